"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

Documents are tokenised and cut into full windows and smaller pieces. Blocks of
pieces are packed independently: partial partitions with opposing imbalances are
merged until one near-equal partition is left, and the number of windows rises
whenever the fullest would exceed the capacity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import IdWriter, default_path, loaded
from .common import read_table

END_ID = 1
#: The rest of one document in ``FINE_SHARE`` is halved down to ``FINEST`` ids, so that the last merges of the
#: differencing have small pieces by which to level the windows.
FINE_SHARE, FINEST = 4, 16


def differencing(sizes: np.ndarray, ways: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin of every size, sum of every bin)``: Karmarkar-Karp for ``ways`` bins.

    A partial partition keeps the sums of its non-empty bins in descending order.
    The two with the largest spread are merged, the fullest bin of one joining the
    emptiest of the other.
    """
    n = len(sizes)
    parent = np.full(2 * n + 1, -1, dtype=np.int64)  # bins form trees over the pieces
    fresh = n
    heap: list = [(-int(s), i, np.array([s], dtype=np.int64), np.array([i])) for i, s in enumerate(sizes)]
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if ways == 1:
        return np.zeros(n, dtype=np.int64), np.array([sizes.sum()], dtype=np.int64)
    heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, sa, na = heappop(heap)
        _, _, sb, nb = heap[0]
        over = len(sa) + len(sb) - ways
        if over <= 0:
            sums, nodes = np.concatenate((sa, sb)), np.concatenate((na, nb))
        else:  # the fullest bins of either join empty ones, the last ``over`` of both join each other crosswise
            joined = sa[len(sa) - over :] + sb[len(sb) - over :][::-1]
            new = np.arange(fresh, fresh + over)
            fresh += over
            if fresh > len(parent):
                parent = np.concatenate((parent, np.full(max(len(parent), fresh), -1, dtype=np.int64)))
            parent[na[len(na) - over :]] = new
            parent[nb[len(nb) - over :][::-1]] = new
            sums = np.concatenate((sa[: len(sa) - over], sb[: len(sb) - over], joined))
            nodes = np.concatenate((na[: len(na) - over], nb[: len(nb) - over], new))
        by = np.argsort(-sums, kind="stable")
        sums, nodes = sums[by], nodes[by]
        spread = sums[0] - (sums[-1] if len(sums) == ways else 0)
        heapreplace(heap, (-int(spread), order, sums, nodes))
        order += 1
    _, _, sums, nodes = heap[0]
    root = np.arange(len(parent))
    at = np.arange(n)
    while True:
        up = parent[at]
        if (up < 0).all():
            break
        at = np.where(up >= 0, up, at)
    index = np.full(len(root), -1, dtype=np.int64)
    index[nodes] = np.arange(len(nodes))
    return index[at], sums


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of every piece; no window holds more than ``capacity`` (each size is at most that)."""
    ways = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        bins, sums = differencing(sizes, ways)
        if not len(sums) or sums.max() <= capacity:
            return bins
        ways += max(1, ways // 200)


def cut_points(n: int, capacity: int, grain: int, finest: int) -> np.ndarray:
    """Starts of the pieces of ``n`` ids: full windows, pieces of ``grain``, then halves of what is left down to ``finest``."""
    full, rest = divmod(n, capacity)
    coarse, rest = divmod(rest, grain)
    sizes = [capacity] * full + [grain] * coarse
    while rest > finest:
        sizes.append(rest - rest // 2)
        rest //= 2
    if rest:
        sizes.append(rest)
    return np.cumsum([0, *sizes[:-1]], dtype=np.int64)


PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, capacity: int, grain: int, path: str) -> DataFrame:
    """One row per piece of every document, with the number of its row; its ids end with ``END_ID``."""
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        write = loaded(IdWriter, path)
        for batch in batches:
            ids, rows = [], []
            for doc_id, text, row in zip(batch["doc_id"], batch["text"], batch["row"].tolist()):
                data = write(text) + end
                n = len(data) // 4
                starts = cut_points(n, capacity, grain, FINEST if zlib.crc32(data) % FINE_SHARE == 0 else grain).tolist()
                for a, b in zip(starts, [*starts[1:], n]):
                    ids.append(doc_id)
                    rows.append((a, b - a, zlib.crc32(data[4 * a : 4 * b]), n, row))
            out = pd.DataFrame(rows, columns=["start", "length", "ids_crc32", "doc_tokens", "row"], dtype=np.int64)
            out.insert(0, "doc_id", pd.Series(ids, dtype=object))
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return numbered.mapInPandas(cut, PIECE.format(id=kind) + ", row long")


def pack(
    docs: DataFrame, capacity: int = 2048, grain: int = 512, block_docs: int = 512, path: str | None = None
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: each sequence is gapless from 0 and at most ``capacity`` long.

    Only lengths and checksums are shuffled, never ids or texts. Pieces are dealt
    by a hash of row number and start, so repeated rows too, into blocks of about
    ``block_docs`` documents; a block wastes less than
    one window beyond what differencing leaves uneven. Null text is empty and so one
    id long; null ids and repeated rows are packed like any other row. An empty
    table gives an empty result.
    """
    path = path or default_path()
    blocks = max(1, -(-docs.count() // block_docs))
    cut = pieces(docs, capacity, grain, path).withColumn(
        "block", F.pmod(F.xxhash64("row", "start"), F.lit(blocks))
    ).drop("row")

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        size = rows["length"].to_numpy()
        window = np.zeros(len(rows), dtype=np.int64)
        whole = size == capacity
        window[~whole] = pack_sizes(size[~whole], capacity)
        window[whole] = np.arange(whole.sum()) + (window[~whole].max() + 1 if (~whole).any() else 0)
        by = np.argsort(window, kind="stable")
        ends = np.cumsum(size[by])
        first = np.concatenate(([True], window[by][1:] != window[by][:-1]))
        base = np.maximum.accumulate(np.where(first, ends - size[by], 0))
        offset = np.empty(len(rows), dtype=np.int64)
        offset[by] = ends - size[by] - base
        return rows.assign(sequence_id=rows["block"].to_numpy() * (1 << 32) + window, offset=offset).drop(columns="block")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut.groupBy("block").applyInPandas(place, PIECE.format(id=kind) + ", sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents; of the columns only ``doc_id`` and ``text`` count.

    Nulls, empty texts, repeated rows and an empty table are treated as in ``pack``.
    """
    return pack(docs)
