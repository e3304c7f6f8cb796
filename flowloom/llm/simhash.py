"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into blocks; two fingerprints that differ in at most
``max_bits`` bits agree on all but ``max_bits`` of them, so they share the key made
of some choice of ``blocks - max_bits`` agreeing blocks. Fingerprints meet on those
keys, distances are verified, and links are contracted to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carry, durable, min_components, read_table, restore

SEED = 42
#: Tells rows of one doc_id but different texts apart.
TEXT_HASH = "xxhash64(coalesce(text, '')) AS th"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose hash bits are counted in one step.
_STEP = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the ``width``-word shingles, repeats included; 0 without words.

    A bit is set if it is set in more than half of the shingle hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        pieces, n = [xxhash.xxh64_intdigest(joined, SEED)], 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        n = len(words) - width + 1
        digest = xxhash.xxh64_intdigest
        pieces = [digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), (ends[width - 1 :] - 1).tolist())]
    hashes = np.array(pieces, dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, _STEP):
        ones += np.unpackbits(hashes[k : k + _STEP], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``(doc_id, th, fp bigint)`` for every row; the bit pattern is kept in a signed long."""

    @F.pandas_udf("long")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", F.expr(TEXT_HASH), digest("text").alias("fp"))


def block_count(n: int, max_bits: int) -> int:
    """Blocks such that random fingerprints put about one of ``n`` under each key."""
    blocks = max_bits + 2
    while blocks < 16 and n > 2 ** ((blocks - max_bits) * (64 // blocks)):
        blocks += 1
    return blocks


def block_keys(fp: Column, blocks: int, max_bits: int) -> Column:
    """Array of keys, one per choice of agreeing blocks; the choice is part of the key."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = sum(masks[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(k).cast("short").alias("k"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("v")))
    return F.array(*keys)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(ids: np.ndarray, fps: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links of one group that connect what all its links connect: each newly reached member once."""
    left = np.argsort(ids, kind="stable")
    while len(left) > 1:
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            grown = []
            for r in reached:
                near = _popcount(fps[left] ^ fps[r]) <= max_bits
                if near.any():
                    for x in left[near]:
                        yield int(ids[r]), int(ids[x])
                    grown.append(left[near])
                    left = left[~near]
                    if not len(left):
                        break
            reached = np.concatenate(grown) if grown else left[:0]


def _links(max_bits: int):
    """mapInPandas body over rows sorted by group ``g``: verified links, linear in a group's size."""

    def verify(g: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(g)])))
        a, b = [], []
        for size in range(2, 9):  # small groups: all at once, pair by pair of positions
            at = starts[sizes == size]
            for i, j in combinations(range(size), 2) if len(at) else ():
                near = _popcount(fps[at + i] ^ fps[at + j]) <= max_bits
                a.append(ids[at[near] + i])
                b.append(ids[at[near] + j])
        for s, size in zip(starts[sizes > 8], sizes[sizes > 8]):
            pairs = list(_forest(ids[s : s + size], fps[s : s + size], max_bits))
            if pairs:
                x, y = zip(*pairs)
                a.append(np.array(x, dtype=np.int64))
                b.append(np.array(y, dtype=np.int64))
        none = np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            g = rows["g"].to_numpy()
            cut = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on
            if cut:
                yield verify(g[:cut], rows["id"].to_numpy()[:cut], rows["fp"].to_numpy().view(np.uint64)[:cut])
            kept = rows.iloc[cut:]
        if kept is not None and len(kept):
            yield verify(kept["g"].to_numpy(), kept["id"].to_numpy(), kept["fp"].to_numpy().view(np.uint64))

    return body


def links(nodes: DataFrame, n: int, max_bits: int = 4, tile: int = 2048) -> DataFrame:
    """Verified links ``(a, b)`` between ``nodes(id, fp)`` with distinct fingerprints.

    Keys held by one fingerprint are dropped before anything is verified. A key
    with over ``tile`` members is dealt into chunks and every pair of chunks is a
    task of its own, so that no group is unbounded; of each group only links that
    connect it are emitted, never all its pairs.
    """
    keyed = nodes.select("id", "fp", F.explode(block_keys(F.col("fp"), block_count(n, max_bits), max_bits)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = keyed.join(sizes, "key").withColumn("t", F.ceil(F.col("m") / tile).cast("int"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("t")).cast("int")
    dealt = met.withColumn("c", chunk).select(
        "id", "fp", "key", "c", F.explode(F.sequence(F.lit(0), F.greatest(F.col("t") - 1, F.lit(0)))).alias("o")
    )
    grouped = dealt.select(
        F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("g"), "id", "fp"
    )
    return (
        grouped.repartition("g")
        .sortWithinPartitions("g")
        .mapInPandas(_links(max_bits), "a long, b long")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def components(docs: DataFrame, width: int, max_bits: int, tile: int) -> DataFrame:
    """``(doc_id, th, fp, component_id)`` per row; ``th`` hashes the text itself."""
    marked = durable(fingerprints(docs.select("doc_id", "text"), width))
    nodes = durable(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")))
    parts = min_components(links(nodes, nodes.count(), max_bits, tile))
    roots = nodes.join(parts, nodes.id == parts.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return marked.join(roots, "fp", "left").select(
        "doc_id", "th", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, tile: int = 2048) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Equal fingerprints (exact copies, and all texts without words) are one node
    whose id is the smallest doc_id. Null and empty texts have fingerprint zero.
    Rows with a null doc_id keep a fingerprint, link nothing and get a null
    component; repeated rows are returned as often as they occur; an empty table
    gives an empty result.
    """
    return components(docs, width, max_bits, tile).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id stays.

    Rows with a null doc_id link nothing and stay; of rows with equal id and text one stays.
    """
    found = components(docs, 4, 4, 2048).where("doc_id is not null")
    each = durable(found.groupBy("doc_id", "th").agg(F.min("component_id").alias("root"), F.count(F.lit(1)).alias("n")))
    gone = each.where("doc_id <> root").select("doc_id", "th")
    twice = each.where("doc_id = root and n > 1").select("doc_id", "th")
    keyed = carry(docs, "doc_id", "text").select("doc_id", F.expr(TEXT_HASH), "_row")
    left = keyed.join(gone, ["doc_id", "th"], "left_anti")
    if not twice.isEmpty():
        once = left.join(twice, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
        left = left.join(twice, ["doc_id", "th"], "left_anti").unionByName(once)
    return restore(left, docs.columns)
