"""Embedding near-duplicates by NN-descent.

First neighbour lists are cheap: groups of a few vectors dealt by hash, and few tables of random
hyperplanes. Rounds join neighbours with neighbours' neighbours, in either direction, and keep the
best; a list that is full of entries over the threshold is saturated and is enlarged. Rounds go on, over the
neighbourhoods that changed, until few entries change. Entries and compared pairs over the
threshold are edges; edges make components. Where lists stay saturated, near copies may hide links to
other clumps, so further rounds keep lists of vectors of other components only. All links of a
component lie inside it; they are counted exactly, tile by tile. Vectors whose id is
divisible by ``AUDITED`` are then compared with all vectors, to measure only: while too many of
their links are missing, the search goes on with fresh first lists, and a result under
``LEAST_RECALL`` is an error.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, min_components, read_table

#: Members of a bucket that are compared at once; larger buckets are split.
TILE = 1024
#: Members of a component whose links are counted at once; a larger one is dealt into chunks, compared pair by pair.
COUNT_TILE = 8192
#: Rows of a product of vectors that are held at once.
STRIP = 512
#: Every vector whose id is divisible by this is audited, so many of them at a time.
AUDITED, AUDIT_BLOCK = 50, 4096
#: The least mean share of a vector's links that a result must have.
LEAST_RECALL = 0.9
#: Vectors of a group dealt by hash, dealings (several, so that groups overlap), and vectors of a hyperplane bucket, in first lists.
FEW, DEALS, BUCKET = 5, 3, 32
#: The round that changes at most this share of the lists' entries is the last (of lists apart: if it finds no edge either).
STILL = 0.25
#: Hyperplanes that split a too large bucket at once, at most.
SPLITS = 8
PAIR = "a long, b long, sim double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; all vectors have one length here."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_group(work: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """mapInArrow body for rows sorted by column ``g``: hands over one group at a time."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if kept is not None:
                rows = pa.concat_tables([kept, rows]).combine_chunks()
            g = rows["g"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                yield from work(rows.slice(s, e - s))
            kept = rows.slice(int(starts[-1]))
        if kept is not None and kept.num_rows:
            yield from work(kept)

    return body


def _batched(work):
    """Joins the small results of many groups into batches."""

    def body(batches):
        held, size = [], 0
        for batch in _by_group(work)(batches):
            held.append(batch)
            size += batch.num_rows
            if size > 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return body


def _pairs(a, b, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], ["a", "b", "sim"])


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _foreign(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines of a group; members of one component count as -2 to each other."""
    x, part = _matrix(_column(rows, "vec")), rows["comp"].to_numpy()
    sim = x @ x.T
    sim[part[:, None] == part[None, :]] = -2
    return rows["node"].to_numpy(), sim


def _lowest(near: np.ndarray) -> np.ndarray:
    """Lowest position that each position reaches over ``near``."""
    low = np.arange(len(near))
    at = np.flatnonzero(near.any(axis=1))
    if not len(at):
        return low
    near, part = near[np.ix_(at, at)], np.arange(len(at))
    while True:
        least = np.minimum(part, np.where(near, part[None, :], len(at)).min(axis=1))
        least = least[least]
        if (least == part).all():
            low[at] = at[part]
            return low
        part = least


def _compared(ids: np.ndarray, sim: np.ndarray, k: int, threshold: float, kth: np.ndarray, apart: bool) -> Iterator[pa.RecordBatch]:
    """Of all compared pairs: edges without ``sim`` that join what those over ``threshold`` join, fewer than
    there are members; and for every vector the best ``k`` members, if better than ``kth`` (``apart``: of those that the edges do not join to it)."""
    low = _lowest(sim >= threshold)
    i = np.flatnonzero(low != np.arange(len(low)))
    if len(i):
        yield _pairs(ids[i], ids[low[i]], np.full(len(i), np.nan))
        if apart:
            sim[low[:, None] == low[None, :]] = -2
    np.fill_diagonal(sim, -2)
    m = min(k, len(ids) - 1)
    at = np.argpartition(-sim, m - 1, axis=1)[:, :m]
    best = np.take_along_axis(sim, at, 1)
    real = (best > kth[:, None]).ravel()
    yield _pairs(np.repeat(ids, m)[real], ids[at].ravel()[real], best.ravel()[real])


def _best_in_group(k: int, threshold: float, apart: bool):
    """Body for groups of a first list: the best ``k`` of every member, no edges but theirs."""

    def work(rows: pa.Table):
        if rows.num_rows > 1:
            ids, sim = _foreign(rows)
            yield from _compared(ids, sim, k, 2.0, np.full(len(ids), -1.5), apart)

    return work


def _improving(k: int, threshold: float, apart: bool):
    def work(rows: pa.Table):
        if rows.num_rows > 1:
            ids, sim = _foreign(rows)
            yield from _compared(ids, sim, k, threshold, rows["kth"].to_numpy(), apart)

    return work


def listed(found: DataFrame) -> DataFrame:
    return found.where(~F.isnan("sim"))


def links(found: DataFrame) -> DataFrame:
    return found.where(F.isnan("sim")).select("a", "b").distinct()


def parted(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``(node, vec, comp)``: a vector without a label is a component of its own."""
    if labels is None:
        return nodes.select("node", "vec", F.col("node").alias("comp"))
    return nodes.select("node", "vec").join(labels, "node", "left").select(
        "node", "vec", F.coalesce("component", "node").alias("comp")
    )


def classes(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``(node, vec, copies, id, asked)``: one row per distinct usable vector, padded to one length.

    ``node`` is the vector's hash, ``copies`` how many rows hold it, ``asked`` whether it
    is audited. Null and zero vectors and those with a null or non-finite component are left out.
    """
    e = F.col(embedding)
    usable = (
        F.col(vec_id).isNotNull() & e.isNotNull()
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(e, lambda x: x != 0)
    )
    found = vectors.where(F.coalesce(usable, F.lit(False)))
    longest = found.agg(F.max(F.size(e))).first()[0] or 0
    padded = F.concat(e, F.array_repeat(F.lit(0).cast(vectors.schema[embedding].dataType.elementType), F.lit(longest) - F.size(e)))
    return found.groupBy(F.xxhash64(e).alias("node")).agg(
        F.first(padded).alias("vec"), F.count(F.lit(1)).alias("copies"), F.min(vec_id).alias("id"),
        F.max(F.coalesce(F.col(vec_id).cast("long") % AUDITED == 0, F.lit(False))).alias("asked"),
    )


def top(candidates: DataFrame, k: int, threshold: float) -> DataFrame:
    """The best ``k`` distinct entries of every list; saturated lists get two or four times as many.

    Each task cuts its part before the shuffle.
    """
    of, order = Window.partitionBy("a"), (F.col("sim").desc(), F.col("b"))
    rank = F.dense_rank().over(of.orderBy(*order))
    best = candidates.withColumn("r", rank).where(F.col("r") <= 4 * k)
    full = F.max(F.when(F.col("sim") >= threshold, F.col("r")).otherwise(0)).over(of)
    width = F.when(full >= 2 * k, 4 * k).when(full >= k, 2 * k).otherwise(k)
    return best.withColumn("w", width).where("r <= w").dropDuplicates(["a", "b"]).select("a", "b", "sim")


def dealt(members: DataFrame, group: str) -> DataFrame:
    """Column ``g``: groups of at most about two times ``COUNT_TILE`` members in which every pair of a ``group`` meets.

    A larger group is dealt into chunks ``c``, and each pair of chunks makes a group.
    """
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = members.join(sizes, group).withColumn("t", F.ceil(F.col("m") / COUNT_TILE).cast("int"))
    met = met.withColumn("c", F.pmod(F.xxhash64("node", group), F.col("t")).cast("int"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    lo, hi = F.least("c", "o"), F.greatest("c", "o")
    return met.select("*", F.xxhash64(group, lo, hi).alias("g"), (lo != hi).alias("crossed")).drop("m", "t", "o", group)


def split(members: DataFrame, nodes: DataFrame, dim: int, tables: int, seed: int) -> DataFrame:
    """``(node, table, g)``: buckets of at most ``TILE`` members, near vectors together.

    A larger bucket is cut by up to ``SPLITS`` random hyperplanes through its own centre,
    other ones in each table, and its parts again until none is too large. Vectors of one
    direction cannot be cut: they are dealt into chunks that share one of them.
    """
    done, level = [], 0
    while True:
        members = durable(members)
        large = members.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > TILE)
        large = durable(large)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done + [members])
        done.append(members.join(large, "g", "left_anti"))
        planes = np.random.default_rng([seed, level]).standard_normal((tables, dim, SPLITS))

        def project(batches, planes=planes):
            for batch in batches:
                if batch.num_rows:
                    x, table = _matrix(batch.column("vec")), batch.column("table").to_numpy()
                    over = np.empty((len(x), SPLITS))
                    for t in np.unique(table):
                        over[table == t] = x[table == t] @ planes[t]
                    flat = pa.array(over.ravel())
                    ends = pa.array(np.arange(0, over.size + 1, SPLITS, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(c) for c in ("node", "table", "g", "m")] + [pa.ListArray.from_arrays(ends, flat)],
                        ["node", "table", "g", "m", "p"],
                    )

        inside = members.join(large, "g").join(nodes.select("node", "vec"), "node").select("node", "table", "g", "m", "vec")
        inside = durable(inside.mapInArrow(project, "node long, table int, g long, m long, p array<double>"))
        p = [F.col("p")[j] for j in range(SPLITS)]
        centres = inside.groupBy("g").agg(
            F.array(*[F.avg(x) for x in p]).alias("centre"), (F.max(p[0]) - F.min(p[0]) < 1e-9).alias("flat"), F.min("node").alias("pivot")
        )
        met = inside.join(centres, "g")
        wanted = F.least(F.lit(SPLITS), F.ceil(F.log2(F.col("m") / TILE)) + 1)
        side = F.array(*[(F.lit(j) < wanted) & (x > F.col("centre")[j]) for j, x in enumerate(p)])
        chunk = F.pmod(F.xxhash64("node", "g"), F.ceil(2 * F.col("m") / TILE))
        flat = met.where("flat").withColumn("c", chunk)
        pivots = flat.select(F.col("pivot").alias("node"), "table", F.xxhash64("g", "c").alias("g")).distinct()
        done.append(flat.where("node <> pivot").select("node", "table", F.xxhash64("g", "c").alias("g")).unionByName(pivots))
        members = met.where("not flat").select("node", "table", F.xxhash64("g", side).alias("g"))
        level += 1


def bits_for(n: int, bucket: int) -> int:
    """Hyperplanes of a table so that ``bucket`` of ``n`` vectors share a bucket."""
    return min(40, max(1, math.ceil(math.log2(max(n, 2) / bucket))))


def first_lists(nodes: DataFrame, n: int, dim: int, k: int, bits: int, tables: int, seed: int, threshold: float, apart: bool) -> DataFrame:
    """The best ``k`` of other components among about ``FEW`` vectors dealt by hash ``DEALS`` times and in each of ``tables`` hyperplane buckets."""
    deal = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    group = F.pmod(F.xxhash64("node", "deal", F.lit(seed)), F.lit(n // FEW + 1))
    grouped = deal.select("node", F.lit(-1).alias("table"), F.xxhash64(group, "deal", F.lit("dealt")).alias("g"))
    if tables:
        grouped = grouped.unionByName(in_buckets(nodes, dim, bits, tables, seed))
    around = grouped.join(nodes, "node").select("g", "node", "vec", "comp")
    return around.repartition("g").sortWithinPartitions("g").mapInArrow(_batched(_best_in_group(k, threshold, apart)), PAIR)


def in_buckets(nodes: DataFrame, dim: int, bits: int, tables: int, seed: int) -> DataFrame:
    """``(node, table, g)``: hyperplane buckets, too large ones split."""
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    powers = 1 << np.arange(bits, dtype=np.int64)

    def signed(batches):
        for batch in batches:
            if batch.num_rows:
                over = (_matrix(batch.column("vec")) @ planes > 0).reshape(batch.num_rows, tables, bits)
                table = np.arange(tables)
                code = (over * powers).sum(axis=2) * tables + table
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(batch.column("node").to_numpy(), tables)),
                        pa.array(np.tile(table.astype(np.int32), batch.num_rows)),
                        pa.array(code.ravel()),
                    ],
                    ["node", "table", "g"],
                )

    return split(nodes.select("node", "vec").mapInArrow(signed, "node long, table int, g long"), nodes, dim, tables, seed)


def refine(lists: DataFrame, nodes: DataFrame, k: int, threshold: float, changed: DataFrame, apart: bool) -> DataFrame:
    """One round: neighbours of a vector, in either direction, are compared with each other and with it.

    Only around vectors to which one of the pairs ``changed`` belongs.
    """
    back = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")
    # of the reverse lists the best k count, so that a hub's neighbourhood stays bounded
    members = lists.select("a", "b").unionByName(top(back, k, 2.0).select("a", "b"))
    members = members.unionByName(lists.select("a", F.col("a").alias("b"))).distinct()
    active = changed.select("a").unionByName(changed.select(F.col("b").alias("a"))).distinct()
    kth = lists.groupBy("a").agg(F.min("sim").alias("kth"), F.count(F.lit(1)).alias("n")).select(
        F.col("a").alias("node"), F.when(F.col("n") < k, F.lit(-1.5)).otherwise(F.col("kth")).alias("kth")
    )
    held = nodes.join(kth, "node", "left").select("node", "vec", "comp", F.coalesce("kth", F.lit(-1.5)).alias("kth"))
    around = members.join(active, "a", "left_semi").select(F.col("a").alias("g"), F.col("b").alias("node")).join(held, "node").select("g", "node", "vec", "comp", "kth")
    return around.repartition("g").sortWithinPartitions("g").mapInArrow(_batched(_improving(k, threshold, apart)), PAIR)


def joined(labels: DataFrame | None, more: DataFrame) -> DataFrame:
    """Labels ``(node, component)`` after the links ``more``; earlier labels count as links."""
    if labels is not None:
        more = more.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return min_components(more, "a", "b")


def foreign(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b", "sim")


def descend(
    nodes: DataFrame, labels: DataFrame | None, n: int, dim: int, threshold: float, k: int, bits: int, tables: int, seed: int, apart: bool, trail: list | None
) -> tuple[DataFrame, DataFrame]:
    """``(lists, labels)`` after rounds from first lists; ``apart``: lists hold other components only.

    A round writes two tables, its pairs and the new lists with a mark on new entries; edges make components at the end,
    or, where lists stand ``apart``, after each round that has found some.
    """

    def note(step: str, edges: DataFrame) -> None:
        if trail is not None:
            linked, parts = joined(labels, edges).agg(F.count(F.lit(1)), F.count_distinct("component")).first()
            trail.append((step, linked - parts))

    near = lambda lists: lists.where(F.col("sim") >= threshold).select("a", "b")
    comps = parted(nodes, labels if apart else None)
    lists = durable(top(first_lists(comps, n, dim, k, bits, tables, seed, threshold, apart), k, threshold))
    edges = near(lists)
    note("first", edges)
    if apart:
        labels, comps, edges = _relabelled(nodes, labels, edges)
        lists = durable(foreign(lists, labels))
    changed = lists
    while True:
        met = durable(refine(lists, comps, k, threshold, changed, apart))
        none = True
        if apart:
            more = foreign(links(met).withColumn("sim", F.lit(1.0)), labels)
            none = more.isEmpty()
            if not none:
                labels, comps, _ = _relabelled(nodes, labels, more)
        else:
            edges = edges.unionByName(links(met))
        note("round", edges if edges is not None else links(met))
        back = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")
        found = lists.select("a", "b", "sim").unionByName(back).unionByName(listed(met))
        grown = top(foreign(found, labels) if apart else found, k, threshold)
        lists = durable(grown.join(lists.select("a", "b", F.lit(True).alias("old")), ["a", "b"], "left"))
        moved, held = lists.agg(F.count(F.when(F.col("old").isNull(), 1)), F.count(F.lit(1))).first()
        changed, lists = lists.where("old is null"), lists.select("a", "b", "sim")
        if none and moved <= STILL * held:
            return lists, labels if apart else joined(labels, edges.unionByName(near(lists)))


def _relabelled(nodes: DataFrame, labels: DataFrame | None, edges: DataFrame) -> tuple[DataFrame, DataFrame, None]:
    labels = joined(labels, edges.select("a", "b"))
    return labels, parted(nodes, labels), None


def saturated(lists: DataFrame, k: int, threshold: float) -> bool:
    """Whether a list is as long as lists get and holds nothing under the threshold."""
    return not lists.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least")).where((F.col("n") >= 4 * k) & (F.col("least") >= threshold)).isEmpty()


def search(
    nodes: DataFrame, labels: DataFrame | None, n: int, dim: int, threshold: float, k: int, bits: int, tables: int, seed: int, trail: list | None = None
) -> DataFrame:
    """Labels ``(node, component)`` of vectors with links after one search, from ``labels`` of an earlier one.

    The first search builds the neighbour graph; where lists stay saturated, and in later searches, lists of other components follow.
    ``trail`` gets how many vectors first lists and each round have joined to others.
    """
    again = labels is not None
    if not again:
        lists, labels = descend(nodes, None, n, dim, threshold, k, bits, tables, seed, False, trail)
        again = saturated(lists, k, threshold)
    if again:
        _, labels = descend(nodes, labels, n, dim, threshold, k, bits, tables, seed + 500, True, trail)
    return labels


def _near(x: np.ndarray, y: np.ndarray, threshold: float, weights: np.ndarray) -> np.ndarray:
    """Weight of the vectors of ``y`` that link with each of ``x``."""
    return np.concatenate([(x[i : i + STRIP] @ y.T >= threshold) @ weights for i in range(0, len(x), STRIP)])


def count_links(nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``(node, linked)``: rows linked to each vector of a component, other than its own copies."""

    def work(rows: pa.Table):
        ids, x = rows["node"].to_numpy(), _matrix(_column(rows, "vec"))
        copies = rows["copies"].to_numpy()
        if rows["crossed"][0].as_py():
            chunk = rows["c"].to_numpy()
            one = chunk == chunk.min()
            linked = np.zeros(len(ids), dtype=np.int64)
            if not one.all():
                linked[one] = _near(x[one], x[~one], threshold, copies[~one])
                linked[~one] = _near(x[~one], x[one], threshold, copies[one])
        else:
            linked = _near(x, x, threshold, copies) - copies
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked)], ["node", "linked"])

    tiles = dealt(labels, "component").join(nodes.select("node", "vec", "copies"), "node")
    counted = tiles.select("g", "node", "c", "crossed", "vec", "copies").repartition("g").sortWithinPartitions("g")
    return counted.mapInArrow(_batched(work), "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def audit(nodes: DataFrame, threshold: float) -> DataFrame:
    """``(node, due)``: links of the asked vectors with all others, by brute force, a bounded block of them at a time.

    Only counts leave the tasks, one row for each task and asked vector.
    """
    sc = nodes.sparkSession.sparkContext
    asked = nodes.where("asked")
    blocks = max(1, -(-asked.count() // AUDIT_BLOCK))
    parts = []
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k).select("node", "vec", "copies").toArrow()
        if not block.num_rows:
            continue
        shared = sc.broadcast((block["node"].to_numpy(), block["copies"].to_numpy(), _matrix(_column(block, "vec"))))

        def compare(batches, shared=shared):
            ids, copies, x = shared.value
            counts = np.zeros(len(ids), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    counts += _near(x, _matrix(batch.column("vec")), threshold, batch.column("copies").to_numpy())
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(counts[at])], ["node", "met"])

        met = nodes.select("vec", "copies").mapInArrow(compare, "node long, met long")
        parts.append(durable(met.groupBy("node").agg(F.sum("met").alias("met"))))
    if not parts:
        return nodes.sparkSession.createDataFrame([], "node long, due long")
    own = nodes.select("node", "copies")
    return reduce(DataFrame.unionByName, parts).join(own, "node").select("node", (F.col("met") - F.col("copies")).alias("due"))


def recall_of(truth: DataFrame, linked: DataFrame) -> float:
    """Mean share of its own links that an audited vector with links has; 1 if none has any."""
    own = truth.where("due > 0").join(linked, "node", "left")
    share = F.least(F.coalesce("linked", F.lit(0)) / F.col("due"), F.lit(1.0))
    mean = own.agg(F.avg(share)).first()[0]
    return 1.0 if mean is None else mean


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding",
    k: int = 10, tables: int = 2, recall: float = 0.98, tries: int = 4,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    ``n_links`` counts other rows with cosine >= ``threshold``, copies of the same
    vector included. Unusable vectors (null, zero, null or non-finite component)
    link with nothing; shorter vectors are compared as if padded by zeros; a null id
    has a null component and is kept; repeated rows are copies of each other; an empty
    table gives an empty result. While the audited vectors have less than ``recall`` of
    their links on average, the search is repeated between components with other and
    twice as many tables, at most ``tries`` times; a recall that stays lower is reported
    as a warning, one under ``LEAST_RECALL`` as an error.
    """
    nodes = durable(classes(vectors, vec_id, embedding))
    n = nodes.count()
    hashed = vectors.select(F.col(vec_id).alias("vec_id"), F.xxhash64(embedding).alias("node"))
    if not n:
        return hashed.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    dim = nodes.select(F.size("vec")).first()[0]
    # cosines within rounding of the threshold differ by the order of summation
    truth = durable(audit(nodes, threshold + 1e-9))
    bits, labels, got = bits_for(n, BUCKET), None, 0.0
    for attempt in range(tries):
        labels = search(nodes, labels, n, dim, threshold, k, bits, tables << attempt, 1000 + attempt)
        linked = durable(count_links(nodes, labels, threshold))
        got = recall_of(truth, linked)
        if got >= recall:
            break
    if got < LEAST_RECALL:
        raise RuntimeError(f"near-duplicate links: recall {got:.3f} after {tries} searches")
    if got < recall:
        warnings.warn(f"near-duplicate links: recall {got:.3f}", stacklevel=2)
    parts = (
        nodes.select("node", "id", "copies")
        .join(labels, "node", "left")
        .join(linked, "node", "left")
        .select("node", "id", "copies", F.coalesce("component", "node").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked"))
    )
    lowest = parts.groupBy("root").agg(F.min("id").alias("component_id"))
    result = parts.join(lowest, "root").select("node", "component_id", (F.col("linked") + F.col("copies") - 1).alias("n_links"))
    out = hashed.join(result, (hashed.node == result.node) & hashed.vec_id.isNotNull(), "left")
    component = F.when(hashed.vec_id.isNotNull(), F.coalesce("component_id", hashed.vec_id))
    return out.select(
        hashed.vec_id.alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        hashed.vec_id.eqNullSafe(component).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
