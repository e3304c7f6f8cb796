"""Hard negatives by partial products in rotated space.

The eigenvectors of the table's second moments rotate all vectors; most of an inner product is then
in its leading components. For a block of anchors, each task multiplies the first components of its
rows, adds the product of the norms of what is left and a slack for rounding, and so has a bound for
every score. Pairs whose bound cannot enter an anchor's lists are discarded; the others get further components,
and those that survive all steps are verified with products of integers, which alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.projection import components, moments
from .common import durable, read_table

#: Anchors that are held at once, rows that are multiplied at once, rows that give first thresholds.
BLOCK, STRIP, SAMPLE = 4096, 512, 4096
BEST = 5
_NONE = np.iinfo(np.int64).min
LISTED = "a int, slot int, id long, score long"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(id, label, q)`` of rows that take part: ids modulo 7 relabelled, components floor(256 * x), zeros up to the longest length."""
    e = F.col(embedding)
    sound = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    found = vectors.where(F.coalesce(e.isNotNull() & sound, F.lit(False)))
    number = F.col(vec_id).cast("long")
    relabelled = F.when(number % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))
    q = F.transform(e, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    rows = found.select(number.alias("id"), relabelled.cast("long").alias("label"), q.alias("q"))
    longest = rows.agg(F.max(F.size("q"))).first()[0] or 0
    return rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("q"))))


def integers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


class Rotation:
    """Rotates integer vectors; knows the steps of components and what each leaves."""

    def __init__(self, second: np.ndarray):
        self.turn = components(second)[1].T
        d = len(second)
        self.steps = sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2), d} if d else {0})

    def of(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rotated vectors, the norm left after each step, and whole norms."""
        y = q.astype(np.float64) @ self.turn
        left = np.stack([np.sqrt((y[:, k:] ** 2).sum(axis=1)) for k in self.steps], axis=1)
        return y, left, np.sqrt((y**2).sum(axis=1))

    def survivors(self, rows: tuple, anchors: tuple, fits: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, anchor) of ``fits`` whose score can lie between an anchor's ``low`` and ``high``."""
        (y, y_left, y_norm), (a, a_left, a_norm) = rows, anchors
        k = self.steps[0]
        part = y[:, :k] @ a[:, :k].T
        slack = 1e-9 * y_norm[:, None] * a_norm[None, :] + 1e-6  # far above what sums of doubles lose
        room = y_left[:, :1] * a_left[None, :, 0] + slack
        i, j = np.nonzero(fits & (part + room >= low[None, :]) & (part - room <= high[None, :]))
        part, slack = part[i, j], slack[i, j]
        for s in range(1, len(self.steps)):
            k, upto = self.steps[s - 1], self.steps[s]
            part = part + np.einsum("nd,nd->n", y[i, k:upto], a[j, k:upto])
            room = y_left[i, s] * a_left[j, s] + slack
            stay = (part + room >= low[j]) & (part - room <= high[j])
            i, j, part, slack = i[stay], j[stay], part[stay], slack[stay]
        return i, j


class Lists:
    """The best ``BEST`` entries of every slot: higher scores first, ties by smaller id."""

    def __init__(self, slots: int):
        self.slot, self.id, self.score = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least = np.full(slots, _NONE)  # the last score of a full list

    def add(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(slot):
            return
        slot, ids, score = (np.concatenate(x) for x in ((self.slot, slot), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        begins = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        place = np.arange(len(slot)) - np.repeat(begins, np.diff(np.append(begins, len(slot))))
        stay = place < BEST
        full = place == BEST - 1
        self.least[slot[full]] = score[full]
        self.slot, self.id, self.score = slot[stay], ids[stay], score[stay]


def _scores(q: np.ndarray, anchors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs."""
    return np.concatenate([np.einsum("nd,nd->n", q[i[k : k + 65536]], anchors[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0, dtype=np.int64)


class Search:
    """One block of anchors against rows; ``goals`` (per anchor its positives' scores, downwards) asks for negatives, none for positives."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, rotation: Rotation, goals: np.ndarray | None = None):
        self.ids, self.labels, self.q, self.rotation, self.goals = ids, labels, q, rotation, goals
        self.rotated = rotation.of(q)

    def lists(self) -> Lists:
        return Lists(len(self.ids) * (1 if self.goals is None else BEST))

    def bounds(self, lists: Lists, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What scores can still enter an anchor's lists; ``floor`` is known of each slot beforehand."""
        least = np.maximum(lists.least, floor)
        if self.goals is None:
            return np.where(least == _NONE, -np.inf, least), np.full(len(self.ids), np.inf)
        low = np.maximum(np.where(least == _NONE, -np.inf, least).reshape(-1, BEST), self.goals * 0.8)
        wanted = self.goals >= 0  # a negative score has no band
        return np.where(wanted, low, np.inf).min(axis=1), np.where(wanted, self.goals, -np.inf).max(axis=1)

    def look(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, lists: Lists, floor: np.ndarray) -> None:
        for k in range(0, len(ids), STRIP):
            id_, label, x = ids[k : k + STRIP], labels[k : k + STRIP], q[k : k + STRIP]
            same = label[:, None] == self.labels[None, :]
            fits = same & (id_[:, None] != self.ids[None, :]) if self.goals is None else ~same
            low, high = self.bounds(lists, floor)
            i, j = self.rotation.survivors(self.rotation.of(x), self.rotated, fits, low, high)
            score = _scores(x, self.q, i, j)
            if self.goals is None:
                lists.add(j, id_[i], score)
                continue
            for p in range(BEST):
                goal = self.exact[j, p]
                inside = (self.goals[j, p] >= 0) & (80 * goal <= 100 * score) & (score <= goal)
                lists.add(j[inside] * BEST + p, id_[i][inside], score[inside])

    @property
    def exact(self) -> np.ndarray:
        return np.where(np.isfinite(self.goals), self.goals, 0).astype(np.int64)


def _mined(rows: DataFrame, search: Search, sample: tuple) -> DataFrame:
    """``LISTED``: the best of every slot over all rows; every task hands on its own best."""
    first = search.lists()
    search.look(*sample, first, np.full(len(first.least), _NONE))
    shared = rows.sparkSession.sparkContext.broadcast((search, first.least))  # BLOCK vectors

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, floor = shared.value
        lists = search.lists()
        for batch in batches:
            if batch.num_rows:
                search.look(batch.column("id").to_numpy(), batch.column("label").to_numpy(), integers(batch.column("q")), lists, floor)
        per = 1 if search.goals is None else BEST
        yield pa.RecordBatch.from_arrays(
            [pa.array((lists.slot // per).astype(np.int32)), pa.array((lists.slot % per).astype(np.int32)), pa.array(lists.id), pa.array(lists.score)], ["a", "slot", "id", "score"]
        )

    order = Window.partitionBy("a", "slot").orderBy(F.col("score").desc(), "id")
    return rows.mapInArrow(work, LISTED).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)


def hard_negatives(vectors: DataFrame, every: int = 100, block: int = BLOCK, **columns: str) -> DataFrame:
    """``OUT``: of every anchor (id divisible by ``every``) and each of its positives, the first negatives.

    Anchors meet all rows ``block`` at a time; what is broadcast is a block of vectors, what the driver
    gets is their positives. Rows without an id take no part either; shorter vectors are padded by zeros; a row never
    is a partner of its own id; repeated rows count as often as they occur, repeated anchors once; equal scores go by
    id; a positive without negatives gives no row; an empty table gives an empty result; other columns are not looked at.
    Scores must fit a long.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, **columns)
    anchors = durable(rows.where(F.col("id") % every == 0).distinct())
    n = anchors.count()
    if not n:
        return spark.createDataFrame([], OUT)
    rotation = Rotation(moments(rows, "q")[2])
    blocks = -(-n // block)
    share = rows.agg(F.count(F.lit(1))).first()[0] // SAMPLE + 1
    kept = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(share)) == 0).limit(2 * SAMPLE).toArrow()  # thresholds only
    sample = tuple(np.asarray(kept[c]) for c in ("id", "label")) + (integers(kept["q"].combine_chunks()) if len(kept) else np.zeros((0, len(rotation.turn)), dtype=np.int64),)
    out = None
    for b in range(blocks):
        held = anchors.where(F.pmod(F.xxhash64("id", "label", "q"), F.lit(blocks)) == b).toArrow()
        if not len(held):
            continue
        search = Search(np.asarray(held["id"]), np.asarray(held["label"]), integers(held["q"].combine_chunks()), rotation)
        found = _mined(rows, search, sample).toPandas()  # BEST rows per anchor of the block
        goals = np.full((len(held), BEST), -np.inf)
        goals[found["a"], found["rank"] - 1] = found["score"]
        positives = pd.DataFrame({
            "a": found["a"].astype("int32"), "slot": (found["rank"] - 1).astype("int32"), "anchor_id": search.ids[found["a"]], "positive_id": found["id"], "positive_score": found["score"],
        })
        known = spark.createDataFrame(positives, "a int, slot int, anchor_id long, positive_id long, positive_score long")
        mined = _mined(rows, Search(search.ids, search.labels, search.q, rotation, goals), sample)
        part = durable(mined.join(F.broadcast(known), ["a", "slot"]).select(  # BEST rows per anchor of the block
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ))
        out = part if out is None else out.unionByName(part)
    return out


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read_table(spark, sf_dir, "embeddings"))
