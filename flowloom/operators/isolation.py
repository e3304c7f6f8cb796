"""Isolation forest: random cut trees on bounded subsamples, path lengths as scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODES = "tree int, node int, dim int, cut double, size int"


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def subsamples(df: DataFrame, key: str, vector: str, trees: int, size: int, seed: int) -> DataFrame:
    """``(tree, vector)``: ``size`` rows per tree, those of the smallest hashes of (seed, tree, key).

    A row is copied for a tree only where its hash is under a threshold that about twice ``size`` rows pass.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("vector"))
    share = min(1.0, 2.0 * size / max(rows.count(), 1) + 16.0 / max(rows.count(), 1))
    hashed = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col("_k")), F.lit(1 << 30))
    hits = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: hashed(t) < int(share * (1 << 30)))
    dealt = rows.withColumn("tree", F.explode(hits))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(hashed(F.col("tree")), "_k"))
    return dealt.withColumn("_r", rank).where(F.col("_r") <= size).select("tree", "vector")


def grow(tree: int, x: np.ndarray, seed: int) -> list[tuple]:
    """Nodes of one tree; the children of node j are 2 j + 1 and 2 j + 2. Leaves have dimension -1."""
    rng, most = np.random.default_rng([seed, tree]), max(1, math.ceil(math.log2(max(len(x), 2))))
    out, todo = [], [(0, x, 0)]
    while todo:
        node, rows, depth = todo.pop()
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        split = np.flatnonzero(high > low)
        if depth == most or len(rows) <= 1 or not len(split):
            out.append((tree, node, -1, 0.0, len(rows)))
            continue
        dim = int(rng.choice(split))
        cut = float(rng.uniform(low[dim], high[dim]))
        left = rows[:, dim] < cut
        out.append((tree, node, dim, cut, len(rows)))
        todo += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
    return out


def fit(df: DataFrame, key: str, vector: str, trees: int = 100, size: int = 256, seed: int = 42) -> DataFrame:
    """``NODES`` of a forest, every tree grown in a task on its own ``size`` rows."""

    def grown(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["vector"].to_numpy())
        x = x[np.lexsort(x.T[::-1])]  # the same tree whatever the order of the rows
        return pd.DataFrame(grow(int(group["tree"].iloc[0]), x, seed), columns=[c.split()[0] for c in NODES.split(", ")])

    return subsamples(df, key, vector, trees, size, seed).groupBy("tree").applyInPandas(grown, NODES)


def paths(x: np.ndarray, nodes: dict[int, tuple]) -> np.ndarray:
    """Path length of every row through one tree: all rows go down a level at once."""
    most = max(nodes) + 1
    dim, cut, rest = np.full(most, -1), np.zeros(most), np.zeros(most)
    for node, (d, c, n) in nodes.items():
        dim[node], cut[node], rest[node] = d, c, expected_path(n)
    at, depth = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    while (inner := np.flatnonzero(dim[at] >= 0)).size:
        right = x[inner, dim[at[inner]]] >= cut[at[inner]]
        at[inner] = 2 * at[inner] + 1 + right
        depth[inner] += 1
    return depth + rest[at]


def anomaly(df: DataFrame, vector: str, forest: DataFrame, size: int = 256) -> DataFrame:
    """Adds ``anomaly`` = 2 ** -(mean path / expected path), near 1 for rows cut off early; null vectors give null.

    ``size`` is that of the subsamples. The forest, trees x 2 ``size`` rows whatever the data, is broadcast; rows are scored by Arrow batches.
    """
    trees: dict[int, dict] = {}
    for r in forest.collect():
        trees.setdefault(r.tree, {})[r.node] = (r.dim, r.cut, r.size)
    used = max((t[0][2] for t in trees.values()), default=1)
    shared = df.sparkSession.sparkContext.broadcast(list(trees.values()))
    scale = max(expected_path(min(size, used)), 1e-9)

    @F.pandas_udf("double")
    def rated(vectors: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=vectors.index)
        there = vectors.notna()
        if there.any() and shared.value:
            x = np.stack(vectors[there].to_numpy())
            out[there] = 2.0 ** (-np.mean([paths(x, t) for t in shared.value], axis=0) / scale)
        return out

    return df.withColumn("anomaly", F.when(F.col(vector).isNotNull(), rated(F.col(vector).cast("array<double>"))))
