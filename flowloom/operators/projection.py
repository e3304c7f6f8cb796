"""Second moments of vectors, principal components, clustering tendency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MOMENTS = "i int, n long, s double, g array<double>"


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _rows(n: int, sums: np.ndarray, gram: np.ndarray) -> pa.RecordBatch:
    d = len(sums)
    flat = pa.array(gram.ravel())
    ends = pa.array(np.arange(0, d * d + 1, d, dtype=np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(sums), pa.ListArray.from_arrays(ends, flat)], ["i", "n", "s", "g"]
    )


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """``(rows, sums, Gramian)`` of vectors of one length; null vectors are left out, no row gives (0, [], []).

    Each task adds up products of its Arrow batches and sends one row for each dimension; these are
    summed as a stream for each dimension, and the driver gets a matrix of dimensions x dimensions.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, gram = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                if sums is None:
                    sums, gram = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
                n, sums, gram = n + len(x), sums + x.sum(0), gram + x.T @ x
        if n:
            yield _rows(n, sums, gram)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows:
                for i, n, s, g in zip(batch.column("i").to_pylist(), batch.column("n").to_pylist(), batch.column("s").to_pylist(), matrix(batch.column("g"))):
                    have = total.setdefault(i, [0, 0.0, np.zeros(len(g))])
                    have[0], have[1], have[2] = have[0] + n, have[1] + s, have[2] + g
        for i, (n, s, g) in total.items():
            yield pa.RecordBatch.from_pylist([{"i": i, "n": n, "s": s, "g": g.tolist()}], schema=pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.float64()), ("g", pa.list_(pa.float64()))]))

    parts = df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("x")).mapInArrow(partial, _MOMENTS)
    found = sorted(parts.repartition("i").mapInArrow(added, _MOMENTS).collect())  # one row per dimension
    if not found:
        return 0, np.zeros(0), np.zeros((0, 0))
    return found[0].n, np.array([r.s for r in found]), np.array([r.g for r in found])


def components(second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest down and eigenvectors as rows, each with its largest entry positive."""
    values, vectors = np.linalg.eigh(second)
    values, vectors = values[::-1], vectors[:, ::-1].T
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return values, vectors * np.where(signs == 0, 1, signs)[:, None]


def explained(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(share of variance, components as rows, mean)`` of the principal components, the largest first."""
    n, sums, gram = moments(df, vector)
    if not n:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    mean = sums / n
    values, rows = components(gram / n - np.outer(mean, mean))
    values = np.maximum(values, 0.0)
    return values / max(values.sum(), 1e-300), rows, mean


def projected(df: DataFrame, vector: str, rows: np.ndarray, mean: np.ndarray, name: str = "projected") -> DataFrame:
    """Adds ``name``, the coordinates along ``rows``; a null vector has none. Rows are multiplied by Arrow batches, nothing is shuffled."""
    turn = np.asarray(rows, dtype=np.float64).T

    @F.pandas_udf("array<double>")
    def coordinates(vectors):
        import pandas as pd

        out = pd.Series([None] * len(vectors), dtype=object)
        there = vectors.notna()
        if there.any():
            made = (np.stack(vectors[there].to_numpy()).astype(np.float64) - mean) @ turn
            out[there] = pd.Series(list(made), index=vectors.index[there])
        return out

    return df.withColumn(name, coordinates(F.col(vector).cast("array<double>")))


def least_distances(df: DataFrame, key: str, vector: str, probes: list[tuple[int | None, list[float]]]) -> dict[int, float]:
    """Distance of every probe ``(id or none, vector)`` to its nearest row of another id.

    The probes, a bounded number, are broadcast; every task keeps the least distance of each, and these are merged by ``min``.
    """
    ids = np.array([-1 if i is None else 0 for i, _ in probes])
    own = np.array([0 if i is None else i for i, _ in probes], dtype=np.int64)
    shared = df.sparkSession.sparkContext.broadcast((ids, own, np.array([p for _, p in probes], dtype=np.float64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free, own, p = shared.value
        least = np.full(len(p), np.inf)
        for batch in batches:
            if batch.num_rows:
                x, keys = matrix(batch.column("x")), batch.column("k").to_numpy()
                for lo in range(0, len(x), 1024):  # differences, not products, so that small distances keep their digits
                    part = x[lo : lo + 1024]
                    for j in range(len(p)):
                        square = ((part - p[j]) ** 2).sum(axis=1)
                        if free[j] == 0:
                            square[keys[lo : lo + 1024] == own[j]] = np.inf
                        least[j] = min(least[j], square.min())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(p), dtype=np.int64)), pa.array(least)], ["j", "d"])

    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("x"))
    found = rows.mapInArrow(work, "j long, d double").groupBy("j").agg(F.sqrt(F.min("d")).alias("d")).collect()  # one row per probe
    return {r.j: r.d for r in found}


def hopkins(df: DataFrame, key: str, vector: str, most: int = 100) -> DataFrame:
    """One row ``(probes, real, uniform, hopkins)``: clustering tendency, over 0.5 where rows are nearer to each other than to chance.

    A tenth of the rows, ``most`` at most, chosen by an arithmetic hash of the key, look for their nearest other
    row; as many points of a fixed sequence within the value ranges look for their nearest row. All rows are
    looked at. Under ten rows there is no probe and the statistic is null.
    """
    spark = df.sparkSession
    rows = df.where(F.col(vector).isNotNull())
    n = rows.count()
    m = min(most, n // 10)
    schema = "probes long, real double, uniform double, hopkins double"
    if not m:
        return spark.createDataFrame([(0, None, None, None)], schema)
    chosen = rows.orderBy((F.col(key) * 7919 + 13) % 10007, key).limit(m).select(key, vector).collect()
    d = len(chosen[0][1])
    low, high = (np.array(rows.agg(F.array(*[f(F.col(vector)[i]) for i in range(d)])).first()[0], dtype=np.float64) for f in (F.min, F.max))
    share = (np.arange(m * d, dtype=np.uint64) * np.uint64(2654435761) % np.uint64(1 << 32)).reshape(m, d) / float(1 << 32)
    probes = [(r[0], list(r[1])) for r in chosen] + [(None, list(p)) for p in low + share * (high - low)]
    found = least_distances(rows, key, vector, probes)
    real, uniform = (sum(found[j] for j in part) for part in (range(m), range(m, 2 * m)))
    return spark.createDataFrame([(m, real, uniform, uniform / (real + uniform) if real + uniform else None)], schema)
