"""Gaussian mixtures with diagonal, spherical, tied and full covariances, by triangular factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .projection import matrix

KINDS = ("diag", "spherical", "tied", "full")
_SUMS = "k int, i int, n long, s double, g array<double>"


def scatter(df: DataFrame, vector: str, label: str) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """``label -> (rows, sums, Gramian)``; every task sends one row for each label and dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows:
                x, labels = matrix(batch.column("x")), batch.column("k").to_numpy()
                for k in np.unique(labels):
                    part = x[labels == k]
                    have = held.setdefault(int(k), [0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)])
                    have[0], have[1], have[2] = have[0] + len(part), have[1] + part.sum(0), have[2] + part.T @ part
        for k, (n, s, g) in held.items():
            yield _rows(k, n, s, g)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for batch in batches:
            if batch.num_rows:
                for k, i, n, s, g in zip(*(batch.column(c).to_pylist() for c in ("k", "i", "n", "s")), matrix(batch.column("g"))):
                    have = total.setdefault((k, i), [0, 0.0, np.zeros(len(g))])
                    have[0], have[1], have[2] = have[0] + n, have[1] + s, have[2] + g
        if total:
            rows = [{"k": k, "i": i, "n": n, "s": s, "g": g.tolist()} for (k, i), (n, s, g) in total.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("k", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("s", pa.float64()), ("g", pa.list_(pa.float64()))]))

    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("int").alias("k"), F.col(vector).alias("x"))
    found: dict[int, list] = {}
    for r in rows.mapInArrow(partial, _SUMS).repartition("k", "i").mapInArrow(added, _SUMS).collect():  # components x dimensions rows
        found.setdefault(r.k, []).append(r)
    return {k: (rs[0].n, np.array([r.s for r in sorted(rs, key=lambda r: r.i)]), np.array([r.g for r in sorted(rs, key=lambda r: r.i)])) for k, rs in found.items()}


def _rows(k: int, n: int, s: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    d = len(s)
    ends = pa.array(np.arange(0, d * d + 1, d, dtype=np.int32))
    columns = [np.full(d, k, dtype=np.int32), np.arange(d, dtype=np.int32), np.full(d, n, dtype=np.int64), s]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(ends, pa.array(g.ravel()))], ["k", "i", "n", "s", "g"])


def fitted(sums: dict[int, tuple], kind: str, shrink: float = 0.1, floor: float = 1e-6) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """``label -> (weight, mean, lower factor)`` of the covariance of a kind.

    Tied scatter is pooled over the components. Where a component has few rows its matrix is singular, so full ones give
    ``shrink`` of themselves to the pooled diagonal; all have ``floor`` added to their diagonal.
    """
    total = sum(n for n, _, _ in sums.values())
    within = {k: g - np.outer(s, s) / n for k, (n, s, g) in sums.items()}
    pooled = sum(within.values()) / max(total, 1)
    out = {}
    for k, (n, s, _) in sums.items():
        own = within[k] / n
        if kind == "tied":
            cov = pooled
        elif kind == "full":
            cov = (1 - shrink) * own + shrink * np.diag(np.diag(pooled))
        elif kind == "diag":
            cov = np.diag(np.diag(own))
        elif kind == "spherical":
            cov = np.eye(len(s)) * np.diag(own).mean()
        else:
            raise ValueError(f"covariance {kind!r}")
        out[k] = (n / total, s / n, np.linalg.cholesky(cov + floor * np.eye(len(s))))
    return out


def forward(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solves ``lower`` y = b for every row of ``b``, one dimension after the other."""
    y = np.zeros_like(b)
    for i in range(len(lower)):
        y[:, i] = (b[:, i] - y[:, :i] @ lower[i, :i]) / lower[i, i]
    return y


def scored(df: DataFrame, vector: str, model: dict[int, tuple]) -> DataFrame:
    """Adds ``cluster`` (ties to the lowest label) and ``log_likelihood``; null vectors give nulls. The model, components x
    dimensions squared numbers whatever the data, is broadcast; nothing is shuffled."""
    keys = sorted(model)
    shared = df.sparkSession.sparkContext.broadcast([(np.log(model[k][0]), model[k][1], model[k][2]) for k in keys])

    @F.pandas_udf("cluster int, ll double")
    def rated(vectors: pd.Series) -> pd.DataFrame:
        cluster, level = np.full(len(vectors), np.nan), np.full(len(vectors), np.nan)
        there = vectors.notna().to_numpy()
        if there.any():
            x = np.stack(vectors[there].to_numpy()).astype(np.float64)
            joint = np.stack([
                w - 0.5 * (forward(lower, x - mean) ** 2).sum(axis=1) - np.log(np.diag(lower)).sum() - 0.5 * len(mean) * np.log(2 * np.pi) for w, mean, lower in shared.value
            ], axis=1)
            top = joint.max(axis=1)
            cluster[there], level[there] = np.array(keys)[joint.argmax(axis=1)], top + np.log(np.exp(joint - top[:, None]).sum(axis=1))
        return pd.DataFrame({"cluster": pd.array(cluster).astype("Int32"), "ll": level})

    out = df.withColumn("_r", rated(F.col(vector).cast("array<double>")))
    return out.select(*df.columns, F.col("_r.cluster").alias("cluster"), F.when(F.col(vector).isNotNull(), F.col("_r.ll")).alias("log_likelihood"))
