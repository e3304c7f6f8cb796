"""Autoencoder error: a small network trained by sums of gradients over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import durable
from .projection import matrix

Weights = list[tuple[np.ndarray, np.ndarray]]


def start(sizes: list[int], seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    return [(rng.uniform(-1, 1, (a, b)) / np.sqrt(a), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def rebuilt(x: np.ndarray, net: Weights) -> list[np.ndarray]:
    """The layers' values; the rectifier between layers but not after the last."""
    layers = [x]
    for k, (w, b) in enumerate(net):
        z = layers[-1] @ w + b
        layers.append(z if k + 1 == len(net) else np.maximum(z, 0.0))
    return layers


def gradient(x: np.ndarray, net: Weights) -> tuple[float, np.ndarray]:
    """``(summed squared error per dimension, its gradient)`` over the rows of ``x``, the gradient as one flat vector."""
    layers = rebuilt(x, net)
    error = layers[-1] - x
    back, parts = 2 * error / x.shape[1], []
    for k in range(len(net) - 1, -1, -1):
        parts += [back.sum(0), (layers[k].T @ back).ravel()]
        if k:
            back = (back @ net[k][0].T) * (layers[k] > 0)
    return float((error**2).mean(axis=1).sum()), np.concatenate(parts[::-1])


def unflat(flat: np.ndarray, net: Weights) -> Weights:
    out, at = [], 0
    for w, b in net:
        out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def flat(net: Weights) -> np.ndarray:
    return np.concatenate([p.ravel() for layer in net for p in layer])


def summed_gradient(rows: DataFrame, net: Weights) -> tuple[int, float, np.ndarray]:
    """``(rows, loss, gradient)`` summed over all rows ``x``: one row for each task, added up in a few tasks before the driver adds the rest."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, np.zeros(sum(w.size + b.size for w, b in shared.value))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                more, g = gradient(x, shared.value)
                n, loss, total = n + len(x), loss + more, total + g
        if n:
            yield packed(n, loss, total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, None
        for batch in batches:
            if batch.num_rows:
                g = matrix(batch.column("g")).sum(axis=0)
                n, loss, total = n + sum(batch.column("n").to_pylist()), loss + sum(batch.column("loss").to_pylist()), g if total is None else total + g
        if n:
            yield packed(n, loss, total)

    def packed(n: int, loss: float, g: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.array([0, len(g)], dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.ListArray.from_arrays(ends, pa.array(g))], ["n", "loss", "g"])

    schema = "n long, loss double, g array<double>"
    found = rows.mapInArrow(partial, schema).repartition(4).mapInArrow(added, schema).collect()  # four rows
    if not found:
        return 0, 0.0, np.zeros(0)
    return sum(r.n for r in found), sum(r.loss for r in found), np.sum([r.g for r in found], axis=0)


def train(df: DataFrame, key: str, vector: str, hidden: tuple[int, ...] = (128, 32, 128), steps: int = 60, batches: int = 4, rate: float = 3e-3, seed: int = 42) -> tuple[Weights, list[float]]:
    """``(network, loss per step)``: Adam over mini-batches, each a hash-chosen ``1 / batches`` of all rows, its gradient summed over tasks.

    The vectors are written once to the shared folder; a step is one pass over its share of them.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(batches)).alias("b"), F.col(vector).cast("array<double>").alias("x"))
    rows = durable(rows)
    first = rows.first()
    if first is None:
        return [], []
    net = start([len(first.x), *hidden, len(first.x)], seed)
    now, mean, spread, losses = flat(net), 0.0, 0.0, []
    for step in range(1, steps + 1):
        n, loss, g = summed_gradient(rows.where(F.col("b") == step % batches), unflat(now, net))
        if not n:
            continue
        g = g / n
        mean, spread = 0.9 * mean + 0.1 * g, 0.999 * spread + 0.001 * g * g
        now = now - rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
        losses.append(loss / n)
    return unflat(now, net), losses


def errors(df: DataFrame, vector: str, net: Weights) -> DataFrame:
    """Adds ``error``, the mean squared error of the rebuilt vector; null vectors give null."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def rated(vectors: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=vectors.index)
        there = vectors.notna()
        if there.any() and shared.value:
            x = np.stack(vectors[there].to_numpy())
            out[there] = ((rebuilt(x, shared.value)[-1] - x) ** 2).mean(axis=1)
        return out

    return df.withColumn("error", F.when(F.col(vector).isNotNull(), rated(F.col(vector).cast("array<double>"))))
