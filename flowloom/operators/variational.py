"""Truncated stick-breaking Gaussian mixtures by variational inference, several starts in one scan."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import durable
from .mixture import PARAMS
from .projection import matrix

_SUMS = "start int, k int, n double, level double, s1 array<double>, s2 array<double>"


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    inv = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


log_gamma = np.vectorize(math.lgamma, otypes=[float])


@dataclass
class Prior:
    """Beta(1, ``concentration``) on sticks; per dimension a normal of mean ``mean`` and ``kappa`` rows' weight, and Gamma(``shape``, ``rate``) on precisions."""

    concentration: float
    mean: np.ndarray
    rate: np.ndarray
    kappa: float = 1.0
    shape: float = 1.0


@dataclass
class Start:
    """One model: Beta parameters of the sticks, normal-gamma parameters of the components."""

    a: np.ndarray
    b: np.ndarray
    kappa: np.ndarray
    mean: np.ndarray
    shape: np.ndarray
    rate: np.ndarray
    bound: float = -math.inf
    done: bool = False

    def log_weights(self) -> np.ndarray:
        """Expected logarithms of the weights."""
        log_v, log_rest = digamma(self.a) - digamma(self.a + self.b), digamma(self.b) - digamma(self.a + self.b)
        return log_v + np.append(0.0, np.cumsum(log_rest)[:-1])

    def terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(constant, precision, precision * mean)``: the expected log joint of a row is constant + x . pm - x^2 . p / 2."""
        p = self.shape[:, None] / self.rate
        d = self.mean.shape[1]
        level = 0.5 * (d * (digamma(self.shape) - math.log(2 * math.pi)) - np.log(self.rate).sum(1) - d / self.kappa - (p * self.mean**2).sum(1))
        return self.log_weights() + level, p, p * self.mean

    def divergence(self, prior: Prior) -> float:
        """How far the posterior of the parameters lies from their prior."""
        a, b, c = self.a, self.b, prior.concentration
        beta = log_gamma(a + b) - log_gamma(a) - log_gamma(b) - math.log(c) + (a - 1) * digamma(a) + (b - c) * digamma(b) + (1 + c - a - b) * digamma(a + b)
        s, r, s0, r0 = self.shape[:, None], self.rate, prior.shape, prior.rate[None, :]
        gamma = (s - s0) * digamma(s) - log_gamma(s) + math.lgamma(s0) + s0 * (np.log(r) - np.log(r0)) + s * (r0 - r) / r
        k = self.kappa[:, None]
        normal = 0.5 * (np.log(k / prior.kappa) - 1 + prior.kappa / k + prior.kappa * (s / r) * (self.mean - prior.mean) ** 2)
        return float(beta.sum() + gamma.sum() + normal.sum())


def updated(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, prior: Prior) -> Start:
    """The model after responsibilities of sums ``n``, ``s1``, ``s2``; sticks are broken in order of mass."""
    order = np.argsort(-n, kind="stable")
    n, s1, s2 = n[order], s1[order], s2[order]
    after = np.append(np.cumsum(n[::-1])[::-1][1:], 0.0)
    kappa = prior.kappa + n
    mean = (prior.kappa * prior.mean + s1) / kappa[:, None]
    rate = prior.rate + 0.5 * np.maximum(s2 + prior.kappa * prior.mean**2 - kappa[:, None] * mean**2, 0.0)
    return Start(1 + n, prior.concentration + after, kappa, mean, prior.shape + 0.5 * n, rate)


def responsibility_sums(rows: DataFrame, models: list[Start]) -> dict[int, tuple]:
    """``start -> (level, n, s1, s2)`` of all models by one scan of ``rows`` (column ``x``); a task sends one row per model and component.

    ``level`` is the sum of the rows' log normalisers.
    """
    shared = rows.sparkSession.sparkContext.broadcast([m.terms() for m in models])  # models x components x dimensions

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            x2 = x * x
            if held is None:
                held = [[0.0, np.zeros(len(c)), np.zeros(p.shape), np.zeros(p.shape)] for c, p, _ in shared.value]
            for have, (c, p, pm) in zip(held, shared.value):
                joint = c + x @ pm.T - 0.5 * (x2 @ p.T)
                top = joint.max(axis=1)
                level = top + np.log(np.exp(joint - top[:, None]).sum(axis=1))
                g = np.exp(joint - level[:, None])
                have[0] += level.sum()
                have[1] += g.sum(0)
                have[2] += g.T @ x
                have[3] += g.T @ x2
        if held is not None:
            out = [
                {"start": i, "k": k, "n": float(n[k]), "level": float(level), "s1": s1[k].tolist(), "s2": s2[k].tolist()}
                for i, (level, n, s1, s2) in enumerate(held) for k in range(len(n))
            ]
            kinds = [("start", pa.int32()), ("k", pa.int32()), ("n", pa.float64()), ("level", pa.float64()), ("s1", pa.list_(pa.float64())), ("s2", pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for batch in batches:
            if batch.num_rows:
                for i, k, n, level, s1, s2 in zip(*(batch.column(c).to_pylist() for c in ("start", "k", "n", "level")), matrix(batch.column("s1")), matrix(batch.column("s2"))):
                    have = total.setdefault((i, k), [0.0, 0.0, np.zeros(len(s1)), np.zeros(len(s2))])
                    total[i, k] = [have[0] + n, have[1] + level, have[2] + s1, have[3] + s2]
        if total:
            out = [{"start": i, "k": k, "n": v[0], "level": v[1], "s1": v[2].tolist(), "s2": v[3].tolist()} for (i, k), v in total.items()]
            kinds = [("start", pa.int32()), ("k", pa.int32()), ("n", pa.float64()), ("level", pa.float64()), ("s1", pa.list_(pa.float64())), ("s2", pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    found: dict[int, list] = {}
    for r in rows.mapInArrow(partial, _SUMS).repartition("start", "k").mapInArrow(added, _SUMS).collect():  # one row per model and component
        found.setdefault(r.start, []).append(r)
    out = {}
    for i, rs in found.items():
        rs.sort(key=lambda r: r.k)
        out[i] = (rs[0].level, np.array([r.n for r in rs]), np.array([r.s1 for r in rs]), np.array([r.s2 for r in rs]))
    return out


def fit_dirichlet_mixture(
    spark: SparkSession, df: DataFrame, vector: str, components: int = 20, rounds: int = 30, concentration: float = 0.1, tol: float = 1e-4, seed: int = 42, starts: int = 10,
    trail: list | None = None,
) -> DataFrame:
    """``(k, weight, mean, var)`` of the best of ``starts`` models by their evidence bound.

    Vectors are written once to the shared folder; each round is one scan that serves all starts that have not settled (their
    bound per row still grows by ``tol``), and yields sums of components x dimensions numbers for the driver. A start's centres are
    hash-chosen rows. Weights are posterior means. Null vectors are left out; no row gives an empty model. ``trail`` gets the bounds.
    """
    rows = durable(df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x")))
    base = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).orderBy("i").collect()
    if not base:
        return spark.createDataFrame([], PARAMS)
    total = base[0].n
    prior = Prior(concentration, np.array([r.m for r in base]), np.maximum([r.v for r in base], 1e-6))
    models = []
    for i in range(starts):
        centres = np.array([r.x for r in rows.orderBy(F.xxhash64(F.lit(seed + i), "x")).limit(components).collect()])
        k = len(centres)
        n = np.full(k, total / k)
        models.append(updated(n, n[:, None] * centres, n[:, None] * (centres**2 + prior.rate), prior))
    best = models[0]
    for _ in range(rounds):
        active = [i for i, m in enumerate(models) if not m.done]
        if not active:
            break
        for j, (level, n, s1, s2) in responsibility_sums(rows, [models[i] for i in active]).items():
            old = models[active[j]]
            bound = (level - old.divergence(prior)) / total
            if trail is not None:
                trail.append((active[j], bound))
            settled = bound - old.bound < tol
            old.bound, old.done = bound, settled
            if not settled:
                models[active[j]] = updated(n, s1, s2, prior)
                models[active[j]].bound = bound
    best = max(models, key=lambda m: m.bound)
    v = best.a / (best.a + best.b)
    weight = v * np.append(1.0, np.cumprod(1 - v)[:-1])
    var = best.rate / best.shape[:, None]
    return spark.createDataFrame([(i, float(w), m.tolist(), x.tolist()) for i, (w, m, x) in enumerate(zip(weight / weight.sum(), best.mean, var))], PARAMS)
