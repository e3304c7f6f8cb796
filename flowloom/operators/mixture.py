"""Diagonal Gaussian mixtures: scoring, novelty, online updates, replaced components, drift."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profiles import quantiles

PARAMS = "k int, weight double, mean array<double>, var array<double>"


def label_mixture(df: DataFrame, vector: str, label: str, floor: float = 1e-6) -> DataFrame:
    """``(k, weight, mean, var)`` of the rows of each label."""
    at = df.where(F.col(label).isNotNull()).select(F.col(label).alias("k"), F.posexplode(vector).alias("i", "x"))
    each = at.groupBy("k", "i").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.greatest(F.var_pop("x"), F.lit(floor)).alias("v"))
    rows = each.groupBy("k").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m", "v"))).alias("s"))
    total = rows.agg(F.sum("n").alias("_n"))
    return rows.crossJoin(F.broadcast(total)).select(  # one row
        F.col("k").cast("int").alias("k"), (F.col("n") / F.col("_n")).alias("weight"), F.col("s.m").alias("mean"), F.col("s.v").alias("var")
    )


def bind(value: Column, body) -> Column:
    """``let v = value in body(v)``: evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def model_row(params: DataFrame) -> DataFrame:
    """The whole mixture as one row ``_model``: array of (k, log constant, mean, 1 / (2 var)), sorted by k."""
    const = F.log(F.greatest("weight", F.lit(1e-300))) - 0.5 * F.aggregate("var", F.lit(0.0), lambda a, v: a + F.log(2 * math.pi * v))
    each = params.select("k", const.alias("c"), F.col("mean").alias("m"), F.transform("var", lambda v: 0.5 / v).alias("h"))
    return each.agg(F.array_sort(F.collect_list(F.struct("k", "c", "m", "h"))).alias("_model"))


def log_joint(x: Column, component: Column) -> Column:
    """log(weight * density) with ``component`` = (k, c, m, h)."""
    scaled = F.zip_with(F.zip_with(x, component["m"], lambda a, b: (a.cast("double") - b) ** 2), component["h"], lambda d, h: d * h)
    return component["c"] - F.aggregate(scaled, F.lit(0.0), lambda a, v: a + v)


def posteriors(df: DataFrame, vector: str, params: DataFrame) -> DataFrame:
    """Adds ``post`` (array of (k, p)), ``cluster`` and ``log_likelihood``. Null vectors give nulls.

    The mixture is one row, components x dimensions numbers whatever the data, and is
    broadcast; rows are scored where they are read. Ties go to the lowest ``k``.
    """

    def result(j):
        top = F.aggregate(j, F.lit(float("-inf")), lambda a, x: F.greatest(a, x["l"]))
        level = lambda m: m + F.log(F.aggregate(j, F.lit(0.0), lambda a, x: a + F.exp(x["l"] - m)))
        best = F.aggregate(j, F.struct(F.lit(-1).alias("k"), F.lit(float("-inf")).alias("l")), lambda a, x: F.when(x["l"] > a["l"], x).otherwise(a), lambda a: a["k"])
        return bind(
            bind(top, level),
            lambda ll: F.struct(F.transform(j, lambda x: F.struct(x["k"].alias("k"), F.exp(x["l"] - ll).alias("p"))).alias("post"), best.alias("cluster"), ll.alias("ll")),
        )

    joint = F.transform("_model", lambda c: F.struct(c["k"].alias("k"), log_joint(F.col(vector), c).alias("l")))
    scored = df.crossJoin(F.broadcast(model_row(params))).withColumn("_r", F.when(F.col(vector).isNotNull(), bind(joint, result)))  # one row
    return scored.select(*df.columns, F.col("_r.post").alias("post"), F.col("_r.cluster").alias("cluster"), F.col("_r.ll").alias("log_likelihood"))


def novelty(scored: DataFrame, fit: Column | None = None, sigmas: float = 3.0) -> DataFrame:
    """Adds ``novel``: likelihood below mean - sigmas * deviation of the fitted rows."""
    seen = scored if fit is None else scored.where(fit)
    cut = seen.agg((F.avg("log_likelihood") - sigmas * F.stddev_pop("log_likelihood")).alias("_cut"))
    return scored.crossJoin(F.broadcast(cut)).withColumn("novel", F.col("log_likelihood") < F.col("_cut")).drop("_cut")  # one row


def percentile_novelty(scored: DataFrame, fit: Column, q: float = 0.05) -> DataFrame:
    """Adds ``novel``: likelihood below the ``q`` quantile of the rows where ``fit`` holds."""
    seen = scored.where(fit).select(F.lit(0).alias("_g"), "log_likelihood")
    cut = quantiles(seen, "_g", ["log_likelihood"], q).select(F.col("value").alias("_cut"))
    return scored.crossJoin(F.broadcast(cut)).withColumn("novel", F.col("log_likelihood") < F.col("_cut")).drop("_cut")  # one row


def nearest(df: DataFrame, vector: str, params: DataFrame) -> DataFrame:
    """K-means style ``cluster`` and ``score`` = -(smallest squared distance); the centres are one broadcast row."""
    square = lambda c: F.aggregate(F.zip_with(F.col(vector), c["m"], lambda a, b: (a.cast("double") - b) ** 2), F.lit(0.0), lambda a, v: a + v)
    far = F.transform("_model", lambda c: F.struct(square(c).alias("d"), c["k"].alias("k")))
    best = df.crossJoin(F.broadcast(model_row(params))).withColumn("_b", F.array_min(far))  # one row
    return best.select(*df.columns, F.col("_b.k").alias("cluster"), (-F.col("_b.d")).alias("score"))


def sufficient(scored: DataFrame, vector: str) -> DataFrame:
    """``(k, n, level, s1 array, s2 array)``: responsibility sums per component; ``level`` sums p * log-likelihood.

    Every task multiplies its responsibilities by its vectors as matrices and hands
    on one row per component, whatever the number of its rows.
    """

    def partial(batches):
        total: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ks = batch.column("ks")[0].as_py()
            g = batch.column("g").flatten().to_numpy().reshape(-1, len(ks))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(g), -1)
            ll = batch.column("ll").to_numpy()
            for k, n, level, s1, s2 in zip(ks, g.sum(0), ll @ g, g.T @ x, g.T @ (x * x)):
                have = total.get(k)
                total[k] = [n, level, s1, s2] if have is None else [a + b for a, b in zip(have, (n, level, s1, s2))]
        if total:
            rows = [{"k": k, "n": v[0], "level": v[1], "s1": v[2].tolist(), "s2": v[3].tolist()} for k, v in total.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("k", pa.int32()), ("n", pa.float64()), ("level", pa.float64()), ("s1", pa.list_(pa.float64())), ("s2", pa.list_(pa.float64()))]))

    wide = scored.where(F.col(vector).isNotNull()).select(
        F.col(vector).alias("x"), F.col("post.p").alias("g"), F.col("post.k").alias("ks"), F.col("log_likelihood").alias("ll")
    )
    parts = wide.mapInArrow(partial, "k int, n double, level double, s1 array<double>, s2 array<double>")
    dims = parts.select("k", "n", "level", F.posexplode(F.arrays_zip("s1", "s2")).alias("i", "s"))
    sums = dims.groupBy("k", "i").agg(*[F.sum(c).alias(a) for c, a in (("n", "n"), ("level", "level"), ("s.s1", "s1"), ("s.s2", "s2"))])
    rows = sums.groupBy("k").agg(F.max("n").alias("n"), F.max("level").alias("level"), F.array_sort(F.collect_list(F.struct("i", "s1", "s2"))).alias("s"))
    return rows.select("k", "n", "level", F.col("s.s1").alias("s1"), F.col("s.s2").alias("s2"))


def online_step(scored: DataFrame, vector: str, params: DataFrame, rate: float = 0.3, floor: float = 1e-6) -> DataFrame:
    """One online EM step: parameters blended with the batch's; a component without mass keeps its own."""
    stats = sufficient(scored, vector)
    total = stats.agg(F.sum("n").alias("_t"))
    joined = params.join(stats, "k", "left").crossJoin(F.broadcast(total))  # one row
    live = F.coalesce(F.col("n"), F.lit(0.0)) > 1e-8
    mean = F.zip_with("mean", F.transform("s1", lambda s: s / F.col("n")), lambda a, b: (1 - rate) * a + rate * b)
    moved = joined.withColumn("_mean", F.when(live, mean).otherwise(F.col("mean")))
    batch_var = F.zip_with(F.zip_with("s1", "s2", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), "_mean", lambda s, m: s["b"] / F.col("n") - 2 * m * s["a"] / F.col("n") + m * m)
    var = F.zip_with("var", batch_var, lambda a, b: F.greatest((1 - rate) * a + rate * b, F.lit(floor)))
    weight = F.when(live, (1 - rate) * F.col("weight") + rate * F.col("n") / F.col("_t")).otherwise((1 - rate) * F.col("weight"))
    out = moved.select("k", weight.alias("weight"), F.col("_mean").alias("mean"), F.when(live, var).otherwise(F.col("var")).alias("var"))
    norm = out.agg(F.sum("weight").alias("_w"))
    return out.crossJoin(F.broadcast(norm)).select("k", (F.col("weight") / F.col("_w")).alias("weight"), "mean", "var")  # one row


def drift(before: DataFrame, after: DataFrame, threshold: float = 0.15) -> DataFrame:
    """One row: L2 change of the weights, mean shift of the centres, and whether either passes the threshold."""
    both = before.select("k", F.col("weight").alias("w0"), F.col("mean").alias("m0")).join(after.select("k", F.col("weight").alias("w1"), F.col("mean").alias("m1")), "k")
    shift = F.sqrt(F.aggregate(F.zip_with("m0", "m1", lambda a, b: (a - b) ** 2), F.lit(0.0), lambda a, x: a + x))
    out = both.agg(F.sqrt(F.sum((F.col("w0") - F.col("w1")) ** 2)).alias("weight_shift"), F.avg(shift).alias("mean_shift"))
    return out.withColumn("drift", (F.col("weight_shift") > threshold) | (F.col("mean_shift") > threshold))


def replace_lightest(params: DataFrame, novel: DataFrame, vector: str, rows: int, limit: float = 0.05) -> DataFrame:
    """Where over max(5, 5 %) of ``rows`` are novel, the lightest component (weight <= ``limit``) becomes one of the novel rows."""
    found = novel.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.greatest(F.var_pop("x"), F.lit(1e-6)).alias("v"))
    made = found.agg(F.max("n").alias("_n"), F.array_sort(F.collect_list(F.struct("i", "m", "v"))).alias("_s"))
    lightest = params.orderBy("weight", "k").limit(1).select(F.col("k").alias("_k"), F.col("weight").alias("_w"))
    joined = params.crossJoin(F.broadcast(made)).crossJoin(F.broadcast(lightest))  # one row each
    hit = (F.col("k") == F.col("_k")) & (F.col("_w") <= limit) & (F.coalesce(F.col("_n"), F.lit(0)) > max(5, 0.05 * rows))
    out = joined.select(
        "k", F.when(hit, F.greatest(F.col("weight"), F.col("_n") / float(max(rows, 1)))).otherwise(F.col("weight")).alias("weight"),
        F.when(hit, F.col("_s.m")).otherwise(F.col("mean")).alias("mean"), F.when(hit, F.col("_s.v")).otherwise(F.col("var")).alias("var"),
    )
    norm = out.agg(F.sum("weight").alias("_t"))
    return out.crossJoin(F.broadcast(norm)).select("k", (F.col("weight") / F.col("_t")).alias("weight"), "mean", "var")
