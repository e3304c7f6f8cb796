"""Group profiles, effect sizes, Fisher ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def profile(df: DataFrame, group: str, columns: list[str], sample_std: bool = False) -> DataFrame:
    """Size, mean and exact interpolated median per group (and sample deviation where asked for)."""
    stats = [(F.avg, "avg"), *([(F.stddev_samp, "std")] if sample_std else [])]
    means = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"), *[f(c).alias(f"{k}_{c}") for c in columns for f, k in stats])
    return with_quantiles(means, quantiles(df, group, columns), group, {c: f"med_{c}" for c in columns})


def quantiles(df: DataFrame, group: str, columns: list[str], q: float = 0.5) -> DataFrame:
    """``(group, feature, value)``: exact linearly interpolated quantiles.

    Values are counted first. Counts per value range, at most some thousand per group and
    feature, tell in which range a quantile lies; only those ranges are sorted.
    """
    long = df.select(group, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([group], columns, "feature", "x")
    per = long.where(F.col("x").isNotNull() & F.col(group).isNotNull()).groupBy(group, "feature", "x").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("range", F.floor(F.signum("x") * F.log2(1 + F.abs("x")) * 32))  # never decreases with x
    of = Window.partitionBy(group, "feature")
    ranges = per.groupBy(group, "feature", "range").agg(F.sum("n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(of.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = (F.sum("_n").over(of) - 1) * F.lit(q)
    held = ranges.withColumns({"_before": before, "_at": at}).where((F.col("_before") <= F.ceil("_at")) & (F.col("_before") + F.col("_n") > F.floor("_at")))
    run = F.col("_before") + F.sum("n").over(Window.partitionBy(group, "feature", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    placed = per.join(held.drop("_n"), [group, "feature", "range"]).withColumn("_run", run)
    value = lambda p: F.max(F.when((F.col("_run") - F.col("n") <= p) & (p < F.col("_run")), F.col("x")))
    ends = placed.groupBy(group, "feature").agg(value(F.floor("_at")).alias("a"), value(F.ceil("_at")).alias("b"), F.max(F.col("_at") - F.floor("_at")).alias("w"))
    return ends.select(group, "feature", (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("value"))


def with_quantiles(df: DataFrame, found: DataFrame, group: str, names: dict[str, str]) -> DataFrame:
    """Adds quantiles as columns; ``names`` maps features to them."""
    wide = found.groupBy(F.col(group).alias("_g")).agg(*[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(a) for c, a in names.items()])
    return df.join(wide, df[group].eqNullSafe(wide["_g"]), "left").drop("_g")


def value_shares(df: DataFrame, group: str) -> DataFrame:
    """Shares of single TTLs, flags and protocols per group: one pass."""
    share = lambda c: F.avg(c.cast("double"))
    ttl, flags = F.col("min_ttl"), F.col("tcp_flags")
    return df.groupBy(group).agg(
        share(ttl == 0).alias("share_ttl0"), share(ttl == 64).alias("share_ttl64"), share(~ttl.isin(0.0, 64.0)).alias("share_ttl_other"),
        share(flags == 2).alias("share_syn"), share(F.col("protocol") == 17).alias("share_udp"),
    )


def shares(df: DataFrame, group: str) -> DataFrame:
    """``value_shares``, the number of ports and their median per group."""
    ports = df.groupBy(F.col(group).alias("_p")).agg(F.count_distinct("dst_port").alias("n_ports"))
    found = value_shares(df, group).join(ports, F.col(group).eqNullSafe(F.col("_p"))).drop("_p")
    return with_quantiles(found, quantiles(df, group, ["dst_port"]), group, {"dst_port": "med_port"})


def unpivoted(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(keys, columns, "feature", "x")


def moments(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """``(group, feature, n, mean, var)`` from one pass over wide rows; only the aggregates are unpivoted."""
    wide = df.where(F.col(group).isNotNull()).groupBy(group).agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var")).alias(c) for c in columns])
    return wide.unpivot([group], columns, "feature", "m").select(group, "feature", "m.n", "m.mean", "m.var")


def fisher_ratio(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """``(feature, fisher)``: between-class over within-class scatter; classes of fewer than two rows are left out."""
    each = moments(df, group, columns)
    whole = each.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"))  # all rows of the feature
    parts = each.where("n >= 2").join(F.broadcast(whole), "feature")  # one row per feature
    out = parts.groupBy("feature").agg(F.sum(F.col("n") * (F.col("mean") - F.col("m")) ** 2).alias("b"), F.sum(F.col("n") * F.col("var")).alias("w"))
    return out.select("feature", F.when(F.col("w") > 0, F.col("b") / F.col("w")).otherwise(0.0).alias("fisher"))


def effect_sizes(df: DataFrame, group: str, columns: list[str], top: int = 10, hidden: tuple[str, ...] = ()) -> DataFrame:
    """The ``top`` features per group by standardised difference from the overall mean.

    Features whose name starts with one of ``hidden`` (one-hot columns) take their ranks but are not shown.
    """
    each = moments(df, group, columns)
    over = Window.partitionBy("feature")
    n, mean = F.sum("n").over(over), F.sum(F.col("n") * F.col("mean")).over(over) / F.sum("n").over(over)
    square = F.sum(F.col("n") * (F.col("var") + F.col("mean") ** 2)).over(over) / n
    effect = (F.col("mean") - mean) / (F.sqrt(F.greatest(square - mean**2, F.lit(0.0))) + 1e-8)
    ranked = each.withColumn("effect", effect).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.abs("effect").desc(), "feature")))
    shown = ranked.where(F.col("rank") <= top).select(group, "feature", "effect", "rank")
    for prefix in hidden:
        shown = shown.where(~F.col("feature").startswith(prefix))
    return shown


def spread(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``(group, within, nearest, ratio)``: mean distance to the own centre, distance to the nearest other centre, their ratio."""
    at = df.select(group, F.posexplode(vector).alias("i", "v")).groupBy(group, "i").agg(F.avg("v").alias("c"))
    centre = at.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("_c"))
    d = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) ** 2), F.lit(0.0), lambda s, x: s + x))
    within = df.join(F.broadcast(centre), group).groupBy(group).agg(F.avg(d(vector, "_c")).alias("within"))  # one row per group
    other = centre.select(F.col(group).alias("_o"), F.col("_c").alias("_d"))
    nearest = centre.join(F.broadcast(other), F.col(group) != F.col("_o")).groupBy(group).agg(F.min(d("_c", "_d")).alias("nearest"))  # groups by groups
    return within.join(nearest, group).withColumn("ratio", F.col("within") / F.col("nearest"))


def representatives(df: DataFrame, group: str, vector: str, key: str, k: int = 5) -> DataFrame:
    """The ``k`` rows nearest to the mean vector of their group."""
    at = df.select(group, F.posexplode(vector).alias("i", "v")).groupBy(group, "i").agg(F.avg("v").alias("c"))
    centre = at.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("_c"))
    d = F.sqrt(F.aggregate(F.zip_with(vector, "_c", lambda a, b: (a.cast("double") - b) ** 2), F.lit(0.0), lambda a, x: a + x))
    ranked = df.join(F.broadcast(centre), group).withColumn("distance", d)  # one row per group
    rank = F.row_number().over(Window.partitionBy(group).orderBy("distance", key))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select(group, key, "distance", "rank")
