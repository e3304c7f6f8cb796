"""Alarms over the levels of a stream's batches, injected drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Batches whose levels are ordered in one task.
RUN = 4096


def likelihood_alarms(levels: DataFrame, order: str = "batch", level: str = "level", sigmas: float = 2.0, least: int = 2) -> DataFrame:
    """Adds ``alarm``: a batch below the mean of all earlier ones by ``sigmas`` deviations (5 % of the mean at least).

    Batches are summed in runs of ``RUN`` numbers; only one row for each run is ordered in one place.
    Levels are summed as differences from their overall mean, which keeps small deviations exact.
    """
    names, past = ["_n", "_s", "_q"], (Window.unboundedPreceding, -1)
    x = F.col(level) - F.col("_mid")
    middle = levels.agg(F.avg(level).alias("_mid"))
    found = levels.crossJoin(F.broadcast(middle)).withColumns({"_run": F.floor(F.col(order) / RUN), "_n": F.col(level).isNotNull().cast("long"), "_s": x, "_q": x * x})  # one row
    sums = found.groupBy("_run").agg(*[F.sum(c).alias(c) for c in names])
    offsets = sums.select("_run", *[F.coalesce(F.sum(c).over(Window.orderBy("_run").rowsBetween(*past)), F.lit(0)).alias(f"_o{c}") for c in names])
    inside = Window.partitionBy("_run").orderBy(order).rowsBetween(*past)
    run = found.join(offsets, "_run").withColumns({f"_t{c}": F.col(f"_o{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in names})
    n, mean = F.col("_t_n"), F.col("_t_s") / F.col("_t_n")
    std = F.sqrt(F.greatest(F.col("_t_q") / n - mean * mean, F.lit(0.0)))
    low = F.col(level) < mean + F.col("_mid") - sigmas * F.greatest(std, F.abs(mean + F.col("_mid")) * 0.05)
    return run.withColumn("alarm", F.when(n >= least, F.coalesce(low, F.lit(False))).otherwise(False)).select(*levels.columns, "alarm")


def injected_drift(vector: Column, direction: list[float], std: Column, progress: Column, strength: float = 3.0, stretch: float = 0.3) -> Column:
    """Vector shifted along a fixed direction by up to ``strength`` deviations of each dimension and stretched, both as ``progress`` (0 to 1) goes on."""
    shift = F.zip_with(F.array(*[F.lit(float(x)) for x in direction]), std, lambda a, s: a * s * strength * progress)
    return F.transform(F.zip_with(vector, shift, lambda a, b: a.cast("double") + b), lambda a: a * (1 + progress * stretch))
