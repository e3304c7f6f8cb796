"""Ablation runs: tracks of a vector switched off, a grid of runs that remembers what is finished."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "variant string, seed long"


def masked(vector: Column, off: Sequence[tuple[int, int]]) -> Column:
    """The vector with zeros in the ranges ``(first position from 0, length)``; its length stays, so all variants have one size."""
    if not off:
        return vector
    return F.transform(vector, lambda x, i: F.when(_within(i, off), F.lit(0).cast("double")).otherwise(x.cast("double")))


def _within(i: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    hit = F.lit(False)
    for first, length in ranges:
        hit |= (i >= first) & (i < first + length)
    return hit


def finished(spark: SparkSession, path: str) -> DataFrame:
    """``(variant, seed)`` of finished runs; none before the first."""
    from ..streaming.model_stream import exists

    done = [spark.read.parquet(f"{path}/done/*")] if exists(spark, f"{path}/begun") else []
    return done[0].distinct() if done else spark.createDataFrame([], RUNS)


def run_grid(spark: SparkSession, path: str, variants: Sequence[str], seeds: Sequence[int], work: Callable[[str, int], DataFrame]) -> DataFrame:
    """``(variant, seed, measures...)`` of all runs of the grid; finished ones are read back, not repeated.

    A run's row is written under its name first and entered in the ledger after that, so a run that was broken off
    is done again and replaces what it left. The grid is small; what is large is the work of a run.
    """
    grid = spark.createDataFrame([(v, s) for v in variants for s in seeds], RUNS)
    missing = grid.join(finished(spark, path), ["variant", "seed"], "left_anti").orderBy("variant", "seed").collect()  # variants x seeds rows
    for r in missing:
        measures = work(r.variant, r.seed).select(F.lit(r.variant).alias("variant"), F.lit(r.seed).alias("seed"), "*")
        measures.write.mode("overwrite").parquet(f"{path}/runs/{r.variant}-{r.seed}")
        spark.createDataFrame([(r.variant, r.seed)], RUNS).write.mode("overwrite").parquet(f"{path}/done/{r.variant}-{r.seed}")
        spark.createDataFrame([(True,)], "begun boolean").write.mode("overwrite").parquet(f"{path}/begun")
    return spark.read.parquet(f"{path}/runs/*").join(grid, ["variant", "seed"], "left_semi")


def spread(runs: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Per variant the mean and the sample deviation of each measure over seeds."""
    return runs.groupBy("variant").agg(F.count(F.lit(1)).alias("runs"), *[f(m).alias(f"{k}_{m}") for m in measures for k, f in (("mean", F.avg), ("std", F.stddev_samp))])
