"""Restartable streams: all state in versioned tables of the shared folder, every batch idempotent by its id.

A batch's outputs are written under its id and replaced when the batch runs again; the state after it
is written last, as version id + 1. A batch whose next version is there has been done and is skipped. So a
driver that is lost in the middle of a batch starts again from the stream's own checkpoint and leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mixture, timeline


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def replaced(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Versions:
    """A table with a version before every batch."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def path(self, version: int) -> str:
        return f"{self.base}/version={version}"

    def start(self, first: DataFrame) -> None:
        if not exists(self.spark, self.path(0)):
            replaced(first, self.path(0))

    def at(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self.path(version))

    def done(self, batch_id: int) -> bool:
        return exists(self.spark, self.path(batch_id + 1))

    def commit(self, batch_id: int, after: DataFrame) -> None:
        replaced(after, self.path(batch_id + 1))


class ModelStream:
    """Prequential scoring: score a batch with the model before it, record it, then update the model.

    Tables under ``base``: ``model`` (versions of the mixture), ``levels`` (one row per batch: level, rows,
    novel rows, whether a component was replaced). A row is novel under ``cut``, by default three deviations under the mean of
    what the first model says of ``fit``. Enough novel rows replace the lightest component before the
    update. Null vectors count for nothing.
    """

    LEVELS = "batch long, level double, n long, novel long, replaced boolean"

    def __init__(self, spark: SparkSession, base: str, params: DataFrame, vector: str, fit: DataFrame | None = None, rate: float = 0.3, sigmas: float = 3.0):
        self.spark, self.base, self.vector, self.rate = spark, base, vector, rate
        self.model, self.limits = Versions(spark, f"{base}/model"), Versions(spark, f"{base}/limit")
        self.model.start(params)
        if not exists(spark, self.limits.path(0)):
            seen = None if fit is None else mixture.posteriors(fit, vector, self.model.at(0))
            cut = spark.createDataFrame([(None,)], "cut double") if seen is None else seen.agg((F.avg("log_likelihood") - sigmas * F.stddev_pop("log_likelihood")).alias("cut"))
            self.limits.start(cut)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.model.done(batch_id):
            return
        params, cut = self.model.at(batch_id), self.limits.at(0).first().cut
        scored = mixture.posteriors(batch, self.vector, params).where(F.col("log_likelihood").isNotNull()).persist()
        novel = F.col("log_likelihood") < F.lit(cut).cast("double")
        level, n, far = scored.agg(F.avg("log_likelihood"), F.count(F.lit(1)), F.count(F.when(novel, 1))).first()
        after, swapped = params, False
        if n:
            light = params.agg(F.min("weight")).first()[0]
            swapped = far > max(5, 0.05 * n) and light is not None and light <= 0.05
            if swapped:
                after = replaced(mixture.replace_lightest(params, scored.where(novel), self.vector, n), f"{self.base}/made/batch={batch_id}")
                again = mixture.posteriors(batch, self.vector, after).where(F.col("log_likelihood").isNotNull())
            after = mixture.online_step(again if swapped else scored, self.vector, after, self.rate)
        row = self.spark.createDataFrame([(batch_id, level, n, far, swapped)], self.LEVELS)
        replaced(row, f"{self.base}/levels/batch_id={batch_id}")
        self.model.commit(batch_id, after)
        scored.unpersist()

    def levels(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/levels").drop("batch_id")


class WindowStream:
    """Full count windows per source, fewer than ``size`` rows of a source carried to the next batch.

    Tables under ``base``: ``rest`` (versions of the carried rows) and ``windows`` (one folder per batch). Rows of a
    batch are ordered by (source, time, value) over many tasks, carried rows first, so a source with
    most of a batch is no larger task than others. Needs rows ``(src, ts_ms, value)``; batches come in order of time;
    rows without a source are left out. ``next`` is the number of a source's next window, kept in a row that is
    not ``held`` where nothing is carried. ``time`` names the column of time; it must be as fine as the order of the events.
    """

    OUT = "src long, window_id long, n_flows long, first_ts long, last_ts long, sum_value double"
    REST = "src long, ts_ms long, value double, next long, held boolean"

    def __init__(self, spark: SparkSession, base: str, size: int, time: str = "ts_ms"):
        self.spark, self.base, self.size, self.time = spark, base, size, time
        self.rest = Versions(spark, f"{base}/rest")
        self.rest.start(spark.createDataFrame([], self.REST.replace("ts_ms", time)))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.rest.done(batch_id):
            return
        held = self.rest.at(batch_id)
        first = held.groupBy("src").agg(F.max("next").alias("_next"))
        rows = held.where("held").select("src", self.time, "value", F.lit(0).alias("_new")).unionByName(batch.where("src is not null").select("src", self.time, "value", F.lit(1).alias("_new")))
        salted = rows.withColumn("_salt", F.monotonically_increasing_id())
        ranked = timeline.class_rank(salted, "src", ["_new", self.time, "value", "_salt"]).join(first, "src", "left")
        n = ranked.groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
        window = F.floor((F.col("_rank") - 1) / self.size)
        placed = ranked.join(n, "src").select("src", self.time, "value", (F.coalesce("_next", F.lit(0)) + window).alias("window_id"), (F.floor(F.col("_n") / self.size) <= window).alias("_over"))
        full = placed.where("not _over").groupBy("src", "window_id").agg(
            F.count(F.lit(1)).alias("n_flows"), F.min(self.time).alias("first_ts"), F.max(self.time).alias("last_ts"), F.sum("value").alias("sum_value")
        )
        replaced(full, f"{self.base}/windows/batch_id={batch_id}")
        left = placed.where("_over").select("src", self.time, "value", F.col("window_id").alias("next"), F.lit(True).alias("held"))
        numbers = n.join(first, "src", "full_outer").select("src", (F.coalesce("_next", F.lit(0)) + F.floor(F.coalesce("_n", F.lit(0)) / self.size)).alias("next"))
        none = [F.lit(None).cast(t).alias(c) for c, t in ((self.time, "long"), ("value", "double"))]
        bare = numbers.where("next > 0").join(left, "src", "left_anti").select("src", *none, "next", F.lit(False).alias("held"))
        self.rest.commit(batch_id, left.unionByName(bare))

    def windows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/windows").drop("batch_id")


def run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Drives a stream to its present end; started again on the same checkpoint it goes on where it was."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
