"""Evaluations of streamed scores: phases of a static and an updated model, injected drift, novelty of a held-out class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, mixture
from ..operators.profiles import quantiles


def compare_phases(
    spark: SparkSession, batches: list[tuple[str, DataFrame]], vector: str, label: str, params: DataFrame, names: DataFrame, rate: float = 0.3
) -> DataFrame:
    """``(phase, system, n, accuracy, macro_f1, level)`` of a static model and of one that learns after every batch.

    ``batches`` are taken in order, each scored by both models before the second one is
    updated. ``names`` maps components ``k`` to the label they predict (no row: Unknown). The
    macro F1 goes over labels that occur in the phase. Only models, a few rows of numbers,
    and counts per batch are kept.
    """
    kept = lambda df: spark.createDataFrame(df.collect(), mixture.PARAMS)
    static = online = kept(params)
    counts = []
    for phase, batch in batches:
        scored = mixture.posteriors(batch, vector, online).persist()
        for system, rows in (("static", mixture.posteriors(batch, vector, static)), ("online", scored)):
            named = rows.join(F.broadcast(names.select(F.col("k").alias("cluster"), F.col("name").alias("_name"))), "cluster", "left")  # one row per component
            made = named.groupBy(F.col(label).alias("true_label"), F.coalesce("_name", F.lit("Unknown")).alias("pred_label")).agg(
                F.count(F.lit(1)).alias("n"), F.sum("log_likelihood").alias("level")
            )
            counts += [(phase, system, r.true_label, r.pred_label, r.n, r.level) for r in made.collect()]  # labels squared
        online = kept(mixture.online_step(scored, vector, online, rate))
        scored.unpersist()
    table = spark.createDataFrame(counts, "phase string, system string, true_label string, pred_label string, n long, level double")
    out = None
    for phase in dict.fromkeys(p for p, _ in batches):
        for system in ("static", "online"):
            cells = table.where((F.col("phase") == phase) & (F.col("system") == system)).groupBy("true_label", "pred_label").agg(F.sum("n").alias("n"), F.sum("level").alias("level"))
            scores = metrics.prf(cells).where("support > 0").agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))
            level = cells.agg((F.sum("level") / F.sum("n")).alias("level"))
            row = scores.crossJoin(level).select(F.lit(phase).alias("phase"), F.lit(system).alias("system"), "*")  # one row each
            out = row if out is None else out.unionByName(row)
    return out


def drift_report(levels: DataFrame, first_drifted: int, sigmas: float = 2.0) -> DataFrame:
    """One row about ``(batch, level)``: threshold from the batches before ``first_drifted``, detection, latency, precision, recall, F1."""
    normal = F.col("batch") < first_drifted
    cut = levels.where(normal).agg((F.avg("level") - sigmas * F.when(F.count("level") > 1, F.stddev_pop("level")).otherwise(F.abs(F.avg("level")) * 0.1)).alias("threshold"))
    flagged = levels.crossJoin(F.broadcast(cut)).withColumn("low", F.col("level") < F.col("threshold"))  # one row
    number = lambda c: F.sum(c.cast("long"))
    agg = flagged.agg(
        F.max("threshold").alias("threshold"), F.min(F.when(~normal & F.col("low"), F.col("batch"))).alias("detected"),
        number(~normal & F.col("low")).alias("tp"), number(normal & F.col("low")).alias("fp"), number(~normal & ~F.col("low")).alias("fn"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.select(
        "threshold", F.coalesce("detected", F.lit(-1)).cast("long").alias("detected"), F.coalesce(F.col("detected") - first_drifted, F.lit(-1)).cast("long").alias("latency"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def novelty_report(scored: DataFrame, training: DataFrame, q: float = 0.05) -> DataFrame:
    """``(gated, auc, detected, benign_flagged, known_flagged, precision, flagged)`` with and without the gate.

    ``scored`` has ``log_likelihood``, ``held_out`` and ``benign`` (booleans) and ``gate``: rows of
    clusters known as benign, which are no candidates and rank last. The threshold is the
    ``q`` quantile of the likelihoods in ``training``.
    """
    cut = quantiles(training.select(F.lit(0).alias("_g"), "log_likelihood"), "_g", ["log_likelihood"], q).select(F.col("value").alias("_cut"))
    top = scored.agg(F.max("log_likelihood").alias("_top"))
    base = scored.crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(top))  # one row each
    out = None
    for gated in (False, True):
        free = ~F.col("gate") if gated else F.lit(True)
        rows = base.withColumn("s", F.when(free, -F.col("log_likelihood")).otherwise(-F.col("_top") - 1)).withColumn("f", (F.col("log_likelihood") < F.col("_cut")) & free)
        rate = lambda c: F.avg(F.when(c, F.col("f").cast("double")))
        held, benign = F.col("held_out"), F.col("benign")
        row = rows.agg(
            rate(held).alias("detected"), rate(benign).alias("benign_flagged"), rate(~held & ~benign).alias("known_flagged"),
            F.avg(F.when(F.col("f"), held.cast("double"))).alias("precision"), F.sum(F.col("f").cast("long")).alias("flagged"),
        )
        auc = metrics.roc_auc(rows, "s", "held_out").select("auc")
        row = row.crossJoin(auc).select(F.lit(gated).alias("gated"), "auc", "detected", "benign_flagged", "known_flagged", "precision", "flagged")  # one row each
        out = row if out is None else out.unionByName(row)
    return out
