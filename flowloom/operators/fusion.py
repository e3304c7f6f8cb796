"""Fusing label distributions: rules with given labels, posteriors with a knowledge base, parameter sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normalised(long: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    total = F.sum(p).over(Window.partitionBy(*keys))
    return long.withColumn("_t", total).withColumn(p, F.when(F.col("_t") > 0, F.col(p) / F.col("_t")).otherwise(0.0)).drop("_t")


def fuse(rules: DataFrame, other: DataFrame, key: str, label: str, weight: float = 0.7) -> DataFrame:
    """``weight * rules + (1 - weight) * other``, renormalised; a key without other labels keeps the rules."""
    known = other.select(key).distinct().withColumn("_k", F.lit(True))
    both = rules.select(key, label, F.col("p").alias("_a")).join(other.select(key, label, F.col("p").alias("_b")), [key, label], "full_outer")
    both = both.join(known, key, "left")
    a, b = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    mixed = both.select(key, label, F.when(F.col("_k").isNotNull(), weight * a + (1 - weight) * b).otherwise(a).alias("p"))
    return normalised(mixed, [key])


def posterior_fusion(scored: DataFrame, kb: DataFrame, keys: list[str], label: str, least: float = 1e-6) -> DataFrame:
    """``P(label | row) = sum_k P(k | row) P(label | k)``; posteriors below ``least`` are ignored.

    ``kb`` is long ``(k, label, p)``, one row per component and label, and is broadcast.
    """
    each = scored.select(*keys, F.explode("post").alias("q")).where(F.col("q.p") >= least)
    joined = each.select(*keys, F.col("q.k").alias("k"), F.col("q.p").alias("_q")).join(F.broadcast(kb), "k")
    return normalised(joined.groupBy(*keys, label).agg(F.sum(F.col("_q") * F.col("p")).alias("p")), keys)


def first_best(rows: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """Per ``by`` the row with the largest ``score``; the first in ``order`` among equals."""
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return rows.withColumn("_r", F.row_number().over(over.orderBy(F.col(score).desc(), order))).where("_r = 1").drop("_r")


def weight_sweep(rules: DataFrame, other: DataFrame, key: str, label: str, weights: list[float]) -> DataFrame:
    """Fused primary label per key and weight in one pass: ``(key, w, label, p)``; ties go to the first label."""
    both = rules.select(key, label, F.col("p").alias("_a")).join(other.select(key, label, F.col("p").alias("_b")), [key, label], "full_outer")
    grid = both.withColumn("w", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    p = F.col("w") * F.coalesce("_a", F.lit(0.0)) + (1 - F.col("w")) * F.coalesce("_b", F.lit(0.0))
    ranked = grid.withColumn("p", p).withColumn("_r", F.row_number().over(Window.partitionBy(key, "w").orderBy(F.col("p").desc(), label)))
    return ranked.where("_r = 1").select(key, "w", label, "p")


def build_kb(behaviours: DataFrame, tactics: DataFrame, sizes: DataFrame, key: str = "cluster") -> DataFrame:
    """One row per cluster with score maps, primary labels (ties: by name), size and share."""
    as_map = lambda df, label: df.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label), F.round("p", 4))))).alias(f"{label}_scores"),
        F.max_by(F.col(label), F.struct(F.col("p"), F.translate(label, "", ""))).alias(f"primary_{label}"),
    )
    total = sizes.agg(F.sum("size").alias("_n"))
    out = sizes.crossJoin(F.broadcast(total)).join(as_map(behaviours, "behaviour"), key, "left").join(as_map(tactics, "tactic"), key, "left")  # one row
    return out.select(
        key, "behaviour_scores", F.coalesce("primary_behaviour", F.lit("Unknown")).alias("primary_behaviour"), "tactic_scores",
        F.coalesce("primary_tactic", F.lit("Unknown")).alias("primary_tactic"), F.col("size").alias("cluster_size"), F.round(F.col("size") / F.col("_n"), 6).alias("cluster_proportion"),
    )


def lookup(df: DataFrame, kb: DataFrame, key: str = "cluster") -> DataFrame:
    """Rows with the primary labels of their cluster; a miss is Unknown. The base has one row per cluster."""
    small = kb.select(key, "primary_behaviour", "primary_tactic")
    joined = df.join(F.broadcast(small), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in ("primary_behaviour", "primary_tactic")})


def kb_after(kb: DataFrame, updates: DataFrame, rescored: DataFrame, key: str = "cluster") -> tuple[DataFrame, DataFrame]:
    """``(base, log)``: entries that moved or are new take their primary labels from ``rescored``; the log has a row for each.

    ``kb`` is ``(key, primary_behaviour, primary_tactic)``, ``rescored`` the same for the current batch.
    """
    now = rescored.select(key, F.col("primary_behaviour").alias("_b"), F.col("primary_tactic").alias("_t"))
    log = updates.join(now, key).select(key, "action", "shift", F.col("_b").alias("new_behaviour"), F.col("_t").alias("new_tactic"))
    changed = log.select(key, "action", F.col("new_behaviour").alias("_b"), F.col("new_tactic").alias("_t"))
    both = kb.join(changed, key, "full_outer")
    base = both.select(key, F.coalesce("_b", "primary_behaviour").alias("primary_behaviour"), F.coalesce("_t", "primary_tactic").alias("primary_tactic"), F.col("action").isNotNull().alias("updated"))
    return base, log


def kb_updates(kb_means: DataFrame, now_means: DataFrame, key: str = "cluster", moved: float = 0.5, least: int = 50) -> DataFrame:
    """``(key, action, shift)``: clusters whose centre moved by more than ``moved`` deviations are re-scored, unseen ones of over ``least`` rows are new."""
    old = kb_means.select(key, F.col("mean").alias("_m0"), F.col("std").alias("_s0"))
    joined = now_means.join(old, key, "left")
    shift = F.sqrt(F.aggregate(F.zip_with("mean", "_m0", lambda a, b: (a - b) ** 2), F.lit(0.0), lambda a, x: a + x)) / F.greatest("_s0", F.lit(1e-8))
    action = F.when(F.col("_m0").isNull() & (F.col("n") > least), "new").when(shift > moved, "rescore")
    return joined.withColumn("shift", shift).withColumn("action", action).where("action is not null").select(key, "action", "shift")
