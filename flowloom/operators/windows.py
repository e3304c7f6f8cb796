"""Causal sequences and count windows per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rules
from .timeline import class_rank

#: Flows of one source, and positions, that are ordered in one task.
RUN = 100_000

def causal_sequences(df: DataFrame, columns: list[str], length: int = 10, key: str = "src", order: str = "pos") -> DataFrame:
    """``seq`` (front zero-padded), ``mask`` and the positions it covers, of the last flows of the same source up to this one.

    A source is cut into runs of ``RUN`` flows by rank; the last flows of a run are copied to the
    next one, so that no task holds a whole source. Flows without a source are left out.
    """
    ranked = class_rank(df, key, [order])
    run = F.floor((F.col("_rank") - 1) / RUN)
    carried = F.col("_rank") > (run + 1) * RUN - (length - 1)
    placed = ranked.withColumn("_own", run).withColumn("_run", F.explode(F.when(carried, F.array(run, run + 1)).otherwise(F.array(run))))
    frame = Window.partitionBy(key, "_run").orderBy(order).rowsBetween(1 - length, 0)
    past = F.collect_list(F.struct(F.col(order).alias("p"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))).over(frame)
    held = placed.withColumn("_s", past).where("_own = _run")
    missing = F.lit(length) - F.size("_s")
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), len(columns)), missing)
    return held.select(
        *df.columns,
        F.concat(zero, F.col("_s.x")).alias("seq"),
        F.concat(F.array_repeat(F.lit(0), missing), F.array_repeat(F.lit(1), F.size("_s"))).alias("mask"),
        F.col("_s.p").alias("covered"),
    )


def count_windows(df: DataFrame, size: int, order: list[str], key: str = "src", full_only: bool = False) -> DataFrame:
    """``window_id`` of every flow: ``size`` consecutive flows per source; ``full_only`` drops a partial tail.

    Ranks are taken per source and time bucket and shifted by small bucket counts, so
    that a source with most of the flows is not sorted in one task. A null source has
    no window.
    """
    out = class_rank(df, key, order).withColumn("window_id", F.floor((F.col("_rank") - 1) / size))
    if full_only:
        totals = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(totals, key).where((F.col("window_id") + 1) * size <= F.col("_n")).drop("_n")
    return out.drop("_rank")


def mean_distribution(long: DataFrame, keys: list[str], label: str = "label", score: str = "score", rows: Column | None = None) -> DataFrame:
    """Per key the mean of long-form distributions, renormalised: ``(*keys, label, p)``."""
    sums = long.groupBy(*keys, label).agg(F.sum(score).alias("_s"))
    total = F.sum("_s").over(Window.partitionBy(*keys))
    return sums.select(*keys, label, F.when(total > 0, F.col("_s") / total).otherwise(0.0).alias("p"))


def primary(long: DataFrame, keys: list[str], label: str = "label", p: str = "p", tie: str | None = None) -> DataFrame:
    """The highest entry per key; ties go to the lowest ``tie`` (default: the label)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(p).desc(), F.col(tie or label)))
    return long.withColumn("_r", rank).where("_r = 1").drop("_r")


def majority(df: DataFrame, keys: list[str], label: str, order: str = "pos") -> DataFrame:
    """Most frequent label per key with its share; ties go to the label seen first."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    over = Window.partitionBy(*keys)
    ranked = counts.withColumn("_r", F.row_number().over(over.orderBy(F.col("n").desc(), "_first"))).withColumn("n_flows", F.sum("n").over(over))
    return ranked.where("_r = 1").select(*keys, F.col(label).alias("majority"), "n_flows", (F.col("n") / F.col("n_flows")).alias("purity"))


def window_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sums, means, population deviations, shares and distinct ratios per window; distinct values are sets of at most a window's flows, no row is repeated for a count."""
    n = F.count(F.lit(1))
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*keys).agg(
        n.alias("n_flows"),
        *[f(F.col(c)).alias(f"{k}_{c}") for c in ("in_bytes", "out_bytes", "in_pkts", "out_pkts") for k, f in (("sum", F.sum), ("avg", F.avg))],
        F.stddev_pop("in_bytes").alias("std_in_bytes"), F.stddev_pop("in_pkts").alias("std_in_pkts"),
        share(F.col("protocol") == 6).alias("share_tcp"), share(F.col("protocol") == 17).alias("share_udp"), share(F.col("protocol") == 1).alias("share_icmp"),
        share((F.col("tcp_flags").bitwiseAND(2) != 0) & (F.col("tcp_flags").bitwiseAND(16) == 0)).alias("share_syn_only"),
        (F.size(F.collect_set("dst")) / n).alias("dst_ratio"), (F.size(F.collect_set("dst_port")) / n).alias("port_ratio"),
        F.avg("min_ttl").alias("avg_min_ttl"), F.min("min_ttl").alias("min_min_ttl"), F.max("in_bytes").alias("max_in_bytes"),
    )


def window_measures(df: DataFrame, keys: list[str]) -> DataFrame:
    """The 27 measures of a window that the window scorer reads; distinct values are sets of at most a window's flows."""
    c, n = F.col, F.count(F.lit(1))
    share = lambda x: F.avg(x.cast("double"))
    kinds = lambda x: F.size(F.collect_set(x))
    pkts, size = c("in_pkts") + c("out_pkts"), c("in_bytes") + c("out_bytes")
    return df.groupBy(*keys).agg(
        n.alias("n_flows"), kinds("dst").alias("fan_out"), F.lit(1).alias("fan_in"), F.avg("tcp_flags").alias("tcp_flags_mean"),
        share(c("tcp_flags") < 4).alias("syn_only_fraction"), share(c("tcp_flags") > 15).alias("normal_tcp_fraction"),
        F.sum("out_bytes").alias("total_out_bytes"), F.avg("out_bytes").alias("mean_out_bytes"), F.sum("in_bytes").alias("total_in_bytes"), F.avg("in_bytes").alias("mean_in_bytes"),
        share(c("out_bytes") < 10).alias("zero_payload_fraction"), F.avg(pkts).alias("mean_total_pkts"), F.sum(pkts).alias("total_pkts"),
        (F.sum(size) / F.greatest(F.sum(pkts), F.lit(1.0))).alias("mean_bytes_per_pkt"), F.avg("min_ttl").alias("mean_min_ttl"),
        F.avg("dst_port").alias("mean_dst_port"), F.avg("src_port").alias("mean_src_port"), share(c("dst_port") < 1024).alias("low_port_fraction"), share(c("dst_port") > 10000).alias("high_port_fraction"),
        F.avg("duration_ms").alias("mean_duration_ms"), (F.sum("out_bytes") / F.greatest(F.sum("in_bytes"), F.lit(0.01))).alias("direction_ratio"),
        *[share(c("protocol") == p).alias(f"{name}_fraction") for name, p in (("tcp", 6), ("udp", 17), ("icmp", 1))],
        (kinds("dst_port") / n).alias("port_diversity"), (kinds("protocol") / n).alias("protocol_diversity"), F.stddev_pop(size).alias("pkt_size_std"),
    )


def window_behaviours(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long ``(*keys, behaviour, score)`` of the additive window scorer."""
    return rules.expert_scores(window_measures(df, keys), keys, rules.WINDOW_BEHAVIOURS, rivals=[])
