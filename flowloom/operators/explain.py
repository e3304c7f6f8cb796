"""Checks and texts about labelled clusters: agreement, completeness, alignment with expectations, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import metrics

#: Expected features per tactic: (feature, operator, bound); fixed values.
EXPECTED = {
    "bot_iot": {
        "Impact": [("tcp_flags", "<", 4.0), ("out_bytes", "<", 10.0)],
        "Reconnaissance": [("tcp_flags", ">", 15.0), ("out_bytes", "<", 200.0)],
        "Exfiltration": [("out_bytes", ">", 50000.0)],
        "None": [("min_ttl", "<", 25.0)],
    },
    "cicids": {
        "Impact": [("duration", ">", 2000000.0)],
        "Command and Control": [("tcp_flags", ">", 200.0)],
        "Credential Access": [("dst_port", "<", 25.0)],
        "None": [("duration", "<", 500000.0)],
    },
}
#: Stand-ins for flow features where only a latent mean is known: (name, dimension, factor, offset); fixed values.
PROXIES = [
    ("tcp_flags", 0, 10.0, 0.0), ("out_bytes", 1, 1000.0, 0.0), ("in_bytes", 2, 1000.0, 0.0), ("min_ttl", 3, 30.0, 0.0), ("duration", 4, 100000.0, 0.0),
    ("dst_port", 5, 1000.0, 0.0), ("pps", 6, 5000.0, 0.0), ("dir_ratio", 7, 1.0, 0.0), ("bpp", 8, 100.0, 0.0), ("longest_pkt", 9, 500.0, 0.0),
    ("shortest_pkt", 10, 50.0, 0.0), ("fan_out", 11, 5.0, 1.0), ("fan_in", 12, 5.0, 1.0),
]


def alignment(profiles: DataFrame, primary: str, table: dict[str, list[tuple]]) -> DataFrame:
    """Rows whose tactic has expectations, with ``aligned``: every expected feature that is known lies on its side."""
    known = aligned = None
    for tactic, tests in table.items():
        here, ok = F.col(primary) == tactic, F.lit(True)
        for feature, op, bound in tests:
            if feature in profiles.columns:
                x = F.col(feature)
                ok &= F.coalesce(x < bound if op == "<" else x > bound, F.lit(True))
        known = here if known is None else known | here
        aligned = F.when(here, ok) if aligned is None else aligned.when(here, ok)
    return profiles.where(known).withColumn("aligned", aligned)


def completeness(kb: DataFrame, slack: float = 0.1) -> DataFrame:
    """One row of shares: entries with all fields, with behaviours, with tactics, and with behaviours that sum to about one."""
    total = F.aggregate(F.map_values("behaviour_scores"), F.lit(0.0), lambda a, x: a + x)
    filled = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    whole = F.lit(True)
    for c in ("behaviour_scores", "tactic_scores", "primary_behaviour", "primary_tactic", "cluster_size"):
        whole &= F.col(c).isNotNull()
    share = lambda c: F.avg(c.cast("double"))
    return kb.agg(
        F.count(F.lit(1)).alias("entries"), share(whole).alias("complete"), share(filled("behaviour_scores")).alias("behaviours"), share(filled("tactic_scores")).alias("tactics"),
        share(F.coalesce(F.abs(total - 1) < slack, F.lit(False))).alias("normalised"),
    )


def complementarity(rows: DataFrame) -> DataFrame:
    """One row about ``(truth, rule, other, fused, n)``: accuracies, who is right where the first two differ, flow-weighted accuracies."""
    ok = {c: F.col(c) == F.col("truth") for c in ("rule", "other", "fused")}
    differ = F.col("rule") != F.col("other")
    share = lambda c: F.avg(c.cast("double"))
    number = lambda c: F.sum(c.cast("long"))
    return rows.agg(
        F.count(F.lit(1)).alias("clusters"), share(~differ).alias("agreement"), *[share(x).alias(f"{c}_accuracy") for c, x in ok.items()],
        number(differ).alias("differ"), number(differ & ok["rule"]).alias("differ_rule_right"), number(differ & ok["other"]).alias("differ_other_right"),
        number(differ & ~ok["rule"] & ~ok["other"]).alias("differ_both_wrong"), share(ok["rule"] | ok["other"]).alias("either_accuracy"),
        *[(F.sum(x.cast("double") * F.col("n")) / F.sum("n")).alias(f"{c}_flow_weighted") for c, x in ok.items()],
    )


def labelling_comparison(truth: DataFrame, strategies: dict[str, DataFrame], key: str, labels: list[str], eps: float = 1e-8) -> DataFrame:
    """Per strategy, averaged over keys it knows: agreement of the first labels, soft Jaccard, KL(truth | strategy), cosine.

    All tables are long ``(key, label, p)``; first labels are taken over all labels (ties: the
    alphabetically first), distances over the given list.
    """
    def first(df: DataFrame, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.round("p", 9).desc(), "label"))
        return df.withColumn("_r", rank).where("_r = 1").select(key, F.col("label").alias(name))

    out = None
    wanted = F.col("label").isin(labels)
    for name, df in strategies.items():
        t = truth.join(df.select(key).distinct(), key, "left_semi")
        both = t.where(wanted).select(key, "label", F.col("p").alias("t"), F.lit(0.0).alias("q")).unionByName(df.where(wanted).select(key, "label", F.lit(0.0).alias("t"), F.col("p").alias("q")))
        pairs = both.groupBy(key, "label").agg(F.sum("t").alias("t"), F.sum("q").alias("q"))
        t_, q = F.col("t"), F.col("q")
        each = pairs.groupBy(key).agg(
            (F.sum(F.least(t_, q)) / F.greatest(F.sum(F.greatest(t_, q)), F.lit(eps))).alias("jaccard"),
            F.sum(F.when(t_ > eps, t_ * F.log(t_ / F.greatest(q, F.lit(eps)))).otherwise(0.0)).alias("kl"),
            F.sum(t_ * q).alias("tq"), F.sqrt(F.sum(t_ * t_)).alias("nt"), F.sqrt(F.sum(q * q)).alias("nq"),
        )
        cosine = F.when((F.col("nt") < eps) | (F.col("nq") < eps), 0.0).otherwise(F.col("tq") / (F.col("nt") * F.col("nq")))
        right = first(t, "a").join(first(df, "b"), key, "left").select(key, (F.coalesce(F.col("a") == F.col("b"), F.lit(False))).cast("double").alias("right"))
        joined = right.join(each, key, "left")
        row = joined.agg(
            F.lit(name).alias("strategy"), F.count(F.lit(1)).alias("clusters"), F.avg("right").alias("agreement"), F.avg("jaccard").alias("soft_jaccard"),
            F.avg("kl").alias("kl"), F.avg(cosine).alias("cosine"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def stability(runs: DataFrame, variant: str, item: str, label: str) -> DataFrame:
    """Per variant the mean share of an item's most frequent label over its repeats."""
    counts = runs.groupBy(variant, item, label).agg(F.count(F.lit(1)).alias("n"))
    each = counts.groupBy(variant, item).agg((F.max("n") / F.sum("n")).alias("s"), F.sum("n").alias("m"))
    return each.groupBy(variant).agg(F.sum("m").alias("runs"), F.avg("s").alias("stability"))


def categorical_shares(df: DataFrame, group: str, indicators: dict[str, Column]) -> DataFrame:
    """``(group, label, share, rank)``: means of one-hot indicators, the most frequent first (ties by label)."""
    means = df.groupBy(group).agg(*[F.avg(c.cast("double")).alias(name) for name, c in indicators.items()])
    long = means.unpivot([group], list(indicators), "label", "share")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("share").desc(), "label")))


def summary_text(key: str) -> Column:
    """One sentence per cluster from its profile, in whole numbers."""
    whole = lambda c: F.floor(c + 0.5).cast("long")
    c = F.col
    return F.format_string(
        "Cluster %d holds %d flows (%d per mille). Mean bytes in %d, out %d; mean duration %d ms; packets per second %d. TTL of zero in %d %%, SYN only in %d %%. %d sources, %d destinations, %d pairs.",
        c(key), c("size"), whole(c("proportion") * 1000), whole(c("in_bytes")), whole(c("out_bytes")), whole(c("duration")), whole(c("pps")),
        whole(c("share_ttl0") * 100), whole(c("share_syn") * 100), c("n_src"), c("n_dst"), c("n_pairs"),
    )


def proxy_features(mean: str = "mean") -> list[Column]:
    """Stand-ins for flow features from a component's latent mean; a missing dimension gives the offset."""
    return [(F.abs(F.coalesce(F.get(mean, F.lit(i)), F.lit(0.0))) * factor + offset).alias(name) for name, i, factor, offset in PROXIES]


def row_normalised(counts: DataFrame) -> DataFrame:
    """A confusion table with ``share``, each cell's part of its true label's rows."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true_label")))


def reconstruction_error(a: str, b: str) -> Column:
    """Mean squared difference of two vectors; null where either is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def combined_auc(df: DataFrame, scores: list[str], positive: str) -> DataFrame:
    """``(score, auc, average_precision)`` of every score and of the mean of all, each scaled to 0..1 first."""
    ends = df.agg(*[f(c).alias(f"_{k}{c}") for c in scores for k, f in (("a", F.min), ("b", F.max))])
    scaled = [(F.col(c) - F.col(f"_a{c}")) / (F.col(f"_b{c}") - F.col(f"_a{c}") + 1e-10) for c in scores]
    mean = scaled[0]
    for s in scaled[1:]:
        mean = mean + s
    wide = df.crossJoin(F.broadcast(ends)).select(positive, *scores, (mean / len(scores)).alias("combined"))  # one row
    out = None
    for c in [*scores, "combined"]:
        row = metrics.roc_auc(wide, c, positive).select(F.lit(c).alias("score"), "auc", "average_precision")
        out = row if out is None else out.unionByName(row)
    return out
