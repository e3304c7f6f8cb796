"""How a flow came to its tactic: one provenance struct per flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entries(df: DataFrame, key: str, name: str, value: str, alias: str) -> DataFrame:
    """``(key, alias)``: a map of the positive values per key, small by the number of names."""
    kept = df.where(F.col(value) > 0)
    return kept.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias(alias))


def traced(flows: DataFrame, heuristics: list[str], rules: DataFrame, behaviours: DataFrame, weights: DataFrame, tactics: DataFrame) -> DataFrame:
    """``flows`` with ``provenance``: cluster, heuristic scores, rule hits, behaviour shares, their tactic weights, tactic shares, behaviour, tactic.

    ``flows`` has ``cluster`` and the columns ``heuristics``; filter it by key before, and the filter reaches the scan. ``rules`` are
    ``(cluster, behaviour, score)``, ``behaviours`` ``(cluster, behaviour, p)``, ``weights`` ``(behaviour, tactic, weight)``, ``tactics``
    ``(cluster, tactic, p)``: small tables of one row per cluster and name. A flow of an unknown cluster has nulls. Ties go to the first name.
    """
    contributions = behaviours.where("p > 0").join(weights, "behaviour").select("cluster", F.concat_ws(" -> ", "behaviour", "tactic").alias("way"), (F.col("p") * F.col("weight")).alias("part"))
    parts = [
        entries(rules, "cluster", "behaviour", "score", "hits"), entries(behaviours, "cluster", "behaviour", "p", "shares"),
        entries(contributions, "cluster", "way", "part", "weights"), entries(tactics, "cluster", "tactic", "p", "tactics"),
    ]
    best = lambda df, name: df.groupBy("cluster").agg(F.max_by(name, F.struct(F.round("p", 9), F.col("_order"))).alias(name))
    for df, name in ((behaviours, "behaviour"), (tactics, "tactic")):
        ordered = df.withColumn("_order", F.transform(F.split(F.col(name), ""), lambda c: -F.ascii(c)))
        parts.append(best(ordered, name))
    out = flows
    for part in parts:
        out = out.join(part, "cluster", "left")
    scores = F.struct(*[F.col(h) for h in heuristics]).alias("scores")
    provenance = F.struct("cluster", scores, "hits", "shares", "weights", "tactics", "behaviour", "tactic").alias("provenance")
    kept = [c for c in flows.columns if c not in heuristics and c != "cluster"]
    return out.select(*kept, provenance)
