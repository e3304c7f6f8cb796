"""Registered queries of data preparation, window scores, evaluations and streams, with their SQL counterparts."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import baselines, explain, fusion, graph, metrics, mixture, profiles, rules, timeline, windows
from ..sources.flows import ORDER, flow_lines, flows, held_out, load_model, read_kb, save_model, stratified_sample, write_kb
from ..sources.shared import shared_folder, written
from ..streaming import flow_stream, model_stream, phases
from .catalogue import (
    heuristic_rows_from,
    _CL, _E, _FP, _ORACLES, _FU, _J, _OT, _P, _PCOLS, _PRI, _PROF, _RULED, _SPLIT, _TL, _TRUE, _WIN, _Z, _bands, _expert_sql, _rules_sql, _split, cluster_features, clustered, embeddings, heuristic_rows,
    heuristic_sql, joint_sql, near, other_tactics, params_sql, query, rd, rounded, rule_tactics, scored_embeddings, tactic_confusion, windowed, with_sql,
)

# ---- data preparation -------------------------------------------------------------------------------------------------

_TON = {"benign": "Benign", "reconnaissance": "Reconnaissance", "dos": "DoS", "ddos": "DDoS"}
_HELD = ("tr AS (SELECT * FROM flows WHERE flow_key % 5 <> 0)", "hs AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s_{c}" for c in _Z) + " FROM tr)")
_HZ = lambda t, cols: ", ".join(f"({t}.{c} - m_{c}) / s_{c} AS {c}_z" for c in cols)


@query(with_sql(*_HELD) + f"""SELECT src, dst, flow_key, line_no, CASE WHEN attack = 'Theft' THEN 'Theft' ELSE attack END AS attack, attack <> 'Theft' AS in_scope, {rd(*[f'{c}_z' for c in _Z])}
  FROM (SELECT flows.*, {_HZ('flows', _Z)} FROM flows, hs WHERE flow_key % 5 = 0)""")
def heldout_scaled(spark, d):
    """Held-out rows through the scaler of the training rows, labels mapped, out-of-scope rows kept as context."""
    df = flows(spark, d, duration=True)
    stats = S.scale_stats(df.where("flow_key % 5 <> 0"), _Z)
    out = held_out(S.scaled(df.where("flow_key % 5 = 0"), _Z, stats), "attack", _TON)
    return rounded(out.select("src", "dst", "flow_key", "line_no", "attack", "in_scope", *[f"{c}_z" for c in _Z]))


_DUP = ["in_pkts", "out_pkts"]


@query(with_sql(*_HELD, f"hz AS (SELECT flows.*, {_HZ('flows', _DUP)} FROM flows, hs)") + """SELECT attack, count(*) AS n, sum(flow_key) AS keys FROM hz h WHERE flow_key % 5 = 0 AND NOT EXISTS (SELECT 1 FROM hz t WHERE t.flow_key % 5 <> 0
  AND round(t.in_pkts_z, 6) = round(h.in_pkts_z, 6) AND round(t.out_pkts_z, 6) = round(h.out_pkts_z, 6) AND t.protocol = h.protocol AND t.tcp_flags = h.tcp_flags) GROUP BY 1""")
def heldout_dedup(spark, d):
    """Held-out rows without those that equal a training row after scaling."""
    df = flows(spark, d)
    stats = S.scale_stats(df.where("flow_key % 5 <> 0"), _DUP)
    z = S.scaled(df, _DUP, stats)
    left = timeline.without_cross_duplicates(z.where("flow_key % 5 = 0"), z.where("flow_key % 5 <> 0"), ["in_pkts_z", "out_pkts_z", "protocol", "tcp_flags"])
    return left.groupBy("attack").agg(F.count(F.lit(1)).alias("n"), F.sum("flow_key").cast("double").alias("keys"))


_GAP = ("gp AS (SELECT * FROM sp t WHERE split = 'gap' AND NOT EXISTS (SELECT 1 FROM sp r WHERE r.split = 'train' AND r.in_pkts = t.in_pkts AND r.out_pkts = t.out_pkts AND r.protocol = t.protocol AND r.tcp_flags = t.tcp_flags))",
  "gr AS (SELECT *, row_number() OVER (PARTITION BY attack ORDER BY ts_ms, flow_key, line_no, dst, src) - 1 AS idx FROM gp)", "gc AS (SELECT attack, count(*) AS n, least(count(*), 40) AS k FROM gp GROUP BY 1)",
  "gk AS (SELECT DISTINCT attack, CASE WHEN k = 1 THEN 0 ELSE CAST(floor(i * (n - 1) / (k - 1)) AS BIGINT) END AS idx FROM (SELECT *, unnest(generate_series(0, k - 1)) AS i FROM gc))")


@query(with_sql(*_SPLIT, *_GAP) + "SELECT src, dst, flow_key, line_no, attack FROM gr JOIN gk USING (attack, idx)")
def validation_set(spark, d):
    """Gap rows of the split without train duplicates, balanced like the test rows."""
    df = _split(spark, d, "in_pkts", "out_pkts", "protocol", "tcp_flags")
    gap = timeline.without_cross_duplicates(df.where("split = 'gap'"), df.where("split = 'train'"), ["in_pkts", "out_pkts", "protocol", "tcp_flags"])
    counts = gap.groupBy("attack").agg(F.count(F.lit(1)).alias("n"))
    targets = timeline.target_sizes(counts, "attack", total=30_000, cap=40, floor=1, oversample=False)
    return timeline.strided(gap, "attack", ORDER, targets).select("src", "dst", "flow_key", "line_no", "attack")


@query(with_sql(*_SPLIT) + """SELECT (SELECT count(*) FROM sp a JOIN sp b USING (src, dst, flow_key, line_no, ts_ms) WHERE a.split = 'train' AND b.split = 'test') AS train_and_test,
  (SELECT count(*) FROM sp a JOIN sp b USING (src, dst, flow_key, line_no, ts_ms) WHERE a.split = 'gap' AND b.split <> 'gap') AS gap_and_other""")
def split_leakage(spark, d):
    """Rows that two parts of the split share; both numbers must be zero."""
    df, key = _split(spark, d), ["src", "dst", "flow_key", "line_no", "ts_ms"]
    both = lambda a, b, name: df.where(a).select(key).join(df.where(b).select(key), key, "left_semi").agg(F.count(F.lit(1)).alias(name))
    return both("split = 'train'", "split = 'test'", "train_and_test").crossJoin(both("split = 'gap'", "split <> 'gap'", "gap_and_other"))  # one row each


_SCALE = ("cn AS (SELECT attack, count(*) AS n FROM flows GROUP BY 1)", "tg AS (SELECT attack, n, greatest(least(n, 400), 150) AS t0 FROM cn)", "ts AS (SELECT sum(t0) AS t FROM tg)")


@query(with_sql(*_SCALE) + "SELECT attack, CASE WHEN t > 1000 THEN greatest(CAST(floor(t0 * 1000 / CAST(t AS DOUBLE)) AS BIGINT), least(t0, 150)) ELSE t0 END AS target, greatest(0, CASE WHEN t > 1000 THEN greatest(CAST(floor(t0 * 1000 / CAST(t AS DOUBLE)) AS BIGINT), least(t0, 150)) ELSE t0 END - n) AS copies FROM tg, ts")
def scaled_targets(spark, d):
    """Target sizes where the total binds: scaled down, but not below the floor; rare classes would be copied."""
    counts = flows(spark, d).groupBy("attack").agg(F.count(F.lit(1)).alias("n"))
    sized = timeline.target_sizes(counts, "attack", total=1000, cap=400, floor=150, oversample=True)
    return sized.select("attack", "target", F.greatest(F.lit(0), F.col("target") - F.col("n")).cast("long").alias("copies"))


@query(with_sql() + "SELECT attack, greatest(count(*), 5 * (SELECT min(n) FROM (SELECT count(*) AS n FROM flows GROUP BY attack))) AS rows, count(*) AS originals FROM flows GROUP BY 1")
def oversampled(spark, d):
    """Every class raised to five times the smallest one by hash-chosen copies."""
    df = flows(spark, d).select("attack", *ORDER)
    counts = df.groupBy("attack").agg(F.count(F.lit(1)).alias("n"))
    floor = counts.agg((5 * F.min("n")).alias("_f"))
    targets = counts.crossJoin(F.broadcast(floor)).select("attack", "n", F.greatest("n", "_f").alias("target"))  # one row
    taken = timeline.strided(df, "attack", ORDER, targets)
    return taken.groupBy("attack").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("copy_no") == 0).cast("long")).alias("originals"))


@query(with_sql() + "SELECT attack, least(count(*), 500 // (SELECT count(DISTINCT attack) FROM flows)) AS n FROM flows GROUP BY 1")
def exact_sample(spark, d):
    return stratified_sample(flows(spark, d), "attack", 500, 42, ["flow_key", "line_no", "dst", "src"]).groupBy("attack").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql() + "SELECT attack, count(*) AS n FROM flows WHERE attack <> 'Theft' GROUP BY 1")
def left_out_class(spark, d):
    return timeline.leave_out(flows(spark, d), "attack", "Theft").groupBy("attack").agg(F.count(F.lit(1)).alias("n"))


_PK = "CASE WHEN in_pkts + out_pkts > 0 THEN out_bytes / greatest(in_pkts + out_pkts, 1) ELSE 0 END"
_ZW = "CASE WHEN abs(z) < 0.5 THEN 'near average' WHEN abs(z) < 1 THEN 'slightly' WHEN abs(z) < 2 THEN 'notably' ELSE 'strongly' END"


@query(with_sql(*_HELD) + f"SELECT {_bands('b', S.PACKET)} AS packets, {_ZW} AS word, count(*) AS n FROM (SELECT {_PK} AS b, (in_pkts - m_in_pkts) / s_in_pkts AS z FROM flows, hs) GROUP BY 1, 2")
def packet_and_deviation_words(spark, d):
    """Packet-size classes against the words for deviations of packet counts."""
    df = flows(spark, d)
    z = S.scaled(df, ["in_pkts"], S.scale_stats(df.where("flow_key % 5 <> 0"), ["in_pkts"]))
    size = S.bytes_per_packet(F.col("out_bytes"), F.col("in_pkts") + F.col("out_pkts"))
    return z.groupBy(S.banded(size, S.PACKET).alias("packets"), S.z_word(F.col("in_pkts_z")).alias("word")).agg(F.count(F.lit(1)).alias("n"))


_LS = "ls AS (SELECT avg(ln(1 + in_bytes)) AS m, CASE WHEN stddev_pop(ln(1 + in_bytes)) > 0 THEN stddev_pop(ln(1 + in_bytes)) ELSE 1 END AS s FROM flows)"


@query(with_sql(_CL, _LS) + "SELECT cluster, round(exp(greatest(avg((ln(1 + in_bytes) - m) / s) * any_value(s) + any_value(m), 0)) - 1, 3) AS in_bytes FROM cl, ls GROUP BY 1")
def unscaled_means(spark, d):
    """Cluster means of a scaled log feature in original units."""
    df = clustered(spark, d, False).withColumn("x", F.log1p("in_bytes"))
    stats = S.scale_stats(df, ["x"])
    means = S.scaled(df, ["x"], stats).groupBy("cluster").agg(F.avg("x_z").alias("z"))
    return rounded(means.crossJoin(F.broadcast(stats)).select("cluster", S.unscaled(F.col("z"), F.col("_m_x"), F.col("_s_x"), logged=True).alias("in_bytes")), 3)  # one row


# ---- graph, profiles --------------------------------------------------------------------------------------------------

_TWO = ("e AS (SELECT src, dst, count(*) AS m FROM flows GROUP BY 1, 2)", "n0 AS (SELECT src AS ip FROM flows UNION SELECT dst FROM flows)",
  "x0 AS (SELECT n0.ip, CAST(coalesce(o, 0) AS DOUBLE) AS a, CAST(coalesce(i, 0) AS DOUBLE) AS b FROM n0 LEFT JOIN (SELECT src AS ip, sum(m) AS o FROM e GROUP BY 1) USING (ip) LEFT JOIN (SELECT dst AS ip, sum(m) AS i FROM e GROUP BY 1) USING (ip))",
  "g0 AS (SELECT dst AS ip, sum(a * m) / sum(m) AS a, sum(b * m) / sum(m) AS b FROM e JOIN x0 ON src = x0.ip GROUP BY 1)",
  "x1 AS (SELECT x0.ip, greatest(0.5::DOUBLE * x0.a - 0.25::DOUBLE * x0.b + 0.125::DOUBLE * coalesce(g0.a, 0), 0) AS a, greatest(0.25::DOUBLE * x0.b + 0.5::DOUBLE * coalesce(g0.b, 0), 0) AS b FROM x0 LEFT JOIN g0 USING (ip))",
  "g1 AS (SELECT dst AS ip, sum(a * m) / sum(m) AS a, sum(b * m) / sum(m) AS b FROM e JOIN x1 ON src = x1.ip GROUP BY 1)")


@query(with_sql(*_TWO) + "SELECT x1.ip, round(x1.a - 0.5::DOUBLE * coalesce(g1.b, 0), 5) + CAST(0 AS DOUBLE) AS h0, round(0.25::DOUBLE * x1.b - coalesce(g1.a, 0), 5) + CAST(0 AS DOUBLE) AS h1 FROM x1 LEFT JOIN g1 USING (ip)")
def sage_two_layers(spark, d):
    edges = flows(spark, d)
    sent, got = (edges.groupBy(F.col(c).alias("ip")).agg(F.count(F.lit(1)).cast("double").alias(a)) for c, a in (("src", "a"), ("dst", "b")))
    x = graph.nodes(edges).join(sent, "ip", "left").join(got, "ip", "left").select("ip", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    layers = [([[0.5, -0.25], [0.0, 0.25]], [[0.125, 0.0], [0.0, 0.5]]), ([[1.0, 0.0], [0.0, 0.25]], [[0.0, -0.5], [-1.0, 0.0]])]
    h = graph.sage(edges, x, layers, ["a", "b"])
    return rounded(h.select("ip", F.col("h")[0].alias("h0"), F.col("h")[1].alias("h1")), 5)


_IP = "mm AS (SELECT ip, round(avg(x), 6) AS h FROM (SELECT src AS ip, in_pkts AS x FROM flows WHERE flow_key % 4 <> 0 UNION ALL SELECT dst, in_pkts FROM flows WHERE flow_key % 4 <> 0) GROUP BY 1)"


@query(with_sql(_IP) + """SELECT attack, count(*) AS n, CAST(sum(CAST(a.h IS NULL AS INTEGER) + CAST(b.h IS NULL AS INTEGER)) AS BIGINT) AS unseen, round(sum(coalesce(a.h, 0) + 2 * coalesce(b.h, 0)), 3) AS total
  FROM flows LEFT JOIN mm a ON src = a.ip LEFT JOIN mm b ON dst = b.ip WHERE flow_key % 4 = 0 GROUP BY 1""")
def flow_context(spark, d):
    """Embeddings of both ends of new flows, looked up among the ends of earlier ones."""
    df = flows(spark, d)
    seen = graph.incident_means(df.where("flow_key % 4 <> 0"), ["in_pkts"]).select("ip", F.array(near("in_pkts", 6)).alias("h"))
    out = graph.flow_context(df.where("flow_key % 4 = 0"), seen, 1)
    total = F.sum(F.col("context")[0] + 2 * F.col("context")[1])
    return rounded(out.groupBy("attack").agg(F.count(F.lit(1)).alias("n"), F.sum("unseen").alias("unseen"), total.alias("total")), 3)


@query(with_sql(_CL) + "SELECT cluster, " + ", ".join(f"round(quantile_cont({c}, 0.05), 4) AS {c}" for c in _PCOLS) + " FROM cl GROUP BY 1")
def fifth_percentiles(spark, d):
    """Exact fifth percentiles per cluster."""
    df = clustered(spark, d, False)
    found = profiles.quantiles(df, "cluster", _PCOLS, 0.05)
    return rounded(profiles.with_quantiles(df.select("cluster").distinct(), found, "cluster", {c: c for c in _PCOLS}), 4)


@query(with_sql() + f"""SELECT {_TRUE} AS tactic, count(*) AS size, round(median(in_bytes), 4) AS med_in_bytes, round(median(out_bytes), 4) AS med_out_bytes, round(median(duration_ms), 4) AS med_duration_ms, round(median(dst_port), 4) AS med_dst_port,
  round(avg(CAST(min_ttl = 0 AS DOUBLE)), 6) AS share_ttl0, round(avg(CAST(min_ttl = 64 AS DOUBLE)), 6) AS share_ttl64, round(avg(CAST(tcp_flags = 2 AS DOUBLE)), 6) AS share_syn, round(avg(CAST(protocol = 17 AS DOUBLE)), 6) AS share_udp FROM flows GROUP BY 1""")
def reference_profile(spark, d):
    """Medians and shares per true tactic."""
    df = rules.attack_tactics(flows(spark, d, True, written(flow_lines(spark, d, True))), rules.attack_table(spark))
    med = ["in_bytes", "out_bytes", "duration_ms", "dst_port"]
    base = profiles.profile(df, "tactic", med).select("tactic", "size", *[f"med_{c}" for c in med])
    parts = profiles.value_shares(df, "tactic").select("tactic", "share_ttl0", "share_ttl64", "share_syn", "share_udp")
    out = base.join(parts, "tactic")
    return out.select("tactic", "size", *[near(f"med_{c}", 4).alias(f"med_{c}") for c in med], *[near(c).alias(c) for c in ("share_ttl0", "share_ttl64", "share_syn", "share_udp")])


_IND = {"TCP": "protocol = 6", "UDP": "protocol = 17", "ICMP": "protocol = 1", "other": "protocol NOT IN (6, 17, 1)"}


@query(with_sql(_CL, "cs AS (" + " UNION ALL ".join(f"SELECT cluster, '{k}' AS label, avg(CAST({v} AS DOUBLE)) AS share FROM cl GROUP BY 1" for k, v in _IND.items()) + ")")
  + "SELECT cluster, label, round(share, 6) AS share, CAST(row_number() OVER (PARTITION BY cluster ORDER BY share DESC, label) AS INTEGER) AS rank FROM cs")
def categorical_shares(spark, d):
    return rounded(explain.categorical_shares(clustered(spark, d, False), "cluster", {k: F.expr(v) for k, v in _IND.items()}))


_ONE = ["in_bytes", "out_bytes", "min_ttl", "PROTO_6", "PROTO_17"]
_OLO = "lo AS (" + " UNION ALL ".join(f"SELECT attack, '{c}' AS feature, CAST({e} AS DOUBLE) AS x FROM flows" for c, e in zip(_ONE, ["in_bytes", "out_bytes", "min_ttl", "protocol = 6", "protocol = 17"])) + ")"


@query(with_sql(_OLO, "mo AS (SELECT attack, feature, avg(x) AS mean FROM lo GROUP BY 1, 2)", "al AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM lo GROUP BY 1)")
  + """SELECT attack, feature, round(effect, 5) + CAST(0 AS DOUBLE) AS effect, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY attack ORDER BY abs(effect) DESC, feature) AS rank
  FROM (SELECT attack, feature, (mean - m) / (s + CAST(1e-8 AS DOUBLE)) AS effect FROM mo JOIN al USING (feature))) WHERE rank <= 3 AND feature NOT LIKE 'PROTO%'""")
def effect_sizes_shown(spark, d):
    """Largest effects; one-hot features take ranks but are not shown."""
    df = flows(spark, d).withColumns({f"PROTO_{p}": (F.col("protocol") == p).cast("double") for p in (6, 17)})
    return rounded(profiles.effect_sizes(df, "attack", _ONE, 3, hidden=("PROTO_",)), 5)


_TEXT = """printf('Cluster %d holds %d flows (%d per mille). Mean bytes in %d, out %d; mean duration %d ms; packets per second %d. TTL of zero in %d %%, SYN only in %d %%. %d sources, %d destinations, %d pairs.', cluster, size, {proportion}, {in_bytes}, {out_bytes}, {duration}, {pps}, {share_ttl0}, {share_syn}, n_src, n_dst, n_pairs)""".format(
    **{c: f"CAST(floor({c}{' * 1000' if c == 'proportion' else ' * 100' if c.startswith('share') else ''} + 0.5) AS BIGINT)" for c in ("proportion", "in_bytes", "out_bytes", "duration", "pps", "share_ttl0", "share_syn")})


@query(with_sql(_CL, *_PROF) + f"SELECT cluster, {_TEXT} AS summary FROM pf")
def cluster_summaries(spark, d):
    return cluster_features(spark, d).select("cluster", explain.summary_text("cluster").alias("summary"))


_ALIGNED = " ".join(f"WHEN tactic = '{t}' THEN " + " AND ".join(f"{f} {op} {b}" for f, op, b in tests) for t, tests in explain.EXPECTED["bot_iot"].items())


@query(with_sql(*_RULED, "pm AS (SELECT cluster, tac AS tactic FROM (SELECT cluster, tactic AS tac, row_number() OVER (PARTITION BY cluster ORDER BY round(p, 9) DESC, tactic) AS r FROM ta) WHERE r = 1)")
  + f"SELECT cluster, tactic, CASE {_ALIGNED} END AS aligned FROM pf JOIN pm USING (cluster) WHERE tactic IN ({', '.join(repr(t) for t in explain.EXPECTED['bot_iot'])})")
def feature_alignment(spark, d):
    features = cluster_features(spark, d)
    best = windows.primary(rule_tactics(spark, d, features)[1].withColumn("p", F.round("p", 9)), ["cluster"], "tactic").select("cluster", "tactic")
    return explain.alignment(features.join(best, "cluster"), "tactic", explain.EXPECTED["bot_iot"]).select("cluster", "tactic", "aligned")


# ---- rules over clusters and windows ----------------------------------------------------------------------------------

_CHAVE = {"shortest_pkt", "bpp_flow", "iat_avg", "fan_out", "iat_max", "tcp_win_in", "protocol", "iat_std", "duration"}
#: The test flows have no shortest packets; a tenth of the longest one stands in.
_CP = """cp AS (SELECT pf.*, longest_pkt / 10 AS shortest_pkt, protocol, bpp_flow FROM pf JOIN (SELECT cluster, avg(protocol) AS protocol, avg(CASE WHEN in_pkts + out_pkts > 0 THEN (in_bytes + out_bytes) / (in_pkts + out_pkts) ELSE 0 END) AS bpp_flow FROM cl GROUP BY 1) USING (cluster))"""


@query(with_sql(_CL, *_PROF, _CP, "cr AS " + _rules_sql(rules.CICIDS_RULES, _CHAVE, "cp")) + "SELECT cluster, behaviour, round(score, 6) AS score FROM cr")
def rule_scores_cicids(spark, d):
    c = F.col
    more = clustered(spark, d, False).groupBy("cluster").agg(F.avg("protocol").alias("protocol"), F.avg(S.bytes_per_packet(c("in_bytes") + c("out_bytes"), c("in_pkts") + c("out_pkts"))).alias("bpp_flow"))
    prof = cluster_features(spark, d).join(more, "cluster").withColumn("shortest_pkt", c("longest_pkt") / 10).select("cluster", *sorted(_CHAVE))
    return rounded(rules.rule_scores(prof, "cluster", rules.CICIDS_RULES))


#: Ports, flags and fans are stretched so that every branch of the scorer is taken.
_E2 = """e2 AS (SELECT pf.* EXCLUDE (dst_port, tcp_flags, fan_out, duration), CAST(cluster * 5 % 26 + CASE WHEN cluster % 3 = 0 THEN 60 WHEN cluster % 3 = 1 THEN 0 ELSE 6000 END AS DOUBLE) AS dst_port, tcp_flags * CASE WHEN cluster % 2 = 0 THEN 15 ELSE 2 END AS tcp_flags,
  CAST(cluster % 7 * CASE WHEN cluster % 4 = 0 THEN 20 ELSE 1 END AS DOUBLE) AS fan_out, CAST(n_pairs / n_dst * CASE WHEN cluster % 5 = 0 THEN 500 ELSE 1 END AS DOUBLE) AS fan_in, duration * CASE WHEN cluster % 6 = 0 THEN 0 ELSE 1 END AS duration,
  CASE WHEN in_pkts + out_pkts > 0 THEN (in_bytes + out_bytes) / (in_pkts + out_pkts) ELSE 0 END AS bpp FROM pf)"""


@query(_expert_sql(rules.EXPERT_CICIDS, [], _E2, source="e2"))
def expert_scores_cicids_first(spark, d):
    k, c = F.col("cluster"), F.col
    prof = cluster_features(spark, d).withColumns({
        "dst_port": (k * 5 % 26 + F.when(k % 3 == 0, 60).when(k % 3 == 1, 0).otherwise(6000)).cast("double"), "tcp_flags": c("tcp_flags") * F.when(k % 2 == 0, 15).otherwise(2),
        "fan_out": (k % 7 * F.when(k % 4 == 0, 20).otherwise(1)).cast("double"), "fan_in": c("n_pairs") / c("n_dst") * F.when(k % 5 == 0, 500).otherwise(1),
        "duration": c("duration") * F.when(k % 6 == 0, 0).otherwise(1), "bpp": S.bytes_per_packet(c("in_bytes") + c("out_bytes"), c("in_pkts") + c("out_pkts")),
    })
    return rounded(rules.expert_scores(prof, "cluster", rules.EXPERT_CICIDS, rivals=[]))


_WMS = """wm AS (SELECT src, window_id, CAST(count(*) AS BIGINT) AS n_flows, CAST(count(DISTINCT dst) AS INTEGER) AS fan_out, 1 AS fan_in, avg(tcp_flags) AS tcp_flags_mean, avg(CAST(tcp_flags < 4 AS DOUBLE)) AS syn_only_fraction, avg(CAST(tcp_flags > 15 AS DOUBLE)) AS normal_tcp_fraction,
  sum(out_bytes) AS total_out_bytes, avg(out_bytes) AS mean_out_bytes, sum(in_bytes) AS total_in_bytes, avg(in_bytes) AS mean_in_bytes, avg(CAST(out_bytes < 10 AS DOUBLE)) AS zero_payload_fraction, avg(in_pkts + out_pkts) AS mean_total_pkts, sum(in_pkts + out_pkts) AS total_pkts,
  sum(in_bytes + out_bytes) / greatest(sum(in_pkts + out_pkts), 1) AS mean_bytes_per_pkt, avg(min_ttl) AS mean_min_ttl, avg(dst_port) AS mean_dst_port, avg(src_port) AS mean_src_port, avg(CAST(dst_port < 1024 AS DOUBLE)) AS low_port_fraction, avg(CAST(dst_port > 10000 AS DOUBLE)) AS high_port_fraction,
  avg(duration_ms) AS mean_duration_ms, sum(out_bytes) / greatest(sum(in_bytes), 0.01::DOUBLE) AS direction_ratio, avg(CAST(protocol = 6 AS DOUBLE)) AS tcp_fraction, avg(CAST(protocol = 17 AS DOUBLE)) AS udp_fraction, avg(CAST(protocol = 1 AS DOUBLE)) AS icmp_fraction,
  count(DISTINCT dst_port) / count(*) AS port_diversity, count(DISTINCT protocol) / count(*) AS protocol_diversity, stddev_pop(in_bytes + out_bytes) AS pkt_size_std FROM wi GROUP BY 1, 2)"""
_WKEYS = ["src", "window_id"]
_WCOLS = [
    "tcp_flags_mean", "syn_only_fraction", "normal_tcp_fraction", "total_out_bytes", "mean_out_bytes", "total_in_bytes", "mean_in_bytes", "zero_payload_fraction", "mean_total_pkts", "total_pkts", "mean_bytes_per_pkt", "mean_min_ttl", "mean_dst_port",
    "mean_src_port", "low_port_fraction", "high_port_fraction", "mean_duration_ms", "direction_ratio", "tcp_fraction", "udp_fraction", "icmp_fraction", "port_diversity", "protocol_diversity", "pkt_size_std",
]


@query(with_sql(_CL, _WIN, _WMS) + "SELECT src, window_id, n_flows, fan_out, fan_in, " + ", ".join(f"CAST(floor({c} * 1000 + 0.12345678::DOUBLE) AS BIGINT) AS {c}" for c in _WCOLS) + " FROM wm")
def window_measures(spark, d):
    """In thousandths, cut where no sum of these decimals can lie."""
    found = windows.window_measures(windowed(spark, d, duration=True), _WKEYS)
    return found.select(*_WKEYS, "n_flows", "fan_out", "fan_in", *[F.floor(F.col(c) * 1000 + 0.12345678).alias(c) for c in _WCOLS])


def _window_sql(tail: str) -> str:
    import re

    plain = lambda p: re.sub(r"(?<=[0-9])D\b", "::DOUBLE", str(p))
    rows = []
    for b, (guard, steps, damp) in rules.WINDOW_BEHAVIOURS.items():
        total = " + ".join("CASE " + " ".join(f"WHEN {plain(p)} THEN CAST({plain(v)} AS DOUBLE)" for p, v in step) + " ELSE 0 END" for step in steps)
        total = f"({total})" + "".join(f" * CASE WHEN {plain(p)} THEN CAST({f} AS DOUBLE) ELSE 1 END" for p, f in damp or [])
        rows.append(f"SELECT src, window_id, '{b}' AS behaviour, CASE WHEN {plain(guard)} THEN least({total}, CAST(1 AS DOUBLE)) ELSE 0 END AS score FROM wm")
    weights = ", ".join(f"('{b}', '{t}', CAST({w} AS DOUBLE))" for b, ws in rules.TACTIC_WEIGHTS["window"].items() for t, w in ws.items())
    return with_sql(_CL, _WIN, _WMS, "wb AS (" + " UNION ALL ".join(rows) + ")", f"tw(behaviour, tactic, weight) AS (VALUES {weights})") + tail


@query(_window_sql("SELECT src, window_id, behaviour, round(score, 5) AS score FROM wb"))
def window_behaviour_scores(spark, d):
    return rounded(windows.window_behaviours(windowed(spark, d, duration=True), _WKEYS), 5)


@query(_window_sql("""SELECT src, window_id, tactic, CASE WHEN m > 0 THEN round(s / m, 3) ELSE s END AS p FROM (SELECT *, max(s) OVER (PARTITION BY src, window_id) AS m FROM
  (SELECT src, window_id, tactic, round(sum(score * weight), 9) AS s FROM wb JOIN tw USING (behaviour) GROUP BY 1, 2, 3))"""))
def window_behaviour_tactics(spark, d):
    """Tactics of windows by the window scorer, scaled by the largest of each window."""
    scores = windows.window_behaviours(windowed(spark, d, duration=True), _WKEYS)
    table = rules.tactic_table(spark, "window")
    mapped = scores.join(F.broadcast(table), "behaviour").groupBy(*_WKEYS, "tactic").agg(F.round(F.sum(F.col("score") * F.col("weight")), 9).alias("score"))  # a fixed table
    most = F.max("score").over(fusion.Window.partitionBy(*_WKEYS))
    return mapped.select(*_WKEYS, "tactic", F.when(most > 0, near(F.col("score") / most, 3)).otherwise(F.col("score")).alias("p"))


_BST = "bt AS (SELECT cluster, behaviour FROM rs WHERE score >= 0.3)"


@query(with_sql(*_RULED, _BST, "rk(tactic, r) AS (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(rules.TACTICS)) + ")")
  + "SELECT cluster, string_agg(DISTINCT tactic, ',' ORDER BY tactic) AS tactics, arg_min(tactic, r) AS primary_tactic FROM bt JOIN tw USING (behaviour) JOIN rk USING (tactic) GROUP BY 1")
def tactic_sets(spark, d):
    """Tactics named by the behaviours that score 0.3 or more, and the first of them by priority."""
    scores = rules.rule_scores(cluster_features(spark, d), "cluster", rules.RULES["bot_iot"]).where("score >= 0.3").select("cluster", "behaviour")
    return rules.tactic_set(scores, ["cluster"], rules.tactic_table(spark)).select("cluster", F.concat_ws(",", "tactics").alias("tactics"), "primary_tactic")


_HROWS = with_sql(*heuristic_sql("CAST(dst % 20 AS INTEGER) AS cluster")) + "SELECT * FROM h"


@query("SELECT label, count(*) AS flows, " + ", ".join(f"round(avg(s_{n}), 6) + CAST(0 AS DOUBLE) AS {n}" for n in S.HEURISTICS) + f" FROM ({_HROWS}) JOIN ({_ORACLES['default_labels']}) USING (cluster) GROUP BY 1")
def heuristic_label_matrix(spark, d):
    """Mean heuristic scores of the flows under each default label of their cluster."""
    lines = written(flow_lines(spark, d, True))
    labels = rules.default_labels(cluster_features(spark, d, lines=lines)).select("cluster", "label")
    each = heuristic_rows_from(flows(spark, d, True, lines), F.lit(True), (F.col("dst") % 20).cast("int").alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).alias("flows"), *[F.sum(n).alias(n) for n in S.HEURISTICS])
    joined = each.join(labels, "cluster").groupBy("label")
    return rounded(joined.agg(F.sum("flows").alias("flows"), *[(F.sum(n) / F.sum("flows")).alias(n) for n in S.HEURISTICS]))


# ---- fusion and labelling ---------------------------------------------------------------------------------------------

_TRUTH = f"tt AS (SELECT cluster, tactic, n / sum(n) OVER (PARTITION BY cluster) AS p FROM (SELECT cluster, {_TRUE} AS tactic, count(*) AS n FROM cl GROUP BY 1, 2))"
_SIX = ["Impact", "Reconnaissance", "Exfiltration", "None", "Command and Control", "Discovery"]


def true_tactics(spark, d):
    labelled = rules.attack_tactics(clustered(spark, d, False), rules.attack_table(spark))
    return fusion.normalised(labelled.groupBy("cluster", "tactic").agg(F.count(F.lit(1)).cast("double").alias("p")), ["cluster"])


def _compare_sql(name: str, table: str) -> str:
    six = "(" + ", ".join(f"'{t}'" for t in _SIX) + ")"
    return f"""SELECT '{name}' AS strategy, count(*) AS clusters, round(avg(CAST(a = b AS DOUBLE)), 6) AS agreement, round(avg(j), 6) AS soft_jaccard, round(avg(kl), 5) + CAST(0 AS DOUBLE) AS kl, round(avg(co), 6) AS cosine FROM
  (SELECT cluster, sum(least(t, q)) / greatest(sum(greatest(t, q)), 1e-8::DOUBLE) AS j, sum(CASE WHEN t > 1e-8::DOUBLE THEN t * ln(t / greatest(q, 1e-8::DOUBLE)) ELSE 0 END) AS kl, CASE WHEN sum(t * t) * sum(q * q) > 0 THEN sum(t * q) / sqrt(sum(t * t) * sum(q * q)) ELSE 0 END AS co
   FROM (SELECT k.cluster, l.label, coalesce(tt.p, 0) AS t, coalesce(s.p, 0) AS q FROM (SELECT DISTINCT cluster FROM {table}) k CROSS JOIN (SELECT label FROM tl WHERE label IN {six}) l LEFT JOIN tt ON tt.cluster = k.cluster AND tt.tactic = label LEFT JOIN {table} s ON s.cluster = k.cluster AND s.tactic = label) GROUP BY 1)
  JOIN (SELECT cluster, tactic AS a FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(p, 9) DESC, tactic) AS r FROM tt) WHERE r = 1) USING (cluster)
  JOIN (SELECT cluster, tactic AS b FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(p, 9) DESC, tactic) AS r FROM {table}) WHERE r = 1) USING (cluster)"""


@query(with_sql(*_RULED, _OT, _FU, _TRUTH, _TL) + " UNION ALL ".join(_compare_sql(n, t) for n, t in (("rules", "ta"), ("other", "ot"), ("fused", "fu"))))
def labelling_comparison(spark, d):
    own = rule_tactics(spark, d)[1]
    other = other_tactics(spark, d)
    named = lambda df: df.withColumnRenamed("tactic", "label")
    strategies = {"rules": named(own), "other": named(other), "fused": named(fusion.fuse(own, other, "cluster", "tactic"))}
    out = explain.labelling_comparison(named(true_tactics(spark, d)), strategies, "cluster", _SIX)
    return out.select("strategy", "clusters", near("agreement").alias("agreement"), near("soft_jaccard").alias("soft_jaccard"), near("kl", 5).alias("kl"), near("cosine").alias("cosine"))


def _first_sql(table: str, name: str) -> str:
    return f"(SELECT cluster, tactic AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(p, 9) DESC, tactic) AS r FROM {table}) WHERE r = 1)"


@query(with_sql(*_RULED, _OT, _FU, _TRUTH, f"cm AS (SELECT * FROM {_first_sql('tt', 'truth')} JOIN {_first_sql('ta', 'rule')} USING (cluster) JOIN {_first_sql('ot', 'other')} USING (cluster) JOIN {_first_sql('fu', 'fused')} USING (cluster) JOIN (SELECT cluster, size AS n FROM pf) USING (cluster))")
  + """SELECT count(*) AS clusters, round(avg(CAST(rule = other AS DOUBLE)), 6) AS agreement, round(avg(CAST(rule = truth AS DOUBLE)), 6) AS rule_accuracy, round(avg(CAST(other = truth AS DOUBLE)), 6) AS other_accuracy, round(avg(CAST(fused = truth AS DOUBLE)), 6) AS fused_accuracy,
  count(*) FILTER (rule <> other) AS differ, count(*) FILTER (rule <> other AND rule = truth) AS differ_rule_right, count(*) FILTER (rule <> other AND other = truth) AS differ_other_right, count(*) FILTER (rule <> other AND rule <> truth AND other <> truth) AS differ_both_wrong,
  round(avg(CAST(rule = truth OR other = truth AS DOUBLE)), 6) AS either_accuracy, round(sum(n * CAST(rule = truth AS DOUBLE)) / sum(n), 6) AS rule_flow_weighted, round(sum(n * CAST(other = truth AS DOUBLE)) / sum(n), 6) AS other_flow_weighted,
  round(sum(n * CAST(fused = truth AS DOUBLE)) / sum(n), 6) AS fused_flow_weighted FROM cm""")
def complementarity(spark, d):
    own, other = rule_tactics(spark, d)[1], other_tactics(spark, d)
    first = lambda df, name: windows.primary(df.withColumn("p", F.round("p", 9)), ["cluster"], "tactic").select("cluster", F.col("tactic").alias(name))
    rows = first(true_tactics(spark, d), "truth")
    for df, name in ((own, "rule"), (other, "other"), (fusion.fuse(own, other, "cluster", "tactic"), "fused")):
        rows = rows.join(first(df, name), "cluster")
    sizes = clustered(spark, d, False).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return rounded(explain.complementarity(rows.join(sizes, "cluster")))


@query(with_sql(*_RULED) + """SELECT count(*) AS entries, round(avg(CAST(nb > 0 AND nt > 0 AND size > 0 AS DOUBLE)), 6) AS complete, round(avg(CAST(coalesce(nb, 0) > 0 AS DOUBLE)), 6) AS behaviours,
  round(avg(CAST(coalesce(nt, 0) > 0 AS DOUBLE)), 6) AS tactics, round(avg(CAST(coalesce(ok, false) AS DOUBLE)), 6) AS normalised
  FROM pf LEFT JOIN (SELECT cluster, count(*) AS nb, abs(sum(round(p, 4)) - 1) < 0.1 AS ok FROM sh GROUP BY 1) USING (cluster) LEFT JOIN (SELECT cluster, count(*) AS nt FROM ta GROUP BY 1) USING (cluster)""")
def kb_completeness(spark, d):
    behaviours, tactics = rule_tactics(spark, d)
    return rounded(explain.completeness(fusion.build_kb(behaviours, tactics, cluster_features(spark, d).select("cluster", "size"))))


@query(with_sql(*_RULED, _PRI) + "SELECT coalesce(pred, 'Unknown') AS tactic, attack, count(*) AS n FROM cl LEFT JOIN (SELECT * FROM pr WHERE cluster <> 5) USING (cluster) GROUP BY 1, 2")
def kb_lookup(spark, d):
    """Flows with their cluster's entry; cluster 5 has none."""
    behaviours, tactics = rule_tactics(spark, d)
    best = windows.primary(tactics.withColumn("p", F.round("p", 9)), ["cluster"], "tactic").select("cluster", F.col("tactic").alias("primary_tactic"), F.lit("any").alias("primary_behaviour"))
    found = fusion.lookup(clustered(spark, d, False).select("cluster", "attack"), best.where("cluster <> 5"))
    return found.groupBy(F.col("primary_tactic").alias("tactic"), "attack").agg(F.count(F.lit(1)).alias("n"))


_POWERS = [0.5, 1.0, 1.5, 2.0, 3.0, 5.0]


@query(with_sql(_CL, *_PROF, _RULED[-4], _RULED[-2], "gp AS (SELECT unnest([0.5, 1.0, 1.5, 2.0, 3.0, 5.0]::DOUBLE[]) AS power)", "sg AS (SELECT power, cluster, tactic, sum(power(score, power) * weight) AS s FROM rs JOIN tw USING (behaviour), gp GROUP BY 1, 2, 3)",
  "fb AS (SELECT power, cluster, tactic FROM (SELECT *, row_number() OVER (PARTITION BY power, cluster ORDER BY round(s, 9) DESC, tactic) AS r FROM sg) WHERE r = 1)")
  + f"SELECT power, round(avg(CAST(fb.tactic = {_TRUE} AS DOUBLE)), 6) AS accuracy FROM cl JOIN fb USING (cluster) GROUP BY 1")
def sharpening_grid(spark, d):
    """Flow accuracy of the first tactic for each sharpening power; scores are computed once."""
    scores = rules.rule_scores(cluster_features(spark, d), "cluster", rules.RULES["bot_iot"])
    grid = scores.withColumn("power", F.explode(F.array(*[F.lit(p) for p in _POWERS]))).withColumn("s", F.pow("score", "power"))
    mapped = grid.join(F.broadcast(rules.tactic_table(spark)), "behaviour").groupBy("power", "cluster", "tactic").agg(F.round(F.sum(F.col("s") * F.col("weight")), 9).alias("p"))  # a fixed table
    best = windows.primary(mapped, ["power", "cluster"], "tactic").select("power", "cluster", "tactic")
    truth = rules.attack_tactics(clustered(spark, d, False), rules.attack_table(spark)).groupBy("cluster", F.col("tactic").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.sum(F.when(F.col("t") == F.col("tactic"), F.col("n")).otherwise(0)) / F.sum("n")
    return rounded(truth.join(best, "cluster").groupBy("power").agg(hit.alias("accuracy")))


@query(with_sql(*_RULED, _OT, "gw AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS w)", "sw AS (SELECT w, coalesce(ta.cluster, ot.cluster) AS cluster, coalesce(ta.tactic, ot.tactic) AS tactic, w * coalesce(ta.p, 0) + (1 - w) * coalesce(ot.p, 0) AS p FROM ta FULL JOIN ot ON ta.cluster = ot.cluster AND ta.tactic = ot.tactic, gw)",
  "fb AS (SELECT w, cluster, tactic FROM (SELECT *, row_number() OVER (PARTITION BY cluster, w ORDER BY round(p, 9) DESC, tactic) AS r FROM sw) WHERE r = 1)", f"ac AS (SELECT w, avg(CAST(fb.tactic = {_TRUE} AS DOUBLE)) AS accuracy FROM cl JOIN fb USING (cluster) GROUP BY 1)")
  + "SELECT w, round(accuracy, 6) AS accuracy FROM ac ORDER BY round(accuracy, 9) DESC, w LIMIT 1")
def selected_weight(spark, d):
    """The fusion weight with the best flow accuracy; the first of equals."""
    swept = fusion.weight_sweep(rule_tactics(spark, d)[1].withColumn("p", F.round("p", 12)), other_tactics(spark, d).withColumn("p", F.round("p", 12)), "cluster", "tactic", [0.0, 0.25, 0.5, 0.75, 1.0])
    truth = rules.attack_tactics(clustered(spark, d, False), rules.attack_table(spark)).groupBy("cluster", F.col("tactic").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.sum(F.when(F.col("t") == F.col("tactic"), F.col("n")).otherwise(0)) / F.sum("n")
    scores = truth.join(swept, "cluster").groupBy("w").agg(F.round(hit, 9).alias("accuracy"))
    return rounded(fusion.first_best(scores, [], "accuracy", "w"))


_RUNS = "ru AS (SELECT event_type AS method, user_id % 3 AS seed, avg(value) AS f1 FROM events GROUP BY 1, 2)"


def _runs(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("method"), (F.col("user_id") % 3).alias("seed")).agg(F.avg("value").alias("f1"))


@query("WITH " + _RUNS + " SELECT method, count(*) AS seeds, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS std FROM ru GROUP BY 1")
def seed_spread(spark, d):
    """Mean and deviation of a score over seeds per method."""
    return rounded(_runs(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("seeds"), F.avg("f1").alias("mean"), F.stddev_samp("f1").alias("std")))


@query("WITH " + _RUNS + " SELECT method, seed, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY f1 DESC, seed) AS r FROM ru) WHERE r = 1")
def selected_seed(spark, d):
    return rounded(fusion.first_best(_runs(spark, d), ["method"], "f1", "seed"))


# ---- metrics ----------------------------------------------------------------------------------------------------------


@query(with_sql(*_RULED, _PRI, _FP) + "SELECT true_label, pred_label, n, round(n / sum(n) OVER (PARTITION BY true_label), 6) AS share FROM fp")
def confusion_shares(spark, d):
    return rounded(explain.row_normalised(tactic_confusion(spark, d)))


@query(with_sql(*_RULED, _PRI, _FP, _TL) + """SELECT label, support, round(CASE WHEN p + s > 0 THEN 2 * tp / (p + s) ELSE 0 END, 6) AS f1 FROM (SELECT label, CAST(coalesce((SELECT sum(n) FROM fp WHERE true_label = label), 0) AS BIGINT) AS support, CAST(coalesce((SELECT sum(n) FROM fp WHERE true_label = label), 0) AS DOUBLE) AS s,
  CAST(coalesce((SELECT sum(n) FROM fp WHERE pred_label = label), 0) AS DOUBLE) AS p, CAST(coalesce((SELECT sum(n) FROM fp WHERE pred_label = label AND true_label = label), 0) AS DOUBLE) AS tp FROM tl)""")
def prf_given_labels(spark, d):
    """F1 over the fixed list of tactics, those that never occur included."""
    return rounded(metrics.prf(tactic_confusion(spark, d), rules.TACTICS).select("label", "support", "f1"))


@query(with_sql(_CL, _WIN) + """SELECT src, window_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM (SELECT src, window_id, list_distinct(list(attack)) AS a,
  list_distinct(list(attack) FILTER (tcp_flags > 15)) AS b0, coalesce(list_distinct(list(attack) FILTER (tcp_flags > 15)), []) AS b FROM wi GROUP BY 1, 2)""")
def window_set_jaccard(spark, d):
    """Attacks of a window against those of its flows with high flags, as sets."""
    sets = windowed(spark, d, columns=["attack", "tcp_flags"]).groupBy(*_WKEYS).agg(F.collect_set("attack").alias("a"), F.collect_set(F.when(F.col("tcp_flags") > 15, F.col("attack"))).alias("b"))
    return rounded(sets.select(*_WKEYS, metrics.set_jaccard("a", "b").alias("jaccard")))


_AUC = """SELECT '{c}' AS score, round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) AS auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS average_precision FROM (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(q) OVER (ORDER BY s DESC) AS fp
  FROM (SELECT {c} AS s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM ev GROUP BY 1))"""


@query("""WITH e0 AS (SELECT value AS a, CAST(user_id % 17 AS DOUBLE) AS b, event_type IN ('purchase', 'error') AS y FROM events), ev AS (SELECT *, ((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER () + 1e-10::DOUBLE) + (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER () + 1e-10::DOUBLE)) / 2 AS combined FROM e0) """
  + " UNION ALL ".join(_AUC.format(c=c) for c in ("a", "b", "combined")))
def combined_auc(spark, d):
    """AUC of two scores and of their scaled mean."""
    ev = spark.read.parquet(f"{d}/events.parquet").select(F.col("value").alias("a"), (F.col("user_id") % 17).cast("double").alias("b"), F.col("event_type").isin("purchase", "error").alias("y"))
    return rounded(explain.combined_auc(ev, ["a", "b"], "y"))


@query("""WITH v AS (SELECT user_id % 50 AS item, event_type AS label, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS r FROM events), w AS (SELECT * FROM v WHERE r <= 10), c AS (SELECT item, label, count(*) AS n FROM w GROUP BY 1, 2),
  p AS (SELECT avg((sq - 10) / CAST(90 AS DOUBLE)) AS p FROM (SELECT item, sum(n * n) AS sq, sum(n) AS m FROM c GROUP BY 1) WHERE m = 10), f AS (SELECT item FROM c GROUP BY 1 HAVING sum(n) = 10), e AS (SELECT sum(s * s) AS e FROM (SELECT sum(n) / (SELECT sum(n) FROM c JOIN f USING (item)) AS s FROM c JOIN f USING (item) GROUP BY label))
  SELECT round((p - e) / (1 - e), 6) + CAST(0 AS DOUBLE) AS kappa FROM p, e""")
def fleiss_kappa(spark, d):
    """Agreement of ten votes per item; items with fewer votes are left out."""
    ev = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 50).alias("item"), F.col("event_type").alias("label"), "event_id")
    rank = F.row_number().over(fusion.Window.partitionBy("item").orderBy("event_id"))
    votes = ev.withColumn("r", rank).where("r <= 10")
    full = votes.groupBy("item").agg(F.count(F.lit(1)).alias("m")).where("m = 10").select("item")
    return rounded(metrics.fleiss_kappa(votes.join(full, "item", "left_semi"), "item", "label"))


@query("WITH c AS (SELECT user_id % 4 AS variant, user_id AS item, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2, 3), e AS (SELECT variant, item, max(n) / sum(n) AS s, sum(n) AS m FROM c GROUP BY 1, 2) SELECT variant, CAST(sum(m) AS BIGINT) AS runs, round(avg(s), 6) AS stability FROM e GROUP BY 1")
def label_stability(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").withColumn("variant", F.col("user_id") % 4)
    return rounded(explain.stability(ev, "variant", "user_id", "event_type"))


@query("WITH a AS (SELECT vec_id, label, embedding AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x[i] AS DOUBLE)) AS c FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM a) GROUP BY 1, 2), r AS (SELECT vec_id, avg((CAST(x[i] AS DOUBLE) - c) * (CAST(x[i] AS DOUBLE) - c)) AS e FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM a) JOIN m USING (label, i) GROUP BY 1) SELECT vec_id, round(e, 6) AS error FROM r")
def reconstruction_error(spark, d):
    """Mean squared difference of every vector from the centre of its label."""
    e = embeddings(spark, d)
    centres = mixture.label_mixture(e, "embedding", "label").select(F.col("k").alias("label"), "mean")
    return rounded(e.join(F.broadcast(centres), "label").select("vec_id", explain.reconstruction_error("embedding", "mean").alias("error")))  # one row per label


# ---- mixtures, streams ------------------------------------------------------------------------------------------------

_PW = ("po AS (SELECT vec_id, k, exp(l - log_likelihood) AS g FROM lj JOIN ll USING (vec_id))", "kb AS (SELECT DISTINCT label AS k, CASE WHEN label % 3 = 0 THEN 'Impact' WHEN label % 3 = 1 THEN 'Discovery' ELSE 'None' END AS tactic FROM embeddings)",
  "fl AS (SELECT vec_id, tactic, g / sum(g) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, tactic, sum(g) AS g FROM po JOIN kb USING (k) WHERE g >= 1e-6 GROUP BY 1, 2))", "wn AS (SELECT vec_id, vec_id % 7 AS src, (row_number() OVER (PARTITION BY vec_id % 7 ORDER BY vec_id) - 1) // 20 AS window_id FROM embeddings)",
  "ws AS (SELECT src, window_id, tactic, sum(p) AS s FROM fl JOIN wn USING (vec_id) GROUP BY 1, 2, 3)", "wp AS (SELECT src, window_id, tactic, s / sum(s) OVER (PARTITION BY src, window_id) AS p FROM ws)")


@query("WITH " + ", ".join((_E, *_P, *_J, *_PW)) + " SELECT src, window_id, tactic AS primary_tactic, round(p, 4) AS p FROM (SELECT *, row_number() OVER (PARTITION BY src, window_id ORDER BY round(p, 6) DESC, tactic) AS r FROM wp) WHERE r = 1")
def posterior_windows(spark, d):
    """Primary tactic per window of twenty vectors, from posteriors fused with a knowledge base."""
    e = embeddings(spark, d)
    kb = e.select(F.col("label").alias("k"), F.when(F.col("label") % 3 == 0, "Impact").when(F.col("label") % 3 == 1, "Discovery").otherwise("None").alias("tactic"), F.lit(1.0).alias("p")).distinct()
    placed = windows.count_windows(e.select("vec_id", (F.col("vec_id") % 7).alias("src")), 20, ["vec_id"])
    fused = fusion.posterior_fusion(scored_embeddings(spark, d), kb, ["vec_id"], "tactic")
    each = windows.mean_distribution(fused.join(placed, "vec_id").withColumnRenamed("p", "score"), _WKEYS, "tactic")
    return windows.primary(each.withColumn("best", F.round("p", 6)), _WKEYS, "tactic", p="best").select(*_WKEYS, F.col("tactic").alias("primary_tactic"), near("p", 4).alias("p"))


@query("WITH " + ", ".join((_E, *_P)) + " SELECT CAST(k AS INTEGER) AS k, " + ", ".join(f"round(abs(max(m) FILTER (i = {i + 1})) * {f} + {o}, 4) AS {n}" for n, i, f, o in explain.PROXIES) + " FROM mp GROUP BY 1")
def proxy_features(spark, d):
    params = mixture.label_mixture(embeddings(spark, d), "embedding", "label")
    return rounded(params.select("k", *explain.proxy_features()), 4)


_HOLD = 3
_HJ = params_sql(f"WHERE label <> {_HOLD}")


@query("WITH " + ", ".join((_E, *_HJ, *_J, f"""nv AS (SELECT ll.vec_id, log_likelihood AS l, label = {_HOLD} AS h, label % 4 = 0 AS b, cluster % 4 = 0 AS gate, log_likelihood < (SELECT quantile_cont(log_likelihood, 0.05) FROM ll JOIN embeddings USING (vec_id) WHERE label <> {_HOLD}) AS f0 FROM ll JOIN embeddings USING (vec_id))""",
  "gs AS (SELECT *, unnest([false, true]) AS gated FROM nv)", "sc AS (SELECT *, CASE WHEN gated AND gate THEN -(SELECT max(l) FROM nv) - 1 ELSE -l END AS s, f0 AND NOT (gated AND gate) AS f FROM gs)",
  "ra AS (SELECT gated, sum(q * (tp - p / 2)) / (sum(p) * sum(q)) AS auc FROM (SELECT *, sum(p) OVER (PARTITION BY gated ORDER BY s DESC) AS tp FROM (SELECT gated, s, count(*) FILTER (h) AS p, count(*) FILTER (NOT h) AS q FROM sc GROUP BY 1, 2)) GROUP BY 1)"))
  + """ SELECT gated, round(any_value(auc), 5) AS auc, round(avg(CAST(f AS DOUBLE)) FILTER (h), 6) AS detected, round(avg(CAST(f AS DOUBLE)) FILTER (b), 6) AS benign_flagged, round(avg(CAST(f AS DOUBLE)) FILTER (NOT h AND NOT b), 6) AS known_flagged,
  round(avg(CAST(h AS DOUBLE)) FILTER (f), 6) AS precision, count(*) FILTER (f) AS flagged FROM sc JOIN ra USING (gated) GROUP BY 1""")
def novelty_evaluation(spark, d):
    """Label 3 held out of the mixture: AUC and flag rates by likelihood, with and without the gate of benign clusters."""
    e = embeddings(spark, d)
    known = e.where(F.col("label") != _HOLD)
    scored = mixture.posteriors(e, "embedding", mixture.label_mixture(known, "embedding", "label"))
    marked = scored.select("label", "log_likelihood", (F.col("label") == _HOLD).alias("held_out"), (F.col("label") % 4 == 0).alias("benign"), (F.col("cluster") % 4 == 0).alias("gate"))
    out = phases.novelty_report(marked, marked.where("not held_out"))
    return out.select("gated", near("auc", 5).alias("auc"), *[near(c).alias(c) for c in ("detected", "benign_flagged", "known_flagged", "precision")], "flagged")


@query("WITH " + ", ".join((_E, *_P, *_J)) + " SELECT vec_id, log_likelihood < (SELECT quantile_cont(log_likelihood, 0.05) FROM ll WHERE vec_id % 2 = 0) AS novel FROM ll")
def percentile_novelty(spark, d):
    return mixture.percentile_novelty(scored_embeddings(spark, d).select("vec_id", "log_likelihood"), F.col("vec_id") % 2 == 0).select("vec_id", "novel")


_WAY = [math.sin(i + 1.0) for i in range(64)]
_WAY = [x / math.sqrt(sum(y * y for y in _WAY)) for x in _WAY]
_DRIFT = (_E, *_P, "rw AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings)", "sd AS (SELECT i, stddev_pop(x) AS s FROM em GROUP BY 1)", "wy AS (SELECT unnest(generate_series(1, 64)) AS i, unnest([" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in _WAY) + "]) AS w)",
  "dr AS (SELECT vec_id, pos, n, em.label, i, CASE WHEN pos < n * 6 // 10 THEN x ELSE (x + w * s * 3 * (pos - n * 6 // 10) / (n - n * 6 // 10)) * (1 + (pos - n * 6 // 10) / (n - n * 6 // 10) * 0.3::DOUBLE) END AS x FROM em JOIN rw USING (vec_id) JOIN sd USING (i) JOIN wy USING (i))",
  *joint_sql("dr"), "lv AS (SELECT CAST(pos // 50 AS BIGINT) AS batch, avg(log_likelihood) AS level FROM ll JOIN rw USING (vec_id) WHERE pos < n // 50 * 50 GROUP BY 1)", "fd AS (SELECT any_value(n) * 6 // 10 // 50 AS first FROM rw)",
  "ct AS (SELECT avg(level) - 2 * CASE WHEN count(*) > 1 THEN stddev_pop(level) ELSE abs(avg(level)) * 0.1 END AS threshold FROM lv, fd WHERE batch < first)", "fg AS (SELECT batch, batch >= first AS d, level < threshold AS low, threshold, first FROM lv, ct, fd)")


def _drifted(spark, d):
    """Batches of fifty vectors; the last two fifths drift further and further in a fixed direction."""
    e = timeline.positions(embeddings(spark, d), ["vec_id"])
    n = e.agg(F.count(F.lit(1)).alias("n"))
    spread = profiles.moments(e.select(F.lit(0).alias("g"), *[F.col("embedding")[i].alias(f"x{i}") for i in range(64)]), "g", [f"x{i}" for i in range(64)])
    std = spread.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct(F.substring("feature", 2, 9).cast("int").alias("i"), F.sqrt("var").alias("s")))), lambda x: x["s"]).alias("std"))
    cut = F.floor(F.col("n") * 6 / 10)
    progress = F.when(F.col("pos") < cut, 0.0).otherwise((F.col("pos") - cut) / (F.col("n") - cut))
    placed = e.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(std)).withColumn("progress", progress)  # one row each
    return placed.withColumn("embedding", flow_stream.injected_drift(F.col("embedding"), _WAY, F.col("std"), F.col("progress")))


@query("WITH " + ", ".join(_DRIFT) + """ SELECT round(any_value(threshold), 3) AS threshold, CAST(coalesce(min(batch) FILTER (d AND low), -1) AS BIGINT) AS detected, CAST(coalesce(min(batch) FILTER (d AND low) - any_value(first), -1) AS BIGINT) AS latency,
  round(CASE WHEN count(*) FILTER (low) > 0 THEN count(*) FILTER (d AND low) / count(*) FILTER (low) ELSE 0 END, 6) AS precision, round(count(*) FILTER (d AND low) / count(*) FILTER (d), 6) AS recall,
  round(2 * count(*) FILTER (d AND low) / (2 * count(*) FILTER (d AND low) + count(*) FILTER (NOT d AND low) + count(*) FILTER (d AND NOT low)), 6) AS f1 FROM fg""")
def drift_evaluation(spark, d):
    """Injected drift: does the mean likelihood of batches fall under the threshold of the undisturbed ones?"""
    e = embeddings(spark, d)
    scored = mixture.posteriors(_drifted(spark, d).select("pos", "n", "embedding"), "embedding", mixture.label_mixture(e, "embedding", "label"))
    whole = scored.where(F.col("pos") < F.floor(F.col("n") / 50) * 50)
    levels = whole.groupBy(F.floor(F.col("pos") / 50).alias("batch")).agg(F.avg("log_likelihood").alias("level"))
    first = e.count() * 6 // 10 // 50
    out = phases.drift_report(levels, first)
    return out.select(near("threshold", 3).alias("threshold"), "detected", "latency", near("precision").alias("precision"), near("recall").alias("recall"), near("f1").alias("f1"))


@query()
def three_phases(spark, d):
    """A static and an online model over three phases of two batches; the middle phase drifts, the last one stays drifted."""
    e = timeline.chunk(embeddings(spark, d).withColumn("name", F.concat(F.lit("t"), (F.col("label") % 3).cast("string"))), 6, ["vec_id"])
    shift = F.array_repeat(F.lit(0.4), 64)
    moved = F.when(F.col("chunk") < 2, F.lit(0.0)).when(F.col("chunk") < 4, (F.col("chunk") - 1) / 2.0).otherwise(F.lit(1.0))
    e = e.withColumn("embedding", F.zip_with("embedding", shift, lambda x, s: x.cast("double") + s * moved))
    shared_folder(spark)
    e = e.select("chunk", "embedding", "label", "name").checkpoint()  # every batch reads it
    params = mixture.label_mixture(e.where("chunk < 2"), "embedding", "label")
    names = e.select(F.col("label").alias("k"), "name").distinct()
    batches = [(("Stable", "Drift", "Recovery")[k // 2], e.where(F.col("chunk") == k)) for k in range(6)]
    return rounded(phases.compare_phases(spark, batches, "embedding", "name", params, names), 4)


_SRC = "ev AS (SELECT user_id % 20 AS src, epoch_us(ts) // 1000 AS ts_ms, value, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, value) - 1 AS k FROM events)"


@query("WITH " + _SRC + " SELECT src, CAST(k // 10 AS BIGINT) AS window_id, CAST(count(*) AS BIGINT) AS n_flows, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts, round(sum(value), 3) AS sum_value FROM ev GROUP BY 1, 2 HAVING count(*) = 10")
def streamed_windows(spark, d):
    """Full windows of ten events per source by a restartable stream, over files of events in order of time."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")  # events of one millisecond have an order too
    ev = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 20).alias("src"), us.alias("ts_us"), "value")
    files = ev.count() // (5 * FILE_ROWS) + 1
    for k, cut in enumerate(timeline_cuts(ev, 5, "ts_us")):
        ev.where((F.col("ts_us") >= cut[0]) & (F.col("ts_us") < cut[1])).repartition(files).write.parquet(f"{base}/in/{k}")
    stream = spark.readStream.schema("src long, ts_us long, value double").option("maxFilesPerTrigger", files).parquet(f"{base}/in/*")
    step = model_stream.WindowStream(spark, base, 10, "ts_us")
    model_stream.run(stream, step, f"{base}/checkpoint")
    ms = {c: F.floor(F.col(c) / 1000).cast("long") for c in ("first_ts", "last_ts")}
    return rounded(step.windows().withColumns(ms), 3)


#: Rows of a file that a stream reads.
FILE_ROWS = 1_000_000


def timeline_cuts(df, parts: int, time: str = "ts_ms") -> list[tuple[int, int]]:
    """Ranges of time that cut the rows into about equal parts."""
    at = df.approxQuantile(time, [k / parts for k in range(1, parts)], 0.01)
    ends = [-(1 << 62), *[int(x) for x in at], 1 << 62]
    return list(zip(ends, ends[1:]))


@query("""WITH b AS (SELECT CAST(event_id // 500 AS BIGINT) AS batch, avg(value) AS level, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1), p AS (SELECT batch * 3 // (SELECT max(batch) + 1 FROM b) AS ph, * FROM b)
  SELECT CASE ph WHEN 0 THEN 'Stable' WHEN 1 THEN 'Drift' ELSE 'Recovery' END AS phase, count(*) AS batches, CAST(sum(n) AS BIGINT) AS n, round(avg(level), 5) AS level FROM p GROUP BY 1""")
def phase_levels(spark, d):
    """Batch levels summarised over three phases of equally many batches."""
    b = spark.read.parquet(f"{d}/events.parquet").groupBy(F.floor(F.col("event_id") / 500).alias("batch")).agg(F.avg("value").alias("level"), F.count(F.lit(1)).alias("n"))
    most = b.agg((F.max("batch") + 1).alias("_m"))
    part = F.floor(F.col("batch") * 3 / F.col("_m"))
    named = b.crossJoin(F.broadcast(most)).withColumn("phase", F.when(part == 0, "Stable").when(part == 1, "Drift").otherwise("Recovery"))  # one row
    return rounded(named.groupBy("phase").agg(F.count(F.lit(1)).alias("batches"), F.sum("n").alias("n"), F.avg("level").alias("level")), 5)


@query("WITH " + ", ".join((_E, *_P, "bf AS (SELECT label AS k, i, avg(x) AS m FROM em WHERE vec_id % 2 = 0 GROUP BY 1, 2)", "af AS (SELECT label AS k, i, avg(x) AS m FROM em WHERE vec_id % 2 = 1 GROUP BY 1, 2)", "w0 AS (SELECT label AS k, count(*) / sum(count(*)) OVER () AS w FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1)",
  "w1 AS (SELECT label AS k, count(*) / sum(count(*)) OVER () AS w FROM embeddings WHERE vec_id % 2 = 1 GROUP BY 1)", "sh AS (SELECT k, sqrt(sum((bf.m - af.m) * (bf.m - af.m))) AS s FROM bf JOIN af USING (k, i) GROUP BY 1)"))
  + " SELECT round(sqrt(sum((w0.w - w1.w) * (w0.w - w1.w))), 6) AS weight_shift, round(avg(s), 5) AS mean_shift, sqrt(sum((w0.w - w1.w) * (w0.w - w1.w))) > 0.15 OR avg(s) > 0.15 AS drift FROM sh JOIN w0 USING (k) JOIN w1 USING (k)")
def model_drift(spark, d):
    """How far the mixture of one half of the vectors lies from that of the other."""
    e = embeddings(spark, d)
    half = lambda k: mixture.label_mixture(e.where(F.col("vec_id") % 2 == k), "embedding", "label")
    return mixture.drift(half(0), half(1)).select(near("weight_shift").alias("weight_shift"), near("mean_shift", 5).alias("mean_shift"), "drift")


@query("WITH " + ", ".join((_E, "kb AS (SELECT DISTINCT CAST(label AS INTEGER) AS cluster, CASE WHEN label % 2 = 0 THEN 'a' ELSE 'b' END AS b FROM embeddings WHERE label <> 7)", "h AS (SELECT label, i, avg(x) FILTER (vec_id % 2 = 0) AS a, avg(x) FILTER (vec_id % 2 = 1) AS b FROM em GROUP BY 1, 2)",
  "s AS (SELECT label, stddev_pop(x) AS std, count(DISTINCT vec_id) FILTER (vec_id % 2 = 1) AS n FROM em GROUP BY 1)", "lg AS (SELECT CAST(label AS INTEGER) AS cluster, CASE WHEN any_value(label) = 7 THEN CASE WHEN any_value(n) > 10 THEN 'new' END WHEN sqrt(sum((a - b) * (a - b))) / any_value(std) > 0.5 THEN 'rescore' END AS action FROM h JOIN s USING (label) GROUP BY label)"))
  + " SELECT coalesce(kb.cluster, lg.cluster) AS cluster, CASE WHEN action IS NOT NULL THEN 'now' || coalesce(lg.cluster, 0) ELSE kb.b END AS primary_behaviour, action IS NOT NULL AS updated FROM kb FULL JOIN (SELECT * FROM lg WHERE action IS NOT NULL) lg USING (cluster)")
def kb_after_updates(spark, d):
    """A knowledge base after a batch: moved clusters are labelled anew, an unseen one (7) is added."""
    e = embeddings(spark, d).select(F.col("label").alias("cluster"), "vec_id", "embedding")
    std = e.select("cluster", F.explode("embedding").alias("x")).groupBy("cluster").agg(F.stddev_pop("x").alias("std"))
    half = lambda k: mixture.label_mixture(e.where(F.col("vec_id") % 2 == k), "embedding", "cluster").select(F.col("k").alias("cluster"), "mean")
    sizes = e.where("vec_id % 2 = 1").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    updates = fusion.kb_updates(half(0).where("cluster <> 7").join(std, "cluster"), half(1).join(sizes, "cluster"), least=10)
    kb = e.select("cluster").distinct().where("cluster <> 7").select("cluster", F.when(F.col("cluster") % 2 == 0, "a").otherwise("b").alias("primary_behaviour"), F.lit("t").alias("primary_tactic"))
    rescored = e.select("cluster").distinct().select("cluster", F.concat(F.lit("now"), F.col("cluster").cast("string")).alias("primary_behaviour"), F.lit("t").alias("primary_tactic"))
    return fusion.kb_after(kb, updates, rescored)[0].select(F.col("cluster").cast("int").alias("cluster"), "primary_behaviour", "updated")


# ---- baselines --------------------------------------------------------------------------------------------------------


@query("WITH " + ", ".join((_E, "ce AS (SELECT label, i, avg(x) AS m FROM em GROUP BY 1, 2)", "ia AS (SELECT label, avg(s) AS within FROM (SELECT label, vec_id, sqrt(sum((x - m) * (x - m))) AS s FROM em JOIN ce USING (label, i) GROUP BY 1, 2) GROUP BY 1)",
  "ie AS (SELECT label, min(s) AS nearest FROM (SELECT a.label, b.label AS o, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS s FROM ce a JOIN ce b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2) GROUP BY 1)")) + " SELECT label, round(within, 5) AS within, round(nearest, 5) AS nearest, round(within / nearest, 5) AS ratio FROM ia JOIN ie USING (label)")
def cluster_spread(spark, d):
    """Mean distance to the own centre against the distance to the nearest other centre."""
    return rounded(profiles.spread(embeddings(spark, d), "label", "embedding"), 5)


@query("""WITH a AS (SELECT event_id, least(greatest(value / 50 - 0.2::DOUBLE, 0), 1) AS x, least(greatest(CAST(user_id % 5 AS DOUBLE) / 4, 0), 1) AS y FROM events)
  SELECT event_id, round(CASE WHEN x + y > 0 THEN x / (x + y) ELSE 0 END, 5) AS syn_flooding, round(CASE WHEN x + y > 0 THEN y / (x + y) ELSE 0 END, 5) AS port_scanning, round(CASE WHEN x + y > 0 THEN 0 ELSE 1 END, 5) AS normal_activity FROM a""")
def parsed_answers(spark, d):
    """Behaviour scores of JSON answers in fences: clamped, renamed, normalised, benign where nothing is named."""
    ev = spark.read.parquet(f"{d}/events.parquet")
    body = F.to_json(F.struct(F.create_map(F.lit("syn_flooding"), F.col("value") / 50 - 0.2, F.lit("scan"), (F.col("user_id") % 5) / 4).alias("behaviours")))
    answer = F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```"))
    parsed = ev.select("event_id", S.parsed_answer(answer, {"scan": "port_scanning"}, ["syn_flooding", "port_scanning", "normal_activity"]).alias("s"))
    score = lambda name: near(F.coalesce(F.try_element_at(F.map_from_entries("s"), F.lit(name)), F.lit(0.0)), 5).alias(name)
    return parsed.select("event_id", score("syn_flooding"), score("port_scanning"), score("normal_activity"))


@query(_ORACLES["knowledge_base"])
def kb_json_round_trip(spark, d):
    """The knowledge base through its JSON sink and source."""
    base = f"{shared_folder(spark)}/kb-{uuid.uuid4().hex}"
    behaviours, tactics = rule_tactics(spark, d)
    write_kb(fusion.build_kb(behaviours, tactics, cluster_features(spark, d).select("cluster", "size")), base)
    return rounded(read_kb(spark, base).select("cluster", "cluster_size", "cluster_proportion", "primary_tactic"))


@query("WITH " + ", ".join((_E, *_P)) + " SELECT CAST(k AS INTEGER) AS k, round(w, 6) AS weight, 64 AS dimensions FROM mw")
def model_round_trip(spark, d):
    """A mixture through the model sink and source."""
    base = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    save_model({"mixture": mixture.label_mixture(embeddings(spark, d), "embedding", "label")}, {"vector": "embedding"}, base)
    parts, config = load_model(spark, base, ["mixture"])
    return rounded(parts["mixture"].select("k", "weight", F.size("mean").alias("dimensions")).where(F.lit(config["vector"] == "embedding")))


@query()
def clustering_grid(spark, d):
    """K-means and Gaussian mixtures of several sizes: purity, majority accuracy, mutual information, silhouette."""
    return rounded(baselines.clustering_grid(embeddings(spark, d), "embedding", "label", [("kmeans", 5), ("kmeans", 10), ("gmm", 5)], "vec_id"), 4)


@query()
def supervised_baselines(spark, d):
    """Accuracy and F1 of a random forest and a perceptron on vectors whose id is divisible by four."""
    e = embeddings(spark, d)
    train, test = e.where("vec_id % 4 <> 0"), e.where("vec_id % 4 = 0")
    out = None
    for method in ("forest", "perceptron"):
        found = baselines.supervised(train, test, "embedding", "label", method)
        row = metrics.summary(metrics.confusion(found, "label", "prediction")).select(F.lit(method).alias("method"), "*")
        out = row if out is None else out.unionByName(row)
    return rounded(out, 4)
