import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import scalar
from flowloom.operators import fusion, graph, metrics, mixture, profiles, rules, timeline, variational, windows
from flowloom.plans import catalogue
from flowloom.sources import flows as source
from flowloom.streaming import flow_stream


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def table(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_split_rounds_half_to_even_and_keeps_tiny_classes(spark):
    values = [(f"c{n}", i, i) for n in (1, 2, 3, 7, 10, 20, 100) for i in range(n)]
    out = timeline.chronological_split(table(spark, values, "label string, ts long, id long"), "label", ["ts", "id"])
    got = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    for n in (1, 2, 3, 7, 10, 20, 100):
        test, gap = round(n * 0.15), round(n * 0.05)
        if test == 0:
            test = gap = 0
        assert got.get((f"c{n}", "test"), 0) == test and got.get((f"c{n}", "gap"), 0) == gap
        last = out.where((F.col("label") == f"c{n}") & (F.col("split") == "test")).agg(F.min("ts")).first()[0]
        assert last is None or last == n - test


def test_cross_duplicates_leave_copies_within_test(spark):
    train = table(spark, [(1.0, None), (2.00000001, 5.0)], "a double, b double")
    test = table(spark, [(1.0, None), (2.0, 5.0), (3.0, 1.0), (3.0, 1.0)], "a double, b double")
    assert rows(timeline.without_cross_duplicates(test, train, ["a", "b"]), "a", "b") == [(3.0, 1.0), (3.0, 1.0)]


@pytest.mark.parametrize("k", [1, 3, 10, 12])
def test_stride_and_oversampling(spark, k):
    df = table(spark, [("x", i * 90_000_000, i) for i in range(10)], "label string, ts long, id long")
    out = timeline.strided(df, "label", ["ts", "id"], table(spark, [("x", 10, k)], "label string, n long, target long"))
    ids = sorted(r.id for r in out.where("copy_no = 0").collect())
    want = [int(i * 9 / (k - 1)) for i in range(k)] if 1 < k <= 10 else [0] if k == 1 else list(range(10))
    assert ids == want and out.count() == k


def test_copies_are_not_broadcast_and_are_drawn_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(timeline, "DRAWN", 7)
    df = table(spark, [("x", i, i) for i in range(10)] + [("y", i, i) for i in range(40)] + [("z", 0, 0)], "label string, ts long, id long")
    out = timeline.strided(df, "label", ["ts", "id"], table(spark, [("x", 10, 60), ("y", 40, 40), ("z", 1, 15)], "label string, n long, target long"))
    copies = sorted((r.label, r.copy_no, r.id) for r in out.where("copy_no > 0").collect())
    want = [(c, k, n) for c, n, m in (("x", 10, 50), ("z", 1, 14)) for k, n in [(r.k, r.p) for r in spark.range(1, m + 1).selectExpr("id AS k", f"pmod(xxhash64(42, '{c}', cast(id as long)), {n}L) AS p").collect()]]
    assert copies == sorted(want) and out.where("copy_no = 0").count() == 51
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_classes_are_not_shuffled_for_their_ranks(spark):
    df = table(spark, [(f"c{i % 3}", i) for i in range(50)], "label string, ts long")
    ranked = timeline.class_rank(df, "label", ["ts"])
    assert sorted((r.label, r._rank, r.ts) for r in ranked.collect()) == sorted((f"c{i % 3}", i // 3 + 1, i) for i in range(50))
    assert "SortMergeJoin" not in ranked._jdf.queryExecution().sparkPlan().toString()


def test_samples_rank_only_the_last_range_of_hashes(spark):
    df = table(spark, [(f"c{i % 3}" if i % 7 else None, i) for i in range(2000)] + [("one", i) for i in range(3)], "label string, id long")
    got = source.stratified_sample(df, "label", 400, 5, ["id"])
    hashes = {(r.label, r.id): r.h for r in df.where("label is not null").selectExpr("label", "id", "xxhash64(5, id) AS h").collect()}
    want = [k for c in ("c0", "c1", "c2", "one") for k in sorted((k for k in hashes if k[0] == c), key=lambda k: (hashes[k], k[1]))[:100]]
    assert sorted((r.label, r.id) for r in got.collect()) == sorted(want) and got.columns == df.columns
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"row_number\(\) windowspecdefinition\(label#\d+, (\S+?)#", plan) == ["_range"]


def test_fans_meet_flows_once_and_cluster_features_are_written(spark):
    edges = table(spark, [(i % 3, i % 7, i) for i in range(50)] + [(None, 1, 50), (1, None, 51)], "src long, dst long, id long")
    out = graph.flow_fan(edges)
    assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    got = {r.id: (r.fan_out, r.fan_in, r.n_peers) for r in out.collect()}
    assert got[0] == (7, 3, 10) and got[1] == (8, 4, 12) and got[50] == (None, 4, None) and got[51] == (8, None, None)
    features = catalogue.cluster_features(spark, "/root/testdata/sf0.001")
    assert "Join" not in features._jdf.queryExecution().optimizedPlan().toString()


def test_an_answer_is_parsed_once(spark):
    df = table(spark, [('```json\n{"behaviours": {"a": 2, "b": 0.5, "old": 0.5}}\n```',), ("junk",), (None,)], "t string")
    out = df.select(scalar.parsed_answer(F.col("t"), {"old": "b"}, ["a", "b", "normal_activity"]).alias("s"))
    benign = [("normal_activity", 1.0)]
    assert [[tuple(x) for x in r.s] for r in out.collect()] == [[("a", 0.5), ("b", 0.5)], benign, benign]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_positions_are_dense_in_order(spark):
    values = [(t, i) for i, t in enumerate([5, 5, 90_000_000, 3, 300_000_000, 90_000_001])]
    got = sorted((r.pos, r.ts, r.id) for r in timeline.positions(table(spark, values, "ts long, id long"), ["ts", "id"]).collect())
    assert [(t, i) for _, t, i in got] == sorted(values) and [p for p, *_ in got] == list(range(6))


def test_ports_protocols_and_l7(spark):
    df = table(spark, [(p,) for p in (-1, 0, 1023, 1024, 49151, 49152, 65535, 70000)], "p int").select("p", scalar.port_bucket(F.col("p")).alias("b"))
    assert [r.b[0] for r in df.collect()] == list("WWWRREEE")
    out = table(spark, [(7.0,), (7.178,), (None,), (9.0,)], "x double").select(*scalar.l7_one_hot(F.col("x"), [7.0, 7.178]))
    assert out.columns == ["L7_7", "L7_7.178", "L7_OTHER"] and [tuple(r) for r in out.collect()] == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 1)]


def test_ratio_guards(spark):
    df = table(spark, [(0.0, 0.0), (5.0, 0.0), (1e9, 1.0), (1.0, 2.0)], "o double, i double").select(scalar.direction_ratio(F.col("o"), F.col("i")).alias("r"))
    assert [r.r for r in df.collect()] == [1.0, 999.0, 999.0, 0.5]
    out = table(spark, [(3.0, 0.0), (0.0, 5.0)], "n double, ms double").select(scalar.packets_per_second(F.col("n"), F.col("ms")).alias("r"), scalar.bytes_per_packet(F.lit(9.0), F.col("n")).alias("b"))
    assert [tuple(r) for r in out.collect()] == [(30000.0, 3.0), (0.0, 0.0)]


def test_answers_are_parsed_or_replaced(spark):
    texts = ['```json\n{"behaviours": {"scan": 0.5, "flood": 2, "odd": 1}}\n```', "no json", None, '{"behaviours": {}}']
    got = table(spark, [(t,) for t in texts], "t string").select(scalar.parsed_answer(F.col("t"), {"flooding": "flood"}, ["scan", "flood"]).alias("x")).collect()
    assert {s.label: round(s.score, 6) for s in got[0].x} == {"scan": round(0.5 / 1.5, 6), "flood": round(1 / 1.5, 6)}
    assert all([(s.label, s.score) for s in r.x] == [("normal_activity", 1.0)] for r in got[1:])


def test_graph_edges(spark):
    e = table(spark, [(1, 2, 80, 6, 1.0, 1.0), (1, 2, 80, 6, 1.0, 1.0), (1, 3, 81, 17, 2.0, 1.0), (4, 4, 1, 6, 1.0, 1.0)], "src long, dst long, dst_port int, protocol int, in_bytes double, in_pkts double")
    assert rows(graph.nodes(e), "ip") == [(1,), (2,), (3,), (4,)]
    assert rows(graph.flow_fan(e).where("src = 1"), "fan_out", "fan_in", "n_peers") == [(2, 1, 3)] * 3
    feats = table(spark, [(1, 10.0), (2, 20.0), (3, 0.0), (4, 4.0), (9, 1.0)], "ip long, x double")
    mean = dict(rows(graph.aggregate_neighbours(e, feats, ["x"]), "ip", "x"))
    assert mean == {1: 0.0, 2: 10.0, 3: 10.0, 4: 4.0, 9: 0.0}
    emb = table(spark, [(1, [1.0, 2.0])], "ip long, h array<double>")
    got = graph.flow_context(e, emb, 2).where("dst = 3").first()
    assert got.context == [1.0, 2.0, 0.0, 0.0] and got.unseen == 1


def test_causal_sequences_pad_in_front(spark):
    df = table(spark, [(1, p, float(p)) for p in range(15)] + [(2, 100, 7.0)], "src long, pos long, x double")
    got = {r.pos: r for r in windows.causal_sequences(df, ["x"], 10).collect()}
    assert [v[0] for v in got[14].seq] == [float(p) for p in range(5, 15)]
    assert got[100].mask == [0] * 9 + [1] and got[100].seq[-1] == [7.0] and got[100].seq[0] == [0.0]


def test_count_windows_keep_or_drop_the_tail(spark):
    df = table(spark, [(s, i * 50_000_000, i) for s, n in ((1, 49), (2, 50), (3, 51), (4, 101)) for i in range(n)], "src long, ts long, id long")
    tail = windows.count_windows(df, 50, ["ts", "id"]).groupBy("src", "window_id").count()
    assert rows(tail, "src", "window_id", "count") == [(1, 0, 49), (2, 0, 50), (3, 0, 50), (3, 1, 1), (4, 0, 50), (4, 1, 50), (4, 2, 1)]
    full = windows.count_windows(df, 50, ["ts", "id"], full_only=True).groupBy("src", "window_id").count()
    assert rows(full, "src", "window_id") == [(2, 0), (3, 0), (4, 0), (4, 1)]


def test_majority_ties_go_to_the_first_seen(spark):
    df = table(spark, [(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3)], "w int, label string, pos int")
    assert rows(windows.majority(df, ["w"], "label"), "majority", "purity") == [("b", 0.5)]


def test_rule_scores_skip_nulls_and_take_the_best_profile(spark):
    table_ = [("a#x", "f", ">", 1.0, None, 2.0), ("a#y", "f", "in", 0.0, 1.0, 1.0), ("a#y", "g", "<", 5.0, None, 3.0), ("n", "g", ">", 5.0, None, 1.0)]
    prof = table(spark, [(1, 1.0, None), (2, 3.0, 9.0)], "cluster int, f double, g double")
    assert rows(rules.rule_scores(prof, "cluster", table_), "cluster", "behaviour", "score") == [(1, "a", 1.0), (1, "n", 0.0), (2, "a", 1.0), (2, "n", 1.0)]


def test_sharpen_and_tactics_sum_to_one(spark):
    scores = table(spark, [(1, "port_scanning", 0.5), (1, "normal_activity", 0.25), (2, "port_scanning", 0.0), (2, "normal_activity", 0.0)], "cluster int, behaviour string, score double")
    sharp = rules.sharpen(scores, "cluster")
    assert rows(sharp, "cluster", "behaviour", "p") == [(1, "normal_activity", 0.2), (1, "port_scanning", 0.8), (2, "normal_activity", 1.0), (2, "port_scanning", 0.0)]
    assert all(abs(t - 1) < 1e-12 for (t,) in rows(rules.to_tactics(sharp, "cluster", rules.tactic_table(spark)).groupBy("cluster").agg(F.sum("p").alias("t")), "t"))


def test_fusion_keeps_rules_where_no_other_label(spark):
    schema = "cluster int, tactic string, p double"
    a, b = table(spark, [(1, "x", 0.85), (1, "y", 0.15), (2, "x", 1.0)], schema), table(spark, [(1, "x", 0.85), (1, "z", 0.15)], schema)
    got = {(c, t): round(p, 9) for c, t, p in rows(fusion.fuse(a, b, "cluster", "tactic"), "cluster", "tactic", "p")}
    assert got == {(1, "x"): 0.85, (1, "y"): 0.105, (1, "z"): 0.045, (2, "x"): 1.0}


def test_auc_with_ties_and_one_class(spark):
    df = table(spark, [(0.1, False), (0.4, False), (0.4, True), (0.8, True), (-3.0, False), (900.0, True)], "s double, y boolean")
    pos, neg = [0.4, 0.8, 900.0], [0.1, 0.4, -3.0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert abs(metrics.roc_auc(df, "s", "y").first().auc - want) < 1e-12
    assert metrics.roc_auc(df.where("y"), "s", "y").first().auc is None


def test_clustering_metrics_on_known_values(spark):
    same = table(spark, [("a", "x"), ("a", "x"), ("b", "y")], "t string, p string")
    assert tuple(metrics.nmi_ari(metrics.confusion(same, "t", "p")).first()) == pytest.approx((1.0, 1.0))
    votes = table(spark, [(1, "a"), (1, "a"), (2, "b"), (2, "b")], "i int, l string")
    assert metrics.fleiss_kappa(votes, "i", "l").first().kappa == pytest.approx(1.0)


def test_fisher_leaves_out_single_rows(spark):
    df = table(spark, [("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", 12.0), ("c", 99.0)], "g string, x double")
    m = np.mean([1, 3, 10, 12, 99])
    assert profiles.fisher_ratio(df, "g", ["x"]).first().fisher == pytest.approx((2 * (2 - m) ** 2 + 2 * (11 - m) ** 2) / (2 + 2))


@pytest.fixture(scope="module")
def two_blobs(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, (120, 2)), r.normal(12, 1, (60, 2))])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def test_mixture_scores_and_novelty(spark, two_blobs):
    params = table(spark, [(0, 0.7, [0.0, 0.0], [1.0, 1.0]), (1, 0.3, [12.0, 12.0], [1.0, 1.0])], mixture.PARAMS)
    extra = two_blobs.unionByName(table(spark, [(999, [50.0, -50.0]), (1000, None)], "id long, v array<double>"))
    got = {r.id: r for r in mixture.novelty(mixture.posteriors(extra, "v", params)).collect()}
    assert got[0].cluster == 0 and got[150].cluster == 1 and got[999].novel and not got[0].novel and got[1000].cluster is None
    assert sum(p.p for p in got[5].post) == pytest.approx(1.0)
    z = np.array(two_blobs.where("id = 3").first().v)
    want = np.log(0.7 * np.exp(-(z @ z) / 2) / (2 * np.pi) + 0.3 * np.exp(-((z - 12) @ (z - 12)) / 2) / (2 * np.pi))
    assert got[3].log_likelihood == pytest.approx(want)


def test_online_step_moves_towards_the_batch(spark, two_blobs):
    params = table(spark, [(0, 0.5, [1.0, 1.0], [2.0, 2.0]), (1, 0.5, [10.0, 10.0], [2.0, 2.0])], mixture.PARAMS)
    after = mixture.online_step(mixture.posteriors(two_blobs, "v", params), "v", params)
    got = {r.k: r for r in after.collect()}
    assert got[0].mean[0] < 1.0 and got[1].mean[0] > 10.0 and got[0].weight + got[1].weight == pytest.approx(1.0)
    assert mixture.drift(params, after).first().drift


def test_dirichlet_mixture_finds_both_groups(spark, two_blobs):
    got = variational.fit_dirichlet_mixture(spark, two_blobs, "v", components=6, rounds=12).orderBy(F.col("weight").desc()).limit(2).collect()
    centres = sorted(r.mean[0] for r in got)
    assert abs(centres[0]) < 1.5 and abs(centres[1] - 12) < 1.5 and sum(r.weight for r in got) > 0.6


def test_alarm_needs_two_batches_and_a_drop(spark):
    levels = table(spark, [(0, -10.0), (1, -10.1), (2, -10.0), (3, -30.0)], "batch long, level double")
    assert [r.alarm for r in flow_stream.likelihood_alarms(levels).orderBy("batch").collect()] == [False, False, False, True]


def test_sources_and_sinks(spark, tmp_path):
    raw = table(spark, [("1.1.1.1", "2.2.2.2", "DDoS", 6), ("1.1.1.1", "3.3.3.3", "Benign", 17), (None, "3.3.3.3", "Benign", 17)], "IPV4_SRC_ADDR string, IPV4_DST_ADDR string, Attack string, PROTOCOL int")
    raw.coalesce(1).write.option("header", True).csv(f"{tmp_path}/csv")
    back = source.read_flow_csv(spark, f"{tmp_path}/csv")
    assert dict(back.dtypes)["PROTOCOL"] == "int" and back.count() == 3
    with pytest.raises(ValueError, match="IN_BYTES"):
        source.check_columns(back, ["IN_BYTES", "Attack"])
    assert source.stratified_sample(back, "Attack", 2, 1, ["IPV4_DST_ADDR"]).count() == 2
    (tmp_path / "c.json").write_text(json.dumps({"numeric_features": ["a"]}))
    assert source.load_feature_config(str(tmp_path / "c.json")) == {"numeric_features": ["a"], "log_features": [], "l7_proto_buckets": []}
    kb = table(spark, [(3, {"x": 0.5}, "x", 7)], "cluster int, behaviour_scores map<string,double>, primary_behaviour string, cluster_size long")
    source.write_kb(kb, f"{tmp_path}/kb")
    got = source.read_kb(spark, f"{tmp_path}/kb").first()
    assert got.cluster == 3 and got.behaviour_scores == {"x": 0.5} and got.p_gmm is None
    source.save_model({"kb": kb}, {"w": 1}, f"{tmp_path}/model")
    parts, config = source.load_model(spark, f"{tmp_path}/model", ["kb"])
    assert parts["kb"].count() == 1 and config == {"w": 1}
    assert rows(source.held_out(raw, "Attack", {"ddos": "DoS"}), "Attack", "in_scope") == [("Benign", False), ("Benign", False), ("DoS", True)]


def test_entry_survives_without_the_training_data_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['flowloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and not any(q.startswith('op') for q in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_unsw_additive_scores(spark):
    names = "g tcp_flags out_bytes in_bytes min_ttl fan_in fan_out pps dir_ratio duration proportion protocol longest_pkt shortest_pkt bpp".split()
    rows = [
        ("scan", 9.8, 164.0, 90.0, 253.0, 4.0, 3.0, 2000.0, 120.0, 10.0, 0.01, 6.0, 80.0, 60.0, 83.0),
        ("benign", 20.0, 900.0, 900.0, 32.0, 10.0, 9.0, 50.0, 8.0, 10.0, 0.5, 6.0, 900.0, 60.0, 150.0),
    ]
    got = {(r.g, r.behaviour): r.score for r in rules.expert_scores(spark.createDataFrame(rows, names), "g", rules.EXPERT_UNSW, rivals=[]).collect()}
    assert len(got) == 2 * 12
    assert got["scan", "port_scanning"] == pytest.approx(0.9)
    assert got["scan", "normal_activity"] == 0.0
    assert got["benign", "normal_activity"] == pytest.approx(0.95)
    assert {s for (g, b), s in got.items() if g == "benign" and b != "normal_activity"} == {0.0}


def test_attack_tables_take_either_spelling(spark):
    df = spark.createDataFrame([("SQL Injection",), ("SQL_Injection",), ("nothing",), (None,)], "attack string")
    got = [(r.attack, r.tactic) for r in rules.attack_tactics(df, rules.attack_table(spark, "cicids")).collect()]
    assert sorted(got, key=str) == sorted([("SQL Injection", "Initial Access"), ("SQL_Injection", "Initial Access"), ("nothing", "Unknown"), (None, "Unknown")], key=str)


def test_cicids_additive_scores(spark):
    names = "g dst_port share_udp tcp_flags duration min_ttl shortest_pkt bpp tcp_win_in iat_avg in_bytes fan_out".split()
    rows = [
        ("bot", 8080.0, 0.0, 219.0, 11.0, 128.0, 40.0, 90.0, 8000.0, 2.0, 500.0, 10.0),
        ("login", 22.0, 0.0, 27.0, 365.0, 0.0, 50.0, 150.0, 30000.0, 20.0, 3000.0, 1.0),
        ("udp", 80.0, 1.0, 0.0, 120000.0, 0.0, 60.0, 60.0, 0.0, 1.0, 7e6, 2.0),
    ]
    got = {(r.g, r.behaviour): r.score for r in rules.expert_scores(spark.createDataFrame(rows, names), "g", rules.EXPERT_CICIDS_V3, rivals=[]).collect()}
    assert got["bot", "periodic_comm"] == pytest.approx(1.0)
    assert got["bot", "connection_attempts"] == pytest.approx(0.15 * 0.2)  # short flows only
    assert got["login", "connection_attempts"] == pytest.approx(1.0)
    assert got["login", "syn_flooding"] == pytest.approx(0.3 * 0.2)
    assert got["udp", "volumetric_flood"] == pytest.approx(1.0)
    assert got["udp", "syn_flooding"] == pytest.approx(0.9 * 0.2)
    assert got["udp", "normal_activity"] == pytest.approx(0.0)


def test_cluster_features_of_lines_without_or_with_two_orders(spark, tmp_path, monkeypatch):
    import duckdb

    joins = []
    monkeypatch.setattr(catalogue, "flow_lines", lambda s, d, duration=False, f=catalogue.flow_lines: joins.append(duration) or f(s, d, duration))
    whole = catalogue.cluster_features(spark, "/root/testdata/sf0.001")
    assert joins and not any(joins) and whole.count() == 20
    line, orders = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("lineitem", "orders"))
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    orders.where("o_orderkey % 3 <> 0").union(orders.where("o_orderkey % 5 = 1")).write.parquet(str(tmp_path / "orders.parquet"))
    got = catalogue.cluster_features(spark, str(tmp_path)).select("cluster", "size", "n_src", "n_dst", "n_pairs", "duration", "in_bytes").collect()
    assert any(joins)
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(catalogue.with_sql(catalogue._CL, *catalogue._PROF) + "SELECT cluster, size, n_src, n_dst, n_pairs, duration, in_bytes FROM pf").fetchall()
    near = lambda rows: sorted(tuple(round(float(x), 4) for x in r) for r in rows)
    assert near(got) == near(want)


def test_counters_shuffle_flows_once_and_cut_long_sources_only(spark):
    df = table(spark, [(p, p % 3 if p % 4 else None, p % 5, float(p)) for p in range(40)] + [(40, 7, None, 1.0), (41, 7, None, 2.0)], "pos long, src long, dst long, in_bytes double")
    out = graph.causal_counters(df, run=9)
    assert "SortMergeJoin" not in re.split(r"\bUnion\b", out._jdf.queryExecution().sparkPlan().toString())[-1]
    assert "min(pos" in out._jdf.queryExecution().optimizedPlan().toString() and len(re.findall(r"Join Left\w*, \(pos", out._jdf.queryExecution().optimizedPlan().toString())) == 0
    got = {r.pos: (r.past_flows, r.past_bytes, r.past_fan_out) for r in out.collect()}
    want, seen = {}, {}
    for p, s, d, b in df.orderBy("pos").collect():
        if s is not None:
            past = seen.setdefault(s, [])
            want[p] = (len(past), sum(x[1] for x in past), len({x[0] for x in past}))
            past.append((d, b))
    assert got == want and got[41] == (1, 1.0, 1)
