import math
import random

import numpy as np
import pytest

from flowloom.functions import scalar
from flowloom.operators import explain, graph, metrics, profiles, windows
from flowloom.streaming import flow_stream, phases


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.9, 1.0])
def test_quantiles_equal_sorted_values(spark, q):
    r = random.Random(5)
    rows = [(k % 3 if k % 11 else None, r.choice([0.0, -1.5, 7.0, r.uniform(-1e6, 1e6), r.gauss(0, 1)]), None if k % 5 == 0 else r.random() * 1e-3) for k in range(400)]
    found = {(x.g, x.feature): x.value for x in profiles.quantiles(spark.createDataFrame(rows, "g int, a double, b double"), "g", ["a", "b"], q).collect()}
    for g in range(3):
        for i, c in enumerate("ab", 1):
            values = [x[i] for x in rows if x[0] == g and x[i] is not None]
            assert found[g, c] == pytest.approx(np.quantile(values, q), abs=1e-12)
    assert len(found) == 6


def flows(n=300, sources=4, seed=2):
    r = random.Random(seed)
    return [(p, r.choice([0] * 3 + list(range(sources))), r.randint(0, 6), float(r.randint(1, 9))) for p in range(n)]


def test_causal_windows_cross_runs(spark, monkeypatch):
    monkeypatch.setattr(windows, "RUN", 7)
    rows = flows()
    df = spark.createDataFrame(rows, "pos long, src int, dst int, in_bytes double")
    seen: dict = {}
    want_seq, want_count = {}, {}
    for pos, src, dst, size in rows:
        past = seen.setdefault(src, [])
        want_count[pos] = (len(past), sum(x[2] for x in past), len({x[1] for x in past}))
        past.append((pos, dst, size))
        want_seq[pos] = [x[0] for x in past[-4:]]
    got = {r.pos: r for r in windows.causal_sequences(df, ["in_bytes"], length=4).collect()}
    assert {p: list(r.covered) for p, r in got.items()} == want_seq
    assert all(len(r.seq) == len(r["mask"]) == 4 and sum(r["mask"]) == len(want_seq[p]) for p, r in got.items())
    counts = graph.causal_counters(df, run=7).collect()
    assert {r.pos: (r.past_flows, r.past_bytes, r.past_fan_out) for r in counts} == want_count


def test_alarms_cross_runs(spark, monkeypatch):
    monkeypatch.setattr(flow_stream, "RUN", 3)
    r = random.Random(1)
    levels = [(b, 100.0 + r.gauss(0, 1) - 30 * (b % 9 == 8)) for b in range(40)]
    got = {x.batch: x.alarm for x in flow_stream.likelihood_alarms(spark.createDataFrame(levels, "batch long, level double")).collect()}
    for b, level in levels:
        past = [x for _, x in levels[:b]]
        low = len(past) >= 2 and level < np.mean(past) - 2 * max(np.std(past), abs(np.mean(past)) * 0.05)
        assert got[b] == low, b


def test_phases_equal_plain_updates(spark):
    r = np.random.default_rng(0)
    centres = np.array([[0.0, 0.0], [5.0, 5.0]])
    params = [(k, 0.5, c.tolist(), [1.0, 1.0]) for k, c in enumerate(centres)]
    weight, mean, var = np.full(2, 0.5), centres.copy(), np.ones((2, 2))
    batches, want = [], {}
    for b, phase in enumerate(["Stable", "Drift", "Drift"]):
        label = r.integers(0, 2, 40)
        x = centres[label] + r.standard_normal((40, 2)) + 1.5 * b
        batches.append((phase, spark.createDataFrame([(row.tolist(), f"t{k}") for row, k in zip(x, label)], "v array<double>, name string")))

        def joint(w, m, s):
            return np.log(w) - 0.5 * (np.log(2 * np.pi * s).sum(1) + ((x[:, None] - m) ** 2 / s).sum(2))

        for system, j in (("static", joint(np.full(2, 0.5), centres, np.ones((2, 2)))), ("online", joint(weight, mean, var))):
            want.setdefault((phase, system), []).append((label, j.argmax(1), np.logaddexp.reduce(j, axis=1)))
        g = np.exp(j - np.logaddexp.reduce(j, axis=1)[:, None])
        n = g.sum(0)
        mean = 0.7 * mean + 0.3 * (g.T @ x) / n[:, None]
        spread = (g.T @ (x * x)) / n[:, None] - 2 * mean * (g.T @ x) / n[:, None] + mean**2
        var = np.maximum(0.7 * var + 0.3 * spread, 1e-6)
        weight = 0.7 * weight + 0.3 * n / n.sum()
        weight /= weight.sum()
    table = spark.createDataFrame(params, "k int, weight double, mean array<double>, var array<double>")
    names = spark.createDataFrame([(0, "t0"), (1, "t1")], "k int, name string")
    got = {(x.phase, x.system): x for x in phases.compare_phases(spark, batches, "v", "name", table, names).collect()}
    for key, parts in want.items():
        true, pred, level = (np.concatenate(c) for c in zip(*parts))
        assert got[key].n == len(true) and got[key].accuracy == pytest.approx((true == pred).mean()) and got[key].level == pytest.approx(level.mean())


def test_novelty_gate_ranks_gated_rows_last(spark):
    rows = [(-10.0, True, False, False), (-9.0, True, False, True), (-1.0, False, True, True), (-2.0, False, False, False), (-8.0, False, True, True), (-0.5, False, False, False)]
    df = spark.createDataFrame(rows, "log_likelihood double, held_out boolean, benign boolean, gate boolean")
    training = spark.createDataFrame([(-x / 10.0,) for x in range(51)], "log_likelihood double")
    plain, gated = sorted(phases.novelty_report(df, training).collect(), key=lambda r: r.gated)
    assert plain.auc == 1.0 and plain.flagged == 3 and plain.detected == 1.0 and plain.benign_flagged == 0.5 and plain.precision == pytest.approx(2 / 3)
    assert gated.auc == pytest.approx((4 + 1) / 8) and gated.flagged == 1 and gated.detected == 0.5 and gated.benign_flagged == 0.0 and gated.precision == 1.0


def test_drift_report_without_alarm(spark):
    levels = spark.createDataFrame([(b, 1.0 + 0.01 * (b % 2)) for b in range(8)], "batch long, level double")
    row = phases.drift_report(levels, 4).first()
    assert (row.detected, row.latency, row.precision, row.recall, row.f1) == (-1, -1, 0.0, 0.0, 0.0)


def test_given_labels_unscaling_and_sets(spark):
    counts = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "b", 2)], "true_label string, pred_label string, n long")
    got = {r.label: (r.support, round(r.f1, 6)) for r in metrics.prf(counts, ["a", "c"]).collect()}
    assert got == {"a": (4, round(6 / 7, 6)), "c": (0, 0.0)}
    row = spark.createDataFrame([(1.0, 2.0, 0.5)], "z double, m double, s double")
    out = row.select(scalar.unscaled(row.z, row.m, row.s).alias("a"), scalar.unscaled(row.z, row.m, row.s, logged=True).alias("b"), scalar.unscaled(row.z, row.m * 0, row.s * 0 + 0.0).alias("c")).first()
    assert out.a == 2.5 and out.b == pytest.approx(math.expm1(2.5)) and out.c == 1.0
    with pytest.raises(ValueError, match="missing columns"):
        scalar.scaled(row, ["absent"], row)


def test_alignment_ignores_unknown_features(spark):
    df = spark.createDataFrame([("Impact", 3.0, 5.0), ("Impact", 3.0, None), ("Impact", 9.0, 5.0), ("Discovery", 0.0, 0.0), ("None", 1.0, 1.0)], "tactic string, tcp_flags double, out_bytes double")
    got = [(r.tactic, r.tcp_flags, r.aligned) for r in explain.alignment(df, "tactic", explain.EXPECTED["bot_iot"]).collect()]
    assert got == [("Impact", 3.0, True), ("Impact", 3.0, True), ("Impact", 9.0, False), ("None", 1.0, True)]
