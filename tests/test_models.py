"""Fitted models against plain versions: moments, covariances, forest, autoencoder, restarts, streams, ledger, traces, sketches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import autoencoder, covariance, graph, isolation, ledger, metrics, mixture, projection, timeline, trace, variational
from flowloom.plans import catalogue
from flowloom.streaming import model_stream

VECTORS = "id long, v array<double>, label int"


def blobs(n=300, d=5, seed=1):
    r = np.random.default_rng(seed)
    mix = r.standard_normal((3, d, d)) * 0.4 + np.eye(d)
    return [(i, (r.standard_normal(d) @ mix[i % 3] + 4 * (i % 3)).tolist(), i % 3) for i in range(n)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([*blobs(), (1000, None, 1)], VECTORS).repartition(5).cache()


def dense(rows=None):
    rows = rows or blobs()
    return np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def test_positions_and_ranks_when_all_share_a_day(spark):
    """One instant with all rows: as many tasks as asked for, none with much more than its share, ranks by all of the order."""
    rows = [(5, i * 7919 % 4001, i % 3 if i % 50 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "ts long, id long, label long")
    placed = timeline.numbered(df, ["ts", "id"], "pos", tasks=16)
    got = {r.id: r.pos for r in placed.select("id", "pos").collect()}
    assert [got[i] for i in sorted(got)] == list(range(4000))
    sizes = [len(p) for p in timeline.durable(df.repartitionByRange(16, "ts", "id")).rdd.glom().collect()]
    assert max(sizes) < 3 * 4000 / 16
    ranked = {(r.label, r.id): r._rank for r in timeline.class_rank(df, "label", ["ts", "id"], tasks=16).collect()}
    for label in range(3):
        ids = sorted(i for _, i, x in rows if x == label)
        assert [ranked[label, i] for i in ids] == list(range(1, len(ids) + 1))
    assert len(ranked) == sum(x is not None for *_, x in rows)
    assert timeline.numbered(df.where("false"), ["ts", "id"], "pos").count() == 0


def test_moments_and_components(vectors):
    x, _ = dense()
    n, sums, gram = projection.moments(vectors, "v")
    assert n == 300 and np.allclose(sums, x.sum(0)) and np.allclose(gram, x.T @ x)
    share, rows, mean = projection.explained(vectors, "v")
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(share, want / want.sum(), atol=1e-6) and np.allclose(rows @ rows.T, np.eye(5), atol=1e-9)
    got = {r.id: r.projected for r in projection.projected(vectors, "v", rows[:2], mean).collect()}
    assert got[1000] is None and np.allclose([got[i] for i in range(300)], (x - x.mean(0)) @ rows[:2].T)
    assert np.allclose(np.var([got[i] for i in range(300)], axis=0), want[:2])
    assert projection.moments(vectors.where("v is null"), "v")[0] == 0


def test_hopkins(spark, vectors):
    x, _ = dense()
    chosen = sorted(range(300), key=lambda i: ((i * 7919 + 13) % 10007, i))[:30]
    real = sum(min(np.linalg.norm(x[i] - x[j]) for j in range(300) if j != i) for i in chosen)
    row = projection.hopkins(vectors, "id", "v").first()
    assert row.probes == 30 and math.isclose(row.real, real, rel_tol=1e-9) and row.hopkins > 0.6
    even = spark.createDataFrame([(i, np.random.default_rng(i).random(2).tolist()) for i in range(400)], "id long, v array<double>")
    assert 0.35 < projection.hopkins(even, "id", "v").first().hopkins < 0.65
    assert projection.hopkins(vectors.limit(5), "id", "v").first().hopkins is None


@pytest.mark.parametrize("kind", covariance.KINDS)
def test_covariance_kinds_equal_plain_sums(vectors, kind):
    x, labels = dense()
    sums = covariance.scatter(vectors, "v", "label")
    model = covariance.fitted(sums, kind)
    covs = {k: np.cov(x[labels == k].T, bias=True) for k in range(3)}
    pooled = sum(c * (labels == k).sum() for k, c in covs.items()) / 300
    joint = []
    for k in range(3):
        c = {"diag": np.diag(np.diag(covs[k])), "spherical": np.eye(5) * np.diag(covs[k]).mean(), "tied": pooled, "full": 0.9 * covs[k] + 0.1 * np.diag(np.diag(pooled))}[kind] + 1e-6 * np.eye(5)
        diff = x - x[labels == k].mean(0)
        joint.append(math.log((labels == k).mean()) - 0.5 * (np.einsum("nd,nd->n", diff @ np.linalg.inv(c), diff) + np.linalg.slogdet(c)[1] + 5 * math.log(2 * math.pi)))
    joint = np.array(joint).T
    got = {r.id: r for r in covariance.scored(vectors, "v", model).collect()}
    assert np.allclose([got[i].log_likelihood for i in range(300)], np.logaddexp.reduce(joint, axis=1))
    assert [got[i].cluster for i in range(300)] == joint.argmax(1).tolist()
    assert got[1000].cluster is None and got[1000].log_likelihood is None


def test_isolation_paths(spark, vectors):
    """Each row's path equals a walk node by node; far rows are cut off early; trees come from their bounded subsamples."""
    forest = isolation.fit(vectors, "id", "v", trees=12, size=64)
    nodes = {}
    for r in forest.collect():
        nodes.setdefault(r.tree, {})[r.node] = (r.dim, r.cut, r.size)
    assert len(nodes) == 12 and all(t[0][2] == 64 for t in nodes.values())
    for tree in nodes.values():
        assert all(dim < 0 or tree[2 * j + 1][2] + tree[2 * j + 2][2] == size for j, (dim, _, size) in tree.items())

    def walk(x, tree, node=0):
        dim, cut, size = tree[node]
        return isolation.expected_path(size) if dim < 0 else 1 + walk(x, tree, 2 * node + 1 + (x[dim] >= cut))

    x, _ = dense()
    for tree in nodes.values():
        assert np.allclose(isolation.paths(x, tree), [walk(v, tree) for v in x])
    far = spark.createDataFrame([(2000, [60.0, -60.0, 60.0, -60.0, 60.0], 0)], VECTORS)
    scored = {r.id: r.anomaly for r in isolation.anomaly(vectors.unionByName(far), "v", forest, size=64).collect()}
    assert scored[1000] is None and scored[2000] > np.median([v for k, v in scored.items() if k not in (1000, 2000)])
    want = 2 ** (-np.mean([[walk(v, t) for v in x] for t in nodes.values()], axis=0) / isolation.expected_path(64))
    assert np.allclose([scored[i] for i in range(300)], want)
    again = isolation.fit(vectors.repartition(2), "id", "v", trees=12, size=64)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, forest.collect()))


def test_autoencoder_gradients_and_loss(spark, vectors):
    x, _ = dense()
    net = [(w, np.linspace(0.1, 0.4, len(b))) for w, b in autoencoder.start([5, 4, 3, 5], 3)]  # no value lies on a corner
    n, loss, g = autoencoder.summed_gradient(vectors.where("v is not null").select(F.col("v").alias("x")), net)
    at = autoencoder.flat(net)
    value = lambda w: ((autoencoder.rebuilt(x, autoencoder.unflat(w, net))[-1] - x) ** 2).mean(1).sum()
    assert n == 300 and math.isclose(loss, value(at))
    for i in np.random.default_rng(1).choice(len(at), 12, replace=False):
        step = np.zeros(len(at))
        step[i] = 1e-7  # few rows cross a corner of the rectifier
        assert math.isclose(g[i], (value(at + step) - value(at - step)) / 2e-7, rel_tol=1e-3, abs_tol=1e-2)
    trained, losses = autoencoder.train(vectors, "id", "v", hidden=(8, 2, 8), steps=12, batches=2, rate=0.02)
    assert np.mean(losses[-2:]) < 0.7 * np.mean(losses[:2])
    got = {r.id: r.error for r in autoencoder.errors(vectors, "v", trained).collect()}
    assert got[1000] is None and np.allclose([got[i] for i in range(300)], ((autoencoder.rebuilt(x, trained)[-1] - x) ** 2).mean(1))
    assert autoencoder.train(vectors.where("false"), "id", "v") == ([], [])


def test_restarts_return_the_best_bound(spark, vectors):
    """Bounds never fall, all starts share one scan per round, and the model is that of the greatest bound."""
    x, labels = dense()
    trail = []
    model = variational.fit_dirichlet_mixture(spark, vectors, "v", components=6, rounds=10, starts=4, trail=trail)
    by = {i: [b for j, b in trail if j == i] for i in range(4)}
    for bounds in by.values():
        assert len(bounds) > 1 and all(b >= a - 1e-9 for a, b in zip(bounds, bounds[1:]))
    best = max(by, key=lambda i: by[i][-1])
    alone = []
    variational.fit_dirichlet_mixture(spark, vectors, "v", components=6, rounds=10, starts=1, seed=42 + best, trail=alone)
    assert np.allclose([b for _, b in alone], by[best])
    top = model.orderBy(F.col("weight").desc()).limit(3).collect()
    centres = sorted(np.mean(r.mean) for r in top)
    assert np.allclose(centres, [x[labels == k].mean() for k in range(3)], atol=0.4) and abs(sum(r.weight for r in model.collect()) - 1) < 1e-9
    assert variational.fit_dirichlet_mixture(spark, vectors.where("false"), "v").count() == 0


class Broken(Exception):
    pass


def test_a_stream_that_breaks_goes_on_where_it_was(spark, tmp_path):
    """A driver lost in the middle of a batch, after its level and before its model, leaves the rows of one that was not."""
    rows = spark.createDataFrame(blobs(), VECTORS)
    for k in range(3):
        rows.where(F.col("id") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    params = mixture.label_mixture(rows, "v", "label")

    def go(base, breaks=None):
        step = model_stream.ModelStream(spark, base, params, "v", fit=rows)
        if breaks is not None:
            commit = step.model.commit

            def broken(batch_id, after):
                if batch_id == breaks:
                    raise Broken
                commit(batch_id, after)

            step.model.commit = broken
        stream = spark.readStream.schema(VECTORS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        model_stream.run(stream, step, f"{base}/checkpoint")
        return step

    whole = go(f"{tmp_path}/whole")
    with pytest.raises(Exception):
        go(f"{tmp_path}/cut", breaks=1)
    assert not model_stream.exists(spark, f"{tmp_path}/cut/model/version=2")
    again = go(f"{tmp_path}/cut")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(again.levels()) == key(whole.levels()) and len(key(whole.levels())) == 3
    assert key(again.model.at(3)) == key(whole.model.at(3)) != key(whole.model.at(0))
    again(rows, 2)  # a replayed batch changes nothing
    assert key(again.model.at(3)) == key(whole.model.at(3))


def test_novel_rows_replace_the_lightest_component(spark, tmp_path):
    near = [(i, [0.1 * (i % 7), 0.1 * (i % 5)], 0) for i in range(100)]
    far = [(200 + i, [50 + 0.1 * (i % 7), 50.0 + 0.1 * (i % 3)], 0) for i in range(20)]
    rows = spark.createDataFrame(near, "id long, v array<double>, label int")
    params = spark.createDataFrame([(0, 0.97, [0.3, 0.2], [0.1, 0.1]), (1, 0.03, [1.0, 1.0], [0.1, 0.1])], mixture.PARAMS)
    step = model_stream.ModelStream(spark, f"{tmp_path}/s", params, "v", fit=rows)
    step(rows, 0)
    step(rows.unionByName(spark.createDataFrame(far, rows.schema)), 1)
    levels = {r.batch: r for r in step.levels().collect()}
    assert (levels[0].novel, levels[0].replaced, levels[1].novel, levels[1].replaced) == (0, False, 20, True)
    new = {r.k: r for r in step.model.at(2).collect()}[1]
    assert abs(new.mean[0] - 50.3) < 0.3 and abs(new.mean[1] - 50.1) < 0.3 and new.weight > 0.1


def test_windows_of_a_hot_source(spark, tmp_path):
    """Full windows over batches equal windows over all rows; one source has most rows, one none in some batches, null sources none at all."""
    batches = [
        [(1, 10 * k + i // 9, float(i % 4)) for i in range(95)] + [(2, k, 2.0)] * (k % 2 * 7) + [(3, k, float(k))] * 5 + [(None, k, 1.0)] for k in range(4)
    ]
    schema = "src long, ts_ms long, value double"
    step = model_stream.WindowStream(spark, f"{tmp_path}/w", 10)
    for k, rows in enumerate(batches):
        step(spark.createDataFrame(rows, schema), k)
        step(spark.createDataFrame(rows, schema), k)  # replayed
    want = []
    for src in (1, 2, 3):
        rows = [r for b in batches for r in sorted((r for r in b if r[0] == src), key=lambda r: r[1:])]
        full = [rows[i : i + 10] for i in range(0, len(rows) - 9, 10)]
        want += [(src, w, 10, min(r[1] for r in f), max(r[1] for r in f), sum(r[2] for r in f)) for w, f in enumerate(full)]
    got = step.windows().select(*[c.split()[0] for c in model_stream.WindowStream.OUT.split(", ")])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_finished_runs_are_not_repeated(spark, tmp_path):
    done = []

    def work(variant, seed):
        done.append((variant, seed))
        if variant == "b" and seed == 2 and done.count(("b", 2)) == 1:
            raise Broken
        return spark.range(1).select(F.lit(float(seed + len(variant))).alias("score"))

    with pytest.raises(Broken):
        ledger.run_grid(spark, str(tmp_path), ["a", "b"], [1, 2], work)
    first = list(done)
    runs = ledger.run_grid(spark, str(tmp_path), ["a", "b"], [1, 2], work)
    assert done[len(first) :] == [("b", 2)]
    again = ledger.run_grid(spark, str(tmp_path), ["a", "b"], [1, 2], work)
    assert done[len(first) :] == [("b", 2)] and again.count() == runs.count() == 4
    got = {r.variant: r for r in ledger.spread(again, ["score"]).collect()}
    assert got["a"].runs == 2 and got["a"].mean_score == 2.5 and math.isclose(got["a"].std_score, math.sqrt(0.5))
    wider = ledger.run_grid(spark, str(tmp_path), ["a"], [1, 2, 3], work)
    assert done[-1] == ("a", 3) and wider.count() == 3


def test_masked_tracks(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), (None,)], "v array<double>")
    got = [r[0] for r in df.select(ledger.masked(F.col("v"), [(0, 1), (2, 2)])).collect()]
    assert got == [[0.0, 2.0, 0.0, 0.0], None]


def test_trace_carries_what_led_to_the_tactic(spark):
    flows = spark.createDataFrame([(1, 0, 0.2), (2, 1, 0.9), (3, 9, 0.1)], "flow_key long, cluster int, scan double")
    rules = spark.createDataFrame([(0, "x", 1.0), (0, "y", 0.0), (1, "y", 0.5)], "cluster int, behaviour string, score double")
    shares = spark.createDataFrame([(0, "x", 1.0), (1, "x", 0.5), (1, "y", 0.5)], "cluster int, behaviour string, p double")
    weights = spark.createDataFrame([("x", "T", 1.0), ("y", "T", 0.25), ("y", "U", 0.75)], "behaviour string, tactic string, weight double")
    tactics = spark.createDataFrame([(0, "T", 1.0), (1, "T", 0.625), (1, "U", 0.375)], "cluster int, tactic string, p double")
    got = {r.flow_key: r.provenance for r in trace.traced(flows.where("flow_key <> 7"), ["scan"], rules, shares, weights, tactics).collect()}
    assert got[2].asDict(True) == {
        "cluster": 1, "scores": {"scan": 0.9}, "hits": {"y": 0.5}, "shares": {"x": 0.5, "y": 0.5}, "weights": {"x -> T": 0.5, "y -> T": 0.125, "y -> U": 0.375},
        "tactics": {"T": 0.625, "U": 0.375}, "behaviour": "x", "tactic": "T",
    }
    assert got[1].hits == {"x": 1.0} and got[3].tactic is None and got[3].hits is None


def test_sketches_stay_within_their_error(spark):
    edges = spark.range(60_000).selectExpr("id % 2 as src", "id * 7 % 40000 as dst", "cast(id div 15000 as int) as chunk", "1.0 as in_bytes")
    exact = {(r.src, r.chunk): r for r in graph.context_by_chunk(edges).collect()}
    got = {(r.src, r.chunk): r for r in graph.context_by_chunk_sketch(edges).collect()}
    assert got.keys() == exact.keys()
    for k, r in got.items():
        assert (r.flows, r.bytes) == (exact[k].flows, exact[k].bytes)
        assert abs(r.fan_out - exact[k].fan_out) <= 4 * 1.04 / 128 * max(exact[k].fan_out, 1)
    sizes = graph.fan_sketches(edges, ["src"]).select(F.max(F.length("sketch"))).first()[0]
    assert sizes <= 17_000


def test_clustering_grid_on_separate_groups(spark):
    """K-means and mixtures of the right size find three groups; the row's figures follow from the clusters."""
    from flowloom.operators import baselines

    r = np.random.default_rng(2)
    rows = [(i, (10.0 * (i % 3) + r.standard_normal(6)).tolist(), i % 3) for i in range(150)] + [(999, None, 1)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {(x.method, x.k): x for x in baselines.clustering_grid(df, "v", "label", [("kmeans", 3), ("kmeans", 2), ("gmm", 3)], "id").collect()}
    for key in (("kmeans", 3), ("gmm", 3)):
        assert (got[key].clusters, got[key].purity, got[key].accuracy) == (3, 1.0, 1.0) and got[key].nmi > 0.999 and got[key].silhouette > 0.7
    assert got["kmeans", 2].clusters == 2 and math.isclose(got["kmeans", 2].accuracy, 2 / 3)


@pytest.mark.parametrize("method", ["forest", "perceptron"])
def test_supervised_baselines_on_separate_groups(spark, method):
    from flowloom.operators import baselines

    r = np.random.default_rng(3)
    rows = [(i, (4.0 * (i % 3) + r.standard_normal(4)).tolist(), i % 3) for i in range(240)]
    train, test = spark.createDataFrame(rows[:180], VECTORS), spark.createDataFrame(rows[180:], VECTORS)
    found = baselines.supervised(train, test, "v", "label", method).collect()
    assert len(found) == 60 and sum(x.prediction == x.label for x in found) >= 57


def test_an_evaluation_must_be_prepared_as_the_training(spark):
    from flowloom.functions import scalar

    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(40)], "id long, a double, b double")
    train, test, saved = df.where("id < 30"), df.where("id >= 30"), {"features": ["a", "b"], "stats": scalar.scale_stats(df.where("id < 30"), ["a", "b"])}
    gaps = lambda features, fit, held, seen: timeline.preparation_gaps(saved, features, scalar.scale_stats(fit, features), held, seen, ["id"])
    timeline.check_preparation(gaps(["a", "b"], train, test, train))
    for bad, what in ((gaps(["b", "a"], train, test, train), "features"), (gaps(["a", "b"], test, test, train), "scaler"), (gaps(["a", "b"], train, df, train), "30 test rows")):
        with pytest.raises(RuntimeError, match=what):
            timeline.check_preparation(bad)


def test_silhouette_of_all_rows_over_blocks(spark, tmp_path):
    r = np.random.default_rng(3)
    x, c = r.standard_normal((6000, 64)).astype("float32"), r.integers(0, 4, 6000)
    x[c == 1] += 1
    x[1::50] = x[::50][: len(x[1::50])]  # equal vectors
    c[7] = 9  # a cluster of one row
    x64, want = x.astype(float), []
    for i in range(len(x)):
        d = np.sqrt(((x64 - x64[i]) ** 2).sum(1))
        d[i] = 0
        means = {k: d[c == k].sum() / n for k in range(10) if (n := (c == k).sum() - (k == c[i])) > 0}
        a, b = means.get(c[i]), min(m for k, m in means.items() if k != c[i])
        want.append(0 if a is None else (b - a) / max(a, b))
    spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(c, x))], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.queries()["silhouette_sample"](spark, str(tmp_path)).first()
    assert got.n == 6000 and math.isclose(got.silhouette, np.mean(want), abs_tol=1e-6)
    few = metrics.silhouette(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), "vec_id", "embedding", "label", rows=100, block=16).first()
    assert few.n == 100


@pytest.mark.parametrize("widest", [32_768, 45])
def test_silhouette_sends_a_row_to_few_tiles(spark, monkeypatch, widest):
    """Blocks grow and not their number, until they are as wide as a task may hold; repeated ids, nulls and far vectors as pairs of rows say."""
    r = np.random.default_rng(4)
    rows = [(i // 2 if i < 40 else i, (r.standard_normal(5) * (1e4 if i % 90 == 0 else 1)).astype("float32").tolist(), i % 3) for i in range(1500)]
    ids, x, c = np.array([a for a, _, _ in rows]), np.array([v for _, v, _ in rows]), np.array([k for *_, k in rows])
    want = []
    for i in range(20):
        near = {}
        for j in np.flatnonzero(ids == i):
            d = np.sqrt(((x - x[j]) ** 2).sum(1))
            for k in range(3):
                near.setdefault((c[j], k), []).extend(d[(c == k) & (ids != i)])
        a, b = (f([np.mean(v) for (own, k), v in near.items() if same == (own == k)]) for f, same in ((max, True), (min, False)))
        want.append((b - a) / max(a, b))
    for j in range(40, 1500):
        d = np.sqrt(((x - x[j]) ** 2).sum(1))
        a, b = d[(c == c[j]) & (ids != ids[j])].mean(), min(d[c == k].mean() for k in range(3) if k != c[j])
        want.append((b - a) / max(a, b))
    odd = [(9001, None, 1), (9002, [1.0, None, 0.0, 0.0, 0.0], 1), (None, [1.0] * 5, 1), (9003, [1.0] * 5, None)]
    df = spark.createDataFrame([*rows, *odd], "id long, v array<float>, c int")
    sent, of = spark.sparkContext.accumulator(0), metrics._tile_sums

    def counted(tile):
        sent.add(tile.shape[0])
        return of(tile)

    monkeypatch.setattr(metrics, "_tile_sums", counted)
    monkeypatch.setattr(metrics, "WIDEST", widest, raising=False)
    got = metrics.silhouette(df, "id", "v", "c", rows=None, block=16).first()
    assert got.n == 1480 and math.isclose(got.silhouette, np.mean(want), abs_tol=1e-9)
    assert 0 < sent.value <= 1501 * max(24, math.ceil(1501 / widest))


def test_events_of_one_millisecond_keep_their_order(spark, tmp_path):
    at = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, 0) + make_dt_interval(0, 0, 0, cast(id as decimal(18, 6)) / 10000)"
    spark.range(95).selectExpr("id AS event_id", f"{at} AS ts", "1L AS user_id", "cast(1000 - id as double) AS value").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in catalogue.queries()["streamed_windows"](spark, str(tmp_path)).select("window_id", "n_flows", "first_ts", "last_ts", "sum_value").collect())
    base = 1_704_067_200_000
    assert got == [(w, 10, base + w, base + w, float(sum(1000 - i for i in range(10 * w, 10 * w + 10)))) for w in range(9)]


def test_context_of_chunks_counts_every_destination(spark, tmp_path):
    n = 40_000
    line = spark.range(n).selectExpr(
        "id AS l_orderkey", "id * 37 AS l_partkey", "1L AS l_suppkey", "1 AS l_linenumber", "1.0D AS l_quantity", "1.0D AS l_extendedprice", "0.0D AS l_discount", "0.0D AS l_tax",
        "'N' AS l_returnflag", "'O' AS l_linestatus", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int)) AS l_shipdate",
    )
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.chunk, r.flows, r.fan_out) for r in catalogue.queries()["context_by_chunk_sketch"](spark, str(tmp_path)).collect())
    assert got == [(k, k * n // 10, k * n // 10) for k in range(10)]
