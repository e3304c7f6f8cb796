import numpy as np
import pytest

from flowloom.llm import nn_descent as nd

from .helpers import root_table, save

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_and_truth(n=500, dim=16, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(n // 10):
        centre = r.standard_normal(dim)
        for k in range(10):
            rows.append(centre + r.standard_normal(dim) * (0.12 if c % 2 else 0.4))
    for _ in range(40):  # a group of exact copies and scaled copies
        rows.append(rows[0] * 2)
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(rows)]
    nan, inf = float("nan"), float("inf")
    rows += [(9000, None, 0), (9001, [0.0] * dim, 0), (9002, [nan] + [1.0] * (dim - 1), 0), (9003, [inf] * dim, 0), (9004, [None] + [1.0] * (dim - 1), None), (9005, [], 0)]
    return rows


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, dtype=float)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    ids = [i for i, _ in good]
    links = dict(zip(ids, near.sum(axis=1).tolist()))
    root = root_table([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b], ids)
    return sorted((i, links.get(i, 0), root.get(i, i), root.get(i, i) == i) for i, *_ in rows)


@pytest.mark.parametrize("tile", [1024, 16])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, tile):
    monkeypatch.setattr(nd, "TILE", tile)
    rows = rows_and_truth()
    save(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as sim", "3 as component"), tmp_path, "embeddings")
    got = sorted(tuple(r) for r in nd.query(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty(spark, tmp_path):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (None, [1.0, 0.0], 0)]
    got = sorted((tuple(r) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=str)
    save(spark.createDataFrame([], SCHEMA), tmp_path, "embeddings")
    assert nd.query(spark, str(tmp_path)).count() == 0


def pairs_over(nodes, threshold=0.95):
    """Links between nodes by brute force."""
    rows = nodes.select("node", "vec").collect()
    x = np.array([r.vec for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [r.node for r in rows]
    return [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)))], ids


def test_recall_of_one_search(spark):
    """The search itself, with few tables and without an audit, joins what the links join."""
    rows = rows_and_truth(1000, 32, 5)
    nodes = nd.durable(nd.classes(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding"))
    labels = {r.node: r.component for r in nd.search(nodes, None, nodes.count(), 32, 0.95, 10, 5, 2, 3).collect()}
    truth, ids = pairs_over(nodes)
    root = root_table(truth, ids)
    assert {n: root[n] for n in labels} == labels  # none joined below the threshold
    assert sum(labels.get(a) == labels.get(b, 0) for a, b in truth) >= 0.98 * len(truth)


def twin_clumps(pairs=12, size=60, dim=32, seed=3):
    """Clumps of more near copies than a list holds, in pairs that only links across make one component."""
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(pairs):
        centre, way = (v / np.linalg.norm(v) for v in r.standard_normal((2, dim)))
        way = way - centre * (way @ centre)
        way /= np.linalg.norm(way)
        for side in (-1, 1):
            for _ in range(size):
                rows.append(np.cos(0.12) * centre + side * np.sin(0.12) * way + r.standard_normal(dim) * 0.004)
    return [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(rows)]


def test_links_across_dense_clumps(spark):
    rows = twin_clumps()
    got = sorted(tuple(r) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    want = brute(rows)
    assert sum(w[3] for w in want) == 12 and all(w[1] == 119 for w in want)
    assert got == want


def test_large_components_are_counted_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(nd, "COUNT_TILE", 32)
    monkeypatch.setattr(nd, "STRIP", 7)
    rows = twin_clumps(2, 60) + [(500 + i, v, 0) for i, (_, v, _) in enumerate(twin_clumps(1, 5))]
    got = sorted(tuple(r) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)


def one_sided_pairs(n=1500, dim=32, seed=4):
    """Sparse near pairs that lie in one dense region, so that the hyperplane buckets are all too large."""
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, dim)) + 12 * np.ones(dim) / np.sqrt(dim)
    return np.vstack([base, base + r.standard_normal(base.shape) * 0.002])


def test_near_pairs_meet_in_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(nd, "TILE", 64)
    x = one_sided_pairs()
    n = len(x) // 2
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    nodes = nd.durable(nd.classes(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding"))
    ids = {r.node: r.id for r in nodes.select("node", "id").collect()}
    found = nd.first_lists(nd.parted(nodes, None), len(x), x.shape[1], 10, 4, 8, 3, 0.9999, False).where("sim >= 0.9999").collect()
    met = {tuple(sorted((ids[r.a], ids[r.b]))) for r in found}
    assert sum((i, i + n) in met for i in range(n)) >= 0.99 * n


def test_buckets_of_one_direction(spark, monkeypatch):
    monkeypatch.setattr(nd, "TILE", 16)
    rows = [(i, [1.0 + i, 2.0 + 2 * i], 0) for i in range(100)]
    got = [tuple(r) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == [(i, 99, 0, i == 0) for i in range(100)]


def test_saturated_lists_are_enlarged(spark):
    pairs = [(1, b, 0.99) for b in range(100, 107)] + [(2, b, 0.99 if b < 103 else 0.5) for b in range(100, 107)] + [(3, 9, 0.1), (3, 9, 0.1)]
    got = [tuple(r) for r in nd.top(spark.createDataFrame(pairs, nd.PAIR), 2, 0.95).select("a", "b").collect()]
    assert sorted(got) == [(1, b) for b in range(100, 107)] + [(2, b) for b in range(100, 104)] + [(3, 9)]


def test_recall_counts_vectors_not_links(spark):
    truth = spark.createDataFrame([(a, 39) for a in range(40)] + [(100 + i, 1) for i in range(10)] + [(200, 0)], "node long, due long")
    linked = spark.createDataFrame([(a, 39) for a in range(40)], "node long, linked long")
    assert nd.recall_of(truth, linked) == pytest.approx(0.8)  # 1560 of 1570 links, but 10 of 50 vectors miss theirs


def test_search_goes_on_until_the_recall(spark, monkeypatch):
    calls, real = [], nd.search

    def blind(nodes, labels, n, dim, threshold, k, bits, tables, seed):
        calls.append((seed, tables))
        if len(calls) <= 2:
            return nd.min_components(spark.createDataFrame([], "a long, b long"))
        return real(nodes, labels, n, dim, threshold, k, bits, tables, seed)

    monkeypatch.setattr(nd, "search", blind)
    monkeypatch.setattr(nd, "AUDITED", 2)
    rows = [(i, [float(i // 2 == j) + 0.01 * (i % 2) for j in range(4)], 0) for i in range(8)]
    got = sorted(tuple(r) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), tables=8).collect())
    assert got == brute(rows) and calls == [(1000, 8), (1001, 16), (1002, 32)]
    calls.clear()
    with pytest.raises(RuntimeError, match="recall 0.000"):
        nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), tries=2)


def test_the_audit_is_exact_and_supplies_no_links(spark, monkeypatch):
    monkeypatch.setattr(nd, "AUDITED", 3)
    monkeypatch.setattr(nd, "AUDIT_BLOCK", 5)
    rows = rows_and_truth(100, 16, 2)
    nodes = nd.durable(nd.classes(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding"))
    asked = {r.node: r for r in nodes.where("asked").collect()}
    true = {i: links for i, links, *_ in brute(rows)}
    got = {r.node: r.due for r in nd.audit(nodes, 0.95).collect()}
    assert set(got) == set(asked)
    assert all(got[n] == true[r.id] - (r.copies - 1) for n, r in asked.items())
    monkeypatch.setattr(nd, "search", lambda *a: nd.min_components(spark.createDataFrame([], "a long, b long")))
    monkeypatch.setattr(nd, "LEAST_RECALL", 0.0)
    with pytest.warns(UserWarning, match="recall"):
        lone = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), tries=1)
    assert lone.where("n_links > 40").count() == 0


def test_rounds_find_the_links(spark):
    """From lists dealt by hash alone, the rounds of the neighbour graph join most of what is joined, and lists that fill up grow."""
    rows = rows_and_truth(400, 16, 9)
    nodes = nd.durable(nd.classes(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding"))
    n, trail = nodes.count(), []
    lists, labels = nd.descend(nodes, None, n, 16, 0.95, 6, 5, 0, 3, False, trail)
    first, last = trail[0][1], trail[-1][1]
    assert trail[0][0] == "first" and last - first >= 0.8 * last
    truth, ids = pairs_over(nodes)
    got = {r.node: r.component for r in labels.collect()}
    assert sum(got.get(a) == got.get(b, 0) for a, b in truth) >= 0.9 * len(truth)
    sizes = [r.n for r in lists.where("sim >= 0.95").groupBy("a").agg(nd.F.count("b").alias("n")).collect()]
    assert max(sizes) > 6  # neighbours over the threshold fill lists of six, which then hold more


def test_saturated_lists_lead_to_a_second_search(spark):
    """Clumps larger than any list: the graph joins each clump, lists of other components join the clumps."""
    rows = twin_clumps(6, 60)
    nodes = nd.durable(nd.classes(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding"))
    n, trail = nodes.count(), []
    lists, _ = nd.descend(nodes, None, n, 32, 0.95, 10, 4, 1, 3, False, None)
    assert nd.saturated(lists, 10, 0.95)
    labels = nd.search(nodes, None, n, 32, 0.95, 10, 4, 1, 3, trail)
    assert labels.select("component").distinct().count() == 6 and [x[0] for x in trail].count("first") == 2


def test_ties_at_equal_cosines(spark):
    rows = [(i, [1.0, 0.001 * (i % 2), 0.0], 0) for i in range(60)] + [(100 + i, [0.0, 0.0, 1.0 + i], 0) for i in range(5)]
    got = sorted(tuple(r) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)
