import random
import zlib

import numpy as np

from flowloom.llm import toxicity

from .helpers import DOC_SCHEMA, documents, edge_rows, save, words

BAD = ["zqxvile", "kwjscum", "vexrotten"]


def corpus(n=600):
    r = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        w = words(k, r.randint(30, 90)).split()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append((1000 + k, " ".join(w), "en", "s", 1))
        labels.append((1000 + k, 1, int(toxic)))
    return rows, labels


def tables(spark, folder, rows, labels):
    save(documents(spark, rows, clash=True), folder, "documents")
    save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), folder, "labels")


def test_held_out_accuracy_and_contract(spark, tmp_path):
    rows, labels = corpus()
    tables(spark, tmp_path, rows + edge_rows(), labels)
    got = toxicity.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(edge_rows())
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    same = {r.score for r in got if r.doc_id in (0, 1)}
    assert len(same) == 1 and all(r.predicted == 0 for r in got if r.doc_id in (2, 3, 4))


def plain_scores(train, texts, features, alpha=1.0, strength=1e-4):
    """The classifier by plain sums: log-count ratios, then balanced logistic regression by Newton steps in the dual."""
    grams = lambda t: set(toxicity.ngram_buckets(t).tolist())  # noqa: E731  (n-grams that share a bucket are one feature)
    bags = [(grams(t), y) for t, y in train]
    n_pos, n_neg = sum(y for _, y in bags), sum(1 - y for _, y in bags)
    counts = {}
    for bag, y in bags:
        for g in bag:
            c = counts.setdefault(g, [0, 0])
            c[y] += 1
    ratio = {g: np.log(((p + alpha) / (n_pos + 2 * alpha)) / ((n + alpha) / (n_neg + 2 * alpha))) for g, (n, p) in counts.items() if n + p >= 3}
    at = {g: i for i, g in enumerate(sorted(ratio, key=lambda g: (-abs(ratio[g]), g))[:features])}

    def rows(found):
        x = np.zeros((len(found), len(at)))
        for r, bag in enumerate(found):
            known = bag & at.keys()
            for g in known:
                x[r, at[g]] = ratio[g] / len(known) ** 0.5
        return x

    x, y = rows([b for b, _ in bags]), np.array([y for _, y in bags], dtype=float)
    kernel, n = x @ x.T, len(y)
    share = np.where(y > 0, n_neg / n_pos, 1.0)
    share /= share.sum()
    a, b = np.zeros(n), 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(kernel @ a + b)))
        grad = np.append(kernel @ (share * (p - y) + strength * a), (share * (p - y)).sum())
        w = p * (1 - p) * share
        hess = np.block([[kernel * w @ kernel + strength * kernel, (kernel @ w)[:, None]], [(w @ kernel)[None], np.array([[w.sum()]])]])
        step = np.linalg.lstsq(hess + 1e-10 * np.eye(n + 1), grad, rcond=None)[0]
        a, b = a - step[:n], b - step[n]
    return 1 / (1 + np.exp(-(rows([grams(t) for t in texts]) @ (x.T @ a) + b)))


def test_scores_equal_an_independent_classifier(spark):
    rows, labels = corpus(240)
    docs = documents(spark, rows)
    weights, bias = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), features=2000, iterations=400)
    got = {r.doc_id: r.score for r in toxicity.score(docs, weights, bias).collect()}
    learnt = [i for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    text, toxic = {r[0]: r[1] for r in rows}, {i: t for i, _, t in labels}
    want = plain_scores([(text[i], toxic[i]) for i in learnt], [r[1] for r in rows], 2000)
    apart = np.abs(np.array([got[r[0]] for r in rows]) - want)
    # both stop near the optimum, not at it, which shows where the log-odds of an unlearnt document are about zero
    assert apart.mean() < 0.01 and (apart < 0.05).mean() >= 0.98, (apart.max(), apart.mean(), (apart < 0.05).mean())


def test_repeated_documents_and_bound(spark):
    rows, labels = corpus(90)
    docs = documents(spark, rows * 3)
    table = spark.createDataFrame(labels + labels, "doc_id long, quality int, toxic int")
    usable = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, *_ in labels)
    assert toxicity.labelled_sample(docs, table, 1000).count() == usable
    some = [r.doc_id for r in toxicity.labelled_sample(docs, table, 20).collect()]
    assert len(some) == len(set(some)) and 10 <= len(some) <= 20


def test_held_out_labels_are_never_learnt(spark, tmp_path):
    rows, labels = corpus(300)
    docs = documents(spark, rows)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    both = [toxicity.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped)]
    assert np.array_equal(both[0][0], both[1][0], equal_nan=True) and both[0][1] == both[1][1]


def test_buckets_are_those_of_all_ngrams_of_the_whole_text():
    text = "Abc DEF " * 3
    assert np.array_equal(toxicity.ngram_buckets(text), toxicity.ngram_buckets(text.lower()))
    long = words(1, 400_000)
    whole = set(toxicity.ngram_buckets(long).tolist())
    assert set(toxicity.ngram_buckets(long[-1000:])[1:].tolist()) - whole == set() or len(set(toxicity.ngram_buckets(long[-1000:]).tolist()) - whole) <= 3
    assert len(toxicity.ngram_buckets(None)) == len(toxicity.ngram_buckets(""))


def test_no_labels_one_class_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, quality int, toxic int"
    docs = documents(spark)
    for labels in ([], [(0, 1, 0), (7, 1, 0)], [(None, 1, 1), (0, None, None)]):
        out = toxicity.score(docs, *toxicity.train(docs, spark.createDataFrame(labels, schema))).collect()
        assert len(out) == len(edge_rows()) and all(r.score < 0.5 for r in out)
    tables(spark, tmp_path, [], [])
    assert toxicity.query(spark, str(tmp_path)).count() == 0


def test_stage_drops_toxic_documents_only(spark, tmp_path):
    rows, labels = corpus()
    tables(spark, tmp_path, rows, labels)
    docs = documents(spark, rows, clash=True)
    out = toxicity.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    toxic = {i for i, _, t in labels if t}
    assert len(kept & toxic) <= 0.03 * len(toxic) and len(kept - toxic) >= 0.98 * (len(labels) - len(toxic))


def test_sample_of_any_bound(spark):
    """Bounds far below a 1024th of the labels still give as many rows and both classes; all labels are taken under the bound."""
    n = 12_000
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "cast(id % 10 = 0 as int) as toxic")
    docs = spark.range(n).selectExpr("id as doc_id", "cast(id as string) as text")
    usable = [i for i in range(n) if zlib.crc32(str(i).encode()) % 3 != 1]
    for bound in (1, 5, 15, 300, 7000, 20_000):
        got = toxicity.labelled_sample(docs, labels, bound).collect()
        want = toxicity.quotas({1: sum(i % 10 == 0 for i in usable), 0: sum(i % 10 > 0 for i in usable)}, bound)
        assert {1: sum(r.toxic for r in got), 0: sum(1 - r.toxic for r in got)} == want
        assert {r.doc_id for r in got} <= set(usable) and bound - 1 <= sum(want.values()) <= max(bound, 2) or bound > len(usable)
    assert toxicity.labelled_sample(docs, labels.where("toxic = 0"), 10).count() == 10
    assert toxicity.labelled_sample(docs, labels.where("false"), 10).count() == 0
