import math
import zlib
from collections import Counter

import numpy as np
import pytest

from flowloom.llm import lattice_lm as lm

from .helpers import DOC_SCHEMA, documents, edge_rows, lower_ascii, save, split_words, words


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba"]
    log_p = np.log(np.arange(1, 9) / 40)
    byte = np.full(256, math.log(1e-4))
    lattice = lm.Lattice(pieces, log_p, byte)
    p = dict(zip(pieces, np.exp(log_p)))

    def total(s):
        if not s:
            return 1.0
        out = sum(p.get(s[:k], 0) * total(s[k:]) for k in range(1, len(s) + 1))
        return out + (1e-4 ** len(s[0].encode()) * total(s[1:]) if s[0] not in p else 0)

    found = [b"a", b"ab", b"abab", "aéb".encode(), "😀".encode(), b"bbaaba"]
    got = np.zeros(len(found))
    for at, points in lattice.by_length(found):
        got[at] = lattice.forward(points)[:, -1]
    assert np.allclose(got, [math.log(total("▁" + w.decode())) for w in found])


def test_expected_counts_equal_enumeration():
    pieces = ["▁", "a", "b", "ab", "▁a"]
    log_p = np.log(np.array([0.1, 0.2, 0.15, 0.3, 0.25]))
    lattice = lm.Lattice(pieces, log_p, np.full(256, -9.0))
    p = dict(zip(pieces, np.exp(log_p)))

    def ways(s):
        if not s:
            yield []
        for k in range(1, len(s) + 1):
            if s[:k] in p:
                for rest in ways(s[k:]):
                    yield [s[:k], *rest]

    all_ways = list(ways("▁abab"))
    weight = [math.prod(p[x] for x in w) for w in all_ways]
    want = np.zeros(len(pieces))
    for w, v in zip(all_ways, weight):
        for x in w:
            want[pieces.index(x)] += 3 * v / sum(weight)
    (_, points), = lattice.by_length([b"abab"])
    assert np.allclose(lattice.expected(points, np.array([3.0])), want)


def rows():
    return edge_rows() + [(100 + k, words(k % 7, 40 + k), "en", "s", 1) for k in range(60)]


@pytest.mark.parametrize("frequent", [1 << 16, 20])  # most words joined in the second case
def test_query_counts_and_base_scores(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    save(documents(spark, rows(), clash=True), tmp_path, "documents")
    got = lm.query(spark, str(tmp_path)).collect()
    tokens = [(i, split_words(lower_ascii(t)) + [None]) for i, t, *_ in rows()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n) for i, ws in tokens), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got), key=str) == want
    base = sorted((str(i), sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in ws)) for i, ws in tokens)
    have = sorted((str(r.doc_id), r.base_score) for r in got)
    assert [i for i, _ in base] == [i for i, _ in have] and np.allclose([x for _, x in base], [x for _, x in have])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_scores_are_sums_of_word_marginals(spark):
    docs = documents(spark, rows())
    got = {r.doc_id: r.score for r in lm.score(docs, ~lm.held_out()).collect()}
    counted = lm.vocabulary(docs.withColumn("training", ~lm.held_out()))
    table = {bytes(r.word): r.lp for r in lm.word_scores(counted, lm.fit(counted, lm.default_path())).collect()}
    for i, t, *_ in rows():
        want = sum(table[w.encode()] for w in split_words(lower_ascii(t))) + table[lm.END]
        assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-9)


def test_em_raises_the_training_likelihood(spark):
    docs = documents(spark, rows()).withColumn("training", ~lm.held_out())
    counted = lm.vocabulary(docs).cache()
    by_rounds = []
    for k in (0, 1, 3):
        table = lm.word_scores(counted, lm.fit(counted, lm.default_path(), rounds=k)).where("c > 0")
        by_rounds.append(table.selectExpr("sum(c * lp)").first()[0])
    assert by_rounds[0] < by_rounds[1] < by_rounds[2]


def test_long_words_one_by_one_equal_batches(monkeypatch):
    pieces, log_p = lm.load_pieces(lm.default_path())
    lattice = lm.Lattice(pieces, log_p - 5, np.full(256, -15.0))
    found = [words(3, 9).replace(" ", "").encode(), "größer😀".encode(), b"x" * 60]
    weights = np.array([2.0])

    def both():
        return [(lattice.forward(p), lattice.expected(p, weights)) for w in found for _, p in lattice.by_length([w])]

    batches = both()
    monkeypatch.setattr(lm, "LONG", 1)
    for (a, x), (b, y) in zip(batches, both()):
        assert np.allclose(a, b) and np.allclose(x, y)


def test_frequent_words_are_bounded_and_whole_steps(spark):
    rows = [(str(i).encode(), c, -1.0) for i, c in enumerate([1000, 900, 900, 50, 50, 50, 3, 0])] + [(b"-" * 500, 70, -2.0)]
    table = spark.createDataFrame(rows, "word binary, c long, lp double")
    assert lm.frequent_words(table, 2) == {b"0": (math.log10(1001), -1.0)}
    assert set(lm.frequent_words(table, 6)) == {b"0", b"1", b"2", lm.key_of(b"-" * 500)}
    assert len(lm.frequent_words(table, 99)) == 8


def test_keys_are_the_same_on_both_sides(spark):
    found = [b"", b"a", b"x" * 64, b"x" * 65, "ü".encode() * 400]
    table = spark.createDataFrame([(w,) for w in found], "word binary")
    assert [bytes(r.k) for r in table.select(lm.key_column().alias("k")).collect()] == [lm.key_of(w) for w in found]


def test_one_very_long_word(spark):
    docs = documents(spark, [(1, "q1w2" * 50_000, "en", "s", 1), (2, "plain words " + "-" * 3000, "en", "s", 1)] * 2)
    got = lm.score(docs, ~lm.held_out()).collect()
    assert len(got) == 4 and all(math.isfinite(r.score) for r in got) and {r.n_tokens for r in got} == {2, 4}


def test_empty_table(spark, tmp_path):
    save(spark.createDataFrame([], DOC_SCHEMA), tmp_path, "documents")
    assert lm.query(spark, str(tmp_path)).count() == 0
