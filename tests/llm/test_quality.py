import re
from collections import Counter

from flowloom.llm import line_frequency as quality

from .helpers import DOC_SCHEMA, documents, edge_rows, save, split_words, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def measures(text):
    text = text or ""
    w = split_words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if split_words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    inside = {p for i, x in enumerate(windows) if count[x] > 1 for p in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed)


def verdicts(rows, limit=50, least=20):
    norm = lambda line: re.sub("[\x20\x09-\x0d]+", " ", line).strip(" ").lower()
    held = [(h or "", t or "", [x for x in map(norm, (t or "").split("\n")) if x]) for _, t, _, h, _ in rows]
    count = Counter((h, x) for h, _, x in {(h, t, x) for h, t, lines in held for x in lines})
    out = []
    for (h, _, lines), row in zip(held, rows):
        lost = [x for x in lines if count[h, x] > limit]
        n, *_, failed = measures(row[1])
        out.append(not failed and (not lost or n - sum(len(x.split(" ")) for x in lost) >= least))
    return out


def corpus():
    rows = edge_rows()
    banner = "Subscribe to our newsletter today and save on everything"
    for k in range(70):
        rows.append((100 + k, words(50 + k, 60) + "\n" + banner, "en", "hot", 1))
    rows.append((300, banner + "\n" + words(9, 12), "en", "hot", 1))  # depleted
    rows += [(400 + k, words(77, 40) + "\n" + words(78, 30), "en", "hot", 1) for k in range(60)]  # copies are not boilerplate
    common = "Terms and conditions apply to all of these offers"
    for k in range(30):  # a common line on too few distinct documents, each of them present twice
        rows += [(500 + k, words(500 + k, 30) + "\n" + common, "en", "twice", 1)] * 2
    for k in range(60):  # heavy boilerplate: 18 own words and a line of 22 words
        rows.append((600 + k, words(700 + k, 18) + "\n" + words(79, 22), "en", "banner", 1))
    rows += [(700 + k, "\n".join([banner] * (k % 3)) + "\n" + words(800 + k, 61), None, None, 1) for k in range(80)]
    return rows


def key(x):
    return tuple(map(str, x))


def test_query_equals_brute_force(spark, tmp_path):
    rows = corpus()
    save(documents(spark, rows, clash=True), tmp_path, "documents")
    got = sorted((tuple(r) for r in quality.query(spark, str(tmp_path)).select("doc_id", *MEASURES, "kept").collect()), key=key)
    want = sorted(((r[0], *measures(r[1]), v) for r, v in zip(rows, verdicts(rows))), key=key)
    assert got == want
    kept = {i for i, *_, k in got if k}
    assert 300 not in kept and {100, 169, 400, 459} <= kept
    assert set(range(500, 530)) <= kept and not kept & set(range(600, 660))


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    save(documents(spark, corpus()), tmp_path, "documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, {', '.join(MEASURES)}, kept FROM ({quality.ORACLE})").fetchall(), key=key)
    got = sorted((tuple(r) for r in quality.query(spark, str(tmp_path)).select("doc_id", *MEASURES, "kept").collect()), key=key)
    assert got == want


def test_stage_removes_lines_and_rejects(spark):
    docs = documents(spark, corpus(), clash=True)
    out = quality.stage(spark, docs, "")
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert "Subscribe" not in rows[100].text and rows[100].n_chars == len(rows[100].text)
    assert rows[100].text == words(50, 60)
    assert 300 not in rows and 2 not in rows and 9 not in rows and 459 in rows
    assert sum(r.doc_id == 500 for r in out.collect()) == 2 and rows[400].text == words(77, 40) + "\n" + words(78, 30)
    assert rows[702].text == words(802, 61) and rows[700].text == "\n" + words(800, 61)


def test_no_python_in_the_plan(spark, tmp_path):
    save(documents(spark), tmp_path, "documents")
    plan = quality.query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark, tmp_path):
    save(spark.createDataFrame([], DOC_SCHEMA), tmp_path, "documents")
    assert quality.query(spark, str(tmp_path)).count() == 0


def test_template_pages_are_depleted(spark):
    template = "\n".join(words(900 + k, 10) for k in range(8))
    rows = [(k, template + "\n" + words(2000 + k, 10 + k % 21), "en", "hot", 1) for k in range(80)]
    out = {r.doc_id: r.text for r in quality.stage(spark, documents(spark, rows), "").collect()}
    assert out == {i: t.split("\n")[-1] for i, t, *_ in rows if i % 21 >= 10}
