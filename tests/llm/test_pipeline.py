import corpus_pipeline

from flowloom.llm import packing, pii, simhash, toxicity
from flowloom.llm import line_frequency as quality

from .helpers import documents, save
from .test_packing import check
from .test_quality import verdicts
from .test_simhash import brute
from .test_toxicity import corpus


def test_stages_are_those_agreed():
    assert [f for _, f in corpus_pipeline.STAGES] == [quality.stage, toxicity.stage, simhash.stage, pii.stage, packing.stage]


def test_run_equals_the_stages_by_hand(spark, tmp_path):
    rows, labels = corpus(300)
    rows += [(5000 + k, rows[1][1], "en", "s", 1) for k in range(5)]  # copies of a clean document
    rows += [(6000, None, None, None, None), (6001, "too short", "en", "s", 9)]
    save(documents(spark, rows, clash=True), tmp_path, "documents")
    save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    left = [r for r, v in zip(rows, verdicts(rows)) if v]
    docs = documents(spark, left)
    clean = {r.doc_id for r in toxicity.score(docs, *toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).where("score < 0.7").collect()}
    left = [r for r in left if r[0] in clean]
    left = [r for r, (_, _, root) in zip(sorted(left, key=str), sorted(brute(left), key=str)) if root == r[0]]
    masked = pii.redact(documents(spark, left)).collect()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r[0] for r in left} and not any(5000 <= r.doc_id for r in out)
    check(out, [(r.doc_id, r.text) for r in masked])


def test_empty_documents(spark, tmp_path):
    save(documents(spark, []), tmp_path, "documents")
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
