"""Corpus pipeline: documents in, packed token windows out.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; ``run`` writes every
stage's result as Parquet into the cluster's shared folder and hands the reread
table to the next one, so that a lost executor costs one stage's tasks at most.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import line_frequency, packing, pii, simhash, toxicity
from flowloom.llm.common import discard, read_table, shared_folder

STAGES = [
    ("quality rules", line_frequency.stage),
    ("toxicity", toxicity.stage),
    ("SimHash near-dedup", simhash.stage),
    ("PII", pii.stage),
    ("packing", packing.stage),
]

#: Hashes, trained models and token ids can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what earlier stages wrote is deleted as soon as the next one has been written."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            discard(spark, f"{base}/{k - 1}")
    return docs
