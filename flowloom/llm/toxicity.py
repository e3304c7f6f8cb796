"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Presence of hashed character n-grams is counted per class over labelled documents;
each feature's log-count ratio scales it, the presence of a document's features has
length one, so that long documents don't add up noise, a logistic regression with
balanced classes is fitted, and every document is scored with the product of both.
The orders, the length, the balance and the strength were chosen by cross-validation
on rows whose labels may be learnt.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carry, durable, read_table, restore

ORDERS = (3, 4, 5, 6)
BITS = 20
#: Bits of a hash that are looked at at once.
DIGIT = 10
_STEP = 1 << 20
_FLAGS = np.zeros(1 << BITS, dtype=bool)  # scratch of one text, always left all false


def ngram_buckets(text: str | None) -> np.ndarray:
    """Distinct hash buckets of the character n-grams of a text (ASCII lower-cased, padded by spaces)."""
    data = (" " + (text or "") + " ").encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(data, dtype=np.uint32).astype(np.uint64)
    upper = (points >= 65) & (points <= 90)
    points = np.where(upper, points + np.uint64(32), points)
    flags = _FLAGS
    for lo in range(0, len(points), _STEP):
        part = points[lo : lo + _STEP + max(ORDERS) - 1]
        mixed = part * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        rolled = mixed
        for n in range(2, max(ORDERS) + 1):
            if len(part) < n:
                break
            rolled = rolled[:-1] * np.uint64(0xBF58476D1CE4E5B9) + mixed[n - 1 :]
            if n in ORDERS:
                key = rolled ^ (rolled >> np.uint64(32))
                key = (key * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)
                flags[key.astype(np.int64)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


def quotas(sizes: dict[int, int], bound: int) -> dict[int, int]:
    """Labels to take of each class: all within ``bound``, else shares of it, one of each class at least."""
    total = sum(sizes.values())
    if total <= bound:
        return sizes
    return {c: min(n, max(1, bound * n // total)) for c, n in sizes.items()}


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """``(doc_id, text, toxic)``: about ``bound`` labelled documents, all if there are no more, the same ones every time.

    Labels whose crc32(doc_id) mod 3 is 1 are never used. Of each class the labels of the smallest
    hashes are taken, up to its share of ``bound``. The last of these hashes is found digit by digit: the driver sees
    how many labels of a class have each of 1024 next digits behind the digits found so far, so the
    cut is as fine for any number of labels. The chosen labels are broadcast; of documents with one id the least text
    counts.
    """
    usable = (
        labels.where("doc_id is not null and toxic is not null")
        .where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("c", (F.col("toxic") > 0).cast("int"))
        .withColumn("h", F.xxhash64("doc_id"))
    )
    sizes = {r.c: r.n for r in usable.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    due = quotas(sizes, bound)
    upto = {c: 0 for c, n in due.items() if n < sizes[c]}  # digits found; classes taken as a whole have none
    taken, shift = dict.fromkeys(upto, 0), 64
    while shift > 4 and any(taken[c] < due[c] for c in upto):
        shift -= DIGIT
        digits = F.expr(f"shiftrightunsigned(h, {shift})")
        behind = [(F.col("c") == c) & (F.expr(f"shiftrightunsigned(h, {shift + DIGIT})") == x if shift + DIGIT < 64 else F.lit(True)) for c, x in upto.items() if taken[c] < due[c]]
        found: dict[int, list] = {}
        for r in usable.where(reduce(or_, behind)).groupBy("c", digits.alias("x")).agg(F.count(F.lit(1)).alias("n")).collect():  # 1024 rows a class at most
            found.setdefault(r.c, []).append((r.x, r.n))
        for c in upto:
            if taken[c] == due[c]:
                upto[c] <<= DIGIT
                continue
            upto[c] = max(x for x, _ in found[c]) + 1
            for x, n in sorted(found[c]):
                if taken[c] + n > due[c]:
                    upto[c] = x
                    break
                taken[c] += n
    digits = F.expr(f"shiftrightunsigned(h, {shift})") if shift < 64 else F.lit(0).cast("long")
    cut = [(F.col("c") == c) & (digits < upto[c] if c in upto else F.lit(True)) for c in due]
    chosen = usable.where(reduce(or_, cut, F.lit(False))).select("doc_id", "toxic")
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return held.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def train(
    docs: DataFrame, labels: DataFrame, bound: int = 20_000, features: int = 1 << 14, alpha: float = 1.0, strength: float = 1e-4,
    iterations: int = 40,
) -> tuple[np.ndarray, float]:
    """``(weight per bucket, bias)``, not a number where a bucket is no feature; ``bound`` labelled rows and ``features`` features at most.

    Both classes weigh the same. Without both among the labels there is no feature and the bias is the
    smoothed log-odds of the labels (none: strongly negative). Labels that are null or have
    no document, repeated labels (the greatest counts) and repeated documents are harmless;
    null text counts as empty; ties among features go to the smaller bucket.
    """
    weights = np.full(1 << BITS, np.nan, dtype=np.float32)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 << BITS), dtype=np.int32)
        rows = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                sums[int(toxic > 0)][ngram_buckets(text)] += 1
                rows[int(toxic > 0)] += 1
        at = np.flatnonzero(sums.any(axis=0))
        yield pd.DataFrame({"f": np.append(at, -1), "neg": np.append(sums[0][at], rows[0]), "pos": np.append(sums[1][at], rows[1])})

    sample = durable(labelled_sample(docs, labels, bound))
    counts = sample.mapInPandas(counted, "f long, neg long, pos long").groupBy("f").agg(
        F.sum("neg").alias("neg"), F.sum("pos").alias("pos")
    )
    counts = durable(counts)
    rows = counts.where("f = -1").collect()
    neg, pos = (rows[0].neg, rows[0].pos) if rows else (0, 0)
    if not neg or not pos:
        return weights, float(np.log((pos + 0.01) / (neg + 1)))
    ratio = F.log(((F.col("pos") + alpha) / (pos + 2 * alpha)) / ((F.col("neg") + alpha) / (neg + 2 * alpha)))
    top = (
        counts.where("f >= 0 and neg + pos >= 3")
        .select("f", ratio.alias("r"))
        .coalesce(4)  # 2**BITS rows at most, whatever the corpus; every task sends its own best to the driver
        .orderBy(F.abs("r").desc(), "f")
        .limit(features)
        .collect()
    )
    index = np.array([x.f for x in top], dtype=np.int64)
    ratios = np.array([x.r for x in top])
    order = np.argsort(index)
    index, ratios = index[order], ratios[order]

    @F.pandas_udf("array<string>")
    def present(texts: pd.Series) -> pd.Series:
        return pd.Series([index[np.isin(index, ngram_buckets(t), assume_unique=True)].astype(str) for t in texts], dtype=object)

    label = (F.col("toxic") > 0).cast("double")
    weight = F.when(label > 0, F.lit(neg / pos)).otherwise(1.0)
    sparse = durable(sample.select(label.alias("label"), weight.alias("weight"), present("text").alias("found")))
    presence = CountVectorizerModel.from_vocabulary([str(f) for f in index.tolist()], inputCol="found", outputCol="has", binary=True)
    unit = Normalizer(inputCol="has", outputCol="unit", p=2.0)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(ratios), inputCol="unit", outputCol="x")
    fitted = LogisticRegression(
        maxIter=iterations, regParam=strength, standardization=False, featuresCol="x", labelCol="label", weightCol="weight",
        aggregationDepth=2,
    ).fit(scaled.transform(unit.transform(presence.transform(sparse))).select("label", "weight", "x"))
    weights[index] = fitted.coefficients.toArray() * ratios
    return weights, float(fitted.intercept)


def score(docs: DataFrame, weights: np.ndarray, bias: float, text: str = "text") -> DataFrame:
    """Input columns plus ``score``, the probability of a toxic text.

    Null text counts as empty; texts of any length are read whole, ``_STEP`` characters at a time; an input
    column named ``score`` is replaced; repeated rows get equal scores; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS floats, whatever the corpus

    @F.pandas_udf("double")
    def rated(texts: pd.Series) -> pd.Series:
        z = np.full(len(texts), bias)
        for i, text in enumerate(texts):
            w = shared.value[ngram_buckets(text)]
            w = w[~np.isnan(w)]
            z[i] += w.sum(dtype=np.float64) / np.sqrt(max(len(w), 1))
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return docs.withColumn("score", rated(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    weights, bias = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, weights, bias).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored 0.7 or more go.

    All columns, of any name, stay; null and empty texts have the bias alone and stay;
    repeated rows get one verdict; an empty table gives an empty result.
    """
    weights, bias = train(docs, read_table(spark, sf_dir, "labels"))
    return restore(score(carry(docs, "text"), weights, bias).where("score < 0.7"), docs.columns)
