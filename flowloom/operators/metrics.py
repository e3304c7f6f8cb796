"""Evaluation metrics as aggregations over small contingency tables or cumulative counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: Blocks of a silhouette while their rows may grow, rows and sums (rows x clusters) of the widest block, tasks that its tiles are dealt to at least.
BLOCKS, WIDEST, CELLS, TASKS = 24, 32_768, 1 << 22, 300


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))


def prf(counts: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label of a confusion table; an empty denominator gives 0.

    ``labels``: the labels that are reported, those that never occur with zeros; default all that occur.
    """
    if labels is not None:
        spark = counts.sparkSession
        blank = spark.createDataFrame([(x, x, 0) for x in labels], "true_label string, pred_label string, n long")
        each = prf(counts.select("true_label", "pred_label", "n").unionByName(blank))
        return each.where(F.col("label").isin(labels))
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    by_true = counts.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_pred = counts.groupBy(F.col("pred_label").alias("label")).agg(F.sum("n").alias("predicted"))
    both = by_true.join(by_pred, "label", "full_outer").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "predicted", "tp")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = both.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(counts: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1 in one row."""
    each = prf(counts)
    return each.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1")
    )


def nmi_ari(counts: DataFrame) -> DataFrame:
    """Normalised mutual information (arithmetic mean) and adjusted Rand index of a contingency table."""
    a, b = Window.partitionBy("true_label"), Window.partitionBy("pred_label")
    pairs = lambda x: x * (x - 1) / 2.0
    # sums per label and overall come from the table itself, which has one row per pair of labels
    cells = counts.withColumn("a", F.sum("n").over(a)).withColumn("b", F.sum("n").over(b)).withColumn("t", F.sum("n").over(Window.partitionBy()))
    n, t = F.col("n"), F.col("t")
    agg = cells.agg(
        F.sum(n / t * F.log(n * t / (F.col("a") * F.col("b")))).alias("mi"),
        (-F.sum(n / t * F.log(F.col("a") / t))).alias("ht"), (-F.sum(n / t * F.log(F.col("b") / t))).alias("hp"),
        F.sum(pairs(n)).alias("s"), F.sum(n / F.col("a") * pairs(F.col("a"))).alias("sa"), F.sum(n / F.col("b") * pairs(F.col("b"))).alias("sb"), F.max(pairs(t)).alias("st"),
    )
    expected, most = F.col("sa") * F.col("sb") / F.col("st"), (F.col("sa") + F.col("sb")) / 2
    half = (F.col("ht") + F.col("hp")) / 2
    return agg.select(
        F.when(half > 0, F.col("mi") / half).otherwise(1.0).alias("nmi"), F.when(most - expected == 0, 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("ari")
    )


def roc_auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """``(auc, average_precision)`` from counts per distinct score; tied scores share a rank; one class only gives nulls.

    Scores are counted first; the running sums go over distinct scores, in parallel
    per leading digits of the score with offsets from a small table.
    """
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("q", F.col("n") - F.col("p")).withColumn("bin", F.floor(F.col("s") * 64))
    bins = per.groupBy("bin").agg(F.sum("p").alias("bp"), F.sum("q").alias("bq"))
    above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select("bin", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("op"), F.coalesce(F.sum("bq").over(above), F.lit(0)).alias("oq"))
    inner = Window.partitionBy("bin").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = per.join(offsets, "bin").withColumn("tp", F.col("op") + F.sum("p").over(inner)).withColumn("fp", F.col("oq") + F.sum("q").over(inner))
    out = run.agg(
        F.sum("p").alias("P"), F.sum("q").alias("N"),
        F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0)).alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
    )
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return out.select(F.when(both, F.col("area") / (F.col("P") * F.col("N"))).alias("auc"), F.when(both, F.col("ap") / F.col("P")).alias("average_precision"))


def distribution_metrics(pairs: DataFrame, keys: list[str], eps: float = 1e-8) -> DataFrame:
    """Soft Jaccard, cosine, KL(true | pred), top-1 and coverage per key from long ``(label, t, p)`` over one label list.

    Ties of the top labels go to the alphabetically first one; a zero vector has cosine 0.
    """
    t, p = F.col("t"), F.col("p")
    low = lambda c: F.max_by("label", F.struct(c, -F.col("_o")))
    ranked = pairs.withColumn("_o", F.row_number().over(Window.partitionBy(*keys).orderBy("label")))
    agg = ranked.groupBy(*keys).agg(
        (F.sum(F.least(t, p)) / F.sum(F.greatest(t, p))).alias("soft_jaccard"),
        F.sum(t * p).alias("tp"), F.sum(t * t).alias("tt"), F.sum(p * p).alias("pp"),
        F.sum(F.when(t > 0, t * F.log((t + eps) / (p + eps))).otherwise(0.0)).alias("kl"),
        low(t).alias("true_top"), low(p).alias("pred_top"),
        F.sum(F.when(p > 0, t).otherwise(0.0)).alias("coverage"),
    )
    norm = F.sqrt(F.col("tt") * F.col("pp"))
    return agg.select(
        *keys, F.coalesce("soft_jaccard", F.lit(0.0)).alias("soft_jaccard"), F.when(norm > 0, F.col("tp") / norm).otherwise(0.0).alias("cosine"), "kl",
        (F.col("true_top") == F.col("pred_top")).cast("int").alias("top1"), "coverage",
    )


def set_jaccard(a, b):
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def multilabel(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall and F1 per label of two set columns, for labels that occur in either."""
    a = df.select(F.explode(F.array_distinct(true)).alias("label"), "*").select("label", F.lit(1).alias("t"), F.array_contains(pred, F.col("label")).cast("int").alias("p"))
    b = df.select(F.explode(F.array_distinct(pred)).alias("label"), "*").where(~F.array_contains(true, F.col("label"))).select("label", F.lit(0).alias("t"), F.lit(1).alias("p"))
    agg = a.union(b).groupBy("label").agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum((1 - F.col("t")) * F.col("p")).alias("fp"), F.sum(F.col("t") * (1 - F.col("p"))).alias("fn"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.select("label", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def silhouette(df: DataFrame, key: str, vector: str, cluster: str, rows: int | None = 5000, block: int = 2048) -> DataFrame:
    """Mean silhouette of at most ``rows`` hash-chosen rows (the bound of this sampling metric), of all rows if that is None.

    Rows are dealt into blocks, and every pair of blocks is one group: one row of sums of distances per row and tile
    is what leaves it. The work is quadratic in the rows, the memory of a task is not. A row is sent to each of its tiles:
    from ``block`` rows each, blocks grow and not their number, up to ``WIDEST`` rows or ``CELLS`` sums in one.
    """
    s = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.col(cluster).isNotNull())
    if rows is not None:
        s = s.orderBy(F.xxhash64(key), key).limit(rows)
    kind = "float" if s.schema[vector].dataType.simpleString() == "array<float>" else "double"  # sent as narrow as they are, summed in double
    s = written(s.select(F.col(key).alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"), F.col(cluster).alias("c")))
    kinds = {f.name: f.dataType.simpleString() for f in s.schema}
    n, clusters = s.agg(F.count(F.lit(1)), F.count_distinct("c")).first()
    widest = max(block, min(WIDEST, CELLS // max(1, clusters)))
    blocks = max(1, min(-(-n // block), BLOCKS), -(-n // widest))
    dealt = s.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = dealt.select("id", "v", "c", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    tasks = min(blocks * (blocks + 1) // 2, max(TASKS, int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    tiles = tiles.withColumn("t", F.expr(f"cast((j * (j + 1L) div 2 + i) % {tasks} AS int)")).repartitionById(tasks, "t")  # small inputs are much work: no tasks are joined
    sums = tiles.groupBy("t", "i", "j").applyInArrow(_tile_sums, f"id {kinds['id']}, c {kinds['c']}, oc array<{kinds['c']}>, s array<double>, n array<bigint>")
    near = sums.repartition("id").select("id", "c", F.inline(F.arrays_zip("oc", "s", "n"))).groupBy("id", "c", "oc").agg((F.sum("s") / F.sum("n")).alias("d"))
    own = F.max(F.when(F.col("c") == F.col("oc"), F.col("d")))
    each = near.groupBy("id").agg(own.alias("a"), F.min(F.when(F.col("c") != F.col("oc"), F.col("d"))).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg(F.avg(value).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def _tile_sums(rows: pa.Table) -> pa.Table:
    """Sums and numbers of distances from each row of two blocks to the other block's clusters (of one block: to its own, a row's own id left out)."""
    rows = rows.combine_chunks()
    one = rows["i"][0] == rows["j"][0]
    vectors = rows["v"].combine_chunks()
    x = np.asarray(vectors.flatten(), dtype=float).reshape(len(vectors), len(vectors.flatten()) // len(vectors))
    codes = rows["c"].combine_chunks().dictionary_encode()
    names, at = codes.dictionary, codes.indices.to_numpy()
    side = rows["b"].to_numpy() != rows["i"][0].as_py()
    order = np.lexsort((at, side))
    order = order[~np.isnan(x[order]).any(axis=1)]  # distances from null components count for nothing
    x, at, m = x[order], at[order], len(order) - int(side[order].sum())
    rows = rows.select(["id", "c"]).take(pa.array(order))
    ids = rows["id"].combine_chunks().dictionary_encode().indices.to_numpy() if one else None
    right = slice(0, m) if one else slice(m, len(x))
    totals = np.zeros((len(x), len(names)))
    counts = np.zeros((len(x), len(names)), dtype=np.int64)

    def parts(of: slice, size: int):
        """Pieces of sorted rows: their place, the starts of clusters in them and the clusters."""
        for lo in range(of.start, of.stop, size):
            piece = at[lo : min(lo + size, of.stop)]
            starts = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            yield slice(lo, lo + len(piece)), starts, piece[starts], np.diff(np.append(starts, len(piece)))

    theirs = list(parts(right, 1024))
    for p, starts, clusters, sizes in parts(slice(0, m), 256):
        for q, starts_q, clusters_q, sizes_q in theirs:
            d = _distances(x[p], x[q])
            out = np.isnan(d)
            if one:
                out |= ids[p, None] == ids[None, q]
            some = out.any()
            d[out] = 0.0
            rows_p, rows_q = np.arange(p.start, p.stop)[:, None], np.arange(q.start, q.stop)[:, None]
            totals[rows_p, clusters_q] += np.add.reduceat(d, starts_q, axis=1)
            counts[rows_p, clusters_q] += np.add.reduceat((~out).astype(np.int64), starts_q, axis=1) if some else sizes_q
            if not one:
                totals[rows_q, clusters] += np.add.reduceat(d, starts, axis=0).T
                counts[rows_q, clusters] += np.add.reduceat((~out).astype(np.int64), starts, axis=0).T if some else sizes
    r, g = np.nonzero(counts)
    has = np.bincount(r, minlength=len(x))
    ends = pa.array(np.concatenate(([0], np.cumsum(has[has > 0]))).astype(np.int32))
    whole = rows.take(pa.array(np.flatnonzero(has)))
    lists = [pa.ListArray.from_arrays(ends, values) for values in (names.take(pa.array(g)), pa.array(totals[r, g]), pa.array(counts[r, g]))]
    return pa.Table.from_arrays([whole["id"], whole["c"], *lists], ["id", "c", "oc", "s", "n"])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all pairs by products; where those cancel, or are not finite, by differences, some at a time."""
    with np.errstate(invalid="ignore", over="ignore"):
        scale = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
        square = x @ y.T
        square *= -2.0
        square += scale
        scale *= 1e-4
        near = ~(square >= scale)
        p, q = np.nonzero(near) if near.any() else ((), ())
        for k in range(0, len(p), 1 << 15):
            a, b = p[k : k + (1 << 15)], q[k : k + (1 << 15)]
            square[a, b] = ((x[a] - y[b]) ** 2).sum(1)
        return np.sqrt(square, out=square)


def fleiss_kappa(votes: DataFrame, item: str, label: str) -> DataFrame:
    """Agreement of equally many votes per item."""
    cells = votes.groupBy(item, label).agg(F.count(F.lit(1)).alias("n"))
    per = cells.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    p = per.agg(F.avg((F.col("sq") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("p"))
    total = votes.agg(F.count(F.lit(1)).alias("t"))
    e = cells.groupBy(label).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).agg(F.sum((F.col("n") / F.col("t")) ** 2).alias("e"))
    return p.crossJoin(e).select(F.when(F.col("e") < 1, (F.col("p") - F.col("e")) / (1 - F.col("e"))).otherwise(1.0).alias("kappa"))
