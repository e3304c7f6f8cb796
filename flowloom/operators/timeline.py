"""Global order, splits, balancing and cross-split duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import durable, written  # noqa: F401  callers take durable from here

#: Classes whose starts are sent to every task (a few MB); more are joined by key.
FEW = 500_000
#: Copies of a class that one task draws.
DRAWN = 100_000


def numbered(df: DataFrame, order: list[str], name: str, tasks: int | None = None) -> DataFrame:
    """``df`` with ``name``, its dense position from 0 in the total order ``order`` (nulls first), and cut lineage.

    Range bounds come from the data and from all of ``order``, so one busy day, or one
    instant, is as many tasks as its rows need: each of ``tasks`` (default: the session's
    shuffle partitions) sorts its share. Rows are written once, sorted; only the sizes of
    the tasks, one row each, are summed in one place. Rows equal in all of ``order`` keep together.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = written(spread.withColumn("_at", F.monotonically_increasing_id()))
    task, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    joined = placed.join(F.broadcast(offsets), task == F.col("_task"))  # one row per task
    return joined.withColumn(name, F.col("_o") + inside).drop("_at", "_task", "_o")


def positions(df: DataFrame, order: list[str], tasks: int | None = None) -> DataFrame:
    """Dense position ``pos`` from 0 in the total order ``order``, by range partitions."""
    return numbered(df, order, "pos", tasks)


def chronological_split(df: DataFrame, label: str, order: list[str], test: float = 0.15, gap: float = 0.05) -> DataFrame:
    """Adds ``split``: per class the last rows are test, those before them gap, the rest train.

    A class whose test part rounds to nothing, or that leaves no row for training, is
    train as a whole. Class sizes come from one small aggregate; a large class is sorted in parallel.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = class_rank(df, label, order).join(F.broadcast(sizes), label)  # one row per class
    n_test, n_gap = F.bround(F.col("_n") * test), F.bround(F.col("_n") * gap)
    whole = (n_test == 0) | (F.col("_n") - n_test - n_gap <= 0)
    place = (
        F.when(whole, "train")
        .when(F.col("_rank") > F.col("_n") - n_test, "test")
        .when(F.col("_rank") > F.col("_n") - n_test - n_gap, "gap")
        .otherwise("train")
    )
    return ranked.withColumn("split", place).drop("_rank", "_n")


def class_rank(df: DataFrame, label: str, order: list[str], tasks: int | None = None) -> DataFrame:
    """Adds ``_rank``, the position from 1 within the class in ``order``; rows without a class are left out.

    One order by (class, ``order``) serves all classes, so that a class of any size is cut into
    ranges; a class starts at its smallest position.
    """
    placed = numbered(df.where(F.col(label).isNotNull()), [label, *order], "_i", tasks)
    starts = placed.groupBy(label).agg(F.min("_i").alias("_o"))
    if starts.limit(FEW + 1).count() <= FEW:  # counted from the written order; a join by key would hold a class in one task
        starts = F.broadcast(starts)
    return placed.join(starts, label).withColumn("_rank", F.col("_i") - F.col("_o") + 1).drop("_i", "_o")


def without_cross_duplicates(test: DataFrame, train: DataFrame, columns: list[str], decimals: int = 6) -> DataFrame:
    """Test rows whose rounded values occur in no train row; copies within test stay. Nulls compare equal."""
    key = F.struct(*[F.round(F.col(c).cast("double"), decimals).alias(c) for c in columns])
    seen = train.select(F.xxhash64(key).alias("_h"), key.alias("_k")).distinct()
    keyed = test.withColumn("_h", F.xxhash64(key)).withColumn("_k", key)
    same = [keyed["_h"] == seen["_h"], keyed["_k"].eqNullSafe(seen["_k"])]
    return keyed.join(seen, same, "left_anti").drop("_h", "_k")


def target_sizes(counts: DataFrame, label: str, total: int, cap: int, floor: int, oversample: bool = True) -> DataFrame:
    """``(label, n, target)``: capped, raised to the floor, and scaled down above ``total`` keeping the floor."""
    goal = F.least(F.col("n"), F.lit(cap))
    if oversample:
        goal = F.greatest(goal, F.lit(floor))
    sized = counts.withColumn("target", goal.cast("long"))
    sums = sized.agg(F.sum("target").alias("_t"))
    scaled = F.greatest((F.col("target") * F.lit(total) / F.col("_t")).cast("long"), F.least(F.col("target"), F.lit(floor)))
    out = sized.crossJoin(F.broadcast(sums))  # one row
    return out.select(label, "n", F.when(F.col("_t") > total, scaled).otherwise(F.col("target")).alias("target"))


def strided(df: DataFrame, label: str, order: list[str], targets: DataFrame, seed: int = 42) -> DataFrame:
    """Evenly strided rows per class; a class below its target adds hash-chosen copies (``copy_no`` > 0).

    Copies are drawn in pieces of ``DRAWN`` over many tasks and meet their rows by a sorted join, however many they are.
    """
    ranked = class_rank(df, label, order).join(F.broadcast(targets), label)  # one row per class
    n, k, at = F.col("n"), F.col("target"), F.col("_rank") - 1
    # the i-th sample sits at floor(i * (n - 1) / (k - 1)); a row is taken if some i lands on it
    first = F.ceil(at * (k - 1) / F.greatest(n - 1, F.lit(1)))
    lands = F.when(k == 1, at == 0).otherwise((first < k) & (F.floor(first * (n - 1) / (k - 1)) == at))
    chosen = ranked.where((k >= n) | lands).withColumn("copy_no", F.lit(0))
    pieces = targets.where("target > n").select(label, F.col("n").alias("_n"), (F.col("target") - F.col("n")).alias("_m"), F.explode(F.expr(f"sequence(0L, (target - n - 1) div {DRAWN})")).alias("_c"))
    drawn = F.sequence(F.col("_c") * DRAWN + 1, F.least((F.col("_c") + 1) * DRAWN, F.col("_m")))
    extra = pieces.repartition(label, "_c").select(label, "_n", F.explode(drawn).alias("copy_no"))
    picks = extra.select(label, "copy_no", F.pmod(F.xxhash64(F.lit(seed), F.col(label), "copy_no"), F.col("_n")).alias("_p")).hint("merge")  # estimated as small as the targets, yet as many as the copies
    copies = ranked.where("target > n").withColumn("_p", F.col("_rank") - 1).join(picks, [label, "_p"]).drop("_p")
    return chosen.unionByName(copies).drop("_rank", "n", "target")


def preparation_gaps(saved: dict, features: list[str], stats: DataFrame, test: DataFrame, train: DataFrame, key: list[str]) -> DataFrame:
    """One row ``(same_features, scaler_gap, shared)``: is an evaluation prepared as the training was?

    ``saved`` has the training's ``features`` in order and its scaler ``stats``; ``scaler_gap`` is the largest difference of a
    mean from the saved one in saved deviations; ``shared`` counts test rows whose ``key`` occurs in the training.
    """
    both = saved["stats"].crossJoin(stats.select(*[F.col(f"_m_{c}").alias(f"_now_{c}") for c in features]))  # one row each
    gap = F.greatest(*[F.abs(F.col(f"_now_{c}") - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in features], F.lit(0.0))
    shared = test.select(*key).join(train.select(*key), key, "left_semi").agg(F.count(F.lit(1)).alias("shared"))
    return both.select(F.lit(list(saved["features"]) == list(features)).alias("same_features"), gap.alias("scaler_gap")).crossJoin(shared)  # one row each


def check_preparation(gaps: DataFrame, tolerance: float = 1e-5) -> None:
    """Raises where ``preparation_gaps`` says that features, scaler or rows are not those of the training."""
    row = gaps.first()
    if not row.same_features:
        raise RuntimeError("features differ from the training's")
    if row.scaler_gap > tolerance:
        raise RuntimeError(f"scaler differs from the training's by {row.scaler_gap:g} deviations")
    if row.shared:
        raise RuntimeError(f"{row.shared} test rows occur in the training")


def ip_overlap(test: DataFrame, train: DataFrame, ip: str, label: str) -> DataFrame:
    """Share of test flows whose source occurs in train, per label and overall (null label)."""
    seen = train.select(ip).distinct().withColumn("_seen", F.lit(1))
    flagged = test.join(seen, ip, "left")
    return flagged.rollup(label).agg(F.count(F.lit(1)).alias("flows"), F.avg(F.coalesce("_seen", F.lit(0))).alias("share"))


def chunk(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """``chunk`` 0..n-1 in order, the first ``rows mod n`` chunks one row longer."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    placed = positions(df, order).crossJoin(F.broadcast(total))  # one row
    size, long = F.expr(f"_n div {n}"), F.col("_n") % n
    early = F.floor(F.col("pos") / (size + 1))
    late = long + F.floor((F.col("pos") - long * (size + 1)) / F.greatest(size, F.lit(1)))
    return placed.withColumn("chunk", F.when(F.col("pos") < long * (size + 1), early).otherwise(late).cast("int")).drop("_n")


def leave_out(df: DataFrame, label: str, held: Column | str) -> DataFrame:
    return df.where(~F.col(label).eqNullSafe(F.lit(held) if isinstance(held, str) else held))
