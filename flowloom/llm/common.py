"""Shared pieces of the training-data operators: table access, durable cuts, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: A word is a maximal run of characters other than ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a finished step left in the shared folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def carry(docs: DataFrame, *used: str) -> DataFrame:
    """The columns an operator works on, and the whole input row as the struct ``_row``.

    Extra columns of any name can so neither clash with an operator's own nor get lost.
    """
    return docs.select(*used, F.struct(*docs.columns).alias("_row"))


def restore(df: DataFrame, columns: list[str], **new) -> DataFrame:
    """The columns of the input row again, those in ``new`` replaced."""
    return df.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in columns])


def min_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list as rows ``(node, component)``.

    Every round maps each node to the smallest node of its closed neighbourhood
    and contracts the graph along that map; a round removes every node that has a
    smaller neighbour, so the number of rounds is logarithmic in practice. Each
    step is an equi-join against a table that is unique on the join key, so a hub
    holding a third of all edges is split by the skew-join rule, and the minimum
    is pre-aggregated before its shuffle. ``component`` is the smallest node id
    reachable. Self loops, repeated and null edges are ignored; an empty edge
    list gives an empty result.
    """
    cur = (
        edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    cur = durable(cur)
    label = None
    while not cur.isEmpty():
        both = cur.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            cur.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        step = durable(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("to")))
        if label is None:
            label = step.select("node", F.col("to").alias("component"))
        else:
            nxt = step.select(F.col("node").alias("component"), F.col("to"))
            label = label.join(nxt, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        cur = (
            cur.join(step.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
            .distinct()
        )
        cur = durable(cur)
    if label is None:
        kind = edges.schema[a].dataType
        return edges.sparkSession.createDataFrame([], "node long, component long").select(
            F.col("node").cast(kind), F.col("component").cast(kind)
        )
    return durable(label)
