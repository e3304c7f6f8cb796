"""Baselines: K-means and Gaussian mixtures over a grid with majority labels, random forest, perceptron."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from . import metrics, mixture, variational


def with_features(df: DataFrame, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def clustered(df: DataFrame, vector: str, method: str, k: int, seed: int = 42) -> DataFrame:
    """Rows with ``cluster`` of a fitted K-means (``kmeans``) or diagonal Gaussian mixture (``gmm``), over all dimensions."""
    if method == "gmm":
        params = variational.fit_dirichlet_mixture(df.sparkSession, df, vector, components=k, rounds=10, starts=3, seed=seed)
        return mixture.posteriors(df.where(F.col(vector).isNotNull()), vector, params).select(*df.columns, "cluster")
    made = with_features(df, vector)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(made).transform(made).select(*df.columns, "cluster")


def majority_accuracy(counts: DataFrame) -> DataFrame:
    """One row from a table of ``(true_label, pred_label, n)``: clusters, purity, weighted purity, accuracy of majority labels."""
    rank = F.row_number().over(Window.partitionBy("pred_label").orderBy(F.col("n").desc(), "true_label"))
    each = counts.withColumn("_r", rank).withColumn("_n", F.sum("n").over(Window.partitionBy("pred_label"))).where("_r = 1")
    weighted = F.sum("n") / F.sum("_n")
    return each.agg(F.count(F.lit(1)).alias("clusters"), F.avg(F.col("n") / F.col("_n")).alias("purity"), weighted.alias("weighted_purity"), weighted.alias("accuracy"))


def clustering_grid(df: DataFrame, vector: str, label: str, grid: list[tuple[str, int]], key: str) -> DataFrame:
    """Per (method, k): active clusters, purities, majority accuracy, mutual information, sampled silhouette."""
    out = None
    for method, k in grid:
        found = written(clustered(df.select(key, vector, label), vector, method, k))  # assigned once, read by every metric
        counts = written(metrics.confusion(found, label, "cluster"))  # a small table
        row = (
            majority_accuracy(counts).crossJoin(metrics.nmi_ari(counts).select("nmi")).crossJoin(metrics.silhouette(found, key, vector, "cluster").select("silhouette"))  # one row each
            .select(F.lit(method).alias("method"), F.lit(k).alias("k"), "*")
        )
        out = row if out is None else out.unionByName(row)
    return out


def supervised(train: DataFrame, test: DataFrame, vector: str, label: str, method: str, seed: int = 42) -> DataFrame:
    """Test rows with ``prediction`` of a random forest (``forest``) or a perceptron (``perceptron``); labels are 0, 1, ..."""
    a, b = (with_features(x, vector).withColumn("_y", F.col(label).cast("double")) for x in (train, test))
    if method == "forest":
        model = RandomForestClassifier(labelCol="_y", featuresCol="features", numTrees=50, seed=seed)
    else:
        size, classes = a.agg(F.max(F.size(vector)), F.max("_y")).first()
        model = MultilayerPerceptronClassifier(labelCol="_y", featuresCol="features", layers=[size, 64, int(classes) + 1], seed=seed, maxIter=60)
    return model.fit(a).transform(b).select(*test.columns, F.col("prediction").cast(train.schema[label].dataType).alias("prediction"))
