"""Flow tables: CSV source, schema checks, sampling, feature configuration, JSON and CSV sinks, adapter view."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Total order of flows: time first, then whatever makes rows distinct.
ORDER = ["ts_ms", "flow_key", "line_no", "dst", "src"]

#: Columns of a raw flow file by type (fixed names of the NetFlow v3 layout).
RAW_STRINGS = ["IPV4_SRC_ADDR", "IPV4_DST_ADDR", "Attack"]
RAW_LONGS = ["FLOW_START_MILLISECONDS", "FLOW_END_MILLISECONDS"]
RAW_INTS = ["Label", "L4_SRC_PORT", "L4_DST_PORT", "PROTOCOL", "TCP_FLAGS", "CLIENT_TCP_FLAGS", "SERVER_TCP_FLAGS"]
RAW_DOUBLES = [
    "L7_PROTO", "IN_BYTES", "IN_PKTS", "OUT_BYTES", "OUT_PKTS", "FLOW_DURATION_MILLISECONDS", "DURATION_IN", "DURATION_OUT",
    "MIN_TTL", "MAX_TTL", "LONGEST_FLOW_PKT", "SHORTEST_FLOW_PKT", "MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN",
    "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES", "SRC_TO_DST_AVG_THROUGHPUT", "DST_TO_SRC_AVG_THROUGHPUT",
    "RETRANSMITTED_IN_BYTES", "RETRANSMITTED_IN_PKTS", "RETRANSMITTED_OUT_BYTES", "RETRANSMITTED_OUT_PKTS",
    "NUM_PKTS_UP_TO_128_BYTES", "NUM_PKTS_128_TO_256_BYTES", "NUM_PKTS_256_TO_512_BYTES", "NUM_PKTS_512_TO_1024_BYTES",
    "NUM_PKTS_1024_TO_1514_BYTES", "TCP_WIN_MAX_IN", "TCP_WIN_MAX_OUT", "ICMP_TYPE", "ICMP_IPV4_TYPE", "DNS_QUERY_ID",
    "DNS_QUERY_TYPE", "DNS_TTL_ANSWER", "FTP_COMMAND_RET_CODE", "SRC_TO_DST_IAT_MIN", "SRC_TO_DST_IAT_MAX",
    "SRC_TO_DST_IAT_AVG", "SRC_TO_DST_IAT_STDDEV", "DST_TO_SRC_IAT_MIN", "DST_TO_SRC_IAT_MAX", "DST_TO_SRC_IAT_AVG",
    "DST_TO_SRC_IAT_STDDEV",
]


def raw_schema() -> T.StructType:
    kinds = ((RAW_STRINGS, T.StringType()), (RAW_LONGS, T.LongType()), (RAW_INTS, T.IntegerType()), (RAW_DOUBLES, T.DoubleType()))
    return T.StructType([T.StructField(name, kind) for names, kind in kinds for name in names])


def read_flow_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Flow files with a header; columns are found by name, those absent from a file are left out.

    Only the header line is looked at ahead of the scan; nothing is inferred from data.
    """
    schema = schema or raw_schema()
    names = spark.read.option("header", True).csv(path).columns
    known = {f.name: f.dataType for f in schema}
    exact = T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in names])
    return spark.read.option("header", True).schema(exact).csv(path)


def check_columns(df: DataFrame, needed: list[str]) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def load_feature_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    return {key: config.get(key, []) for key in ("numeric_features", "log_features", "l7_proto_buckets")}


def stratified_sample(df: DataFrame, label: str, size: int, seed: int, key: list[str]) -> DataFrame:
    """Exactly ``min(rows of the class, size // classes)`` rows per class, chosen by a seeded hash of ``key``.

    Counts per range of hashes (65,536 at most for a class) tell in which range a class's share ends; all rows before it are
    taken, and only that range is sorted.
    """
    classes = df.select(F.count_distinct(label).alias("_classes"))
    hashed = df.where(F.col(label).isNotNull()).withColumn("_hash", F.xxhash64(F.lit(seed), *key)).withColumn("_range", F.shiftright("_hash", 48))
    counts = hashed.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(classes))  # one row
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.expr(f"{size} div _classes") - F.col("_before")
    ends = counts.withColumn("_before", before).where(wanted > 0).groupBy(label).agg(F.max(F.struct(F.col("_range").alias("end"), wanted.alias("wanted"))).alias("_end"))
    near = hashed.join(F.broadcast(ends), label).where("_range <= _end.end")  # one row per class
    rank = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_hash", *key))
    last = near.where("_range = _end.end").withColumn("_rank", rank).where("_rank <= _end.wanted").drop("_rank")
    return near.where("_range < _end.end").unionByName(last).select(*df.columns)


def write_kb(kb: DataFrame, path: str) -> None:
    kb.withColumn("cluster", F.col("cluster").cast("string")).write.mode("overwrite").json(path)


KB_SCHEMA = (
    "cluster string, behaviour_scores map<string,double>, tactic_scores map<string,double>, primary_behaviour string, "
    "primary_tactic string, cluster_size bigint, cluster_proportion double, cluster_features map<string,double>, p_gmm double"
)


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KB_SCHEMA).json(path).withColumn("cluster", F.col("cluster").cast("int"))


def save_model(parts: dict[str, DataFrame], config: dict, path: str) -> None:
    """Tables as Parquet under ``path``; the configuration as one JSON row."""
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = part.sparkSession
    spark.createDataFrame([(json.dumps(config),)], "config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")


def load_model(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    config = json.loads(spark.read.parquet(f"{path}/config").first()[0])
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}, config


def write_metrics(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers; aggregated tables make one small file, and nothing is forced into one task."""
    df.write.mode("overwrite").option("header", True).csv(path)


def held_out(df: DataFrame, label: str, mapping: dict[str, str]) -> DataFrame:
    """Labels of another data set in this one's terms; rows out of scope stay as context with ``in_scope`` false."""
    key = F.lower(F.trim(label))
    mapped = F.coalesce(*[F.when(key == k.lower(), F.lit(v)) for k, v in mapping.items()])
    return df.withColumns({label: F.coalesce(mapped, F.col(label)), "in_scope": mapped.isNotNull()})


def flow_lines(spark: SparkSession, sf_dir: str, duration: bool = False) -> DataFrame:
    """The rows behind ``flows``, joined with orders where ``duration`` is asked for; short columns, worth writing where they are read more than once."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if not duration:
        return line
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return line.join(orders, "l_orderkey")


def flows(spark: SparkSession, sf_dir: str, duration: bool = False, lines: DataFrame | None = None, *columns: str) -> DataFrame:
    """Flow view over the order tables, or over ``lines`` of ``flow_lines`` with their ``columns``; the join with orders is made only where ``duration`` is asked for."""
    line = flow_lines(spark, sf_dir, duration) if lines is None else lines
    ms = lambda c: F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")
    attack = (
        F.when(F.col("l_returnflag") == "N", "Benign")
        .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "DDoS")
        .when(F.col("l_returnflag") == "A", "DoS")
        .when(F.col("l_linestatus") == "F", "Reconnaissance")
        .otherwise("Theft")
    )
    protocol = F.get(F.array(F.lit(6), F.lit(17), F.lit(1), F.lit(47)), F.col("l_linenumber") % 4)
    return line.select(
        F.col("l_suppkey").alias("src"),
        F.col("l_partkey").alias("dst"),
        F.col("l_orderkey").alias("flow_key"),
        F.col("l_linenumber").alias("line_no"),
        ms("l_shipdate").alias("ts_ms"),
        F.col("l_extendedprice").alias("in_bytes"),
        F.col("l_quantity").alias("in_pkts"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("out_bytes"),
        F.floor(F.col("l_quantity") * (F.lit(1.0) - F.col("l_tax"))).cast("double").alias("out_pkts"),
        *([F.abs(ms("l_shipdate") - ms("o_orderdate")).cast("double").alias("duration_ms")] if duration else []),
        F.expr("(l_partkey * 7919) % 65536").cast("int").alias("dst_port"),
        F.expr("(l_orderkey * 31) % 65536").cast("int").alias("src_port"),
        protocol.alias("protocol"),
        (F.col("l_orderkey") % 32).cast("int").alias("tcp_flags"),
        F.get(F.array(F.lit(0.0), F.lit(64.0), F.lit(128.0)), (F.col("l_suppkey") % 3).cast("int")).alias("min_ttl"),
        F.expr("(l_partkey % 10)").cast("double").alias("l7_proto"),
        F.expr("l_orderkey % 3").cast("double").alias("icmp_type"),
        (F.col("l_quantity") * 73.0).alias("iat_max"),
        (F.col("l_quantity") * 29.0).alias("iat_avg"),
        (F.col("l_quantity") * 17.0).alias("iat_std"),
        F.expr("(l_orderkey * 257) % 16384").cast("double").alias("tcp_win_in"),
        F.least(F.lit(1514.0), F.col("l_extendedprice") / F.greatest(F.col("l_quantity"), F.lit(1.0))).alias("longest_pkt"),
        attack.alias("attack"),
        *columns,
    )


#: The same view for SQL engines.
FLOWS_SQL = """
flows AS (
  SELECT l_suppkey AS src, l_partkey AS dst, l_orderkey AS flow_key, l_linenumber AS line_no,
         epoch_ms(l_shipdate) AS ts_ms, l_extendedprice AS in_bytes, l_quantity AS in_pkts,
         l_extendedprice * l_discount AS out_bytes, floor(l_quantity * (1 - l_tax)) AS out_pkts,
         CAST(abs(epoch_ms(l_shipdate) - epoch_ms(o_orderdate)) AS DOUBLE) AS duration_ms,
         CAST((l_partkey * 7919) % 65536 AS INTEGER) AS dst_port, CAST((l_orderkey * 31) % 65536 AS INTEGER) AS src_port,
         CASE l_linenumber % 4 WHEN 0 THEN 6 WHEN 1 THEN 17 WHEN 2 THEN 1 ELSE 47 END AS protocol,
         CAST(l_orderkey % 32 AS INTEGER) AS tcp_flags,
         CAST(CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 64 ELSE 128 END AS DOUBLE) AS min_ttl,
         CAST(l_partkey % 10 AS DOUBLE) AS l7_proto, CAST(l_orderkey % 3 AS DOUBLE) AS icmp_type,
         l_quantity * CAST(73 AS DOUBLE) AS iat_max, l_quantity * CAST(29 AS DOUBLE) AS iat_avg, l_quantity * CAST(17 AS DOUBLE) AS iat_std,
         CAST((l_orderkey * 257) % 16384 AS DOUBLE) AS tcp_win_in,
         least(CAST(1514 AS DOUBLE), l_extendedprice / greatest(l_quantity, CAST(1 AS DOUBLE))) AS longest_pkt,
         CASE WHEN l_returnflag = 'N' THEN 'Benign' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'DDoS'
              WHEN l_returnflag = 'A' THEN 'DoS' WHEN l_linestatus = 'F' THEN 'Reconnaissance' ELSE 'Theft' END AS attack
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
