"""Column functions over flow records: cleaning, encoding, ratios, classes, scores. Codegen only, no Python rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Lit = F.lit


def finite(c: Column) -> Column:
    """Infinite and NaN become null."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clean(df: DataFrame, identifiers: list[str], numeric: list[str]) -> DataFrame:
    """Rows without an identifier go; non-finite and null numbers become 0."""
    return df.dropna(subset=identifiers).withColumns({c: F.coalesce(finite(F.col(c)), Lit(0.0)) for c in numeric})


def port_bucket(port: Column) -> Column:
    p = F.least(F.greatest(port, Lit(0)), Lit(65535))
    return F.when(p <= 1023, "WELL_KNOWN").when(p <= 49151, "REGISTERED").otherwise("EPHEMERAL")


def protocol_name(protocol: Column) -> Column:
    return F.when(protocol == 6, "TCP").when(protocol == 17, "UDP").when(protocol == 1, "ICMP").otherwise("OTHER")


def one_hot(value: Column, values: list, prefix: str) -> list[Column]:
    return [F.coalesce((value == v).cast("int"), Lit(0)).alias(f"{prefix}{v}") for v in values]


def l7_one_hot(value: Column, buckets: list[float], prefix: str = "L7_") -> list[Column]:
    """One column per configured protocol, named by its integer form where integral, and one for the rest."""
    name = lambda b: str(int(b)) if float(b).is_integer() else str(b)
    known = [F.coalesce((value == Lit(float(b))).cast("int"), Lit(0)).alias(f"{prefix}{name(b)}") for b in buckets]
    other = F.coalesce((~value.isin([float(b) for b in buckets])).cast("int"), Lit(1)).alias(f"{prefix}OTHER")
    return [*known, other]


def log_scaled(c: Column) -> Column:
    return F.log1p(F.greatest(c, Lit(0.0)))


def log_restored(c: Column) -> Column:
    return F.expm1(F.greatest(c, Lit(0.0)))


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def packets_per_second(pkts: Column, duration_ms: Column) -> Column:
    return pkts / F.greatest(duration_ms / 1000.0, Lit(0.0001))


def bytes_per_packet(size: Column, pkts: Column) -> Column:
    return F.when(pkts > 0, size / pkts).otherwise(Lit(0.0))


def direction_ratio(out_bytes: Column, in_bytes: Column) -> Column:
    return (
        F.when(in_bytes > 0.01, F.least(F.greatest(out_bytes / in_bytes, Lit(0.0)), Lit(999.0)))
        .when(out_bytes > 0.01, Lit(999.0))
        .otherwise(Lit(1.0))
    )


#: Upper bounds and names of classes (fixed values).
VOLUME = [(100, "TINY"), (1000, "SMALL"), (10000, "MEDIUM"), (100000, "LARGE"), (None, "VERY_LARGE")]
DURATION = [(10, "VERY_SHORT (<10ms)"), (100, "SHORT (10-100ms)"), (1000, "MEDIUM (100ms-1s)"), (10000, "LONG (1-10s)"), (None, "VERY_LONG (>10s)")]
RATE = [(1, "VERY_LOW (<1 pps)"), (10, "LOW (1-10 pps)"), (100, "MODERATE (10-100 pps)"), (1000, "HIGH (100-1000 pps)"), (None, "VERY_HIGH (>1000 pps)")]
PACKET = [(64, "TINY (<64 bytes, SYN/ACK only)"), (256, "SMALL (64-256 bytes)"), (1024, "MEDIUM (256-1024 bytes)"), (None, "LARGE (>1024 bytes, data transfer)")]
Z_WORDS = [(0.5, "near average"), (1, "slightly"), (2, "notably"), (None, "strongly")]
FLAG_NAMES = ["FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR"]


def banded(c: Column, bands: list[tuple]) -> Column:
    out = None
    for bound, name in bands[:-1]:
        out = F.when(c < bound, name) if out is None else out.when(c < bound, name)
    return out.otherwise(bands[-1][1])


def z_word(z: Column) -> Column:
    return banded(F.abs(z), Z_WORDS)


def direction_class(ratio: Column, out_bytes: Column, out_pkts: Column) -> Column:
    return (
        F.when((out_bytes <= 0) & (out_pkts <= 0), "RECEIVE_ONLY")
        .when(ratio > 3.0, "OUTBOUND_HEAVY")
        .when(ratio < 0.33, "INBOUND_HEAVY")
        .otherwise("BALANCED")
    )


def tcp_flag_names(flags: Column) -> Column:
    """``FIN+SYN+...``; ``NONE`` without a flag."""
    bits = F.bround(flags.cast("double")).cast("int")
    named = F.concat_ws("+", *[F.when(bits.bitwiseAND(1 << i) != 0, name) for i, name in enumerate(FLAG_NAMES)])
    return F.when(named == "", "NONE").otherwise(named)


def syn_only(flags: Column) -> Column:
    return (flags.bitwiseAND(2) != 0) & (flags.bitwiseAND(16) == 0)


#: Weights of the heuristic behaviour scores on standardised features (fixed values).
HEURISTICS = {
    "scan": {"duration": -0.8, "out_bytes": -0.5, "small_pkts": 0.5, "fan_out": 1.0, "dst_well_known": 0.6, "icmp_active": 0.4},
    "flood": {"in_pkts": 0.7, "out_pkts": 0.7, "src_throughput": 0.8, "dst_throughput": 0.8, "duration": -0.5, "syn_only": 0.4, "fan_in": 0.6},
    "exfil": {"src_minus_dst_bps": 1.0, "out_bytes": 0.8, "longest_pkt": 0.6, "duration": 0.4, "fan_out": -0.3},
    "beacon": {"imbalance": -0.8, "duration": 0.8, "fan_out": -0.6, "fan_in": -0.4, "tcp": 0.3, "syn_only": -0.3},
    "lateral": {"n_peers": 0.8, "src_ephemeral": 0.5, "tcp": 0.4, "fan_out": 0.4, "fan_in": 0.4, "duration": -0.2},
}


def heuristic_scores(features: Mapping[str, Column]) -> list[Column]:
    """The five scores; a feature that is not given counts as 0."""
    out = []
    for name, weights in HEURISTICS.items():
        terms = [features[f] * Lit(float(w)) for f, w in weights.items() if f in features]
        total = Lit(0.0)
        for term in terms:
            total = total + term
        out.append(sigmoid(total).alias(name))
    return out


def scale_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with mean and population deviation of every column: what a fitted scaler keeps."""
    return df.agg(*[f(F.col(c)).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])


def scaled(df: DataFrame, columns: list[str], stats: DataFrame, suffix: str = "_z") -> DataFrame:
    """New rows scaled by stored ``scale_stats``; a missing column is an error, a deviation of 0 counts as 1."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    joined = df.crossJoin(F.broadcast(stats))  # one row
    scale = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return joined.select(*df.columns, *[((F.col(c) - F.col(f"_m_{c}")) / scale(c)).alias(f"{c}{suffix}") for c in columns])


def standardised(df: DataFrame, columns: list[str], fit: Column | None = None, suffix: str = "_z") -> DataFrame:
    """Columns scaled by mean and population deviation of the rows where ``fit`` holds; deviation 0 counts as 1."""
    return scaled(df, columns, scale_stats(df if fit is None else df.where(fit), columns), suffix)


def unscaled(z: Column, mean: Column, deviation: Column, logged: bool = False) -> Column:
    """The original value of a scaled mean; a log-scaled feature is raised again and not below zero."""
    x = z * F.when(deviation > 0, deviation).otherwise(1.0) + mean
    return F.expm1(F.greatest(x, Lit(0.0))) if logged else x


#: Features of the behavioural vector, in order; counts enter by log1p.
BEHAVIOURAL = [
    "out_bytes", "in_pkts", "out_pkts", "duration", "src_throughput", "src_bps", "dst_bps", "longest_pkt", "shortest_pkt", "small_pkts",
    "tcp_flags", "client_tcp_flags", "server_tcp_flags", "min_ttl", "fan_out", "fan_in", "n_pairs", "tcp", "udp", "icmp_active",
    "dst_well_known", "src_ephemeral",
]


def behavioural_vector(features: Mapping[str, Column]) -> Column:
    value = lambda f: F.log1p(features[f]) if f in ("fan_out", "fan_in", "n_pairs") else features[f]
    return F.array(*[value(f).cast("double") if f in features else Lit(0.0) for f in BEHAVIOURAL])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def parsed_answer(text: Column, renames: Mapping[str, str], labels: list[str], default: str = "normal_activity") -> Column:
    """Behaviour scores of a model's JSON answer: fences stripped, clamped to 0..1, renamed, normalised; an answer is parsed once."""
    body = F.regexp_replace(text, r"(?s)^.*?```(?:json)?\s*|\s*```.*$", "")
    fallback = F.array(F.struct(Lit(default).alias("label"), Lit(1.0).alias("score")))
    clamped = lambda given, k: F.coalesce(F.least(F.greatest(F.try_element_at(given, Lit(k)), Lit(0.0)), Lit(1.0)), Lit(0.0))

    def kept(given: Column) -> Column:
        named = {label: [label, *[o for o, n in renames.items() if n == label]] for label in labels}
        return F.array(*[F.struct(Lit(label).alias("label"), sum((clamped(given, k) for k in keys), Lit(0.0)).alias("score")) for label, keys in named.items()])

    def normalised(scores: Column, total: Column) -> Column:
        shares = F.transform(scores, lambda x: F.struct(x["label"].alias("label"), (x["score"] / F.when(total > 0, total)).alias("score")))
        return F.when(F.coalesce(total, Lit(0.0)) > 0, F.filter(shares, lambda x: x["score"] > 0)).otherwise(fallback)

    summed = lambda scores: F.aggregate(scores, Lit(0.0), lambda a, x: a + x["score"])
    parsed = F.from_json(body, "behaviours map<string,double>")["behaviours"]
    return bound(parsed, lambda given: bound(kept(given), lambda scores: bound(summed(scores), lambda total: normalised(scores, total))))


def number_claims(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, Lit(r"(?<![\w.])(-?\d+(?:,\d{3})*(?:\.\d+)?)"), 1), lambda x: F.regexp_replace(x, ",", "").cast("double"))


def supported(claim: Column, values: Column) -> Column:
    """Whether some value backs the number: within 5.1 % or 0.011, also read as a percentage."""
    close = lambda v: (F.abs(claim - v) <= F.greatest(F.abs(v) * 0.051, Lit(0.011)))
    return F.exists(values, lambda v: close(v) | close(v * 100))
