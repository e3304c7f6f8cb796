"""Quality rules with cross-document line frequency (DataFrame functions only).

Lines are normalised and hashed; the engine counts, per host, the distinct
documents that hold a line, removes lines above a limit and rejects documents
that are depleted by the removal.

Documents are distinct by their text: repeated rows and exact copies of a document
on one host count once, so that a text which is merely copied stays whole (that is
near-duplicate removal's work), while a banner, a footer or a template goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, carry, durable, read_table, restore

#: Window length of the within-document repetition rule.
WINDOW = 8
#: Keys over which the rows of one line are dealt.
SALTS = 16


def bind(value: Column, body) -> Column:
    """``let v = value in body(v)``: evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def repeated_window_words(words: Column) -> Column:
    """Words covered by ``WINDOW``-word windows that occur at least twice in one text."""

    def window_hashes(h):
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
        )

    def covered(w):
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s):
            twice = F.filter(
                s,
                lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        return F.aggregate(
            bind(ordered, positions),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
            lambda acc, p: F.struct(
                (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).cast("long").alias("n"), (p + WINDOW).alias("end")
            ),
            lambda acc: acc["n"],
        )

    return bind(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) < WINDOW, F.lit(0).cast("long")).otherwise(
            bind(
                window_hashes(h),
                lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)),
            )
        ),
    )


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the per-document measures and ``base_failed``; null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(
        "*",
        bind(
            words_of(t),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).alias("n_repeat_words")),
        ).alias("_w"),
        (F.length(t) - without(" \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    out = out.select(*[c for c in out.columns if c != "_w"], "_w.n_words", "_w.n_repeat_words")
    return out.withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE_CLASS, " ")))


def _hashed_lines(text: Column) -> Column:
    return F.transform(
        F.filter(F.transform(F.split(text, "\n"), _normal), lambda x: x != ""),
        lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("w")),
    )


def _text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _host_hash(host: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(host), F.lit("")))


def frequent_lines(held: DataFrame, max_docs: int) -> DataFrame:
    """Lines ``(host, h)`` that more than ``max_docs`` documents of different text hold on one host.

    ``held``: ``(host, th, lines)``. A line repeated in one document counts once.
    """
    forms = held.select("host", "th", F.array_distinct("lines.h").alias("h")).groupBy("host", "th").agg(F.first("h").alias("h"))
    counts = forms.select("host", F.explode("h").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > max_docs).select("host", "h")


def lost_words(held: DataFrame, gone: DataFrame) -> DataFrame:
    """``(rid, lost, removed)``: words in removed lines, repeats included, and the lines' hashes; only rows that lose any.

    One line may stand in a third of all documents: its rows are dealt over ``SALTS``
    keys, to each of which the few frequent lines are copied.
    """
    salt = F.pmod(F.col("rid"), F.lit(SALTS)).alias("salt")
    lines = held.select("rid", "host", salt, F.explode("lines").alias("x")).select("rid", "host", "salt", "x.h", "x.w")
    copied = gone.select("host", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return lines.join(copied, ["host", "h", "salt"]).groupBy("rid").agg(
        F.sum("w").alias("lost"), F.collect_set("h").alias("removed")
    )


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality(
    docs: DataFrame, min_words: int = 20, max_docs: int = 50, host: str = "source", keep_text: bool = False
) -> DataFrame:
    """Documents with measures, ``base_failed`` and ``kept``; all rows stay.

    ``kept`` is false where the base rules fail or where fewer than ``min_words``
    words stay after the frequent lines are removed. With ``keep_text`` the text and
    all other input columns stay and ``text`` loses the removed lines; otherwise the
    result has ``doc_id`` and the measures only. The texts are read once; what is
    counted and joined are numbers and line hashes.

    Null text counts as empty and fails the base rules; a null host is a host of its
    own; null ids and repeated rows get verdicts like any other row, equal ones for equal
    rows; input columns with the names of the result's are replaced; an empty table gives
    an empty result.
    """
    used = docs.select("doc_id", "text", F.col(host).alias("_host"))
    held = durable(
        base_rules(used).select(
            "doc_id", _text_hash().alias("th"), _host_hash("_host").alias("host"), *NAMES,
            _hashed_lines(F.coalesce(F.col("text"), F.lit(""))).alias("lines"), F.monotonically_increasing_id().alias("rid"),
        )
    )
    lost = lost_words(held, frequent_lines(held, max_docs))
    left = F.col("lost").isNull() | (F.col("n_words") - F.col("lost") >= min_words)
    out = held.drop("lines").join(lost, "rid", "left").withColumn("kept", ~F.col("base_failed") & left)
    if not keep_text:
        return out.select("doc_id", *NAMES, "kept")
    verdicts = out.select(
        F.struct("doc_id", "th", "host").alias("key"), *NAMES, "kept", "removed"
    ).dropDuplicates(["key"])
    carried = [c for c in docs.columns if c not in {*NAMES, "kept", "removed", "key"}]
    keyed = docs.select(*carried, F.struct("doc_id", _text_hash().alias("th"), _host_hash(host).alias("host")).alias("key"))
    stays = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("removed", F.xxhash64(_normal(x))))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    whole = keyed.join(verdicts, keyed.key.eqNullSafe(verdicts.key), "left").drop("key")
    return whole.withColumn("text", text).select(*carried, *NAMES, "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go, frequent lines leave the texts that stay.

    All columns, of any name, stay; ``n_chars`` follows the text. Null and empty texts go
    (the base rules reject them); repeated rows and null ids share the verdict of their
    text and host; an empty table gives an empty result.
    """
    cleaned = quality(carry(docs, "doc_id", "text", "source"), keep_text=True).where("kept")
    return restore(cleaned, docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS g
        FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY rid),
base AS (
  SELECT rid, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)),
lines AS (
  SELECT rid, host, t, x AS h, CAST(len(string_split(x, ' ')) AS BIGINT) AS w FROM (
    SELECT rid, host, t, unnest(list_transform(string_split(t, chr(10)),
           lambda y: lower(trim(regexp_replace(y, '[\x20\x09-\x0D]+', ' ', 'g'))))) AS x FROM d) WHERE x <> ''),
gone AS (SELECT host, h FROM (SELECT DISTINCT host, t, h FROM lines) GROUP BY host, h HAVING count(*) > 50),
lost AS (SELECT rid, sum(w) AS lost FROM lines JOIN gone USING (host, h) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(n_words - lost >= 20, true) AS kept
FROM base LEFT JOIN lost USING (rid)
"""
