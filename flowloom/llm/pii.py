"""Personal data by weak supervision.

Candidate spans are found by broad patterns. Labelers (strict patterns,
gazetteers, context words) vote on every candidate; expectation-maximisation over
the counts of vote patterns estimates the labelers' reliabilities without any gold
labels; its posteriors train the final span classifier. Spans of the base patterns
always stay, the classifier decides on the rest.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carry, durable, read_table, restore

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run's first digit decides: where it fails, later starts in the same run fail as well
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT_WORD = re.compile(r"[(\[{<]\s?at\s?[)\]}>]", re.I)
_EMAIL_WORDS = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?[(\[{<]\s?at\s?[)\]}>]\s?"
    r"[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[(\[{<]\s?dot\s?[)\]}>]\s?)[A-Za-z0-9-]{1,63}){1,8}",
    re.I,
)
_PHONE_LOCAL = re.compile(r"(?<![0-9+.\-(])(?:\([0-9]{3}\)|[0-9]{3})[ .-]{0,2}[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_PHONE_ABROAD = re.compile(r"(?<![0-9])00[1-9][0-9](?:[ ()./-]{0,2}[0-9]){6,12}(?![0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")

#: Gazetteers and context words of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov info io co de fr es uk eu us".split())
CONTEXT = (
    re.compile(r"\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b", re.I),
    re.compile(r"\b(?:ip|host|server|address|login|adresse|dirección)\b", re.I),
    re.compile(r"\b(?:card|visa|mastercard|credit|payment|karte|carte|tarjeta)\b", re.I),
    re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|téléphone|teléfono)\b", re.I),
)
AGAINST = re.compile(r"\b(?:version|order|isbn|invoice|serial|section|figure|token|hash|code|id)\b[\s:=#.]*\Z", re.I)
#: Characters before a span in which context counts.
REACH = 40
#: Features of the span classifier besides its kind; the first ``VOTERS`` come from votes.
VOTERS = 5
FEATURES = VOTERS * 2 + 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the base patterns: leftmost, non-overlapping within a kind."""
    found = []
    done = 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        domain = _DOMAIN.match(text, at + 1) if lo < at else None
        if domain:
            done = domain.end()
            found.append((EMAIL, lo, done))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((IP, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((CARD, m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((PHONE, m.start(), m.end()))
    return found


def broad_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """Looser candidates; they may overlap base spans."""
    if _AT_WORD.search(text):
        for m in _EMAIL_WORDS.finditer(text):
            yield EMAIL, m.start(), m.end()
    if _DIGIT.search(text):
        for m in _CARD.finditer(text):
            if 13 <= sum(c not in " -" for c in m[0]) <= 19:
                yield CARD, m.start(), m.end()
        for pattern in (_PHONE_LOCAL, _PHONE_ABROAD):
            for m in pattern.finditer(text):
                yield PHONE, m.start(), m.end()
        if ":" in text:
            for m in _IPV6.finditer(text):
                yield IP, m.start(), m.end()


def votes(text: str, kind: int, start: int, end: int, base: bool) -> list[int]:
    """One vote per labeler: 1 for, -1 against, 0 abstains."""
    span, before = text[start:end], text[max(0, start - REACH) : start]
    digits = [c for c in span if c in "0123456789"]
    strict = 1 if base else (-1 if kind == CARD else 0)
    gazetteer = 0
    if kind == EMAIL:
        gazetteer = 1 if re.split(r"[.\s)\]}>]+", span.strip(")]}> "))[-1].lower() in TOP_DOMAINS else -1
    elif kind == CARD:
        gazetteer = 1 if digits[0] in "3456" else -1
    elif kind == PHONE:
        gazetteer = -1 if len(set(digits)) < 3 else 0
    elif kind == IP:
        gazetteer = -1 if digits[:1] == ["0"] else 0
    context = 1 if CONTEXT[kind].search(before) else 0
    against = -1 if AGAINST.search(before) else 0
    glued = text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()
    return [strict, gazetteer, context, against, -1 if glued else 1]


def candidates(text: str | None) -> list[tuple[int, int, int, bool, int]]:
    """``(kind, start, end, base, signature)``; the signature codes votes and surface features."""
    text = text or ""
    if "@" not in text and not _DIGIT.search(text) and not _AT_WORD.search(text):
        return []
    base = base_spans(text)
    found = [(k, s, e, True) for k, s, e in base]
    ends: list[int] = []  # of the base spans merged to disjoint intervals
    starts: list[int] = []
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for k, s, e in broad_spans(text):
        at = bisect_right(ends, s)  # the first interval that ends after s
        if at == len(ends) or starts[at] >= e:
            found.append((k, s, e, False))
    out, last = [], {}
    for k, s, e, is_base in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
        if not is_base and s < last.get(k, 0):
            continue
        last[k] = e
        code = 0
        for v in votes(text, k, s, e, is_base):
            code = code * 3 + v + 1
        digits = sum(c in "0123456789" for c in text[s:e])
        surface = (digits >= 10) + 2 * (re.search(r"[ ().-]", text[s:e]) is not None) + 4 * (e - s > 24)
        out.append((k, s, e, is_base, code * 8 + surface))
    return out


def unpack(signature: int) -> tuple[list[int], np.ndarray]:
    """Votes and the classifier's 0/1 features of a signature."""
    surface, code = signature % 8, signature // 8
    v = []
    for _ in range(VOTERS):
        v.append(code % 3 - 1)
        code //= 3
    v.reverse()
    bits = [float(x == 1) for x in v] + [float(x == -1) for x in v] + [float(surface >> i & 1) for i in range(3)]
    return v, np.array(bits)


def reliabilities(kinds: np.ndarray, vote_rows: np.ndarray, counts: np.ndarray, rounds: int = 50):
    """EM over vote patterns: posterior of each pattern, and P(vote | class) per kind and labeler."""
    post = np.clip(0.5 + 0.35 * np.sign(vote_rows.sum(axis=1) - 0.5) + 0.1 * (vote_rows[:, 0] == 1), 0.05, 0.95)
    tables = np.zeros((len(KINDS), 2, VOTERS, 3))
    for _ in range(rounds):
        new = np.zeros_like(post)
        for k in np.unique(kinds):
            at = kinds == k
            w = np.stack([(1 - post[at]) * counts[at], post[at] * counts[at]])
            prior = (w.sum(axis=1) + 1) / (w.sum() + 2)
            like = np.log(prior)[:, None] + np.zeros((2, at.sum()))
            for j in range(VOTERS):
                for v in (-1, 0, 1):
                    hit = vote_rows[at, j] == v
                    tables[k, :, j, v + 1] = (w[:, hit].sum(axis=1) + 0.5) / (w.sum(axis=1) + 1.5)
                like += np.log(tables[k][:, j, vote_rows[at, j] + 1])
            new[at] = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        post = new
    return post, tables


def span_classifier(kinds: np.ndarray, bits: np.ndarray, counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logistic regression on soft targets, one weight vector per kind; the last weight is the bias."""
    weights = np.zeros((len(KINDS), FEATURES + 1))
    for k in np.unique(kinds):
        at = kinds == k
        x = np.hstack([bits[at], np.ones((at.sum(), 1))])
        w = counts[at] / counts[at].sum()
        for _ in range(60):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ weights[k], -30, 30)))
            grad = x.T @ (w * (p - target[at])) + 1e-3 * weights[k]
            hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(FEATURES + 1)
            weights[k] -= np.linalg.solve(hess, grad)
    return weights


SPAN_TYPE = "array<struct<kind:int,start:int,end:int,base:boolean,sig:int>>"


def find_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    @F.pandas_udf(SPAN_TYPE)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [[dict(zip(("kind", "start", "end", "base", "sig"), c)) for c in candidates(t)] for t in texts], dtype=object
        )

    return docs.withColumn("spans", find(F.col(text)))


def tallied(found: DataFrame) -> list:
    """Candidates of all documents as counts ``(kind, sig, n)``: at most 4 * 3**VOTERS * 8 rows leave the executors, whatever the corpus."""
    return found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.sig").agg(F.count(F.lit(1)).alias("n")).collect()


def train(found: DataFrame) -> np.ndarray:
    """Weights of the span classifier from the candidates of all documents."""
    return fitted(tallied(found))


def fitted(rows: list) -> np.ndarray:
    if not rows:
        return np.zeros((len(KINDS), FEATURES + 1))
    rows = sorted(rows)
    kinds = np.array([r.kind for r in rows])
    counts = np.array([r.n for r in rows], dtype=float)
    unpacked = [unpack(r.sig) for r in rows]
    vote_rows = np.array([v for v, _ in unpacked])
    post, _ = reliabilities(kinds, vote_rows, counts)
    return span_classifier(kinds, np.array([b for _, b in unpacked]), counts, post)


def probability(span: Column, weights: np.ndarray) -> Column:
    """The classifier as a column over one span struct."""
    code = F.floor(span["sig"] / 8)
    terms = []
    for j in range(VOTERS):
        vote = F.pmod(F.floor(code / 3 ** (VOTERS - 1 - j)), F.lit(3)).cast("int")
        terms += [(j, (vote == 2).cast("double")), (VOTERS + j, (vote == 0).cast("double"))]
    terms += [(2 * VOTERS + i, F.shiftright(span["sig"], i).bitwiseAND(F.lit(1)).cast("double")) for i in range(3)]
    w = F.get(F.lit([[float(x) for x in row] for row in weights]), span["kind"])
    z = F.get(w, F.lit(FEATURES))
    for i, term in terms:
        z = z + F.get(w, F.lit(i)) * term
    return 1 / (1 + F.exp(-z))


def accepted(weights: np.ndarray, threshold: float) -> Column:
    """Spans of column ``spans`` that stay, sorted: ``(kind, start, end, base)``."""
    kept = F.filter("spans", lambda s: s["base"] | (probability(s, weights) >= threshold))
    return F.array_sort(
        F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    )


def signatures(spark: SparkSession, rows: list, threshold: float) -> set[tuple[int, int]]:
    """``(kind, sig)`` of the candidates that the classifier trained on the counts ``rows`` accepts."""
    if not rows:
        return set()
    seen = spark.createDataFrame([(int(r.kind), int(r.sig)) for r in rows], "kind int, sig int")
    likely = seen.where(probability(F.struct("kind", "sig"), fitted(rows)) >= threshold)
    return {(r.kind, r.sig) for r in likely.collect()}


def label_spans(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Input columns plus ``spans``: base spans and those the trained classifier accepts.

    Each span is ``(kind, start, end, base)`` in code points, end exclusive, sorted
    by kind (index into ``KINDS``) and start; of overlapping candidates of one kind the first,
    then the longest counts. Null text counts as empty; repeated rows get equal spans; an input
    column named ``spans`` is replaced; texts of any length are searched whole, in time about
    proportional to it; an empty table gives an empty result. One pass gathers vote counts, one labels.
    """
    found = find_candidates(docs.drop("spans"))
    return found.withColumn("spans", accepted(train(found.select("spans")), threshold))


def redact(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``docs`` with every labelled span of ``text`` replaced by its kind, as ``[EMAIL]``.

    All rows and columns stay; null text stays null; ``n_chars`` follows the new text. Spans are found
    and masked by one function, so that a task needs one Python worker and reads a text once.
    """
    held = carry(docs, "text")
    rows = tallied(find_candidates(held.select("text")))
    good = signatures(docs.sparkSession, rows, threshold)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        def one(text):
            out, at = [], 0
            for kind, start, end, base, sig in sorted(candidates(text), key=lambda c: (c[1], -c[2], c[0])):
                if not base and (kind, sig) not in good:
                    continue
                if start >= at:
                    out += [text[at:start], f"[{KINDS[kind].upper()}]"]
                at = max(at, end)
            return "".join([*out, text[at:]]) if out else text

        return pd.Series([None if t is None else one(t) for t in texts], dtype=object)

    masked = held.withColumn("text", mask("text"))
    return restore(masked, docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # only the candidates are materialised, never the texts
    found = durable(find_candidates(docs).select("doc_id", "spans"))
    labelled = found.withColumn("spans", accepted(train(found), 0.9))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return labelled.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents stay, their personal data is masked.

    All columns, of any name, and repeated rows stay; null and empty texts stay as they are;
    null ids are no matter; an empty table gives an empty result.
    """
    return redact(docs)
