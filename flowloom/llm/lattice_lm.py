"""Language-model scores by subword lattice likelihood.

An existing subword vocabulary gives pieces and scores; a document's probability
is the sum over all segmentations of its words into pieces, computed by the forward
recursion in log space. The vocabulary's scores are merge ranks, so they start the
piece probabilities by Zipf's law and expectation-maximisation over the training
documents' words adapts them. Pieces do not cross words, hence the sum factorises
by word and every distinct word is evaluated once.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read_table

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SLOTS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words a task counts before it hands them on.
FLUSH = 500_000
#: The most frequent words, at most so many, are scored within the tasks that read the texts; they are sent to every executor.
FREQUENT = 1 << 16
#: A longer word stands under its digest in joins and in the table of frequent words.
KEY_BYTES = 64
#: Words of more characters are taken through the lattice one by one.
LONG = 512
END = b""  # stands for the end of a text; no word is empty


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def key_of(word: bytes) -> bytes:
    """The word itself, or a tab and its digest where it is long; no word holds a tab."""
    return word if len(word) <= KEY_BYTES else b"\t" + hashlib.md5(word).digest()


def key_column(word: str = "word") -> Column:
    digest = F.concat(F.lit(b"\t"), F.unhex(F.md5(word)))
    return F.when(F.octet_length(word) <= KEY_BYTES, F.col(word)).otherwise(digest)


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


class Lattice:
    """Pieces with log probabilities, and forward and backward recursions over batches of words."""

    def __init__(self, pieces: list[str], log_p: np.ndarray, byte_log_p: np.ndarray):
        self.log_p, self.byte_log_p = log_p, byte_log_p
        self.longest = max(map(len, pieces))
        self.hashes = np.zeros(len(pieces), dtype=np.uint64)
        for size in {len(p) for p in pieces}:
            at = [i for i, p in enumerate(pieces) if len(p) == size]
            points = np.array([[ord(c) for c in pieces[i]] for i in at], dtype=np.uint64)
            h = np.zeros(len(at), dtype=np.uint64)
            for k in range(size):
                h = h * _BASE + points[:, k] + np.uint64(1)
            self.hashes[at] = h
        if len(np.unique(self.hashes)) != len(pieces):
            raise ValueError("two pieces have one hash")
        self.table = np.full(1 << _SLOTS, -1, dtype=np.int32)
        for i, slot in enumerate(self._slot(self.hashes).tolist()):
            while self.table[slot] >= 0:
                slot = (slot + 1) & ((1 << _SLOTS) - 1)
            self.table[slot] = i

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        slot = self._slot(h)
        found = self.table[slot]
        open_ = np.flatnonzero((found >= 0) & (self.hashes[found] != h))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << _SLOTS) - 1)
            found[open_] = self.table[slot[open_]]
            open_ = open_[(found[open_] >= 0) & (self.hashes[found[open_]] != h[open_])]
        return found

    def _edges(self, points: np.ndarray):
        """``(start, size, rows, piece, log_p)`` of all arcs of equally long words, by start and size."""
        n, length = points.shape
        h = np.zeros((n, length), dtype=np.uint64)
        out = []
        for size in range(1, min(self.longest, length) + 1):
            h = h[:, : length - size + 1] * _BASE + points[:, size - 1 :] + np.uint64(1)
            found = self.find(h.ravel()).reshape(h.shape)
            for start in range(length - size + 1):
                rows = np.flatnonzero(found[:, start] >= 0)
                if len(rows):
                    piece = found[rows, start]
                    out.append((start, size, rows, piece, self.log_p[piece]))
            if size == 1:
                for start in range(length):
                    rows = np.flatnonzero(found[:, start] < 0)
                    if len(rows):  # characters without a piece are spelled by their bytes
                        chars, back = np.unique(points[rows, start], return_inverse=True)
                        cost = np.array([self.byte_log_p[list(chr(int(c)).encode("utf-8", "replace"))].sum() for c in chars])
                        out.append((start, 1, rows, None, cost[back]))
        return out

    def forward(self, points: np.ndarray, edges=None) -> np.ndarray:
        """Log probability of every prefix of equally long words."""
        n, length = points.shape
        if length > LONG:
            return np.array([self.forward_long(self._arcs(p[None]), length) for p in points])
        alpha = np.full((n, length + 1), -np.inf)
        alpha[:, 0] = 0
        for start, size, rows, _, log_p in sorted(edges or self._edges(points), key=lambda e: e[0]):
            alpha[rows, start + size] = np.logaddexp(alpha[rows, start + size], alpha[rows, start] + log_p)
        return alpha

    def expected(self, points: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected piece counts over weighted words."""
        n, length = points.shape
        if length > LONG:
            return sum(self.expected_long(p[None], w) for p, w in zip(points, weights.tolist()))
        edges = self._edges(points)
        alpha = self.forward(points, edges)
        beta = np.full((n, length + 1), -np.inf)
        beta[:, length] = 0
        counts = np.zeros(len(self.log_p))
        for start, size, rows, piece, log_p in sorted(edges, key=lambda e: -(e[0] + e[1])):
            reach = beta[rows, start + size] + log_p
            if piece is not None:
                share = np.exp(alpha[rows, start] + reach - alpha[rows, length])
                counts += np.bincount(piece, share * weights[rows], minlength=len(counts))
            beta[rows, start] = np.logaddexp(beta[rows, start], reach)
        return counts

    def _arcs(self, points: np.ndarray) -> list[tuple[int, int, int, float]]:
        """``(start, end, piece or -1, log_p)`` of one word, by start."""
        length = points.shape[1]
        h, parts = np.zeros(length, dtype=np.uint64), []
        for size in range(1, min(self.longest, length) + 1):
            h = h[: length - size + 1] * _BASE + points[0, size - 1 :] + np.uint64(1)
            found = self.find(h)
            start = np.flatnonzero(found >= 0)
            parts.append((start, start + size, found[start], self.log_p[found[start]]))
            if size == 1:
                start = np.flatnonzero(found < 0)
                chars, back = np.unique(points[0, start], return_inverse=True)
                cost = np.array([self.byte_log_p[list(chr(int(c)).encode("utf-8", "replace"))].sum() for c in chars])
                parts.append((start, start + 1, np.full(len(start), -1), cost[back] if len(start) else np.zeros(0)))
        columns = [np.concatenate(x) for x in zip(*parts)]
        order = np.argsort(columns[0], kind="stable")
        return list(zip(*(c[order].tolist() for c in columns)))

    def forward_long(self, arcs: list[tuple[int, int, int, float]], length: int) -> list[float]:
        alpha = [-math.inf] * (length + 1)
        alpha[0] = 0.0
        for start, end, _, log_p in arcs:
            alpha[end] = _log_add(alpha[end], alpha[start] + log_p)
        return alpha

    def expected_long(self, points: np.ndarray, weight: float) -> np.ndarray:
        length, arcs = points.shape[1], self._arcs(points)
        alpha, counts = self.forward_long(arcs, length), np.zeros(len(self.log_p))
        beta = [-math.inf] * length + [0.0]
        for start, end, piece, log_p in reversed(arcs):  # all arcs from beyond a start come before those from it
            reach = beta[end] + log_p
            if piece >= 0:
                counts[piece] += weight * math.exp(alpha[start] + reach - alpha[length])
            beta[start] = _log_add(beta[start], reach)
        return counts

    def by_length(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and code points (word start mark first) of words of one length, in bounded batches."""
        texts = ["▁" + w.decode("utf-8", "replace") for w in words]
        sizes = np.array([len(t) for t in texts])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            step = max(1, (1 << 19) // int(size))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                data = "".join([texts[i] for i in part]).encode("utf-32-le", "replace")
                yield part, np.frombuffer(data, dtype=np.uint32).reshape(len(part), size).astype(np.uint64)


def load_pieces(path: str) -> tuple[list[str], np.ndarray]:
    """Ordinary pieces and their starting log probabilities, Zipf's law over the order of their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    score = np.array([model.get_score(i) for i in ids])
    rank = np.empty(len(ids))
    rank[np.argsort(-score, kind="stable")] = np.arange(len(ids))
    return [model.id_to_piece(i) for i in ids], -np.log(rank + 10)


def _normal(log_p: np.ndarray, end: float, byte: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    total = np.logaddexp.reduce(np.concatenate((log_p, [end], byte)))
    return log_p - total, end - total, byte - total


def _count_words(training: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            words = list(seen[1].keys() | seen[0].keys())
            yield pd.DataFrame({"word": words, "c": np.fromiter((seen[1][w] for w in words), np.int64, len(words))})
            seen[0].clear()
            seen[1].clear()

        for batch in batches:
            for text, train in zip(batch["text"], batch[training]):
                into = seen[int(train)]
                into.update(words_of(text))
                into[END] += 1
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield from flush()
        yield from flush()

    return count


def vocabulary(docs: DataFrame, training: str = "training") -> DataFrame:
    """``(word binary, c)`` for every word of all documents; ``c`` counts training documents only."""
    counted = docs.select("text", training).mapInPandas(_count_words(training), "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, path: str, rounds: int = 2, smoothing: float = 0.1):
    """``(pieces, log_p, end_log_p, byte_log_p)`` after EM over all training words.

    Expected counts are summed per piece within a task, then across tasks; what
    reaches the driver has one row per vocabulary piece.
    """
    pieces, log_p = load_pieces(path)
    log_p, end, byte = _normal(log_p, math.log(1e-3), np.full(256, math.log(1e-8)))
    sc = words.sparkSession.sparkContext
    ends = words.where(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    for _ in range(rounds):
        shared = sc.broadcast((pieces, log_p, byte))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lattice = Lattice(*shared.value)
            counts = np.zeros(len(lattice.log_p))
            for batch in batches:
                weights = batch["c"].to_numpy(dtype=np.float64)
                for at, points in lattice.by_length(batch["word"].tolist()):
                    counts += lattice.expected(points, weights[at])
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"piece": at, "n": counts[at]})

        known = words.where((F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word", "c")
        summed = known.mapInPandas(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = np.full(len(pieces), smoothing)
        for row in summed:
            counts[row.piece] += row.n
        log_p, end, byte = _normal(np.log(counts), math.log(ends + smoothing), np.full(256, math.log(smoothing)))
    return pieces, log_p, end, byte


def word_scores(words: DataFrame, model) -> DataFrame:
    """``(word, c, lp)``: log10 of the marginal probability of each word, or of the end of a text."""
    pieces, log_p, end, byte = model
    shared = words.sparkSession.sparkContext.broadcast((pieces, log_p, byte))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            found, out = batch["word"].tolist(), np.zeros(len(batch))
            for at, points in lattice.by_length(found):
                out[at] = lattice.forward(points)[:, -1]
            out[[i for i, w in enumerate(found) if w == END]] = end
            yield pd.DataFrame({"word": found, "c": batch["c"], "lp": out / math.log(10)})

    return words.mapInPandas(score, "word binary, c long, lp double")


SUMS = "n_tokens long, n_known long, base double, lp double, n_rows long"


def _sum_frequent(frequent):
    """Per document the sums over frequent words, and a row for each other word to be joined."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = frequent.value
        for batch in batches:
            words, times, owner, heads = [], [], [], []
            for i, text in enumerate(batch["text"]):
                counts = Counter(words_of(text))
                counts[END] += 1
                n = n_known = 0
                base = lp = 0.0
                first = len(words)
                for whole, k in counts.items():
                    n += k
                    word = key_of(whole)
                    have = known.get(word)
                    if have is None:
                        words.append(word)
                        times.append(k)
                    else:
                        n_known += k * (have[0] > 0)
                        base += k * have[0]
                        lp += k * have[1]
                if len(words) == first:  # a word of its own that no text holds, for it has a space
                    words.append(f" {i}".encode())
                    times.append(0)
                owner += [i] * (len(words) - first)
                heads.append((first, n, n_known, base, lp))
            at = np.array([h[0] for h in heads], dtype=np.int64)
            out = pd.DataFrame({"word": words, "k": np.array(times, dtype=np.int64)})
            for j, name in enumerate(("n_tokens", "n_known", "base", "lp"), 1):
                column = np.zeros(len(words), dtype=np.float64 if j > 2 else np.int64)
                column[at] = [h[j] for h in heads]
                out[name] = column
            rows = np.zeros(len(words), dtype=np.int64)
            rows[at] = 1
            out["n_rows"] = rows
            for key in ("doc_id", "th"):
                out[key] = batch[key].to_numpy()[np.array(owner, dtype=np.int64)]
            yield out

    return sums


def frequent_words(words: DataFrame, most: int) -> dict[bytes, tuple[float, float]]:
    """``{key: (log10(c + 1), lp)}`` of all words at least as frequent as some count, ``most`` of them at most.

    The count is found from a histogram in steps of a sixteenth of an octave, so that
    the driver receives some hundred rows and then the chosen words only.
    """
    step = F.floor(F.log2(F.col("c")) * 16).cast("int")
    seen = words.where("c > 0")
    sizes = sorted(seen.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    total, least = 0, None
    for r in sizes:
        total += r.n
        if total > most:
            break
        least = r.step
    if least is None:
        return {}
    chosen = seen.where(step >= least).select(key_column().alias("key"), "c", "lp").collect()
    return {bytes(r.key): (math.log10(r.c + 1), r.lp) for r in chosen}


def score(docs: DataFrame, training: Column, path: str | None = None, rounds: int = 2) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    ``training`` marks the documents that are learnt from. Null text is empty and
    so one token long; repeated rows are returned as often as they occur; an empty table
    gives an empty result; of the input only ``doc_id`` and ``text`` are read.
    Only words outside the ``FREQUENT`` most frequent ones of the training texts travel with
    their document, long ones as digests, to a join with the vocabulary on the word.
    """
    path = path or default_path()
    marked = docs.select(
        "doc_id", "text", F.xxhash64("text").alias("th"), F.coalesce(training, F.lit(False)).alias("training")
    )
    counted = durable(vocabulary(marked))
    total = counted.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    tokens, distinct = int(total.n or 0), int(total.v or 0)
    words = durable(word_scores(counted, fit(counted, path, rounds)))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_words(words, FREQUENT))
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = marked.select("doc_id", "th", "text").mapInPandas(
        _sum_frequent(frequent), f"word binary, k long, {SUMS}, doc_id {kind}, th long"
    )
    looked_up = parts.join(words.select(key_column().alias("word"), "c", F.col("lp").alias("w_lp")), "word", "left")
    add = lambda column: F.coalesce(column, F.lit(0.0)) * F.col("k")
    summed = looked_up.groupBy("doc_id", "th").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + add(F.log10(F.col("c") + 1))).alias("base"),
        F.sum(F.col("lp") + add(F.col("w_lp"))).alias("lp"),
    )
    each = summed.select("*", F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("copy"))
    whole = lambda c: F.expr(f"{c} div n_rows")
    return each.select(
        "doc_id",
        whole("n_tokens").alias("n_tokens"),
        whole("n_known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("n_rows") - whole("n_tokens") * F.lit(math.log10(tokens + distinct + 1))).alias("base_score"),
        (F.col("lp") / F.col("n_rows")).alias("score"),
    )


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
