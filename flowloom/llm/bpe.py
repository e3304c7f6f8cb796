"""Byte-level BPE by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge,
so every text may be cut there and the fragments encoded independently. A cut is
used only where the pre-tokeniser's view of either side cannot change as well, and
most fragments are words that repeat, so their encodings are remembered within a
task (bounded) and concatenated.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Entries a task remembers before it starts afresh, and the longest remembered fragment in bytes.
CACHE_ENTRIES, CACHE_BYTES = 200_000, 48
#: The pre-tokeniser pattern of byte-level vocabularies of this kind (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# last bytes of multi-byte white space, and the bytes before them
_SPACE_ENDS = [*range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
_BEFORE_ENDS = [0xC2, 0x80, 0x81, 0x9A, 0xA0]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte: itself where printable, else the next letter from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b if b in printable else next(spare)): b for b in range(256)}


class Vocabulary:
    """Ids and bytes of a byte-level BPE vocabulary file, and its table of certain cuts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token.encode() not in self.special}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if ids[bytes(letters[c] for c in left + right)] != 256 + rank:
                raise ValueError("ids are not in merge order; this vocabulary can't be ranked by id")
        self.bytes_of = {i: token for token, i in ids.items()} | {i: token for token, i in self.special.items()}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
        cut = np.ones((256, 256), dtype=bool)
        for token in ids:
            pair = np.frombuffer(token, dtype=np.uint8)
            cut[pair[:-1], pair[1:]] = False
        cut[:33, :] = False  # white space on the left: its split looks at what follows
        cut[127, :] = False
        cut[:, ord("'")] = False  # an apostrophe's split depends on what stands before it
        cut[:, 0x80:0xC0] = False  # inside a character
        self.cut = cut.ravel()
        self.space_end = np.zeros(256, dtype=bool)
        self.space_end[_SPACE_ENDS] = True
        self.before_end = np.zeros(256, dtype=bool)
        self.before_end[_BEFORE_ENDS] = True

    def fragments(self, data: bytes) -> list[bytes]:
        """Pieces of one special-free text whose encodings concatenate to that of the text."""
        if len(data) < 2:
            return [data] if data else []
        b = np.frombuffer(data, dtype=np.uint8)
        cut = self.cut[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        doubtful = self.space_end[b[1:-1]] & self.before_end[b[:-2]]
        cut[1:][doubtful] = False
        ends = (np.flatnonzero(cut) + 1).tolist()
        return [data[i:j] for i, j in zip([0, *ends], [*ends, len(data)])]

    def sections(self, data: bytes) -> list[tuple[bytes, int | None]]:
        """The text between special tokens, each with the id of the special token after it."""
        out, at = [], 0
        while True:
            found = min(((data.find(t, at), -len(t), t) for t in self.special if data.find(t, at) >= 0), default=None)
            if found is None:
                return [*out, (data[at:], None)]
            out.append((data[at : found[0]], self.special[found[2]]))
            at = found[0] + len(found[2])


class Memory(dict):
    """Fragment -> ``shape(ids)``; bounded."""

    def __init__(self, vocabulary: Vocabulary, shape: Callable[[list[int]], object]):
        super().__init__()
        self.encode, self.shape = vocabulary.core.encode_ordinary, shape

    def __missing__(self, fragment: bytes):
        value = self.shape(self.encode(fragment.decode("utf-8")))
        if len(fragment) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[fragment] = value
        return value


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


class IdWriter:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.memory = Memory(self.vocabulary, lambda ids: np.array(ids, dtype="<u4").tobytes())

    def __call__(self, text: str | None) -> bytes:
        get, parts = self.memory.__getitem__, []
        for section, special in self.vocabulary.sections(utf8(text)):
            parts.extend(map(get, self.vocabulary.fragments(section)))
            if special is not None:
                parts.append(special.to_bytes(4, "little"))
        return b"".join(parts)


_LOADED: dict[tuple, object] = {}


def loaded(kind: type, path: str):
    """One instance per Python worker."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """Text of ids, special tokens included; broken UTF-8 becomes U+FFFD, unknown ids vanish."""
    return b"".join(map(vocabulary.bytes_of.get, ids.tolist(), [b""] * len(ids))).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Input columns plus ``ids array<int>``; null text counts as empty, texts of any length are encoded whole, fragment by fragment.

    Repeated rows get equal ids; an empty table gives an empty result; an input column named ``ids`` is replaced.
    """
    path = path or default_path()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        write = loaded(IdWriter, path)
        return pd.Series([np.frombuffer(write(t), dtype="<u4").astype(np.int32) for t in texts], dtype=object)

    return docs.withColumn("ids", ids(F.col(text)))


def decoded(docs: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """Input columns plus ``decoded``, the text of ``ids``; null ids give null, an empty list an empty text, an empty table an empty result."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        vocabulary = loaded(IdWriter, path).vocabulary
        return pd.Series([None if r is None else decode(np.asarray(r), vocabulary) for r in rows], dtype=object)

    return docs.withColumn("decoded", text(F.col(ids)))


class Digester:
    """Per text: token count, digest of the decimal ids, digest of the decoded text."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        names = [str(i) for i in range(max(self.vocabulary.bytes_of) + 1)]
        of = self.vocabulary.bytes_of
        self.memory = Memory(
            self.vocabulary, lambda ids: (len(ids), ",".join([names[i] for i in ids]), b"".join([of[i] for i in ids]))
        )

    def __call__(self, text: str | None) -> tuple[int, str, str]:
        get, parts = self.memory.__getitem__, []
        for section, special in self.vocabulary.sections(utf8(text)):
            parts.extend(map(get, self.vocabulary.fragments(section)))
            if special is not None:
                parts.append((1, str(special), self.vocabulary.bytes_of[special]))
        if not parts:
            parts = [(0, "", b"")]
        counts, names, raw = zip(*parts)
        back = b"".join(raw).decode("utf-8", "replace").encode()
        return sum(counts), hashlib.sha256(",".join(names).encode()).hexdigest(), hashlib.sha256(back).hexdigest()


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row; nothing is shuffled.

    Null and empty texts have no ids and the digests of empty strings; null ids and repeated
    rows are rows like any other; further columns are left out; an empty table gives an empty result.
    """
    path = path or default_path()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        of = loaded(Digester, path)
        return pd.DataFrame([of(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(read_table(spark, sf_dir, "documents"))
