import hashlib
import random

import numpy as np
import pytest

from flowloom.llm import bpe

from .helpers import DOC_SCHEMA, documents, edge_rows, save

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_equal_the_library_on_random_texts(reference):
    r = random.Random(1)
    alphabet = list("abcXYZ019  \n\t'’.,!?-_éß漢字  　 ̀‍😀\x00\x1f\x7f") + ["'s", "'LL", "'re", "<|endoftext|>", "  ", "\r\n", "the", " of", "한국", " ", "᠎", "\u0085"]
    write = bpe.IdWriter(PATH)
    for _ in range(6000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        got = np.frombuffer(write(text), dtype="<u4").tolist()
        want = reference.encode(text, add_special_tokens=False).ids
        assert got == want, repr(text)
        assert bpe.decode(np.array(want), write.vocabulary) == reference.decode(want, skip_special_tokens=False)


def test_broken_utf8_decodes_like_the_library(reference):
    r = random.Random(2)
    vocabulary = bpe.Vocabulary(PATH)
    for _ in range(3000):
        ids = [r.randrange(50257) if r.random() < 0.5 else r.randrange(256) for _ in range(r.randint(0, 12))]
        assert bpe.decode(np.array(ids, dtype=np.int64), vocabulary) == reference.decode(ids, skip_special_tokens=False)


def test_fragments_are_forced_and_concatenate():
    vocabulary = bpe.Vocabulary(PATH)
    data = "Hello wörld, zxqj 12345... don't".encode()
    parts = vocabulary.fragments(data)
    assert b"".join(parts) == data and len(parts) > 1
    tokens = {t for t in vocabulary.bytes_of.values()}
    for a, b in zip(parts, parts[1:]):
        assert not any(a[-1:] + b[:1] in t for t in tokens)


def test_query_on_edge_rows(spark, tmp_path, reference):
    save(documents(spark, clash=True), tmp_path, "documents")
    got = sorted((tuple(r) for r in bpe.query(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in edge_rows():
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(reference.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)


def test_general_interface_round_trip(spark):
    docs = documents(spark)
    out = bpe.decoded(bpe.encode(docs)).collect()
    assert all(r.decoded == (r.text or "") for r in out)


def test_empty_table(spark, tmp_path):
    save(spark.createDataFrame([], DOC_SCHEMA), tmp_path, "documents")
    assert bpe.query(spark, str(tmp_path)).count() == 0
