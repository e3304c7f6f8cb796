import random
import zlib
from collections import defaultdict

import numpy as np

from flowloom.llm import bpe, packing

from .helpers import DOC_SCHEMA, documents, edge_rows, save, words


def check(rows, texts, capacity=2048):
    write = bpe.IdWriter(bpe.default_path())
    streams = defaultdict(list)
    for i, t in texts:
        streams[i].append(write(t) + (1).to_bytes(4, "little"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(streams)
    for i, parts in by_doc.items():
        copies = len(streams[i])
        data = streams[i][0]
        assert sum(r.length for r in parts) == copies * len(data) // 4
        for r in parts:
            assert r.doc_tokens == len(data) // 4
            assert r.ids_crc32 == zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)])
        at = 0
        for r in sorted(parts, key=lambda r: r.start)[::copies]:
            assert r.start == at
            at += r.length
        assert at == len(data) // 4
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_query_on_edge_rows(spark, tmp_path):
    save(documents(spark, clash=True), tmp_path, "documents")
    check(packing.query(spark, str(tmp_path)).collect(), [(i, t) for i, t, *_ in edge_rows()])


def test_little_padding(spark):
    rows = [(k, words(k, random.Random(k).choice((3, 40, 200, 700))), "en", "s", 1) for k in range(1500)]
    out = packing.pack(documents(spark, rows)).collect()
    n = check(out, [(r[0], r[1]) for r in rows])
    assert sum(r.length for r in out) / (n * 2048) > 0.98


def test_differencing_is_near_equal_and_partitions():
    r = random.Random(3)
    for ways in (1, 2, 3, 7):
        for n in (0, 1, 2, 5, 40):
            sizes = np.array([r.randint(1, 500) for _ in range(n)], dtype=np.int64)
            bins, sums = packing.differencing(sizes, ways)
            assert len(bins) == n
            assert np.array_equal(np.bincount(bins, sizes, minlength=len(sums)).astype(int), sums) or n == 0
            if n >= 40:
                assert sums.max() - sums.min() <= 60


def plain_differencing(sizes, ways):
    """Karmarkar-Karp on full tuples of sets, as the textbook has it."""
    parts = [(s, [(s, (i,))] + [(0, ())] * (ways - 1)) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: -p[0])
        (_, a), (_, b), *rest = parts
        merged = sorted(((x + y, i + j) for (x, i), (y, j) in zip(a, reversed(b))), reverse=True)
        parts = [*rest, (merged[0][0] - merged[-1][0], merged)]
    return parts[0][1]


def test_differencing_equals_the_textbook():
    r = random.Random(8)
    for _ in range(200):
        ways, n = r.randint(2, 6), r.randint(1, 30)
        sizes = [r.randint(1, 10**6) for _ in range(n)]  # ties are unlikely, so both take the same steps
        bins, sums = packing.differencing(np.array(sizes, dtype=np.int64), ways)
        want = plain_differencing(sizes, ways)
        assert sorted(sums.tolist()) == sorted(s for s, _ in want if s)
        assert {tuple(np.flatnonzero(bins == b)) for b in set(bins.tolist())} == {tuple(sorted(i)) for _, i in want if i}


def test_repeated_rows_and_ties_spread_over_blocks(spark):
    rows = [(7, words(1, 300), "en", "s", 1)] * 900 + [(8 + k, words(2, 300), "en", "s", 1) for k in range(300)]
    docs = documents(spark, rows)
    out = packing.pack(docs, block_docs=100).collect()
    check(out, [(r[0], r[1]) for r in rows])
    sizes = defaultdict(int)
    for r in out:
        sizes[r.sequence_id >> 32] += r.length
    assert len(sizes) == 12 and max(sizes.values()) < 2 * min(sizes.values())


def test_window_count_rises_until_all_fit():
    sizes = np.array([1100] * 7)
    bins = packing.pack_sizes(sizes, 2048)
    assert np.bincount(bins, sizes).max() <= 2048 and len(set(bins.tolist())) == 7
    assert len(packing.pack_sizes(np.zeros(0, dtype=np.int64), 2048)) == 0


def test_empty_table(spark, tmp_path):
    save(spark.createDataFrame([], DOC_SCHEMA), tmp_path, "documents")
    assert packing.query(spark, str(tmp_path)).count() == 0
