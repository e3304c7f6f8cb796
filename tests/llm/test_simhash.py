import xxhash

from flowloom.llm import simhash

from .helpers import DOC_SCHEMA, documents, edge_rows, lower_ascii, root_table, rows_of, save, split_words, words


def brute_fingerprint(text):
    w = split_words(lower_ascii(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    known = [(i, f) for i, f in fps if i is not None]
    pairs = [(a, b) for k, (a, f) in enumerate(known) for b, g in known[:k] if (f ^ g).bit_count() <= 4]
    root = root_table(pairs, {i for i, _ in known})
    return sorted(((i, f"{f:016x}", root.get(i)) for i, f in fps), key=str)


def near_rows():
    base = words(11, 400).split()
    rows = []
    for k in range(60):
        w = list(base)
        for j in range(k % 4):
            w[(37 * k + j) % 400] = f"x{k}{j}"
        rows.append((100 + k, " ".join(w), "en", "s", 1))
    return rows + [(200 + k, words(1000 + k, 50), "en", "s", 1) for k in range(150)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = edge_rows() + near_rows()
    save(documents(spark, rows, clash=True), tmp_path, "documents")
    got = rows_of(simhash.query(spark, str(tmp_path)), "doc_id", "fingerprint", "component_id")
    assert sorted(got, key=str) == brute(rows)


def test_many_blocks_and_small_tiles_lose_no_link(spark):
    rows = near_rows()
    docs = documents(spark, rows)
    want = brute(rows)
    got = simhash.near_duplicates(docs, tile=7)
    assert sorted(rows_of(got, "doc_id", "fingerprint", "component_id"), key=str) == want
    nodes = simhash.fingerprints(docs).groupBy("fp").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "id")
    for n in (10, 10**6, 10**9):
        found = simhash.links(nodes, n, 4, 2048).collect()
        ids = {r.id: r.fp for r in nodes.collect()}
        pairs = [(a, b) for a in ids for b in ids if a < b and ((ids[a] ^ ids[b]) & (2**64 - 1)).bit_count() <= 4]
        assert root_table([(r.a, r.b) for r in found], ids) == root_table(pairs, ids)


def test_every_pair_within_four_bits_shares_a_key(spark):
    import random

    r = random.Random(5)
    for blocks in (6, 8, 11, 16):
        for _ in range(200):
            a = r.getrandbits(64)
            b = a
            for bit in r.sample(range(64), 4):
                b ^= 1 << bit
            edges = [round(64 * i / blocks) for i in range(blocks + 1)]
            same = sum(((a ^ b) >> lo) & ((1 << (hi - lo)) - 1) == 0 for lo, hi in zip(edges, edges[1:]))
            assert same >= blocks - 4


def test_empty_table_and_stage(spark, tmp_path):
    save(spark.createDataFrame([], DOC_SCHEMA), tmp_path, "documents")
    assert simhash.query(spark, str(tmp_path)).count() == 0
    docs = documents(spark, clash=True)
    out = simhash.stage(spark, docs, "")
    assert out.columns == docs.columns
    root = {(i, f): c for i, f, c in brute(edge_rows())}
    kept = sorted((r.doc_id for r in out.collect()), key=str)
    want = sorted({i for (i, _), c in root.items() if i == c} | {None}, key=str)
    assert kept == want
