"""Structure repair against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from flowloom.llm import turn_repair as T

from .helpers import CLASHES, words

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def cheapest(faults, roles):
    """Least (cost, audit) and its roles by a search that pops the least first; states are written out as role strings' last letters."""
    fits = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, kept = heapq.heappop(heap)
        if i == len(faults) and last in ("", "a"):
            return cost, audit, kept
        if (i, last) in done:
            continue
        done.add((i, last))
        for r in "ua":
            if r in fits[last]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, r, (*kept, (None, r))))
        if i < len(faults):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, kept))
            more = faults[i] == "truncated"
            if faults[i] in ("", "truncated"):
                if roles[i] and roles[i] in fits[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles[i], (*kept, (i, None))))
                for r in "ua":
                    if r in fits[last]:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, r, (*kept, (i, r))))
    raise AssertionError


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = damage([r for r in rows if r[0] == conv])
        faults, seen = [], set()
        for _, _, role, text in own:
            solid = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        roles = [r[2][:1] for r in own]
        turns = {r[1] for r in own} - {None}
        cost, audit, kept = cheapest(faults, roles)
        full = {"u": "user", "a": "assistant"}
        lines = [f"{full[r] if r else own[i][2]}:{'' if i is None else own[i][3]}" for i, r in kept]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversations(seed, n, longest=12):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None]) if turn else r.choice(["system", "user", "assistant"])
            text = r.choice([words(r.randint(1, 99), 3) + ".", words(r.randint(1, 99), 4) + "?\n ", "cut off", "ok!", "  \t\n", "", None, "Größe 😀."])
            rows.append((conv, r.choice([turn, turn, turn, turn + 2, None]), role, text))
    return rows


def got(spark, rows, clash=False, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        df = df.selectExpr("*", *[f"cast(null as {p.split()[1]}) as {p.split()[0]}" for p in CLASHES.split(", ")], "1 as gone", "2 as run", "'x' as audit")
    return sorted((tuple(r) for r in T.repair(df, **more).collect()), key=str)


def test_equals_a_search_over_edits(spark):
    rows = conversations(1, 150) + [(None, None, None, None), (None, 1, "user", "hi."), (None, 1, "user", "hi."), (-5, 2**40, "assistant", words(4, 5000))]
    rows += [(900, t, "user", "same.") for t in range(9)] + [(901, 3, "user", "tie."), (901, 3, "assistant", "tie."), (901, 3, "user", "tie.")]
    assert got(spark, rows, clash=True) == plain(rows)


def test_conversations_without_rows_left(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    want = [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(spark, [(conv, 0, "user", "gone.")]) == want == plain([(conv, 0, "user", "gone.")])
    assert got(spark, [(conv, 0, "user", "gone.")] * 3, run=2) == want
    assert got(spark, []) == []


@pytest.mark.parametrize("size", [1, 3, 16])
def test_cut_conversations(spark, size, monkeypatch):
    """Runs of any length give the same as the whole conversation."""
    monkeypatch.setattr(T, "RUN", size)
    rows = conversations(7, 25, 60) + [(None, t, "user", "x.") for t in range(20)] + [(700, 5, "user", "same")] * 40
    assert got(spark, rows, run=10) == plain(rows)


def test_layers_of_one_run():
    """s u a is kept at no cost; two users need an answer between them."""
    s, u, a = 0, 4, 8
    for codes, cost, audit in (([s, u, a], 0, "KKK"), ([u, u, a], 2, "KIKK"), ([a], 2, "IK"), ([u + T.TRUNCATED, a], 1, "KK"), ([u, a + T.BLANK], 5, "KDI"), ([], 0, "")):
        found = T.layers(codes, T._ACCEPT, True, 1)
        assert (len(found) - 1, T.trace(codes, T._ACCEPT, True, found, 0)[0]) == (cost, audit)
