"""Conversation structure repair by cost layers.

A conversation's role initials must read ``(s?(ua)+)?``. The grammar has four states: start, after s,
after u, after a (start and after a accept). For each cost from 0 on, a layer holds for every turn the
bitset of states from which the rest can be repaired at exactly that cost; a layer follows from the
layers below it by looking bitsets up in tables of 16 entries. The first layer that holds the start
state at the first turn gives the cost. The audit is traced forwards through the bits: of the
edits (D, I, K, R) whose bit is set, the least letter, hence the least string.

A conversation of up to ``RUN`` rows is repaired at once. A longer one is cut into runs: layers of each
run give its least cost from state to state, one pass over those small rows brings the cost of the rest to
every run, each run is traced from every state, and another pass picks the traces that meet. Runs are
found by range over (conversation, turn, role, text), so no task holds or sorts a long conversation; its
pieces of text and audit, which make one hash and one string by definition, pass through one task as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeline import numbered
from .common import durable, read_table

RUN = 512
SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_ACCEPT = (0, None, None, 0)
#: Next state by state and role (s, u, a, other); -1 is none.
_NEXT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
#: The one state that an inserted or changed role leads to.
_PUT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
#: Bitsets one row back: states whose next state is in the set.
_KEPT = [bytes(sum(1 << s for s in range(4) if _NEXT[s][r] >= 0 and b >> _NEXT[s][r] & 1) for b in range(16)) for r in range(4)]
_MADE = bytes(sum(1 << s for s in range(4) if b >> _PUT[s] & 1) for b in range(16))
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def role_code(role: str) -> int:
    return {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)


def layers(codes: list[int], goal: tuple, last: bool, want: int) -> list[bytearray]:
    """Layers by cost until every state of the bitset ``want`` has shown at the first turn.

    A code is role * 4 + fault. ``goal`` is the cost of what follows by state (None: none); rows may be
    inserted after the last turn where nothing follows (``last``).
    """
    n, found, seen = len(codes), [], 0
    empty = bytearray(n + 1)
    while True:
        c = len(found)
        one, two, three, four = (found[c - k] if c >= k else empty for k in (1, 2, 3, 3))
        row = bytearray(n + 1)
        bits = sum(1 << s for s in range(4) if goal[s] == c)
        row[n] = bits = bits | _MADE[two[n]] if last else bits
        for i in range(n - 1, -1, -1):
            role, fault = codes[i] >> 2, codes[i] & 3
            here = three[i + 1] | _MADE[two[i]]
            if not fault:
                here |= _KEPT[role][bits] | _MADE[two[i + 1]]
            elif fault == TRUNCATED:
                here |= _KEPT[role][one[i + 1]] | _MADE[four[i + 1]]
            row[i] = bits = here
        found.append(row)
        seen |= row[0]
        if seen & want == want:
            return found


def least(found: list[bytearray], state: int) -> int:
    return next(c for c, row in enumerate(found) if row[0] >> state & 1)


def trace(codes: list[int], goal: tuple, last: bool, found: list[bytearray], state: int) -> tuple[str, int]:
    """The least audit from ``state`` at the first turn, and the state that it ends in."""
    c, i, n, audit = least(found, state), 0, len(codes), []
    holds = lambda cost, at, s: cost >= 0 and s >= 0 and found[cost][at] >> s & 1
    while not (i == n and goal[state] == c):
        role, fault = (codes[i] >> 2, codes[i] & 3) if i < n else (3, BLANK)
        more, stays = int(fault == TRUNCATED), fault in (0, TRUNCATED)
        if i < n and holds(c - 3, i + 1, state):
            audit.append("D")
            c, i = c - 3, i + 1
        elif (i < n or last) and holds(c - 2, i, _PUT[state]):
            audit.append("I")
            c, state = c - 2, _PUT[state]
        elif stays and holds(c - more, i + 1, _NEXT[state][role]):
            audit.append("K")
            c, i, state = c - more, i + 1, _NEXT[state][role]
        else:
            audit.append("R")
            c, i, state = c - 2 - more, i + 1, _PUT[state]
    return "".join(audit), state


def repaired(rows: list[tuple[str, str]], audit: str, state: int) -> Iterator[str]:
    """``role:text`` of the rows that ``audit`` leaves, from ``state`` on."""
    at = iter(rows)
    for edit in audit:
        role, text = next(at) if edit != "I" else ("", "")
        if edit == "K":
            yield f"{role}:{text}"
            state = _NEXT[state][role_code(role)]
        elif edit != "D":
            yield f"{_ROLE[state]}:{text}"
            state = _PUT[state]


def illegal(codes: list[int]) -> int:
    return sum((a >> 2, b >> 2) not in _LEGAL for a, b in zip(codes, codes[1:]))


def _own_fault(text: str) -> int:
    text = text.strip(SPACE)
    return BLANK if not text else 0 if text[-1] in ".!?" else TRUNCATED


def _whole(conv_id: int | None, rows: list[tuple]) -> tuple:
    """Result of a conversation of ``(turn, role, text)`` in order."""
    seen, codes = set(), []
    for _, role, text in rows:
        fault = _own_fault(text)
        if fault != BLANK and (role, text) in seen:
            fault = DUPLICATE
        seen.add((role, text))
        codes.append(role_code(role) * 4 + fault)
    faults = [c & 3 for c in codes]
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    found = layers(codes, _ACCEPT, True, 1)
    audit, _ = trace(codes, _ACCEPT, True, found, 0)
    text = "\n".join(repaired([r[1:] for r in rows], audit, 0))
    return (
        conv_id, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal(codes), least(found, 0), audit,
        hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in OUT.split(", ")])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose rows come one after the other."""
    now, rows, out, begun = None, [], [], False
    for batch in batches:
        for conv, turn, role, text, gone in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone"))):
            if begun and conv != now:
                out.append(_whole(now, rows))
                rows = []
            now, begun = conv, True
            if not gone:
                rows.append((turn, role, text))
        if len(out) > 5000:
            yield _batch(out)
            out = []
    if begun:
        out.append(_whole(now, rows))
    if out:
        yield _batch(out)


def damaged(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, gone)``: rows damaged by crc32(``conv_id:turn``) % 20; dropped ones stay as ``gone``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    hit = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _streamed(df: DataFrame, order: list[str], work, schema: str) -> DataFrame:
    """``work`` over the small rows of each conversation in order, as a stream through its task."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInPandas(work, schema)


def _met(a: DataFrame, b: DataFrame, *also: str) -> DataFrame:
    """``a`` with the other columns of ``b`` of the same conversation (a null one too) and the same ``also``."""
    keys = ["conv_id", *also]
    right = b.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in b.columns])
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id"))
    for c in also:
        same &= F.col(c) == F.col(f"_{c}")
    return a.join(right, same).drop(*[f"_{c}" for c in keys])


def _long(rows: DataFrame) -> DataFrame:
    """Results of conversations of any length, ``rows`` without those dropped."""
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # equal rows in any order, but not in one task
    placed = numbered(salted, ["conv_id", "turn", "role", "text", "salt"], "pos").drop("salt")
    starts = placed.groupBy("conv_id").agg(F.min("pos").alias("start"), (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    firsts = placed.groupBy("conv_id", "role", F.sha2("text", 256).alias("sha")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("fresh"))
    stripped = F.rtrim("text", F.lit(SPACE))
    fault = F.when(stripped == "", BLANK).when(F.col("fresh").isNull(), DUPLICATE).when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    coded = _met(placed.join(firsts, "pos", "left"), starts).select(
        "conv_id", "pos", "role", "text", (role * 4 + fault).alias("code"), F.floor((F.col("pos") - F.col("start")) / RUN).alias("run")
    )
    kept = F.array_sort(F.collect_list(F.struct("pos", "code", "role", "text"))).alias("rows")  # at most RUN
    runs = durable(coded.groupBy("conv_id", "run").agg(kept))
    codes = runs.select("conv_id", "run", F.col("rows.code").alias("codes"))

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Least cost from each state to each, -1 where there is no way."""
        for batch in batches:
            made = []
            for codes in map(list, batch["codes"]):
                n, cost = len(codes), [[-1] * 4 for _ in range(4)]
                cost[0][0] = cost[1][1] = 3 * n  # nothing leads back there: all rows go
                first = [0 if not x & 3 else 1 for x in codes if x >> 2 == 0 and x & 3 in (0, TRUNCATED)]
                if first:
                    cost[0][1] = 3 * (n - 1) + min(first)
                for to in (2, 3):
                    found = layers(codes, tuple(0 if s == to else None for s in range(4)), False, 15)
                    for s in range(4):
                        cost[s][to] = least(found, s)
                made.append(sum(cost, []))
            yield pd.DataFrame({"conv_id": batch["conv_id"], "run": batch["run"], "cost": made})

    def backwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cost of what follows each run by state, less the least of it; a last run has none."""
        now, after = object(), None
        for batch in batches:
            goals = []
            for conv, cost in zip(batch["conv_id"].astype("Int64"), batch["cost"]):
                conv = None if pd.isna(conv) else int(conv)
                if conv != now:
                    now, after = conv, None
                goals.append([] if after is None else after)
                end = (0, 4, 2, 0) if after is None else after  # behind the last turn rows may be inserted
                ahead = [min(cost[4 * s + t] + end[t] for t in range(4) if cost[4 * s + t] >= 0) for s in range(4)]
                after = [x - min(ahead) for x in ahead]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "run": batch["run"], "goal": goals})

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            audits, ends, costs = [], [], []
            for codes, after in zip(map(list, batch["codes"]), map(list, batch["goal"])):
                last, goal = not after, tuple(after) if after else _ACCEPT
                found = layers(codes, goal, last, 15)
                each = [trace(codes, goal, last, found, s) for s in range(4)]
                audits.append([a for a, _ in each])
                ends.append([e for _, e in each])
                costs.append([least(found, s) - goal[e] for s, (_, e) in enumerate(each)])
            yield pd.DataFrame({"conv_id": batch["conv_id"], "run": batch["run"], "audits": audits, "ends": ends, "costs": costs})

    def forwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), 0
        for batch in batches:
            states = []
            for conv, ends in zip(batch["conv_id"].astype("Int64"), batch["ends"]):
                conv = None if pd.isna(conv) else int(conv)
                if conv != now:
                    now, state = conv, 0
                states.append(state)
                state = int(ends[state])
            yield pd.DataFrame({"conv_id": batch["conv_id"], "run": batch["run"], "state": states})

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, got = object(), None

        def result():
            conv, counts, _, cost, audit, digest, _ = got
            return pd.DataFrame([(conv, 0, *counts, cost, "".join(audit), digest.hexdigest())], columns=[x.split()[0] for x in OUT.split(", ")]).astype({"conv_id": "Int64"})

        for batch in batches:
            for conv, codes, state, audit, cost, piece, some in zip(*(batch[c] for c in ("conv_id", "codes", "state", "audit", "cost", "piece", "some"))):
                conv = None if pd.isna(conv) else int(conv)
                codes = list(codes)
                if conv != now:
                    if got is not None:
                        yield result()
                    now, got = conv, [conv, [0, 0, 0, 0], [], 0, [], hashlib.sha256(), False]
                for f in (BLANK, DUPLICATE, TRUNCATED):
                    got[1][f - 1] += sum(x & 3 == f for x in codes)
                got[1][3] += illegal(got[2] + codes)
                got[2], got[3] = codes[-1:], got[3] + int(cost)
                got[4].append(audit)
                if some:
                    got[5].update((("\n" if got[6] else "") + piece).encode("utf-8", "surrogatepass"))
                    got[6] = True
        if got is not None:
            yield result()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left = [list(repaired([(r["role"], r["text"]) for r in rows], audit, int(state))) for rows, audit, state in zip(batch["rows"], batch["audit"], batch["state"])]
            yield pd.DataFrame({
                "conv_id": batch["conv_id"], "run": batch["run"], "codes": [[r["code"] for r in rows] for rows in batch["rows"]], "state": batch["state"],
                "audit": batch["audit"], "cost": batch["cost"], "piece": ["\n".join(x) for x in left], "some": [bool(x) for x in left],
            })

    costs = codes.mapInPandas(between, "conv_id long, run long, cost array<long>")
    goals = durable(_streamed(costs, [F.col("run").desc()], backwards, "conv_id long, run long, goal array<long>"))
    ways = durable(_met(codes, goals, "run").mapInPandas(traced, "conv_id long, run long, audits array<string>, ends array<long>, costs array<long>"))
    states = durable(_streamed(ways.select("conv_id", "run", "ends"), ["run"], forwards, "conv_id long, run long, state long"))
    picked = _met(ways, states, "run").select("conv_id", "run", "state", F.get("audits", F.col("state").cast("int")).alias("audit"), F.get("costs", F.col("state").cast("int")).alias("cost"))
    left = _met(runs, picked, "run").mapInPandas(pieces, "conv_id long, run long, codes array<int>, state long, audit string, cost long, piece string, some boolean")
    done = _streamed(left, ["run"], finished, OUT).drop("gaps")
    return _met(done, starts).select(*[x.split()[0] for x in OUT.split(", ")])


def repair(turns: DataFrame, run: int = RUN) -> DataFrame:
    """One row per ``conv_id``: gaps, faults by kind, illegal neighbours, least cost, its least audit, hash of the repair.

    Rows of a conversation come by turn (nulls first), then role, then text, so repeated rows and ties have one
    order; a null conversation is one conversation; null roles and texts are one space; texts of any length are read
    whole; other columns are not looked at; an empty table gives an empty result. Of gaps, null turns count
    for nothing. Conversations of over ``run`` rows are cut.
    """
    found = damaged(turns)
    many = durable(found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > run).select(F.col("conv_id").alias("c")))
    if many.isEmpty():
        rest, cut = found, None
    else:
        same = F.col("conv_id").eqNullSafe(F.col("c"))
        rest, cut = found.join(many, same, "left_anti"), _long(found.where("not gone").join(many, same, "left_semi"))
        zeros = [F.coalesce(c, F.lit(v)).alias(c) for c, v in (*((x, 0) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", ""), ("repaired_sha256", hashlib.sha256(b"").hexdigest()))]
        cut = many.join(cut, same, "left").select(F.col("c").alias("conv_id"), *zeros)
    done = rest.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_short, OUT)
    return done if cut is None else done.unionByName(cut)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read_table(spark, sf_dir, "conversations"))
