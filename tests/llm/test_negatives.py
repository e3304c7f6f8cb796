"""Hard negatives against plain products of Python integers."""

import math
import random

import numpy as np
import pytest

from flowloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100):
    def sound(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])

    made = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e, label in filter(sound, rows)]
    anchors = sorted({(i, label, tuple(q)) for i, label, q in made if i % every == 0})
    out = []
    for a, own, q in anchors:
        scored = [(-sum(x * y for x, y in zip(q, r)), i, label) for i, label, r in made if i != a]
        for s, i, _ in sorted(x for x in scored if x[2] == own)[:5]:
            fit = sorted(x for x in scored if x[2] != own and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(a, i, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return sorted(out)


def got(spark, rows, **more):
    return sorted(tuple(r) for r in H.hard_negatives(spark.createDataFrame(rows, SCHEMA), **more).collect())


def vectors(seed, n, d=16, clusters=6):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((clusters, d))
    of = r.integers(0, clusters, n)
    x = centres[of] + 0.4 * r.standard_normal((n, d))
    return [(i, [float(v) for v in x[i]], int(r.integers(0, 10) if r.random() < 0.5 else of[i])) for i in range(n)]


@pytest.mark.parametrize("block", [3, 4096])
def test_equals_plain_products(spark, block):
    rows = vectors(1, 900)
    assert got(spark, rows, every=20, block=block) == plain(rows, 20)


def test_edges(spark):
    """Nulls, ties, repeats, negative and zero scores, other lengths."""
    rows = vectors(2, 200, 4) + [
        (None, [1.0] * 4, 1), (300, None, 1), (400, [1.0, None, 0.0, 0.0], 1), (500, [float("nan"), 0.0, 0.0, 0.0], 1), (600, [float("inf")] * 4, 2), (700, [1.0] * 4, None),
        (800, [0.0] * 4, 3), (900, [-3.0, -3.0, -3.0, -3.0], 4), (1000, [2.0, 2.0], 5), (1100, [], 6), (1200, [1e5, -1e5, 1e5, 0.0], 2),
    ]
    rows += [(2000 + k, [0.5, 0.5, 0.5, 0.5], k % 3) for k in range(30)] + [(2100, [0.5, 0.5, 0.5, 0.5], 1)] * 3
    random.Random(1).shuffle(rows)
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == got(spark, [(1, [1.0], 1)]) == []
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", score long, q string")
    assert sorted(tuple(r) for r in H.hard_negatives(wide).collect()) == plain(rows)


def test_bounds_hold_and_discard():
    """No pair that can count is discarded, and few others survive."""
    r = np.random.default_rng(3)
    base = r.standard_normal((3, 64)) * 300
    q = np.floor(base[r.integers(0, 3, 3000)] + 40 * r.standard_normal((3000, 64))).astype(np.int64)
    rotation = H.Rotation(q.T.astype(float) @ q)
    exact = q @ q[:50].T
    low = np.sort(exact, axis=0)[-6].astype(float)
    i, j = rotation.survivors(rotation.of(q), rotation.of(q[:50]), np.ones((3000, 50), dtype=bool), low, np.full(50, np.inf))
    due = set(zip(*np.nonzero(exact >= low[None, :])))
    assert due <= set(zip(i, j)) and len(i) < 2 * len(due)
    first = rotation.steps[0]
    y = rotation.of(q)[0]
    assert (np.abs(y[:, :first]).sum() > np.abs(y[:, first:]).sum()) and np.allclose(rotation.turn @ rotation.turn.T, np.eye(64))
