"""Hard negatives against a plain search over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterwise.llm import negatives

COLUMNS = "vec_id long, embedding array<double>, label int"


def brute(rows):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (label, [max(min(math.floor(256 * x) if abs(x) < 2**60 else int(math.copysign(2**60, x)), 2**60), -2**60)
                       for x in v])
        best[i] = min(best.get(i, key), key)
    out = set()
    dot = lambda a, b: max(min(sum(x * y for x, y in zip(a, b, strict=True)), 2**63 - 1), 1 - 2**63)
    for a, (label, v) in best.items():
        if a % 50:
            continue
        others = sorted((-dot(v, w), i, m) for i, (m, w) in best.items() if i != a and len(w) == len(v))
        for p, i, _ in [o for o in others if o[2] == label][:5]:
            fit = [(s, j) for s, j, m in others if m != label and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out |= {(a, i, r, j, -p, -s) for r, (s, j) in enumerate(fit, 1)}
    return out


def mined(frame, rows):
    got = [tuple(r) for r in negatives.mine(frame(rows, COLUMNS), F.col("vec_id") % 50 == 0, F.col("label")).collect()]
    assert len(got) == len(set(got))
    return set(got)


def rows_of(seed, n, dim=16, scale=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, dim))
    own = rng.integers(0, 5, n)
    x = (centers[own] + 0.7 * rng.normal(size=(n, dim))) * rng.uniform(0.2, 2, (n, 1)) * scale
    # labels partly apart from directions, so that negatives come close
    label = np.where(rng.random(n) < 0.6, own, rng.integers(0, 5, n))
    return [(i, [float(a) for a in v], int(m)) for i, (v, m) in enumerate(zip(x, label, strict=True))]


def test_equals_brute_force(frame):
    rows = rows_of(1, 1500)
    want = brute(rows)
    assert len(want) > 100 and mined(frame, rows) == want


def test_small_parts_blocks_and_strides(frame, monkeypatch):
    for name, value in (("ANCHORS", 7), ("CANDIDATES", 200), ("STRIDE", 16), ("WALKERS", 8)):
        monkeypatch.setattr(negatives, name, value)
    rows = rows_of(2, 1200, dim=8)
    assert mined(frame, rows) == brute(rows)


@pytest.mark.parametrize("scale", [1e6, 1e12, 1e25, 1e300, 1e-9])
def test_magnitudes(frame, scale):
    rows = rows_of(3, 200, dim=4, scale=scale)
    assert mined(frame, rows) == brute(rows)


def test_edge_cases(frame):
    nan, inf = float("nan"), float("inf")
    same = [(100 + i, [1.0, 0.5], 1) for i in range(12)]
    rows = [*same, *[(200 + i, [0.7, 0.4], 2) for i in range(1, 8)], (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1),
            (50, [0.0, 0.0], 1), (350, [-1.0, -1.0], 2), (1, None, 1), (2, [nan, 1.0], 1), (3, [None, 1.0], 1), (4, [inf, 1.0], 2),
            (5, [0.7, 0.4], None), (None, [0.7, 0.4], 2), (6, [1.0], 2), (150, [1.0], 2), (7, [0.8], 1), (450, [], 1), (8, [], 1),
            (9, [], 2), (250, [0.9, 0.9, 0.9], 1), (11, [-0.5, 0.0], 2)]
    want = brute(rows)
    assert want and mined(frame, rows) == want
    assert mined(frame, []) == set()


def test_walks_end_early():
    rng = np.random.default_rng(4)
    centers = np.eye(32)[:4] * 40
    x = np.round(centers[rng.integers(0, 4, 4000)] * 50 + rng.normal(size=(4000, 32)) * 60)
    seen = []

    class Counting(negatives.Scorer):
        def __call__(self, rows, cols):
            seen.append(len(rows) * len(cols))
            return super().__call__(rows, cols)

    a = x[(x @ centers[0]) > (x @ centers[1:4].T).max(1)][:40]
    plain, negatives.Scorer = negatives.Scorer, Counting
    try:
        found = negatives.walk(a, np.full(40, -2**62), np.full(40, 2**62), np.zeros(40), True, np.full(40, -1),
                               centers[0] / 40, x, np.zeros(4000), np.arange(4000), 5)
    finally:
        negatives.Scorer = plain
    assert sum(seen) < 0.5 * 40 * 4000
    scores = a @ x.T
    for i in range(40):
        assert list(found[1][found[0] == i]) == list(np.lexsort((np.arange(4000), -scores[i]))[:5])
