"""Nearest neighbours against exact search."""

import numpy as np
from pyspark.sql import functions as F

from meterwise.llm import ann


def exact(rows, k):
    sound = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[i] = min(sound[i], v) if i in sound else v
    out = {}
    for q, v in sound.items():
        if q % 20 == 0:
            s = [(-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in sound.items()
                 if i != q and len(w) == len(v)]
            out[q] = sorted(s)[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def vectors(seed, n, dim, kinds=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(kinds, dim))
    x = centers[rng.integers(0, kinds, n)] + 0.5 * rng.normal(size=(n, dim))
    return [(i, [float(np.float32(a)) for a in row]) for i, row in enumerate(x * rng.uniform(0.2, 3, (n, 1)))]


def test_recall_and_exact_scores(frame, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 400)
    monkeypatch.setattr(ann, "QUERIES", 20)
    rows = vectors(1, 1500, 64)
    got = found(ann.search(frame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0))
    want = exact(rows, 20)
    assert set(got) == set(want)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    x = dict(rows)
    for q, best in got.items():
        assert [r for r, _, _ in best] == list(range(1, 21))
        for _, i, s in best:
            assert abs(s - float(np.dot(x[q], x[i]))) < 1e-9


def test_edge_cases(frame):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]),
            (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [0.5, 0.5]), (9, [2.0]), (40, [3.0]), (None, [9.0, 9.0]), (8, [0.5, 0.5]),
            (60, []), (10, [-1.0, 0.0])]
    got = found(ann.search(frame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=3))
    assert [i for _, i, _ in got[0]] == [1, 2, 20] and [i for _, i, _ in got[20]] == [0, 1, 2]
    assert got[40] == [(1, 9, 6.0)] and set(got) == {0, 20, 40}
    assert ann.search(frame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect() == []


def test_error_bound_holds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 64))
    q = rng.normal(size=(50, 64))
    code, norm, scalar = ann.encode(x)
    signs = np.unpackbits(code, axis=1, count=64) * 2.0 - 1
    estimate = (q @ ann.rotation(64)) @ signs.T * (norm / (scalar * 8))
    error = np.abs(estimate - q @ x.T) / np.linalg.norm(q, axis=1)[:, None]
    bound = ann.BOUND * norm * np.sqrt(1 - scalar**2) / scalar / np.sqrt(63)
    assert (error <= bound).mean() > 0.995
    assert code.shape == (2000, 8)


def same_as_exact(frame, rows, k=5):
    got = found(ann.search(frame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=k))
    x = {i: np.array(v) for i, v in rows}
    power = {i: np.frexp(np.abs(v).max())[1] for i, v in x.items()}
    part = {i: np.ldexp(v, -power[i]) for i, v in x.items()}
    for q in (i for i in x if i % 20 == 0):
        with np.errstate(over="ignore"):
            s = sorted((-float(np.ldexp(part[q] @ part[i], power[q] + power[i])), i) for i in x if i != q)[:k]
        assert [i for _, i, _ in got[q]] == [i for _, i in s], q
        assert np.allclose([sc for _, _, sc in got[q]], [-m for m, _ in s], rtol=1e-12, atol=0), q


def test_any_magnitude_is_searched(frame, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 60)
    for scale in (1e25, 1e-30, 1e39, 1e200, 1e-200):
        same_as_exact(frame, [(i, [a * scale for a in v]) for i, v in vectors(3, 200, 16)])


def test_vectors_of_mixed_magnitude(frame):
    rng = np.random.default_rng(7)
    rows = [(i, [float(a) for a in rng.normal(size=16) * s]) for i, s in
            enumerate(rng.choice([1.0, 1e-3, 1e39, 1e-60, 1e150], 300, p=[0.6, 0.2, 0.05, 0.1, 0.05]))]
    same_as_exact(frame, rows)
