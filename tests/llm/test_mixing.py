"""Weights by bisection; block permutations against a plain walk."""

import hashlib
import math
from collections import defaultdict

import pytest

from meterwise.llm import mixing


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def brute_copies(rows, **kw):
    """rows: (doc_id, source, tokens). Walks blocks and documents in order."""
    totals = defaultdict(int)
    for _, s, n in rows:
        totals[s] += n
    copies = {}
    for share in mixing.plan(dict(totals), **kw):
        n_blocks = max(1, -(-share.tokens // mixing.BLOCK_TOKENS))
        blocks = defaultdict(list)
        for i, s, n in rows:
            if s == share.source:
                k = md5("" if i is None else str(i))
                blocks[int(k[:15], 16) % n_blocks].append((k, i, n))
                copies[i] = share.passes if n else 1
        room = share.rest
        for b in sorted(blocks, key=lambda b: (md5(f"block:{b}"), b)):
            for k, i, n in sorted(blocks[b]):
                if n > room:
                    break
                room -= n
                copies[i] += 1 if n else 0
            else:
                continue
            break
    return {i: copies.get(i, 1) for i, _, _ in rows}


def table(frame, rows):
    return frame([(i, " ".join(["w"] * n) if n else None, None, s) for i, s, n in rows])


@pytest.mark.parametrize("block", [10**6, 40])
@pytest.mark.parametrize("kw", [{}, {"max_repeats": 3.5}, {"max_repeats": None, "target_entropy": 0.9},
                                {"max_repeats": None, "target_entropy": 99.0}])
def test_copies_equal_a_plain_walk(frame, monkeypatch, kw, block):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", block)
    rows = [(i, "big" if i % 3 else f"s{i % 5}", 1 + (i * 7) % 23) for i in range(200)]
    rows += [(900, None, 5), (901, "", 3), (902, "empty", 0), (903, "big", 0)]
    monkeypatch.setattr(mixing, "PART_BLOCKS", 2)  # parts of two hex digits for the small blocks
    got = {r["doc_id"]: r["copies"] for r in mixing.schedule(table(frame, rows), **kw).collect()}
    assert got == brute_copies(rows, **kw)
    assert min(got.values()) >= 1


def test_weights_meet_their_target():
    tokens = [1000, 100, 10, 1]
    for target in (0.3, 0.8, 1.2):
        w = mixing.weights(tokens, mixing.solve(tokens, target, None))
        assert abs(mixing.entropy(w) - target) < 1e-6 or mixing.solve(tokens, target, None) in (0.0, 1.0)
    a = mixing.solve(tokens, None, 2.0)
    assert abs(mixing.repeats(tokens, mixing.weights(tokens, a), 1.0) - 2.0) < 1e-6
    assert abs(a - (1 - math.log(2) / math.log(1000))) < 1e-6  # closed form of the limit
    assert mixing.solve([5, 5], None, 2.0) == 0.0 and mixing.solve([], None, 2.0) == 0.0


def test_shares_of_the_result(frame):
    rows = [(i, "big", 10) for i in range(400)] + [(1000 + i, "small", 10) for i in range(100)]
    out = mixing.mix(table(frame, rows))
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert n == {"big": 400, "small": 200}  # 2 passes at most
    assert out.columns == table(frame, rows).columns


def test_edge_cases(frame):
    assert mixing.schedule(frame([])).collect() == [] and mixing.mix(frame([])).collect() == []
    rows = [(1, "a", 3), (1, "a", 3), (2, "a", 1), (None, None, 2), (3, "b", 0)]
    assert mixing.mix(table(frame, rows)).count() >= len(rows)
    with pytest.raises(ValueError):
        big = mixing.MAX_SOURCES
        try:
            mixing.MAX_SOURCES = 1
            mixing.schedule(table(frame, rows))
        finally:
            mixing.MAX_SOURCES = big
