"""Near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from meterwise.llm import minhash
from meterwise.llm.components import components


def brute_set(text):
    if text is None:
        return frozenset()
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """doc_id -> (set size, component) by comparing every pair."""
    rows = [(i, brute_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, s) in enumerate(rows):
        for j, t in rows[a + 1:]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in rows}


def near(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def corpus(seed, families=12, size=14):
    rng = random.Random(seed)
    rows, n = [], 0
    for f in range(families):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([6, 20, 60, 200, 400]))]
        for _ in range(size):
            words = near(rng, base, rng.randrange(0, max(1, len(base) // 25) + 1))
            rows.append((n, rng.choice([" ", "  ", "\n"]).join(words)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(frame, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(rows)).collect()}
    assert got == brute(rows)


def test_edge_cases(frame):
    long = " ".join(f"x{i % 997}y{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "One two"), (5, "one  TWO"), (6, "one two three"),
            (7, long), (8, long + " tail"), (9, "É a b c d"), (10, "é a b c d"), (None, "one two"), (11, "one two"),
            (11, "one two"), (12, "a b c d e"), (13, "a b c d e")]
    out = sorted((tuple(r) for r in minhash.near_duplicates(frame(rows)).select(
        "doc_id", "n_shingles", "component_id", "kept").collect()), key=lambda r: (r[0] is None, r[0] or 0))
    want = {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (59_996, 7), 8: (59_997, 7),
            9: (1, 9), 10: (1, 10), 11: (1, 4), 12: (1, 12), 13: (1, 13)}
    assert len(out) == len(rows)
    for doc, n, comp, kept in out[:-1]:
        assert (n, comp) == want[doc] and kept == (doc == comp), doc
    assert out[-1] == (None, 1, None, True)


def test_empty_table(frame):
    assert minhash.near_duplicates(frame([])).collect() == []


def test_a_large_group_of_near_copies_is_whole(frame):
    """One base and many variants that are closer to it than to each other."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    rows = [(0, " ".join(base))] + [(i, " ".join(near(rng, base, rng.randrange(4, 9)))) for i in range(1, 300)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(rows)).collect()}
    assert got == brute(rows)


def test_hashes_do_not_depend_on_the_batch():
    rng = random.Random(3)
    texts = [" ".join(f"t{rng.randrange(50)}" for _ in range(n)).encode() for n in (0, 1, 4, 5, 6, 50, 500)]
    together = minhash.shingle_sets(texts)
    for t, s in zip(texts, together):
        assert np.array_equal(minhash.shingle_sets([t])[0], s)
        assert len(s) == len(brute_set(t.decode()))


def test_pieces_cut_no_word(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("q" * rng.randrange(1, 40) + str(rng.randrange(9)) for _ in range(200)).encode() for _ in range(5)]
    whole = minhash.shingle_sets(texts)
    monkeypatch.setattr(minhash, "PIECE", 64)
    for a, b in zip(whole, minhash.shingle_sets(texts)):
        assert np.array_equal(a, b)


def test_components_both_plans(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1040)]
    edges += [(5000, i) for i in range(5001, 5200)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in root}
    df = spark.createDataFrame(edges, "a long, b long")
    assert dict(map(tuple, components(df).collect())) == want
    monkeypatch.setattr("meterwise.llm.components.SMALL_EDGES", 0)
    assert dict(map(tuple, components(df).collect())) == want
