"""Near lines within buckets, and what of a table goes into the buckets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from meterwise.llm import line_buckets as lb
from meterwise.llm import line_dedup as ld
from meterwise.llm import line_simhash as ls
from tests.llm.test_line_dedup import levenshtein


def test_near_pairs_against_a_plain_loop(monkeypatch):
    """However the rows are cut into batches; short lines that cannot be
    similar are left out, no similar one is."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("the and er in ou买 é".split()) for _ in range(rng.randrange(1, 4)))
    rows = []
    for key in range(12):
        base = [word() for _ in range(rng.randrange(3, 9))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            words = [rng.choice([w, w, word()]) for w in base]
            text, ident = " ".join(words), rng.randrange(90)
            sim = sum(rng.getrandbits(1) << b for b in range(0, 60, 2)) - 2**61
            role = rng.choice([(True, True), (False, True), (True, False)])
            rows.append((key // 3, key % 3, ident, *role, len(text), sim, ident % 7, rng.choice([text, text, None])))
    rows.sort(key=lambda r: r[:4])
    names = ["key", "part", "id", "x", "y", "chars", "sim", "comp", "short"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    firsts = {r[:4]: r for r in reversed(rows)}
    most = lambda n: int(n * (1 - ld.SIMILARITY) + 1e-9)
    need, may = set(), set()
    for x in firsts.values():
        for y in firsts.values():
            if not (x[3] and y[4] and x[:2] == y[:2] and x[7] != y[7] and bin((x[6] ^ y[6]) % 2**64).count("1") <= 20
                    and min(x[5], y[5]) >= ld.SIMILARITY * max(x[5], y[5])):
                continue
            told, pair = x[8] is not None and y[8] is not None, (max(x[2], y[2]), min(x[2], y[2]))
            may.add(pair)
            if not told or levenshtein(x[8], y[8]) <= most(max(x[5], y[5])):
                need.add(pair)
    for size, pairs, wide in ((7, 1 << 19, 512), (1000, 64, 512), (60, 50, 3)):
        monkeypatch.setattr(lb, "PAIRS", pairs)
        monkeypatch.setattr(lb, "WIDE", wide)
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + size], strict=True), types,
                                                                             strict=True)], names)
                   for i in range(0, len(rows), size)]
        got = {(r["a"], r["b"]) for out in lb.near(iter(batches), 20, ld.SIMILARITY) for r in out.to_pylist()}
        assert need <= got < may and need


def test_counts_of_runs_never_deny_a_similar_pair():
    rng = random.Random(9)
    texts, a, b, most = [], [], [], []
    for _ in range(400):
        s = [rng.choice("ab é买\U0001F600") for _ in range(rng.randrange(1, 60))]
        t = list(s)
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(t) + 1)
            t[at:at + rng.randrange(0, 2)] = rng.choice(["", "x", "ab"])
        a, b, texts = [*a, len(texts)], [*b, len(texts) + 1], [*texts, "".join(s), "".join(t)]
        most.append(levenshtein(texts[-2], texts[-1]))
    a, b, most = np.array(a), np.array(b), np.array(most)
    assert lb._possible(texts, a, b, most).all()
    assert not lb._possible(texts, a, np.roll(b, 1), np.zeros(len(a), np.int64)).all()


def test_matrices_of_many_pairs_at_once(monkeypatch):
    rng = random.Random(8)
    rows, want = [], []
    for _ in range(250):
        a = "".join(rng.choice("abé ") for _ in range(rng.randrange(0, 120)))
        b = list(a) if rng.random() < 0.7 else [rng.choice("abé ") for _ in range(len(a))]
        for _ in range(rng.randrange(0, 25)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(0, 3)] = rng.choice(["", "x", "ab"])
        d = levenshtein(a, "".join(b))
        rows.append((a, "".join(b), max(0, d + rng.choice([-9, -1, 0, 0, 3]))))
        want.append(d <= rows[-1][2])
    assert 50 < sum(want) < 200
    for bits in (1, 700, 1 << 15):
        monkeypatch.setattr(ls, "BITS", bits)
        assert ls.all_within(rows) == want


def test_a_repeated_line_gives_its_keys_once_in_a_task(frame):
    line = "One line of some words that many documents of a table have"
    keys = lambda n: ld._keys(ld._lines(
        frame([(i, line) for i in range(n)]).coalesce(1).select("doc_id", "text"))).count()
    assert keys(50) == keys(1) > 0


@pytest.mark.parametrize("passes", [4, 0])
def test_wide_buckets_in_parts_and_texts_in_passes(frame, monkeypatch, passes):
    """Buckets over the size of a part, and more texts than may be broadcast, give the same groups."""
    rng = random.Random(29)
    syllables = "th he an re on er in nd st ea".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 3)))
    lines = [" ".join(word() for _ in range(8)) for _ in range(250)]
    lines += [line[:9] + "x" + line[10:] for line in lines[:60]] + lines[:20]
    docs = [*enumerate(lines), (None, lines[3] + " end")]
    groups = lambda: sorted(ld.dedup_lines(frame(docs)).collect(), key=str)
    want = groups()
    tiles, roles = [], ld._roles

    def watched(placed, most):
        tiles.append(most)
        out = roles(placed, most)
        tiles.append(out.where("part > 0").count())
        return out

    monkeypatch.setattr(ld, "_roles", watched)
    monkeypatch.setattr(ld, "PART", 5)
    monkeypatch.setattr(ld, "PASSES", passes)
    monkeypatch.setattr(ld, "BROADCAST_ROWS", 100)
    assert groups() == want
    assert tiles[0] > 5 and tiles[1] > 0
    assert sum(not r["kept"] for r in want) >= 60
