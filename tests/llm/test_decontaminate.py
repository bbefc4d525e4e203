"""Window hits against brute force; removal of spans and documents."""

import re

import pytest

from meterwise.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, bench):
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for item, t in bench:
            b = words(t)
            n = min(10, len(b))
            for i in range(len(b) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == b[i:i + n]:
                        hit.update(range(j, j + n))
                        if item is not None:
                            items.add(str(item))
        out.append((doc, len(w), len(hit), sorted(items), bool(hit)))
    return out


TEN = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
BENCH = [(1, TEN + " lambda mu"), (2, "Short, item"), (3, None), (4, " .,! "), (10, "éclair Été 9"), (2, TEN.upper()),
         (None, "nameless item text")]
DOCS = [(1, "x " + TEN + " y"), (2, TEN.replace(" ", "... ").title() + " lambda"), (3, None), (4, ""), (5, "short item"),
        (6, "shorT--ITEM and short item short"), (7, "éclair Été 9"), (8, "éclair été 9"), (9, TEN.replace("beta", "b")),
        (10, (TEN + " ") * 400), (None, "short item"), (11, "short item"), (11, "nothing"), (11, "nothing"),
        (12, "nameless item text"), (13, "alpha beta [gamma]")]


@pytest.mark.parametrize("rows", [10**6, 0])
def test_equals_brute_force(frame, monkeypatch, rows):
    """With the broadcast table and with the shuffled one."""
    monkeypatch.setattr(dc, "WINDOW_ROWS", rows)
    got = dc.contamination(frame(DOCS), frame([(i, t) for i, t in BENCH], "item_id long, text string")).select(
        "doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute(DOCS, BENCH), key=key)


def test_one_window_length_only(frame):
    bench = [(1, TEN + " lambda mu nu")]
    got = dc.contamination(frame(DOCS), frame(bench, "item_id long, text string")).select(
        "doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute(DOCS, bench), key=key)


def test_empty_tables(frame):
    bench = frame(BENCH, "item_id long, text string")
    none = frame([], "item_id long, text string")
    assert dc.contamination(frame([]), bench).collect() == []
    assert {r["contaminated"] for r in dc.contamination(frame(DOCS), none).collect()} == {False}
    assert dc.drop_contaminated(frame(DOCS), none).count() == len(DOCS)


def test_removal(frame):
    docs, bench = frame(DOCS), frame(BENCH, "item_id long, text string")
    clean = dc.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    keep = [d for d, r in zip(DOCS, brute(DOCS, BENCH)) if not r[4]]
    assert sorted((r["doc_id"], r["text"] or "") for r in clean.collect()) == sorted((d, t or "") for d, t in keep)
    cut = {r["doc_id"]: r["text"] for r in dc.cut_spans(
        frame([(1, "x, " + TEN + "! y"), (2, "a Short... item b"), (3, "clean — text."), (4, None)]), bench).collect()}
    assert cut == {1: "x, ! y", 2: "a  b", 3: "clean — text.", 4: None}
