"""Conversation repair against a search over all repairs, row by row."""

import hashlib
import random
import zlib

import pytest

from meterwise.llm import dialogue

COLUMNS = "conv_id long, turn long, role string, text string"
WHITE = dialogue.WHITE


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        s = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{s(c)}:{s(t)}".encode()) % 20
        role, text = s(role), s(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows, ids):
    """Every conversation by a search over (cost, audit, repaired rows)."""
    out = {}
    for conv in set(ids) | {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            body = text.strip(WHITE)
            fault = "blank" if not body else "dup" if (role, text) in seen else "cut" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))

        def legal(prefix, letter):
            return letter == "u" if prefix[-1:] in ("s", "a") else letter in ("su" if not prefix else "a")

        states = {"": (0, "", ())}
        def add(to, letter, way):
            if way < to.get(letter, (10**9,)):
                to[letter] = way
        def inserts(states):
            for _ in range(3):
                for end, (cost, audit, lines) in list(states.items()):
                    for name in ("user", "assistant"):
                        if legal(end, name[0]):
                            add(states, name[0], (cost + 3, audit + "I", lines + ((name, ""),)))
            return states
        states = inserts(states)
        for (_, role, text), fault in zip(own, faults):
            new = {}
            for end, (cost, audit, lines) in states.items():
                add(new, end, (cost + 4, audit + "D", lines))
                if fault in ("blank", "dup"):
                    continue
                extra = 3 if fault else 0
                if role and legal(end, role[0]):
                    add(new, role[0], (cost + extra, audit + "K", lines + ((role, text),)))
                for name in ("user", "assistant"):
                    if legal(end, name[0]):
                        add(new, name[0], (cost + 3 + extra, audit + "R", lines + ((name, text),)))
            states = inserts(new)
        cost, audit, lines = min(w for end, w in states.items() if end in ("", "a"))
        said = "\n".join(f"{r}:{t}" for r, t in lines)
        out[conv] = (gaps, faults.count("blank"), faults.count("dup"), faults.count("cut"), illegal, cost, audit,
                     hashlib.sha256(said.encode()).hexdigest())
    return out


def repaired(df):
    rows = df.collect()
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: tuple(r[1:]) for r in rows}


def conversations(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]) if rng.random() < 0.4 else \
                ("user", "assistant")[t % 2]
            out.append((c, t, role, rng.choice(["Hi.", "Yes!", "no", "", " \n", "What?  ", f"text {t}.", f"cut {t}", None])))
    return out


def test_equals_brute_force(frame):
    rows = conversations(1, 120, 9)
    df = frame(rows, COLUMNS)
    assert repaired(dialogue.repair(dialogue.damage(df), df)) == brute(damaged(rows), {r[0] for r in rows})


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_conversations_of_many_blocks(frame, monkeypatch, bits):
    monkeypatch.setattr(dialogue, "BLOCK_BITS", bits)
    rows = conversations(2, 12, 40) + [(77, t, "user", "same") for t in range(30)]
    df = frame(rows, COLUMNS)
    assert repaired(dialogue.repair(dialogue.damage(df), df)) == brute(damaged(rows), {r[0] for r in rows})


def test_edge_cases(frame):
    big = 2**63 - 1
    rows = [(1, None, "user", "Null turn."), (1, 3, "user", "Tie."), (1, 3, "assistant", "Tie."), (1, 3, "user", "Tie."),
            (2, None, None, None), (None, 1, "user", "No id."), (None, 1, "user", "No id."), (None, 2, "assistant", "Yes."),
            (3, -big, "user", "Far."), (3, big, "assistant", "Away."), (4, 0, "", "No role."), (5, 0, "system", "Alone."),
            (6, 0, "ultra", "Kept."), (6, 1, "a", "x" * 300_000 + "."), (7, 0, "system", "S."), (7, 1, "assistant", "A.")]
    got = repaired(dialogue.repair(frame(rows, COLUMNS)))
    said = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = brute(said, set())
    assert want[3][0] > big
    want[3] = (None, *want[3][1:])
    assert got == want
    assert got[2][6] == "D"
    ids = frame([(8, 0, "user", "x"), (1, 0, "user", "x"), (8, 0, "user", "x")], COLUMNS)
    got = repaired(dialogue.repair(frame([], COLUMNS), ids))
    assert got == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (1, 8)}
    assert dialogue.repair(frame([], COLUMNS)).collect() == []


def test_prices_are_costs_and_work_is_linear():
    rng = random.Random(5)
    codes = "".join(rng.choice("abbbcccbcefghijkl") for _ in range(20_000))
    price = dialogue.auction(codes, dialogue.FINAL)
    state, cost, audit = dialogue.walk(codes, dialogue.FINAL, price, 0)
    assert state in (0, 3) and cost == price[0][0] and len(audit) - audit.count("I") == len(codes)
    for i in range(len(codes)):
        for s in range(4):
            assert price[i][s] == min(c + price[i + n][t] for c, n, t, _ in dialogue.ARCS[codes[i]][s])
