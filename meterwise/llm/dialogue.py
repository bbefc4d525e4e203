"""Repair of conversation structure by the cheapest edits.

A conversation's rows are taken by turn (nulls first; rows of one turn by role,
then text). A row may be blank (no character other than white space), a
duplicate (role and text seen earlier in its conversation) or truncated (its
last such character is none of ``.!?``); the first of these counts. Edits turn
the rows into one that alternates, initials ``(s?(ua)+)?``: Keep a row (0),
Rerole it to user or assistant (3), Delete it (4; blank and duplicate rows must
go), Insert a user or assistant row without text (3). A truncated row that stays
costs 3 more. Of equally cheap repairs the one whose edit initials come first in
ASCII order is taken.

Method: the repairs of a conversation are the paths through a lattice of nodes
(row, state), the state being what the kept rows end with (nothing, s, u, a). The
auction algorithm finds shortest paths by node prices: the path's end node is
compared with its cheapest arc; if its price is too low, it is raised and the
path contracts by that node, otherwise the path extends along the arc. All nodes
are taken as origins, from the last row to the first, and a path stops at a
node whose price is final, so the work grows with the number of rows. In the end
every price is the cost of the rest, an arc is tight if its cost is the difference
of its ends' prices, all cheapest repairs consist of tight arcs, and the walk that
takes the first tight arc in ASCII order is the wanted one.

A conversation may hold any share of all rows. Its order is a range-partitioned
sort that splits it, first occurrences are minima joined by a key, and the lattice
is cut into blocks of at most ``BLOCK`` rows of one character each. A conversation
of several blocks first gets each block's costs between the four states at its
ends (sixteen numbers a block; these meet in one task), which give the prices at
all block ends and, after the blocks' walks from each of the four states, the
state in which each block is entered. Only the SHA-256 of a repaired conversation,
which is sequential by definition, is taken in one task, over a sorted stream in
constant memory.

Edge cases: nulls in role and text count as one space; a null id is a conversation
of its own; a null turn comes first and takes no part in ``gaps``. A role that
starts with another letter, or with none, cannot be kept. Ids without rows give
zeros and the hash of an empty string; an empty table without ids gives an empty
result. ``gaps`` is null where it does not fit into a long. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.scratch import materialize

WHITE = " \t\n\x0b\x0c\r"
#: Rows of a block, as a power of two.
BLOCK_BITS = 16
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
ENDS = "suax"
LEGAL = {"su", "ua", "au"}
#: States are 0 nothing, 1 s, 2 u, 3 a; the one that a new user or assistant row leads to.
NEXT = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
FREE = 1 << 60


def _arcs(code: int) -> list[list[tuple[int, int, int, str]]]:
    """By state: (cost, rows taken, next state, initial), in ASCII order, of a
    row with ``code`` (letter of its initial + 4 * (0 sound, 1 truncated, 2 must go))."""
    letter, fault = ENDS[code % 4], code // 4
    extra = TRUNCATED * (fault == 1)
    out = []
    for s in range(4):
        arcs = [(DELETE, 1, s, "D"), (INSERT, 0, NEXT[s], "I")]
        if fault < 2:
            if s in KEEPS[letter]:
                arcs.append((extra, 1, KEEPS[letter][s], "K"))
            arcs.append((REROLE + extra, 1, NEXT[s], "R"))
        out.append(arcs)
    return out


ARCS = {chr(97 + code): _arcs(code) for code in range(12)}
_LAST = [[(INSERT, 0, NEXT[s], "I")] for s in range(4)]


def auction(codes: str, ends: list[int]) -> list[list[int]]:
    """Prices (rows + 1 times 4 states): each node's cheapest cost to leave the
    block, ``ends`` being the prices of the states behind it. ``FREE`` or more
    marks nodes without a way out."""
    after = list(ends)
    layers = []
    for i in range(len(codes), -1, -1):
        last = i == len(codes)
        table = _LAST if last else ARCS[codes[i]]
        # nodes with a way out, by inserts within the layer if need be
        out = [(after[s] if last else min(after[t] for _, d, t, _ in table[s] if d)) < FREE for s in range(4)]
        for s in (3, 2, 1, 0, 3):
            out[s] = out[s] or out[NEXT[s]]
        # no arc leads below the cheapest node of the next layer, so prices may start there
        price = [min(after) if x else FREE for x in out]
        final = [not x for x in out]
        for origin in range(4):
            path = [origin]
            while not final[path[-1]]:
                s = path[-1]
                best, to, done = (after[s], s, True) if last else (FREE, s, True)
                for cost, rows, t, _ in table[s]:
                    c = cost + (after[t] if rows else price[t])
                    if c < best:
                        best, to, done = c, t, bool(rows)
                if price[s] < best:
                    price[s] = best  # raise, and contract unless at the origin
                    if len(path) > 1:
                        path.pop()
                elif done:
                    break  # the arc leads to a later row, whose price is final
                else:
                    path.append(to)
            for s in path:
                final[s] = True
        layers.append(price)
        after = price
    return layers[::-1]


def walk(codes: str, ends: list[int], price: list[list[int]], state: int) -> tuple[int, int, str]:
    """(state behind the block, cost, edit initials) of the first tight path."""
    audit, cost, i = [], 0, 0
    while i < len(codes) or price[i][state] != ends[state]:
        for c, rows, t, initial in (ARCS[codes[i]][state] if i < len(codes) else _LAST[state]):
            if price[i][state] == c + price[i + rows][t]:
                audit.append(initial)
                cost, i, state = cost + c, i + rows, t
                break
        else:
            raise AssertionError("no tight arc")
    return state, cost, "".join(audit)


FINAL = [0, FREE, FREE, 0]


def _initials(codes: str) -> str:
    return "".join(ENDS[(ord(c) - 97) % 4] for c in codes)


def _illegal(letters: str) -> int:
    return sum(letters[i:i + 2] not in LEGAL for i in range(len(letters) - 1))


def _transfer(batches):
    """Costs from each state before a block to each state behind it."""
    for batch in batches:
        codes = batch.column(2).to_pylist()
        costs = []
        for c in codes:
            to = [auction(c, [0 if s == t else FREE for s in range(4)])[0] for t in range(4)]
            costs.append([min(to[t][s], FREE) for s in range(4) for t in range(4)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64())),
             pa.array([_initials(c[0] + c[-1]) for c in codes], pa.string())], names=["c", "block", "costs", "edge"])


def _block_ends(rows: pd.DataFrame) -> pd.DataFrame:
    """Prices behind each block of a conversation, from its last block on, and
    whether the rows on both sides of a block's start are an illegal pair."""
    rows = rows.sort_values("block")
    ends, price = [], FINAL
    for costs in reversed(rows["costs"].tolist()):
        ends.append(price)
        m = np.array(costs, np.int64).reshape(4, 4) + np.array(price, np.int64)
        price = [min(int(x), FREE) for x in m.min(1)]
    edges = rows["edge"].tolist()
    joint = [0] + [int(a[1] + b[0] not in LEGAL) for a, b in zip(edges, edges[1:])]
    return pd.DataFrame({"c": rows["c"], "block": rows["block"], "ends": ends[::-1], "joint": joint})


_WAY = pa.struct([("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])


def _solve(batches):
    """Walks through each block from the states it may be entered in: only
    from 0 if it is its conversation's only one (no ``ends``)."""
    for batch in batches:
        ways, illegal = [], []
        for codes, ends, joint in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            price = auction(codes, ends or FINAL)
            ways.append([dict(zip(("state", "cost", "audit"), walk(codes, ends or FINAL, price, s), strict=True))
                         if price[0][s] < FREE else None for s in range(4 if ends else 1)])
            illegal.append(_illegal(_initials(codes)) + (joint or 0))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(5), pa.array(ways, pa.list_(_WAY)),
             pa.array(illegal, pa.int64())], names=["c", "block", "first", "ways", "illegal"])


def _entered(rows: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of a conversation is entered."""
    rows = rows.sort_values("block")
    state, entry = 0, []
    for to in rows["to"]:
        entry.append(state)
        state = int(to[state])
    return pd.DataFrame({"c": rows["c"], "block": rows["block"], "entry": entry})


class _Digest:
    """SHA-256 of one conversation's repaired rows, fed in order."""

    def __init__(self):
        self.sha, self.state, self.edits, self.at, self.some = hashlib.sha256(), 0, "", 0, False

    def _line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.some else ''}{role}:{text}".encode("utf-8", "replace"))
        self.some = True

    def inserts(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.state = NEXT[self.state]
            self._line(NAMES[self.state], "")
            self.at += 1

    def block(self, audit: str) -> None:
        self.inserts()
        self.edits, self.at = audit, 0

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEEPS[role[0]][self.state]
            self._line(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._line(NAMES[self.state], text)

    def end(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


def _digests(batches):
    """Rows (c, pos, kind, role, text) sorted by the first three: of kind 0 are
    the edits of a block (in ``text``), of kind 1 its rows."""
    now, digest = None, None
    for batch in batches:
        done, found = [], []
        for a in range(0, batch.num_rows, 256):
            piece = batch.slice(a, 256)
            for c, kind, role, text in zip(*(piece.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if c != now:
                    if digest is not None:
                        done.append(now)
                        found.append(digest.end())
                    now, digest = c, _Digest()
                if kind:
                    digest.row(role, text)
                else:
                    digest.block(text)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array(found, pa.string())],
                                         names=["c", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([digest.end()], pa.string())],
                                         names=["c", "repaired_sha256"])


def _key(conv: Column) -> Column:
    return F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv.cast("string")))


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text) with planted faults,
    chosen by the CRC-32 of ``conv_id:turn`` modulo 20."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    hurt = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    return hurt.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text) and of
    ``ids`` (conv_id): conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    order = ["c", "turn", "role", "text"]
    placed = materialize(
        rows.select(_key(F.col("conv_id")).alias("c"), "conv_id", "turn", said("role"), said("text"))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("pos", F.monotonically_increasing_id()), "turns")
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    narrow = materialize(placed.select(
        "c", "turn", "pos", "role", F.unhex(F.sha2("text", 256)).alias("said"), end.alias("end")), "turn-marks")
    first = (narrow.where("end <> ''").groupBy("c", "role", "said")
             .agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    marked = narrow.join(materialize(first, "repeated"), ["c", "role", "said"], "left")
    blank = F.col("end") == ""
    again = ~blank & F.coalesce(F.col("pos") != F.col("first"), F.lit(False))
    cut = ~blank & ~again & ~F.col("end").isin(".", "!", "?")
    letter = F.instr(F.lit("sua"), F.left("role", F.lit(1)))
    letter = F.when((letter == 0) | (F.col("role") == ""), 3).otherwise(letter - 1)
    code = F.char(F.lit(97) + letter + 4 * F.when(blank | again, 2).when(cut, 1).otherwise(0))
    one = lambda c, name: F.sum(c.cast("long")).alias(name)
    marked = materialize(marked.select("c", "turn", "pos", code.alias("code"), blank.alias("blank"),
                                       again.alias("again"), cut.alias("cut")), "marked")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    faults = (marked.groupBy("c", "turn").agg(one(F.col("blank"), "blank"), one(F.col("again"), "duplicate"),
                                              one(F.col("cut"), "truncated"))
              .groupBy("c").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("turns"),
                                *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")])
              .withColumn("gaps", F.coalesce((wide("high") - wide("low") + 1 - F.col("turns")), F.lit(0).cast("decimal(38,0)"))
                          .try_cast("long")).drop("low", "high", "turns"))
    blocks = materialize(
        marked.groupBy("c", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "")
            .alias("codes"), F.min("pos").alias("first")), "blocks")
    several = materialize(blocks.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c"), "several")
    chain = blocks.join(several, "c", "left_semi").select("c", "block", "codes").mapInArrow(
        _transfer, "c string, block long, costs array<long>, edge string")
    ends = chain.groupBy("c").applyInPandas(_block_ends, "c string, block long, ends array<long>, joint int")
    solved = materialize(
        blocks.join(ends, ["c", "block"], "left").select("c", "block", "codes", "ends", "joint", "first").mapInArrow(
            _solve, "c string, block long, first long, ways array<struct<state:int,cost:long,audit:string>>, illegal long"),
        "ways")
    to = F.transform("ways", lambda w: F.coalesce(w["state"], F.lit(0))).alias("to")
    entry = (solved.where(F.size("ways") > 1).select("c", "block", to).groupBy("c")
             .applyInPandas(_entered, "c string, block long, entry int"))
    way = F.get("ways", F.coalesce("entry", F.lit(0)))
    edits = materialize(solved.join(entry, ["c", "block"], "left").select(
        "c", "block", "first", way["cost"].alias("cost"), way["audit"].alias("audit"), "illegal"), "edits")
    repaired = edits.groupBy("c").agg(
        F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
        .alias("audit"))
    stream = (placed.select("c", "pos", F.lit(1).alias("kind"), "role", "text")
              .union(edits.select("c", "first", F.lit(0), F.lit(None).cast("string"), "audit"))
              .repartition("c").sortWithinPartitions("c", "pos", "kind"))
    digests = stream.mapInArrow(_digests, "c string, repaired_sha256 string")
    all_ids = rows.select("conv_id") if ids is None else rows.select("conv_id").union(ids.select("conv_id"))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return (all_ids.distinct().withColumn("c", _key(F.col("conv_id")))
            .join(faults, "c", "left").join(repaired, "c", "left").join(digests, "c", "left")
            .select("conv_id", F.when(F.col("blank").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps"),
                    *[zero(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")))
