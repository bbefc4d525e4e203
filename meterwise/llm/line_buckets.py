"""Pairs of near lines within buckets, for ``line_dedup``.

All pairs that a bucket is asked for are compared, by the distance of their
SimHashes first: some nanoseconds a pair on arrays, so that a wide bucket, whose
pairs grow with its square, costs little. Short lines bring their texts; of
those, pairs whose counts of characters or of runs of two characters differ in
more places than their edit similarity allows are left out. That is exact: an
edit changes at most ``k`` runs of ``k`` characters on each side, and counting
several runs as one never adds a difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs compared at once, and members from which a bucket is compared row by row.
PAIRS, WIDE = 1 << 19, 512
#: Counters of single characters and of runs of two.
ONES, TWOS = 32, 64

SCHEMA = "a long, b long, ta string, tb string"


def _left(group_x: np.ndarray, xs: np.ndarray, ys: np.ndarray, ny: np.ndarray, sim: np.ndarray, distance: int):
    """Index pairs (into the rows) of x rows ``xs`` and the y rows of their
    groups whose SimHashes are near, some at a time. ``group_x`` is the group of
    each x row, ``ny`` the number of y rows of each group, in the order of ``ys``."""
    first = np.cumsum(ny) - ny
    wide = ny[group_x] >= WIDE
    for g in np.unique(group_x[wide]):
        y = ys[first[g]:first[g] + ny[g]]
        x = xs[wide & (group_x == g)] if wide.any() else xs[:0]
        step = max(1, PAIRS // len(y))
        for at in range(0, len(x), step):
            some = x[at:at + step]
            i, j = np.nonzero(np.bitwise_count(sim[some][:, None] ^ sim[y][None, :]) <= distance)
            yield some[i], y[j]
    xs, group_x = xs[~wide], group_x[~wide]
    ends = np.cumsum(ny[group_x])
    at = done = 0
    while at < len(xs):
        to = min(int(np.searchsorted(ends, done + PAIRS)) + 1, len(xs))
        n = ny[group_x[at:to]]
        x = np.repeat(xs[at:to], n)
        y = ys[np.arange(len(x)) + np.repeat(first[group_x[at:to]] - (np.cumsum(n) - n), n)]
        near = np.flatnonzero(np.bitwise_count(sim[x] ^ sim[y]) <= distance)
        yield x[near], y[near]
        at, done = to, int(ends[to - 1])


def _counts(texts: list[str]) -> np.ndarray:
    """Counters of the characters and of the runs of two characters of every text."""
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ones = np.bincount(row * ONES + (cp % ONES).astype(np.int64), minlength=len(texts) * ONES)
    within = row[1:] == row[:-1]
    run = ((cp[:-1] << np.uint64(21)) + cp[1:])[within] * np.uint64(0x9E3779B97F4A7C15)
    twos = np.bincount(row[1:][within] * TWOS + (run >> np.uint64(58)).astype(np.int64), minlength=len(texts) * TWOS)
    return np.concatenate((ones.reshape(-1, ONES), twos.reshape(-1, TWOS)), axis=1).astype(np.int16)


def _possible(texts: list[str], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the counts of texts ``a`` and ``b`` (indices) allow ``most`` edits."""
    counts, out = _counts(texts), np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 15):
        some = slice(at, at + (1 << 15))
        off = np.abs(counts[a[some]] - counts[b[some]])
        out[some] = (off[:, :ONES].sum(axis=1) <= 2 * most[some]) & (off[:, ONES:].sum(axis=1) <= 4 * most[some])
    return out


def _pairs(rows: pa.RecordBatch, distance: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs of whole groups (see ``near``)."""
    col = lambda name: rows.column(name).to_numpy(zero_copy_only=False)
    key, part, ident, is_x, is_y = (col(c) for c in ("key", "part", "id", "x", "y"))
    if len(key) > 1:
        same = (key[1:] == key[:-1]) & (part[1:] == part[:-1]) & (ident[1:] == ident[:-1]) & (is_x[1:] == is_x[:-1])
        if same.any():
            yield from _pairs(rows.filter(pa.array(np.concatenate(([True], ~same)))), distance, similarity)
            return
    group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
    xs, ys = np.flatnonzero(is_x), np.flatnonzero(is_y)
    ny = np.bincount(group[ys], minlength=group[-1] + 1)
    comp, chars, text, sim = col("comp"), col("chars"), rows.column("short"), col("sim").view(np.uint64)
    short = text.is_valid().to_numpy(zero_copy_only=False)
    for i, j in _left(group[xs], xs, ys, ny, sim, distance):
        longer = np.maximum(chars[i], chars[j])
        # of two rows that meet as (x, y) and as (y, x), one pair is enough
        keep = (comp[i] != comp[j]) & (np.minimum(chars[i], chars[j]) >= similarity * longer) & (
            ~(is_x[j] & is_y[i]) | (ident[i] > ident[j]))
        i, j, longer = i[keep], j[keep], longer[keep]
        told = np.flatnonzero(short[i] & short[j])
        if len(told):
            some, at = np.unique(np.concatenate((i[told], j[told])), return_inverse=True)
            most = np.floor(longer[told] * (1 - similarity) + 1e-9).astype(np.int64)
            ok = np.ones(len(i), bool)
            ok[told] = _possible(text.take(pa.array(some)).to_pylist(), at[:len(told)], at[len(told):], most)
            i, j = i[ok], j[ok]
        if len(i):
            both = pa.array(short[i] & short[j])
            texts = [pa.compute.if_else(both, text.take(pa.array(k)), pa.scalar(None, text.type)) for k in (i, j)]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ident[i], ident[j])),
                                              pa.array(np.minimum(ident[i], ident[j])), *texts], ["a", "b", "ta", "tb"])


def near(batches: Iterator[pa.RecordBatch], distance: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows (key, part, id, x, y, chars, sim, comp, short), sorted by key,
    part, id and x, the pairs of an x row and a y row of one key and part that
    differ in ``comp`` and may be linked, as (a, b, text of one, text of the
    other): a the larger id; no texts if one of the lines is not short. A pair
    that shares several keys comes several times."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held else batch
        key, part = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part"))
        cut = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if (
            key[0] != key[-1] or part[0] != part[-1]) else 0
        if cut:
            yield from _pairs(rows.slice(0, cut), distance, similarity)
        held = [rows.slice(cut)]
    if held:
        yield from _pairs(held[0], distance, similarity)
