"""MinHash near-duplicates of whole documents.

Method: one-permutation hashing with optimal densification, banded buckets,
star-shaped candidate edges.

* A document's set is the distinct 5-word shingles of its lower-cased (A-Z)
  whitespace-separated words; fewer words make one shingle, none an empty set.
* One hash per shingle fills ``BINS`` bins (its top bits choose the bin, the
  least hash stays); an empty bin copies the first filled bin along a hash
  sequence of its own that is the same for all documents.
* ``BANDS`` bands of ``BINS / BANDS`` bins are hashed to bucket keys. With 32
  bands of 4 bins, a pair at similarity 0.75 shares no bucket with
  probability (1 - 0.75^4)^32, about 5 in a million.
* Equal sets (128-bit fingerprint) collapse to their smallest doc_id first.
  Buckets are then confirmed through their hub (``confirm_by_hubs``) on full
  sets. Jaccard distance is a metric, so two members of one bucket can only be
  within 0.25 if their distances to the hub differ by at most 0.25. Two more
  tests stand in the join that pairs members outside the star. Each set has a
  bitmap of ``BITMAP`` bits, one for each shingle's hash: common bits, plus the
  fewer shingles that share a bit within their set, bound the intersection
  from above, so nothing is lost. Sets of ``MANY`` shingles or more, for which
  that bound is loose, are also judged by the bins in which their signatures
  agree (``PLANES`` bits each): at similarity 0.75 that is 98 of 128 on average
  with a deviation of 4.8, and pairs with fewer than ``AGREE`` (five deviations
  less, one in three million) are left out.

Edge cases: null or word-less text has an empty set, links with nothing and
is its own component. Rows with a null id are never linked: component null,
kept. Repeated rows of one document get equal results. Rows that share an id
but differ in text each carry their own set size and class; where such an id
stands for several sets, its links are confirmed on its greatest text. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.components import confirm_by_hubs
from meterwise.llm.scratch import broadcast_if_small, materialize, materialize_counted

WORDS = 5
BINS = 128
BANDS = 32
BITMAP = 2048
PLANES = 4
AGREE = 74
MANY = 256
PIECE = 1 << 20

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.random.default_rng(12).integers(1, 2**63, WORDS, dtype=np.uint64) | _U(1)
_powers: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=np.uint64)
    return have


def _words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of ``data`` (uint8); ``first``
    marks offsets where a new document starts."""
    word = ~_WHITE[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first))
    if not len(starts):
        return np.empty(0, np.uint64), starts
    after = np.ones(len(data), bool)
    after[:-1] = ~word[1:] | first[1:]
    ends = np.flatnonzero(word & after) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data))[:len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * _power(_INVERSE, len(data))[starts]
    return _mix(h + (ends - starts).astype(np.uint64)), starts


def _pieces(data: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut ``data`` where no word is cut, so memory stays bounded."""
    a = 0
    while a < len(data):
        b = min(a + PIECE, len(data))
        while b < len(data):
            m = min(PIECE, len(data) - b)
            cuts = np.flatnonzero(_WHITE[data[b - 1:b - 1 + m]] | first[b:b + m])
            if len(cuts):
                b += int(cuts[0])
                break
            b += m
        yield a, b
        a = b


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    data = np.frombuffer(b"".join(t for t in texts if t), np.uint8)
    if not len(data):
        return [np.empty(0, np.uint64) for _ in texts]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    first = np.zeros(len(data), bool)
    first[begin[:-1][sizes > 0]] = True
    hashes, starts = [], []
    for a, b in _pieces(data, first):
        h, s = _words(data[a:b], first[a:b])
        hashes.append(h)
        starts.append(s + a)
    w, at = np.concatenate(hashes), np.concatenate(starts)
    edge = np.searchsorted(at, begin)
    n5 = len(w) - WORDS + 1
    if n5 > 0:
        s5 = np.zeros(n5, np.uint64)
        for k in range(WORDS):
            s5 += w[k:k + n5] * _PLACE[k]
        s5 = _mix(s5)
    out = []
    for i in range(len(texts)):
        a, b = edge[i], edge[i + 1]
        if b - a >= WORDS:
            out.append(np.unique(s5[a:b - WORDS + 1]))
        elif b > a:
            few = (w[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64) + _U(int(b - a))
            out.append(_mix(np.array([few], np.uint64) * _U(0xD6E8FEB86659FD93)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _fill(sig: np.ndarray, empty: np.ndarray) -> None:
    """Optimal densification, in place."""
    bins = np.arange(BINS, dtype=np.uint64)
    rows, cols = np.nonzero(empty)
    attempt = 0
    while len(rows):
        attempt += 1
        to = (_mix(bins * _U(0x100000001B3) + _U(attempt)) >> _U(32)) % _U(BINS)
        from_ = to[cols].astype(np.int64)
        hit = ~empty[rows, from_]
        sig[rows[hit], cols[hit]] = sig[rows[hit], from_[hit]]
        rows, cols = rows[~hit], cols[~hit]


def band_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each non-empty set a row of ``BANDS`` bucket keys, and ``PLANES``
    bits of each bin's value, as planes of ``BINS`` bits (both int64)."""
    bounds = np.arange(BINS, dtype=np.uint64) << _U(64 - BINS.bit_length() + 1)
    sig = np.zeros((len(sets), BINS), np.uint64)
    empty = np.ones((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, bounds)
        end = np.append(at[1:], len(s))
        full = end > at
        sig[i, full] = s[at[full]]
        empty[i] = ~full
    _fill(sig, empty)
    r = BINS // BANDS
    key = np.zeros((len(sets), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _U(_BASE)
    for k in range(r):
        key = _mix(key + sig[:, k::r][:, :BANDS])
    mixed = _mix(sig)
    planes = [np.packbits((mixed >> _U(p) & _U(1)).astype(np.uint8), axis=1) for p in range(PLANES)]
    low = np.ascontiguousarray(np.concatenate(planes, axis=1)) if sets else np.empty((0, PLANES * BINS // 8), np.uint8)
    return key.view(np.int64), low.view(np.int64).reshape(len(sets), PLANES * BINS // 64)


def slices(batch: pa.RecordBatch, col: int, limit: int = 4 << 20) -> Iterator[tuple[int, int, list]]:
    """Row ranges of a batch whose texts hold about ``limit`` bytes, with the
    texts as bytes."""
    texts = batch.column(col).cast(pa.binary())
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = done = 0
    while a < len(texts):
        # up to the row that reaches the limit; only these rows become Python bytes
        b = min(int(np.searchsorted(ends, done + limit)) + 1, len(texts))
        yield a, b, texts.slice(a, b - a).to_pylist()
        a, done = b, int(ends[b - 1])


def _signatures(batches):
    for batch in batches:
        for a, b, texts in slices(batch, 1):
            sets = shingle_sets(texts)
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            keys, low = band_keys([sets[i] for i in some])
            f1, f2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            for i in some:
                s = sets[i]
                f1[i] = s.sum(dtype=np.uint64).view(np.int64)
                f2[i] = _mix(s + _U(0x51ED27)).sum(dtype=np.uint64).view(np.int64)
            offsets = np.zeros(len(sets) + 1, np.int32)
            offsets[1:] = np.cumsum(n > 0)
            ones = np.zeros((len(some), BITMAP), np.uint8)
            for k, i in enumerate(some):
                ones[k, sets[i] & _U(BITMAP - 1)] = 1
            spare = n.copy()
            spare[some] -= ones.sum(1, dtype=np.int64)
            bitmap = np.packbits(ones, axis=1).view(np.int64).reshape(len(some), BITMAP // 64)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(offsets * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(n), pa.array(f1), pa.array(f2),
                 lists(keys), lists(low), lists(bitmap), pa.array(spare)],
                names=["doc_id", "n_shingles", "f1", "f2", "bands", "bins", "bitmap", "spare"])


def _compare(batches):
    last, center = None, None
    for batch in batches:
        for a, b, texts in slices(batch, 2):
            ids = batch.column(1).slice(a, b - a).to_pylist()
            centers = batch.column(3).slice(a, b - a).cast(pa.binary()).to_pylist()
            near, linked = np.zeros(b - a), np.zeros(b - a, bool)
            for i, (s, c) in enumerate(zip(shingle_sets(texts), ids, strict=True)):
                if c != last:
                    last, center = c, shingle_sets([centers[i]])[0]
                both = len(np.intersect1d(s, center, assume_unique=True))
                either = len(s) + len(center) - both
                linked[i] = 100 * both >= 75 * either
                near[i] = both / either
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(linked), pa.array(near)],
                names=["a", "b", "linked", "near"])


def _ones(longs: Column) -> Column:
    return F.aggregate(longs, F.lit(0), lambda n, x: n + F.bit_count(x))


def _agreeing(a: Column, b: Column) -> Column:
    """Bins whose ``PLANES`` bits are all equal."""
    words = BINS // 64

    def differ(i: Column) -> Column:
        return functools.reduce(Column.bitwiseOR, [
            F.get(a, i + p * words).bitwiseXOR(F.get(b, i + p * words)) for p in range(PLANES)])

    return F.lit(BINS) - _ones(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), differ))


def _may_link(x: Column, y: Column) -> Column:
    """Array functions, not sixty written-out terms: a generated method of
    that size is never compiled by the JIT and takes five times as long."""
    s, t = x["trait"], y["trait"]
    n, m = s["n"], t["n"]
    both = (_ones(F.zip_with(s["bitmap"], t["bitmap"], lambda a, b: a.bitwiseAND(b)))
            + F.least(s["spare"], t["spare"]))
    # 100 * both >= 75 * (n + m - both)
    return ((F.abs(x["near"] - y["near"]) <= 0.25 + 1e-9) & (100 * F.least(n, m) >= 75 * F.greatest(n, m))
            & (7 * both >= 3 * (n + m))
            & ((F.least(n, m) < MANY) | (_agreeing(s["bins"], t["bins"]) >= AGREE)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = materialize(base.mapInArrow(
        _signatures, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, bins array<long>, "
        "bitmap array<long>, spare long"), "signatures")
    linkable = sig.where("n_shingles > 0 and doc_id is not null")
    reps = materialize(linkable.groupBy("f1", "f2").agg(
        F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first(F.struct(
            F.col("n_shingles").alias("n"), "bins", "bitmap", "spare")).alias("trait")), "representatives")
    keys = reps.select(F.explode("bands").alias("key"), "id")

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs, n = materialize_counted(pairs, "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = materialize(
            base.join(broadcast_if_small(ends, known=2 * n), "doc_id", "left_semi")
            .groupBy("doc_id").agg(F.max("text").alias("text")), "texts")
        rows = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
                .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
                .select("a", "b", "ta", "tb"))
        return rows.mapInArrow(_compare, "a long, b long, linked boolean, near double")

    labels = confirm_by_hubs(keys, confirm, reps.select("id", "trait"), _may_link)
    of = materialize(
        reps.select("f1", "f2", "id").join(labels.withColumnRenamed("node", "id"), "id", "left")
        .select("f1", "f2", F.coalesce("component", "id").alias("component_id")), "class-components")
    linked = linkable.select("doc_id", "n_shingles", "f1", "f2").join(of, ["f1", "f2"])
    alone = sig.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (linked.select("doc_id", "n_shingles", "component_id").union(alone)
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
