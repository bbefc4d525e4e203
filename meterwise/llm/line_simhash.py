"""SimHash of normalised lines, block by block, for ``line_dedup``.

A line's features are dealt by hash into groups; the SimHash of one group's
features is one block, the SimHash of all of them the line's ``sim``. By the
pigeonhole principle two lines whose features differ in fewer places than
there are groups have an equal block.

Three kinds of features, each for itself, so that pairs of every sort meet:

* words, of lines with at least ``WORDS_FROM`` distinct ones;
* runs of three characters, of lines of at least ``THREE_FROM`` characters with
  fewer than ``WORDS_UPTO`` distinct words or ``THREE_UPTO`` characters, or with
  long words: unspaced scripts, identifiers, short lines;
* runs of two characters, of lines of fewer than ``TWO_UPTO`` characters.

Lines are compared within a class of feature counts (powers of two); one near
the end of its class is in the next one too. Longer classes have more groups,
so the changes that a block must be free of do not grow with the line.

A block of few features says little and would gather unlike lines, so it is a
key only from ``CHARS`` characters (words and blanks) or a few runs on; the
whole line is one more key, for lines that repeat a few features. Every line has
its own keys whatever else the table holds.

The texts of a batch are handled in slices of about ``SLICE`` bytes, a longer
line alone in its slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa

from meterwise.llm.minhash import slices

WORDS_FROM, WORDS_UPTO = 10, 16
TWO_UPTO, THREE_FROM, THREE_UPTO = 40, 30, 100
#: Mean word length from which a line of any number of words has runs too.
LONG_WORDS = 16
CHARS = 17
SLICE = 1 << 17
#: Characters after a difference within which a plain alignment must meet again.
MEETS = 40
#: Bits of the integers that hold several distance matrices, and columns between two looks at them.
BITS, STEP = 1 << 15, 32
#: Lines that a task remembers having made the blocks of.
SEEN = 1 << 18

#: The keys of a line by the SimHash of the features that they are made of.
SCHEMA = "blocks array<struct<sim:long,keys:array<long>>>"

_U = np.uint64
#: The bits of a byte as eight counters of one byte.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(_U).ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _starts(changed: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], changed)))


def _distinct(line: np.ndarray, h: np.ndarray, weight: np.ndarray):
    """Distinct (line, feature), by line and hash: 38 bits of the hash, whose
    first three are the group, with the weight below them."""
    packed = np.sort((line.astype(_U) << _U(44)) | ((h >> _U(26)) << _U(6)) | np.minimum(weight, 63).astype(_U))
    packed = packed[_starts(packed[1:] != packed[:-1])]
    return (packed >> _U(44)).astype(np.int64), packed & _U((1 << 44) - 1)


def _totals(x: np.ndarray) -> np.ndarray:
    """Sums of all that stands before each place. They may wrap around; the
    difference of two is the sum between them all the same."""
    out = np.zeros((*x.shape[:-1], x.shape[-1] + 1), _U)
    np.cumsum(x, axis=-1, out=out[..., 1:])
    return out


def _majority(totals: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHash of each segment (from ``at`` on), from the totals of its hashes'
    bits: eight counters to a long, so a segment is counted in parts of up to 255."""
    end = np.append(at[1:], totals.shape[1] - 1)
    n = end - at
    if n.max() < 256:
        counts = np.ascontiguousarray((totals[:, end] - totals[:, at]).T).view(np.uint8)
        return np.packbits(counts > (n >> 1).astype(np.uint8)[:, None], axis=1).view(_U).ravel()
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    split = np.repeat(at, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    counts = np.ascontiguousarray((totals[:, np.append(split[1:], end[-1])] - totals[:, split]).T).view(np.uint8)
    ones = np.add.reduceat(counts.astype(np.int32), first, axis=0)
    return np.packbits(2 * ones > n[:, None], axis=1).view(_U).ravel()


def _blocks(line: np.ndarray, h: np.ndarray, bits: np.ndarray):
    """SimHash of every block and its line, from distinct features by line and
    hash; ``bits`` of the hash of each feature name its group.

    Returns line, group, block, weight of the block and sim of the line."""
    group = (h >> (_U(44) - bits.astype(_U))).astype(np.int64)
    at = _starts((line[1:] != line[:-1]) | (group[1:] != group[:-1]))
    totals = _totals(_LANES[_mix(h).view(np.uint8).reshape(-1, 8).T])
    of = line[at]
    whole = _starts(of[1:] != of[:-1])
    sims = _majority(totals, at[whole])
    weight = np.add.reduceat((h & _U(63)).astype(np.int64), at)
    return of, group[at], _majority(totals, at), weight, np.repeat(sims, np.diff(np.append(whole, len(of))))


def _keys(line: np.ndarray, h: np.ndarray, count: np.ndarray, kind: int, least: int, need: int):
    """(line, key, sim) of the blocks that weigh at least ``need``, and of the
    whole line, for lines that repeat a few features. ``count``
    is the size of every line, by which it has its classes; a class of up to
    2^(c+1) has 2^(c-2) groups, at least 2^``least``."""
    low = np.floor(np.log2(np.maximum(count, 1))).astype(np.int64)
    high = np.floor(np.log2(np.maximum(np.floor(count * 1.25 + 1e-9), 1))).astype(np.int64)
    for cls, pick in ((low, np.ones(len(line), bool)), (high, (low != high)[line])):
        if pick.any():
            some = line[pick]
            of, group, block, weight, sim = _blocks(some, h[pick], np.clip(cls[some] - 2, least, 24))
            first = _starts(of[1:] != of[:-1])
            whole, sims = of[first], sim[first]
            full = weight >= need
            of, group, block = of[full], group[full], block[full]
            tag = (kind * 64 + cls[of]).astype(_U)
            yield of, _mix(block + _mix((tag << _U(32)) + group.astype(_U) + _U(1))), sim[full]
            yield whole, _mix(sims + _mix((kind * 64 + cls[whole]).astype(_U) << _U(32))), sims


def _words(cp: np.ndarray, start: np.ndarray, size: np.ndarray):
    """(line, hash, letters and a blank) of every word of lines joined without a gap."""
    head = np.zeros(len(cp), bool)
    head[start] = True
    space = cp == 32
    head[1:] |= space[:-1]
    at = np.flatnonzero(head)
    n = np.diff(np.append(at, len(cp)))
    place = np.arange(len(cp)) - np.repeat(at, n)
    value = _mix((cp.astype(_U) << _U(32)) + place.astype(_U) + _U(1))
    value[space] = 0
    total = _totals(value)
    # a blank is the last character of what it ends
    return np.repeat(np.arange(len(start)), size)[at], _mix(total[at + n] - total[at]), n - space[at + n - 1] + 1


def _runs(cp: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray, k: int):
    """(line, hash) of the runs of ``k`` (2 or 3) characters of the lines
    ``which``; a line shorter than a run is one run."""
    n = np.maximum(size[which] - k + 1, 1)
    line = np.repeat(which, n)
    inside = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    at = start[line] + inside
    left = size[line] - inside
    pad = np.concatenate((cp.astype(_U), np.zeros(2, _U)))
    h = pad[at]
    for i in range(1, k):
        h |= np.where(left > i, pad[at + i], _U(0)) << _U(21 * i)
    return line, _mix(_mix(h) + _U(0x9E3779B97F4A7C15))


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, sim) of every key of the texts; an empty one has none."""
    some = np.array([i for i, t in enumerate(texts) if t], np.int64)
    if not len(some):
        return some, np.zeros(0, _U), np.zeros(0, _U)
    byte = np.frombuffer(b"".join([texts[i] for i in some]), np.uint8)
    cp = np.frombuffer(byte.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    chars = np.concatenate(([0], np.cumsum((byte & 0xC0) != 0x80)))
    edge = np.concatenate(([0], chars[np.cumsum([len(texts[i]) for i in some])]))
    start, size = edge[:-1], np.diff(edge)

    line, h = _distinct(*_words(cp, start, size))
    n_words = np.bincount(line, minlength=len(some))
    pick = (n_words >= WORDS_FROM)[line]
    out = [*_keys(line[pick], h[pick], n_words, 0, 3, CHARS)]
    few = (n_words < WORDS_UPTO) | (size < THREE_UPTO) | (size >= LONG_WORDS * n_words)
    for k, which in ((3, few & (size >= THREE_FROM)), (2, size < TWO_UPTO)):
        if which.any():
            line, h = _runs(cp, start, size, np.flatnonzero(which), k)
            line, h = _distinct(line, h, np.ones(len(line), np.int64))
            out += _keys(line, h, size, k, 4, k)
    of, key, sim = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (some[:0], h[:0], h[:0])
    return some[of], key, sim


def with_signatures(batches: Iterator[pa.RecordBatch], text: int, ident: int) -> Iterator[pa.RecordBatch]:
    """Replace the text column, the last one, by the column of ``SCHEMA``. Of
    rows with one ``ident`` the first has the blocks, later ones of the same task
    may have none."""
    seen: set[int] = set()
    for batch in batches:
        ids = batch.column(ident).to_pylist()
        for a, b, texts in slices(batch, text, SLICE):
            if len(seen) > SEEN:
                seen.clear()
            for i in range(a, b):
                if ids[i] in seen:
                    texts[i - a] = b""
                seen.add(ids[i])
            of, key, sim = signatures(texts)
            order = np.lexsort((key, sim, of))
            of, key, sim = of[order], key[order], sim[order]
            head = _starts((of[1:] != of[:-1]) | (sim[1:] != sim[:-1])) if len(of) else np.zeros(0, np.int64)
            ends = np.append(head, len(of)).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64)))
            groups = pa.StructArray.from_arrays([pa.array(sim[head].view(np.int64)), keys], ["sim", "keys"])
            offsets = np.concatenate(([0], np.cumsum(np.bincount(of[head], minlength=b - a)))).astype(np.int32)
            kept = [batch.column(i).slice(a, b - a) for i in range(text)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.ListArray.from_arrays(pa.array(offsets), groups)], [*batch.schema.names[:text], "blocks"])


def _equal_start(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _aligned(a: str, b: str, most: int) -> bool:
    """Whether one alignment, found from left to right, costs at most ``most``
    edits. False says nothing: another one may cost less."""
    i = j = cost = 0
    while cost <= most:
        top, n, step = min(len(a) - i, len(b) - j), 0, 16
        while n < top and a[i + n:i + n + min(step, top - n)] == b[j + n:j + n + min(step, top - n)]:
            n, step = n + min(step, top - n), 2 * step
        n += _equal_start(a[i + n:i + n + step], b[j + n:j + n + step])
        i, j = i + n, j + n
        if i == len(a) or j == len(b):
            return cost + max(len(a) - i, len(b) - j) <= most
        for skip in range(min(MEETS, len(a) - i)):
            at = b.find(a[i + skip:i + skip + 8], j, j + skip + MEETS)
            if at >= 0:
                cost, i, j = cost + max(skip, at - j), i + skip, at
                break
        else:
            return False
    return False


def _decided(a: str, b: str, most: int) -> tuple[bool | None, str, str]:
    """Whether two texts are within ``most`` edits, if that shows without a
    matrix (else None), and the shorter and the longer text without equal ends."""
    n = _equal_start(a, b)
    a, b = a[n:], b[n:]
    n = _equal_start(a[::-1], b[::-1])
    a, b = sorted((a[:len(a) - n], b[:len(b) - n]), key=len)
    if not a or len(b) - len(a) > most:
        return len(b) <= most, a, b
    return (True if len(b) <= most or _aligned(a, b, most) else None), a, b


class _Slots:
    """Distance matrices of several pairs, column by column and bit-parallel:
    each pair has ``wide`` bytes of the long integers, of which the top bit
    stays clear, so that no pair carries into the next.

    A path that crosses column j at row i pays at least the distance on the
    diagonal, (j, j), less |i - j| before, and |i - j| less the difference of
    the lengths after it, so that distance ends a pair early."""

    def __init__(self, pairs: list[tuple[int, str, str, int]]):
        self.pairs, self.wide = pairs, max(len(p[1]) for p in pairs) // 8 + 1
        none, self.same = bytes(self.wide), []
        for _, a, b, _ in pairs:
            at: dict[str, int] = {}
            for i, c in enumerate(a):
                at[c] = at.get(c, 0) | 1 << i
            rows = {c: x.to_bytes(self.wide, "little") for c, x in at.items()}
            self.same.append([rows.get(c, none) for c in b])
        self.up, self.down = self._full(), 0

    def _full(self) -> int:
        return int.from_bytes(((1 << 8 * self.wide - 1) - 1).to_bytes(self.wide, "little") * len(self.pairs), "little")

    def _part(self, x: bytes, k: int, rows: int) -> int:
        return (int.from_bytes(x[k * self.wide:(k + 1) * self.wide], "little") & (1 << rows) - 1).bit_count()

    def within(self) -> Iterator[tuple[int, bool]]:
        j, none = 0, bytes(self.wide)
        while self.pairs:
            full, n = self._full(), self.wide * len(self.pairs)
            one = int.from_bytes((1).to_bytes(self.wide, "little") * len(self.pairs), "little")
            over = {}
            up, down = self.up, self.down
            ends: dict[int, list[int]] = {}
            for k, p in enumerate(self.pairs):
                ends.setdefault(len(p[2]), []).append(k)
            for column in zip_longest(*(s[j:j + STEP] for s in self.same), fillvalue=none):
                same = int.from_bytes(b"".join(column), "little")
                diagonal = (((same & up) + up ^ up) | same | down) & full
                right_up, right_down = down | (diagonal | up) ^ full, up & diagonal
                right_up = (right_up << 1 | one) & full
                up = (right_down << 1 & full) | (diagonal | right_up) ^ full
                down = right_up & diagonal
                j += 1
                if j in ends:
                    x, y = up.to_bytes(n, "little"), down.to_bytes(n, "little")
                    for k in ends[j]:
                        rows = len(self.pairs[k][1])
                        over[k] = j + self._part(x, k, rows) - self._part(y, k, rows) <= self.pairs[k][3]
            x, y = up.to_bytes(n, "little"), down.to_bytes(n, "little")
            for k, (_, a, b, most) in enumerate(self.pairs):
                if k not in over and j <= len(a) and j + self._part(x, k, j) - self._part(y, k, j) - len(b) + len(a) > most:
                    over[k] = False
            for k, ok in over.items():
                yield self.pairs[k][0], ok
            left = [k for k in range(len(self.pairs)) if k not in over]
            self.pairs, self.same = [self.pairs[k] for k in left], [self.same[k] for k in left]
            self.up, self.down = (int.from_bytes(b"".join(z[k * self.wide:(k + 1) * self.wide] for k in left), "little")
                                  for z in (x, y))


def all_within(texts: list[tuple[str, str, int]]) -> list[bool]:
    """Whether the Levenshtein distance of each pair of texts (a, b, most) is at
    most ``most``. Equal ends are cut off first, texts that a plain alignment
    shows to be near need no matrix, and the others have theirs made together."""
    out, hard = [False] * len(texts), []
    for i, (x, y, most) in enumerate(texts):
        known, a, b = _decided(x, y, most)
        if known is None:
            hard.append((i, a, b, most))
        else:
            out[i] = known
    hard.sort(key=lambda p: len(p[1]))
    while hard:
        n = max(1, BITS // (len(hard[-1][1]) + 8))
        for i, ok in _Slots(hard[-n:]).within():
            out[i] = ok
        del hard[-n:]
    return out


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance of two texts is at most ``most``."""
    return all_within([(a, b, most)])[0]


def linked(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text of a, text of b) those whose edit similarity
    suffices, as (a, b)."""
    for batch in batches:
        texts = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        keep = all_within([(x, y, int(max(len(x), len(y)) * (1 - similarity) + 1e-9)) for x, y in texts])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
