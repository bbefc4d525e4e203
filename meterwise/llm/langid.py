"""Language identification as multilingual mixture inference.

Method: character trigrams (hashed, with word boundaries) give each language a
multinomial model, counted over all labelled rows. A document's words are
explained as draws from a mixture of languages: expectation-maximisation
estimates the proportions from the words' n-gram likelihoods, and the language
set is the one with the best likelihood less half a log of the word count per
further language (the sets are nested: the k largest proportions). The
predicted language is the set's largest proportion, its score that proportion.

Counts are made in tasks that see a part of the rows each and summed by
(language, trigram) in Spark; the model, at most ``BUCKETS`` numbers for each
language, is all that reaches the driver. It is broadcast, and documents are
scored in Arrow batches cut by bytes.

Edge cases: null text or text without a letter is ``und`` with score 0. Equal
proportions go to the alphabetically first language. Without labelled rows no
language is known and every row is ``und``. Rows with a null label train
nothing. Repeated rows and extra columns change nothing else; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.minhash import slices

BUCKETS = 1 << 18
SMOOTHING = 0.1
STEPS = 12
UNKNOWN = "und"
#: Bytes of text that are worked on together; arrays over them take about 50 times as much.
SLICE = 256 << 10
_LETTER = regex.compile(r"\p{L}")


@functools.cache
def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for a in range(0, len(out), 4096):  # a few code points at a time: the table is all that stays
        if not 0xD800 <= a < 0xE000:
            for m in _LETTER.finditer("".join(map(chr, range(a, a + 4096)))):
                out[ord(m[0])] = True
    return out


def _trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each letter, first letter of each word, words of each text)."""
    low = ["" if t is None else t.decode("utf-8", "replace").lower() for t in texts]
    cp = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[cp]
    z = np.where(letter, cp, 0).astype(np.uint32)
    at = np.flatnonzero(letter)
    h = (z[at - 1] * np.uint32(0x9E3779B1) ^ z[at] * np.uint32(0x85EBCA77)) + z[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    code = (h >> np.uint32(14)).astype(np.int32)
    first = np.flatnonzero(~letter[at - 1]) if len(at) else at
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    edges = np.searchsorted(at[first], begin) if len(at) else np.zeros(len(begin), np.int64)
    return code, first, np.diff(edges)


def _counts(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for a, b, texts in slices(batch, 1, SLICE):
            langs = np.array(batch.column(0).slice(a, b - a).to_pylist(), object)
            for lang in sorted(set(langs)):
                code, _, _ = _trigrams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                n = np.bincount(code, minlength=BUCKETS)
                total[lang] = total[lang] + n if lang in total else n
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])],
                                         names=["lang", "code", "n"])


class Model:
    """Log-probabilities of hashed trigrams: ``table`` (BUCKETS x languages)."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.table = np.empty((BUCKETS, len(self.langs)), np.float32)
        for i, lang in enumerate(self.langs):
            code, n = counts[lang]
            full = np.full(BUCKETS, SMOOTHING)
            full[code] += n
            self.table[:, i] = np.log(full / full.sum())


def train(docs: DataFrame, rows: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count trigrams over all ``rows`` of ``docs`` that have a label."""
    labelled = docs.where(rows & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = (labelled.mapInArrow(_counts, "lang string, code long, n long")
              .groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas())
    return Model({lang: (g["code"].to_numpy(), g["n"].to_numpy()) for lang, g in counts.groupby("lang")})


def _em(a: np.ndarray, pi: np.ndarray, doc: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
        steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) and log-likelihood of each document
    (relative to each word's best language) from word likelihoods ``a``."""
    for _ in range(steps):
        r = a * pi[doc]
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, starts, axis=0) / sizes[:, None]
    mix = (a * pi[doc]).sum(1)
    return pi, np.add.reduceat(np.log(np.maximum(mix, 1e-300)), starts)


def mixtures(model: Model, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text over ``model.langs`` within its chosen set
    (zero rows for texts without a letter), and the size of the set."""
    n_lang = len(model.langs)
    out, size = np.zeros((len(texts), n_lang)), np.zeros(len(texts), np.int64)
    code, first, words = _trigrams(texts)
    if not len(first) or not n_lang:
        return out, size
    log = np.add.reduceat(model.table[code], first, axis=0, dtype=np.float64)
    a = np.maximum(np.exp(log - log.max(1, keepdims=True)), 1e-30)
    some = np.flatnonzero(words)
    sizes = words[some]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc = np.repeat(np.arange(len(some)), sizes)
    single = np.add.reduceat(np.log(a), starts, axis=0)
    best = single.argmax(1)
    score = single[np.arange(len(some)), best]
    pick = np.zeros((len(some), n_lang))
    pick[np.arange(len(some)), best] = 1.0
    chosen = np.ones(len(some), np.int64)
    if n_lang > 1:
        pi, full = _em(a, np.full((len(some), n_lang), 1 / n_lang), doc, starts, sizes)
        price = 0.5 * np.log(sizes + 1.0)
        order = np.argsort(-pi, axis=1, kind="stable")
        open_ = np.flatnonzero(full > score + price)  # a part of the full set never fits better than all of it
        if len(open_):
            sub = np.isin(doc, open_)
            a2, n2 = a[sub], sizes[open_]
            starts2 = np.concatenate([[0], np.cumsum(n2)[:-1]])
            doc2 = np.repeat(np.arange(len(open_)), n2)
            for k in range(2, n_lang + 1):
                mask = np.zeros((len(open_), n_lang))
                np.put_along_axis(mask, order[open_, :k], 1.0, axis=1)
                start = (pi[open_] + 1e-6) * mask
                p, ll = _em(a2, start / start.sum(1, keepdims=True), doc2, starts2, n2, STEPS // 2)
                better = ll - (k - 1) * price[open_] > score[open_]
                won = open_[better]
                score[won] = (ll - (k - 1) * price[open_])[better]
                pick[won] = p[better]
                chosen[won] = k
    out[some], size[some] = pick, chosen
    return out, size


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, n_langs, langs (proportions of the
    chosen set, largest first)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for a, b, texts in slices(batch, 1, SLICE):
                pi, size = mixtures(m, texts)
                top = pi.argmax(1) if m.langs else np.zeros(len(texts), np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a),
                    pa.array([m.langs[t] if n else UNKNOWN for t, n in zip(top, size, strict=True)], pa.string()),
                    pa.array([float(pi[i, t]) if n else 0.0 for i, (t, n) in enumerate(zip(top, size, strict=True))],
                             pa.float64()),
                    pa.array(size.astype(np.int32)),
                    pa.array([",".join(f"{m.langs[j]}:{pi[i, j]:.3f}" for j in np.argsort(-pi[i], kind="stable")[:n])
                              for i, n in enumerate(size)], pa.string()),
                ], names=["doc_id", "lang_pred", "score", "n_langs", "langs"])

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_langs int, langs string")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(-1))
