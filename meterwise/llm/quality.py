"""Quality classifier: a byte-level convolutional network in numpy.

Method: each byte is embedded, learned filters slide over every byte of the
whole document, and their responses are max-pooled over overlapping chunks
(``2 * BLOCK`` bytes, one every ``BLOCK``). A document's chunks are combined by
mean and maximum per filter and one logistic unit gives the probability.

Training runs on the driver over a bounded sample: at most ``SAMPLE`` labelled
documents of the training folds, those with the smallest hash of their id,
among texts of at most ``SAMPLE_BYTES`` bytes (so at most about 100 MB). The
seed and the order are fixed. Scoring cuts Arrow batches by bytes; memory grows
with the longest single document only.

Edge cases: null text scores like empty text, which has one chunk of padding.
Null labels train nothing; a document with several labels trains on their
greatest. Without labelled rows every score is 0.5. Repeated rows get equal
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.minhash import slices

SAMPLE = 3_000
SAMPLE_BYTES = 32_768
BLOCK, WIDTH, EMBED, FILTERS = 128, 5, 4, 16
STEPS, RATE, BATCH = 900, 0.01, 32
#: Blocks whose responses are held at once while scoring.
PIECE = 1024


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f32 = lambda x: x.astype(np.float32)
        self.p = {
            "embed": f32(r.normal(0, 0.5, (256, EMBED))),
            "filt": f32(r.normal(0, 0.4, (WIDTH * EMBED, FILTERS))),
            "bias": np.zeros(FILTERS, np.float32),
            "out": f32(r.normal(0, 0.1, 2 * FILTERS)),
            "base": np.zeros(1, np.float32),
        }
        self.trained = False

    def _layout(self, texts: list[bytes]):
        """Padded bytes of all texts and the blocks of each. ``WIDTH - 1`` zero
        bytes come before every text, so no filter sees two texts."""
        lead = WIDTH - 1
        sizes = np.array([len(t) for t in texts])
        blocks = np.maximum(1, -(-(sizes + lead) // BLOCK))
        data = np.zeros(int(blocks.sum()) * BLOCK + WIDTH, np.uint8)
        for t, a in zip(texts, np.concatenate([[0], np.cumsum(blocks)]) * BLOCK, strict=False):
            data[a + lead:a + lead + len(t)] = np.frombuffer(t, np.uint8)
        return data, blocks

    def _conv(self, data: np.ndarray) -> np.ndarray:
        """Filter responses (blocks x BLOCK x FILTERS) of whole blocks."""
        n = len(data) - WIDTH
        x = self.p["embed"][data]
        z = x[:n] @ self.p["filt"][:EMBED]
        for k in range(1, WIDTH):
            z += x[k:n + k] @ self.p["filt"][k * EMBED:(k + 1) * EMBED]
        return z.reshape(-1, BLOCK, FILTERS)

    def _pool(self, values: np.ndarray, blocks: np.ndarray):
        """Chunk (first block, width in blocks) layout and document features."""
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        last = np.zeros(len(values), bool)
        last[first + blocks - 1] = True
        single = np.zeros(len(values), bool)
        single[first[blocks == 1]] = True
        left = np.flatnonzero(~last | single)
        right = np.where(single[left], left, left + 1)
        chunk = np.maximum(np.maximum(values[left], values[right]) + self.p["bias"], 0)
        per = np.maximum(blocks - 1, 1)
        start = np.concatenate([[0], np.cumsum(per)[:-1]])
        feats = np.concatenate([np.add.reduceat(chunk, start, axis=0) / per[:, None],
                                np.maximum.reduceat(chunk, start, axis=0)], axis=1).astype(chunk.dtype)
        return left, right, chunk, per, start, feats

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), 0.5)
        data, blocks = self._layout(texts)
        step = PIECE * BLOCK
        pooled = [self._conv(data[a:min(a + step, len(data) - WIDTH) + WIDTH]).max(1)
                  for a in range(0, len(data) - WIDTH, step)]
        feats = self._pool(np.concatenate(pooled), blocks)[-1]
        logit = feats.astype(np.float64) @ self.p["out"].astype(np.float64) + float(self.p["base"][0])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def _gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        data, blocks = self._layout(texts)
        z = self._conv(data)
        arg = z.argmax(1)
        values = np.take_along_axis(z, arg[:, None], 1)[:, 0]
        left, right, chunk, per, start, feats = self._pool(values, blocks)
        prob = 1 / (1 + np.exp(-np.clip(feats @ self.p["out"] + self.p["base"][0], -30, 30)))
        d = ((prob - y) / len(y)).astype(np.float32)
        g = {"out": feats.T @ d, "base": np.array([d.sum()], np.float32)}
        doc = np.repeat(np.arange(len(texts)), per)
        d_chunk = (d / per)[doc][:, None] * self.p["out"][:FILTERS]
        top = chunk == feats[doc, FILTERS:]
        count = np.add.reduceat(top, start, axis=0)[doc]
        d_chunk = d_chunk + top / np.maximum(count, 1) * d[doc][:, None] * self.p["out"][FILTERS:]
        d_chunk = d_chunk * (chunk > 0)
        g["bias"] = d_chunk.sum(0).astype(np.float32)
        block = np.where(values[left] >= values[right], left[:, None], right[:, None])
        cols = np.broadcast_to(np.arange(FILTERS), block.shape)
        pos = block * BLOCK + arg[block, cols]
        live = np.flatnonzero(d_chunk.ravel())
        pos, f, dz = pos.ravel()[live], cols.ravel()[live], d_chunk.ravel()[live].astype(np.float32)
        g["filt"], g["embed"] = np.zeros_like(self.p["filt"]), np.zeros_like(self.p["embed"])
        for k in range(WIDTH):
            byte = data[pos + k]
            e = self.p["embed"][byte]
            for j in range(EMBED):
                g["filt"][k * EMBED + j] = np.bincount(f, e[:, j] * dz, FILTERS)
                g["embed"][:, j] += np.bincount(byte, self.p["filt"][k * EMBED + j][f] * dz, 256)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray) -> Network:
        """``STEPS`` steps of Adam over fixed shuffles, the rate halved after
        half of them."""
        if not len(texts):
            return self
        r = np.random.default_rng(3)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        while step < STEPS:
            order = r.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                own = order[a:a + BATCH]
                step += 1
                rate = RATE * (0.5 if step > STEPS // 2 else 1.0)
                for k, g in self._gradients([texts[i] for i in own], labels[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
                                  ).astype(np.float32)
        self.trained = True
        return self


def train(docs: DataFrame, labels: DataFrame, rows: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Network:
    """Fit on the bounded sample of labelled documents. ``rows``: which rows
    of ``labels`` may be learned from (a condition on their id)."""
    of = (labels.where(rows & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
          .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label"))
          .orderBy(F.xxhash64("id"), "id").limit(SAMPLE))
    picked = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
              .where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(of), "id")
              .orderBy(F.xxhash64("id"), "id", "text").limit(SAMPLE))
    sample = picked.select(F.col("text").cast("binary").alias("text"), "label").toPandas()
    return Network().fit([bytes(t) for t in sample["text"]], sample["label"].to_numpy(np.float32))


def classify(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            for a, b, texts in slices(batch, 1, 1 << 18):
                score = shared.value.score([t or b"" for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score, pa.float64())],
                                                 names=["doc_id", "score"])

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, score double")
