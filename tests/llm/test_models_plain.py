"""The quality network and language mixtures against plain loops."""

import math

import numpy as np
import pytest
import regex

from meterwise.llm import langid, quality

SF = "/root/testdata/sf0.01"


def plain_score(net, text):
    """One text, one byte, one filter at a time."""
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    lead, size = quality.WIDTH - 1, quality.BLOCK
    n_blocks = max(1, math.ceil((lead + len(text)) / size))
    data = bytes(lead) + text + bytes(n_blocks * size + quality.WIDTH - lead - len(text))
    best = [[-math.inf] * quality.FILTERS for _ in range(n_blocks)]
    for i in range(n_blocks * size):
        for f in range(quality.FILTERS):
            z = sum(p["embed"][data[i + k]][e] * p["filt"][k * quality.EMBED + e][f]
                    for k in range(quality.WIDTH) for e in range(quality.EMBED))
            best[i // size][f] = max(best[i // size][f], z)
    chunks = [[max(0.0, max(x, y) + b) for x, y, b in zip(best[i], best[min(i + 1, n_blocks - 1)], p["bias"])]
              for i in range(max(1, n_blocks - 1))]
    feats = [sum(c) / len(chunks) for c in zip(*chunks)] + [max(c) for c in zip(*chunks)]
    return 1 / (1 + math.exp(-sum(x * w for x, w in zip(feats, p["out"])) - p["base"][0]))


def test_scores_equal_plain_loops():
    rng = np.random.default_rng(5)
    net = quality.Network(11)
    net.trained = True
    net.p["bias"] = rng.normal(0, 0.3, quality.FILTERS).astype(np.float32)
    texts = [b"", b"a", "naïve – text".encode(), *(bytes(rng.integers(0, 256, n, dtype=np.uint8))
                                                   for n in (123, 124, 125, 252, 253, 640))]
    got = net.score(texts)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-5)
    assert len(set(got.round(6))) > 5


def plain_em(a, pi, steps):
    for _ in range(steps):
        total = [0.0] * len(pi)
        for word in a:
            r = [x * p for x, p in zip(word, pi)]
            for i, x in enumerate(r):
                total[i] += x / sum(r)
        pi = [t / len(a) for t in total]
    return pi, sum(math.log(max(sum(x * p for x, p in zip(word, pi)), 1e-300)) for word in a)


def plain_mixture(model, text):
    """Proportions of the best set and its size, every set size tried."""
    n_lang, a = len(model.langs), []
    for word in regex.findall(r"\p{L}+", text.lower()):
        z, log = [0, *map(ord, word), 0], [0.0] * n_lang
        for i in range(1, len(z) - 1):
            h = ((z[i - 1] * 0x9E3779B1 ^ z[i] * 0x85EBCA77 % 2**32) + z[i + 1] * 0xC2B2AE3D) % 2**32
            h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
            log = [x + float(y) for x, y in zip(log, model.table[h >> 14])]
        a.append([max(math.exp(x - max(log)), 1e-30) for x in log])
    if not a:
        return [0.0] * n_lang, 0
    price = 0.5 * math.log(len(a) + 1)
    single = [sum(math.log(w[i]) for w in a) for i in range(n_lang)]
    top = single.index(max(single))
    best, pick, size = single[top], [float(i == top) for i in range(n_lang)], 1
    pi, _ = plain_em(a, [1 / n_lang] * n_lang, langid.STEPS)
    order = sorted(range(n_lang), key=lambda i: -pi[i])
    for k in range(2, n_lang + 1):
        start = [(pi[i] + 1e-6) * (i in order[:k]) for i in range(n_lang)]
        p, fit = plain_em(a, [x / sum(start) for x in start], langid.STEPS // 2)
        if fit - (k - 1) * price > best:
            best, pick, size = fit - (k - 1) * price, p, k
    return pick, size


def test_mixtures_equal_plain_loops(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 600").orderBy("doc_id").limit(60).collect()
    of = {}
    for r in rows:
        of.setdefault(r["lang"], r["text"])
    counts = {}
    for lang, text in of.items():
        code, _, _ = langid._trigrams([text.encode()])
        n = np.bincount(code, minlength=langid.BUCKETS)
        counts[lang] = np.flatnonzero(n), n[np.flatnonzero(n)]
    model = langid.Model(counts)
    parts = [t[:500] for t in of.values()]
    texts = [*(r["text"][:300] for r in rows[:12]), parts[0] + "\n" + parts[1], " ".join(p[:200] for p in parts),
             "", "12 !", "ж", "Über ÉTÉ"]
    pi, size = langid.mixtures(model, [t.encode() for t in texts])
    plain = [plain_mixture(model, t) for t in texts]
    assert size.tolist() == [n for _, n in plain]
    assert pi == pytest.approx(np.array([p for p, _ in plain]), abs=1e-6)
    assert max(size) >= 2 and min(size) == 0
