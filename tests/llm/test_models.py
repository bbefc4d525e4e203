"""Language mixtures and the quality network on held-out rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterwise.llm import langid, quality
from meterwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_folds_match_crc32(frame):
    got = frame([(i,) for i in (0, 7, 123, -5)] + [(None,)]).select("doc_id", langid.fold("doc_id", 5).alias("f")).collect()
    for r in got:
        assert r["f"] == (-1 if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 5)


def test_language_accuracy_on_held_out_rows(spark):
    out = QUERIES["op5_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    r = (out.where("held_out").join(docs, "doc_id")
         .agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("acc"), F.min("score").alias("low"),
              F.max("score").alias("high"), F.count("*").alias("n")).first())
    assert r["n"] > 150 and r["acc"] > 0.98 and 0 <= r["low"] <= r["high"] <= 1


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet"), langid.fold("doc_id", 5) != 0)


def test_mixture_proportions(spark, model):
    docs = {r["lang"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where(
        "length(text) between 2500 and 4000").orderBy("doc_id").collect()}
    text = docs["de"][:2000] + "\n" + docs["fr"][:1000]
    pi, size = langid.mixtures(model, [text.encode(), docs["es"].encode(), None, b"12 34", "ж".encode()])
    share = dict(zip(model.langs, pi[0]))
    assert 0.5 < share["de"] < 0.8 and 0.2 < share["fr"] < 0.5 and size[0] >= 2
    assert model.langs[pi[1].argmax()] == "es" and pi[1].max() > 0.9
    assert not pi[2].any() and not pi[3].any() and size[4] >= 1


def test_a_batch_changes_nothing(model, spark):
    texts = [r["text"].encode() for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect()]
    together = langid.mixtures(model, [*texts, None, b""])[0]
    for t, row in zip(texts, together):
        assert np.allclose(langid.mixtures(model, [t])[0][0], row)


def test_language_edge_cases(frame, model):
    rows = [(1, None), (2, ""), (3, "123 ... €"), (None, "the and of the"), (4, "x " * 200_000), (5, "the"), (5, "the")]
    got = langid.identify(frame(rows), model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["lang_pred"] for i in (1, 2, 3)} == {langid.UNKNOWN} and by[1]["score"] == 0
    assert by[5]["lang_pred"] in model.langs and by[None]["lang_pred"] == "en"
    none = langid.train(frame(rows), F.lit(True))
    assert none.langs == [] and {r["lang_pred"] for r in langid.identify(frame(rows), none).collect()} == {langid.UNKNOWN}
    assert langid.identify(frame([]), model).collect() == []


def test_quality_on_held_out_rows(spark):
    out = QUERIES["op3_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = out.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good = [r for r in rows if r["quality"] == 1]
    bad = [r for r in rows if r["quality"] == 0]
    assert np.mean([r["predicted"] for r in good]) > 0.97
    assert np.mean([r["predicted"] == 0 for r in bad]) > 0.7
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_network_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = quality.Network()
    net.trained = True
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [bytes(rng.integers(1, 255, n, dtype=np.uint8)) for n in (0, 50, 130, 700)]
    y = np.array([0, 1, 1, 0], np.float64)

    def loss():
        p = net.score(texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net._gradients(texts, y)
    for name, at in (("out", 3), ("base", 0), ("bias", 2)):
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-4
        up = loss()
        net.p[name][at] = keep - 1e-4
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / 2e-4 - g[name][at]) < 1e-3, name


def test_whole_text_counts_and_batches_do_not(monkeypatch):
    net = quality.Network().fit([b"good words here " * 20, b"@@@@ #### !!!! " * 20] * 20, np.array([1, 0] * 20, np.float32))
    assert net.score([b"good words here " * 9])[0] > 0.5 > net.score([b"@@@@ #### !!!! " * 9])[0]
    long = b"good words here " * 5000
    assert net.score([long + b"@@@@ #### !!!! " * 2000])[0] < net.score([long])[0]
    texts = [b"", b"a", long, b"@" * 127, b"@" * 128]
    together = net.score(texts)
    monkeypatch.setattr(quality, "PIECE", 3)
    assert np.allclose([net.score([t])[0] for t in texts], together, atol=1e-6)


def test_quality_edge_cases(frame, spark):
    docs = frame([(1, None), (2, ""), (None, "x"), (3, "y"), (3, "y")])
    none = quality.train(docs, spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int"), F.lit(True))
    got = quality.classify(docs, none).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.5}
    assert quality.classify(frame([]), none).collect() == []
