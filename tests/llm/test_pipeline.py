"""Stages keep their contracts; every query against SQL on an awkward fixture."""

import os

import duckdb
import pytest

from meterwise.llm import decontaminate, minhash
from meterwise.llm.queries import ORACLE_SQL, QUERIES

corpus_pipeline = pytest.importorskip("corpus_pipeline")

LOW = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
DOCS = [(1, LOW, "en", "a", 5), (2, LOW.lower() + " mu", "en", "a", 5), (3, None, None, None, None), (4, "", "en", "b", 0),
        (5, "12 !!", None, "b", 1), (6, "password=abcdefgh1 the other text of its own kind", "en", "b", 9),
        (7, "le chat et la souris sont dans la maison " * 20, "fr", "c", 9), (7, "le chat et la souris sont dans la maison " * 20, "fr", "c", 9),
        (8, "é" * 3000, "fr", None, 1), (9, "x y z", "en", "", 1), (None, "no id at all here", "en", "c", 1),
        (10, "the cat and the mouse are in the house " * 30, "en", "c", 9), (11, "the cat and the mouse are in the house " * 31, "en", "c", 9)]
BENCH = [(1, "he said " + LOW + " and went"), (2, None), (3, "x y z")]
PAGES = [(1, "u", "a"), (2, None, "a"), (3, "u", None), (3, "u", None), (None, "u", "a")]

TURNS = [(c, t, r, x) for c in (1, 2, 3, None) for t, r, x in (
    (0, "system", "Be brief."), (1, "user", "Hi."), (2, "assistant", "Yes?"), (4, "user", "cut of"), (5, None, None),
    (6, "assistant", "Yes?"), (7, "tool", " Odd. "), (None, "user", "No turn."), (9, "", "No role!"), (7, "tool", " Odd. "))]
VECTORS = [(i, [0.1 * (i % 7), 0.3, -0.2 * (i % 3), 0.05 * (i % 11)], i % 3) for i in range(120)] + [
    (500, None, 1), (501, [1.0, None, 0.0, 0.0], 1), (502, [float("nan"), 0.0, 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0, 0.0], 1),
    (550, [0.2, 0.2, 0.2, 0.2], None), (600, [0.0, 0.0, 0.0, 0.0], 2)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("fixture"))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(DOCS, columns).coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(
        f"{d}/conversations.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(
        f"{d}/embeddings.parquet")
    return d


def rows(cur):
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([tuple(r[i] for i in order) for r in cur.fetchall()]), key=str)


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, folder, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = QUERIES[key](spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)
    assert got == rows(con.execute(ORACLE_SQL[key]))


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        seen[name] = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    ids = {k: [i for i, _ in v] for k, v in seen.items()}
    assert set(ids["language_id"]) == {1, 2, 6, 7, 8, 9, 10, 11, None}
    assert set(ids["minhash_near_dedup"]) == {1, 6, 7, 8, 9, 10, None}
    assert set(ids["benchmark_decontamination"]) == {6, 7, 8, 10, None}
    assert set(ids["source_mixing"]) == set(ids["sharding"]) == {6, 7, 8, 10, None}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "benchmark_decontamination",
                                                      "source_mixing", "sharding"]


def test_stages_on_given_documents(spark):
    """The filters drop what brute force says, and nothing else."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    after = stage["language_id"](spark, docs, sf)
    assert after.count() == docs.where("text rlike '[a-zA-Z]'").count()
    from tests.llm.test_minhash import brute

    texts = [(r["doc_id"], r["text"]) for r in after.collect()]
    want = {i for i, (_, c) in brute(texts).items() if i == c}
    deduped = stage["minhash_near_dedup"](spark, after, sf)
    assert {r["doc_id"] for r in deduped.select("doc_id").collect()} == want
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    clean = stage["benchmark_decontamination"](spark, deduped, sf)
    hit = decontaminate.contamination(deduped, bench).where("contaminated").select("doc_id")
    assert clean.count() + hit.count() == deduped.count()
    mixed = stage["source_mixing"](spark, clean, sf)
    assert mixed.select("doc_id").distinct().count() == clean.count()


def test_run_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    assert {"shard_id", "shard_bytes"} <= set(out.columns) and out.count() > 50
    assert minhash.near_duplicates(out.dropDuplicates(["doc_id"])).where("not kept").count() == 0


def test_entry_lists_all_operators():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {k.split("_")[0] for k in names if k.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in names and os.path.exists("corpus_pipeline.py")


def test_columns_that_clash_with_the_stages_own(spark, tmp_path):
    extra = "k1 string, k2 long, f1 string, f2 long, gone long, hit_spans string, c string"
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "en", "a", 5, "x", 1, "y", 2, 3, "z", "c"), (2, words, "en", "a", 5, "x", 1, "y", 2, 3, "z", "c"),
            (3, "1 2 3", None, None, 5, "x", 1, "y", 2, 3, "z", "c"), (4, "another text altogether", "en", "b", 5, "x", 1, "y", 2, 3, "z", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    spark.createDataFrame([("i", words)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    for stage, kept in ((corpus_pipeline.language, [1, 2, 4]), (corpus_pipeline.near_dedup, [1, 3, 4]),
                        (corpus_pipeline.decontaminated, [3, 4])):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and ids(out) == kept
    from meterwise.llm import decontaminate

    cut = decontaminate.cut_spans(docs, spark.read.parquet(str(tmp_path / "benchmark.parquet")))
    assert cut.columns == docs.columns and cut.count() == 4
