"""Token counts against the library itself."""

import os
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from meterwise.llm import tokens
from meterwise.llm.scratch import scratch_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def library(path):
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(pieces.encode(t))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


def texts(seed, n):
    rng = random.Random(seed)
    letters = list("abAB'stSredm.,;:!?<|>0١٢ \t\n\x0b\x0c\x1c\x85\xa0　éÉÉक़İßΣσ한ㄱ字🙂​") + [
        "<|endoftext|>", "<|ENDOFTEXT|>", "'re", "'S", "  "]
    return ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(n)]


def test_word_by_word_counts_are_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    v = tokens.Vocabulary.load(path)
    assert v.by_words
    count, want = tokens._counter(v.version, v.kind, v.by_words, v.data), library(path)
    rows = texts(1, 4000)
    assert count(rows) == [want(t) for t in rows]
    assert count(rows) == [want(t) for t in rows]  # now from the memo


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_copies_and_edge_cases(spark, frame, name):
    path = public_tokenizers.path(name)
    want = library(path)
    rows = [(i, t) for i, t in enumerate(texts(2, 60))]
    rows += [(None, "a b"), (None, "a b"), (7, None), (8, ""), (8, "  "), (9, "A  B "), (10, "word " * 30000), (11, "x" * 9000)]
    cache = scratch_path(spark, "token-cache")
    got = tokens.count_tokens(frame(rows), tokens.Vocabulary.load(path), cache).collect()
    exact = sorted((i is None, i or 0, len((t or "").encode()), want(t or ""), want(t or "") > 2048) for i, t in rows)
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == exact
    assert tokens.count_tokens(frame([]), tokens.Vocabulary.load(path), cache).collect() == []


def test_only_missing_contents_are_encoded(spark, frame):
    v = tokens.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))
    cache = scratch_path(spark, "token-cache")
    held = lambda: spark.read.parquet(f"{cache}/{v.version}")
    tokens.count_tokens(frame([(1, "Some  words"), (2, "some words"), (3, "more")]), v, cache).collect()
    assert held().count() == 2
    # a planted count is used, so what the cache holds is not encoded again
    digest = F.unhex(F.sha2(F.lit("planted"), 256))
    spark.range(2).select(digest.alias("digest"), F.lit(77).cast("long").alias("n_tokens")).write.mode("append").parquet(
        f"{cache}/{v.version}")
    got = tokens.count_tokens(frame([(1, "planted"), (2, "PLANTED "), (3, "more"), (4, "new")]), v, cache).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {1: 77, 2: 77, 3: 1, 4: 1}
    assert held().count() == 5
    other = tokens.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"))
    assert other.version != v.version
    assert tokens.count_tokens(frame([(1, "planted")]), other, cache).first()["n_tokens"] != 77


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(ValueError):
        tokens.Vocabulary.load(str(tmp_path / "x.txt"))
