"""Token counts through a digest cache.

Method: a text's content is normalised by steps that cannot change its count
(see ``Vocabulary``), and its SHA-256 is looked up in a cache of counts kept in
a folder for each tokenizer version (the SHA-256 of the vocabulary file, the
library's name and its release). Only contents that the cache does not hold are
encoded, each once however often it occurs, and their counts are appended to
the cache, which every later run over other documents reads.

Texts are shuffled once, by digest, after copies have collapsed in the task
that scanned them; the lookup of missing contents uses the same distribution.
Documents meet their counts by a join of digests only, whose hot keys (one text
that fills a third of the rows) AQE splits. Encoding sees Arrow batches in
slices of bounded bytes.

Edge cases: a null text counts as empty, an empty one has no token. Repeated
rows and ids, and null ids, each keep their row. An empty table gives an empty
result; extra columns are ignored. Two runs that append the same content leave
two equal cache rows, which are read as one. A very long text is encoded whole,
word by word where the vocabulary allows it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.minhash import slices
from meterwise.llm.scratch import materialize

LIMIT = 2048
#: Words whose counts a worker remembers, and words of one library call.
MEMO, TOGETHER = 1_000_000, 4096

# Fixed value: the pre-tokenizer pattern under which words can be counted apart.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORD = re.compile(r"[^ \t-\r]+")
_END_MARKS = ".,;:!?"


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary file: ``.json`` is read by the library tokenizers,
    ``.model`` by sentencepiece.

    ``by_words`` holds where the tokenizer lower-cases, turns each run of white
    space into a space that it then drops, and splits by ``WORD_PATTERN``: there
    ASCII white space can be collapsed and words counted apart, and, in texts
    without ``<|``, which opens its special strings, ASCII capitals lowered.
    """

    kind: str
    data: bytes
    version: str
    by_words: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read ``path`` on the driver; tasks get the contents by broadcast."""
        with open(path, "rb") as f:
            data = f.read()
        if path.endswith(".json"):
            import tokenizers as library
        elif path.endswith(".model"):
            import sentencepiece as library
        else:
            raise ValueError(f"a vocabulary file ends in .json or .model, got {path!r}")
        kind = library.__name__
        of = f"{kind} {library.__version__} {hashlib.sha256(data).hexdigest()}"
        return cls(kind, data, hashlib.sha256(of.encode()).hexdigest(),
                   kind == "tokenizers" and _counts_words_apart(json.loads(data)))

    def content(self, text: Column) -> Column:
        """``text`` in the form whose digest is the cache key."""
        if not self.by_words:
            return text
        flat = F.trim(F.regexp_replace(text, r"[ \t-\r]+", " "))
        low = F.translate(flat, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return F.when(F.contains(flat, F.lit("<|")), flat).otherwise(low)


def _counts_words_apart(spec: dict) -> bool:
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (steps == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
                      {"type": "Lowercase"}]
            and len(splits) == 2 and splits[0].get("pattern") == {"Regex": WORD_PATTERN}
            and splits[0].get("behavior") == "Removed" and splits[0].get("invert") is True
            and splits[1].get("type") == "ByteLevel" and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
            and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")
            and all(t["content"].startswith("<|") and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized"))
                    and not re.search(r"\s", t["content"]) for t in spec["added_tokens"]))


class _Words:
    """Counts of texts as the sums of their words' counts, which are kept."""

    def __init__(self, tokenizer):
        self.tokenizer, self.memo = tokenizer, {}

    def _learn(self, words: list[str]) -> None:
        """One call for many words, each token placed by its offset."""
        for a in range(0, len(words), TOGETHER):
            part = words[a:a + TOGETHER]
            starts = np.cumsum([0] + [len(w) + 1 for w in part[:-1]])
            at = [s for s, _ in self.tokenizer.encode(" ".join(part), add_special_tokens=False).offsets]
            n = np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(part)) if at else [0] * len(part)
            self.memo.update(zip(part, map(int, n), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        get, known, parts, new = self.memo.get, [], [], {}
        for text in texts:
            words = _WORD.findall(text)
            n = list(map(get, words))
            parts.append([w for w, k in zip(words, n, strict=True) if k is None] if None in n else [])
            known.append(sum(filter(None, n)))
            for w in parts[-1]:
                # letters and the marks after them are tokens apart
                stem = w.rstrip(_END_MARKS)
                if len(stem) < len(w) and stem.lower().isalpha() and unicodedata.is_normalized("NFC", stem):
                    new[w] = stem, w[len(stem):]
                else:
                    new[w] = w,
        self._learn([p for p in {p: None for ps in new.values() for p in ps} if p not in self.memo])
        for w, ps in new.items():
            self.memo[w] = sum(map(self.memo.__getitem__, ps))
        return [k + sum(map(self.memo.__getitem__, p)) for k, p in zip(known, parts, strict=True)]


@functools.lru_cache(maxsize=2)
def _counter(version: str, kind: str, by_words: bool, data: bytes):
    """list of texts -> list of counts; kept while the worker lives."""
    if kind == "sentencepiece":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data.decode())
    if by_words:
        return _Words(tokenizer).counts
    return lambda texts: [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def _encode(vocabulary):
    def run(batches):
        v = vocabulary.value
        count = _counter(v.version, v.kind, v.by_words, v.data)
        for batch in batches:
            for a, b, texts in slices(batch, 1, 1 << 20):
                n = count([t.decode("utf-8", "replace") for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64())],
                                                 names=["digest", "n_tokens"])

    return run


def open_cache(spark, folder: str, version: str) -> str:
    """The folder of one tokenizer version, made if it is not there."""
    path = f"{folder.rstrip('/')}/{version}"
    spark.createDataFrame([], "digest binary, n_tokens long").write.mode("append").parquet(path)
    return path


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, cache: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.
    ``cache`` is a shared folder; missing contents are encoded and appended
    when this is called."""
    spark = docs.sparkSession
    path = open_cache(spark, cache, vocabulary.version)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    content = vocabulary.content(text)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                        F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content"))
    known = spark.read.schema("digest binary, n_tokens long").parquet(path)
    missing = (keyed.groupBy("digest").agg(F.first("content").alias("content"))
               .join(known.hint("merge"), "digest", "left_anti"))
    shared = spark.sparkContext.broadcast(vocabulary)
    (missing.select("digest", "content").mapInArrow(_encode(shared), "digest binary, n_tokens long")
     .write.mode("append").parquet(path))
    known = spark.read.schema("digest binary, n_tokens long").parquet(path)
    counts = materialize(known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    found = F.coalesce("n_tokens", F.raise_error(F.lit("a content is missing from the token cache")).cast("long"))
    return (keyed.drop("content").join(counts, "digest", "left")
            .select("doc_id", "n_bytes", found.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit))
