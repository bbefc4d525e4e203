"""Benchmark decontamination by exact token windows.

Method: the benchmark's distinct windows become a hash table that is
broadcast when a count shows it is small (shuffled otherwise); every window
of every document is hashed inside whole-stage codegen and probed against it;
hits are verified word by word, and spans or whole documents are removed.
Built-in functions only.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing
A-Z. A window is ``window`` consecutive item words; an item with fewer words,
but not none, is one window of all its words. A document is shuffled only as
its key and hits, never its text.

Edge cases: null text has no words; null or word-less items have no window;
null item ids are not counted. Repeated rows get equal results, since hits
are keyed by id and a 128-bit hash of the text. An empty benchmark hits
nothing; an empty table gives an empty result. Extra columns are kept by the
removing forms and ignored by ``contamination``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.scratch import broadcast_if_small, fresh, materialize

WINDOW = 10
#: Benchmark windows up to which the table is broadcast.
WINDOW_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same before lower-casing.
NOT_RAW_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the fast built-in form where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Array of normalised words; empty for null text."""
    parts = F.split(ascii_lower(text), NOT_WORD)
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def _key(text: Column, name: str) -> list[Column]:
    return [F.xxhash64(text).alias(f"{name}1"), F.xxhash64(F.lit(7), text).alias(f"{name}2")]


def _windows(bench: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """item_id (string), len, win (the window's words, blank-separated)."""
    w = bench.select(F.col(item_col).cast("string").alias("item_id"),
                     words_of(F.col(text_col).cast("string")).alias("w")).where("size(w) > 0")
    m = F.least(F.size("w"), F.lit(window))
    return (w.withColumn("len", m).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - m + 1)))
            .select("item_id", "len", F.array_join(F.slice("w", F.col("at"), F.col("len")), " ").alias("win"))
            .distinct())


def _hash(words: Column, at: Column, n: int, *salt: int) -> Column:
    """Hash of ``n`` words from 0-based ``at``; the same for a window's words."""
    return F.xxhash64(*[F.lit(x) for x in salt], *[F.get(words, at + k) for k in range(n)])


def window_hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per hit: doc_id, k1, k2 (hash of the text), at (0-based word),
    len, item_id. Repeated rows give a hit once."""
    wins = materialize(_windows(bench, item_col, bench_text_col, window), "windows")
    lengths = sorted(r["len"] for r in wins.select("len").distinct().collect())  # at most ``window`` values
    keyed = docs.select(F.col(id_col).alias("doc_id"), *_key(F.col(text_col), "k"),
                        words_of(F.col(text_col).cast("string")).alias("w"))
    if not lengths:
        return keyed.select("doc_id", "k1", "k2", F.lit(0).alias("at"), F.lit(0).alias("len"),
                            F.lit("").alias("item_id")).where("false")
    small = wins.count() <= WINDOW_ROWS
    table = None
    for n in lengths:
        words = F.split("win", " ")
        of = (wins.where(F.col("len") == n).select("win").distinct()
              .select("win", _hash(words, F.lit(0), n).alias("h"), _hash(words, F.lit(0), n, 7).alias("h2"),
                      F.lit(n).alias("len")))
        table = of if table is None else table.union(of)
    table = materialize(table, "window-hashes")
    last = F.size("w") - lengths[0]
    scanned = keyed.select("*", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))
    if len(lengths) > 1:
        each = F.array(*[F.struct(F.lit(n).alias("len"), _hash(F.col("w"), F.col("at"), n).alias("h")) for n in lengths])
        probes = scanned.select("*", F.inline(each)).where(F.col("at") + F.col("len") <= F.size("w"))
    else:
        probes = scanned.select("*", F.lit(lengths[0]).alias("len"),
                                _hash(F.col("w"), F.col("at"), lengths[0]).alias("h"))
    if small:  # the words are still at hand after a broadcast join: compare them
        hit = (probes.join(F.broadcast(table.drop("h2")), ["len", "h"])
               .where(F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " ") == F.col("win")))
        wins = F.broadcast(wins)
    else:  # shuffle two hashes of the window, not the document's words
        second = F.coalesce(*[F.when(F.col("len") == n, _hash(F.col("w"), F.col("at"), n, 7)) for n in lengths])
        hit = probes.select("doc_id", "k1", "k2", "at", "len", "h", second.alias("h2")).join(table, ["len", "h", "h2"])
    return (hit.select("doc_id", "k1", "k2", "at", "len", "win").distinct().join(wins, ["len", "win"])
            .select("doc_id", "k1", "k2", "at", "len", "item_id"))


def _per_document(hits: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_hit, items (sorted distinct), spans (sorted)."""
    g = hits.groupBy("doc_id", "k1", "k2").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"),
        F.sort_array(F.collect_set(F.struct("at", "len"))).alias("spans"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))))
    return g.withColumn("n_hit", F.size(covered).cast("long"))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items, contaminated."""
    found = materialize(_per_document(window_hits(docs, bench, id_col, text_col, item_col, bench_text_col, window))
                        .select("doc_id", "k1", "k2", "n_hit", "items"), "contamination")
    base = docs.select(F.col(id_col).alias("doc_id"), *_key(F.col(text_col), "k"),
                       F.size(words_of(F.col(text_col).cast("string"))).cast("long").alias("n_words"))
    f = found.select(F.col("doc_id").alias("fd"), F.col("k1").alias("f1"), F.col("k2").alias("f2"), "n_hit", "items")
    j = base.join(f, F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("k1") == F.col("f1"))
                  & (F.col("k2") == F.col("f2")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return j.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                    items.alias("items"), (n_hit > 0).alias("contaminated"))


def _fresh_keys(docs: DataFrame) -> list[str]:
    """Names of a text's two hashes in ``docs`` and in a table that it meets."""
    out = []
    for name in ("k1", "k2", "f1", "f2"):
        out.append(fresh(name, [*docs.columns, *out]))
    return out


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold an occurrence of a window."""
    hit = window_hits(docs, bench, id_col, text_col, item_col, bench_text_col, window)
    c1, c2, f1, f2 = _fresh_keys(docs)
    bad = broadcast_if_small(materialize(hit.select(
        F.col("k1").alias(f1), F.col("k2").alias(f2)).distinct(), "contaminated"))
    h1, h2 = _key(F.col(text_col), "k")
    return (docs.withColumn(c1, h1).withColumn(c2, h2)
            .join(bad, (F.col(c1) == F.col(f1)) & (F.col(c2) == F.col(f2)), "left_anti").drop(c1, c2))


def cut_spans(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit words, and the characters between two hit words
    that follow each other, cut out of the text; other text is unchanged."""
    per = _per_document(window_hits(docs, bench, id_col, text_col, item_col, bench_text_col, window))
    c1, c2, f1, f2 = _fresh_keys(docs)
    cs = fresh("hit_spans", [*docs.columns, c1, c2, f1, f2])
    spans = materialize(per.groupBy(F.col("k1").alias(f1), F.col("k2").alias(f2)).agg(
        F.max("spans").alias(cs)), "spans")
    h1, h2 = _key(F.col(text_col), "k")
    j = (docs.withColumn(c1, h1).withColumn(c2, h2)
         .join(spans, (F.col(c1) == F.col(f1)) & (F.col(c2) == F.col(f2)), "left").drop(f1, f2))
    text = F.col(text_col)
    words = F.array_remove(F.split(text, NOT_RAW_WORD), "")
    gaps = F.split(text, RAW_WORD, -1)
    hit = F.array_distinct(F.flatten(F.transform(cs, lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))))
    kept = F.transform(words, lambda w, i: F.when(
        F.array_contains(hit, i), F.lit("")).otherwise(w))
    gap = F.transform(gaps, lambda g, i: F.when(
        F.array_contains(hit, i) & F.array_contains(hit, i - 1), F.lit("")).otherwise(g))
    joined = F.array_join(F.zip_with(gap, kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
    return j.withColumn(text_col, F.when(F.col(cs).isNotNull(), joined).otherwise(text)).drop(c1, c2, cs)
