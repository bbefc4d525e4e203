"""Secret scans with corpus-wide ownership frequency.

Method: besides the fixed base kinds, every long mixed token is a candidate;
candidates are hashed and counted over the whole corpus by distinct
repositories and owners. A candidate that ``WIDE_OWNERS`` owners or more share is a
copied example; any other is live-looking and becomes a span, so a mirror under
a second owner hides nothing. However many repositories of few owners hold it,
it stays live-looking: one owner's leak may be copied within its own site.
``ownership`` reports both counts. Base spans always stay and get the same
verdict. Built-in functions only.

Offsets are code points, end exclusive. Splitting a text at a pattern gives
the gaps between its matches, so running lengths of gaps and matches are the
offsets.

The table's columns name a repository and an owner per row (for the given
documents: the document itself, and its ``source``). Only hashes and ids are
shuffled; counts are two grouped sums with map-side combine, so one secret
that a third of all rows hold stays balanced.

Edge cases: null text counts as empty; null owners count as one owner of their
own. Repeated rows get equal results. Candidates inside a base span are not
added. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.scratch import materialize

# The base patterns.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
          r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A candidate beyond the base: a long run that mixes digits and letters
#: (looked at from its start only, so a very long run costs linear time).
TOKEN = (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])"
         r"[A-Za-z0-9+/_=-]{20,}")
#: Owners from which on a candidate counts as a widely copied example.
WIDE_OWNERS = 3

_SPAN = "struct<start:int,end:int,value:string>"


def _spans(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Matches of ``pattern`` as array of (start, end, value), left to right."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    parts = F.arrays_zip(found.alias("m"), value.alias("v"), gaps.alias("g"))
    start = F.struct(F.array().cast(f"array<{_SPAN}>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["g"]
        end = begin + F.coalesce(F.char_length(p["m"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), p["v"].alias("value")).cast(_SPAN))
        return F.struct(F.when(p["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"),
                        end.alias("at"))

    all_spans = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), all_spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _kind(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"),
        F.xxhash64(s["value"]).alias("h1"), F.xxhash64(F.lit(7), s["value"]).alias("h2")))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
               repo_col: str | None = None) -> DataFrame:
    """Per row: doc_id, owner, repo, k1, k2 (text hash), base, extra (arrays of
    start, rank, kind, end, h1, h2, sorted)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
                    F.col(repo_col or id_col).cast("string").alias("repo"), text.alias("text"))
    t = F.col("text")
    d = d.select("doc_id", "owner", "repo", F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2"),
                 F.filter(_spans(t, ASSIGN, 2), lambda s: F.char_length(s["value"]) >= 8).alias("assign"),
                 _spans(t, ACCESS).alias("access"), _spans(t, HEX).alias("hex"), _spans(t, TOKEN).alias("token"))
    base = F.sort_array(F.concat(_kind(F.col("assign"), "assign", 1), _kind(F.col("access"), "access", 2),
                                 _kind(F.col("hex"), "hex", 3)))
    d = d.select("doc_id", "owner", "repo", "k1", "k2", base.alias("base"),
                 F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"),
                 F.size("hex").cast("long").alias("n_hex"), _kind(F.col("token"), "owned", 4).alias("token"))
    apart = F.filter("token", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return d.withColumn("extra", apart).drop("token")


def ownership(spans: DataFrame) -> DataFrame:
    """Per candidate hash: h1, h2, owners, repos (distinct counts), copied."""
    one = (spans.select("owner", "repo", F.explode(F.concat("base", "extra")).alias("s"))
           .select("s.h1", "s.h2", F.coalesce(F.col("owner"), F.lit("")).alias("owner"),
                   F.col("owner").isNull().alias("no_owner"), "repo").distinct())
    by_owner = one.groupBy("h1", "h2", "owner", "no_owner").agg(F.count("repo").alias("repos"))
    return (by_owner.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
            .withColumn("copied", F.col("owners") >= WIDE_OWNERS))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_col: str | None = None) -> DataFrame:
    """Per document row: doc_id, n_assign, n_access, n_hex, base_spans,
    all_spans (digest strings), n_live (live-looking spans), n_copied
    (spans that ``WIDE_OWNERS`` owners or more share)."""
    spans = materialize(find_spans(docs, id_col, text_col, owner_col, repo_col), "spans")
    known = materialize(ownership(spans), "ownership")
    some = spans.where("size(base) + size(extra) > 0").select("doc_id", "k1", "k2", "base", "extra").distinct()
    each = (some.select("doc_id", "k1", "k2", F.explode(F.concat("base", "extra")).alias("s"))
            .select("doc_id", "k1", "k2", "s", "s.h1", "s.h2"))
    judged = (each.join(known, ["h1", "h2"])
              .where("s.rank < 4 or not copied")
              .groupBy("doc_id", "k1", "k2").agg(
        F.sort_array(F.collect_set("s")).alias("all_spans"),
        F.count(F.when(~F.col("copied"), 1)).alias("n_live"),
        F.count(F.when(F.col("copied"), 1)).alias("n_copied")))
    f = materialize(judged.withColumnsRenamed({"doc_id": "fd", "k1": "f1", "k2": "f2"}), "judged")
    j = spans.join(f, F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("k1") == F.col("f1"))
                   & (F.col("k2") == F.col("f2")), "left")
    return j.select("doc_id", "n_assign", "n_access", "n_hex", _digest(F.col("base")).alias("base_spans"),
                    F.coalesce(_digest(F.col("all_spans")), F.lit("")).alias("all_spans"),
                    F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
                    F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"))
