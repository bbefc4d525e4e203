"""Fuzzy line deduplication.

Method: lines are normalised (lower case, runs of anything but letters and
digits to one blank, digit runs to ``0``); equal normalised lines collapse.
Every line has a SimHash made of blocks (``line_simhash``); lines with an equal
block meet (pigeonhole), those whose whole SimHashes differ in at most
``DISTANCE`` of 64 bits are tested, and two are linked if their edit
similarity, 1 - Levenshtein / longer length, is at least ``SIMILARITY``. Of each
connected group, the occurrence with the smallest (doc_id, line) stays.
Built-in functions, but for the SimHashes, the comparison of SimHashes within a
bucket and the edit test of pairs that leave it (numpy and Python on Arrow
batches; why, is in the README).

Lines of up to ``TINY`` characters also meet by their texts without any one or
two characters, which finds every pair of such lines. Other pairs are missed
if no block is equal: lines that differ in more features than they have blocks,
by chance; the README has the measured recall. Buckets are confirmed through
their hub.

Edge cases: null text has no lines. A line without letters or digits is never
linked and always stays. Repeated rows of a document are one: each (doc_id,
line) occurs once, and rows that share an id but differ in text have each of
their lines; a null id is an id of its own, smaller than all others. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm import line_buckets, line_simhash
from meterwise.llm.components import components
from meterwise.llm.scratch import BROADCAST_ROWS, broadcast_if_small, materialize, materialize_counted, materialize_with

#: Bits by which the SimHashes of tested lines may differ.
DISTANCE = 16
SIMILARITY = 0.8
TINY = 14
#: Characters up to which a line's text goes with it into its buckets.
CARRIED = 128
#: Pairs whose texts one task compares.
PAIRS = 2_048
#: Readings of the documents for the texts of all pairs, each for as many lines as may be broadcast.
PASSES = 4
#: Rows of a bucket that are compared in one task, on either side.
PART = 16_384
#: Rows up to which labels and first occurrences are broadcast.
SMALL = 1_000_000


def normalise(line: Column) -> Column:
    # a lone blank stays as it is: most matches would put a blank for a blank
    other = r"[^\p{L}\p{N}]"
    clean = F.regexp_replace(F.lower(line), f"{other}(?:(?<! )|(?={other})){other}*+", " ")
    return F.trim(F.regexp_replace(clean, r"\p{N}+", "0"))


def exploded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, line (0-based), text_hash (of the document), norm; lines that
    normalise to nothing included."""
    text = F.col(text_col).cast("string")
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                        text.alias("text"))
            .select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
            .select("doc_id", "line", "text_hash", normalise(F.col("raw")).alias("norm")))


def _shortened(norm: Column) -> Column:
    """Hashes of a text without any of as many characters as a pair of up to
    ``TINY`` characters may differ in: one from 4 characters on, two from 8."""
    def less(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1))), lambda i: F.concat(
            F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.char_length(s))))

    none, n = F.array().cast("array<string>"), F.char_length(norm)
    texts = F.concat(F.array(norm), F.when(n >= 4, less(norm)).otherwise(none),
                     F.when(n >= 8, F.flatten(F.transform(less(norm), less))).otherwise(none))
    return F.transform(F.array_distinct(texts), lambda t: F.xxhash64(F.lit("tiny"), t))


def _lines(base: DataFrame) -> DataFrame:
    """doc_id, line, text_hash, h, chars, short (the text of a line of up to
    ``CARRIED`` characters, null for longer ones) and the blocks of every line,
    once in each task that has it."""
    n = F.char_length("norm")
    lines = exploded(base, "doc_id", "text").select(
        "doc_id", "line", "text_hash", F.xxhash64("norm").alias("h"), n.alias("chars"),
        F.when(n.between(1, CARRIED), F.col("norm")).alias("short"), "norm")
    kept = lines.schema.simpleString()[len("struct<"):-1].rsplit(",norm:", 1)[0]
    at, h = len(lines.columns) - 1, lines.columns.index("h")
    signed = lines.mapInArrow(lambda batches: line_simhash.with_signatures(batches, at, h),
                              f"{kept},{line_simhash.SCHEMA}")
    return materialize(signed, "lines")


def _keys(seen: DataFrame) -> DataFrame:
    """key, id, chars, sim: the bucket keys of every line, with the SimHash of
    the features that the key is made of (0 for keys of short texts). Lines
    that occur in several tasks give their keys several times."""
    signed = seen.where(F.size("blocks") > 0)
    blocks = (signed.select("h", "chars", F.explode("blocks").alias("x"))
              .select(F.explode("x.keys").alias("key"), F.col("h").alias("id"), "chars", F.col("x.sim").alias("sim")))
    short = (signed.where(F.col("chars") <= TINY).select("h", "chars", "short")
             .select(F.explode(_shortened(F.col("short"))).alias("key"), F.col("h").alias("id"), "chars",
                     F.lit(0).cast("long").alias("sim")))
    return blocks.union(short)


def _near(a: str, b: str) -> Column:
    """Whether two ends (chars, sim), named by their prefixes, may be linked."""
    x, y = f"{a}chars", f"{b}chars"
    return (F.least(x, y) >= SIMILARITY * F.greatest(x, y)) & (
        F.bit_count(F.col(f"{a}sim").bitwiseXOR(F.col(f"{b}sim"))) <= DISTANCE)


def _similar(a: Column, b: Column) -> Column:
    """Whether the edit similarity of two texts is at least ``SIMILARITY``."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.call_function("levenshtein", a, b, F.floor(longer * (1 - SIMILARITY) + 1e-9).cast("int")) >= 0


def _texts(wanted: DataFrame, base: DataFrame) -> DataFrame:
    """h, norm of the lines that ``wanted`` (at, h) names by a hash of their place."""
    lines = (base.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
             .select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
             .select(_place("doc_id", "text_hash", "line").alias("at"), "raw").join(wanted, "at"))
    # normalised once: neither Spark's filter nor its aggregate sees through explode
    norm = lines.select("h", F.explode(F.array(normalise(F.col("raw")))).alias("norm"))
    return materialize(norm.where(F.xxhash64("norm") == F.col("h")).groupBy("h").agg(F.max("norm").alias("norm")), "texts")


def _place(doc_id: str | Column, text_hash: str | Column, line: str | Column) -> Column:
    return F.xxhash64(doc_id, text_hash, line)


def _confirmed(pairs: DataFrame, first: DataFrame, base: DataFrame) -> DataFrame:
    """Pairs (a, b) of line ids whose edit similarity suffices. The texts come
    from the first occurrences, in up to ``PASSES`` readings of the documents
    that need no shuffle of them, or else in one that does."""
    near, n = materialize_counted(pairs, "pairs")
    tested = near.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    wanted, m = materialize_counted(first.join(broadcast_if_small(tested, SMALL, known=2 * n), "h").select(
        _place("at.doc_id", "at.text_hash", "at.line").alias("at"), "h"), "wanted")
    passes = max(1, -(-m // BROADCAST_ROWS))
    if passes <= PASSES:
        parts = [_texts(F.broadcast(wanted.where(F.pmod("at", F.lit(passes)) == i)), base) for i in range(passes)]
    else:
        parts = [_texts(wanted, base)]
    text = reduce(DataFrame.union, parts)
    both = (near.join(text.select(F.col("h").alias("a"), F.col("norm").alias("ta")), "a")
            .join(text.select(F.col("h").alias("b"), F.col("norm").alias("tb")), "b").select("a", "b", "ta", "tb"))
    spread = both.repartition(max(1, -(-n // PAIRS)), "a", "b")
    return spread.mapInArrow(lambda batches: line_simhash.linked(batches, SIMILARITY), "a long, b long")


def _roles(placed: DataFrame, most: int) -> DataFrame:
    """``placed`` with part, x and y: strays (x) of a bucket meet its members (y)
    within a part. A bucket of more than ``PART`` rows, of which some stray from
    a hub and there are several components, has a part for each ``PART`` strays
    and ``PART`` members."""
    stray = F.col("comp") != F.col("hub_comp")
    whole = placed.where(F.col("n") <= PART).select("*", F.lit(0).alias("part"), stray.alias("x"), F.lit(True).alias("y"))
    if most <= PART:
        return whole
    large = placed.where(F.col("n") > PART)
    parts = (large.groupBy("key").agg(F.count(F.when(stray, 1)).alias("strays"), F.count(F.lit(1)).alias("all"),
                                      F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .where("strays > 0 and lo < hi")
             .select("key", *[F.ceil(F.col(c) / PART).cast("int").alias(p) for c, p in (("strays", "px"), ("all", "py"))]))
    large = large.join(parts, "key")

    def dealt(rows: DataFrame, own: str, other: str, x: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit(x), "id"), F.col(own)).cast("int")
        rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        part = F.col("mine") * F.col("py") + F.col("other") if x else F.col("other") * F.col("py") + F.col("mine")
        return rows.select(*placed.columns, part.alias("part"), F.lit(x).alias("x"), F.lit(not x).alias("y"))

    return whole.union(dealt(large.where(stray), "px", "py", True)).union(dealt(large, "py", "px", False))


def _groups(seen: DataFrame, first: DataFrame, base: DataFrame) -> DataFrame:
    """(node, component) over all linked lines, whole for the reason given in
    ``components.confirm_by_hubs``. Here the condition on the pair, the ratio
    of lengths and the distance of the SimHashes, stands in the bucket rows, and
    of lines of up to ``CARRIED`` characters the text as well: buckets of common
    runs are wide, and nearly all of their pairs end at the edit test there.

    The keys are dealt once: a bucket's hub and its rows meet where they lie, as
    nearly all keys belong to one line only."""
    keys = _keys(seen).where("key is not null and id is not null").repartition("key")
    buckets = keys.groupBy("key").agg(
        F.min("id").alias("hub"), F.max("id").alias("far"), F.min_by("chars", "id").alias("hub_chars"),
        F.min_by("sim", "id").alias("hub_sim"), F.count(F.lit(1)).alias("n")).where("hub < far").drop("far")
    members, met = materialize_with(
        keys.join(buckets.hint("shuffle_hash"), "key").where("id <> hub")
        .select("key", "id", "chars", "sim", "hub", "n", _near("", "hub_").alias("close")), "members", most=F.max("n"))
    tested = materialize(members.where("close").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(),
                         "hub-pairs")
    label, n = materialize_counted(components(materialize(_confirmed(tested, first, base), "links")), "labels")
    of = lambda end, name: broadcast_if_small(
        label.select(F.col("node").alias(end), F.col("component").alias(name)), SMALL, known=n)
    placed = (members.where("n > 2").join(of("id", "comp"), "id", "left").join(of("hub", "hub_comp"), "hub", "left")
              .select("key", "id", "chars", "sim", "n", F.coalesce("comp", "id").alias("comp"),
                      F.coalesce("hub_comp", "hub").alias("hub_comp")))
    texts = seen.where("short is not null and size(blocks) > 0").select(F.col("h").alias("id"), "short").repartition(
        "id").distinct()
    rows = (_roles(placed, met["most"] or 0).drop("n", "hub_comp").join(texts, "id", "left").repartition("key", "part")
            .sortWithinPartitions("key", "part", "id", "x"))
    near = rows.mapInArrow(lambda batches: line_buckets.near(batches, DISTANCE, SIMILARITY), line_buckets.SCHEMA)
    rest = (near.where(F.coalesce(_similar(F.col("ta"), F.col("tb")), F.lit(True))).select("a", "b").distinct()
            .join(tested, ["a", "b"], "left_anti"))
    more = materialize(_confirmed(rest, first, base), "more-links")
    return components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: doc_id, line (0-based), group_doc_id, group_line (the
    occurrence that stays for its group), kept."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    all_lines = _lines(base)
    seen = all_lines.where("chars > 0")
    # line ids: 64-bit hash of the normalised text
    at = F.struct("doc_id", "line", "text_hash")
    first = materialize(seen.groupBy("h").agg(F.min(at).alias("at")), "distinct-lines")
    groups, n = materialize_counted(_groups(seen, first, base).withColumnRenamed("node", "h"), "groups")
    grouped = materialize(first.join(broadcast_if_small(groups, SMALL, known=n), "h"), "grouped")
    best = grouped.groupBy("component").agg(F.min("at").alias("best"))
    moved = materialize(grouped.select("h", "component").join(best, "component").select("h", "best"), "line-groups")
    of = first.join(broadcast_if_small(moved, SMALL, known=n), "h", "left").select(
        "h", F.coalesce("best", "at").alias("best"))
    rows = seen.select("doc_id", "line", "h")
    # only rows that share an id can repeat a line
    if not all_lines.where("line = 0").groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.distinct()
    linked = rows.join(of, "h").select(
        "doc_id", "line", F.col("best.doc_id").alias("group_doc_id"), F.col("best.line").alias("group_line"))
    blank = all_lines.where("chars = 0").select("doc_id", "line", F.col("doc_id").alias("group_doc_id"),
                                                F.col("line").alias("group_line")).distinct()
    return linked.union(blank).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("group_doc_id")) & (F.col("line") == F.col("group_line")))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text made of the lines that stay, for every document
    that has text."""
    kept = dedup_lines(docs, id_col, text_col).where("kept").select("doc_id", "line")
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(
        F.split(F.col(text_col).cast("string"), "\n", -1)).alias("line", "raw")).distinct()
    left = (raw.withColumnsRenamed({"doc_id": "d", "line": "l"})
            .join(kept, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("l") == F.col("line")), "left"))
    return left.groupBy(F.col("d").alias("doc_id")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("l", "raw")))), lambda s: s["raw"]),
        "\n").alias("text"))
