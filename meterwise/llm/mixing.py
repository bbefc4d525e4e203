"""Mixing sources to target weights.

Method: temperature mixing. A source with token share p gets weight p^a /
sum(p^a). The exponent a in [0, 1] is bisected: the smallest one, so the
flattest mixture, whose repetition stays within ``max_repeats``, or the one
whose entropy meets a target. The weights are then realised with whole
documents: the token budget is the least for which no source is cut below one
pass, times ``budget``; every source's documents are dealt by hash into
blocks of about ``BLOCK_TOKENS`` tokens, and a source's budget is spent on
permutations of its blocks: whole passes first, then blocks in the last pass's
order until the next would cross the budget, then documents of that block in
hash order the same way.

Only source totals (``MAX_SOURCES`` rows at most) reach the driver, for the
bisection. Prefix sums run over parts of a source's order of blocks, over the
blocks of a part and over the documents of one block, never over all blocks or
documents of a source.

Edge cases: a null source is a source of its own (``""`` and null stay
apart); null or word-less documents hold no tokens and are kept once. Equal
rows share a hash and stay in one block, whose documents are taken up to the
budget in hash order, equal ones in any order. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.scratch import broadcast_if_small, fresh, materialize

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1_000_000
MAX_SOURCES = 100_000
PART_BLOCKS = 1_024


@dataclass(frozen=True)
class Share:
    """One source: its tokens, weight, token budget, whole passes, rest."""

    source: str | None
    tokens: int
    weight: float
    budget: float

    @property
    def passes(self) -> int:
        return int(self.budget // self.tokens)

    @property
    def rest(self) -> int:
        return int(self.budget - self.passes * self.tokens)


def weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raw = [(t / total) ** exponent for t in tokens]
    whole = math.fsum(raw)
    return [r / whole for r in raw]


def entropy(w: list[float]) -> float:
    return -math.fsum(x * math.log(x) for x in w if x > 0)


def repeats(tokens: list[int], w: list[float], budget: float) -> float:
    """The most passes over a source at the least budget that cuts none."""
    least = max(t / x for t, x in zip(tokens, w, strict=True))
    return max(budget * least * x / t for t, x in zip(tokens, w, strict=True))


def solve(tokens: list[int], target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS,
          budget: float = 1.0) -> float:
    """The exponent, by bisection. Entropy falls and repetition falls as it
    grows, so both limits are monotone; an entropy out of reach gives the
    nearest end."""
    def low_enough(a: float) -> bool:
        w = weights(tokens, a)
        if target_entropy is not None and entropy(w) > target_entropy:
            return False
        return max_repeats is None or repeats(tokens, w, budget) <= max_repeats + 1e-9

    if not tokens or low_enough(0.0):
        return 0.0
    a, b = 0.0, 1.0
    for _ in range(60):
        mid = (a + b) / 2
        a, b = (a, mid) if low_enough(mid) else (mid, b)
    return b


def plan(totals: dict[str | None, int], target_entropy: float | None = None,
         max_repeats: float | None = MAX_REPEATS, budget: float = 1.0) -> list[Share]:
    """Weights and budgets of all sources that hold tokens."""
    names = sorted((s for s, t in totals.items() if t), key=lambda s: (s is not None, s or ""))
    tokens = [totals[s] for s in names]
    if not tokens:
        return []
    w = weights(tokens, solve(tokens, target_entropy, max_repeats, budget))
    whole = budget * max(t / x for t, x in zip(tokens, w, strict=True))
    # a budget within a millionth of whole passes means those passes
    near = lambda b, t: round(b / t) * t if abs(b / t - round(b / t)) < 1e-6 else b
    return [Share(s, t, x, near(whole * x, t)) for s, t, x in zip(names, tokens, w, strict=True)]


def token_count(text: Column) -> Column:
    """Whitespace-separated words; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def _running(value: str, parts: list[str], order: list[Column]) -> Column:
    """Running sum; rows that are equal in ``order`` share the later value."""
    return F.sum(value).over(Window.partitionBy(*parts).orderBy(*order))


def _spent(sizes: DataFrame, most: int) -> DataFrame:
    """``sizes`` (source, block, size, ...) with ``end``: the tokens of the
    source's blocks up to this one, in the order of the last pass. The order is
    cut into parts of about ``PART_BLOCKS`` blocks of the source with the most
    blocks (``most``); sums run over the parts of a source and over the blocks
    of a part."""
    digits = 1
    while most > PART_BLOCKS * 16**digits:
        digits += 1
    order = F.md5(F.concat_ws(":", F.lit("block"), F.col("block").cast("string")).cast("binary"))
    placed = sizes.withColumn("order", order).withColumn("part", F.substring("order", 1, digits))
    parts = (placed.groupBy("source", "part").agg(F.sum("size").alias("held"))
             .withColumn("before", _running("held", ["source"], [F.col("part")]) - F.col("held"))
             .select(F.col("source").alias("ps"), F.col("part").alias("pp"), "before"))
    return (placed.withColumn("within", _running("size", ["source", "part"], [F.col("order"), F.col("block")]))
            .join(parts, F.col("source").eqNullSafe(F.col("ps")) & (F.col("part") == F.col("pp")))
            .withColumn("end", F.col("before") + F.col("within")).drop("ps", "pp", "before", "within", "order", "part"))


def _hash(id_col: Column) -> Column:
    return F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


@dataclass(frozen=True)
class Plan:
    """Small tables that decide how often a row is taken."""

    sources: DataFrame  # source: weight, passes, rest, n_blocks
    blocks: DataFrame  # source, block: wholly inside the rest or not
    edge: DataFrame  # source, block that the rest cuts: largest hash taken

    def apply(self, df: DataFrame, source: str, h: str, some: Column, prefix: str) -> DataFrame:
        """``df`` with ``<prefix>weight``, ``<prefix>block`` and
        ``<prefix>copies``; ``h`` names the hash column, ``some`` says whether
        a row holds tokens. All joined tables are small."""
        name = lambda x: prefix + x
        src = self.sources.select(*[F.col(c).alias(name(c)) for c in self.sources.columns])
        blk = self.blocks.select(*[F.col(c).alias(name("b_" + c)) for c in self.blocks.columns])
        edge = self.edge.select(*[F.col(c).alias(name("e_" + c)) for c in self.edge.columns])
        block = F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), F.coalesce(name("n_blocks"), F.lit(1)))
        src_of = F.col(source).cast("string")
        out = (df.join(F.broadcast(src), src_of.eqNullSafe(F.col(name("source"))), "left")
               .withColumn(name("block"), block)
               .join(blk, src_of.eqNullSafe(F.col(name("b_source"))) & (F.col(name("block")) == F.col(name("b_block"))),
                     "left")
               .join(F.broadcast(edge), src_of.eqNullSafe(F.col(name("e_source")))
                     & (F.col(name("block")) == F.col(name("e_block"))), "left"))
        more = (F.coalesce(name("b_inside"), F.lit(False)) | F.coalesce(F.col(h) <= F.col(name("e_upto")), F.lit(False)))
        copies = F.when(some, F.coalesce(F.col(name("passes")) + more.cast("int"), F.lit(1))).otherwise(F.lit(1))
        return out.withColumn(name("copies"), copies.cast("int")).withColumn(
            name("weight"), F.coalesce(name("weight"), F.lit(0.0)))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, target_entropy: float | None,
          max_repeats: float | None, budget: float) -> tuple[DataFrame, Plan]:
    base = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        token_count(F.col(text_col).cast("string")).alias("n_tokens"), _hash(F.col(id_col)).alias("h")), "tokens")
    rows = base.groupBy("source").agg(F.sum("n_tokens").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    shares = plan({r["source"]: r["n"] for r in rows}, target_entropy, max_repeats, budget)
    sources = docs.sparkSession.createDataFrame(
        [(s.source, s.weight, s.passes, s.rest, max(1, -(-s.tokens // BLOCK_TOKENS))) for s in shares],
        "source string, weight double, passes int, rest long, n_blocks long")
    no_edge = docs.sparkSession.createDataFrame([], "source string, block long, upto string")
    no_blocks = docs.sparkSession.createDataFrame([], "source string, block long, inside boolean")
    dealt = Plan(sources, no_blocks, no_edge).apply(base, "source", "h", F.col("n_tokens") > 0, "p_")
    dealt = dealt.select("source", "h", "n_tokens", F.col("p_block").alias("block"), F.col("p_rest").alias("rest"))
    sizes = materialize(dealt.where("rest > 0").groupBy("source", "block", "rest").agg(
        F.sum("n_tokens").alias("size")), "block-sizes")
    most = max([1, *(-(-s.tokens // BLOCK_TOKENS) for s in shares)])
    blocks = materialize(
        _spent(sizes, most)
        .withColumn("inside", F.col("end") <= F.col("rest"))
        .withColumn("room", F.col("rest") - F.col("end") + F.col("size")), "blocks")
    cut = blocks.where("not inside and room > 0").select(
        F.col("source").alias("cs"), F.col("block").alias("cb"), "room")
    edge = materialize(
        dealt.join(F.broadcast(cut), F.col("source").eqNullSafe(F.col("cs")) & (F.col("block") == F.col("cb")))
        .withColumn("end", _running("n_tokens", ["source", "block"], [F.col("h")]))
        .where(F.col("end") <= F.col("room")).groupBy("source", "block").agg(F.max("h").alias("upto")), "cut-blocks")
    inside = broadcast_if_small(blocks.where("inside").select("source", "block", "inside"), MAX_SOURCES)
    return base, Plan(sources, inside, edge)


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS,
             budget: float = 1.0) -> DataFrame:
    """Per document row: doc_id, source, n_tokens, weight (of its source),
    copies (times it is taken), block."""
    base, p = _plan(docs, id_col, text_col, source_col, target_entropy, max_repeats, budget)
    out = p.apply(base, "source", "h", F.col("n_tokens") > 0, "p_")
    return out.select("doc_id", base["source"], "n_tokens", F.col("p_weight").alias("weight"),
                      F.col("p_copies").alias("copies"), F.col("p_block").alias("block"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS,
        budget: float = 1.0) -> DataFrame:
    """``docs`` with every row repeated as often as ``schedule`` takes it; the
    text is not shuffled."""
    _, p = _plan(docs, id_col, text_col, source_col, target_entropy, max_repeats, budget)
    h = fresh("mix_hash", docs.columns)
    prefix = h.replace("mix_hash", "mix_")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    some = F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    out = p.apply(docs.withColumn(h, _hash(F.col(id_col))), source_col, h, some, prefix)
    return out.withColumn(h, F.explode(F.array_repeat(F.lit(1), F.col(prefix + "copies")))).select(*docs.columns)
