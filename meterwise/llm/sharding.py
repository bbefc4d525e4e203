"""Sharding by extendible hashing.

Method: a document's hash is 60 bits of the md5 of its key. The directory is
indexed by leading hash bits; a bucket whose bytes pass the limit, and no
other, splits on its next bit until each fits. Buckets of several depths so
make up the directory, whose depth is that of its deepest bucket; shallower
ones own several entries.

Bytes are summed once per directory cell ``LOOK`` bits below the first depth
that could fit (map-side combine, so the number of rows shuffled follows the
number of shards, not documents), and rolled up to every shallower prefix;
cells that are still too large are looked into again, deeper. Rows meet their
bucket by the bits all buckets share and a range of the hash: no row is
compared with more buckets than split below that prefix. Built-in functions
only.

Edge cases: null text has 0 bytes, a null key is the empty key. A document
larger than the limit ends alone (with rows of its own hash) in an oversized
bucket at full depth, split off as far as its neighbours ask for: a bucket
that holds a single hash never splits. If rows of one hash (repeated rows)
pass the limit together, they stay together, as lookup by key needs. An empty
table has no bucket; extra columns are kept by ``shard``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.scratch import broadcast_if_small, fresh, materialize

LIMIT_BYTES = 64 << 20
BITS = 60
LOOK = 3


def hash_of(key: Column) -> Column:
    """60 bits of md5, as a non-negative long."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: str, depth: Column) -> Column:
    return F.call_function("shiftright", F.col(h), (F.lit(BITS) - depth).cast("int"))


def _roll_up(cells: DataFrame, low: int, high: int) -> DataFrame:
    """Sums of cells (h of the cell's first hash, bytes, rows, least, most) for
    every prefix from ``low`` to ``high`` bits."""
    return (cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
            .groupBy("depth", _prefix("least", F.col("depth")).alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("least").alias("least"),
                 F.max("most").alias("most")))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """Buckets of ``sizes`` (h, bytes): depth, prefix, start, stop (the hashes
    it owns, stop excluded), bytes, rows."""
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    low = 0
    high = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + LOOK)
    rest, found = sizes, None
    while True:
        cells = (rest.groupBy(_prefix("h", F.lit(high)).alias("cell"))
                 .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("h").alias("least"),
                      F.max("h").alias("most")).drop("cell"))
        sums = materialize(_roll_up(cells, low, high), "prefixes")
        fits = (F.col("bytes") <= limit) | (F.col("least") == F.col("most"))
        parents = sums.where((F.col("depth") < high) & ~fits).select(
            (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        under = (sums.withColumn("parent", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
                 .join(parents, ["depth", "parent"], "left_semi").where(fits).drop("parent"))
        leaves = under if low else under.unionByName(sums.where((F.col("depth") == 0) & fits))
        found = leaves if found is None else found.unionByName(leaves)
        large = sums.where((F.col("depth") == high) & ~fits).select(F.col("prefix").alias("large"))
        if high >= BITS or not large.take(1):
            break
        rest = materialize(rest.withColumn("large", _prefix("h", F.lit(high))).join(
            broadcast_if_small(large), "large", "left_semi").drop("large"), "large-cells")
        low, high = high, min(BITS, high + LOOK)
    span = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(BITS) - F.col("depth")).cast("int"))
    return materialize(found.select(
        "depth", "prefix", (F.col("prefix") * span).alias("start"), ((F.col("prefix") + 1) * span).alias("stop"),
        "bytes", "rows"), "directory")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """``docs`` with shard_id (the bucket's leading bits as text; empty if
    nothing split), shard_depth, shard_bytes, shard_rows and n_bytes. Given
    columns of these names are replaced."""
    ours = ["shard_id", "shard_depth", "shard_bytes", "shard_rows", "n_bytes"]
    keep = [c for c in docs.columns if c.lower() not in ours]
    n_bytes = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    d = directory(materialize(docs.select(hash_of(F.col(id_col)).alias("h"), n_bytes.alias("bytes")), "sizes"), limit)
    shared = d.agg(F.min("depth")).first()[0] or 0
    dirs = broadcast_if_small(d.select(
        F.call_function("shiftright", F.col("start"), F.lit(BITS - shared)).alias("d_cell"),
        F.col("start").alias("d_start"), F.col("stop").alias("d_stop"), F.col("depth").cast("int").alias("d_depth"),
        F.col("prefix").alias("d_prefix"), F.col("bytes").alias("d_bytes"), F.col("rows").alias("d_rows")))
    h = fresh("h", [*keep, "d_cell", "d_start", "d_stop", "d_depth", "d_prefix", "d_bytes", "d_rows"])
    clash = {c: fresh(f"__{c}", keep) for c in keep if c.lower().startswith("d_")}
    rows = docs.select(*[F.col(c).alias(clash.get(c, c)) for c in keep], hash_of(F.col(id_col)).alias(h),
                       n_bytes.alias("n_bytes"))
    met = rows.join(dirs, (F.call_function("shiftright", F.col(h), F.lit(BITS - shared)) == F.col("d_cell"))
                    & (F.col(h) >= F.col("d_start")) & (F.col(h) < F.col("d_stop")))
    bits = F.when(F.col("d_depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("d_prefix"), F.col("d_depth"), F.lit("0")))
    return met.select(*[F.col(clash.get(c, c)).alias(c) for c in keep], bits.alias("shard_id"),
                      F.col("d_depth").alias("shard_depth"), F.col("d_bytes").alias("shard_bytes"),
                      F.col("d_rows").alias("shard_rows"), "n_bytes")
