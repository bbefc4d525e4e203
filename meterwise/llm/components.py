"""Connected components and hub-first candidate confirmation.

``components`` alternates two steps until the edges form stars around each
component's smallest node: every node points its larger neighbours, then its
smaller ones, at the smallest node it knows. A step never makes more edges
than it was given. Up to ``SMALL_EDGES`` edges a step is one window over each
node's edges, three shuffles a round; beyond that it is a grouped minimum (with
map-side combine) written to the shared folder and a join of two plain scans,
so a hub that holds a third of all edges is a skewed join that AQE splits,
never one task. Both give the same edges. Nothing but two numbers per round,
observed while writing, reaches the driver.

``confirm_by_hubs`` turns buckets of candidates into confirmed links without
enumerating a bucket's pairs: all members are first tested against the
bucket's hub (a star); only members that end in another component than their
hub are then paired, with the members of the other components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.scratch import broadcast_if_small, materialize, materialize_counted, materialize_with

#: Edges (two longs each) up to which one node's edges may meet in one task.
SMALL_EDGES = 4_000_000


def _two(df: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Two edges (u, v) for every row, named by its columns."""
    edge = lambda x: F.struct(F.col(x[0]).alias("u"), F.col(x[1]).alias("v"))
    return df.select(F.inline(F.array(edge(a), edge(b))))


def _with_least(edges: DataFrame, small: bool) -> DataFrame:
    """(u, v, m): m the smallest of u and its v."""
    if small:
        return edges.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    least = materialize(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    return edges.join(least, "u")


def _round(edges: DataFrame, small: bool) -> DataFrame:
    large = _with_least(_two(edges, ("u", "v"), ("v", "u")), small).where("v > u").select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    if not small:
        large = materialize(large.distinct(), "large")
    return _two(_with_least(large, small), ("v", "m"), ("u", "m")).where("u <> v").distinct()


def _write(edges: DataFrame) -> tuple[DataFrame, int, int | None]:
    out, seen = materialize_with(edges, "edges", n=F.count(F.lit(1)), x=F.bit_xor(F.xxhash64("u", "v")))
    return out, seen["n"], seen["x"]


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: longs, undirected; self-loops and repeats allowed) ->
    (node, component) for every node of a real edge, component being the
    smallest node reachable. No edges give an empty table; null ends are
    ignored."""
    e, n, x = _write(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while n:
        before = n, x
        e, n, x = _write(_round(e, n <= SMALL_EDGES))
        if (n, x) == before:
            break
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def confirm_by_hubs(keys: DataFrame, confirm: Callable[[DataFrame], DataFrame],
                    traits: DataFrame, may_link: Callable[[Column, Column], Column]) -> DataFrame:
    """Components over all confirmed pairs that share a bucket.

    ``keys`` (key, id): bucket memberships, longs. ``confirm`` takes distinct
    pairs (a, b) and returns (a, b, linked, near), one row per pair, ``near``
    describing a relative to b. ``traits`` (id, trait) has one row per id.
    ``may_link(x, y)`` is a necessary condition for a link between two members
    of one bucket, given structs of their ``near`` to the hub and ``trait``; it
    runs inside the join. Returns (node, component) for linked nodes.

    Whole: a confirmed pair of one bucket either lies inside a component
    that the hub tests already built (then it changes nothing), or its ends
    lie in two components, so at least one end is a stray of that bucket and
    the pair is tested in the second round.
    """
    buckets, seen = materialize_with(
        keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("far"), F.count(F.lit(1)).alias("size"))
        .where("hub < far"), "buckets", many=F.count(F.when(F.col("size") > 2, 1)))
    # a bucket of two is its hub and its far end; only larger ones meet their keys again
    large = buckets.where("size > 2").select("key", "hub")
    members = materialize(keys.join(broadcast_if_small(large, known=seen["many"]), "key").where("id <> hub"), "members")
    pairs = buckets.where("size = 2").select(F.col("far").alias("a"), F.col("hub").alias("b")).union(
        members.select("id", "hub"))
    spokes = materialize(confirm(pairs.distinct()), "spokes")
    label = materialize(components(spokes.where("linked")), "labels")
    of = lambda end: label.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    placed = (spokes.where("not linked").join(of("a"), "a", "left").join(of("b"), "b", "left")
              .withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b")))
    strays, n = materialize_counted(
        members.join(
            placed.where("ca <> cb").select(F.col("a").alias("id"), F.col("b").alias("hub"), F.col("ca").alias("comp"),
                                            "near"), ["id", "hub"])
        .join(traits, "id").select("key", "id", "comp", F.struct("near", "trait").alias("what")), "strays")
    if not n:
        return label
    others = materialize(
        members.join(strays.select("key").distinct(), "key", "left_semi")
        .join(spokes.select(F.col("a").alias("id"), F.col("b").alias("hub"), "near"), ["id", "hub"])
        .join(label.select(F.col("node").alias("id"), "component"), "id", "left")
        .join(traits, "id")
        .select("key", "id", F.coalesce("component", "id").alias("comp"), F.struct("near", "trait").alias("what")),
        "others")
    x, y = strays.alias("x"), others.alias("y")
    pairs = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp"))
                    & may_link(F.col("x.what"), F.col("y.what")))
             .select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct())
    rest = confirm(pairs).where("linked")
    merged = label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest.select("a", "b"))
    return materialize(components(merged), "labels")
