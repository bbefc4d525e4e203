"""Hard-negative mining by lists that an anchor cluster shares.

Method: anchors are grouped by the nearest of a few centers (spherical
k-means). For a cluster with center ``c`` whose members lie within the angle
``t`` of it, no member ``a`` can score a candidate ``x`` above
``|a| * |x| * cos(max(angle(x, c) - t, 0))``. The factor after ``|a|`` is the
same for all members, so a cluster's candidates are sorted by it once, and
every member walks that list until the bound of the next candidate falls below
what it still needs: its k-th best score so far, or the lower end of its window.
That ends the walk with proof, so results are exact; the clusters only decide
how far members walk.

Two walks: one over rows of the anchor's label for its positives, one over
rows of other labels, where an anchor asks once for each distinct positive
score, with the window that score gives.

Clusters lie in parts of about ``ANCHORS`` anchors, small ones together, large
ones split by hash. A task meets one part and one block of about ``CANDIDATES``
candidates, sorts the block once for each cluster of the part, and returns each
walker's best k of it; the blocks' results are ranked in Spark, where a rank
limit drops all but k rows of a walker before the shuffle. Part and block counts
follow the table's counts, so a task stays the same at any size and no label,
cluster or vector is hot. Centers are fitted on at most ``SAMPLE`` anchors,
chosen by hash.

Scores are integers: each component x counts as floor(256 * x). They are exact:
sums that a double cannot hold are made in Python integers, and a score outside
a long becomes the nearest long. Components beyond 2**60 count as 2**60.

Edge cases: rows with a null id, label or vector, or a null or non-finite
component take no part. Only vectors of one dimension meet; the zero and the
empty vector take part with score 0. Of rows that share an id, one stays (the
smallest label, then vector). Ties go to the smaller id. An anchor without
positives, or a positive without negatives in its window, gives no row. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.scratch import broadcast_if_small, materialize, materialize_counted

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in percent of its positive's.
LOW, HIGH = 50, 95
SCALE = 256
SAMPLE, CLUSTERS, STEPS = 8_192, 64, 8
ANCHORS, CANDIDATES = 32_768, 32_768
#: Candidates of a list that are scored in one step, and walkers that walk together.
STRIDE, WALKERS = 512, 1024
_LARGEST = float(2**60)
_LONG = 2**63 - 1


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one (zero rows stay); a row's largest component is
    divided out first, so no square overflows."""
    top = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit_centers(x: np.ndarray, clusters: int = CLUSTERS, steps: int = STEPS) -> np.ndarray:
    """Unit centers of spherical k-means over the rows of ``x``."""
    units = _units(x)
    n = max(1, min(clusters, len(x) // 16))
    centers = units[np.random.default_rng(3).choice(len(units), n, replace=False)]
    for _ in range(steps):
        own = (units @ centers.T).argmax(1)
        total = np.zeros_like(centers)
        np.add.at(total, own, units)
        centers = np.where(np.bincount(own, minlength=n)[:, None] > 0, _units(total), centers)
    return centers


class Scorer:
    """Exact integer inner products of two sets of whole-number vectors."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
        self.exact = bool(most < 2**53)
        self.a, self.b = (a, b) if self.exact else (_integers(a), _integers(b))

    def __call__(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        if self.exact:
            return (self.a[rows] @ self.b[cols].T).astype(np.int64)
        return np.clip(self.a[rows].dot(self.b[cols].T), -_LONG, _LONG).astype(np.int64)


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def walk(a: np.ndarray, low: np.ndarray, high: np.ndarray, label: np.ndarray, same: bool, own: np.ndarray,
         center: np.ndarray, x: np.ndarray, x_label: np.ndarray, x_id: np.ndarray, k: int):
    """Each walker's best k candidates with a score within [low, high] and an
    equal (``same``) or different label: arrays (walker, id, score).

    ``a`` are the walkers' vectors and ``own`` their ids, ``center`` the unit
    center of their cluster."""
    units, x_units = _units(a), _units(x)
    spread = np.arccos(np.clip((units @ center).min(initial=1.0), -1, 1))
    angle = np.arccos(np.clip(x_units @ center, -1, 1))
    length = lambda v: (v * _units(v)).sum(1)
    bound = length(x) * np.cos(np.maximum(angle - spread, 0))
    order = np.argsort(-bound, kind="stable")
    # what rounding, of the angles above all, may have taken from a bound
    bound = bound[order] + 1e-7 * length(x)[order]
    x_label, x_id = x_label[order], x_id[order]
    scores, norm = Scorer(a, x[order]), length(a)
    who = np.empty(0, np.int64)
    ids, score = who, who
    need = low.copy()
    awake = np.arange(len(a))
    for s in range(0, len(order), STRIDE):
        top = bound[s]
        awake = awake[norm[awake] * top + 1 >= need[awake]]
        if not len(awake):
            break
        cols = np.arange(s, min(s + STRIDE, len(order)))
        got = scores(awake, cols)
        # ties go to smaller ids, so a score equal to the k-th best still counts
        fit = (got >= need[awake][:, None]) & (got <= high[awake][:, None])
        fit &= (label[awake][:, None] == x_label[cols][None, :]) == same
        fit &= own[awake][:, None] != x_id[cols][None, :]
        i, j = np.nonzero(fit)
        who = np.concatenate([who, awake[i]])
        ids = np.concatenate([ids, x_id[cols[j]]])
        score = np.concatenate([score, got[i, j]])
        best = np.lexsort((ids, -score, who))
        who, ids, score = who[best], ids[best], score[best]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < k
        who, ids, score, rank = who[keep], ids[keep], score[keep], rank[keep]
        full = rank == k - 1
        need[who[full]] = score[full]
    return who, ids, score


def _walk_part(same: bool, k: int, centers):
    """For one part and one block of candidates. Each anchor walks once for
    every score in its list ``asked``: positives ask for any score, negatives
    for the window of a positive's."""
    def run(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {n: [] for n in ("anchor_id", "positive_score", "vec_id", "score")}
        x, x_label, x_id = (np.stack(c["vec"].to_numpy()) if len(c) else None), c["label"].to_numpy(), c["vec_id"].to_numpy()
        for cluster, members in q.groupby("cluster") if len(c) else ():
            a, label, own = np.stack(members["vec"].to_numpy()), members["label"].to_numpy(), members["vec_id"].to_numpy()
            found = centers.value.get(key[1])
            # no center: angles of 90 degrees, whose bound is the product of the lengths
            center = np.zeros(a.shape[1]) if found is None else found[cluster]
            asked = members["asked"].to_numpy()
            at = np.repeat(np.arange(len(a)), [len(w) for w in asked])
            scores = np.concatenate(asked).astype(np.int64)
            if same:
                low, high = np.full(len(at), -_LONG), np.full(len(at), _LONG)
            else:
                low = np.array([-(-LOW * int(p) // 100) for p in scores], np.int64)
                high = np.array([HIGH * int(p) // 100 for p in scores], np.int64)
            for s in range(0, len(at), WALKERS):
                w, e = at[s:s + WALKERS], s + WALKERS
                who, ids, score = walk(a[w], low[s:e], high[s:e], label[w], same, own[w], center, x, x_label, x_id, k)
                for name, values in zip(out, (own[w[who]], scores[s:e][who], ids, score), strict=True):
                    out[name].append(values)
        return pd.DataFrame({n: np.concatenate(v) if v else np.empty(0, "i8") for n, v in out.items()})

    return run


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best k of each group of ``found``, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of each component, as doubles without a fraction."""
    clipped = lambda e: F.greatest(F.least(e * SCALE, F.lit(_LARGEST)), F.lit(-_LARGEST))
    return F.transform(vector.cast("array<double>"), lambda e: F.floor(clipped(e)).cast("double"))


def mine(vectors: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id",
         vec_col: str = "embedding") -> DataFrame:
    """Hard negatives for the rows that ``anchors`` (a condition on the id
    column) selects: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score, in all the first ``NEGATIVES`` of each of
    an anchor's ``POSITIVES``."""
    spark = vectors.sparkSession
    v = F.col(vec_col).cast("array<double>")
    sound = (F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull()
             & F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))))
    one = (vectors.where(sound)
           .select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                   whole_numbers(v).alias("vec"), anchors.alias("anchor"))
           .groupBy("vec_id", "anchor").agg(F.min(F.struct("label", "vec")).alias("row"))
           .select("vec_id", "anchor", "row.label", "row.vec", F.size("row.vec").alias("dim")))
    rows, n = materialize_counted(one, "vectors")
    asked = rows.where("anchor")
    sample = asked.orderBy(F.xxhash64("vec_id"), "vec_id").select("dim", "vec").limit(SAMPLE).toPandas()
    centers = spark.sparkContext.broadcast(
        {d: fit_centers(np.stack(g["vec"].to_numpy())) for d, g in sample.groupby("dim")})

    def place(frames):
        for f in frames:
            cluster = np.zeros(len(f), np.int32)
            for d, at in f.groupby("dim").indices.items():
                if d in centers.value:
                    cluster[at] = (_units(np.stack(f["vec"].to_numpy()[at])) @ centers.value[d].T).argmax(1)
            yield f.assign(cluster=cluster)

    fields = "vec_id long, label long, vec array<double>, dim int"
    placed = materialize(asked.select("vec_id", "label", "vec", "dim").mapInPandas(place, fields + ", cluster int"),
                         "anchors")
    before = F.sum("n").over(Window.partitionBy("dim").orderBy("cluster")) - F.col("n")
    sizes = materialize(placed.groupBy("dim", "cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before),
                        "clusters")
    # a cluster takes the parts that its anchors' running count covers
    spot = F.col("before") + F.pmod(F.xxhash64("vec_id"), F.col("n"))
    placed = materialize(placed.join(broadcast_if_small(sizes), ["dim", "cluster"])
                         .withColumn("part", (spot / ANCHORS).cast("int")).drop("n", "before"), "anchor-parts")
    cells = materialize(placed.select("dim", "part").distinct(), "cells")
    blocks = max(1, math.ceil(n / CANDIDATES))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    candidates = (rows.select("vec_id", "label", "vec", "dim", block.alias("block"))
                  .join(broadcast_if_small(cells), "dim"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def met(walkers: DataFrame, same: bool, k: int) -> DataFrame:
        keys = ["block", "dim", "part"]
        return (walkers.select("*", every).groupBy(*keys).cogroup(candidates.groupBy(*keys))
                .applyInPandas(_walk_part(same, k, centers), "anchor_id long, positive_score long, vec_id long, score long"))

    found = met(placed.withColumn("asked", F.array(F.lit(0).cast("long"))), True, POSITIVES)
    positives = materialize(_ranked(found, ["anchor_id"], POSITIVES).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # a negative score has an empty window
    windows = positives.where("positive_score >= 0").groupBy("anchor_id").agg(
        F.collect_set("positive_score").alias("asked"))
    walkers = placed.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    negatives = _ranked(met(walkers, False, NEGATIVES), ["anchor_id", "positive_score"], NEGATIVES)
    return (positives.join(negatives, ["anchor_id", "positive_score"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                    F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
