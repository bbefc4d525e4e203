"""Approximate nearest neighbours with randomly rotated one-bit codes.

Method: unit vectors are rotated by one fixed random orthogonal matrix; the
signs of the rotated coordinates are the code (packed bits), and one scalar,
the inner product of the vector with its own code, corrects the estimate
``<q, x> ~ norm * <q', code> / scalar``. The estimate's error has standard
deviation ``sqrt((1 - scalar^2) / (dim - 1)) / scalar`` per unit of query; with
``BOUND`` times that as error bound, only vectors whose upper bound reaches
the k-th best lower bound are reranked by the exact inner product, in double
precision on the original vectors.

Vectors are encoded once and written. Candidates are dealt by hash into blocks
of about ``CANDIDATES`` rows, queries into blocks of about ``QUERIES``; a task
meets one block of each and returns each query's best k of its block, and the
blocks' results are merged by query. Block counts follow the table's counts,
so a task's memory stays the same at any size.

Edge cases: null and zero vectors and those holding null or non-finite
components take no part, as query or candidate. Only vectors of one dimension
meet. Rows with a null id take no part. Of rows that share an id, one stays
(the smallest vector). Ties go to the smaller id; fewer candidates than k give
all of them. An empty table gives an empty result; extra columns are ignored.
Any magnitude is searched alike: a vector is scaled by the power of two that
brings its largest component below one, which changes no digit, estimates and
bounds are relative to the longest vector of the block, and a product beyond the
range of doubles is infinite, one below it 0 (their ties go to the smaller id).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.scratch import materialize

NEAREST = 20
BOUND = 3.0
CANDIDATES, QUERIES = 16_384, 16_384
SEED = 5


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of ``x`` divided by a power of two, so that its largest
    component is at least a half and below one, and the exponents."""
    exponent = np.frexp(np.abs(x).max(axis=1, initial=0.0))[1]
    return np.ldexp(x, -exponent[:, None]), exponent


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, norm, correction scalar) of each row of ``x``, whose rows
    are scaled."""
    norm = np.linalg.norm(x, axis=1)
    turned = (x / norm[:, None]) @ rotation(x.shape[1])
    bits = turned > 0
    scalar = np.abs(turned).sum(1) / np.sqrt(x.shape[1])
    return np.packbits(bits, axis=1), norm, scalar


def _encode(batches):
    for batch in batches:
        vectors = batch.column(1)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = np.diff(vectors.offsets.to_numpy())
        at = np.concatenate([[0], np.cumsum(sizes)])
        n = len(sizes)
        code, norm, scalar = [b""] * n, np.zeros(n), np.zeros(n)
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            bits, norm[own], scalar[own] = encode(scaled(flat[at[own][:, None] + np.arange(d)])[0])
            for i, row in zip(own, bits, strict=True):
                code[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), vectors, pa.array(sizes.astype(np.int32)), pa.array(code, pa.binary()),
             pa.array(norm), pa.array(scalar)], names=["vec_id", "vec", "dim", "code", "norm", "scalar"])


def nearest_in_block(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray,
                     code: np.ndarray, norm: np.ndarray, scalar: np.ndarray, k: int):
    """The best k of one block for each query: lists of (query, ids, scores).
    ``norm`` is that of the scaled rows of ``x``."""
    dim = x.shape[1]
    x, exponent = scaled(x)
    queries, query_exponent = scaled(queries)
    # lengths relative to the block's longest vector; queries count as unit vectors
    norm = np.ldexp(norm, exponent - exponent.max(initial=0))
    signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    units = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    turned = (units @ rotation(dim)).astype(np.float32)
    factor = norm / (scalar * np.sqrt(dim))
    spread = BOUND * norm * np.sqrt(np.maximum(1 - scalar**2, 0) / max(dim - 1, 1)) / scalar + 1e-6 * norm
    for a in range(0, len(queries), 256):
        estimate = (turned[a:a + 256] @ signs.T) * factor
        for i, est in enumerate(estimate, a):
            low = est - spread
            own = ids == query_ids[i]
            low[own] = -np.inf
            # products near the ends of the range may be equal (infinite, or 0) where estimates differ: all are scored
            if len(ids) > k and -900 < query_exponent[i] + exponent.min() and query_exponent[i] + exponent.max() < 1000:
                floor = np.partition(low, len(ids) - k)[len(ids) - k]
                pick = np.flatnonzero((est + spread >= floor) & ~own)
            else:
                pick = np.flatnonzero(~own)
            with np.errstate(over="ignore"):  # beyond the range of doubles: infinite
                score = np.ldexp(x[pick] @ queries[i], exponent[pick] + query_exponent[i]) + 0.0
            best = np.lexsort((ids[pick], -score))[:k]
            yield query_ids[i], ids[pick][best], score[best]


def _search(k: int):
    def run(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(q) and len(c):
            x = np.stack(c["vec"].to_numpy()).astype(np.float64)
            code = np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), -1)
            found = nearest_in_block(
                np.stack(q["vec"].to_numpy()).astype(np.float64), q["vec_id"].to_numpy(), x, c["vec_id"].to_numpy(),
                code, c["norm"].to_numpy(), c["scalar"].to_numpy(), k)
            for query, ids, score in found:
                out["query_id"].append(np.full(len(ids), query))
                out["vec_id"].append(ids)
                out["score"].append(score)
        return pd.DataFrame({n: np.concatenate(v) if v else np.empty(0, "f8" if n == "score" else "i8")
                             for n, v in out.items()})

    return run


def search(vectors: DataFrame, queries: Column, k: int = NEAREST, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """The k largest inner products of each query row (``queries``: a
    condition on the id column) with all other rows: query_id, rank, vec_id,
    score."""
    v = F.col(vec_col).cast("array<double>")
    sound = (F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()
             & F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
             & F.exists(v, lambda e: e != 0))
    one = (vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"),
                                       queries.alias("is_query"))
           .groupBy("vec_id", "is_query").agg(F.min("vec").alias("vec")))
    table = materialize(one.select("vec_id", "vec").mapInArrow(
        _encode, "vec_id long, vec array<double>, dim int, code binary, norm double, scalar double"), "codes")
    ask = one.where("is_query").select("vec_id")
    asked = materialize(table.join(ask, "vec_id", "left_semi").select("vec_id", "vec", "dim"), "queries")
    n_c = max(1, -(-table.count() // CANDIDATES))
    n_q = max(1, -(-asked.count() // QUERIES))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    cands = table.select("*", block(n_c).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))
    q = asked.select("*", block(n_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"))
    met = (q.groupBy("dim", "qb", "cb").cogroup(cands.groupBy("dim", "qb", "cb"))
           .applyInPandas(_search(k), "query_id long, vec_id long, score double"))
    # a rank limit: k rows of a query leave a task, and are merged without a list over all blocks
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
