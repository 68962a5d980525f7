"""Largest inner products by randomly rotated one-bit codes.

A vector less the centre is scaled to length one, rotated, and kept as the signs of its coordinates,
with two scalars: its length and the inner product of the code with what it stands for. From these
the inner product with a query is estimated, with an error bound of EPSILON standard deviations. Of
each block of vectors the few with the highest upper bounds are scored with the original vectors in
double precision; all whose upper bound reaches the k-th best of these scores are reranked so.

The centre comes from a bounded sample; every vector is coded. Vectors and queries are laid into
blocks of at most about PART rows by a hash of their ids, so that equal vectors spread out, and each
pair of a vector block and a query block is one group. Blocks give their k best for each query.

Bounds are kept in units of the query's length times the block's longest rest, so components of any
finite size do; a bound that is no number counts as reached.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows without an id; rows with the query's own id are
never its candidates; rows that repeat an id each count; equal scores go by the smaller id, and of
rows equal in both any comes first. An empty table gives no rows; columns other than vec_id and
embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

PART, CENTRE_SAMPLE, EPSILON, SEED, K = 3072, 20_000, 3.5, 11, 20
#: How many times k vectors are scored first.
FIRST = 2
#: Bits for each component: vectors are padded with zeros before the rotation, which halves the error for four.
SPREAD = 4


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles, of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (lengths[0]["d"] if lengths else 0))


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """SPREAD * d orthonormal columns of length d: a rotation of vectors padded with zeros."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((SPREAD * d, SPREAD * d)))
    return (q * np.sign(np.diag(r)))[:, :d]


def lengths_of(x: np.ndarray) -> np.ndarray:
    """The lengths of rows; no square of a large component overflows."""
    most = np.abs(x).max(axis=1, initial=0)
    return np.linalg.norm(x / np.where(most > 0, most, 1)[:, None], axis=1) * most


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, lengths, and inner products of the codes with the unit vectors they stand for."""
    rest = x - centre
    length = lengths_of(rest)
    unit = (rest / np.where(length > 0, length, 1)[:, None]) @ turn.T
    return np.packbits(unit > 0, axis=1), length, np.abs(unit).sum(axis=1) / np.sqrt(len(turn))


def upper_bounds(bits: np.ndarray, length: np.ndarray, fit: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of the inner products, queries by vectors, and for each query the unit that they are in."""
    d = len(turn)
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    fit = np.maximum(fit, 1e-9)
    size = lengths_of(queries)
    unit = max(float(length.max(initial=0)), float(lengths_of(centre[None, :])[0]))
    unit = unit if 0 < unit < np.inf else 1.0
    queries, length, centre = queries / size[:, None], length / unit, centre / unit
    out = (queries @ turn.T).astype(np.float32) @ signs.T
    out *= (length / fit / np.sqrt(d)).astype(np.float32)
    out += (queries @ centre)[:, None].astype(np.float32)
    spread = length * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(d - 1, 1)) * EPSILON + 1e-5 * (length + np.linalg.norm(centre))
    out += spread.astype(np.float32)
    return out, size * unit


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, added in order of the components."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(a.shape[1]):
            total += a[:, k] * b[:, k]
    return total


def best_of_block(ids: np.ndarray, x: np.ndarray, code, query_ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int):
    """query_id, vec_id, score: each query's k best of the block."""
    out = []
    for at in range(0, len(queries), 256):
        q, qi = queries[at : at + 256], query_ids[at : at + 256]
        bound, unit = upper_bounds(*code, q, centre, turn)
        own = qi[:, None] == ids[None, :]
        bound[np.isnan(bound)] = np.inf
        bound[own] = -np.inf
        bar = np.full(len(q), -np.inf)
        if len(ids) > FIRST * k:
            top = np.argpartition(bound, -FIRST * k, axis=1)[:, -FIRST * k :]
            known = products(x[top.ravel()], np.repeat(q, FIRST * k, axis=0)).reshape(top.shape)
            known[np.take_along_axis(own, top, axis=1)] = -np.inf
            bar = np.partition(known, -k, axis=1)[:, -k] / unit
            bar = np.where(np.isfinite(bar), bar - 1e-6 * np.abs(bar), -np.inf)
        row, col = np.nonzero((bound >= bar[:, None].astype(np.float32)) & ~own)
        score = np.concatenate([products(x[col[a : a + 100_000]], q[row[a : a + 100_000]]) for a in range(0, len(row), 100_000)] or [np.zeros(0)])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        keep = place < k
        out.append((qi[row[keep]], ids[col[keep]], score[keep]))
    return [np.concatenate(p) for p in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def search(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: which rows of vectors are queries as well."""
    rows = stored(usable(vectors), "vectors")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    sample = np.array([r["embedding"] for r in rows.select("embedding").limit(CENTRE_SAMPLE).collect()])
    d = sample.shape[1] if len(sample) else 0
    most = np.abs(sample).max() if len(sample) else 1.0
    centre, turn = (sample / most).mean(axis=0) * most if len(sample) else np.zeros(0), rotation(d)
    parts, blocks = max(1, -(-counts["n"] // PART)), max(1, -(-counts["q"] // PART))

    def coded(batches):
        for pdf in batches:
            x = np.stack(pdf["embedding"].to_numpy()) if len(pdf) else np.zeros((0, d))
            bits, length, fit = encode(x, centre, turn)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "code": [b.tobytes() for b in bits], "length": length, "fit": fit, "embedding": pdf["embedding"]})

    index = stored(rows.mapInPandas(coded, "vec_id long, code binary, length double, fit double, embedding array<double>"), "vector-index")
    block_of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("part", block_of(parts)).withColumn("block", every(blocks))
    right = rows.where(is_query).withColumn("block", block_of(blocks)).withColumn("part", every(parts))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        code = (np.frombuffer(b"".join(a["code"]), np.uint8).reshape(len(a), -1), a["length"].to_numpy(), a["fit"].to_numpy())
        found = best_of_block(a["vec_id"].to_numpy(), np.stack(a["embedding"].to_numpy()), code, b["vec_id"].to_numpy(), np.stack(b["embedding"].to_numpy()), centre, turn, k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    near = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
