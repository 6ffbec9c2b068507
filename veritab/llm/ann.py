"""Approximate nearest neighbours by inner product: multi-index hashing over learned binary codes.

Vectors get binary codes from rotations that are fitted to a bounded sample. A code is cut into bytes, and every byte has
an index of its own: for each of its 256 values the rows that have it. If two codes differ in at most R bits, some byte
differs in at most R / bytes of them, so looking up, per byte, the values within that distance of the query's byte reaches
every code within R. What is reached is held against R on whole codes, and what passes is scored on the original vectors.

Rows and queries are cut into blocks of bounded size by a hash of their id; every block of queries meets every block of
rows in one task, which holds just those two.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .common import materialise

PER_BYTE = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)], np.uint8)


@dataclass(frozen=True)
class Codes:
    """What the sample taught: directions of the bits, the largest norm, and the radius to search."""

    directions: np.ndarray
    norm: float
    radius: int

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Inner product becomes angle: rows are scaled to norm 1 at most and filled up by one more component."""
        x = x / self.norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
        return self._pack(np.column_stack([x, rest]))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        return self._pack(np.column_stack([q, np.zeros(len(q))]))

    def _pack(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.directions > 0, axis=1)


def _rotation(x: np.ndarray, rng, rounds: int = 20) -> np.ndarray:
    """An orthogonal matrix that brings the sample close to the corners of a cube (iterative quantisation)."""
    r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(x.T @ np.sign(x @ r))
        r = u @ v
    return r


def learn(sample: np.ndarray, norm: float, k: int = 20, bits: int = 256, share: float = 0.98, seed: int = 5) -> Codes:
    """Codes from a sample of rows. The radius holds the ``share`` of the sample's own k nearest: with more rows than in
    the sample the k nearest are nearer still, so it errs on the wide side."""
    rng = np.random.default_rng(seed)
    x = sample / norm
    x = np.column_stack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))])
    turns = [_rotation(x, rng) for _ in range(-(-bits // x.shape[1]))]
    codes = Codes(np.column_stack(turns)[:, :bits], norm, bits)
    asked = sample[:: max(1, len(sample) // 400)]
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, : k + 1]
    a, b = codes.of_queries(asked), codes.of_rows(sample)
    apart = np.bitwise_count(a[:, None, :] ^ b[near]).sum(axis=2)
    return Codes(codes.directions, norm, int(np.quantile(apart, share)) + 1)


def usable(vector: Column) -> Column:
    """Not null, not zero, nothing null or non-finite in it."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors by id; of rows with equal ids the first in the order of their vectors."""
    ids = table.column("id").to_numpy()
    flat = table.column("vector").combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, x = ids[order], x[order]
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    return ids[new], x[new]


FOUND = "query_id long, vec_id long, score double"


def _search(queries: pa.Table, rows: pa.Table, codes: Codes, k: int) -> pa.Table:
    out = ([], [], [])
    if queries.num_rows and rows.num_rows:
        qid, q = _matrix(queries)
        rid, x = _matrix(rows)
        qc, rc = codes.of_queries(q), codes.of_rows(x)
        per_byte = codes.radius // rc.shape[1]
        for lo in range(0, len(qid), 64):
            part = qc[lo : lo + 64]
            # which values each byte's index is probed at, and the rows listed there
            reached = np.zeros((len(part), len(rid)), bool)
            for byte in range(rc.shape[1]):
                probed = PER_BYTE[part[:, byte]] <= per_byte
                reached |= probed[:, rc[:, byte]]
            for i in range(len(part)):
                at = np.flatnonzero(reached[i])
                at = at[np.bitwise_count(rc[at] ^ part[i]).sum(axis=1) <= codes.radius]
                at = at[rid[at] != qid[lo + i]]
                if len(at) == 0:
                    continue
                score = x[at] @ q[lo + i]
                best = np.lexsort((rid[at], -score))[:k]
                out[0].append(np.full(len(best), qid[lo + i]))
                out[1].append(rid[at[best]])
                out[2].append(score[best])
    types = (pa.int64(), pa.int64(), pa.float64())
    return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, types)], names=["query_id", "vec_id", "score"])


def search(index: DataFrame, queries: DataFrame, k: int = 20, sample_rows: int = 4096, most_in_block: int = 32_768, **how) -> DataFrame:
    """The ``k`` rows of ``index`` with the largest inner product for each query: query_id, rank, vec_id, score.

    Both have id (long) and vector (array of numbers). A row is no candidate for a query with its own id. Rows that are
    not ``usable``, have a null id, or another length than most take no part; of rows with equal ids one counts. Codes are
    fitted to the ``sample_rows`` rows with the smallest hash of their id; all rows are indexed. Ties go to the smaller id.
    Queries that find fewer than ``k`` within the radius are searched again over all codes, so every query gets ``k`` rows
    if there are as many. An empty index or no query gives an empty result.
    """
    spark = index.sparkSession
    c = F.col
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = index.filter(c("id").isNotNull() & usable(c("vector"))).select(c("id").cast("long"), c("vector").cast("array<double>"))
    squared = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    n, length = index.agg(F.count(F.lit(1)), F.mode(F.size("vector"), True)).first()
    if not n:
        return empty
    same = F.size("vector") == length
    index = index.filter(same)
    norm = index.agg(F.max(F.sqrt(squared))).first()[0]
    queries = queries.filter(c("id").isNotNull() & usable(c("vector"))).select(c("id").cast("long"), c("vector").cast("array<double>")).filter(same)
    asked = queries.count()
    first = index.orderBy(F.xxhash64("id"), "id", "vector").limit(sample_rows)
    codes = learn(np.array([r.vector for r in first.select("vector").collect()]), norm, k, **how)

    block = max(1024, min(most_in_block, n // (2 * spark.sparkContext.defaultParallelism) + 1))
    found = materialise(_blocks(index, queries, n, asked, block, codes, k), "found")
    few = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("m")).filter(c("m") >= k).select("query_id")
    short = queries.join(few, c("id") == c("query_id"), "left_anti")
    lacking = short.count()
    if lacking:
        everything = Codes(codes.directions, norm, 8 * (codes.directions.shape[1] // 8))
        again = _blocks(index, short, n, lacking, block, everything, k)
        found = found.join(short.select(c("id").alias("s")).distinct(), c("query_id") == c("s"), "left_anti").union(again)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(c("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(c("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(index: DataFrame, queries: DataFrame, n: int, asked: int, block: int, codes: Codes, k: int) -> DataFrame:
    many, few = -(-n // block), -(-asked // block)
    at = lambda parts: F.pmod(F.xxhash64("id"), F.lit(max(1, parts)))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(max(1, parts) - 1)).cast("array<long>"))
    q = queries.withColumn("qb", at(few)).withColumn("rb", every(many))
    r = index.withColumn("rb", at(many)).withColumn("qb", every(few))
    pairs = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb"))
    return pairs.applyInArrow(lambda a, b: _search(a, b, codes, k), FOUND)
