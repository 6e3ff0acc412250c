"""Exact top-k by exhaustive term-at-a-time accumulation.

A term is a dimension. Candidates are packed in blocks whose postings of a term are one dense column of weights; a block
of queries keeps, for each term, the queries with a weight there, and scatters weight times postings into a dense array
of scores. Each pair of blocks is cut to its k best by partition selection; Spark merges the cuts of a query.

Vectors become integers floor(scale * x) first, so scores are exact. Vectors with a component beyond 31 bits have blocks of
their own and are scored with integers of any length, so that every finite component counts as it is.

Defined cases: vectors that are null, or hold null or non-finite components, or have a null id take no part; vectors of
different lengths meet in their common dimensions; an empty vector scores 0; rows that repeat a query's id are its own and
never its candidates; repeated query rows are answered each; a score that is no 64-bit integer has its right rank and is
null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.work import Work, read

SCALE, NARROW = 256, 1 << 31
CANDIDATES, QUERIES = 2048, 512
BLOCKS = "block long, first long, dims int, ids binary, weights binary, wide boolean"
_SCHEMA = pa.schema([("block", pa.int64()), ("first", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary()), ("wide", pa.bool_())])
_WIDE = 1 << 2199  # more than any product of finite doubles


def _exact(x: float) -> int:
    return math.floor(x * SCALE) if abs(x) < 1 << 53 else int(x) * SCALE


def _vectors(batch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and whole vectors: 32-bit integers, or Python's where a component needs more."""
    column = batch.column(1)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(flat * SCALE)
        far = np.concatenate([[0], np.cumsum(~((whole >= -NARROW) & (whole < NARROW)))])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    good = np.flatnonzero((bad[offsets[1:]] == bad[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False))
    vectors = []
    for k in good:
        low, high = offsets[k], offsets[k + 1]
        vectors.append(whole[low:high].astype(np.int32) if far[low] == far[high] else np.array([_exact(x) for x in flat[low:high].tolist()], object))
    return ids[good].astype(np.int64), vectors


def _pack(size: int):
    """Blocks of up to `size` vectors, terms by rows: dims x vectors, in order of the ids."""

    def row(block: int, first: int, held):
        ids, wide = np.array([i for i, _ in held], np.int64), held[0][1].dtype == object
        order = np.argsort(ids, kind="stable")
        dims = max(len(v) for _, v in held)
        weights = np.zeros((dims, len(ids)), object if wide else np.int32)
        for k, at in enumerate(order):
            weights[: len(held[at][1]), k] = held[at][1]
        raw = b" ".join(b"%d" % x for x in weights.ravel()) if wide else weights.tobytes()
        values = dict(block=[block], first=[first], dims=[dims], ids=[ids[order].astype("<i8").tobytes()], weights=[raw], wide=[wide])
        return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)

    def run(batches):
        from pyspark import TaskContext

        part, n, first = TaskContext.get().partitionId(), 0, 0
        waiting: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            for i, v in zip(*_vectors(batch), strict=True):
                held = waiting[v.dtype == object]
                held.append((i, v))
                if len(held) == size:
                    yield row((part << 32) + n, (part << 40) + first, held)
                    n, first = n + 1, first + size
                    held.clear()
        for held in waiting.values():
            if held:
                yield row((part << 32) + n, (part << 40) + first, held)
                n, first = n + 1, first + len(held)

    return run


def _weights(raw: bytes, wide: bool, dims: int, n: int) -> np.ndarray:
    return (np.array([int(x) for x in raw.split()], object) if wide else np.frombuffer(raw, np.int32)).reshape(dims, n)


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of (dims x queries) against (dims x candidates), one term after the other."""
    dims = min(len(queries), len(candidates))
    most = max(dims, 1)
    for side in (queries, candidates):
        most *= max(abs(int(side.max())), abs(int(side.min()))) if side.size else 0
    wide = object in (queries.dtype, candidates.dtype)
    kind = object if wide or most >= 1 << 63 else np.int64 if most >= 1 << 31 else np.int32
    scores = np.zeros((queries.shape[1], candidates.shape[1]), kind)
    for t in range(dims):
        weight, postings = queries[t].astype(kind), candidates[t].astype(kind)
        live = np.flatnonzero(weight)
        if len(live) == len(weight):
            scores += np.multiply.outer(weight, postings)
        else:
            scores[live] += np.multiply.outer(weight[live], postings)
    return scores


def select(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) of the k best of each row, ties to the earlier column; own marks what is no candidate."""
    n = scores.shape[1]
    k = min(k, n)
    if scores.dtype == object:
        best = [heapq.nsmallest(k, np.flatnonzero(~own[r]).tolist(), key=lambda c, r=r: (-scores[r, c], c)) for r in range(len(scores))]
        return np.repeat(np.arange(len(scores)), [len(b) for b in best]), np.array([c for b in best for c in b], np.int64)
    scores = scores.astype(np.int64)
    if int(np.abs(scores).max(initial=0)) < (1 << 61) // max(n, 1):
        rank = scores * n + np.arange(n - 1, -1, -1)
        rank[own] = np.iinfo(np.int64).min
        best = np.argpartition(rank, n - k, axis=1)[:, n - k :]
    else:
        best = np.stack([np.lexsort((np.arange(n), -scores[r], own[r]))[:k] for r in range(len(scores))])
    q = np.repeat(np.arange(len(scores)), k)
    c = best.ravel()
    keep = ~own[q, c]
    return q[keep], c[keep]


SCORES = "row long, query_id long, vec_id long, beyond int, wide binary, score long"


def _score(k: int):
    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                first, q_dims, q_ids, q_weights, q_wide, c_dims, c_ids, c_weights, c_wide = (batch.column(i)[r].as_py() for i in range(9))
                q, c = np.frombuffer(q_ids, "<i8"), np.frombuffer(c_ids, "<i8")
                scores = accumulate(_weights(q_weights, q_wide, q_dims, len(q)), _weights(c_weights, c_wide, c_dims, len(c)))
                at, of = select(scores, q[:, None] == c[None, :], k)
                got = scores[at, of]
                # beyond: on which side of the 64-bit integers a score lies; wide orders those that lie outside
                beyond = [(x >= 1 << 63) - (x < -(1 << 63)) for x in got.tolist()] if scores.dtype == object else [0] * len(got)
                wide = [(int(x) + _WIDE).to_bytes(276, "big") if b else None for x, b in zip(got, beyond, strict=True)]
                score = [None if b else int(x) for x, b in zip(got, beyond, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(first + at), pa.array(q[at]), pa.array(c[of]), pa.array(beyond, pa.int32()), pa.array(wide, pa.binary()), pa.array(score, pa.int64())], names=["row", "query_id", "vec_id", "beyond", "wide", "score"])

    return run


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, groups: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of vectors (vec_id, embedding) for every query."""
    spark = queries.sparkSession
    work = Work(spark, "topk")
    groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda df, size, name: work.table(df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null and embedding is not null").mapInArrow(_pack(size), BLOCKS), name)
    q = blocks(queries, QUERIES, "queries").select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.col("first"), F.col("dims").alias("qd"), F.col("ids").alias("qi"), F.col("weights").alias("qw"), F.col("wide").alias("ql"))
    # the stated query set meets every block of vectors: query blocks are copied to each group of candidate blocks
    c = blocks(vectors, CANDIDATES, "vectors").select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g"), F.col("dims").alias("cd"), F.col("ids").alias("ci"), F.col("weights").alias("cw"), F.col("wide").alias("cl"))
    pairs = q.join(c.hint("merge"), "g").select("first", "qd", "qi", "qw", "ql", "cd", "ci", "cw", "cl")
    cut = pairs.mapInArrow(_score(k), SCORES)
    order = Window.partitionBy("row").orderBy(F.desc("beyond"), F.desc("wide"), F.desc("score"), "vec_id")
    return cut.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors.where("vec_id % 50 = 0"), vectors)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
