"""Hard-negative mining by exact products in a residue number system.

Components become integers floor(256 * x). A block of anchors meets a block of rows in one matrix product for each of
several primes below 256: both matrices are reduced modulo the prime to residues around zero, multiplied in float32 in
slices of dimensions so short that every sum stays below 2^24 and is exact, and reduced again. Mixed-radix Chinese
remaindering puts the residues together to the signed score; as many primes are taken as the largest possible score of
the two blocks needs, so scores are exact whatever the components are.

1. Each pair of blocks is cut to the best rows of the anchor's own label; Spark merges the cuts to the anchor's positives.
2. The positives travel with their block of anchors, which meets all rows again: a positive's window of scores selects the
   rows of other labels, each pair of blocks is cut to the best of each window, and Spark merges the cuts.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; vectors of
different lengths meet in their common dimensions; an empty vector scores 0; rows that repeat an anchor's id are the anchor
itself, neither positives nor negatives; repeated anchor rows are mined each; repeated rows of another id are ranked each;
a positive with a negative score has an empty window, as has one that no row reaches; a score that is no 64-bit integer
has its right rank and is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.topk import _vectors, _weights, select
from casewright.llm.work import Work, read

ANCHORS, ROWS = 256, 2048
SLICE = 1024  # dimensions of one float32 product: 1024 * 125^2 < 2^24
PRIMES = [p for p in range(255, 1, -1) if all(p % q for q in range(2, 16))]
BLOCKS = "block long, dims int, ids binary, labels binary, weights binary, wide boolean"
_SCHEMA = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("weights", pa.binary()), ("wide", pa.bool_())])
_WIDE = 1 << 2199  # more than any product of finite doubles


def _pack(size: int):
    """Blocks of up to `size` rows (vec_id, embedding, label): weights are dims x rows, in order of the ids."""

    def row(block: int, held):
        ids, wide = np.array([i for i, *_ in held], np.int64), held[0][1].dtype == object
        order = np.argsort(ids, kind="stable")
        dims = max(len(v) for _, v, _ in held)
        weights = np.zeros((dims, len(ids)), object if wide else np.int32)
        for k, at in enumerate(order):
            weights[: len(held[at][1]), k] = held[at][1]
        raw = b" ".join(b"%d" % x for x in weights.ravel()) if wide else weights.tobytes()
        labels = np.array([held[at][2] for at in order], "<i8").tobytes()
        values = dict(block=[block], dims=[dims], ids=[ids[order].astype("<i8").tobytes()], labels=[labels], weights=[raw], wide=[wide])
        return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        waiting: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.column(1)], names=["i", "v"])
            ids, labels = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for i, v in zip(*_vectors(numbered), strict=True):
                held = waiting[v.dtype == object]
                held.append((ids[i], v, labels[i]))
                if len(held) == size:
                    yield row(block, held)
                    block += 1
                    held.clear()
        for held in waiting.values():
            if held:
                yield row(block, held)
                block += 1

    return run


def _residues(weights: np.ndarray, p: int) -> np.ndarray:
    """Residues from -p/2 to p/2 as float32."""
    r = (weights % p).astype(np.float32)
    return np.where(r > p // 2, r - np.float32(p), r)


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of (dims x n) and (dims x m) integers: n x m, of 64 bits where the scores fit, else of any length."""
    dims = min(len(left), len(right))
    most = max(dims, 1)
    for side in (left, right):
        most *= max(abs(int(side.max())), abs(int(side.min())), 1) if side.size else 1
    primes, whole = [], 1
    # a bound beyond what all primes below 256 hold is met by larger ones, with shorter slices of dimensions
    candidates = iter(PRIMES)
    larger = 257
    while whole <= 2 * most:
        p = next(candidates, None)
        while p is None:
            p, larger = (larger if all(larger % q for q in range(2, int(larger**0.5) + 1)) else None), larger + 2
        primes.append(p)
        whole *= p
    digits = []
    for p in primes:
        step = min(SLICE, max(1, ((1 << 24) - 1) // (p // 2) ** 2))
        total = np.zeros((left.shape[1], right.shape[1]), np.int32)
        for low in range(0, dims, step):
            a, b = _residues(left[low : min(low + step, dims)], p), _residues(right[low : min(low + step, dims)], p)
            total += np.fmod(a.T @ b, np.float32(p)).astype(np.int32)
            total %= p
        # mixed radix: what is left of the residue after the digits before, over the primes before
        scale, known = 1, np.zeros_like(total)
        for q, d in zip(primes, digits, strict=False):
            known = (known + d * np.int32(scale)) % p
            scale = scale * q % p
        digits.append((total - known) % p * np.int32(pow(scale, -1, p)) % p)
    kind = np.int64 if whole < 1 << 63 else object
    score, scale = np.zeros((left.shape[1], right.shape[1]), kind), 1
    for p, d in zip(primes, digits, strict=True):
        score += d.astype(kind) * scale
        scale *= p
    score -= (score > whole // 2).astype(kind) * whole
    if kind is object and most < 1 << 62:
        score = score.astype(np.int64)
    return score


SCORES = "row long, anchor_id long, place int, vec_id long, beyond int, wide binary, score long"
_NAMES = ["row", "anchor_id", "place", "vec_id", "beyond", "wide", "score"]


def _cut(row, anchor, place, vec_id, scores) -> pa.RecordBatch:
    if scores.dtype == object:
        # beyond: on which side of the 64-bit integers a score lies; wide orders those that lie outside
        exact = scores.tolist()
        beyond = [(x >= 1 << 63) - (x < -(1 << 63)) for x in exact]
        wide = pa.array([(int(x) + _WIDE).to_bytes(276, "big") if b else None for x, b in zip(exact, beyond, strict=True)], pa.binary())
        score = pa.array([None if b else int(x) for x, b in zip(exact, beyond, strict=True)], pa.int64())
    else:
        beyond, wide, score = np.zeros(len(scores), np.int32), pa.nulls(len(scores), pa.binary()), pa.array(scores.astype(np.int64))
    columns = [pa.array(row, pa.int64()), pa.array(anchor, pa.int64()), pa.array(place, pa.int32()), pa.array(vec_id, pa.int64()), pa.array(beyond, pa.int32()), wide, score]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _sides(batch, r):
    """Scores of the r-th pair of blocks, ids and labels of both sides, the number of the block of anchors."""
    block, a_dims, a_ids, a_labels, a_weights, a_wide, dims, ids, labels, weights, wide = (batch.column(i)[r].as_py() for i in range(11))
    a, c = np.frombuffer(a_ids, "<i8"), np.frombuffer(ids, "<i8")
    scores = product(_weights(a_weights, a_wide, a_dims, len(a)), _weights(weights, wide, dims, len(c)))
    return scores, a, c, np.frombuffer(a_labels, "<i8"), np.frombuffer(labels, "<i8"), block


def _positives(k: int):
    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                scores, a, c, a_labels, labels, block = _sides(batch, r)
                at, of = select(scores, (a[:, None] == c[None, :]) | (a_labels[:, None] != labels[None, :]), k)
                yield _cut(block * ANCHORS + at, a[at], np.zeros(len(at), np.int32), c[of], scores[at, of])

    return run


def _windows(k: int, low: int, high: int):
    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                scores, a, c, a_labels, labels, block = _sides(batch, r)
                asked = batch.column(11)[r].as_py()
                for start in range(0, len(asked), ANCHORS):
                    part = asked[start : start + ANCHORS]
                    place = np.array([x["place"] for x in part], np.int32)
                    bound = [x["score"] if x["wide"] is None else int.from_bytes(x["wide"], "big") - _WIDE for x in part]
                    least, most = [-(-low * b // 100) for b in bound], [high * b // 100 for b in bound]
                    fits = scores.dtype != object and all(abs(x) < 1 << 63 for x in (*least, *most))
                    kind = np.int64 if fits else object
                    at = np.array([x["row"] % ANCHORS for x in part], np.int64)
                    own = scores[at]
                    inside = (own >= np.array(least, kind)[:, None]) & (own <= np.array(most, kind)[:, None])
                    inside &= (a_labels[at][:, None] != labels[None, :]) & (a[at][:, None] != c[None, :])
                    i, of = select(own, ~inside.astype(bool), k)
                    yield _cut(block * ANCHORS + at[i], a[at[i]], place[i], c[of], own[i, of])

    return run


def _best(cut: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "place").orderBy(F.desc("beyond"), F.desc("wide"), F.desc("score"), "vec_id")
    return cut.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(anchors: DataFrame, rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, groups: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    anchors and rows: vec_id, label, embedding. An anchor's positives are its best rows of the same label; a positive's
    negatives are the best rows of other labels with low * positive <= 100 * negative <= high * positive.
    """
    spark = rows.sparkSession
    work = Work(spark, "hard-negatives")
    groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = "vec_id is not null and label is not null and embedding is not null"
    blocks = lambda df, size, name: work.table(df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("long")).where(whole).mapInArrow(_pack(size), BLOCKS), name)
    a = blocks(anchors, ANCHORS, "anchors")
    # the stated set of anchors meets every block of rows: its blocks are copied to each group of blocks
    c = blocks(rows, ROWS, "rows").select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g"), *(F.col(x).alias(f"c_{x}") for x in ("dims", "ids", "labels", "weights", "wide")))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    met = lambda side, *more: side.select(everywhere, *a.columns, *more).join(c.hint("merge"), "g").select(*a.columns, *c.columns[1:], *more)
    found = work.table(_best(met(a).mapInArrow(_positives(positives), SCORES), positives), "positives")
    # at most ANCHORS * positives entries a block
    asked = found.groupBy(F.expr(f"row div {ANCHORS}").alias("block")).agg(F.collect_list(F.struct("row", F.col("rank").alias("place"), "score", "wide")).alias("asked"))
    cut = met(a.join(asked, "block"), "asked").mapInArrow(_windows(negatives, low, high), SCORES)
    positive = found.select("row", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = _best(cut, negatives).join(positive, ["row", "place"])
    return best.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine(rows.where("vec_id % 100 = 0"), rows)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score
      FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
w AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 5
"""
