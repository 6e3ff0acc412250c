"""Nearest vectors by random projections: a bucketed index over all rows, an equi-join on buckets, exact re-ranking.

Each vector is projected on random directions, one for each cell. A row is kept in the `copies` cells it
reaches furthest into, a query probes the `probes` cells it reaches furthest into, so the two meet if their ranks of
directions agree somewhere. Cells are written as blocks of about BLOCK rows: a crowded cell has more blocks, never a larger
one. The join meets query blocks with the blocks of their cells, and cosines there are exact.

The share of rows that a query reads depends on the vectors: where neighbours are near, few probes reach them; where all
directions are alike (vectors without structure) a recall of nine tenths reads a large part of the rows. So the number of
probes is found by measuring: the hits of the exhaustive search for a bounded sample of queries tell how deep a query has
to probe. `read_share` states the rows read, `recall` measures hits against the exhaustive search.

Defined cases: rows and queries whose vector is null, of another length than `dims`, zero, or not finite are not found and
find nothing; repeated ids are rows each, and hits of one id count once, by its best row; an empty index or query set gives
no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators.retrieval import cosine_topk, nearest_in_blocks, top
from casewright.sources.scratch import scratch

CELLS, COPIES, TARGET = 256, 4, 0.92
BLOCK, QUERIES, SAMPLE = 2048, 512, 200


@dataclass
class ProjectionIndex:
    """blocks (cell, part, ci, ce: ids and vectors), homes (cell, chunk_id), cells (cell, n, parts), and what placed them."""

    blocks: DataFrame
    homes: DataFrame
    cells: DataFrame
    rows: int
    dims: int
    n_cells: int
    copies: int
    seed: int
    id_type: str


def _placing(dims: int, cells: int, copies: int, seed: int):
    """(id, embedding) to the same with the `copies` cells the vector reaches furthest into, best first."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        directions = np.random.default_rng(seed).normal(size=(dims, cells))
        directions /= np.linalg.norm(directions, axis=0)
        for batch in batches:
            column = batch.column(1)
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            some = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == dims))
            x = flat[offsets[some][:, None] + np.arange(dims)].astype(float).reshape(len(some), dims)
            with np.errstate(invalid="ignore", over="ignore"):
                size = np.sqrt((x * x).sum(axis=1))
            good = np.isfinite(size) & (size > 0)
            some, reach = some[good], x[good] @ directions
            home = np.argpartition(-reach, copies - 1, axis=1)[:, :copies] if len(some) else np.zeros((0, copies), int)
            home = np.take_along_axis(home, np.argsort(-np.take_along_axis(reach, home, 1), axis=1), 1)
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * copies), pa.array(home.ravel().astype(np.int32)))
            rows = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*rows.columns, held], names=[*batch.schema.names, "cells"])

    return run


def _placed(df: DataFrame, key: str, index_or: dict) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    vector = df.schema["embedding"].dataType.simpleString()
    return df.select(key, "embedding").mapInArrow(_placing(**index_or), f"{key} {kind}, embedding {vector}, cells array<int>")


def build_index(vectors: DataFrame, cells: int = CELLS, copies: int = COPIES, dims: int | None = None, block: int = BLOCK, seed: int = 7) -> ProjectionIndex:
    """vectors (chunk_id, embedding) as a written index. dims: the length of all vectors; found in the data if not given."""
    spark = vectors.sparkSession
    dims = dims or vectors.select(F.max(F.size("embedding"))).first()[0] or 1
    copies = min(copies, cells)
    placed = _placed(vectors, "chunk_id", dict(dims=dims, cells=cells, copies=copies, seed=seed))
    path = scratch(spark, "projections")
    placed = placed.select(F.explode("cells").alias("cell"), "chunk_id", "embedding")
    placed.write.parquet(f"{path}/rows")
    rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    # one row a cell at most, so it is small whatever the data
    counted = rows.groupBy("cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    counted.write.parquet(f"{path}/cells")
    sizes = spark.read.schema(counted.schema).parquet(f"{path}/cells")
    dealt = rows.join(F.broadcast(sizes.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("chunk_id"), "parts").cast("int"))
    held = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("chunk_id", "embedding")).alias("x")).select("cell", "part", F.col("x.chunk_id").alias("ci"), F.col("x.embedding").alias("ce"))
    held.write.parquet(f"{path}/blocks")
    return ProjectionIndex(spark.read.schema(held.schema).parquet(f"{path}/blocks"), rows.select("cell", "chunk_id"), sizes, rows.count() // copies, dims, cells, copies, seed, vectors.schema["chunk_id"].dataType.simpleString())


def _probing(queries: DataFrame, index: ProjectionIndex, probes: int) -> DataFrame:
    return _placed(queries, "query_id", dict(dims=index.dims, cells=index.n_cells, copies=min(probes, index.n_cells), seed=index.seed))


def probes_for(queries: DataFrame, vectors: DataFrame, index: ProjectionIndex, k: int = 10, target: float = TARGET, sample: int = SAMPLE) -> int:
    """How many cells a query has to probe to reach the share `target` of its k nearest, measured on about `sample` queries."""
    share = min(1.0, sample / max(queries.count(), 1))
    some = queries.where(F.pmod(F.xxhash64("query_id", F.lit(index.seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    ranked = _probing(some, index, index.n_cells).select("query_id", F.posexplode("cells").alias("at", "cell"))
    hits = cosine_topk(some, vectors, k).select("query_id", "chunk_id")
    met = hits.join(index.homes, "chunk_id").join(ranked, ["query_id", "cell"]).groupBy("query_id", "chunk_id").agg(F.min("at").alias("at"))
    deep = met.agg(F.expr(f"percentile(at, {target})")).first()[0]
    return index.n_cells if deep is None else min(index.n_cells, int(deep) + 1)


def projection_topk(queries: DataFrame, index: ProjectionIndex, probes: int, k: int = 10, least: float = 0.0) -> DataFrame:
    """queries (query_id, embedding) as query_id, chunk_id, vector_score, rank: the k nearest by cosine among the rows of the probed cells."""
    groups = max(1, -(-queries.count() // QUERIES))
    asked = _probing(queries, index, probes).select(F.explode("cells").alias("cell"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("g"), F.struct("query_id", "embedding").alias("q"))
    asked = asked.groupBy("cell", "g").agg(F.collect_list("q").alias("q")).join(F.broadcast(index.cells), "cell")
    asked = asked.select("cell", F.col("q.query_id").alias("qi"), F.col("q.embedding").alias("qe"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    kind = queries.schema["query_id"].dataType.simpleString()
    cut = asked.join(index.blocks, ["cell", "part"]).select("qi", "qe", "ci", "ce").mapInArrow(nearest_in_blocks(k, least), f"query_id {kind}, chunk_id {index.id_type}, vector_score double")
    return top(cut.groupBy("query_id", "chunk_id").agg(F.max("vector_score").alias("vector_score")), "vector_score", k)


def read_share(queries: DataFrame, index: ProjectionIndex, probes: int) -> DataFrame:
    """(query_id, rows_read, rows): rows of the probed cells, copies counted each, and rows of the index."""
    asked = _probing(queries, index, probes).select("query_id", F.explode("cells").alias("cell"))
    return asked.join(F.broadcast(index.cells), "cell", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_read"), F.lit(index.rows).cast("long").alias("rows"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, wanted, hit): hits of the exhaustive search, and how many of them were found."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("hit"))
