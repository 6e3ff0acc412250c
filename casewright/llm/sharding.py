"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has CELLS cells; a document's cell is three hexadecimal digits of the md5 of its id, and every shard stands at
`nodes` cells. A document belongs to the first shard clockwise. A shard takes a bounded number of rows: the law `rows`
gives each shard its exact share, so counts are at most one apart. Keys that overflow a full shard continue clockwise to
the next one with room, so only they move.

Rows of one cell share all preferences, so the walk is decided on the counts of the cells (4096 numbers, whatever the
table's size) and each row finds its shard by its rank within its cell. Ranks are counted by parts of the written table
and then within a part, so neither a cell nor an id that many rows repeat is one group.

Defined cases: null texts have no bytes; a null id has the cell of the empty string; rows that repeat an id, or are equal
in all columns, are placed each; an empty table gives no rows; `assign_shards` reads no other columns, `write_shards` keeps
all of them, a column named `shard` as `_shard`.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.work import Work, fresh, read

CELLS = 4096
SHARDS, NODES = 16, 64


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise."""
    spots = []
    for s in range(shards):
        for v in range(nodes):
            digest = hashlib.md5(f"shard {s} node {v}".encode()).digest()
            spots.append((int.from_bytes(digest[:4], "big") % CELLS, digest, s))
    return [(cell, s) for cell, _, s in sorted(spots)]


def ring_plan(counts: dict[int, int], shards: int, nodes: int = NODES) -> list[tuple[int, int, int, int, int]]:
    """Rows (cell, first rank, rows, shard, first slot). Home keys come first; what overflows walks on clockwise."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    spots = ring(shards, nodes)
    plan, over, k = [], [], 0
    for cell in range(CELLS):
        while k < len(spots) and spots[k][0] < cell:
            k += 1
        n = counts.get(cell, 0)
        home = k % len(spots)
        s = spots[home][1]
        take = min(n, room[s] - used[s])
        if take:
            plan.append((cell, 0, take, s, used[s]))
            used[s] += take
        if n > take:
            over.append((cell, take, n - take, home))
    for cell, first, n, at in over:
        while n:
            s = spots[at % len(spots)][1]
            take = min(n, room[s] - used[s])
            if take:
                plan.append((cell, first, take, s, used[s]))
                used[s], first, n = used[s] + take, first + take, n - take
            at += 1
    return plan


def cell_of(key):
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 3), 16, 10).cast("int")


def _place(rows: DataFrame, shards: int, nodes: int) -> DataFrame:
    """rows (doc_id and further columns) with shard and slot."""
    spark = rows.sparkSession
    work = Work(spark, "sharding")
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    rows = work.table(rows.select("*", cell_of(F.col("doc_id")).alias("cell"), part.alias("part")), "rows")
    counts = rows.groupBy("cell", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ahead = work.table(counts.select("cell", "part", "n", (F.sum("n").over(earlier) - F.col("n")).alias("ahead")), "ahead")
    totals = {r.cell: r.n for r in ahead.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # CELLS rows at most
    names = ("cell", "first", "n", "shard", "base")
    values = F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in ring_plan(totals, shards, nodes)]))
    plan = spark.range(1).select(F.explode(F.from_json(values, "array<struct<cell:int,first:bigint,n:bigint,shard:int,base:bigint>>")).alias("p")).select("p.*")
    local = F.row_number().over(Window.partitionBy("cell", "part").orderBy("doc_id")) - 1
    ranked = rows.withColumn("local", local).join(ahead.drop("n").hint("merge"), ["cell", "part"]).withColumn("rank", F.col("ahead") + F.col("local"))
    # the plan has a row for each cell and one more for each shard that fills up
    placed = ranked.join(F.broadcast(plan), "cell").where("rank >= first and rank < first + n")
    return placed.withColumn("slot", F.col("base") + F.col("rank") - F.col("first"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """docs (doc_id, text) with doc_id, size, text_crc32, shard, slot."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return _place(rows, shards, nodes).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, nodes: int = NODES) -> None:
    """Writes docs, all columns, in folders shard=0 ... of Parquet files."""
    names = [fresh(docs, "_shard") if c.lower() == "shard" else c for c in docs.columns]
    rows = docs.select("doc_id", F.struct(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("row"))
    _place(rows, shards, nodes).select("row.*", "shard").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
