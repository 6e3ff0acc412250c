"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Pieces are no longer than the capacity, so an instance is a histogram with `capacity` cells at most, whatever the number
of documents. The reduction and the best-fit rules work on that histogram with multiplicities: runs of equal bins are one
row of a plan. Documents then find their bin by the rank of their piece among the pieces of its length, which Spark
computes by counts of partitions and a local rank.

Defined cases: null or empty texts have only their end id and make one piece; rows that repeat a doc_id, or have none, are
packed each; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm import textblocks as tb
from casewright.llm.tokenizing import encoder
from casewright.llm.work import Work, read, sparing

CAPACITY = 2048


def dominating_sets(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins that some best packing holds, as (sizes, how many); count keeps what is left.

    For the largest piece w, any bin with it is dominated by {w, v} if v is the largest piece that fits beside it and
    either fills the bin or nothing else could stand beside w but one piece (no two smallest fit), and by {w, v} too if
    v is at least as large as the best pair; a piece beside which nothing fits stays alone.
    """
    sizes = sorted(s for s, n in count.items() if n)
    fixed = []

    def take(parts: tuple[int, ...]) -> None:
        n = min(count[s] // parts.count(s) for s in parts)
        fixed.append((parts, n))
        for s in parts:
            count[s] -= n
        for s in set(parts):
            if not count[s]:
                sizes.pop(bisect_left(sizes, s))

    def others(w: int, room: int) -> list[int]:
        """The sizes up to room that are still free when one w is taken."""
        own = sizes[: bisect_right(sizes, room)]
        return own if w > room or count[w] > 1 else [s for s in own if s != w]

    for w in sorted(sizes, reverse=True):
        while count[w]:
            room = capacity - w
            fits = others(w, room)
            if not fits:
                take((w,))
                continue
            v = fits[-1]
            if v == room:
                take((w, v))
                continue
            free = lambda s, w=w: count[s] - (s == w)
            two = 2 * fits[0] if free(fits[0]) > 1 else fits[0] + fits[1] if len(fits) > 1 else room + 1
            if two > room:  # one piece at most stands beside w
                take((w, v))
                continue
            three = sum(sorted([s for s in fits[:3] for _ in range(min(3, free(s)))])[:3]) if sum(min(3, free(s)) for s in fits[:3]) >= 3 else room + 1
            if three > room:  # two at most: v dominates if no pair that fits is larger
                best, i, j = 0, 0, len(fits) - 1
                while i <= j:
                    total = fits[i] + fits[j]
                    if total > room or (i == j and free(fits[i]) < 2):
                        j -= 1
                    else:
                        best = max(best, total)
                        i += 1
                if v >= best:
                    take((w, v))
                    continue
            break
    return fixed


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing with multiplicities: bins as (((size, times), ...), how many)."""
    rooms: list[int] = []
    open_bins: dict[int, list[tuple[tuple, int]]] = {}

    def put(room: int, parts: tuple, n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((parts, n))

    for s in sorted((s for s, n in count.items() if n), reverse=True):
        left = count[s]
        while left:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                each = min(capacity // s, left)
                bins = left // each
                put(capacity - each * s, ((s, each),), bins)
                left -= bins * each
                continue
            room = rooms[k]
            parts, n = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(k)
            each = min(room // s, left)
            bins = min(n, left // each)
            put(room - each * s, (*parts, (s, each)), bins)
            if n > bins:
                put(room, parts, n - bins)
            left -= bins * each
    return [x for group in open_bins.values() for x in group]


def packing_plan(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, times, offset): ranks of a length go to sequences in turn."""
    count = {int(s): int(n) for s, n in count.items() if n}
    bins = [(tuple((s, parts.count(s)) for s in sorted(set(parts), reverse=True)), n) for parts, n in dominating_sets(count, capacity)]
    bins += best_fit(count, capacity)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for parts, n in bins:
        offset = 0
        for s, times in parts:
            first = used.get(s, 0)
            rows.append((s, first, n * times, sequence, times, offset))
            used[s] = first + n * times
            offset += s * times
        sequence += n
    return rows


def piece_lengths(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of all pieces, pieces of each document); all but the first piece of a document are full."""
    pieces = -(-n // capacity)
    length = np.full(int(pieces.sum()), capacity, np.int64)
    length[np.cumsum(pieces) - pieces] = n - (pieces - 1) * capacity
    return length, pieces


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def _cut(tokenizer: str, end: int, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        coder, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for low, high, ids, bounds in coder.blocks(batch.column(1)):
                n = np.diff(bounds) + 1
                full = np.full(len(ids) + len(n), end, "<u4")
                full[np.arange(len(ids)) + tb.row_of(bounds)] = ids
                length, pieces = piece_lengths(n, capacity)
                ends = np.cumsum(length)
                raw = memoryview(full.tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for k, e in zip(length.tolist(), ends.tolist(), strict=True)]
                first = np.repeat(np.cumsum(pieces) - pieces, pieces)
                order = np.argsort(length, kind="stable")
                sizes = length[order]
                head = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]])
                local = np.empty(len(length), np.int64)
                local[order] = seen[sizes] + np.arange(len(sizes)) - np.repeat(head, np.diff(np.r_[head, len(sizes)]))
                seen += np.bincount(length, minlength=capacity + 1)
                doc = batch.column(0).slice(low, high - low).take(pa.array(np.repeat(np.arange(len(n)), pieces)))
                yield tb.to_batch(schema, doc_id=doc, piece=(np.arange(len(length)) - first).astype(np.int32), start=ends - length - np.repeat(np.cumsum(n) - n, pieces), length=length, ids_crc32=crc, part=np.full(len(length), part, np.int32), local=local)

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of docs (doc_id, text) with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    work = Work(spark, "packing")
    pieces = work.table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sparing(_cut(tokenizer, end, capacity), keep=True), PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ahead = work.table(counts.select("length", "part", (F.sum("n").over(before) - F.col("n")).alias("ahead"), "n"), "ahead")
    histogram = {r.length: r.n for r in ahead.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    rows = packing_plan(histogram, capacity)
    kind = "array<struct<length:bigint,first:bigint,ranks:bigint,sequence:bigint,times:bigint,at:bigint>>"
    names = ("length", "first", "ranks", "sequence", "times", "at")
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), kind)).alias("p")).select("p.*")
    ranked = pieces.join(ahead.select("length", "part", "ahead").hint("merge"), ["length", "part"]).withColumn("rank", F.col("ahead") + F.col("local"))
    # the plan has a few rows for each length, of which there are `capacity` at most
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= first and rank < first + ranks")
    turn = F.col("rank") - F.col("first")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.expr("(rank - first) div times")).alias("sequence_id"), (F.col("at") + F.col("length") * F.pmod(turn, F.col("times"))).alias("offset"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
