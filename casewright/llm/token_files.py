"""Token ids in files: interleaved range-asymmetric-numeral blocks over one shared frequency table.

A table of blocks, in ascending order of (doc_id, text):
    part int, block int   place in the order: ranges of doc_id, then blocks within a range
    doc_ids, n_tokens     the block's documents and their lengths in ids
    payload binary        header | lane states | checkpoints | words, see encode_block
    crc32 long            of the payload
and, beside it, the frequency table (id, freq), which sums to 2**BITS and is counted over all documents.

Every block decodes by itself, so readers work in parallel; inside a block, LANES coders take turns (id i belongs to lane
i mod lanes), and a checkpoint every CHECK rounds lets a reader start there.

Defined cases: null or empty texts have only their end id; rows that repeat a doc_id stay separate rows, ordered by text;
rows without a doc_id come first; a text of any length may fill several blocks' worth of ids and stays in one; an empty
table gives no blocks; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm import textblocks as tb
from casewright.llm.tokenizing import encoder
from casewright.llm.work import Work, read

U = np.uint64
BITS = 20
LOW = U(1 << 31)
LANES = 4096
CHECK = 128
BLOCK_IDS = 1 << 20
MAGIC = b"CWT1"
_WORD = U(0xFFFFFFFF)


class Table:
    """Frequencies that sum to 2**BITS, their starts, and the id of each slot."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        order = np.argsort(ids)
        self.ids, freq = np.asarray(ids, np.int64)[order], np.asarray(freq, np.int64)[order]
        size = int(self.ids[-1]) + 1 if len(ids) else 1
        self.freq, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[self.ids] = freq
        self.start[self.ids] = np.cumsum(freq) - freq
        self.slot = np.repeat(self.ids.astype(np.uint32), freq)


def scale_counts(counts: dict[int, int]) -> dict[int, int]:
    """Counts scaled to a sum of 2**BITS with at least one for each id; the rounding falls on the largest."""
    if not counts:
        return {}
    ids = sorted(counts, key=lambda i: (-counts[i], i))
    total, free = sum(counts.values()), (1 << BITS) - len(ids)
    out = {i: 1 + counts[i] * free // total for i in ids}
    short = (1 << BITS) - sum(out.values())
    for k in range(short):
        out[ids[k % len(ids)]] += 1
    return out


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """Header (magic, ids, lanes, words, checkpoints), final states, checkpoints (word offset, states), words.

    The last rounds are coded first, so a reader meets states and words in the order of the ids.
    """
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    rounds = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    chunks: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    top = (LOW >> U(BITS)) << U(32)
    for r in range(rounds - 1, -1, -1):
        s = ids[r * lanes : (r + 1) * lanes]
        f, c, own = table.freq[s], table.start[s], x[: len(s)]
        full = own >= f * top
        if full.any():
            words = (own[full] & _WORD).astype(np.uint32)
            chunks.append(words[::-1])
            written += len(words)
            own = np.where(full, own >> U(32), own)
        q = own // f
        x[: len(s)] = (q << U(BITS)) + (own - q * f) + c
        if r and r % CHECK == 0:
            marks.append((written, x.copy()))
    words = np.concatenate(chunks)[::-1] if chunks else np.zeros(0, np.uint32)
    head = MAGIC + struct.pack("<QIQI", n, lanes, len(words), len(marks))
    points = b"".join(struct.pack("<Q", written - w) + states.tobytes() for w, states in reversed(marks))
    return head + x.tobytes() + points + words.tobytes()


HEADER = 4 + struct.calcsize("<QIQI")


def decode_block(payload: bytes, table: Table, checkpoint: int = 0) -> np.ndarray:
    """The ids of a block from its k-th checkpoint on (0: all of them)."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n, lanes, n_words, marks = struct.unpack_from("<QIQI", payload, 4)
    at, step = HEADER, lanes * 8
    words = np.frombuffer(payload, np.uint32, n_words, at + step + marks * (8 + step))
    pos, first = 0, 0
    if checkpoint:
        place = at + step + (checkpoint - 1) * (8 + step)
        (pos,), first, at = struct.unpack_from("<Q", payload, place), checkpoint * CHECK, place + 8
    x = np.frombuffer(payload, np.uint64, lanes, at).copy()
    out = np.empty(n - first * lanes if n > first * lanes else 0, np.uint32)
    mask = U((1 << BITS) - 1)
    for k in range(0, len(out), lanes):
        own = x[: len(out) - k]
        slot = own & mask
        s = table.slot[slot]
        own = table.freq[s] * (own >> U(BITS)) + slot - table.start[s]
        low = np.flatnonzero(own < LOW)
        own[low] = (own[low] << U(32)) | words[pos : pos + len(low)]
        pos += len(low)
        x[: len(own)] = own
        out[k : k + lanes] = s
    return out


def _tokenize(path: str, end: int):
    """Sorted rows (part, doc_id, text) to blocks of ids; each partition ends with its counts of ids."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        coder, part, block = encoder(path), 0, 0
        size = max(coder.tokenizer.get_vocab_size(with_added_tokens=True), end + 1)
        counts = np.zeros(size, np.int64)
        kept: list[tuple[list, np.ndarray, np.ndarray]] = []
        held = 0

        def flush():
            nonlocal kept, held, block, counts
            ids = np.concatenate([x[2] for x in kept])
            counts += np.bincount(ids, minlength=size)
            row = tb.to_batch(schema, part=[part], block=[block], doc_ids=[sum((x[0] for x in kept), [])], n_tokens=[np.concatenate([x[1] for x in kept])], ids=[ids.astype("<u4" if size > 1 << 16 else "<u2").tobytes()], counts=[None])
            kept, held, block = [], 0, block + 1
            return row

        for batch in batches:
            if not len(batch):
                continue
            part = batch.column(0)[0].as_py()
            names = batch.column(1).to_pylist()
            for low, high, ids, bounds in coder.blocks(batch.column(2)):
                n = np.diff(bounds) + 1
                full = np.full(len(ids) + len(n), end, np.uint32)
                full[np.arange(len(ids)) + tb.row_of(bounds)] = ids
                stops = np.cumsum(n)
                begin = 0
                while begin < len(n):
                    done = stops[begin - 1] if begin else 0
                    stop = max(begin + 1, int(np.searchsorted(stops, done + BLOCK_IDS - held, side="right")))
                    kept.append((names[low + begin : low + stop], n[begin:stop], full[done : stops[stop - 1]]))
                    held += int(stops[stop - 1] - done)
                    begin = stop
                    if held >= BLOCK_IDS or begin < len(n):
                        yield flush()
        if kept:
            yield flush()
        if block:
            yield tb.to_batch(schema, part=[part], block=[-1], doc_ids=[[]], n_tokens=[[]], ids=[None], counts=[counts.tobytes()])

    return run


def _counts(batches):
    total = None
    for batch in batches:
        for value in batch.column(0).to_pylist():
            own = np.frombuffer(value, np.int64)
            total = own.copy() if total is None else total + own
    if total is not None:
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int) -> tuple[str, str]:
    """Writes docs (doc_id, text) as token files in ascending doc_id order; gives the paths of blocks and frequencies."""
    spark = docs.sparkSession
    work = Work(spark, "token-files")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    tokens = work.table(rows.mapInArrow(_tokenize(tokenizer, end), "part int, block int, doc_ids array<long>, n_tokens array<long>, ids binary, counts binary"), "ids")
    counted = tokens.where("counts is not null").select("counts").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    freq = scale_counts({r.id: r.n for r in counted.collect()})  # as many rows as the vocabulary has ids at most
    spark.createDataFrame(list(freq.items()), "id long, freq long").coalesce(1).write.parquet(f"{folder}/frequencies")

    def code(batches):
        table = Table(np.array(list(freq)), np.array(list(freq.values())))
        for batch in batches:
            for k, (ids, docs_of) in enumerate(zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                payload = encode_block(np.frombuffer(ids, "<u2" if 2 * sum(docs_of) == len(ids) else "<u4"), table)
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*one.columns[:4], pa.array([payload], pa.binary()), pa.array([zlib.crc32(payload)], pa.int64())], names=["part", "block", "doc_ids", "n_tokens", "payload", "crc32"])

    blocks = tokens.where("block >= 0").select("part", "block", "doc_ids", "n_tokens", "ids")
    blocks.mapInArrow(code, "part int, block int, doc_ids array<long>, n_tokens array<long>, payload binary, crc32 long").write.option("compression", "none").parquet(f"{folder}/blocks")
    return f"{folder}/blocks", f"{folder}/frequencies"


def read_token_files(spark: SparkSession, blocks: str, frequencies: str) -> DataFrame:
    """One row for each document, decoded from the files: doc_id, start, n_tokens, ids (little-endian uint32)."""
    freq = {r.id: r.freq for r in spark.read.parquet(frequencies).collect()}
    table = spark.read.parquet(blocks)
    sums = table.select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    # one row for each range of doc_id
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("ahead"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.select("part", "block", (F.sum("n").over(within) - F.col("n")).alias("within")).join(ahead, "part").select("part", "block", (F.col("ahead") + F.col("within")).alias("first"))

    def decode(batches):
        codes = Table(np.array(list(freq)), np.array(list(freq.values())))
        for batch in batches:
            for k in range(len(batch)):
                first, names, sizes, payload, crc = (batch.column(i)[k].as_py() for i in range(5))
                if zlib.crc32(payload) != crc:
                    raise ValueError("a block does not have its checksum")
                ids = decode_block(payload, codes)
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4")
                parts = [raw[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(first + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return table.join(starts, ["part", "block"]).select("first", "doc_ids", "n_tokens", "payload", "crc32").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = Work(spark, "op2-files").root
    paths = write_token_files(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return read_token_files(spark, *paths).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
