"""Byte-level numpy views of Arrow text columns.

Texts are handled whole. A block is a run of rows of about BLOCK_BYTES; a longer row is a block of its own.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 21
U = np.uint64
_MUL = U(0x9E3779B97F4A7C15)
_MIX = U(0xD6E8FEB86659FD93)
LONG_SPAN = 4096

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes reach about `size`."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1)
        yield low, high
        low = high


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * _MIX
    h = (h ^ (h >> U(32))) * _MIX
    return h ^ (h >> U(32))


def word_spans(buf: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of each row's first word with the total at the end) of maximal runs of word bytes."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word[buf]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def eight_bytes(buf: np.ndarray) -> np.ndarray:
    """At every position the next eight bytes as one number; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    view = eight_bytes(buf)
    length = ends - starts
    h = length.astype(np.uint64) * _MUL
    live, k = np.arange(len(starts)), 0
    long = np.flatnonzero(length > LONG_SPAN)
    if len(long):
        live = np.flatnonzero(length <= LONG_SPAN)
    while len(live):
        left = np.minimum(length[live] - k, 8)
        x = view[starts[live] + k] & _MASKS[left]
        v = (h[live] ^ x) * _MUL
        h[live] = v ^ (v >> U(29))
        k += 8
        live = live[length[live] > k]
    for i in long:
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return mix(h)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For bounds [0, a, b, ...]: the row of each element."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def to_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
