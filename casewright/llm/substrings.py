"""Removal of repeated byte strings by distributed difference-cover suffix sorting.

Every string of `span` bytes holds a least GRAM-byte gram (by hash); strings that are equal have the same least gram at
the same place. So the gram deals the strings out: all texts around the occurrences of one gram meet in one bucket, and
a bucket holds every text that can share such a string. Only grams that occur in two documents matter.

1. Packs of documents send the hashes of their least grams to buckets; a bucket answers which of them occur in two
   documents or more, and which are so frequent (HOT) that their strings have to be dealt out further.
2. Packs send the neighbourhoods of those grams (all strings whose least gram it is; about 60 bytes) to buckets, equal
   ones of a pack once, with the smallest doc_id. Of a hot gram each string goes to a bucket of its own hash.
3. A bucket suffix-sorts its distinct neighbourhoods by a difference cover modulo 3: it sorts the triples at two of three
   places, recurses on their names, sorts the remaining suffixes by the ranks, merges the three orders, and compares
   adjacent prefixes of `span` bytes. Each run of equal prefixes takes its smallest doc_id.
4. Packs get, for every neighbourhood, the strings that start in a document with a smaller id, and cut their bytes.

Documents are dealt to packs by a hash of their id and text, so a group of copies of any size, or rows without an id,
spread over all packs, and each pack sends equal strings once. The documents of a pack travel as compressed chunks. A pack sends a row to every bucket, so packs times buckets
rows are shuffled, as many as a shuffle between as many tasks has blocks; PACK_BYTES and BUCKET_BYTES set both.

Defined cases: null and empty texts have no bytes; texts shorter than `span` never lose any; rows that repeat a doc_id
are cut each, and never because of each other; rows without a doc_id come after all others: they lose what those have, and
nothing is lost because of them; an empty table gives no rows; texts of bytes that are no UTF-8 are handled
as bytes; further columns pass through `remove_repeats` untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import textblocks as tb
from casewright.llm.work import BATCH_BYTES, Work, fresh, read, sparing

U = np.uint64
SPAN, GRAM = 50, 24
PACK_BYTES, BUCKET_BYTES, CHUNK_BYTES = 4 << 20, 16 << 20, 8 << 20  # of text; a task cuts chunks from so much at once
HOT = 1 << 16  # places of a gram from which its strings are dealt out one by one
LAST = (1 << 63) - 1  # stands for no doc_id
SORT_BYTES = 1 << 19  # of neighbourhoods sorted at once; grams part a bucket, so a part is complete
_PRIME = tb.mix(np.arange(21, 25, dtype=np.uint64)) | U(1)
_BLOCK = 1 << 18  # bytes whose hashes stay in a core's cache
_AT_ONCE = 1 << 14  # neighbourhoods whose strings are marked at once: each takes some hundred bytes a string


# --- difference cover -------------------------------------------------------------------------------------------------


def _names(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1 of tuples of numbers, compared from the first on, and how many there are."""
    key = keys[0].astype(np.int64)
    for more in keys[1:]:
        top = int(more.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 62) // top:
            key = _names(key)[0]
        key = key * top + more
    order = np.argsort(key)
    new = np.empty(len(key), np.int64)
    if len(key):
        in_order = key[order]
        new[0], new[1:] = 1, in_order[1:] != in_order[:-1]
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(new)
    return names, int(new.sum())


def _less(keys: np.ndarray) -> np.ndarray:
    """For small numbers: how many are less than each."""
    count = np.bincount(keys)
    return (np.cumsum(count) - count)[keys]


def _merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(members of a and b less than each of a, members of b less than each of a, members of a less than each of b)."""
    keys = np.concatenate([a, b])
    order = np.argsort(keys)
    in_order, from_b = keys[order], order >= len(a)
    start = np.zeros(len(keys), np.int64)
    start[1:] = np.where(in_order[1:] != in_order[:-1], np.arange(1, len(keys)), 0)
    start = np.maximum.accumulate(start)
    b_before = np.concatenate([[0], np.cumsum(from_b)])[start]
    less, less_b = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    less[order], less_b[order] = start, b_before
    return less[: len(a)], less_b[: len(a)], (less - less_b)[len(a) :]


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """For every suffix of s (numbers over 0; 0 ends a string) how many suffixes are less.

    Suffixes that agree in `depth` numbers at least may get equal ranks.
    """
    n = len(s)
    t = np.zeros(n + 3 + (-n) % 3, np.int64)
    t[:n] = s
    size = len(t) - 3
    at1, at2 = np.arange(1, size + 1, 3), np.arange(2, size + 2, 3)
    at = np.concatenate([at1, at2])
    at_next, at_last = np.minimum(at + 1, len(t) - 1), np.minimum(at + 2, len(t) - 1)
    names, kinds = _names(t[at], t[at_next], t[at_last])
    if kinds == len(at) or depth <= 3:
        rank12 = names - 1
    else:
        # the names of the places 1, 4, ... then of 2, 5, ...; a zero parts them
        rank = suffix_ranks(np.concatenate([names[: len(at1)], [0], names[len(at1) :]]), -(-depth // 3))
        rank12 = np.concatenate([rank[: len(at1)], rank[len(at1) + 1 :]])
    top = int(rank12.max(initial=0)) + 2
    of = np.zeros(len(t) + 2, np.int64)  # rank of the sampled suffixes, from 1
    of[at] = rank12 + 1
    at0 = np.arange(0, size, 3)
    # places 0 and 1 compare by (number, rank of the next), 0 and 2 by (two numbers, rank of the one after)
    first0, first1 = t[at0] * top + of[at0 + 1], t[at1] * top + of[at1 + 1]
    pair = int(t.max(initial=0)) + 1
    if pair * pair * top < 1 << 62:
        second0, second2 = (t[x] * pair + t[np.minimum(x + 1, len(t) - 1)] for x in (at0, at2))
        second0, second2 = second0 * top + of[at0 + 2], second2 * top + of[at2 + 2]
    else:
        both = np.concatenate([at0, at2])
        named, _ = _names(t[both], t[np.minimum(both + 1, len(t) - 1)], of[both + 2])
        second0, second2 = named[: len(at0)], named[len(at0) :]
    less12 = _less(rank12)
    ahead01, _, ahead1 = _merge(first0, first1)
    _, ahead02, ahead2 = _merge(second0, second2)
    ranks = np.zeros(len(t), np.int64)
    ranks[at0] = ahead01 + ahead02
    ranks[at1] = less12[: len(at1)] + ahead1
    ranks[at2] = less12[len(at1) :] + ahead2
    return ranks[:n]


def smallest_owners(buf: np.ndarray, starts: np.ndarray, size: np.ndarray, owners: np.ndarray, span: int) -> np.ndarray:
    """For every `span`-byte string of every text (buf from its start, its size), in order, the smallest owner of a text with that string."""
    begin = np.cumsum(size + 1) - size - 1
    s = np.zeros(int((size + 1).sum()), np.int64)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    s[step + np.repeat(begin, size)] = buf[step + np.repeat(starts, size)].astype(np.int64) + 1
    n = size - span + 1
    places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)
    of = np.repeat(np.arange(len(size)), n)
    order = np.argsort(suffix_ranks(s, span)[places])
    sorted_places = places[order]
    # adjacent prefixes, eight bytes at a time; ranks put equal ones side by side
    view = tb.eight_bytes((s - 1).astype(np.uint8))
    same = np.ones(max(len(places) - 1, 0), bool)
    for k in [*range(0, span - 7, 8), *([span - 8] if span % 8 else [])]:
        part = view[sorted_places + k]
        same &= part[1:] == part[:-1]
    head = np.flatnonzero(np.r_[True, ~same])
    least = np.empty(len(places), owners.dtype)
    least[order] = np.repeat(np.minimum.reduceat(owners[of][order], head), np.diff(np.r_[head, len(places)]))
    return least


# --- least grams ------------------------------------------------------------------------------------------------------


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every window of `width` members."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


def least_grams(buf: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one least gram: (hash of the gram, first start, starts, row) in order of place.

    The least gram of a string is the leftmost of the smallest hash, and its hash names it.
    """
    none = np.zeros(0, np.int64)
    rows = np.flatnonzero(np.diff(offsets) >= span)
    if not len(rows):
        return none.astype(np.uint64), none, none, none
    x = buf.astype(np.uint64)
    for k in (1, 2, 4):  # at every place the next 2, 4, 8 bytes as one number
        y = x[k:] << U(8 * k)
        y |= x[:-k]
        x = y
    n = len(buf) - GRAM + 1
    h = x[:n] * _PRIME[0]
    h += x[8 : n + 8] * _PRIME[1]
    h += x[16 : n + 16] * _PRIME[2]
    h ^= h >> U(32)
    h *= _PRIME[3]
    h ^= h >> U(29)
    low = _slide(h, span - GRAM + 1, np.minimum)  # of the string that starts here
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[1:] |= h[: len(low) - 1] == low[:-1]  # the least gram was the string's first, so it has gone
    begin, end = offsets[:-1][rows], offsets[1:][rows] - span + 1
    new[begin] = True
    start = np.flatnonzero(new)
    row = np.searchsorted(begin, start, side="right") - 1
    keep = (row >= 0) & (start < end[row])
    start, row = start[keep], row[keep]
    count = np.minimum(np.r_[start[1:], len(buf)], end[row]) - start
    return low[start], start, count, rows[row]


# --- the Spark job ----------------------------------------------------------------------------------------------------


def _chunk(texts: list[str], rest: list[str]):
    """Rows (pack, ...) to one row for each pack in every CHUNK_BYTES of a task: its documents as compressed Arrow streams."""
    schema = pa.schema([("pack", pa.int32()), ("texts", pa.binary()), ("rest", pa.binary())])

    def stream(table: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    def cut(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held)
        used, cuts, order = _by_bucket(table.column("pack").to_numpy().astype(np.uint64), 1 << 62)
        table = table.take(pa.array(order))
        for pack, low, high in zip(used, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = table.slice(low, high - low).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([pack, stream(own.select(texts)), stream(own.select(rest))], schema.types, strict=True)], schema=schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                yield from cut(held)
                held, size = [], 0
        if held:
            yield from cut(held)

    return run


def _unpack(table: pa.Table, column: str) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column(column)]).combine_chunks()


def _pack_rows(table: pa.Table):
    """The documents of a pack in order of (place, text): places, texts, and blocks of rows."""
    table = _unpack(table, "texts").sort_by([("place", "ascending"), ("text", "ascending")])
    buf, offsets = tb.text_bytes(table.column("text"))
    return table.column("place").to_numpy(), buf, offsets


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _send_grams(buckets: int, span: int):
    """A pack's distinct gram hashes by bucket: 6 bytes each, and a byte of 2 log2(places), odd if two of its documents have it."""
    schema = pa.schema([("bucket", pa.int32()), ("pack", pa.int32()), ("grams", pa.binary())])

    def run(key, table):
        ids, buf, offsets = _pack_rows(table)
        parts = []
        for low, high in tb.row_blocks(offsets, _BLOCK):
            h, _, _, row = least_grams(buf[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], span)
            parts.append(np.stack([h >> U(16), ids[low + row].view(np.uint64)]))
        both = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.uint64)
        order = np.lexsort((both[1], both[0]))
        h, doc = both[:, order]
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        last = np.r_[head[1:], len(h)] - 1
        count = np.frexp(np.diff(np.r_[head, len(h)]).astype(float))[1].astype(np.uint64)
        grams = h[head] << U(8) | count << U(1) | (doc[last] != doc[head])
        own, cuts, order = _by_bucket(h[head], buckets)
        blobs = [_blob(grams[order[a:b]].view(np.uint8).reshape(-1, 8)[:, :7]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([pa.array(own, pa.int32()), pa.array([key[0].as_py()] * len(own), pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    return run


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(buckets in use, bounds of each, order of the hashes by bucket)."""
    bucket = (h % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, first = np.unique(bucket[order], return_index=True)
    return own.tolist(), np.r_[first, len(h)], order


def _wide(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(blob, np.uint8).reshape(-1, 7)
    return out.view(np.uint64).ravel()


def _answer_grams(hot: int):
    """Of a bucket: the grams of each pack that two documents have; the last byte tells the hot ones."""

    def run(key, table):
        parts = [_wide(x) for x in table.column("grams").to_pylist()]
        grams = np.concatenate(parts)
        order = np.argsort(grams)
        h = grams[order] >> U(8)
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.r_[head, len(h)])
        places = np.add.reduceat(np.exp2((grams[order] >> U(1) & U(127)).astype(float)), head)
        shared = (count > 1) | np.logical_or.reduceat((grams[order] & U(1)).astype(bool), head)
        keep, answer = np.empty(len(grams), bool), np.empty(len(grams), np.uint64)
        keep[order] = np.repeat(shared, count)
        answer[order] = h << U(8) | np.repeat(places > hot, count)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        own = [x[k] for x, k in zip(np.split(answer, cuts), np.split(keep, cuts), strict=True)]
        return pa.table([table.column("pack"), pa.array([_blob(x.view(np.uint8).reshape(-1, 8)[:, :7]) for x in own], pa.binary())], names=["pack", "grams"])

    return run


def _neighbourhoods(table: pa.Table, grams: pa.Table, span: int):
    """The distinct neighbourhoods of a pack's shared grams, in a fixed order; of hot grams, their strings.

    (hash of gram or string, text, smallest place) of each, and for every occurrence (neighbourhood, row, start, starts).
    """
    ids, buf, offsets = _pack_rows(table)
    answered = np.sort(np.concatenate([np.zeros(0, np.uint64), *[_wide(x) for x in grams.column("grams").to_pylist()]]))
    shared, hot = answered >> U(8), (answered & U(1)).astype(bool)
    h, start, count, row = [], [], [], []
    for low, high in tb.row_blocks(offsets, _BLOCK):
        a, b, c, r = least_grams(buf[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], span)
        at = np.searchsorted(shared, a >> U(16))
        keep = shared[np.minimum(at, len(shared) - 1)] == a >> U(16) if len(shared) else np.zeros(len(a), bool)
        h.append(a[keep])
        start.append(b[keep] + offsets[low])
        count.append(c[keep])
        row.append(r[keep] + low)
    h, start, count, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, start, count, row))
    if hot.any() and len(h):
        single = hot[np.searchsorted(shared, h >> U(16))]
        n = np.where(single, count, 1)
        start = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        h, count, row, single = np.repeat(h, n), np.where(np.repeat(single, n), 1, np.repeat(count, n)), np.repeat(row, n), np.repeat(single, n)
        h[single] = tb.span_hashes(buf, start[single], start[single] + span)
    content = tb.span_hashes(buf, start, start + count + span - 1)
    # equal texts of the pack are one neighbourhood; rows are in order of doc_id, so the first has the smallest
    _, first, of = np.unique(content, return_index=True, return_inverse=True)
    return ids, buf, offsets, (h, start, count, row, first, of)


def _send_neighbourhoods(buckets: int, span: int):
    schema = pa.schema([("bucket", pa.int32()), ("pack", pa.int32()), ("texts", pa.binary()), ("sizes", pa.binary()), ("parts", pa.binary()), ("owners", pa.binary())])

    def run(key, table, grams):
        ids, buf, _, (h, start, count, row, first, _) = _neighbourhoods(table, grams, span)
        used, cuts, order = _by_bucket(h[first] >> U(16), buckets)
        out = []
        for b, low, high in zip(used, cuts[:-1], cuts[1:], strict=True):
            own = first[order[low:high]]
            size = count[own] + span - 1
            at = np.arange(size.sum()) + np.repeat(start[own] - (np.cumsum(size) - size), size)
            out.append((b, _blob(buf[at]), _blob(size.astype(np.uint8)), _blob((h[own] >> U(8)).astype(np.uint8)), _blob(ids[row[own]])))
        columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
        pack = [key[0].as_py() if key[0].as_py() is not None else -1] * len(out)
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(pack, pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], schema=schema)

    return run


def _sort_bucket(span: int):
    """For each pack's neighbourhoods, in the order sent: a bit for each string that starts in a document before its owner."""

    def part(buf, begin, size, docs) -> np.ndarray:
        """The bits of the neighbourhoods of one part."""
        _, first, of = np.unique(tb.span_hashes(buf, begin, begin + size), return_index=True, return_inverse=True)
        owners = np.full(len(first), LAST, np.int64)
        np.minimum.at(owners, of, docs)
        least = smallest_owners(buf, begin[first], size[first], owners, span)
        starts = size[first] - span + 1
        n = starts[of]
        head = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(head, n)
        covered = least[step + np.repeat((np.cumsum(starts) - starts)[of], n)] < np.repeat(docs, n)
        return np.bitwise_or.reduceat(covered.astype(np.uint32) << step.astype(np.uint32), head)

    def run(key, table):
        buf, offsets = tb.text_bytes(table.column("texts"))
        size, sent = tb.text_bytes(table.column("sizes"))
        size, parts = size.astype(np.int64), tb.text_bytes(table.column("parts"))[0]
        docs = np.frombuffer(tb.text_bytes(table.column("owners"))[0].tobytes(), np.int64)
        begin = np.cumsum(size) - size  # texts of all packs follow each other
        n = min(256, max(1, len(buf) // SORT_BYTES))
        order = np.argsort(parts % n, kind="stable")
        cuts = np.r_[np.flatnonzero(np.r_[True, np.diff((parts % n)[order]) != 0]), len(order)]
        bits = np.zeros(len(size), np.uint32)
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[low:high]
            bits[own] = part(buf, begin[own], size[own], docs[own])
        return pa.table([table.column("bucket"), table.column("pack"), pa.array([_blob(x) for x in np.split(bits, sent[1:-1])], pa.binary())], names=["bucket", "pack", "bits"])

    return run


def _cut(buckets: int, span: int, payload: list[str], schema: pa.Schema, whole_characters: bool):
    """Marks and cuts the bytes of a pack's documents."""

    def run(key, table, answers):
        grams, bits = answers.filter(pa.compute.is_valid(answers.column("grams"))), answers.filter(pa.compute.is_valid(answers.column("bits")))
        both = _unpack(table, "texts")
        for name, values in zip(payload, _unpack(table, "rest").columns, strict=True):
            both = both.append_column(f"own {name}", values)
        both = both.sort_by([("place", "ascending"), ("text", "ascending")])
        ids, buf, offsets, (h, start, count, row, first, of) = _neighbourhoods(table, grams, span)
        removed = np.zeros(len(buf), bool)
        if len(first):
            _, _, order = _by_bucket(h[first] >> U(16), buckets)
            by = dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True))
            mask = np.empty(len(first), np.uint32)
            mask[order] = np.concatenate([np.frombuffer(by[b], np.uint32) for b in sorted(by)])
            owner = ids[row[first]]
            covered = np.zeros(len(buf) + 1, bool)
            for low in range(0, len(start), _AT_ONCE):
                some = slice(low, low + _AT_ONCE)
                n, kind = count[some], of[some]
                place = np.repeat(np.arange(len(n)), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hit = (mask[kind][place] >> step.astype(np.uint32) & 1).astype(bool) | (ids[row[some]] > owner[kind])[place]
                covered[(start[some][place] + step)[hit] + 1] = True
            before = np.cumsum(covered, dtype=np.int32)  # covered starts ahead of each place
            edge = min(span - 1, len(buf))
            removed[:edge] = before[1 : edge + 1] > 0
            np.greater(before[edge + 1 :], before[: len(buf) - edge], out=removed[edge:])
            del covered, before
        del h, start, count, row, first, of
        gone, runs, kept = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), []
        for low, high in tb.row_blocks(offsets, _BLOCK):  # counts take many times the bytes that they count
            own, cut, at = buf[offsets[low] : offsets[high]], removed[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            heads = at[:-1][at[:-1] < at[1:]]
            if whole_characters:  # a character stays unless all of its bytes go
                first_bytes = (own & 0xC0) != 0x80
                first_bytes[heads] = True
                lead = np.flatnonzero(first_bytes)
                if len(lead):
                    cut = np.repeat(np.logical_and.reduceat(cut, lead), np.diff(np.r_[lead, len(own)]))
            edge = cut & ~np.r_[False, cut[:-1]] if len(own) else cut
            edge[heads] |= cut[heads]
            gone[low:high], runs[low:high] = (np.diff(np.r_[0, np.cumsum(x)][at]) for x in (cut, edge))
            kept += [own[a:b][~cut[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        values = {
            "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(gone), "n_spans": pa.array(runs),
            "kept": pa.array(kept, pa.binary()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        return pa.table([both.column(f"own {f.name}") if f.name in payload else values[f.name] for f in schema], schema=schema)

    return run


def cut_repeats(docs: DataFrame, output: str, span: int = SPAN, whole_characters: bool = False, extra: str | None = None, pack_bytes: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """docs (doc_id, text and the struct column `extra`, if named) cut; `output` names the columns of the result.

    span: 33 to 55, so that the strings that can share a least gram have a bit each in an answer of 32. pack_bytes and
    bucket_bytes: of text, PACK_BYTES and BUCKET_BYTES if not given; larger ones take more memory a task and fewer rows.
    """
    if not 33 <= span <= GRAM + 31:
        raise ValueError("span is out of range")
    spark = docs.sparkSession
    work = Work(spark, "substrings", BATCH_BYTES)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("place"), F.col("text").cast("binary").alias("text"), *([extra] if extra else []))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, m = max(1, -(-size // (pack_bytes or PACK_BYTES))), max(1, -(-size // (bucket_bytes or BUCKET_BYTES)))
    payload = ["doc_id", *([extra] if extra else [])]
    own = docs.schema[extra] if extra else None
    pack = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("pack")
    chunks = work.table(docs.select(pack, "place", "text", *payload).mapInArrow(sparing(_chunk(["place", "text"], payload)), "pack int, texts binary, rest binary"), "chunks")
    packs = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pack")
    slim = packs.select("pack", "texts")
    grams = slim.groupBy("pack").applyInArrow(sparing(_send_grams(m, span)), "bucket int, pack int, grams binary")
    shared = work.table(grams.groupBy("bucket").applyInArrow(sparing(_answer_grams(HOT)), "pack int, grams binary"), "grams")
    near = slim.groupBy("pack").cogroup(shared.groupBy("pack")).applyInArrow(sparing(_send_neighbourhoods(m, span)), "bucket int, pack int, texts binary, sizes binary, parts binary, owners binary")
    bits = near.groupBy("bucket").applyInArrow(sparing(_sort_bucket(span)), "bucket int, pack int, bits binary")
    answers = work.table(shared.select("pack", "grams", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("bits")).unionByName(bits.select("pack", F.lit(None).cast("binary").alias("grams"), "bucket", "bits")), "answers")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = StructType([own if f.name == extra else f for f in _parse_datatype_string(output)])
    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(sparing(_cut(m, span, payload, to_arrow_schema(kind), whole_characters)), kind)


def remove_repeats(docs: DataFrame, span: int = SPAN, **sizes) -> DataFrame:
    """docs with their texts cut; a character stays unless all its bytes go. All columns stay; null texts stay null."""
    extra, blank = fresh(docs, "_row"), fresh(docs, "_blank")
    others = [F.col(c) for c in docs.columns if c != "text"]
    nested = docs.select("doc_id", "text", F.struct(*others, F.col("text").isNull().alias(blank)).alias(extra))
    kept = cut_repeats(nested, f"{extra} int, kept binary", span, True, extra, **sizes)
    text = F.when(~F.col(extra)[blank], F.col("kept").cast("string"))
    return kept.select(*[text.alias(c) if c == "text" else F.col(extra)[c].alias(c) for c in docs.columns])


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(read(spark, sf_dir, "documents"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
