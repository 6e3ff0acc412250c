"""Benchmark decontamination by suffix arrays over the training words.

Training documents are dealt to blocks. A task builds the suffix array of a block's words (all suffixes in order, as far as
the longest test goes), and the benchmark streams past it in slices: every test suffix is binary-searched, its interval
narrowed word by word, so matches are verbatim and come with their places. A document's words inside any match of a window
are hit; from each place that is hit the match is followed on among the test suffixes, which gives the longest one.

Documents are read and dealt once, whatever the benchmark's size; neither is ever whole in the driver or in a task.

Defined cases: null or empty texts have no words and no hits; an item of fewer than `window` words, but at least one, is
one shorter test suffix; items without words never match; repeated documents are judged each by itself; repeated item
ids count once per document; an item with a null id counts for n_hit and the longest match, all such items are one null
among a document's items, as in the SQL; item ids may have any type that can be ordered; further columns pass through
untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.llm import textblocks as tb
from casewright.llm.work import Work, fresh, read, sparing

WINDOW = 10
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 1 << 20  # of training text in a block, of benchmark text in a slice
WORD = tb.byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def in_order(ids) -> list:
    """Distinct ids in order, a null last."""
    distinct = set(ids)
    return sorted(distinct - {None}) + [None] * (None in distinct)


def suffix_array(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of all words in the order of the suffixes there, keys of their first words in that order, words a key holds).

    words are numbers over 0; zeros end texts, three of them the array. Prefix doubling: names of h words in order give the
    order by 2h words, for the suffixes that h words do not tell apart. Beyond `depth` words equal ones stay as they are.
    """
    top = int(words.max(initial=0)) + 1
    h = 3 if top < 1 << 21 else 2 if top < 1 << 31 else 1
    key = words.copy()
    for k in range(1, h):
        key *= top
        key[:-k] += words[k:]
    live = np.flatnonzero(words)
    order = live[np.argsort(key[live], kind="stable")]
    keys = key[order]
    names = np.zeros(len(words), np.int64)
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    slots = np.arange(len(order))
    names[order] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
    open_slots = np.flatnonzero(~new | ~np.r_[new[1:], True]) if len(keys) else slots
    length = h
    while length < depth and len(open_slots):
        own = order[open_slots]
        pair = names[own] * (len(words) + 1) + names[np.minimum(own + length, len(words) - 1)]
        at = np.argsort(pair, kind="stable")
        own, pair = own[at], pair[at]
        order[open_slots] = own
        new = np.r_[True, pair[1:] != pair[:-1]]
        names[own] = open_slots[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))] + 1
        open_slots = open_slots[~new | ~np.r_[new[1:], True]]
        length *= 2
    return order, keys, h


def narrow(words: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, j: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the intervals low:high of a suffix array, in which all agree in j words, that have `value` as the next word."""
    last = len(words) - 1

    def first(strict: bool) -> np.ndarray:
        a, b = low.copy(), high.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            word = words[np.minimum(order[mid] + j, last)]
            after = word <= value[live] if strict else word < value[live]
            a[live[after]], b[live[~after]] = mid[after] + 1, mid[~after]
            live = live[a[live] < b[live]]
        return a

    return first(False), first(True)


def _layout(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words with one zero after every text and three at the end, where each text begins)."""
    begin = first[:-1] + np.arange(len(first) - 1)
    words = np.zeros(len(hashes) + len(first) + 2, np.int64)
    words[np.arange(len(hashes)) + tb.row_of(first)] = hashes
    return words, begin


class Block:
    """Training texts with the suffix array of their words; `search` takes one slice of tests after the other."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, depth: int):
        buf = tb.LOWER[buf]
        starts, ends, first = tb.word_spans(buf, offsets, WORD)
        self.vocabulary, ids = np.unique(tb.span_hashes(buf, starts, ends), return_inverse=True)
        self.words, self.begin = _layout(ids + 1, first)
        self.count = np.diff(first)
        self.order, self.keys, self.h = suffix_array(self.words, depth)
        rows = len(self.count)
        self.cover = np.zeros(len(self.words) + 1, np.int64)
        self.items: list[set] = [set() for _ in range(rows)]
        self.longest, self.where = np.zeros(rows, np.int64), np.full(rows, -1, np.int64)

    def _ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words as in this block; others get one that none has."""
        n = len(self.vocabulary)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(n - 1, 0))
        return np.where(self.vocabulary[at] == hashes, at + 1, n + 1) if n else np.full(len(hashes), 1)

    def _bounds(self, tests: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with size words of tests from at on."""
        top, low, high = len(self.vocabulary) + 2, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if self.h == 1 or not len(self.keys):
            high += len(self.order)
            done = np.zeros(len(at), np.int64)
        else:
            top = int(self.words.max()) + 1
            key, done = np.zeros(len(at), np.int64), np.minimum(size, self.h)
            for j in range(self.h):
                key = key * top + np.where(j < size, tests[np.minimum(at + j, len(tests) - 1)], 0)
            low = np.searchsorted(self.keys, key)
            high = np.searchsorted(self.keys, key + np.where(done < self.h, top ** (self.h - done), 1))
        for j in range(int(size.max(initial=0))):
            own = np.flatnonzero((done <= j) & (j < size) & (low < high))
            if len(own):
                low[own], high[own] = narrow(self.words, self.order, low[own], high[own], j, tests[at[own] + j])
        return low, high

    def search(self, ids: list, buf: np.ndarray, offsets: np.ndarray, window: int) -> None:
        """Notes the matches of items (their ids and texts)."""
        buf = tb.LOWER[buf]
        starts, ends, first = tb.word_spans(buf, offsets, WORD)
        tests, begin = _layout(self._ids(tb.span_hashes(buf, starts, ends)), first)
        n = np.diff(first)
        size = np.minimum(n, window)
        windows = np.where(n > 0, n - size + 1, 0)
        item = np.repeat(np.arange(len(n)), windows)
        at = begin[item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        size = size[item]
        strange = np.concatenate([[0], np.cumsum(tests > len(self.vocabulary))])
        known = strange[at + size] == strange[at]
        at, item, size = at[known], item[known], size[known]
        low, high = self._bounds(tests, at, size)
        found = low < high
        at, item, size, low, high = at[found], item[found], size[found], low[found], high[found]
        if not len(at):
            return
        # equal windows are one: their interval and length tell them apart
        (low, size), of = np.unique(np.stack([low, size]), axis=1, return_inverse=True)
        of = of.ravel()
        high_of = np.zeros(len(low), np.int64)
        high_of[of] = high
        n = high_of - low
        which = np.repeat(np.arange(len(low)), n)
        place = self.order[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]]
        np.add.at(self.cover, place, 1)
        np.add.at(self.cover, place + size[which], -1)
        row = np.searchsorted(self.begin, place, side="right") - 1
        holders: list[set] = [set() for _ in range(len(low))]
        for w, i in zip(of.tolist(), item.tolist(), strict=True):
            holders[w].add(ids[i])
        for r, w in np.unique(np.stack([row, which]), axis=1).T.tolist():
            self.items[r] |= holders[w]
        self._follow(tests, at, of, size, which, place, row, window)

    def _follow(self, tests, at, of, size, which, place, row, window) -> None:
        """The longest match from every place that is hit: the window's interval among the tests is narrowed on."""
        length = size[which].copy()
        live = np.flatnonzero(length == window)  # a shorter item ends there
        if len(live):
            order, _, _ = suffix_array(tests, len(tests))
            rank = np.empty(len(tests), np.int64)
            rank[order] = np.arange(len(order))
            low, high = np.full(len(size), len(order)), np.zeros(len(size), np.int64)
            np.minimum.at(low, of, rank[at])
            np.maximum.at(high, of, rank[at] + 1)
            a, b, j = low[which[live]], high[which[live]], window
            while len(live):
                word = self.words[np.minimum(place[live] + j, len(self.words) - 1)]
                a, b = narrow(tests, order, a, b, j, word)
                more = (a < b) & (word > 0)
                live, a, b, j = live[more], a[more], b[more], j + 1
                length[live] = j
        best = np.lexsort((place, -length, row))
        best = best[np.r_[True, row[best][1:] != row[best][:-1]]]
        r, size, start = row[best], length[best], place[best] - self.begin[row[best]]
        better = (size > self.longest[r]) | ((size == self.longest[r]) & (start < self.where[r]))
        self.longest[r[better]], self.where[r[better]] = size[better], start[better]

    def result(self) -> list[dict]:
        """For each text: n_words, n_hit, items, longest, longest_at."""
        hit = np.concatenate([[0], np.cumsum(np.cumsum(self.cover[:-1]) > 0)])
        n_hit = hit[self.begin + self.count] - hit[self.begin]
        rows = zip(self.count.tolist(), n_hit.tolist(), self.items, self.longest.tolist(), self.where.tolist(), strict=True)
        return [dict(zip(("n_words", "n_hit", "items", "longest", "longest_at"), (c, h, in_order(i), s, w), strict=True)) for c, h, i, s, w in rows]


def _scan(window: int, depth: int, match: pa.DataType):
    """Rows in order of (block, kind): the documents of a block, then the slices of the benchmark; gives the documents, matched."""

    def finish(held: list, block: Block | None):
        rows = pa.concat_arrays(held)
        matches = (block or Block(*tb.text_bytes(rows.field("text")), depth)).result()
        step = 4096
        for low in range(0, len(rows), step):
            part = rows.slice(low, step)
            yield pa.RecordBatch.from_arrays([part.field("row"), pa.array(matches[low : low + step], match)], names=["row", "match"])

    def run(batches):
        held, block, now = [], None, None
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1]), True]) if len(batch) else [0]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if blocks[low] != now:
                    if held:
                        yield from finish(held, block)
                    held, block, now = [], None, blocks[low]
                if kinds[low] == 0:
                    held.append(batch.column(2).slice(low, high - low))
                elif held:
                    block = block or Block(*tb.text_bytes(pa.concat_arrays(held).field("text")), depth)
                    for k in range(low, high):
                        items = batch.column(3)[k].values
                        block.search(items.field("i").to_pylist(), *tb.text_bytes(items.field("t")), window)
        if held:
            yield from finish(held, block)

    return run


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, item_id: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """docs with a struct column (its name is returned): n_words, n_hit, items, longest, longest_at."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    work = Work(spark, "decontaminate")
    name = fresh(docs, "_match")
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct()
    items = work.table(items.withColumn("bytes", F.octet_length("t")), "items")
    size, longest = items.agg(F.sum("bytes"), F.max("bytes")).first()
    n = -(-(size or 0) // slice_bytes) or 1
    slices = items.groupBy(F.pmod(F.xxhash64("i", "t"), F.lit(n)).alias("slice")).agg(F.collect_list(F.struct("i", "t")).alias("items"))
    slices = work.table(slices.select("items"), "slices")
    blocks = max(1, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // block_bytes))
    row = F.struct(*[F.col(c) for c in docs.columns])
    dealt = docs.select(F.pmod(F.xxhash64(text, F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), F.struct(row.alias("row"), F.col(text).cast("string").alias("text")).alias("doc"), F.lit(None).cast(slices.schema["items"].dataType).alias("items"))
    # every block meets every slice of the stated tests
    tests = slices.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.lit(None).cast(dealt.schema["doc"].dataType).alias("doc"), "items")
    parts = min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    together = dealt.union(tests).repartition(parts, "block").sortWithinPartitions("block", "kind")
    match = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(items.schema["i"].dataType)), T.StructField("longest", T.LongType()), T.StructField("longest_at", T.LongType())])
    schema = T.StructType([T.StructField("row", dealt.schema["doc"].dataType["row"].dataType), T.StructField("match", match)])
    out = together.mapInArrow(sparing(_scan(window, (longest or 0) // 2 + 1, to_arrow_type(match))), schema)
    return out.select("row.*", F.col("match").alias(name)), name


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without those that hold any test suffix; all columns stay."""
    out, name = annotate(docs, benchmark, text, **options)
    return out.where(F.col(name)["n_hit"] == 0).select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out, name = annotate(docs, read(spark, sf_dir, "benchmark"))
    m = F.col(name)
    joined = F.array_join(F.array_sort(F.transform(m["items"], lambda i: i.cast("string"))), ",")
    return out.select("doc_id", m["n_words"].alias("n_words"), m["n_hit"].alias("n_hit"), F.size(m["items"]).cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (m["n_hit"] > 0).alias("contaminated"), m["longest"].alias("longest_match"), m["longest_at"].alias("longest_at"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS rid, item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(p)),
m AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM m), unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id),
-- a match is a run of windows that follow each other in the document and in the item
ip AS (SELECT rid, p AS ip, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(p) WHERE len(w) > 0),
r AS (SELECT doc_id, rid, p, n, p - ip AS diag, p - row_number() OVER (PARTITION BY doc_id, rid, p - ip ORDER BY p) AS run
      FROM dw JOIN ip USING (n, g)),
l AS (SELECT doc_id, max(p) + max(n) - min(p) AS size, min(p) - 1 AS place FROM r GROUP BY doc_id, rid, diag, run),
lm AS (SELECT doc_id, size, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, place) AS k FROM l) WHERE k = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(size, 0) AS BIGINT) AS longest_match, CAST(coalesce(place, -1) AS BIGINT) AS longest_at
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN lm USING (doc_id)
"""
