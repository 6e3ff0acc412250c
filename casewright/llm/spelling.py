"""Spelling variants: a pair dictionary of trie nodes gives all words one edit apart, exactly.

1. Words are counted in Arrow batches: maximal runs of letters, counted per document, then summed by Spark.
2. The words in order are the leaves of a trie. A range partition numbers the nodes that its words add to those of the word
   before, so a node is numbered once and a word keeps the numbers of its prefixes, never the prefixes themselves. The node
   a partition shares with earlier ones comes from the path to the last word before it. The same over the reversed words
   numbers suffixes.
3. A word without its i-th letter is the pair (prefix node before i, suffix node after i); a whole word cut at i is the pair
   of its two parts. Equal pairs of integers mean equal strings. Words that meet with a letter skipped on both sides differ by
   a replacement; a skipped word that meets a whole one differs by an insertion or deletion (taken at the first of a run of
   equal letters, so that it counts once). A pair holds at most one whole word and one word for each letter of the alphabet,
   so no group is larger than that, whatever the words.
4. Each word takes its near words' count and the most frequent of them; forms are followed to their end by doubling.

The driver holds the first and last word of each range and as many numbers as they have letters.

Defined cases: null and empty texts have no words; a null doc_id is written as nothing in the key of the typing rule;
rows that repeat a doc_id count each; words of any length take part; an empty table gives no rows; ties of frequency fall to
the smaller word in code-point order; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import textblocks as tb
from casewright.llm.work import Work, read

LEAST_LETTERS, LEAST_COUNT, RATIO, EVERY = 6, 5, 5, 199
_LETTER = tb.byte_set((0x41, 0x5A), (0x61, 0x7A))
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def letter_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of [A-Za-z\\u00C0-\\u00FF]+ in UTF-8: ASCII letters, and the byte C3 with the byte after it."""
    lead = buf == 0xC3
    inside = _LETTER[buf] | lead
    inside[1:] |= lead[:-1]
    return _spans(inside, offsets)


def _spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tb.word_spans(inside.view(np.uint8), offsets, np.array([False, True] + [False] * 254))


def _count(least: int, every: int):
    """(doc_id, text) to words and counts of a block of texts; with `every`, one letter in so many (document, word) goes."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            buf, offsets = tb.text_bytes(batch.column(1))
            for low, high in tb.row_blocks(offsets):
                part, off = tb.LOWER[buf[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
                starts, ends, first = letter_runs(part, off)
                lead = np.concatenate([[0], np.cumsum(part == 0xC3)])
                points = ends - starts - (lead[ends] - lead[starts])
                long = np.flatnonzero(points >= least)
                if not len(long):
                    continue
                row, starts, ends = tb.row_of(first)[long], starts[long], ends[long]
                size = ends - starts
                ends_at = np.cumsum(size)
                bytes_of = part[np.repeat(starts - (ends_at - size), size) + np.arange(ends_at[-1])]
                runs = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], ends_at]).astype(np.int64)), pa.py_buffer(bytes_of))
                coded = runs.dictionary_encode()
                names = coded.dictionary.to_pylist()
                key, n = np.unique(row * len(names) + coded.indices.to_numpy(), return_counts=True)
                total = np.bincount(key % len(names), weights=n, minlength=len(names)).astype(np.int64)
                if every:
                    raw, moved = [w.encode() for w in names], {}
                    salt = [zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids[low:high]]
                    for r, w, k in zip((key // len(names)).tolist(), (key % len(names)).tolist(), n.tolist(), strict=True):
                        h = zlib.crc32(raw[w], salt[r])
                        if not h % every:
                            word = names[w]
                            at = h % len(word)
                            total[w] -= k
                            word = word[:at] + word[at + 1 :]
                            if len(word) >= least:
                                moved[word] = moved.get(word, 0) + k
                    yield tb.to_batch(COUNTS, word=pa.array(list(moved), pa.string()), n=pa.array(list(moved.values()), pa.int64()))
                some = np.flatnonzero(total)
                yield tb.to_batch(COUNTS, word=coded.dictionary.take(pa.array(some)).cast(pa.string()), n=total[some])

    return run


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, every: int = 0) -> DataFrame:
    """word, n: runs of letters of docs (doc_id, text), A-Z lower-cased, with at least so many letters and occurrences.

    every: where that number divides crc32("<doc_id>:<run>"), the run is taken without its letter at crc32 % length.
    """
    counts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_count(least_letters, every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _points(column) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings of a column, and their bounds."""
    column = column.cast(pa.large_string())
    text = "".join(column.to_pylist())
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)


def shared_prefix(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


class _Path:
    """The numbers of the trie nodes on the way to the last word seen."""

    def __init__(self, part: int):
        self.word, self.nodes, self.free = np.zeros(0, np.uint32), np.zeros(0, np.int64), part << 40

    def step(self, word: np.ndarray) -> np.ndarray:
        """Numbers of the word's prefixes of 1, 2, ... letters."""
        k = shared_prefix(self.word, word)
        new = np.arange(self.free, self.free + len(word) - k)
        self.word, self.nodes, self.free = word, np.concatenate([self.nodes[:k], new]), self.free + len(new)
        return self.nodes


def _walk(batches, part: int, path: _Path | None = None):
    path = path or _Path(part)
    for batch in batches:
        points, bounds = _points(batch.column(0))
        yield batch, [path.step(points[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], path


def _edges(batches):
    """For each range: its first and last word and the numbers on the way to the last, as if no range went before."""
    first: dict[int, str] = {}
    last: dict[int, tuple[str, np.ndarray]] = {}
    paths: dict[int, _Path] = {}
    for batch in batches:
        parts = batch.column(1).to_numpy()
        for p in np.unique(parts).tolist():
            own = batch.filter(pa.array(parts == p))
            for _, nodes, path in _walk([own.select([0])], p, paths.get(p)):
                paths[p] = path
                first.setdefault(p, own.column(0)[0].as_py())
                last[p] = (own.column(0)[len(own) - 1].as_py(), nodes[-1])
    schema = pa.schema([("part", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("nodes", pa.list_(pa.int64()))])
    yield tb.to_batch(schema, part=list(first), first=list(first.values()), last=[last[p][0] for p in first], nodes=[last[p][1] for p in first])


def number_nodes(work: Work, words: DataFrame, name: str, parts: int) -> DataFrame:
    """words (word, key) with `nodes`: the number of each prefix of the word in the trie of all words; equal numbers, equal prefixes."""
    ordered = words.repartitionByRange(parts, "word").sortWithinPartitions("word").select("word", F.spark_partition_id().cast("long").alias("part"), "key")
    ordered = work.table(ordered, f"{name}-ordered")
    # a written file holds one range in order; ranges meet again by number, so it does not matter how files are read
    gathered = ordered.repartition(parts, "part").sortWithinPartitions("part", "word")
    carried: dict[int, tuple[str, np.ndarray]] = {}
    word, nodes = "", np.zeros(0, np.int64)
    code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    for r in sorted(gathered.mapInArrow(_edges, "part long, first string, last string, nodes array<long>").collect(), key=lambda r: r.part):
        carried[r.part] = (word, nodes)
        k = shared_prefix(code(word), code(r.first))  # so many nodes of the range's first word were numbered before
        stays = min(k, shared_prefix(code(r.first), code(r.last)))
        word, nodes = r.last, np.concatenate([nodes[:stays], np.array(r.nodes, np.int64)[stays:]])

    def run(batches):
        paths: dict[int, _Path] = {}
        schema = pa.schema([("key", pa.int64()), ("nodes", pa.list_(pa.int64()))])
        for batch in batches:
            ranges = batch.column(1).to_numpy()
            for p in np.unique(ranges).tolist():
                own = batch.filter(pa.array(ranges == p))
                if p not in paths:
                    paths[p] = _Path(p)
                    before, known = carried[p]
                    paths[p].word, paths[p].nodes = code(before), known
                    # the range's own numbers run on as if its shared nodes were new, as _edges has counted them
                    paths[p].free += shared_prefix(code(before), code(own.column(0)[0].as_py()))
                for part, found, _ in _walk([own.select([0])], p, paths[p]):
                    flat = np.concatenate(found)
                    bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    yield tb.to_batch(schema, key=own.column(2), nodes=pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)))

    return gathered.mapInArrow(run, "key long, nodes array<long>")


def _pairs(batches):
    """(word, key, n, prefix nodes, suffix nodes) to rows: the pair of nodes, the word's key and count, and what it stands for:
    0 the whole word cut here, 1 a letter skipped, 2 a letter skipped that is the first of a run of equal ones."""
    schema = pa.schema([("p", pa.int64()), ("s", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("kind", pa.int32())])
    for batch in batches:
        points, bounds = _points(batch.column(0))
        size = np.diff(bounds)
        pre, suf = (np.asarray(batch.column(i).flatten()) for i in (3, 4))
        # prefixes of 0 to size letters, node -1 for none; suffixes likewise by the place where they begin
        row = np.repeat(np.arange(len(size)), size + 1)
        at = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size + 1)
        begin, left = bounds[:-1][row], size[row] - at
        before = np.where(at > 0, pre[np.minimum(begin + np.maximum(at - 1, 0), max(len(pre) - 1, 0))], -1)
        after = lambda skip: np.where(left - skip > 0, suf[np.minimum(begin + np.maximum(left - skip - 1, 0), max(len(suf) - 1, 0))], -1)
        whole, skipped = after(0), after(1)
        inner = left > 0
        letter = points[np.minimum(begin + at, len(points) - 1)]
        anew = (at == 0) | (letter != points[np.maximum(begin + at - 1, 0)])
        keys, n = batch.column(1).to_numpy()[row], batch.column(2).to_numpy()[row]
        join = lambda a, b: np.concatenate([a, b[inner]])
        yield tb.to_batch(schema, p=join(before, before), s=join(whole, skipped), key=join(keys, keys), n=join(n, n), kind=join(np.zeros(len(row), np.int32), np.where(anew, 2, 1).astype(np.int32)))


def near_words(work: Work, words: DataFrame, parts: int) -> DataFrame:
    """words (word, key, n; keys in the order of the words) to key, n_near, best: how many words are one edit apart, and
    the most frequent of them (n, minus its key)."""
    forward = work.table(number_nodes(work, words.select("word", "key"), "forward", parts), "prefixes").withColumnRenamed("nodes", "pre")
    backward = work.table(number_nodes(work, words.select(F.reverse("word").alias("word"), "key"), "backward", parts), "suffixes").withColumnRenamed("nodes", "suf")
    rows = words.join(forward, "key").join(backward, "key").select("word", "key", "n", "pre", "suf").mapInArrow(_pairs, "p long, s long, key long, n long, kind int")
    # one whole word and one for each letter at most
    met = rows.groupBy("p", "s").agg(F.collect_list(F.struct("n", (-F.col("key")).alias("key"), "kind")).alias("all")).where(F.size("all") > 1)
    skipped, whole = F.filter("all", lambda x: x["kind"] > 0), F.filter("all", lambda x: x["kind"] == 0)
    first = F.filter("all", lambda x: x["kind"] == 2)
    top = lambda xs: F.array_max(F.transform(xs, lambda x: F.struct(x["n"], x["key"])))
    others = F.transform(
        "skipped",
        lambda x: F.struct(
            (-x["key"]).alias("key"),
            (F.size("skipped") - 1 + F.when(x["kind"] == 2, F.size("whole")).otherwise(0)).alias("n_near"),
            top(F.concat(F.filter("skipped", lambda y: y["key"] != x["key"]), F.when(x["kind"] == 2, F.col("whole")).otherwise(F.slice("whole", 1, 0)))).alias("best"),
        ),
    )
    own = F.transform("whole", lambda x: F.struct((-x["key"]).alias("key"), F.size("first").alias("n_near"), top(F.col("first")).alias("best")))
    told = met.select(skipped.alias("skipped"), whole.alias("whole"), first.alias("first")).select(F.explode(F.filter(F.concat(others, own), lambda x: x["n_near"] > 0)).alias("x"))
    return told.groupBy("x.key").agg(F.sum("x.n_near").cast("long").alias("n_near"), F.max("x.best").alias("best"))


def variants(words: DataFrame, ratio: int = RATIO, parts: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n; distinct).

    Near words are one insertion, deletion or replacement apart. form: the near word of largest n, if that is at least
    ratio * n; root: the last word that following forms reaches.
    """
    spark = words.sparkSession
    work = Work(spark, "spelling")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # keys in the order of the words: ranges in order, rows in order within each
    numbered = work.table(words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word").select("word", "n", F.monotonically_increasing_id().alias("key")), "words")
    near = near_words(work, numbered, parts)
    found = numbered.join(near, "key", "left").select("key", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best"))
    found = work.table(found.select("key", "word", "n", "n_near", (-F.col("best.key")).alias("form_key"), F.col("best.n").alias("form_n")), "forms")
    # counts grow by the ratio at each step, so a chain is no longer than log(largest n), and doubling takes its log
    linked = work.table(found.where("form_key is not null").select("key", F.col("form_key").alias("root")), "linked")
    while True:
        onward = linked.select(F.col("key").alias("root"), F.col("root").alias("next"))
        if linked.join(onward, "root", "left_semi").isEmpty():
            break
        linked = work.table(linked.join(onward, "root", "left").select("key", F.coalesce("next", "root").alias("root")), "linked")
    name = numbered.select(F.col("key").alias("k"), F.col("word").alias("name"))
    some = found.where("form_key is not null").join(linked, "key")
    some = some.join(name.withColumnRenamed("name", "form"), F.col("form_key") == F.col("k")).drop("k").join(name.withColumnRenamed("name", "to"), F.col("root") == F.col("k")).drop("k", "root")
    none = found.where("form_key is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    return some.select("word", "form", F.col("to").alias("root"), "n", "n_near", "form_n").unionByName(none)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = Work(spark, "words").table(count_words(read(spark, sf_dir, "documents"), every=EVERY), "words")
    return variants(words)
