"""MinHash near-duplicates: universal hash minima, banding, signature check, full-set check, star components.

1. Each text becomes its set of word shingles (64-bit hashes), a 128-bit key of the set, `bands * rows` minima of
   universal hashes x -> a*x + b (mod 2^64, a odd), and one key for each band.
2. Documents with equal sets form one class, represented by its smallest id; only representatives go on.
3. In every band bucket each member meets one pivot, the one that shares its buckets with most others. Pairs whose
   minima agree well enough are confirmed on the full sets; confirmed pairs are links.
4. Components come from alternating large-star and small-star steps.
5. Buckets that still hold several components take further pivots. Around each pivot a set is told by what it has apart
   from the middle of its group: sets near the middle are linked without any pair being made, and two others only if those
   differences have a large enough common part. A prefix filter makes the pairs that can have it, and they are checked as
   in 3. So no link between bucket neighbours is lost, and copies that differ each in its own way make no pairs.

Working tables are written, so Spark knows their sizes: it broadcasts what is under its threshold
(spark.sql.autoBroadcastJoinThreshold) and joins the rest by shuffle.

Defined cases: null, empty or blank texts have no shingles, are linked with nothing and form their own component; a
text with fewer words than a shingle is one shingle; rows that repeat a doc_id share one component; rows without a
doc_id are linked with nothing: their class and component are null, they are kept, and `drop_near_duplicates` leaves all
of them; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm import textblocks as tb
from casewright.llm.work import BATCH_BYTES, Work, read, sparing

U = np.uint64
WORD = ~tb.byte_set((0x20, 0x20), (0x09, 0x0D))
SHINGLE, BANDS, ROWS = 5, 24, 4
NEAR, ROUNDS = 0.5, 3  # a bucket's member so alike to its pivot is settled in the pivot's group; pivots of a bucket at most
MEETINGS, BLOCK = 8, 1 << 17  # of a group's sets by their prefixes, for each set; members in a block of sets
SLACK = 0.2  # minima may agree that much less often than the threshold: over five standard deviations of 96 minima


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, bounds by row)."""
    buf = tb.LOWER[buf]
    starts, ends, first = tb.word_spans(buf, offsets, WORD)
    h = np.concatenate([tb.span_hashes(buf, starts, ends), np.zeros(size, np.uint64)])
    factors = tb.mix(np.arange(1, size + 2, dtype=np.uint64)) | U(1)
    tails = np.arange(size, dtype=np.uint64) * factors[size]
    n = len(starts)
    grams = np.zeros(n, np.uint64)
    for j in range(size):
        grams += h[j : n + j] * factors[j]
    grams = tb.mix(grams)
    out, bounds = [], [0]
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        k = high - low
        if k >= size:
            s = np.sort(grams[low : high - size + 1])
            s = s[np.r_[True, s[1:] != s[:-1]]]
        elif k:
            s = tb.mix((h[low:high] * factors[:k]).sum(dtype=np.uint64, keepdims=True) + tails[k])
        else:
            s = h[:0]
        out.append(s)
        bounds.append(bounds[-1] + len(s))
    return (np.concatenate(out) if out else h[:0]), np.array(bounds, np.int64)


def minima(sets: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """For each row with a non-empty set, the least value of n universal hashes (upper 32 bits)."""
    a, b = tb.mix(np.arange(1, n + 1, dtype=np.uint64) * U(3)) | U(1), tb.mix(np.arange(1, n + 1, dtype=np.uint64) * U(7))
    heads = bounds[:-1][np.diff(bounds) > 0]
    out, t = np.empty((len(heads), n), np.uint32), np.empty_like(sets)
    for j in range(n if len(heads) else 0):
        np.multiply(sets, a[j], out=t)
        t += b[j]
        out[:, j] = np.minimum.reduceat(t, heads) >> U(32)
    return out


SIGNED = "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, minima binary"


def _signer(size: int, bands: int, rows: int):
    def sign(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("bands", pa.list_(pa.int64())), ("minima", pa.binary())])
        salt = tb.mix(np.arange(1, bands + 1, dtype=np.uint64) * U(11))
        factors = tb.mix(np.arange(1, rows + 1, dtype=np.uint64) * U(13)) | U(1)
        for batch in batches:
            buf, offsets = tb.text_bytes(batch.column(1))
            for low, high in tb.row_blocks(offsets):
                sets, bounds = shingle_sets(buf[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], size)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                sig = minima(sets, bounds, bands * rows)
                keys = np.zeros((2, len(n)), np.uint64)
                if len(full):
                    for k in range(2):
                        keys[k, full] = np.add.reduceat(tb.mix(sets + U(k + 1) * U(0x51ED27)), bounds[:-1][full])
                band = tb.mix((sig.reshape(-1, bands, rows).astype(np.uint64) * factors).sum(axis=2, dtype=np.uint64) + salt)
                flat = np.zeros(len(n) + 1, np.int32)
                flat[1:] = np.cumsum((n > 0) * bands)
                minima_of = np.full(len(n), None, object)
                minima_of[full] = [r.tobytes() for r in sig]
                yield tb.to_batch(schema, doc_id=batch.column(0).slice(low, high - low), n_shingles=n, key1=keys[0].view(np.int64), key2=keys[1].view(np.int64), bands=pa.ListArray.from_arrays(pa.array(flat), pa.array(band.ravel().view(np.int64))), minima=pa.array(minima_of.tolist(), pa.binary()))

    return sign


def _agreeing(least: float):
    """Keeps pairs whose minima agree in that share at least."""

    def keep(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(len(batch), -1) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).mean(axis=1) >= least))

    return keep


def _confirming(size: int, num: int, den: int):
    """Keeps pairs with den * intersection >= num * union, on the full sets."""

    def keep(batches):
        for batch in batches:
            good = np.zeros(len(batch), bool)
            sides = [tb.text_bytes(batch.column(k)) for k in (2, 3)]
            step = 256
            for low in range(0, len(batch), step):
                high = min(low + step, len(batch))
                (sa, ba), (sb, bb) = (shingle_sets(buf[off[low] : off[high]], off[low : high + 1] - off[low], size) for buf, off in sides)
                for r in range(high - low):
                    x, y = sa[ba[r] : ba[r + 1]], sb[bb[r] : bb[r + 1]]
                    if len(x) and len(y):
                        at = np.searchsorted(x, y)
                        both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                        good[low + r] = den * both >= num * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(good))

    return keep


def _sides(work: Work, table: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the column of both ends, as x and y."""
    ids = work.table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    some = table.select("doc_id", column).join(ids, "doc_id", "left_semi")
    x = some.select(F.col("doc_id").alias("a"), F.col(column).alias("x"))
    y = some.select(F.col("doc_id").alias("b"), F.col(column).alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")


def _links(work: Work, docs: DataFrame, signed: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are links: first by their minima, then on the full sets of their texts."""

    near = work.table(_sides(work, signed.where("minima is not null"), "minima", pairs).mapInArrow(sparing(_agreeing(num / den - SLACK)), "a long, b long").distinct(), "near")
    texts = docs.where("text is not null")
    return work.table(_sides(work, texts, "text", near).mapInArrow(sparing(_confirming(size, num, den)), "a long, b long").distinct(), "links")


def components(work: Work, edges: DataFrame) -> DataFrame:
    """(doc_id, component) for every end of an edge (a, b): the smallest id reachable.

    Alternating stars: large-star hangs each node's larger neighbours on its smallest one, small-star hangs a node and
    its smaller neighbours on the smallest; both keep the components, and every component ends as one star.
    """
    edges = work.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        n = edges.agg(F.count("*"), F.count_distinct("u")).first()
        if n[0] == n[1] and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break  # every node hangs on one root and no root hangs: both steps would change nothing
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = work.table(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = work.table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = work.table(hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
    roots = edges.select(F.col("v").alias("doc_id")).distinct()
    return work.table(edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).union(roots.select("doc_id", F.col("doc_id").alias("component"))), "components")


def _relating(size: int):
    """Rows (doc, pivot, text of each) to doc, pivot, sizes of both sets, and the members that just one of the two has."""

    def relate(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("pivot", pa.int64()), ("size", pa.int64()), ("pivot_size", pa.int64()), ("delta", pa.list_(pa.int64()))])
        for batch in batches:
            sides = [tb.text_bytes(batch.column(k)) for k in (2, 3)]
            for low in range(0, len(batch), 256):
                high = min(low + 256, len(batch))
                (sa, ba), (sb, bb) = (shingle_sets(buf[off[low] : off[high]], off[low : high + 1] - off[low], size) for buf, off in sides)
                deltas = [np.setxor1d(sa[ba[r] : ba[r + 1]], sb[bb[r] : bb[r + 1]], assume_unique=True).view(np.int64) for r in range(high - low)]
                yield tb.to_batch(schema, doc_id=batch.column(0).slice(low, high - low), pivot=batch.column(1).slice(low, high - low), size=np.diff(ba), pivot_size=np.diff(bb), delta=deltas)

    return relate


def _groups(work: Work, docs: DataFrame, weighed: DataFrame, first: DataFrame, found: DataFrame, size: int, num: int, den: int) -> DataFrame | None:
    """Members (pivot, doc_id, size, pivot_size, delta) of groups in which all links of open buckets lie.

    A bucket is open if it holds several components. Its members nearer to its pivot than NEAR are settled there; the
    others take a further pivot among themselves, ROUNDS times. A link is no longer than 1 - num/den, so whoever is linked
    with a settled member is near enough to that pivot to be in its group too. The last pivot keeps everybody.
    """
    placed = weighed.join(found, "doc_id", "left").select("doc_id", "key", "weight", F.coalesce("component", "doc_id").alias("component"))
    now, pivots, groups = placed, first, None
    for k in range(ROUNDS):
        several = work.table(now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"), "open")
        if several.isEmpty():
            break
        now = work.table(now.join(several, "key"), "members-open")
        pivots = pivots or now.groupBy("key").agg(F.max_by("doc_id", "weight").alias("pivot"))
        now = work.table(now.join(pivots, "key"), "led")
        pairs = work.table(now.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct(), "open-pairs")
        related = _sides(work, docs.where("text is not null"), "text", pairs).mapInArrow(sparing(_relating(size)), "doc_id long, pivot long, size long, pivot_size long, delta array<long>")
        both = F.col("size") + F.col("pivot_size")
        related = work.table(related.withColumn("alike", (both - F.size("delta")) / (both + F.size("delta"))), "related")
        last = k + 1 == ROUNDS
        own = related if last else related.where(F.col("alike") >= NEAR - (1 - num / den) - 1e-9)
        groups = own if groups is None else groups.unionByName(own)
        if last or related.where(F.col("alike") < NEAR).isEmpty():
            break
        far = related.where(F.col("alike") < NEAR).select("doc_id", "pivot")
        now, pivots = now.join(far, ["doc_id", "pivot"], "left_semi").drop("pivot"), None
    return groups and groups.drop("alike")


def _rest(work: Work, docs: DataFrame, weighed: DataFrame, pivots: DataFrame, found: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(components, pairs (a, b) that may still be links between them, further links) by what sets have apart from a group's middle.

    C is what over half of a group's sets hold, D(x) the members that just one of x and C has. x and y differ in
    |D(x)| + |D(y)| - 2 |D(x) & D(y)| members, and are linked if (den + num) times that is at most (den - num) times the
    sum of their sizes. With h(x) = (den + num) |D(x)| - (den - num) |x| this means 2 (den + num) |D(x) & D(y)| >= h(x) + h(y).
    So all with h(x) + h(y) <= 0 are linked as they are: a star around the least h tells their component. Others need a
    common part of D of a size known beforehand. Members of D that nobody else has cannot be in it, and a prefix filter
    over the rest, rare ones first, makes the few pairs that can have it. Where its members are shared by so many that they
    would meet more than MEETINGS times for each set, the group's common parts are counted in blocks instead (_crowds).
    """
    k, d = den + num, den - num
    related = _groups(work, docs, weighed, pivots, found, size, num, den)
    if related is None:
        return found, None, None
    own = related.groupBy("pivot").agg(F.max("pivot_size").alias("size"))
    related = work.table(related.select("pivot", "doc_id", "size", "delta", (k * F.size("delta") <= d * (F.col("size") + F.col("pivot_size"))).alias("linked")).unionByName(own.select("pivot", F.col("pivot").alias("doc_id"), "size", F.array().cast("array<long>").alias("delta"), F.lit(False).alias("linked"))), "grouped")
    total = related.groupBy("pivot").agg(F.count("*").alias("g"))
    counted = related.select("pivot", F.explode("delta").alias("member")).groupBy("pivot", "member").agg(F.count("*").alias("n"))
    # a pivot's flips are in more than half of the deltas, so they are fewer than two texts have words
    flips = work.table(counted.join(total, "pivot").where("2 * n > g").groupBy("pivot").agg(F.collect_list("member").alias("flips")), "flips")
    moved = F.when(F.col("flips").isNull(), F.col("delta")).otherwise(F.concat(F.array_except("delta", "flips"), F.array_except("flips", "delta")))
    deltas = related.join(flips, "pivot", "left").withColumn("delta", moved)
    deltas = work.table(deltas.select("pivot", "doc_id", "size", "delta", "linked", (k * F.size("delta") - d * F.col("size")).cast("long").alias("h")), "deltas")
    least = work.table(deltas.groupBy("pivot").agg(F.min(F.struct("h", "doc_id")).alias("least")).select("pivot", F.col("least.h").alias("h0"), F.col("least.doc_id").alias("y0")), "middles")
    near = deltas.select("pivot", "doc_id", "h").join(least, "pivot").where("h + h0 <= 0 and doc_id <> y0").select(F.col("y0").alias("a"), F.col("doc_id").alias("b"))
    star = found.where("doc_id <> component").select(F.col("component").alias("a"), F.col("doc_id").alias("b"))
    found = components(work, star.union(near).union(deltas.where("linked").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))))

    of = found.withColumnRenamed("doc_id", "d")
    deltas = deltas.join(of, F.col("doc_id") == F.col("d"), "left").select("pivot", "doc_id", "size", "delta", "h", F.coalesce("component", "doc_id").alias("component"))
    deltas = work.table(deltas, "placed")
    sizes = deltas.groupBy("pivot", "component").agg(F.count("*").alias("n"), F.min("h").alias("h"))
    order = Window.partitionBy("pivot").orderBy(F.desc("n"), "component")
    ordered = sizes.withColumn("k", F.row_number().over(order))
    mains = ordered.groupBy("pivot").agg(F.max(F.when(F.col("k") == 1, F.col("component"))).alias("main"), F.min("h").alias("h0"), F.min(F.when(F.col("k") > 1, F.col("h"))).alias("h1")).where("h1 is not null")
    mains = work.table(mains, "mains")
    members = work.table(deltas.join(mains, "pivot").select("pivot", "doc_id", "component", "size", "h", "h0", "h1", (F.col("component") == F.col("main")).alias("in_main"), F.explode("delta").alias("member")), "members")
    counted = work.table(members.groupBy("pivot", "member").agg(F.count("*").alias("n")).where("n > 1"), "counted")
    mine = Window.partitionBy("pivot", "doc_id")
    ranked = members.join(counted, ["pivot", "member"]).withColumn("place", F.row_number().over(mine.orderBy("n", "member"))).withColumn("left", F.count("*").over(mine) - F.col("place") + 1)
    # `left` members of D, this one included, can still be common; h0 is the least h of a group, h1 of those outside its main component
    ranked = work.table(ranked.where(2 * k * F.col("left") >= F.col("h") + F.col("h0")).drop("n", "place", "h0"), "prefixes")
    second = 2 * k * F.col("left") >= F.col("h") + F.col("h1")
    met = ranked.groupBy("pivot", "member").agg(F.count_if(~F.col("in_main")).alias("nx"), F.count_if(second).alias("ny")).groupBy("pivot").agg(F.sum(F.col("nx") * F.col("ny")).alias("meetings"))
    docs_of = mains.join(deltas.groupBy("pivot").agg(F.count("*").alias("n")), "pivot").select("pivot", "n")
    crowded = work.table(met.join(docs_of, "pivot").where(F.col("meetings") > MEETINGS * F.col("n")).select("pivot"), "crowded")
    sure = _crowds(work, members.join(crowded, "pivot").join(counted, ["pivot", "member"]), k)
    ranked = ranked.join(crowded, "pivot", "left_anti")
    x, y = ranked.where("not in_main").alias("x"), ranked.where(second).alias("y")
    apart = F.col("x.component") != F.col("y.component")
    alike = (F.least("x.size", "y.size") * den) >= (F.greatest("x.size", "y.size") * num)
    enough = 2 * k * F.least("x.left", "y.left") >= F.col("x.h") + F.col("y.h")
    sharing = x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.member") == F.col("y.member")) & apart & alike & enough)
    return found, sharing.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct(), sure


def _crowds(work: Work, members: DataFrame, k: int) -> DataFrame:
    """Links (a, b) between components of groups whose differences are shared by many: no pairs are made.

    members (pivot, doc_id, member, ...): what each set has apart from its group's middle and shares with others. Sets
    are dealt to blocks of about BLOCK members. A block of sets outside the main component and a block of all sets meet in
    one task, which counts the common members of all their pairs in place; a pair is a link exactly if 2 k times that count
    reaches h(x) + h(y). Out come only links that join components which the same task has not joined yet.
    """
    own = members.groupBy("pivot", "doc_id").agg(*[F.first(c).alias(c) for c in ("component", "in_main", "h", "h0", "h1")], F.collect_list("member").alias("delta"))
    own = work.table(own.where(2 * k * F.size("delta") >= F.col("h") + F.when(F.col("in_main"), F.col("h1")).otherwise(F.col("h0"))), "crowds")
    weight = F.size("delta") + 8
    size = own.groupBy("pivot").agg(F.ceil(F.sum(weight) / BLOCK).cast("int").alias("ny"), F.greatest(F.lit(1), F.ceil(F.sum(F.when(~F.col("in_main"), weight)) / BLOCK).cast("int")).alias("nx"))
    dealt = own.join(size, "pivot")
    place = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("not in_main").select("pivot", place("nx").alias("i"), every("ny").alias("j"), F.lit(0).alias("side"), "doc_id", "component", "h", "delta")
    right = dealt.select("pivot", every("nx").alias("i"), place("ny").alias("j"), F.lit(1).alias("side"), "doc_id", "component", "h", "delta")
    met = work.table(left.unionByName(right), "crowd-blocks").groupBy("pivot", "i", "j").applyInArrow(_counting(k), "a long, b long")
    return work.table(met.distinct(), "crowd-links")


def _counting(k: int):
    def count(table: pa.Table) -> pa.Table:
        side, ids, components, h = (table.column(c).to_numpy() for c in ("side", "doc_id", "component", "h"))
        lists = table.column("delta").combine_chunks()
        flat, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        rows = tb.row_of(bounds)
        xs, ys = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        of_y = np.flatnonzero(side[rows] == 1)
        of_y = of_y[np.argsort(flat[of_y], kind="stable")]
        members, holder = flat[of_y], np.searchsorted(ys, rows[of_y])
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                root[c] = root.get(root[c], root[c])
                c = root[c]
            return c

        a, b, low = [], [], 0
        while low < len(xs):
            high = low
            while high < len(xs) and (high == low or (high + 1 - low) * len(ys) <= 1 << 21):
                high += 1
            part = xs[low:high]
            common = np.zeros((len(part), len(ys)), np.int64)
            for n, r in enumerate(part.tolist()):
                own = flat[bounds[r] : bounds[r + 1]]
                first, last = np.searchsorted(members, own), np.searchsorted(members, own, "right")
                n_of = last - first
                at = np.repeat(first - np.concatenate([[0], np.cumsum(n_of)[:-1]]), n_of) + np.arange(n_of.sum())
                common[n] = np.bincount(holder[at], minlength=len(ys))
            linked = (2 * k * common >= h[part][:, None] + h[ys][None, :]) & (components[part][:, None] != components[ys][None, :])
            i, j = np.nonzero(linked)
            cx, cy = components[part][i], components[ys][j]
            _, one = np.unique(np.stack([cx, cy]), axis=1, return_index=True)
            for n in one.tolist():
                p, q = find(int(cx[n])), find(int(cy[n]))
                if p != q:
                    root[p] = q
                    a.append(int(ids[part[i[n]]]))
                    b.append(int(ids[ys[j[n]]]))
            low = high
        return pa.table({"a": pa.array(np.minimum(a, b) if a else [], pa.int64()), "b": pa.array(np.maximum(a, b) if a else [], pa.int64())})

    return count


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, class_id, component_id, kept.

    Two documents are linked if den * |intersection| >= num * |union| of their shingle sets. class_id is the smallest
    doc_id with an equal set, component_id the smallest one reachable over links.
    """
    spark = docs.sparkSession
    work = Work(spark, "near-dup", BATCH_BYTES)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = work.table(docs.mapInArrow(sparing(_signer(size, bands, rows)), SIGNED), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    copies = work.table(full.groupBy("key1", "key2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    base = work.table(signed.select("doc_id", "n_shingles", "key1", "key2").join(copies, ["key1", "key2"], "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")).alias("class_id")), "classes")
    heads = full.join(copies, ["key1", "key2"], "left").where("class_id is null or class_id = doc_id")
    members = heads.select("doc_id", F.explode("bands").alias("key"))
    sizes = work.table(members.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key", "n"), "buckets")
    crowd = work.table(members.join(sizes, "key").select("doc_id", "key", "n"), "crowd")
    # a document that meets many others over all its bands is near the middle of its family
    central = crowd.groupBy("doc_id").agg((F.sum("n") + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)).alias("weight"))
    weighed = work.table(crowd.join(central, "doc_id").select("doc_id", "key", "weight"), "weighed")
    pivots = work.table(weighed.groupBy("key").agg(F.max_by("doc_id", "weight").alias("pivot")), "pivots")
    shared = work.table(weighed.select("doc_id", "key").join(pivots, "key"), "shared")
    pairs = work.table(shared.where("doc_id <> pivot").select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct(), "pairs")
    links = _links(work, docs, signed, pairs, size, num, den)
    found = components(work, links)

    found, rest, sure = _rest(work, docs, weighed, pivots, found, size, num, den)
    more = rest and _links(work, docs, signed, work.table(rest.join(pairs, ["a", "b"], "left_anti"), "rest"), size, num, den).unionByName(sure)
    if more and not more.isEmpty():
        star = found.where("doc_id <> component").select(F.col("component").alias("a"), F.col("doc_id").alias("b"))
        found = components(work, star.union(more))
    return (
        base.join(found.withColumnRenamed("doc_id", "class_id"), "class_id", "left")
        .select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component, the one of the smallest doc_id; all columns stay.

    Of rows that repeat a doc_id one stays; rows without an id all stay.
    """
    gone = Work(docs.sparkSession, "near-dup-gone").table(near_duplicates(docs, **options).where("not kept").select("doc_id").distinct(), "gone")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    named = docs.where("doc_id is not null")
    if named.select("doc_id").distinct().count() < named.count():
        left = left.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.where("doc_id is null"))
    return left


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), num=85).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
