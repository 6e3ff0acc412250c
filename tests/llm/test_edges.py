"""Nulls, empty and odd rows, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow as pa
import pytest

from casewright.llm import chat, decontaminate, quality, sharding, topk, url_filter
from casewright.llm.textblocks import text_bytes

SF = "/root/testdata/sf0.001"
TEXTS = [(1, "A b c d e f g h i j k"), (2, None), (3, ""), (4, "..."), (5, "x " * 5000 + "b c d e f g h i j k"), (6, "short"), (6, "short"), (7, "the b-c d e. F g h i j k l"), (8, "bb c d e f g h i j k")]
ITEMS = [(1, "b c d e f g h i j k"), (2, "short"), (3, None), (4, "!!"), (1, "b c d e f g h i j k"), (5, "c d e f g h i j k l m")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, "q") for r in rows], "doc_id long, text string, _match long, n_words string")


@pytest.mark.parametrize("slice_bytes", [1 << 20, 8])
def test_decontamination(spark, slice_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out, name = decontaminate.annotate(docs(spark, TEXTS), items, slice_bytes=slice_bytes)
    got = [(r.doc_id, r[name].n_words, r[name].n_hit, r[name].items, r[name].longest) for r in out.collect()]
    want = [(1, 11, 10, [1], 10), (2, 0, 0, [], 0), (3, 0, 0, [], 0), (4, 0, 0, [], 0), (5, 5010, 10, [1], 10), (6, 1, 1, [2], 1), (6, 1, 1, [2], 1), (7, 12, 11, [1, 5], 10), (8, 10, 0, [], 0)]
    assert sorted(got) == want
    kept = decontaminate.decontaminate(docs(spark, TEXTS), items, slice_bytes=slice_bytes)
    assert kept.columns == ["doc_id", "text", "_match", "n_words"] and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 8]
    assert decontaminate.decontaminate(docs(spark, []), items).count() == 0
    assert decontaminate.decontaminate(docs(spark, TEXTS), items.limit(0)).count() == len(TEXTS)


def brute_longest(text, items, window=10):
    w = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, best = w(text), (0, -1)
    for item in map(w, items):
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                    n += 1
                if n >= window or (n == len(item) and n):
                    best = max(best, (n, -i))
    return best[0], -best[1] if best[0] else -1


def test_longest_matches_over_blocks_slices_and_repeated_windows(spark):
    rnd = random.Random(8)
    x = "p q r s t u v w x y"
    items = [("a", f"A {x} A {x[::-1]}"), ("b", "a a a a a a a a a a a a a a a"), (None, "z z"), ("c", " ".join(rnd.choices("abc", k=60))), ("a", f"A {x} B")]
    rows = [(1, f"q A {x[::-1]} z"), (2, "a " * 40), (3, f"A {x} A {x[::-1]} B"), (4, "z z z"), (5, None)]
    rows += [(k, " ".join(rnd.choice([rnd.choice("abc"), items[3][1][2 * rnd.randrange(20) :]]) for _ in range(6))) for k in range(10, 40)]
    df = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], "doc_id long, text string, _match_0 int, _mask_0 int, row string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for slice_bytes, block_bytes in ((1 << 20, 1 << 20), (30, 200)):
        out, name = decontaminate.annotate(df, bench, slice_bytes=slice_bytes, block_bytes=block_bytes)
        got = {r.doc_id: (r[name].longest, r[name].longest_at) for r in out.collect()}
        assert got == {i: brute_longest(t, [u for _, u in items]) for i, t in rows}
        assert {r.doc_id: r[name]["items"] for r in out.where("doc_id < 5").collect()} == {1: ["a"], 2: ["b"], 3: ["a"], 4: [None]}


def test_word_suffix_arrays_hold_all_suffixes_in_order():
    rnd = random.Random(3)
    for n in (0, 1, 7, 60, 300):
        words = [rnd.choice([0, 1, 1, 2, 3]) for _ in range(n)] + [0, 0, 0]
        import numpy as np

        order, _, _ = decontaminate.suffix_array(np.array(words, np.int64), 1 << 20)
        assert sorted(order.tolist()) == [k for k, w in enumerate(words) if w]
        cut = lambda k: words[k : words.index(0, k)] if 0 in words[k:] else words[k:]
        texts = [cut(k) for k in order.tolist()]
        assert texts == sorted(texts)


def test_perspectives(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be kind", 1), (1, 1, "ann", "hi", 1), (1, 2, "bob", None, 1), (1, 3, "ann", "bye", 1), (2, None, None, "x", 1), (2, None, None, "x", 1), (3, 0, "system", "alone", 1)], "conv_id long, turn long, role string, text string, start long")
    by = defaultdict(list)
    for r in chat.rotate_perspectives(turns).collect():
        by[r.conv_id, r.perspective].append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (2, "unknown")}
    for rows in by.values():
        rows.sort(key=lambda r: r.position)
        text = "".join(r.segment for r in rows)
        assert [r.position for r in rows] == list(range(len(rows)))
        for r in rows:
            assert text[r.start : r.stop] == r.segment
            assert (r.mask_start is not None) == (r.speaker == r.perspective)
            if r.mask_start is not None:
                assert text[r.mask_start : r.mask_stop].endswith("<|im_end|>")
    assert "".join(r.segment for r in by[1, "ann"]) == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n"
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0


def brute_topk(rows, queries, k):
    whole = lambda e: [math.floor(256 * Fraction(x)) for x in e]
    ok = [(i, whole(e)) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = Counter()
    for q, a in ok:
        if q in queries:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)[:k]
            out.update((q, n + 1, i, -s if -(1 << 63) <= -s < 1 << 63 else None) for n, (s, i) in enumerate(scored))
    return out


def test_topk_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, [0.5, -0.25, 9.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf]), (6, [None, 1.0]), (7, []), (8, [1e30, -1e30]), (9, [0.001]), (100, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, g int")
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df.where("vec_id % 50 = 0"), df, 5, 3).collect())
    assert got == brute_topk(rows, {0, 50, 100}, 5)
    assert topk.search(df.limit(0), df).count() == 0 and topk.search(df, df.limit(0)).count() == 0


def test_topk_has_no_bound(spark):
    rows = [(0, [2e6, 1.0]), (1, [4e6, 0.0]), (2, [5e6, 0.0]), (3, [2.0**40, -3.5]), (4, [-1e300, 7.0]), (5, [1e300, 7.0]), (6, [1e300, 7.5]), (50, [1e305, -1e305]), (100, [1.5, -2.0]), (7, [0.1, 0.2]), (8, [5e307, 1.0])]
    df = spark.createDataFrame([*rows, (None, [9e9, 1.0])], "vec_id long, embedding array<double>")
    got = topk.search(df.where("vec_id % 50 = 0"), df, 5, 2).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_topk(rows, {0, 50, 100}, 5)
    two = spark.createDataFrame([(0, [2e6]), (1, [4e6]), (2, [5e6])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(two.where("vec_id = 0"), two).orderBy("rank").collect()] == [(2, 655360000000000000), (1, 524288000000000000)]


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(7, "same", 1)] * 40 + [(None, None, 2)] * 30 + [(None, f"t{k % 5}", 3) for k in range(30)] + [(k, "x" * k, k) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    sharding.write_shards(df, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert Counter((r.doc_id, r.text, r._shard) for r in back) == Counter(rows)
    sizes = Counter(r.shard for r in back)
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 1


def test_a_rare_class_of_urls_is_in_the_sample(spark):
    pages = [(k, f"http://site{k}.com/{k}") for k in range(3000)] + [(5000, "http://x.net/es/1"), (5001, "http://free.org/")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), train_rows=50).collect()}
    assert got[5000].verdict == "block" and got[5001].rule is None and got[5001].block_score is not None and len(got) == 3002


def test_shards(spark):
    rows = [(k, f"text {k}" * (k % 7)) for k in range(1000)] + [(5, "again"), (5, "again"), (2000, None), (None, "no id")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, shard long")
    got = sharding.assign_shards(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == 16 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.assign_shards(df.limit(0)).count() == 0


def test_ring_plan_equals_placing_one_key_after_the_other():
    counts = {c: (c * 7919) % 5 for c in range(0, sharding.CELLS, 3)}
    shards, spots = 7, sharding.ring(7)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    home = {c: next((k for k, (cell, _) in enumerate(spots) if cell >= c), 0) for c in counts}
    placed, late = Counter(), []
    for c in sorted(counts):
        for _ in range(counts[c]):
            s = spots[home[c]][1]
            if room[s]:
                room[s] -= 1
                placed[c, s] += 1
            else:
                late.append(c)
    moved = 0
    for c in late:
        k = home[c]
        while not room[spots[k % len(spots)][1]]:
            k += 1
        s = spots[k % len(spots)][1]
        room[s] -= 1
        placed[c, s] += 1
        moved += 1
    got = Counter()
    for cell, _, n, s, _ in sharding.ring_plan(counts, shards):
        got[cell, s] += n
    assert got == placed and moved < total / 3


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_over_a_whole_table_and_odd_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = [None, "", "no scheme", "http://", "http://EXAMPLE.com", "http://example.com/en/x?y#z", "http://www.example.com/en/1", "http://a.www.example.com/en/1", "http://net/es/", "http://x.net/es", "http://notexample.com/en/", "a://b://c.net/fr/?q", "http://x.net?/es/", "http://É.com/\n/en/"]
    rows = pages.unionByName(spark.createDataFrame([(10_000 + k, u) for k, u in enumerate(odd)], "page_id long, url string"))
    got = {r.page_id: r for r in url_filter.judge(rows).collect()}
    urls = {r.page_id: r.url for r in rows.collect()}
    assert set(got) == set(urls)
    for i, u in urls.items():
        host, path, rule, verdict = rule_of(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")
    assert url_filter.judge(rows.limit(0)).count() == 0
    one = url_filter.judge(spark.createDataFrame([(1, "http://a.com/"), (2, "http://b.org/")], "page_id long, url string")).collect()
    assert {r.verdict for r in one} == {"allow"}


def test_quality_holds_out_a_fifth_and_tells_junk_from_prose(spark):
    rows = {r.doc_id: r for r in quality.op8_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    held = [i for i in labels if rows[i].held_out]
    assert sum(rows[i].predicted == labels[i] for i in held) / len(held) > 0.9


def plain_statistics(text):
    """The statistics of one text, one after the other."""
    raw = (text or "").encode()
    kind = lambda c: "line" if c == 10 else "space" if c == 32 or 9 <= c <= 13 else "upper" if 65 <= c <= 90 else "digit" if 48 <= c <= 57 else "stop" if chr(c) in ",.!?:;'\"-" else "letter" if 97 <= c <= 122 or c >= 128 else "mark"
    kinds = Counter(map(kind, raw))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n, size = max(1, len(words)), max(1, len(raw))
    mean = sum(map(len, words)) / n
    pairs = list(zip(words, words[1:], strict=False))
    counts = [len(raw), len(set(words)) / math.sqrt(n), len(words)]
    spread = math.sqrt(max(0, sum(len(w) ** 2 for w in words) / n - mean**2))
    shares = [kinds[k] / size for k in ("upper", "digit", "stop", "mark", "space", "line")] + [sum(c >= 128 for c in raw) / size]
    repeats = [1 - len(set(words)) / n, max(Counter(words).values(), default=0) / n, 1 - len(set(pairs)) / len(pairs) if pairs else 0, sum(a == b for a, b in pairs) / n, 1 - len(set(lines)) / len(lines) if lines else 0, len(lines) / n]
    a, b = lambda x: math.log1p(x), lambda x: math.log(x + 1e-3)
    return [a(counts[0]), a(mean), a(spread), *map(b, shares), *map(b, repeats), a(counts[1]), a(counts[2])]


def test_quality_equals_a_plain_discriminant(spark):
    import numpy as np

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    x = {i: np.round(np.array(plain_statistics(t)) * 4096) / 4096 for i, t in texts.items()}
    assert all(np.allclose(quality.statistics(*text_bytes(pa.array([t])))[0], x[i], atol=1 / 4000) for i, t in texts.items())
    train = [i for i in texts if i in labels and zlib.crc32(str(i).encode()) % 5]
    density = {}
    for y in (0, 1):
        own = np.array([x[i] for i in train if labels[i] == y])
        cov = np.cov(own.T, bias=True)
        cov = (1 - quality.SHRINK) * cov + quality.SHRINK * np.diag(np.maximum(np.diag(cov), 1e-6)) + 1e-4 * np.eye(len(cov))
        inverse, logdet, mean, prior = np.linalg.inv(cov), np.linalg.slogdet(cov)[1], own.mean(axis=0), math.log(len(own) / len(train))
        density[y] = lambda v, inverse=inverse, logdet=logdet, mean=mean, prior=prior: prior - 0.5 * logdet - 0.5 * (v - mean) @ inverse @ (v - mean)
    z = {i: math.asinh(density[1](v) - density[0](v)) for i, v in x.items()}
    grid, best = [round(min(200, max(-200, z[i] * 16))) / 16 for i in train], (1.0, 0.0)
    for _ in range(200):  # the logistic fit by Newton steps on single rows
        p = [1 / (1 + math.exp(-(best[0] * v + best[1]))) for v in grid]
        g = np.array([sum((labels[i] - q) * v for i, q, v in zip(train, p, grid, strict=True)) - 1e-3 * (best[0] - 1), sum(labels[i] - q for i, q in zip(train, p, strict=True)) - 1e-3 * best[1]])
        w = np.array([q * (1 - q) for q in p])
        v = np.array(grid)
        m = np.array([[(w * v * v).sum(), (w * v).sum()], [(w * v).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(m, g)
        best = tuple(np.array(best) + step * min(1.0, 0.5 / max(abs(step).max(), 1e-12)))
    got = {r.doc_id: r.score for r in quality.op8_quality(spark, SF).collect()}
    assert set(got) == set(texts)
    assert all(abs(got[i] - 1 / (1 + math.exp(-max(-40, min(40, best[0] * z[i] + best[1]))))) < 0.02 for i in texts)
    docs_scored, score = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id: r[score] for r in docs_scored.collect()} == got


def test_quality_of_odd_rows(spark):
    df = docs(spark, TEXTS + [(None, "z"), (9, "word " * 300)])
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 1), (9, 0), (77, 1), (8, None)], "doc_id long, quality int")
    out, score = quality.classify(df, labels)
    got = out.collect()
    assert len(got) == len(TEXTS) + 2 and all(0 <= r[score] <= 1 for r in got)
    assert quality.classify(df.limit(0), labels)[0].count() == 0
    odd = spark.createDataFrame([(k, f"some words here {k} and there", 0.5, "x", [1.0]) for k in range(20)] + [(99, "w " * 700_000, 0.1, "y", None)], "doc_id long, text string, _score double, _statistics string, x array<double>")
    out, score = quality.classify(odd, spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int"))
    assert score not in odd.columns and out.columns[:5] == odd.columns and all(0 <= r[score] <= 1 for r in out.collect()) and out.count() == 21
    out, score = quality.classify(df, labels.limit(0))
    assert out.count() == len(TEXTS) + 2
    x = quality.statistics(*__import__("casewright.llm.textblocks", fromlist=["x"]).text_bytes(pa.array(["", None, "a"])))
    assert x.shape == (3, quality.FEATURES) and (x[0] == x[1]).all()


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
