"""Spelling variants, toxicity and hard negatives against plain versions, and their odd cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from casewright.llm import decontaminate, hard_negatives, quality, spelling, substrings, toxicity
from casewright.llm.textblocks import text_bytes
from casewright.llm.work import Work

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, least_letters=6, least_count=5, every=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_letters and k >= least_count}


def brute_variants(words, ratio=5):
    by = defaultdict(set)
    for w in words:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[x].add(w)
    near = defaultdict(set)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    form = {}
    for w, k in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= ratio * k:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), k, len(near[w]), words[form[w]] if w in form else None) for w, k in words.items()), key=str)


def variant_rows(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


def test_spelling_of_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spelling.op11_spelling_variants(spark, SF)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert variant_rows(df) == brute_variants(brute_words(rows))


def test_words_with_nulls_accents_and_the_typing_rule(spark):
    rnd = random.Random(3)
    letters = "abABéÉ×ÿ"
    rows = [(k, " ".join("".join(rnd.choices(letters, k=rnd.randint(1, 8))) for _ in range(rnd.randint(0, 400)))) for k in range(30)]
    rows += [(None, rows[0][1]), (5, rows[5][1]), (40, None), (41, ""), (42, "ĀÃa€¿ 12 一"), (43, "ab" * 50_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    for every in (0, 3, 199):
        got = spelling.count_words(df, 3, 2, every).collect()
        assert {r.word: r.n for r in got} == brute_words(rows, 3, 2, every)
    assert spelling.count_words(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts, alphabet, longest, n", [(1, "ab", 7, 200), (5, "ab", 9, 400), (7, "abcéÿ", 5, 600), (9, "ab", 60, 150), (3, "a", 30, 30)])
def test_variants_of_crowded_words(spark, parts, alphabet, longest, n):
    rnd = random.Random(longest)
    words = {"".join(rnd.choices(alphabet, k=rnd.randint(1, longest))): rnd.choice([1, 1, 2, 5, 5, 25, 130, 700]) for _ in range(n)}
    words |= {"a" * k: 5**k for k in range(1, 9)}  # a chain of forms
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert variant_rows(spelling.variants(df, parts=parts)) == brute_variants(words)


def test_a_very_long_word_and_no_words(spark):
    words = {"a" * 30_000: 7, "a" * 30_001: 40, "b" + "a" * 30_000: 300}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.n: (r.root and len(r.root), r.n_near) for r in spelling.variants(df).collect()}
    assert got == {7: (30_001, 2), 40: (30_001, 2), 300: (30_001, 2)}
    assert spelling.variants(df.limit(0)).count() == 0


def brute_negatives(anchors, rows):
    def whole(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]

    live = [(i, y, e) for i, y, v in rows if i is not None and y is not None and (e := whole(v)) is not None]
    out = []
    for i, y, v in anchors:
        e = whole(v)
        if i is None or y is None or e is None:
            continue
        scored = sorted((-sum(a * b for a, b in zip(e, f, strict=False)), j, z) for j, z, f in live if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:5]:
            window = [(-t, k) for t, k, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, r, k, -s, t) for r, (t, k) in enumerate(window, 1)]
    return sorted(out)


def test_hard_negatives_with_nulls_ties_and_repeated_rows(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice([0, 1, -3]), [rnd.choice([-0.5, 0.25, 0.3]) for _ in range(rnd.choice([3, 3, 4]))]) for k in range(300)]
    rows += [(300, None, [1.0]), (301, 1, None), (302, 0, [float("nan")]), (303, 0, [1.0, None]), (None, 0, [9.0, 9.0]), (304, 1, []), rows[7], rows[100], (100, 1, [0.4, 0.4])]
    schema = "vec_id long, label int, embedding array<double>, block int, row string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    got = sorted(map(tuple, hard_negatives.mine(df.where("vec_id % 100 = 0"), df).collect()))
    assert got and got == brute_negatives([r for r in rows if r[0] is not None and r[0] % 100 == 0], rows)
    assert hard_negatives.mine(df.limit(0), df).count() == 0 == hard_negatives.mine(df, df.limit(0)).count()


def test_hard_negatives_of_components_beyond_31_bits(spark):
    rnd = random.Random(6)
    rows = [(k, k % 2, [rnd.choice([1e9, -3e8, 2.0**40, 0.5]) for _ in range(4)]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = brute_negatives(rows[:3], rows)
    clip = lambda x: x if abs(x) < 1 << 63 else None
    got = hard_negatives.mine(df.where("vec_id < 3"), df).collect()
    assert want and sorted(tuple(r)[:4] for r in got) == [w[:4] for w in want]
    assert {tuple(r) for r in got} == {(*w[:4], clip(w[4]), clip(w[5])) for w in want}


@pytest.mark.parametrize("dims, high", [(64, 160), (3000, 2**31 - 1), (1, 5), (0, 5), (5, 10**300)])
def test_residue_products_are_exact(dims, high):
    rnd = random.Random(dims)
    kind = np.int32 if high < 1 << 31 else object
    a, b = (np.array([[rnd.randint(-high, high) for _ in range(n)] for _ in range(dims)], kind).reshape(dims, n) for n in (4, 6))
    want = [[sum(int(a[d, i]) * int(b[d, j]) for d in range(dims)) for j in range(6)] for i in range(4)]
    assert hard_negatives.product(a, b).tolist() == want


def test_terms_against_plain_python():
    texts = ["Trash, trashy! éclairé a", "", None, "you IDIOT\nYou"]
    import pyarrow as pa

    row, h, kind, number = toxicity.term_hashes(*text_bytes(pa.array(texts)))
    want = Counter()
    for r, t in enumerate(texts):
        for w in re.findall(r"[a-z\x80-\U0010ffff]+", (t or "").translate(LOWER)):
            want[r, 0] += 1
            want[r, 1] += len(w) > 4
            want[r, 2] += len(w) > 5
    assert Counter(zip(row.tolist(), kind.tolist(), strict=True)) == +want
    assert h[(row == 0) & (kind == 1)][0] == h[(row == 0) & (kind == 1)][1]  # tras-h, tras-hy
    assert len(set(number[row == 3].tolist())) == 3


def test_label_model_finds_accuracies_and_correlations(spark):
    rnd = np.random.default_rng(1)
    n = 20_000
    y = rnd.random(n) < 0.2
    hit, miss = (0.8, 0.6, 0.5, 0.4), (0.05, 0.02, 0.1, 0.1)
    votes = [rnd.random(n) < np.where(y, a, b) for a, b in zip(hit, miss, strict=True)]
    votes.append(votes[0] ^ (rnd.random(n) < 0.02))  # nearly a copy of the first
    mask = sum(v.astype(np.int64) << k for k, v in enumerate(votes))
    known = np.where(np.arange(n) % 20 == 0, y, -1)
    df = spark.createDataFrame([(int(m), int(k)) for m, k in zip(mask, known, strict=True)], "votes long, y int").groupBy("votes", "y").count()
    model = toxicity.fit_labels(df, np.ones(5, bool))
    share = [y[v].mean() for v in votes]
    assert np.abs(model.accuracy - share).max() < 0.05
    assert abs(model.prior[1] - y.mean()) < 0.02
    assert {0, 4} in [{i, int(model.parent[i])} for i in range(5)] and model.correlation[:, 0, 4].min() > 0.6 and abs(model.correlation[1, 0, 1]) < 0.1
    p = model.posterior(mask)
    assert ((p > 0.5) == y).mean() > 0.93


def test_toxicity_of_held_out_labels(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(300)]
    bad = ["zornix", "zornup", "quarble"]
    rows, labels = [], []
    for k in range(1500):
        t, y = rnd.choices(words, k=rnd.randint(1, 150)), int(rnd.random() < 0.15)
        for _ in range(y * rnd.randint(1, 3)):
            t.insert(rnd.randrange(len(t) + 1), rnd.choice(bad))
        rows.append((k, " ".join(t)))
        if k % 2:
            labels.append((k, y))
    rows += [(2000, None), (2001, ""), (2001, "zornix"), (None, "quarble zornix")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _score string, votes int")
    own = spark.createDataFrame([*labels, (1, None), (5000, 1), (None, 1)], "doc_id long, toxic int")
    out, name = toxicity.classify(docs, own)
    assert name == "__score" and out.columns[:4] == docs.columns and out.count() == len(rows)
    got = {(r.doc_id, r.text): r[name] for r in out.collect()}
    truth = {k: any(w in bad for w in t.split()) for k, t in rows[:1500]}
    assert sum((got[k, t] >= toxicity.CUT) == truth[k] for k, t in rows[:1500]) >= 1485
    assert all(0 <= s <= 1 for s in got.values()) and got[2000, None] == got[2001, ""] < 0.5 < got[2001, "zornix"]
    assert toxicity.classify(docs.limit(0), own)[0].count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you stupid idiot, you moron"), (2, "a fine day"), (3, None)] * 5, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(2, 0)], "doc_id long, toxic int")
    for labels in (none, one):
        out, name = toxicity.classify(docs, labels)
        assert all(0 <= r[name] <= 1 for r in out.collect()) and out.count() == 15


def test_op12_returns_every_document(spark):
    out = toxicity.op12_toxicity(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)


def test_node_numbers_are_equal_for_equal_prefixes_alone(spark):
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choices("ab", k=rnd.randint(1, 12))) for _ in range(500)})
    df = spark.createDataFrame(list(enumerate(words)), "key long, word string")
    got = spelling.number_nodes(Work(spark, "test"), df, "nodes", 6).collect()
    of = {}
    for r in got:
        for k, node in enumerate(r.nodes, 1):
            assert of.setdefault(words[r.key][:k], node) == node
    assert len(set(of.values())) == len(of) and len(got) == len(words)


def test_item_ids_that_are_empty_beside_null(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([("", "one"), (None, "two"), ("a", "three")], "item_id string, text string")
    out, name = decontaminate.annotate(docs, items)
    assert {r.doc_id: r[name]["items"] for r in out.collect()} == {1: ["", "a", None], 2: []}


def test_quality_without_any_label(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    out, name = quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r[name] for r in out.collect()] == [0.5, 0.5]


def test_spans_that_do_not_fit_an_answer_are_refused(spark):
    docs = spark.createDataFrame([(1, "x" * 80), (2, "x" * 70)], "doc_id long, text string")
    for span in (32, 56):
        with pytest.raises(ValueError):
            substrings.remove_repeats(docs, span)
    for span in (33, 55):
        got = {r.doc_id: r.text for r in substrings.remove_repeats(docs, span, pack_bytes=64, bucket_bytes=64).collect()}
        assert got == {1: "x" * 80, 2: ""}
