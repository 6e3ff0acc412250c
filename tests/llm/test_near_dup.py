import random
import re

import pytest

from casewright.llm import near_dup
from casewright.llm.near_dup import near_duplicates, op1_near_duplicates

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, num):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= num * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(x), find(i)) for i, x in sets)


def test_whole_table_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op1_near_duplicates(spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_short_texts_nulls_and_extra_columns(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = rnd.choices(words, k=120)
    rows, now = [(7, None), (8, ""), (9, " \n "), (10, "a b"), (11, "A  b"), (12, "a b c")], list(base)
    for i in range(40):
        now = list(now)
        now[rnd.randrange(len(now))] = rnd.choice(words)
        rows.append((100 + i, " ".join(now)))
    for i in range(20):
        one = list(base)
        for _ in range(rnd.randrange(1, 5)):
            one[rnd.randrange(len(one))] = rnd.choice(words)
        rows.append((200 - i, " ".join(one)))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bands string, component long")
    for num in (80, 85):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, num=num).collect())
        assert got == brute(rows, num)


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "z")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


def family(n, least, most, seed):
    """n texts of 300 words that replace `least` to `most` words of one text each, and texts far from all of them."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(n):
        one = list(base)
        for k in rnd.sample(range(300), rnd.randint(least, most)):
            one[k] = f"x{rnd.randrange(10**6)}"
        rows.append((n - i, " ".join(one)))
    return rows


def tables_of(monkeypatch):
    """Rows of every working table by its name."""
    rows, plain = {}, near_dup.Work.table

    def table(self, df, name):
        out = plain(self, df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dup.Work, "table", table)
    return rows


@pytest.mark.parametrize("n, least, most", [(150, 6, 9), (600, 6, 9), (300, 1, 12)])
def test_rows_of_a_family_are_in_proportion_to_its_size(spark, monkeypatch, n, least, most):
    rows, at = family(n, least, most, n), tables_of(monkeypatch)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, num=85).collect())
    assert got == brute(rows, 85)
    # a document meets one pivot for each of its bands and rounds at most, and hardly anything else
    assert all(at[t] <= near_dup.BANDS * n for t in ("pairs", "near", "open-pairs", "related")) and at.get("rest", 0) <= 2 * n, at


def test_two_families_that_share_buckets_and_a_chain(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    common, rows = rnd.choices(words, k=120), []
    for f in range(3):
        base = common + rnd.choices(words, k=160)
        for i in range(60):
            one = list(base)
            for k in rnd.sample(range(280), rnd.randint(0, 9)):
                one[k] = rnd.choice(words)
            rows.append((1000 - 100 * f - i, " ".join(one)))
    now = list(base)
    for i in range(60):
        now[rnd.randrange(280)] = rnd.choice(words)
        rows.append((2000 + i, " ".join(now)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for num in (80, 85):
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, num=num).collect()) == brute(rows, num)


def test_rows_without_an_id_are_linked_with_nothing(spark):
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (None, "other words"), (2, "a b c d e f"), (3, "word " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (None, 1, None, True), (None, 2, None, True)]
    left = near_dup.drop_near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.text[:5]) for r in left) == [(0, "a b c"), (0, "other"), (1, "a b c"), (3, "word ")]


def variants(n, places, variants_of, chosen, seed):
    """n texts of 300 words that each replace some of the same places, each by one of a few words."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    at = rnd.sample(range(300), places)
    rows = []
    for i in range(n):
        one = list(base)
        for k in rnd.sample(at, chosen):
            one[k] = f"v{k}-{rnd.randrange(variants_of)}"
        rows.append((n - i, " ".join(one)))
    return rows


@pytest.mark.parametrize("n, places, kinds, chosen", [(200, 24, 1, 10), (400, 24, 1, 10), (300, 16, 2, 8)])
def test_families_that_share_their_differences_make_no_pairs(spark, monkeypatch, n, places, kinds, chosen):
    rows, at = variants(n, places, kinds, chosen, n), tables_of(monkeypatch)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, num=85).collect())
    assert got == brute(rows, 85)
    linear = sum(at.get(t, 0) for t in ("pairs", "near", "open-pairs", "related", "rest", "crowds", "crowd-blocks"))
    assert linear <= 200 * n and at.get("rest", 0) <= 16 * n, at


def test_crowds_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 2000)
    monkeypatch.setattr(near_dup, "MEETINGS", 0)
    rows = variants(120, 14, 1, 7, 1) + [(1000 + i, t) for i, t in family(60, 4, 8, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, num=85).collect()) == brute(rows, 85)
