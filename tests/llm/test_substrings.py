import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from casewright.llm import substrings

SF = "/root/testdata/sf0.001"


def brute(rows, span=50):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - span + 1):
            s = b[k : k + span]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if first[b[k : k + span]] < i:
                gone[k : k + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_suffix_ranks_order_all_suffixes():
    rnd = np.random.default_rng(1)
    for n in [*range(0, 12), 50, 301, 1000]:
        for letters in (1, 2, 4, 200):
            s = rnd.integers(1, letters + 1, n)
            if n:
                s[rnd.integers(0, n, n // 7)] = 0
                s[-1] = letters
            want = np.empty(n, int)
            order = sorted(range(n), key=lambda i: s[i:].tolist())
            want[order] = np.arange(n)
            assert (np.argsort(np.argsort(substrings.suffix_ranks(s, 10**6))) == want).all()


def test_whole_table_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(substrings.op3_substrings(spark, SF)) == brute(rows)


def test_overlaps_edges_and_odd_rows(spark):
    rnd = random.Random(2)
    passage = ["".join(rnd.choices("abé \n", k=rnd.randrange(45, 160))) for _ in range(8)]
    rows = [(5, None), (6, ""), (7, "x" * 49), (8, "x" * 49), (9, "x" * 400), (2, "y" * 50), (3, "y" * 51), (4, "ab" * 80), (1, "ba" * 60)]
    for i in range(40):
        text = "".join(rnd.choice(passage)[rnd.randrange(3) :] + "".join(rnd.choices("cdef", k=rnd.randrange(4))) for _ in range(rnd.randrange(5)))
        rows.append((100 - i, text))
    rows += [(100, rows[-1][1]), (100, rows[-1][1])]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, pack int, kept string")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    assert got(substrings.cut_repeats(df, out)) == brute(rows)
    assert got(substrings.cut_repeats(df.limit(0), out)) == []
    cut = substrings.remove_repeats(df)
    assert cut.columns == df.columns and cut.count() == len(rows)
    assert cut.where("text is null").count() == 1 and {r.kept for r in cut.collect()} == {"k"}
    assert not any("�" in (r.text or "") for r in cut.collect())


def texts_with_a_common_phrase(n, seed):
    rnd = random.Random(seed)
    letters, phrase = "abcdefghij é", "this phrase of forty bytes is everywhere"
    passages = ["".join(rnd.choices(letters, k=80)) for _ in range(10)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(letters) * rnd.randrange(3) + phrase + rnd.choice(letters), rnd.choice(passages), "".join(rnd.choices(letters, k=90)), phrase]
        rows.append((n - i if i % 5 else None, "".join(rnd.sample(parts, rnd.randint(2, 4)))))
    return rows


def brute_with_nulls(rows):
    # a row without an id comes after all others
    placed = [(2**63 - 1 if i is None else i, t) for i, t in rows]
    return [(None if r[0] == 2**63 - 1 else r[0], *r[1:]) for r in brute(placed)]


@pytest.mark.parametrize("hot", [8, 1 << 16])
def test_many_packs_hot_grams_and_rows_without_an_id(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "PACK_BYTES", 3000)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 5000)
    monkeypatch.setattr(substrings, "SORT_BYTES", 400)
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = texts_with_a_common_phrase(150, 4) + [(3, "z" * 60_000), (2**53 + 1, "y" * 70), (2**53 + 2, "y" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    assert sorted(map(str, got_rows(substrings.cut_repeats(df, out)))) == sorted(map(str, brute_with_nulls(rows)))


def got_rows(df):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()]


def test_shuffled_rows_are_packs_times_buckets_at_most(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PACK_BYTES", 20_000)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 80_000)
    made, plain = {}, substrings.Work.table

    def table(self, df, name):
        out = plain(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(substrings.Work, "table", table)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = sum(len((r.text or "").encode()) for r in docs.collect())
    packs, buckets = -(-size // 20_000), -(-size // 80_000)
    assert substrings.op3_substrings(spark, SF).count() == docs.count()
    assert made["grams"] <= packs * buckets and made["answers"] <= 2 * packs * buckets


def test_a_pack_is_cut_in_little_memory():
    rnd = np.random.default_rng(5)
    text = bytes(rnd.integers(97, 123, 1 << 20).astype(np.uint8))
    docs = pa.table({"pack": pa.array([0, 0], pa.int32()), "place": pa.array([1, 2]), "text": pa.array([text, b"-" + text]), "doc_id": pa.array([1, 2])})
    pack = pa.Table.from_batches(list(substrings._chunk(["place", "text"], ["doc_id"])(docs.to_batches())))
    key = (pa.scalar(0, pa.int32()),)
    grams = substrings._answer_grams(substrings.HOT)(key, substrings._send_grams(1, 50)(key, pack))
    bits = substrings._sort_bucket(50)(key, substrings._send_neighbourhoods(1, 50)(key, pack, grams))
    answers = pa.concat_tables([grams, bits.select(["bucket", "pack", "bits"])], promote_options="default")
    schema = pa.schema([("doc_id", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    cut = substrings._cut(1, 50, ["doc_id"], schema, True)
    tracemalloc.start()
    out = cut(key, pack, answers).to_pydict()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (out["n_removed"], out["n_spans"], out["kept"]) == ([0, len(text)], [0, 1], [text, b"-"])
    assert most < 40 * len(text)  # 20 for each byte of the pack
