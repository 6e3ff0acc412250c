import tempfile
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casewright.llm import packing, token_files
from casewright.llm.tokenizing import Encoder

SF = "/root/testdata/sf0.001"
ODD = ["", None, "  a  b \n\n c\r\n d \t", "don't I'LL 'S x's", "naïve—dash “q” … x,y.z!?(a)b", "<|endoftext|> x <|ENDOFTEXT|>", "a1 2b 33 4.5,6", "  ", "\n\n\n", "あ テキスト。English混", "é á, .́x", "a  b  c", "x\x1cy", "İI K"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ODD
    whole = Tokenizer.from_file(path)
    for rows in (texts, *([t] for t in ODD)):
        ids, bounds = Encoder(path).rows(pa.array(rows, pa.string()))
        for k, t in enumerate(rows):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 63, 64, 1000, 70_001, 600_000])
def test_blocks_round_trip_from_every_checkpoint(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.zipf(1.3, n), 40_000).astype(np.uint32)
    found, counts = np.unique(ids, return_counts=True)
    freq = token_files.scale_counts(dict(zip(found.tolist(), counts.tolist(), strict=True)))
    assert sum(freq.values()) == 1 << token_files.BITS and min(freq.values()) > 0
    table = token_files.Table(np.array(list(freq)), np.array(list(freq.values())))
    payload = token_files.encode_block(ids, table)
    assert (token_files.decode_block(payload, table) == ids).all()
    lanes = max(1, min(token_files.LANES, n // 64))
    for k in range(1, -(-n // lanes) // token_files.CHECK + 1):
        if k * token_files.CHECK * lanes < n:
            assert (token_files.decode_block(payload, table, k) == ids[k * token_files.CHECK * lanes :]).all()


def want_rows(rows, name, end):
    whole, start, out = Tokenizer.from_file(public_tokenizers.path(name)), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, start, ids))
        start += len(ids)
    return out


def test_token_files_of_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.op2_token_files(spark, SF).collect())
    assert got == [(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, s, x in want_rows(rows, "word_bpe_49k.json", 2)]


def test_token_files_of_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "again")]
    for some in (rows, []):
        df = spark.createDataFrame([(*r, 1) for r in some], "doc_id long, text string, part long")
        paths = token_files.write_token_files(df, tempfile.mkdtemp(prefix="spark-") + "/t", public_tokenizers.path("word_bpe_49k.json"), 2)
        got = sorted((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read_token_files(spark, *paths).collect())
        assert [(i, len(x)) for i, _, x in got] == [(i, len(x)) for i, _, x in want_rows(some, "word_bpe_49k.json", 2)]
        assert sum(len(x) for *_, x in got) == (got[-1][1] + len(got[-1][2]) if got else 0)


def test_rows_without_an_id_and_a_very_long_text(spark):
    rows = [(None, "no id"), (None, None), (4, "word " * 300_000), (-2**63, "least"), (2**63 - 1, "last"), (None, "also none")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, doc_ids string")
    paths = token_files.write_token_files(df, tempfile.mkdtemp(prefix="spark-") + "/t", public_tokenizers.path("word_bpe_49k.json"), 2)
    got = sorted(((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read_token_files(spark, *paths).collect()), key=lambda r: r[1])
    named = [(i, x) for i, _, x in want_rows([r for r in rows if r[0] is not None], "word_bpe_49k.json", 2)]
    unnamed = [x for _, _, x in want_rows([(0, t) for i, t in rows if i is None], "word_bpe_49k.json", 2)]
    assert [i for i, *_ in got[:3]] == [None] * 3 and sorted(x for *_, x in got[:3]) == sorted(unnamed) and [(i, x) for i, _, x in got[3:]] == named
    assert [s for _, s, _ in got] == [sum(len(x) for *_, x in got[:k]) for k in range(len(got))]
    pieces = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    check_packing([r for r in rows if r[0] is not None], [r for r in pieces if r.doc_id is not None], 2048, 0, gapless=False)
    assert sum(r.doc_id is None for r in pieces) == 3
    places = defaultdict(list)
    for r in pieces:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(o == sum(n for p, n in x if p < o) for x in places.values() for o, _ in x)


def check_packing(rows, got, capacity, end, gapless=True):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, end] for i, t in rows}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == capacity for r in pieces[1:]) and sum(r.length for r in pieces) == len(ids[i])
        for r in pieces:
            assert zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at or not gapless
            at = offset + length
        assert at <= capacity
    return len(by_bin), -(-sum(map(len, ids.values())) // capacity)


def test_packing_of_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bins, least = check_packing(rows, packing.op6_packing(spark, SF).collect(), 2048, 0)
    assert bins <= least + 1


def test_packing_of_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(k, t) for k, t in enumerate(ODD)] + [(50, "a b c d e f g h i j k l m n o p q r s t u v w x y z")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, length long, part string")
    check_packing(rows, packing.pack(df, path, capacity=10).collect(), 10, 0)
    assert packing.pack(df.limit(0), path).count() == 0


def fewest(sizes, capacity):
    best = [len(sizes)]

    def go(rest, rooms):
        if len(rooms) >= best[0]:
            return
        if not rest:
            best[0] = len(rooms)
            return
        s, seen = rest[0], set()
        for k, room in enumerate(rooms):
            if room >= s and room not in seen:
                seen.add(room)
                go(rest[1:], [*rooms[:k], room - s, *rooms[k + 1 :]])
        go(rest[1:], [*rooms, capacity - s])

    go(sorted(sizes, reverse=True), [])
    return best[0]


def test_fixed_bins_belong_to_a_best_packing():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        sizes = rnd.integers(1, 21, rnd.integers(1, 9)).tolist()
        count = {s: sizes.count(s) for s in sizes}
        fixed = packing.dominating_sets(count, 20)
        left = [s for s, n in count.items() for _ in range(n)]
        assert all(sum(p) <= 20 for p, _ in fixed)
        assert sum(n for _, n in fixed) + fewest(left, 20) == fewest(sizes, 20)
