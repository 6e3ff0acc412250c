import re
import tempfile
from collections import defaultdict

import corpus_pipeline
from casewright.llm import quality
from tests.llm.test_near_dup import brute as components
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def cut(rows, span=50):
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - span + 1):
            first[b[k : k + span]] = min(i, first.get(b[k : k + span], i))
    out = {}
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - span + 1):
            if first[b[k : k + span]] < i:
                gone[k : k + span] = [True] * span
        text, at = "", 0
        for c in b.decode():
            n = len(c.encode())
            text += "" if all(gone[at : at + n]) else c
            at += n
        out[i] = text
    return out


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(ws, n):
    return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}


def clean(text, items):
    ws = words(text)
    return not any(w and grams(w, min(10, len(w))) & grams(ws, min(10, len(w))) for w in items)


def test_every_stage_equals_its_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, folder = docs.columns, tempfile.mkdtemp(prefix="spark-")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert docs.columns == names
            after[name] = {r.doc_id: r.text for r in docs.collect()}
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    scores = {r.doc_id: r.score for r in quality.op8_quality(spark, SF).collect()}
    assert after["quality"] == {i: t for i, t in start.items() if scores[i] >= quality.CUT}
    kept = {i for i, _, c in components(sorted(after["quality"].items()), 80) if i == c}
    assert after["near_duplicates"] == {i: after["quality"][i] for i in kept}
    assert after["substrings"] == cut(sorted(after["near_duplicates"].items()))
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert after["decontaminate"] == {i: t for i, t in after["substrings"].items() if clean(t, items)}
    bins, least = check_packing(list(after["decontaminate"].items()), docs.collect(), 2048, 0)
    assert bins <= least + 1
    whole = defaultdict(set)
    for r in corpus_pipeline.run(spark, SF).collect():
        whole[r.doc_id].add((r.piece, r.start, r.length, r.ids_crc32))
    again = defaultdict(set)
    for r in docs.collect():
        again[r.doc_id].add((r.piece, r.start, r.length, r.ids_crc32))
    assert whole == again


def test_stages_on_odd_rows(spark):
    """Nulls, repeated ids with other texts, rows without an id, clashing columns, and an empty table, stage by stage."""
    good = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 2000").orderBy("doc_id").limit(12).collect()]
    rows = [*good, (None, good[0][1]), (None, good[3][1][:1500] + " tail"), (good[0][0], good[5][1][::-1]), (900_001, None), (900_002, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _score double, _row string, kept boolean, component int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x", None, 1) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns, name
        got = out.collect()
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({i for i, _ in rows if i is not None})
            assert sum(r.doc_id is None for r in got) == 2
        elif name == "substrings":
            assert len(got) == len(rows)
            texts = {r.doc_id: r.text for r in got if r.doc_id in (900_001, 900_002)}
            assert texts == {900_001: None, 900_002: ""}
            # rows without an id come after all others, so a copy of a named text goes whole
            assert min(len(r.text) for r in got if r.doc_id is None) == 0
            assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
        elif name == "decontaminate":
            assert {900_001, 900_002} <= {r.doc_id for r in got}
        elif name == "packing":
            assert {r.doc_id for r in got} == {i for i, _ in rows}
