"""Registered queries read whole texts and all rows, on small tables whose facts stand late in a text."""

import pytest

from casewright.plans.registry import QUERIES

LATE = "plain words " * 50 + "\nPublic Interest: none was shown by any side in this matter.\nPenalty: Smt. Lata Late, Raipur Water Board, Section 24, 1) roads of the town; and so on."


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of given tables with these documents; doc_id, text."""

    def write(rows):
        docs = [(k, text, "en", "web", len(text)) for k, text in rows]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def test_decision_queries_read_the_whole_text(spark, tables):
    sf = tables([(4, LATE)])
    rows = lambda name: QUERIES[name](spark, sf).collect()
    assert any(r.section == "PUBLIC_INTEREST" and r.start > len("plain words " * 50) for r in rows("g1_find_boundaries"))
    assert any(r.section == "PUBLIC_INTEREST" for r in rows("g2_resolve_boundaries"))
    for name in ("g3_slice_sections", "g7_augment_sections"):
        assert any(r.section == "PENALTY" and "Lata Late" in r.text for r in rows(name)), name
    assert any("Lata Late" in str(r) for r in rows("g9_labelled_blocks"))
    assert rows("e4_section_citations")[0].cited == ["24", "8(1)(j)", "10"]
    assert rows("e8_classify_outcome")[0].by_document == "PENALTY"
    assert any("Lata Late" in p for p in rows("e13_entities")[0].people)
    assert rows("e11_requested_items")[0]["items"] == ["roads of the town"]
    assert "roads of the town" in rows("e14_precedent_summary")[0].precedent
    for name in ("c4_synthetic_chunks", "c5_summary_chunk"):
        assert any("roads of the town" in r.text for r in rows(name)), name
    assert rows("c6_chunk_metadata")[0].rti_sections == "24, 8(1)(j), 10"


def test_tokens_of_every_document(spark, tables):
    sf = tables([(n, "w " * n) for n in (1, 5, 10, 15, 25)])
    assert {r.doc_id: r.tokens for r in QUERIES["c2_approx_tokens_all"](spark, sf).collect()} == {1: 1, 5: 6, 10: 13, 15: 20, 25: 32}


def test_words_between_rare_and_known_are_corrected(spark, tables):
    sf = tables([(1, "report " * 40), (2, "reporq " * 5 + "repott")])
    got = {r.word: (r.term, r.accepted) for r in QUERIES["t16_spell_candidates_all"](spark, sf).collect()}
    assert got == {"reporq": ("report", True), "repott": ("report", True)}
    texts = {r.doc_id: r.text for r in QUERIES["t17_apply_corrections"](spark, sf).collect()}
    assert set(texts[2].split()) == {"report"}


def test_fields_and_evidence_of_every_document(spark, tables):
    sf = tables([(7, "a"), (8, "b"), (27, "c")])
    spark.createDataFrame([(7, "q"), (8, "q"), (21, "q")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert {r.doc_id for r in QUERIES["t5_critical_fields_all"](spark, sf).collect()} == {7, 8, 27}
    got = {r.query_id: (r.confidence, len(r.sources)) for r in QUERIES["r18_evidence_confidence_all"](spark, sf).collect()}
    assert got == {7: (0.6, 2), 8: (0.525, 1), 21: (0.25, 0)}


def test_references_and_scripts_of_whole_texts(spark, tables):
    sf = tables([(3, "word " * 40 + "सूचना " * 80), (7, "word " * 200 + "the Bombay High Court, Notification No. 7/2021 ")])
    got = {r.doc_id: (r.courts, r.circulars) for r in QUERIES["e12_references"](spark, sf).collect()}
    assert got[3] == (["High Court of Delhi"], ["Circular No. 5/2020"])
    assert got[7] == (["High Court of Delhi", "Bombay High Court"], ["Circular No. 5/2020", "Notification No. 7/2021"])
    assert {r.doc_id: (r.a, r.b, r.c) for r in QUERIES["t15_detect_script_all"](spark, sf).collect()} == {3: ("hi", "hi", "hindi"), 7: ("en", "en", "english")}
