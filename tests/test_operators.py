"""Cases with known results, as small tables."""

import random
from datetime import date

from pyspark.sql import functions as F

from casewright.functions import text as tx
from casewright.operators import audit, cases, chunking, cleaning, extraction, jobs, ocr_tables, retrieval, routing, segmentation
from casewright.sources import readers
from casewright.streaming import index_stream

DECISION = """CENTRAL INFORMATION COMMISSION
File No: CIC/MFINB/A/2024/001234
Date of Decision: 05.04.2025
Appellant: Shri Ram Kumar
Respondent: CPIO, Ministry of Finance
Background:
The appellant filed an RTI application.
RTI Application:
Copies of file notings were requested.
CPIO Reply: Information was denied under Section 8(1)(j).
Commission's Findings:
The Commission observes that personal information may be severed under Section 10.
Public Interest:
No larger public interest was shown.
Directions: The CPIO shall provide redacted records.
Penalty: A show cause notice under Section 20(1) for Rs. 25,000 is issued.
"""


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id int, text string")


def value(spark, column, text):
    return one(spark, text).select(column(F.col("text")).alias("v")).first().v


def test_rounding_half_to_even(spark):
    assert [value(spark, tx.approx_tokens, " ".join("w" * n)) for n in (0, 1, 5, 15)] == [1, 1, 6, 20]


def test_tokens_keep_references_and_case_numbers(spark):
    got = value(spark, tx.legal_tokens, "The file noting, Section 8 (1) (j) of CIC/ABC/A/2024/12 is-it?")
    assert set(got) == {"8(1)(j)", "cic/abc/a/2024/12", "cic", "abc", "2024", "12", "file", "noting"}, got  # "a" is no word to search for
    assert got[0] == "8(1)(j)" and "cic/abc/a/2024/12" in got and "the" not in got


def test_scripts_and_dates(spark):
    assert value(spark, lambda c: tx.detect_script(c, "A"), "यह सूचना का अधिकार है") == "hi"
    assert value(spark, lambda c: tx.detect_script(c, "A"), "Please provide the records") == "en"
    assert value(spark, lambda c: tx.detect_script(c, "A"), "") == "unknown"
    dates = {"2025-04-05": date(2025, 4, 5), "5.4.2025": date(2025, 4, 5), "05/04/70": date(1970, 4, 5), "05.04.25": date(2025, 4, 5), "31.02.2024": None, "soon": None}
    assert {k: value(spark, tx.normalize_date, k) for k in dates} == dates


def test_segments_of_a_labelled_decision(spark):
    got = {r.section: r for r in segmentation.segment(one(spark, DECISION)).collect()}
    assert "CIC/MFINB/A/2024/001234" in got["HEADER"].text
    for name in ("RTI_REQUEST", "CPIO_REPLY", "PUBLIC_INTEREST", "DIRECTIONS", "PENALTY"):
        assert got[name].text and got[name].confidence >= 0.74, name


def test_unlabelled_text_is_one_finding(spark):
    rows = segmentation.segment(one(spark, "A plain sentence about nothing at all.")).collect()
    assert [(r.section, r.text, r.confidence) for r in rows if r.section == "COMMISSION_FINDINGS"] == [("COMMISSION_FINDINGS", "A plain sentence about nothing at all.", 0.35)]


def test_facts_of_a_case(spark):
    r = extraction.extract_cases(one(spark, DECISION)).first()
    assert r.case_number == "CIC/MFINB/A/2024/001234" and r.decision_date == date(2025, 4, 5)
    assert r.rti_sections == ["8(1)(j)", "10", "20(1)"] and r.penalty_amount == 25000 and r.penalty_imposed
    assert r.outcome == "PENALTY" and r.appellant == "Shri Ram Kumar" and r.extraction_confidence >= 0.75
    r = extraction.extract_cases(one(spark, "nothing to see, held on 10.03.2016 and rejected")).first()
    assert (r.case_number, r.source, r.rti_sections, r.outcome, r.respondent) == ("UNKNOWN", "CIC", [], "REJECTED", None)


def test_long_sections_are_split_within_bounds(spark):
    text = " ".join(f"This is sentence number {k} of a long finding." for k in range(700))
    parts = one(spark, text).select(F.explode(chunking.split_long(F.col("text"), 800, 50)).alias("p")).select("p", tx.approx_tokens(F.col("p")).alias("n")).collect()
    assert len(parts) > 5 and all(r.n <= 820 for r in parts)
    plain = [r.p for r in one(spark, text).select(F.explode(chunking.split_long(F.col("text"), 800)).alias("p")).collect()]
    assert " ".join(plain).split() == text.split()
    assert one(spark, "x " * 3000).select(F.explode(chunking.split_long(F.col("text"), 800)).alias("p")).count() > 1


def test_chunks_start_with_their_type(spark):
    docs = one(spark, DECISION)
    job = jobs.index_corpus(docs)
    rows = job["chunks"].collect()
    assert rows and all(r.text.startswith(f"[{r.chunk_type}]") and r.token_count > 0 for r in rows)
    assert len({r.chunk_id for r in rows}) == len(rows)
    assert jobs.index_corpus(docs, docs.select("doc_id"))["chunks"].count() == 0


def test_cleaning_markdown(spark):
    text = "##  **Title**\n## Title\n\n84\n| a | b |\n| c |\ntext on a line that is certainly long enough\ntext on a line  that is certainly long enough\n3) one\n9) two\nhyphen-\nated"
    got = cleaning.clean_markdown(one(spark, text)).first().text
    assert got.split("\n") == ["## Title", "", "| a | b |", "| --- | --- |", "| c |  |", "", "text on a line that is certainly long enough", "1. one", "2. two", "hyphenated"]
    again = cleaning.dedup_paragraphs(cleaning.dedup_paragraphs(cleaning.explode_lines(one(spark, text)))).count()
    assert again == cleaning.dedup_paragraphs(cleaning.explode_lines(one(spark, text))).count()


def test_ocr_fixes(spark):
    assert value(spark, lambda c: cleaning.apply_fixes(c), "a@nic in 5~6 I8 3$4 $7 &amp;\nAB\nend  ") == "a@nic.in 5-6 18 354 57 &\n\nend"


def test_spelling(spark):
    words = spark.createDataFrame([("teh",), ("the",), ("xyzzyq",)], "word string")
    dictionary = spark.createDataFrame([("the", 1000), ("tea", 900), ("then", 3)], "word string, freq long")
    got = {r.word: (r.term, r.distance, r.accepted) for r in cleaning.spell_candidates(words, dictionary).collect()}
    assert got == {"teh": ("tea", 1, True)}


def test_search_finds_and_filters(spark):
    chunks = spark.createDataFrame([(1, "CIC", "file noting under exemption 8(1)(j)"), (2, "CIC", "tender records"), (3, "CIC", "directions to provide records"), (4, "SIC", "something else entirely"), (5, "SIC", "more of other things")], "chunk_id long, source string, text string")
    queries = spark.createDataFrame([(1, "file noting exemption 8(1)(j)"), (2, ""), (3, "unknownword")], "query_id long, text string")
    got = retrieval.bm25_search(queries, retrieval.bm25_stats(chunks)).collect()
    assert [(r.query_id, r.chunk_id, r.rank) for r in got] == [(1, 1, 1)]
    kept = chunks.where(retrieval.metadata_filter({"source": "sic", "outcome": None}, chunks.columns))
    assert {r.chunk_id for r in kept.collect()} == {4, 5}


def test_fusion_is_symmetric_but_for_ties(spark):
    a = spark.createDataFrame([(1, 10, 2.0, 1), (1, 11, 1.0, 2)], "query_id long, chunk_id long, bm25_score double, rank int")
    b = spark.createDataFrame([(1, 11, 0.9, 1), (1, 10, 0.8, 2), (1, 12, 0.1, 3)], "query_id long, chunk_id long, vector_score double, rank int")
    got = {r.chunk_id: r for r in retrieval.rrf(a, b).collect()}
    assert got[10].rrf_score == got[11].rrf_score == 1.0 and got[10].rank == 1 and got[12].bm25_score is None
    assert got[10].bm25_score and got[10].vector_score


def test_context_stays_within_its_budget(spark):
    rnd = random.Random(1)
    rows = [(1, k, f"c{k}", rnd.choice(["COMMISSION_FINDINGS", "DIRECTIONS", "OTHER"]), 1.0 - k / 50, k + 1, " ".join(["word"] * rnd.randrange(5, 900))) for k in range(19)]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id long, case_number string, chunk_type string, rrf_score double, rank int, text string")
    for stop in (False, True):
        got = retrieval.pack_context(hits, 3500, stop).collect()
        assert got and sum(r.tokens for r in got) <= 3500
        assert [r.position for r in sorted(got, key=lambda r: -r.rrf_score)] == list(range(1, len(got) + 1))


def test_routing(spark):
    departments = spark.createDataFrame([("chips", ["vpn", "data centre"], []), ("health", ["hospital"], ["अस्पताल"])], "department_id string, keywords_en array<string>, keywords_hi array<string>")
    requests = spark.createDataFrame([(1, "The VPN of the data centre at CHIPS"), (2, "अस्पताल records"), (3, "nothing")], "request_id long, text string")
    scores = {(r.request_id, r.department_id): (r.hits, r.keyword_score) for r in routing.route_keywords(requests, departments).collect()}
    assert scores == {(1, "chips"): (5.0, 0.767), (2, "health"): (1.0, 0.45)}
    got = {r.request_id: (r.department, r.band, r.transfer, r.manual_review) for r in routing.route_decide(requests, routing.route_keywords(requests, departments).withColumnRenamed("keyword_score", "score")).collect()}
    assert got == {1: ("chips", "MEDIUM", False, False), 2: ("health", "LOW", True, True), 3: ("UNKNOWN", "LOW", True, True)}


def test_names_match_by_sorted_tokens(spark):
    left = spark.createDataFrame([(1, "Department of Health & Family Welfare"), (2, "Mining")], "left_id long, name string")
    right = spark.createDataFrame([("a", "Family and Health Dept"), ("b", "Finance")], "right_id string, name string")
    got = {r.left_id: r.right_id for r in routing.match_entities(left, right).collect()}
    assert got == {1: "a", 2: None}


def test_upsert_keeps_one_row_and_its_birth(spark):
    schema = "case_number string, outcome string, created_at string, updated_at string"
    base = spark.createDataFrame([("CIC/1", "OLD", "t0", "t0")], schema)
    new = spark.createDataFrame([("cic-1", "A", "t1", "t1", 1), ("CIC_1", "B", "t2", "t2", 2), ("CIC/2", "C", "t2", "t2", 3)], schema + ", arrived int")
    got = sorted(tuple(r) for r in cases.upsert_cases(base, new).collect())
    assert got == [("CIC/1", "B", "t0", "t2"), ("CIC/2", "C", "t2", "t2")]


def test_chain_is_clean_and_shows_an_altered_record(spark):
    rows = [("k", str(n), f"t{n}", f"text {n}", "d", "HIGH", "why") for n in range(5)]
    names = "chain_key string, audit_id string, timestamp string, raw_input_text string, system_recommended_department string, system_confidence_band string, system_reasoning string"
    chained = audit.chain_append(spark.createDataFrame(rows, names))
    assert audit.verify_chain(chained).count() == 0
    bad = chained.withColumn("raw_input_text", F.when(F.col("audit_id") == "2", "other").otherwise(F.col("raw_input_text")))
    assert [(r.audit_id, r.problem) for r in audit.verify_chain(bad).collect()] == [("2", "content")]
    tail = chained.groupBy("chain_key").agg(F.max_by("current_hash", "sequence").alias("last_hash"), F.max("sequence").alias("last_sequence"))
    more = audit.chain_append(spark.createDataFrame([("k", "9", "t9", "x", "d", "LOW", "y")], names), tail=tail)
    assert audit.verify_chain(chained.unionByName(more)).count() == 0


def test_tables_and_nested_documents(spark):
    cells = spark.createDataFrame([("t", 0, 0, 2, 2, "a"), ("t", 1, 1, 2, 2, "b"), ("t", 7, 7, 2, 2, "out")], "table_id string, row int, col int, n_rows int, n_cols int, text string")
    assert ocr_tables.table_to_markdown(cells).first().markdown == "| a |  |\n| --- | --- |\n|  | b |"
    assert ocr_tables.table_to_tsv(cells).first().tsv == "a\t\n\tb"


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a b.txt").write_text("one")
    (tmp_path / "sub" / "c.txt").write_text("two")
    (tmp_path / "c_meta.txt").write_text("no")
    (tmp_path / "blank.txt").write_text(" \n")
    got = {r.path: (r.doc_id, r.text) for r in readers.scan_texts(spark, str(tmp_path)).collect()}
    assert got["a b.txt"] == ("a_b", "one") and got["sub/c.txt"][0].startswith("c_") and len(got) == 2


def test_stream_indexes_each_document_once(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    (folder / "one.txt").write_text(DECISION)
    for _ in range(2):
        index_stream.index_stream(index_stream.text_stream(spark, str(folder)), table, str(tmp_path / "state")).awaitTermination()
    first = spark.read.parquet(table).count()
    (folder / "two.txt").write_text(DECISION.replace("001234", "009999"))
    index_stream.index_stream(index_stream.text_stream(spark, str(folder)), table, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(table).count() == 2 * first > 0
