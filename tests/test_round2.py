"""Sources, sinks, requests, names and chains on small fixtures."""

import random
from collections import Counter

from casewright.operators import audit, chunking, extraction, jobs, retrieval, routing
from casewright.sources import readers, writers
from casewright.streaming.index_stream import text_stream


def test_bad_bytes_are_replaced_and_ids_follow_the_path(spark, tmp_path):
    for name, raw in (("a/x.txt", b"ok \xff text"), ("b/x.txt", b"other"), ("y.txt", b"top"), ("b/x_meta.txt", b"no"), ("z.txt", b" \n")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(raw)
    rows = {r.path: r for r in readers.scan_texts(spark, f"{tmp_path}/in").collect()}
    assert {p: r.text for p, r in rows.items()} == {"a/x.txt": "ok � text", "b/x.txt": "other", "y.txt": "top"}
    assert len({r.doc_id for r in rows.values()}) == 3 and rows["y.txt"].doc_id == "y"
    text_stream(spark, f"{tmp_path}/in").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    seen = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {r.doc_id for r in rows.values()} <= set(seen) and seen[rows["a/x.txt"].doc_id] == "ok � text"


def test_writing_a_case_leaves_its_neighbours(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "chunk_id int, case_number string, source string, text string")
    writers.write_chunks(make([(1, "A", "CIC", "a"), (2, "B", "CIC", "b"), (3, "A", "SIC", "s"), (4, None, "CIC", "n")]), f"{tmp_path}/chunks")
    writers.write_chunks(make([(5, "A", "CIC", "new")]), f"{tmp_path}/chunks")
    assert {(r.chunk_id, r.case_number, r.source) for r in spark.read.parquet(f"{tmp_path}/chunks").collect()} == {(5, "A", "CIC"), (2, "B", "CIC"), (3, "A", "SIC"), (4, None, "CIC")}
    case = lambda rows: spark.createDataFrame(rows, "case_number string, source string, decision_date string, outcome string").withColumn("decision_date", __import__("pyspark").sql.functions.to_date("decision_date"))
    writers.write_case_partitions(case([("A", "CIC", "2020-01-02", "x"), ("B", "CIC", "2020-03-04", "y"), ("C", "", None, "z")]), f"{tmp_path}/cases")
    writers.write_case_partitions(case([("A", "CIC", "2020-05-05", "again")]), f"{tmp_path}/cases")
    assert {(r.case_number, r.source, str(r.year), r.outcome) for r in spark.read.parquet(f"{tmp_path}/cases").collect()} == {("A", "CIC", "2020", "again"), ("B", "CIC", "2020", "y"), ("C", "UNKNOWN", "unknown", "z")}


def test_records_that_repeat_are_links_each(spark):
    names = "chain_key string, audit_id string, timestamp string, raw_input_text string, system_recommended_department string, system_confidence_band string, system_reasoning string, note int"
    rows = [("k", "1", "t1", "a", "d", "HIGH", "r", 1), ("k", "1", "t1", "a", "d", "HIGH", "r", 2), ("k", "1", "t2", "b", None, "LOW", "r", 3), ("q", "1", "t1", "a", "d", "HIGH", "r", 4)]
    out = audit.chain_append(spark.createDataFrame(rows, names))
    got = out.collect()
    assert sorted(r.note for r in got) == [1, 2, 3, 4] and sorted(r.sequence for r in got if r.chain_key == "k") == [1, 2, 3]
    assert audit.verify_chain(out).count() == 0


REQUESTS = [
    ("Please provide the service book and medical records of employee Ramesh Kumar, who works as a senior assistant.", "employee", "none", True, False),
    ("Please provide the bid details, pricing, and tender evaluation files for the ongoing e-District system modernization tender which is currently active and open for bidding.", "procurement", "active_tender", False, False),
    ("Please provide the firewall configuration files, system architecture diagram, and network IP routing tables for the core database server of CHiPS.", "cybersecurity", "none", False, False),
    ("Please provide details of active tender T-8787. I am requesting this because there is a severe corruption scandal and bribe allegations involving the selection committee.", "procurement", "active_tender", False, True),
    ("Please provide the proprietary pricing models and corporate tax returns submitted to CHiPS by Tech Mahindra in commercial confidence during their partnership.", "third_party_commercial", "none", False, False),
    ("Old quotation of the canteen", "procurement", "completed_tender", False, False),
    ("My ration card, ref: ab/1234 of 01-02-2024", "citizen_data", "none", True, False),
    ("The cabinet note", "confidential", "none", False, False),
    ("An office memo", "internal", "none", False, False),
    ("Hello", "other", "none", False, False),
    (None, "other", "none", False, False),
]


def test_requests_are_classed_by_the_fixed_words(spark):
    df = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(REQUESTS)], "request_id int, text string")
    got = {r.request_id: r for r in extraction.classify_requests(df).collect()}
    for k, (_, kind, status, personal, public) in enumerate(REQUESTS):
        assert (got[k].information_type, got[k].procurement_status, got[k].personal_data, got[k].public_interest_override) == (kind, status, personal, public), k
    assert got[2].systems == ["DATABASE", "SERVER", "NETWORK"] and got[1].systems == ["E-DISTRICT"]
    assert got[6].entities == ["Date: 01-02-2024", "Ref Number: ab/1234"] and "Ref Number: t-8787" in got[3].entities
    flags = {(r.request_id, r.section): r.overridden for r in routing.exemption_rules(extraction.classify_requests(df)).collect()}
    assert flags[2, "Section 8(1)(a)"] is False and flags[3, "Section 8(1)(d)"] is True and (4, "Section 11") in flags and (9, "Section 11") not in flags


def test_outcomes_and_lists(spark):
    names = [("Partly allowed", "PARTIAL"), (" show-cause ", "PENALTY"), ("no interference required.", "APPEAL_DISPOSED"), ("appeal_allowed", "APPEAL_ALLOWED"), ("granted", None), ("", None), (None, None)]
    df = spark.createDataFrame([(n,) for n, _ in names], "t string")
    assert [r[0] for r in df.select(extraction.normalize_outcome(df.t)).collect()] == [o for _, o in names]
    df = spark.createDataFrame([("Section 8(1) (j), 8(1)(J);section 11\n\n -10. ",)], "t string")
    assert df.select(extraction.list_field(df.t, sections=True)).first()[0] == ["8(1)(j)", "11", "10"]
    df = spark.createDataFrame([(" a   b,A b; • c. ",)], "t string")
    assert df.select(extraction.list_field(df.t)).first()[0] == ["a b", "c"]


def test_names_are_all_compared(spark):
    rnd = random.Random(4)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b, 1):
                before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
        return row[-1]

    left = ["education", "Health & Welfare Department", "", None, "public works", "शिक्षा विभाग"] + ["".join(rnd.choices("abcde ", k=rnd.randrange(1, 25))) for _ in range(60)]
    right = ["educaton", "health and", "works public", "शिक्षा", ""] + ["".join(rnd.choices("abcde ", k=rnd.randrange(1, 25))) for _ in range(60)]
    a = spark.createDataFrame(list(enumerate(left)), "left_id int, name string")
    b = spark.createDataFrame(list(enumerate(right)), "right_id int, name string")
    plain = lambda df, i: {r[0]: r[1] for r in df.select(i, routing.sorted_tokens(routing.plain_name(df["name"]))).collect()}
    p, q = plain(a, "left_id"), plain(b, "right_id")
    got = {r.left_id: (r.right_id, r.score) for r in routing.match_entities(a, b).collect()}
    for i, x in p.items():
        scores = [(-(200.0 * common(x, y) / (len(x) + len(y)) if x or y else 100.0), k) for k, y in q.items()]
        best = min(scores)
        assert got[i] == ((best[1], round(-best[0], 6)) if -best[0] >= 65 else (None, None)), (x, got[i], best)
    assert len(got) == len(left) and got[0][0] == 0
    assert routing.match_entities(a, b.limit(0)).where("right_id is not null").count() == 0


def test_all_kinds_of_chunks_are_made(spark):
    text = "CENTRAL INFORMATION COMMISSION\nFile No: CIC/DEPT/A/2024/7\nAppellant: A. Person\nRespondent: Department of Records\nDate of Decision: 3.04.2025\nDate of hearing: 4/03/2025\nRTI application: 5/01/2025\nFacts:\nThe appellant sought information regarding 1. the list of all teachers of the district; 2. the list of all schools of the district\nGrounds for Second Appeal:\nThe reply was not complete and was late by a month.\nDecision:\nThe Commission observed that the reply is just and proper in all points. Shri Mohan Lal of the State Education Board was heard at Delhi. The appeal is disposed of accordingly with the directions that are given above to the officer."
    cases = extraction.extract_cases(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    got = {r.chunk_type: r.text for r in chunking.synthetic_chunks(cases).collect()}
    assert set(got) == set(chunking.CHUNK_ORDER)
    assert "Commission: Central Information Commission" in got["CASE_HEADER"] and "late by a month" in got["GROUNDS_FOR_APPEAL"] and "list of all schools of the district" in got["INFORMATION_REQUESTED"]


def test_cosine_of_odd_vectors_and_report_of_failures(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [-1.0, 0.0]), (7, [1.0, 1.0])], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.chunk_id, round(r.vector_score, 6)) for r in retrieval.cosine_topk(q, v, 4).collect()}
    assert [got[1, k] for k in (1, 2, 3)] == [(1, 1.0), (2, 1.0), (7, 0.707107)] and got[1, 4] == (3, 0.0) and got[2, 1] == (1, 0.0)
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    job = {"todo": docs.where("doc_id < 3"), "chunks": spark.createDataFrame([(1, "c1"), (1, "c2")], "doc_id int, chunk_id string")}
    report = jobs.run_report(docs, job, spark.createDataFrame([("c2",)], "chunk_id string")).collect()
    assert Counter((r.doc_id, r.status, r.chunks, r.embeddings, r.error) for r in report) == Counter([(1, "processed", 2, 1, None), (2, "failed", 0, 0, "no chunk"), (3, "skipped", 0, 0, None)])
