"""Fixtures of the rules mended in this round, and plain versions of composed queries over the whole smallest tables."""

import hashlib
import re
from collections import Counter

import pytest

from casewright.functions import rules
from casewright.operators import audit, extraction, retrieval, routing
from casewright.plans import table_queries
from casewright.plans.registry import QUERIES
from casewright.plans.views import view

SF = "/root/testdata/sf0.001"


def test_the_first_decision_stands(spark):
    records = spark.createDataFrame([("a", "PENDING", None, None), ("b", "APPROVED", "x", None), ("c", "PENDING", None, None), ("d", "PENDING", "keep", None)], "audit_id string, pio_action_taken string, pio_override_department string, pio_comments string")
    made = [("a", "APPROVED", None, "yes", 1), ("a", "REJECTED", None, "no", 2), ("b", "REJECTED", None, "", 1), ("c", "MAYBE", None, "", 1), ("c", "OVERRIDDEN", "health", "", 5), ("z", "APPROVED", None, "", 1), (None, "APPROVED", None, "", 1), ("c", None, None, "", 0)]
    decisions = spark.createDataFrame(made, "audit_id string, action string, override string, comments string, arrived int")
    out, rejected = audit.apply_decisions(records, decisions)
    assert sorted(map(tuple, out.collect())) == [("a", "APPROVED", None, "yes"), ("b", "APPROVED", "x", None), ("c", "OVERRIDDEN", "health", ""), ("d", "PENDING", "keep", None)]
    want = [(None, "APPROVED", "unknown record"), ("a", "REJECTED", "already decided"), ("b", "REJECTED", "already decided"), ("c", None, "unknown action"), ("c", "MAYBE", "unknown action"), ("z", "APPROVED", "unknown record")]
    assert sorted(map(tuple, rejected.collect()), key=str) == sorted(want, key=str)


FIRST = [
    ("[FACTS] short. this sentence has more than forty characters in it. Another one.", "this sentence has more than forty characters in it."),
    ("[FACTS] no end mark", "no end mark"),
    ("12345678901234567890123456789012345678901. The next sentence is the one that has to be taken here.", "The next sentence is the one that has to be taken here."),
    ("Too short! Really? yes", "Too short! Really? yes"),
    ("A very long sentence " + "word " * 100 + ".", ("A very long sentence " + "word " * 100)[:350].strip()),
    ("", ""),
    (None, ""),
]


def test_first_sentences(spark):
    df = spark.createDataFrame([(t,) for t, _ in FIRST], "t string")
    assert [r[0] for r in df.select(retrieval.first_sentence(df.t)).collect()] == [w for _, w in FIRST]


def test_similar_cases_by_score_and_circulars_in_order(spark):
    hits = spark.createDataFrame([(1, 1, "A", "CIC", 0.2, 1, "x"), (1, 2, "B", "CIC", 1.7, 2, "y"), (1, 3, "A", "CIC", 0.9, 3, "z"), (1, 4, "K2", "CIRCULAR", 0.1, 5, ""), (1, 5, "K1", "CIRCULAR", 0.1, 4, ""), (1, 6, "K2", "CIRCULAR", 0.1, 6, ""), (1, 7, "K3", "CIRCULAR", 0.1, 7, "")], "query_id int, chunk_id int, case_number string, source string, rrf_score double, rank int, text string")
    cited = hits.where("case_number <> 'K3'")
    got = [(r.place, r.case_number, r.chunk_id, r.similarity_score) for r in retrieval.similar_cases(hits.where("source = 'CIC'"), cited).orderBy("place").collect()]
    assert got == [(1, "B", 2, 1.0), (2, "A", 3, 0.9)]
    assert [tuple(r) for r in retrieval.relevant_circulars(hits, cited).collect()] == [(1, ["K1", "K2"])]


def test_general_entities_and_leads(spark):
    text = "Delhi Metro Rail met Shri Ram Kumar at Raipur Airport. New Delhi and Delhi Metro Rail again. X Corporation Limited."
    df = spark.createDataFrame([(1, text, "Asha", "Land Board"), (2, text, "", None), (3, None, None, None)], "doc_id int, text string, appellant string, public_authority string")
    got = {r.doc_id: r for r in extraction.entities(df, general=True).join(df.select("doc_id", extraction.general_entities(df).alias("names")), "doc_id").collect()}

    def names(lead):
        found = [" ".join(m[0].split()) for p in rules.GENERAL_ENTITIES for m in re.finditer(p, text)]
        return list(dict.fromkeys([*lead, *(v for v in found if len(v) <= 80)]))[:20]

    assert got[1].entities == got[1].names == names(["Land Board"]) and got[2].entities == names([])
    assert got[1].people[0] == "Asha" and got[1].authorities[0] == "Land Board" and got[2].people[0].startswith("Shri Ram Kumar")
    assert got[3].entities == got[3].people == []


def test_request_categories(spark):
    rows = [("Please give the NOTE SHEET of the tender", "file_request"), ("salary of a contract worker", "personal_records"), ("bid papers", "procurement"), ("the server password", "technical_or_security"), ("roads", "information_request"), (None, "information_request")]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r[0] for r in df.select(extraction.request_category(df.t)).collect()] == [c for _, c in rows]


def test_bands_without_decisions_count_zero(spark):
    df = spark.createDataFrame([("LOW",), ("LOW",), ("HIGH",)], "band string")
    assert {r.band: r.n for r in routing.band_distribution(df).collect()} == {"HIGH": 1, "MEDIUM": 0, "LOW": 2}
    assert {r.n for r in routing.band_distribution(df.limit(0)).collect()} == {0}


def tokens(n):
    return max(1, round(n * 1.3))


def test_contexts_of_all_queries(spark):
    chunks = view(spark, SF, "chunks")
    hits = retrieval.normalize_hits(retrieval.bm25_search(view(spark, SF, "queries"), retrieval.bm25_stats(chunks)), "bm25_score").join(chunks, "chunk_id").collect()
    place = {t: k for k, t in enumerate(retrieval.CONTEXT_PRIORITY, 1)}
    want = {}
    for q in {h.query_id for h in hits}:
        pool = sorted((h for h in hits if h.query_id == q and h.text), key=lambda h: (-round(h.rrf_score, 9), h["rank"], h.chunk_id))
        first = next((h.chunk_id for h in pool if h.chunk_type == "COMMISSION_FINDINGS"), None)
        used, chosen = 0, {}
        for h in sorted(pool, key=lambda h: (0 if h.chunk_id == first else place.get(h.chunk_type, 999), -round(h.rrf_score, 9), h["rank"], h.chunk_id)):
            left, words = 3500 - used, len(h.text.split())
            if tokens(words) + 12 <= left:
                kept = words
            else:
                kept = min(int((left - 15) / 1.3), words) if left - 15 >= 30 else 0
            if kept > 0:
                used += tokens(kept) + 12
                chosen[h.chunk_id] = (kept, tokens(kept) + 12)
        for n, h in enumerate((h for h in pool if h.chunk_id in chosen), 1):
            want[q, h.chunk_id] = (n, *chosen[h.chunk_id])
    got = {(r.query_id, r.chunk_id): (r.position, r.kept_words, r.tokens) for r in QUERIES["r15_pack_context"](spark, SF).collect()}
    assert got == want and got


def test_merged_master_records(spark):
    left, right = table_queries._names(spark, SF)
    lefts, rights = {r.left_id: r for r in left.collect()}, {r.right_id: r for r in right.collect()}
    want = []
    for m in QUERIES["q9_match_entities"](spark, SF).collect():
        if m.right_id is not None:
            a, b = lefts[m.left_id], rights[m.right_id]
            want.append((m.left_id, m.right_id, a.name if a.name is not None else b.name, sorted({a.name, b.name} - {None}), sorted({*(a.keywords or []), *(b.keywords or [])})))
    assert sorted(map(tuple, QUERIES["q10_merge_master"](spark, SF).collect())) == sorted(want)


@pytest.fixture(scope="module")
def cases(spark):
    return extraction.extract_cases(view(spark, SF, "decision_docs")).collect()


def chunk_id(*parts):
    return hashlib.sha256("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()


def marked(kind, text):
    return text if text.startswith(f"[{kind}]") else f"[{kind}] {text}"


def test_chunks_of_case_fields(spark, cases):
    from casewright.operators.chunking import CHUNK_ORDER, FIELD_CHUNKS, TEXT_CHUNKS

    def value(r, c, between):
        v = r[c] if c in r.__fields__ else ""
        return between.join(v) if isinstance(v, list) else "" if v is None else str(v)

    want = Counter()
    for r in cases:
        for kind in CHUNK_ORDER:
            text = ". ".join(f"{label}: {v}" for label, c in FIELD_CHUNKS[kind] if (v := value(r, c, ", "))) if kind in FIELD_CHUNKS else value(r, TEXT_CHUNKS[kind], "; ")
            if len(text) >= 50:
                text = marked(kind, text)
                want[r.case_number, kind, text, chunk_id(r.case_number, kind), tokens(len(text.split()))] += 1
    got = Counter((r.case_number, r.chunk_type, r.text, r.chunk_id, r.token_count) for r in QUERIES["c4_synthetic_chunks"](spark, SF).collect())
    assert got == want and {k[1] for k in got} >= {"CASE_HEADER", "DATES_TABLE", "PARTIES", "FACTS", "ENTITY_CONTEXT"}


def test_summary_chunks(spark, cases):
    want = Counter()
    for r in cases:
        findings = "; ".join(s for s in (x.strip(" .") for x in r.key_findings) if s)
        made = f"Case {r.case_number}. Outcome: {r.outcome}. Sections invoked: {', '.join(r.rti_sections) or 'not specified'}. Key findings: {findings}." if r.outcome is not None and findings else None
        text = r.precedent if r.precedent is not None else made
        if text is not None:
            want[r.case_number, "FULL_SUMMARY", marked("FULL_SUMMARY", text), chunk_id(r.case_number, "FULL_SUMMARY")] += 1
    assert Counter((r.case_number, r.chunk_type, r.text, r.chunk_id) for r in QUERIES["c5_summary_chunk"](spark, SF).collect()) == want


def test_precedents_from_their_fields(spark, cases):
    got = {r.doc_id: r.precedent for r in QUERIES["e14_precedent_summary"](spark, SF).collect()}
    for r in cases:
        strong = [s for s in r.key_findings if re.search(r"just\s+and\s+proper|pointwise|interference|directed|disclosed|exempt", s, re.I)]
        chosen = list(dict.fromkeys([*strong, *r.key_findings]))[:4]
        parts = ["Applicant sought " + "; ".join(r.information_requested[:4])] if r.information_requested else []
        parts += ["Commission observed " + "; ".join(chosen)] if chosen else []
        parts += [f"Final order: {r.final_order}"] if r.final_order is not None else []
        parts += [f"Outcome: {r.outcome}"] if r.outcome is not None else []
        text = " ".join(". ".join(parts).split())
        text = text if len(text) <= 1200 else text[:1197].rstrip() + "..."
        assert got[r.doc_id] == (text or None), r.doc_id


def test_coverage_counts_sections(spark):
    from casewright.operators import segmentation

    docs = view(spark, SF, "decision_docs")
    sections = segmentation.segment(docs).collect()
    n, seen = docs.count(), Counter(s for _, s in {(r.doc_id, r.section) for r in sections if r.text.strip(" ")})
    got = {r.section: (r.docs, round(r.share, 9)) for r in QUERIES["g10_segmentation_coverage"](spark, SF).collect()}
    assert got == {s: (k, round(k / n, 9)) for s, k in seen.items()}


def test_keywords_by_trigrams_equal_those_of_one_row(spark):
    import random

    rnd = random.Random(5)
    letters = "abcdeé "
    word = lambda k: "".join(rnd.choices(letters, k=k)).strip()
    departments = [(f"d{k}", [word(rnd.randint(1, 7)) for _ in range(12)] + ["data centre"], [word(4)]) for k in range(30)]
    requests = [(k % 90, word(rnd.randint(0, 60)) + rnd.choice(["", " metadata centres", " data centre"])) for k in range(120)] + [(200, None), (201, "")]
    df = spark.createDataFrame(requests, "request_id int, text string")
    for kws in (departments, [*departments, ("none", ["", "x"], [])]):
        dep = spark.createDataFrame(kws, "department_id string, keywords_en array<string>, keywords_hi array<string>")
        row, index = (sorted(map(tuple, routing.route_keywords(df, dep, most=most).collect())) for most in (10**6, 0))
        assert row == index and row


def test_names_of_all_lengths(spark):
    import random

    rnd = random.Random(7)
    name = lambda: "".join(rnd.choices("abc ", k=rnd.choice([0, 1, 2, 3, 4, 5, 8, 12, 13, 25, 26, 27, 40])))
    left, right = [name() for _ in range(80)], [name() for _ in range(80)]
    a, b = spark.createDataFrame(list(enumerate(left)), "left_id int, name string"), spark.createDataFrame(list(enumerate(right)), "right_id int, name string")

    def common(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            before = 0
            for k, d in enumerate(y, 1):
                before, row[k] = row[k], before + 1 if c == d else max(row[k], row[k - 1])
        return row[-1]

    plain = lambda t: " ".join(sorted(t.split()))
    for threshold in (65.0, 30.0, 100.0, 0.0):
        got = {r.left_id: (r.right_id, r.score) for r in routing.match_entities(a, b, threshold).collect()}
        for i, x in enumerate(map(plain, left)):
            best = min((-(200.0 * common(x, y) / (len(x) + len(y)) if x or y else 100.0), k) for k, y in enumerate(map(plain, right)))
            assert got[i] == ((best[1], round(-best[0], 6)) if -best[0] >= threshold else (None, None)), (threshold, x)
