"""Plain searches ahead of patterns: they never lose a match, and texts without the words are not searched."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from casewright.functions import rules
from casewright.functions import text as tx
from casewright.operators import extraction

PATTERNS = [
    *[p for _, p in rules.DATE_LABELS], *[p for _, p in rules.OUTCOME_RULES + rules.DOCUMENT_OUTCOME_RULES], *rules.FINAL_ORDER_PATTERNS,
    rules.PENALTY_RULE, rules.CASE_NUMBER_FALLBACK, rules.CASE_NUMBER, rules.AUTHORITIES, rules.DEPARTMENTS, rules.LOCATIONS, rules.PEOPLE,
    r"(?im)^\s*cpio\s*[:\-]\s*(.+)$", r"(?i)(?:Chief )?Information Commissioner\s*[:\-]?\s*([^\n]+)",
]


def test_needed_words_by_hand():
    assert tx.needed(r"(?i)\b(?:Appeal|Case)s?\s+No\b") == ["no"]
    assert tx.needed(r"First\s+Appeal|Complaints?") == ["appeal", "complaint"]
    assert tx.needed(r"\b(redact|section 10)\b") == ["redact", "section 10"]
    assert tx.needed(r"[A-Z]+(?:Board|Limited)\b") == ["board", "limited"]
    assert tx.needed(r"[a-z]+(?:Board|Limited)?") is None
    assert tx.needed(r"appeal|\d+") is None
    assert tx.needed(r"(?<=x)appeal") is None


@pytest.mark.parametrize("pattern", PATTERNS)
def test_every_match_has_a_needed_word(pattern):
    rnd = random.Random(pattern)
    words = re.findall(r"[A-Za-z]+", pattern) + ["Rs", "10", ":", "05.04.2025", "CIC/AB/A/2024/12", ".", "\n", " is ", " to "]
    for _ in range(3000):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))
        text = text.lower() if rnd.random() < 0.3 else text
        if re.search(pattern, text) and tx.needed(pattern):
            assert any(w in text.lower() for w in tx.needed(pattern)), (text, tx.needed(pattern))


def test_guarded_patterns_by_hand(spark):
    ministry = r"(?i)ministry\s+of\s+([a-z]+)"
    rows = spark.createDataFrame([(1, "no such word"), (2, "The MINISTRY of Power"), (3, "a penalty"), (4, "a PENALTY"), (5, None)], "i int, t string")
    got = {r.i: (r.m, r.p) for r in rows.select("i", tx.extract(F.col("t"), ministry, 1).alias("m"), tx.matches(F.col("t"), rules.PENALTY_RULE).alias("p")).collect()}
    assert got == {1: ("", False), 2: ("Power", False), 3: ("", True), 4: ("", False), 5: ("", False)}


def test_authorities_of_long_lines(spark):
    """A line without an authority is not searched from each of its capitals."""
    line = "Abc Def, " * 4000
    docs = spark.createDataFrame([(k, f"{line}\nThe Delhi Water Board met.\n{line}"[k:]) for k in range(300)], "doc_id int, text string")
    start = time.time()
    got = extraction.entities(docs).select("authorities", "departments").distinct().collect()
    assert time.time() - start < 20
    assert [(r.authorities, r.departments) for r in got] == [([], [])]
    short = docs.select("doc_id", F.expr("substring(text, length(text) div 2 - 100, 200)").alias("text"))
    assert extraction.entities(short.where("doc_id = 0")).first().authorities == ["The Delhi Water Board"]


def test_named_case_fields_alone_are_made(spark):
    docs = spark.createDataFrame([(1, "File No: CIC/DEPT/A/2024/1001\nDate of Decision: 05.04.2025\nFacts:\nThe appellant sought information.")], "doc_id long, text string")
    from casewright.operators import jobs

    job = jobs.index_corpus(docs, fields=jobs.CHUNK_FIELDS)
    assert job["cases"].columns == ["doc_id", *jobs.CHUNK_FIELDS]
    whole = extraction.extract_cases(docs).select("doc_id", *jobs.CHUNK_FIELDS)
    assert job["cases"].collect() == whole.collect()
