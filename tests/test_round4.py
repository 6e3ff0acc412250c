"""Rows on which queries and their SQL parted, and plans that were to grow no faster than their input."""

import datetime
import re

import duckdb
import pytest

from pyspark.sql import functions as F

from casewright.operators import cleaning
from casewright.plans.registry import ORACLE_SQL, QUERIES
from tests.test_queries import plain


@pytest.fixture
def same(spark, tmp_path):
    """Holds a query against its SQL on small tables, and gives its rows."""

    def check(name, **tables):
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        columns, rows = sorted(df.columns), df.collect()
        cur = con.execute(ORACLE_SQL[name])
        at = [[c[0] for c in cur.description].index(c) for c in columns]
        key = lambda row: tuple(map(repr, row))
        assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=key) == sorted((tuple(plain(r[k]) for k in at) for r in cur.fetchall()), key=key)
        return rows

    return check


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date, o_orderpriority string, o_totalprice double"


def test_first_year_in_a_case_number(same):
    day = datetime.date(1997, 3, 4)
    rows = same("k3_write_case_partitions", orders=([(11, 1900, "F", day, "1-URGENT", 1.0), (13, 2099, "O", day, "1-URGENT", 1.0), (15, 7, "F", day, "1-URGENT", 1.0), (16, 1950, "F", day, "1-URGENT", 1.0)], ORDERS))
    assert {r.case_number.rsplit("/", 1)[1]: r.year for r in rows} == {"11": "1900", "13": "2099", "15": "1995", "16": "1997"}


DOCUMENTS = "doc_id long, text string, lang string, source string"


def test_percentages_that_end_in_a_half(same):
    rows = same("t14_reduction_report", documents=([(1, "a" * 587 + "b" * 1413, "en", "s"), (2, "a" * 1 + "b" * 1999, "en", "s"), (3, "", "en", "s")], DOCUMENTS))
    assert {r.doc_id: r.reduced_pct for r in rows}[1] == 29.4 and {r.doc_id: r.reduced_pct for r in rows}[2] == 0.1


def test_percentages_of_texts_that_grow(spark):
    from casewright.operators import cleaning

    make = lambda n: spark.createDataFrame([(1, "x" * n)], "doc_id long, text string")
    assert [r.reduced_pct for r in cleaning.reduction_report(make(2000), make(2001)).collect()] == [-0.1, -0.1]


BEGINNINGS = [(8, "56 and more", "en", "s"), (9, "$ 12 and more", "en", "s"), (11, "$7", "en", "s"), (17, "क्रमांक 9/8 रु. 1,200 दिनांक 45.1.24", "en", "s"), (27, "plain", "en", "s"), (32, None, "en", "s"), (1, "दिनांक: 1/13/2020 ₹ 7 हजार", "en", "s")]


def test_fields_of_texts_that_go_on_with_numbers(same):
    rows = same("t5_critical_fields", documents=(BEGINNINGS, DOCUMENTS))
    assert {r.value for r in rows if r.kind == "reference" and r.doc_id in (8, 17)} == {"124/5\n56", "9/8"}


def test_fields_of_all_texts_that_go_on_with_numbers(same):
    rows = same("t5_critical_fields_all", documents=(BEGINNINGS, DOCUMENTS))
    assert len([r for r in rows if r.doc_id == 17]) == 6


def test_quality_of_texts_that_go_on_with_numbers(same):
    rows = same("t6_document_quality", documents=(BEGINNINGS, DOCUMENTS))
    assert {r.doc_id: r.suspicious for r in rows} == {8: 0, 9: 1, 11: 1, 17: 1, 27: 0, 32: 0, 1: 1}


def searches(df) -> list[int]:
    """How many searches by pattern each node of the plan names."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [len(re.findall(r"regexp_\w+\(|RLIKE", line)) for line in plan.splitlines()]


@pytest.mark.parametrize("name", ["t15_detect_script", "t15_detect_script_all"])
def test_each_count_of_scripts_once(spark, same, tmp_path, name):
    texts = ["Z z", "", " \n\t", "abc", "सूचना", "सूचना abc x", "१२ 34 --", "é ß \U0001f600"]
    same(name, documents=([(k, texts[k % 8], "en", "s") for k in range(32)], DOCUMENTS))
    assert sum(searches(QUERIES[name](spark, str(tmp_path)))) == 3


def test_cases_are_searched_once(spark, tmp_path):
    spark.createDataFrame([(1, "a text of some words. And one more sentence here.", "en", "s")], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert max(searches(QUERIES["c5_summary_chunk"](spark, str(tmp_path)))) < 5
    assert max(searches(QUERIES["c4_synthetic_chunks"](spark, str(tmp_path)))) < 5


def test_blocks_of_vectors_stay_off_the_driver(spark):
    from casewright.operators import retrieval

    vectors = spark.range(50).select(F.col("id").alias("chunk_id"), F.array((F.col("id") % 7).cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    plan = retrieval.cosine_topk(vectors.withColumnRenamed("chunk_id", "query_id"), vectors)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


TERMS = ["", "The section 8 ( 1 ) (j) and 7(1) of CIC/ABC-1/A/2020/5, music-hall", "music/al a/.b a//b c/d-e", "sic_x/y basic-1 no (here)", "section 20 Sec 3 12 ( 4 )x", "x.y,z!w ÄÖ é 1/2"]


def test_terms_as_before(spark):
    from casewright.functions import text as tx

    def before(text):
        low = F.lower(tx.blank_if_null(text))
        refs = F.transform(F.regexp_extract_all(low, F.lit(tx.SECTION_REF), 0), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", ""), "^section", ""))
        rest = F.regexp_replace(low, tx.SECTION_REF, " ")
        cases = F.transform(F.regexp_extract_all(rest, F.lit(tx.CASE_REF), 0), lambda x: F.translate(x, "_-", "//"))
        parts = F.flatten(F.transform(cases, lambda x: F.concat(F.array(x), F.split(x, "/"))))
        plain = F.regexp_replace(F.regexp_replace(rest, tx.CASE_REF, " "), r"[\p{Punct}&&[^/]]", " ")
        return F.filter(F.concat(refs, parts, F.regexp_extract_all(plain, F.lit(tx.WORD), 0)), lambda t: (t != "") & ~t.isin(*tx.STOPWORDS))

    texts = spark.createDataFrame([(t,) for t in [*TERMS, None]], "text string")
    rows = texts.select("text", tx.legal_tokens(F.col("text")).alias("now"), before(F.col("text")).alias("then")).collect()
    assert [r.now for r in rows] == [r.then for r in rows]


def test_texts_are_searched_a_few_at_a_time(spark):
    from casewright.operators import segmentation

    n = 2 * segmentation.SLICE + 1
    docs = spark.createDataFrame([(k, "Background: x\nOrder: y") for k in range(n)], "doc_id long, text string").coalesce(1)
    found = segmentation.find_boundaries(docs).groupBy("doc_id").count().collect()
    assert len(found) == n and len({r["count"] for r in found}) == 1


def test_touched_folders_are_not_dealt_out(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from casewright.sources import writers

    rows = spark.createDataFrame([(k, "A" if k % 2 else "B", "CIC", "t") for k in range(10)], "chunk_id long, case_number string, source string, text string")
    writers.write_chunks(rows, f"{tmp_path}/chunks")
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()), write(self, path, *a, **k))[1])
    writers.write_chunks(rows.where("case_number = 'A'"), f"{tmp_path}/chunks")
    assert "strategy=broadcast" in plans[0] and spark.read.parquet(f"{tmp_path}/chunks").count() == 10


def test_line_passes_sort_few_times(spark):
    """Places in tables and numbers in lists come in the lines' own order, without a sort for each."""
    docs = spark.createDataFrame([(1, "| a |\n\n| b |\n1. x\ny\n3) z\n4) w\n– v")], "doc_id long, text string")
    made = cleaning.renumber_lists(cleaning.repair_tables(cleaning.explode_lines(docs)))
    assert [r.line for r in made.orderBy("line_no").collect()] == ["| a |", "| --- |", "| b |", "", "1. x", "y", "1. z", "2. w", "- v"]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert sum("Sort [" in x for x in plan.splitlines()) <= 3
