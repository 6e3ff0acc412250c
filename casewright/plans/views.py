"""Input tables of the registered queries, derived from the given tables.

Each view is SQL that Spark and DuckDB read alike; {name} is a given table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "docs": "SELECT doc_id, text FROM {documents}",
    "chunks": """SELECT doc_id AS chunk_id, 'CIC/DEPT/A/2024/' || CAST(doc_id % 97 AS STRING) AS case_number,
        CASE doc_id % 4 WHEN 0 THEN 'CIC' WHEN 1 THEN 'SIC' WHEN 2 THEN 'COURT' ELSE 'CIRCULAR' END AS source,
        CASE doc_id % 7 WHEN 0 THEN 'COMMISSION_FINDINGS' WHEN 1 THEN 'FACTS' WHEN 2 THEN 'FINAL_ORDER' WHEN 3 THEN 'RTI_REQUEST' WHEN 4 THEN 'DIRECTIONS' WHEN 5 THEN 'PRECEDENT_SUMMARY' ELSE 'OTHER' END AS chunk_type,
        CASE doc_id % 3 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'PARTIAL' ELSE 'APPEAL_ALLOWED' END AS outcome,
        lang AS department, DATE '2020-01-01' + CAST(doc_id % 1500 AS INT) AS decision_date, text FROM {documents}""",
    "queries": "SELECT item_id AS query_id, text FROM {benchmark}",
    "vectors": "SELECT vec_id AS chunk_id, embedding FROM {embeddings}",
    "vector_queries": "SELECT vec_id AS query_id, embedding FROM {embeddings} WHERE vec_id % 20 = 0",
    "lexical": "SELECT vec_id % 25 AS query_id, vec_id AS chunk_id, CAST(1000 - vec_id % 613 AS DOUBLE) / 100 AS bm25_score, CAST(row_number() OVER (PARTITION BY vec_id % 25 ORDER BY vec_id % 613, vec_id) AS INT) AS rank FROM {embeddings} WHERE vec_id % 3 <> 0",
    "semantic": "SELECT vec_id % 25 AS query_id, vec_id AS chunk_id, CAST(vec_id % 499 AS DOUBLE) / 500 AS vector_score, CAST(row_number() OVER (PARTITION BY vec_id % 25 ORDER BY vec_id % 499 DESC, vec_id) AS INT) AS rank FROM {embeddings} WHERE vec_id % 4 <> 0",
    "hits": """SELECT doc_id % 20 AS query_id, doc_id AS chunk_id, 'CIC/DEPT/A/2024/' || CAST(doc_id % 97 AS STRING) AS case_number, CASE doc_id % 3 WHEN 0 THEN 'CIC' ELSE 'SIC' END AS source,
        CASE doc_id % 6 WHEN 0 THEN 'COMMISSION_FINDINGS' WHEN 1 THEN 'FACTS' WHEN 2 THEN 'FINAL_ORDER' WHEN 3 THEN 'RTI_REQUEST' WHEN 4 THEN 'DIRECTIONS' ELSE 'PRECEDENT_SUMMARY' END AS chunk_type,
        CASE doc_id % 3 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'PARTIAL' ELSE 'APPEAL_ALLOWED' END AS outcome, lang AS department,
        CAST(1000 - doc_id % 337 AS DOUBLE) / 1000 AS rrf_score, CAST(row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id % 337, doc_id) AS INT) AS rank,
        'Section 8(1)(j) ' || text AS text, CASE WHEN doc_id % 2 = 0 THEN '8(1)(j)' ELSE '11' END AS cited FROM {documents}""",
    "cases": """SELECT 'CIC/' || CAST(o_custkey AS STRING) || '/A/' || CAST(1990 + o_orderkey % 10 AS STRING) || '/' || CAST(o_orderkey AS STRING) AS case_number,
        CASE o_orderstatus WHEN 'F' THEN 'REJECTED' WHEN 'O' THEN 'PARTIAL' ELSE '' END AS outcome, CAST(o_orderdate AS DATE) AS decision_date,
        'Department of ' || o_orderpriority AS department, CASE WHEN o_orderkey % 3 = 0 THEN 'SIC' ELSE 'CIC' END AS source, o_totalprice AS amount, o_orderkey AS n FROM {orders}""",
    "records": """SELECT CAST(user_id AS STRING) AS chain_key, CAST(event_id AS STRING) AS audit_id, lpad(CAST(event_id AS STRING), 12, '0') AS ts_key, ts, event_type AS raw_input_text,
        CASE event_id % 5 WHEN 0 THEN 'revenue' WHEN 1 THEN 'health' ELSE 'chips' END AS system_recommended_department,
        CASE event_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS system_confidence_band, 'by ' || event_type AS system_reasoning,
        CASE event_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'OVERRIDDEN' ELSE 'REJECTED' END AS pio_action_taken,
        CASE WHEN event_id % 4 = 2 THEN 'health' END AS pio_override_department, event_id FROM {events}""",
    "decision_docs": """SELECT doc_id, 'CENTRAL INFORMATION COMMISSION' || chr(10) || 'File No: CIC/DEPT/A/2024/' || CAST(1000 + doc_id AS STRING) || chr(10) || 'Date of Decision: ' || CAST(1 + doc_id % 28 AS STRING) || '.04.2025' || chr(10)
        || 'Appellant: A' || CAST(doc_id AS STRING) || chr(10) || 'Respondent: Department of Records ' || lang || chr(10) || 'Date of hearing: ' || CAST(1 + doc_id % 28 AS STRING) || '/03/2025' || chr(10)
        || 'Facts:' || chr(10) || 'The appellant sought information regarding ' || text || chr(10) || 'CPIO Reply: The CPIO replied under Section 8(1)(j) and Section 10.' || chr(10)
        || 'Decision:' || chr(10) || 'The Commission observes that the reply is proper. ' || CASE doc_id % 4 WHEN 0 THEN 'The appeal is dismissed.' WHEN 1 THEN 'The appeal is partly allowed.' WHEN 2 THEN 'The CPIO is directed to provide the records.' ELSE 'A penalty of Rs. 25,000 under Section 20(1) may follow.' END AS text FROM {documents}""",
    "requests": """SELECT item_id AS request_id, text || CASE item_id % 6 WHEN 0 THEN ' vpn firewall of chips' WHEN 1 THEN ' active tender of revenue' WHEN 2 THEN ' salary of an employee' WHEN 3 THEN ' vendor pricing' WHEN 4 THEN ' corruption in medical records of health' ELSE '' END AS text,
        CASE item_id % 3 WHEN 0 THEN 'chips' WHEN 1 THEN 'revenue' ELSE 'health' END AS expected, CASE item_id % 2 WHEN 0 THEN 'en' ELSE 'hi' END AS language FROM {benchmark}""",
    "pages": """SELECT CAST((doc_id - doc_id % 4) / 4 AS BIGINT) AS doc_id, CAST(doc_id % 4 + 1 AS INT) AS page_no, text, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(doc_id % 100 AS DOUBLE) / 100 END AS ocr_score,
        CASE WHEN doc_id % 5 = 0 THEN 'native' ELSE 'ocr' END AS source FROM {documents}""",
    "cells": "SELECT l_orderkey AS table_id, CAST(l_linenumber AS INT) - 1 AS row, CAST(l_orderkey % 3 AS INT) AS col, 5 AS n_rows, 3 AS n_cols, l_returnflag || l_linestatus AS text FROM {lineitem}",
}
TABLE = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(TABLE.findall(sql))}
    return spark.sql(sql, **tables)


def ctes(*names: str) -> str:
    """The views as the first common table expressions of a DuckDB statement."""
    return "WITH " + ", ".join(f"v_{n} AS ({TABLE.sub(lambda m: m[1], VIEWS[n])})" for n in names)
