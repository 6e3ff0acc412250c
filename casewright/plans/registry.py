"""All registered queries of the library and their SQL."""

from casewright.plans import document_queries, retrieval_queries, table_queries

QUERIES: dict = {**retrieval_queries.QUERIES, **document_queries.QUERIES, **table_queries.QUERIES}
ORACLE_SQL: dict = {**retrieval_queries.ORACLE_SQL, **document_queries.ORACLE_SQL, **table_queries.ORACLE_SQL}
