"""Queries of retrieval, reranking and context, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import text as tx
from casewright.operators import projections
from casewright.operators import retrieval as r
from casewright.plans.views import ctes, view

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def _tokens(c: str) -> str:
    low = f"lower(coalesce({c}, ''))"
    rest = f"regexp_replace({low}, '{tx.SECTION_REF}', ' ', 'g')"
    refs = f"list_transform(regexp_extract_all({low}, '{tx.SECTION_REF}'), lambda x: regexp_replace(regexp_replace(x, '\\s+', '', 'g'), '^section', ''))"
    cases = f"list_transform(regexp_extract_all({rest}, '{tx.CASE_REF}'), lambda x: translate(x, '_-', '//'))"
    parts = f"flatten(list_transform({cases}, lambda x: list_concat([x], string_split(x, '/'))))"
    plain = f"regexp_replace(regexp_replace({rest}, '{tx.CASE_REF}', ' ', 'g'), '[!-.:-@\\[-`{{-~]', ' ', 'g')"
    return f"list_filter(list_concat(list_concat({refs}, {parts}), regexp_extract_all({plain}, '{tx.WORD}')), lambda t: t <> '' AND t NOT IN ({_STOP}))"


@query(f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents")
def r1_legal_tokenize(spark, sf):
    return view(spark, sf, "docs").select("doc_id", tx.legal_tokens(F.col("text")).alias("tokens"))


_STATS = f"""t AS (SELECT chunk_id, {_tokens('text')} AS tokens FROM v_chunks), p AS (SELECT chunk_id, len(tokens) AS length, unnest(tokens) AS term FROM t),
post AS (SELECT term, chunk_id, length, count(*) AS tf FROM p GROUP BY ALL), n AS (SELECT count(*) AS n, avg(len(tokens)) AS avg_length FROM t),
d AS (SELECT term, count(*) AS df FROM post GROUP BY term), raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw, avg_length FROM d, n),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf, avg_length FROM raw)"""


@query(ctes("chunks") + f", {_STATS} SELECT term, df, round(idf, 6) AS idf, round(avg_length, 6) AS avg_length FROM idf")
def r2_bm25_stats(spark, sf):
    terms = r.bm25_stats(view(spark, sf, "chunks")).terms
    return terms.select("term", "df", F.round("idf", 6).alias("idf"), F.round("avg_length", 6).alias("avg_length"))


_SEARCH = ctes("chunks", "queries") + f""", {_STATS}, q AS (SELECT query_id, unnest({_tokens('text')}) AS term FROM v_queries), asked AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT query_id, chunk_id, sum(times * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * length / avg_length))) AS score FROM asked JOIN idf USING (term) JOIN post USING (term) GROUP BY ALL HAVING score > 0),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 20)"""


@query(_SEARCH + " SELECT query_id, chunk_id, round(score, 6) AS bm25_score, CAST(rank AS INTEGER) AS rank FROM bm25")
def r3_bm25_search(spark, sf):
    hits = r.bm25_search(view(spark, sf, "queries"), r.bm25_stats(view(spark, sf, "chunks")))
    return hits.select("query_id", "chunk_id", F.round("bm25_score", 6).alias("bm25_score"), "rank")


@query(_SEARCH + " SELECT query_id, chunk_id, round(score, 6) AS bm25_score, CAST(rank AS INTEGER) AS rank FROM bm25")
def r3_bm25_bounded(spark, sf):
    """The same hits, with postings skipped that cannot reach them."""
    index = r.bm25_stats(view(spark, sf, "chunks"))
    hits = r.bm25_search_bounded(view(spark, sf, "queries"), index, r.bm25_bounds(index)).hits
    return hits.select("query_id", "chunk_id", F.round("bm25_score", 6).alias("bm25_score"), "rank")


@query(_SEARCH + ", r AS (SELECT query_id, count(*) AS postings FROM asked JOIN post USING (term) GROUP BY ALL) SELECT query_id, postings, true AS fewer FROM r")
def r3_postings_scored(spark, sf):
    """For each query the postings of its words, and whether the bounded search scores no more of them."""
    index = r.bm25_stats(view(spark, sf, "chunks"))
    scored = r.bm25_search_bounded(view(spark, sf, "queries"), index, r.bm25_bounds(index)).scored
    return scored.select("query_id", "postings", (F.col("scored") <= F.col("postings")).alias("fewer"))


@query(ctes("chunks") + " SELECT chunk_id, source, chunk_type, decision_date FROM v_chunks WHERE lower(source) = 'cic' AND lower(chunk_type) = 'facts' AND CAST(decision_date AS VARCHAR) LIKE '2020%'")
def r4_metadata_filter(spark, sf):
    chunks = view(spark, sf, "chunks")
    return chunks.where(r.metadata_filter({"source": "cic", "chunk_type": "FACTS", "year": 2020, "outcome": ""}, chunks.columns)).select("chunk_id", "source", "chunk_type", "decision_date")


@query(ctes("chunks") + " SELECT chunk_id, source FROM v_chunks WHERE chunk_id % 3 <> 0")
def r5_add_missing(spark, sf):
    chunks = view(spark, sf, "chunks").select("chunk_id", "source")
    return r.add_missing(chunks.where("chunk_id % 3 = 0"), chunks.unionByName(chunks))


_COS = ctes("vectors", "vector_queries") + """, s AS (SELECT query_id, chunk_id, least(greatest(coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 0), 0), 1) AS score FROM v_vector_queries q, v_vectors v)
SELECT query_id, chunk_id, round(score, 6) AS vector_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 10"""


@query(_COS)
def r6_cosine_topk(spark, sf):
    hits = r.cosine_topk(view(spark, sf, "vector_queries"), view(spark, sf, "vectors"))
    return hits.select("query_id", "chunk_id", F.round("vector_score", 6).alias("vector_score"), "rank")


@query()
def r6_projection_topk(spark, sf):
    """The same by the projection index; tests/test_nearest.py measures its recall against r6_cosine_topk."""
    queries, vectors = view(spark, sf, "vector_queries"), view(spark, sf, "vectors")
    index = projections.build_index(vectors)
    return projections.projection_topk(queries, index, projections.probes_for(queries, vectors, index))


@query()
def r6_projection_recall(spark, sf):
    """For each query: hits of the exhaustive search, how many the index finds, and the rows it reads."""
    queries, vectors = view(spark, sf, "vector_queries"), view(spark, sf, "vectors")
    index = projections.build_index(vectors)
    probes = projections.probes_for(queries, vectors, index)
    found = projections.recall(projections.projection_topk(queries, index, probes), r.cosine_topk(queries, vectors))
    return found.join(projections.read_share(queries, index, probes), "query_id")


@query(ctes("chunks") + " SELECT source, chunk_type, CAST(grouping(source) * 2 + grouping(chunk_type) AS BIGINT) AS level, count(*) AS n FROM v_chunks GROUP BY GROUPING SETS ((), (source), (chunk_type))")
def r7_index_stats(spark, sf):
    return r.index_stats(view(spark, sf, "chunks"))


_RRF = ctes("lexical", "semantic") + """, f AS (SELECT query_id, chunk_id, bm25_score, l.rank AS bm25_rank, vector_score, s.rank AS vector_rank, coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS raw FROM v_lexical l FULL JOIN v_semantic s USING (query_id, chunk_id)),
g AS (SELECT *, raw / max(raw) OVER (PARTITION BY query_id) AS rrf FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST, chunk_id) AS rank FROM g)"""


@query(_RRF + " SELECT query_id, chunk_id, bm25_score, bm25_rank, vector_score, vector_rank, round(rrf, 6) AS rrf_score, CAST(rank AS INTEGER) AS rank FROM k")
def r8_rrf(spark, sf):
    return r.rrf(view(spark, sf, "lexical"), view(spark, sf, "semantic")).withColumn("rrf_score", F.round("rrf_score", 6))


_HYBRID = _RRF.replace("v_lexical l FULL JOIN v_semantic s", "(SELECT * FROM v_lexical WHERE rank <= 50) l FULL JOIN (SELECT * FROM v_semantic WHERE rank <= 50) s") + """, h AS (SELECT query_id, chunk_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS place FROM k WHERE chunk_id % 4 = 0)
SELECT query_id, chunk_id, round(rrf, 6) AS rrf_score, CAST(place AS INTEGER) AS rank FROM h WHERE place <= 10"""


@query(_HYBRID)
def r9_hybrid_search(spark, sf):
    chunks = view(spark, sf, "vectors").select("chunk_id", F.when(F.col("chunk_id") % 4 == 0, "CIC").otherwise("SIC").alias("source"))
    hits = r.hybrid_search(view(spark, sf, "lexical"), view(spark, sf, "semantic"), chunks, filters={"source": "cic"})
    return hits.select("query_id", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"), "rank")


@query(ctes("lexical") + " SELECT query_id, chunk_id, round(bm25_score / max(bm25_score) OVER (PARTITION BY query_id), 6) AS rrf_score FROM v_lexical")
def r10_normalize_hits(spark, sf):
    return r.normalize_hits(view(spark, sf, "lexical"), "bm25_score").select("query_id", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"))


@query(ctes("lexical", "semantic") + """, u AS (SELECT query_id, chunk_id, bm25_score / 10 AS s FROM v_lexical UNION ALL SELECT query_id, chunk_id, vector_score FROM v_semantic), m AS (SELECT query_id, chunk_id, max(s) AS s FROM u GROUP BY ALL)
SELECT query_id, chunk_id, round(s, 6) AS rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, chunk_id) AS INTEGER) AS rank FROM m""")
def r11_merge_best(spark, sf):
    a = view(spark, sf, "lexical").select("query_id", "chunk_id", "rank", (F.col("bm25_score") / 10).alias("rrf_score"))
    b = view(spark, sf, "semantic").select("query_id", "chunk_id", "rank", F.col("vector_score").alias("rrf_score"))
    return r.merge_best(a, b).select("query_id", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"), "rank")


def _asked(spark, sf):
    return view(spark, sf, "hits").select("query_id").distinct().select("query_id", F.lit("status of the report").alias("text"), F.array(F.lit("8(1)(j)")).alias("sections"), F.lit("fr").alias("request_department"), F.lit("REJECTED").alias("outcome_hint"), F.lit("").alias("info_type"))


_RERANK = ctes("hits") + """, b AS (SELECT *, lower(concat_ws(' ', text, case_number, department, outcome)) AS blob, CASE chunk_type WHEN 'PRECEDENT_SUMMARY' THEN 1 WHEN 'COMMISSION_FINDINGS' THEN 2 WHEN 'FINAL_ORDER' THEN 3 WHEN 'FACTS' THEN 6 ELSE 99 END AS priority FROM v_hits),
s AS (SELECT *, least(greatest(0.45::DOUBLE * rrf_score + CASE WHEN priority < 99 THEN 0.22::DOUBLE - (priority - 1) * 0.025::DOUBLE ELSE 0 END + CASE WHEN contains(regexp_replace(blob, '\\s+', '', 'g'), '8(1)(j)') THEN 0.2::DOUBLE ELSE 0 END
 + CASE WHEN contains(blob, 'fr') THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN contains(blob, 'rejected') THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN chunk_type IN ('PRECEDENT_SUMMARY', 'COMMISSION_FINDINGS', 'FINAL_ORDER') THEN 0.12::DOUBLE ELSE 0 END
 - CASE WHEN chunk_type IN ('RTI_REQUEST', 'FACTS') THEN 0.04::DOUBLE ELSE 0 END, 0), 1) AS score FROM b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, priority, rank, case_number, chunk_id) AS place FROM s)"""


@query(_RERANK + " SELECT query_id, chunk_id, round(score, 6) AS score, CAST(place AS INTEGER) AS rank FROM ranked")
def r12_rerank(spark, sf):
    ranked = r.rerank(view(spark, sf, "hits"), _asked(spark, sf))
    return ranked.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(_RERANK + """, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, case_number ORDER BY place) AS k FROM ranked), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS card FROM f WHERE k = 1)
SELECT query_id, CAST(card AS INTEGER) AS card, case_number AS title, chunk_id, '8(1)(j)' AS relevant_section, round(score, 3) AS confidence FROM c WHERE card <= 8""")
def r13_reference_cards(spark, sf):
    cards = r.reference_cards(r.rerank(view(spark, sf, "hits"), _asked(spark, sf)))
    return cards.select("query_id", "card", "title", "chunk_id", "relevant_section", "confidence")


def _statutes(spark, sf):
    """Sections made of the benchmark items: the first word is the title."""
    return view(spark, sf, "queries").select(F.col("query_id").cast("string").alias("section_number"), (F.col("query_id") + 1).cast("int").alias("position"), F.split("text", " ")[0].alias("title"), F.col("text").alias("section_text"), F.when(F.col("query_id") % 3 == 0, "Appeals").otherwise("").alias("module"), F.array(F.split("text", " ")[1]).alias("keywords"))


@query("""WITH q AS (SELECT conv_id * 1000 + turn AS query_id, list_distinct(list_filter(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' '), lambda w: length(w) > 2)) AS ws, regexp_extract_all(lower(text), 'section\\s+(\\d+)', 1) AS cited FROM conversations),
a AS (SELECT query_id, unnest(ws) AS word FROM q), s AS (SELECT CAST(item_id AS VARCHAR) AS section_number, CAST(item_id + 1 AS INTEGER) AS position, string_split(text, ' ')[1] AS title, text FROM benchmark),
h AS (SELECT section_number, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS word, 1.0::DOUBLE AS v FROM s UNION ALL SELECT section_number, unnest(list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'))), 1.5 FROM s),
x AS (SELECT query_id, section_number, v FROM a JOIN h USING (word)), g AS (SELECT query_id, section_number, least(0.99::DOUBLE, 0.5 + sum(v) / 20) AS score FROM x GROUP BY ALL),
k AS (SELECT query_id, section_number, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, position) AS rank FROM g JOIN s USING (section_number)), b AS (SELECT * FROM k WHERE rank <= 3)
SELECT query_id, section_number, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM b UNION ALL SELECT query_id, section_number, 0.5, position FROM q, s WHERE position <= 3 AND query_id NOT IN (SELECT query_id FROM b)""")
def r14_statute_search(spark, sf):
    q = spark.read.parquet(f"{sf}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return r.statute_search(q, _statutes(spark, sf)).select("query_id", "section_number", F.round("score", 6).alias("score"), "rank")


@query("""WITH q AS (SELECT doc_id AS query_id, lower(coalesce(text, '')) AS t, CAST(embedding AS DOUBLE[]) AS e FROM documents JOIN embeddings ON doc_id = vec_id),
s AS (SELECT CAST(item_id AS VARCHAR) AS section_number, CAST(item_id + 1 AS INTEGER) AS position, CAST(embedding AS DOUBLE[]) AS e FROM benchmark JOIN embeddings ON item_id = vec_id),
c AS (SELECT query_id, section_number, position, contains(t, section_number) AS named, greatest(-1, least(1, coalesce(list_cosine_similarity(q.e, s.e), 0))) AS sim FROM q, s),
k AS (SELECT *, CASE WHEN named THEN least(0.99, sim + 0.15) ELSE sim END AS score FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, position) AS rank FROM k)
SELECT query_id, section_number, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 3""")
def r14_statute_search_dense(spark, sf):
    """Documents with vectors against the benchmark's items as sections, each with the vector of its number."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    queries = view(spark, sf, "docs").join(v, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"), "embedding")
    sections = _statutes(spark, sf).join(v, F.col("section_number").cast("long") == F.col("vec_id")).select("section_number", "position", "embedding")
    return r.statute_search_dense(queries, sections)


@query()
def r15_pack_context(spark, sf):
    """The best hits of a search for every benchmark item over all documents, packed."""
    chunks = view(spark, sf, "chunks")
    hits = r.normalize_hits(r.bm25_search(view(spark, sf, "queries"), r.bm25_stats(chunks)), "bm25_score").join(chunks, "chunk_id")
    return r.pack_context(hits).withColumn("rrf_score", F.round("rrf_score", 6))


_FIRST_SENTENCE = """(WITH c AS (SELECT trim(regexp_replace(regexp_replace(text, '^\\[[A-Z_]+\\]\\s*', ''), '\\s+', ' ', 'g')) AS c) SELECT trim(substr(coalesce(list_filter(string_split(regexp_replace(c, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) >= 40 AND NOT regexp_full_match(s, '\\d+\\.?'))[1], c), 1, 350)) FROM c)"""


@query(ctes("hits") + f""", f AS (SELECT *, row_number() OVER (PARTITION BY query_id, case_number ORDER BY rrf_score DESC, rank, chunk_id) AS k FROM v_hits WHERE source = 'CIC'), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, rank, chunk_id) AS place FROM f WHERE k = 1)
SELECT query_id, CAST(place AS INTEGER) AS place, case_number, chunk_id, rrf_score AS similarity_score, {_FIRST_SENTENCE} AS summary FROM o WHERE place <= 5""")
def r16_similar_cases(spark, sf):
    hits = view(spark, sf, "hits").where("source = 'CIC'")
    return r.similar_cases(hits, hits)


@query(ctes("hits") + """, f AS (SELECT query_id, case_number, min(rank) AS rank FROM v_hits WHERE chunk_id % 7 = 0 GROUP BY ALL) SELECT query_id, list(case_number ORDER BY rank) AS circulars FROM f GROUP BY query_id""")
def r16_relevant_circulars(spark, sf):
    """Hits of which each seventh is of a circular."""
    hits = view(spark, sf, "hits").withColumn("source", F.when(F.col("chunk_id") % 7 == 0, "CIRCULAR").otherwise("CIC"))
    return r.relevant_circulars(hits, hits)


@query(ctes("hits") + """, f AS (SELECT query_id, cited AS section, chunk_id, case_number, row_number() OVER (PARTITION BY query_id, cited ORDER BY rank, chunk_id) AS k FROM v_hits)
SELECT query_id, section, chunk_id, case_number, CASE WHEN section LIKE '8%' THEN 'MEDIUM' ELSE 'LOW' END AS level FROM f WHERE k = 1 AND (query_id % 2 = 1 OR section = '8(1)(j)')""")
def r17_exemption_precedents(spark, sf):
    hits = view(spark, sf, "hits").withColumn("sections_invoked", F.array("cited"))
    asked = hits.select("query_id").distinct().select("query_id", F.when(F.col("query_id") % 2 == 0, F.array(F.lit("8(1)(j)"))).otherwise(F.array().cast("array<string>")).alias("sections"))
    return r.exemption_precedents(asked, hits)


_EVIDENCE = ctes("hits", "queries") + """, g AS (SELECT query_id, least(0.95::DOUBLE, 0.45::DOUBLE + least(0.30::DOUBLE, 0.06::DOUBLE * count(DISTINCT case_number)) + least(0.15::DOUBLE, 0.015::DOUBLE * count(*)) + CASE WHEN bool_or(chunk_type = 'COMMISSION_FINDINGS') THEN 0.1::DOUBLE ELSE 0 END) AS c, list_sort(list_distinct(list(case_number))) AS sources FROM v_hits GROUP BY query_id)
SELECT query_id, round(coalesce(c, 0.25::DOUBLE), 6) AS confidence, coalesce(sources, []) AS sources FROM v_queries LEFT JOIN g USING (query_id)"""


@query(_EVIDENCE)
def r18_evidence_confidence(spark, sf):
    """All hits; queries from 20 on have none."""
    return r.evidence_confidence(view(spark, sf, "queries"), view(spark, sf, "hits")).withColumn("confidence", F.round("confidence", 6))


@query(_EVIDENCE)
def r18_evidence_confidence_all(spark, sf):
    return r18_evidence_confidence(spark, sf)


@query("SELECT doc_id, concat_ws(chr(10), nullif(trim(text), ''), 'Language: ' || lang, 'Sources: ' || source || ', ' || lang) AS query_text FROM documents")
def r19_build_query_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("both", F.array("source", "lang")).withColumn("none", F.lit(""))
    return docs.select("doc_id", r.build_query_text(docs, [("Language", "lang"), ("Nothing", "none"), ("Sources", "both")]).alias("query_text"))


@query("""WITH s AS (SELECT CAST(item_id AS VARCHAR) AS section_number, string_split(text, ' ')[2] AS kw, text, CASE WHEN item_id % 3 = 0 THEN 'Appeals' ELSE 'General' END AS module FROM benchmark)
SELECT module, count(*) AS n, list_sort(list(section_number)) AS sections FROM s WHERE contains(lower(text), 'tion') OR contains(lower(kw), 'tion') GROUP BY module""")
def r20_section_browse(spark, sf):
    return r.section_browse(_statutes(spark, sf), "Tion")


@query(ctes("hits", "queries") + """, g AS (SELECT query_id, count(*) AS n, bool_or(chunk_type = 'COMMISSION_FINDINGS') AS findings, bool_or(cited = '11') AS cites FROM v_hits GROUP BY query_id)
SELECT query_id, coalesce(n, 0) AS n, coalesce(findings, false) AS findings, coalesce(cites, false) AS cites FROM v_queries LEFT JOIN g USING (query_id)""")
def r21_retrieval_relevance(spark, sf):
    return r.retrieval_relevance(view(spark, sf, "queries"), view(spark, sf, "hits").withColumn("sections_invoked", F.array("cited")), "11")
