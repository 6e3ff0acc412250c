"""Lexical, vector and fused retrieval of many queries over many chunks, reranking, and bounded context.

Ties always fall to the smaller chunk id, so every result has one order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import text as tx
from casewright.sources.scratch import scratch

K1, B, EPSILON = 1.5, 0.75, 0.25
POOL, RRF_K = 50, 60
# Which chunk types count most in reranking.
TYPE_PRIORITY = {
    "PRECEDENT_SUMMARY": 1, "COMMISSION_OBSERVATION": 2, "COMMISSION_OBSERVATIONS": 2, "COMMISSION_FINDINGS": 2, "FINAL_ORDER": 3,
    "PIO_LEARNING_SIGNAL": 4, "INFORMATION_REQUESTED": 5, "FACTS": 6, "ENTITY_CONTEXT": 7,
}


# --- lexical index and search -----------------------------------------------------------------------------------------


@dataclass
class LexicalIndex:
    """postings (term, chunk_id, tf, length) and terms (term, df, idf, avg_length)."""

    postings: DataFrame
    terms: DataFrame


def bm25_stats(chunks: DataFrame, text: str = "text") -> LexicalIndex:
    """Postings, written once; terms and the averages come from them. A negative idf becomes EPSILON times the mean idf."""
    spark = chunks.sparkSession
    # a text is smaller than its postings, and dealing texts out evenly keeps large files from being one task's work
    even = chunks.select("chunk_id", text).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk_id")
    tokens = even.select("chunk_id", tx.legal_tokens(F.col(text)).alias("tokens"))
    made = tokens.withColumn("length", F.size("tokens")).select("chunk_id", "length", tx.each(F.col("tokens")).alias("term")).where("term is not null").groupBy("term", "chunk_id", "length").agg(F.count("*").alias("tf"))
    path = scratch(spark, "postings")
    made.write.parquet(path)
    postings = spark.read.schema(made.schema).parquet(path)
    df = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    sizes = df.agg(F.sum("tf").alias("tokens")).join(F.broadcast(chunks.agg(F.count("*").alias("n")))).select("n", (F.coalesce("tokens", F.lit(0)) / F.col("n")).alias("avg_length"))  # one row each
    raw = df.join(F.broadcast(sizes)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # sizes is one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"), "avg_length")
    return LexicalIndex(postings, terms)


def _asked(queries: DataFrame, index: LexicalIndex) -> DataFrame:
    """(query_id, term, times, idf, avg_length) of the words of queries that the index holds."""
    asked = queries.select("query_id", tx.each(tx.legal_tokens(F.col("text"))).alias("term")).where("term is not null").groupBy("query_id", "term").agg(F.count("*").alias("times"))
    return asked.join(index.terms, "term").select("query_id", "term", "times", "idf", "avg_length")


def _weight() -> Column:
    tf = F.col("tf").cast("double")
    return (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))


def _part() -> Column:
    return F.col("times") * F.col("idf") * _weight()


def bm25_bounds(index: LexicalIndex) -> DataFrame:
    """(term, largest): what a word's best posting is worth, over its idf. Made once for an index, and written."""
    spark = index.postings.sparkSession
    average = index.terms.select("avg_length").limit(1)
    made = index.postings.join(F.broadcast(average)).groupBy("term").agg(F.max(_weight()).alias("largest"))  # average is one row
    path = scratch(spark, "bounds")
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def bm25_search(queries: DataFrame, index: LexicalIndex, k: int = 20) -> DataFrame:
    """queries (query_id, text) as query_id, chunk_id, bm25_score, rank. A repeated query word counts each time."""
    scored = _asked(queries, index).join(index.postings, "term").groupBy("query_id", "chunk_id").agg(F.sum(_part()).alias("bm25_score")).where("bm25_score > 0")
    return top(scored, "bm25_score", k)


@dataclass
class BoundedSearch:
    """hits as of `bm25_search`, and how many postings were scored, of how many that hold a query word."""

    hits: DataFrame
    scored: DataFrame


def bm25_search_bounded(queries: DataFrame, index: LexicalIndex, bounds: DataFrame, k: int = 20, first: float = 0.5) -> BoundedSearch:
    """The hits of `bm25_search` without scoring every posting of every query word.

    bounds (`bm25_bounds`) tell what a word adds at most; rare words add most. Each query's words are taken in that order
    until they make up the share `first` of what all can add; scoring their postings gives chunks and, by the k-th
    best of them, a threshold that the k-th best score reaches at least. If the other words together cannot reach it, only
    chunks seen already can be hits, and of those only the ones that the other words can lift to it: their postings
    alone are looked up, by word and chunk. Queries whose other words could reach the threshold are scored in full, as are
    words of negative weight, for which the bound does not hold.
    """
    spark = queries.sparkSession
    path = scratch(spark, "bounded")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")
    words = _asked(queries, index).join(bounds, "term").withColumn("most", F.greatest(F.col("times") * F.col("idf") * F.col("largest"), F.lit(0.0))).drop("largest")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    words = words.withColumn("early", (F.col("idf") < 0) | (before < first * F.sum("most").over(Window.partitionBy("query_id"))))
    words = kept(words, "words")
    late = words.where("not early").groupBy("query_id").agg(F.sum("most").alias("rest"))
    begun = kept(words.where("early").join(index.postings, "term").groupBy("query_id", "chunk_id").agg(F.sum(_part()).alias("score"), F.count("*").alias("n")), "begun")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    least = begun.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    asked = words.select("query_id").distinct().join(late, "query_id", "left").join(least, "query_id", "left")
    # a hair below the threshold counts as reaching it: sums in another order differ in their last digits
    closed = F.coalesce(F.col("rest"), F.lit(0.0)) < F.coalesce(F.col("least"), F.lit(0.0)) * (1 - 1e-9)
    plan = kept(asked.select("query_id", F.coalesce("rest", F.lit(0.0)).alias("rest"), F.coalesce("least", F.lit(0.0)).alias("least"), (closed | F.col("rest").isNull()).alias("closed")), "plan")
    able = kept(begun.join(plan.where("closed"), "query_id").where(F.col("score") + F.col("rest") >= F.col("least") * (1 - 1e-9)).select("query_id", "chunk_id"), "able")
    # of open queries every posting of the late words counts, of closed ones those of chunks that can still be hits
    late_words = words.where("not early")
    open_parts = late_words.join(plan.where("not closed").select("query_id"), "query_id").join(index.postings, "term").select("query_id", "chunk_id", _part().alias("part"))
    closed_parts = late_words.join(able, "query_id").join(index.postings, ["term", "chunk_id"]).select("query_id", "chunk_id", _part().alias("part"))
    more = kept(open_parts.unionByName(closed_parts), "more")
    closed_begun = begun.join(able, ["query_id", "chunk_id"], "left_semi")
    open_begun = begun.join(plan.where("not closed").select("query_id"), "query_id", "left_semi")
    scores = closed_begun.unionByName(open_begun).select("query_id", "chunk_id", F.col("score").alias("part")).unionByName(more)
    scored = scores.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("bm25_score")).where("bm25_score > 0")
    held = words.join(index.terms.select("term", "df"), "term").groupBy("query_id").agg(F.sum("df").alias("postings"))
    read = begun.select("query_id", "n").unionByName(more.select("query_id", F.lit(1).cast("long").alias("n"))).groupBy("query_id").agg(F.sum("n").alias("scored"))
    return BoundedSearch(top(scored, "bm25_score", k), held.join(read, "query_id", "left").select("query_id", F.coalesce("scored", F.lit(0)).alias("scored"), "postings"))


def top(hits: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def metadata_filter(filters: dict, columns: list[str]) -> Column:
    """All filters at once: equal without case; `year` is a prefix of decision_date; null and empty values ask nothing."""
    out = F.lit(True)
    for key, value in filters.items():
        if value in (None, ""):
            continue
        if key == "year":
            out = out & F.startswith(F.coalesce(F.col("decision_date").cast("string"), F.lit("")), F.lit(str(value)))
        else:
            actual = F.col(key).cast("string") if key in columns else F.lit("")
            out = out & (F.lower(F.coalesce(actual, F.lit(""))) == str(value).lower())
    return out


# --- stored vectors ---------------------------------------------------------------------------------------------------


def add_missing(store: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose id the store does not hold, once each."""
    return chunks.join(store.select("chunk_id"), "chunk_id", "left_anti").dropDuplicates(["chunk_id"])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


VECTORS = 2048  # vectors in a block


def nearest_in_blocks(k: int, least: float):
    """Blocks of queries and vectors to the k nearest of each query by cosine, of `least` at least; equal ones by the smaller id."""
    import numpy as np
    import pyarrow as pa

    def matrix(vectors) -> tuple[np.ndarray, np.ndarray]:
        """Rows of an Arrow list of vectors, filled up with not-numbers, and their lengths."""
        offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False).astype(float)
        n = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        x = np.full((len(n), int(n.max(initial=0))), np.nan)
        at = np.arange(x.shape[1]) < n[:, None]
        x[at] = flat[(offsets[:-1, None] + np.arange(x.shape[1]))[at]]
        return x, np.sqrt((x * x).sum(axis=1))

    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                q_ids, c_ids = batch.column(0)[r].values, batch.column(2)[r].values
                (q, qn), (c, cn) = matrix(batch.column(1)[r].values), matrix(batch.column(3)[r].values)
                if q.shape[1] == c.shape[1]:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        score = np.nan_to_num((q @ c.T) / np.outer(qn, cn), nan=0.0)
                else:
                    score = np.zeros((len(q), len(c)))
                score = np.clip(score, least, 1.0)
                order = np.argsort(np.argsort(c_ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
                best = np.stack([np.lexsort((order, -np.round(s, 9)))[:k] for s in score]) if len(q) else np.zeros((0, 0), int)
                row = np.repeat(np.arange(len(q)), best.shape[1])
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row)), c_ids.take(pa.array(best.ravel())), pa.array(score[row, best.ravel()])], names=["query_id", "chunk_id", "vector_score"])

    return run


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, least: float = 0.0) -> DataFrame:
    """queries and vectors (chunk_id, embedding): the k nearest by cosine, as a score clamped to least..1.

    The query set meets the vectors in blocks of VECTORS each, as matrix products; their number grows with the vectors. A
    vector that is null, holds a null or a not-number, or has another length than the query scores 0.
    """

    def blocks(df: DataFrame, key: str, short: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // VECTORS))
        part = F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("g")
        held = df.select(part, F.struct(F.col(key).alias("i"), F.col("embedding").alias("e")).alias("x")).groupBy("g").agg(F.collect_list("x").alias("x"))
        return held.select("g", F.col("x.i").alias(f"{short}i"), F.col("x.e").alias(f"{short}e")), n

    v, n = blocks(vectors, "chunk_id", "c")
    q, _ = blocks(queries, "query_id", "q")
    q = q.select("qi", "qe", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("g"))
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "chunk_id": vectors.schema["chunk_id"].dataType.simpleString()}
    # arrays count for little in Spark's estimates, so it would send all blocks through the driver
    cut = q.hint("merge").join(v.hint("merge"), "g").select("qi", "qe", "ci", "ce").mapInArrow(nearest_in_blocks(k, least), f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, vector_score double")
    return top(cut, "vector_score", k)


def index_stats(chunks: DataFrame) -> DataFrame:
    """Rows in all, by source and by chunk type, in one pass."""
    return chunks.groupingSets([[], [F.col("source")], [F.col("chunk_type")]], F.col("source"), F.col("chunk_type")).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


# --- fusion -----------------------------------------------------------------------------------------------------------


def rrf(lexical: DataFrame, vector: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists, over the best score of each query; lexical hits first on ties."""
    a = lexical.select("query_id", "chunk_id", "bm25_score", F.col("rank").alias("bm25_rank"))
    b = vector.select("query_id", "chunk_id", "vector_score", F.col("rank").alias("vector_rank"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    raw = F.coalesce(1 / (k + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("vector_rank")), F.lit(0.0))
    fused = both.withColumn("raw", raw)
    fused = fused.withColumn("rrf_score", F.col("raw") / F.max("raw").over(Window.partitionBy("query_id")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).drop("raw")


# What a search mode asks beside the given filters.
MODE_FILTERS = {"commission_findings": {"chunk_type": "COMMISSION_FINDINGS"}, "circulars": {"source": "CIRCULAR"}}


def normalize_hits(hits: DataFrame, score: str) -> DataFrame:
    """score over the query's largest."""
    best = F.max(score).over(Window.partitionBy("query_id"))
    return hits.withColumn("rrf_score", F.greatest(F.lit(0.0), F.col(score) / F.when(best == 0, 1.0).otherwise(best)))


def hybrid_search(lexical: DataFrame, vector: DataFrame, chunks: DataFrame, mode: str = "hybrid", filters: dict | None = None, k: int = 10, filter_mode: str = "post") -> DataFrame:
    """Pools of POOL from each side are fused, then filtered, then numbered anew.

    Queries with one empty side get the other side's scores over their largest. filter_mode "pre" filters the pools' input
    instead, so that rare chunks are found too.
    """
    asked = {**(filters or {}), **MODE_FILTERS.get(mode, {})}
    keep = chunks.where(metadata_filter(asked, chunks.columns))
    if filter_mode == "pre":
        ids = keep.select("chunk_id")
        lexical, vector = (top(x.drop("rank").join(ids, "chunk_id", "left_semi"), s, POOL) for x, s in ((lexical, "bm25_score"), (vector, "vector_score")))
    lexical, vector = lexical.where(F.col("rank") <= POOL), vector.where(F.col("rank") <= POOL)
    if mode in ("bm25", "vector"):
        own, score = (lexical, "bm25_score") if mode == "bm25" else (vector, "vector_score")
        hits = normalize_hits(own.join(keep, "chunk_id"), score)
    else:
        w = Window.partitionBy("query_id")
        fused = rrf(lexical, vector).withColumn("has_bm25", F.max(F.col("bm25_rank").isNotNull()).over(w)).withColumn("has_vector", F.max(F.col("vector_rank").isNotNull()).over(w))
        fused = fused.join(keep, "chunk_id")
        alone = F.when(~F.col("has_vector"), F.col("bm25_score") / F.max("bm25_score").over(w)).when(~F.col("has_bm25"), F.col("vector_score") / F.max("vector_score").over(w))
        hits = fused.withColumn("rrf_score", F.coalesce(alone, F.col("rrf_score"))).drop("has_bm25", "has_vector")
    order = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("rank").withColumnRenamed("place", "rank")


def merge_best(*hits: DataFrame) -> DataFrame:
    """The union of result sets with each chunk's best score, ranked."""
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    best = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("rrf_score"), "rank")
    one = every.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "rank")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "chunk_id")))


# --- reranking and cards ----------------------------------------------------------------------------------------------

_REASONED = ["PRECEDENT_SUMMARY", "COMMISSION_OBSERVATION", "COMMISSION_OBSERVATIONS", "COMMISSION_FINDINGS", "FINAL_ORDER", "PIO_LEARNING_SIGNAL"]
COMMITTEE_WORDS = r"(?i)\b(committee|report|proceedings?|members?|compliance|follow\s+up|status)\b"


def priority_of(chunk_type: Column) -> Column:
    pairs = [F.lit(x) for kv in TYPE_PRIORITY.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), chunk_type), F.lit(99))


def rerank(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """hits with the request's sections (array), department, outcome_hint, info_type, text: score, reasons, new rank."""
    h = hits.join(requests.withColumnRenamed("text", "request_text"), "query_id")
    squash = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    blob = F.lower(F.concat_ws(" ", "text", "case_number", "department", "outcome"))
    priority = priority_of(F.col("chunk_type"))
    has_section = F.exists("sections", lambda s: (s != "") & F.contains(squash(F.col("_blob")), squash(s)))
    asks = lambda c: (F.coalesce(F.col(c), F.lit("")) != "")
    dept = asks("request_department") & F.contains(F.col("_blob"), F.lower("request_department"))
    outcome = asks("outcome_hint") & F.contains(F.col("_blob"), F.lower("outcome_hint"))
    info = asks("info_type") & F.contains(F.col("_blob"), F.translate(F.lower("info_type"), "_", " "))
    committee = F.concat_ws(" ", "request_text", "info_type", "request_department").rlike(COMMITTEE_WORDS)
    reasoned = F.col("chunk_type").isin(_REASONED)
    h = h.withColumn("_blob", blob)
    plus = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    score = (
        0.45 * F.coalesce("rrf_score", F.lit(0.0)) + plus(priority < 99, F.greatest(F.lit(0.0), 0.22 - (priority - 1) * 0.025)) + plus(has_section, 0.20) + plus(dept, 0.12)
        + plus(outcome, 0.08) + plus(info, 0.06) + plus(committee & reasoned, 0.12) - plus(committee & F.col("chunk_type").isin("RTI_REQUEST", "INFORMATION_REQUESTED", "FACTS"), 0.04)
    )
    why = [(has_section, F.lit("section")), (dept, F.lit("department")), (outcome, F.lit("outcome")), (info, F.lit("information type")), (priority < 99, F.concat(F.lit("chunk type "), "chunk_type")), (committee & reasoned, F.lit("committee"))]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), t) for c, t in why]))
    out = h.select("query_id", *[c for c in hits.columns if c not in ("query_id", "rank")], F.col("rank").alias("old_rank"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"), reasons.alias("reasons"), priority.alias("priority"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "priority", "old_rank", "case_number", "chunk_id")
    return out.withColumn("rank", F.row_number().over(order))


def reference_cards(ranked: DataFrame, limit: int = 8) -> DataFrame:
    """The best chunk of each case title, `limit` cards a query, with a short passage and summary."""
    title = F.coalesce(F.nullif("case_number", F.lit("")), F.concat(F.coalesce("source", F.lit("")), F.lit(" reference")))
    first = Window.partitionBy("query_id", "title").orderBy("rank")
    bare = F.trim(F.regexp_replace(tx.squeeze(F.col("text")), r"^\s*\[[A-Z_]+\]\s*", ""))
    label = F.when(F.col("chunk_type").isin("COMMISSION_OBSERVATION", "COMMISSION_OBSERVATIONS", "COMMISSION_FINDINGS", "FINAL_ORDER"), "Commission reasoning: ").when(F.col("chunk_type").isin("RTI_REQUEST", "INFORMATION_REQUESTED", "FACTS"), "Request context: ").when(F.col("chunk_type") == "PIO_LEARNING_SIGNAL", "PIO learning: ").otherwise("")
    extras = F.slice(F.array_compact(F.array(F.when(F.coalesce("department", F.lit("")) != "", F.concat(F.lit("Authority: "), "department")), F.when(F.coalesce("outcome", F.lit("")) != "", F.concat(F.lit("Outcome: "), F.initcap(F.translate("outcome", "_", " ")))))), 1, 2)
    brief = tx.compact(F.concat(label, bare), 260)
    summary = tx.compact(F.when(F.size(extras) > 0, F.concat(brief, F.lit(" "), F.array_join(extras, " | "), F.lit("."))).otherwise(brief), 360)
    section = F.regexp_replace(F.regexp_extract("text", r"(?i)\b(?:Section|Sec\.?|S\.|u/s)\s*([0-9]+(?:\([0-9a-z]\))?(?:\([a-z]\))?)", 1), r"\s+", "")
    cards = ranked.withColumn("title", title).withColumn("_k", F.row_number().over(first)).where("_k = 1")
    cards = cards.withColumn("card", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("card") <= limit)
    return cards.select("query_id", "card", "title", "chunk_id", "chunk_type", "outcome", section.alias("relevant_section"), tx.compact(F.col("text"), 620).alias("passage"), summary.alias("summary"), F.round("score", 3).alias("confidence"))


# --- statutes ---------------------------------------------------------------------------------------------------------


def statute_search(queries: DataFrame, sections: DataFrame, k: int = 3) -> DataFrame:
    """Sections by words in common: 1 for a word of the text, 1.5 of the title, 10 if cited; min(.99, .5 + s / 20).

    Distinct query words of over two letters are joined to the words' sections, so no query meets a section in vain; a
    query without a match gets the first k sections at .5.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(F.lower(tx.squeeze(F.col("text"))), " "), lambda w: F.length(w) > 2))).alias("word"))
    held = lambda c, v: sections.select("section_number", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0))).alias("word"), F.lit(v).alias("value"))
    cited = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"section\s+(\d+)"), 1))).alias("section_number")).withColumn("value", F.lit(10.0))
    hits = asked.join(held("section_text", 1.0).unionByName(held("title", 1.5)), "word").select("query_id", "section_number", "value")
    hits = hits.unionByName(cited.join(sections.select("section_number"), "section_number").select("query_id", "section_number", "value"))
    scored = hits.groupBy("query_id", "section_number").agg(F.least(F.lit(0.99), 0.5 + F.sum("value") / 20).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "position")
    best = scored.join(sections.select("section_number", "position"), "section_number").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("position")
    first = sections.where(F.col("position") <= k).select("section_number", F.lit(0.5).alias("score"), F.col("position").alias("rank"))
    rest = queries.select("query_id").join(best.select("query_id").distinct(), "query_id", "left_anti").join(F.broadcast(first))  # k rows
    return best.unionByName(rest.select(*best.columns))


def statute_search_dense(queries: DataFrame, sections: DataFrame, k: int = 3) -> DataFrame:
    """queries (query_id, text, embedding) to the k sections nearest by cosine; .15 more, up to .99, for a section the text names.

    sections (section_number, position, embedding) are a statute, so their numbers travel as one array beside each query.
    The best k are among the k nearest and the named ones, whose scores only rise.
    """
    table = sections.agg(F.sort_array(F.collect_list(F.struct("section_number", "position", "embedding"))).alias("table"))
    held = F.filter("table", lambda s: F.contains(F.col("low"), F.replace(F.lower(s["section_number"]), F.lit("section "), F.lit(""))))
    low = queries.select("query_id", "embedding", F.lower("text").alias("low"))
    named = low.join(F.broadcast(table)).withColumn("held", held).select("query_id", "embedding", F.explode("held").alias("s")).select("query_id", "embedding", "s.section_number", "s.position", F.col("s.embedding").alias("own"))  # table is one row
    norm = F.sqrt(_dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(_dot(F.col("own"), F.col("own")))
    cosine = F.coalesce(F.try_divide(_dot(F.col("embedding"), F.col("own")), norm), F.lit(0.0))
    named = named.select("query_id", "section_number", "position", F.least(F.lit(0.99), cosine + 0.15).alias("score"))
    near = cosine_topk(queries, sections.select(F.col("position").alias("chunk_id"), "embedding"), k, -1.0).select("query_id", F.col("chunk_id").alias("position"), F.col("vector_score").alias("score"))
    near = near.join(sections.select("section_number", "position"), "position").join(named, ["query_id", "section_number"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "position")
    out = named.unionByName(near.select(*named.columns)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "section_number", F.round("score", 4).alias("score"), "rank")


def section_browse(sections: DataFrame, needle: str) -> DataFrame:
    """Sections that hold the needle in a column or keyword, grouped by module (General if none)."""
    low = needle.lower()
    seen = F.exists("keywords", lambda k: F.contains(F.lower(k), F.lit(low)))
    for c in ("section_number", "title", "section_text", "module"):
        seen = seen | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(low))
    return sections.where(F.coalesce(seen, F.lit(False))).groupBy(F.coalesce(F.nullif("module", F.lit("")), F.lit("General")).alias("module")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("section_number")).alias("sections"))


# --- context ----------------------------------------------------------------------------------------------------------


# The order in which chunk types enter a context.
CONTEXT_PRIORITY = ["COMMISSION_FINDINGS", "SECTION_ANALYSIS", "DIRECTIONS", "PUBLIC_INTEREST", "PENALTY_REASONING", "GROUNDS_FOR_APPEAL", "FAA_ORDER", "CPIO_REPLY", "RTI_REQUEST", "FULL_SUMMARY"]
LABEL_TOKENS, LEAST_TEXT = 12, 30


def pack_context(hits: DataFrame, budget: int = 3500, stop_when_full: bool = False) -> DataFrame:
    """Hits that fit a query's token budget: the best findings first, then by type and score, cut to fit or skipped.

    The choice depends on what came before, so it is a fold over the query's sorted pool (which is at most as long as the
    pool of a search). The result is in order of relevance. With stop_when_full the first misfit ends the query, and types
    outside the list do not enter.
    """
    one = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("rrf_score"), "rank")
    pool = hits.where("text is not null and text <> ''").withColumn("_k", F.row_number().over(one)).where("_k = 1")
    place = F.array_position(F.array(*map(F.lit, CONTEXT_PRIORITY)), F.col("chunk_type"))
    place = F.when(place == 0, 999).otherwise(place)
    lead = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 9)), "rank", "chunk_id")
    found = F.col("chunk_type") == "COMMISSION_FINDINGS"
    pool = pool.withColumn("_first", F.row_number().over(Window.partitionBy("query_id", found).orderBy(F.desc(F.round("rrf_score", 9)), "rank", "chunk_id")))
    pool = pool.withColumn("_place", F.when(found & (F.col("_first") == 1), 0).otherwise(place))
    if stop_when_full:
        pool = pool.where("_place < 999")
    item = F.struct("_place", (-F.round("rrf_score", 9)).alias("_score"), "rank", "chunk_id", "chunk_type", "case_number", "rrf_score", tx.word_count(F.col("text")).alias("words"))
    sorted_pool = pool.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    tokens = lambda w: F.greatest(F.lit(1), F.bround(w * F.lit(1.3)).cast("int"))
    empty = "array<struct<chunk_id:bigint,kept_words:int,tokens:int>>"

    def step(acc, x):
        left = F.lit(budget) - acc["used"]
        whole = tokens(x["words"]) + LABEL_TOKENS
        room = F.floor((left - LABEL_TOKENS - 3) / 1.3).cast("int")
        cut = F.least(room, x["words"])
        some = (left - LABEL_TOKENS - 3 >= LEAST_TEXT) & (cut > 0)
        kept = F.when(acc["full"], F.lit(0)).when(whole <= left, x["words"]).when(some, cut).otherwise(0)
        cost = F.when(kept > 0, tokens(kept) + LABEL_TOKENS).otherwise(0)
        chosen = F.when(kept > 0, F.array_append(acc["chosen"], F.struct(x["chunk_id"].cast("long").alias("chunk_id"), kept.cast("int").alias("kept_words"), cost.cast("int").alias("tokens")))).otherwise(acc["chosen"])
        return F.struct((acc["used"] + cost).cast("int").alias("used"), (acc["full"] | (F.lit(stop_when_full) & (kept < x["words"]))).alias("full"), chosen.alias("chosen"))

    zero = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast(empty).alias("chosen"))
    packed = sorted_pool.select("query_id", tx.each(F.aggregate("items", zero, step)["chosen"]).alias("c")).where("c is not null").select("query_id", "c.*")
    out = packed.join(pool.select("query_id", "chunk_id", "chunk_type", "case_number", "rrf_score", "rank"), ["query_id", "chunk_id"])
    return out.withColumn("position", F.row_number().over(lead)).drop("rank")


# --- what a set of hits says ------------------------------------------------------------------------------------------


TYPE_MARK, SENTENCE_END = r"\A\[[A-Z_]+\]\s*", r"(?<=[.!?])\s+"


def first_sentence(text: Column, least: int = 40, most: int = 350) -> Column:
    """The first part of a chunk, without its type mark and cut after any of .!? and blanks, that has so many characters; else the text's start."""
    clean = tx.squeeze(F.translate(F.regexp_replace(tx.blank_if_null(text), TYPE_MARK, ""), "\0", " "))
    parts = F.filter(F.split(clean, SENTENCE_END), lambda s: (F.length(s) >= least) & ~s.rlike(r"\A\d+\.?\z"))
    return F.trim(F.substring(F.coalesce(F.try_element_at(parts, F.lit(1)), clean), 1, most))


def similar_cases(hits: DataFrame, cited: DataFrame, limit: int = 5) -> DataFrame:
    """The best chunk of each cited case by score, then rank, `limit` cases a query, with its score from 0 to 1 and first sentence."""
    own = hits.join(cited.select("query_id", "case_number").distinct(), ["query_id", "case_number"], "left_semi")
    order = [F.desc(F.coalesce("rrf_score", F.lit(0.0))), "rank", "chunk_id"]
    best = own.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "case_number").orderBy(*order))).where("_k = 1").drop("_k")
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= limit)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("rrf_score", F.lit(0.0))))
    return best.select("query_id", "place", "case_number", "chunk_id", score.alias("similarity_score"), first_sentence(F.col("text")).alias("summary"))


def relevant_circulars(hits: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, circulars): numbers of the cited circulars among the hits, each once, in the order of the hits."""
    own = hits.where("source = 'CIRCULAR'").join(cited.select("query_id", "case_number").distinct(), ["query_id", "case_number"], "left_semi")
    first = own.groupBy("query_id", "case_number").agg(F.min(F.struct("rank", "chunk_id")).alias("at"))
    return first.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "case_number"))), lambda x: x["case_number"]).alias("circulars"))


def exemption_precedents(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """For each section of a request (or, if it has none, of its hits) the best-ranked hit that cites it, and a level."""
    cited = hits.select("query_id", "rank", "chunk_id", "case_number", F.explode("sections_invoked").alias("section"))
    own = requests.select("query_id", F.explode("sections").alias("section")).distinct()
    rest = cited.join(own.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "section").distinct()
    best = cited.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "section").orderBy("rank", "chunk_id"))).where("_k = 1")
    wanted = own.unionByName(rest)
    return best.join(wanted, ["query_id", "section"]).select("query_id", "section", "chunk_id", "case_number", F.when(F.startswith("section", F.lit("8")), "MEDIUM").otherwise("LOW").alias("level"))


def evidence_confidence(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """.25 without hits, else .45 + min(.30, .06 cases) + min(.15, .015 hits) + .10 with findings, at most .95."""
    seen = hits.groupBy("query_id").agg(F.count_distinct("case_number").alias("cases"), F.count("*").alias("hits"), F.bool_or(F.col("chunk_type") == "COMMISSION_FINDINGS").alias("findings"), F.sort_array(F.collect_set("case_number")).alias("sources"))
    score = F.least(F.lit(0.95), 0.45 + F.least(F.lit(0.30), 0.06 * F.col("cases")) + F.least(F.lit(0.15), 0.015 * F.col("hits")) + F.when(F.col("findings"), 0.10).otherwise(0.0))
    return queries.select("query_id").join(seen, "query_id", "left").select("query_id", F.when(F.col("cases").isNull(), 0.25).otherwise(score).alias("confidence"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def build_query_text(requests: DataFrame, fields: list[tuple[str, str]]) -> Column:
    """Non-empty fields as `label: value` lines under the request's text."""
    lines = [F.nullif(F.trim("text"), F.lit(""))]
    for label, c in fields:
        value = F.array_join(c, ", ") if dict(requests.dtypes)[c].startswith("array") else F.col(c).cast("string")
        lines.append(F.when(F.coalesce(F.trim(value), F.lit("")) != "", F.concat(F.lit(f"{label}: "), value)))
    return F.concat_ws("\n", *lines)


def retrieval_relevance(queries: DataFrame, hits: DataFrame, section: str) -> DataFrame:
    """Hits of each query, whether any is a finding, and whether any cites the section."""
    seen = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.bool_or(F.col("chunk_type") == "COMMISSION_FINDINGS").alias("findings"), F.bool_or(F.array_contains("sections_invoked", section)).alias("cites"))
    return queries.select("query_id").join(seen, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("findings", F.lit(False)).alias("findings"), F.coalesce("cites", F.lit(False)).alias("cites"))
