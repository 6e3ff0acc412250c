"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last give the columns of
`documents`. Between stages the rows are written as Parquet and read again.

Defined cases, for every stage: an empty table gives no rows; further columns, whatever their names, pass through all
stages but the last; null and empty texts are scored by the first stage, and no later one but the last does anything to
them; rows without a doc_id pass the near-duplicates all, lose in the third stage what named documents hold, and are
packed with null ids. Rows that repeat a doc_id are scored each; one of them stays in the second stage, also where their
texts differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import decontaminate, near_dup, packing, quality, substrings
from casewright.llm.work import Work, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored, score = quality.classify(docs, read(spark, sf_dir, "labels"))
    return scored.where(F.col(score) >= quality.CUT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays."""
    return near_dup.drop_near_duplicates(docs, num=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that start in an earlier document go; n_chars follows the text."""
    return substrings.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item (or a whole shorter item) go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

#: Discriminants, components and packings are no SQL: tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    work = Work(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.table(docs, name)
    return docs
