"""Sources: texts, chunk files, manifests, dimensions, frequency lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = "chunk_id string, case_number string, source string, decision_date string, outcome string, department string, commissioner string, chunk_type string, text string, token_count int, metadata struct<public_authority:string,hearing_date:string,section_name:string,part_index:int,part_count:int,rti_sections:array<string>,keywords:array<string>,date:string,outcome:string,department:string>"
MANIFEST_SCHEMA = "source_url string, downloaded_at timestamp, http_status int, content_type string, content_length bigint, sha256 string, source_name string, crawl_run_id string"


def stable_doc_id(relative: Column) -> Column:
    """The sanitised stem; files in subfolders get `_` and ten hex digits of the sha1 of the relative path."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(relative, r"([^/]+?)(?:\.[^./]*)?$", 1), r"[^A-Za-z0-9._-]+", "_"), r"\A[._-]+|[._-]+\z", "")
    name = F.coalesce(F.nullif(stem, F.lit("")), F.lit("document"))
    return F.when(F.contains(relative, F.lit("/")), F.concat(name, F.lit("_"), F.substring(F.sha1(relative), 1, 10))).otherwise(name)


def relative_path(path: Column, folder: str) -> Column:
    """The part of a file's path below the folder."""
    plain = F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")
    root = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    return F.when(F.startswith(plain, F.lit(root)), F.substring(plain, len(root) + 1, 10_000)).otherwise(plain)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8; bad ones become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def scan_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text, path): all .txt files below the folder but *_meta.txt; blank ones are dropped, bad bytes replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    out = raw.select(relative_path(F.col("path"), folder).alias("path"), decoded(F.col("content")).alias("text")).where(~F.endswith("path", F.lit("_meta.txt")) & (F.trim("text", F.lit(" \n\r\t")) != ""))
    return out.select(stable_doc_id(F.col("path")).alias("doc_id"), "text", "path")


def scan_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of JSON lines; a malformed line fails the read, rows without id or text go, top-level columns win."""
    raw = spark.read.schema(CHUNK_SCHEMA).option("mode", "FAILFAST").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(folder)
    return tidy_chunks(raw)


def tidy_chunks(raw: DataFrame) -> DataFrame:
    full = raw.where((F.coalesce("chunk_id", F.lit("")) != "") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    lifted = {c: F.coalesce(F.nullif(c, F.lit("")), F.col(f"metadata.{c}")) for c in ("outcome", "department")}
    return full.withColumns(lifted).withColumn("decision_date", F.coalesce(F.nullif("decision_date", F.lit("")), "metadata.date"))


def scan_crawl_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Crawl records, one JSON object a file."""
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """Per source: records, bytes, and records whose content or address stands there before."""
    return manifest.groupBy("source_name").agg(F.count("*").alias("records"), F.sum("content_length").alias("bytes"), (F.count("sha256") - F.count_distinct("sha256")).alias("repeated_content"), (F.count("source_url") - F.count_distinct("source_url")).alias("repeated_urls"))


def scan_dimension(spark: SparkSession, path: str, schema: str, wrapper: str = "departments") -> DataFrame:
    """Records of a JSON array, or of an object that holds the array under `wrapper`."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.trim("value").alias("v"))
    items = F.when(F.startswith("v", F.lit("[")), F.from_json("v", f"array<struct<{schema}>>")).otherwise(F.from_json("v", f"struct<{wrapper}:array<struct<{schema}>>>")[wrapper])
    return raw.select(F.explode(items).alias("d")).select("d.*")


def scan_frequency_dict(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq) of tab-separated lines; a byte order mark and malformed lines are dropped."""
    lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", "^﻿", "")), "\t").alias("p"))
    return lines.where(F.size("p") == 2).select(F.trim(F.col("p")[0]).alias("word"), F.trim(F.col("p")[1]).try_cast("bigint").alias("freq")).where("freq is not null and word <> ''")
