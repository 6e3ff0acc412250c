"""Tables of OCR results: pages with scores, cells of tables, nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import text as tx


def low_confidence_pages(pages: DataFrame, least: float = 0.6) -> DataFrame:
    """Pages without a score or below `least`."""
    return pages.where(F.col("ocr_score").isNull() | (F.col("ocr_score") < least))


def merge_page_sources(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(doc_id, page_no, text, source): the fallback's text where it has one."""
    f = fallback.select("doc_id", "page_no", F.nullif(F.trim("text"), F.lit("")).alias("_text"))
    j = primary.join(f, ["doc_id", "page_no"], "left")
    return j.select("doc_id", "page_no", F.coalesce("_text", "text").alias("text"), F.when(F.col("_text").isNotNull(), "fallback").otherwise("primary").alias("source"))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """One text for each document: pages in order, each under its comment."""
    part = F.concat(F.lit("<!-- page "), F.col("page_no").cast("string"), F.lit(" -->\n"), tx.blank_if_null(F.col("text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("text"))


def document_confidence(pages: DataFrame, warn: float = 0.85) -> DataFrame:
    """The mean score of a document's pages (native pages count 1.0, none at all gives 1.0), and whether to warn."""
    score = F.coalesce(F.avg(F.when(F.col("source") == "native", 1.0).otherwise(F.col("ocr_score"))), F.lit(1.0))
    return pages.groupBy("doc_id").agg(score.alias("confidence")).withColumn("warn", F.col("confidence") < warn)


def _grid(cells: DataFrame) -> DataFrame:
    """(table_id, row, texts by column); cells outside the table's stated size are ignored."""
    inside = cells.where((F.col("row") < F.col("n_rows")) & (F.col("col") < F.col("n_cols")) & (F.col("row") >= 0) & (F.col("col") >= 0))
    size = cells.groupBy("table_id").agg(F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols")).where("n_rows > 0 and n_cols > 0")
    filled = inside.groupBy("table_id", "row").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("col", "text")))).alias("by_col"))
    rows = size.select("table_id", "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row")).join(filled, ["table_id", "row"], "left")
    texts = F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda c: F.coalesce(F.try_element_at("by_col", c), F.lit("")))
    return rows.select("table_id", "row", "n_cols", texts.alias("texts"))


def table_to_markdown(cells: DataFrame) -> DataFrame:
    line = F.concat(F.lit("| "), F.array_join("texts", " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n_cols")), " | "), F.lit(" |"))
    rows = _grid(cells).withColumn("line", F.when(F.col("row") == 0, F.concat(line, F.lit("\n"), rule)).otherwise(line))
    return rows.groupBy("table_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def table_to_tsv(cells: DataFrame) -> DataFrame:
    rows = _grid(cells).withColumn("line", F.array_join("texts", "\t"))
    return rows.groupBy("table_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("tsv"))


def document_counts(nested: DataFrame) -> DataFrame:
    """nested (doc_id, pages array of (elements array of (kind, text))): pages, elements, tables, characters."""
    elements = F.flatten(F.transform("pages", lambda p: p["elements"]))
    chars = F.aggregate(elements, F.lit(0), lambda n, e: n + F.coalesce(F.length(e["text"]), F.lit(0)))
    return nested.select("doc_id", F.size("pages").alias("pages"), F.size(elements).alias("elements"), F.size(F.filter(elements, lambda e: e["kind"] == "table")).alias("tables"), chars.alias("chars"))


def page_flags(*flags: tuple[Column, str]) -> Column:
    """Names of the flags that hold, joined by commas; `none` if none does."""
    return F.coalesce(F.nullif(F.concat_ws(", ", *[F.when(c, n) for c, n in flags]), F.lit("")), F.lit("none"))


def digital_or_scanned(pages: DataFrame) -> DataFrame:
    """Digital if every page has over 50 characters; `by_mean`: scanned if pages have under 20 on average."""
    n = F.length(F.trim(tx.blank_if_null(F.col("text"))))
    return pages.groupBy("doc_id").agg(F.when(F.bool_and(n > 50), "digital").otherwise("scanned").alias("by_pages"), F.when(F.avg(n) < 20, "scanned").otherwise("digital").alias("by_mean"))
