"""Sinks and table maintenance."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import cases as case_ops


def _replace(rows: DataFrame, path: str, parts: list[str], keys: list[str]) -> None:
    """Writes rows in partitions by `parts`; rows of the same keys that are there go, all others stay."""
    try:
        there = rows.sparkSession.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        there = None
    if there is not None:
        there = there.withColumns({c: F.col(c).cast(rows.schema[c].dataType) for c in parts})
        # one row for each folder that is touched: dealt out by folder, one task would read a whole one
        touched, new = rows.select(*parts).distinct(), rows.select(*keys).distinct()
        same = lambda a, names: [there[c].eqNullSafe(a[c]) for c in names]
        rows = rows.unionByName(there.join(F.broadcast(touched), same(touched, parts), "left_semi").join(new, same(new, keys), "left_anti"), allowMissingColumns=True)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """A folder for each source; writing a case's chunks again replaces those of that case and source alone."""
    _replace(chunks, path, ["source"], ["source", "case_number"])


def write_case_partitions(cases: DataFrame, path: str) -> None:
    """The layout source/year; a case that is written again is replaced, its neighbours stay."""
    _replace(case_ops.with_layout(cases), path, ["source", "year"], ["source", "case_number"])


def export_cases(cases: DataFrame, path: str) -> None:
    """JSON lines ordered by decision date and case number, nulls first."""
    case_ops.export_order(cases).write.mode("overwrite").json(path)


AUDIT_COLUMNS = ["audit_id", "timestamp", "system_recommended_department", "system_confidence_band", "pio_action_taken", "pio_override_department", "system_reasoning", "previous_hash", "current_hash"]


def export_audit_csv(records: DataFrame, path: str) -> None:
    """Nine columns with a header, all quoted, quotes doubled."""
    records.select(*[F.col(c).cast("string") for c in AUDIT_COLUMNS]).write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def append_page_log(pages: DataFrame, path: str) -> None:
    pages.select("doc_id", "page_no", "ocr_score").write.mode("append").parquet(path)
