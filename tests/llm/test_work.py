"""Working tables leave no shuffle files behind, and their texts go to Python in small batches."""

import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from casewright.llm.work import BATCH, CLEANUP, KEPT, Work, sparing


def test_shuffle_files_of_a_written_table_go(spark):
    local = Path(spark.sparkContext.getConf().get("spark.local.dir"))
    files = lambda: {p.name for p in local.rglob("shuffle_*.data")}
    before, set_to = files(), spark.conf.get(CLEANUP)
    rows = spark.range(10000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).repartition(4, "id")
    table = Work(spark, "files").table(rows.groupBy(F.col("id") % 10).agg(F.count("*").alias("n"), F.max("text").alias("text")), "rows")
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(CLEANUP) == set_to
    assert sum(r.n for r in table.collect()) == 10000


def test_texts_go_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    set_to = spark.conf.get(BATCH)
    rows = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("text")).repartition(2)
    table = Work(spark, "batches", 1 << 20).table(rows.mapInArrow(sizes, "n long"), "sizes")
    assert max(r.n for r in table.collect()) < 3 << 19
    assert spark.conf.get(BATCH) == set_to


def test_a_worker_gives_back_what_a_step_took():
    held = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    def step(batches):
        small = [np.ones(1 << 12) for _ in range(5000)]  # 160 MB in pieces; the last ones stay, so the heap cannot shrink
        for batch in batches:
            yield small[-1] + batch

    KEPT["words"] = 1
    before = held()
    out = list(sparing(step, keep=True)([0, 1]))
    assert held() - before < 40
    assert KEPT["words"] == 1 and len(out) == 2
    list(sparing(lambda key, table: [table])(0, 1))
    assert not KEPT
