"""Rows with null keys have defined results."""

import duckdb
import pytest
from pyspark.sql import functions as F

from casewright.llm import chat, decontaminate

PASSAGE = "one two three four five six seven eight nine ten eleven"


def test_turns_without_a_conversation_are_one_dialogue(spark):
    names = "conv_id long, turn int, role string, text string"
    turns = [(0, "user", "hi"), (1, "bot", "hello"), (70, "user", "bye")]
    got = {i: sorted(tuple(r)[1:] for r in chat.rotate_perspectives(spark.createDataFrame([(i, *t) for t in turns] + [(8, 0, "else", "x")], names)).where(F.col("conv_id").eqNullSafe(F.lit(i))).collect()) for i in (None, 7)}
    assert len(got[7]) == 6 and str(got[None]) == str(got[7])


@pytest.mark.parametrize("slice_bytes", [1 << 20, 40])
def test_items_without_id_count_as_in_the_sql(spark, tmp_path, slice_bytes):
    docs = [(1, f"before {PASSAGE} after"), (2, "other short words"), (3, "clean"), (4, f"{PASSAGE} short words")]
    items = [(None, PASSAGE), (None, "short words"), (5, "short words"), (6, None)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    table = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    out, name = decontaminate.annotate(table("documents"), table("benchmark"), slice_bytes=slice_bytes)
    got = {r.doc_id: (r[name].n_hit, r[name]["items"], r[name].longest, r[name].longest_at) for r in out.collect()}
    assert got == {1: (11, [None], 11, 1), 2: (2, [5, None], 2, 1), 3: (0, [], 0, -1), 4: (13, [5, None], 11, 0)}
    assert [r.doc_id for r in decontaminate.decontaminate(table("documents"), table("benchmark"), slice_bytes=slice_bytes).collect()] == [3]
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    cur = con.execute(decontaminate.ORACLE_SQL)
    want = [dict(zip([c[0] for c in cur.description], row, strict=True)) for row in cur.fetchall()]
    assert sorted(want, key=str) == sorted((r.asDict() for r in decontaminate.op10_decontaminate(spark, str(tmp_path)).select(*want[0]).collect()), key=str)
