"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For every participant of a conversation the whole dialogue is rendered once, with that speaker as the assistant and the
others as named users; only the assistant's words and end marks are to be trained on. The result has one row for each
perspective and turn, with the rendered segment and its place, so a dialogue of any length never meets in one row: the
dialogue is its segments in order of `position`.

Places are two-level running sums: over blocks of BLOCK turn numbers, then within a block.

Defined cases: a null text is empty; a null role is the participant `unknown`; context roles (system) are rendered as
such and are no participants, so a conversation of only such turns gives no rows; a null turn number stands first; turns
with equal numbers are ordered by role and text; turns with a null conv_id are one conversation, whose id is null;
repeated rows stay; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.work import Work, read

BLOCK = 64
CONTEXT = ("system",)


def rotate_perspectives(turns: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """turns (conv_id, turn, role, text) as conv_id, perspective, position, turn, speaker, rendered_as, segment, start, stop, mask_start, mask_stop.

    start and stop are character places in the perspective's rendering; mask_start and mask_stop bound what is trained
    on, and are null for the other speakers.
    """
    work = Work(turns.sparkSession, "chat")
    # within a struct a null id is equal to itself, so joins keep it
    rows = turns.select(F.struct("conv_id").alias("conv_id"), "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"), F.expr(f"coalesce(turn div {BLOCK}, -9223372036854775808)").alias("block"))
    cast = work.table(rows.where(~F.col("speaker").isin(*context)).select("conv_id", F.col("speaker").alias("perspective")).distinct(), "participants")
    own = F.col("speaker") == F.col("perspective")
    rendered_as = F.when(own, "assistant").when(F.col("speaker").isin(*context), "system").otherwise(F.concat(F.lit("user name="), "speaker"))
    head = F.concat(F.lit("<|im_start|>"), "rendered_as", F.lit("\n"))
    seen = rows.join(cast.hint("merge"), "conv_id").withColumn("rendered_as", rendered_as).withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "text", F.lit("<|im_end|>\n")))
    seen = work.table(seen.drop("text").withColumn("size", F.length("segment").cast("long")), "segments")
    key = ["conv_id", "perspective", "block"]
    blocks = seen.groupBy(*key).agg(F.sum("size").alias("chars"), F.count("*").alias("turns"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ahead = blocks.select(*key, (F.sum("chars").over(earlier) - F.col("chars")).alias("chars_before"), (F.sum("turns").over(earlier) - F.col("turns")).alias("turns_before"))
    inside = Window.partitionBy(*key).orderBy("turn", "speaker", "segment").rowsBetween(Window.unboundedPreceding, 0)
    placed = seen.withColumn("stop_in", F.sum("size").over(inside)).withColumn("place", F.row_number().over(inside) - 1)
    out = placed.join(ahead, key).withColumn("start", F.col("chars_before") + F.col("stop_in") - F.col("size")).withColumn("stop", F.col("start") + F.col("size"))
    trained = F.col("rendered_as") == "assistant"
    return out.select(F.col("conv_id.conv_id").alias("conv_id"), "perspective", (F.col("turns_before") + F.col("place")).alias("position"), "turn", "speaker", "rendered_as", "segment", "start", "stop", F.when(trained, F.col("start") + F.col("head")).alias("mask_start"), F.when(trained, F.col("stop") - 1).alias("mask_stop"))


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(read(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
s AS (SELECT r.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END AS rendered_as FROM r JOIN p USING (conv_id)),
t AS (SELECT *, '<|im_start|>' || rendered_as || chr(10) || text || '<|im_end|>' || chr(10) AS segment, length('<|im_start|>' || rendered_as) + 1 AS head FROM s),
o AS (SELECT *, row_number() OVER w - 1 AS position, sum(length(segment)) OVER w AS stop FROM t
      WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaker, rendered_as, segment,
       CAST(stop - length(segment) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop,
       CASE WHEN rendered_as = 'assistant' THEN CAST(stop - length(segment) + head AS BIGINT) END AS mask_start,
       CASE WHEN rendered_as = 'assistant' THEN CAST(stop - 1 AS BIGINT) END AS mask_stop
FROM o
"""
