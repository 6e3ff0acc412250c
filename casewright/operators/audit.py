"""Hash-chained audit records and the event logs of cases.

A chain is ordered by (timestamp, audit_id) within its key. Building one is a fold that streams through one task, and chains
run in parallel; verifying is a window and needs no fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.sources.keyed import KeyedTables

GENESIS = "0" * 64
HASHED = ["audit_id", "timestamp", "raw_input_text", "system_recommended_department", "system_confidence_band", "system_reasoning"]
ACTIONS = ["APPROVED", "OVERRIDDEN", "REJECTED"]


def record_hash(previous: Column, get=F.col) -> Column:
    return F.sha2(F.concat_ws("|", previous, *[F.coalesce(get(c), F.lit("")) for c in HASHED]), 256)


def chain_append(records: DataFrame, key: str = "chain_key", tail: DataFrame | None = None) -> DataFrame:
    """records with previous_hash, current_hash and sequence, chained after `tail` (key, last_hash, last_sequence).

    Each hash needs the one before, so a chain is folded in order: rows stream through a task in batches, and what it
    keeps of a chain is the last hash and sequence. Time and shuffle are linear in the records, memory is a batch.

    Defined cases: a null key is a chain of its own; records that repeat, or share an audit_id, are links each, in the order
    of all hashed columns; null columns are hashed as empty; an empty table gives no rows.
    """
    taken = {c.lower() for c in records.columns}
    own = [c for c in ("previous_hash", "current_hash", "sequence") if c in taken]
    rows = records.drop(*own)
    fields = [F.col(c).cast("string").alias(f"_h{k}") for k, c in enumerate(HASHED)]
    rows = rows.select(F.struct(*rows.columns).alias("_row"), F.col(key).alias("_key"), *fields)
    if tail is not None:
        after = tail.select(F.col(key).alias("_k"), "last_hash", "last_sequence")
        rows = rows.join(after, F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_k")
    else:
        rows = rows.withColumns({"last_hash": F.lit(None).cast("string"), "last_sequence": F.lit(None).cast("long")})
    order = ["_h1", "_h0", *[f"_h{k}" for k in range(2, len(HASHED))]]
    ordered = rows.repartition("_key").sortWithinPartitions("_key", *order)

    def fold(batches):
        import hashlib

        import pyarrow as pa

        now, previous, sequence, started = None, GENESIS, 0, False
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(1, batch.num_columns)]
            out: tuple[list, list, list] = ([], [], [])
            for k, *parts, last_hash, last_sequence in zip(*columns, strict=True):
                if not started or k != now:
                    now, previous, sequence, started = k, last_hash or GENESIS, last_sequence or 0, True
                hashed = hashlib.sha256("|".join([previous, *[p or "" for p in parts]]).encode()).hexdigest()
                sequence += 1
                for column, v in zip(out, (previous, hashed, sequence), strict=True):
                    column.append(v)
                previous = hashed
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["_row", "previous_hash", "current_hash", "sequence"])

    kind = T.StructType([rows.schema["_row"], T.StructField("previous_hash", T.StringType()), T.StructField("current_hash", T.StringType()), T.StructField("sequence", T.LongType())])
    return ordered.mapInArrow(fold, kind).select("_row.*", "previous_hash", "current_hash", "sequence")


def chain_tails(chained: DataFrame, key: str = "chain_key") -> DataFrame:
    """(key, last_hash, last_sequence) of each chain."""
    last = F.max(F.struct("sequence", "current_hash")).alias("last")
    return chained.groupBy(key).agg(last).select(key, F.col("last.current_hash").alias("last_hash"), F.col("last.sequence").alias("last_sequence"))


def chain_batch(records: DataFrame, root: str, source: str, number: int, key: str = "chain_key", buckets: int = 16) -> bool:
    """Chains one batch after all before it, exactly once: records below root/records, tails in a keyed table.

    Records of earlier batches are not read: a chain goes on from its tail. Only the tails' buckets that the batch touches
    are read and written. False if the ledger has the batch. A batch must not hold records that belong before those of an
    earlier batch of its chain; they are chained as they arrive.
    """
    tables = KeyedTables(records.sparkSession, root, buckets)
    batch = tables.begin(source, number)
    if batch is None:
        return False
    touched = tables.touched(records, key)
    before = tables.read("tails", touched)
    path = f"{root}/records/seq={batch.seq}"
    chained = chain_append(records, key, before)
    chained.write.mode("overwrite").parquet(path)
    new = chain_tails(records.sparkSession.read.schema(chained.schema).parquet(path), key)
    if before is not None:
        kept = before.join(new.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
        new = kept.unionByName(new)
    batch.write("tails", new, key, touched)
    batch.commit()
    return True


def read_chains(spark: SparkSession, root: str) -> DataFrame:
    """All records of the batches that the ledger has."""
    seqs = [r.seq for r in KeyedTables(spark, root).ledger().select("seq").distinct().collect()]  # one for each batch
    return spark.read.option("mergeSchema", "true").parquet(*[f"{root}/records/seq={s}" for s in sorted(seqs)])


def chain_stream(stream: DataFrame, root: str, checkpoint: str, key: str = "chain_key"):
    """Starts chaining arriving records: every micro-batch is one batch of `chain_batch`."""
    return stream.writeStream.foreachBatch(lambda rows, number: chain_batch(rows, root, checkpoint, number, key) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verify_chain(records: DataFrame, key: str = "chain_key") -> DataFrame:
    """(key, audit_id, problem) for each record that does not follow the one before or does not have its hash."""
    before = F.lag("current_hash", 1, GENESIS).over(Window.partitionBy(key).orderBy("sequence"))
    checked = records.withColumn("_before", before).withColumn("_own", record_hash(F.col("previous_hash")))
    problems = F.array_compact(F.array(F.when(~F.col("previous_hash").eqNullSafe(F.col("_before")), "linkage"), F.when(~F.col("current_hash").eqNullSafe(F.col("_own")), "content")))
    return checked.select(key, "audit_id", F.explode(problems).alias("problem"))


# What a decision sets: the record's column and the decision's.
DECIDED = {"pio_action_taken": "action", "pio_override_department": "override", "pio_comments": "comments", "legal_disclaimer_accepted": "disclaimer_accepted", "pio_exemption_override": "exemption_override", "decided_at": "decided_at"}


def apply_decisions(records: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with decisions applied, rejected decisions with a reason); only PENDING rows and known actions change.

    Of several decisions about a pending record the first known action by order of arrival (`arrived`, else `decided_at`)
    stands, and the others are reported as already decided. All columns of DECIDED that both sides have are set.

    Defined cases: as many records as before; decisions of equal arrival are ordered by their values; a decision without
    an audit_id is about an unknown record.
    """
    order = [F.col(c).asc_nulls_last() for c in ("arrived", "decided_at") if c in decisions.columns]
    order += [F.col(c).asc_nulls_last() for c in decisions.columns if c not in ("audit_id", "arrived", "decided_at")]
    status = records.select("audit_id", F.col("pio_action_taken").alias("_status")).dropDuplicates(["audit_id"])
    judged = decisions.join(status, "audit_id", "left")
    able = F.coalesce(F.col("action").isin(ACTIONS) & (F.col("_status") == "PENDING"), F.lit(False))
    judged = judged.withColumn("_able", able).withColumn("_k", F.when(able, F.row_number().over(Window.partitionBy("audit_id", "_able").orderBy(*order))))
    reason = F.when(F.col("_status").isNull(), "unknown record").when(~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)), "unknown action").when(~F.col("_able") | (F.col("_k") > 1), "already decided")
    rejected = judged.withColumn("reason", reason).where("reason is not null").select("audit_id", "action", "reason")
    set_ = {c: d for c, d in DECIDED.items() if c in records.columns and d in decisions.columns}
    own = judged.where("_k = 1").select(F.col("audit_id").alias("_id"), *[F.col(d).cast(records.schema[c].dataType).alias(f"_new_{c}") for c, d in set_.items()])
    j = records.join(own, F.col("audit_id") == F.col("_id"), "left")
    return j.select(*[F.when(F.col("_id").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in records.columns]), rejected


def recent(records: DataFrame, n: int = 50) -> DataFrame:
    return records.orderBy(F.desc("timestamp"), F.desc("audit_id")).limit(n)


def audit_metrics(records: DataFrame) -> DataFrame:
    """Total, approved, overridden, override rate in whole percent (halves up), departments seen."""
    changed = F.col("pio_action_taken").isin("OVERRIDDEN", "PARTIALLY_APPROVE") | F.col("pio_override_department").isNotNull()
    n = records.agg(F.count("*").alias("total"), F.count_if(F.col("pio_action_taken") == "APPROVED").alias("approved"), F.count_if(changed).alias("overridden"))
    seen = records.select(F.explode(F.array("system_recommended_department", "pio_override_department")).alias("d")).where("d is not null").agg(F.count_distinct("d").alias("departments"))
    rate = F.when(F.col("total") > 0, F.round(100 * F.col("overridden") / F.col("total"))).otherwise(0).cast("long")
    return n.join(F.broadcast(seen)).select("total", "approved", "overridden", rate.alias("override_rate"), "departments")  # one row each


_GROUPS = {"OVERRIDDEN": ["OVERRIDDEN", "PARTIALLY_APPROVE"], "REJECTED": ["REJECTED", "REJECT"]}


def audit_filter_sort(records: DataFrame, now: str, query: str = "", action: str = "", department: str = "", confidence: str = "", most_days: int | None = None, sort_by: str = "newest") -> DataFrame:
    """Free text over six columns, action groups, department in either column, band, age in whole days; five orders."""
    out = records
    if query.strip():
        q = query.strip().lower()
        has = F.lit(False)
        for c in ("audit_id", "system_recommended_department", "pio_comments", "system_reasoning", "extracted_entities", "raw_input_text"):
            has = has | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q))
        out = out.where(has)
    if action:
        same = F.col("pio_action_taken").isin(_GROUPS.get(action, [action]))
        out = out.where(same | F.col("pio_override_department").isNotNull() if action == "OVERRIDDEN" else same)
    if department:
        out = out.where(F.col("system_recommended_department").eqNullSafe(department) | F.col("pio_override_department").eqNullSafe(department))
    if confidence:
        out = out.where(F.col("system_confidence_band") == confidence)
    if most_days is not None:
        age = F.ceil(F.abs(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("timestamp").cast("timestamp"))) / 86400)
        out = out.where(age <= most_days)
    rank = F.when(F.col("system_confidence_band") == "HIGH", 3).when(F.col("system_confidence_band") == "MEDIUM", 2).when(F.col("system_confidence_band") == "LOW", 1).otherwise(0)
    orders = {"newest": [F.desc("timestamp")], "oldest": [F.asc("timestamp")], "action": [F.coalesce("pio_action_taken", F.lit("")).asc()], "department": [F.coalesce("system_recommended_department", F.lit("")).asc()], "confidence": [rank.desc()]}
    return out.orderBy(*orders[sort_by], "audit_id")


# --- event logs -------------------------------------------------------------------------------------------------------


def event_digest(payload: Column) -> Column:
    """16 hex digits of the sha256 of a map's JSON with sorted keys."""
    return F.substring(F.sha2(F.to_json(F.map_from_entries(F.sort_array(F.map_entries(payload)))), 256), 1, 16)


def corrections_export(events: DataFrame) -> DataFrame:
    """events (case_id, event_type, timestamp, payload map): one row for each case whose first routing was corrected."""
    first = lambda kind: F.min_by(F.when(F.col("event_type") == kind, F.col("payload")), F.when(F.col("event_type") == kind, F.col("timestamp")))
    one = events.groupBy("case_id").agg(first("ROUTING_DECISION").alias("r"), first("PIO_DECISION").alias("d"), first("RTI_INPUT").alias("i"))
    get = lambda m, k: F.coalesce(F.try_element_at(F.col(m), F.lit(k)), F.lit(""))
    return one.where(get("r", "training_data_flag") == "true").select("case_id", get("i", "rti_text_preview").alias("text"), get("r", "ai_prediction").alias("predicted"), get("r", "effective_department").alias("correct"), get("r", "override_reason").alias("reason"), get("d", "final_approved_decision").alias("decision"))


def edit_flags(events: DataFrame) -> DataFrame:
    """(case_id, draft_changed, overridden): whether a draft was edited and a prediction overridden."""
    p = lambda k: F.try_element_at(F.col("payload"), F.lit(k))
    changed = F.trim(p("ai_draft_original")) != F.trim(p("pio_edited_version"))
    return events.groupBy("case_id").agg(F.coalesce(F.bool_or(changed), F.lit(False)).alias("draft_changed"), F.coalesce(F.bool_or((F.col("event_type") == "ROUTING_DECISION") & p("pio_override").isNotNull()), F.lit(False)).alias("overridden"))
