"""Batches that count once: upserts of the index job and chained records, with kills between writes."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from casewright.operators import audit, encoders
from casewright.sources.keyed import KeyedTables
from casewright.streaming.index_stream import upsert_index, upsert_stream

TEXT = "CENTRAL INFORMATION COMMISSION\nFile No: CIC/DEPT/A/2024/{n}\nDate of Decision: 05.04.2025\nFacts:\nThe appellant sought information regarding {word} and the file notings of the tender in question.\nDecision:\nThe Commission observes that the reply is proper. The appeal is {how}."


def decisions(spark, ids, word="roads", how="dismissed"):
    return spark.createDataFrame([(k, TEXT.format(n=1000 + k, word=word, how=how)) for k in ids], "doc_id long, text string")


def tables_of(spark, root):
    t = KeyedTables(spark, root)
    chunks = sorted((r.doc_id, r.chunk_id, r.text, tuple(r.embedding)) for r in t.read("chunks").collect())
    cases = sorted((r.case_number, r.doc_id, r.outcome, r.created_at, r.updated_at) for r in t.read("cases").collect())
    return chunks, cases


class Killed(Exception):
    pass


@pytest.mark.parametrize("at", ["cases"])
def test_a_batch_killed_between_writes_and_run_again(spark, tmp_path, at):
    def kill(name):
        if name == at:
            raise Killed(name)

    encoder = encoders.hashing_encoder(16)
    batches = [decisions(spark, [1, 2]), decisions(spark, [2, 3], "water", "allowed")]
    for root, broken in ((f"{tmp_path}/plain", False), (f"{tmp_path}/killed", True)):
        for n, batch in enumerate(batches):
            if broken and n:
                with pytest.raises(Killed):
                    upsert_index(batch, root, "s", n, encoder, force=True, buckets=4, before=kill)
                # what a killed batch has written is not seen
                seen = KeyedTables(spark, root, 4).read("chunks")
                assert {r.doc_id for r in seen.collect()} == {1, 2}
            assert upsert_index(batch, root, "s", n, encoder, force=True, buckets=4)
            assert not upsert_index(batch, root, "s", n, encoder, force=True, buckets=4)
    chunks, cases = tables_of(spark, f"{tmp_path}/plain")
    assert tables_of(spark, f"{tmp_path}/killed") == (chunks, cases)
    assert {c[1]: c[3:] for c in cases} == {1: (1, 1), 2: (1, 2), 3: (2, 2)}
    assert {c[0] for c in chunks} == {1, 2, 3} and any("water" in c[2] for c in chunks if c[0] == 2) and not any("roads" in c[2] for c in chunks if c[0] == 2)


def test_known_documents_are_skipped_and_untouched_buckets_stay(spark, tmp_path):
    root = str(tmp_path)
    upsert_index(decisions(spark, range(8)), root, "s", 0, buckets=8)
    before = {r.bucket: r.seq for r in KeyedTables(spark, root, 8).ledger().where("tab = 'chunks'").collect()}
    upsert_index(decisions(spark, [3, 100], "other"), root, "s", 1, buckets=8)
    t = KeyedTables(spark, root, 8)
    assert not [r for r in t.read("chunks").where("doc_id = 3").collect() if "other" in r.text]
    assert t.read("chunks").select("doc_id").distinct().count() == 9
    again = {r.bucket for r in t.ledger().where("tab = 'chunks' and seq = 2").collect()}
    assert len(again) == 1 and len(before) > 1
    upsert_index(decisions(spark, []), root, "s", 2, buckets=8)
    assert t.read("chunks").select("doc_id").distinct().count() == 9 and not upsert_index(decisions(spark, [200]), root, "s", 2, buckets=8)


def test_a_stream_of_files(spark, tmp_path):
    source, root, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    for words in ("roads", "water"):
        decisions(spark, [len(words), 50], words).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        upsert_stream(stream, root, state, force=True, buckets=4).awaitTermination()
    chunks = KeyedTables(spark, root, 4).read("chunks").collect()
    assert {r.doc_id for r in chunks} == {5, 50} and all("roads" not in r.text for r in chunks)


def records(spark, n, keys=1):
    one = spark.range(n).select(F.concat(F.lit("k"), F.col("id") % keys).alias("chain_key"), F.format_string("%08d", "id").alias("timestamp"), F.col("id").cast("string").alias("audit_id"))
    return one.withColumns({c: F.lit("x") if c != "system_reasoning" else F.lit(None).cast("string") for c in audit.HASHED[2:]})


def by_hand(rows):
    previous, out = audit.GENESIS, []
    for k, r in enumerate(sorted(rows, key=lambda r: (r.timestamp, r.audit_id)), 1):
        own = hashlib.sha256("|".join([previous, *[r[c] or "" for c in audit.HASHED]]).encode()).hexdigest()
        out.append((r.audit_id, k, previous, own))
        previous = own
    return out


def plain(df):
    return sorted((r.chain_key, r.audit_id, r.sequence, r.previous_hash, r.current_hash) for r in df.collect())


def test_ten_batches_equal_one(spark, tmp_path):
    rows, root = records(spark, 400, 7), str(tmp_path)
    whole = plain(audit.chain_append(rows))
    for key in {w[0] for w in whole}:
        assert sorted(w[1:] for w in whole if w[0] == key) == sorted(by_hand(rows.where(F.col("chain_key") == key).collect()))
    for k in range(10):
        batch = rows.where(F.col("timestamp").cast("int").between(40 * k, 40 * k + 39))
        if k == 5:  # killed after its records, before its tails
            real, KeyedTables.touched = KeyedTables.touched, None
            try:
                with pytest.raises(TypeError):
                    audit.chain_batch(batch, root, "s", k)
            finally:
                KeyedTables.touched = real
        assert audit.chain_batch(batch, root, "s", k) and not audit.chain_batch(batch, root, "s", k)
    assert plain(audit.read_chains(spark, root)) == whole
    assert audit.verify_chain(audit.read_chains(spark, root)).count() == 0


def test_a_long_chain_in_linear_time(spark):
    took = []
    for n in (100_000, 1_000_000):
        began = time.time()
        last = audit.chain_tails(audit.chain_append(records(spark, n))).collect()
        took.append(time.time() - began)
        assert [(r.chain_key, r.last_sequence) for r in last] == [("k0", n)]
    assert took[1] < 60


def test_null_keys_repeated_records_and_clashing_columns(spark):
    rows = records(spark, 3).unionByName(records(spark, 2)).withColumn("_row", F.lit(1)).withColumn("sequence", F.lit(9))
    rows = rows.unionByName(rows.limit(1).withColumn("chain_key", F.lit(None).cast("string")))
    got = audit.chain_append(rows).collect()
    assert sorted((r.chain_key or "", r.sequence) for r in got) == [("", 1), *[("k0", k) for k in range(1, 6)]]
    tail = spark.createDataFrame([(None, "f" * 64, 7)], "chain_key string, last_hash string, last_sequence long")
    assert {(r.sequence, r.previous_hash[0]) for r in audit.chain_append(rows, tail=tail).where("chain_key is null").collect()} == {(8, "f")}
    assert audit.chain_append(rows.limit(0)).count() == 0
