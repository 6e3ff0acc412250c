"""Searches that read less, against the exhaustive ones, on whole tables and odd input."""

import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import projections, retrieval
from casewright.plans.registry import QUERIES


@pytest.mark.parametrize("sf, most", [("0.001", 1.1), ("0.01", 1.1), ("0.1", 0.8)])
def test_recall_and_rows_read_on_whole_tables(spark, sf, most):
    # vectors without structure: the fewer rows, the further their nearest ones are
    got = QUERIES["r6_projection_recall"](spark, f"/root/testdata/sf{sf}").agg(F.sum("hit") / F.sum("wanted"), F.sum("rows_read") / F.sum("rows"), F.min("wanted")).first()
    assert got[0] >= 0.9 and got[1] <= most and got[2] == 10


def test_neighbours_that_are_near_need_few_probes(spark):
    rnd = random.Random(1)
    centres = [[rnd.gauss(0, 1) for _ in range(32)] for _ in range(60)]
    rows = [(k, [x + rnd.gauss(0, 0.2) for x in centres[k % 60]]) for k in range(3000)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    queries = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    index = projections.build_index(vectors, block=100)
    found, exact = projections.projection_topk(queries, index, probes=4), retrieval.cosine_topk(queries, vectors)
    hit = projections.recall(found, exact).agg(F.sum("hit") / F.sum("wanted")).first()[0]
    share = projections.read_share(queries, index, 4).agg(F.sum("rows_read") / F.sum("rows")).first()[0]
    assert hit >= 0.95 and share <= 0.15 and projections.probes_for(queries, vectors, index) <= 4
    # probing every cell is the exhaustive search
    whole = projections.projection_topk(queries, index, projections.CELLS)
    plain = lambda df: sorted((r.query_id, r.chunk_id, round(r.vector_score, 9), r["rank"]) for r in df.collect())
    assert plain(whole) == plain(exact)


def test_a_crowded_cell_is_split_and_copies_are_all_found(spark):
    rows = [(str(k), [1.0, 0.0, 0.5]) for k in range(500)] + [("far", [-1.0, 0.0, 0.0]), ("none", None), ("zero", [0.0, 0.0, 0.0]), ("nan", [float("nan"), 1.0, 1.0]), ("short", [1.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "chunk_id string, embedding array<float>, part int")
    index = projections.build_index(vectors, cells=16, copies=2, block=50)
    assert index.rows == 501 and index.blocks.select(F.max(F.size("ci"))).first()[0] < 100
    queries = spark.createDataFrame([("q", [2.0, 0.0, 1.0]), ("bad", None), ("long", [1.0, 1.0, 1.0, 1.0])], "query_id string, embedding array<float>")
    got = projections.projection_topk(queries, index, 8, k=600).collect()
    assert [r.query_id for r in got] == ["q"] * len(got) and {r.chunk_id for r in got} >= {str(k) for k in range(500)}
    assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"])][:3] == ["0", "1", "10"]
    assert projections.projection_topk(queries, projections.build_index(vectors.limit(0)), 8).count() == 0


def plain_hits(df):
    return sorted((r.query_id, r.chunk_id, round(r.bm25_score, 6), r["rank"]) for r in df.collect())


def test_bounded_search_gives_the_same_hits_and_skips_common_words(spark):
    rnd = random.Random(3)
    common, rare = [f"common{k}" for k in range(6)], [f"rare{k}" for k in range(300)]
    chunks = [(k, " ".join(rnd.choices(common, k=rnd.randint(5, 40)) + rnd.choices(rare, k=3))) for k in range(2000)]
    asked = [(k, f"{rnd.choice(rare)} {rnd.choice(rare)} {rnd.choice(common)} {rnd.choice(common)}") for k in range(40)]
    asked += [(100, "common1 common2"), (101, "nothing"), (102, ""), (103, None), (104, "rare1 rare1 rare2 common1")]
    index = retrieval.bm25_stats(spark.createDataFrame(chunks, "chunk_id long, text string"))
    queries = spark.createDataFrame(asked, "query_id long, text string")
    bounds = retrieval.bm25_bounds(index)
    for k in (3,):
        want = plain_hits(retrieval.bm25_search(queries, index, k))
        for first in (0.0, 0.6, 1.0):
            got = retrieval.bm25_search_bounded(queries, index, bounds, k, first)
            assert plain_hits(got.hits) == want, (k, first)
    few = retrieval.bm25_search_bounded(queries.where("query_id < 100"), index, bounds, 3, 0.6).scored.agg(F.sum("scored") / F.sum("postings")).first()[0]
    assert few < 0.2, few
