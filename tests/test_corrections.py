"""Corrections meet documents by their vocabulary."""

from casewright.operators import cleaning


def test_corrections_by_hand_and_what_they_shuffle(spark, capsys):
    docs = spark.createDataFrame([(1, "teh cat\r\n# teh head\nteh, teh dgo"), (2, None), (3, "nothing here"), (None, "1. teh\nteh\u0001x"), (5, "- teh\n\n|teh|")], "doc_id long, text string")
    fixes = spark.createDataFrame([("teh", "the", True), ("dgo", "dog", True), ("cat", "cut", False)], "word string, term string, accepted boolean")
    out, log = cleaning.apply_corrections(docs, fixes, "[a-z]+")
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "the cat\n# teh head\nthe, the dog", 2: "", 3: "nothing here", None: "1. teh\nthex", 5: "- teh\n\n|teh|"}
    assert sorted((r.word, r.term, r.n) for r in log.collect()) == [("dgo", "dog", 1), ("teh", "the", 4)]
    out.explain()
    assert "line_no" not in capsys.readouterr().out  # no row for each piece of a line goes through a shuffle
