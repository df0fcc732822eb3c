"""Benchmark items of fewer words than a shingle."""

from skyloom.llm import decontam


def test_short_items_are_found_in_long_texts(spark):
    filler = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, f"{filler} Paris, the capital {filler}"), (2, f"{filler} the capital Paris {filler}"), (3, "paris the capital"), (4, filler), (5, "oslo")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Paris the capital"), (2, "oslo"), (3, " ".join(f"q{k}" for k in range(20)))], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.overlap) for r in decontam.contamination(docs, items).collect()} == {(1, 1, 1.0), (3, 1, 1.0), (5, 2, 1.0)}
    assert {r.doc_id for r in decontam.keep_clean(docs, items).collect()} == {2, 4}
