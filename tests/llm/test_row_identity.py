"""Stages tell rows apart by id and text, null and repeated ids among them."""

from tablesmith.llm import decontaminate, exact_dedup, shingles
from tests.llm.test_corpus import frame


def test_drop_copies_tells_rows_apart(spark):
    left = lambda rows: sorted(((x.doc_id, x.text) for x in exact_dedup.drop_copies(frame(spark, rows)).collect()), key=str)
    assert left([(None, "a"), (None, "b"), (None, "a")]) == [(None, "a"), (None, "b")]
    assert left([(1, "A"), (5, "A"), (5, "B")]) == [(1, "A"), (5, "B")]
    both = left([(1, "a  b"), (1, "a b"), (1, "c"), (2, None), (2, "")])
    assert [(i, " ".join((t or "").split())) for i, t in both] == [(1, "a b"), (1, "c"), (2, "")]


def test_drop_contaminated_tells_rows_apart(spark):
    leak = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, leak)], "item_id bigint, text string")
    rows = [(None, leak), (None, "clean"), (5, leak + " x"), (5, "clean too"), (6, None)]
    got = decontaminate.drop_contaminated(frame(spark, rows), bench).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == [(5, "clean too"), (6, None), (None, "clean")]


CLASH = ("kept_id", "kept_text", "kept_rid", "bad_id", "bad_rid", "rid", "row", "order", "content", "_lang", "_rate", "words", "found")


def clashing(spark, rows):
    return spark.createDataFrame([(*r, *(["x"] * len(CLASH))) for r in rows], "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in CLASH))


def test_stages_take_any_column_names(spark):
    leak = " ".join(f"w{i}" for i in range(20))
    docs = clashing(spark, [(1, "a"), (1, "b"), (None, "x"), (None, "y"), (3, "a"), (4, leak), (4, leak), (None, leak)])
    bench = spark.createDataFrame([(1, leak)], "item_id bigint, text string")
    keys = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=str)
    copies = exact_dedup.drop_copies(docs)
    assert keys(copies) == sorted([(1, "a"), (1, "b"), (None, "x"), (None, "y"), (4, leak)], key=str) and copies.columns == docs.columns
    near = shingles.drop_near_copies(docs)
    assert keys(near) == keys(copies) and near.columns == docs.columns
    clean = decontaminate.drop_contaminated(docs, bench)
    assert keys(clean) == sorted([(1, "a"), (1, "b"), (None, "x"), (None, "y"), (3, "a")], key=str) and clean.columns == docs.columns
    for stage in (exact_dedup.drop_copies, shingles.drop_near_copies, lambda d: decontaminate.drop_contaminated(d, bench)):
        assert stage(docs.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_a_short_passage_in_a_long_text_goes_too(spark):
    leak = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([(1, leak)], "item_id bigint, text string")
    text = "Some, words! " * 400 + leak.upper() + " -- The END."
    docs = spark.createDataFrame([(1, text), (2, "Some, words!")], "doc_id bigint, text string")
    assert [x.doc_id for x in decontaminate.drop_contaminated(docs, bench).collect()] == [2]
    assert decontaminate.drop_contaminated(docs, bench, min_share=0.05).count() == 2
    left = {x.doc_id: x.text for x in decontaminate.strip_spans(docs, bench).collect()}
    assert left == {1: "Some, words! " * 399 + "Some, words -- The END.", 2: "Some, words!"}
