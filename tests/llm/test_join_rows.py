"""Rows that share a doc_id, rows without one, repeated rows, and sets with crowded histogram buckets."""

import numpy as np

from knotwork.llm import ngram_join

SCHEMA = "doc_id bigint, text string, row string, n bigint, head int"


def text(seed, n=100):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))


def components(spark, rows, **k):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    return sorted((str(r.doc_id), str(r.component_id)) for r in ngram_join.jaccard_components(docs, **k).collect())


def test_null_id_links(spark):
    t = text(1)
    got = components(spark, [(None, t), (5, t), (7, t), (8, t + " more"), (9, text(2)), (None, text(3))])
    assert got == sorted([("None", "5"), ("5", "5"), ("7", "5"), ("8", "5"), ("9", "9"), ("None", "None")])


def test_one_id_with_two_texts(spark):
    a, b = text(1), text(2)
    got = components(spark, [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (0, b + " y")])
    assert got == sorted([("1", "1"), ("1", "0"), ("2", "1"), ("3", "0"), ("0", "0")])


def test_repeated_rows(spark):
    a = text(1)
    rows = [(4, a)] * 50 + [(2, a + " x")] * 50 + [(3, None)] * 3
    got = components(spark, rows, tile=2, tile_shingles=50)
    assert got == sorted([("4", "2")] * 50 + [("2", "2")] * 50 + [("3", "3")] * 3)


def test_keep_one(spark):
    a, b = text(1, 200), text(2, 200)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (0, b + " y"), (None, a + " z"), (7, None), (7, ""), (None, text(5)), (9, text(6)), (9, text(6))]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(1, a), (0, b + " y"), (7, None), (7, ""), (None, text(5)), (9, text(6)), (9, text(6))]
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in want)
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


