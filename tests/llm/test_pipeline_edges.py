"""The pipeline on empty tables, on rows of nulls, and with further columns whose names the stages use themselves."""

import pytest

import corpus_pipeline
from knotwork.llm import common

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
MORE = ", kept string, n bigint, row string, _row int, head string, d2 string, rep int"


def prose(k):
    return " ".join(f"word{(7 * i + k * 13) % 97}x{k}" for i in range(60))


def run(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(spark, str(folder))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3], ids=["none", "nulls"])
def test_nothing_left(spark, tmp_path, rows):
    got = run(spark, tmp_path, rows, SCHEMA)
    assert got.count() == 0 and "sequence_id" in got.columns


def test_clashing_columns_and_repeats(spark, tmp_path):
    more = ("x", 1, "y", 2, "z", "q", 3)
    rows = [(i, prose(i), "en", "s", 1, *more) for i in range(30)] + [(1, prose(1), "en", "s", 1, *more), (None, prose(40), None, None, None, *more), (50, None, "en", "s", 0, *more)]
    docs = spark.createDataFrame(rows, SCHEMA + MORE)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == [c.split()[0] for c in (SCHEMA + MORE).split(", ")]
    assert sorted(str(r.doc_id) for r in docs.collect()) == sorted([*map(str, range(30)), "1", "None"])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 31
    common.drop_tables(spark)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        docs.count()
