"""Samples, labels, models, side files and nearest neighbours: against their SQL and on small tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.functions import indic
from knotwork.functions import text as T
from knotwork.operators import features as X
from knotwork.operators import linkage as L
from knotwork.operators import models as M
from knotwork.operators import training as A
from knotwork.plans import learning, scoring
from knotwork.plans import records as R
from knotwork.sources import store, tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(learning.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    got = learning.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({learning.ORACLES[name]}) x").fetchall()
    assert want and sorted(map(str, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(str, want))


def test_blocking_recall(spark):
    row = learning.QUERIES["blocking_recall"](spark, SF).first()
    assert row.top10 >= 0.9 * row.n and row.top3 >= 0.9 * row.n


def test_rerank_against_a_loop(spark):
    from knotwork.functions import similarity as S

    records = learning.blocking_records(spark, SF)
    text = {r.rec_id: (r.core, r.addr) for r in records.collect()}
    pool = {}
    for r in L.candidates(records, kept=L.POOL).collect():
        rs = sum(S.token_set(a, b) for a, b in zip(text[r.o], text[r.s], strict=True))
        pool.setdefault(r.o, []).append((-rs, -r.tok, r.s))
    got = {(r.o, r["rank"]): r.s for r in L.reranked(records).collect()}
    assert got == {(o, i): s for o, rows in pool.items() for i, (_, _, s) in enumerate(sorted(rows)[: L.KEPT], 1)}


def test_models(spark, tmp_path):
    rows = learning._training(spark, SF).persist()
    model = M.fit(rows, learning.FEATURES, trees=3, depth=3)
    M.save(model, str(tmp_path / "m"))
    a, b = (sorted((r.o, r.s, r.p) for r in M.predict(m, rows, learning.FEATURES).select("o", "s", "p").collect()) for m in (model, M.load(str(tmp_path / "m"))))
    assert a == b and len(a) == rows.count()
    sampled = F.col("o") % 4 < 2
    crossed = {(r.o, r.s): r.p1 for r in M.halves(rows, learning.FEATURES, sampled, trees=2, depth=2).collect()}
    one = {k: {(r.o, r.s): r.p for r in M.predict(M.fit(rows.where(sampled & (F.col("o") % 2 == k)), learning.FEATURES, trees=2, depth=2), rows, learning.FEATURES).collect()} for k in (0, 1)}
    for (o, s), p in crossed.items():
        want = one[1 - o % 2][o, s] if o % 4 < 2 else (one[0][o, s] + one[1][o, s]) / 2
        assert p == pytest.approx(want, abs=1e-9)
    out, _ = M.stacked(rows, learning.FEATURES, scoring._truth(spark, SF), folds=2, trees=2, depth=2)
    assert out.count() == rows.count() and out.select("o", "fold").distinct().count() == rows.select("o").distinct().count()
    truth = {(r.o, r.s) for r in scoring._truth(spark, SF).collect()}
    p = {(r.o, r.s): r.p for r in out.collect()}
    assert np.mean([v for k, v in p.items() if k in truth]) > np.mean([v for k, v in p.items() if k not in truth]) + 0.2
    rows.unpersist()


def test_samples(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("o")).repartition(7)
    some = {r.o for r in A.bernoulli(rows, 0.25, 5).collect()}
    assert 4700 < len(some) < 5300 and None not in some and some == {r.o for r in A.bernoulli(rows.repartition(3), 0.25, 5).collect()}
    assert some != {r.o for r in A.bernoulli(rows, 0.25, 6).collect()}
    assert A.seeded_sample(rows, 10, 1).collect() == A.seeded_sample(rows.repartition(2), 10, 1).collect()
    assert A.seeded_sample(rows.limit(4), 10, 1).count() <= 4 and A.shuffled(rows, 1).count() == 20_000
    assert 0.18 < rows.where(A.held_out("o")).count() / 20_000 < 0.22


def test_scripts(spark):
    texts = ["பாலாஜி பிசினஸ்", "बालाजी", "Café", "plain Text", None, "a–b"]
    got = [tuple(r) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.to_ascii("t"), indic.indian("t")).collect()]
    assert got == [("palaji picins", True), ("balaji", True), ("cafe", False), ("plain Text", False), (None, None), ("a–b", True)]


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(L, "POINT_BLOCK", 7)
    monkeypatch.setattr(L, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(2)
    rows = [(i, ["a", "a", "a", "b", None][i % 5], [float(x) for x in rng.integers(-3, 4, 4)] if i % 11 else None) for i in range(120)]
    points = spark.createDataFrame(rows, "s bigint, country string, v array<double>")
    got = {(r.o, r["rank"]): (r.s, r.sim) for r in L.nearest(points.where("s % 6 = 0").withColumnRenamed("s", "o"), points, 4).collect()}
    want = {}
    for o, c, v in rows:
        if o % 6 == 0 and c and v:
            sims = sorted((-float(np.dot(v, w)), s) for s, d, w in rows if d == c and w and s != o)[:4]
            want |= {(o, i): (s, -x) for i, (x, s) in enumerate(sims, 1)}
    assert got == want
    assert L.nearest(points.limit(0).withColumnRenamed("s", "o"), points).count() == 0


def test_unique_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "i int, k string")
    assert [r.i for r in L.unique_keys(rows, "k").collect()] == [3]


def test_store(spark, tmp_path):
    path, calls = str(tmp_path / "stage"), []

    def make():
        calls.append(1)
        return spark.range(3)

    assert store.resumed(spark, path, make).count() == store.resumed(spark, path, make).count() == 3 and len(calls) == 1
    store.remove(spark, f"{path}/_SUCCESS")  # as an interrupted run leaves it
    assert store.resumed(spark, path, make).count() == 3 and len(calls) == 2
    parts = str(tmp_path / "parts")
    assert not store.is_done(spark, parts)
    assert store.resumed_parts(spark, parts, {"a": make, "b": make}).count() == 6 and store.is_done(spark, parts)
    store.write_json(spark, str(tmp_path / "rule"), {"thr": 0.5, "é": [1, None]})
    assert store.read_json(spark, str(tmp_path / "rule")) == {"thr": 0.5, "é": [1, None]}
    store.publish(spark, path, str(tmp_path / "out"))
    store.publish(spark, path, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(FileNotFoundError):
        store.publish(spark, str(tmp_path / "none"), str(tmp_path / "out"))
    v = spark.createDataFrame([(1, [0.5, 1.0])], "id bigint, v array<double>")
    store.write_vectors(v, str(tmp_path / "v"))
    assert store.read_vectors(spark, str(tmp_path / "v")).first().v == [0.5, 1.0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('id\tname\tn\n1\t"x\t3\n2\t\t\n')
    (tmp_path / "b.tsv").write_text("id\tname\tn\n7\ty\t1\n")
    a = tables.read_tsv(spark, str(tmp_path / "a.tsv"), ["id", "name", "n"], {"n": "BIGINT"}, "")
    assert [tuple(r) for r in a.collect()] == [("1", '"x', 3), ("2", "", None)]
    both = tables.read_sources(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")], ["id", "name", "n"])
    assert sorted((r.id, r.src) for r in both.collect()) == [("1", 1), ("2", 1), ("7", 2)]
    rows = spark.createDataFrame([("a", None), ("a", None), ("a", ""), (None, "a")], "x string, y string")
    keyed = [tables.with_row_key(rows.repartition(n)).collect() for n in (1, 3)]
    assert sorted((r.row_key, r.copy) for r in keyed[0]) == sorted((r.row_key, r.copy) for r in keyed[1]) and len({(r.row_key, r.copy) for r in keyed[0]}) == 4
    (tmp_path / "truth.tsv").write_text("s\tmatched\nS1-1\tS2-1,S2-9\nS1-2\t\n")
    records = spark.createDataFrame([(10, "S1-1"), (11, "S1-2"), (12, "S2-1")], "rec_id bigint, entity_id string")
    assert [tuple(r) for r in tables.truth_pairs(spark, str(tmp_path / "truth.tsv"), records).collect()] == [(12, 10)]


def test_embedded(spark):
    def loader():
        return lambda texts: [np.ones((len(t.split()), 2)) * [[3.0, 4.0]] if t.strip() else np.zeros((0, 2)) for t in texts]

    rows = spark.createDataFrame([(1, "a b c"), (2, None)], "rec_id bigint, text string")
    got = {r.rec_id: np.round(r.v, 5).tolist() for r in M.embedded(rows, loader, prefix="").collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]} or got == {1: [0.60000002, 0.80000001], 2: [0.0, 0.0]}


def test_pair_features_numbers(spark):
    """The number columns of the feature table are those of number_features."""
    pairs, records = scoring._pairs(spark, SF), scoring._records(spark, SF)
    table = X.pair_features(pairs, records)
    n = records.select("rec_id", "nums")
    sided = pairs.join(n.toDF("o", "nums_o"), "o").join(n.toDF("s", "nums_s"), "s")
    want = {(r.o, r.s): r.num_delta for r in L.number_features(sided).collect()}
    assert {(r.o, r.s): r.num_diff for r in table.collect()} == want and table.columns.count("num_up") == 1 and len(table.columns) == 41
    assert R.business_pairs(spark, SF).count() > 0


def test_stacker_makes_features_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def x(o):
        made.add(1)
        return float(o % 7)

    rows = spark.range(200).select(F.col("id").alias("o"), (F.col("id") * 2).alias("s"), (F.col("id") % 7 > 3).cast("int").alias("y"), x("id").alias("x"))
    out, _ = M.stacked(rows, ["x"], rows.where("y = 1").select("o", "s"), folds=2, trees=1, depth=1)
    by_truth = made.value
    assert out.count() == 200 and {r.fold for r in out.collect()} == {0, 1}
    assert made.value == by_truth == 200
