import duckdb
import pytest

from knotwork.functions import edits as E
from knotwork.operators import features as X
from knotwork.plans.scoring import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]}) x").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, map(tuple, got.select(cols).collect()))) == sorted(map(key, want))


def test_aligned_words():
    assert E.aligned([], []) == (0, 0, [], [])
    assert E.aligned(["oak", "streat"], ["oak", "street"]) == (1, 1, [], [])
    assert E.aligned(["ab"], ["ac"]) == (0, 0, ["ab"], ["ac"])
    assert E.aligned(["martin", "martin"], ["marten"]) == (0, 1, ["martin"], [])


def test_edit_counts():
    got = E.edit_counts("groupe dupont sarl", "dupont sas de club", "12 rue haute", None)
    assert {k: v for k, v in got.items() if v} == {"n_o": 3, "n_s": 3, "n_common": 1, "add_filler": 1, "add_legal": 1, "drop_generic": 1, "drop_legal": 1, "legal_swap": 1, "a_add": 2}
    assert not any(E.edit_counts(None, None, "", None).values())
    assert E.edit_counts("b a", "a b", "", "")["order_changed"] == 1


@pytest.mark.parametrize(
    ("o", "s", "kind"),
    [
        ("club martin", "ecole martin", "swap"), ("club martin", "martin", "org added"), ("club martin", "zebra martin", "org added (other drop)"),
        ("martin", "club martin", "org dropped"), ("martin groupe", "club martin", "org dropped + filler"), ("martin groupe xylo", "club martin", "org dropped + filler (other add)"),
        ("c1ub martin", "club martin", "none"), ("martin sarl", "martin", "none"), (None, "", "none"),
    ],
)
def test_org_change(o, s, kind):
    assert E.org_change(o, s) == kind


def test_pair_features(spark):
    rows = [(1, 0, "acme foods", "acme foods", "12 oak street", "12"), (10, 2, "acme foods", "acme foods", "15 oak street", "15"), (11, 3, "zeta", "zeta", "", "")]
    records = spark.createDataFrame(rows, "rec_id long, src int, name string, core string, addr string, nums string")
    pairs = spark.createDataFrame([(10, 1, 90, 1), (11, 1, 30, 1)], "o long, s long, tok long, rank int")
    got = {r.o: r for r in X.pair_features(pairs, records).collect()}
    assert len(got[10].asDict()) == 41 and got[10].name_ratio == 100 and got[10].num_diff == 3 and got[10].num_up == 1 and got[10].pt_tok == 30
    assert got[11].num_jacc is None and got[11].o_no_num == 1 and round(got[11].pt_core_tset, 2) == 14.29 and got[11].s_n == 1 and got[11].tok_gap == 0
    alone = X.pair_features(pairs.where("o = 10"), records).first()
    assert alone.pt_core_tset is None and alone.pt_tok is None


def test_edit_and_raw_features(spark):
    pairs = spark.createDataFrame([(1, 2, "abc", "a b c", "nord 7 rue", "7 rue", "7", "9")], "o long, s long, name_o string, name_s string, addr_o string, addr_s string, nums_o string, nums_s string")
    row = X.edit_features(pairs).first()
    assert len(row.asDict()) == 28 and row.o_initials and row.num_rel == 5 and row.num_diff == -2 and row.a_add == 0 and (row.o_num_extra, row.s_num_missing) == (1, 1)
    raw = spark.createDataFrame([(1, 2, "Acme S.A.R.L.", "ACME sarl", "007 Oak", None)], "o long, s long, raw_name_o string, raw_name_s string, raw_addr_o string, raw_addr_s string")
    row = X.raw_features(raw).first()
    assert row.lf_eq and not row.lf_raw_eq and row.num_eq is None and not row.num_in and not row.o_addr_empty


def test_recovered(spark):
    cols = "o long, s long, name_o string, name_s string, core_o string, core_s string, addr_o string, addr_s string, nums_o string, nums_s string, fce double"
    same = ("7 rue", "7 rue", "7", "7")
    pairs = spark.createDataFrame(
        [(1, 9, "martin", "marten", "martin", "marten", *same, None), (2, 9, "dupont x", "durand y", "", "", *same, 0.95), (3, 9, "dupont x", "durand y", "", "", *same, 0.5), (4, 9, "martin", "marten", "", "", *same, None), (5, 9, "club martin", "martin", "", "", *same, 0.99)],
        cols,
    )
    assert {r.o for r in X.recovered(pairs, spark.createDataFrame([(4, 8)], "o long, s long")).collect()} == {1, 2}
