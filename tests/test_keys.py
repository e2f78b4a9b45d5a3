import time

import duckdb
import pytest

from knotwork.operators import keys as K
from knotwork.plans.keyed import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLES[name]}) x").fetchall()
    key = lambda r: tuple(map(str, r))
    got = sorted(map(key, map(tuple, got.select(cols).collect())))
    assert got and got == sorted(map(key, want))


def test_keys(spark):
    rows = [("sarl martin et fils martin", "no012b r de la paix nord"), ("", ""), (None, None)]
    d = spark.createDataFrame(rows, "n string, a string").select(K.name_key("n"), K.house_number("a"), K.address_key("a"), K.sorted_address("a"))
    assert [tuple(r) for r in d.collect()] == [("martin", "12", "12 bis paix rue", "de la no012b paix r"), ("", None, "", ""), (None, None, None, None)]


def test_links(spark):
    rows = [
        (1, 0, "fr", "martin sarl", "12 rue haute lille"), (2, 0, "fr", "dupont", "14 rue haute lille"), (3, 0, "fr", "dupont sas", "16 rue basse lille"),
        (10, 1, "fr", "sas martin", "ndeg12 autre"), (11, 1, "fr", "martin", "13 autre"), (12, 2, "fr", "dupont", "r haute 14 lille"), (13, 2, "fr", "durand", "14 rue haute lille"),
        (14, 1, "de", "martin", "12 autre"), (15, 1, "fr", None, None),
    ]
    links = K.linked(spark.createDataFrame(rows, "rec_id long, src int, country string, name string, addr string"))
    assert {tuple(r) for r in links.collect()} == {(10, 1, "name"), (12, 2, "address")}
    two = spark.createDataFrame([(1, 5, "address"), (1, 6, "name"), (2, 9, "address"), (2, 8, "address")], "o long, s long, kind string")
    assert {(r.o, r.s) for r in K.preferred(two).collect()} == {(1, 6), (2, 8)}
    assert K.closed(links, links).count() == 2
    with pytest.raises(ValueError, match="12, 2"):
        K.closed(links, links.where("o = 10"))


def test_initials_of_a_frequent_address(spark):
    n, at = 40_000, "'fr' AS country, '1 rue' AS key"
    many = spark.sql(f"SELECT id AS o, {at}, 'AF' AS raw FROM range({n})")
    odd = spark.createDataFrame([(-1, "fr", "1 rue", "NT"), (-2, "fr", "1 rue", "novatools.com"), (-3, "fr", "1 rue", "NT"), (-3, "fr", "1 rue", "novatools.com"), (-4, "de", "1 rue", "NT"), (-5, "fr", None, "NT")], "o long, country string, key string, raw string")
    references = spark.sql(f"SELECT id AS s, {at}, 'acme foods' AS core FROM range({n}) UNION ALL SELECT -9, {at}, 'nova tools' UNION ALL SELECT -8, 'fr', NULL, 'nova tools'")
    start = time.time()
    got = {tuple(r) for r in K.initials(many.union(odd), references).collect()}
    assert got == {(-1, -9), (-2, -9)}
    assert time.time() - start < 60  # not n times n pairs
