"""Small sources and languages are judged by all rows of their language or table."""

import random

from knotwork.llm import quality

COLS = "doc_id bigint, text string, lang string, source string"


def prose(rng, odd=False):
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(120)]
    return " ".join(w + "$$$$####" if odd else w for w in words)


def test_rare_source_beside_a_hot_one(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng), "en", "hot") for i in range(400)]
    rows += [(1000, prose(rng, odd=True), "en", "rare"), (1001, prose(rng), "en", "other"), (1002, prose(rng, odd=True), "xx", "tiny"), (1003, prose(rng), "yy", "tiny")]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, COLS)).collect()}
    assert [got[i].kept for i in (1000, 1001, 1002, 1003)] == [False, True, False, True]
    assert got[1000].distance2 > quality.SPREADS**2 and sum(r.kept for r in got.values()) >= 400


def test_pools_hold_all_rows_of_their_level(spark):
    rows = [(i, "en", "hot", 0.0) for i in range(5)] + [(5, "en", "rare", 0.0), (6, "xx", "tiny", 0.0)] + [(i, "de", "hot", 0.0) for i in range(7, 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, v double").select("*", *[quality.F.col("v").alias(x) for x in quality.AXES])
    got = {(r.g_lang, r.g_source): r["count"] for r in quality._pools(quality._levels(df, 3)).groupBy("g_lang", "g_source").count().collect()}
    assert got == {("=en", "=hot"): 5, ("=en", "*"): 6, ("=de", "=hot"): 5, ("*", "*"): 12}
