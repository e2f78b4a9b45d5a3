"""Queries of feature tables and score decisions, over businesses made from customer keys, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import edits as E
from ..functions import fixed
from ..functions import text as T
from ..operators import features as X
from ..operators import linkage as L
from . import records as R

#: A variant's candidates: the references of its own key and of keys so much larger.
STEPS = [0, 1, 56]
_NAME = "CASE WHEN kind > 0 AND k % 5 = 0 THEN replace(name, 'a', 'e') WHEN kind > 0 AND k % 11 = 0 THEN concat('club ', name) WHEN kind = 0 AND k % 13 = 0 THEN concat('maison ', name) ELSE name END"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    b = R.businesses(spark, sf).withColumn("name", F.expr(_NAME))
    return b.select((F.col("k") * 10 + F.col("kind")).alias("rec_id"), F.col("kind").alias("src"), "name", T.without("name", fixed.LEGAL).alias("core"), F.col("nums_street").alias("addr"), "nums")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(o, s, tok, rank)."""
    every = _records(spark, sf).select("rec_id", "src")
    o = every.where("src > 0").select(F.col("rec_id").alias("o"), F.explode(F.array(*map(F.lit, STEPS))).alias("step"))
    o = o.withColumn("s", F.expr("CAST(floor(o / 10) AS BIGINT) * 10 + step * 10")).withColumn("tok", F.expr("o * 31 % 97 + step * 7 % 89 + 1"))
    real = o.join(every.where("src = 0").select(F.col("rec_id").alias("s")), "s", "left_semi").select("o", "s", "tok")
    return real.withColumn("rank", F.row_number().over(Window.partitionBy("o").orderBy(F.desc("tok"), "s")))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pairs with name, core, addr, nums of both sides and the score fce of every third pair."""
    r = _records(spark, sf)
    side = lambda x: r.select(F.col("rec_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("name", "core", "addr", "nums")])
    return _pairs(spark, sf).join(side("o"), "o").join(side("s"), "s").withColumn("fce", F.expr("CASE WHEN tok % 3 = 0 THEN tok / 200D END"))


def _p1(spark, sf):
    return _pairs(spark, sf).select("o", "s", F.round(F.col("tok") / 200, 6).alias("p1"))


def _ce(spark, sf):
    return _pairs(spark, sf).select("o", "s", F.col("tok").cast("double").alias("ce"), F.expr("CASE WHEN tok % 3 <> 0 THEN CAST(tok * 7 % 101 AS DOUBLE) END").alias("s2"))


def _dense(spark, sf):
    return _pairs(spark, sf).where("tok % 4 <> 0").select("o", "s", F.row_number().over(Window.partitionBy("o").orderBy("s")).alias("drank"))


def _truth(spark, sf):
    return _records(spark, sf).where("src > 0").select(F.col("rec_id").alias("o"), F.expr("CAST(floor(rec_id / 10) AS BIGINT) * 10").alias("s"))


def _p(spark, sf):
    return _p1(spark, sf).withColumnRenamed("p1", "p")


def _q(spark, sf):
    return _pairs(spark, sf).where("tok % 2 = 0").select("o", "s", F.round(F.col("tok") * 7 % 101 / 101, 6).alias("q"))


def _best(spark, sf):
    return L.best_per_record(_p(spark, sf), "p")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


def _raw(spark, sf):
    return X.raw_features(_texts(spark, sf).withColumnsRenamed({f"{c}_{x}": f"raw_{c}_{x}" for c in ("name", "addr") for x in "os"}))


QUERIES = {
    "pair_features": lambda s, d: _rounded(X.pair_features(_pairs(s, d), _records(s, d))),
    "second_pass_competition": lambda s, d: X.second_pass(_p1(s, d)),
    "second_pass_features": lambda s, d: X.second_pass_features(_p1(s, d), _records(s, d)),
    "record_level_features": lambda s, d: X.record_level(_ce(s, d)),
    "raw_text_features": _raw,
    "edit_features": lambda s, d: X.edit_features(_texts(s, d)),
    "org_change_kinds": lambda s, d: _texts(s, d).select("o", "s", E.org_change_of("name_o", "name_s").alias("kind")),
    "generic_word_rule": lambda s, d: X.generic_rule(_texts(s, d)).select("o", "s"),
    "org_word_rule": lambda s, d: X.org_word_rule(_texts(s, d)).select("o", "s"),
    "recovered_links": lambda s, d: X.recovered(_texts(s, d), L.accepted(_best(s, d), 0.6, 0.1)),
    "expanded_candidates": lambda s, d: X.expanded(_pairs(s, d), _dense(s, d), _best(s, d), 0.5, near=2, after=1, upto=2),
    "recall_audit": lambda s, d: X.recall_audit(_truth(s, d), _pairs(s, d), _dense(s, d)),
    "rescoring_cascade": lambda s, d: X.rescored(_p(s, d), _q(s, d), 0.5),
    "model_blend": lambda s, d: X.blended(_p(s, d), _q(s, d), 0.6),
    "agreement_filter": lambda s, d: X.agreed(_best(s, d), _q(s, d), 0.4, 0.05, 0.5),
    "pseudo_labels": lambda s, d: X.pseudo_labels(_p(s, d), 0.6, 0.1, 0.3),
}

# --- SQL -------------------------------------------------------------------------------------------------------------


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_REC = f"""rec AS (SELECT k * 10 + kind AS rec_id, kind AS src, {_NAME} AS name, nums_street AS addr, nums FROM ({R.BUSINESS}) b)"""
_PAIR = (
    _REC
    + f""", pr AS (SELECT o, s, tok, CAST(row_number() OVER (PARTITION BY o ORDER BY tok DESC, s) AS INT) AS rank FROM (
SELECT rec_id AS o, rec_id // 10 * 10 + step * 10 AS s, rec_id * 31 % 97 + step * 7 % 89 + 1 AS tok FROM rec CROSS JOIN (SELECT unnest({STEPS}) AS step) WHERE src > 0)
WHERE s IN (SELECT rec_id FROM rec WHERE src = 0))"""
)
_PQ = (
    _PAIR
    + """, p AS (SELECT o, s, round(tok / 200, 6) AS p FROM pr), q AS (SELECT o, s, round(tok * 7 % 101 / 101, 6) AS q FROM pr WHERE tok % 2 = 0),
dn AS (SELECT o, s, row_number() OVER (PARTITION BY o ORDER BY s) AS drank FROM pr WHERE tok % 4 <> 0),
bs AS (SELECT o, s, p, coalesce(p2, 0) AS p2 FROM (SELECT *, row_number() OVER w AS r, lead(p) OVER w AS p2 FROM p WINDOW w AS (PARTITION BY o ORDER BY p DESC, s)) WHERE r = 1)"""
)
_ONLY = lambda x, y, ws: f"list_filter(string_split({x}, ' '), lambda w: {ws} AND NOT list_contains(string_split({y}, ' '), w))"
_CORE = lambda x: f"array_to_string(list_filter(string_split({x}, ' '), lambda w: NOT list_contains({_list(fixed.LEGAL)}, w)), ' ')"
_SIZE = lambda x, y, words="": f"len({_ONLY(x, y, words or 'true')})"
_NOT_IN = lambda words: f"NOT list_contains({_list(words)}, w)"
_IN_ORG = f"list_contains({_list(fixed.ORG)}, w)"

ORACLES = {
    "second_pass_competition": f"""WITH {_PQ}, x AS (SELECT o, s, p AS p1, row_number() OVER w AS p1_rank, lead(p) OVER w AS nx, max(p) OVER (PARTITION BY o) AS top, row_number() OVER v AS place FROM p WINDOW w AS (PARTITION BY o ORDER BY p DESC, s), v AS (PARTITION BY s ORDER BY p DESC, o)),
g AS (SELECT s, count(*) FILTER (p1 > 0.5) AS n_hi, sum(p1) AS sum_p, max(o) FILTER (place = 1) AS q1_o, max(p1) FILTER (place = 1) AS q1_p, max(o) FILTER (place = 2) AS q2_o, max(p1) FILTER (place = 2) AS q2_p FROM x GROUP BY s)
SELECT o, s, p1, CAST(p1_rank AS INT) AS p1_rank, round(CASE WHEN p1_rank = 1 THEN p1 - coalesce(nx, p1) ELSE p1 - top END, 9) AS p1_gap, CASE WHEN place = 1 THEN q2_p ELSE q1_p END AS s_other_p, CASE WHEN place = 1 THEN q2_o ELSE q1_o END AS partner,
 n_hi - CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END AS s_n_hi, round(sum_p - p1, 6) AS s_sum_other FROM x JOIN g USING (s)""",
    "record_level_features": f"""WITH {_PAIR}, c AS (SELECT o, s, CAST(tok AS DOUBLE) AS ce, CASE WHEN tok % 3 <> 0 THEN CAST(tok * 7 % 101 AS DOUBLE) END AS s2 FROM pr),
x AS (SELECT *, CAST(s2 IS NOT NULL AS INT) AS has_s2, count(*) OVER (PARTITION BY o) AS n_o, CAST(row_number() OVER w AS INT) AS ce_rank, CASE WHEN s2 IS NOT NULL THEN CAST(row_number() OVER v AS INT) END AS s2_rank, lead(ce) OVER w AS cn, lead(s2) OVER v AS sn, max(ce) OVER (PARTITION BY o) AS cm, max(s2) OVER (PARTITION BY o) AS sm
FROM c WINDOW w AS (PARTITION BY o ORDER BY ce DESC, s), v AS (PARTITION BY o ORDER BY s2 DESC NULLS LAST, s)),
y AS (SELECT *, CASE WHEN ce_rank = 1 THEN coalesce(cn, 0) ELSE cm END AS ce_2nd FROM x)
SELECT o, s, ce, s2, has_s2, n_o, ce_rank, s2_rank, ce_2nd, s2 - CASE WHEN s2_rank = 1 THEN sn ELSE sm END AS s2_gap, ce - ce_2nd AS ce_gap FROM y""",
    "generic_word_rule": f"""WITH {_PAIR}, t AS (SELECT pr.o, pr.s, a.name AS no, b.name AS ns, {_CORE("a.name")} AS co, {_CORE("b.name")} AS cs FROM pr JOIN rec a ON a.rec_id = pr.o JOIN rec b ON b.rec_id = pr.s),
u AS (SELECT o, s, {_SIZE("co", "cs")} > 0 AND {_SIZE("co", "cs", _NOT_IN(fixed.GENERIC_CORE))} = 0 AND {_SIZE("cs", "co", _NOT_IN(fixed.GENERIC_CORE))} = 0 AS generic, {_SIZE("co", "cs", _NOT_IN(fixed.ORG_FILLER))} = 0 AS fill,
 {_SIZE("no", "ns", _IN_ORG)} > 0 AND {_SIZE("ns", "no", _IN_ORG)} > 0 AS mixed FROM t)
SELECT o, s FROM u WHERE CASE WHEN generic THEN fill ELSE NOT mixed END""",
    "expanded_candidates": f"""WITH {_PQ} SELECT o, s FROM (SELECT o, s FROM dn WHERE drank <= 2 UNION SELECT o, s FROM pr WHERE rank = 2) x
WHERE o IN (SELECT o FROM bs WHERE p < 0.5) AND (o, s) NOT IN (SELECT (o, s) FROM pr WHERE rank <= 1)""",
    "recall_audit": f"""WITH {_PQ} SELECT count(*) AS n, count(*) FILTER (rank <= 3) AS top3, count(*) FILTER (rank <= 10) AS top10, count(*) FILTER (drank <= 5) AS dense5, count(*) FILTER (rank <= 6 OR drank <= 5) AS together
FROM (SELECT rec_id AS o, rec_id // 10 * 10 AS s FROM rec WHERE src > 0) t LEFT JOIN pr USING (o, s) LEFT JOIN dn USING (o, s)""",
    "rescoring_cascade": f"WITH {_PQ} SELECT p.o, p.s, CASE WHEN b.p < 0.5 THEN coalesce(q.q, p.p) ELSE p.p END AS p FROM p JOIN bs b ON b.o = p.o LEFT JOIN q ON q.o = p.o AND q.s = p.s",
    "model_blend": f"WITH {_PQ} SELECT o, s, round(CAST(0.6 AS DOUBLE) * p + (1 - CAST(0.6 AS DOUBLE)) * coalesce(q, 0), 9) AS p FROM p LEFT JOIN q USING (o, s)",
    "agreement_filter": f"WITH {_PQ} SELECT bs.o, bs.s FROM bs JOIN q ON q.o = bs.o AND q.s = bs.s WHERE p >= 0.4 AND p - p2 >= CAST(0.05 AS DOUBLE) AND q >= 0.5",
    "pseudo_labels": f"WITH {_PQ} SELECT o, s, CAST(y AS INT) AS y FROM (SELECT o, s, CASE WHEN p >= 0.6 AND p - p2 >= CAST(0.1 AS DOUBLE) THEN 1 WHEN p < 0.3 THEN 0 END AS y FROM bs) WHERE y IS NOT NULL",
}
