"""Queries of linking keys and of reports over two models' links, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import keys as K
from ..operators import linkage as L
from . import records as R

#: Businesses with names that few or no others have, and number signs glued to some addresses.
_NAME = "concat(name, ' q', CAST(k % 700 AS VARCHAR(20)))"
_ADDR = "concat(CASE kind WHEN 1 THEN 'ndeg0' ELSE '' END, nums_street, CASE kind WHEN 2 THEN ' nord lille' ELSE ' lille' END)"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    b = R.businesses(spark, sf)
    return b.select((F.col("k") * 10 + F.col("kind")).alias("rec_id"), F.col("kind").alias("src"), F.lit("fr").alias("country"), F.expr(_NAME).alias("name"), F.expr(_ADDR).alias("addr"))


def _keys(spark, sf):
    return _records(spark, sf).select("rec_id", K.name_key("name").alias("name_key"), K.house_number("addr").alias("number"), K.address_key("addr").alias("addr_key"), K.sorted_address("addr").alias("sorted_addr"))


def _scores(spark, sf):
    """(o, s, q, y): every record with the references of its own key and of the one 56 further."""
    o = _records(spark, sf).where("src > 0").select(F.col("rec_id").alias("o"), F.explode(F.array(F.lit(0), F.lit(56))).alias("step"))
    return o.selectExpr("o", "CAST(floor(o / 10) AS BIGINT) * 10 + step * 10 AS s", "round((o * 31 + step) % 97 / 97D, 6) AS q", "CASE WHEN step = 0 AND o % 3 > 0 THEN 1 ELSE 0 END AS y")


def _reports(spark, sf):
    scores = _scores(spark, sf)
    first = L.accepted(L.best_per_record(scores, "q"), 0.5, 0.1)
    second = scores.where("s % 560 < 280 AND y = 1")
    return K.disagreements(scores.select("o").distinct(), first, second, K.preferred(K.linked(_records(spark, sf))))


QUERIES = {
    "linking_keys": _keys,
    "key_links": lambda s, d: K.linked(_records(s, d)),
    "preferred_key_links": lambda s, d: K.preferred(K.linked(_records(s, d))),
    "model_disagreements": _reports,
    "score_report": lambda s, d: K.score_report(_scores(s, d), 0.6),
}

# --- SQL -------------------------------------------------------------------------------------------------------------


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _rx(x: str, *rules: tuple[str, str]) -> str:
    for a, b in rules:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def _words(x: str, drop) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '' AND NOT list_contains({_list(drop)}, w))"


_GLUED = _rx("addr", (r"\b(ndeg|no)(\d)", r"\2"), (r"\b0+(\d)", r"\1"), (r"\b(\d+)(bis|ter|b|t)\b", r"\1 \2"))
_MAPPED = f"list_transform(string_split({_GLUED}, ' '), lambda w: coalesce({_list(fixed.KEY_ADDRESS.values())}[list_position({_list(fixed.KEY_ADDRESS)}, w)], w))"
_REGIONS = [(rf"\b{r}\b", " ") for r in sorted(fixed.FR_REGIONS, key=len, reverse=True)]
KEYS = f"""rec AS (SELECT k * 10 + kind AS rec_id, kind AS src, {_NAME} AS name, {_ADDR} AS addr FROM ({R.BUSINESS}) b),
keys AS (SELECT *, array_to_string(list_sort(list_distinct({_words("name", fixed.KEY_NOISE)})), ' ') AS name_key,
  nullif(regexp_extract(addr, '(?:^|\\s)(?:ndeg|no)?0*(\\d+)', 1), '') AS number,
  array_to_string(list_sort(list_distinct(list_filter({_MAPPED}, lambda w: w <> '' AND NOT list_contains({_list(fixed.KEY_REGIONS)}, w)))), ' ') AS addr_key,
  array_to_string(list_sort({_words(_rx("addr", *_REGIONS), [])}), ' ') AS sorted_addr FROM rec)"""
LINKS = (
    KEYS
    + """, by_name AS (SELECT name_key, min(rec_id) AS s, min(number) AS number FROM keys WHERE src = 0 AND length(name_key) >= 6 GROUP BY 1 HAVING count(*) = 1),
by_addr AS (SELECT addr_key, min(rec_id) AS s, min(name) AS name FROM keys WHERE src = 0 AND length(addr_key) >= 12 AND regexp_matches(addr_key, '[0-9]') GROUP BY 1 HAVING count(*) = 1),
links AS (SELECT k.rec_id AS o, b.s, 'name' AS kind FROM keys k JOIN by_name b USING (name_key) WHERE k.src <> 0 AND k.number = b.number
  UNION ALL SELECT k.rec_id, b.s, 'address' FROM keys k JOIN by_addr b USING (addr_key) WHERE k.src <> 0 AND list_has_any(string_split(k.name, ' '), string_split(b.name, ' '))),
pref AS (SELECT o, s, kind FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY kind <> 'name', s) AS r FROM links) WHERE r = 1)"""
)
SCORES = LINKS + """, sc AS (SELECT rec_id AS o, rec_id // 10 * 10 + step * 10 AS s, round((rec_id * 31 + step) % 97 / CAST(97 AS DOUBLE), 6) AS q, CASE WHEN step = 0 AND rec_id % 3 > 0 THEN 1 ELSE 0 END AS y
  FROM keys CROSS JOIN (SELECT unnest([0, 56]) AS step) WHERE src > 0),
ranked AS (SELECT *, row_number() OVER w AS r, coalesce(lead(q) OVER w, 0) AS q2 FROM sc WINDOW w AS (PARTITION BY o ORDER BY q DESC, s))"""  # fmt: skip
ORACLES = {
    "linking_keys": f"WITH {KEYS} SELECT rec_id, name_key, number, addr_key, sorted_addr FROM keys",
    "key_links": f"WITH {LINKS} SELECT o, s, kind FROM links",
    "preferred_key_links": f"WITH {LINKS} SELECT o, s, kind FROM pref",
    "model_disagreements": f"""WITH {SCORES}, f AS (SELECT o, s FROM ranked WHERE r = 1 AND q >= 0.5 AND q - q2 >= 0.1), g AS (SELECT o, s FROM sc WHERE s % 560 < 280 AND y = 1),
j AS (SELECT x.o, f.s AS a, g.s AS b, pref.s AS h FROM (SELECT DISTINCT o FROM sc) x LEFT JOIN f USING (o) LEFT JOIN g USING (o) LEFT JOIN pref USING (o)),
c AS (SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'neither' WHEN a = b THEN 'both, same' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'both, different' WHEN a IS NOT NULL THEN 'first only' ELSE 'second only' END AS "case",
  CASE WHEN h IS NULL THEN 'no link' WHEN a = h AND b = h THEN 'both' WHEN a = h THEN 'first' WHEN b = h THEN 'second' ELSE 'neither' END AS support FROM j)
SELECT "case", support, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY "case"), 6) AS share FROM c GROUP BY 1, 2""",
    "score_report": f"""WITH {SCORES}, t AS (SELECT o, max(y) FILTER (r = 1) AS top_y, max(y) AS any_y, max(q) AS top_q, sum(-CASE WHEN y = 1 THEN ln(greatest(least(q, 1 - 1e-6), 1e-6)) ELSE ln(1 - greatest(least(q, 1 - 1e-6), 1e-6)) END) AS loss, count(*) AS n FROM ranked GROUP BY o)
SELECT round(sum(loss) / sum(n), 6) AS log_loss, count(*) FILTER (any_y = 1) AS with_match, count(*) FILTER (any_y = 1 AND top_y = 1) AS on_top, count(*) FILTER (any_y = 0) AS without, count(*) FILTER (any_y = 0 AND top_q < 0.6) AS left_alone FROM t""",
}
