"""Queries of samples, labels, models, thresholds and list files, over businesses made from customer keys, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, indic
from ..functions import similarity as S
from ..functions import text as T
from ..operators import features as X
from ..operators import linkage as L
from ..operators import models as M
from ..operators import training as A
from ..sources import tables
from . import records as R
from . import scoring as C

RATE, SEED = 0.4, 3
RULES, DEFAULT = {"c0": (0.5, 0.1), "c1": (0.3, 0.0)}, (0.4, 0.05)
#: Letters of names that every fourth business writes in Tamil or Devanagari.
SCRIPT = ("aeioklmnrst", "ஆஏஇஒकலमனरசट")


def _references(spark, sf):
    return C._records(spark, sf).where("src = 0 AND rec_id % 70 = 0").select(F.col("rec_id").alias("s"))


def _linked(spark, sf):
    """Every third record's true link, held out by its reference."""
    return C._truth(spark, sf).where("o % 3 = 0").select("o", F.col("s").alias("h"), A.held_out("s").alias("held"))


def _ranked(spark, sf):
    return C._pairs(spark, sf).select("o", "s", F.round(F.col("tok") / 200, 6).alias("p"), "rank")


def _script(spark, sf):
    name = F.when(F.col("rec_id") % 4 == 0, F.translate("name", *SCRIPT)).when(F.col("rec_id") % 4 == 1, F.replace("name", F.lit("a"), F.lit("à"))).otherwise(F.col("name"))
    return C._records(spark, sf).select("rec_id", name.alias("raw"))


def _countries(spark, sf):
    return C._records(spark, sf).where("src > 0").select(F.col("rec_id").alias("o"), F.concat(F.lit("c"), F.col("rec_id") % 3).alias("country"))


def _level(spark, sf):
    src = C._records(spark, sf).select(F.col("rec_id").alias("o"), "src")
    return X.record_level(C._ce(spark, sf)).join(src, "o").select("o", "s", "src", "ce", "ce_rank")


def _entities(spark, sf):
    return C._records(spark, sf).select("rec_id", F.concat(F.lit("S"), F.col("src") + 1, F.lit("-"), F.col("rec_id")).alias("entity_id"))


def _lists(spark, sf, truth) -> DataFrame:
    ids = _entities(spark, sf)
    named = truth.join(ids.toDF("o", "eo"), "o").join(ids.toDF("s", "es"), "s").select(F.col("eo").alias("o"), F.col("es").alias("s"))
    return tables.match_lists(named, ids.where("entity_id LIKE 'S1-%'").select(F.col("entity_id").alias("s")))


def _swapped(spark, sf):
    base, other = _lists(spark, sf, C._truth(spark, sf)), _lists(spark, sf, C._p(spark, sf).where("p > 0.4").select("o", "s"))
    return tables.swapped(base, other, _entities(spark, sf).where("rec_id % 30 = 0").select(F.col("entity_id").alias("s")))


def _jaccard():
    def score(a, b):
        return [len(x & y) / max(1, len(x | y)) for x, y in ((set(p.split()), set(q.split())) for p, q in zip(a, b, strict=True))]

    return score


def _letters():
    """A stand-in for a language model: a vector of letter counts for each word."""

    def vectors(texts):
        return [np.array([[w.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for w in t.split()], float).reshape(-1, 26) for t in texts]

    return vectors


def _scored(spark, sf):
    t = C._texts(spark, sf).select("o", "s", F.col("name_o").alias("a"), F.col("name_s").alias("b"))
    return M.scored_by(t, _jaccard).select("o", "s", F.round("ce", 6).alias("ce"))


def _embedded(spark, sf):
    v = M.embedded(C._records(spark, sf).select("rec_id", A.model_text().alias("text")), _letters, "text", "", 2)
    return v.select("rec_id", F.transform("v", lambda x: F.round(x.cast("double"), 5)).alias("v"))


FEATURES = ["tok", "rank", "name_ratio", "core_tset", "core_partial", "core_jw", "addr_tset", "num_first_eq", "num_jacc", "pt_core_tset", "s_n", "n_cand"]
SMALL = {"trees": 4, "depth": 3}


def _training(spark, sf):
    return A.labelled(X.pair_features(C._pairs(spark, sf), C._records(spark, sf)), C._truth(spark, sf))


def _two_passes(spark, sf):
    p, _ = M.two_passes(_training(spark, sf), FEATURES, C._records(spark, sf), A.draw("o", SEED) < int(0.7 * 2**32), **SMALL)
    return p.select("o", "s", F.round("p1", 6).alias("p1"), F.round("p2", 6).alias("p2"))


def _stacked(spark, sf):
    p, _ = M.stacked(_training(spark, sf), FEATURES, C._truth(spark, sf), decoy=2.0, **SMALL)
    return p.select("o", "s", "fold", F.round("p", 6).alias("p"))


def blocking_records(spark, sf):
    """Businesses as normalised records of one country with their own streets and numbers."""
    return C._records(spark, sf).withColumn("country", F.lit("x")).withColumn("src", F.col("src").cast("int"))


def _grid(spark, sf):
    refs = C._records(spark, sf).where("src = 0").select(F.col("rec_id").alias("s"))
    return L.threshold_grid(C._best(spark, sf), C._truth(spark, sf), refs, GRID)


GRID = [(a, b) for a in (0.1, 0.2, 0.3) for b in (0.0, 0.1)]

QUERIES = {
    "training_split": lambda s, d: A.split(C._pairs(s, d), _references(s, d), RATE, SEED).select("o", "s", "part"),
    "bernoulli_records": lambda s, d: A.bernoulli(C._pairs(s, d), RATE, SEED).select("o", "s"),
    "seeded_sample": lambda s, d: A.seeded_sample(C._truth(s, d), 500, SEED),
    "labelled_pairs": lambda s, d: A.labelled(C._pairs(s, d), C._truth(s, d)).select("o", "s", "y"),
    "group_any": lambda s, d: A.touching(C._pairs(s, d), _references(s, d)).select("o", "s", "has"),
    "first_records": lambda s, d: A.first_of(C._pairs(s, d)),
    "model_texts": lambda s, d: C._records(s, d).select("rec_id", A.model_text().alias("text"), A.held_out("rec_id").alias("held")),
    "regional_training_rows": lambda s, d: A.regional_rows(_linked(s, d), _ranked(s, d), high=0.6, low=0.3, records=400, seed=SEED),
    "renamed_records": lambda s, d: A.renamed(C._records(s, d), L.word_dictionary(R.business_pairs(s, d), share=0.1), fixed.LEGAL).select("rec_id", "name", "core"),
    "script_to_latin": lambda s, d: _script(s, d).select("rec_id", indic.indian("raw").alias("indian"), T.to_ascii("raw").alias("ascii")),
    "reference_level": lambda s, d: M.reference_level(_level(s, d), 60.0),
    "top_by_score": lambda s, d: M.top(C._p(s, d), 2).select("o", "s", "p", "place"),
    "best_threshold": lambda s, d: M.best_point(_grid(s, d)),
    "country_thresholds": lambda s, d: M.accepted_by_country(C._best(s, d), _countries(s, d), RULES, DEFAULT),
    "merged_scores": lambda s, d: M.merged_scores(C._p(s, d).where("o % 2 = 0"), C._q(s, d).withColumnRenamed("q", "p"), C._p(s, d).where("o % 7 = 0 AND p > 0.2")),
    "entity_lists": lambda s, d: _lists(s, d, C._truth(s, d)),
    "entity_list_pairs": lambda s, d: tables.id_pairs(_lists(s, d, C._truth(s, d)), _entities(s, d)),
    "swapped_lists": _swapped,
    "jaro_winkler": lambda s, d: R.business_pairs(s, d).select("o", "s", F.round(S.jaro_winkler_of("name_o", "name_s"), 6).alias("jw")),
    "scored_by_model": _scored,
    "embedded_records": _embedded,
    "blocking_recall": lambda s, d: L.recall(L.candidates(blocking_records(s, d)), C._truth(s, d)),
    "two_pass_scores": _two_passes,
    "stacked_scores": _stacked,
}

# --- SQL -------------------------------------------------------------------------------------------------------------

_DRAW = lambda x, seed: f"CAST('0x' || substr(md5('{seed}:' || {x}), 1, 8) AS BIGINT)"
_HELD = lambda x: f"CAST('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0"
_PICKED = f"{_DRAW('o', SEED)} < {int(RATE * 2**32)}"
_TRUE = "tr AS (SELECT rec_id AS o, rec_id // 10 * 10 AS s FROM rec WHERE src > 0)"
_HAS = "bool_or(s IN (SELECT rec_id FROM rec WHERE src = 0 AND rec_id % 70 = 0)) OVER (PARTITION BY o)"
_DICT = """bp AS (SELECT x.name AS no, y.name AS ns FROM biz x JOIN biz y ON x.k = y.k AND y.kind = 0 WHERE x.kind > 0),
z AS (SELECT unnest(list_zip(string_split(no, ' '), string_split(ns, ' '))) AS z FROM bp WHERE len(string_split(no, ' ')) = len(string_split(ns, ' '))),
c AS (SELECT z[1] AS x, z[2] AS y, count(*) AS n FROM z GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS r, sum(n) OVER (PARTITION BY x) AS t FROM c),
dict AS (SELECT x, y FROM r WHERE r = 1 AND n >= 2 AND n >= t * 0.1 AND x <> y)"""
_ROUTE = "CASE country WHEN 'c0' THEN {0} WHEN 'c1' THEN {1} ELSE {2} END"
_POINT = lambda i: _ROUTE.format(RULES["c0"][i], RULES["c1"][i], DEFAULT[i])
_F = "CASE WHEN nt = 0 THEN CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + tp / nt) END"
_ENT = "ent AS (SELECT rec_id, 'S' || (src + 1) || '-' || rec_id AS entity_id, src FROM rec)"
_LISTED = lambda links: f"SELECT e.entity_id AS s, coalesce(string_agg(DISTINCT f.entity_id, ',' ORDER BY f.entity_id), '') AS matched FROM ent e LEFT JOIN ({links}) t ON t.s = e.rec_id LEFT JOIN ent f ON f.rec_id = t.o WHERE e.src = 0 GROUP BY 1"
_SAMPLE = lambda rows, seed: f"SELECT o, h FROM {rows} ORDER BY {_DRAW('o', seed)}, o LIMIT 400"


def _latin_sql() -> str:
    """The letters of SCRIPT and of the accent, written out one by one."""
    x = "raw"
    for c, v in [*zip(SCRIPT[1], ["a", "e", "i", "o", "k", "l", "m", "n", "r", "c", "t"], strict=True), ("à", "a")]:
        x = f"replace({x}, '{c}', '{v}')"
    return x


ORACLES = {
    "training_split": f"WITH {C._PAIR} SELECT o, s, CASE WHEN has THEN 'val' WHEN {_PICKED} THEN 'train' ELSE 'none' END AS part FROM (SELECT o, s, {_HAS} AS has FROM pr)",
    "bernoulli_records": f"WITH {C._PAIR} SELECT o, s FROM pr WHERE {_PICKED}",
    "seeded_sample": f"WITH {C._REC}, {_TRUE} SELECT o, s FROM tr ORDER BY {_DRAW('o', SEED)}, o LIMIT 500",
    "labelled_pairs": f"WITH {C._PAIR} SELECT o, s, CAST(s = o // 10 * 10 AS INT) AS y FROM pr",
    "group_any": f"WITH {C._PAIR} SELECT o, s, {_HAS} AS has FROM pr",
    "first_records": f"WITH {C._PAIR} SELECT s, (list_sort(list(o)))[1:3] AS firsts FROM pr GROUP BY s",
    "model_texts": f"WITH {C._REC} SELECT rec_id, 'name: ' || name || ' | address: ' || addr AS text, {_HELD('rec_id')} AS held FROM rec",
    "regional_training_rows": f"""WITH {C._PQ}, {_TRUE}, lk AS (SELECT o, s AS h, {_HELD("s")} AS held FROM tr WHERE o % 3 = 0), ru AS (SELECT o, h FROM lk WHERE NOT held),
su AS (SELECT o, s AS h FROM bs WHERE p >= 0.6 AND p2 <= 0.3 AND s NOT IN (SELECT h FROM lk WHERE held) AND o NOT IN (SELECT o FROM ru)),
both_ AS (SELECT *, 'rules' AS origin FROM ({_SAMPLE("ru", SEED)}) UNION ALL SELECT *, 'sure' FROM ({_SAMPLE("su", SEED + 1)}))
SELECT b.o, b.h AS s, coalesce(pr.rank, 99) AS rank, CAST(1 AS INT) AS y, origin FROM both_ b LEFT JOIN pr ON pr.o = b.o AND pr.s = b.h UNION ALL SELECT b.o, pr.s, pr.rank, CAST(0 AS INT), origin FROM both_ b JOIN pr ON pr.o = b.o AND pr.s <> b.h""",
    "renamed_records": f"""WITH {C._REC}, biz AS ({R.BUSINESS}), {_DICT}, w AS (SELECT rec_id, unnest(string_split(name, ' ')) AS x, generate_subscripts(string_split(name, ' '), 1) AS i FROM rec),
m AS (SELECT rec_id, string_agg(coalesce(y, w.x), ' ' ORDER BY i) AS name FROM w LEFT JOIN dict ON dict.x = w.x WHERE w.x <> '' GROUP BY 1) SELECT rec_id, name, {C._CORE("name")} AS core FROM m""",
    "script_to_latin": f"""WITH {C._REC}, x AS (SELECT rec_id, CASE WHEN rec_id % 4 = 0 THEN translate(name, '{SCRIPT[0]}', '{SCRIPT[1]}') WHEN rec_id % 4 = 1 THEN replace(name, 'a', 'à') ELSE name END AS raw FROM rec)
SELECT rec_id, regexp_matches(raw, '[^\\x00-\\x7F\\x{{C0}}-\\x{{24F}}]') AS indian, {_latin_sql()} AS ascii FROM x""",
    "reference_level": f"""WITH {C._PAIR}, c AS (SELECT pr.o, pr.s, rec.src, CAST(tok AS DOUBLE) AS ce, CAST(row_number() OVER (PARTITION BY pr.o ORDER BY tok DESC, pr.s) AS INT) AS ce_rank FROM pr JOIN rec ON rec.rec_id = pr.o)
SELECT *, s_top - s_top_src AS s_top_other FROM (SELECT *, count(*) OVER (PARTITION BY s) AS s_n, count(*) FILTER (ce_rank = 1 AND ce >= 60) OVER (PARTITION BY s) AS s_top, round(sum(ce) OVER (PARTITION BY s), 6) AS s_ce_sum,
 count(*) FILTER (ce_rank = 1 AND ce >= 60) OVER (PARTITION BY s, src) AS s_top_src FROM c)""",
    "top_by_score": f"WITH {C._PQ} SELECT * FROM (SELECT o, s, p, CAST(row_number() OVER (PARTITION BY o ORDER BY p DESC, s) AS INT) AS place FROM p) WHERE place <= 2",
    "best_threshold": f"""WITH {C._PQ}, {_TRUE}, g(least, margin) AS (VALUES {", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in GRID)}),
h AS (SELECT least, margin, b.s, count(*) AS np, count(t.o) AS tp FROM bs b JOIN g ON p >= least AND p - p2 >= margin LEFT JOIN tr t ON t.o = b.o AND t.s = b.s GROUP BY ALL),
i AS (SELECT n.rec_id AS s, count(t.o) AS nt FROM rec n LEFT JOIN tr t ON t.s = n.rec_id WHERE n.src = 0 GROUP BY 1),
x AS (SELECT g.least, g.margin, nt, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp FROM i CROSS JOIN g LEFT JOIN h ON h.s = i.s AND h.least = g.least AND h.margin = g.margin)
SELECT least, margin, round(avg({_F}), 9) AS macro_f05 FROM x GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1""",
    "country_thresholds": f"WITH {C._PQ} SELECT o, s, p, p2 FROM (SELECT *, 'c' || (o % 3) AS country FROM bs) WHERE p >= {_POINT(0)} AND p - p2 >= CAST({_POINT(1)} AS DOUBLE)",
    "merged_scores": f"""WITH {C._PQ}, a AS (SELECT * FROM p WHERE o % 2 = 0), e AS (SELECT * FROM a UNION ALL SELECT * FROM q ANTI JOIN a USING (o, s)), n AS (SELECT * FROM p WHERE o % 7 = 0 AND p > 0.2)
SELECT * FROM e WHERE o NOT IN (SELECT o FROM n) UNION ALL SELECT * FROM n""",
    "entity_lists": f"WITH {C._REC}, {_TRUE}, {_ENT} {_LISTED('SELECT o, s FROM tr')}",
    "entity_list_pairs": f"WITH {C._REC} SELECT rec_id AS o, rec_id // 10 * 10 AS s FROM rec WHERE src > 0",
    "swapped_lists": f"""WITH {C._PQ}, {_TRUE}, {_ENT}, a AS ({_LISTED("SELECT o, s FROM tr")}), b AS ({_LISTED("SELECT o, s FROM p WHERE p > 0.4")})
SELECT a.s, CASE WHEN CAST(split_part(a.s, '-', 2) AS BIGINT) % 30 = 0 THEN coalesce(b.matched, '') ELSE a.matched END AS matched FROM a LEFT JOIN b USING (s)""",
    "jaro_winkler": f"WITH biz AS ({R.BUSINESS}) SELECT x.k * 10 + x.kind AS o, x.k AS s, round(jaro_winkler_similarity(x.name, y.name), 6) AS jw FROM biz x JOIN biz y ON x.k = y.k AND y.kind = 0 WHERE x.kind > 0",
    "scored_by_model": f"""WITH {C._PAIR}, t AS (SELECT pr.o, pr.s, list_distinct(string_split(a.name, ' ')) AS x, list_distinct(string_split(b.name, ' ')) AS y FROM pr JOIN rec a ON a.rec_id = pr.o JOIN rec b ON b.rec_id = pr.s)
SELECT o, s, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS ce FROM t""",
}
