"""Feature tables of candidate pairs (o, s) for the scoring models, and the decisions taken on their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import edits as E
from ..functions import fixed
from ..functions import similarity as S
from ..functions import text as T
from . import linkage as L

#: Similarities of each text of a record and its reference.
SIMILARITIES = {
    "name": {"ratio": S.ratio_of},
    "core": {"ratio": S.ratio_of, "tset": S.token_set_of, "tsort": S.token_sort_of, "partial": S.partial_of, "jw": S.jaro_winkler_of},
    "addr": {"ratio": S.ratio_of, "tset": S.token_set_of, "tsort": S.token_sort_of, "partial": S.partial_of},
    "nums": {"tset": S.token_set_of},
    "snd": {"ratio": S.ratio_of, "tset": S.token_set_of},
    "sq": {"ratio": S.ratio_of, "partial": S.partial_of},
    "street": {"tset": S.token_set_of, "ratio": S.ratio_of},
}
PARTNER = {"core": "pt_core_tset", "addr": "pt_addr_tset"}
TEXTS = list(SIMILARITIES)


def _sided(records: DataFrame, side: str, *columns: str) -> DataFrame:
    return records.select(F.col("rec_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])


def pair_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The 39 features of pairs (o, s, tok, rank) of normalised records, as doubles.

    The partner is the strongest other record of the same reference. Number features are null where either side has no
    number, partner features where there is no partner. All pairs of a record must be present.
    """
    texts = records.withColumns({"snd": T.sound("core"), "sq": T.squashed("core"), "street": T.street("addr")}).select("rec_id", "src", *TEXTS)
    stats = _reference_stats(pairs)
    own = F.col("o1") == F.col("o")
    d = L.within_record(pairs).join(stats, "s").withColumns({"partner": F.when(own, F.col("o2")).otherwise(F.col("o1")), "pt_tok": F.when(own, F.col("t2")).otherwise(F.col("t1"))})
    d = d.join(_sided(texts, "o", "src", *TEXTS), "o").join(_sided(texts, "s", *TEXTS), "s").join(_sided(texts, "partner", *PARTNER), "partner", "left")
    numbers = {k.replace("num_delta", "num_diff"): c.cast("double") for k, c in L.number_columns().items() if k != "num_rel"}
    both, paired = (F.col("nums_o") != "") & (F.col("nums_s") != ""), F.col("partner").isNotNull()
    sims = {f"{c}_{k}": f(f"{c}_o", f"{c}_s") for c, fs in SIMILARITIES.items() for k, f in fs.items()}
    sims["nums_tset"] = F.when(both, sims["nums_tset"])
    sims |= {name: F.when(paired, S.token_set_of(f"{c}_o", F.coalesce(f"{c}_partner", F.lit("")))) for c, name in PARTNER.items()}
    plain = {"tok": F.col("tok"), "rank": F.col("rank"), "tok_rel": F.col("rel"), "tok_gap": F.col("gap"), "n_cand": F.col("n_cand"), "src": F.col("src_o"), "s_n": F.col("s_n"), "s_top1": F.col("s_top1")}
    plain |= {"len_core": F.length("core_o"), "len_core_s": F.length("core_s"), "len_addr": F.length("addr_o"), "len_addr_s": F.length("addr_s")}
    plain |= {"pt_tok": F.when(paired, F.col("pt_tok")), "o_no_num": F.col("nums_o") == ""}
    plain |= numbers | {"num_up": numbers["num_diff"].between(1, 60)}
    return d.select("o", "s", *[x.cast("double").alias(k) for k, x in (sims | plain).items()])


def _reference_stats(pairs: DataFrame) -> DataFrame:
    """Two strongest records of each reference, and its counts divided by their means over references."""
    stats = L.competition(pairs)
    means = stats.agg(F.avg("n_top").alias("m"))
    return stats.crossJoin(F.broadcast(means)).select("s", "o1", "t1", "o2", "t2", F.col("n_rel").alias("s_n"), F.try_divide("n_top", "m").alias("s_top1"))  # one row


def second_pass(scores: DataFrame) -> DataFrame:
    """Competition of first-pass scores (o, s, p1) within the record and among the records of a reference."""
    by_o, by_s = Window.partitionBy("o").orderBy(F.desc("p1"), "s"), Window.partitionBy("s").orderBy(F.desc("p1"), "o")
    d = scores.withColumns({"p1_rank": F.row_number().over(by_o), "next": F.lead("p1").over(by_o), "top": F.max("p1").over(Window.partitionBy("o")), "place": F.row_number().over(by_s)})
    first, second = F.col("place") == 1, F.col("place") == 2
    high = (F.col("p1") > 0.5).cast("long")
    best = d.groupBy("s").agg(
        F.sum(high).alias("n_hi"), F.sum("p1").alias("sum_p"), F.max(F.when(first, F.col("o"))).alias("q1_o"), F.max(F.when(first, F.col("p1"))).alias("q1_p"),
        F.max(F.when(second, F.col("o"))).alias("q2_o"), F.max(F.when(second, F.col("p1"))).alias("q2_p"),
    )
    gap = F.when(F.col("p1_rank") == 1, F.col("p1") - F.coalesce("next", "p1")).otherwise(F.col("p1") - F.col("top"))
    return d.join(best, "s").select(
        "o", "s", "p1", "p1_rank", F.round(gap, 9).alias("p1_gap"), F.when(first, F.col("q2_p")).otherwise(F.col("q1_p")).alias("s_other_p"),
        F.when(first, F.col("q2_o")).otherwise(F.col("q1_o")).alias("partner"), (F.col("n_hi") - high).alias("s_n_hi"), F.round(F.col("sum_p") - F.col("p1"), 6).alias("s_sum_other"),
    )


def second_pass_features(scores: DataFrame, records: DataFrame) -> DataFrame:
    """second_pass and what the record has in common with the partner; null without one."""
    d = second_pass(scores).join(_sided(records, "o", "src", "name", "core", "addr"), "o").join(_sided(records, "partner", "src", "name", "core", "addr"), "partner", "left")
    shared = {"pp_core_tset": S.token_set_of("core_o", "core_partner"), "pp_addr_tset": S.token_set_of("addr_o", "addr_partner"), "pp_name_ratio": S.ratio_of("name_o", "name_partner")}
    return d.select("o", "s", "p1", "p1_rank", "p1_gap", "s_other_p", "s_n_hi", "s_sum_other", *[F.round(x, 6).alias(k) for k, x in shared.items()], (F.col("src_o") == F.col("src_partner")).alias("pp_same_src"))


def record_level(scores: DataFrame) -> DataFrame:
    """Per record, of scores ce and s2 (which may be null): ranks, count, the best other ce and the gaps."""
    o = Window.partitionBy("o")
    by_ce, by_s2 = o.orderBy(F.desc("ce"), "s"), o.orderBy(F.desc_nulls_last("s2"), "s")
    d = scores.withColumns({"has_s2": F.col("s2").isNotNull().cast("int"), "n_o": F.count(F.lit(1)).over(o), "ce_rank": F.row_number().over(by_ce), "s2_rank": F.when(F.col("s2").isNotNull(), F.row_number().over(by_s2))})
    d = d.withColumns({"ce_2nd": F.when(F.col("ce_rank") == 1, F.coalesce(F.lead("ce").over(by_ce), F.lit(0.0))).otherwise(F.max("ce").over(o)), "s2_other": F.when(F.col("s2_rank") == 1, F.lead("s2").over(by_s2)).otherwise(F.max("s2").over(o))})
    return d.withColumn("s2_gap", F.col("s2") - F.col("s2_other")).withColumn("ce_gap", F.col("ce") - F.col("ce_2nd")).drop("s2_other")


def raw_features(pairs: DataFrame) -> DataFrame:
    """Features of lower-cased raw texts (raw_name, raw_addr with _o and _s): what normalising hides."""
    d = pairs
    for side in "os":
        name, addr = (F.lower(F.coalesce(f"raw_{c}_{side}", F.lit(""))) for c in ("name", "addr"))
        forms = F.filter(F.split(name, " "), lambda w: F.regexp_replace(w, "[^a-z]", "").isin(*fixed.EDIT_LEGAL))
        bare = F.transform(forms, lambda w: F.regexp_replace(w, "[^a-z]", ""))
        found = F.transform(F.regexp_extract_all(addr, F.lit(r"(\d+)"), F.lit(1)), lambda x: F.ltrim(x, F.lit("0")))
        d = d.withColumns({f"rn_{side}": name, f"ra_{side}": addr, f"forms_{side}": F.array_join(forms, " "), f"bare_{side}": F.array_join(bare, ""), f"found_{side}": found})
    a, b = F.get("found_o", F.lit(0)), F.get("found_s", F.lit(0))
    change = F.abs(a.try_cast("long") - b.try_cast("long"))
    return d.select(
        "o", "s", F.round(S.ratio_of("rn_o", "rn_s"), 6).alias("r_name"), F.round(S.token_sort_of("rn_o", "rn_s"), 6).alias("r_name_sort"), F.round(S.token_set_of("ra_o", "ra_s"), 6).alias("r_addr"),
        (F.col("forms_o") == F.col("forms_s")).alias("lf_raw_eq"), (F.col("bare_o") == F.col("bare_s")).alias("lf_eq"), F.length("bare_o").alias("lf_o_n"), F.length("bare_s").alias("lf_s_n"),
        (a == b).alias("num_eq"), F.coalesce(F.array_contains("found_o", b), F.lit(False)).alias("num_in"), F.round(F.log1p(change), 6).alias("num_diff"), (F.col("ra_o") == "").alias("o_addr_empty"),
    )


def edit_features(pairs: DataFrame) -> DataFrame:
    """The 26 edit features of pairs with name, addr and nums of both sides (_o, _s). Region names leave addresses."""
    regions = rf"\b({'|'.join(sorted(fixed.FR_REGIONS, key=len, reverse=True))})\b"
    d = pairs
    for side in "os":
        d = d.withColumn(f"addr_{side}", F.trim(F.regexp_replace(F.regexp_replace(f"addr_{side}", regions, " "), " +", " ")))
    first = [F.regexp_extract(f"nums_{x}", r"^(\d+)", 1).try_cast("long") for x in "os"]
    delta = first[0] - first[1]
    rel = F.when(first[0].isNull() & first[1].isNull(), 0).when(first[0].isNull(), 1).when(first[1].isNull(), 2).when(delta == 0, 3).when(delta.between(1, 60), 4).when(delta.between(-60, -1), 5).otherwise(6)
    only = lambda x, y: F.size(F.array_except(F.split(f"nums_{x}", " "), F.split(f"nums_{y}", " ")))
    return d.withColumn("e", E.edits_of("name_o", "name_s", "addr_o", "addr_s")).select(
        "o", "s", "e.*", F.col("name_o").rlike("^[a-z]{2,4}$").alias("o_initials"), F.col("name_o").rlike("^[a-z0-9]+ (com|fr|net|org|in|co)$").alias("o_web"),
        (F.col("addr_o") == "").alias("o_addr_empty"), (F.col("addr_s") == "").alias("s_addr_empty"), rel.alias("num_rel"),
        F.when(delta.isNotNull(), F.greatest(F.lit(-1000), F.least(F.lit(1000), delta))).alias("num_diff"), only("o", "s").alias("o_num_extra"), only("s", "o").alias("s_num_missing"),
    )


# --- rules of organisation words ---


def generic_additions() -> Column:
    """The core words differ by generic words only, and the record has one more."""
    o, s = T.words("core_o"), T.words("core_s")
    within = lambda x: F.forall(x, lambda w: w.isin(*fixed.GENERIC_CORE))
    added = F.array_except(o, s)
    return within(added) & within(F.array_except(s, o)) & (F.size(added) > 0)


def generic_rule(pairs: DataFrame) -> DataFrame:
    """Pairs kept: generic additions go unless all are fillers; so do pairs whose names differ by organisation words on both sides."""
    added = F.array_except(T.words("core_o"), T.words("core_s"))
    fillers = F.forall(added, lambda w: w.isin(*fixed.ORG_FILLER))
    org = lambda x, y: F.exists(F.array_except(T.words(f"name_{x}"), T.words(f"name_{y}")), lambda w: w.isin(*fixed.ORG))
    generic = generic_additions()
    return pairs.where((generic & fillers) | (~generic & ~(org("o", "s") & org("s", "o"))))


def org_word_rule(pairs: DataFrame) -> DataFrame:
    """Pairs kept: those whose organisation words changed in no rejected way."""
    return pairs.where(~E.org_change_of("name_o", "name_s").isin(*fixed.DROPPED_KINDS))


def recovered(pairs: DataFrame, linked: DataFrame, least: float = 0.9) -> DataFrame:
    """(o, s) of unlinked records with exactly one reference at the same address, if the name has typing errors only, is
    another one-word brand, or scores (fce, may be null) at least so much; records that repeat a word do not count."""
    known = pairs.withColumns({"kind": E.org_change_of("name_o", "name_s"), "again": F.coalesce(L.repeats_word(), F.lit(False))}).select("o", "s", "name_o", "fce", "kind", "again")
    same = (F.col("num_rel") == 3) & (F.col("a_add") == 0) & (F.col("a_drop") == 0) & ~F.col("o_addr_empty")
    alone = L.unique_keys(edit_features(pairs).where(same), "o").join(linked.select("o").distinct(), "o", "left_anti").join(known, ["o", "s"])
    unchanged = sum((F.col(c) for c in COUNTED), F.lit(0)) == 0
    brand = (F.col("n_common") == 0) & ~F.col("o_initials") & F.col("name_o").rlike("^[a-z]{5,}( (labs|co|one|sys))?$")
    fits = ((F.col("typo") > 0) & unchanged) | brand | F.coalesce(F.col("fce") >= least, F.lit(False))
    return alone.where(F.col("kind").isin("none", "org dropped", "org dropped (other add)", "org dropped + filler") & ~F.col("again") & fits).select("o", "s")


COUNTED = [f"{way}_{k}" for k in ("core", "generic", "filler", "legal") for way in ("add", "drop")] + ["legal_swap"]


# --- decisions on scores ---


def expanded(ranked: DataFrame, dense: DataFrame, best: DataFrame, least: float, near: int = 5, after: int = 3, upto: int = 6) -> DataFrame:
    """New pairs of records whose best first score is under least: dense ranks up to near and blocking ranks after..upto,
    without the blocking pairs up to rank after, which have been scored."""
    unsure = best.where(F.col("p") < least).select("o")
    more = dense.where(F.col("drank") <= near).select("o", "s").union(ranked.where(F.col("rank").between(after + 1, upto)).select("o", "s")).distinct()
    return more.join(unsure, "o", "left_semi").join(ranked.where(F.col("rank") <= after), ["o", "s"], "left_anti")


def recall_audit(truth: DataFrame, ranked: DataFrame, dense: DataFrame) -> DataFrame:
    """One row: true pairs, and how many of them blocking, dense search and both together have."""
    both = truth.join(ranked.select("o", "s", "rank"), ["o", "s"], "left").join(dense.select("o", "s", "drank"), ["o", "s"], "left")
    count = lambda x: F.count(F.when(x, 1))
    return both.agg(
        F.count(F.lit(1)).alias("n"), count(F.col("rank") <= 3).alias("top3"), count(F.col("rank") <= 10).alias("top10"),
        count(F.col("drank") <= 5).alias("dense5"), count((F.col("rank") <= 6) | (F.col("drank") <= 5)).alias("together"),
    )


def rescored(scores: DataFrame, better: DataFrame, sure: float) -> DataFrame:
    """Scores p replaced by another model's (o, s, q), where it has one, for records whose best score is under sure."""
    unsure = scores.groupBy("o").agg(F.max("p").alias("m")).where(F.col("m") < sure).select("o")
    return scores.join(better.join(unsure, "o", "left_semi"), ["o", "s"], "left").select("o", "s", F.coalesce("q", "p").alias("p"))


def blended(scores: DataFrame, other: DataFrame, weight: float) -> DataFrame:
    """weight * p + (1 - weight) * q of the pairs of scores; a pair that other lacks counts 0 there."""
    return scores.join(other, ["o", "s"], "left").select("o", "s", F.round(weight * F.col("p") + (1 - weight) * F.coalesce("q", F.lit(0.0)), 9).alias("p"))


def agreed(best: DataFrame, scores: DataFrame, least: float, margin: float, other: float) -> DataFrame:
    """Links that the accept rule takes and to which a second scorer (o, s, q) gives at least other."""
    return L.accepted(best, least, margin).join(scores.where(F.col("q") >= other), ["o", "s"], "left_semi").select("o", "s")


def pseudo_labels(pairs: DataFrame, sure: float = 0.95, lead: float = 0.5, never: float = 0.05) -> DataFrame:
    """(o, s, y) of best pairs: 1 if the score is at least sure and leads, 0 if it is under never; others have no label."""
    best = L.best_per_record(pairs, "p")
    y = F.when((F.col("p") >= sure) & (F.col("p") - F.col("p2") >= lead), 1).when(F.col("p") < never, 0)
    return best.select("o", "s", y.alias("y")).where("y is not null")
