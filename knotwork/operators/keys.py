"""Order-free keys of names and addresses, the links that unique keys give, and reports that hold models against them.

Null texts have null keys and link with nothing. Records are (rec_id, src, country, name, addr), src 0 the references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from . import linkage as L

#: Shortest keys that may link.
NAME_LENGTH, ADDRESS_LENGTH = 6, 12


def name_key(x) -> Column:
    """Distinct words without legal forms and fillers, sorted."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(T.words(x), lambda w: ~w.isin(*fixed.KEY_NOISE)))), " ")


def house_number(x) -> Column:
    """The first number, without a number sign's words and leading zeros; null if there is none."""
    n = F.regexp_extract(x, r"(?:^|\s)(?:ndeg|no)?0*(\d+)", 1)
    return F.when(n != "", n)


def address_key(x) -> Column:
    """Distinct words with street types in one spelling, numbers apart from what is glued to them, no regions; sorted."""
    x = F.regexp_replace(F.regexp_replace(x, r"\b(ndeg|no)(\d)", "$2"), r"\b0+(\d)", "$1")
    mapped = T.words(T.map_words(F.regexp_replace(x, r"\b(\d+)(bis|ter|b|t)\b", "$1 $2"), fixed.KEY_ADDRESS))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(mapped, lambda w: ~w.isin(*fixed.KEY_REGIONS)))), " ")


def sorted_address(x) -> Column:
    """All words in order, repeated ones too, without region names."""
    x = F.col(x) if isinstance(x, str) else x
    for region in sorted(fixed.FR_REGIONS, key=len, reverse=True):
        x = F.regexp_replace(x, rf"\b{region}\b", " ")
    return F.array_join(F.array_sort(T.words(x)), " ")


def _by_key(records: DataFrame, fit: Column) -> DataFrame:
    """(o, s) of records that have a reference's key (column key), one that no other reference has, and fit."""
    side = lambda d, x: d.select("country", "key", *[F.col(c).alias(f"{c}_{x}") for c in ("rec_id", "name", "number")])
    references = L.unique_keys(records.where("src = 0"), "country", "key")
    both = side(records.where("src <> 0"), "o").join(side(references, "s"), ["country", "key"])
    return both.where(fit).select(F.col("rec_id_o").alias("o"), F.col("rec_id_s").alias("s"))


def linked(records: DataFrame) -> DataFrame:
    """(o, s, kind): 'name' links agree in name key and house number, 'address' links in address key and a name word."""
    r = records.withColumn("number", house_number("addr"))
    names = r.withColumn("key", name_key("name")).where(F.length("key") >= NAME_LENGTH)
    addresses = r.withColumn("key", address_key("addr")).where(F.col("key").rlike("[0-9]") & (F.length("key") >= ADDRESS_LENGTH))
    common = F.arrays_overlap(F.split("name_o", " "), F.split("name_s", " "))
    by_name = _by_key(names, F.col("number_o") == F.col("number_s")).withColumn("kind", F.lit("name"))
    return by_name.union(_by_key(addresses, common).withColumn("kind", F.lit("address")))


def initials(forms: DataFrame, references: DataFrame) -> DataFrame:
    """(o, s) of records whose raw name is initials or a website, by country and address key; a record with exactly one
    fitting reference links.

    forms: (o, country, key, raw), references: (s, country, key, core). Initials fit a core whose words begin with them, a
    website or tag fits a core that it holds, written together. Of an address, equal forms and equal cores are compared
    once, and counted: a frequent address costs its different texts, not its records.
    """
    raw = F.col("raw")
    at = ["country", "key"]
    short_forms = forms.where(raw.rlike(fixed.INITIALS) | raw.rlike(fixed.WEB))
    cores = references.groupBy(*at, "core").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"))
    j = short_forms.select(*at, "raw").distinct().join(cores, at)
    short = F.array_join(F.transform(T.words("core"), lambda w: F.substring(w, 1, 1)), "")
    plain = F.regexp_replace(F.regexp_replace(F.lower(raw), r"^[#@]|\.(com|fr|net|org|in|co)$", ""), "[^a-z0-9]", "")
    fit = F.when(raw.rlike(fixed.INITIALS), F.startswith(short, F.lower(raw))).otherwise(F.contains(plain, T.squashed("core")))
    fitting = j.where(fit).groupBy(*at, "raw").agg(F.sum("n").alias("n"), F.min("s").alias("s"))
    links = short_forms.join(fitting, [*at, "raw"]).groupBy("o").agg(F.sum("n").alias("n"), F.min("s").alias("s"))
    return links.where("n = 1").select("o", "s")


def preferred(links: DataFrame) -> DataFrame:
    """One link a record: 'name' before 'address', then the smallest reference."""
    w = Window.partitionBy("o").orderBy(F.col("kind") != "name", "s")
    return links.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def closed(links: DataFrame, *candidates: DataFrame) -> DataFrame:
    """The links, if all are among the candidates (o, s); ValueError names one that is not."""
    rest = links.select("o", "s")
    for c in candidates:
        rest = L.new(rest, c.select("o", "s"))
    if (odd := rest.first()) is not None:
        raise ValueError(f"link outside the candidates: {odd.o}, {odd.s}")
    return links


def disagreements(records: DataFrame, first: DataFrame, second: DataFrame, links: DataFrame) -> DataFrame:
    """(case, support, n, share of the case) of all records (o): which of two link tables (o, s) have the record, and
    which of them agrees with the links (o, s) of unique keys."""
    named = lambda d, c: d.select("o", F.col("s").alias(c))
    d = records.join(named(first, "a"), "o", "left").join(named(second, "b"), "o", "left").join(named(links, "h"), "o", "left")
    a, b, h = F.col("a"), F.col("b"), F.col("h")
    case = F.when(a.isNull() & b.isNull(), "neither").when(a == b, "both, same").when(a.isNotNull() & b.isNotNull(), "both, different").when(a.isNotNull(), "first only").otherwise("second only")
    support = F.when(h.isNull(), "no link").when((a == h) & (b == h), "both").when(a == h, "first").when(b == h, "second").otherwise("neither")
    n = d.groupBy(case.alias("case"), support.alias("support")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("case")), 6))


def score_report(scores: DataFrame, least: float) -> DataFrame:
    """One row for scores (o, s, q, y): log loss of pairs; of records with a true pair, how many have it on top; of those
    without, how many have no score of at least so much."""
    q = F.greatest(F.least("q", F.lit(1 - 1e-6)), F.lit(1e-6))
    loss = -F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q))
    top = scores.groupBy("o").agg(F.max_by("y", F.struct("q", (-F.col("s")).alias("s"))).alias("top_y"), F.max("y").alias("any_y"), F.max("q").alias("top_q"), F.sum(loss).alias("loss"), F.count(F.lit(1)).alias("n"))
    count = lambda x: F.count(F.when(x, 1))
    return top.agg(
        F.round(F.sum("loss") / F.sum("n"), 6).alias("log_loss"), count(F.col("any_y") == 1).alias("with_match"), count((F.col("any_y") == 1) & (F.col("top_y") == 1)).alias("on_top"),
        count(F.col("any_y") == 0).alias("without"), count((F.col("any_y") == 0) & (F.col("top_q") < least)).alias("left_alone"),
    )
