"""Text normalisation of records as column expressions (inside whole-stage code); state names need one Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed, indic


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x) -> Column:
    """Null to empty, lower case, Latin accents folded, "&" as a word, other characters as one space."""
    x = F.lower(F.coalesce(_col(x), F.lit("")))
    x = F.when(F.length(x) == F.octet_length(x), x).otherwise(F.translate(x, *fixed.FOLD))  # nothing to fold in ASCII
    return F.trim(F.regexp_replace(F.replace(x, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def to_ascii(x) -> Column:
    """Latin accents folded and Indian scripts in Latin letters, lower case; ASCII texts pass through as they are."""
    x = _col(x)
    return F.when(x.rlike("[^\\x00-\\x7F]"), F.translate(indic.latin(F.lower(x)), *fixed.FOLD)).otherwise(x)


def words(x, least: int = 1) -> Column:
    return F.filter(F.split(_col(x), " "), lambda w: F.length(w) >= least)


def map_words(x, mapping: dict[str, str]) -> Column:
    """Whole words replaced by the mapping; words mapped to nothing go."""
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    put = lambda w: F.when(w.isin(*mapping), F.element_at(table, w)).otherwise(w)  # noqa: E731  a map is searched from its start, a list of words by a hash
    return F.array_join(F.filter(F.transform(F.split(_col(x), " "), put), lambda w: w != ""), " ")


def without(x, drop: list[str]) -> Column:
    return F.array_join(F.filter(words(x), lambda w: ~w.isin(*drop)), " ")


def fix_name(x) -> Column:
    """Legal forms in one spelling; what precedes an alias marker goes unless nothing would be left."""
    x = _col(x)
    for a, b in fixed.NAME_FIX:
        x = F.regexp_replace(x, a, b)
    short = F.regexp_replace(x, fixed.ALIAS, "")
    return F.when(short != "", short).otherwise(x)


def house_numbers(x) -> Column:
    """Ordinals, zero padding and number prefixes to bare numbers."""
    x = F.regexp_replace(_col(x), r"\b(\d+)(?:st|nd|rd|th)\b", "$1")
    return F.regexp_replace(F.regexp_replace(x, r"\b0+(\d)", "$1"), r"\bndeg(\d)", "$1")


def french_suffixes(x) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(x), r"\b(\d+) ?(?:bis|b)\b", "$1 bis"), r"\b(\d+) ?(?:ter|t)\b", "$1 ter")


def drop_regions(x) -> Column:
    parts = F.filter(F.split(F.coalesce(_col(x), F.lit("")), ","), lambda p: ~F.trim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", " ")).isin(*fixed.FR_REGIONS))
    return F.array_join(parts, ",")


_STATES = re.compile("|".join(f" {k} " for k in sorted(fixed.STATES, key=len, reverse=True)))


@F.pandas_udf(StringType())
def shorten_states(x: pd.Series) -> pd.Series:
    """State names to their codes, longest first; a match takes the space on both sides."""
    swap = lambda m: f" {fixed.STATES[m[0].strip()]} "
    return x.map(lambda t: None if t is None else _STATES.sub(swap, f" {t} ").strip())


def sound(x) -> Column:
    """The consonant skeleton of every word."""
    x = _col(x)
    for a, b in fixed.SOUND:
        x = F.regexp_replace(x, a, b)
    for _ in range(2):
        x = F.regexp_replace(x, r"([a-z])\1", "$1")
    return F.regexp_replace(x, "s( |$)", "$1")


def squashed(x) -> Column:
    return F.replace(_col(x), F.lit(" "), F.lit(""))


def street(x) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_col(x), "[0-9]+", " "), " +", " "))


def numbers(x) -> Column:
    return F.array_join(F.regexp_extract_all(_col(x), F.lit(r"(\d+)"), F.lit(1)), " ")


def normalized(records: DataFrame, french: str = "fr", states: bool = False) -> DataFrame:
    """rec_id, src, country, name, core, addr, nums from raw_name and raw_addr; states adds the Arrow step."""
    fr = F.col("country") == french
    out = records.withColumn("name", fix_name(clean("raw_name"))).withColumn("addr", house_numbers(clean(F.when(fr, drop_regions("raw_addr")).otherwise(F.col("raw_addr")))))
    out = out.withColumn("addr", F.when(fr, french_suffixes("addr")).otherwise(F.col("addr"))).withColumn("nums", numbers("addr"))
    out = out.withColumn("name", F.when(fr, map_words("name", fixed.FR_NAME)).otherwise(F.col("name")))
    if states:
        out = out.withColumn("addr", shorten_states("addr"))
    core = F.when(fr, without("name", fixed.LEGAL + fixed.FR_FILLER)).otherwise(without("name", fixed.LEGAL))
    addr = F.when(fr, map_words("addr", fixed.ADDRESS_FR)).otherwise(map_words("addr", fixed.ADDRESS))
    return out.withColumn("core", core).withColumn("addr", addr).select("rec_id", "src", "country", "name", "core", "addr", "nums")
