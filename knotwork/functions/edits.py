"""What changed between a record's name and address and its reference's: word alignment, edit counts, organisation words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from . import fixed
from .similarity import ratio

#: Least ratio at which two words count as spellings of one.
NEAR = 75

NAME_COUNTS = ["n_o", "n_s", "n_common", "typo"]
KINDS = {"generic": frozenset(fixed.EDIT_GENERIC), "filler": frozenset(fixed.EDIT_FILLER), "legal": frozenset(fixed.EDIT_LEGAL)}
_KNOWN = frozenset().union(*KINDS.values())
COUNTS = [*NAME_COUNTS, *(f"{way}_{k}" for way in ("add", "drop") for k in ("core", *KINDS)), "legal_swap", "order_changed", "a_common", "a_typo", "a_add", "a_drop"]


def aligned(o: list[str], s: list[str]) -> tuple[int, int, list[str], list[str]]:
    """Distinct shared words, spelling pairs, and what is left of either side.

    Each unshared word of o, in order, takes the nearest free word of s (the first of equals); short words must be equal to it.
    """
    shared = set(o) & set(s)
    free, extra, near = [w for w in s if w not in shared], [], 0
    for word in (w for w in o if w not in shared):
        scores = [ratio(word, f) for f in free]
        best = max(scores, default=0.0)
        if best >= NEAR and (len(word) >= 3 or best == 100):
            free.pop(scores.index(best))
            near += 1
        else:
            extra.append(word)
    return len(shared), near, extra, free


def edit_counts(name_o: str | None, name_s: str | None, addr_o: str | None, addr_s: str | None) -> dict[str, int]:
    """COUNTS of one pair; null counts as empty. Articles and, in addresses, numbers do not count."""
    o, s = ([w for w in (x or "").split() if w not in fixed.ARTICLES] for x in (name_o, name_s))
    common, typo, *left = aligned(o, s)
    out = {"n_o": len(o), "n_s": len(s), "n_common": common, "typo": typo}
    for way, words in zip(("add", "drop"), left, strict=True):
        out[f"{way}_core"] = sum(w not in _KNOWN for w in words)
        out |= {f"{way}_{k}": sum(w in members for w in words) for k, members in KINDS.items()}
    forms = [sorted(w for w in x if w in KINDS["legal"]) for x in (o, s)]
    out["legal_swap"] = int(all(forms) and forms[0] != forms[1])
    out["order_changed"] = int([w for w in o if w in set(s)] != [w for w in s if w in set(o)])
    common, typo, add, drop = aligned(*([w for w in (x or "").split() if not w.isdigit()] for x in (addr_o, addr_s)))
    return out | {"a_common": common, "a_typo": typo, "a_add": len(add), "a_drop": len(drop)}


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in COUNTS]))
def edits_of(name_o: pd.Series, name_s: pd.Series, addr_o: pd.Series, addr_s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edit_counts(*x) for x in zip(name_o, name_s, addr_o, addr_s, strict=True)], columns=COUNTS, dtype="int32")


_VOCABULARY = frozenset(fixed.ORG + fixed.ORG_NEW)
_PLAIN = frozenset(fixed.ORG_FILLER + fixed.EDIT_LEGAL + fixed.ARTICLES)
_DIGITS = str.maketrans("10", "lo")


def org_change(name_o: str | None, name_s: str | None) -> str:
    """How the organisation words of the record differ from the reference's, once spelling pairs have cancelled out."""
    o, s = (name_o or "").split(), (name_s or "").split()
    new = [w for w in o if w not in set(s)]
    added = [w.translate(_DIGITS) for w in new if w not in _PLAIN]
    dropped = [w.translate(_DIGITS) for w in s if w not in set(o) and w not in _PLAIN]
    rest = []
    for word in added:
        twin = next((i for i, d in enumerate(dropped) if ratio(word, d) >= NEAR), None)
        if twin is None:
            rest.append(word)
        else:
            del dropped[twin]
    match any(w in _VOCABULARY for w in rest), any(w in _VOCABULARY for w in dropped):
        case True, True:
            return "swap"
        case True, False:
            return "org added (other drop)" if dropped else "org added"
        case False, True:
            filler = " + filler" if any(w in fixed.ORG_FILLER for w in new) else ""
            return f"org dropped{filler}{' (other add)' if rest else ''}"
    return "none"


@F.pandas_udf(StringType())
def org_change_of(name_o: pd.Series, name_s: pd.Series) -> pd.Series:
    return pd.Series([org_change(*x) for x in zip(name_o, name_s, strict=True)], dtype="object")
