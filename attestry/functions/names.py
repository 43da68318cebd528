"""Keys of entities and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes, and words of each modality that a predicate may carry.
LEGAL_SUFFIXES = r"(?:\s+(?:private\s+limited|pvt\s+ltd|limited|ltd|incorporated|inc|corporation|corp|plc|llc))+$"
FISCAL_FRAGMENT = r"(?:^|_)(?:(?:for|in|during|from|to|as_of|at)_)?(?:fy|fiscal_year|fiscal|calendar_year)_?\d{2,4}(?:_\d{2,4})?(?=_|$)"
MODALITY_WORDS = {
    "actual": ("actual",),
    "asserted": ("asserted", "assertion"),
    "estimate": ("estimate", "estimated"),
    "estimated": ("estimate", "estimated"),
    "forecast": ("forecast", "forecasted", "projected", "projection"),
    "observed": ("observed",),
    "projection": ("forecast", "forecasted", "projected", "projection"),
    "reported": ("reported",),
}


def name_key(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def entity_key(value: Column) -> Column:
    """The name key without legal suffixes; business scopes stay."""
    return F.trim(F.regexp_replace(name_key(value), LEGAL_SUFFIXES, ""))


def predicate_key(value: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown_predicate"))


def conceptual_predicate(value: Column, period: Column, modality: Column) -> Column:
    """The predicate without fiscal fragments (if a period is known) and without its modality's words at either end."""
    key = predicate_key(value)
    has_period = F.coalesce(period, F.lit("")) != ""
    key = F.when(has_period, F.regexp_replace(key, FISCAL_FRAGMENT, "_")).otherwise(key)
    key = F.regexp_replace(F.regexp_replace(key, "_+", "_"), "^_+|_+$", "")
    asked, out = name_key(F.coalesce(modality, F.lit(""))), None
    for name, words in MODALITY_WORDS.items():
        either = "|".join(sorted(words, key=len, reverse=True))
        bare = F.regexp_replace(F.regexp_replace(key, f"^(?:(?:{either})(?:_|$))+", ""), f"(?:(?:^|_)(?:{either}))+$", "")
        out = F.when(asked == name, bare) if out is None else out.when(asked == name, bare)
    return F.coalesce(F.nullif(out.otherwise(key), F.lit("")), F.lit("unknown_predicate"))
