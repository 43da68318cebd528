"""Source context of a claim: reported, forecast, estimate and so on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of modalities, and keywords in their order.
ALIASES = {
    "asserted": "reported",
    "actual": "reported",
    "historical": "reported",
    "estimate": "estimated",
    "projection": "forecast",
    "projected": "forecast",
    "forecasted": "forecast",
    "mandatory": "required",
}
KEYWORDS = (("projected", "forecast"), ("projection", "forecast"), ("forecast", "forecast"), ("guidance", "guidance"), ("estimate", "estimate"), ("actual", "actual"))


def _name(key: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(names[key], key)


def _key(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z]+", "_"), "^_+|_+$", "")


#: Every wording that decides has one of these.
HINTS = ("estimate", "forecast", "project", "expected", "preliminary")


def _said(evidence: Column) -> Column:
    """In lower case with single spaces; empty where no wording can decide, which spares most texts the patterns."""
    low = F.lower(evidence)
    told = reduce(Column.__or__, (F.contains(low, F.lit(hint)) for hint in HINTS))
    return F.when(told, F.regexp_replace(low, r"\s+", " ")).when(evidence.isNotNull(), "")


def _release(said: Column) -> Column:
    """The word before "estimate", empty without one; null for a null text."""
    found = F.regexp_extract(said, r"\b(first|initial|second|revised|updated)\s+(?:advance\s+)?estimates?\b", 1)
    return F.when(~F.contains(said, F.lit("estimate")), "").otherwise(found)


def _canonical(value: Column, evidence: Column, name: Column, said: Column, release: Column) -> Column:
    refined = (
        F.when(release.isin("first", "initial"), "first_estimate")
        .when(release != "", "revised_estimate")
        .when(said.rlike(r"\b(?:forecast(?:ed)?|project(?:ed|ion)|expected to)\b"), "forecast")
        .when(said.rlike(r"\b(?:estimate|estimated|preliminary)\b"), "estimated")
        .otherwise(name)
    )
    canonical = F.when(name.isin("reported", "observed", "estimated") & (F.coalesce(evidence, F.lit("")) != ""), refined).otherwise(name)
    return F.when(value.isNull() | (F.trim(value) == ""), None).otherwise(canonical)


def normalize_modality(value: Column, evidence: Column) -> Column:
    """The canonical name; the evidence's wording decides where the value only says reported, observed or estimated."""
    said = _said(evidence)
    return _canonical(value, evidence, _name(_key(value)), said, _release(said))


def with_context(df: DataFrame, value: str, evidence: str, name: str) -> DataFrame:
    """df with normalize_modality of two columns; each step is a column, so that it is worked out once a row."""
    steps = df.withColumns({"_key": _key(F.col(value)), "_said": _said(F.col(evidence))})
    steps = steps.withColumns({"_name": _name(F.col("_key")), "_release": _release(F.col("_said"))})
    return steps.withColumn(name, _canonical(F.col(value), F.col(evidence), F.col("_name"), F.col("_said"), F.col("_release"))).drop("_key", "_said", "_name", "_release")


def infer_modality(text: Column) -> Column:
    """The modality of the first keyword, in the keywords' order."""
    found = None
    for keyword, name in KEYWORDS:
        hit = F.contains(F.lower(text), F.lit(keyword))
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found
