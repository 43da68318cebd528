"""Fiscal period labels and date hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _none_if_empty(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def _compact(value: Column) -> Column:
    """In upper case, without white space, with plain dashes."""
    return F.translate(F.upper(value), "–— \t\n\x0b\f\r", "--")


def _year_part(compact: Column) -> Column:
    return F.regexp_replace(compact, r"^(?:Q[1-4])?(?:FY)?", "")


def _two(rest: Column) -> Column:
    """The last two digits of YY, 20YY, 20YY-YY or 20YY-20YY, in which the year ends; empty for other texts."""
    return F.regexp_extract(rest, r"^(?:20\d{2}[-/](?:20)?(?=\d{2}$)|(?:20)?(?=\d{2}\z))(\d{2})", 1)


def _from(rest: Column) -> Column:
    """The last two digits of the first of two years; empty without one."""
    return F.regexp_extract(rest, r"^20(\d{2})[-/]", 1)


def _label(value: Column, compact: Column, two: Column, start: Column) -> Column:
    """A span's years must follow each other."""
    follows = (start == "") | (start.try_cast("int") + 1 == two.try_cast("int"))
    label = F.concat(F.regexp_extract(compact, "^(Q[1-4])", 1), F.lit("FY"), (F.when(follows, two.try_cast("int")) + 1999).cast("string"), F.lit("/"), two)
    return F.when(F.trim(value) == "", None).otherwise(F.coalesce(label, F.trim(value)))


def normalize_period(value: Column) -> Column:
    """Explicit spellings of a fiscal year become FY{start}/{end}, with the quarter before it; others stay, trimmed."""
    compact = _compact(value)
    rest = _year_part(compact)
    return _label(value, compact, _two(rest), _from(rest))


def with_label(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with normalize_period of a column; each step is a column, so that it is worked out once a row."""
    steps = df.withColumn("_compact", _compact(F.col(value))).withColumn("_rest", _year_part(F.col("_compact")))
    steps = steps.withColumns({"_two": _two(F.col("_rest")), "_from": _from(F.col("_rest"))})
    return steps.withColumn(name, _label(F.col(value), F.col("_compact"), F.col("_two"), F.col("_from"))).drop("_compact", "_rest", "_two", "_from")


def parse_period(text: Column) -> Column:
    """The first fiscal label in a text, by kind of spelling, or the year after a word such as "ended"."""
    compact = F.regexp_replace(F.upper(text), r"\s+", "")
    by_kind = (r"FY20\d{2}(?:/\d{2})?", r"20\d{2}/\d{2}", r"Q[1-4]FY(?:20)?\d{2}")
    year = _none_if_empty(F.regexp_extract(text, r"(?i)(?:year|ended|asat).*?(20\d{2})", 1))
    return F.coalesce(*(_none_if_empty(F.regexp_extract(compact, p, 0)) for p in by_kind), F.concat(F.lit("FY"), year))


def parse_interval(text: Column) -> Column:
    """struct(start, end, basis) of the first one or two ISO dates."""
    dates = F.regexp_extract_all(text, F.lit(r"(\b20\d{2}-\d{2}-\d{2}\b)"))
    basis = F.when(F.size(dates) >= 2, "explicit-iso-range").when(F.size(dates) == 1, "explicit-iso-date")
    return F.struct(F.get(dates, F.lit(0)).alias("start"), F.coalesce(F.get(dates, F.lit(1)), F.get(dates, F.lit(0))).alias("end"), basis.alias("basis"))
