"""Numbers as text: parsing, canonical form and comparison, in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency tokens in their order, scale words in theirs, texts that stand for a missing value.
CURRENCIES = (("₹", "INR"), ("rs", "INR"), ("rs.", "INR"), ("inr", "INR"), ("$", "USD"), ("usd", "USD"), ("€", "EUR"), ("eur", "EUR"), ("£", "GBP"), ("gbp", "GBP"))
SCALES = (
    ("thousand", 1_000),
    ("k", 1_000),
    ("lakh", 100_000),
    ("lac", 100_000),
    ("crore", 10_000_000),
    ("cr", 10_000_000),
    ("million", 1_000_000),
    ("mn", 1_000_000),
    ("billion", 1_000_000_000),
    ("bn", 1_000_000_000),
    ("trillion", 1_000_000_000_000),
)
MISSING = ("", "-", "—", "–", "n/a", "na", "nil", "none", "not available", "not meaningful", "nm")
NUMBER = r"((?:\(|[-−+])?\s*\d[\d,]*(?:\.\d+)?\s*\)?)"


def first_match(cases: list[tuple[Column, object]]) -> Column:
    """The value of the first case that holds."""
    out = F.when(cases[0][0], cases[0][1])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out


def clean_decimal(text: Column) -> Column:
    """A number's text as a decimal: without commas and spaces, in brackets negative; null where it isn't one."""
    bare = F.translate(F.translate(text, ", \t\n", ""), "−", "-")
    signed = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    return signed.try_cast("decimal(24,8)")


def decimal_text(value: Column) -> Column:
    """Without exponent and trailing zeros."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def bound_operator(raw: Column) -> Column:
    found = F.regexp_extract(raw, r"^\s*(<=|>=|<|>|≤|≥)", 1)
    return F.when(found == "≤", "<=").when(found == "≥", ">=").when(found == "", None).otherwise(found)


def precision(raw: Column) -> Column:
    """Decimal places of the first number; null without one."""
    return F.when(raw.rlike(r"\d"), F.length(F.regexp_extract(raw, r"\d[\d,]*(?:\.(\d+))?", 1)))


def parse_numeric(raw: Column) -> Column:
    """struct(raw, normalized, normalized_end, value_type, unit, currency, precision, operator, trace).

    normalized_end is the second value of a range. Scale words are looked for as whole words, currencies anywhere.
    """
    original = F.trim(raw)
    lower = F.lower(original)
    percent = original.rlike(r"(?i)%|per cent|percent")
    points = original.rlike(r"(?i)percentage\s*points?|pp\b")
    basis = original.rlike(r"(?i)basis\s*points?|\bbps?\b")
    numbers = F.filter(F.transform(F.regexp_extract_all(original, F.lit(NUMBER)), clean_decimal), lambda x: x.isNotNull())
    value, second = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    scale = first_match([(lower.rlike(rf"\b{word}\b"), word) for word, _ in SCALES])
    factor = F.coalesce(first_match([(scale == word, F.lit(n).cast("decimal(13,0)")) for word, n in SCALES]), F.lit(1).cast("decimal(13,0)"))
    currency = first_match([(F.contains(lower, F.lit(token)), code) for token, code in CURRENCIES])
    fraction = percent & ~points
    share = F.when(basis, F.lit("0.0001")).when(fraction, F.lit("0.01")).otherwise(F.lit("1")).cast("decimal(5,4)")
    exact = lambda x: x.cast("decimal(33,12)")
    scaled = exact((value * factor).cast("decimal(28,8)") * share)
    end = exact(second * F.when(basis | fraction, share).otherwise(factor))
    is_range = (F.size(numbers) > 1) & original.rlike("(?i)-|to|–")
    missing = lower.isin(*MISSING)
    textual = value.isNull()
    kind = first_match([(missing, "missing"), (textual, "text"), (is_range, "range"), (basis, "rate"), (fraction, "percentage"), (points, "percentage_points"), (currency.isNotNull(), "money")]).otherwise("number")
    unit = first_match([(missing | textual, F.lit(None).cast("string")), (basis, F.lit("bps")), (fraction, F.lit("%")), (points, F.lit("pp"))]).otherwise(F.coalesce(currency, scale))
    operator = bound_operator(original)
    steps = F.array_compact(
        F.array(
            F.when(~textual, "parse-number"), F.when(scale.isNotNull(), F.concat(F.lit("scale:"), scale)), F.when(fraction, "percent-to-fraction"),
            F.when(basis, "basis-points-to-fraction"), F.when(points, "percentage-points-preserved"), F.when(operator.isNotNull(), F.concat(F.lit("bound:"), operator)),
        )
    )
    trace = F.when(missing, F.array(F.lit("missing-token"))).when(textual, F.array().cast("array<string>")).otherwise(steps)
    known = ~(missing | textual)
    return F.struct(
        original.alias("raw"),
        F.when(known, decimal_text(scaled)).alias("normalized"),
        F.when(known & is_range, decimal_text(end)).alias("normalized_end"),
        kind.alias("value_type"),
        unit.alias("unit"),
        F.when(known, currency).alias("currency"),
        F.when(known, precision(original)).alias("precision"),
        F.when(known, operator).alias("operator"),
        trace.alias("trace"),
    )


def compare_numeric(a: Column, b: Column, precision_a: Column, precision_b: Column, percentage: Column) -> Column:
    """unknown, equal, rounding-compatible or different, for decimals a and b.

    With a precision the tolerance is half a unit of the last place, as a share of the larger value (at least 1), two
    places finer for percentages; without one it is 0.0005 up to 1 and 0.5 above.
    """
    places = F.greatest(F.when(precision_a >= 0, precision_a), F.when(precision_b >= 0, precision_b))
    gap, size = F.abs(a - b), F.greatest(F.abs(a), F.abs(b))
    power = F.pow(F.lit(10), places + F.when(percentage, 2).otherwise(0)).cast("decimal(13,0)")
    # |a - b| <= size / 10^places / 2, without dividing
    close = F.when(places.isNotNull(), gap.cast("decimal(24,8)") * (power * 2).cast("decimal(13,0)") <= F.greatest(size, F.lit(1).cast("decimal(24,8)")))
    plain = F.when(size <= 1, gap <= F.lit("0.0005").cast("decimal(24,8)")).otherwise(gap <= F.lit("0.5").cast("decimal(24,8)"))
    return F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "equal").when(F.coalesce(close, plain), "rounding-compatible").otherwise("different")
