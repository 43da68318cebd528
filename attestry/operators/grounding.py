"""From a model's claims to grounded ones: hints, quotes looked up in their sources, and the checks a claim must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.screening import is_admissible

HINT_LIMIT = 16
# Units that make a hint worth more, and dates that no number is taken from.
UNIT = r"(?i)(?:₹|rs\.?|inr|usd|eur|gbp|\$|€|£|trillion|billion|million|thousand|crore|lakh|bn|mn|cr|%|percent|bps)"
DATES = (
    r"(?i)\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b|\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?"
    r"|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2}(?:,\s*\d{4})?\b"
)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def without_dates(line: Column) -> Column:
    """The line with a sign in place of each date, so that no number within one is found."""
    return F.regexp_replace(line, DATES, "#")


def needs_ocr(scanned: Column, garbled: Column, vector: Column, text: Column) -> Column:
    """Pages without usable text of their own: scanned, garbled, or drawn as vectors with next to no text."""
    return scanned | garbled | (vector & (F.length(text) < 80))


def hints(candidates: DataFrame, limit: int = HINT_LIMIT) -> DataFrame:
    """The best hints of each batch: batch columns document_id and batch, rank, page, label, value, period, score.

    candidates(document_id, batch, page, seq, label, raw_value, period). Hints of one page, label and value are one, the
    first by seq. Named units count 4, words of the label up to 3, a period 1; ties go to the earlier.
    """
    label, value = F.trim(F.coalesce("label", F.lit(""))), F.trim(F.coalesce("raw_value", F.lit("")))
    kept = candidates.where((label != "") & (value != "")).withColumn("label", label).withColumn("raw_value", value)
    keyed = kept.withColumn("slug", F.regexp_replace(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "_"), "^_+|_+$", "")).withColumn("bare", F.regexp_replace(F.lower("raw_value"), r"\s+", ""))
    first = keyed.groupBy("document_id", "batch", "page", "slug", "bare").agg(F.min(F.struct("seq", "label", "raw_value", "period")).alias("h")).select("document_id", "batch", "page", "h.*")
    score = F.when(F.col("raw_value").rlike(UNIT), 4).otherwise(0) + F.least(F.lit(3), F.size(F.split("label", "_"))) + F.col("period").isNotNull().cast("int")
    best = Window.partitionBy("document_id", "batch").orderBy(F.desc("score"), "seq")
    ranked = first.withColumn("score", score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    cut = lambda c, n: F.substr(F.col(c), F.lit(1), F.lit(n))
    return ranked.select("document_id", "batch", "rank", "page", cut("label", 120).alias("label"), cut("raw_value", 80).alias("value"), cut("period", 40).alias("period"), "score")


#: How many characters of each field of a model's item are kept.
FIELD_LIMITS = {"subject": 240, "predicate": 240, "raw_value": 500, "value_type": 40, "unit": 80, "period": 120, "modality": 80, "scope": 240, "normalized_value": 500}
QUOTE_LIMIT, EXCERPT_LIMIT, EXCERPT_TOKENS = 500, 1000, 12
_SCALARS = r"^(STRING|BOOLEAN|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _said(value: Column) -> Column:
    """A scalar variant as text; true and false are written as models' lists write them."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(_kind(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def scalar(value: Column, limit: int) -> Column:
    """A variant as a field: scalars as text, lists as their scalars joined by `; `, anything else empty; single spaces, cut."""
    parts = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: _kind(x).rlike(_SCALARS))
    text = F.when(_kind(value).startswith("ARRAY"), F.array_join(F.transform(parts, _said), "; ")).when(_kind(value).rlike(_SCALARS), _said(value)).otherwise("")
    return F.substr(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(1), F.lit(limit))


def _page(value: Column) -> Column:
    """A page number of a variant: a number, cut to a whole one, or text of digits; of a list its first entry."""
    one = F.when(_kind(value).startswith("ARRAY"), F.try_variant_get(value, "$[0]", "variant")).otherwise(value)
    text = F.trim(F.try_variant_get(one, "$", "string"))
    kind = _kind(one)
    number = F.when(kind == "BOOLEAN", (F.lower(text) == "true").cast("int")).when(kind.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"), text.try_cast("double").cast("int"))
    return number.when((kind == "STRING") & text.rlike(r"^[+-]?\d{1,9}$"), text.try_cast("int"))


def _truthy(value: Column) -> Column:
    """Whether a variant holds anything: not null, empty, zero or false."""
    return value.isNotNull() & ~_kind(value).isin("VOID") & ~F.lower(F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("null"))).rlike(r'^(|false|-?0+(\.0*)?|\[\]|\{\}|null)$')


def model_items(items: DataFrame) -> DataFrame:
    """items(item_id, document_id, body) with the fields of body, a model's item as JSON: quote, page, requested_status and FIELD_LIMITS.

    Evidence is a text, with the page beside it, or an object of text and pdf_page, where the item's own page stands in for
    one that is missing; a page may be a list. Items whose body is no JSON object, or whose evidence is of another shape, are left
    out. Missing fields are null.
    """
    # each step is generated from an array of one row, so that later steps use its values and don't work them out anew
    once = lambda df, *made: df.select("item_id", "document_id", F.inline(F.array(F.struct(*made))))
    get = lambda c, path: F.try_variant_get(c, path, "variant")
    parsed = once(items.where("body is not null"), F.try_parse_json("body").alias("v"))
    shaped = once(parsed, get("v", "$.evidence").alias("e"), get("v", "$.pdf_page").alias("own_page"), get("v", "$.evidence.pdf_page").alias("inner"), get("v", "$.evidence.text").alias("inner_text"), F.try_variant_get("v", "$.requested_status", "string").alias("requested_status"), *(get("v", f"$.{c}").alias(c) for c in FIELD_LIMITS))
    kinds = once(shaped, F.regexp_extract(_kind(F.col("e")), "^[A-Z]+", 0).alias("shape"), "e", "own_page", "inner", "inner_text", "requested_status", *FIELD_LIMITS)
    used = kinds.where("shape in ('OBJECT', 'STRING')")
    nested = F.col("shape") == "OBJECT"
    fields = [F.when(~_kind(F.col(c)).isin("VOID"), scalar(F.col(c), n)).alias(c) for c, n in FIELD_LIMITS.items()]
    page = F.when(nested & _truthy(F.col("inner")), _page(F.col("inner"))).otherwise(_page(F.col("own_page")))
    quote = F.when(nested, scalar(F.col("inner_text"), QUOTE_LIMIT)).otherwise(scalar(F.col("e"), QUOTE_LIMIT))
    return once(used, quote.alias("quote"), page.alias("page"), "requested_status", *fields)


#: Characters of a bin in which spans and blocks meet.
BIN = 1_000


def evidence_boxes(spans: DataFrame, blocks: DataFrame, words: DataFrame) -> DataFrame:
    """(span_id, excerpt, printed_page, n_blocks, x0, top, x1, bottom, precision) for each of spans(span_id, page_id, start, end, text).

    The box is that around the blocks(page_id, block_id, start, end, x0, top, x1, bottom) which the span overlaps, by a join
    in bins of BIN characters; where there is none, that around the words(page_id, word, x0, top, x1, bottom) of the page that
    are among the first tokens of the excerpt. Without either there is no box. Blocks without a box are overlapped but add nothing.
    """
    excerpt = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    asked = spans.select("span_id", "page_id", "start", "end", excerpt.alias("whole"))
    bins = lambda a, b: F.explode(F.when(F.col(b) > F.col(a), F.sequence(F.floor(F.col(a) / BIN), F.floor((F.col(b) - 1) / BIN)))).alias("bin")
    sides = ("x0", "top", "x1", "bottom")
    a = asked.select("span_id", "page_id", F.col("start").alias("from"), F.col("end").alias("to"), bins("start", "end"))
    b = blocks.select("page_id", "block_id", "start", "end", *sides, bins("start", "end"))
    # two that overlap meet in each bin they share; the one where the later of them begins counts
    first = F.floor(F.greatest("from", "start") / BIN) == F.col("bin")
    met = a.join(b, ["page_id", "bin"]).where((F.col("start") < F.col("to")) & (F.col("from") < F.col("end")) & first)
    around = (F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    by_block = met.groupBy("span_id").agg(F.count("*").alias("n_blocks"), *around)
    tokens = F.slice(F.regexp_extract_all(F.lower("whole"), F.lit("([a-z0-9]+)")), 1, EXCERPT_TOKENS)
    named = asked.select("span_id", "page_id", F.explode(F.array_distinct(tokens)).alias("token"))
    by_word = named.join(words.select("page_id", F.lower("word").alias("token"), *sides), ["page_id", "token"]).groupBy("span_id").agg(*around)
    joined = asked.join(by_block, "span_id", "left").join(by_word.select("span_id", *(F.col(c).alias(f"w_{c}") for c in sides)), "span_id", "left")
    box = [F.when(F.col("x0").isNotNull(), F.col(c)).otherwise(F.col(f"w_{c}")).alias(c) for c in sides]
    kind = F.when(F.col("x0").isNotNull() | F.col("w_x0").isNotNull(), "word-region").otherwise("page-only").alias("precision")
    printed = F.nullif(F.regexp_extract("whole", r"(?i)(?:page\s+|\s)(\d{1,4})\s*$", 1), F.lit("")).alias("printed_page")
    return joined.select("span_id", F.substr("whole", F.lit(1), F.lit(EXCERPT_LIMIT)).alias("excerpt"), printed, F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), *box, kind)


def grounded_source(items: DataFrame, sections: DataFrame) -> DataFrame:
    """items(item_id, document_id, page, quote, ...) with found_page, found_start and found_end of the first section that holds the quote.

    Quotes are compared in lower case with single spaces. A null page looks in all sections of the document. The join is by
    document, so a quote meets its own document's sections only. Items without a source have nulls there.
    """
    asked = items.select("item_id", "document_id", F.col("page").alias("asked"), squeezed(F.coalesce("quote", F.lit(""))).alias("needle")).where("needle <> ''")
    held = sections.select("document_id", F.col("page").alias("found_page"), "section", squeezed(F.col("text")).alias("hay"))
    met = asked.join(held, "document_id").where(F.col("asked").isNull() | (F.col("asked") == F.col("found_page"))).where(F.contains("hay", F.col("needle")))
    place = F.struct("section", "found_page", F.expr("locate(needle, hay) - 1").alias("found_start"), F.length("needle").alias("size"))
    first = met.groupBy("item_id").agg(F.min(place).alias("p"))
    return items.join(first.select("item_id", "p.found_page", "p.found_start", (F.col("p.found_start") + F.col("p.size")).alias("found_end")), "item_id", "left")


def validated(items: DataFrame, sections: DataFrame) -> DataFrame:
    """Items that may become claims, with where their evidence stands.

    An item needs subject, predicate and value, an admissible quote that one of the document's sections holds, and the
    value's digits in the quote. items also has subject, predicate, raw_value and requested_status.
    """
    clean = lambda c, n: F.substr(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit(1), F.lit(n)).alias(c)
    tidy = items.select("item_id", "document_id", "page", clean("quote", 500), clean("subject", 240), clean("predicate", 240), clean("raw_value", 500), "requested_status")
    full = tidy.where("subject <> '' and predicate <> '' and raw_value <> ''").where(is_admissible(F.col("quote"), F.col("requested_status")))
    numbers = F.regexp_extract_all("raw_value", F.lit(r"(\d[\d,]*(?:\.\d+)?)"))
    held = full.where(F.forall(numbers, lambda x: F.contains(F.col("quote"), x)))
    return grounded_source(held, sections).where("found_page is not null")
