"""From text to numeric candidates: sections, batches, values with offsets, labels and recall gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CHARS, MAX_PAGES, HINTS = 12_000, 3, 16
# What a value looks like and what measures it.
VALUE = r"((?:₹|Rs\.?|INR|USD|EUR|GBP|\$|€|£)?\s*\(?[-+]?\d[\d,]*(?:\.\d+)?\)?\s*(?:trillion|billion|million|thousand|crore|lakh|bn|mn|cr|k|%|per\s+cent|percent|bps)?)"
MEASURE = r"(?i)(?:₹|Rs\.?|INR|USD|EUR|GBP|\$|€|£|trillion|billion|million|thousand|crore|lakh|bn|mn|cr|%|per\s+cent|percent|bps)"
CUES = ("and", "are", "ended", "has", "have", "is", "reported", "shows", "stood", "was", "were", "with")
TRAILING = ("at", "by", "effective", "for", "in", "of", "on", "to")
MARK = "\x01"


def page_quality(text: Column, words: Column, area: Column) -> Column:
    """struct(flags, score, disposition) of a page."""
    stripped = F.trim(text)
    low, glyphs = F.length(stripped) < 80, text.rlike("[\\x{FFFD}\\x{0000}]")
    bare, sparse = words == 0, F.length(stripped) / F.greatest(area, F.lit(1.0)) < 0.00012
    flags = F.array_compact(F.array(F.when(low, "low-native-text"), F.when(glyphs, "suspicious-glyphs"), F.when(bare, "no-word-geometry"), F.when(sparse, "sparse-page")))
    strong, weak = low.cast("int") + bare.cast("int"), glyphs.cast("int") + sparse.cast("int")
    score = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.lit(0.98) - 0.22 * strong - 0.08 * weak))
    return F.struct(flags.alias("flags"), F.round(score, 4).alias("score"), F.when(low | bare, "vision-required").otherwise("native").alias("disposition"))


def sections(pages: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(document_id, page, section, start, text): slices of at most max_chars, blank ones left out, numbered per page."""
    count = F.ceil(F.length("text") / max_chars).cast("int")
    cut = pages.where(F.length("text") > 0).select("document_id", "page", F.explode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * max_chars)).alias("start"), "text")
    slices = cut.select("document_id", "page", "start", F.substr("text", F.col("start") + 1, F.lit(max_chars)).alias("text")).where("trim(text) <> ''")
    number = Window.partitionBy("document_id", "page").orderBy("start")
    return slices.withColumn("section", F.row_number().over(number) - 1)


def batches(cut: DataFrame, max_chars: int = MAX_CHARS, max_pages: int = MAX_PAGES) -> DataFrame:
    """(document_id, page, section, batch): sections dealt in order, a new batch where characters or pages would exceed."""
    rows = F.array_sort(F.collect_list(F.struct("page", "section", F.length("text").alias("chars"))))
    state = F.struct(F.lit(-1).alias("batch"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("pages"), F.array().cast("array<struct<page:int,section:int,batch:int>>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        new_page = ~F.array_contains(s["pages"], r["page"])
        full = (s["batch"] < 0) | (s["chars"] + r["chars"] > max_chars) | (new_page & (F.size(s["pages"]) >= max_pages))
        batch = F.when(full, s["batch"] + 1).otherwise(s["batch"])
        pages = F.when(full, F.array(r["page"])).when(new_page, F.concat(s["pages"], F.array(r["page"]))).otherwise(s["pages"])
        row = F.struct(r["page"].alias("page"), r["section"].alias("section"), batch.alias("batch"))
        return F.struct(batch.alias("batch"), F.when(full, r["chars"]).otherwise(s["chars"] + r["chars"]).alias("chars"), pages.alias("pages"), F.concat(s["out"], F.array(row)).alias("out"))

    typed = cut.select("document_id", F.col("page").cast("int").alias("page"), F.col("section").cast("int").alias("section"), "text")
    folded = typed.groupBy("document_id").agg(rows.alias("rows")).select("document_id", F.explode(F.aggregate("rows", state, step, lambda s: s["out"])).alias("r"))
    return folded.select("document_id", "r.page", "r.section", "r.batch")


def values(line: Column) -> Column:
    """array of struct(value, start) of the value-like runs in a line, by marking them and cutting at the marks."""
    parts = F.split(F.regexp_replace(line, f"(?i){VALUE}", f"{MARK}$1{MARK}"), MARK)
    found = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), lambda i: F.struct(F.get(parts, i).alias("value"), F.length(F.array_join(F.slice(parts, F.lit(1), i), "")).alias("start")))
    return F.filter(found, lambda v: v["value"].isNotNull() & (F.trim(v["value"]) != ""))


def is_useful(value: Column, line: Column) -> Column:
    """It has a measure, or is no year and stands in a line of words and digits."""
    digits = F.regexp_replace(value, r"\D", "")
    year = (F.length(digits) == 4) & digits.rlike("^(19|20)")
    words = F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))
    return value.rlike(MEASURE) | (~year & (words >= 3) & line.rlike(r"[A-Za-z].*\d|\d.*[A-Za-z]"))


def label(prefix: Column) -> Column:
    """The metric named before a value: the last clause's words after its last cue, as a slug of at most eight words."""
    clause = F.element_at(F.split(prefix, "[,;|]"), -1)
    words = F.regexp_extract_all(clause, F.lit("([A-Za-z][A-Za-z0-9&'/-]*)"))
    n = F.size(words)
    cue = F.array_max(F.transform(F.filter(F.arrays_zip(words.alias("w"), F.sequence(F.lit(1), F.greatest(n, F.lit(1))).alias("i")), lambda x: F.lower(x["w"]).isin(*CUES) & (x["i"] < n)), lambda x: x["i"]))
    after = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.slice(words, F.coalesce(cue, F.lit(0)) + 1, F.greatest(n, F.lit(1))))
    joined = F.regexp_replace(F.array_join(after, " "), rf"(?i)(?:^|\s+)(?:(?:{'|'.join(TRAILING)})(?:\s+|$))+$", "")
    kept = F.filter(F.split(joined, " "), lambda w: (w != "") & ~w.rlike(r"(?i)^(?:fy)?\d{2,4}$"))
    last = F.slice(F.reverse(kept), 1, 8)
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.array_join(F.reverse(last), "_")), "[-/]", "_"), "_+", "_")
    return F.when(F.exists(kept, lambda w: F.length(w) >= 3), F.nullif(F.regexp_replace(slug, "^_+|_+$", ""), F.lit("")))


def candidates(lines: DataFrame) -> DataFrame:
    """(document_id, page, line_no, raw_value, start, label) of useful values with a label, the first of each label, value and page."""
    each = lines.select("document_id", "page", "line_no", "line", F.explode(values(F.col("line"))).alias("v"))
    named = each.select("document_id", "page", "line_no", F.trim("v.value").alias("raw_value"), F.col("v.start").alias("start"), label(F.substr("line", F.lit(1), F.col("v.start"))).alias("label"), "line")
    good = named.where(F.col("label").isNotNull() & is_useful(F.col("raw_value"), F.col("line"))).drop("line")
    first = Window.partitionBy("document_id", "page", "label", "raw_value").orderBy("line_no", "start")
    return good.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
