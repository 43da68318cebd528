"""Files as sources, with what is wrong about them as rows, and facts as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestry.functions.numeric import decimal_text

MEGABYTE = 1024 * 1024
# The magic bytes of a payload and the columns of an export; these two are written as they are.
MAGIC, SUFFIX = b"%PDF-", ".pdf"
EXPORTED = ("id", "subject", "predicate", "normalized_value", "display_value", "value_type", "unit", "period", "modality", "scope", "status", "reason", "revision")
NOT_NEUTRALIZED = ("normalized_value", "revision")
ORDER = ("subject", "predicate", "period", "id")


def _empty_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Paths of files without content, which Spark's sources pass over; asked for by name only if there can be any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store, found = path.getFileSystem(spark._jsc.hadoopConfiguration()), []
    if store.getContentSummary(path).getFileCount() > spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).count():
        each = store.listFiles(path, True)
        while each.hasNext():
            status = each.next()
            if not status.getLen() and status.getPath().getName()[0] not in "._":
                found.append((status.getPath().toString(), 0))
    return found


def payloads(spark: SparkSession, folder: str, max_mb: float) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files below a folder: path, document_id, sha256, length; and path, length, code, reason.

    A file must have the suffix, at most max_mb MB and the magic bytes, looked at in this order. Only files within the size are
    opened: the limit is pushed to the source, and the others are read without their content. Files without content have no
    magic bytes. Files whose names begin with a dot or _ are nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    limit, named = int(max_mb * MEGABYTE), F.lower("path").endswith(SUFFIX)
    small, large = files.where(F.col("length") <= limit), files.where(F.col("length") > limit).select("path", "length")
    opened = small.select("path", "length", named.alias("named"), (F.substring("content", 1, len(MAGIC)) == F.lit(MAGIC)).alias("real"), F.sha2("content", 256).alias("sha256"))
    good = opened.where("named and real").select("path", F.concat(F.lit("doc-"), F.substr("sha256", F.lit(1), F.lit(20))).alias("document_id"), "sha256", "length")
    reject = lambda df, code, reason: df.select("path", "length", F.lit(code).alias("code"), F.lit(reason).alias("reason"))
    bad = reject(opened.where("not named"), 400, "suffix").unionByName(reject(opened.where("named and not real"), 400, "magic"))
    empty = spark.createDataFrame(_empty_files(spark, folder), "path string, length long")
    bad = bad.unionByName(reject(empty.where(named), 400, "magic")).unionByName(reject(empty.where(~named), 400, "suffix"))
    return good, bad.unionByName(reject(large.where(named), 413, "size")).unionByName(reject(large.where(~named), 400, "suffix"))


def json_rows(spark: SparkSession, path: str, schema: str, required: tuple[str, ...], check: Column | None = None, wrong: str = "wrong record") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of lines of JSON: rows of the schema, and (line, reason) of what isn't one.

    A line is rejected as malformed, for the first required field that is missing or empty, or where `check` isn't true. Blank
    lines are nothing. A source without any line is an error, as is a path that isn't there.
    """
    shape = StructType.fromDDL(schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    if lines.isEmpty():
        raise ValueError(f"no rows in {path}")
    held = "corrupt_record"
    while held in shape.names:
        held += "_"
    parsed = lines.select("value", F.from_json("value", StructType(list(shape)).add(held, "string"), {"columnNameOfCorruptRecord": held}).alias("r"))
    reason = F.when(F.col(f"r.{held}").isNotNull() | F.col("r").isNull(), "malformed")
    for name in required:
        reason = reason.when(F.coalesce(F.col(f"r.`{name}`").cast("string"), F.lit("")) == "", f"missing {name}")
    reason = reason.when(~F.coalesce(check, F.lit(False)), wrong) if check is not None else reason
    marked = parsed.withColumn("reason", reason)
    return marked.where("reason is null").select(*(F.col(f"r.`{n}`") for n in shape.names)), marked.where("reason is not null").select(F.col("value").alias("line"), "reason")


GOLD = "item_id string, kind string, annotation struct<synthetic: boolean>, text string"


def gold_records(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): synthetic claims. Unless strict is off, any other record is an error, as it spoils an evaluation."""
    check = (F.col("r.kind") == "claim") & F.col("r.annotation.synthetic")
    rows, rejects = json_rows(spark, path, GOLD, ("kind",), check, "not a synthetic claim")
    if strict and (first := rejects.first()):
        raise ValueError(f"{first.reason}: {first.line[:200]}")
    return rows, rejects


def export_rows(facts: DataFrame) -> DataFrame:
    """Active facts as export rows, with the columns of EXPORTED; values are decimal text without needless zeros."""
    named = {"id": F.col("fact_id"), "normalized_value": decimal_text(F.col("value_num")), "display_value": F.col("raw_value")}
    active = facts.where("active") if "active" in facts.columns else facts
    return active.select(*(named.get(c, F.col(c)).alias(c) for c in EXPORTED))


def neutralized(rows: DataFrame) -> DataFrame:
    """The rows with a quote before each text that a spreadsheet would read as a formula."""
    cells = {c: F.when(F.col(c).rlike("^[=+@]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)) for c, kind in rows.dtypes if kind == "string" and c not in NOT_NEUTRALIZED}
    return rows.withColumns(cells)


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows in one order over all files: ranges by subject, predicate, period and id, sorted inside."""
    by = [F.asc_nulls_first(c) for c in ORDER]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def export_json(rows: DataFrame, folder: str) -> None:
    _ordered(rows).write.option("ignoreNullFields", "false").json(folder)


def export_csv(rows: DataFrame, folder: str) -> None:
    """CSV with a header in each file; a quote inside a cell is doubled, and nulls and empty texts are both empty cells."""
    _ordered(neutralized(rows)).write.option("header", "true").option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", "true").csv(folder)
