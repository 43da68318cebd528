"""Exact duplicates by distributed MSD radix partitioning: texts are told apart by their successive bytes.

A digit of the radix is a run of bytes: 64 at first, eight times as many each round. A round splits each group by its
texts' next digit. Texts that are alone in their group are done, and so are groups whose texts have ended; only the others
are written, without the bytes read so far, and go to the next round. Groups are counted with partial aggregation, so a
digit that many rows share is one row of each task, and rows learn their group by a join in which hot keys are broadcast:
no task holds a group. Equality is that of the bytes themselves; the digest is only a column of the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.base import HOT_ROWS, shared_folder, unused

FIRST_BYTES, GROWTH = 64, 8
#: Digits don't grow beyond this, unless so few texts are left that their digits hold ROUND_BYTES together.
DIGIT_BYTES, ROUND_BYTES = 64 << 10, 1 << 30
#: Digits of groups are broadcast if they hold so many bytes together; of more, only those of hot groups, with the same bound.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is the empty text. Single spaces needn't be replaced."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _grouped(rows: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """rows with the columns of their group of groups(grp, digit, n, ...), null where it isn't there."""
    key, size = ["grp", "digit"], groups.agg(F.count("*"), F.coalesce(F.sum(F.length("digit")), F.lit(0))).first()
    if size[0] * ROW_BYTES + size[1] <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), key, "left")
    limit = max(HOT_ROWS, rows.count() * (width + ROW_BYTES) // BROADCAST_BYTES)
    hot = F.broadcast(groups.where(F.col("n") > limit))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col("n") <= limit), key, "left")
    return rows.join(hot, key).unionByName(cold)


def equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row: keep_id is the smallest id of the rows with an equal text.

    Texts are equal when they are after white space is normalised; a null text is empty, and all empty texts are equal.
    Null ids come after all others: keep_id is null only where all ids of a group are. An id names a document, so rows
    repeated with the id that stays are all marked kept (`drop_equal` leaves one of them). Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    spark, folder = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/equal-{uuid.uuid4().hex}"
    text = normalised(F.col(text_col)).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("grp"), text.alias("rest"))
    rows = rows.select("id", "grp", F.sha2("rest", 256).alias("text_sha256"), "rest")
    width, turn, done = FIRST_BYTES, 0, None
    while True:
        keyed = rows.withColumn("digit", F.substring("rest", 1, width))
        groups = keyed.groupBy("grp", "digit").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
        # names must not change once rows have them, so they are written
        groups = groups.select("*", (F.length("digit") < width).alias("ended"), F.monotonically_increasing_id().alias("name"))
        groups.write.parquet(f"{folder}/groups-{turn}")
        groups = spark.read.schema(groups.schema).parquet(f"{folder}/groups-{turn}")
        split = _grouped(keyed, groups, width)
        split = split.select(
            "id", "text_sha256", "n", "least", F.col("name").alias("grp"),
            F.when(~F.col("ended"), F.expr(f"substring(rest, {width + 1})")).alias("rest"), (~F.coalesce("ended", F.lit(True))).alias("open"),
        )
        split.write.partitionBy("open").parquet(f"{folder}/rows-{turn}")
        split = spark.read.schema(split.schema).parquet(f"{folder}/rows-{turn}")
        closed = split.where("not open").select("id", "n", "least", "text_sha256")
        done = closed if done is None else done.unionByName(closed)
        rows = split.where("open").select("id", "grp", "text_sha256", "rest")
        left = rows.count()
        if not left:
            break
        width, turn = min(width * GROWTH, max(DIGIT_BYTES, ROUND_BYTES // left)), turn + 1
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("least"))
    return done.select("id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), "text_sha256")


def drop_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each text, with its columns (of any names): that with the smallest id, one of repeated rows."""
    found = equal_texts(docs, id_col, text_col).where("kept")
    names = [unused(docs, name) for name in ("kept_id", "kept_text")]
    kept = found.select("id", "text_sha256").toDF(*names)
    marked = docs.withColumn(unused(docs, "own_text"), F.sha2(normalised(F.col(text_col)), 256))
    own = marked.columns[-1]
    same = F.col(id_col).eqNullSafe(F.col(names[0])) & (F.col(own) == F.col(names[1]))
    once = marked.join(kept.distinct(), same, "left_semi")
    return once.dropDuplicates([id_col, own]).drop(own)
