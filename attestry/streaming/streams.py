"""Streams of events and texts. Each query runs until its input is used up and returns the final state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.screening import security_flags
from attestry.sources.tables import table


def replay(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream with the table's schema."""
    schema = table(spark, sf_dir, name).schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else rows


def shared_folder(spark: SparkSession) -> str:
    """Where streams keep their state and results: the session's spark.checkpoint.dir, else a folder of the warehouse."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_streams").rstrip("/")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream yields from what is there now, written as Parquet.

    In append mode the file sink writes each row once, by its log; in complete mode each batch replaces the result
    of the one before. State and progress are kept beside the result, so a stream that is broken off goes on there.
    """
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        running = writer.format("parquet").option("path", f"{folder}/rows").start()
    else:
        running = writer.outputMode(mode).foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def ingested(texts: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """Texts that weren't there before, each once: (hash, id, further columns), the smallest id of a batch.

    A batch writes what neither an earlier batch nor itself has written, to a folder of its own number, so a batch that is
    run again replaces its own rows.
    """
    spark = texts.sparkSession
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    schema = f"hash string, id long, {', '.join(f'{k} string' for k in keep)}, batch long"

    def take(rows: DataFrame, number: int) -> None:
        hashed = rows.select(F.sha2(text_col, 256).alias("hash"), F.col(id_col).cast("long").alias("id"), *keep)
        first = hashed.groupBy("hash").agg(F.min_by(F.struct("id", *keep), "id").alias("r")).select("hash", "r.*")
        if number:
            before = spark.read.schema(schema).parquet(f"{folder}/rows").where(F.col("batch") < number).select("hash")
            first = first.join(before, "hash", "left_anti")
        first.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    running = texts.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(take).start()
    running.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def published(turns: DataFrame) -> DataFrame:
    """Turns of conversations that readers may see: batches are written as provisional and published by a revision each.

    A reader joins the rows with the published revisions, so rows of a batch that broke off are never seen.
    """
    spark = turns.sparkSession
    folder = f"{shared_folder(spark)}/publish-{uuid.uuid4().hex}"
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in turns.schema)}, revision long"

    def take(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/revision={number}")
        spark.range(1).select(F.lit(number).cast("long").alias("revision")).write.mode("overwrite").parquet(f"{folder}/published/{number}")

    running = turns.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(take).start()
    running.awaitTermination()
    revisions = spark.read.schema("revision long").option("recursiveFileLookup", "true").parquet(f"{folder}/published")
    return spark.read.schema(schema).parquet(f"{folder}/rows").join(F.broadcast(revisions), "revision")


def throughput(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values in each window and of each type."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return by.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("started"), "event_type", "n", "total")


def screen(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts with their flags, as they come in."""
    return texts.select(id_col, F.size(security_flags(F.col(text_col))).alias("n_flags"))
