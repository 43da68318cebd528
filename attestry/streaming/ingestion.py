"""Streams that write more than rows: claims with their edges and families, two sinks of screening, and runs that stall."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from attestry.functions.screening import is_admissible, security_flags
from attestry.operators import families as fam
from attestry.operators import relations as rel


def published(spark: SparkSession, folder: str, kind: str, schema: StructType | str, before: int | None = None) -> DataFrame:
    """Rows of one kind of the batches that were written to their end, with batch; only earlier ones than `before`, if given.

    A batch's number stands under published once all that it writes is there, so what a broken batch left isn't seen.
    """
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema))
    if before == 0:
        return spark.createDataFrame([], shape.add("batch", "long"))
    rows = spark.read.schema(StructType(list(shape)).add("batch", "long")).parquet(f"{folder}/{kind}")
    done = spark.read.schema("done long, batch long").parquet(f"{folder}/published").select("batch")
    rows = rows.where(F.col("batch") < before) if before is not None else rows
    return rows.join(F.broadcast(done), "batch", "left_semi")


def _written(df: DataFrame, folder: str, kind: str, number: int) -> DataFrame:
    """df as it was written for a batch, instead of what an earlier attempt wrote."""
    path = f"{folder}/{kind}/batch={number}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _publish(spark: SparkSession, folder: str, number: int) -> None:
    _written(spark.range(1).select(F.lit(1).cast("long").alias("done")), folder, "published", number)


def _run(stream: DataFrame, folder: str, take) -> None:
    stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()


_EDGES = "edge_id string, claim_a string, claim_b string, type string, confidence double"


class Claims:
    """Claims that come in by batches: each batch compares its claims with stored ones of their lanes and rewrites their families.

    A claim is known by its id: one that comes again, in its batch or a later one, is left out. A batch that is run again
    replaces what it wrote. Pairs with at least one new claim are compared among the last claims of a lane, as many as
    `relations.LANE_LIMIT`; families without a new claim stay as they are, as no new pair can have both ends in them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.shapes = spark, folder.rstrip("/"), {}

    def take(self, rows: DataFrame, number: int) -> None:
        """One batch of claims, for foreachBatch or by hand."""
        new = fam.with_family(rel.resolved(rows))
        self.shapes["claims"] = new.schema
        prior = published(self.spark, self.folder, "claims", new.schema, number)
        fresh = _written(new.where("id is not null").dropDuplicates(["id"]).join(prior.select("id"), "id", "left_anti").select(new.columns), self.folder, "claims", number)
        lanes = fresh.select(*rel.LANE).distinct()
        near = prior.join(lanes, rel.LANE, "left_semi").select(*new.columns, F.lit(False).alias("is_new")).unionByName(fresh.withColumn("is_new", F.lit(True)))
        edges = _written(rel.edges(rel.lane_pairs(near, further=("is_new",), within=("label",)).where("a_is_new or b_is_new")), self.folder, "edges", number)
        touched = fresh.select("fact_id").distinct()
        members = prior.select(new.columns).unionByName(fresh).join(touched, "fact_id", "left_semi")
        known = published(self.spark, self.folder, "edges", _EDGES, number).drop("batch").unionByName(edges)
        families = fam.families(members, fam.inner_edges(members, known))
        self.shapes["families"] = families.schema
        _written(families, self.folder, "families", number)
        _publish(self.spark, self.folder, number)

    def ingest(self, claims: DataFrame) -> None:
        """Takes all batches of a stream of claims that are there now."""
        _run(claims, self.folder, self.take)

    def edges(self) -> DataFrame:
        return published(self.spark, self.folder, "edges", _EDGES).drop("batch")

    def families(self) -> DataFrame:
        """The families as the last batch that touched each has left them."""
        rows = published(self.spark, self.folder, "families", self.shapes["families"])
        return rows.groupBy("fact_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), "batch").alias("f")).select("f.*")


def screened_sinks(texts: DataFrame, id_col: str, text_col: str, status_col: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) of a stream of texts: the id, the text and its flags, each text in one of the two sinks.

    A text is accepted where there is evidence, it isn't suspicious and asks for no status that only reviewers give. Both
    sinks are written by batch number before the batch counts, so an attempt that breaks off leaves no repeats and no half.
    """
    spark = texts.sparkSession
    columns = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), security_flags(F.col(text_col)).alias("flags"))

    def take(rows: DataFrame, number: int) -> None:
        good = F.coalesce(is_admissible(F.col(text_col), F.col(status_col)), F.lit(False))
        marked = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(security_flags(F.col(text_col)), F.array().cast("array<string>")).alias("flags"), good.alias("good"))
        for kind, wanted in (("accepted", F.col("good")), ("quarantined", ~F.col("good"))):
            _written(marked.where(wanted).drop("good"), folder, kind, number)
        _publish(spark, folder, number)

    _run(texts, folder, take)
    return tuple(published(spark, folder, kind, columns.schema).drop("batch") for kind in ("accepted", "quarantined"))


class _Liveness(StatefulProcessor):
    """Keeps a run's last sign of life and a timer an allowed silence after it; the timer reports the run."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_ms long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, n = self.last.get() if self.last.exists() else (-1, 0)
        newest = last
        for batch in rows:
            newest, n = max(newest, int(batch["ms"].max())), n + len(batch)
        if newest > last:
            # a timer fires once time has passed it, so it stands a millisecond before the silence is long enough
            if last >= 0:
                self.handle.deleteTimer(last + self.silence_ms - 1)
            self.handle.registerTimer(newest + self.silence_ms - 1)
        self.last.update((newest, n))
        yield pd.DataFrame({"run_id": [], "last_ms": [], "n": []})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, n = self.last.get()
        yield pd.DataFrame({"run_id": [key[0]], "last_ms": [last], "n": [n]})

    def close(self) -> None:
        pass


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stalled(events: DataFrame, run_col: str, time_col: str, silence_seconds: int = 3600, late: str = "0 seconds") -> DataFrame:
    """(run_id, last_ms, n) as a stream: a run is reported once time has passed its last event by the allowed silence.

    Time is that of the events (their watermark), so a later batch reports a run while the stream goes on; a run that comes
    to life again is reported again when it falls silent. Events without a time are left out. The state is a row a run; the
    session must keep state in RocksDB when the stream starts (STATE_STORE), as timers need it. Times are rounded to
    milliseconds, not cut, as SQL's epoch_ms does.
    """
    timed = events.where(F.col(time_col).isNotNull()).select(F.col(run_col).cast("long").alias("run_id"), F.floor((F.unix_micros(F.col(time_col)) + 500) / 1000).alias("ms"))
    beats = timed.select("run_id", F.timestamp_millis("ms").alias("at"), "ms").withWatermark("at", late)
    return beats.groupBy("run_id").transformWithStateInPandas(_Liveness(silence_seconds * 1000), "run_id long, last_ms long, n long", outputMode="append", timeMode="eventTime")


def reported(parts: list[DataFrame], folder: str, **options: Any) -> DataFrame:
    """What `stalled` reports while parts, frames of (run_id, at), are added to a streamed folder one after another."""
    spark, before = parts[0].sparkSession, parts[0].sparkSession.conf.get(STATE_STORE[0])
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/source")
        events = spark.readStream.schema(part.schema).parquet(f"{folder}/source")
        stream = stalled(events, "run_id", "at", **options)
        spark.conf.set(*STATE_STORE)
        try:
            running = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/rows").start()
            running.awaitTermination()
        finally:
            spark.conf.set(STATE_STORE[0], before)
    return spark.read.schema("run_id long, last_ms long, n long").parquet(f"{folder}/rows")


def new_folder(base: str, name: str) -> str:
    return f"{base}/{name}-{uuid.uuid4().hex}"
