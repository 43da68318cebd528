"""Views that turn the star schema and the text tables into claims, lines, names, telemetry and gate requests.

Each has a Spark form here and a DuckDB form in `attestry.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.sources.tables import table


def text2(column: str) -> Column:
    """A number with two decimals as text."""
    return F.col(column).cast("decimal(18,2)").cast("string")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as claims: each supplier is a document that states a part's discount rate in a fiscal year; every third is scanned."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus", "l_shipdate")
    identity = F.concat_ws("|", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), text2("l_quantity"), text2("l_extendedprice"), F.col("l_shipdate").cast("date").cast("string"))
    year = F.year("l_shipdate") + 20
    raw = F.concat((F.col("l_discount").cast("decimal(4,2)") * 100).cast("int").cast("string"), F.lit("%"))
    period = (
        F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("FY"), year.cast("string")))
        .when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("FY"), F.substr(year.cast("string"), F.lit(3), F.lit(2))))
        .otherwise(F.concat((year - 1).cast("string"), F.lit("-"), F.substr(year.cast("string"), F.lit(3), F.lit(2))))
    )
    subject = F.concat(F.lit("Part#"), F.col("l_partkey").cast("string"))
    return li.select(
        F.concat(F.lit("claim-"), F.substr(F.sha2(identity, 256), F.lit(1), F.lit(24))).alias("id"),
        F.lit("w0").alias("workspace_id"),
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("document_id"),
        subject.alias("subject"),
        F.lit("discount_rate").alias("predicate"),
        raw.alias("raw_value"),
        F.col("l_discount").cast("decimal(24,8)").alias("value_num"),
        F.lit("percentage").alias("value_type"),
        F.lit("%").alias("unit"),
        F.lit(0).alias("precision"),
        period.alias("period"),
        F.when(F.col("l_linestatus") == "O", "projected").otherwise("actual").alias("modality"),
        F.lit(None).cast("string").alias("scope"),
        F.col("l_shipdate").cast("date").alias("created_on"),
        F.col("l_linenumber").cast("int").alias("pdf_page"),
        F.concat(subject, F.lit(" discount rate was "), raw).alias("evidence_text"),
        (F.col("l_suppkey") % 3 == 1).alias("visual"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of text with metrics: (o_orderkey, document_id, line)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    scale = F.element_at(F.array(*(F.lit(x) for x in (" million", " crore", "", " bn"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    line = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" reported total price of $"), text2("o_totalprice"), scale, F.lit(" in FY"), (F.year("o_orderdate") + 20).cast("string"), F.lit("."))
    return orders.select("o_orderkey", F.col("o_custkey").alias("document_id"), line.alias("line"))


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under varying names: (key, name)."""
    suffix = F.element_at(F.array(*(F.lit(x) for x in (" Limited", " Ltd", " Holdings Limited", ""))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.concat(F.lit("Supplier#"), F.col("s_suppkey").cast("string"), suffix).alias("name"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of runs."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").cast("long").alias("call_id"),
        F.col("user_id").cast("long").alias("run_id"),
        F.col("event_type").alias("role"),
        F.when(F.col("event_type") == "error", "failed").otherwise("complete").alias("status"),
        F.col("value").cast("int").cast("long").alias("latency_ms"),
        (F.col("event_id") % 3 + 1).cast("long").alias("attempts"),
        (F.col("event_id") % 5 == 0).alias("cache_hit"),
        F.get_json_object("props", "$.k").alias("request_chars"),
        F.col("ts").alias("ts"),
    )


def gate_requests(claims_df: DataFrame) -> DataFrame:
    """(query_id, subject, predicate, period, policy, known_at): one per part and fiscal year, every 7th part without a year."""
    from attestry.functions.periods import with_label

    keyed = with_label(claims_df.withColumn("part", F.substr("subject", F.lit(6)).cast("long")), "period", "label")
    label = F.when(F.col("part") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("label"))
    asked = keyed.select("part", "subject", "predicate", label.alias("period")).distinct()
    policy = F.when(F.col("part") % 5 == 0, "human_preference").otherwise("strict")
    known = F.when(F.col("part") % 2 == 0, F.lit(None).cast("int")).otherwise(F.lit(1))
    real = asked.select(F.concat_ws("|", "subject", F.coalesce("period", F.lit("-"))).alias("query_id"), "subject", "predicate", "period", policy.alias("policy"), known.alias("known_at"))
    unknown = claims_df.sparkSession.range(10).select(F.concat(F.lit("Unknown#"), F.col("id").cast("string"), F.lit("|-")).alias("query_id"), F.concat(F.lit("Unknown#"), F.col("id").cast("string")).alias("subject"), F.lit("discount_rate").alias("predicate"), F.lit(None).cast("string").alias("period"), F.lit("strict").alias("policy"), F.lit(None).cast("int").alias("known_at"))
    return real.unionByName(unknown)
