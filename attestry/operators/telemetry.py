"""Runs and calls in numbers, costs and the budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def role_counts(calls: DataFrame, roles: list[str] | None = None) -> DataFrame:
    chosen = calls.where(F.col("role").isin(*roles)) if roles else calls
    return chosen.groupBy("role").agg(
        F.count("*").alias("calls"),
        F.sum("attempts").alias("attempts"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.sum("latency_ms").alias("latency_ms"),
    )


def run_profile(calls: DataFrame) -> DataFrame:
    """Calls, network calls and HTTP attempts by role and status, with totals by role and over all (null keys)."""
    network = ~F.col("cache_hit")
    return calls.rollup("role", "status").agg(F.count("*").alias("calls"), F.count_if(network).alias("network_calls"), F.sum(F.when(network, F.col("attempts")).otherwise(0)).alias("http_attempts"), F.sum("latency_ms").alias("latency_ms"))


def estimated_cost(chars: Column, price_in: float = 1.0, price_out: float = 1.0, max_output: int = 1200, attempts: int = 3) -> Column:
    """What a request may cost at most, with all its retries."""
    tokens = F.greatest(F.lit(1), F.floor(chars / 4))
    return F.round((tokens / 1_000_000 * price_in + F.lit(max_output) / 1_000_000 * price_out) * max(1, attempts), 6)


def admit(requests: DataFrame, limit: int) -> DataFrame:
    """(budget_key, request_id, amount, admitted, reserved): requests of a budget in order while they fit.

    A rejected request takes nothing, so the later ones depend on it: a fold over each budget's requests in order.
    """
    rows = F.array_sort(F.collect_list(F.struct("request_id", F.col("amount").cast("long").alias("amount"))))
    kind = "array<struct<request_id:bigint,amount:bigint,admitted:boolean,reserved:bigint>>"
    state = F.struct(F.lit(0).cast("long").alias("reserved"), F.array().cast(kind).alias("out"))

    def step(s: Column, r: Column) -> Column:
        fits = s["reserved"] + r["amount"] <= limit
        reserved = s["reserved"] + F.when(fits, r["amount"]).otherwise(0)
        row = F.struct(r["request_id"].alias("request_id"), r["amount"].alias("amount"), fits.alias("admitted"), reserved.alias("reserved"))
        return F.struct(reserved.alias("reserved"), F.concat(s["out"], F.array(row)).alias("out"))

    folded = requests.groupBy("budget_key").agg(rows.alias("rows")).select("budget_key", F.explode(F.aggregate("rows", state, step, lambda s: s["out"])).alias("r"))
    return folded.select("budget_key", "r.request_id", "r.amount", "r.admitted", "r.reserved")


def settle(requests: DataFrame, limit: int) -> DataFrame:
    """(budget_key, request_id, amount, outcome, cost): what becomes of each budget's requests in order.

    requests(budget_key, request_id, amount, actual, status). A request is rejected if it doesn't fit beside what is
    reserved and spent. One with an actual cost is settled as soon as it is admitted, once, and costs what is spendable at
    most: then it is budget_capped if it was complete. One without stays reserved. Each depends on those before it, so
    this is a fold over a budget's requests; a budget is one run's.
    """
    request = F.struct("request_id", F.col("amount").cast("long").alias("amount"), F.col("actual").cast("long").alias("actual"), "status")
    rows = F.array_sort(F.collect_list(request))
    kind = "array<struct<request_id:bigint,amount:bigint,outcome:string,cost:bigint>>"
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("reserved"), zero.alias("spent"), F.array().cast(kind).alias("out"))

    def step(s: Column, r: Column) -> Column:
        fits = s["reserved"] + s["spent"] + r["amount"] <= limit
        settled = fits & r["actual"].isNotNull()
        spendable = F.greatest(zero, F.lit(limit).cast("long") - s["spent"] - s["reserved"])
        cost = F.when(settled, F.least(F.greatest(zero, r["actual"]), spendable)).otherwise(zero)
        capped = settled & (r["actual"] > cost) & (r["status"] == "complete")
        outcome = F.when(~fits, "rejected").when(capped, "budget_capped").when(settled, r["status"]).otherwise("reserved")
        row = F.struct(r["request_id"].alias("request_id"), r["amount"].alias("amount"), outcome.alias("outcome"), cost.alias("cost"))
        reserved = s["reserved"] + F.when(fits & ~settled, r["amount"]).otherwise(zero)
        return F.struct(reserved.alias("reserved"), (s["spent"] + cost).alias("spent"), F.concat(s["out"], F.array(row)).alias("out"))

    folded = requests.groupBy("budget_key").agg(rows.alias("rows")).select("budget_key", F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("r"))
    return folded.select("budget_key", "r.request_id", "r.amount", "r.outcome", "r.cost")


def nearest_ranks(rows: DataFrame, key: str, value: str, fraction: float) -> DataFrame:
    """(key, rank value) of each key: its sorted values' element at round((n - 1) * fraction), half to even.

    Values are counted first, so a key has as many rows as different values, whatever its rows.
    """
    counted = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("own"), F.col(value).alias("x")).groupBy("own", "x").agg(F.count("*").alias("k"))
    running = Window.partitionBy("own").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("upto", F.sum("k").over(running)).withColumn("n", F.sum("k").over(Window.partitionBy("own")))
    return placed.where(F.col("upto") > F.bround((F.col("n") - 1) * fraction)).groupBy(F.col("own").alias(key)).agg(F.min("x").alias(value))
