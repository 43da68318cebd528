"""The trust gate: may a consumer use a value?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = ["period", "modality", "scope", "value_type", "unit"]


_OVER = ("status", "value_num", "raw_value", "n_evidence")


def _matched(facts: DataFrame, versions: DataFrame, requests: DataFrame, how: str) -> DataFrame:
    """Requests with the facts that match them, and seen: whether a fact is there at the request's revision.

    A fact has its versions as a list, so that requests meet facts once, by subject and predicate, and the state known at a
    revision is chosen within the row.
    """
    asked = requests.select("query_id", F.lower("subject").alias("s"), F.lower("predicate").alias("p"), F.col("period").alias("asked"), "policy", "known_at")
    states = versions.groupBy("fact_id").agg(F.collect_list(F.struct(F.col("knowledge_revision").alias("k"), F.col("revision").alias("r"), "version_id", *_OVER)).alias("states"))
    live = facts.where("active").join(states, "fact_id", "left").withColumns({"own_s": F.lower("subject"), "own_p": F.lower("predicate")}).drop("subject", "predicate")
    met = asked.join(live, F.expr("s = own_s and p = own_p and (asked is null or asked = period)"), how)
    current = F.col("known_at").isNull()
    known = F.when(~current, F.array_max(F.filter("states", lambda v: v["k"] <= F.col("known_at"))))
    newest = F.when(current, F.array_max(F.transform("states", lambda v: F.struct(v["r"].alias("r"), v["version_id"].alias("version_id")))))
    rows = met.withColumns({"_known": known, "_newest": newest})
    over = {c: F.when(current, F.col(c)).otherwise(F.col(f"_known.{c}")) for c in _OVER}
    shown = {"version_id": F.coalesce("_newest.version_id", "_known.version_id"), "revision": F.when(current, F.col("revision")).otherwise(F.col("_known.r"))}
    return rows.withColumns({**shown, **over, "seen": F.col("fact_id").isNotNull() & (current | F.col("_known").isNotNull())})


def known_at(facts: DataFrame, versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Facts that match each request, in the state known at its revision (all facts' current state where that is null).

    Subject and predicate match in any case, a null period matches every period. A fact without a version by that
    revision isn't there yet. A query_id names one request.
    """
    return _matched(facts, versions, requests, "inner").where("seen").select("query_id", "fact_id", "policy", "known_at", *CONTEXT, "updated_on", "visual_only", "version_id", "revision", *_OVER)


def gate(requests: DataFrame, facts: DataFrame, versions: DataFrame, reviews: DataFrame) -> DataFrame:
    """One decision per request: query_id, decision, safe_to_use, reasons, fact_id, value_num, n_candidates, n_evidence.

    reviews(review_id, fact_id, action, status, stale, based_on_revision, created_on). The cases are tried in order. What
    is known of a fact, its reviews too, is joined by fact first; requests then meet facts once.
    """
    usable = "action in ('prefer', 'select') and status = 'active' and not stale and based_on_revision = now"
    said = reviews.join(facts.select("fact_id", F.col("revision").alias("now")), "fact_id").groupBy("fact_id").agg(
        F.bool_or(F.coalesce(F.expr("stale or status = 'stale'"), F.lit(False))).alias("has_stale"),
        F.max(F.when(F.expr(usable), F.struct("created_on", "review_id"))).alias("review"),
    )
    rows = _matched(facts.join(said, "fact_id", "left"), versions, requests, "left")
    seen = lambda column: F.when(F.col("seen"), column)
    # of what is counted by its different values, only whether there are several matters
    period, context, value = F.coalesce("period", F.lit("\x00")), F.struct(*(F.coalesce(c, F.lit("\x00")).alias(c) for c in CONTEXT)), F.struct("value_num")
    differ = lambda column: ~F.min(seen(column)).eqNullSafe(F.max(seen(column)))
    every = rows.groupBy("s", "p", "query_id", "asked", "policy").agg(
        F.when(F.count_if("seen") > 0, F.count_if("seen")).alias("n"),
        differ(period).alias("several_periods"),
        differ(context).alias("several_contexts"),
        differ(value).alias("several_values"),
        F.bool_and(seen(F.col("visual_only"))).alias("all_visual"),
        F.bool_and(seen(F.col("status") == "CORROBORATED")).alias("all_corroborated"),
        F.bool_and(seen(F.col("status").isin("SUPPORTED", "CORROBORATED"))).alias("all_good"),
        F.bool_or(seen(F.col("status").isin("CONTESTED", "UNRESOLVED"))).alias("any_bad"),
        F.bool_or(seen(F.col("status") == "UNRESOLVED")).alias("any_unresolved"),
        F.bool_or(seen(F.coalesce("has_stale", F.lit(False)))).alias("any_stale"),
        F.max(seen(F.struct("updated_on", "fact_id", "status", "value_num", "n_evidence"))).alias("top"),
        F.sum(seen(F.col("n_evidence"))).alias("all_evidence"),
        F.max(seen(F.struct("review.created_on", "review.review_id", "fact_id", "value_num"))).alias("picked"),
        F.bool_or(F.col("fact_id").isNotNull()).alias("matched"),
    )
    every = every.select("*", F.col("top.fact_id").alias("first_fact"), F.col("top.status").alias("first_status"), F.col("top.value_num").alias("first_value"), F.col("top.n_evidence").alias("first_evidence"))
    several = (F.col("n") > 1) & ~F.col("several_contexts") & F.col("all_good") & (~F.col("several_values") | F.col("all_corroborated"))
    troubled = F.col("any_bad") | F.col("several_values")
    human = troubled & (F.col("policy") == "human_preference") & F.col("picked.review_id").isNotNull()
    none = F.col("n").isNull()
    needs_period = F.col("asked").isNull() & F.col("several_periods")
    decision = F.when(none, "not_found").when(needs_period, "needs_context").when(F.col("all_visual"), "needs_review").when(several | human, "allow").when(troubled, "block").when(F.col("first_evidence") == 0, "needs_review").otherwise("allow")
    blocked = F.array_compact(F.array(F.lit("CONTESTED_OR_MULTIPLE"), F.when(F.col("any_unresolved"), "UNRESOLVED_CONTEXT"), F.when(F.col("any_stale"), "STALE_REVIEW")))
    good = F.array_compact(F.array(F.lit("GROUNDED"), F.when(F.when(several, F.col("all_corroborated")).otherwise(F.col("first_status") == "CORROBORATED"), "CORROBORATED")))
    reasons = (
        F.when(none & ~F.col("matched"), F.array(F.lit("NO_MATCH")))
        .when(none, F.array(F.lit("NO_MATCH_AT_REVISION")))
        .when(needs_period, F.array(F.lit("PERIOD_REQUIRED")))
        .when(F.col("all_visual"), F.array(F.lit("VISUAL_EVIDENCE_REQUIRES_REVIEW")))
        .when(several, good)
        .when(human, F.array(F.lit("GROUNDED"), F.lit("HUMAN_PREFERENCE")))
        .when(troubled, blocked)
        .when(F.col("first_evidence") == 0, F.array(F.lit("NO_EVIDENCE")))
        .otherwise(good)
    )
    safe = decision == "allow"
    picked = human & ~several
    return every.select(
        "query_id",
        decision.alias("decision"),
        safe.alias("safe_to_use"),
        F.array_join(reasons, ",").alias("reasons"),
        F.when(safe, F.when(picked, F.col("picked.fact_id")).otherwise(F.col("first_fact"))).alias("fact_id"),
        F.when(safe, F.when(picked, F.col("picked.value_num")).otherwise(F.col("first_value"))).alias("value_num"),
        F.coalesce("n", F.lit(0)).alias("n_candidates"),
        F.when(safe, F.when(several, F.col("all_evidence")).otherwise(F.col("first_evidence"))).alias("n_evidence"),
    )
