"""Relationships between claims of different documents about the same thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.modality import with_context
from attestry.functions.numeric import compare_numeric
from attestry.functions.periods import with_label

#: Claims of a lane that are compared exhaustively: the last ones by id.
LANE_LIMIT = 250
CANDIDATES = 12
#: About so many claims are a list at most where all claims of a lane are compared.
CHUNK = 512
# Fixed values.
NUMERIC_TYPES = ("money", "number", "percentage")
FORECASTS = ("forecast", "guidance", "management_guidance")
ESTIMATES = ("estimated", "first_estimate", "preliminary", "reported", "revised_estimate")


def laned(claims: DataFrame) -> DataFrame:
    """Claims with their lane: subject and predicate in lower case."""
    return claims.withColumns({"lane_subject": F.lower("subject"), "lane_predicate": F.lower("predicate")})


def named(claims: DataFrame) -> DataFrame:
    """Claims with canonical period and modality."""
    return with_context(with_label(claims, "period", "label"), "modality", "evidence_text", "context")


def resolved(claims: DataFrame) -> DataFrame:
    """Claims with canonical period and modality, and their lane.

    One that goes on to `lane_pairs` had better be `named` after `kept`: what makes a claim and what names it are long
    expressions, and in one generated method they pass the 8,000 bytes up to which the JVM compiles a method.
    """
    return laned(named(claims))


LANE = ["lane_subject", "lane_predicate"]
SIDE = ["id", "document_id", "value_num", "value_type", "precision", "label", "context"]


def kept(claims: DataFrame, limit: int = LANE_LIMIT, early: str | None = None) -> DataFrame:
    """The last claims of each lane by id, as many as the limit; claims without a lane are left out.

    With `early`, a boolean column, also the last of the early claims alone: in_all and in_early say which of the two a
    claim is one of.
    """
    laned = claims.where(" and ".join(f"{c} is not null" for c in LANE))
    last = Window.partitionBy(*LANE).orderBy(F.desc("id"))
    if early is None:
        return laned.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= limit).drop("rank")
    so_far = last.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = laned.withColumns({"_n": F.count("*").over(so_far), "_m": F.count_if(early).over(so_far)})
    inside = {"in_all": F.col("_n") <= limit, "in_early": F.coalesce(F.col(early), F.lit(False)) & (F.col("_m") <= limit)}
    return counted.withColumns(inside).drop("_n", "_m").where("in_all or in_early")


def lane_pairs(claims: DataFrame, limit: int | None = LANE_LIMIT, further: tuple[str, ...] = (), within: tuple[str, ...] = (), early: str | None = None) -> DataFrame:
    """All pairs a.id < b.id within a lane and of different documents: columns a_* and b_* of resolved claims, with further ones.

    The limit is applied first, so a frequent lane makes at most limit * (limit - 1) / 2 pairs: its claims are a list, of
    which each claim meets the ones after it. `within` names columns that both of a pair have the same (null is a value),
    so other pairs aren't formed. `early` as in `kept`; its two columns stand on both sides. Without a limit the claims are
    those that `kept` gave.
    """
    side = [*SIDE, *further, *(("in_all", "in_early") if early else ())]
    if limit is not None:
        wanted = list(dict.fromkeys([*LANE, *within, *SIDE, *further, *((early,) if early else ())]))
        claims = kept(claims.select(wanted), limit, early)
    lists = claims.groupBy(*LANE, *within).agg(F.sort_array(F.collect_list(F.struct(*side))).alias("all"))
    several = lists.where(F.size("all") > 1)
    first = several.select(*LANE, "all", F.posexplode("all").alias("at", "a")).where(F.col("at") + 1 < F.size("all"))
    both = first.select(*LANE, "a", F.explode(F.slice("all", F.col("at") + 2, F.size("all") - F.col("at") - 1)).alias("b"))
    pairs = both.where("a.id < b.id and a.document_id <> b.document_id")
    return pairs.select(*LANE, *(F.col(f"a.{c}").alias(f"a_{c}") for c in side), *(F.col(f"b.{c}").alias(f"b_{c}") for c in side))


def every_pair(claims: DataFrame, further: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """lane_pairs of all claims of a lane, in lists of bounded length.

    Claims of a lane and of `within` are one list if they are few. More are dealt into chunks, by their ids, of which every
    two meet in a list of their own, and these lists are dealt out to tasks.
    """
    side, group = [*SIDE, *further], [*LANE, *within]
    known = claims.where(" and ".join(f"{c} is not null" for c in (*LANE, "document_id"))).select(list(dict.fromkeys([*group, *side])))
    counted = known.withColumn("_chunks", F.ceil(F.count("*").over(Window.partitionBy(*group)) / CHUNK).cast("int"))
    few = counted.where("_chunks = 1").groupBy(*group).agg(F.collect_list(F.struct(*side, F.lit(0).alias("_own"))).alias("all"))
    dealt = counted.where("_chunks > 1").withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int"))
    each = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    cell = [*group, "_low", "_high"]
    placed = each.withColumns({"_low": F.least("_own", "_with"), "_high": F.greatest("_own", "_with")}).repartition(*cell)
    many = placed.groupBy(*cell).agg(F.collect_list(F.struct(*side, "_own")).alias("all"))
    lists = few.select(*LANE, F.lit(True).alias("one"), "all").unionByName(many.select(*LANE, (F.col("_low") == F.col("_high")).alias("one"), "all"))
    several = lists.where(F.size("all") > 1).withColumn("all", F.sort_array("all"))
    first = several.select(*LANE, "one", "all", F.posexplode("all").alias("at", "a")).where(F.col("at") + 1 < F.size("all"))
    both = first.select(*LANE, "one", "a", F.explode(F.slice("all", F.col("at") + 2, F.size("all") - F.col("at") - 1)).alias("b"))
    pairs = both.where("a.id < b.id and a.document_id <> b.document_id and (one or a._own <> b._own)")
    return pairs.select(*LANE, *(F.col(f"a.{c}").alias(f"a_{c}") for c in side), *(F.col(f"b.{c}").alias(f"b_{c}") for c in side))


def candidate_score(a: str = "a_", b: str = "b_") -> Column:
    """How alike two claims' contexts are: period 8 (3 if one is missing), modality 2, value 2, unit 1."""
    x, y = (lambda c: F.col(a + c)), (lambda c: F.col(b + c))
    period = F.when(x("label").eqNullSafe(y("label")) & x("label").isNotNull(), 8).when(x("label").isNull() | y("label").isNull(), 3).otherwise(0)
    return period + F.when(x("context").eqNullSafe(y("context")), 2).otherwise(0) + F.when(x("value_num").eqNullSafe(y("value_num")), 2).otherwise(0) + F.when(x("unit").eqNullSafe(y("unit")), 1).otherwise(0)


def incremental_candidates(claims: DataFrame, new_document: Column, limit: int = CANDIDATES) -> DataFrame:
    """For each claim of new documents, the `limit` best-scored claims of others: new_id, other_id, score, rank."""
    side = ["id", "document_id", "value_num", "unit", "label", "context", "created_on"]
    new = claims.where(new_document).select(*LANE, *(F.col(c).alias(f"a_{c}") for c in side))
    other = claims.where(~new_document).select(*LANE, *(F.col(c).alias(f"b_{c}") for c in side))
    scored = new.join(other, LANE).where("a_document_id <> b_document_id").withColumn("score", candidate_score())
    best = Window.partitionBy("a_id").orderBy(F.desc("score"), F.desc("b_created_on"), "b_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return ranked.select(F.col("a_id").alias("new_id"), F.col("b_id").alias("other_id"), "score", "rank")


def value_state(a: str = "a_", b: str = "b_") -> Column:
    """How the values of a pair compare: as compare_numeric where both are numeric."""
    x, y = (lambda c: F.col(a + c)), (lambda c: F.col(b + c))
    both_numeric = x("value_type").isin(*NUMERIC_TYPES) & y("value_type").isin(*NUMERIC_TYPES)
    percentage = (x("value_type") == "percentage") & (y("value_type") == "percentage")
    numeric = compare_numeric(x("value_num"), y("value_num"), x("precision"), y("precision"), percentage)
    return F.when(both_numeric, numeric).when(x("value_num") == y("value_num"), "equal").otherwise("UNKNOWN")


def compared(pairs: DataFrame, a: str = "a_", b: str = "b_") -> DataFrame:
    """pairs in one lane with type, value_state, period, modality and confidence; the order of the cases is the meaning.

    Each step is a column, so that it is worked out once a pair.
    """
    x, y = (lambda c: F.col(a + c)), (lambda c: F.col(b + c))
    same_period = x("label").eqNullSafe(y("label"))
    same_context = x("context").eqNullSafe(y("context"))
    forecast = lambda c: F.coalesce(c.isin(*FORECASTS), F.lit(False))
    one_forecast = forecast(x("context")) != forecast(y("context"))
    vintages = x("context").isin(*ESTIMATES) & y("context").isin(*ESTIMATES)
    agree = F.col("value_state").isin("equal", "rounding-compatible")
    kind = (
        F.when(~same_period, "UNRELATED")
        .when(agree, "CORROBORATES")
        .when(~same_context & one_forecast, "UNCERTAIN")
        .when(~same_context & F.coalesce(vintages, F.lit(False)), "RECONCILES")
        .when(~same_context, "UNCERTAIN")
        .otherwise("CONTRADICTS")
    )
    foreseen = F.coalesce(x("context") == "forecast", F.lit(False))
    confidence = (
        F.when(F.col("type") == "UNRELATED", F.lit(0.93))
        .when(F.col("type") == "CORROBORATES", F.lit(0.96))
        .when(F.col("type") == "RECONCILES", F.lit(0.90))
        .when(F.col("type") == "UNCERTAIN", F.when(one_forecast, F.lit(0.91)).otherwise(F.lit(0.72)))
        .otherwise(F.when(foreseen, F.lit(0.91)).otherwise(F.lit(0.84)))
    )
    period = F.when(same_period & x("label").isNotNull(), "MATCH").otherwise("DIFFERENT")
    modality = F.when(same_context, "MATCH").otherwise("DIFFERENT")
    steps = pairs.withColumn("value_state", value_state(a, b)).withColumn("type", kind)
    return steps.withColumns({"period": period, "modality": modality, "confidence": confidence})


def edges(pairs: DataFrame) -> DataFrame:
    """(edge_id, claim_a, claim_b, type, confidence) of pairs that are related, that is, of one period."""
    related = pairs.where(F.col("a_label").eqNullSafe(F.col("b_label")))
    identity = F.concat_ws("|", "a_id", "b_id", "type")
    edge_id = F.concat(F.lit("rel-"), F.substr(F.sha2(identity, 256), F.lit(1), F.lit(24)))
    return compared(related).select(edge_id.alias("edge_id"), F.col("a_id").alias("claim_a"), F.col("b_id").alias("claim_b"), "type", "confidence")


def lane_edges(claims: DataFrame, limit: int | None = LANE_LIMIT) -> DataFrame:
    """The edges of all pairs of the claims (`lane_pairs`), of which only those of one period are formed."""
    return edges(lane_pairs(claims, limit, within=("label",)))


def every_edge(claims: DataFrame) -> DataFrame:
    """lane_edges of all claims of a lane."""
    return edges(every_pair(claims, within=("label",)))
