"""Semantic review of pairs of claims: which need it, how many get it, which answers count, and what happens without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators import relations as rel

REVIEW_LIMIT = 24
# Markers in evidence, and what a reviewer may answer.
CONTEXT_MARKERS = ("advance estimate", "assumption", "baseline", "forecast", "guidance", "preliminary", "projected", "revised", "scenario", "vintage")
STATUS_MARKERS = ("appointed", "effective from", "left the board", "no longer", "resigned", "retired", "terminated", "with effect from")
ANSWERS = ("CORROBORATES", "CONTRADICTS", "RECONCILES", "SUPERSEDES", "UNCERTAIN")
_ITEM = "struct<text: string, pdf_page: int, kind: string, precision: string, requires_review: boolean>"


def evidence_items(value: Column) -> Column:
    """A claim's evidence as an array of items; one object is one item, invalid JSON none."""
    bare = F.trim(F.coalesce(value, F.lit("[]")))
    one = F.from_json(bare, _ITEM)
    many = F.from_json(bare, f"array<{_ITEM}>")
    known = lambda x: x.isNotNull() & (x["text"].isNotNull() | x["kind"].isNotNull())
    return F.filter(F.when(F.startswith(bare, F.lit("[")), F.coalesce(many, F.array())).otherwise(F.array(one)), known)


def visual_only(value: Column) -> Column:
    """There is evidence, and all of it is of pictures."""
    found = evidence_items(value)
    picture = lambda x: (x["kind"] == "visual-region") | (x["precision"] == "visual-region") | F.coalesce(x["requires_review"], F.lit(False))
    return (F.size(found) > 0) & F.forall(found, lambda x: F.coalesce(picture(x), F.lit(False)))


def marked(evidence: Column) -> Column:
    """Whether evidence speaks of another context or status."""
    return evidence.rlike("(?i)" + "|".join((*CONTEXT_MARKERS, *STATUS_MARKERS)))


def needs_review(kind: Column, semantic: Column, is_marked: Column) -> Column:
    """Contradictions of semantic values, and unrelated pairs of which one's evidence is `marked`."""
    return ((kind == "CONTRADICTS") & semantic) | ((kind == "UNRELATED") & is_marked)


def pairs_to_review(pairs: DataFrame) -> DataFrame:
    """Those of pairs (rel.lane_pairs, with semantic and marked on both sides) that need review.

    What the period and the marks rule out isn't compared, and the type is worked out once a pair: of those of one period a
    semantic value is left, which a contradiction makes need review, of the others marked evidence, and they are unrelated.
    """
    one_period = F.col("a_label").eqNullSafe(F.col("b_label"))
    open_pairs = pairs.where((one_period & (F.col("a_semantic") | F.col("b_semantic"))) | (~one_period & (F.col("a_marked") | F.col("b_marked"))))
    return rel.compared(open_pairs).where(F.col("type").isin("CONTRADICTS", "UNRELATED"))


def reviewed(pairs: DataFrame, limit: int = REVIEW_LIMIT) -> DataFrame:
    """The first `limit` of pairs(a_id, b_id, ...) that need review, in the order of their ids, with turn from 1 on."""
    first = pairs.orderBy("a_id", "b_id").limit(limit)
    rows = first.select(F.array_sort(F.collect_list(F.struct("a_id", "b_id"))).alias("all")) if limit <= 10_000 else None
    if rows is None:
        raise ValueError("at most 10,000 reviews a run")
    return rows.select(F.posexplode("all").alias("at", "p")).select("p.a_id", "p.b_id", (F.col("at") + 1).alias("turn"))


def valid_answers(answers: DataFrame) -> DataFrame:
    """(a_id, b_id, type, confidence, reason) of answers that count: a known type, and exactly both claims as evidence.

    answers(a_id, b_id, type, evidence_ids, confidence, reason). Confidence is brought into 0 to 1 (0.5 where it is no number).
    """
    both = F.array_sort(F.array_distinct("evidence_ids")) == F.array_sort(F.array("a_id", "b_id"))
    kind = F.upper(F.coalesce("type", F.lit("")))
    sure = F.col("confidence").try_cast("double")
    chance = F.when(sure.isNull() | F.isnan(sure), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)))
    reason = F.substr(F.trim(F.coalesce("reason", F.lit("Semantic comparison abstained."))), F.lit(1), F.lit(1000))
    return answers.where(kind.isin(*ANSWERS) & both).select("a_id", "b_id", kind.alias("type"), chance.alias("confidence"), reason.alias("reason"))


def settled_types(compared: DataFrame, answers: DataFrame) -> DataFrame:
    """compared(a_id, b_id, type, confidence, review) with what an answer makes of it.

    Without an answer, unrelated pairs are dropped and contradictions that need review are uncertain at 0.45.
    """
    said = answers.select("a_id", "b_id", F.col("type").alias("answer"), F.col("confidence").alias("sure"))
    joined = compared.join(said, ["a_id", "b_id"], "left")
    answered = F.col("review") & F.col("answer").isNotNull()
    abstained = F.col("review") & F.col("answer").isNull() & (F.col("type") == "CONTRADICTS")
    kept = joined.where(answered | (F.col("type") != "UNRELATED"))
    return kept.select("a_id", "b_id", F.when(answered, F.col("answer")).when(abstained, "UNCERTAIN").otherwise(F.col("type")).alias("type"), F.when(answered, F.col("sure")).when(abstained, 0.45).otherwise(F.col("confidence")).alias("confidence"))
