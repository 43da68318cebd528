"""Steps that must not grow faster than their input, and give what the plain steps give."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from attestry.functions.modality import with_context
from attestry.operators import families as fam
from attestry.operators import relations as rel
from attestry.plans import claims_to_gate as core
from attestry.plans import review_and_runs as runs


def claims_of(spark, n=400):
    """Claims in two lanes, one of them longer than the limit, with early ones, periods in two spellings and nulls."""
    def one(i):
        return (f"c{i * 7919 % 1009:04d}", "w0", f"d{i % 5}" if i % 41 else None, "Rate" if i % 9 else "rate", "p" if i % 4 else "Q", f"{i % 3}%", Decimal(i % 3) / 100 if i % 17 else None, "percentage", "%", i % 2, None if i % 13 == 0 else f"FY{17 + i % 3}" if i % 2 else f"20{17 + i % 3}", "actual", None, datetime.date(2000 + i % 7, 1, 1), f"Rate was {i}", i % 3 == 0, i % 7 < 4)

    shape = "id string, workspace_id string, document_id string, subject string, predicate string, raw_value string, value_num decimal(24,8), value_type string, unit string, precision int, period string, modality string, scope string, created_on date, evidence_text string, visual boolean, early boolean"
    return fam.with_family(rel.resolved(spark.createDataFrame([one(i) for i in range(n)], shape)))


def plain_pairs(claims, limit=rel.LANE_LIMIT):
    """Pairs by hand, lane by lane."""
    lanes = {}
    for r in claims.collect():
        lanes.setdefault((r.lane_subject, r.lane_predicate), []).append(r)
    for rows in lanes.values():
        last = sorted(rows, key=lambda r: r.id)[-limit:]
        yield from ((a, b) for i, a in enumerate(last) for b in last[i + 1 :] if a.document_id and b.document_id and a.document_id != b.document_id)


def test_pairs_and_edges(spark):
    claims = claims_of(spark).persist()
    wanted = sorted((a.id, b.id) for a, b in plain_pairs(claims))
    assert sorted(tuple(r) for r in rel.lane_pairs(claims).select("a_id", "b_id").collect()) == wanted
    same = sorted((a.id, b.id) for a, b in plain_pairs(claims) if a.label == b.label)
    edges = rel.lane_edges(claims)
    assert sorted((r.claim_a, r.claim_b) for r in edges.collect()) == same
    assert sorted(edges.collect()) == sorted(rel.edges(rel.lane_pairs(claims)).collect())


def test_pairs_of_two_revisions(spark):
    claims = claims_of(spark).persist()
    both = rel.lane_pairs(claims, early="early").persist()
    every = sorted(tuple(r) for r in both.where("a_in_all and b_in_all").select("a_id", "b_id").collect())
    first = sorted(tuple(r) for r in both.where("a_in_early and b_in_early").select("a_id", "b_id").collect())
    assert every == sorted((a.id, b.id) for a, b in plain_pairs(claims))
    assert first == sorted((a.id, b.id) for a, b in plain_pairs(claims.where("early")))
    assert set(first) - set(every)  # pairs that the limit has taken from the second revision


def test_histories_are_two_families(spark):
    claims = claims_of(spark).persist()
    early = claims.where("early")
    now = fam.families(claims, fam.inner_edges(claims, rel.lane_edges(claims)))
    before = fam.families(early, fam.inner_edges(early, rel.lane_edges(early)))
    found = fam.histories(claims, fam.inner_flags(claims, early="early"), "early").persist()
    assert sorted(map(str, found.select(now.columns).collect())) == sorted(map(str, now.collect()))
    old = found.where("known_early").select("fact_id", *(F.col(f"early_{c}").alias(c) for c in fam.STATE))
    assert sorted(map(str, old.collect())) == sorted(map(str, before.select("fact_id", *fam.STATE).collect()))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_pair_is_joined_with_pairs(spark):
    """Pairs, edges and versions are formed in one pass over the claims, without a join of pairs or of snapshots."""
    folder = "/root/testdata/sf0.001"
    assert "Join" not in plan_of(core.g11_unassessed_pairs(spark, folder))
    assert "Join" not in plan_of(core.g12_edges(spark, folder))
    for query in (core.h9_fact_snapshot, core.h10_versions, core.h14_active_revision):
        plan = plan_of(query(spark, folder))
        assert plan.count("Relation") == 2 and plan.count("Join") == 1  # the claims' lists and their flags
    assert plan_of(core.h12_deactivated(spark, folder)).count("Relation") == 1


def test_archived_facts_come_from_one_history(spark):
    """What an archive touches is counted where the families are formed, and memberships take their state from there."""
    folder = "/root/testdata/sf0.001"
    assert plan_of(runs.j4_versions(spark, folder)).count("Relation") == 2
    assert plan_of(runs.j4_memberships(spark, folder)).count("Relation") == 2


def largest_method(df):
    """Bytes of the largest generated method; the JVM compiles none above 8,000."""
    execution = df._jdf.queryExecution()
    execution.executedPlan()  # with the settings of now
    made, sizes = execution.debug().codegenToSeq().iterator(), []
    while made.hasNext():
        sizes.append(made.next()._3().maxMethodCodeSize())
    return max(sizes)


def test_generated_methods_are_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # adaptive plans have no generated code before they run
    try:
        made = {query.__name__: largest_method(query(spark, "/root/testdata/sf0.001")) for query in (core.h9_fact_snapshot, core.history, core.facts_of, core.h4_family_edges, core.g12_edges, core.g6_pair_comparison, runs.g12_sums)}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert not {name: size for name, size in made.items() if size > 8000}


def test_requests_meet_facts_once(spark):
    """A gate joins requests with facts once, and forms its decisions without distinct counts, which would repeat its rows."""
    plan = plan_of(core.QUERIES["i5_needs_review"](spark, "/root/testdata/sf0.001"))
    assert plan.count("own_s") and len([line for line in plan.split("\n") if "Join" in line and "own_s" in line]) == 1
    assert "Expand" not in plan


def test_context_of_texts_with_and_without_hints(spark):
    said = ["first  advance\testimate", "Projected", "it is EXPECTED\n to rise", "a preliminary count", "plain text", "expectedly", "", None]
    rows = spark.createDataFrame([("actual", x) for x in said], "m string, e string")
    found = with_context(rows, "m", "e", "context").select("context").collect()
    assert [r.context for r in found] == ["first_estimate", "forecast", "forecast", "estimated", "reported", "reported", "reported", "reported"]
    from attestry.functions.modality import _said

    assert rows.select(_said(F.col("e")).alias("s")).where("s = ''").count() == 2
