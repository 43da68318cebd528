import random

from pyspark.sql import functions as F

from attestry.operators import grounding, registry, review, telemetry


def settled(rows, limit):
    """The fold, request by request: {request: (outcome, cost)}."""
    out, reserved, spent = {}, {}, {}
    for budget, request, amount, actual, status in sorted(rows):
        r, s = reserved.get(budget, 0), spent.get(budget, 0)
        if r + s + amount > limit:
            out[request] = ("rejected", 0)
        elif actual is None:
            out[request] = ("reserved", 0)
            reserved[budget] = r + amount
        else:
            cost = min(max(0, actual), max(0, limit - s - r))
            out[request] = ("budget_capped" if actual > cost and status == "complete" else status, cost)
            spent[budget] = s + cost
    return out


def test_settlement_against_a_plain_fold(spark):
    rng = random.Random(1)
    rows = [(b, 100 * b + k, rng.randrange(1, 40), rng.choice([None, rng.randrange(60)]), rng.choice(["complete", "failed"])) for b in range(6) for k in range(40)]
    df = spark.createDataFrame(rows, "budget_key long, request_id long, amount long, actual long, status string")
    found = {r.request_id: (r.outcome, r.cost) for r in telemetry.settle(df, 300).collect()}
    assert found == settled(rows, 300)
    assert {o for o, _ in found.values()} == {"rejected", "reserved", "budget_capped", "complete", "failed"}
    assert telemetry.settle(df.limit(0), 300).count() == 0


def test_nearest_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(20)) for _ in range(200)] + [(9, 5), (9, None)]
    found = {r.k: r.v for r in telemetry.nearest_ranks(spark.createDataFrame(rows, "k int, v int"), "k", "v", 0.95).collect()}
    for k in {k for k, _ in rows}:
        values = sorted(v for q, v in rows if q == k and v is not None)
        assert found[k] == values[round((len(values) - 1) * 0.95)]


def test_visual_only_evidence(spark):
    cases = {
        '[{"text":"a","kind":"visual-region"}]': True,
        '[{"text":"a","kind":"visual-region"},{"text":"b","kind":"text"}]': False,
        '{"text":"a","precision":"visual-region"}': True,
        '[{"text":"a","requires_review":true}]': True,
        "[]": False,
        "": False,
        "not json": False,
        None: False,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "evidence string").select("evidence", review.visual_only(F.col("evidence")).alias("v")).collect()
    assert {r.evidence: r.v for r in rows} == cases


def test_answers_that_count(spark):
    rows = [("a", "b", "supersedes", ["b", "a"], "1.7"), ("a", "c", "MAYBE", ["a", "c"], "0.5"), ("a", "d", "UNCERTAIN", ["a"], "0.5"), ("a", "e", "RECONCILES", ["a", "e", "a"], "much")]
    df = spark.createDataFrame(rows, "a_id string, b_id string, type string, evidence_ids array<string>, confidence string").withColumn("reason", F.lit(None).cast("string"))
    assert sorted((r.b_id, r.type, r.confidence) for r in review.valid_answers(df).collect()) == [("b", "SUPERSEDES", 1.0), ("e", "RECONCILES", 0.5)]


def test_frames_of_claims(spark):
    rows = [(1, "Acme Ltd's net  revenue in FY2024", "grew", "FY2024", "reported", None), (2, "Acme forecast sales", "sales_rate", None, "forecast", None), (3, "Group revenue", "amount", None, None, "Group"), (4, "Acme was", "headcount", None, None, None)]
    claims = spark.createDataFrame(rows, "id int, subject string, predicate string, period string, modality string, scope string")
    entities = spark.createDataFrame([("Acme",), ("Acme Ltd",)], "label string")
    found = {r.id: (r.entity, r.concept) for r in registry.claim_frames(claims, entities).collect()}
    assert found == {1: ("Acme Ltd", "net_revenue_in"), 2: ("Acme", "sales"), 3: ("Group revenue", "amount"), 4: ("Acme was", "headcount")}


def test_quotes_are_looked_up_in_their_documents(spark):
    items = spark.createDataFrame([(1, 7, None, "Some  words"), (2, 7, 2, "SOME words"), (3, 7, 1, "more"), (4, 8, None, "some words"), (5, 7, None, "")], "item_id int, document_id int, page int, quote string")
    held = spark.createDataFrame([(7, 1, 1, "here are some words"), (7, 2, 2, "some words again and more")], "document_id int, page int, section int, text string")
    found = {r.item_id: (r.found_page, r.found_start, r.found_end) for r in grounding.grounded_source(items, held).collect()}
    assert found == {1: (1, 9, 19), 2: (2, 0, 10), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None)}
