"""Pairs that need review, found without comparing all pairs, and by compiled code."""

from pyspark.sql import functions as F

from attestry.operators import relations as rel
from attestry.operators import review as rv
from attestry.plans import review_and_runs as runs
from tests.test_growth import claims_of, largest_method


def test_same_pairs_as_by_comparing_all(spark):
    number = F.substr("id", F.lit(2)).cast("int")
    claims = claims_of(spark, 300).withColumn("semantic", F.when(number % 11 != 0, number % 4 == 0)).withColumn("marked", F.when(number % 13 != 0, number % 3 == 0))
    pairs = rel.lane_pairs(claims, further=("marked", "semantic")).persist()
    wanted = rel.compared(pairs).where(rv.needs_review(F.col("type"), F.col("a_semantic") | F.col("b_semantic"), F.col("a_marked") | F.col("b_marked")))
    found = sorted(tuple(r) for r in rv.pairs_to_review(pairs).select("a_id", "b_id", "type").collect())
    assert found and found == sorted(tuple(r) for r in wanted.select("a_id", "b_id", "type").collect())


def test_its_methods_are_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert largest_method(runs.g9(spark, "/root/testdata/sf0.001")) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
