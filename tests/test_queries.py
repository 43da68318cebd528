import os

import pytest

from attestry.plans.registered import ORACLE_SQL, QUERIES
from tests.compare import compare, connect

FOLDER = os.environ.get("TEST_DATA", "/root/testdata") + "/sf0.001"
SLOW = {name for name in QUERIES if name[0] in "hi" and name[1].isdigit()} - {"h5_fact_families", "i5_needs_review", "i10_gate_decisions", "h15_knowledge_diff"}
SLOW |= {"j4_archive_memberships", "j4_reviews_made_stale", "j9_review_listing", "g12_edge_sums", "g9_valid_answers"}
#: What has no rows on these data.
EMPTY = set()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - SLOW))
def test_equals_sql(spark, duck, name):
    said = compare(spark, duck, FOLDER, QUERIES[name], ORACLE_SQL[name])
    assert said is None or said == "no rows" and name in EMPTY, said


def test_status_counts(spark):
    rows = QUERIES["h5_status_counts"](spark, FOLDER).collect()
    assert {r.status: (r.n, r.n_claims) for r in rows} == {"CONTESTED": (1619, 5021), "CORROBORATED": (70, 145), "SUPPORTED": (760, 834)}
