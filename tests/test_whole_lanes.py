"""Lanes of more claims than a list holds: all of their pairs count, in bounded lists."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from attestry.operators import families as fam
from attestry.operators import relations as rel
from attestry.plans import claims_to_gate as core
from attestry.plans.registered import ORACLE_SQL, QUERIES
from tests.compare import TABLES, compare, connect
from tests.test_growth import claims_of, plain_pairs
from tests.test_queries import FOLDER

WHOLE = (
    "g12_edges",
    "g12_edge_sums",
    "g13_edge_listing",
    "g7_review_gate",
    "h5_fact_families",
    "h5_status_counts",
    "h9_fact_snapshot",
    "h10_versions",
    "h10_stored_versions",
    "h11_memberships",
    "h14_active_revision",
    "h18_fact_detail",
    "a10_fact_export_json",
    "a11_fact_export_csv",
    "j10_review_queue",
    "j4_reviews_made_stale",
    "m12_fact_statuses",
)


@pytest.fixture(scope="module")
def long_lanes(tmp_path_factory):
    """The smallest tables with 1,500 claims in three lanes, of some 40 years, so a family has few of its lane's last claims."""
    folder = str(tmp_path_factory.mktemp("long_lanes"))
    for name in TABLES:
        if name != "lineitem":
            os.symlink(f"{FOLDER}/{name}.parquet", f"{folder}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (l_partkey % 3 + 1 AS l_partkey, l_shipdate + to_years(cast(l_orderkey % 35 - 10 AS int)) AS l_shipdate) FROM '{FOLDER}/lineitem.parquet' ORDER BY l_orderkey, l_linenumber LIMIT 1500) TO '{folder}/lineitem.parquet'")
    return folder


@pytest.mark.parametrize("name", WHOLE)
def test_all_claims_of_a_lane_count(spark, long_lanes, name):
    core.forget()
    assert compare(spark, connect(long_lanes), long_lanes, QUERIES[name], ORACLE_SQL[name]) is None


@pytest.mark.parametrize("chunk", [16, 512])
def test_pairs_and_edges_of_all_claims(spark, monkeypatch, chunk):
    monkeypatch.setattr(rel, "CHUNK", chunk)
    claims = claims_of(spark, 700).persist()
    plain = list(plain_pairs(claims, 1_000))
    wanted = sorted((a.id, b.id) for a, b in plain)
    assert len(wanted) > sum(1 for _ in plain_pairs(claims))
    assert sorted(tuple(r) for r in rel.every_pair(claims).select("a_id", "b_id").collect()) == wanted
    edges = rel.every_edge(claims)
    assert sorted((r.claim_a, r.claim_b) for r in edges.collect()) == sorted((a.id, b.id) for a, b in plain if a.label == b.label)
    assert sorted(edges.collect()) == sorted(rel.edges(rel.lane_pairs(claims, 1_000)).collect())


def test_families_and_histories_of_all_claims(spark):
    claims = claims_of(spark, 700).persist()
    flags = lambda df: sorted(tuple(bool(x) if i else x for i, x in enumerate(r)) for r in df.collect() if any(r[1:]))
    kinds = ["fact_id", *(kind.lower() for kind in fam.KINDS)]
    plain = fam.inner_edges(claims, rel.every_edge(claims)).persist()
    assert flags(fam.every_flags(claims).select(kinds)) == flags(plain.select(kinds))
    early = claims.where("early")
    both = fam.every_flags(claims, early="early").persist()
    assert flags(both.select(kinds)) == flags(plain.select(kinds))
    assert flags(both.select("fact_id", *(F.col(f"early_{k}") for k in kinds[1:]))) == flags(fam.inner_edges(early, rel.every_edge(early)).select(kinds))


def test_last_claims_alone_give_other_facts(spark, long_lanes):
    counted = lambda facts: {r.status: r.n for r in facts.groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert counted(core.all_facts(spark, long_lanes)) != counted(core.facts_of(spark, long_lanes))
