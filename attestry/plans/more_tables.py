"""More registered queries: documents, evidence, registry, reviews, vectors, runs and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.functions import names, periods
from attestry.operators import families as fam
from attestry.operators import relations as rel
from attestry.operators import retrieval as rt
from attestry.plans import claims_to_gate as core
from attestry.plans import oracle
from attestry.plans.tables_and_text import _DENSE, _ENTITY, CALLS, CLAIMS, MENTIONS, _dense
from attestry.sources import views
from attestry.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str):
    def register(function):
        QUERIES[name], ORACLE_SQL[name] = function, sql
        return function

    return register


@query("a8_manifest_matching", r"""WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS tok FROM part), f AS (SELECT DISTINCT p_name AS path, unnest(string_split(lower(p_name), ' ')) AS tok FROM part),
  n AS (SELECT p_partkey, count(*) AS n FROM t GROUP BY 1), s AS (SELECT p_partkey, path, count(*) AS shared FROM t JOIN f USING (tok) GROUP BY 1, 2),
  r AS (SELECT s.*, shared::double / n AS coverage, row_number() OVER (PARTITION BY p_partkey ORDER BY shared DESC, path) AS k, lead(shared) OVER (PARTITION BY p_partkey ORDER BY shared DESC, path) AS second FROM s JOIN n USING (p_partkey))
  SELECT p_partkey, path FROM r WHERE k = 1 AND coverage >= 0.3 AND (second IS NULL OR second < shared)""")
def a8(spark, sf):
    """Titles and the one path that shares most of their words; ties are rejected."""
    part = table(spark, sf, "part")
    words = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), " ")))
    titles = part.select("p_partkey", words("p_name").alias("tok"))
    paths = part.select("p_name").distinct().select(F.col("p_name").alias("path"), words("p_name").alias("tok"))
    size = titles.groupBy("p_partkey").agg(F.count("*").alias("n"))
    shared = titles.join(paths, "tok").groupBy("p_partkey", "path").agg(F.count("*").alias("shared")).join(size, "p_partkey")
    order = Window.partitionBy("p_partkey").orderBy(F.desc("shared"), "path")
    ranked = shared.withColumn("k", F.row_number().over(order)).withColumn("second", F.lead("shared").over(order))
    return ranked.where("k = 1 and shared / n >= 0.3 and (second is null or second < shared)").select("p_partkey", "path")


@query("a9_manifest_verification", "SELECT o_orderkey, count(l_orderkey) AS pages, count(l_orderkey) = o_orderkey % 5 AS complete FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def a9(spark, sf):
    pages = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("pages"))
    orders = table(spark, sf, "orders").select("o_orderkey").join(pages, "o_orderkey", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    return orders.select("o_orderkey", "pages", (F.col("pages") == F.col("o_orderkey") % 5).alias("complete"))


@query("a16_document_detail", "SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 1")
def a16(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "orders").where("o_custkey = 1").select("o_orderkey", "o_custkey").join(items, "o_orderkey")


@query("a17_default_workspace", "SELECT n_regionkey AS region, arg_min(n_name, n_nationkey) AS name, count(*) AS n FROM nation GROUP BY 1")
def a17(spark, sf):
    return table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.min_by("n_name", "n_nationkey").alias("name"), F.count("*").alias("n"))


@query("b7_table_lines", "SELECT conv_id, string_agg(concat(role, ' | ', length(text)), chr(10) ORDER BY turn, role, text) AS rows FROM conversations GROUP BY 1")
def b7(spark, sf):
    """Turns as table rows: cells joined by a bar, rows by a line feed."""
    cells = F.struct("turn", "role", "text")
    ordered = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(cells)).alias("t"))
    line = F.transform("t", lambda r: F.concat_ws(" | ", r["role"], F.length(r["text"]).cast("string")))
    return ordered.select("conv_id", F.array_join(line, "\n").alias("rows"))


@query("b20_merged_claims", f"WITH c AS {CLAIMS} SELECT subject, raw_value, period, modality, min(lane) AS lane FROM (SELECT *, 1 AS lane FROM c WHERE substr(id, 7, 1) < '8' UNION ALL SELECT *, 2 FROM c WHERE substr(id, 7, 1) >= '4') GROUP BY 1, 2, 3, 4")
def b20(spark, sf):
    """Primary claims, and recovered ones that add something."""
    claims = views.claims(spark, sf)
    first = F.substr("id", F.lit(7), F.lit(1))
    both = claims.where(first < "8").withColumn("lane", F.lit(1)).unionByName(claims.where(first >= "4").withColumn("lane", F.lit(2)))
    return both.groupBy("subject", "raw_value", "period", "modality").agg(F.min("lane").alias("lane"))


@query("d6_value_in_evidence", f"SELECT id, regexp_matches(concat(' ', evidence_text, ' '), concat('[^0-9.,]', replace(raw_value, '%', ''), '[^0-9.,]')) AS found FROM {CLAIMS}")
def d6(spark, sf):
    """The value's number stands in the evidence with no digit beside it."""
    number = F.regexp_extract("raw_value", r"(\d[\d,.]*)", 1)
    padded = F.concat(F.lit(" "), "evidence_text", F.lit(" "))
    return views.claims(spark, sf).select("id", F.rlike(padded, F.concat(F.lit("[^0-9.,]"), number, F.lit("[^0-9.,]"))).alias("found"))


@query("e3_claim_evidence", f"SELECT DISTINCT id AS claim_id, concat('anchor-', substr(sha256(concat_ws(chr(31), document_id, cast(pdf_page AS varchar), evidence_text)), 1, 20)) AS anchor_id, 'supports' AS purpose FROM {CLAIMS}")
def e3(spark, sf):
    anchor = F.concat(F.lit("anchor-"), F.substr(F.sha2(F.concat_ws("\x1f", "document_id", F.col("pdf_page").cast("string"), "evidence_text"), 256), F.lit(1), F.lit(20)))
    return views.claims(spark, sf).select(F.col("id").alias("claim_id"), anchor.alias("anchor_id"), F.lit("supports").alias("purpose")).distinct()


@query("e8_checkpoint_reuse", "SELECT count(*) AS pending FROM (SELECT DISTINCT sha256(text) AS h FROM documents) WHERE substr(h, 1, 1) >= '4'")
def e8(spark, sf):
    """Distinct inputs that no finished batch (hashes below 4) has."""
    inputs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("h")).distinct()
    finished = inputs.where(F.substr("h", F.lit(1), F.lit(1)) < "4")
    return inputs.join(finished, "h", "left_anti").agg(F.count("*").alias("pending"))


@query("e9_truncation_guard", f"SELECT role, count(*) FILTER (call_id % 11 = 0) AS output_truncated, count(*) FILTER (call_id % 11 <> 0) AS usable FROM {CALLS} GROUP BY 1")
def e9(spark, sf):
    reason = F.when(F.col("call_id") % 11 == 0, "max_tokens").otherwise("stop")
    calls = views.telemetry(spark, sf).withColumn("cut", reason.isin("length", "max_tokens", "max_output_tokens"))
    return calls.groupBy("role").agg(F.count_if("cut").alias("output_truncated"), F.count_if(~F.col("cut")).alias("usable"))


@query("f7_alias_lookup", f"SELECT m.key, e.first_seen AS entity FROM (SELECT key, {_ENTITY} AS k FROM {MENTIONS}) m JOIN (SELECT {_ENTITY} AS k, min(key) AS first_seen FROM {MENTIONS} GROUP BY 1) e USING (k)")
def f7(spark, sf):
    """Each mention's entity: the first mention with its key."""
    mentions = views.entity_mentions(spark, sf).select("key", names.entity_key(F.col("name")).alias("k"))
    return mentions.join(mentions.groupBy("k").agg(F.min("key").alias("entity")), "k").select("key", "entity")


@query("f12_semantic_budget", f"SELECT key, CASE WHEN row_number() OVER (PARTITION BY grp ORDER BY key) <= 4 THEN 'asked' ELSE 'semantic_budget_deferred' END AS state FROM (SELECT key, key % 10 AS grp FROM {MENTIONS})")
def f12(spark, sf):
    """The first four ambiguous names of a run are asked about, the rest stay apart."""
    mentions = views.entity_mentions(spark, sf).withColumn("grp", F.col("key") % 10)
    order = Window.partitionBy("grp").orderBy("key")
    return mentions.select("key", F.when(F.row_number().over(order) <= 4, "asked").otherwise("semantic_budget_deferred").alias("state"))


@query("f18_registry_listing", f"SELECT {_ENTITY} AS entity_key, string_agg(name, '; ' ORDER BY name) AS aliases FROM {MENTIONS} GROUP BY 1")
def f18(spark, sf):
    mentions = views.entity_mentions(spark, sf).withColumn("entity_key", names.entity_key(F.col("name")))
    return mentions.groupBy("entity_key").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("aliases"))


@query("f19_vector_batches", "SELECT batch, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY label) - 1) // 128 AS batch FROM (SELECT DISTINCT trim(p_name) AS label FROM part)) GROUP BY 1")
def f19(spark, sf):
    """Distinct labels without a vector, in batches of 128."""
    labels = table(spark, sf, "part").select(F.trim("p_name").alias("label")).distinct()
    # labels are numbered within their first two letters; each such bucket begins where those before it end
    bucketed = labels.withColumn("bucket", F.substr("label", F.lit(1), F.lit(2)))
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("k"))
    other = sizes.select(F.col("bucket").alias("earlier"), F.col("k").alias("before"))
    begins = sizes.join(F.broadcast(other), F.col("earlier") < F.col("bucket"), "left").groupBy("bucket").agg(F.coalesce(F.sum("before"), F.lit(0)).alias("begin"))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("label"))
    numbered = bucketed.withColumn("own", own).join(F.broadcast(begins), "bucket")
    return numbered.select(F.floor((F.col("begin") + F.col("own") - 1) / 128).alias("batch")).groupBy("batch").agg(F.count("*").alias("n"))


@query("g7_review_gate", oracle.with_steps("SELECT edge_id, type IN ('CONTRADICTS', 'UNCERTAIN') AS gated FROM every_edges", oracle.WHOLE))
def g7(spark, sf):
    return core.g12_edges(spark, sf).select("edge_id", F.col("type").isin("CONTRADICTS", "UNCERTAIN").alias("gated"))


@query("j2_status_cascade", f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN substr(id, 7, 1) = '0' THEN 'quarantined' WHEN document_id = 'supplier-2' THEN 'archived' ELSE 'accepted' END AS status FROM {CLAIMS}) GROUP BY 1")
def j2(spark, sf):
    status = F.when(F.substr("id", F.lit(7), F.lit(1)) == "0", "quarantined").when(F.col("document_id") == "supplier-2", "archived").otherwise("accepted")
    return views.claims(spark, sf).select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("j4_affected_facts", oracle.with_steps("SELECT DISTINCT fact_id, 'UNRESOLVED' AS status FROM every_members WHERE document_id = 'supplier-2'", oracle.steps("every")))
def j4(spark, sf):
    """Facts that lose a member when a source is archived."""
    return core.members(spark, sf).where("document_id = 'supplier-2'").select("fact_id", F.lit("UNRESOLVED").alias("status")).distinct()


@query("j6_rebuild_after_archive", oracle.with_steps("SELECT status, count(*) AS n FROM rest_facts GROUP BY 1", oracle.steps("rest", "document_id <> 'supplier-2'")))
def j6(spark, sf):
    return core.facts_of(spark, sf, "document_id <> 'supplier-2'").groupBy("status").agg(F.count("*").alias("n"))


@query("j7_review_admission", oracle.with_steps("""SELECT fact_id, CASE WHEN k = 0 THEN 'unknown_action' WHEN k = 1 THEN 'stale_revision' ELSE 'accepted' END AS outcome
  FROM (SELECT fact_id, (ascii(substr(fact_id, 6, 1)) % 3) AS k FROM every_facts)""", oracle.steps("every")))
def j7(spark, sf):
    """Reviews with an unknown action, on an old revision, or in order, by the fact's hash."""
    kind = F.ascii(F.substr("fact_id", F.lit(6), F.lit(1))) % 3
    asked = core.facts_of(spark, sf).select("fact_id", F.when(kind == 0, "guess").otherwise("prefer").alias("action"), F.when(kind == 1, 0).otherwise(1).alias("based_on"), F.lit(1).alias("revision"))
    outcome = F.when(~F.col("action").isin("prefer", "select", "reject"), "unknown_action").when(F.col("based_on") != F.col("revision"), "stale_revision").otherwise("accepted")
    return asked.select("fact_id", outcome.alias("outcome"))


@query("j10_review_queue", oracle.with_steps("SELECT fact_id, status FROM every_facts WHERE status IN ('CONTESTED', 'UNRESOLVED')", oracle.WHOLE))
def j10(spark, sf):
    return core.all_facts(spark, sf).where("status in ('CONTESTED', 'UNRESOLVED')").select("fact_id", "status")


@query("m3_identity_text", f"SELECT id, concat_ws(' | ', coalesce(subject, ''), coalesce(predicate, ''), coalesce(period, ''), coalesce(modality, ''), coalesce(scope, '')) AS identity FROM {CLAIMS}")
def m3(spark, sf):
    return views.claims(spark, sf).select("id", rt.identity_text().alias("identity"))


_LANES = f"(SELECT query_id, id, rank FROM ({_DENSE.format(30)}) UNION ALL SELECT q.vec_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY v.vec_id) FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.vec_id AND v.vec_id < q.vec_id + 40 AND v.vec_id > q.vec_id)"


@query("m6_fused_search", f"SELECT query_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(1.0::double / (60 + rank)), 6) AS score FROM {_LANES} GROUP BY 1, 2)) WHERE rank <= 10")
def m6(spark, sf):
    """A dense lane and a lane of equal labels nearby, fused by reciprocal ranks."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    asked = vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("own"))
    near = vectors.join(F.broadcast(asked.limit(100_000)) if asked.limit(100_001).count() <= 100_000 else asked, (F.col("label") == F.col("own")) & (F.col("id") > F.col("query_id")) & (F.col("id") < F.col("query_id") + 40))
    second = near.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("id")).alias("rank"))
    return rt.fuse(_dense(spark, sf, 30).select("query_id", "id", "rank").unionByName(second), 10).select("query_id", "rank", "score")


@query("m8_dimension_check", "SELECT count(*) FILTER (len(embedding) = 64) AS accepted, count(*) FILTER (len(embedding) <> 64) AS rejected FROM embeddings")
def m8(spark, sf):
    right = F.size("embedding") == 64
    return table(spark, sf, "embeddings").agg(F.count_if(right).alias("accepted"), F.count_if(~right).alias("rejected"))


@query("o2_batch_counts", f"SELECT run_id, count(*) AS total, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (cache_hit) AS cache_hits, sum(attempts - 1)::bigint AS retries FROM {CALLS} GROUP BY 1")
def o2(spark, sf):
    return views.telemetry(spark, sf).groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if("cache_hit").alias("cache_hits"), F.sum(F.col("attempts") - 1).alias("retries"))


@query("o6_stage_durations", f"SELECT run_id, role, epoch(max(ts)) - epoch(min(ts)) >= 60 AS long, count(*) AS n FROM {CALLS} GROUP BY 1, 2")
def o6(spark, sf):
    seconds = F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))) - F.min(F.unix_timestamp(F.col("ts").cast("timestamp")))
    return views.telemetry(spark, sf).groupBy("run_id", "role").agg((seconds >= 60).alias("long"), F.count("*").alias("n"))


@query("o12_run_spend", f"SELECT run_id, sum(CASE WHEN cache_hit THEN 0 ELSE latency_ms END)::bigint AS spend, count(*) FILTER (cache_hit) AS hits FROM {CALLS} GROUP BY 1")
def o12(spark, sf):
    return views.telemetry(spark, sf).groupBy("run_id").agg(F.sum(F.when(F.col("cache_hit"), 0).otherwise(F.col("latency_ms"))).alias("spend"), F.count_if("cache_hit").alias("hits"))


@query("p2_claim_match", f"WITH c AS {CLAIMS} SELECT e.id, count(f.id) AS matches FROM c e LEFT JOIN c f ON lower(f.subject) = lower(e.subject) AND f.predicate = e.predicate AND {oracle.period('f.period')} = {oracle.period('e.period')} AND f.value_num = e.value_num GROUP BY 1")
def p2(spark, sf):
    """Each claim as an expected one, and how many claims match it in all fields: counted by these fields."""
    keyed = views.claims(spark, sf).select("id", F.lower("subject").alias("s"), "predicate", periods.normalize_period(F.col("period")).alias("label"), "value_num")
    fields = ["s", "predicate", "label", "value_num"]
    return keyed.join(keyed.groupBy(*fields).agg(F.count("*").alias("matches")), fields).select("id", "matches")


@query("p5_model_summary", f"SELECT role, count(*) AS cases, round(avg((status = 'complete')::int), 4) AS pass_rate, round(sum(attempts)::double / nullif(count(*) FILTER (status = 'complete'), 0), 4) AS attempts_per_pass FROM {CALLS} GROUP BY 1")
def p5(spark, sf):
    good = F.count_if(F.col("status") == "complete")
    return views.telemetry(spark, sf).groupBy("role").agg(F.count("*").alias("cases"), F.round(F.avg((F.col("status") == "complete").cast("int")), 4).alias("pass_rate"), F.round(F.try_divide(F.sum("attempts"), good), 4).alias("attempts_per_pass"))


@query("p8_relationship_match", oracle.with_steps("SELECT count(*) AS expected, count(e.edge_id) AS found FROM (SELECT b_id AS x, a_id AS y FROM every_compared WHERE type = 'CORROBORATES') w LEFT JOIN every_edges e ON e.claim_a = least(x, y) AND e.claim_b = greatest(x, y) AND e.type = 'CORROBORATES'", oracle.steps("every")))
def p8(spark, sf):
    """Expected relationships with their ends swapped are found in either direction."""
    edges = rel.lane_edges(core.last_members(spark, sf), None)
    wanted = edges.where("type = 'CORROBORATES'").select(F.least("claim_a", "claim_b").alias("claim_a"), F.greatest("claim_a", "claim_b").alias("claim_b"))
    joined = wanted.join(edges.where("type = 'CORROBORATES'").select("claim_a", "claim_b", "edge_id"), ["claim_a", "claim_b"], "left")
    return joined.agg(F.count("*").alias("expected"), F.count("edge_id").alias("found"))


@query("p10_provider_rollup", f"SELECT role, count(*) AS calls, round(avg(latency_ms), 4) AS mean_latency, max(attempts) AS most_attempts FROM {CALLS} GROUP BY 1")
def p10(spark, sf):
    return views.telemetry(spark, sf).groupBy("role").agg(F.count("*").alias("calls"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"), F.max("attempts").alias("most_attempts"))
