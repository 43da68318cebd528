"""Registered queries that carry the parts of operators which other queries leave out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.functions import names, numeric
from attestry.operators import extraction as ex
from attestry.operators import retrieval as rt
from attestry.plans import oracle
from attestry.plans.tables_and_text import _ENTITY, CALLS, CLAIMS, MENTIONS
from attestry.sources import views
from attestry.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str):
    def register(function):
        QUERIES[name], ORACLE_SQL[name] = function, sql
        return function

    return register


@query("a1_documents_in_order", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, lang, doc_id) AS place FROM documents")
def a1(spark, sf):
    """The documents of each source as a workspace lists them, newest first, then by name; sizes stand for dates here."""
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "lang", "doc_id")
    return table(spark, sf, "documents").select("doc_id", "source", F.row_number().over(order).alias("place"))


_SLUG = "nullif(substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '')"


@query("a14_workspaces_created", f"""WITH s AS (SELECT p_partkey, {_SLUG} AS slug FROM part), held AS (SELECT DISTINCT slug FROM s WHERE p_partkey % 50 = 0)
  SELECT p_partkey, slug, CASE WHEN slug IS NULL THEN 'empty' WHEN slug IN (SELECT slug FROM held) THEN 'exists' WHEN p_partkey > min(p_partkey) OVER (PARTITION BY slug) THEN 'exists' END AS refused FROM s WHERE p_partkey % 50 <> 0""")
def a14(spark, sf):
    """Workspaces asked for by name, in order: a slug that is there already, or was asked for before, is refused."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    every = table(spark, sf, "part").select("p_partkey", F.nullif(F.substr(slug, F.lit(1), F.lit(48)), F.lit("")).alias("slug"))
    held = every.where("p_partkey % 50 = 0").select("slug", F.lit(True).alias("there")).distinct()
    asked = every.where("p_partkey % 50 <> 0")
    first = asked.groupBy("slug").agg(F.min("p_partkey").alias("first")).join(held, "slug", "left")
    refused = F.when(F.col("slug").isNull(), "empty").when(F.col("there") | (F.col("p_partkey") > F.col("first")), "exists")
    return asked.join(first, "slug", "left").select("p_partkey", "slug", refused.alias("refused"))


_PAGE = """(SELECT source, round(greatest(0.05, least(1.0, 0.98 - 0.22 * (low::int + bare::int) - 0.08 * (glyphs::int + sparse::int))), 4)::double AS score, low OR bare AS vision FROM
  (SELECT source, length(trim(text)) < 80 AS low, doc_id % 10 = 0 AS bare, regexp_matches(text, '[\\x{FFFD}]') OR contains(text, chr(0)) AS glyphs, length(trim(text)) / 1000000.0 < 0.00012 AS sparse FROM documents))"""


@query("b5_quality_rollup", f"SELECT source, count(*) AS pages, cast(round(avg(score) * 1000) AS bigint) AS mean_quality, count(*) FILTER (NOT vision) AS native, count(*) FILTER (vision) AS vision_required FROM {_PAGE} GROUP BY 1")
def b5(spark, sf):
    """Pages, their mean quality in thousandths and their dispositions, by source."""
    pages = table(spark, sf, "documents").select("source", ex.page_quality(F.col("text"), F.col("doc_id") % 10, F.lit(1000000.0)).alias("q"))
    return pages.groupBy("source").agg(
        F.count("*").alias("pages"), F.round(F.avg("q.score") * 1000).cast("long").alias("mean_quality"),
        F.count_if(F.col("q.disposition") == "native").alias("native"), F.count_if(F.col("q.disposition") == "vision-required").alias("vision_required"),
    )


@query("c6_bound_operators", """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN '<=' WHEN 1 THEN '>=' WHEN 2 THEN '<' WHEN 3 THEN '>' WHEN 4 THEN '<=' WHEN 5 THEN '>=' END AS bound FROM orders""")
def c6(spark, sf):
    """Prices with a bound before them, or none, or one that stands after the number."""
    signs = F.array(*(F.lit(x) for x in ("<=", " >=", "<", "  >", "≤", "≥ ", "", "about ")))
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    raw = F.concat(F.element_at(signs, (F.col("o_orderkey") % 8 + 1).cast("int")), price, F.when(F.col("o_orderkey") % 8 >= 6, " >= 1").otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", numeric.bound_operator(raw).alias("bound"))


@query("e6_pair_fingerprints", f"""WITH p AS (SELECT id AS a, lead(id) OVER (PARTITION BY subject, predicate ORDER BY id) AS b FROM {CLAIMS})
  SELECT sha256(concat_ws(chr(10), 'relation', a, b)) AS fingerprint, 2::bigint AS asked FROM p WHERE b IS NOT NULL""")
def e6(spark, sf):
    """Requests about neighbouring claims of a lane, each asked in both orders: one fingerprint."""
    after = F.lead("id").over(Window.partitionBy("subject", "predicate").orderBy("id"))
    pairs = views.claims(spark, sf).select(F.col("id").alias("x"), after.alias("y")).where("y is not null")
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    mark = F.sha2(F.concat_ws("\n", F.lit("relation"), F.least("x", "y"), F.greatest("x", "y")), 256)
    return both.groupBy(mark.alias("fingerprint")).agg(F.count("*").alias("asked"))


@query("f4_conceptual_predicates", """SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN slug || '_fy2024' WHEN 3 THEN 'actual_' || slug WHEN 4 THEN 'unknown_predicate' ELSE slug END AS concept
  FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS slug FROM part)""")
def f4(spark, sf):
    """Names of parts as predicates: with fiscal years, which go where a period is known, and with words of their modality or of another."""
    turn, name = F.col("p_partkey") % 5, F.col("p_name")
    predicate = F.when(turn == 0, F.concat(name, F.lit(" for FY2024-25"))).when(turn == 1, F.concat(name, F.lit(" FY2024"))).when(turn == 2, F.concat(F.lit("Projected "), name, F.lit(" in fiscal 2024 forecast"))).when(turn == 3, F.concat(F.lit("actual "), name)).otherwise(F.lit("forecast projection"))
    period = F.when(turn != 1, "FY2024")
    modality = F.when(turn.isin(2, 4), "forecast").when(turn == 3, "reported")
    return table(spark, sf, "part").select("p_partkey", names.conceptual_predicate(predicate, period, modality).alias("concept"))


@query("f7_confirmed_aliases", f"""WITH m AS (SELECT key, {_ENTITY} AS k FROM {MENTIONS}), e AS (SELECT k, min(key) AS entity FROM m WHERE key % 10 = 0 GROUP BY 1),
  a AS (SELECT k, min(key - key % 10) AS entity FROM m WHERE key % 3 = 1 GROUP BY 1)
  SELECT m.key, coalesce(e.entity, a.entity) AS entity, CASE WHEN e.entity IS NOT NULL THEN 'exact' WHEN a.entity IS NOT NULL THEN 'alias' END AS lane FROM m LEFT JOIN e USING (k) LEFT JOIN a USING (k)""")
def f7(spark, sf):
    """Mentions looked up by key among the entities (every tenth supplier), then among confirmed aliases; proposed ones don't count."""
    said = views.entity_mentions(spark, sf).select("key", names.entity_key(F.col("name")).alias("k"))
    entities = said.where("key % 10 = 0").groupBy("k").agg(F.min("key").alias("exact"))
    aliases = said.select("k", (F.col("key") - F.col("key") % 10).alias("of"), F.when(F.col("key") % 3 == 1, "confirmed").otherwise("proposed").alias("status"))
    confirmed = aliases.where("status = 'confirmed'").groupBy("k").agg(F.min("of").alias("alias"))
    met = said.join(entities, "k", "left").join(confirmed, "k", "left")
    return met.select("key", F.coalesce("exact", "alias").alias("entity"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").alias("lane"))


@query("m3_evidence_text", f"SELECT id, concat(concat_ws(' | ', coalesce(subject, ''), coalesce(predicate, ''), coalesce(period, ''), coalesce(modality, ''), coalesce(scope, '')), ' | ', coalesce(raw_value, '')) AS evidence FROM {CLAIMS}")
def m3(spark, sf):
    return views.claims(spark, sf).select("id", rt.evidence_text().alias("evidence"))


@query("o11_run_listing", f"""SELECT run_id, row_number() OVER (ORDER BY min(ts) DESC, run_id) AS place, count(*) AS calls, count(*) FILTER (status = 'failed') AS failed FROM {CALLS} GROUP BY 1 QUALIFY place <= 100""")
def o11_runs(spark, sf):
    """The hundred newest runs with their calls, newest first."""
    runs = views.telemetry(spark, sf).groupBy("run_id").agg(F.min("ts").alias("began"), F.count("*").alias("calls"), F.count_if(F.col("status") == "failed").alias("failed"))
    newest = runs.orderBy(F.desc("began"), "run_id").limit(100)  # the list's length bounds the window
    return newest.select("run_id", F.row_number().over(Window.orderBy(F.desc("began"), "run_id")).alias("place"), "calls", "failed")


@query("o11_stage_listing", f"""SELECT run_id, role, row_number() OVER (PARTITION BY run_id ORDER BY min(ts), role) AS place, cast(epoch_us(max(ts)) - epoch_us(min(ts)) AS bigint) AS took_us, count(*) AS calls FROM {CALLS} GROUP BY 1, 2""")
def o11_stages(spark, sf):
    """The stages of each run in the order in which they began, with the time from the first to the last sign of each."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    stages = views.telemetry(spark, sf).groupBy("run_id", "role").agg(F.min("ts").alias("began"), F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("calls"))
    order = Window.partitionBy("run_id").orderBy("began", "role")
    return stages.select("run_id", "role", F.row_number().over(order).alias("place"), (F.col("b") - F.col("a")).alias("took_us"), "calls")


@query("p2_claim_match_values", f"""WITH c AS {CLAIMS} SELECT e.id, count(f.id) AS matches FROM c e LEFT JOIN c f ON lower(f.subject) = lower(e.subject) AND f.predicate = e.predicate AND (e.visual OR {oracle.period('f.period')} = {oracle.period('e.period')})
  AND f.value_num IN (e.value_num, e.value_num + 0.01, e.value_num - 0.01) GROUP BY 1""")
def p2(spark, sf):
    """Each claim as an expected one with three values that are right, and any period where it expects none: how many claims match."""
    from attestry.functions.periods import normalize_period

    keyed = views.claims(spark, sf).select("id", F.lower("subject").alias("s"), "predicate", normalize_period(F.col("period")).alias("label"), "value_num", "visual")
    step = F.lit("0.01").cast("decimal(24,8)")
    counted = keyed.groupBy("s", "predicate", "label", F.col("value_num").cast("decimal(25,8)").alias("value")).agg(F.count("*").alias("n"))
    values = F.explode(F.array(*(x.cast("decimal(25,8)") for x in (F.col("value_num"), F.col("value_num") + step, F.col("value_num") - step)))).alias("value")
    asked = keyed.select("id", "s", "predicate", F.when(~F.col("visual"), F.col("label")).alias("wanted"), values)
    met = asked.join(counted, ["s", "predicate", "value"]).where("wanted is null or wanted = label")
    return met.groupBy("id").agg(F.sum("n").alias("matches"))
