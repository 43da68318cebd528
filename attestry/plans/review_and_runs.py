"""Registered queries of groups G to P: semantic review, archive and reviews, embedding spaces, budgets and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from attestry.operators import families as fam
from attestry.operators import grounding as gr
from attestry.operators import relations as rel
from attestry.operators import review as rv
from attestry.operators import telemetry as tm
from attestry.plans import claims_to_gate as core
from attestry.plans import oracle
from attestry.plans.evidence_steps import _FOUND, _ITEMS, _PAGED, items, paged, sections
from attestry.plans.tables_and_text import CALLS, CLAIMS
from attestry.sources import views
from attestry.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


_EVERY = oracle.steps("every")
_w = oracle.with_steps


def _number(id_column: str) -> Column:
    """Eight hexadecimal digits of an id's hash as a number, so that both engines can add ids up."""
    return F.conv(F.substr(F.col(id_column), F.lit(7), F.lit(8)), 16, 10).cast("long")


_SUM = "cast(sum((('0x' || substr(a_id, 7, 8))::bigint * 31 + ('0x' || substr(b_id, 7, 8))::bigint * 17) % 1000003) AS bigint)"


def _total(a: str = "a_id", b: str = "b_id") -> Column:
    return F.sum((_number(a) * 31 + _number(b) * 17) % 1_000_003)


# --- G: pairs by lane, and their review


@query("g3_lane_pair_sums", _w(f"SELECT m.lane_subject, count(*) AS n, {_SUM} AS pairs FROM every_pairs p JOIN (SELECT id, lane_subject FROM resolved) m ON m.id = p.a_id GROUP BY 1", _EVERY))
def g3_sums(spark, sf):
    """All pairs, added up by lane: how many, and a sum over their ids."""
    return rel.lane_pairs(core.last_members(spark, sf), None).groupBy("lane_subject").agg(F.count("*").alias("n"), _total().alias("pairs"))


@query("g6_comparison_sums", _w(f"SELECT type, value_state, confidence, count(*) AS n, {_SUM} AS pairs FROM every_compared GROUP BY 1, 2, 3", _EVERY))
def g6_sums(spark, sf):
    compared = rel.compared(rel.lane_pairs(core.last_members(spark, sf), None))
    return compared.groupBy("type", "value_state", "confidence").agg(F.count("*").alias("n"), _total().alias("pairs"))


_ENDS = _SUM.replace("a_id", "claim_a").replace("b_id", "claim_b")


@query("g12_edge_sums", _w(f"SELECT substr(edge_id, 5, 1) AS digit, type, count(*) AS n, {_ENDS} AS pairs FROM every_edges GROUP BY 1, 2", oracle.WHOLE))
def g12_sums(spark, sf):
    edges = core.g12_edges(spark, sf)
    return edges.groupBy(F.substr("edge_id", F.lit(5), F.lit(1)).alias("digit"), "type").agg(F.count("*").alias("n"), _total("claim_a", "claim_b").alias("pairs"))


@query("j3_edges_left_by_type", _w("SELECT type, count(*) AS n FROM every_edges e JOIN claims a ON a.id = e.claim_a JOIN claims b ON b.id = e.claim_b WHERE NOT (a.visual OR b.visual) GROUP BY 1", _EVERY))
def j3_left(spark, sf):
    """Edges that are left when the scanned documents are archived."""
    kept = core.members(spark, sf).select("id", "visual")
    edges = rel.lane_edges(core.last_members(spark, sf), None)
    gone = kept.where("visual").select("id")
    left = edges.join(gone.withColumnRenamed("id", "claim_a"), "claim_a", "left_anti").join(gone.withColumnRenamed("id", "claim_b"), "claim_b", "left_anti")
    return left.groupBy("type").agg(F.count("*").alias("n"))


_SAID = "CASE pdf_page WHEN 1 THEN ' under the revised baseline' WHEN 2 THEN ', effective from April' WHEN 3 THEN ' as it stands' ELSE '' END"
_MARKED = "(" + "|".join((*rv.CONTEXT_MARKERS, *rv.STATUS_MARKERS)) + ")"
_REVIEW = f"""review AS (SELECT c.*, (type = 'CONTRADICTS' AND (a.semantic OR b.semantic)) OR (type = 'UNRELATED' AND (a.marked OR b.marked)) AS review FROM every_compared c
  JOIN (SELECT id, cast(substr(document_id, 10) AS int) % 7 = 0 AS semantic, regexp_matches(concat(evidence_text, {_SAID}), '{_MARKED}') AS marked FROM claims) a ON a.id = c.a_id
  JOIN (SELECT id, cast(substr(document_id, 10) AS int) % 7 = 0 AS semantic, regexp_matches(concat(evidence_text, {_SAID}), '{_MARKED}') AS marked FROM claims) b ON b.id = c.b_id)"""
_ASKED = "asked AS (SELECT a_id, b_id, row_number() OVER (ORDER BY a_id, b_id) AS turn FROM (SELECT a_id, b_id FROM review WHERE review ORDER BY 1, 2 LIMIT 24))"
_ANSWERED = """answered AS (SELECT a_id, b_id, turn, CASE turn % 6 WHEN 0 THEN 'corroborates' WHEN 1 THEN 'SUPERSEDES' WHEN 2 THEN 'DISPUTES' WHEN 3 THEN 'Reconciles' ELSE 'UNCERTAIN' END AS type,
  CASE WHEN turn % 5 = 0 THEN [a_id] WHEN turn % 4 = 1 THEN [b_id, a_id, b_id] ELSE [a_id, b_id] END AS evidence_ids, CASE turn % 3 WHEN 0 THEN '1.7' WHEN 1 THEN 'high' ELSE '0.8' END AS confidence FROM asked),
valid AS (SELECT a_id, b_id, upper(type) AS type, CASE confidence WHEN '1.7' THEN 1.0::double WHEN 'high' THEN 0.5::double ELSE 0.8::double END AS confidence FROM answered
  WHERE upper(type) IN ('CORROBORATES', 'CONTRADICTS', 'RECONCILES', 'SUPERSEDES', 'UNCERTAIN') AND list_sort(list_distinct(evidence_ids)) = list_sort([a_id, b_id]))"""


def _pairs(spark, sf):
    """Pairs with semantic and marked on both sides: documents of every seventh supplier state semantic values."""
    page = F.col("pdf_page")
    said = F.concat("evidence_text", F.when(page == 1, " under the revised baseline").when(page == 2, ", effective from April").when(page == 3, " as it stands").otherwise(""))
    claims = core.last_members(spark, sf).withColumn("marked", rv.marked(said)).withColumn("semantic", F.substr("document_id", F.lit(10)).cast("int") % 7 == 0)
    return rel.lane_pairs(claims, None, further=("marked", "semantic"))


def _compared(spark, sf):
    """Compared pairs with whether they need review."""
    pairs = rel.compared(_pairs(spark, sf))
    wanted = rv.needs_review(F.col("type"), F.col("a_semantic") | F.col("b_semantic"), F.col("a_marked") | F.col("b_marked"))
    return pairs.select("a_id", "b_id", "type", "confidence", wanted.alias("review"))


def _answers(spark, sf):
    asked = rv.reviewed(rv.pairs_to_review(_pairs(spark, sf)))
    turn = F.col("turn")
    kind = F.when(turn % 6 == 0, "corroborates").when(turn % 6 == 1, "SUPERSEDES").when(turn % 6 == 2, "DISPUTES").when(turn % 6 == 3, "Reconciles").otherwise("UNCERTAIN")
    evidence = F.when(turn % 5 == 0, F.array("a_id")).when(turn % 4 == 1, F.array("b_id", "a_id", "b_id")).otherwise(F.array("a_id", "b_id"))
    sure = F.when(turn % 3 == 0, "1.7").when(turn % 3 == 1, "high").otherwise("0.8")
    return asked.select("a_id", "b_id", "turn", kind.alias("type"), evidence.alias("evidence_ids"), sure.alias("confidence"), F.lit(None).cast("string").alias("reason"))


@query("g7_pairs_to_review", _w("SELECT type, review, count(*) AS n FROM review GROUP BY 1, 2", _EVERY, _REVIEW))
def g7_pairs(spark, sf):
    return _compared(spark, sf).groupBy("type", "review").agg(F.count("*").alias("n"))


@query("g8_reviews_of_a_run", _w("SELECT a_id, b_id, turn FROM asked", _EVERY, _REVIEW, _ASKED))
def g8(spark, sf):
    return _answers(spark, sf).select("a_id", "b_id", "turn")


@query("g9_valid_answers", _w("SELECT a_id, b_id, type, confidence FROM valid", _EVERY, _REVIEW, _ASKED, _ANSWERED))
def g9(spark, sf):
    return rv.valid_answers(_answers(spark, sf)).select("a_id", "b_id", "type", "confidence")


@query("g10_settled_types", _w("""SELECT type, confidence, count(*) AS n FROM (SELECT CASE WHEN review AND answer IS NOT NULL THEN answer WHEN review AND type = 'CONTRADICTS' THEN 'UNCERTAIN' ELSE type END AS type,
  CASE WHEN review AND answer IS NOT NULL THEN sure WHEN review AND type = 'CONTRADICTS' THEN 0.45::double ELSE confidence END AS confidence, type AS old, answer, review FROM review r LEFT JOIN (SELECT a_id, b_id, type AS answer, confidence AS sure FROM valid) v USING (a_id, b_id))
  WHERE old <> 'UNRELATED' OR (review AND answer IS NOT NULL) GROUP BY 1, 2""", _EVERY, _REVIEW, _ASKED, _ANSWERED))
def g10(spark, sf):
    settled = rv.settled_types(_compared(spark, sf), rv.valid_answers(_answers(spark, sf)))
    return settled.groupBy("type", "confidence").agg(F.count("*").alias("n"))


_EVIDENCE = """CASE pdf_page WHEN 1 THEN concat('[{"text":"', evidence_text, '","kind":"', CASE WHEN visual THEN 'visual-region' ELSE 'text' END, '"},{"text":"', predicate, '","requires_review":true}]')
  WHEN 2 THEN concat('{"text":"', evidence_text, '","precision":"', CASE WHEN visual THEN 'visual-region' ELSE 'page-only' END, '"}') WHEN 3 THEN concat('{"text": ', evidence_text) WHEN 4 THEN '[]' ELSE concat('[{"text":"', evidence_text, '"}]') END"""


@query("g15_evidence_items", f"SELECT id, CASE pdf_page WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE 1 END AS n_items, pdf_page IN (1, 2) AND visual AS visual_only, CASE WHEN pdf_page NOT IN (3, 4) THEN evidence_text END AS first_text FROM (SELECT *, {_EVIDENCE} AS evidence FROM {CLAIMS})")
def g15(spark, sf):
    """Evidence as it is stored: lists, single objects, empty lists and broken JSON."""
    page, kind = F.col("pdf_page"), F.when(F.col("visual"), "visual-region")
    text = F.col("evidence_text")
    two = F.to_json(F.array(F.struct(text.alias("text"), F.coalesce(kind, F.lit("text")).alias("kind"), F.lit(None).cast("boolean").alias("requires_review")), F.struct(F.col("predicate").alias("text"), F.lit(None).cast("string").alias("kind"), F.lit(True).alias("requires_review"))))
    one = F.to_json(F.struct(text.alias("text"), F.coalesce(kind, F.lit("page-only")).alias("precision")))
    stored = F.when(page == 1, two).when(page == 2, one).when(page == 3, F.concat(F.lit('{"text": '), text)).when(page == 4, "[]").otherwise(F.to_json(F.array(F.struct(text.alias("text")))))
    read = views.claims(spark, sf).select("id", stored.alias("evidence")).select("id", "evidence", rv.evidence_items(F.col("evidence")).alias("items"))
    return read.select("id", F.size("items").alias("n_items"), rv.visual_only(F.col("evidence")).alias("visual_only"), F.get("items", F.lit(0))["text"].alias("first_text"))


# --- H and J: lists of a fact, archive and reviews


@query("h7_evidence_lists", _w("SELECT m.fact_id, count(*) AS n_evidence, sha256(string_agg(concat(m.id, ':', m.evidence_text), '|' ORDER BY m.created_on, m.id)) AS evidence, coalesce(string_agg(DISTINCT CASE WHEN m.raw_value <> f.raw_value THEN m.raw_value END, ','  ORDER BY CASE WHEN m.raw_value <> f.raw_value THEN m.raw_value END), '') AS alternatives FROM every_members m JOIN every_facts f USING (fact_id) GROUP BY 1", _EVERY))
def h7(spark, sf):
    """Evidence of each fact in the order of its members (as a hash), and the values that aren't the representative's."""
    members = core.members(spark, sf).select("fact_id", "id", "created_on", "evidence_text", "raw_value", F.coalesce("precision", F.lit(-1)).alias("p"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("created_on", "id", "evidence_text"))), lambda x: F.concat_ws(":", x["id"], x["evidence_text"]))
    lists = members.groupBy("fact_id").agg(F.count("*").alias("n_evidence"), F.sha2(F.array_join(ordered, "|"), 256).alias("evidence"), F.array_sort(F.collect_set("raw_value")).alias("all"), F.max_by("raw_value", F.struct("p", "created_on", "id")).alias("own"))
    return lists.select("fact_id", "n_evidence", "evidence", F.array_join(F.filter("all", lambda v: v != F.col("own")), ",").alias("alternatives"))


_ARCHIVED = "cast(substr(document_id, 10) AS int) % 10 = 2"
_AFFECTED = f"affected AS (SELECT f.fact_id, f.revision + 1 AS revision, n FROM facts f JOIN (SELECT fact_id, count(*) AS n FROM every_members GROUP BY 1 HAVING bool_or({_ARCHIVED})) m USING (fact_id))"


def _affected(spark, sf, whole=False):
    """Facts with a member of an archived document: every tenth supplier's. Their next revision, and how many members it copies."""
    gone = F.substr("document_id", F.lit(10)).cast("int") % 10 == 2
    facts = core.history(spark, sf, {"gone": F.bool_or(gone), "n": F.count("*")}, whole).where("gone")
    return facts.select("fact_id", (F.col("revision") + 1).alias("revision"), "n", "status", "value_num")


@query("j4_archive_versions", _w("SELECT concat(fact_id, '-v', revision) AS version_id, fact_id, revision, 3 AS knowledge_revision, 'UNRESOLVED' AS status, n AS n_members FROM affected", *oracle.TWO, _AFFECTED))
def j4_versions(spark, sf):
    version = F.concat("fact_id", F.lit("-v"), F.col("revision").cast("string"))
    return _affected(spark, sf).select(version.alias("version_id"), "fact_id", "revision", F.lit(3).alias("knowledge_revision"), F.lit("UNRESOLVED").alias("status"), F.col("n").alias("n_members"))


@query("j4_archive_memberships", _w("SELECT substr(m.fact_id, 6, 1) AS digit, count(*) AS n, count(DISTINCT m.fact_id) AS n_facts FROM every_members m JOIN affected a USING (fact_id) GROUP BY 1", *oracle.TWO, _AFFECTED))
def j4_memberships(spark, sf):
    """Memberships that the new versions take over, counted by the first digit of the fact."""
    copied = fam.memberships(core.members(spark, sf), _affected(spark, sf))
    return copied.groupBy(F.substr("fact_id", F.lit(6), F.lit(1)).alias("digit")).agg(F.count("*").alias("n"), F.count_distinct("fact_id").alias("n_facts"))


@query("j4_reviews_made_stale", _w("SELECT review_id, fact_id, r.stale AS was_stale, a.fact_id IS NOT NULL OR r.stale AS is_stale FROM reviews r LEFT JOIN affected a USING (fact_id)", *oracle.WHOLE_TWO, _AFFECTED))
def j4_reviews(spark, sf):
    hit = _affected(spark, sf, whole=True).select("fact_id", F.lit(True).alias("hit"))
    marked = core.reviews(core.kept_history(spark, sf, whole=True)).join(hit, "fact_id", "left")
    return marked.select("review_id", "fact_id", F.col("stale").alias("was_stale"), (F.coalesce("hit", F.lit(False)) | F.col("stale")).alias("is_stale"))


@query("j5_archive_changes", f"SELECT document_id, concat('change-', substr(sha256(concat(document_id, '|archived|3')), 1, 16)) AS change_id, 'document_archived' AS kind, 3 AS knowledge_revision, count(*) AS n_claims FROM {CLAIMS} WHERE {_ARCHIVED} GROUP BY 1")
def j5(spark, sf):
    """The revision advances by one for the archive, and each archived document is a change."""
    gone = views.claims(spark, sf).where(F.substr("document_id", F.lit(10)).cast("int") % 10 == 2).groupBy("document_id").agg(F.count("*").alias("n_claims"))
    change = F.concat(F.lit("change-"), F.substr(F.sha2(F.concat("document_id", F.lit("|archived|3")), 256), F.lit(1), F.lit(16)))
    return gone.select("document_id", change.alias("change_id"), F.lit("document_archived").alias("kind"), F.lit(3).alias("knowledge_revision"), "n_claims")


_REVOKED = "(SELECT review_id AS revokes FROM reviews WHERE substr(review_id, 10, 1) < '6')"


def _revoked(spark, sf):
    """Reviews, of which a later one revokes some (by their hash)."""
    found = core.reviews(core.kept_history(spark, sf))
    later = found.where(F.substr("review_id", F.lit(10), F.lit(1)) < "6").select(F.col("review_id").alias("revokes"))
    joined = found.join(later, found.review_id == later.revokes, "left")
    return joined.select("review_id", "fact_id", "stale", F.when(F.col("revokes").isNotNull(), "revoked").otherwise(F.col("status")).alias("status"))


@query("j8_revoked_reviews", _w(f"SELECT review_id, CASE WHEN x.revokes IS NOT NULL THEN 'revoked' ELSE status END AS status FROM reviews r LEFT JOIN {_REVOKED} x ON x.revokes = r.review_id", *oracle.TWO))
def j8(spark, sf):
    return _revoked(spark, sf).select("review_id", "status")


@query("j9_review_listing", _w("SELECT review_id, fact_id, row_number() OVER (PARTITION BY substr(fact_id, 7, 1) ORDER BY review_id DESC) AS place FROM reviews WHERE NOT stale", *oracle.TWO))
def j9(spark, sf):
    """Reviews that aren't stale, newest ids first within each group of facts."""
    order = Window.partitionBy(F.substr("fact_id", F.lit(7), F.lit(1))).orderBy(F.desc("review_id"))
    return _revoked(spark, sf).where("not stale").select("review_id", "fact_id", F.row_number().over(order).alias("place"))


@query("j11_run_sweep", f"SELECT id, CASE WHEN r.status IS NULL THEN 'provisional' ELSE r.status END AS status FROM {CLAIMS} c LEFT JOIN (SELECT run_id, CASE WHEN count(*) FILTER (status = 'failed') * 4 >= count(*) THEN 'failed' ELSE 'cancelled' END AS status FROM {CALLS} WHERE run_id % 3 <> 0 GROUP BY 1) r ON r.run_id = cast(substr(c.document_id, 10) AS bigint) WHERE modality = 'projected'")
def j11(spark, sf):
    """Provisional claims of runs that ended badly: failed if a quarter of their calls failed, else cancelled; a third still runs."""
    share = F.count_if(F.col("status") == "failed") * 4 >= F.count("*")
    ended = views.telemetry(spark, sf).where("run_id % 3 <> 0").groupBy("run_id").agg(F.when(share, "failed").otherwise("cancelled").alias("ended"))
    waiting = views.claims(spark, sf).where("modality = 'projected'").select("id", F.substr("document_id", F.lit(10)).cast("long").alias("run_id"))
    return waiting.join(ended, "run_id", "left").select("id", F.coalesce("ended", F.lit("provisional")).alias("status"))


# --- M: spaces and vectors


@query("m10_embedding_upsert", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'incoming' ELSE 'stored' END AS version, len(embedding) AS dimensions, vec_id % 3 = 0 AS inserted FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 2 = 0")
def m10(spark, sf):
    """Two thirds of the vectors are stored, every other one comes in: the last by (space, id) stays."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    stored = rows.where("vec_id % 3 <> 0").withColumn("seq", F.lit(1))
    incoming = rows.where("vec_id % 2 = 0").withColumn("seq", F.lit(2))
    last = stored.unionByName(incoming).groupBy("vec_id").agg(F.max_by(F.struct("seq", F.size("embedding").alias("n")), "seq").alias("v"), F.min("seq").alias("first"))
    return last.select("vec_id", F.when(F.col("v.seq") == 2, "incoming").otherwise("stored").alias("version"), F.col("v.n").alias("dimensions"), (F.col("first") == 2).alias("inserted"))


_SPACES = "(SELECT n_nationkey AS space_id, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END AS workspace_id, n_nationkey % 7 AS created, n_nationkey % 4 <> 1 AS active FROM nation)"


@query("m11_active_spaces", f"SELECT r_regionkey AS workspace_id, space_id FROM (SELECT r_regionkey, space_id, row_number() OVER (PARTITION BY r_regionkey ORDER BY (workspace_id IS NULL), created DESC, space_id DESC) AS k FROM region JOIN {_SPACES} ON active AND (workspace_id IS NULL OR workspace_id = r_regionkey)) WHERE k = 1")
def m11(spark, sf):
    """Each workspace's space: its own before a global one, the newest first."""
    nation, key = table(spark, sf, "nation"), F.col("n_nationkey")
    spaces = nation.select(key.alias("space_id"), F.when(key % 3 != 0, F.col("n_regionkey")).alias("owner"), (key % 7).alias("created"), (key % 4 != 1).alias("active")).where("active")
    newest = F.struct("created", "space_id")
    own = spaces.where("owner is not null").groupBy(F.col("owner").alias("workspace_id")).agg(F.max_by("space_id", newest).alias("own"))
    shared = spaces.where("owner is null").agg(F.max_by("space_id", newest).alias("shared"))
    workspaces = table(spark, sf, "region").select(F.col("r_regionkey").alias("workspace_id"))
    chosen = workspaces.join(own, "workspace_id", "left").join(F.broadcast(shared)).select("workspace_id", F.coalesce("own", "shared").alias("space_id"))
    return chosen.where("space_id is not null")


@query("m13_new_spaces", f"SELECT concat('space-', substr(sha256(concat_ws('|', n_name, 'm1', '64')), 1, 16)) AS space_id, n_regionkey AS workspace_id, n_name AS provider, 'm1' AS model, 64 AS dimensions FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey <> 2)")
def m13(spark, sf):
    """A space for each nation; those of an unknown workspace are rejected."""
    known = table(spark, sf, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("workspace_id"))
    asked = table(spark, sf, "nation").select(F.col("n_regionkey").alias("workspace_id"), F.col("n_name").alias("provider"), F.lit("m1").alias("model"), F.lit(64).alias("dimensions"))
    name = F.concat(F.lit("space-"), F.substr(F.sha2(F.concat_ws("|", "provider", "model", F.col("dimensions").cast("string")), 256), F.lit(1), F.lit(16)))
    return asked.join(known, "workspace_id", "left_semi").select(name.alias("space_id"), "workspace_id", "provider", "model", "dimensions")


@query("m14_decoded_vectors", "SELECT vec_id, CASE WHEN vec_id % 5 <> 4 THEN len(embedding) END AS dimensions, CASE WHEN vec_id % 5 <> 4 THEN round(embedding[1]::double, 4) END AS first, vec_id % 5 = 4 AS rejected FROM embeddings")
def m14(spark, sf):
    """Answers of embedding services in three forms, and some that hold no numbers."""
    turn, vector = F.col("vec_id") % 5, F.transform("embedding", lambda x: x.cast("double"))
    body = (
        F.when(turn == 0, F.to_json(F.struct(F.array(F.struct(vector.alias("embedding"), F.lit(0).alias("index"))).alias("data"))))
        .when(turn == 1, F.to_json(F.struct(F.array(vector).alias("embeddings"))))
        .when(turn == 4, F.lit('{"embeddings": [["one", "two"]]}'))
        .otherwise(F.to_json(F.array(vector)))
    )
    answers = table(spark, sf, "embeddings").select("vec_id", body.alias("body"))
    bare = F.get(F.from_json("body", "array<array<double>>"), F.lit(0))
    wrapped = F.from_json("body", "data array<struct<embedding: array<double>, index: int>>, embeddings array<array<double>>")
    read = answers.select("vec_id", F.when(F.startswith("body", F.lit("[")), bare).otherwise(F.coalesce(F.get(wrapped["data"], F.lit(0))["embedding"], F.get(wrapped["embeddings"], F.lit(0)))).alias("v"))
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    valid = read.select("vec_id", F.when(F.coalesce(good, F.lit(False)), F.col("v")).alias("v"))
    return valid.select("vec_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("dimensions"), F.round(F.get("v", F.lit(0)), 4).alias("first"), F.col("v").isNull().alias("rejected"))


# --- O: progress and budget

# The share of a run's progress that each stage covers.
BANDS = {"parse": (0, 12), "vision": (12, 20), "extraction": (20, 62), "grounding": (62, 70), "registry": (70, 82), "relationships": (82, 94), "publication": (94, 100)}
_STAGES = tuple(BANDS)
_BAND = "CASE call_id % 7 " + " ".join(f"WHEN {i} THEN {BANDS[s][0]} + ({BANDS[s][1]} - {BANDS[s][0]}) * part" for i, s in enumerate(_STAGES)) + " END"


@query("o5_stage_progress", f"SELECT run_id, cast(max(cast(floor(least(100, greatest(0, {_BAND}))) AS int)) AS int) AS progress, count(*) AS steps FROM (SELECT *, least(1.0, greatest(0.0, (latency_ms % 140 - 20) / 100.0)) AS part FROM {CALLS}) GROUP BY 1")
def o5(spark, sf):
    """Each call as a step of a stage, done in part: how far its run has come."""
    calls = views.telemetry(spark, sf)
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("latency_ms") % 140 - 20) / 100.0))
    value = None
    for i, stage in enumerate(_STAGES):
        low, high = BANDS[stage]
        here = F.lit(low) + (high - low) * part
        value = F.when(F.col("call_id") % 7 == i, here) if value is None else value.when(F.col("call_id") % 7 == i, here)
    return calls.groupBy("run_id").agg(F.max(F.floor(F.least(F.lit(100), F.greatest(F.lit(0), value))).cast("int")).alias("progress"), F.count("*").alias("steps"))


@query("o6_stage_eta", f"SELECT run_id, role, cast(epoch(max(ts)) - epoch(min(ts)) AS bigint) AS seconds, count(*) AS done, CASE WHEN count(*) > 1 THEN cast(floor((cast(epoch(max(ts)) AS bigint) - cast(epoch(min(ts)) AS bigint)) * 10.0 / (count(*) - 1)) AS bigint) END AS eta FROM (SELECT run_id, role, date_trunc('second', ts) AS ts FROM {CALLS}) GROUP BY 1, 2")
def o6_eta(spark, sf):
    """How long a stage has taken, and what ten more steps will take at this rate (none after a single step)."""
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    took = F.max(second) - F.min(second)
    return views.telemetry(spark, sf).groupBy("run_id", "role").agg(took.alias("seconds"), F.count("*").alias("done"), F.when(F.count("*") > 1, F.floor(took * 10.0 / (F.count("*") - 1))).alias("eta"))


def _requests(spark, sf):
    """Calls as requests of runs' budgets, with what they turned out to cost (some are settled twice, some never)."""
    calls = views.telemetry(spark, sf)
    return calls.select(F.col("run_id").alias("budget_key"), F.col("call_id").alias("request_id"), (F.col("latency_ms") % 50 + 1).alias("amount"), F.when(F.col("call_id") % 4 != 3, F.col("latency_ms") % 70).alias("actual"), "status")


@query("o9_settlement")
def o9(spark, sf):
    return tm.settle(_requests(spark, sf), 600).select("budget_key", "request_id", "outcome", "cost")


@query("o10_budget_snapshot")
def o10(spark, sf):
    settled = tm.settle(_requests(spark, sf), 600)
    return settled.groupBy("budget_key").agg(F.lit(600).cast("long").alias("limit"), F.sum(F.when(F.col("outcome") == "reserved", F.col("amount")).otherwise(0)).alias("reserved"), F.sum("cost").alias("spent")).withColumn("remaining", F.greatest(F.lit(0), F.col("limit") - F.col("reserved") - F.col("spent")))


# --- P: evaluation

_LOWER = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


@query("p3_grounding_check", f"SELECT document_id, count(*) AS items, count(*) FILTER (quote <> '' AND contains({_LOWER.format('line')}, {_LOWER.format('quote')})) AS grounded FROM {_ITEMS} GROUP BY 1")
def p3(spark, sf):
    held = (F.col("quote") != "") & F.contains(gr.squeezed(F.col("line")), gr.squeezed(F.col("quote")))
    return items(spark, sf).groupBy("document_id").agg(F.count("*").alias("items"), F.count_if(held).alias("grounded"))


_VALID = rf"(SELECT i.document_id, i.item_id, i.true_page, f.found_page, i.raw_value FROM {_ITEMS} i JOIN {_FOUND} f USING (item_id) WHERE subject <> '' AND requested_status IS NULL AND contains(quote, regexp_extract(raw_value, '(\d[\d,]*(?:\.\d+)?)', 1)))"


def _kept(spark, sf):
    everything = items(spark, sf)
    found = gr.validated(everything, sections(spark, sf)).select("item_id", "document_id", "raw_value", "found_page")
    return found.join(everything.select("item_id", "true_page"), "item_id")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 4))


@query("p4_case_scores", f"""SELECT e.document_id, e.expected, coalesce(v.found, 0) AS found, coalesce(v.matched, 0) AS matched, round(coalesce(v.matched, 0) / e.expected, 4)::double AS recall, CASE WHEN v.found > 0 THEN round(v.matched / v.found, 4)::double END AS precision, coalesce(v.which, '') AS which
  FROM (SELECT document_id, count(*) AS expected FROM {_PAGED} GROUP BY 1) e LEFT JOIN (SELECT document_id, count(*) AS found, count(*) FILTER (found_page = true_page) AS matched, string_agg(CASE WHEN found_page = true_page THEN cast(item_id AS varchar) END, ',' ORDER BY item_id) AS which FROM {_VALID} GROUP BY 1) v USING (document_id)""")
def p4(spark, sf):
    """Each document as a case: its lines are expected, the validated items found; recall, precision and which ones matched."""
    expected = paged(spark, sf).groupBy("document_id").agg(F.count("*").alias("expected"))
    same = F.col("found_page") == F.col("true_page")
    found = _kept(spark, sf).groupBy("document_id").agg(F.count("*").alias("found"), F.count_if(same).alias("matched"), F.array_sort(F.collect_set(F.when(same, F.col("item_id")))).alias("which"))
    joined = expected.join(found, "document_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0))).withColumn("found", F.coalesce("found", F.lit(0)))
    names = F.array_join(F.transform(F.coalesce("which", F.array().cast("array<int>")), lambda x: x.cast("string")), ",")
    return joined.select("document_id", "expected", "found", "matched", _ratio(F.col("matched"), F.col("expected")).alias("recall"), _ratio(F.col("matched"), F.col("found")).alias("precision"), names.alias("which"))


@query("p6_gold_evaluation", f"""SELECT count(*) AS gold, count(*) FILTER (hit) AS value_and_page, round(count(*) FILTER (hit) / count(*), 4)::double AS recall, round(count(*) FILTER (hit AND labelled) / nullif(count(*) FILTER (hit), 0), 4)::double AS predicate_accuracy, count(DISTINCT CASE WHEN late THEN document_id END) AS late_documents
  FROM (SELECT p.*, v.item_id IS NOT NULL AS hit, coalesce(p.o_orderkey % 9 <> 2, false) AS labelled, page >= 2017 AS late FROM {_PAGED} p LEFT JOIN (SELECT DISTINCT document_id, found_page, raw_value, min(item_id) AS item_id FROM {_VALID} GROUP BY 1, 2, 3) v
    ON v.document_id = p.document_id AND v.found_page = p.page AND v.raw_value = regexp_extract(line, '(\\$[0-9.]+)', 1))""")
def p6(spark, sf):
    """Gold: each line's value on its page. Found by value and page; predicates of some gold records have another name."""
    gold = paged(spark, sf).select("document_id", "o_orderkey", "page", F.regexp_extract("line", r"(\$[0-9.]+)", 1).alias("raw_value"))
    found = _kept(spark, sf).select("document_id", F.col("found_page").alias("page"), "raw_value", F.lit(True).alias("hit")).distinct()
    joined = gold.join(found, ["document_id", "page", "raw_value"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    labelled = F.col("o_orderkey") % 9 != 2
    hits = F.count_if("hit")
    return joined.agg(F.count("*").alias("gold"), hits.alias("value_and_page"), F.round(hits / F.count("*"), 4).alias("recall"), F.round(F.count_if(F.col("hit") & labelled) / F.nullif(hits, F.lit(0)), 4).alias("predicate_accuracy"), F.count_distinct(F.when(F.col("page") >= 2017, F.col("document_id"))).alias("late_documents"))


@query("p7_expected_claims", f"""WITH x AS (SELECT id, subject, predicate, period, modality, pdf_page, raw_value, CASE WHEN substr(id, 7, 1) < '4' THEN concat('about ', raw_value) ELSE raw_value END AS wanted FROM {CLAIMS}),
  found AS (SELECT DISTINCT subject, predicate, raw_value, period, modality FROM {CLAIMS} WHERE NOT visual), paged AS (SELECT DISTINCT subject, raw_value, pdf_page FROM {CLAIMS} WHERE NOT visual)
  SELECT x.subject, count(*) AS expected, count(f.subject) AS exact, count(p.subject) AS value_and_page FROM x LEFT JOIN found f ON f.subject = x.subject AND f.predicate = x.predicate AND f.raw_value = x.wanted AND f.period = x.period AND f.modality = x.modality
  LEFT JOIN paged p ON p.subject = x.subject AND p.raw_value = x.raw_value AND p.pdf_page = x.pdf_page GROUP BY 1""")
def p7(spark, sf):
    """All claims as expected ones, some worded otherwise, against those of documents that aren't scanned: by all fields, or by value and page."""
    claims = views.claims(spark, sf)
    wanted = claims.select("subject", "predicate", "period", "modality", "pdf_page", "raw_value", F.when(F.substr("id", F.lit(7), F.lit(1)) < "4", F.concat(F.lit("about "), "raw_value")).otherwise(F.col("raw_value")).alias("wanted"))
    found = claims.where("not visual")
    exact = found.select("subject", "predicate", "period", "modality", F.col("raw_value").alias("wanted"), F.lit(1).alias("is_exact")).distinct()
    loose = found.select("subject", "raw_value", "pdf_page", F.lit(1).alias("is_loose")).distinct()
    joined = wanted.join(exact, ["subject", "predicate", "period", "modality", "wanted"], "left").join(loose, ["subject", "raw_value", "pdf_page"], "left")
    return joined.groupBy("subject").agg(F.count("*").alias("expected"), F.count("is_exact").alias("exact"), F.count("is_loose").alias("value_and_page"))
