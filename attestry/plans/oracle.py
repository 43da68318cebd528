"""DuckDB forms of the views and of the claim-to-fact steps, for checking results."""

from __future__ import annotations

CLAIMS = """SELECT concat('claim-', substr(sha256(concat_ws('|', cast(l_orderkey AS varchar), cast(l_linenumber AS varchar), cast(l_partkey AS varchar),
    cast(l_suppkey AS varchar), cast(cast(l_quantity AS decimal(18,2)) AS varchar), cast(cast(l_extendedprice AS decimal(18,2)) AS varchar),
    cast(cast(l_shipdate AS date) AS varchar))), 1, 24)) AS id,
  'w0' AS workspace_id, concat('supplier-', cast(l_suppkey AS varchar)) AS document_id, concat('Part#', cast(l_partkey AS varchar)) AS subject,
  'discount_rate' AS predicate, concat(cast(cast(cast(l_discount AS decimal(4,2)) * 100 AS int) AS varchar), '%') AS raw_value,
  cast(l_discount AS decimal(24,8)) AS value_num, 'percentage' AS value_type, '%' AS unit, 0 AS precision,
  CASE l_suppkey % 3 WHEN 0 THEN concat('FY', cast(year(l_shipdate) + 20 AS varchar)) WHEN 1 THEN concat('FY', substr(cast(year(l_shipdate) + 20 AS varchar), 3, 2))
    ELSE concat(cast(year(l_shipdate) + 19 AS varchar), '-', substr(cast(year(l_shipdate) + 20 AS varchar), 3, 2)) END AS period,
  CASE l_linestatus WHEN 'O' THEN 'projected' ELSE 'actual' END AS modality, cast(NULL AS varchar) AS scope, cast(l_shipdate AS date) AS created_on,
  cast(l_linenumber AS int) AS pdf_page,
  concat('Part#', cast(l_partkey AS varchar), ' discount rate was ', concat(cast(cast(cast(l_discount AS decimal(4,2)) * 100 AS int) AS varchar), '%')) AS evidence_text, l_suppkey % 3 = 1 AS visual
FROM lineitem"""

LINES = """SELECT o_orderkey, o_custkey AS document_id, concat('Customer ', cast(o_custkey AS varchar), ' reported total price of $',
  cast(cast(o_totalprice AS decimal(18,2)) AS varchar), CASE o_orderkey % 4 WHEN 0 THEN ' million' WHEN 1 THEN ' crore' WHEN 2 THEN '' ELSE ' bn' END,
  ' in FY', cast(year(o_orderdate) + 20 AS varchar), '.') AS line FROM orders"""

MENTIONS = """SELECT cast(s_suppkey AS bigint) AS key, concat('Supplier#', cast(s_suppkey AS varchar),
  CASE s_suppkey % 4 WHEN 0 THEN ' Limited' WHEN 1 THEN ' Ltd' WHEN 2 THEN ' Holdings Limited' ELSE '' END) AS name FROM supplier"""

TELEMETRY = """SELECT cast(event_id AS bigint) AS call_id, cast(user_id AS bigint) AS run_id, event_type AS role,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'complete' END AS status, cast(trunc(value) AS bigint) AS latency_ms, cast(event_id % 3 + 1 AS bigint) AS attempts,
  event_id % 5 = 0 AS cache_hit, json_extract_string(props, '$.k') AS request_chars, ts FROM events"""


def period(x: str) -> str:
    compact = rf"regexp_replace(regexp_replace(upper({x}), '\s+', '', 'g'), '[–—]', '-', 'g')"
    rest = f"regexp_replace(regexp_replace({compact}, '^Q[1-4]', ''), '^FY', '')"
    quarter = f"regexp_extract({compact}, '^(Q[1-4])', 1)"
    start = rf"try_cast(regexp_extract({rest}, '^(20\d{{2}})[-/](\d{{2}}|20\d{{2}})$', 1) AS int)"
    tail = rf"regexp_extract({rest}, '^(20\d{{2}})[-/](\d{{2}}|20\d{{2}})$', 2)"
    end = rf"""CASE WHEN regexp_full_match({rest}, '\d{{2}}') THEN 2000 + try_cast({rest} AS int) WHEN regexp_full_match({rest}, '20\d{{2}}') THEN try_cast({rest} AS int)
      WHEN (CASE WHEN length({tail}) = 4 THEN try_cast({tail} AS int) ELSE ({start} // 100) * 100 + try_cast({tail} AS int) END) = {start} + 1 THEN {start} + 1 END"""
    return f"CASE WHEN trim({x}) = '' THEN NULL ELSE coalesce(({quarter} || 'FY' || cast(({end}) - 1 AS varchar) || '/' || lpad(cast(({end}) % 100 AS varchar), 2, '0')), trim({x})) END"


def modality(x: str, evidence: str) -> str:
    key = f"regexp_replace(regexp_replace(lower({x}), '[^a-z]+', '_', 'g'), '^_+|_+$', '', 'g')"
    name = f"""CASE {key} WHEN 'asserted' THEN 'reported' WHEN 'actual' THEN 'reported' WHEN 'historical' THEN 'reported' WHEN 'estimate' THEN 'estimated'
      WHEN 'projection' THEN 'forecast' WHEN 'projected' THEN 'forecast' WHEN 'forecasted' THEN 'forecast' WHEN 'mandatory' THEN 'required' ELSE {key} END"""
    said = rf"regexp_replace(lower({evidence}), '\s+', ' ', 'g')"
    release = rf"regexp_extract({said}, '\b(first|initial|second|revised|updated)\s+(?:advance\s+)?estimates?\b', 1)"
    return rf"""CASE WHEN {x} IS NULL OR trim({x}) = '' THEN NULL WHEN ({name}) IN ('reported', 'observed', 'estimated') AND coalesce({evidence}, '') <> '' THEN
      CASE WHEN {release} IN ('first', 'initial') THEN 'first_estimate' WHEN {release} <> '' THEN 'revised_estimate'
        WHEN regexp_matches({said}, '\b(?:forecast(?:ed)?|project(?:ed|ion)|expected to)\b') THEN 'forecast'
        WHEN regexp_matches({said}, '\b(?:estimate|estimated|preliminary)\b') THEN 'estimated' ELSE {name} END ELSE {name} END"""


RESOLVED = f"""SELECT *, {period("period")} AS label, {modality("modality", "evidence_text")} AS context, lower(subject) AS lane_subject, lower(predicate) AS lane_predicate FROM claims"""

FAMILY_ID = """concat('fact-', substr(sha256(concat_ws('|', workspace_id, lane_subject, lane_predicate, lower(coalesce(label, '')), lower(coalesce(context, '')),
  lower(coalesce(scope, '')), lower(coalesce(value_type, '')), lower(coalesce(unit, '')))), 1, 24))"""

COMPARED = """SELECT a_id, b_id, a_document_id, b_document_id, same_period, same_context, value_state,
  CASE WHEN NOT same_period THEN 'UNRELATED' WHEN value_state IN ('equal', 'rounding-compatible') THEN 'CORROBORATES'
    WHEN NOT same_context AND (a_context IN ('forecast','guidance','management_guidance')) <> (b_context IN ('forecast','guidance','management_guidance')) THEN 'UNCERTAIN'
    WHEN NOT same_context AND a_context IN ('estimated','first_estimate','preliminary','reported','revised_estimate') AND b_context IN ('estimated','first_estimate','preliminary','reported','revised_estimate') THEN 'RECONCILES'
    WHEN NOT same_context THEN 'UNCERTAIN' ELSE 'CONTRADICTS' END AS type,
  CASE WHEN NOT same_period THEN 0.93::double WHEN value_state IN ('equal', 'rounding-compatible') THEN 0.96::double
    WHEN NOT same_context AND (a_context IN ('forecast','guidance','management_guidance')) <> (b_context IN ('forecast','guidance','management_guidance')) THEN 0.91::double
    WHEN NOT same_context AND a_context IN ('estimated','first_estimate','preliminary','reported','revised_estimate') AND b_context IN ('estimated','first_estimate','preliminary','reported','revised_estimate') THEN 0.90::double
    WHEN NOT same_context THEN 0.72::double WHEN a_context = 'forecast' THEN 0.91::double ELSE 0.84::double END AS confidence
FROM (SELECT *, a_label IS NOT DISTINCT FROM b_label AS same_period, a_context IS NOT DISTINCT FROM b_context AS same_context,
    CASE WHEN a_value IS NULL OR b_value IS NULL THEN 'unknown' WHEN a_value = b_value THEN 'equal'
      WHEN abs(a_value - b_value) * cast(2 * pow(10, greatest(a_precision, b_precision) + CASE WHEN a_type = 'percentage' AND b_type = 'percentage' THEN 2 ELSE 0 END) AS decimal(13,0))
        <= greatest(abs(a_value), abs(b_value), cast(1 AS decimal(24,8))) THEN 'rounding-compatible' ELSE 'different' END AS value_state
  FROM {pairs})"""


def steps(name: str, where: str = "true", limit: int | None = 250) -> str:
    """CTEs {name}_members, _pairs, _compared, _edges, _flags and _facts for the claims that satisfy a condition; needs `resolved`.

    With a limit only so many of a lane's last claims are compared, without one all.
    """
    last = f"WHERE a.rk <= {limit} AND b.rk <= {limit}" if limit else ""
    return f"""{name}_members AS (SELECT *, {FAMILY_ID} AS fact_id FROM resolved WHERE {where}),
{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY lane_subject, lane_predicate ORDER BY id DESC) AS rk FROM {name}_members),
{name}_pairs AS (SELECT a.id AS a_id, b.id AS b_id, a.document_id AS a_document_id, b.document_id AS b_document_id, a.label AS a_label, b.label AS b_label, a.context AS a_context,
    b.context AS b_context, a.value_num AS a_value, b.value_num AS b_value, a.precision AS a_precision, b.precision AS b_precision, a.value_type AS a_type, b.value_type AS b_type
  FROM {name}_ranked a JOIN {name}_ranked b ON a.lane_subject = b.lane_subject AND a.lane_predicate = b.lane_predicate AND a.id < b.id AND a.document_id <> b.document_id
  {last}),
{name}_compared AS ({COMPARED.format(pairs=name + "_pairs")}),
{name}_edges AS (SELECT concat('rel-', substr(sha256(concat_ws('|', a_id, b_id, type)), 1, 24)) AS edge_id, a_id AS claim_a, b_id AS claim_b, type, confidence FROM {name}_compared WHERE type <> 'UNRELATED'),
{name}_flags AS (SELECT a.fact_id, bool_or(type = 'UNCERTAIN') AS uncertain, bool_or(type = 'CONTRADICTS') AS contradicts, bool_or(type = 'RECONCILES') AS reconciles, bool_or(type = 'CORROBORATES') AS corroborates
  FROM {name}_edges e JOIN {name}_members a ON e.claim_a = a.id JOIN {name}_members b ON e.claim_b = b.id WHERE a.fact_id = b.fact_id GROUP BY 1),
{name}_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY coalesce(precision, -1) DESC, created_on DESC, id DESC) AS k FROM {name}_members) WHERE k = 1),
{name}_grouped AS (SELECT fact_id, count(*) AS n_evidence, count(DISTINCT coalesce(cast(value_num AS varchar), '')) AS n_values, bool_and(visual) AS visual_only, max(created_on) AS updated_on, sha256(string_agg(id, ',' ORDER BY created_on, id)) AS members FROM {name}_members GROUP BY 1),
{name}_facts AS (SELECT b.fact_id, b.workspace_id, b.subject, b.predicate, b.label AS period, b.context AS modality, b.scope, b.value_type, b.unit, b.value_num, b.raw_value, b.id AS representative,
    g.n_evidence, g.n_values, g.visual_only, g.updated_on, g.members, CASE WHEN f.uncertain THEN 'UNRESOLVED' WHEN f.contradicts THEN 'CONTESTED' WHEN f.reconciles AND g.n_values > 1 THEN 'UNRESOLVED'
      WHEN f.corroborates THEN 'CORROBORATED' ELSE 'SUPPORTED' END AS status
  FROM {name}_best b JOIN {name}_grouped g USING (fact_id) LEFT JOIN {name}_flags f USING (fact_id))"""


def with_steps(select: str, *parts: str) -> str:
    """A query over the claims and further CTEs."""
    return "WITH claims AS (" + CLAIMS + "),\nresolved AS (" + RESOLVED + ")" + "".join(",\n" + p for p in parts) + "\n" + select


FIRST = "year(created_on) + 20 <= 2018"
STATES = "status, value_num, raw_value, representative, n_evidence, members"
_SAME = " AND ".join(f"o.{c} IS NOT DISTINCT FROM n.{c}" for c in STATES.split(", "))
#: Snapshots after the first and the second revision, versions, current facts and reviews.
REVISIONS = f"""snap1 AS (SELECT fact_id, 1 AS revision, true AS active, {STATES} FROM first_facts),
snap2 AS (SELECT coalesce(n.fact_id, o.fact_id) AS fact_id, coalesce(o.revision, 0) + CASE WHEN n.fact_id IS NOT NULL AND NOT coalesce({_SAME}, false) THEN 1 ELSE 0 END AS revision, n.fact_id IS NOT NULL AS active,
    n.fact_id IS NOT NULL AND NOT coalesce({_SAME}, false) AS changed, CASE WHEN n.fact_id IS NULL THEN 'deactivated' WHEN o.fact_id IS NULL THEN 'new' WHEN {_SAME} THEN 'unchanged' ELSE 'changed' END AS kind,
    {", ".join(f"CASE WHEN n.fact_id IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in STATES.split(", "))}
  FROM snap1 o FULL OUTER JOIN every_facts n ON o.fact_id = n.fact_id),
versions AS (SELECT concat(fact_id, '-v', revision) AS version_id, fact_id, revision, 1 AS knowledge_revision, {STATES} FROM snap1
  UNION ALL SELECT concat(fact_id, '-v', revision), fact_id, revision, 2, {STATES} FROM snap2 WHERE changed),
facts AS (SELECT f.*, s.revision FROM every_facts f JOIN snap2 s USING (fact_id)),
reviews AS (SELECT concat('review-', substr(fact_id, 6)) AS review_id, fact_id, 'prefer' AS action, CASE WHEN substr(fact_id, 7, 1) < '8' THEN revision - 1 ELSE revision END AS based_on_revision,
    CASE WHEN substr(fact_id, 7, 1) < '8' THEN 'stale' ELSE 'active' END AS status, substr(fact_id, 7, 1) < '8' AS stale, DATE '2030-01-01' AS created_on
  FROM facts WHERE status = 'CONTESTED' AND substr(fact_id, 6, 1) = '0')"""
TWO = (steps("first", FIRST), steps("every"), REVISIONS)
#: The same of all claims of a lane.
WHOLE = steps("every", limit=None)
WHOLE_TWO = (steps("first", FIRST, limit=None), WHOLE, REVISIONS)

REQUESTS = """requests AS (SELECT DISTINCT concat_ws('|', subject, coalesce(CASE WHEN part % 7 = 0 THEN NULL ELSE label END, '-')) AS query_id, subject, predicate,
    CASE WHEN part % 7 = 0 THEN NULL ELSE label END AS period, CASE WHEN part % 5 = 0 THEN 'human_preference' ELSE 'strict' END AS policy, CASE WHEN part % 2 = 0 THEN NULL ELSE 1 END AS known_at
  FROM (SELECT *, cast(substr(subject, 6) AS bigint) AS part FROM resolved)
  UNION ALL SELECT concat('Unknown#', i, '|-'), concat('Unknown#', i), 'discount_rate', NULL, 'strict', NULL FROM range(10) t(i))"""

GATE = """matched AS (SELECT q.query_id, q.policy, q.known_at, q.period AS asked, f.* FROM requests q JOIN facts f ON lower(q.subject) = lower(f.subject) AND lower(q.predicate) = lower(f.predicate) AND (q.period IS NULL OR q.period = f.period)),
overlaid AS (SELECT m.query_id, m.policy, m.fact_id, m.period, m.modality, m.scope, m.value_type, m.unit, m.updated_on, m.visual_only,
    CASE WHEN m.known_at IS NULL THEN m.status ELSE v.status END AS status, CASE WHEN m.known_at IS NULL THEN m.value_num ELSE v.value_num END AS value_num,
    CASE WHEN m.known_at IS NULL THEN m.n_evidence ELSE v.n_evidence END AS n_evidence, v.version_id,
    row_number() OVER (PARTITION BY m.query_id, m.fact_id ORDER BY CASE WHEN m.known_at IS NOT NULL THEN v.knowledge_revision END DESC, v.revision DESC) AS k
  FROM matched m LEFT JOIN versions v ON v.fact_id = m.fact_id WHERE m.known_at IS NULL OR v.knowledge_revision <= m.known_at),
seen AS (SELECT o.*, r.review_id, r.created_on AS reviewed, coalesce(s.stale, false) AS has_stale,
    row_number() OVER (PARTITION BY o.query_id ORDER BY o.updated_on DESC, o.fact_id DESC) AS ord,
    row_number() OVER (PARTITION BY o.query_id ORDER BY (r.review_id IS NULL), r.created_on DESC, r.review_id DESC, o.fact_id DESC) AS pref
  FROM overlaid o LEFT JOIN (SELECT r.* FROM reviews r JOIN facts f USING (fact_id) WHERE r.status = 'active' AND NOT r.stale AND r.based_on_revision = f.revision) r ON r.fact_id = o.fact_id
  LEFT JOIN (SELECT DISTINCT fact_id, true AS stale FROM reviews WHERE stale OR status = 'stale') s ON s.fact_id = o.fact_id WHERE o.k = 1),
grouped AS (SELECT query_id, count(*) AS n, count(DISTINCT coalesce(period, chr(0))) AS periods,
    count(DISTINCT concat_ws(chr(1), coalesce(period, chr(0)), coalesce(modality, chr(0)), coalesce(scope, chr(0)), coalesce(value_type, chr(0)), coalesce(unit, chr(0)))) AS contexts,
    count(DISTINCT coalesce(cast(value_num AS varchar), '')) AS distinct_values, bool_and(visual_only) AS all_visual, bool_and(status = 'CORROBORATED') AS all_corroborated, bool_and(status IN ('SUPPORTED', 'CORROBORATED')) AS all_good,
    bool_or(status IN ('CONTESTED', 'UNRESOLVED')) AS any_bad, bool_or(status = 'UNRESOLVED') AS any_unresolved, bool_or(has_stale) AS any_stale, sum(n_evidence) AS all_evidence,
    max(CASE WHEN ord = 1 THEN fact_id END) AS first_fact, max(CASE WHEN ord = 1 THEN status END) AS first_status, max(CASE WHEN ord = 1 THEN value_num END) AS first_value, max(CASE WHEN ord = 1 THEN n_evidence END) AS first_evidence,
    max(CASE WHEN pref = 1 THEN review_id END) AS review_id, max(CASE WHEN pref = 1 THEN fact_id END) AS picked_fact, max(CASE WHEN pref = 1 THEN value_num END) AS picked_value FROM seen GROUP BY 1),
flagged AS (SELECT q.query_id, q.period AS asked, g.*, g.n > 1 AND contexts = 1 AND all_good AND (distinct_values <= 1 OR all_corroborated) AS several, any_bad OR distinct_values > 1 AS troubled,
    (any_bad OR distinct_values > 1) AND q.policy = 'human_preference' AND review_id IS NOT NULL AS human, m.query_id IS NOT NULL AS matched
  FROM requests q LEFT JOIN (SELECT * EXCLUDE (query_id), query_id AS gq FROM grouped) g ON g.gq = q.query_id LEFT JOIN (SELECT DISTINCT query_id FROM matched) m ON m.query_id = q.query_id),
decided AS (SELECT *, CASE WHEN n IS NULL THEN 'not_found' WHEN asked IS NULL AND periods > 1 THEN 'needs_context' WHEN all_visual THEN 'needs_review' WHEN several OR human THEN 'allow' WHEN troubled THEN 'block' WHEN first_evidence = 0 THEN 'needs_review' ELSE 'allow' END AS decision FROM flagged),
decisions AS (SELECT query_id, decision, decision = 'allow' AS safe_to_use,
    CASE WHEN n IS NULL AND NOT matched THEN 'NO_MATCH' WHEN n IS NULL THEN 'NO_MATCH_AT_REVISION' WHEN asked IS NULL AND periods > 1 THEN 'PERIOD_REQUIRED' WHEN all_visual THEN 'VISUAL_EVIDENCE_REQUIRES_REVIEW'
      WHEN several THEN CASE WHEN all_corroborated THEN 'GROUNDED,CORROBORATED' ELSE 'GROUNDED' END WHEN human THEN 'GROUNDED,HUMAN_PREFERENCE'
      WHEN troubled THEN concat('CONTESTED_OR_MULTIPLE', CASE WHEN any_unresolved THEN ',UNRESOLVED_CONTEXT' ELSE '' END, CASE WHEN any_stale THEN ',STALE_REVIEW' ELSE '' END)
      WHEN first_evidence = 0 THEN 'NO_EVIDENCE' WHEN first_status = 'CORROBORATED' THEN 'GROUNDED,CORROBORATED' ELSE 'GROUNDED' END AS reasons,
    CASE WHEN decision = 'allow' THEN CASE WHEN human AND NOT several THEN picked_fact ELSE first_fact END END AS fact_id,
    cast(CASE WHEN decision = 'allow' THEN CASE WHEN human AND NOT several THEN picked_value ELSE first_value END END AS double) AS value,
    coalesce(n, 0) AS n_candidates, cast(CASE WHEN decision = 'allow' THEN CASE WHEN several THEN all_evidence ELSE first_evidence END END AS bigint) AS n_evidence FROM decided)"""
