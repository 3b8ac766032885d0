"""Taxonomy resolution, review queue and decisions on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide import fixed
from jobtide.functions.text import norm_key
from jobtide.operators import governance, taxonomy
from jobtide.operators.upsert import missing_rows
from jobtide.testbed import cleaning
from jobtide.testbed import model as M
from jobtide.testbed.model import duck, portable, with_model

_NONE = "CAST(NULL AS STRING)"
_NOW = "2030-01-01 00:00:00"
# Raw values: one per event, over the three dimensions plus null-like texts.
VALUES = f"""SELECT event_id, dimension, CASE WHEN event_id % 19 = 0 THEN ' null ' WHEN event_id % 23 = 0 THEN '  ' WHEN event_id % 29 = 0 THEN NULL
      WHEN dimension = 'skill' THEN skill WHEN dimension = 'role' THEN role ELSE capability END AS raw_value
    FROM (SELECT *, CASE event_id % 7 % 3 WHEN 0 THEN 'skill' WHEN 1 THEN 'capability' ELSE 'role' END AS dimension FROM ({cleaning._NAMES}) a) b"""
CANON = f"""SELECT DISTINCT 'skill' AS dimension, 's-' || event_type AS id, upper(event_type) AS name, event_type AS normalized_name, {_NONE} AS merged_into_id
      FROM {{events}} WHERE event_type <> 'error'
    UNION ALL SELECT DISTINCT 'role', 'r-' || event_type, event_type || ' Engineer', event_type || ' engineer',
      CASE event_type WHEN 'click' THEN 'r-view' WHEN 'view' THEN 'r-signup' END FROM {{events}} WHERE event_type <> 'error'
    UNION ALL SELECT DISTINCT 'capability', 'c-' || event_type, 'Evaluate ' || event_type, 'evaluate ' || event_type, {_NONE} FROM {{events}} WHERE event_type = 'click'
    UNION ALL SELECT 'skill', 's-lc', 'LangChain', 'langchain', {_NONE} UNION ALL SELECT 'skill', 's-pg', 'PostgreSQL', 'postgresql', {_NONE}
    UNION ALL SELECT 'capability', 'c-rag', 'Build RAG Systems', 'build rag systems', {_NONE}
    UNION ALL SELECT 'capability', 'c-mcp', 'Implement MCP Integrations', 'implement mcp integrations', {_NONE}
    UNION ALL SELECT 'role', 'r-gen', 'Generative AI Engineer', 'generative ai engineer', {_NONE}"""
ALIASES = """SELECT 'skill' AS dimension, 'Lang Chain' AS alias_text, 'lang chain' AS normalized_alias_text, 's-lc' AS canonical_id, 'seed' AS source
    UNION ALL SELECT 'skill', 'postgres', 'postgres', 's-pg', 'seed' UNION ALL SELECT 'role', 'GenAI Engineer', 'genai engineer', 'r-gen', 'seed'
    UNION ALL SELECT 'role', 'LLM Engineer', 'llm engineer', 'r-click', 'human_approved'
    UNION ALL SELECT 'capability', 'fragile', 'fragile', 'c-rag', 'human_approved'"""
_BAD_ALIASES = ALIASES + " UNION ALL SELECT 'skill', 'Kafka', 'kafka', 's-gone', 'seed' UNION ALL SELECT 'role', 'aws', 'aws', 's-lc', 'seed'"
QUEUE = f"""SELECT CAST(c_custkey AS STRING) AS id, CASE c_nationkey % 4 WHEN 0 THEN 'skill' WHEN 1 THEN 'capability' WHEN 2 THEN 'role' ELSE 'seniority' END AS dimension,
      ' ' || c_name AS raw_value, lower(c_name) AS normalized_raw_value, CASE c_custkey % 7 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status,
      CASE WHEN c_custkey % 3 = 0 THEN 'note ' || c_mktsegment END AS notes, CAST(NULL AS TIMESTAMP_NTZ) AS resolved_at FROM {{customer}}""".replace("{{", "{").replace("}}", "}")
_QUEUE_D = QUEUE.replace("TIMESTAMP_NTZ", "TIMESTAMP")
_ITEM_ALIASES = ALIASES + """ UNION ALL SELECT 'skill', c_name, lower(c_name), CASE WHEN c_custkey % 2 = 0 THEN 's-lc' ELSE 's-pg' END, 'seed'
    FROM {customer} WHERE c_custkey % 5 = 0"""
DECISIONS = """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 53 = 0 THEN 'gone' ELSE CAST(o_custkey AS STRING) END AS queue_item_id,
      CASE o_orderkey % 6 WHEN 0 THEN 's-lc' WHEN 1 THEN 'c-rag' WHEN 2 THEN 'r-click' WHEN 3 THEN 'r-gen' WHEN 4 THEN 'none' ELSE 's-pg' END AS canonical_id,
      CASE WHEN o_orderkey % 4 = 0 THEN 'by ' || o_orderpriority END AS notes FROM {orders}"""
RESOLUTIONS = """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 53 = 0 THEN 'gone' ELSE CAST(o_custkey AS STRING) END AS queue_item_id,
      CASE o_orderkey % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'later' WHEN 2 THEN 'rejected' END AS status,
      CASE WHEN o_orderkey % 4 = 0 THEN 'by ' || o_orderpriority END AS notes FROM {orders}"""
# Chains of up to nine hops, dangling pointers and a cycle in every hundred.
CHAINS = """SELECT CAST(c_custkey AS STRING) AS id, c_name AS name, CASE WHEN c_custkey % 100 = 95 THEN 'gone' WHEN c_custkey % 100 = 41 THEN CAST(c_custkey + 1 AS STRING)
      WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey - 1 AS STRING) END AS merged_into_id FROM {customer}"""
ROLE_POOL = """SELECT CAST(c_custkey AS STRING) AS id, c_name AS name, CASE WHEN c_custkey % 10 = 1 THEN CAST(c_custkey - 1 AS STRING) END AS merged_into_id FROM {customer}"""
MERGES = """SELECT o_orderkey AS seq, CAST(o_custkey AS STRING) AS source_id, CASE WHEN o_orderkey % 31 = 0 THEN CAST(o_custkey AS STRING) WHEN o_orderkey % 37 = 0 THEN 'gone'
      ELSE CAST(CAST(floor(o_totalprice) AS INT) % 1000 AS STRING) END AS target_id FROM {orders} WHERE o_orderstatus = 'O'"""
# Sightings in (file, pos) order with many repeats of a value.
SIGHTINGS = """SELECT 'f' || lpad(CAST(p_size AS STRING), 3, '0') AS file, p_partkey AS pos, CAST(p_partkey AS STRING) AS job_id,
      CASE p_partkey % 3 WHEN 0 THEN 'skill' WHEN 1 THEN 'capability' ELSE 'role' END AS dimension,
      CASE p_partkey % 11 WHEN 0 THEN 'Build ' || p_name || ' agents' WHEN 1 THEN 'Build AI Agents' WHEN 2 THEN ' ' || upper(p_name) WHEN 3 THEN 'null'
        WHEN 4 THEN 'multi agent ' || p_name WHEN 5 THEN 'Design Multi-Agent Systems' WHEN 6 THEN 'deploy ' || p_name WHEN 7 THEN '' ELSE p_name END AS raw_value
    FROM {part}"""
_SEEN_CANON = f"""SELECT 'skill' AS dimension, 'k1' AS id, 'Red Bolt' AS name, 'red bolt' AS normalized_name, {_NONE} AS merged_into_id
    UNION ALL SELECT 'capability', 'k2', 'Deploy AI Applications', 'deploy ai applications', {_NONE} UNION ALL SELECT 'role', 'k3', 'Blue Gear', 'blue gear', {_NONE}"""
_SEEN_ALIASES = "SELECT 'skill' AS dimension, 'Old Anvil' AS alias_text, 'old anvil' AS normalized_alias_text, 'k1' AS canonical_id, 'seed' AS source"
_SEEN_QUEUE = "SELECT 'skill' AS dimension, 'Small Ring' AS raw_value, 'small ring' AS normalized_raw_value, 'pending' AS status UNION ALL SELECT 'role', 'New Bolt', 'new bolt', 'rejected'"

_NORM = M.NORM
_DROPPED = "(raw_value IS NULL OR trim(raw_value) = '' OR lower(trim(raw_value)) = 'null')"


def _rule_case(column: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({column}, '{p}', 'i') THEN '{n}'" for p, n in fixed.CAPABILITY_RULES)
    return f"CASE {whens} END"


# Role targets two hops away: click -> view -> signup.
_FINALS = """SELECT c.dimension, c.id, c.normalized_name, coalesce(d2.id, d1.id, c.id) AS final_id, coalesce(d2.name, d1.name, c.name) AS final_name
    FROM canon c LEFT JOIN canon d1 ON d1.dimension = 'role' AND c.dimension = 'role' AND d1.id = c.merged_into_id
    LEFT JOIN canon d2 ON d2.dimension = 'role' AND c.dimension = 'role' AND d2.id = d1.merged_into_id"""
_RESOLVED = f"""SELECT v.*, CASE WHEN dropped THEN NULL ELSE {_NORM.format("raw_value")} END AS normalized_value,
      CASE WHEN dropped THEN 'dropped_null_like' WHEN e.id IS NOT NULL THEN 'exact_match' WHEN a.canonical_id IS NOT NULL THEN 'alias_match'
        WHEN r.id IS NOT NULL THEN 'rule_match' WHEN v.rule_label IS NOT NULL THEN 'rule_match_entity_missing' ELSE 'unresolved' END AS normalization_method,
      CASE WHEN dropped THEN NULL WHEN e.id IS NOT NULL THEN e.final_id WHEN a.canonical_id IS NOT NULL THEN t.final_id ELSE r.final_id END AS canonical_id,
      CASE WHEN dropped THEN NULL WHEN e.id IS NOT NULL THEN e.final_name WHEN a.canonical_id IS NOT NULL THEN t.final_name ELSE coalesce(r.final_name, v.rule_label) END AS canonical_name
    FROM (SELECT *, {_DROPPED} AS dropped, CASE WHEN dimension = 'capability' AND NOT {_DROPPED} THEN {_rule_case("raw_value")} END AS rule_label FROM vals) v
    LEFT JOIN finals e ON NOT dropped AND e.dimension = v.dimension AND e.normalized_name = {_NORM.format("v.raw_value")}
    LEFT JOIN aliases a ON NOT dropped AND a.dimension = v.dimension AND a.normalized_alias_text = {_NORM.format("v.raw_value")}
    LEFT JOIN finals t ON t.dimension = a.dimension AND t.id = a.canonical_id
    LEFT JOIN finals r ON r.dimension = 'capability' AND r.normalized_name = lower(v.rule_label)"""
_WITH = with_model(vals=VALUES, canon=CANON, aliases=ALIASES) + f", finals AS ({_FINALS}), resolved AS ({_RESOLVED})"
_REVIEW_NOTE = """'Deterministic rule suggests canonical name "' || canonical_name || '", which has no matching row yet in the canonical table.'"""

_TABLES = "CASE q.dimension WHEN 'skill' THEN 'skills' WHEN 'capability' THEN 'capabilities' WHEN 'role' THEN 'roles' END"
_JUDGED = f"""SELECT d.*, q.id AS item, q.dimension, q.raw_value, q.normalized_raw_value, q.notes AS old_notes, f.final_id, f.final_name, a.canonical_id AS aliased_to, {_TABLES} AS tbl,
      CASE WHEN q.id IS NULL THEN 'item_not_found' WHEN q.status <> 'pending' THEN 'not_pending' WHEN q.dimension = 'seniority' THEN 'unsupported_dimension'
        WHEN f.id IS NULL THEN 'target_missing' WHEN a.canonical_id <> f.final_id THEN 'alias_conflict' END AS own_error
    FROM decisions d LEFT JOIN queue q ON q.id = d.queue_item_id LEFT JOIN finals f ON f.dimension = q.dimension AND f.id = d.canonical_id
    LEFT JOIN aliases a ON a.dimension = q.dimension AND a.normalized_alias_text = q.normalized_raw_value"""
_APPROVE = (
    with_model(canon=CANON, aliases=_ITEM_ALIASES, queue=_QUEUE_D, decisions=DECISIONS)
    + f""", finals AS ({_FINALS}), j AS ({_JUDGED}), winner AS (SELECT queue_item_id, min(seq) AS seq FROM j WHERE own_error IS NULL GROUP BY 1),
    judged AS (SELECT j.*, CASE WHEN own_error IS NOT NULL THEN own_error WHEN w.seq < j.seq THEN 'not_pending' END AS error_code
      FROM j LEFT JOIN winner w USING (queue_item_id)), good AS (SELECT * FROM judged WHERE error_code IS NULL)"""
)


def _parts(s, d):
    return (
        portable(s, d, QUEUE), portable(s, d, DECISIONS), portable(s, d, CANON), portable(s, d, _ITEM_ALIASES),
        F.lit(_NOW).cast("timestamp_ntz"),
    )


def _resolve(s, d):
    return taxonomy.resolve_taxonomy(portable(s, d, VALUES), portable(s, d, CANON), portable(s, d, ALIASES))


def _novel(s, d):
    return taxonomy.novel_values(portable(s, d, SIGHTINGS), portable(s, d, _SEEN_CANON), portable(s, d, _SEEN_ALIASES))


# A sighting is novel when nothing it could match existed before its turn.
_NOVEL = (
    with_model(seen=_SEEN_CANON, seen_aliases=_SEEN_ALIASES, s0=SIGHTINGS)
    + f""", s AS (SELECT *, {_DROPPED} AS dropped, {_NORM.format("coalesce(raw_value, '')")} AS own_key,
        CASE WHEN dimension = 'capability' THEN {_rule_case("trim(raw_value)")} END AS rule_label, row_number() OVER (ORDER BY file, pos) AS turn FROM s0),
    c AS (SELECT *, lower(coalesce(rule_label, own_key)) AS made_key FROM s),
    made AS (SELECT dimension, made_key, min(turn) AS made_at FROM c GROUP BY 1, 2),
    novel AS (SELECT c.* FROM c LEFT JOIN made m1 ON m1.dimension = c.dimension AND m1.made_key = c.own_key
        LEFT JOIN made m2 ON m2.dimension = c.dimension AND m2.made_key = c.made_key
      WHERE NOT dropped AND NOT coalesce(m1.made_at < c.turn, false) AND NOT (m2.made_at < c.turn)
        AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.dimension = c.dimension AND seen.normalized_name IN (c.own_key, c.made_key))
        AND NOT EXISTS (SELECT 1 FROM seen_aliases a WHERE a.dimension = c.dimension AND a.normalized_alias_text = c.own_key))"""
)

_MERGE_CHECKS = (
    with_model(roles=ROLE_POOL, merges=MERGES)
    + """, j AS (SELECT m.*, CASE WHEN m.source_id = m.target_id THEN 'self_merge' WHEN s.id IS NULL THEN 'source_missing' WHEN t.id IS NULL THEN 'target_missing'
        WHEN s.merged_into_id IS NOT NULL THEN 'source_already_merged' WHEN t.merged_into_id IS NOT NULL THEN 'target_not_active'
        WHEN EXISTS (SELECT 1 FROM roles x WHERE x.merged_into_id = m.source_id) THEN 'source_has_dependents' END AS own_error
      FROM merges m LEFT JOIN roles s ON s.id = m.source_id LEFT JOIN roles t ON t.id = m.target_id),
    v AS (SELECT * FROM j WHERE own_error IS NULL),
    judged AS (SELECT seq, source_id, target_id, CASE WHEN own_error IS NOT NULL THEN own_error
        WHEN EXISTS (SELECT 1 FROM v WHERE v.source_id = j.source_id AND v.seq < j.seq) OR EXISTS (SELECT 1 FROM v WHERE v.target_id = j.source_id AND v.seq < j.seq)
          OR EXISTS (SELECT 1 FROM v WHERE v.source_id = j.target_id AND v.seq < j.seq) THEN 'collides_in_batch' END AS error_code FROM j)"""
)


def _review(s, d):
    rows = _resolve(s, d).withColumn("job_id", F.col("event_id"))
    queue = portable(s, d, "SELECT 'skill' AS dimension, 'kafka' AS normalized_raw_value, 'pending' AS status UNION ALL SELECT 'role', 'error engineer', 'approved'")
    return taxonomy.review_rows(rows), queue


def _review_candidates(s, d):
    resolved = _resolve(s, d).withColumn("job_id", F.col("event_id"))
    queue = portable(s, d, "SELECT 'skill' AS dimension, 'kafka' AS normalized_raw_value, 'pending' AS status UNION ALL SELECT 'role', 'error engineer', 'approved'")
    return taxonomy.review_candidates(resolved, queue, [F.col("first_seen_job_id").cast("long")])


QUERIES = {
    "resolve_taxonomy": (
        lambda s, d: _resolve(s, d).drop("error"),
        _WITH + """SELECT event_id, dimension, raw_value, normalized_value, canonical_id, canonical_name, normalization_method,
            normalization_method IN ('unresolved', 'rule_match_entity_missing') AS requires_review FROM resolved""",
    ),
    "resolve_taxonomy_errors": (
        lambda s, d: taxonomy.resolve_taxonomy(
            portable(s, d, VALUES).withColumn("dimension", F.when(F.col("event_id") % 10 == 7, "seniority").otherwise(F.col("dimension"))),
            portable(s, d, CANON), portable(s, d, _BAD_ALIASES), strict=False,
        ).filter("error IS NOT NULL").select("event_id", "dimension", "raw_value", "error"),
        with_model(vals=VALUES) + f"""SELECT event_id, CASE WHEN event_id % 10 = 7 THEN 'seniority' ELSE dimension END AS dimension, raw_value,
            CASE WHEN event_id % 10 = 7 THEN 'unsupported_dimension' ELSE 'alias_target_missing' END AS error
            FROM vals WHERE event_id % 10 = 7 OR (NOT {_DROPPED} AND dimension = 'skill' AND {_NORM.format("raw_value")} = 'kafka')""",
    ),
    "alias_integrity": (
        lambda s, d: taxonomy.alias_integrity(portable(s, d, _BAD_ALIASES), portable(s, d, CANON)),
        with_model(a=_BAD_ALIASES, c=CANON) + """SELECT dimension, normalized_alias_text, canonical_id FROM a
            WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.dimension = a.dimension AND c.id = a.canonical_id)""",
    ),
    "follow_merges": (
        lambda s, d: taxonomy.follow_merges(portable(s, d, CHAINS)).select("id", "final_id", "final_name", "error"),
        "WITH RECURSIVE r AS MATERIALIZED (" + duck(CHAINS) + """), w AS (SELECT id AS start, id AS here, name, merged_into_id AS nxt, 0 AS hops, false AS lost FROM r
            UNION ALL SELECT w.start, coalesce(r.id, w.here), coalesce(r.name, w.name), r.merged_into_id, w.hops + 1, r.id IS NULL
              FROM w LEFT JOIN r ON r.id = w.nxt WHERE w.nxt IS NOT NULL AND NOT w.lost AND w.hops < 5)
            SELECT start AS id, CASE WHEN NOT lost AND nxt IS NULL THEN here END AS final_id, CASE WHEN NOT lost AND nxt IS NULL THEN name END AS final_name,
              CASE WHEN lost THEN 'missing_target' WHEN nxt IS NOT NULL THEN 'too_many_hops' END AS error
            FROM w QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops DESC) = 1""",
    ),
    "review_rows": (
        lambda s, d: _review(s, d)[0],
        _WITH + f"""SELECT dimension, raw_value, normalized_value AS normalized_raw_value, CAST(NULL AS VARCHAR) AS suggested_canonical_id,
            CAST(event_id AS VARCHAR) AS first_seen_job_id, CASE WHEN normalization_method = 'unresolved' THEN 'new_unreviewed' ELSE 'suggested_alias' END AS queue_reason,
            CASE WHEN normalization_method = 'unresolved' THEN 'low' ELSE 'medium' END AS confidence, 'pending' AS status,
            CASE WHEN normalization_method <> 'unresolved' THEN {_REVIEW_NOTE} END AS notes
            FROM resolved WHERE normalization_method IN ('unresolved', 'rule_match_entity_missing')""",
    ),
    "review_candidates": (
        lambda s, d: _review_candidates(s, d).select("dimension", "raw_value", "normalized_raw_value", "first_seen_job_id", "queue_reason"),
        _WITH + """SELECT dimension, raw_value, normalized_value AS normalized_raw_value, CAST(event_id AS VARCHAR) AS first_seen_job_id,
            CASE WHEN normalization_method = 'unresolved' THEN 'new_unreviewed' ELSE 'suggested_alias' END AS queue_reason
            FROM resolved WHERE normalization_method IN ('unresolved', 'rule_match_entity_missing') AND NOT (dimension = 'skill' AND normalized_value = 'kafka')
            QUALIFY row_number() OVER (PARTITION BY dimension, normalized_value ORDER BY event_id) = 1""",
    ),
    "novel_values": (
        lambda s, d: _novel(s, d).select("file", "pos", "dimension", "raw_value", "normalization_method"),
        _NOVEL + """SELECT file, pos, dimension, raw_value, CASE WHEN rule_label IS NULL THEN 'unresolved' ELSE 'rule_match_entity_missing' END AS normalization_method FROM novel""",
    ),
    "novel_queue": (
        lambda s, d: taxonomy.queue_novel(
            portable(s, d, _SEEN_QUEUE), portable(s, d, SIGHTINGS), portable(s, d, _SEEN_CANON), portable(s, d, _SEEN_ALIASES),
            F.lit(_NOW).cast("timestamp_ntz"),
        ),
        _NOVEL + f""", q AS ({duck(_SEEN_QUEUE)}) SELECT * FROM q UNION ALL (SELECT dimension, raw_value, own_key, 'pending' FROM novel
            WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.status = 'pending' AND q.dimension = novel.dimension AND q.normalized_raw_value = novel.own_key)
            QUALIFY row_number() OVER (PARTITION BY dimension, own_key ORDER BY turn) = 1)""",
    ),
    "approve_alias_queue": (
        lambda s, d: governance.apply_approvals(*_parts(s, d))[0],
        _APPROVE + f"""SELECT q.id, q.dimension, q.raw_value, q.normalized_raw_value, CASE WHEN g.item IS NOT NULL THEN 'approved' ELSE q.status END AS status,
            CASE WHEN g.item IS NULL THEN q.notes ELSE coalesce(q.notes || ' | ', '')
              || CASE WHEN g.aliased_to IS NULL THEN 'Approved as alias of "' || g.final_name || '" (' || g.tbl || '.id=' || g.final_id || ').'
                 ELSE 'Approved - alias for "' || q.normalized_raw_value || '" already existed pointing at "' || g.final_name || '" (' || g.tbl || '.id=' || g.final_id || ').' END
              || CASE WHEN g.final_id <> g.canonical_id THEN ' (requested target "' || g.canonical_id || '" has been merged into "' || g.final_name
                   || '" - alias stored pointing at the final active target instead.)' ELSE '' END || coalesce(' ' || g.notes, '') END AS notes,
            CASE WHEN g.item IS NOT NULL THEN '{_NOW}' END AS resolved_at FROM queue q LEFT JOIN good g ON g.item = q.id""",
    ),
    "approve_alias": (
        lambda s, d: governance.apply_approvals(*_parts(s, d))[1],
        _APPROVE + """SELECT * FROM aliases UNION ALL SELECT dimension, raw_value, normalized_raw_value, final_id, 'human_approved' FROM good WHERE aliased_to IS NULL""",
    ),
    "approve_alias_errors": (
        lambda s, d: governance.apply_approvals(*_parts(s, d))[2],
        _APPROVE + "SELECT seq, queue_item_id, canonical_id, error_code FROM judged WHERE error_code IS NOT NULL",
    ),
    "resolve_without_alias": (
        lambda s, d: governance.apply_resolutions(portable(s, d, QUEUE), portable(s, d, RESOLUTIONS), F.lit(_NOW).cast("timestamp_ntz"))[0],
        with_model(queue=_QUEUE_D, r=RESOLUTIONS) + f""", g AS (SELECT r.* FROM r JOIN queue q ON q.id = r.queue_item_id AND q.status = 'pending'
              WHERE coalesce(r.status, 'rejected') <> 'later' QUALIFY row_number() OVER (PARTITION BY queue_item_id ORDER BY seq) = 1)
            SELECT q.id, q.dimension, q.raw_value, q.normalized_raw_value, CASE WHEN g.seq IS NULL THEN q.status ELSE coalesce(g.status, 'rejected') END AS status,
              CASE WHEN g.notes IS NULL THEN q.notes ELSE coalesce(q.notes || ' | ', '') || g.notes END AS notes,
              CASE WHEN g.seq IS NOT NULL THEN '{_NOW}' END AS resolved_at FROM queue q LEFT JOIN g ON g.queue_item_id = q.id""",
    ),
    "resolve_without_alias_errors": (
        lambda s, d: governance.apply_resolutions(portable(s, d, QUEUE), portable(s, d, RESOLUTIONS), F.lit(_NOW).cast("timestamp_ntz"))[1],
        with_model(queue=_QUEUE_D, r=RESOLUTIONS) + """, g AS (SELECT queue_item_id, min(seq) AS seq FROM r JOIN queue q ON q.id = r.queue_item_id AND q.status = 'pending'
              WHERE coalesce(r.status, 'rejected') <> 'later' GROUP BY 1)
            SELECT * FROM (SELECT r.seq, r.queue_item_id, CASE WHEN r.status = 'later' THEN 'invalid_status' WHEN q.id IS NULL THEN 'item_not_found'
              WHEN q.status <> 'pending' OR g.seq < r.seq THEN 'not_pending' END AS error_code
            FROM r LEFT JOIN queue q ON q.id = r.queue_item_id LEFT JOIN g ON g.queue_item_id = r.queue_item_id) WHERE error_code IS NOT NULL""",
    ),
    "merge_role_checks": (
        lambda s, d: governance.judge_role_merges(portable(s, d, ROLE_POOL), portable(s, d, MERGES)),
        _MERGE_CHECKS + "SELECT * FROM judged",
    ),
    "role_merge_apply": (
        lambda s, d: governance.apply_role_merges(portable(s, d, ROLE_POOL), portable(s, d, MERGES))[0],
        _MERGE_CHECKS + """SELECT r.id, r.name, coalesce(r.merged_into_id, j.target_id) AS merged_into_id
            FROM roles r LEFT JOIN judged j ON j.source_id = r.id AND j.error_code IS NULL""",
    ),
    "missing_keys": (
        lambda s, d: missing_rows(
            M.table(s, d, "customer").select(norm_key("c_mktsegment").alias("k")).distinct().filter("k <> 'building'"),
            M.table(s, d, "customer").select(norm_key("c_mktsegment").alias("k"), "c_name"), ["k"]),
        "SELECT lower(c_mktsegment) AS k, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    ),
}
