"""Documents built from the orders table: classify, parse, project, upsert."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobtide import fixed
from jobtide.operators import firsts, project, upsert
from jobtide.session import shared_dir
from jobtide.sources import documents as D
from jobtide.testbed import model as M
from jobtide.testbed.model import duck, portable, with_model

# One JSON document per order; every 17th-class breaks in its own way.
_BODY = r"""'{{"job_metadata": {{"job_id": ' || k || ', "title": ' || CASE o_orderkey % 5 WHEN 0 THEN '" Null "' WHEN 1 THEN 'null' ELSE '"' || c_name || '"' END
  || ', "company": "' || c_name || '", "location": ' || CASE o_orderkey % 3 WHEN 0 THEN '"' || n_name || ', ' || c_mktsegment || ' , "' WHEN 1 THEN '"Remote"' ELSE 'null' END
  || CASE o_orderkey % 17 WHEN 3 THEN ', "city": "' || repeat('x', 101) || '"' ELSE '' END
  || ', "applicants": ' || CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 977 AS STRING) || '.9' WHEN 1 THEN '"Over 1,' || lpad(CAST(o_orderkey % 977 AS STRING), 3, '0') || ' applicants"' WHEN 2 THEN '"n/a"' ELSE 'null' END
  || CASE o_orderkey % 2 WHEN 0 THEN ', "job_type": "Full"' ELSE ', "employment_type": "null", "employmentType": "Part"' END
  || ', "postedAt": "' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '"}}'
  || ', "skills": {{"zeta": ["RAG", "Brand ' || CAST(o_orderkey % 7 AS STRING) || '", 5, "", null], "alpha": ["rag", " Lang  Chain ", "Tool ' || CAST(o_orderkey % 11 AS STRING)
  || '"], "none": null, "odd": "text", "beta": ["brand ' || CAST(o_orderkey % 7 AS STRING) || '", "Beta ' || CAST(o_orderkey % 3 AS STRING) || '"]}}'
  || ', "skill_priority": {{"critical": ["langchain", "Machine Learning"], "important": ["Rag", "LANG CHAIN", "Tool ' || CAST(o_orderkey % 3 AS STRING) || '"], "preferred": ["brand 1", "rag"]}}'
  || ', "capabilities": ["Build RAG bots", "Mentor ' || c_mktsegment || '", null, 4, "", "RAG apps", "mentor  ' || lower(c_mktsegment) || '"]'
  || ', "role_analysis": {{"actual_role_category": ' || CASE o_orderkey % 3 WHEN 0 THEN '" gen ai  engineer "' WHEN 1 THEN 'null' ELSE '"Data ' || c_mktsegment || '"' END
  || ', "advertised_role_category": "Fallback", "seniority_inferred": ' || CASE o_orderkey % 4 WHEN 0 THEN '"Mid-Senior level"' WHEN 1 THEN '"unknown"' WHEN 2 THEN '"Director"' ELSE 'null' END
  || ', "experience_required": {{"minimum_years": ' || CASE o_orderkey % 5 WHEN 0 THEN '"3-5"' WHEN 1 THEN '7' WHEN 2 THEN '"8+"' ELSE 'null' END
  || ', "maximum_years": ' || CASE o_orderkey % 2 WHEN 0 THEN '"10"' ELSE 'null' END || ', "preferred_years": "2-4"}}}}'
  || ', "production_requirements": {{"cloud": ' || CASE o_orderkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN '"Implied"' WHEN 2 THEN '[]' WHEN 3 THEN '["x"]' WHEN 4 THEN '"no"' ELSE 'null' END
  || ', "cicd": false}}, "engineering_requirements": {{"testing": true}}, "domain_analysis": {{"domain_expertise_required": "implied"}}'
  || CASE o_orderkey % 3 WHEN 0 THEN ', "ai_lifecycle_coverage": ["a"]' WHEN 1 THEN ', "ai_lifecycle_coverage": {{"evaluation": "implied", "deployment": false}}' ELSE '' END || '}}'"""
DOCS = (
    """SELECT o_orderkey, lpad(k, 12, '0') || '.json' AS file,
    CASE o_orderkey % 17 WHEN 0 THEN '{{bad' WHEN 1 THEN '[]' WHEN 2 THEN '{{"job_metadata": {{"job_id": ""}}}}' ELSE """
    + _BODY
    + """ || CASE o_orderkey % 17 WHEN 4 THEN ' x' ELSE '' END END AS raw
  FROM {rows}"""
)
_DOC_ROWS = """SELECT o_orderkey, o_orderdate, CAST(o_orderkey AS STRING) AS k, c_name, c_mktsegment, n_name
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""
#: Documents of a task, few enough for its share of the text to be some ten megabytes at any size of the table.
DOCS_PER_TASK = 20_000
_SRC = """SELECT o_orderkey AS k, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '.json' AS file, CAST(o_orderkey AS VARCHAR) AS job_id,
    o_orderdate, c_name, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
_OK = f"(SELECT * FROM ({_SRC}) WHERE k % 17 > 4)"


# Columns with a width: one value of each as long as its column, or one character longer.
_WIDE = {
    "external_job_id": ("external_job_id", "job_id"), "city": ("city", "city"), "state": ("state", "state"), "country": ("country", "country"),
    "employment_type": ("employment_type", "employment_type"), "advertised_role": ("role", "advertised_role"), "actual_role": ("role", "actual_role_category"),
    "seniority": ("seniority", "seniority_inferred"), "skill": ("skill", None), "category": ("category", None),
}


def _wide(name: str, otherwise: str) -> str:
    width = fixed.WIDTHS[_WIDE[name][0]]
    return f"CASE WHEN c_custkey % {len(_WIDE)} = {list(_WIDE).index(name)} THEN repeat('w', {width} + CAST(floor(c_custkey / {len(_WIDE)}) % 2 AS INT)) ELSE {otherwise} END"


def _wide_struct(*names: str) -> str:
    return "named_struct(" + ", ".join(f"'{_WIDE[n][1]}', {_wide(n, 'CAST(c_custkey AS STRING)')}" for n in names) + ")"


_WIDE_DOCS = f"""SELECT c_custkey AS k, CAST(c_custkey AS STRING) AS file, to_json(named_struct('job_metadata', {_wide_struct("external_job_id", "city", "state", "country", "employment_type")},
    'role_analysis', {_wide_struct("advertised_role", "actual_role", "seniority")}, 'skills', map({_wide("category", "'k'")}, array({_wide("skill", "'RAG'")})))) AS raw FROM {{customer}}"""


def _widths(s, d):
    parsed = D.stage_documents(portable(s, d, _WIDE_DOCS).select("file", "raw"))
    return D.statuses(parsed).select(F.col("file").cast("long").alias("k"), "status", "error")


def documents_of(s, d):
    """A document for each order: o_orderkey, file, raw.

    The short rows are spread before the texts are made of them, over tasks that grow with the table, as a folder of
    documents would be; the texts themselves are never shuffled.
    """
    tasks = max(s.sparkContext.defaultParallelism, M.table(s, d, "orders").count() // DOCS_PER_TASK)
    return s.sql(DOCS, rows=portable(s, d, _DOC_ROWS).repartition(tasks, "o_orderkey"))


_STAGED: dict[tuple[str, str], str] = {}


def staged(s, d):
    """The parsed documents, staged once per session and input folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _STAGED:
        path = f"{shared_dir(s)}/testbed-{uuid.uuid4().hex}"
        docs = documents_of(s, d).select("file", "raw")
        D.parse_documents(D.classify_documents(docs)).write.parquet(path)
        _STAGED[key] = path
    return s.read.parquet(_STAGED[key])


def accepted(s, d):
    return D.accepted(staged(s, d))


_SKILL_ROWS = f"""SELECT file, job_id, CAST(pos AS INTEGER) AS pos, name, lower(name) AS normalized_name, category,
    CASE WHEN lower(name) = 'langchain' THEN 'critical' WHEN lower(name) = 'rag' OR lower(name) = 'tool ' || (k % 3) THEN 'important'
      WHEN lower(name) = 'brand 1' THEN 'preferred' END AS priority
    FROM (SELECT k, file, job_id, 0 AS pos, 'RAG' AS name, 'zeta' AS category FROM {_OK}
      UNION ALL SELECT k, file, job_id, 1, 'Brand ' || (k % 7), 'zeta' FROM {_OK} UNION ALL SELECT k, file, job_id, 2, 'LangChain', 'alpha' FROM {_OK}
      UNION ALL SELECT k, file, job_id, 3, 'Tool ' || (k % 11), 'alpha' FROM {_OK} UNION ALL SELECT k, file, job_id, 4, 'Beta ' || (k % 3), 'beta' FROM {_OK})"""

# State and batch of the upsert queries; together they cover every order.
_JOBS_STATE = """SELECT o_orderkey AS external_job_id, 'old' AS title, o_orderstatus AS company, o_orderdate AS first_seen_at, o_orderdate AS last_seen_at
    FROM {orders} WHERE o_orderkey % 3 <> 0"""
_JOBS_BATCH = """SELECT 'f1.json' AS file, o_orderkey AS external_job_id, 'f1 ' || o_orderpriority AS title, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'new' END AS company
    FROM {orders} WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0
    UNION ALL SELECT 'f2.json', o_orderkey, 'f2 ' || o_orderpriority, 'newest' FROM {orders} WHERE o_orderkey % 4 = 0"""
_BATCH_LAST = "SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY external_job_id ORDER BY file DESC) = 1"
_LINE_BATCH = """SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'f1.json' ELSE 'f2.json' END AS file, l_orderkey AS job_id,
      (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey AS pos, lower(p_brand) AS normalized_name, p_type AS category,
      CASE l_returnflag WHEN 'A' THEN 'critical' WHEN 'R' THEN 'important' END AS priority
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_orderkey % 4 <> 1"""
_SKILL_STATE = """SELECT l_orderkey AS job_id, lower(p_brand) AS skill_id, 'OLD' AS category,
      CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 'preferred' END AS priority
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey, p_brand"""
_NAME_STATE = """SELECT DISTINCT 'Old ' || p_brand AS name, lower(p_brand) AS normalized_name, CASE WHEN p_brand LIKE '%1' THEN 'kept' END AS category
    FROM {part} WHERE p_brand LIKE '%1%'"""
_NAME_BATCH = """SELECT 'f' || CAST(p_size AS STRING) AS file, p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE upper(p_brand) END AS name,
      lower(p_brand) AS normalized_name, p_type AS category FROM {part}"""
_CAP_STATE = "SELECT DISTINCT l_orderkey AS job_id, CAST(l_linenumber AS STRING) AS capability_id FROM {lineitem} WHERE l_orderkey % 3 <> 0"
_CAP_BATCH = "SELECT l_orderkey AS job_id, CAST(l_linenumber AS STRING) AS normalized_name FROM {lineitem} WHERE l_orderkey % 2 = 0"
_CYCLE_STATE = "SELECT o_orderkey AS job_id, true AS evaluation, CAST(NULL AS BOOLEAN) AS deployment FROM {orders} WHERE o_orderkey % 3 <> 0"
_CYCLE_BATCH = """SELECT 'f1' AS file, o_orderkey AS job_id, o_orderkey % 5 = 0 AS replaces, CASE WHEN o_orderkey % 5 = 0 THEN false END AS evaluation,
      CASE WHEN o_orderkey % 5 = 0 THEN true END AS deployment FROM {orders}
    UNION ALL SELECT 'f2', o_orderkey, false, CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN) FROM {orders} WHERE o_orderkey % 2 = 0"""
_ROLE_STATE = "SELECT o_orderkey AS job_id, o_orderpriority AS actual_role, 'Junior' AS seniority FROM {orders} WHERE o_orderkey % 3 <> 0"
_ROLE_BATCH = "SELECT 'f1' AS file, o_orderkey AS job_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS actual_role, 'Senior' AS seniority FROM {orders} WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0"
# Every third brand is a duplicate of the next one; the last one may lack its canonical brand.
_DUPES = """SELECT DISTINCT lower(p_brand) AS duplicate_id, 'brand#' || CAST(CAST(substr(p_brand, 7) AS INT) + 1 AS STRING) AS canonical_id
    FROM {part} WHERE CAST(substr(p_brand, 7) AS INT) % 3 = 1"""
_PAIRS = "SELECT * FROM dupes WHERE canonical_id IN (SELECT lower(p_brand) FROM part)"
_POSTINGS = """SELECT event_id AS position, CAST(event_id % 3 AS INT) AS dataset_no, event_type AS title,
      CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 51 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'hot' ELSE CAST(event_id % 997 AS STRING) END AS job_id FROM {events}"""
_NOW = "2030-01-01 00:00:00"


def _p(sql):
    return lambda s, d: portable(s, d, sql)


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


def _dupes(s, d, part):
    skills = M.model(s, d, "skills").withColumn("category", F.lit("x"))
    bridge = M.job_skills(s, d)
    metrics = bridge.groupBy("skill_id").agg(F.count(F.lit(1)).alias("job_count"))
    return upsert.merge_duplicate_skills(bridge, skills, metrics, portable(s, d, _DUPES))[part]


def _posting_batch(s, d):
    return portable(s, d, _POSTINGS)


QUERIES = {
    "document_status": (
        lambda s, d: D.statuses(staged(s, d)),
        f"""SELECT file, CASE WHEN k % 17 IN (0, 4) THEN 'skipped_invalid_json' WHEN k % 17 IN (1, 2) THEN 'skipped_invalid_structure'
            WHEN k % 17 = 3 THEN 'error' ELSE 'ok' END AS status, CASE WHEN k % 17 IN (0, 4) THEN 'Invalid JSON'
            WHEN k % 17 IN (1, 2) THEN 'Missing job_metadata.job_id' WHEN k % 17 = 3 THEN 'Value does not fit: city' END AS error FROM ({_SRC})""",
    ),
    "document_widths": (
        _widths,
        f"""SELECT c_custkey AS k, CASE WHEN wide THEN 'error' ELSE 'ok' END AS status, CASE WHEN wide THEN 'Value does not fit: ' || name END AS error
            FROM (SELECT c_custkey, floor(c_custkey / {len(_WIDE)}) % 2 = 1 AS wide, ['{"', '".join(_WIDE)}'][c_custkey % {len(_WIDE)} + 1] AS name FROM customer)""",
    ),
    "ingest_summary": (
        lambda s, d: D.ingest_summary(staged(s, d)),
        f"""SELECT count(*) AS total, count(*) FILTER (WHERE k % 17 > 4) AS succeeded, count(*) FILTER (WHERE k % 17 <= 4) AS failed FROM ({_SRC})""",
    ),
    "project_jobs": (
        lambda s, d: project.project_jobs(accepted(s, d)),
        f"""SELECT file, job_id AS external_job_id, CASE WHEN k % 5 < 2 THEN 'Untitled' ELSE c_name END AS title, c_name AS company,
            CASE k % 3 WHEN 0 THEN n_name || ', ' || c_mktsegment || ' , ' WHEN 1 THEN 'Remote' END AS location,
            CASE WHEN k % 3 = 0 THEN n_name END AS city, CASE WHEN k % 3 = 0 THEN c_mktsegment END AS state, CAST(NULL AS VARCHAR) AS country,
            CASE k % 2 WHEN 0 THEN 'Full' ELSE 'Part' END AS employment_type, CAST(NULL AS VARCHAR) AS job_function, CAST(NULL AS VARCHAR) AS industry,
            CAST(CASE k % 4 WHEN 0 THEN k % 977 WHEN 1 THEN 1000 + k % 977 END AS INTEGER) AS applicants,
            strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' AS posted_at, CAST(NULL AS VARCHAR) AS job_url FROM {_OK}""",
    ),
    "first_category_wins": (
        lambda s, d: project.project_job_skills(accepted(s, d)).select("file", "job_id", "pos", "name", "category"),
        f"SELECT file, job_id, pos, name, category FROM ({_SKILL_ROWS})",
    ),
    "priority_assign": (
        lambda s, d: project.project_job_skills(accepted(s, d)).select("job_id", "normalized_name", "priority"),
        f"SELECT job_id, normalized_name, priority FROM ({_SKILL_ROWS})",
    ),
    "explode_capabilities": (
        lambda s, d: project.project_job_capabilities(accepted(s, d)).select("job_id", "pos", "raw_value", "rule_label", "name", "normalized_name"),
        f"""SELECT job_id, CAST(pos AS INTEGER) AS pos, raw_value, rule_label, coalesce(rule_label, raw_value) AS name,
            lower(replace(coalesce(rule_label, raw_value), '  ', ' ')) AS normalized_name FROM (
            SELECT job_id, 0 AS pos, 'Build RAG bots' AS raw_value, 'Build RAG Systems' AS rule_label FROM {_OK}
            UNION ALL SELECT job_id, 1, 'Mentor ' || c_mktsegment, NULL FROM {_OK} UNION ALL SELECT job_id, 2, 'RAG apps', 'Build RAG Systems' FROM {_OK}
            UNION ALL SELECT job_id, 3, 'mentor  ' || lower(c_mktsegment), NULL FROM {_OK})""",
    ),
    "project_job_roles": (
        lambda s, d: project.project_job_roles(accepted(s, d)),
        f"""SELECT file, job_id, 'Fallback' AS advertised_role, CASE k % 3 WHEN 0 THEN 'Generative AI Engineer' WHEN 1 THEN 'Fallback' ELSE 'Data ' || c_mktsegment END AS actual_role,
            CASE k % 4 WHEN 0 THEN 'Mid-Level' WHEN 2 THEN 'Director' END AS seniority,
            CAST(CASE k % 5 WHEN 0 THEN 3 WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE 2 END AS DOUBLE) AS minimum_experience,
            CAST(CASE WHEN k % 2 = 0 THEN 10 ELSE CASE k % 5 WHEN 0 THEN 5 WHEN 1 THEN 7 ELSE 4 END END AS DOUBLE) AS maximum_experience FROM {_OK}""",
    ),
    "project_job_attributes": (
        lambda s, d: project.project_job_attributes(accepted(s, d)),
        f"""SELECT file, job_id, CASE k % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true END AS cloud, false AS cicd, true AS testing,
            true AS domain_expertise_required, {", ".join(f"CAST(NULL AS BOOLEAN) AS {f}" for f in [*fixed.PRODUCTION_FLAGS, *fixed.ENGINEERING_FLAGS] if f not in ("cloud", "cicd", "testing"))} FROM {_OK}""",
    ),
    "project_ai_lifecycle": (
        lambda s, d: project.project_ai_lifecycle(accepted(s, d)),
        f"""SELECT file, job_id, k % 3 = 1 AS replaces, CASE WHEN k % 3 = 1 THEN true END AS evaluation, CASE WHEN k % 3 = 1 THEN false END AS deployment,
            {", ".join(f"CAST(NULL AS BOOLEAN) AS {f}" for f in fixed.LIFECYCLE_FLAGS if f not in ("evaluation", "deployment"))} FROM {_OK}""",
    ),
    "upsert_jobs": (
        lambda s, d: upsert.upsert_jobs(portable(s, d, _JOBS_STATE), portable(s, d, _JOBS_BATCH), _now()),
        with_model(o=_JOBS_STATE, b=_JOBS_BATCH, n=_BATCH_LAST) + f"""SELECT coalesce(n.external_job_id, o.external_job_id) AS external_job_id,
            CASE WHEN n.external_job_id IS NOT NULL THEN n.title ELSE o.title END AS title,
            CASE WHEN n.external_job_id IS NOT NULL THEN n.company ELSE o.company END AS company,
            coalesce(strftime(o.first_seen_at, '%Y-%m-%d %H:%M:%S'), '{_NOW}') AS first_seen_at,
            CASE WHEN n.external_job_id IS NOT NULL THEN '{_NOW}' ELSE strftime(o.last_seen_at, '%Y-%m-%d %H:%M:%S') END AS last_seen_at
            FROM o FULL JOIN n ON o.external_job_id = n.external_job_id""",
    ),
    "upsert_analysis": (
        lambda s, d: upsert.upsert_analysis(
            portable(s, d, "SELECT CAST(o_orderkey AS STRING) AS job_id, 'v1' AS analysis_version, 'old' AS analysis FROM {orders} WHERE o_orderkey % 3 <> 0"),
            project.project_analysis(accepted(s, d)).withColumn("analysis", F.col("file")),
        ),
        f"""SELECT CAST(k AS VARCHAR) AS job_id, 'v1' AS analysis_version, CASE WHEN k % 17 > 4 THEN file ELSE 'old' END AS analysis
            FROM ({_SRC}) WHERE k % 17 > 4 OR k % 3 <> 0""",
    ),
    "upsert_skills": (
        lambda s, d: upsert.upsert_skills(portable(s, d, _NAME_STATE), portable(s, d, _NAME_BATCH)),
        with_model(o=_NAME_STATE, b=_NAME_BATCH, n="SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY normalized_name ORDER BY file, pos) = 1")
        + """SELECT coalesce(o.name, n.name) AS name, n.normalized_name, coalesce(o.category, n.category) AS category
            FROM n LEFT JOIN o ON o.normalized_name = n.normalized_name""",
    ),
    "upsert_job_skills": (
        lambda s, d: upsert.upsert_job_skills(portable(s, d, _SKILL_STATE), portable(s, d, _LINE_BATCH)),
        with_model(o=_SKILL_STATE, b=_LINE_BATCH, n="""SELECT job_id, normalized_name AS skill_id, last(category ORDER BY file, pos) AS category,
              last(priority ORDER BY file, pos) FILTER (WHERE priority IS NOT NULL) AS priority FROM b GROUP BY 1, 2""")
        + """SELECT coalesce(n.job_id, o.job_id) AS job_id, coalesce(n.skill_id, o.skill_id) AS skill_id,
            coalesce(n.category, o.category) AS category, coalesce(n.priority, o.priority) AS priority
            FROM o FULL JOIN n ON o.job_id = n.job_id AND o.skill_id = n.skill_id""",
    ),
    "upsert_entities": (
        lambda s, d: upsert.upsert_entities(portable(s, d, _NAME_STATE).drop("category"), portable(s, d, _NAME_BATCH)),
        with_model(o=_NAME_STATE, b=_NAME_BATCH, n="SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY normalized_name ORDER BY file, pos) = 1")
        + "SELECT coalesce(o.name, n.name) AS name, n.normalized_name FROM n LEFT JOIN o ON o.normalized_name = n.normalized_name",
    ),
    "upsert_job_capabilities": (
        lambda s, d: upsert.upsert_job_capabilities(portable(s, d, _CAP_STATE), portable(s, d, _CAP_BATCH)),
        duck(f"SELECT * FROM ({_CAP_STATE}) UNION SELECT * FROM ({_CAP_BATCH})"),
    ),
    "upsert_job_roles": (
        lambda s, d: upsert.upsert_satellite(portable(s, d, _ROLE_STATE), portable(s, d, _ROLE_BATCH)),
        duck(f"""SELECT job_id, actual_role, seniority FROM ({_ROLE_BATCH}) UNION ALL
            SELECT * FROM ({_ROLE_STATE}) WHERE job_id NOT IN (SELECT job_id FROM ({_ROLE_BATCH}))"""),
    ),
    "upsert_lifecycle": (
        lambda s, d: upsert.upsert_lifecycle(portable(s, d, _CYCLE_STATE), portable(s, d, _CYCLE_BATCH)),
        """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 5 = 0 THEN false WHEN o_orderkey % 3 <> 0 THEN true END AS evaluation,
            CASE WHEN o_orderkey % 5 = 0 THEN true END AS deployment FROM orders""",
    ),
    "backfill_key": (
        lambda s, d: upsert.backfill_key(
            M.table(s, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, "set").alias("key")),
            "key", F.concat(F.lit("k "), F.lower("p_name"))),
        "SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN 'set' ELSE 'k ' || lower(p_name) END AS \"key\" FROM part",
    ),
    "duplicate_merge": (
        lambda s, d: _dupes(s, d, 0),
        with_model("job_skills", dupes=_DUPES, pairs=_PAIRS) + """, mapped AS (SELECT j.*, coalesce(canonical_id, skill_id) AS to_id FROM job_skills j LEFT JOIN pairs ON duplicate_id = skill_id)
            SELECT job_id, to_id AS skill_id, category, priority FROM mapped
            QUALIFY row_number() OVER (PARTITION BY job_id, to_id ORDER BY skill_id <> to_id, skill_id) = 1""",
    ),
    "duplicate_merge_entities": (
        lambda s, d: _dupes(s, d, 1),
        with_model("skills", dupes=_DUPES, pairs=_PAIRS) + "SELECT name, normalized_name, 'x' AS category FROM skills WHERE normalized_name NOT IN (SELECT duplicate_id FROM pairs)",
    ),
    "duplicate_merge_metrics": (
        lambda s, d: _dupes(s, d, 2),
        with_model("job_skills", dupes=_DUPES, pairs=_PAIRS) + """SELECT skill_id, count(*) AS job_count FROM job_skills
            WHERE skill_id NOT IN (SELECT duplicate_id FROM pairs) GROUP BY 1""",
    ),
    "dedup_postings": (
        lambda s, d: firsts.dedup_postings(_posting_batch(s, d)),
        with_model(p=_POSTINGS) + """SELECT * FROM p WHERE coalesce(job_id, '') = '' UNION ALL (SELECT * FROM p WHERE job_id <> ''
            QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY dataset_no, position) = 1)""",
    ),
}
