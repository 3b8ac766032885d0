"""Stored tables on the test tables: state after batches, published dates, append logs, folders and datasets.

The documents are those of ``ingestion``. The first batch holds two thirds of
the orders, the second one half of them, with a skill category renamed and a
flag turned; a third of the orders comes with both.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.operators.terms import label_by_rules, matching_titles
from jobtide.plans import daily as plan
from jobtide.plans import dashboard
from jobtide.session import shared_dir
from jobtide.sources import appends, documents, tables
from jobtide.sources.postings import read_datasets
from jobtide.testbed import ingestion as I
from jobtide.testbed import model as M
from jobtide.testbed import searches as S
from jobtide.testbed.model import duck, portable

FIRST, SECOND = "2024-01-01 06:00:00", "2024-01-06 06:00:00"
START, END = "2024-01-01", "2024-01-14"
_IN_FIRST, _IN_SECOND = "k % 3 <> 0", "k % 2 = 0"


def _folder(s, label: str) -> str:
    return f"{shared_dir(s)}/{label}-{uuid.uuid4().hex}"


def _batches(s, d) -> list[DataFrame]:
    docs = I.documents_of(s, d)
    edited = F.replace(F.replace("raw", F.lit('"zeta"'), F.lit('"eta"')), F.lit('"cicd": false'), F.lit('"cicd": true'))
    return [
        docs.filter("o_orderkey % 3 <> 0").select("file", "raw"),
        docs.filter("o_orderkey % 2 = 0").select(F.concat(F.lit("second-"), "file").alias("file"), edited.alias("raw")),
    ]


def _ingested(s, d) -> str:
    base = _folder(s, "state")
    for docs, at in zip(_batches(s, d), (FIRST, SECOND)):
        plan.ingest_files(docs, base, F.lit(at).cast("timestamp_ntz"), buckets=8)
    return base


_STATES: dict[tuple[str, str], str] = {}


def state_of(s, d) -> str:
    """The state after both batches, kept for all queries over it; version 2 is that state."""
    key = (s.sparkContext.applicationId, d)
    if key not in _STATES:
        _STATES[key] = _ingested(s, d)
    return _STATES[key]


def _line(df: DataFrame, table: str, *columns) -> DataFrame:
    """Rows of any table as (table, a, b, c, d)."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string").alias(n) for c, n in zip(columns, "abcd")]
    return df.select(F.lit(table).alias("table"), *texts, *[F.lit(None).cast("string").alias(n) for n in "abcd"[len(columns) :]])


def _stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def all_tables(state: dict[str, DataFrame]) -> DataFrame:
    """Rows of all tables of a state that documents fill."""
    lines = [
        _line(state["jobs"], "jobs", "external_job_id", "city", _stamp("first_seen_at"), _stamp("last_seen_at")),
        _line(state["job_analysis"], "job_analysis", "job_id", F.get_json_object("analysis", "$.job_metadata.company")),
        _line(state["skills"], "skills", "normalized_name", "name", "category"),
        _line(state["job_skills"], "job_skills", "job_id", "skill_id", "category", "priority"),
        _line(state["capabilities"], "capabilities", "normalized_name", "name"),
        _line(state["job_capabilities"], "job_capabilities", "job_id", "capability_id"),
        _line(state["roles"], "roles", "normalized_name", "name", "merged_into_id"),
        _line(state["job_roles"], "job_roles", "job_id", "actual_role", "seniority", F.col("minimum_experience").cast("int")),
        _line(state["job_attributes"], "job_attributes", "job_id", "cloud", "cicd", "testing"),
        _line(state["job_ai_lifecycle"], "job_ai_lifecycle", "job_id", "evaluation", "deployment"),
        _line(state["taxonomy_review_queue"], "taxonomy_review_queue", "dimension", "raw_value", "queue_reason", "status"),
    ]
    return reduce(DataFrame.unionByName, lines)


def tables_sql(
    source: str = I._SRC, category: str = "category", first: str = f"'{FIRST}'", last: str = f"'{FIRST}'", cicd: str = "'false'", ok: str = "k % 17 > 4"
) -> str:
    """The same lines, from the documents' rules; ``source`` gives k, file, job_id and what the documents are made of."""
    good = f"(SELECT * FROM ({source}) WHERE {ok})"
    skills = I._SKILL_ROWS.replace(I._OK, good)
    none = "CAST(NULL AS VARCHAR)"
    role = "CASE k % 3 WHEN 0 THEN 'Generative AI Engineer' WHEN 1 THEN 'Fallback' ELSE 'Data ' || c_mktsegment END"
    return f"""WITH ok AS (SELECT * FROM {good}), sk AS (SELECT * FROM ({skills})),
      caps AS (SELECT job_id, 'build rag systems' AS key, 'Build RAG Systems' AS name FROM ok UNION ALL SELECT job_id, 'mentor ' || lower(c_mktsegment), 'Mentor ' || c_mktsegment FROM ok)
      SELECT 'jobs' AS "table", job_id AS a, CASE WHEN k % 3 = 0 THEN n_name END AS b, {first} AS c, {last} AS d FROM ok
      UNION ALL SELECT 'job_analysis', job_id, c_name, {none}, {none} FROM ok
      UNION ALL SELECT DISTINCT 'skills', lower(name), name, category, {none} FROM sk
      UNION ALL SELECT 'job_skills', job_id, lower(name), {category}, priority FROM sk JOIN (SELECT k, job_id FROM ok) USING (job_id)
      UNION ALL SELECT DISTINCT 'capabilities', key, name, {none}, {none} FROM caps
      UNION ALL SELECT DISTINCT 'job_capabilities', job_id, key, {none}, {none} FROM caps
      UNION ALL SELECT DISTINCT 'roles', lower({role}), {role}, {none}, {none} FROM ok
      UNION ALL SELECT 'job_roles', job_id, {role}, CASE k % 4 WHEN 0 THEN 'Mid-Level' WHEN 2 THEN 'Director' END,
        CAST(CASE k % 5 WHEN 0 THEN 3 WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE 2 END AS VARCHAR) FROM ok
      UNION ALL SELECT 'job_attributes', job_id, CASE k % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'true' WHEN 2 THEN 'false' WHEN 3 THEN 'true' END, {cicd}, 'true' FROM ok
      UNION ALL SELECT 'job_ai_lifecycle', job_id, CASE WHEN k % 3 = 1 THEN 'true' END, CASE WHEN k % 3 = 1 THEN 'false' END, {none} FROM ok
      UNION ALL SELECT DISTINCT 'taxonomy_review_queue', 'skill', name, 'new_unreviewed', 'pending' FROM sk
      UNION ALL SELECT DISTINCT 'taxonomy_review_queue', 'role', {role}, 'new_unreviewed', 'pending' FROM ok
      UNION ALL SELECT DISTINCT 'taxonomy_review_queue', 'capability', 'Mentor ' || c_mktsegment, 'new_unreviewed', 'pending' FROM ok
      UNION ALL SELECT DISTINCT 'taxonomy_review_queue', 'capability', 'Build RAG bots', 'suggested_alias', 'pending' FROM ok"""


_BOTH = f"SELECT * FROM ({I._SRC}) WHERE {_IN_FIRST} OR {_IN_SECOND}"
_AFTER_BOTH = tables_sql(
    _BOTH, f"CASE WHEN {_IN_SECOND} AND category = 'zeta' THEN 'eta' ELSE category END",
    f"CASE WHEN {_IN_FIRST} THEN '{FIRST}' ELSE '{SECOND}' END", f"CASE WHEN {_IN_SECOND} THEN '{SECOND}' ELSE '{FIRST}' END",
    f"CASE WHEN {_IN_SECOND} THEN 'true' ELSE 'false' END",
)


def _third_batch(s, d):
    """Per table the buckets, out of eight, that a third batch of one known document has written."""
    base = state_of(s, d)
    if tables.state_version(s, base) == 2:
        one = I.documents_of(s, d).filter("o_orderkey % 17 = 5 AND o_orderkey % 3 = 1").orderBy("o_orderkey").limit(1).select("file", "raw")
        plan.ingest_files(one, base, F.lit("2024-01-09 06:00:00").cast("timestamp_ntz"))
    written = tables.versions(s, base).filter("version = 3")
    return written.groupBy(F.col("table_name").alias("table")).agg(F.count(F.lit(1)).alias("buckets"))


# --- published dates ---------------------------------------------------------

_PUBLISHED: dict[tuple[str, str], str] = {}


def published(s, d) -> str:
    """Base of the state and of the snapshots of fourteen dates, kept for the queries that only read it."""
    key = (s.sparkContext.applicationId, d)
    if key not in _PUBLISHED:
        base = state_of(s, d)
        # One date, then all of them at once: the range replaces the date as well.
        plan.aggregate(s, base, START)
        plan.aggregate(s, base, START, END)
        _PUBLISHED[key] = base
    return _PUBLISHED[key]


_SEEN = f"""WITH ok AS (SELECT *, CASE WHEN {_IN_FIRST} THEN DATE '{FIRST[:10]}' ELSE DATE '{SECOND[:10]}' END AS seen FROM ({_BOTH}) WHERE k % 17 > 4),
    days AS (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS metric_date),
    sk AS (SELECT s.*, ok.seen, ok.k FROM ({I._SKILL_ROWS.replace(I._OK, f"(SELECT * FROM ({_BOTH}) WHERE k % 17 > 4)")}) s JOIN ok USING (job_id)),
    totals AS (SELECT metric_date, (SELECT count(*) FROM ok WHERE seen <= metric_date) AS total_jobs FROM days),
    role_of AS (SELECT k, seen, CASE k % 3 WHEN 0 THEN 'Generative AI Engineer' WHEN 1 THEN 'Fallback' ELSE 'Data ' || c_mktsegment END AS value FROM ok),
    facts AS (SELECT 'daily_skill_metrics' AS "table", name AS value, seen FROM sk
      UNION ALL SELECT 'daily_capability_metrics', 'Build RAG Systems', seen FROM ok UNION ALL SELECT 'daily_capability_metrics', 'Mentor ' || c_mktsegment, seen FROM ok
      UNION ALL SELECT 'daily_role_metrics', value, seen FROM role_of
      UNION ALL SELECT 'daily_seniority_metrics', CASE k % 4 WHEN 0 THEN 'Mid-Level' WHEN 2 THEN 'Director' END, seen FROM ok
      UNION ALL SELECT 'daily_location_metrics', CASE WHEN k % 3 = 0 THEN n_name END, seen FROM ok),
    metrics AS (SELECT "table", metric_date, value, count(*) AS job_count, count(*) / any_value(total_jobs) * 100 AS demand_percentage
      FROM facts JOIN totals ON seen <= metric_date WHERE value IS NOT NULL GROUP BY ALL)
    """
_DIMENSIONS = {
    "daily_skill_metrics": "skill_id", "daily_capability_metrics": "capability_id", "daily_role_metrics": "role",
    "daily_seniority_metrics": "seniority", "daily_location_metrics": "city",
}


def _trend(value: str, days: int, key: str = "true") -> str:
    """Change against the average of the days before, where all of them are there."""
    past = f"FROM m p WHERE {key} AND p.metric_date >= a.metric_date - {days} AND p.metric_date < a.metric_date"
    average = f"(SELECT avg(p.{value}) {past})"
    return f"CASE WHEN (SELECT count(*) {past}) >= {days} AND {average} <> 0 THEN floor(((a.{value} - {average}) / {average} * 100) * 100 + 0.5) / 100 END"


def _metric_rows(s, d):
    base = published(s, d)
    frames = [
        tables.read_metrics(s, base, name).select(F.lit(name).alias("table"), "metric_date", F.col(column).alias("value"), "job_count", "demand_percentage")
        for name, column in _DIMENSIONS.items()
    ]
    # Skills and capabilities are keyed by name.
    return reduce(DataFrame.unionByName, frames).withColumn("value", F.lower("value"))


def _named(s, d, name: str) -> DataFrame:
    return tables.read_metrics(s, published(s, d), name)


def _dimensions(s, d):
    rows = {"daily_seniority_metrics": "seniority", "daily_location_metrics": "city"}
    ranked = [dashboard.dimension_ranked(_named(s, d, t), c).withColumnRenamed(c, "name").withColumn("list", F.lit(c)) for t, c in rows.items()]
    state = tables.read_state(s, published(s, d))
    ranked.append(dashboard.capabilities_ranked(_named(s, d, "daily_capability_metrics"), state["capabilities"]).withColumn("list", F.lit("capability")))
    roles = dashboard.roles_ranked(_named(s, d, "daily_role_metrics"))
    ranked.append(roles.withColumnRenamed("role", "name").drop("trend").withColumn("list", F.lit("role")))
    return reduce(DataFrame.unionByName, ranked)


def _jobs_list(s, d):
    state = tables.read_state(s, published(s, d))
    jobs = dashboard.jobs_list(state["jobs"].withColumnRenamed("external_job_id", "job_id"), state["job_roles"])
    return jobs.select("job_id", "title", "company", "city", "first_seen_at", "actual_role", "seniority")


def _replaced_dates(s, d):
    """Order priorities per day in three dates; then two of them anew, one without rows and one without a member."""
    base = _folder(s, "dates")
    days = ["1995-03-01", "1995-03-02", "1995-03-03"]
    orders = M.table(s, d, "orders").select(F.col("o_orderpriority").alias("seniority"))
    # Every order counts on all three dates, so that small tables fill them.
    counted = orders.withColumn("day", F.explode(F.array(*map(F.lit, days)))).groupBy(F.col("day").cast("date").alias("metric_date"), "seniority")
    frame = counted.agg(F.count(F.lit(1)).alias("job_count")).withColumn("demand_percentage", F.lit(1.5))
    tables.publish_snapshots(s, base, {"daily_seniority_metrics": frame}, days)
    again = frame.filter(f"metric_date <> DATE '{days[1]}' AND seniority <> '5-low'")
    tables.publish_snapshots(s, base, {"daily_seniority_metrics": again}, days[1:])
    return tables.read_metrics(s, base, "daily_seniority_metrics").select("metric_date", "seniority", "job_count")


# --- append logs ---------------------------------------------------------------


def _appended_profiles(s, d):
    """Two batches, the first one sent twice, then compacted."""
    path = _folder(s, "profiles")
    rows = S._profiles(s, d).withColumns(
        {"id": F.col("c_custkey"), "resume_id": F.col("c_custkey") % 1000, "created_at": F.lit(None).cast("timestamp_ntz")}
    )
    parts = [rows.filter("c_custkey % 3 = 0"), rows.filter("c_custkey % 3 <> 0")]
    for number in (0, 1, 0):
        appends.append_profiles(parts[number], path, "enrichment", number)
    schema = s.read.parquet(f"{path}/data/*").schema
    appends.compact(s, path, schema)
    return appends.read_appended(s, path, schema).select("id", "resume_id", "seniority_level", "years_of_experience", "location", "enrichment_status")


def _appended_configs(s, d):
    """Two configurations of every profile, in two batches of one stream; both stay."""
    path = _folder(s, "configs")
    # Both batches take their rows from the same profiles and queries: they are parsed once.
    queries = documents.stage(S._configs(s, d).withColumns({"user_profile_id": F.col("c_custkey"), "created_at": F.lit(None).cast("timestamp_ntz")}))
    filters = documents.stage(plan_filters(s, d))
    for number in (0, 1, 1):
        batch = queries.withColumn("id", F.col("c_custkey") * 2 + number)
        failed = batch.filter(f"c_custkey % 10 = {number}").select("id", "user_profile_id", "created_at")
        appends.append_search_configs(batch.filter(f"c_custkey % 10 <> {number}"), filters, path, "generation", number, failed)
    schema = s.read.parquet(f"{path}/data/*").schema
    rows = appends.read_appended(s, path, schema)
    return rows.select(
        "id", "user_profile_id", F.array_join("primary_queries", "|").alias("primary_queries"), F.array_join("secondary_queries", "|").alias("secondary_queries"),
        F.array_join("keywords", "|").alias("keywords"), "location",
    )


def plan_filters(s, d):
    from jobtide.operators.profiles import build_filters

    return build_filters(S._table(s, d))


# --- folders and datasets ------------------------------------------------------


def _as_files(docs: DataFrame, path: str) -> None:
    """A JSON file for each key; the file of a key that is written again is replaced. ``docs`` is partitioned by k.

    A file is written by its name as one stream of bytes. Spark's writer would set up a folder, an attempt and a
    checksum for each, and the driver would move them one by one.
    """
    lines = docs.select("k", F.to_json(F.struct(*[c for c in docs.columns if c != "k"])).alias("line")).sortWithinPartitions("k")

    def write(rows) -> None:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        files.create_dir(root, recursive=True)
        for k, group in groupby(rows, lambda r: r["k"]):
            name = "__HIVE_DEFAULT_PARTITION__" if k is None else k
            with files.open_output_stream(f"{root}/k={name}.json", compression=None) as out:
                out.write("".join(f"{r['line']}\n" for r in group).encode())

    lines.foreachPartition(write)


_FILE_DOC = """SELECT c_custkey AS k, named_struct('job_id', CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_custkey AS STRING) END, 'title', c_name, 'city', c_mktsegment,
    'employment_type', CASE WHEN c_custkey % 11 = 3 THEN repeat('x', 200) ELSE 'Full' END,
    'posted_at', CASE WHEN c_custkey % 13 = 5 THEN 'soon' ELSE '2024-01-01' END,
    'applicants', CASE WHEN c_custkey % 17 = 2 THEN 5000000000 ELSE c_custkey END) AS job_metadata,
    named_struct('a', array('RAG', concat('Tool ', CAST(c_custkey % 5 AS STRING)))) AS skills, array(concat('Do ', c_mktsegment)) AS capabilities FROM {customer}"""
_FILE_ERRORS = """CASE WHEN c_custkey % 7 = 0 THEN 'Missing job_metadata.job_id' ELSE 'Value does not fit: ' || array_to_string(list_filter([
    CASE WHEN c_custkey % 11 = 3 THEN 'employment_type' END, CASE WHEN c_custkey % 17 = 2 THEN 'applicants' END, CASE WHEN c_custkey % 13 = 5 THEN 'posted_at' END], lambda x: x IS NOT NULL), ', ') END"""
_FILE_BAD = "(c_custkey % 7 = 0 OR c_custkey % 11 = 3 OR c_custkey % 13 = 5 OR c_custkey % 17 = 2)"


def _analysis_folder(s, d):
    """One file for each customer, read back as a folder of documents; other files lie among them."""
    path = _folder(s, "files")
    docs = portable(s, d, _FILE_DOC)
    _as_files(docs.repartition(s.sparkContext.defaultParallelism, "k"), path)
    M.table(s, d, "region").select("r_name").write.mode("append").option("compression", "none").text(path)
    found = documents.statuses(documents.stage_documents(documents.read_analysis_dir(s, path)))
    return found.select(F.regexp_extract("file", "k=(\\d+)\\.json", 1).cast("long").alias("k"), "status", "error")


def _edited_folder(s, d):
    """A folder read, a third of its files written anew with other skills, and read again; nothing is read a third time."""
    path, base = _folder(s, "files"), _folder(s, "state")
    docs = portable(s, d, _FILE_DOC).repartition(s.sparkContext.defaultParallelism, "k")
    now = [F.lit(t).cast("timestamp_ntz") for t in (FIRST, SECOND)]
    _as_files(docs, path)
    plan.ingest_changes(s, path, base, now[0], 8)
    edited = F.expr("named_struct('b', array('RAG', concat('Gear ', CAST(k % 3 AS STRING))))")
    _as_files(docs.filter("k % 3 = 0").withColumn("skills", edited).withColumn("capabilities", F.array(F.lit("Do it again"))), path)
    plan.ingest_changes(s, path, base, now[1])
    plan.ingest_changes(s, path, base, now[1])
    state = tables.read_state(s, base)
    lines = [
        _line(state["jobs"], "jobs", "external_job_id", "title", _stamp("last_seen_at")),
        _line(state["job_skills"], "job_skills", "job_id", "skill_id", "category"),
        _line(state["job_capabilities"], "job_capabilities", "job_id", "capability_id"),
        _line(state["taxonomy_review_queue"], "taxonomy_review_queue", "dimension", "raw_value", "queue_reason"),
        _line(s.range(1), "version", F.lit(tables.state_version(s, base))),
    ]
    return reduce(DataFrame.unionByName, lines)


_EDITED_SQL = f"""WITH ok AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS id, c_name, c_mktsegment AS m FROM customer WHERE NOT {_FILE_BAD}),
    edited AS (SELECT * FROM ok WHERE k % 3 = 0), no AS (SELECT CAST(NULL AS VARCHAR) AS x)
    SELECT 'jobs' AS "table", id AS a, c_name AS b, CASE WHEN k % 3 = 0 THEN '{SECOND}' ELSE '{FIRST}' END AS c, x AS d FROM ok, no
    UNION ALL SELECT 'job_skills', id, 'rag', CASE WHEN k % 3 = 0 THEN 'b' ELSE 'a' END, x FROM ok, no
    UNION ALL SELECT 'job_skills', id, 'tool ' || (k % 5), 'a', x FROM ok, no UNION ALL SELECT 'job_skills', id, 'gear ' || (k % 3), 'b', x FROM edited, no
    UNION ALL SELECT 'job_capabilities', id, 'do ' || lower(m), x, x FROM ok, no UNION ALL SELECT 'job_capabilities', id, 'do it again', x, x FROM edited, no
    UNION ALL SELECT DISTINCT 'taxonomy_review_queue', 'skill', 'RAG', 'new_unreviewed', x FROM ok, no
    UNION ALL SELECT DISTINCT 'taxonomy_review_queue', 'skill', 'Tool ' || (k % 5), 'new_unreviewed', x FROM ok, no
    UNION ALL SELECT DISTINCT 'taxonomy_review_queue', 'skill', 'Gear ' || (k % 3), 'new_unreviewed', x FROM edited, no
    UNION ALL SELECT DISTINCT 'taxonomy_review_queue', 'capability', 'Do ' || m, 'new_unreviewed', x FROM ok, no
    UNION ALL SELECT DISTINCT 'taxonomy_review_queue', 'capability', 'Do it again', 'new_unreviewed', x FROM edited, no
    UNION ALL SELECT 'version', '2', x, x, x FROM no"""
_PART = "CASE WHEN event_id % 10 < 5 THEN 0 WHEN event_id % 10 < 8 THEN 1 ELSE 2 END"


def _datasets(s, d):
    """Events as postings in three datasets of JSON lines, some of them broken, and one that is missing."""
    path = _folder(s, "datasets")
    events = M.table(s, d, "events")
    job = F.when(F.col("event_id") % 50 != 0, (F.col("event_id") % 97).cast("string")).alias("jobId")
    lines = F.to_json(F.struct(job, F.col("event_type").alias("title"), F.lit("somewhere").alias("location")))
    broken = F.when(F.col("event_id") % 41 == 7, F.concat(lines, F.lit("}"), F.lit(" and more {"))).otherwise(lines)
    texts = events.select(F.expr(_PART).alias("part"), broken.alias("value"))
    for part in range(3):
        texts.filter(F.col("part") == part).select("value").write.option("compression", "none").text(f"{path}/set{part}")
    found = read_datasets(s, [f"{path}/set0", f"{path}/gone", f"{path}/set1", f"{path}/set2"])

    def name(column: str):
        return F.substring_index(column, "/", -1)

    lines = [
        _line(found.unique(), "unique", name("dataset"), F.coalesce("job_id", F.lit("none"))),
        _line(found.skipped(), "duplicates", "duplicates"),
        _line(found.failures, "failures", name("dataset"), "error", "rows"),
    ]
    return reduce(DataFrame.unionByName, lines)


_DATASETS_SQL = f"""WITH p AS (SELECT event_id, {_PART} AS part, CASE WHEN event_id % 50 <> 0 THEN CAST(event_id % 97 AS VARCHAR) END AS job_id, event_id % 41 = 7 AS broken FROM events),
    good AS (SELECT * FROM p WHERE NOT broken), x AS (SELECT CAST(NULL AS VARCHAR) AS x)
    SELECT 'unique' AS "table", 'set' || part AS a, 'none' AS b, x AS c, x AS d FROM good, x WHERE job_id IS NULL
    UNION ALL SELECT 'unique', 'set' || min(part), job_id, any_value(x), any_value(x) FROM good, x WHERE job_id IS NOT NULL GROUP BY job_id
    UNION ALL SELECT 'duplicates', CAST(count(*) - count(DISTINCT job_id) AS VARCHAR), any_value(x), any_value(x), any_value(x) FROM good, x WHERE job_id IS NOT NULL
    UNION ALL SELECT 'failures', 'set' || part, 'broken JSON', CAST(count(*) AS VARCHAR), any_value(x) FROM p, x WHERE broken GROUP BY part
    UNION ALL SELECT 'failures', 'gone', 'PATH_NOT_FOUND', '0', x FROM x"""


# --- tables of terms and rules -------------------------------------------------


def _terms(s, d):
    """Customers whose number is a term; the terms are a table as long as a third of the titles."""
    customers = M.table(s, d, "customer")
    terms = customers.filter("c_custkey % 3 = 0").select(F.lower(F.substring_index("c_name", "#", -1)).alias("term"))
    more = s.createDataFrame([("",), ("customer#000000001",), ("000",)], "term string")
    return matching_titles(customers.select("c_custkey", F.col("c_name").alias("title")), terms.union(more))


def _rules(s, d):
    """A rule for each part brand and size, on texts of brand and size; the first by rank wins."""
    part = M.table(s, d, "part")
    rules = part.select("p_size").distinct().select(
        F.col("p_size").alias("rank"), F.concat(F.lit("size "), "p_size").alias("term"), F.lit("brand#[1-4]").alias("pattern"),
        F.concat(F.lit("Size "), "p_size").alias("label"),
    ).union(s.createDataFrame([(-1, "brand", "brand#2.*size 7$", "Special"), (99, "brand", ".", "Any")], "rank int, term string, pattern string, label string"))
    values = part.select("p_partkey", F.concat("p_brand", F.lit(" of size "), "p_size").alias("raw_value"))
    return label_by_rules(values, rules)


QUERIES = {
    "state_after_two_batches": (lambda s, d: all_tables(tables.read_state(s, state_of(s, d), 2)), _AFTER_BOTH),
    "state_buckets_written": (
        _third_batch,
        "SELECT unnest(['jobs', 'job_analysis', 'job_skills', 'job_capabilities', 'job_roles', 'job_attributes', 'job_ai_lifecycle', 'job_counts']) AS \"table\", 1 AS buckets",
    ),
    "published_metrics": (
        _metric_rows, _SEEN + 'SELECT "table", CAST(metric_date AS VARCHAR) AS metric_date, lower(value) AS value, job_count, demand_percentage FROM metrics',
    ),
    "published_market": (
        lambda s, d: _named(s, d, "daily_market_metrics").drop("market_health_score"),
        _SEEN + """SELECT CAST(metric_date AS VARCHAR) AS metric_date, count(*) AS total_jobs, count(DISTINCT c_name) AS unique_companies,
            avg(CASE k % 4 WHEN 0 THEN k % 977 WHEN 1 THEN 1000 + k % 977 END) AS average_applicants FROM ok JOIN days ON seen <= metric_date GROUP BY 1""",
    ),
    "published_overview": (
        lambda s, d: dashboard.overview(_named(s, d, "daily_market_metrics")).select("metric_date", "total_jobs", "change_1d", "change_7d", "change_30d", "unique_companies"),
        _SEEN + f""", m AS (SELECT metric_date, total_jobs FROM totals)
            SELECT CAST(metric_date AS VARCHAR) AS metric_date, total_jobs, {_trend("total_jobs", 1)} AS change_1d, {_trend("total_jobs", 7)} AS change_7d,
            {_trend("total_jobs", 30)} AS change_30d, (SELECT count(DISTINCT c_name) FROM ok) AS unique_companies FROM m a WHERE metric_date = DATE '{END}'""",
    ),
    "published_skills": (
        lambda s, d: dashboard.skills_ranked(_named(s, d, "daily_skill_metrics"), tables.read_state(s, published(s, d))["skills"]).drop("change_30d"),
        _SEEN + f""", m AS (SELECT * FROM metrics WHERE "table" = 'daily_skill_metrics')
            SELECT CAST(metric_date AS VARCHAR) AS metric_date, value AS name, job_count, demand_percentage, {_trend("demand_percentage", 7, "p.value = a.value")} AS change_7d
            FROM m a WHERE metric_date = DATE '{END}'""",
    ),
    "published_lists": (
        _dimensions,
        _SEEN + f"""SELECT CAST(metric_date AS VARCHAR) AS metric_date, CASE "table" WHEN 'daily_location_metrics' THEN 'city' ELSE replace(replace("table", 'daily_', ''), '_metrics', '') END AS list,
            value AS name, job_count, demand_percentage FROM metrics WHERE "table" <> 'daily_skill_metrics' AND metric_date = DATE '{END}'""",
    ),
    "published_jobs": (
        _jobs_list,
        _SEEN + """SELECT job_id, CASE WHEN k % 5 < 2 THEN 'Untitled' ELSE c_name END AS title, c_name AS company, CASE WHEN k % 3 = 0 THEN n_name END AS city,
            CAST(seen AS VARCHAR) || ' 06:00:00' AS first_seen_at, value AS actual_role, CASE ok.k % 4 WHEN 0 THEN 'Mid-Level' WHEN 2 THEN 'Director' END AS seniority
            FROM ok JOIN (SELECT k, value FROM role_of) USING (k)""",
    ),
    "published_dates": (
        lambda s, d: dashboard.snapshot_dates({n: _named(s, d, n) for n in [*_DIMENSIONS, "daily_market_metrics"]}),
        f"""SELECT unnest(['{"', '".join([*_DIMENSIONS, "daily_market_metrics"])}']) AS table_name, '{END}' AS metric_date, true AS consistent""",
    ),
    "replaced_dates": (
        _replaced_dates,
        """SELECT day AS metric_date, o_orderpriority AS seniority, count(*) AS job_count FROM orders, (SELECT unnest(['1995-03-01', '1995-03-03']) AS day) x
            WHERE day = '1995-03-01' OR o_orderpriority <> '5-low' GROUP BY 1, 2""",
    ),
    "profiles_appended": (_appended_profiles, S.QUERIES["profiles_table"][1]),
    "search_configs_appended": (
        _appended_configs,
        f"""SELECT c_custkey * 2 + n AS id, c_custkey AS user_profile_id, CASE WHEN c_custkey % 10 = n THEN '' ELSE array_to_string(p, '|') END AS primary_queries,
            CASE WHEN c_custkey % 10 = n THEN '' ELSE array_to_string(sq, '|') END AS secondary_queries,
            CASE WHEN c_custkey % 10 = n THEN '' ELSE array_to_string(kw, '|') END AS keywords, c_mktsegment AS location
            FROM ({S._LISTS}), (SELECT unnest([0, 1]) AS n) x""",
    ),
    "analysis_folder": (
        _analysis_folder,
        f"""SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'skipped_invalid_structure' WHEN {_FILE_BAD} THEN 'error' ELSE 'ok' END AS status,
            CASE WHEN {_FILE_BAD} THEN {_FILE_ERRORS} END AS error FROM customer""",
    ),
    "edited_folder": (_edited_folder, _EDITED_SQL),
    "datasets_in_one_scan": (_datasets, _DATASETS_SQL),
    "title_terms_table": (
        _terms,
        duck("SELECT c_custkey, c_name AS title FROM {customer} WHERE c_custkey % 3 = 0 OR c_custkey = 1"),
    ),
    "capability_rules_table": (
        _rules,
        """SELECT p_partkey, p_brand || ' of size ' || p_size AS raw_value, CASE WHEN regexp_matches(p_brand, '^Brand#2') AND p_size = 7 THEN 'Special'
            WHEN regexp_matches(p_brand, '^Brand#[1-4]') THEN 'Size ' || p_size ELSE 'Any' END AS rule_label FROM part""",
    ),
}
