"""Profiles, search configurations and run histories on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide.operators import firsts, profiles, runs
from jobtide.sources.postings import latest_batch
from jobtide.testbed import model as M
from jobtide.testbed.model import duck, portable, with_model

# Raw model output per customer, every field in several shapes.
PROFILES = r"""SELECT c_custkey, '{{"target_roles": ' || CASE c_custkey % 4 WHEN 0 THEN '[" Data Engineer ", "", 3, "ML"]' WHEN 1 THEN '"AI Engineer"' WHEN 2 THEN '[]' ELSE 'null' END
    || ', "seniority_level": ' || CASE c_custkey % 5 WHEN 0 THEN '" Senior "' WHEN 1 THEN '"Wizard"' WHEN 2 THEN '7' WHEN 3 THEN 'null' ELSE '"Lead"' END
    || ', "years_of_experience": ' || CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey % 90 AS STRING) WHEN 1 THEN '" 1e1 "' WHEN 2 THEN '"5d"' WHEN 3 THEN 'true' WHEN 4 THEN '-1' ELSE '"2.5"' END
    || ', "education": ' || CASE c_custkey % 3 WHEN 0 THEN '[{{"degree": " BSc ", "year": 2001}}, {{"degree": ""}}, "x", ["y"]]' WHEN 1 THEN '[{{"year": 1}}]' ELSE 'null' END
    || ', "location": "  ' || c_mktsegment || ' ", "preferred_industries": ["' || c_mktsegment || '"]' || CASE WHEN c_custkey % 7 = 0 THEN ', "keywords": {{}}' ELSE '' END || '}}' AS raw
    FROM {customer}"""
_P = duck("SELECT c_custkey, c_mktsegment FROM {customer}")
QUERY_OUTPUT = r"""SELECT c_custkey, '{{"primary_queries": ' || CASE c_custkey % 4 WHEN 0 THEN '[" AI Engineer", "AI Engineer ", "ai engineer", "' || c_mktsegment || '", "a", "b", "c", "d"]'
      WHEN 1 THEN '"AI"' WHEN 2 THEN '["x", 5, " "]' ELSE '["q' || chr(92) || '"1"]' END
    || ', "secondary_queries": ' || CASE c_custkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN '[" ai ENGINEER ", "ML Engineer", "X"]' ELSE '["X"]' END
    || ', "keywords": ["k", "k", "' || c_mktsegment || '"]}}' AS raw, c_mktsegment FROM {customer}"""
_LISTS = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ['AI Engineer', 'ai engineer', c_mktsegment, 'a', 'b'] WHEN 1 THEN [] WHEN 2 THEN ['x'] ELSE ['q"1'] END AS p,
    CASE c_custkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['ai ENGINEER', 'ML Engineer', 'X'] ELSE ['X'] END AS sq, ['k', c_mktsegment] AS kw, c_mktsegment FROM customer"""
_PLAN = f""", l AS ({_LISTS}), s AS (SELECT *, list_filter(sq, lambda x: NOT list_contains(list_transform(p, lambda y: lower(y)), lower(x))) AS left_over FROM l),
    plan AS (SELECT c_custkey, 1 AS run_no, 'secondary' AS query_type, left_over AS queries, kw, c_mktsegment FROM s WHERE len(left_over) > 0
      UNION ALL SELECT c_custkey, 2, 'primary', p, kw, c_mktsegment FROM s WHERE len(p) > 0)"""
# A scraper run is created, starts with a data set, and ends with a count or an error.
SCRAPER_STATE = """SELECT o_orderkey AS id, 'created' AS status, CAST(NULL AS STRING) AS dataset_id, CAST(NULL AS BIGINT) AS result_count, CAST(NULL AS STRING) AS error_message,
    CAST(NULL AS INT) AS started_at, CAST(NULL AS INT) AS completed_at FROM {orders}"""
SCRAPER_UPDATES = """SELECT o_orderkey AS id, 1 AS step, 'running' AS status, 'set' || o_orderkey AS dataset_id, CAST(NULL AS BIGINT) AS result_count, CAST(NULL AS STRING) AS error_message, 1 AS started_at
      FROM {orders} WHERE o_orderkey % 4 > 0
    UNION ALL SELECT o_orderkey, 2, CASE WHEN o_orderkey % 4 = 2 THEN 'succeeded' ELSE 'failed' END, NULL, CASE WHEN o_orderkey % 4 = 2 THEN o_custkey END,
      CASE WHEN o_orderkey % 4 = 3 THEN 'failed to start' END, NULL FROM {orders} WHERE o_orderkey % 4 > 1"""
CONFIGS = """SELECT CAST(event_id AS STRING) AS id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_profile_id,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial' ELSE 'complete' END AS generation_status, ts AS created_at FROM {events}"""
RUNS = """SELECT CAST(event_id AS STRING) AS id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_profile_id,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'completed' WHEN 'signup' THEN 'completed_with_errors' ELSE 'scraping' END AS status,
    ts AS created_at FROM {events}"""
SCRAPES = """SELECT CASE WHEN event_id % 4 = 0 THEN 0 ELSE user_id END AS pipeline_run_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'timed_out' ELSE 'succeeded' END AS status,
    CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value) AS INT) END AS result_count, CASE WHEN event_id % 5 <> 0 THEN 'ds' || CAST(event_id AS STRING) END AS dataset_id FROM {events}"""
OUTCOMES = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN 'cfg' END AS search_configuration_id, o_orderkey % 3 AS datasets, o_orderkey % 2 = 0 AS any_scrape_failed,
    o_orderkey % 5 AS jobs_analyzed, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 5 END AS jobs_processed_successfully,
    CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 ELSE 0 END AS jobs_failed, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS dataset_fetch_failures FROM {orders}"""
RUN_STATE = """SELECT c_custkey AS id, 'pending' AS status, CAST(NULL AS STRING) AS search_configuration_id, CAST(NULL AS INT) AS jobs_scraped, 3 AS jobs_analyzed,
    CAST(NULL AS STRING) AS error_message, CAST(NULL AS TIMESTAMP_NTZ) AS completed_at FROM {customer}"""
UPDATES = """SELECT o_custkey AS id, o_orderkey AS n, o_orderdate AS d, CASE o_orderkey % 3 WHEN 0 THEN 'scraping' WHEN 1 THEN 'ingesting' END AS status,
    CASE WHEN o_orderkey % 3 = 2 OR o_orderkey % 5 = 0 THEN CAST(o_orderkey % 100 AS INT) END AS jobs_scraped, CASE WHEN o_orderkey % 50 = 0 THEN 'oops' END AS error_message,
    o_orderkey % 20 = 0 AS completed FROM {orders}"""
_TERMINAL = "('completed', 'completed_with_errors', 'failed')"


def _profiles(s, d):
    return profiles.validate_profiles(portable(s, d, PROFILES))


def _table(s, d):
    rows = _profiles(s, d).withColumns({"id": F.col("c_custkey"), "resume_id": F.col("c_custkey") % 1000, "created_at": F.lit(None).cast("timestamp_ntz")})
    return profiles.profiles_table(rows)


def _configs(s, d):
    return profiles.validate_search_queries(portable(s, d, QUERY_OUTPUT))


def _joined(s, d):
    df = _configs(s, d)
    return df.select("c_custkey", "generation_status", *[F.array_join(c, "|").alias(c) for c in ("primary_queries", "secondary_queries", "keywords", "dropped_fields")])


def _search_rows(s, d):
    queries = _configs(s, d).filter("c_custkey % 10 <> 9").withColumns(
        {"id": F.col("c_custkey"), "user_profile_id": F.col("c_custkey"), "created_at": F.lit(None).cast("timestamp_ntz")})
    failed = M.table(s, d, "customer").filter("c_custkey % 10 = 9").select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("user_profile_id"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    return profiles.search_configs_table(queries, profiles.build_filters(_table(s, d)), failed)



_STATUS_PARTS = {
    "target_roles": "c_custkey % 4 IN (1, 2)", "seniority_level": "c_custkey % 5 IN (1, 2)",
    "years_of_experience": "c_custkey % 6 IN (2, 3, 4) OR (c_custkey % 6 = 0 AND c_custkey % 90 > 80)",
    "education": "c_custkey % 3 = 1", "keywords": "c_custkey % 7 = 0",
}
_DROPPED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{f}' END" for f, t in _STATUS_PARTS.items()) + "], lambda x: x IS NOT NULL), '|')"
_SENIOR = "CASE c_custkey % 5 WHEN 0 THEN 'Senior' WHEN 4 THEN 'Lead' END"
_YEARS = "CAST(CASE c_custkey % 6 WHEN 0 THEN CASE WHEN c_custkey % 90 <= 80 THEN c_custkey % 90 END WHEN 1 THEN 10 WHEN 5 THEN 2.5 END AS DOUBLE)"
_STATUS = f"CASE WHEN {_DROPPED} = '' THEN 'complete' ELSE 'partial' END"

QUERIES = {
    "validate_profiles": (
        lambda s, d: _profiles(s, d).select(
            "c_custkey", F.array_join("profile.target_roles", "|").alias("target_roles"), "profile.seniority_level", "profile.years_of_experience",
            F.to_json("profile.education").alias("education"), "profile.location", F.array_join("dropped_fields", "|").alias("dropped_fields"), "enrichment_status"),
        f"""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Data Engineer|ML' END AS target_roles, {_SENIOR} AS seniority_level, {_YEARS} AS years_of_experience,
            CASE WHEN c_custkey % 3 = 0 THEN '[{{"degree":"BSc"}}]' END AS education, c_mktsegment AS location, {_DROPPED} AS dropped_fields, {_STATUS} AS enrichment_status FROM ({_P})""",
    ),
    "profiles_table": (
        lambda s, d: _table(s, d).drop("enriched_profile", "created_at"),
        f"""SELECT c_custkey AS id, c_custkey % 1000 AS resume_id, {_SENIOR} AS seniority_level, {_YEARS} AS years_of_experience, c_mktsegment AS location,
            {_STATUS} AS enrichment_status FROM ({_P})""",
    ),
    "failed_profiles": (
        lambda s, d: profiles.failed_profiles(_table(s, d).filter("id % 3 = 0").select("id", "resume_id", "created_at"), _table(s, d))
        .select("id", "resume_id", "seniority_level", "years_of_experience", F.col("enriched_profile").isNull().alias("empty"), "enrichment_status"),
        f"""SELECT c_custkey AS id, c_custkey % 1000 AS resume_id, CAST(NULL AS VARCHAR) AS seniority_level, CAST(NULL AS DOUBLE) AS years_of_experience,
            true AS "empty", 'failed' AS enrichment_status FROM ({_P}) WHERE c_custkey % 3 = 0""",
    ),
    "searchable_profiles": (
        lambda s, d: profiles.searchable_profiles(
            _table(s, d).withColumn("enrichment_status", F.when(F.col("id") % 4 == 0, "failed").otherwise(F.col("enrichment_status")))
        ).select("id", "enrichment_status"),
        f"SELECT c_custkey AS id, {_STATUS} AS enrichment_status FROM ({_P}) WHERE c_custkey % 4 <> 0",
    ),
    "profile_details": (
        lambda s, d: profiles.profile_details(
            _table(s, d),
            M.table(s, d, "supplier").select(
                F.col("s_suppkey").alias("id"), F.col("s_name").alias("original_filename"), F.lit("pdf").alias("file_format"), F.lit("/x").alias("storage_path"),
                F.lit("secret").alias("raw_text"), F.lit("2024-01-01").cast("timestamp_ntz").alias("uploaded_at")),
        ).select("id", "resume_id", "original_filename", "file_format", "uploaded_at", "location", "enrichment_status"),
        f"""SELECT c_custkey AS id, s_suppkey AS resume_id, s_name AS original_filename, 'pdf' AS file_format, '2024-01-01 00:00:00' AS uploaded_at,
            c_mktsegment AS location, {_STATUS} AS enrichment_status FROM ({_P}) JOIN supplier ON s_suppkey = c_custkey % 1000""",
    ),
    "validate_queries": (
        _joined,
        f"""WITH l AS ({_LISTS}) SELECT c_custkey, array_to_string(p, '|') AS primary_queries, array_to_string(sq, '|') AS secondary_queries, array_to_string(kw, '|') AS keywords,
            CASE c_custkey % 4 WHEN 1 THEN 'primary_queries' WHEN 2 THEN 'primary_queries (some entries invalid)' ELSE '' END AS dropped_fields,
            CASE WHEN c_custkey % 4 IN (1, 2) THEN 'partial' ELSE 'complete' END AS generation_status FROM l""",
    ),
    "build_filters": (
        lambda s, d: profiles.build_filters(_table(s, d)).withColumn("industries", F.array_join("industries", "|")),
        f"""SELECT c_custkey AS user_profile_id, {_SENIOR} AS seniority, c_mktsegment AS location, c_mktsegment AS industries, CAST(NULL AS VARCHAR) AS employment_type FROM ({_P})""",
    ),
    "search_configs_table": (
        lambda s, d: _search_rows(s, d).select("user_profile_id", F.size("primary_queries").alias("n"), "generation_status", "seniority", "location"),
        f"""WITH l AS ({_LISTS}) SELECT c_custkey AS user_profile_id, CAST(CASE WHEN c_custkey % 10 = 9 THEN 0 ELSE len(p) END AS INTEGER) AS n,
            CASE WHEN c_custkey % 10 = 9 THEN 'failed' WHEN c_custkey % 4 IN (1, 2) THEN 'partial' ELSE 'complete' END AS generation_status,
            {_SENIOR} AS seniority, c_mktsegment AS location FROM l""",
    ),
    "plan_runs": (
        lambda s, d: profiles.plan_runs(_configs(s, d)).select("c_custkey", "run_no", "query_type", F.array_join("queries", "|").alias("queries")),
        "WITH dummy AS (SELECT 1)" + _PLAN + " SELECT c_custkey, run_no, query_type, array_to_string(queries, '|') AS queries FROM plan",
    ),
    "actor_input": (
        lambda s, d: profiles.build_actor_input(
            profiles.plan_runs(_configs(s, d)).withColumns({
                "location": F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit("")),
                "seniority": F.when(F.col("c_custkey") % 3 == 0, "Manager").otherwise("Wizard")}), 25
        ).select("c_custkey", "run_no", "actor_input"),
        "WITH dummy AS (SELECT 1)" + _PLAN + """ SELECT c_custkey, run_no, '{"keywords":"' || array_to_string(list_transform(queries, lambda q: '\\"' || replace(q, '"', '') || '\\"'), ' OR ')
            || '","maxItems":25,"fetchFullDescription":true' || CASE WHEN c_custkey % 2 = 0 THEN ',"location":"' || c_mktsegment || '"' ELSE '' END
            || CASE WHEN c_custkey % 3 = 0 THEN ',"experienceLevels":["director"]' ELSE '' END || ',"titleKeywordFilter":["k","' || c_mktsegment || '"]}' AS actor_input FROM plan""",
    ),
    "latest_valid_config": (
        lambda s, d: firsts.latest_valid_config(portable(s, d, CONFIGS)),
        with_model(c=CONFIGS) + """SELECT id, user_profile_id, generation_status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM c WHERE generation_status <> 'failed'
            QUALIFY row_number() OVER (PARTITION BY user_profile_id ORDER BY created_at DESC, id DESC) = 1""",
    ),
    "recent_configs": (
        lambda s, d: firsts.recent_per_key(portable(s, d, CONFIGS), "user_profile_id").select("id", "user_profile_id"),
        with_model(c=CONFIGS) + "SELECT id, user_profile_id FROM c QUALIFY row_number() OVER (PARTITION BY user_profile_id ORDER BY created_at DESC, id DESC) <= 20",
    ),
    "recent_runs": (
        lambda s, d: firsts.recent_per_key(portable(s, d, RUNS), "user_profile_id", 5).select("id", "user_profile_id", "status"),
        with_model(c=RUNS) + "SELECT id, user_profile_id, status FROM c QUALIFY row_number() OVER (PARTITION BY user_profile_id ORDER BY created_at DESC, id DESC) <= 5",
    ),
    "active_runs": (
        lambda s, d: firsts.active_runs(portable(s, d, RUNS)).select("id", "user_profile_id", "status"),
        with_model(c=RUNS) + f"SELECT id, user_profile_id, status FROM c WHERE status NOT IN {_TERMINAL}",
    ),
    "active_run": (
        lambda s, d: firsts.active_run(portable(s, d, RUNS)).select("id", "user_profile_id", "status"),
        with_model(c=RUNS) + f"""SELECT id, user_profile_id, status FROM c WHERE status NOT IN {_TERMINAL}
            QUALIFY row_number() OVER (PARTITION BY user_profile_id ORDER BY created_at DESC, id DESC) = 1""",
    ),
    "active_run_violations": (
        lambda s, d: firsts.active_run_violations(portable(s, d, RUNS)),
        with_model(c=RUNS) + f"SELECT user_profile_id, count(*) AS active_runs FROM c WHERE status NOT IN {_TERMINAL} GROUP BY 1 HAVING count(*) > 1",
    ),
    "run_rollup": (
        lambda s, d: runs.rollup_runs(portable(s, d, SCRAPES)),
        with_model(c=SCRAPES) + """SELECT pipeline_run_id, count(*) AS scraper_runs, CAST(coalesce(sum(result_count) FILTER (WHERE status = 'succeeded'), 0) AS BIGINT) AS jobs_scraped,
            count(*) FILTER (WHERE status = 'succeeded' AND dataset_id IS NOT NULL) AS datasets, bool_or(status <> 'succeeded') AS any_scrape_failed FROM c GROUP BY 1""",
    ),
    "run_outcome": (
        lambda s, d: runs.derive_run_outcome(portable(s, d, OUTCOMES)).select("id", "outcome"),
        """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'completed' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'completed_with_errors' ELSE 'completed' END
            WHEN o_orderkey % 4 = 0 AND o_orderkey % 5 > 0 THEN 'failed' WHEN o_orderkey % 2 = 0 OR o_orderkey % 11 = 0 THEN 'completed_with_errors' ELSE 'completed' END AS outcome FROM orders""",
    ),
    "run_updates": (
        lambda s, d: runs.apply_run_updates(
            portable(s, d, RUN_STATE),
            portable(s, d, UPDATES).withColumn("at", F.col("d") + F.make_interval(secs=F.col("n"))).drop("d", "n"),
        ).withColumn("completed_at", F.col("completed_at").isNotNull()),
        with_model(u=UPDATES.replace("o_orderdate AS d", "o_orderdate + to_seconds(o_orderkey) AS d")) + """SELECT c_custkey AS id,
            coalesce(last(u.status ORDER BY d) FILTER (WHERE u.status IS NOT NULL), 'pending') AS status, CAST(NULL AS VARCHAR) AS search_configuration_id,
            last(u.jobs_scraped ORDER BY d) FILTER (WHERE u.jobs_scraped IS NOT NULL) AS jobs_scraped, 3 AS jobs_analyzed,
            last(u.error_message ORDER BY d) FILTER (WHERE u.error_message IS NOT NULL) AS error_message, coalesce(bool_or(completed), false) AS completed_at
            FROM customer LEFT JOIN u ON u.id = c_custkey GROUP BY 1""",
    ),
    "latest_batch": (
        lambda s, d: latest_batch(
            M.table(s, d, "events").select(F.col("event_type").alias("dataset_id"), "event_id"),
            M.table(s, d, "events").groupBy(F.col("event_type").alias("dataset_id")).agg(F.max("ts").alias("completed_at"), F.max("event_id").alias("id"))
            .withColumn("status", F.when(F.col("dataset_id") == "view", "failed").otherwise("succeeded")),
        ),
        """SELECT event_type AS dataset_id, event_id FROM events WHERE event_type = (SELECT event_type FROM events WHERE event_type <> 'view' GROUP BY 1 ORDER BY max(ts) DESC LIMIT 1)""",
    ),
    "scraper_run_updates": (
        lambda s, d: runs.apply_run_updates(
            portable(s, d, SCRAPER_STATE), portable(s, d, SCRAPER_UPDATES).withColumn("completed", F.col("step") > 1).withColumnRenamed("step", "at"),
            runs.SCRAPER_UPDATABLE,
        ),
        """SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'created' WHEN o_orderkey % 4 = 1 THEN 'running' WHEN o_orderkey % 4 = 2 THEN 'succeeded' ELSE 'failed' END AS status,
            CASE WHEN o_orderkey % 4 > 0 THEN 'set' || o_orderkey END AS dataset_id, CASE WHEN o_orderkey % 4 = 2 THEN o_custkey END AS result_count,
            CASE WHEN o_orderkey % 4 = 3 THEN 'failed to start' END AS error_message, CASE WHEN o_orderkey % 4 > 0 THEN 1 END AS started_at, CASE WHEN o_orderkey % 4 > 1 THEN 2 END AS completed_at FROM orders""",
    ),
}
