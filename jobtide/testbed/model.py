"""The job-market model derived from the star-schema test tables.

Each adapter is one portable SELECT over ``{table}`` placeholders, so Spark
and the checking SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
DAY = "1998-06-15"
START, END = "1995-01-01", "2001-08-01"
EVENT_START, EVENT_END = "2024-01-01", "2024-01-30"

SENIORITY = {"1-urgent": "Senior", "2-high": "Mid-Level", "3-medium": "Junior", "5-low": "Internship"}
RULES = [
    (r"\bring\b", "Shape Rings"),
    (r"widget|gizmo", "Assemble Widgets"),
    (r"^small", "Handle Small Parts"),
    (r"anvil", "Forge Anvils"),
]

SQL = {
    # Only what the bridges need of a job.
    "job_dates": "SELECT o_orderkey AS job_id, o_orderdate AS first_seen_at FROM {orders}",
    "jobs": """
        SELECT o_orderkey AS job_id, 'Order ' || o_orderpriority AS title, c_name AS company, n_name AS city,
               c_mktsegment AS industry, o_orderdate AS first_seen_at,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS posted_at,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS INT) END AS applicants
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "job_roles_raw": """
        SELECT o_orderkey AS job_id, o_orderpriority AS seniority_text,
               CASE WHEN o_orderkey % 12 = 3 THEN NULL
                    WHEN o_orderkey % 4 = 0 THEN c_mktsegment || '  ENGINEER'
                    WHEN o_orderkey % 4 = 1 THEN ' ' || lower(c_mktsegment) || ' engineer '
                    ELSE lower(c_mktsegment) || ' Engineer' END AS actual_role
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "roles": """
        SELECT DISTINCT lower(c_mktsegment) || ' engineer' AS normalized_name,
               c_mktsegment || ' Engineer' AS name,
               CASE WHEN c_mktsegment = 'FURNITURE' THEN 'building engineer' END AS merged_into_id
        FROM {customer}""",
    "lines": """
        SELECT l_orderkey AS job_id, lower(p_brand) AS skill_id, p_type, l_linenumber,
               CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS priority_rank
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "skills": "SELECT DISTINCT p_brand AS name, lower(p_brand) AS normalized_name FROM {part}",
    "job_parts": "SELECT l_orderkey AS job_id, p_name FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    # Daily series out of the event stream.
    "event_market": """
        SELECT CAST(ts AS DATE) AS metric_date, count(*) AS total_jobs, count(DISTINCT user_id) AS unique_companies,
               avg(floor(value)) AS average_applicants
        FROM {events} GROUP BY 1""",
    "event_skills": """
        SELECT e.metric_date, e.skill_id, e.job_count, e.job_count / t.total_jobs * 100 AS demand_percentage
        FROM (SELECT CAST(ts AS DATE) AS metric_date, event_type AS skill_id, CAST(count(*) AS DOUBLE) AS job_count
              FROM {events} GROUP BY 1, 2) e
        JOIN (SELECT CAST(ts AS DATE) AS metric_date, count(*) AS total_jobs FROM {events} GROUP BY 1) t
          ON e.metric_date = t.metric_date""",
    "event_users": """
        SELECT CAST(ts AS DATE) AS metric_date, CAST(user_id AS STRING) AS role, count(*) AS job_count
        FROM {events} WHERE event_type = 'purchase' AND CAST(ts AS DATE) <> DATE '2024-01-20' GROUP BY 1, 2""",
    "event_names": "SELECT DISTINCT event_type AS normalized_name, upper(event_type) AS name FROM {events}",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def portable(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a portable SELECT with ``{table}`` placeholders on Spark."""
    used = {name: table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in sql}
    return spark.sql(sql, **used)


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return portable(spark, sf_dir, SQL[name])


def duck(sql: str) -> str:
    """The same SELECT for the checking engine."""
    return sql.format(**{name: name for name in TABLES})


def with_model(*names: str, **extra: str) -> str:
    """WITH clause holding the named adapters and further named SELECTs."""
    parts = [f"{n} AS MATERIALIZED ({CHECK_SQL.get(n) or duck(SQL[n])})" for n in names]
    parts += [f"{n} AS MATERIALIZED ({duck(sql)})" for n, sql in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"


_SENIORITY_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SENIORITY.items())
_RULE_CASE = " ".join(f"WHEN regexp_matches(p_name, '{p}', 'i') THEN '{n}'" for p, n in RULES)
NORM = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"

# Checking SQL of the tables that Spark derives with the operators.
CHECK_SQL = {
    "job_roles": f"""
        SELECT job_id, actual_role,
               coalesce(CASE lower(seniority_text) {_SENIORITY_CASE} END, seniority_text) AS seniority
        FROM ({duck(SQL["job_roles_raw"])})""",
    "job_skills": f"""
        SELECT job_id, skill_id, first(p_type ORDER BY l_linenumber, p_type) AS category,
               CASE min(priority_rank) WHEN 1 THEN 'critical' WHEN 2 THEN 'important' ELSE 'preferred' END AS priority
        FROM ({duck(SQL["lines"])}) GROUP BY 1, 2""",
    "job_capabilities": f"""
        SELECT DISTINCT job_id, lower(coalesce(CASE {_RULE_CASE} END, p_name)) AS capability_id
        FROM ({duck(SQL["job_parts"])})""",
    "capabilities": f"""
        SELECT DISTINCT lower(coalesce(CASE {_RULE_CASE} END, p_name)) AS normalized_name,
               coalesce(CASE {_RULE_CASE} END, p_name) AS name FROM part""",
}


def job_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobtide.functions.names import normalize_seniority

    return model(spark, sf_dir, "job_roles_raw").select(
        "job_id", "actual_role", normalize_seniority("seniority_text", SENIORITY).alias("seniority")
    )


def job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (job, skill), strongest priority, category of the first line."""
    rank = F.min("priority_rank")
    priority = F.when(rank == 1, "critical").when(rank == 2, "important").otherwise("preferred")
    first = F.min(F.struct("l_linenumber", "p_type"))["p_type"]
    return (
        model(spark, sf_dir, "lines")
        .groupBy("job_id", "skill_id")
        .agg(first.alias("category"), priority.alias("priority"))
    )


def job_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobtide.functions.names import normalize_capability
    from jobtide.functions.text import norm_key

    # Names repeat in the part table: normalise each part once, before the join.
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), norm_key(normalize_capability("p_name", RULES)).alias("capability_id")
    )
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_partkey")
    return lines.join(part, "l_partkey").select("job_id", "capability_id").distinct()


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobtide.functions.names import normalize_capability
    from jobtide.functions.text import norm_key

    name = normalize_capability("p_name", RULES)
    return table(spark, sf_dir, "part").select(norm_key(name).alias("normalized_name"), name.alias("name")).distinct()


def printable(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, so that both engines return the same type."""
    formats = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss"}
    return df.select(
        *[
            F.date_format(F.col(f"`{name}`"), formats[kind]).alias(name) if kind in formats else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )
