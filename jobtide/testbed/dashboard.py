"""User-facing result sets on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide.functions.scoring import bucket_status
from jobtide.operators import backfill, daily, health
from jobtide.plans import dashboard
from jobtide.testbed import metrics as T
from jobtide.testbed import model as M
from jobtide.testbed.model import DAY, EVENT_END, START, with_model

_E = {"m": M.SQL["event_market"]}
_S = {"m": M.SQL["event_skills"], "names": M.SQL["event_names"]}
_LATEST = "(SELECT max(metric_date) FROM m)"


def scored_market(s, d):
    market = M.model(s, d, "event_market").withColumn("market_health_score", F.lit(None).cast("double"))
    return health.apply_health(market, T.event_health(s, d))


def _overview_sql(day: str) -> str:
    bucket = T.BUCKET.format("h.score")
    return (
        with_model("event_users", "job_roles", **_E) + T.HEALTH_SQL
        + f"""SELECT CAST(q.d AS VARCHAR) AS metric_date, h.score AS health_score, {bucket} AS health_status, a.total_jobs,
            {T._trend_sql("total_jobs", 1)} AS change_1d, {T._trend_sql("total_jobs", 7)} AS change_7d,
            {T._trend_sql("total_jobs", 30)} AS change_30d, a.unique_companies, a.average_applicants
            FROM (SELECT {day} AS d) q LEFT JOIN m a ON a.metric_date = q.d LEFT JOIN health h ON h.metric_date = q.d"""
    )


def _role_metrics(s, d):
    return backfill.backfill_dimension(T._roles_named(s, d), T.dates(s, d), "role", "1998-06-01", DAY)


def _bars(s, d):
    return dashboard.ranked_bars(daily.daily_skill_metrics(M.job_skills(s, d), T.dates(s, d), DAY), "skill_id", n=12)


def _ranked_sql(table: str, dim: str, day: str = DAY) -> str:
    return T._daily_sql(table, dim)


QUERIES = {
    "overview": (lambda s, d: dashboard.overview(scored_market(s, d)), _overview_sql(_LATEST)),
    "overview_of_date": (
        lambda s, d: dashboard.overview(scored_market(s, d), "2024-01-12"), _overview_sql("DATE '2024-01-12'"),
    ),
    "overview_missing_date": (
        lambda s, d: dashboard.overview(scored_market(s, d), "2023-06-01"), _overview_sql("DATE '2023-06-01'"),
    ),
    "skills_ranked": (
        lambda s, d: dashboard.skills_ranked(M.model(s, d, "event_skills"), M.model(s, d, "event_names")),
        with_model(**_S) + f"""SELECT CAST(metric_date AS VARCHAR) AS metric_date, name, job_count, demand_percentage,
            {T._trend_sql("demand_percentage", 7, "skill_id")} AS change_7d,
            {T._trend_sql("demand_percentage", 30, "skill_id")} AS change_30d
            FROM m a JOIN names n ON n.normalized_name = a.skill_id WHERE metric_date = {_LATEST}""",
    ),
    "top_skills": (
        lambda s, d: daily.daily_skill_metrics(M.job_skills(s, d), T.dates(s, d), DAY)
        .join(M.model(s, d, "skills").withColumnRenamed("normalized_name", "skill_id"), "skill_id")
        .select("metric_date", "name", "job_count", "demand_percentage", "critical_count", "important_count", "preferred_count")
        .orderBy(F.desc("demand_percentage"), "name"),
        with_model("job_dates", "job_skills", "skills") + f"""SELECT metric_date, name, job_count, demand_percentage,
            critical_count, important_count, preferred_count
            FROM ({T._daily_sql("job_skills", "skill_id", T._PRIORITY_COUNTS)}) JOIN skills ON normalized_name = skill_id""",
    ),
    "emerging_ranked": (
        lambda s, d: dashboard.emerging_ranked(M.model(s, d, "event_skills"), M.model(s, d, "event_names"), EVENT_END)
        .select("skill", "available", "emerging_score"),
        with_model(**_S) + T._emerging_sql(T.EVENT_DAY, 14).replace(
            "SELECT * FROM emerging", "SELECT skill, available, emerging_score FROM emerging"),
    ),
    "emerging_available": (
        # A date with a short history: only rows that could be scored remain.
        lambda s, d: dashboard.emerging_available(
            M.model(s, d, "event_skills").filter("NOT (skill_id = 'view' AND metric_date < DATE '2024-01-06')"),
            M.model(s, d, "event_names"), "2024-01-10",
        ),
        with_model(src=M.SQL["event_skills"],
                   m="SELECT * FROM src WHERE NOT (skill_id = 'view' AND metric_date < DATE '2024-01-06')",
                   names=M.SQL["event_names"])
        + T._emerging_sql("DATE '2024-01-10'", 14) + " WHERE available",
    ),
    "emerging_short_history": (
        lambda s, d: dashboard.emerging_ranked(M.model(s, d, "event_skills"), M.model(s, d, "event_names"), "2024-01-05"),
        with_model(**_S) + T._emerging_sql("DATE '2024-01-05'", 14),
    ),
    "roles_ranked": (
        lambda s, d: dashboard.roles_ranked(_role_metrics(s, d)),
        with_model("job_dates", "job_roles", "roles", named=T._ROLE_OF,
                   spine=f"SELECT CAST(d AS DATE) AS metric_date FROM generate_series(DATE '1998-06-01', DATE '{DAY}', INTERVAL 1 DAY) t(d)",
                   m=T._backfill_sql("named", "role").replace("CAST(metric_date AS VARCHAR) AS metric_date", "metric_date"))
        + f"""SELECT CAST(metric_date AS VARCHAR) AS metric_date, role, job_count, demand_percentage,
            {T._trend_sql("demand_percentage", 7, "role")} AS trend FROM m a WHERE metric_date = {_LATEST}""",
    ),
    "capabilities_ranked": (
        lambda s, d: dashboard.capabilities_ranked(
            daily.daily_capability_metrics(M.job_capabilities(s, d), T.dates(s, d), DAY), M.capabilities(s, d)
        ),
        with_model("job_dates", "job_capabilities", "capabilities") + f"""SELECT metric_date, name, job_count, demand_percentage
            FROM ({T._daily_sql("job_capabilities", "capability_id")}) JOIN capabilities ON normalized_name = capability_id""",
    ),
    "seniority_ranked": (
        lambda s, d: dashboard.dimension_ranked(
            daily.daily_seniority_metrics(M.job_roles(s, d), T.dates(s, d), DAY), "seniority"),
        with_model("job_dates", "job_roles") + T._daily_sql("job_roles", "seniority"),
    ),
    "locations_ranked": (
        lambda s, d: dashboard.dimension_ranked(daily.daily_location_metrics(T.jobs(s, d), DAY), "city"),
        with_model("job_dates", "jobs", **T._JOBS_ONLY) + T._daily_sql("jobs_core", "city"),
    ),
    "industries_ranked": (
        lambda s, d: dashboard.dimension_ranked(daily.daily_industry_metrics(T.jobs(s, d), DAY), "industry"),
        with_model("job_dates", "jobs", **T._JOBS_ONLY) + T._daily_sql("jobs_core", "industry"),
    ),
    "jobs_list": (
        lambda s, d: dashboard.jobs_list(T.jobs(s, d), M.job_roles(s, d)),
        with_model("jobs", "job_roles") + """SELECT j.job_id, title, company, city, industry, applicants,
            strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at,
            strftime(posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at, r.actual_role, r.seniority
            FROM jobs j LEFT JOIN job_roles r ON r.job_id = j.job_id""",
    ),
    "ranked_bars": (
        _bars,
        with_model("job_dates", "job_skills") + f""", t AS ({T._daily_sql("job_skills", "skill_id")}),
            top AS (SELECT * FROM t ORDER BY demand_percentage DESC, skill_id LIMIT 12)
            SELECT skill_id AS label, job_count AS "count", demand_percentage AS "value",
              demand_percentage / greatest((SELECT max(demand_percentage) FROM top), 1.0) * 100 AS width FROM top""",
    ),
    "trends_report": (
        lambda s, d: dashboard.trends_report(
            M.model(s, d, "event_market"), M.model(s, d, "event_skills"), M.model(s, d, "event_names"),
            T.event_health(s, d), EVENT_END,
        ),
        with_model("event_users", "job_roles", "event_skills", names=M.SQL["event_names"], **_E) + T.HEALTH_SQL
        + f""", jt AS (SELECT {T._trend_sql("total_jobs", 1)} AS d1, {T._trend_sql("total_jobs", 7)} AS d7,
                {T._trend_sql("total_jobs", 30)} AS d30 FROM m a WHERE metric_date = {_LATEST}),
            st AS (SELECT name, {T._trend_sql("demand_percentage", 7, "skill_id").replace("FROM m p", "FROM event_skills p")} AS d7,
                {T._trend_sql("demand_percentage", 30, "skill_id").replace("FROM m p", "FROM event_skills p")} AS d30
                FROM event_skills a JOIN names n ON n.normalized_name = a.skill_id WHERE metric_date = {_LATEST}
                ORDER BY demand_percentage DESC, name LIMIT 5),
            em AS ({with_model(**_S) + T._emerging_sql(T.EVENT_DAY, 14)})
            SELECT 'jobs' AS section, 'all' AS name, 'change_1d' AS metric, d1 AS "value" FROM jt
            UNION ALL SELECT 'jobs', 'all', 'change_7d', d7 FROM jt UNION ALL SELECT 'jobs', 'all', 'change_30d', d30 FROM jt
            UNION ALL SELECT 'skills', name, 'change_7d', d7 FROM st UNION ALL SELECT 'skills', name, 'change_30d', d30 FROM st
            UNION ALL SELECT 'emerging', skill, 'score', emerging_score FROM em
            UNION ALL SELECT 'health', {T.BUCKET.format("score")}, 'score', score FROM health WHERE metric_date = {_LATEST}""",
    ),
    "snapshot_dates": (
        lambda s, d: dashboard.snapshot_dates({
            "market": M.model(s, d, "event_market"), "skills": M.model(s, d, "event_skills"),
            "roles": M.model(s, d, "event_users").filter("metric_date < DATE '2024-01-28'"),
        }),
        with_model("event_users", "event_skills", **_E) + """, t AS (
            SELECT 'market' AS table_name, max(metric_date) AS md FROM m UNION ALL SELECT 'skills', max(metric_date) FROM event_skills
            UNION ALL SELECT 'roles', max(metric_date) FROM event_users WHERE metric_date < DATE '2024-01-28')
            SELECT table_name, CAST(md AS VARCHAR) AS metric_date, (SELECT count(DISTINCT md) = 1 FROM t) AS consistent FROM t""",
    ),
    "latest_date": (
        lambda s, d: dashboard.latest_date(M.model(s, d, "event_market")),
        with_model(**_E) + f"SELECT CAST({_LATEST} AS VARCHAR) AS metric_date",
    ),
    "bucket_status": (
        lambda s, d: M.table(s, d, "events").select("event_id", bucket_status(F.when(F.col("event_type") != "view", F.col("value"))).alias("status")),
        f"""SELECT event_id, {T.BUCKET.format("v")} AS status FROM (SELECT event_id,
            CASE WHEN event_type <> 'view' THEN "value" END AS v FROM events)""",
    ),
}
