"""Daily metrics, backfills, trends and scores on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide import fixed
from jobtide.operators import backfill, daily, health
from jobtide.operators.counts import job_counts, snapshots_from_counts
from jobtide.operators.emerging import emerging_skills
from jobtide.operators.trend import jobs_trend, role_trend, skill_trend, trend_details, with_trends
from jobtide.testbed import model as M
from jobtide.testbed.model import DAY, END, EVENT_END, EVENT_START, START, with_model

KNOWN = f"first_seen_at < DATE '{DAY}' + 1"
TOTAL = f"(SELECT count(*) FROM job_dates WHERE {KNOWN})"


def jobs(s, d):
    return M.model(s, d, "jobs")


def dates(s, d):
    return M.model(s, d, "job_dates")


def _daily_sql(table: str, dim: str, extra: str = "") -> str:
    return f"""SELECT '{DAY}' AS metric_date, {dim}, count(DISTINCT b.job_id) AS job_count,
       count(DISTINCT b.job_id) / {TOTAL} * 100 AS demand_percentage{extra}
       FROM {table} b JOIN job_dates j ON j.job_id = b.job_id
       WHERE j.{KNOWN} AND {dim} IS NOT NULL GROUP BY {dim}"""


_PRIORITY_COUNTS = "".join(
    f", count(DISTINCT b.job_id) FILTER (WHERE b.priority = '{p}') AS {p}_count" for p in fixed.PRIORITIES
)
_JOBS_ONLY = {"jobs_core": "SELECT job_id, city, industry FROM jobs"}
_SPINE = f"SELECT CAST(d AS DATE) AS metric_date FROM generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY) t(d)"


def _backfill_sql(table: str, dim: str, extra: str = "") -> str:
    """Every date counted on its own, over all rows known on it."""
    return f"""SELECT CAST(metric_date AS VARCHAR) AS metric_date, c.{dim}, c.job_count,
        c.job_count / t.total * 100 AS demand_percentage{"".join(", c." + e for e in extra.split()) if extra else ""}
      FROM (SELECT s.metric_date, b.{dim}, count(*) AS job_count{
          "".join(f", count(*) FILTER (WHERE b.priority = '{e.split('_')[0]}') AS {e}" for e in extra.split())}
            FROM {table} b JOIN job_dates j ON j.job_id = b.job_id
            JOIN spine s ON CAST(j.first_seen_at AS DATE) <= s.metric_date
            WHERE b.{dim} IS NOT NULL GROUP BY 1, 2) c
      JOIN (SELECT s.metric_date, count(*) AS total FROM job_dates j
            JOIN spine s ON CAST(j.first_seen_at AS DATE) <= s.metric_date GROUP BY 1) t USING (metric_date)"""


_ROLE_KEY = M.NORM.format("b.actual_role")
_ROLE_OF = f"""SELECT b.job_id, f.name AS role FROM job_roles b
    JOIN roles s ON s.normalized_name = {_ROLE_KEY}
    JOIN roles f ON f.normalized_name = coalesce(s.merged_into_id, s.normalized_name)"""


def _trend_sql(value: str, days: int, dim: str | None = None) -> str:
    """Trend of row a of table m by a plain self-join on the preceding days."""
    same = f"AND p.{dim} = a.{dim}" if dim else ""
    return f"""(SELECT CASE WHEN count(*) >= {days} AND avg(p.{value}) <> 0
        THEN floor((a.{value} - avg(p.{value})) / avg(p.{value}) * 100 * 100 + 0.5) / 100 END
        FROM m p WHERE p.metric_date >= a.metric_date - {days} AND p.metric_date < a.metric_date {same})"""


EVENT_DAY = f"DATE '{EVENT_END}'"


def _emerging_sql(day: str, window: int, score_only: bool = False) -> str:
    reach = max(window, 30)
    recent = f"h.metric_date >= {day} - {window} AND h.metric_date > {day} - {reach}"
    return f"""
    , h AS (SELECT m.* FROM m WHERE metric_date <= {day} AND metric_date > {day} - {reach}),
    cand AS (SELECT * FROM m WHERE metric_date = {day} AND job_count >= 5 AND demand_percentage >= 2),
    f AS (SELECT c.skill_id, any_value(c.job_count) AS job_count, any_value(c.demand_percentage) AS today,
            count(*) FILTER (WHERE {recent}) AS recent,
            count(*) FILTER (WHERE {recent} AND h.job_count > 0) AS appeared,
            avg(h.demand_percentage) FILTER (WHERE h.metric_date >= {day} - 7) AS avg7,
            avg(h.demand_percentage) FILTER (WHERE h.metric_date >= {day} - 30) AS avg30
          FROM cand c JOIN h ON h.skill_id = c.skill_id GROUP BY c.skill_id),
    g AS (SELECT f.*, {_trend_sql("today_value", 7, "skill_id").replace("a.today_value", "f.today").replace("p.today_value", "p.demand_percentage").replace("a.metric_date", day).replace("a.skill_id", "f.skill_id")} AS growth_7d,
                 {_trend_sql("today_value", 30, "skill_id").replace("a.today_value", "f.today").replace("p.today_value", "p.demand_percentage").replace("a.metric_date", day).replace("a.skill_id", "f.skill_id")} AS growth_30d
          FROM f),
    emerging AS (SELECT n.name AS skill, recent >= 7 AS available,
        CASE WHEN recent < 7 THEN 'Insufficient historical data' END AS reason,
        CASE WHEN recent >= 7 THEN job_count END AS job_count,
        CASE WHEN recent >= 7 THEN today END AS demand_percentage,
        CASE WHEN recent >= 7 THEN growth_7d END AS growth_7d,
        CASE WHEN recent >= 7 THEN growth_30d END AS growth_30d,
        CASE WHEN recent >= 7 THEN floor((
            0.4 * CASE WHEN avg30 > 0 THEN (greatest(-100, least(100, (avg7 - avg30) / avg30 * 100)) + 100) / 2 ELSE 50 END
          + 0.3 * CASE WHEN avg7 > 0 THEN (greatest(-100, least(100, (today - avg7) / avg7 * 100)) + 100) / 2 ELSE 50 END
          + 0.2 * greatest(0, least(100, today * 5)) + 0.1 * (appeared / {window} * 100)) * 100 + 0.5) / 100
        END AS emerging_score
      FROM g JOIN names n ON n.normalized_name = g.skill_id
      WHERE recent < 7 OR growth_7d > 0)
    SELECT * FROM emerging"""


_SKILLS_45 = f"""SELECT s.metric_date, b.skill_id, count(*) AS job_count,
      count(*) / any_value(t.total) * 100 AS demand_percentage
    FROM job_skills b JOIN job_dates j ON j.job_id = b.job_id
    JOIN spine s ON CAST(j.first_seen_at AS DATE) <= s.metric_date
    JOIN (SELECT s2.metric_date, count(*) AS total FROM job_dates j2
          JOIN spine s2 ON CAST(j2.first_seen_at AS DATE) <= s2.metric_date GROUP BY 1) t ON t.metric_date = s.metric_date
    GROUP BY 1, 2"""
_SPINE_45 = f"SELECT CAST(d AS DATE) AS metric_date FROM generate_series(DATE '{DAY}' - 45, DATE '{DAY}', INTERVAL 1 DAY) t(d)"

HEALTH_SQL = f"""
    , div AS (SELECT metric_date, count(*) AS n FROM event_users GROUP BY 1),
    acc AS (SELECT count(*) FILTER (WHERE seniority IN ('Entry-Level', 'Junior', 'Mid-Level', 'Associate', 'Internship'))
              / nullif(count(*), 0) * 100 AS pct FROM job_roles WHERE seniority IS NOT NULL),
    p AS (SELECT a.*, {_trend_sql("total_jobs", 7)} AS growth,
        (SELECT count(*) FROM m h WHERE h.metric_date <= a.metric_date) AS snapshots,
        (SELECT min(total_jobs) FROM m h WHERE h.metric_date <= a.metric_date) AS lo1,
        (SELECT max(total_jobs) FROM m h WHERE h.metric_date <= a.metric_date) AS hi1,
        (SELECT min(unique_companies) FROM m h WHERE h.metric_date <= a.metric_date) AS lo2,
        (SELECT max(unique_companies) FROM m h WHERE h.metric_date <= a.metric_date) AS hi2,
        (SELECT min(average_applicants) FROM m h WHERE h.metric_date <= a.metric_date) AS lo3,
        (SELECT max(average_applicants) FROM m h WHERE h.metric_date <= a.metric_date) AS hi3,
        (SELECT min(n) FROM div h WHERE h.metric_date <= a.metric_date) AS lo4,
        (SELECT max(n) FROM div h WHERE h.metric_date <= a.metric_date) AS hi4,
        coalesce((SELECT n FROM div h WHERE h.metric_date = a.metric_date), 0) AS roles
      FROM m a),
    health AS (SELECT metric_date, CASE WHEN snapshots >= 7 THEN floor((
          0.30 * CASE WHEN lo1 IS NULL OR lo1 = hi1 THEN 50 ELSE (total_jobs - lo1) / (hi1 - lo1) * 100 END
        + 0.20 * CASE WHEN growth IS NULL THEN 50 ELSE (greatest(-100, least(100, growth)) + 100) / 2 END
        + 0.15 * CASE WHEN lo2 IS NULL OR lo2 = hi2 THEN 50 ELSE (unique_companies - lo2) / (hi2 - lo2) * 100 END
        + 0.15 * CASE WHEN average_applicants IS NULL THEN 50 ELSE 100 - CASE WHEN lo3 = hi3 THEN 50
                 ELSE (average_applicants - lo3) / (hi3 - lo3) * 100 END END
        + 0.10 * CASE WHEN lo4 IS NULL OR lo4 = hi4 THEN 50 ELSE (roles - lo4) / (hi4 - lo4) * 100 END
        + 0.10 * greatest(0, least(100, coalesce((SELECT pct FROM acc), 50)))) * 100 + 0.5) / 100 END AS score
      FROM p)"""
BUCKET = """CASE WHEN {0} IS NULL THEN 'Insufficient historical data' WHEN {0} >= 70 THEN 'Strong'
    WHEN {0} >= 40 THEN 'Moderate' ELSE 'Weak' END"""


def event_health(s, d):
    return health.market_health(M.model(s, d, "event_market"), M.model(s, d, "event_users"), M.job_roles(s, d))


def _roles_named(s, d):
    from jobtide.functions.text import norm_key

    named = daily.final_roles(M.model(s, d, "roles"))
    rows = M.job_roles(s, d).withColumn("normalized_name", norm_key("actual_role"))
    return rows.join(named, "normalized_name").select("job_id", "role")


_MARKET_E = {"m": M.SQL["event_market"]}
_SKILLS_E = {"m": M.SQL["event_skills"], "names": M.SQL["event_names"]}

QUERIES = {
    "total_jobs": (
        lambda s, d: daily.total_jobs(dates(s, d), DAY),
        with_model("job_dates") + f"SELECT count(*) AS total_jobs FROM job_dates WHERE {KNOWN}",
    ),
    "market_metrics": (
        lambda s, d: daily.daily_market_metrics(jobs(s, d), DAY),
        with_model("jobs") + f"""SELECT '{DAY}' AS metric_date, count(*) AS total_jobs,
            count(DISTINCT company) AS unique_companies, avg(applicants) AS average_applicants
            FROM jobs WHERE {KNOWN}""",
    ),
    "skill_metrics": (
        lambda s, d: daily.daily_skill_metrics(M.job_skills(s, d), dates(s, d), DAY),
        with_model("job_dates", "job_skills") + _daily_sql("job_skills", "skill_id", _PRIORITY_COUNTS),
    ),
    "role_metrics": (
        lambda s, d: daily.daily_role_metrics(M.job_roles(s, d), M.model(s, d, "roles"), dates(s, d), DAY),
        with_model("job_dates", "job_roles", "roles", named=_ROLE_OF) + _daily_sql("named", "role"),
    ),
    "capability_metrics": (
        lambda s, d: daily.daily_capability_metrics(M.job_capabilities(s, d), dates(s, d), DAY),
        with_model("job_dates", "job_capabilities") + _daily_sql("job_capabilities", "capability_id"),
    ),
    "seniority_metrics": (
        lambda s, d: daily.daily_seniority_metrics(M.job_roles(s, d), dates(s, d), DAY),
        with_model("job_dates", "job_roles") + _daily_sql("job_roles", "seniority"),
    ),
    "location_metrics": (
        lambda s, d: daily.daily_location_metrics(jobs(s, d), DAY),
        with_model("job_dates", "jobs", **_JOBS_ONLY) + _daily_sql("jobs_core", "city"),
    ),
    "industry_metrics": (
        lambda s, d: daily.daily_industry_metrics(jobs(s, d), DAY),
        with_model("job_dates", "jobs", **_JOBS_ONLY) + _daily_sql("jobs_core", "industry"),
    ),
    "unmatched_roles": (
        lambda s, d: daily.unmatched_roles(
            M.job_roles(s, d), M.model(s, d, "roles").filter("normalized_name <> 'machinery engineer'")
        ),
        with_model("job_roles", "roles") + f"""SELECT DISTINCT b.actual_role FROM job_roles b
            LEFT JOIN roles r ON r.normalized_name = {_ROLE_KEY} AND r.normalized_name <> 'machinery engineer'
            WHERE b.actual_role IS NOT NULL AND r.normalized_name IS NULL""",
    ),
    "multi_hop_roles": (
        lambda s, d: daily.final_roles(
            M.model(s, d, "roles").withColumn(
                "merged_into_id",
                F.when(F.col("normalized_name") == "building engineer", "machinery engineer").otherwise(F.col("merged_into_id")),
            )
        ).filter("multi_hop"),
        with_model("roles", moved="""SELECT name, normalized_name, CASE WHEN normalized_name = 'building engineer'
            THEN 'machinery engineer' ELSE merged_into_id END AS merged_into_id FROM roles""")
        + """SELECT s.normalized_name, f.name AS role, true AS multi_hop FROM moved s
            JOIN moved f ON f.normalized_name = coalesce(s.merged_into_id, s.normalized_name)
            WHERE f.merged_into_id IS NOT NULL""",
    ),
    "entry_mid_share": (
        lambda s, d: daily.entry_mid_share(M.job_roles(s, d), fixed.ENTRY_MID_LABELS),
        with_model("job_roles") + """SELECT count(*) FILTER (WHERE seniority IN ('Entry-Level', 'Junior', 'Mid-Level',
            'Associate', 'Internship')) / nullif(count(*), 0) * 100 AS accessible_pct
            FROM job_roles WHERE seniority IS NOT NULL""",
    ),
    "backfill_market": (
        lambda s, d: backfill.backfill_market(jobs(s, d), START, END),
        with_model("jobs", spine=_SPINE) + """SELECT CAST(s.metric_date AS VARCHAR) AS metric_date, count(job_id) AS total_jobs,
            count(DISTINCT company) AS unique_companies, avg(applicants) AS average_applicants
            FROM spine s LEFT JOIN jobs j ON CAST(j.first_seen_at AS DATE) <= s.metric_date GROUP BY 1""",
    ),
    "backfill_skill": (
        lambda s, d: backfill.backfill_skills(M.job_skills(s, d), dates(s, d), START, END),
        with_model("job_dates", "job_skills", spine=_SPINE)
        + _backfill_sql("job_skills", "skill_id", "critical_count important_count preferred_count"),
    ),
    "backfill_role": (
        lambda s, d: backfill.backfill_dimension(_roles_named(s, d), dates(s, d), "role", START, END),
        with_model("job_dates", "job_roles", "roles", named=_ROLE_OF, spine=_SPINE) + _backfill_sql("named", "role"),
    ),
    "backfill_capability": (
        lambda s, d: backfill.backfill_dimension(M.job_capabilities(s, d), dates(s, d), "capability_id", START, END),
        with_model("job_dates", "job_capabilities", spine=_SPINE) + _backfill_sql("job_capabilities", "capability_id"),
    ),
    "backfill_seniority": (
        lambda s, d: backfill.backfill_dimension(M.job_roles(s, d), dates(s, d), "seniority", START, END),
        with_model("job_dates", "job_roles", spine=_SPINE) + _backfill_sql("job_roles", "seniority"),
    ),
    "backfill_location": (
        lambda s, d: backfill.backfill_dimension(jobs(s, d), jobs(s, d), "city", START, END),
        with_model("job_dates", "jobs", spine=_SPINE, **_JOBS_ONLY) + _backfill_sql("jobs_core", "city"),
    ),
    "backfill_industry": (
        lambda s, d: backfill.backfill_dimension(jobs(s, d), jobs(s, d), "industry", START, END),
        with_model("job_dates", "jobs", spine=_SPINE, **_JOBS_ONLY) + _backfill_sql("jobs_core", "industry"),
    ),
    "jobs_trend_1d_7d_30d": (
        lambda s, d: jobs_trend(M.model(s, d, "event_market")).drop("average_applicants"),
        with_model(**_MARKET_E) + f"""SELECT CAST(metric_date AS VARCHAR) AS metric_date, total_jobs, unique_companies,
            {_trend_sql("total_jobs", 1)} AS change_1d, {_trend_sql("total_jobs", 7)} AS change_7d,
            {_trend_sql("total_jobs", 30)} AS change_30d FROM m a""",
    ),
    "skill_trend": (
        lambda s, d: skill_trend(M.model(s, d, "event_skills")),
        with_model(**_SKILLS_E) + f"""SELECT CAST(metric_date AS VARCHAR) AS metric_date, skill_id, job_count, demand_percentage,
            {_trend_sql("demand_percentage", 7, "skill_id")} AS change_7d,
            {_trend_sql("demand_percentage", 30, "skill_id")} AS change_30d FROM m a""",
    ),
    "role_trend": (
        lambda s, d: role_trend(
            backfill.backfill_dimension(_roles_named(s, d), dates(s, d), "role", START, END)
        ),
        with_model("job_dates", "job_roles", "roles", named=_ROLE_OF, spine=_SPINE,
                   m=_backfill_sql("named", "role").replace("CAST(metric_date AS VARCHAR) AS metric_date", "metric_date"))
        + """SELECT CAST(metric_date AS VARCHAR) AS metric_date, role, job_count, demand_percentage,
            CASE WHEN count(*) OVER w >= 7 AND avg(demand_percentage) OVER w <> 0 THEN
              floor((demand_percentage - avg(demand_percentage) OVER w) / avg(demand_percentage) OVER w * 100 * 100 + 0.5) / 100
            END AS change_7d
            FROM m WINDOW w AS (PARTITION BY role ORDER BY metric_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
    ),
    "trend_details": (
        lambda s, d: trend_details(M.model(s, d, "event_skills"), "job_count", "skill_id", 7),
        with_model(**_SKILLS_E) + """, t AS (SELECT a.metric_date, a.skill_id, a.job_count AS cur,
              count(p.metric_date) AS n, avg(p.job_count) AS av
            FROM m a LEFT JOIN m p ON p.skill_id = a.skill_id AND p.metric_date >= a.metric_date - 7
              AND p.metric_date < a.metric_date GROUP BY ALL)
            SELECT CAST(metric_date AS VARCHAR) AS metric_date, skill_id, n >= 7 AS available,
              CASE WHEN n >= 7 THEN cur END AS "current", 7 AS "window",
              CASE WHEN n >= 7 THEN floor(av * 100 + 0.5) / 100 END AS previous_period_average,
              CASE WHEN n >= 7 THEN floor((cur - av) / av * 100 * 100 + 0.5) / 100 END AS trend_percentage FROM t""",
    ),
    "trend_gaps": (
        # NULL values count as 0 and as a row; a missing day makes the window too short.
        lambda s, d: with_trends(
            M.model(s, d, "event_skills")
            .filter("NOT (skill_id = 'view' AND metric_date = DATE '2024-01-10')")
            .withColumn("v", F.when(F.col("skill_id") != "click", F.col("job_count")).when(F.dayofmonth("metric_date") % 3 != 0, F.col("job_count"))),
            "v", "skill_id", (7,),
        ).select("metric_date", "skill_id", "v", "change_7d"),
        with_model(src=M.SQL["event_skills"], m="""SELECT metric_date, skill_id,
            CASE WHEN skill_id <> 'click' OR day(metric_date) % 3 <> 0 THEN job_count END AS v FROM src
            WHERE NOT (skill_id = 'view' AND metric_date = DATE '2024-01-10')""")
        + """SELECT CAST(a.metric_date AS VARCHAR) AS metric_date, a.skill_id, any_value(a.v) AS v,
            CASE WHEN count(p.metric_date) >= 7 AND avg(coalesce(p.v, 0)) <> 0 THEN
              floor((any_value(a.v) - avg(coalesce(p.v, 0))) / avg(coalesce(p.v, 0)) * 100 * 100 + 0.5) / 100 END AS change_7d
            FROM m a LEFT JOIN m p ON p.skill_id = a.skill_id AND p.metric_date >= a.metric_date - 7 AND p.metric_date < a.metric_date
            GROUP BY 1, 2""",
    ),
    "emerging_skills": (
        lambda s, d: emerging_skills(M.model(s, d, "event_skills"), M.model(s, d, "event_names"), EVENT_END),
        with_model(**_SKILLS_E) + _emerging_sql(EVENT_DAY, 14),
    ),
    "emerging_skills_wide_window": (
        lambda s, d: emerging_skills(M.model(s, d, "event_skills"), M.model(s, d, "event_names"), EVENT_END, window=40),
        with_model(**_SKILLS_E) + _emerging_sql(EVENT_DAY, 40),
    ),
    "emerging_skills_backfilled": (
        lambda s, d: emerging_skills(
            backfill.backfill_skills(M.job_skills(s, d), dates(s, d), "1998-05-01", DAY), M.model(s, d, "skills"), DAY
        ),
        with_model("job_dates", "job_skills", spine=_SPINE_45, m=_SKILLS_45, names=M.SQL["skills"])
        + _emerging_sql(f"DATE '{DAY}'", 14),
    ),
    "market_health": (
        event_health,
        with_model("event_users", "job_roles", **_MARKET_E) + HEALTH_SQL
        + f"SELECT CAST(metric_date AS VARCHAR) AS metric_date, score, {BUCKET.format('score')} AS status FROM health",
    ),
    "apply_health": (
        lambda s, d: health.apply_health(
            M.model(s, d, "event_market").select("metric_date", "total_jobs", F.lit(1.0).alias("market_health_score")),
            event_health(s, d),
        ),
        with_model("event_users", "job_roles", **_MARKET_E) + HEALTH_SQL
        + """SELECT CAST(m.metric_date AS VARCHAR) AS metric_date, total_jobs, coalesce(score, 1.0::DOUBLE) AS market_health_score
            FROM m JOIN health h ON h.metric_date = m.metric_date""",
    ),
    "upsert_market_row": (
        lambda s, d: health.upsert_market_row(
            M.model(s, d, "event_market").filter("day(metric_date) <= 20").withColumn(
                "market_health_score", F.dayofmonth("metric_date").cast("double")
            ),
            M.model(s, d, "event_market").filter("day(metric_date) > 10").withColumn("total_jobs", F.col("total_jobs") * 2)
            .withColumn("average_applicants", F.lit(None).cast("double")),
        ),
        with_model(**_MARKET_E) + """SELECT CAST(metric_date AS VARCHAR) AS metric_date,
            CASE WHEN day(metric_date) > 10 THEN total_jobs * 2 ELSE total_jobs END AS total_jobs, unique_companies,
            CASE WHEN day(metric_date) > 10 THEN NULL ELSE average_applicants END AS average_applicants,
            CASE WHEN day(metric_date) <= 20 THEN CAST(day(metric_date) AS DOUBLE) END AS market_health_score FROM m""",
    ),
}


def _from_counts(table: str):
    """The figures of every date out of counts per (first day, value), which are stored with a state."""

    def query(s, d):
        counts = job_counts(jobs(s, d).withColumnRenamed("job_id", "external_job_id"), M.job_skills(s, d), M.job_capabilities(s, d), M.job_roles(s, d))
        return snapshots_from_counts(counts, M.model(s, d, "roles"), START, END)[table]

    return query


# The same figures as the backfill of each name, on another way.
QUERIES |= {
    f"counted_{name}": (_from_counts(f"daily_{name}_metrics"), QUERIES[f"backfill_{name}"][1])
    for name in ("market", "skill", "role", "capability", "seniority", "location", "industry")
}
