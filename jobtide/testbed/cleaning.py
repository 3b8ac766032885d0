"""Cleaning expressions on messy values built from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide.functions import checks, clean, names, text, urls
from jobtide.functions import variants as V
from jobtide.testbed import model as M
from jobtide.testbed.model import duck, portable

# Messy scalar texts, one row per event.
_MESSY = """
    SELECT event_id, event_type,
      CASE event_id % 8 WHEN 0 THEN ' NULL ' WHEN 1 THEN 'null' WHEN 2 THEN '' WHEN 3 THEN '  ' || event_type || '  x '
        WHEN 4 THEN upper(event_type) WHEN 5 THEN NULL WHEN 6 THEN 'Null' ELSE event_type END AS a,
      CASE event_id % 3 WHEN 0 THEN 'Null' WHEN 1 THEN '' ELSE 'second ' || event_type END AS b,
      CASE event_id % 6 WHEN 0 THEN CAST(user_id AS STRING) WHEN 1 THEN 'Over ' || CAST(user_id AS STRING) || ',200 applicants'
        WHEN 2 THEN 'be early' WHEN 3 THEN NULL WHEN 4 THEN CAST(user_id AS STRING) || '+ of 9' ELSE 'x1,,2' END AS applicants,
      CASE event_id % 7 WHEN 0 THEN ' ' || CAST(user_id % 9 AS STRING) || ' - ' || CAST(user_id AS STRING) WHEN 1 THEN CAST(user_id % 9 AS STRING) || '+'
        WHEN 2 THEN CAST(user_id % 9 AS STRING) WHEN 3 THEN 'some' WHEN 4 THEN NULL WHEN 5 THEN '3.5' ELSE '8 +' END AS y1,
      CASE event_id % 5 WHEN 0 THEN '2-4' WHEN 1 THEN NULL WHEN 2 THEN '6+' WHEN 3 THEN 'n/a' ELSE '1' END AS y2,
      CASE event_id % 4 WHEN 0 THEN '7' WHEN 1 THEN '5-9' ELSE NULL END AS y3,
      CASE event_id % 6 WHEN 0 THEN 'Pune, MH, ' || event_type WHEN 1 THEN 'Remote' WHEN 2 THEN ', ,IN' WHEN 3 THEN 'a,b' WHEN 4 THEN 'null' ELSE 'x,y,z' END AS loc,
      CASE event_id % 5 WHEN 0 THEN 'Oslo' WHEN 1 THEN 'null' WHEN 2 THEN '' ELSE NULL END AS city,
      CASE event_id % 11 WHEN 0 THEN 'East' ELSE NULL END AS st
    FROM {events}"""
# Names a taxonomy sees, with alias, case and space variants.
_NAMES = """
    SELECT event_id,
      CASE event_id % 10 WHEN 0 THEN ' Lang  Chain ' WHEN 1 THEN 'LLMs' WHEN 2 THEN 'Kafka' WHEN 3 THEN 'POSTGRES' WHEN 4 THEN 'ci/cd  pipeline'
        WHEN 5 THEN 'Retrieval-Augmented Generation' WHEN 6 THEN ' ' || event_type WHEN 7 THEN 'aws' WHEN 8 THEN 'Vector DB' ELSE upper(event_type) || '  Tool' END AS skill,
      CASE event_id % 6 WHEN 0 THEN 'GenAI  Engineer' WHEN 1 THEN ' llm engineer' WHEN 2 THEN ' ' WHEN 3 THEN NULL WHEN 4 THEN 'Gen AI Engineer' ELSE ' ' || event_type || ' Engineer' END AS role,
      CASE event_id % 9 WHEN 0 THEN 'Mid-Senior  level' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN ' Director ' WHEN 3 THEN 'entry level' WHEN 4 THEN 'Intern' WHEN 5 THEN ''
        WHEN 6 THEN NULL WHEN 7 THEN 'senior' ELSE event_type END AS seniority,
      CASE event_id % 13 WHEN 0 THEN 'Deploy RAG agents' WHEN 1 THEN ' Evaluate ' || event_type WHEN 2 THEN 'Mentor  peers' WHEN 3 THEN 'Agents we DESIGN'
        WHEN 4 THEN 'multi agent planning' WHEN 5 THEN 'Use MCP' WHEN 6 THEN 'Observability of ' || event_type WHEN 7 THEN 'deployment' WHEN 8 THEN 'scalable storage'
        WHEN 9 THEN 'production-grade AI' WHEN 10 THEN 'backend API for ' || event_type WHEN 11 THEN 'fragile' ELSE ' ' || event_type END AS capability
    FROM {events}"""
_DATES = """
    SELECT event_id, CASE event_id % 7 WHEN 0 THEN '2020-13-45' WHEN 1 THEN '2021-02-29' WHEN 2 THEN '2024-02-29' WHEN 3 THEN CAST(CAST(ts AS DATE) AS STRING)
        WHEN 4 THEN '2024-1-5' WHEN 5 THEN NULL ELSE event_type END AS day,
      CASE event_id % 3 WHEN 0 THEN '0A1b2c3d-0000-4000-8000-00000000' || lpad(CAST(user_id AS STRING), 4, '0') WHEN 1 THEN event_type ELSE '0a1b2c3d-0000-4000-8000' END AS id
    FROM {events}"""
_VARIANT = """
    SELECT event_id, user_id, CASE event_id % 12 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '" Implied "' WHEN 3 THEN '["x", ' || CAST(user_id AS STRING) || ']'
      WHEN 4 THEN '[]' WHEN 5 THEN 'null' WHEN 6 THEN '"yes"' WHEN 7 THEN '1' WHEN 8 THEN CAST(user_id AS STRING) || '.75'
      WHEN 9 THEN '"Over ' || CAST(user_id AS STRING) || ' people"' WHEN 10 THEN '"' || CAST(user_id % 9 AS STRING) || '+"' ELSE '[[' || CAST(user_id AS STRING) || ']]' END AS j
    FROM {events}"""
_SEARCH = """
    SELECT event_id, event_type || ' C++ & "' || CAST(user_id AS STRING) || '" ~*é' AS kw,
      CASE event_id % 3 WHEN 0 THEN 'São Paulo, BR' WHEN 1 THEN '' ELSE NULL END AS loc, (event_id % 4) * 25 AS st,
      CASE event_id % 4 WHEN 0 THEN 'pastWeek' WHEN 1 THEN 'any' WHEN 2 THEN 'past24Hours' ELSE 'never' END AS dp
    FROM {events}"""
_TITLES = """
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'C++ ' || p_name WHEN 2 THEN upper(p_name) WHEN 3 THEN NULL
      WHEN 4 THEN p_name || 's' ELSE p_name END AS title, split_part(p_name, ' ', 2) AS term FROM {part}"""


def _rows(sql):
    return lambda s, d: portable(s, d, sql)


def _null(c):
    return f"CASE WHEN lower(trim({c})) = 'null' THEN NULL ELSE {c} END"


def _years(c):
    t = f"trim({c})"
    span, plus, one = (f"regexp_extract({t}, '{p}', {{}})" for p in (r"^(\d+)\s*-\s*(\d+)$", r"^(\d+)\s*\+$", r"^(\d+)$"))
    low = f"coalesce(try_cast({span.format(1)} AS DOUBLE), try_cast({plus.format(1)} AS DOUBLE), try_cast({one.format(1)} AS DOUBLE))"
    high = f"coalesce(try_cast({span.format(2)} AS DOUBLE), try_cast({one.format(1)} AS DOUBLE))"
    return low, high


(_L1, _H1), (_L2, _H2), (_L3, _H3) = (_years(c) for c in ("y1", "y2", "y3"))
_MESSY_D, _NAMES_D = f"FROM ({duck(_MESSY)})", f"FROM ({duck(_NAMES)})"


def _norm(c):
    return M.NORM.format(c)


_SKILL = f"""CASE {_norm("skill")} WHEN 'lang chain' THEN 'LangChain' WHEN 'llms' THEN 'LLM' WHEN 'postgres' THEN 'PostgreSQL'
    WHEN 'ci/cd pipeline' THEN 'CI/CD' WHEN 'retrieval-augmented generation' THEN 'RAG' WHEN 'aws' THEN 'AWS'
    WHEN 'vector db' THEN 'Vector Databases' ELSE trim(skill) END"""
_CAPABILITY = r"""CASE WHEN regexp_matches(c, '\brag\b', 'i') THEN 'Build RAG Systems'
    WHEN regexp_matches(c, '\bagents?\b.*\b(build|design|develop)\b', 'i') THEN 'Build AI Agents'
    WHEN regexp_matches(c, 'multi.agent', 'i') THEN 'Design Multi-Agent Systems' WHEN regexp_matches(c, '\bmcp\b', 'i') THEN 'Implement MCP Integrations'
    WHEN regexp_matches(c, 'observab', 'i') THEN 'Implement AI Observability' WHEN regexp_matches(c, 'evaluat', 'i') THEN 'Implement AI Evaluation'
    WHEN regexp_matches(c, 'deploy', 'i') THEN 'Deploy AI Applications' WHEN regexp_matches(c, 'scalab', 'i') THEN 'Design Scalable AI Systems'
    WHEN regexp_matches(c, 'production[- ]grade ai', 'i') THEN 'Develop Production AI Systems'
    WHEN regexp_matches(c, 'backend (api|service)', 'i') THEN 'Build Backend APIs' ELSE c END"""


def _variant(s, d):
    return portable(s, d, _VARIANT).withColumn("v", F.parse_json("j"))


QUERIES = {
    "literal_null": (
        lambda s, d: portable(s, d, _MESSY).select("event_id", text.nullify_literal_null("a").alias("value")),
        f'SELECT event_id, {_null("a")} AS "value" {_MESSY_D}',
    ),
    "first_defined": (
        lambda s, d: portable(s, d, _MESSY).select("event_id", text.first_defined("a", "b", "event_type").alias("value")),
        f"""SELECT event_id, coalesce(nullif({_null("a")}, ''), nullif({_null("b")}, ''), event_type) AS "value" {_MESSY_D}""",
    ),
    "norm_key": (
        lambda s, d: portable(s, d, _NAMES).select("event_id", text.norm_key("skill").alias("key")),
        f'SELECT event_id, {_norm("skill")} AS "key" {_NAMES_D}',
    ),
    "parse_applicants": (
        lambda s, d: portable(s, d, _MESSY).select("event_id", clean.applicants_in_text("applicants").alias("applicants")),
        rf"""SELECT event_id, try_cast(replace(regexp_extract(applicants, '\d[\d,]*'), ',', '') AS DOUBLE) AS applicants {_MESSY_D}""",
    ),
    "parse_applicants_variant": (
        lambda s, d: _variant(s, d).select("event_id", clean.parse_applicants(F.col("v")).alias("applicants")),
        f"""SELECT event_id, CAST(CASE event_id % 12 WHEN 7 THEN 1 WHEN 8 THEN user_id WHEN 9 THEN user_id
            WHEN 10 THEN user_id % 9 END AS INTEGER) AS applicants FROM ({duck(_VARIANT)})""",
    ),
    "parse_years": (
        lambda s, d: portable(s, d, _MESSY).select("event_id", clean.years_in_text("y1").alias("y")).select("event_id", "y.min", "y.max"),
        f'SELECT event_id, {_L1} AS "min", {_H1} AS "max" {_MESSY_D}',
    ),
    "parse_years_variant": (
        lambda s, d: _variant(s, d).select("event_id", clean.parse_years(F.col("v")).alias("y")).select("event_id", "y.min", "y.max"),
        f"""SELECT event_id, CAST(CASE event_id % 12 WHEN 7 THEN 1 WHEN 8 THEN user_id + 0.75 WHEN 10 THEN user_id % 9 END AS DOUBLE) AS "min",
            CAST(CASE event_id % 12 WHEN 7 THEN 1 WHEN 8 THEN user_id + 0.75 END AS DOUBLE) AS "max" FROM ({duck(_VARIANT)})""",
    ),
    "combine_experience": (
        lambda s, d: portable(s, d, _MESSY)
        .select("event_id", *[clean.years_in_text(c).alias(c) for c in ("y1", "y2", "y3")])
        .select("event_id", clean.combine_experience(F.col("y1"), F.col("y2"), F.col("y3")).alias("e"))
        .select("event_id", "e.*"),
        f"""SELECT event_id, coalesce({_L1}, {_L3}, {_L2}) AS minimum_experience,
            coalesce({_H2}, {_H1}, {_H3}) AS maximum_experience {_MESSY_D}""",
    ),
    "tristate": (
        lambda s, d: _variant(s, d).select("event_id", clean.coerce_tristate(F.col("v")).alias("flag")),
        """SELECT event_id, CASE event_id % 12 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true
            WHEN 4 THEN false WHEN 11 THEN true END AS flag FROM events""",
    ),
    "flat_array": (
        lambda s, d: _variant(s, d).select("event_id", V.is_array(F.col("v")).alias("flat")),
        "SELECT event_id, event_id % 12 IN (3, 4, 11) AS flat FROM events",
    ),
    "array_or_empty": (
        lambda s, d: _variant(s, d).select("event_id", F.size(V.array(F.col("v"))).alias("n")),
        "SELECT event_id, CAST(CASE event_id % 12 WHEN 3 THEN 2 WHEN 11 THEN 1 ELSE 0 END AS INTEGER) AS n FROM events",
    ),
    "unwrap_singleton": (
        lambda s, d: _variant(s, d).select("event_id", F.to_json(V.unwrap_singleton(F.col("v"))).alias("j"))
        .withColumn("j", F.replace("j", F.lit(" "), F.lit(""))),
        f"""SELECT event_id, CASE WHEN event_id % 12 = 11 THEN '[' || user_id || ']' ELSE replace(j, ' ', '') END AS j
            FROM ({duck(_VARIANT)})""",
    ),
    "props_number": (
        lambda s, d: M.table(s, d, "events").select(
            "event_id", clean.parse_applicants(F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")).alias("k")),
        "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    ),
    "parse_location": (
        lambda s, d: portable(s, d, _MESSY)
        .select("event_id", clean.parse_location("loc", "city", "st", F.lit(None).cast("string")).alias("p"))
        .select("event_id", "p.*"),
        f"""SELECT event_id, {_null("loc")} AS location,
            CASE WHEN given THEN {_null("city")} WHEN three THEN nullif(trim(split_part(loc, ',', 1)), '') END AS city,
            CASE WHEN given THEN st WHEN three THEN nullif(trim(split_part(loc, ',', 2)), '') END AS state,
            CASE WHEN given THEN NULL WHEN three THEN nullif(trim(split_part(loc, ',', 3)), '') END AS country
            FROM (SELECT *, coalesce(nullif({_null("city")}, ''), st) IS NOT NULL AS given,
              length(loc) - length(replace(loc, ',', '')) = 2 AS three {_MESSY_D})""",
    ),
    "normalize_skill": (
        lambda s, d: portable(s, d, _NAMES).select("event_id", names.normalize_skill("skill").alias("k")).select("event_id", "k.*"),
        f'SELECT event_id, {_SKILL} AS name, {_norm("(" + _SKILL + ")")} AS normalized_name {_NAMES_D}',
    ),
    "normalize_role": (
        lambda s, d: portable(s, d, _NAMES).select("event_id", names.normalize_role("role").alias("role")),
        f"""SELECT event_id, CASE WHEN {_norm("role")} IN ('genai engineer', 'llm engineer', 'gen ai engineer')
            THEN 'Generative AI Engineer' ELSE nullif(trim(role), '') END AS role {_NAMES_D}""",
    ),
    "normalize_seniority": (
        lambda s, d: portable(s, d, _NAMES).select("event_id", names.normalize_seniority("seniority").alias("seniority")),
        f"""SELECT event_id, CASE {_norm("seniority")} WHEN 'mid-senior level' THEN 'Mid-Level' WHEN 'unknown' THEN NULL
            WHEN 'entry level' THEN 'Entry-Level' WHEN 'intern' THEN 'Internship' WHEN 'senior' THEN 'Senior'
            ELSE nullif(trim(seniority), '') END AS seniority {_NAMES_D}""",
    ),
    "capability_rules": (
        lambda s, d: portable(s, d, _NAMES).select("event_id", names.normalize_capability("capability").alias("name")),
        f"SELECT event_id, {_CAPABILITY} AS name FROM (SELECT event_id, trim(capability) AS c {_NAMES_D})",
    ),
    "capability_rules_custom": (
        lambda s, d: M.table(s, d, "part").select("p_partkey", names.normalize_capability("p_name", M.RULES).alias("name")),
        f"SELECT p_partkey, coalesce(CASE {M._RULE_CASE} END, p_name) AS name FROM part",
    ),
    "title_filter": (
        lambda s, d: portable(s, d, _TITLES).filter(checks.matches_title("title", ["ring", "C++", " widget "])).select("p_partkey", "title"),
        rf"""SELECT p_partkey, title FROM ({duck(_TITLES)}) WHERE title <> ''
            AND (regexp_matches(title, '\bring\b', 'i') OR regexp_matches(title, '\bC\+\+\b', 'i') OR regexp_matches(title, '\bwidget\b', 'i'))""",
    ),
    "title_filter_per_row": (
        lambda s, d: portable(s, d, _TITLES).select(
            "p_partkey",
            checks.matches_title("title", F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>"))
                                 .otherwise(F.array("term", F.lit("")))).alias("keep")),
        rf"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN true WHEN title IS NULL OR title = '' THEN false
            ELSE regexp_matches(title, '\b' || term || '\b', 'i') END AS keep FROM ({duck(_TITLES)})""",
    ),
    "calendar_date": (
        lambda s, d: portable(s, d, _DATES).select("event_id", checks.is_calendar_date("day").alias("valid")),
        rf"""SELECT event_id, coalesce(regexp_full_match(day, '\d{{4}}-\d{{2}}-\d{{2}}') AND try_cast(day AS DATE) IS NOT NULL, false) AS "valid"
            FROM ({duck(_DATES)})""",
    ),
    "uuid_shape": (
        lambda s, d: portable(s, d, _DATES).select("event_id", checks.is_uuid("id").alias("valid")),
        f'SELECT event_id, try_cast(id AS UUID) IS NOT NULL AS "valid" FROM ({duck(_DATES)})',
    ),
    "search_url": (
        lambda s, d: portable(s, d, _SEARCH).select(
            "event_id",
            urls.build_search_url(
                "kw", "loc", "st", "dp",
                F.when(F.col("event_id") % 2 == 0, F.array(F.lit("entryLevel"), F.lit("boss"), F.lit("director"))),
                F.when(F.col("event_id") % 3 == 0, F.array(F.lit("fullTime"))).otherwise(F.array().cast("array<string>")),
                F.array(F.lit("hybrid"), F.lit("remote")),
                base="https://jobs.example/search",
            ).alias("url")),
        f"""SELECT event_id, 'https://jobs.example/search?keywords=' || {{e}}(kw)
            || CASE WHEN loc <> '' THEN '&location=' || {{e}}(loc) ELSE '' END || '&start=' || st
            || CASE dp WHEN 'pastWeek' THEN '&f_TPR=r604800' WHEN 'past24Hours' THEN '&f_TPR=r86400' ELSE '' END
            || CASE WHEN event_id % 2 = 0 THEN '&f_E=2%2C5' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN '&f_JT=F' ELSE '' END
            || '&f_WT=3%2C2' AS url FROM ({duck(_SEARCH)})""".replace("{e}(kw)", "replace(replace(replace(url_encode(kw), '%20', '+'), '~', '%7E'), '%2A', '*')")
        .replace("{e}(loc)", "replace(url_encode(loc), '%20', '+')"),
    ),
    "experience_level": (
        lambda s, d: M.job_roles(s, d).select("job_id", F.array_join(names.experience_level("seniority"), ",").alias("levels")),
        M.with_model("job_roles") + """SELECT job_id, CASE seniority WHEN 'Senior' THEN 'midSeniorLevel' WHEN 'Mid-Level' THEN 'midSeniorLevel'
            WHEN 'Junior' THEN 'entryLevel' WHEN 'Internship' THEN 'internship' ELSE '' END AS levels FROM job_roles""",
    ),
    "run_status": (
        lambda s, d: M.table(s, d, "events").select(
            "event_id",
            names.map_run_status(F.element_at(F.array(*map(F.lit, ("SUCCEEDED", "FAILED", "ABORTED", "TIMED-OUT", "READY"))), (F.col("event_id") % 5 + 1).cast("int"))).alias("status"),
            names.run_error_message(F.when(F.col("event_id") % 5 == 3, "TIMED-OUT").otherwise("SUCCEEDED")).alias("error_message")),
        """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'succeeded' WHEN 3 THEN 'timed_out' ELSE 'failed' END AS status,
            CASE WHEN event_id % 5 = 3 THEN 'Apify run ended with status TIMED-OUT' END AS error_message FROM events""",
    ),
    "append_note": (
        lambda s, d: portable(s, d, _MESSY).select("event_id", text.append_note("a", "city").alias("note")),
        f"""SELECT event_id, CASE WHEN coalesce(city, '') = '' THEN a WHEN coalesce(a, '') = '' THEN city ELSE a || ' | ' || city END AS note {_MESSY_D}""",
    ),
    "distinct_list": (
        lambda s, d: portable(s, d, _MESSY).select(
            "event_id", F.array_join(F.array_distinct(F.array("event_type", "b", "event_type", "b")), "|").alias("items")),
        f"SELECT event_id, event_type || '|' || b AS items {_MESSY_D}",
    ),
}
