"""Golden cases of the column expressions."""

import json

import pytest
from pyspark.sql import functions as F

from jobtide.functions import checks, clean, names, scoring, text, urls
from jobtide.functions import variants as V
from jobtide.operators import profiles


def evaluate(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()[0]


def variant(spark, value, fn):
    df = spark.createDataFrame([(json.dumps(value),)], "j string").withColumn("v", F.parse_json("j"))
    return df.select(fn(F.col("v")).alias("y")).first()[0]


@pytest.mark.parametrize("raw, want", [(69, 69), ("44", 44), ("Over 200 applicants", 200), ("1,234", 1234), (True, None), (-2.7, -2), (None, None), ("none", None)])
def test_applicants(spark, raw, want):
    assert variant(spark, raw, clean.parse_applicants) == want


@pytest.mark.parametrize("raw, want", [(7, (7, 7)), ("3-5", (3, 5)), (" 3 - 5 ", (3, 5)), ("8+", (8, None)), ("10", (10, 10)), ("some", (None, None)), (2.5, (2.5, 2.5)), (None, (None, None)), ("3-", (None, None))])
def test_years(spark, raw, want):
    assert tuple(variant(spark, raw, clean.parse_years)) == want


@pytest.mark.parametrize("parts, want", [((None, None, "3-5"), (3, 5)), (("8+", None, None), (8, None)), (("2", "6", "4"), (2, 6)), ((None, "6+", None), (6, None))])
def test_combined_experience(spark, parts, want):
    df = spark.createDataFrame([parts], "a string, b string, c string")
    cols = [clean.years_in_text(c) for c in "abc"]
    assert tuple(df.select(clean.combine_experience(*cols).alias("e")).first()[0]) == want


@pytest.mark.parametrize("raw, want", [(True, True), (False, False), (" Implied ", True), (["x"], True), ([None], True), ([], False), (None, None), ("yes", None), (1, None), ({"a": 1}, None)])
def test_tristate(spark, raw, want):
    assert variant(spark, raw, clean.coerce_tristate) is want


@pytest.mark.parametrize(
    "row, want",
    [
        (("Pune, MH, India", None, None, None), ("Pune", "MH", "India")),
        (("Remote", None, None, None), (None, None, None)),
        (("Pune, MH, India", "Oslo", None, None), ("Oslo", None, None)),
        (("a, ,c", "null", "", None), ("a", None, "c")),
        (("a,b,c,d", None, None, None), (None, None, None)),
    ],
)
def test_location(spark, row, want):
    df = spark.createDataFrame([row], "l string, c string, s string, k string")
    got = df.select(clean.parse_location("l", "c", "s", "k").alias("p")).select("p.city", "p.state", "p.country").first()
    assert tuple(got) == want


@pytest.mark.parametrize("raw, want", [("  Lang \t Chain ", "lang chain"), (" Python﻿", "python"), ("A \nB", "a b"), ("", ""), (None, None)])
def test_norm_key(spark, raw, want):
    assert evaluate(spark, raw, text.norm_key("x")) == want


@pytest.mark.parametrize("raw, want", [(" Lang  Chain ", ("LangChain", "langchain")), ("LLMs", ("LLM", "llm")), ("Kafka ", ("Kafka", "kafka")), ("CICD", ("CI/CD", "ci/cd"))])
def test_skill(spark, raw, want):
    assert tuple(evaluate(spark, raw, names.normalize_skill("x"))) == want


@pytest.mark.parametrize("raw, want", [("Mid-Senior level", "Mid-Level"), ("unknown", None), (" Unknown ", None), ("Director", "Director"), ("", None), ("INTERN", "Internship")])
def test_seniority(spark, raw, want):
    assert evaluate(spark, raw, names.normalize_seniority("x")) == want


@pytest.mark.parametrize("raw, want", [(" LLM  engineer", "Generative AI Engineer"), ("  ", None), (None, None), (" Data Scientist ", "Data Scientist")])
def test_role(spark, raw, want):
    assert evaluate(spark, raw, names.normalize_role("x")) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Deploy RAG agents", "Build RAG Systems"), ("Evaluate LLMs", "Implement AI Evaluation"), (" Mentor peers ", "Mentor peers"),
        ("Design Multi-Agent Systems", "Build AI Agents"), ("multi agent work", "Design Multi-Agent Systems"), ("fragile", "fragile"),
        ("Scalability", "Design Scalable AI Systems"), ("api for the backend", "Build Backend APIs"),
    ],
)
def test_capability(spark, raw, want):
    assert evaluate(spark, raw, names.normalize_capability("x")) == want


@pytest.mark.parametrize(
    "title, terms, want",
    [("Sr AI Engineer", ["ai"], True), ("C++ dev", ["C++"], False), ("x", [], True), ("", ["a"], False), (None, ["a"], False), ("chair", ["ai"], False), ("AI", [""], False), ("AI dev", ["", " dev "], True), ("a.b", ["axb"], False)],
)
def test_title_filter(spark, title, terms, want):
    df = spark.createDataFrame([(title, terms)], "t string, terms array<string>")
    got = df.select(checks.matches_title("t", terms), checks.matches_title("t", F.col("terms"))).first()
    assert tuple(got) == (want, want)


@pytest.mark.parametrize("raw, want", [("2020-13-45", False), ("2021-02-29", False), ("2024-02-29", True), ("2024-2-9", False), (None, False)])
def test_calendar_date(spark, raw, want):
    assert evaluate(spark, raw, checks.is_calendar_date("x")) is want


@pytest.mark.parametrize("score, want", [(70.0, "Strong"), (69.99, "Moderate"), (40.0, "Moderate"), (39.99, "Weak"), (None, "Insufficient historical data")])
def test_bucket(spark, score, want):
    assert evaluate(spark, score, scoring.bucket_status("x"), "double") == want


@pytest.mark.parametrize("value, want", [(-2.005, -2.0), (2.345, 2.35), (-2.5, -2.5), (None, None), (-0.125, -0.12)])
def test_round2(spark, value, want):
    assert evaluate(spark, value, scoring.round2("x"), "double") == want


@pytest.mark.parametrize("pair, want", [(("a", "b"), "a | b"), (("a", None), "a"), ((None, "b"), "b"), (("", "b"), "b"), ((None, None), None), (("a", ""), "a")])
def test_append_note(spark, pair, want):
    df = spark.createDataFrame([pair], "a string, b string")
    assert df.select(text.append_note("a", "b")).first()[0] == want


@pytest.mark.parametrize("raw, want", [([{"a": 1}], '{"a":1}'), ({"a": 1}, '{"a":1}'), ([1], "[1]"), ([{"a": 1}, {"a": 2}], '[{"a":1},{"a":2}]')])
def test_unwrap(spark, raw, want):
    assert variant(spark, raw, lambda v: F.to_json(V.unwrap_singleton(v))) == want


def test_search_url(spark):
    df = spark.range(1).select(
        urls.build_search_url(
            F.lit('"AI Engineer" OR C++'), F.lit("São Paulo"), F.lit(25), F.lit("pastWeek"),
            F.array(F.lit("entryLevel"), F.lit("nobody")), F.array(F.lit("contract"), F.lit("fullTime")), F.array().cast("array<string>"),
            base="https://jobs.example/s",
        )
    )
    assert df.first()[0] == (
        "https://jobs.example/s?keywords=%22AI+Engineer%22+OR+C%2B%2B&location=S%C3%A3o+Paulo&start=25&f_TPR=r604800&f_E=2&f_JT=C%2CF"
    )


def test_profile_validation(spark):
    raw = json.dumps({
        "target_roles": [" ML ", 3, ""], "seniority_level": "Wizard", "years_of_experience": "81", "education": [{"degree": "BSc", "year": 5}, "x"],
        "location": " Oslo ", "keywords": "no",
    })
    row = profiles.validate_profiles(spark.createDataFrame([(raw,), ("[1, 2]",)], "raw string")).collect()
    assert row[0]["profile"]["target_roles"] == ["ML"] and row[0]["profile"]["location"] == "Oslo"
    assert [tuple(e) for e in row[0]["profile"]["education"]] == [("BSc", None, None, None)]
    assert row[0]["dropped_fields"] == ["seniority_level", "years_of_experience", "keywords"]
    assert row[0]["enrichment_status"] == "partial"
    assert row[1]["dropped_fields"] == [] and row[1]["enrichment_status"] == "complete"


def test_search_queries_and_plan(spark):
    raw = json.dumps({"primary_queries": ["AI Engineer", "AI Engineer ", *"abcdef"], "secondary_queries": [" ai engineer", "ML Engineer", 4], "keywords": "x"})
    row = profiles.validate_search_queries(spark.createDataFrame([(raw,)], "raw string"))
    first = row.first()
    assert first["primary_queries"] == ["AI Engineer", "a", "b", "c", "d"]
    assert first["secondary_queries"] == ["ai engineer", "ML Engineer"] and first["keywords"] == []
    assert first["dropped_fields"] == ["secondary_queries (some entries invalid)", "keywords"]
    planned = profiles.plan_runs(row).orderBy("run_no").select("query_type", "queries").collect()
    assert [tuple(r) for r in planned] == [("secondary", ["ML Engineer"]), ("primary", ["AI Engineer", "a", "b", "c", "d"])]


def test_actor_input(spark):
    runs = spark.createDataFrame(
        [(["AI Engineer", 'a"b'], "Oslo", "Manager", ["k"]), (["x"], "", "Nobody", [])],
        "queries array<string>, location string, seniority string, keywords array<string>",
    )
    got = [json.loads(r["actor_input"]) for r in profiles.build_actor_input(runs, 25).collect()]
    assert got[0] == {
        "keywords": '"AI Engineer" OR "ab"', "maxItems": 25, "fetchFullDescription": True, "location": "Oslo",
        "experienceLevels": ["director"], "titleKeywordFilter": ["k"],
    }
    assert got[1] == {"keywords": '"x"', "maxItems": 25, "fetchFullDescription": True}


def test_years_are_worked_out_once_per_value(spark):
    from jobtide.functions import clean

    rows = spark.sql("SELECT parse_json(j) AS v FROM VALUES ('\"3-5\"'), ('[\"8+\"]'), ('7') AS t(j)")
    years = clean.parse_years(F.col("v"))
    found = rows.select(clean.combine_experience(years, years, years).alias("e"))
    # The same text was spelled out for each of its uses, until the generated code no longer compiled.
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract(") <= 60
    assert [tuple(r["e"]) for r in found.collect()] == [(3.0, 5.0), (8.0, None), (7.0, 7.0)]


def test_documents_are_spread_before_their_texts_are_made(spark, tmp_path, monkeypatch):
    from jobtide.testbed import ingestion

    spark.sql("SELECT id AS o_orderkey, id AS o_custkey, DATE '2024-01-01' AS o_orderdate FROM range(400)").write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("SELECT id AS c_custkey, id % 2 AS c_nationkey, 'c' AS c_name, 'M' AS c_mktsegment FROM range(400)").write.parquet(str(tmp_path / "customer.parquet"))
    spark.sql("SELECT id AS n_nationkey, 'N' AS n_name FROM range(2)").write.parquet(str(tmp_path / "nation.parquet"))
    monkeypatch.setattr(ingestion, "DOCS_PER_TASK", 20)
    docs = ingestion.documents_of(spark, str(tmp_path))
    assert docs.rdd.getNumPartitions() == 20 and docs.count() == 400
    assert "raw" not in next(line for line in docs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Repartition" in line)


def test_many_small_files_share_few_tasks(spark, tmp_path):
    from jobtide.sources.documents import read_analysis_dir

    for n in range(400):
        (tmp_path / f"{n}.json").write_text(f'{{"n": {n}}}')
    files = read_analysis_dir(spark, str(tmp_path))
    # Packed by Spark alone they take a task for each thirty-odd files.
    assert files.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert sorted(r["raw"] for r in files.collect()) == sorted(f'{{"n": {n}}}' for n in range(400))


def test_flags_and_kinds_of_a_document_are_columns(spark):
    from jobtide.sources import documents

    docs = [
        '{"job_metadata": {"job_id": 7, "title": " NULL ", "url": "null", "job_url": "u"}, "skills": {"a": ["RAG", null, " x "], "b": ["rag", 5, ""], "a": ["LangChain"]}, '
        '"skill_priority": {"critical": ["lang chain"], "preferred": 3}, "production_requirements": {"cloud": " Implied", "cicd": "true", "monitoring": [null]}, '
        '"role_analysis": {"experience_required": {"minimum_years": ["3-5"], "maximum_years": 7.5}}, "ai_lifecycle_coverage": {"evaluation": true}}',
        "]", "], [", " ", '{"job_metadata": {"job_id": 2.0}} x',
    ]
    parsed = documents.parse_documents(documents.classify_documents(spark.createDataFrame(list(enumerate(docs)), "file int, raw string")))
    rows = {r["file"]: r for r in parsed.collect()}
    assert [rows[n]["status"] for n in range(5)] == ["ok", *["skipped_invalid_json"] * 4]
    first = rows[0]
    assert first["job_id"] == "7" and first["job"]["title"] == "Untitled" and first["job"]["job_url"] == "u"
    assert [tuple(s) for s in first["skills"]] == [("LangChain", "langchain", "a", "critical"), ("RAG", "rag", "b", None)]
    assert (first["attributes"]["cloud"], first["attributes"]["cicd"], first["attributes"]["monitoring"]) == (True, None, True)
    assert (first["role"]["minimum_experience"], first["role"]["maximum_experience"]) == (3.0, 7.5)
    assert first["lifecycle"]["replaces"] and first["lifecycle"]["evaluation"]
    # They were worked out in functions of arrays of one element, value by value, outside generated code.
    plan = parsed.select("attributes", "lifecycle")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "_kind_cloud" in plan
