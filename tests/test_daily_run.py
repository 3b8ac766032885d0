"""Documents in, published snapshot out."""

import json

import pytest
from pyspark.sql import functions as F

from jobtide.plans import daily as plan
from jobtide.sources import tables
from jobtide.sources.documents import read_analysis_dir, stage_documents

DOCS = {
    "a.json": {
        "job_metadata": {
            "job_id": 123, "title": "null", "company": "Acme", "location": "Pune, MH , India",
            "applicants": "Over 1,200 applicants", "posted_at": "2024-01-02", "jobFunction": "Eng",
        },
        "skills": {"zeta": ["RAG", 3, ""], "alpha": ["rag", "Lang  Chain"], "none": None},
        "skill_priority": {"critical": ["langchain"], "important": ["Rag", "langchain"]},
        "capabilities": ["Build RAG bots", "Mentor peers", None, 4, "RAG apps", "mentor  peers"],
        "role_analysis": {
            "actual_role_category": "LLM  Engineer", "seniority_inferred": "Mid-Senior level",
            "experience_required": {"minimum_years": None, "maximum_years": None, "preferred_years": "3-5"},
        },
        "ai_lifecycle_coverage": ["a"],
        "production_requirements": {"cloud": " Implied", "cicd": [], "scalability": True, "monitoring": "yes"},
    },
    "b.json": "{bad",
    "c.json": [],
    "d.json": {"job_metadata": {"job_id": 0}},
    "e.json": {"job_metadata": {"job_id": "x", "posted_at": "soon"}, "skills": {"k": ["Lost"]}},
    "g.json": {
        "job_metadata": {"job_id": "g", "company": "Beta", "city": "Oslo"},
        "skills": {"k": ["RAG"]},
        "role_analysis": {"advertised_role_category": "Data Scientist", "seniority_inferred": "unknown"},
        "ai_lifecycle_coverage": {"evaluation": "implied", "deployment": False},
    },
    "h.json": '{"job_metadata":{"job_id":"h"}} trailing',
    "i.json": '{"job_metadata":{"job_id":"i","job_id":"i2"},"skills":{"b":["q"],"a":["w"],"b":["z","w"]}}',
}


def write(folder, docs):
    for name, doc in docs.items():
        (folder / name).write_text(doc if isinstance(doc, str) else json.dumps(doc))
    (folder / "note.txt").write_text("{}")


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    source, base = tmp_path_factory.mktemp("docs"), str(tmp_path_factory.mktemp("base"))
    write(source, DOCS)
    summary = plan.run_daily(spark, str(source), base, "2024-01-05", "2024-01-05 10:00:00").first()
    return str(source), base, summary


def test_statuses(spark, run, rows):
    source, _, summary = run
    assert tuple(summary) == (8, 3, 5)
    staged = stage_documents(read_analysis_dir(spark, source))
    assert rows(staged.select(F.substring_index("file", "/", -1).alias("file"), "status"), "file") == [
        ("a.json", "ok"),
        ("b.json", "skipped_invalid_json"),
        ("c.json", "skipped_invalid_structure"),
        ("d.json", "skipped_invalid_structure"),
        ("e.json", "error"),
        ("g.json", "ok"),
        ("h.json", "skipped_invalid_json"),
        ("i.json", "ok"),
    ]


def test_state(spark, run, rows):
    _, base, _ = run
    state = tables.read_state(spark, base)
    jobs = state["jobs"].select("external_job_id", "title", "city", "applicants", "job_function")
    assert rows(jobs, "external_job_id") == [
        ("123", "Untitled", "Pune", 1200, "Eng"), ("g", "Untitled", "Oslo", None, None), ("i2", "Untitled", None, None, None),
    ]
    assert rows(state["job_skills"], "job_id", "skill_id") == [
        ("123", "langchain", "alpha", "critical"),
        ("123", "rag", "zeta", "important"),
        ("g", "rag", "k", None),
        ("i2", "w", "b", None),
        ("i2", "z", "b", None),
    ]
    assert rows(state["job_capabilities"], "capability_id") == [("123", "build rag systems"), ("123", "mentor peers")]
    assert rows(state["job_roles"], "job_id") == [
        ("123", None, "Generative AI Engineer", "Mid-Level", 3.0, 5.0),
        ("g", "Data Scientist", "Data Scientist", None, None, None),
        ("i2", None, None, None, None, None),
    ]
    flags = state["job_attributes"].select("job_id", "cloud", "cicd", "scalability", "monitoring")
    assert rows(flags, "job_id")[0] == ("123", True, False, True, None)
    cycle = state["job_ai_lifecycle"].select("job_id", "evaluation", "deployment")
    assert rows(cycle, "job_id") == [("123", None, None), ("g", True, False), ("i2", None, None)]


def test_review_queue(spark, run, rows):
    queue = tables.read_state(spark, run[1])["taxonomy_review_queue"]
    got = rows(queue.select("dimension", "raw_value", "queue_reason", "confidence", "first_seen_job_id"), "dimension", "raw_value")
    assert got == [
        ("capability", "Build RAG bots", "suggested_alias", "medium", "123"),
        ("capability", "Mentor peers", "new_unreviewed", "low", "123"),
        ("role", "Data Scientist", "new_unreviewed", "low", "g"),
        ("role", "Generative AI Engineer", "new_unreviewed", "low", "123"),
        ("skill", "LangChain", "new_unreviewed", "low", "123"),
        ("skill", "RAG", "new_unreviewed", "low", "123"),
        ("skill", "w", "new_unreviewed", "low", "i2"),
        ("skill", "z", "new_unreviewed", "low", "i2"),
    ]


def test_snapshot(spark, run, rows):
    base = run[1]
    market = tables.read_metrics(spark, base, "daily_market_metrics").drop("metric_date")
    assert rows(market) == [(3, 2, 1200.0, None)]
    skills = tables.read_metrics(spark, base, "daily_skill_metrics").drop("metric_date")
    assert rows(skills, "skill_id")[1] == ("rag", 2, 2 / 3 * 100, 0, 1, 0)
    roles = tables.read_metrics(spark, base, "daily_role_metrics").drop("metric_date", "demand_percentage")
    assert rows(roles, "role") == [("Data Scientist", 1), ("Generative AI Engineer", 1)]


def test_second_run_is_idempotent_and_keeps_first_sighting(spark, run, rows):
    source, base, _ = run
    before = {k: rows(v) for k, v in tables.read_state(spark, base).items()}
    plan.run_daily(spark, source, base, "2024-01-06", "2024-01-06 10:00:00")
    after = tables.read_state(spark, base)
    for name, old in before.items():
        if name != "jobs":
            assert sorted(map(str, rows(after[name]))) == sorted(map(str, old)), name
    seen = after["jobs"].select(F.to_date("first_seen_at").cast("string"), F.to_date("last_seen_at").cast("string")).distinct()
    assert rows(seen) == [("2024-01-05", "2024-01-06")]
    # The first date is bounded to what was known then.
    assert tables.read_metrics(spark, base, "daily_market_metrics").count() == 2


def test_failed_publish_leaves_tables_unchanged(spark, run):
    base = run[1]
    state = tables.read_state(spark, base)
    before = tables.read_metrics(spark, base, "daily_market_metrics").orderBy("metric_date").collect()
    broken = plan.snapshot_frames({**state, "roles": state["roles"].limit(0)}, "2024-01-05")
    with pytest.raises(Exception, match="actual role without a roles row"):
        tables.publish_snapshot(spark, base, broken, "2024-01-05")
    assert tables.read_metrics(spark, base, "daily_market_metrics").orderBy("metric_date").collect() == before


def test_empty_frame_clears_the_date(spark, run):
    base = run[1]
    skills = tables.read_metrics(spark, base, "daily_skill_metrics")
    assert skills.filter("metric_date = '2024-01-06'").count() > 0
    tables.publish_snapshot(spark, base, {"daily_skill_metrics": skills.limit(0)}, "2024-01-06")
    left = tables.read_metrics(spark, base, "daily_skill_metrics")
    assert left.filter("metric_date = '2024-01-06'").count() == 0
    assert left.filter("metric_date = '2024-01-05'").count() > 0
