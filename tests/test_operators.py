"""Operators against brute force and stated edge cases."""

import datetime as dt
import io
import os
import shutil
import random
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from jobtide import fixed
from jobtide.operators import backfill, daily, firsts, governance, health, runs, taxonomy, upsert
from jobtide.operators.cards import collect_postings
from jobtide.operators.emerging import emerging_skills
from jobtide.operators.trend import trend_details, with_trends
from jobtide.plans import dashboard
from jobtide.sources import postings, tables
from jobtide.streaming.ingest import read_unique, stream_dedup, stream_ingest


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def now():
    return F.lit("2024-05-01").cast("timestamp_ntz")


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(7)
    jobs = [
        (i, f"c{rng.randrange(9)}" if i % 7 else None, rng.randrange(50) if i % 5 else None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(480)), f"city{rng.randrange(4)}" if i % 6 else None)
        for i in range(120)
    ]
    skills = [(i, f"s{k}", "x", rng.choice([*fixed.PRIORITIES, None])) for i in range(120) for k in range(5) if rng.random() < 0.4]
    return (
        spark.createDataFrame(jobs, "job_id int, company string, applicants int, first_seen_at timestamp_ntz, city string"),
        spark.createDataFrame(skills, "job_id int, skill_id string, category string, priority string"),
    )


def test_backfill_equals_every_single_date(facts, rows):
    jobs, skills = facts
    start, end = day(4), day(22)
    market = {r[0]: r[1:] for r in rows(backfill.backfill_market(jobs, start, end))}
    by_skill = set(rows(backfill.backfill_skills(skills, jobs, start, end)))
    by_city = set(rows(backfill.backfill_dimension(jobs, jobs, "city", start, end)))
    single_skill, single_city = set(), set()
    for n in (4, 5, 11, 19, 22):
        assert rows(daily.daily_market_metrics(jobs, day(n)).drop("metric_date"))[0] == market[day(n)]
        single_skill |= set(rows(daily.daily_skill_metrics(skills, jobs, day(n))))
        single_city |= set(rows(daily.daily_location_metrics(jobs, day(n))))
    picked = {day(n) for n in (4, 5, 11, 19, 22)}
    assert {r for r in by_skill if r[0] in picked} == single_skill
    assert {r for r in by_city if r[0] in picked} == single_city


def test_empty_market(facts, rows):
    jobs, skills = facts
    assert rows(daily.daily_market_metrics(jobs, "2020-01-01"))[0][1:] == (0, 0, None)
    assert rows(daily.daily_skill_metrics(skills, jobs, "2020-01-01")) == []


def test_as_of_bound_reaches_the_scan(facts, tmp_path, spark):
    jobs, skills = facts
    jobs.write.parquet(str(tmp_path / "j"))
    plan = plan_of(daily.daily_location_metrics(spark.read.parquet(str(tmp_path / "j")), day(3)))
    assert "LessThan(first_seen_at" in plan and "IsNotNull(city)" in plan
    assert "applicants" not in plan


def test_multi_hop_role_fails(spark):
    roles = spark.createDataFrame([("A", "a", "b"), ("B", "b", "c"), ("C", "c", None)], tables.STATE_SCHEMAS["roles"])
    jobs = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "job_id int, first_seen_at timestamp_ntz")
    used = spark.createDataFrame([(1, " A ")], "job_id int, actual_role string")
    with pytest.raises(Exception, match="merged role"):
        daily.daily_role_metrics(used, roles, jobs, "2024-01-02").collect()


@pytest.mark.parametrize("series, want", [([10] * 7 + [12], 20.0), ([10] * 6 + [12], None), ([0] * 7 + [5], None), ([10] * 6 + [None, 12], 40.0), ([10] * 7 + [None], None)])
def test_trend(spark, series, want):
    df = spark.createDataFrame([(day(i), v) for i, v in enumerate(series)], "metric_date date, v int")
    last = F.col("metric_date") == F.lit(day(len(series) - 1))
    assert with_trends(df, "v", None, (7,)).filter(last).first()["change_7d"] == want
    detail = trend_details(df, "v", None, 7).filter(last).first()
    assert detail["available"] is (want is not None) and detail["trend_percentage"] == want


def js_round(x):
    import math

    return math.floor(x * 100 + 0.5) / 100


def brute_trend(hist, d, w):
    cur = hist.get(d)
    prev = [v for k, v in hist.items() if d - w <= k < d]
    if cur is None or len(prev) < w:
        return None
    avg = sum(prev) / len(prev)
    return None if avg == 0 else js_round((cur - avg) / avg * 100)


@pytest.mark.parametrize("window", [14, 30, 45])
def test_emerging_against_brute_force(spark, window):
    rng = random.Random(window)
    hist = {}
    for k in range(12):
        start = rng.choice([0, 20, 38, 44, 46])
        base = rng.uniform(1, 30)
        hist[f"s{k}"] = {n: (rng.randrange(3, 40), max(0.5, base + rng.uniform(-3, 3) + (n - start) * rng.choice([0, 0.2]))) for n in range(start, 50) if n == 49 or rng.random() < 0.97}
    data = [(day(n), s, c, p) for s, h in hist.items() for n, (c, p) in h.items()]
    metrics = spark.createDataFrame(data, "metric_date date, skill_id string, job_count long, demand_percentage double")
    skills = spark.createDataFrame([(s.upper(), s) for s in hist], "name string, normalized_name string")
    got = {r["skill"]: r for r in emerging_skills(metrics, skills, day(49), window=window).collect()}
    want = {}
    for s, h in hist.items():
        count, today = h[49]
        if count < 5 or today < 2:
            continue
        reach = max(window, 30)
        fetched = {n: v for n, v in h.items() if 49 - reach < n <= 49}
        recent = [v for n, v in fetched.items() if n >= 49 - window]
        if len(recent) < 7:
            want[s.upper()] = None
            continue
        w7 = [v[1] for n, v in fetched.items() if n >= 42]
        w30 = [v[1] for n, v in fetched.items() if n >= 19]
        a7, a30 = sum(w7) / len(w7), sum(w30) / len(w30)
        g = brute_trend({n: v[1] for n, v in h.items()}, 49, 7)
        if g is None or g <= 0:
            continue
        scale = lambda p: (max(-100, min(100, p)) + 100) / 2
        want[s.upper()] = js_round(0.4 * scale((a7 - a30) / a30 * 100) + 0.3 * scale((today - a7) / a7 * 100) + 0.2 * max(0, min(100, today * 5)) + 0.1 * (sum(v[0] > 0 for v in recent) / window * 100))
    assert {s: r["emerging_score"] for s, r in got.items()} == pytest.approx(want)
    assert all(r["available"] is (want[s] is not None) for s, r in got.items())


def test_health_needs_seven_snapshots_and_survives_missing_roles(spark):
    market = spark.createDataFrame([(day(i), 10 + i, 5, 3.0) for i in range(9)], "metric_date date, total_jobs long, unique_companies long, average_applicants double")
    roles = spark.createDataFrame([(day(i), f"r{k}", 1) for i in range(8) for k in range(1 + i % 2)], "metric_date date, role string, job_count long")
    job_roles = spark.createDataFrame([("Junior",), ("Senior",)], "seniority string")
    got = {r["metric_date"]: r["score"] for r in health.market_health(market, roles, job_roles).collect()}
    assert [got[day(i)] for i in range(6)] == [None] * 6
    # volume 100, growth from avg 14 to 18, flat companies and applicants 50, diversity (0-1)/(2-1) = -100, access 50
    growth = (js_round((18 - 14) / 14 * 100) + 100) / 2
    want = js_round(0.30 * 100 + 0.20 * growth + 0.15 * 50 + 0.15 * 50 + 0.10 * -100 + 0.10 * 50)
    # 01-09 is day 8: previous average over days 1..7 is 14
    assert got[day(8)] == want


def test_overview_of_a_missing_date_is_null(spark):
    schema = tables.METRIC_SCHEMAS["daily_market_metrics"]
    market = spark.createDataFrame([(day(0), 3, 2, 1.0, None)], schema)
    row = dashboard.overview(market, "2023-01-01").first()
    assert row["total_jobs"] is None and row["health_status"] == "Insufficient historical data"
    empty = dashboard.overview(spark.createDataFrame([], schema)).first()
    assert empty["metric_date"] is None


def brute_novel(sightings, state, aliases):
    known = set(state)
    queued = []
    norm = lambda t: re.sub(r"\s+", " ", t.strip().lower())
    for dim, raw, pos in sightings:
        rule = next((c for p, c in fixed.CAPABILITY_RULES if re.search(p, raw.strip(), re.I)), None) if dim == "capability" else None
        key = norm(raw)
        dropped = key in ("", "null")
        found = (dim, key) in known or (dim, key) in aliases or (rule and (dim, norm(rule)) in known)
        if not dropped and not found:
            queued.append((dim, raw, pos))
        known.add((dim, norm(rule) if rule else key))
    return queued


def test_novelty_equals_reading_in_order(spark):
    rng = random.Random(3)
    pool = ["Build RAG bots", "RAG apps", "build rag systems", "Design Multi-Agent Systems", "multi agent x", "Build AI Agents", "Mentor", " mentor ", "null", "", "Deploy it", "deploy ai applications", "x", "X"]
    for _ in range(4):
        seen = [(rng.choice(["skill", "capability", "role"]), rng.choice(pool), i) for i in range(80)]
        state = {("capability", "deploy ai applications")} if rng.random() < 0.5 else set()
        df = spark.createDataFrame([(d, r, f"j{i}", f"f{i // 9:02d}", i) for d, r, i in seen], "dimension string, raw_value string, job_id string, file string, pos int")
        canon = spark.createDataFrame([(d, k, k, k, None) for d, k in state], "dimension string, id string, name string, normalized_name string, merged_into_id string")
        aliases = spark.createDataFrame([], tables.STATE_SCHEMAS["taxonomy_aliases"])
        got = sorted((r["dimension"], r["raw_value"], r["pos"]) for r in taxonomy.novel_values(df, canon, aliases).collect())
        assert got == sorted(brute_novel(seen, state, set()))


def test_strict_resolution_fails_on_dangling_alias(spark):
    values = spark.createDataFrame([("skill", "k8s")], "dimension string, raw_value string")
    canon = spark.createDataFrame([], "dimension string, id string, name string, normalized_name string, merged_into_id string")
    aliases = spark.createDataFrame([("skill", "k8s", "k8s", "gone", "seed")], tables.STATE_SCHEMAS["taxonomy_aliases"])
    resolved = taxonomy.resolve_taxonomy(values, canon, aliases)
    for action in (resolved.collect, resolved.count, resolved.drop("error").collect, resolved.select("raw_value").collect):
        with pytest.raises(Exception, match="alias_target_missing"):
            action()


def test_spelling_variants_give_one_pending_row(spark):
    values = spark.createDataFrame([("skill", v, str(i), "f", i) for i, v in enumerate(["Python", "python", " Python", "PYTHON"])], "dimension string, raw_value string, job_id string, file string, pos int")
    canon = spark.createDataFrame([], "dimension string, id string, name string, normalized_name string, merged_into_id string")
    aliases = spark.createDataFrame([], tables.STATE_SCHEMAS["taxonomy_aliases"])
    queue = spark.createDataFrame([], tables.STATE_SCHEMAS["taxonomy_review_queue"])
    new = taxonomy.queue_novel(queue, values, canon, aliases, now())
    assert [r["raw_value"] for r in new.collect()] == ["Python"]
    again = taxonomy.review_candidates(taxonomy.resolve_taxonomy(values, canon, aliases), new, ["first_seen_job_id"])
    assert again.count() == 0


def test_role_merges(spark, rows):
    roles = spark.createDataFrame([(c, c.upper(), None) for c in "abcdefh"] + [("g", "G", "a")], "id string, name string, merged_into_id string")
    merges = spark.createDataFrame(
        [(1, "b", "b"), (2, "b", "z"), (3, "b", "c"), (4, "c", "d"), (5, "a", "d"), (6, "e", "g"), (7, "g", "e"), (8, "e", "b"), (9, "f", "c"), (10, "h", "d")],
        "seq int, source_id string, target_id string",
    )
    merged, errors = governance.apply_role_merges(roles, merges)
    assert rows(errors.select("seq", "error_code"), "seq") == [
        (1, "self_merge"), (2, "target_missing"), (4, "collides_in_batch"), (5, "source_has_dependents"), (6, "target_not_active"),
        (7, "source_already_merged"), (8, "collides_in_batch"), (9, "collides_in_batch"),
    ]
    assert {r[0]: r[2] for r in rows(merged) if r[2]} == {"b": "c", "h": "d", "g": "a"}


def test_lifecycle_flat_form_never_overwrites(spark, rows):
    state = spark.createDataFrame([("a", True)], "job_id string, evaluation boolean")
    batch = spark.createDataFrame([("f1", "a", False, None), ("f1", "b", False, None), ("f1", "c", True, False), ("f2", "c", False, None)], "file string, job_id string, replaces boolean, evaluation boolean")
    assert rows(upsert.upsert_lifecycle(state, batch), "job_id") == [("a", True), ("b", None), ("c", False)]


def test_known_priority_is_kept(spark, rows):
    state = spark.createDataFrame([("j", "s", "c", "critical"), ("j", "t", "c", None)], tables.STATE_SCHEMAS["job_skills"])
    batch = spark.createDataFrame([("f", 0, "j", "s", "d", None), ("f", 1, "j", "t", "d", "preferred")], "file string, pos int, job_id string, normalized_name string, category string, priority string")
    assert rows(upsert.upsert_job_skills(state, batch), "skill_id") == [("j", "s", "d", "critical"), ("j", "t", "d", "preferred")]


def test_first_per_key_prunes_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = plan_of(firsts.first_per_key(df, ["k"], ["id"]))
    assert plan.index("Exchange") < plan.index("Partial") and plan.count("WindowGroupLimit") == 2


def test_upsert_never_shuffles_the_state(spark, tmp_path):
    spark.range(1000).select("id", F.lit("x").alias("v")).write.parquet(str(tmp_path / "s"))
    state = spark.read.parquet(str(tmp_path / "s"))
    spark.createDataFrame([(1, "y"), (5000, "z")], "id long, v string").write.parquet(str(tmp_path / "b"))
    batch = spark.read.parquet(str(tmp_path / "b"))
    merged = upsert.merge_rows(state, batch, ["id"], {})
    assert merged.count() == 1001
    assert "SortMergeJoin" not in plan_of(merged) and "hashpartitioning(id" not in plan_of(merged)


def test_dedup_keeps_rows_without_id(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), (None, 0, 2), (None, 1, 1), ("", 0, 3), ("b", 1, 2)], "job_id string, dataset_no int, position int")
    got = sorted(firsts.dedup_postings(df).collect(), key=str)
    assert len(got) == 5 and ("a", 0, 1) in [tuple(r) for r in got]


def test_datasets(spark, tmp_path):
    good, bad, folder = tmp_path / "good.json", tmp_path / "bad one.json", tmp_path / "folder"
    folder.mkdir()
    good.write_text('{"jobId": "1", "title": "x"}\n{"title": "no id"}\n\n')
    bad.write_text('{"jobId": "2"}\n{broken\n{"jobId": 1, "title": "late"}\n')
    (folder / "a.json").write_text('{"jobId": "3"}\n{"jobId": "2"}\n')
    gone = str(tmp_path / "none.json")
    found = postings.read_datasets(spark, [str(good), f" {bad} ", gone, str(good), str(folder)])
    got = sorted(tuple(r) for r in found.postings.select("dataset_no", F.coalesce("job_id", F.lit("")), "dataset").collect())
    assert got == [(0, "", str(good)), (0, "1", str(good)), (1, "1", str(bad)), (1, "2", str(bad)), (3, "2", str(folder)), (3, "3", str(folder))]
    assert sorted(map(tuple, found.failures.collect())) == sorted([(str(bad), "broken JSON", 1), (gone, "PATH_NOT_FOUND", 0)])
    unique = sorted(tuple(r) for r in found.unique().select(F.coalesce("job_id", F.lit("")), "dataset_no").collect())
    assert unique == [("", 0), ("1", 0), ("2", 1), ("3", 3)]
    assert found.skipped().first().duplicates == 2
    array, torn = tmp_path / "array.json", tmp_path / "torn.json"
    array.write_text('[{"jobId": "5"},\n {"jobId": "4"}, {"jobId": "5", "title": "again"}]')
    torn.write_text('[{"jobId": "7"},\n {"jobId"')
    many = postings.read_datasets(spark, [str(array), str(torn)], multi_line=True)
    assert [tuple(r) for r in many.failures.collect()] == [(str(torn), "broken JSON", 1)]
    assert sorted(tuple(r) for r in many.unique().select("job_id", "title").collect()) == [("4", None), ("5", None)]
    none = postings.read_datasets(spark, [gone])
    assert none.unique().count() == 0 and none.failures.count() == 1 and none.skipped().first().duplicates == 0


def test_datasets_are_scanned_once(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(f'{{"jobId": "{i}"}}\n{{bad\n')
    found = postings.read_datasets(spark, [str(tmp_path / f"{i}.json") for i in range(3)])
    for df in (found.postings, found.failures):
        # What is left is the staged table; the text was read before.
        assert "json" not in plan_of(df).lower() and not any(f.endswith(".json") for f in df.inputFiles())


def test_terms_by_the_thousand_equal_a_pattern_each(spark):
    from jobtide.functions.checks import matches_title
    from jobtide.operators.terms import label_by_rules, matching_titles

    random.seed(4)
    pieces = ["c", "C++", "++", ".NET", "ml", "ML-Ops", "data engineer", "Data", "é", "x y", r"a\Eb", r"\Qz", "$", "(r)", "sr.", "_u", "9"]
    terms = [random.choice(pieces) + random.choice(["", " ", "-", " dev"]) + random.choice(pieces) for _ in range(60)] + pieces + ["", None]
    titles = [" ".join(random.choices([*pieces, "senior", "Dev", ","], k=random.randint(1, 5))) for _ in range(300)] + ["", None, "a.net b", "a++b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id int, title string")
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    want = {r.id for r in df.filter(matches_title("title", [t for t in terms if t])).collect()}
    assert {r.id for r in matching_titles(df, table).collect()} == want and 0 < len(want) < 300
    plan = plan_of(matching_titles(df, table))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # The same again where a term is blank, where all are, and where none is given.
    blank = table.union(spark.createDataFrame([(" ",)], "term string"))
    assert {r.id for r in matching_titles(df, blank).collect()} == {r.id for r in df.filter(matches_title("title", [t for t in terms if t] + [" "])).collect()}
    assert matching_titles(df, table.filter("term = ''")).count() == 0
    assert matching_titles(df, table.limit(0)).count() == len(titles)

    rules = [(0, "data", "Data", r"\bdata\b"), (1, "dev", "Builds", "dev$"), (2, "ml", "Learns", "ml"), (3, "data", "More data", "data")]
    labels = label_by_rules(df, spark.createDataFrame(rules, "rank int, term string, label string, pattern string"), "title")

    def first(title):
        for _, term, label, pattern in rules:
            if re.search(rf"\b{term}\b", title or "", re.I | re.A) and re.search(pattern, title, re.I | re.A):
                return label

    assert {r.id: r.rule_label for r in labels.collect()} == {i: first(t) for i, t in enumerate(titles)}


def test_append_log_takes_every_batch_once(spark, tmp_path, monkeypatch):
    from jobtide.sources import appends

    path, schema = str(tmp_path / "log"), "id int, v string"

    def batch(*ids):
        return spark.createDataFrame([(i, f"v{i}") for i in ids], schema)

    def held():
        return sorted(r.id for r in appends.read_appended(spark, path, schema).collect())

    assert held() == []
    assert appends.append(batch(1, 2), path, "a", 0) and appends.append(batch(3), path, "b", 0)
    assert not appends.append(batch(1, 2), path, "a", 0)  # replayed
    assert appends.append(batch(), path, "a", 1) and appends.append(batch(4), path, "a", 2)
    assert held() == [1, 2, 3, 4]
    # Two writers of one batch that don't see each other: the first holds.
    monkeypatch.setattr(appends, "has_batch", lambda *_: False)
    assert not appends.append(batch(9), path, "a", 2)
    monkeypatch.undo()
    assert held() == [1, 2, 3, 4]
    assert appends.compact(spark, path, schema) and held() == [1, 2, 3, 4]
    assert len(appends._folders(spark, path)) == 1 and not appends.compact(spark, path, schema)
    assert not appends.append(batch(1, 2), path, "a", 0) and appends.append(batch(5), path, "c", 0)
    assert appends.compact(spark, path, schema) and held() == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError, match="no name for a stream"):
        appends.append(batch(1), path, "compaction", 0)


def test_merge_chains_equal_a_walk(spark):
    random.seed(6)
    names = [f"r{i}" for i in range(40)]
    into = {n: random.choice([None, None, *names, "gone"]) for n in names} | {"a": "a", "b": "c", "c": "b"}
    into |= {f"chain{i}": f"chain{i + 1}" for i in range(9)} | {"chain9": None} | {f"lost{i}": f"lost{i + 1}" for i in range(7)}
    roles = spark.createDataFrame([(n, n.upper(), t) for n, t in into.items()], "id string, name string, merged_into_id string")

    def walk(start, most):
        at, hops = start, 0
        while into[at] is not None:
            if hops == most:
                return None, None, hops, "too_many_hops"
            if into[at] not in into:
                return None, None, hops, "missing_target"
            at, hops = into[at], hops + 1
        return at, at.upper(), hops, None

    for most in (1, 2, 5):
        got = {r.id: tuple(r)[1:] for r in taxonomy.follow_merges(roles, most).collect()}
        assert got == {n: walk(n, most) for n in into}


def test_many_rows_per_key_are_cut_down_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, (i * 37) % 101, i, [i]) for i in range(300)], "k int, o int, i int, l array<int>")
    want = sorted(map(str, firsts.top_per_key(df, ["k"], ["o", F.desc("i")], 20).collect()))
    monkeypatch.setattr(firsts, "GROUP_LIMIT", 5)
    salted = firsts.top_per_key(df, ["k"], ["o", F.desc("i")], 20)
    assert sorted(map(str, salted.collect())) == want and salted.columns == df.columns
    assert firsts.top_per_key(df.select("l"), ["l"], ["l"], 20).count() == 300


def test_run_updates(spark):
    schema = "id int, status string, jobs_scraped int, completed_at timestamp"
    state = spark.createDataFrame([(1, "pending", None, None), (2, "pending", None, None)], schema)
    at = dt.datetime(2024, 1, 1)
    updates = spark.createDataFrame([(1, at, "scraping", None, False), (1, at + dt.timedelta(1), None, 5, True)], "id int, at timestamp, status string, jobs_scraped int, completed boolean")
    got = {r["id"]: (r["status"], r["jobs_scraped"], r["completed_at"] is not None) for r in runs.apply_run_updates(state, updates).collect()}
    assert got == {1: ("scraping", 5, True), 2: ("pending", None, False)}
    empty = spark.createDataFrame([(1, at, None, None, False)], updates.schema)
    with pytest.raises(Exception, match="No fields"):
        runs.apply_run_updates(state, empty).collect()


def test_collect_postings(spark):
    cards = spark.createDataFrame(
        [(1, 0, 0, "a", "x"), (1, 0, 1, "b", "AI dev"), (1, 25, 0, "a", "AI two"), (1, 25, 1, "", "AI"), (1, 25, 2, "c", "AI lead"), (1, 50, 0, "d", "AI late")],
        "search_id int, page_start int, pos int, job_id string, title string",
    )
    pages_ = spark.createDataFrame([(1, 0, 25), (1, 25, 3), (1, 50, 25)], "search_id int, page_start int, n_cards int")
    assert [r["job_id"] for r in collect_postings(cards, pages_, ["ai"], 10).orderBy("page_start", "pos").collect()] == ["b", "c"]
    assert [r["job_id"] for r in collect_postings(cards, pages_, ["ai"], 1).collect()] == ["b"]


def test_streams(spark, tmp_path):
    source, base, checkpoint = tmp_path / "in", str(tmp_path / "base"), str(tmp_path / "cp")
    source.mkdir()
    doc = '{"job_metadata": {"job_id": "%s", "title": "%s"}, "skills": {"k": ["RAG"]}}'
    (source / "a.json").write_text(doc % ("1", "first"))
    stream_ingest(spark, str(source), base, checkpoint, now()).awaitTermination()
    (source / "b.json").write_text(doc % ("1", "second"))
    (source / "c.json").write_text("{broken")
    stream_ingest(spark, str(source), base, checkpoint, now()).awaitTermination()
    stream_ingest(spark, str(source), base, checkpoint, now()).awaitTermination()
    state = tables.read_state(spark, base)
    assert [tuple(r) for r in state["jobs"].select("external_job_id", "title").collect()] == [("1", "second")]
    assert tables.state_version(spark, base) == 2 and state["job_skills"].count() == 1

    # Another source with its own checkpoint counts its batches on its own; an old file is read as well.
    other = tmp_path / "in2"
    other.mkdir()
    (other / "a.json").write_text(doc % ("2", "other"))
    stream_ingest(spark, str(other), base, str(tmp_path / "cp2"), now()).awaitTermination()
    (other / "old.json").write_text(doc % ("3", "old"))
    os.utime(other / "old.json", (1, 1))
    stream_ingest(spark, str(other), base, str(tmp_path / "cp2"), now()).awaitTermination()
    assert sorted(r[0] for r in tables.read_state(spark, base)["jobs"].select("external_job_id").collect()) == ["1", "2", "3"]


def test_replayed_batch_and_missing_folder(spark, tmp_path):
    base = str(tmp_path / "base")
    state = tables.read_state(spark, base)
    assert all(t.count() == 0 for t in state.values())
    skills = spark.createDataFrame([("RAG", "rag", None), ("SQL", "sql", "db")], tables.STATE_SCHEMAS["skills"])
    assert tables.write_state(spark, base, {"skills": skills}, "one", 0) == 1
    assert tables.has_batch(spark, base, "one", 0) and not tables.has_batch(spark, base, "two", 0)
    assert tables.read_state(spark, base)["skills"].count() == 2 and not tables.read_state(spark, base)["jobs"].count()
    with pytest.raises(ValueError, match="never published"):
        tables.read_state(spark, base, 7)
    (tmp_path / "base" / "state" / "skills").rename(tmp_path / "gone")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_state(spark, base)


def test_first_writer_of_a_version_holds(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "base")
    rows = [spark.createDataFrame([(name, "rag", None)], tables.STATE_SCHEMAS["skills"]) for name in ("RAG", "late")]
    tables.write_state(spark, base, {"skills": rows[0]}, "a", 0)
    monkeypatch.setattr(tables, "_newest", lambda *_: (0, None))
    with pytest.raises(RuntimeError, match="another writer"):
        tables.write_state(spark, base, {"skills": rows[1]}, "b", 0)
    monkeypatch.undo()
    assert [r.name for r in tables.read_state(spark, base)["skills"].collect()] == ["RAG"]
    assert not tables.has_batch(spark, base, "b", 0)


def test_stream_dedup_keeps_the_first_and_late_new_ids(spark, tmp_path):
    base = str(tmp_path / "dedup")
    schema = "job_id string, n int"
    for rows_ in ([("a", 2), ("a", 1), (None, 3), ("", 4), ("b", 5)], [("a", 0), ("late", 1), (None, 9)]):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream_dedup(spark.readStream.schema(schema).parquet(f"{base}/in"), base, f"{base}/cp", ["n"]).awaitTermination()
    got = sorted(((r.job_id or "", r.n) for r in read_unique(spark, base, schema).collect()))
    assert got == [("", 3), ("", 4), ("", 9), ("a", 1), ("b", 5), ("late", 1)]


def test_stream_dedup_reads_only_the_buckets_of_its_ids(spark, tmp_path):
    """After many ids, a batch of few opens few buckets; a replayed batch changes nothing."""
    base, cp, schema = tmp_path / "dedup", tmp_path / "dedup" / "cp", "job_id string, n int"

    def run(rows_=()):
        if rows_:
            spark.createDataFrame(list(rows_), schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream_dedup(spark.readStream.schema(schema).parquet(f"{base}/in"), str(base), str(cp), ["n"], buckets=64).awaitTermination()

    run([(f"a{i}", i) for i in range(300)])
    own = {r[0] for r in spark.createDataFrame([("a5",), ("new",)], "k string").select(tables.bucket_of("k", 64)).collect()}
    others = [p for p in (base / "seen").glob("bucket=*") if int(p.name.split("=")[1]) not in own]
    assert len(others) > 40
    for folder in others:
        (folder / "batch=0" / "broken.parquet").write_text("not to be opened")
    shutil.copytree(cp, tmp_path / "before")
    run([("a5", 9), ("new", 1), ("", 3)])
    want = sorted(map(str, read_unique(spark, str(base), schema).collect()))
    assert len(want) == 302
    shutil.rmtree(cp)
    shutil.copytree(tmp_path / "before", cp)
    run()
    assert sorted(map(str, read_unique(spark, str(base), schema).collect())) == want
