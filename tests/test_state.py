"""The bucketed state: copy on write, counts, snapshots of many dates, clean-up."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from jobtide.operators.backfill import backfill_dimension, backfill_market, backfill_skills
from jobtide.operators import project, upsert
from jobtide.operators.counts import job_counts, snapshot_from_counts, snapshots_from_counts
from jobtide.plans import daily as plan
from jobtide.sources import tables
from jobtide.sources.documents import stage_documents
from jobtide.testbed import stored

NOW = "2024-01-0{} 08:00:00"


def document(job, seed, **meta):
    rng = random.Random(seed)
    return json.dumps(
        {
            "job_metadata": {"job_id": job, "company": f"c{rng.randint(0, 4)}", "city": rng.choice(["Oslo", "Pune", None]), "applicants": rng.choice([None, 5, 70]), **meta},
            "skills": {"k": [f"Skill {rng.randint(0, 6)}" for _ in range(3)], "m": ["RAG"]},
            "skill_priority": {"critical": ["Skill 1"], "preferred": ["rag"]},
            "capabilities": [f"Do {rng.randint(0, 3)}"],
            "role_analysis": {"actual_role_category": rng.choice([None, "Data Engineer", "ML Engineer"]), "seniority_inferred": rng.choice([None, "Senior", "Intern"])},
        }
    )


def files(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "file string, raw string")


def ingest(spark, base, docs, day, buckets=None):
    return plan.ingest_files(files(spark, docs), base, F.lit(NOW.format(day)).cast("timestamp_ntz"), buckets=buckets).collect()


def content(frames):
    return {name: sorted(str(tuple(r)) for r in df.collect()) for name, df in frames.items()}


@pytest.fixture(scope="module")
def state(spark, tmp_path_factory):
    """Three batches over three days: many jobs, one job anew with changes, jobs of which one is read again."""
    base = str(tmp_path_factory.mktemp("state"))
    batches = [
        {f"a{i:02}.json": document(f"j{i}", i) for i in range(40)},
        {"b.json": document("j7", 900, title="again")},
        {f"c{i}.json": document(f"j{i}", 500 + i) for i in (7, 50, 51)} | {"bad.json": "{"},
    ]
    for day, docs in enumerate(batches, 1):
        ingest(spark, base, docs, day, 16)
    return base, batches


def test_state_equals_whole_table_upserts(spark, state):
    base, batches = state
    whole = {name: spark.createDataFrame([], schema) for name, schema in tables.STATE_SCHEMAS.items()}
    for day, docs in enumerate(batches, 1):
        staged = stage_documents(files(spark, docs)).filter("status = 'ok'")
        whole = plan.apply_documents(whole, staged, F.lit(NOW.format(day)).cast("timestamp_ntz"))
        whole = {name: spark.createDataFrame(df.collect(), df.schema) for name, df in whole.items()}
    got = content(tables.read_state(spark, base))
    counts = got.pop("job_counts")
    assert got == {name: rows for name, rows in content(whole).items() if name != "job_counts"}
    fresh = job_counts(*[whole[n] for n in ("jobs", "job_skills", "job_capabilities", "job_roles")])
    summed = spark.createDataFrame([], tables.STATE_SCHEMAS["job_counts"]).unionByName(tables.read_state(spark, base)["job_counts"])
    keys = ["dimension", "value", "day"]
    rest = [c for c in summed.columns if c not in keys]
    assert content({"x": summed.groupBy(*keys).agg(*[F.sum(c) for c in rest])}) == content({"x": fresh.select(*keys, *rest)})
    assert counts


def test_a_small_batch_writes_only_its_buckets(spark, state, tmp_path):
    base, _ = state
    rows = tables.versions(spark, base).filter("version = 2").collect()
    written = {(r.table_name, r.bucket) for r in rows}
    job_tables = [*plan.JOB_TABLES, "job_counts"]
    own = spark.range(1).select(tables.bucket_of(F.lit("j7"), 16)).first()[0]
    assert {b for t, b in written if t in job_tables} == {own} and {t for t, _ in written if t in job_tables} == set(job_tables)
    # Names that are known touch nothing.
    assert not {t for t, _ in written} & {"skills", "roles", "taxonomy_review_queue"}
    # The folders on disk are those of the manifest.
    import pathlib

    folder = rows[0].folder
    on_disk = {(p.parts[-3], int(p.name.split("=")[1])) for p in pathlib.Path(base, "state").glob(f"*/attempt={folder}/bucket=*")}
    assert on_disk == written
    # Reading for the next small batch lists no other bucket of the tables of jobs.
    held = tables.read_state(spark, base, only={"jobs": [own]})["jobs"]
    assert all(f"bucket={own}/" in f for f in held.inputFiles())


def test_older_versions_can_be_read(spark, state):
    base, _ = state
    titles = [tables.read_state(spark, base, v)["jobs"].filter("external_job_id = 'j7'").first().title for v in (1, 2, 3)]
    assert titles == ["Untitled", "again", "Untitled"]
    assert [tables.read_state(spark, base, v)["jobs"].count() for v in (1, 2, 3)] == [40, 40, 42]


def test_counts_give_the_metrics_of_facts_and_backfill(spark, state):
    base, _ = state
    held = tables.read_state(spark, base)
    jobs = held["jobs"].withColumnRenamed("external_job_id", "job_id")
    for day in ("2023-12-31", "2024-01-01", "2024-01-03"):
        want = plan.snapshot_frames(held, day)
        want["daily_market_metrics"] = want["daily_market_metrics"].drop("market_health_score")
        got = snapshot_from_counts(held["job_counts"], held["roles"], day)
        assert content({n: got[n].select(*want[n].columns) for n in want}) == content(want)
    start, end = "2024-01-01", "2024-01-04"
    got = snapshots_from_counts(held["job_counts"], held["roles"], start, end)
    want = {
        "daily_market_metrics": backfill_market(jobs, start, end), "daily_skill_metrics": backfill_skills(held["job_skills"], jobs, start, end),
        "daily_capability_metrics": backfill_dimension(held["job_capabilities"], jobs, "capability_id", start, end),
        "daily_seniority_metrics": backfill_dimension(held["job_roles"], jobs, "seniority", start, end),
        "daily_location_metrics": backfill_dimension(jobs, jobs, "city", start, end),
    }
    assert content({n: got[n].select(*want[n].columns) for n in want}) == content(want)
    each = [snapshot_from_counts(held["job_counts"], held["roles"], f"2024-01-0{d}")["daily_role_metrics"].collect() for d in range(1, 5)]
    assert sorted(map(str, got["daily_role_metrics"].collect())) == sorted(str(r) for rows in each for r in rows)


def test_snapshots_read_no_facts(spark, state, tmp_path):
    base, _ = state
    held = tables.read_state(spark, base)
    for frame in snapshot_from_counts(held["job_counts"], held["roles"], "2024-01-02").values():
        read = {f.split("/state/")[1].split("/")[0] for f in frame.inputFiles()}
        assert read <= {"job_counts", "roles"}


def test_many_dates_are_replaced_at_once(spark, state, tmp_path):
    base = str(tmp_path / "snap")
    held = tables.read_state(spark, state[0])
    frames = snapshots_from_counts(held["job_counts"], held["roles"], "2024-01-01", "2024-01-04")
    seniority = {"daily_seniority_metrics": frames["daily_seniority_metrics"]}
    days = [f"2024-01-0{d}" for d in range(1, 5)]
    tables.publish_snapshots(spark, base, seniority, days)
    before = content({d: tables.read_metrics(spark, base, "daily_seniority_metrics").filter(F.col("metric_date") == d) for d in days})
    assert all(before.values())
    # Two dates anew, one of them emptied and one with a vanished member; rows of other dates are left out.
    senior = frames["daily_seniority_metrics"].filter("seniority = 'Senior' AND metric_date <> '2024-01-02'")
    tables.publish_snapshots(spark, base, {"daily_seniority_metrics": senior}, ["2024-01-02", "2024-01-03"])
    after = content({d: tables.read_metrics(spark, base, "daily_seniority_metrics").filter(F.col("metric_date") == d) for d in days})
    assert after[days[0]] == before[days[0]] and after[days[3]] == before[days[3]]
    assert not after[days[1]] and len(after[days[2]]) == 1


def test_vacuum_leaves_what_is_read(spark, state, tmp_path):
    import pathlib
    import shutil

    base = str(tmp_path / "copy")
    shutil.copytree(state[0], base)
    before = content(tables.read_state(spark, base))
    # An attempt that was never published.
    orphan = pathlib.Path(base, "state", "jobs", "attempt=dead", "bucket=3")
    orphan.mkdir(parents=True)
    assert tables.vacuum_state(spark, base) == 0
    gone = tables.vacuum_state(spark, base, older_than=dt.timedelta(0))
    assert gone > 1 and not orphan.exists()
    assert content(tables.read_state(spark, base)) == before
    assert tables.vacuum_state(spark, base, older_than=dt.timedelta(0)) == 0

    snaps = str(tmp_path / "snaps")
    frame = {"daily_seniority_metrics": spark.createDataFrame([(dt.date(2024, 1, 1), "Senior", 1, 100.0)], tables.METRIC_SCHEMAS["daily_seniority_metrics"])}
    for _ in range(2):
        tables.publish_snapshot(spark, snaps, frame, "2024-01-01")
    assert tables.vacuum_snapshots(spark, snaps, dt.timedelta(0)) == 1
    assert tables.read_metrics(spark, snaps, "daily_seniority_metrics").count() == 1


def test_rows_outside_the_touched_buckets_are_refused(spark, tmp_path):
    writer = tables.StateWriter(spark, str(tmp_path / "x"), 4)
    skills = spark.createDataFrame([(str(i), str(i), None) for i in range(20)], tables.STATE_SCHEMAS["skills"])
    with pytest.raises(ValueError, match="outside the touched buckets"):
        writer.write("skills", skills, [1])
    tables.write_state(spark, str(tmp_path / "y"), {"skills": skills}, buckets=4)
    with pytest.raises(ValueError, match="4 buckets"):
        tables.StateWriter(spark, str(tmp_path / "y"), 8)


# --- a folder whose files change in place


def test_changed_files_are_read_again(spark, tmp_path):
    import os
    import pathlib

    source, base = tmp_path / "in", str(tmp_path / "base")
    (source / "deep").mkdir(parents=True)
    for i in range(6):
        (source / f"{i}.json").write_text(document(f"j{i}", i))
    (source / "deep" / "7.json").write_text(document("j7", 7))
    (source / "note.txt").write_text("{}")
    now = F.lit("2024-01-01").cast("timestamp_ntz")

    def run():
        return sorted((pathlib.Path(r.file).name, r.status) for r in plan.ingest_changes(spark, f"file://{source}", base, now, 8).collect())

    assert [n for n, _ in run()] == ["0.json", "1.json", "2.json", "3.json", "4.json", "5.json", "7.json"]
    assert run() == [] and tables.state_version(spark, base) == 1
    edited = document("j2", 77, title="edited").replace("RAG", "Graph")
    (source / "2.json").write_text(edited)
    os.utime(source / "3.json")  # touched only
    (source / "old.json").write_text(document("j9", 9))
    os.utime(source / "old.json", (5, 5))  # arrives late with an old time
    (source / "4.json").write_text("{broken")
    assert run() == [("2.json", "ok"), ("4.json", "skipped_invalid_json"), ("old.json", "ok")]
    held = tables.read_state(spark, base)
    assert held["file_ledger"].count() == 8
    jobs = {r.external_job_id: r.title for r in held["jobs"].collect()}
    assert sorted(jobs) == ["j0", "j1", "j2", "j3", "j4", "j5", "j7", "j9"] and jobs["j2"] == "edited"
    skills = {r.skill_id for r in held["job_skills"].filter("job_id = 'j2'").collect()}
    # What the document no longer names stays, as with any second reading.
    assert {"graph", "rag"} <= skills
    assert held["taxonomy_review_queue"].filter("raw_value = 'Graph'").count() == 1
    assert run() == [] and tables.state_version(spark, base) == 2


def test_names_of_a_batch_are_cut_down_to_their_first_sighting(spark):
    docs = {f"f{i}": document(f"j{i}", i) for i in range(12)}
    staged = stage_documents(files(spark, docs)).filter("status = 'ok'")
    batch = plan.Batch.of(staged)
    first = [r.asDict() for r in batch.first_names().collect()]
    assert len({(r["dimension"], r["raw_value"]) for r in first}) == len(first)
    seen = {}
    for r in sorted(batch.sightings().collect(), key=lambda r: (r["file"], r["pos"])):
        seen.setdefault((r["dimension"], r["raw_value"]), (r["job_id"], r["file"], r["pos"]))
    assert {(r["dimension"], r["raw_value"]): (r["job_id"], r["file"], r["pos"]) for r in first} == seen


def test_rules_of_capabilities_are_matched_once(spark):
    rows = project.project_job_capabilities(spark.createDataFrame([("f", "j", ["Build RAG bots", " Do  it "])], "file string, job_id string, capabilities array<string>"))
    assert [tuple(r)[4:] for r in rows.orderBy("pos").collect()] == [("Build RAG Systems", "Build RAG Systems", "build rag systems"), (None, "Do  it", "do it")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("observab") == 1


def test_lifecycle_rows_meet_the_state_in_one_merge(spark):
    state = spark.createDataFrame([("a", True), ("b", True), ("c", None), (None, True)], "job_id string, evaluation boolean")
    rows = [("f1", "a", True, False), ("f2", "a", False, None), ("f1", "b", False, None), ("f1", "d", False, None), ("f1", "e", True, True), ("f1", "g", None, True), ("f1", None, True, False)]
    batch = spark.createDataFrame(rows, "file string, job_id string, replaces boolean, evaluation boolean")
    new = upsert.upsert_lifecycle(state, batch)
    want = [("a", False), ("b", True), ("c", None), ("d", None), ("e", True), (None, False), (None, True)]
    assert sorted(map(tuple, new.collect()), key=str) == sorted(want, key=str)
    assert new._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3


def test_a_file_for_each_key_is_replaced_in_place(spark, tmp_path):
    path = str(tmp_path / "files")
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n")], "k long, a string").repartition(2, "k")
    stored._as_files(docs, path)
    stored._as_files(docs.filter("k = 1").withColumn("a", F.lit("new")), path)
    found = {p.name: sorted(p.read_text().splitlines()) for p in (tmp_path / "files").iterdir()}
    assert found == {"k=1.json": ['{"a":"new"}'], "k=2.json": ['{"a":"y"}', '{"a":"z"}'], "k=__HIVE_DEFAULT_PARTITION__.json": ['{"a":"n"}']}


def test_appended_configurations_are_parsed_once(spark, tmp_path, monkeypatch):
    rows = [(k, f"Customer {k}", "BUILDING") for k in range(20)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    plans, append = [], stored.appends.append_search_configs

    def spied(queries, filters, *rest):
        plans.extend(f._jdf.queryExecution().optimizedPlan().toString().lower() for f in (queries, filters))
        return append(queries, filters, *rest)

    monkeypatch.setattr(stored.appends, "append_search_configs", spied)
    assert stored._appended_configs(spark, str(tmp_path)).count() == 40
    assert plans and not any("json" in p for p in plans)


# --- large batches


def test_one_full_join_merges_as_the_small_joins_do(spark):
    old = spark.createDataFrame([("a", 1, 2), ("a", 3, 4), ("b", None, 5), (None, 6, 7), ("z", 1, 1)], "k string, x int, y int")
    new = spark.createDataFrame([("a", 9, None), ("b", 8, 8), (None, 7, 7), ("c", 1, None)], "k string, x int, y int")
    rules = {"x": upsert.keep_old, "y": upsert.new_else_old}
    large = upsert.merge_rows(old, new, ["k"], rules, large=True)
    assert content({"x": large}) == content({"x": upsert.merge_rows(old, new, ["k"], rules)})
    assert content({"x": upsert.insert_missing(old, new, ["k"], large=True)}) == content({"x": upsert.insert_missing(old, new, ["k"])})
    assert large._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_the_first_batch_is_joined_with_nothing(spark, tmp_path):
    nothing = tables.read_state(spark, str(tmp_path), names=["job_attributes"])["job_attributes"]
    batch = spark.range(3).select(F.col("id").cast("string").alias("job_id"), *[F.lit(True).alias(c) for c in nothing.columns[1:]])
    merged = upsert.merge_rows(nothing, batch, ["job_id"], {})
    assert merged.count() == 3 and "Join" not in merged._jdf.queryExecution().optimizedPlan().toString()


def _large_batches():
    """Two batches; jobs of one document, and jobs of several that differ."""
    first = {f"a{i:02}.json": document(f"j{i}", i) for i in range(12)} | {f"b{i}.json": document(f"j{i}", 100 + i, title="later") for i in (3, 5)}
    second = {f"c{i:02}.json": document(f"j{i}", 200 + i) for i in range(4, 16)} | {"d.json": document("j5", 300), "e.json": document("j20", 301), "f.json": document("j20", 302)}
    return [first, second]


@pytest.mark.parametrize("limit", [1, 3])
def test_large_batches_give_the_state_of_small_ones(spark, tmp_path, monkeypatch, limit):
    """With a limit of 1 the jobs of several documents are too many to be told apart, with 3 they are few."""
    bases = [str(tmp_path / name) for name in ("small", "large")]
    for base, least in zip(bases, (20_000, limit)):
        monkeypatch.setattr(plan, "LARGE_BATCH", least)
        for day, docs in enumerate(_large_batches(), 1):
            ingest(spark, base, docs, day, 4)
    small, large = (content(tables.read_state(spark, base)) for base in bases)
    assert small == large


def test_jobs_of_one_document_pass_a_large_batch_without_a_sort(spark):
    rows = spark.createDataFrame([("f", "a", "v1", "x"), ("g", "b", "v1", "y"), ("h", None, "v1", "z")], "file string, job_id string, analysis_version string, analysis string")
    none = upsert.repeated_jobs(rows).limit(0)
    state = tables.empty(spark, tables.STATE_SCHEMAS["job_analysis"])
    large = upsert.upsert_analysis(state, rows, large=True, repeated=none)
    assert content({"x": large}) == content({"x": upsert.upsert_analysis(state, rows)})
    plan_ = large._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan_ and "Join" not in plan_


def test_repeated_jobs_are_cut_down_and_keys_may_be_null(spark):
    rows = spark.createDataFrame([("f", "a", "x"), ("g", "a", "y"), ("f", None, "u"), ("g", None, "v"), ("f", "b", "z")], "file string, job_id string, actual_role string")
    state = spark.createDataFrame([("b", "old"), ("c", "old")], "job_id string, actual_role string")
    large = upsert.upsert_satellite(state, rows, large=True, repeated=upsert.repeated_jobs(rows))
    assert content({"x": large}) == content({"x": upsert.upsert_satellite(state, rows)})


# --- disk


def test_a_batch_leaves_its_version_alone_on_the_disk(spark, tmp_path, monkeypatch):
    import pathlib
    import time

    from jobtide.session import CLEANUP
    from jobtide.sources import documents
    from jobtide.streaming.ingest import stream_ingest

    source, staged = tmp_path / "in", tmp_path / "shared"
    source.mkdir()
    # A folder that no other test stages into.
    monkeypatch.setattr(documents, "shared_dir", lambda _: str(staged))
    for i in range(12):
        (source / f"{i}.json").write_text(document(f"j{i}", i))
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def shuffled():
        return {p for d in folders for p in pathlib.Path(d.getPath()).glob("*/shuffle_*.data")}

    before, shuffles = set(staged.glob("staged-*")), shuffled()
    stream_ingest(spark, str(source), str(tmp_path / "base"), str(tmp_path / "cp"), F.lit("2024-01-01").cast("timestamp_ntz"), buckets=4).awaitTermination()
    assert tables.read_state(spark, str(tmp_path / "base"))["jobs"].count() == 12
    # Rows that were staged for the batch have gone with it, and what was shuffled, too; files are deleted in the background.
    assert set(staged.glob("staged-*")) == before
    until = time.time() + 20
    while shuffled() - shuffles and time.time() < until:
        time.sleep(0.2)
    assert len(shuffled() - shuffles) <= 8  # those of the count above and of the manifest it reads
    # Of a batch of files the status of each stays.
    kept = plan.ingest_files(files(spark, {"x": document("j0", 5), "y": "{"}), str(tmp_path / "base"), F.lit("2024-01-02").cast("timestamp_ntz"))
    assert sorted(map(tuple, kept.select("file", "status").collect())) == [("x", "ok"), ("y", "skipped_invalid_json")]
    assert len(set(staged.glob("staged-*")) - before) == 1
    assert spark.conf.get(CLEANUP, "false") == "false"


def test_folders_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from jobtide.sources import documents

    root = tmp_path / "in put"
    for name in ("a b.json", "k=1.json", "100%25.json", "é.json", "x.txt", "_hidden.json", ".dot.json", "_p=1.json", "deep/er/y.json", "_gone/z.json", ".git/z.json", "p=2/z.json"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f'{{"n": "{name}"}}')
    (root / "link.json").symlink_to(root / "nowhere.json")
    known = spark.createDataFrame([], tables.STATE_SCHEMAS["file_ledger"])
    found = documents.changed_files(spark, str(root), known)
    scanned = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(str(root))
    want = scanned.select("path", F.col("content").cast("string"), F.unix_millis("modificationTime"), "length", F.sha2("content", 256))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 7
    # Spark's scan held an object for every file of the folder in the driver.
    assert "binaryFile" not in found._jdf.queryExecution().executedPlan().toString()
    some = found.filter("NOT endswith(file, 'y.json')").select(F.col("file").alias("path"), "modified", "length", "digest")
    rest = documents.changed_files(spark, f"{tmp_path}/in*", documents.stage(some))
    assert [r["file"].rpartition("/")[2] for r in rest.collect()] == ["y.json"]
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        documents.changed_files(spark, str(tmp_path / "nowhere"), known)
