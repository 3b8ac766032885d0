"""Versioned Parquet tables: state of the facts and published snapshots.

A version is a set of new folders plus manifest rows written last, in a
single file. Readers go through the manifest, so they see all tables of a
version or none, and nothing that is being read is ever overwritten.

The state is kept in hash buckets of each table's key. A version writes only
the buckets it changes and names them in the manifest, one row for each; the
others stay where an earlier version has put them.
"""

from __future__ import annotations

import datetime as dt
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtide import fixed
from jobtide.operators.counts import COUNTS, job_counts
from jobtide.session import delete_path, list_folders

_FLAG = " boolean"
STATE_SCHEMAS = {
    "jobs": (
        "external_job_id string, title string, company string, location string, city string, state string, "
        "country string, employment_type string, job_function string, industry string, applicants int, "
        "posted_at timestamp_ntz, job_url string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
    ),
    "job_analysis": "job_id string, analysis_version string, analysis string",
    "skills": "name string, normalized_name string, category string",
    "job_skills": "job_id string, skill_id string, category string, priority string",
    "capabilities": "name string, normalized_name string",
    "job_capabilities": "job_id string, capability_id string",
    "roles": "name string, normalized_name string, merged_into_id string",
    "job_roles": (
        "job_id string, advertised_role string, actual_role string, seniority string, "
        "minimum_experience double, maximum_experience double"
    ),
    "job_attributes": "job_id string, "
    + ", ".join(f + _FLAG for f in [*fixed.PRODUCTION_FLAGS, *fixed.ENGINEERING_FLAGS, "domain_expertise_required"]),
    "job_ai_lifecycle": "job_id string, " + ", ".join(f + _FLAG for f in fixed.LIFECYCLE_FLAGS),
    "taxonomy_aliases": (
        "dimension string, alias_text string, normalized_alias_text string, canonical_id string, source string"
    ),
    "taxonomy_review_queue": (
        "id string, dimension string, raw_value string, normalized_raw_value string, suggested_canonical_id string, "
        "first_seen_job_id string, queue_reason string, confidence string, status string, notes string, "
        "created_at timestamp_ntz, resolved_at timestamp_ntz"
    ),
    "job_counts": COUNTS,
    "file_ledger": "path string, modified long, length long, digest string",
}
#: The column whose hash is a row's bucket. All tables of jobs share their buckets; job_counts carries its own.
BUCKET_KEYS = {
    "jobs": "external_job_id",
    **dict.fromkeys(["job_analysis", "job_skills", "job_capabilities", "job_roles", "job_attributes", "job_ai_lifecycle"], "job_id"),
    **dict.fromkeys(["skills", "capabilities", "roles"], "normalized_name"),
    "taxonomy_aliases": "normalized_alias_text",
    "taxonomy_review_queue": "normalized_raw_value",
    "file_ledger": "path",
}
#: Buckets of a new state. A batch rewrites whole buckets, so choose as many as make one about a gigabyte.
BUCKETS = 64
#: Tables of a state that are written at the same time.
TABLES_AT_ONCE = 4
_COUNTS = "job_count long, demand_percentage double"
METRIC_SCHEMAS = {
    "daily_market_metrics": (
        "metric_date date, total_jobs long, unique_companies long, average_applicants double, market_health_score double"
    ),
    "daily_skill_metrics": (
        f"metric_date date, skill_id string, {_COUNTS}, critical_count long, important_count long, preferred_count long"
    ),
    "daily_role_metrics": f"metric_date date, role string, {_COUNTS}",
    "daily_capability_metrics": f"metric_date date, capability_id string, {_COUNTS}",
    "daily_seniority_metrics": f"metric_date date, seniority string, {_COUNTS}",
    "daily_location_metrics": f"metric_date date, city string, {_COUNTS}",
    "daily_industry_metrics": f"metric_date date, industry string, {_COUNTS}",
}
_STATE_MANIFEST = (
    "version long, table_name string, bucket int, folder string, filled boolean, buckets int, stream string, batch_id long, "
    "written_at timestamp_ntz"
)
_SNAPSHOT_MANIFEST = "table_name string, metric_date date, version long, folder string, filled boolean, written_at timestamp_ntz"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that the optimizer knows to be empty: joins with it go before anything is shuffled for them."""
    return spark.createDataFrame([], schema).limit(0)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a manifest; none before the first is written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, schema)


def append_manifest(spark: SparkSession, path: str, rows: list, schema: str) -> None:
    # One task, one file: the rows appear together when the job commits.
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def attempt() -> tuple[str, dt.datetime]:
    """A folder name that no other attempt has, and the time of the attempt."""
    return uuid.uuid4().hex, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _published(manifest: DataFrame, *keys: str) -> DataFrame:
    """Per key the newest version; of writers that took the same number the first one holds."""
    order = W.partitionBy(*keys).orderBy(F.desc("version"), "written_at", "folder")
    return manifest.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


# --- state -----------------------------------------------------------------


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, base: str, upto: int | None = None) -> DataFrame:
    """Manifest rows that hold: of the writers of one version those of the first."""
    rows = read_manifest(spark, f"{base}/state/_manifest", _STATE_MANIFEST)
    if upto is not None:
        rows = rows.filter(F.col("version") <= upto)
    writers = rows.groupBy("version").agg(F.min(F.struct("written_at", "folder")).alias("first"))
    return rows.join(writers.select("version", F.col("first.folder")), ["version", "folder"], "left_semi")


def _newest(spark: SparkSession, base: str) -> tuple[int, int | None]:
    """(number, buckets) of the current state; (0, None) before the first."""
    rows = read_manifest(spark, f"{base}/state/_manifest", _STATE_MANIFEST)
    newest = rows.agg(F.max("version").alias("version"), F.max("buckets").alias("buckets")).first()
    return newest["version"] or 0, newest["buckets"]


def state_version(spark: SparkSession, base: str) -> int:
    """Number of the current state, 0 before the first."""
    return _newest(spark, base)[0]


def state_buckets(spark: SparkSession, base: str) -> int:
    """Buckets of the state; what a new one will have before the first version."""
    return _newest(spark, base)[1] or BUCKETS


def has_batch(spark: SparkSession, base: str, stream: str, batch_id: int) -> bool:
    """Whether this batch of this stream is in the state; other streams count their batches on their own."""
    return not versions(spark, base).filter((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).isEmpty()


def _folders(spark: SparkSession, base: str, version: int | None = None) -> list:
    """(table_name, bucket, folder, filled) of a state, one row for each bucket that was ever written."""
    rows = versions(spark, base, version)
    order = W.partitionBy("table_name", "bucket").orderBy(F.desc("version"))
    newest = rows.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1")
    return newest.select("table_name", "bucket", "folder", "filled").collect()


def read_state(
    spark: SparkSession, base: str, version: int | None = None, only: dict[str, list[int]] | None = None, names: list[str] | None = None
) -> dict[str, DataFrame]:
    """Tables of a published state, all or those named; empty ones before the first. A published folder that is gone is an error.

    With ``only``, the given tables hold no more than the given buckets; other buckets are not listed or read.
    """
    if version and version > state_version(spark, base):
        raise ValueError(f"state {version} was never published")
    paths: dict[str, list[str]] = {name: [] for name in names or STATE_SCHEMAS}
    for row in _folders(spark, base, version):
        name = row["table_name"]
        if name in paths and row["filled"] and (only is None or name not in only or row["bucket"] in only[name]):
            paths[name].append(_bucket_path(base, name, row["folder"], row["bucket"]))
    return {name: _read(spark, base, name, found) for name, found in paths.items()}


def _bucket_path(base: str, name: str, folder: str, bucket: int) -> str:
    return f"{base}/state/{name}/attempt={folder}/bucket={bucket}"


def _read(spark: SparkSession, base: str, name: str, paths: list[str], with_bucket: bool = False) -> DataFrame:
    schema = STATE_SCHEMAS[name] + (", bucket int" if with_bucket else "")
    if not paths:
        return empty(spark, schema)
    reader = spark.read.schema(schema)
    return (reader.option("basePath", f"{base}/state/{name}") if with_bucket else reader).parquet(*paths)


class StateWriter:
    """The next version of a state: tables are written bucket by bucket, then published together."""

    def __init__(self, spark: SparkSession, base: str, buckets: int | None = None):
        self.spark, self.base = spark, base
        before, known = _newest(spark, base)
        if buckets and known and buckets != known:
            raise ValueError(f"the state has {known} buckets")
        self.version, self.buckets = before + 1, known or buckets or BUCKETS
        self.folder, self.now = attempt()
        self.rows: list[tuple] = []

    def write(self, name: str, frame: DataFrame, touched: list[int]) -> None:
        """Replace the touched buckets of a table by the rows of ``frame``, all of which lie in them."""
        key = BUCKET_KEYS.get(name)
        columns = [c.strip().split(" ")[0] for c in STATE_SCHEMAS[name].split(", ")]
        rows = frame.select(*columns, bucket_of(key, self.buckets).alias("bucket") if key else "bucket")
        path = f"{self.base}/state/{name}/attempt={self.folder}"
        # Rebalancing makes a few files of a bucket: AQE splits large ones and joins small ones.
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
        held = {int(f.rpartition("bucket=")[2]) for f in list_folders(self.spark, path)}
        if stray := held.difference(touched):
            raise ValueError(f"{name}: rows outside the touched buckets, in {sorted(stray)[:5]}")
        self.rows += [(name, bucket, bucket in held) for bucket in touched]

    def write_all(self, frames: dict[str, DataFrame], touched: dict[str, list[int]]) -> None:
        """Replace the touched buckets of several tables; their jobs run side by side."""
        with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
            for done in [pool.submit(self.write, name, frame, touched[name]) for name, frame in frames.items() if touched[name]]:
                done.result()

    def _renew_counts(self) -> None:
        """Count the job buckets that were written anew; job and bridges of a bucket lie in the same one."""
        facts = ("jobs", "job_skills", "job_capabilities", "job_roles")
        touched = sorted({bucket for name, bucket, _ in self.rows if name in facts})
        if not touched:
            return
        folders = {(r["table_name"], r["bucket"]): (r["folder"], r["filled"]) for r in _folders(self.spark, self.base)}
        folders |= {(name, bucket): (self.folder, filled) for name, bucket, filled in self.rows}
        frames = []
        for name in facts:
            held = [(b, *folders.get((name, b), (None, False))) for b in touched]
            paths = [_bucket_path(self.base, name, folder, b) for b, folder, filled in held if filled]
            frames.append(_read(self.spark, self.base, name, paths, with_bucket=True))
        self.write("job_counts", job_counts(*frames, by=["bucket"]), touched)

    def publish(self, stream: str = "", batch_id: int = -1) -> int:
        """Make the written buckets, and the counts of their facts, the next version.

        If another writer has published that version first, its state holds and this call fails; read the state again.
        """
        self._renew_counts()
        rows = self.rows or [("", -1, False)]
        append_manifest(
            self.spark, f"{self.base}/state/_manifest",
            [(self.version, n, b, self.folder, k, self.buckets, stream, batch_id, self.now) for n, b, k in rows], _STATE_MANIFEST,
        )
        if versions(self.spark, self.base).filter(F.col("folder") == self.folder).isEmpty():
            raise RuntimeError(f"another writer has published state {self.version}")
        return self.version


def write_state(
    spark: SparkSession, base: str, state: dict[str, DataFrame], stream: str = "", batch_id: int = -1, buckets: int | None = None
) -> int:
    """Replace whole tables of the state as its next version; tables that are not given stay."""
    writer = StateWriter(spark, base, buckets)
    frames = {name: state[name] for name in BUCKET_KEYS if name in state}
    writer.write_all(frames, dict.fromkeys(frames, list(range(writer.buckets))))
    return writer.publish(stream, batch_id)


def touched_buckets(keys: dict[str, DataFrame], buckets: int) -> dict[str, list[int]]:
    """Per table the buckets of the keys in a frame of one column; at most one row for each bucket is collected."""
    frames = [df.select(F.lit(name).alias("t"), bucket_of(df.columns[0], buckets).alias("b")) for name, df in keys.items()]
    found = reduce(DataFrame.union, frames).distinct().collect()
    return {name: sorted(r["b"] for r in found if r["t"] == name) for name in keys}


def vacuum_state(spark: SparkSession, base: str, keep: int = 1, older_than: dt.timedelta = dt.timedelta(days=1)) -> int:
    """Delete what none of the newest ``keep`` versions refers to, and attempts that were never published.

    Only attempts written more than ``older_than`` ago go, so that of a running writer stays. Returns the number
    of folders deleted. Older versions can't be read afterwards.
    """
    newest = state_version(spark, base)
    wanted = {(r["table_name"], r["bucket"], r["folder"]) for v in range(max(newest - keep + 1, 1), newest + 1) for r in _folders(spark, base, v)}
    horizon = dt.datetime.now(dt.timezone.utc) - older_than
    gone = 0
    for name in STATE_SCHEMAS:
        for attempt in list_folders(spark, f"{base}/state/{name}", horizon):
            folder = attempt.rpartition("attempt=")[2]
            for path in list_folders(spark, attempt, horizon):
                if (name, int(path.rpartition("bucket=")[2]), folder) not in wanted:
                    delete_path(spark, path)
                    gone += 1
            if not any(t == name and f == folder for t, _, f in wanted):
                delete_path(spark, attempt)
    return gone


# --- snapshots -------------------------------------------------------------


def replace_date(df: DataFrame, path: str, day: str | dt.date) -> None:
    """Rows of one date replaced as a whole; an empty frame clears the date."""
    df.drop("metric_date").write.mode("overwrite").parquet(f"{path}/metric_date={day}")


def replace_dates(df: DataFrame, path: str, days: list[str | dt.date]) -> None:
    """Rows of several dates, a folder for each; a date without rows gets none.

    Dynamic partition overwrite writes all dates in one job and touches no other date.
    """
    dates = [str(d) for d in days]
    rows = df.filter(F.col("metric_date").cast("string").isin(dates))
    rows.hint("rebalance", "metric_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric_date").parquet(path)


def publish_snapshots(spark: SparkSession, base: str, frames: dict[str, DataFrame], days: list[str | dt.date]) -> int:
    """Write all frames of the dates into a new folder each, then make them visible together.

    Each table replaces each of the dates as a whole: a date for which it has no rows is published as empty, and rows
    of other dates are left out. If any frame fails, the manifest keeps pointing at the previous version.
    """
    dates = sorted({d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in days})
    manifest = read_manifest(spark, f"{base}/_manifest", _SNAPSHOT_MANIFEST)
    version = (manifest.agg(F.max("version")).first()[0] or 0) + 1
    folder, now = attempt()
    rows = []
    for name, frame in frames.items():
        columns = [c.strip().split(" ")[0] for c in METRIC_SCHEMAS[name].split(",")]
        path = f"{base}/{name}/attempt={folder}"
        replace_dates(frame.select(*columns), path, dates)
        held = {f.rpartition("metric_date=")[2] for f in list_folders(spark, path)}
        rows += [(name, date, version, folder, str(date) in held, now) for date in dates]
    append_manifest(spark, f"{base}/_manifest", rows, _SNAPSHOT_MANIFEST)
    return version


def publish_snapshot(spark: SparkSession, base: str, frames: dict[str, DataFrame], day: str | dt.date) -> int:
    """``publish_snapshots`` of one date."""
    return publish_snapshots(spark, base, frames, [day])


def read_metrics(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Published rows: for every date the folder the manifest names, and no other."""
    manifest = read_manifest(spark, f"{base}/_manifest", _SNAPSHOT_MANIFEST).filter(F.col("table_name") == name)
    schema = METRIC_SCHEMAS[name]
    # One row for each date.
    dates = _published(manifest, "metric_date").filter("filled IS NULL OR filled").select("metric_date", "folder").collect()
    if not dates:
        return empty(spark, schema)
    paths = [f"{base}/{name}/attempt={r['folder']}/metric_date={r['metric_date']}" for r in dates]
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    return spark.read.schema(schema).option("basePath", f"{base}/{name}").parquet(*paths).select(*columns)


def vacuum_snapshots(spark: SparkSession, base: str, older_than: dt.timedelta = dt.timedelta(days=1)) -> int:
    """Delete folders of dates that a later version has replaced, and attempts that were never published.

    Only attempts written more than ``older_than`` ago go. Returns the number of folders deleted.
    """
    manifest = _published(read_manifest(spark, f"{base}/_manifest", _SNAPSHOT_MANIFEST), "table_name", "metric_date")
    wanted = {(r["table_name"], r["folder"], str(r["metric_date"])) for r in manifest.filter("filled IS NULL OR filled").collect()}
    horizon = dt.datetime.now(dt.timezone.utc) - older_than
    gone = 0
    for name in METRIC_SCHEMAS:
        for attempt in list_folders(spark, f"{base}/{name}", horizon):
            folder = attempt.rpartition("attempt=")[2]
            for path in list_folders(spark, attempt, horizon):
                if (name, folder, path.rpartition("metric_date=")[2]) not in wanted:
                    delete_path(spark, path)
                    gone += 1
            if not any(n == name and f == folder for n, f, _ in wanted):
                delete_path(spark, attempt)
    return gone
