"""Job-analysis documents: scan, classify and parse in one row-wise pass."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide import fixed
from jobtide.functions import clean, names
from jobtide.functions import variants as V
from jobtide.functions.text import blank_to_null, first_defined, let, nullify_literal_null
from jobtide.session import delete_path, glob_paths, shared_dir, shuffles_freed


#: Shares of a folder, as Spark packs files for a task, that a task takes.
SHARES = 16


def read_analysis_dir(spark: SparkSession, path: str) -> DataFrame:
    """One row per *.json file: ``file`` (its path), ``raw``.

    Spark packs some thirty small files into a task, and the parse takes longer to set up than to read them. So a task
    takes the share of many.
    """
    files = (
        spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    )
    return _in_shares(files)


def _in_shares(files: DataFrame) -> DataFrame:
    """Rows of a folder of many small files, each task taking the share of many; enough tasks stay for the cores."""
    packed = files.rdd.getNumPartitions()
    return files.coalesce(max(1, min(packed, max(2 * files.sparkSession.sparkContext.defaultParallelism, packed // SHARES))))


#: Files that a task opens at least, and bytes of a batch of their contents.
FILES_PER_TASK, CONTENT_BYTES = 2_000, 8 << 20
_LISTED = "path string, modified long, length long, folder boolean"


def _lister():
    """A function for tasks; as one of its own it takes along what it names, and needs no package there."""

    def entries(batches):
        """What lies right below each folder of a column of paths, as Spark's scans see it: files, and folders to look into."""
        import os

        import pyarrow as pa
        from pyarrow import fs

        names = ["path", "modified", "length", "folder"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_()]

        def below(root: str):
            if root.startswith("file:") or "://" not in root:
                # Read entry by entry: a folder may hold millions.
                with os.scandir("/" + root.removeprefix("file:").lstrip("/")) as found:
                    for entry in found:
                        try:
                            held = entry.stat()
                        except FileNotFoundError:
                            # Gone since, or a link to nothing.
                            continue
                        yield entry.name, held.st_mtime_ns // 1_000_000, held.st_size, entry.is_dir()
                return
            files, folder = fs.FileSystem.from_uri(root)
            for info in files.get_file_info(fs.FileSelector(folder)):
                yield info.base_name, (info.mtime_ns or 0) // 1_000_000, info.size or 0, info.type == fs.FileType.Directory

        def wanted(name: str, folder: bool) -> bool:
            hidden = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
            return not hidden and (folder or name.endswith(".json"))

        rows = []
        for batch in batches:
            for root in batch.column(0).to_pylist():
                for name, modified, length, folder in below(root):
                    if wanted(name, folder):
                        rows.append((f"{root}/{name}", modified, 0 if folder else length, folder))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return entries


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """*.json files of a folder and of those below it: path, modified, length.

    Tasks list the folders, level by level, and store what they find: Spark's own listing holds an object for each file
    in the driver. A folder is listed by one task.
    """
    roots = glob_paths(spark, path)
    if not roots:
        # Spark's own error for a path that is not there.
        return spark.read.format("binaryFile").load(path).selectExpr("path", "0L AS modified", "length")
    single = [(p, modified, length) for p, modified, length, folder in roots if not folder and p.endswith(".json")]
    found = [spark.createDataFrame(single, "path string, modified long, length long")]
    folders = spark.createDataFrame([(p,) for p, _, _, folder in roots if folder], "path string")
    while not folders.isEmpty():
        level = stage(folders.mapInArrow(_lister(), _LISTED))
        found.append(level.filter("NOT folder").drop("folder"))
        folders = level.filter("folder").select("path")
    return reduce(DataFrame.unionByName, found)


def _opener():
    """A function for tasks, as ``_lister``."""

    def contents(batches):
        """path, modified and length of files, and their contents."""
        import pyarrow as pa
        from pyarrow import fs

        def packed(rows: list):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["path", "modified", "length", "content"])

        rows, size, systems = [], 0, {}
        for batch in batches:
            for path, modified, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path.startswith("file:") or "://" not in path:
                    with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as file:
                        content = file.read()
                else:
                    scheme, rest = path.split("://", 1)
                    authority, _, inner = rest.partition("/")
                    if (scheme, authority) not in systems:
                        systems[scheme, authority] = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
                    files, top = systems[scheme, authority]
                    with files.open_input_file(f"{top.rstrip('/')}/{inner}") as file:
                        content = file.read()
                rows.append((path, modified, length, content))
                size += len(content)
                if size >= CONTENT_BYTES or len(rows) == 10_000:
                    yield packed(rows)
                    rows, size = [], 0
        if rows:
            yield packed(rows)

    return contents


def changed_files(spark: SparkSession, path: str, ledger: DataFrame) -> DataFrame:
    """*.json files of a folder that the ledger does not know as they are: file, raw, modified, length, digest.

    The folder is listed once, not read: what the ledger (path, modified, length) knows with the same time and size is
    left out, and only the rest is opened. Neither the listing nor the contents pass the driver.
    """
    listed = listed_files(spark, path)
    unknown = stage(listed.join(ledger.select("path", "modified", "length"), ["path", "modified", "length"], "left_anti").select("path", "modified", "length"))
    tasks = max(1, min(unknown.count() // FILES_PER_TASK, SHARES * spark.sparkContext.defaultParallelism))
    opened = unknown.repartition(tasks, "path").mapInArrow(_opener(), "path string, modified long, length long, content binary")
    return opened.select(
        F.col("path").alias("file"), F.col("content").cast("string").alias("raw"), "modified", "length", F.sha2("content", 256).alias("digest")
    )


def _document_schema() -> str:
    """Sections of a document: text fields as strings, polymorphic ones as VARIANT.

    Reading all sections with one schema costs one parse of the text and keeps
    the generated code small. Text fields given as numbers arrive as text.
    """

    def struct(kind: str, names_: list[str]) -> str:
        return "struct<" + ",".join(f"{n}:{kind}" for n in names_) + ">"

    texts = [
        "title", "company", "location", "city", "state", "country", "employment_type", "job_type",
        "employmentType", "job_function", "jobFunction", "industry", "industries", "posted_at",
        "postedAt", "job_url", "url",
    ]
    years = struct("variant", ["minimum_years", "maximum_years", "preferred_years"])
    job = struct("string", texts)[:-1] + ",applicants:variant>"
    role = (
        "struct<advertised_role:string,advertised_role_category:string,actual_role_category:string,"
        f"seniority_inferred:string,experience_required:{years}>"
    )
    return ",".join(
        [
            f"job_metadata {job}",
            f"role_analysis {role}",
            "skills map<string,variant>",
            f"skill_priority {struct('variant', fixed.PRIORITIES)}",
            "capabilities variant",
            f"production_requirements {struct('variant', fixed.PRODUCTION_FLAGS)}",
            f"engineering_requirements {struct('variant', fixed.ENGINEERING_FLAGS)}",
            "domain_analysis struct<domain_expertise_required:variant>",
            "ai_lifecycle_coverage variant",
        ]
    )


def classify_documents(files: DataFrame) -> DataFrame:
    """Add ``sections, job_id, status, error``; a bad file never affects another."""
    # Repeated object keys keep the last value, see session.SETTINGS.
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # Parsed as the only element of an array: text after the document is an error.
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col("raw"), F.lit("]")))
    # Of a text that begins with anything but the end of the array the first element is there, and need not be taken out.
    alone = F.col("wrapped").isNotNull() & F.col("raw").rlike("^[ \\t\\n\\r]*[^] \\t\\n\\r]") & F.try_variant_get("wrapped", "$[1]", "variant").isNull()
    id_value = F.try_variant_get("wrapped", "$[0].job_metadata.job_id", "variant")
    usable = F.col("alone") & F.coalesce(V.truthy(F.col("id_value"), F.col("id_kind")), F.lit(False))
    status = F.when(~F.col("alone"), "skipped_invalid_json").when(~usable, "skipped_invalid_structure").otherwise("ok")
    error = F.when(F.col("status") == "skipped_invalid_json", "Invalid JSON").when(
        F.col("status") == "skipped_invalid_structure", fixed.MISSING_JOB_ID
    )
    return (
        files.withColumn("wrapped", wrapped)
        .withColumns({"alone": alone, "id_value": id_value, "sections": F.from_json("raw", _document_schema())})
        .withColumn("id_kind", V.kind(F.col("id_value")))
        .withColumns({"job_id": F.when(usable, V.text(F.col("id_value"), F.col("id_kind"))), "status": status})
        .withColumn("error", error)
        .select("file", "raw", "sections", "job_id", "status", "error")
    )


def _field(section: str, key: str) -> Column:
    return F.col("sections")[section][key]


def _first(section: str, *keys: str) -> Column:
    return first_defined(*[_field(section, k) for k in keys])


def _skill_entries(skills: Column) -> Column:
    """(category, items) pairs of the skills map in document order.

    ``map<string,variant>`` keeps the order of the document; a repeated
    category keeps its first place and its last value.
    """

    def latest(entries: Column, keys: Column) -> Column:
        once = F.transform(entries, lambda e: F.struct(e["key"].alias("category"), e["value"].alias("items")))
        first = F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)

        def last_value(key: Column) -> Column:
            return F.get(entries, (F.size(keys) - F.array_position(F.reverse(keys), key)).cast("int"))["value"]

        repeated = F.transform(first, lambda e: F.struct(e["key"].alias("category"), last_value(e["key"]).alias("items")))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), once).otherwise(repeated)

    return let(F.map_entries(skills), lambda entries: let(F.transform(entries, lambda e: e["key"]), lambda keys: latest(entries, keys)))


def _priorities() -> Column:
    """(key, bucket) pairs, strongest bucket first."""

    def pairs(bucket: str) -> Column:
        return F.transform(
            V.texts(_field("skill_priority", bucket)),
            lambda s: F.struct(names.skill_key(s).alias("key"), F.lit(bucket).alias("bucket")),
        )

    lists = [pairs(bucket) for bucket in fixed.PRIORITIES]
    return F.concat(*lists)


def _flat_skills(entries: Column) -> Column:
    return F.flatten(
        F.transform(
            entries,
            lambda e: F.transform(
                V.texts(e["items"]),
                lambda s: F.struct(e["category"].alias("category"), names.normalize_skill(s).alias("skill")),
            ),
        )
    )


def _first_by_key(skills: Column, priorities: Column) -> Column:
    """Skills of one document: first category wins, priority attached.

    Works inside the row: all of a document's skills are already together, so
    the first-wins rule needs no shuffle.
    """

    def first(keys: Column) -> Column:
        return F.filter(skills, lambda s, i: F.array_position(keys, s["skill"]["normalized_name"]) == i + 1)

    def finish(s: Column, ranked: Column) -> Column:
        place = F.array_position(ranked, s["skill"]["normalized_name"])
        return F.struct(
            s["skill"]["name"].alias("name"),
            s["skill"]["normalized_name"].alias("normalized_name"),
            s["category"].alias("category"),
            F.when(place > 0, F.get(priorities, (place - 1).cast("int"))["bucket"]).alias("priority"),
        )

    kept = let(F.transform(skills, lambda s: s["skill"]["normalized_name"]), first)
    ranks = F.transform(priorities, lambda p: p["key"])
    return F.coalesce(
        let(ranks, lambda ranked: F.transform(kept, lambda s: finish(s, ranked))),
        F.array().cast("array<struct<name:string,normalized_name:string,category:string,priority:string>>"),
    )


_YEARS = ("minimum_years", "maximum_years", "preferred_years")
#: The tri-state flags of a document's row of attributes, by section.
_FLAGS = [
    *[("production_requirements", k) for k in fixed.PRODUCTION_FLAGS],
    *[("engineering_requirements", k) for k in fixed.ENGINEERING_FLAGS],
    ("domain_analysis", "domain_expertise_required"),
]


def _years_value(key: str) -> Column:
    return _field("role_analysis", "experience_required")[key]


def _kinds() -> dict[str, Column]:
    """Kinds of the polymorphic fields, worked out once for a row."""
    kinds = {f"_kind_{k}": V.kind(_field(section, k)) for section, k in _FLAGS}
    kinds |= {f"_kind_{k}": V.kind(_years_value(k)) for k in _YEARS}
    return {**kinds, "_kind_applicants": V.kind(_field("job_metadata", "applicants"))}


def _job() -> Column:
    where = F.col("_where")
    return F.struct(
        F.coalesce(nullify_literal_null(_field("job_metadata", "title")), F.lit("Untitled")).alias("title"),
        nullify_literal_null(_field("job_metadata", "company")).alias("company"),
        where["location"].alias("location"),
        where["city"].alias("city"),
        where["state"].alias("state"),
        where["country"].alias("country"),
        _first("job_metadata", "employment_type", "job_type", "employmentType").alias("employment_type"),
        _first("job_metadata", "job_function", "jobFunction").alias("job_function"),
        _first("job_metadata", "industry", "industries").alias("industry"),
        clean.applicants_number(_field("job_metadata", "applicants"), F.col("_kind_applicants")).alias("applicants"),
        _first("job_metadata", "posted_at", "postedAt").alias("posted_at"),
        _first("job_metadata", "job_url", "url").alias("job_url"),
    )


def _role() -> Column:
    experience = clean.combine_experience(*[clean.years_of(F.col(f"_number_{k}"), F.col(f"_text_{k}")) for k in _YEARS])
    return let(experience, _role_with)


def _role_with(experience: Column) -> Column:
    return F.struct(
        names.role_name(F.col("_advertised")).alias("advertised_role"),
        names.role_name(F.col("_actual")).alias("actual_role"),
        names.seniority_name(F.col("_seniority")).alias("seniority"),
        experience["minimum_experience"].alias("minimum_experience"),
        experience["maximum_experience"].alias("maximum_experience"),
    )


def _attributes() -> Column:
    return F.struct(*[clean.coerce_tristate(_field(section, k), F.col(f"_kind_{k}")).alias(k) for section, k in _FLAGS])


def _lifecycle() -> Column:
    replaces = F.col("_replaces")
    flags = [F.when(replaces, clean.coerce_tristate(F.col(f"_cycle_{k}"), F.col(f"_cycle_kind_{k}"))).alias(k) for k in fixed.LIFECYCLE_FLAGS]
    return F.struct(replaces.alias("replaces"), *flags)


def _violations() -> Column:
    """Names of the columns whose value would not fit its table."""
    widths = fixed.WIDTHS
    job, role = F.col("job"), F.col("role")

    def too_long(value: Column, width: int) -> Column:
        return F.length(value) > width

    posted = job["posted_at"]
    applicants = job["applicants"]
    checks = {
        "external_job_id": too_long(F.col("job_id"), widths["external_job_id"]),
        **{k: too_long(job[k], widths[k]) for k in ("city", "state", "country", "employment_type")},
        "applicants": (applicants > 2147483647) | (applicants < -2147483648),
        "posted_at": posted.isNotNull() & posted.try_cast("timestamp_ntz").isNull(),
        "skill": F.exists("skills", lambda s: F.greatest(F.length(s["name"]), F.length(s["normalized_name"])) > widths["skill"]),
        "category": F.exists("skills", lambda s: F.length(s["category"]) > widths["category"]),
        "advertised_role": too_long(role["advertised_role"], widths["role"]),
        "actual_role": too_long(role["actual_role"], widths["role"]),
        "seniority": too_long(role["seniority"], widths["seniority"]),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))


def parse_documents(classified: DataFrame) -> DataFrame:
    """All sections of the documents as fixed structs and arrays, final status.

    One narrow pass without a filter. A filter on the status would be pushed
    below the projections and parse a text once per reference to it, so write
    the result to a staged table and filter that: the stored status is then a
    pushed filter, and every projection reads only its own columns.
    """
    fits = F.size("violations") == 0
    rejected = (F.col("status") == "ok") & ~fits
    reason = F.concat(F.lit("Value does not fit: "), F.array_join("violations", ", "))
    section, section_kind = F.col("sections.ai_lifecycle_coverage"), F.col("_section_kind")
    replaces = V.truthy(section, section_kind) & ~F.coalesce(section_kind.startswith("ARRAY"), F.lit(False))
    # What several fields name is a column of its own: it is worked out once, and by generated code.
    cycle = {k: V.get(section, k) for k in fixed.LIFECYCLE_FLAGS}
    years = {f"_text_{k}": clean.years_text(_years_value(k), F.col(f"_kind_{k}")) for k in _YEARS}
    years |= {f"_number_{k}": F.when(F.col(f"_kind_{k}").rlike(V.NUMBERS), F.try_variant_get(_years_value(k), "$", "double")) for k in _YEARS}
    return (
        classified.withColumns({
            "skill_entries": _skill_entries(F.col("sections.skills")),
            "priorities": _priorities(),
            **_kinds(),
            "_where": clean.parse_location(*[_field("job_metadata", k) for k in ("location", "city", "state", "country")]),
            "_advertised": _first("role_analysis", "advertised_role", "advertised_role_category"),
            "_actual": _first("role_analysis", "actual_role_category", "advertised_role_category"),
            "_seniority": blank_to_null(_field("role_analysis", "seniority_inferred")),
            "_section_kind": V.kind(section),
        })
        .withColumns({
            "flat_skills": _flat_skills(F.col("skill_entries")),
            "job": _job(),
            "attributes": _attributes(),
            **years,
            "_replaces": replaces,
            # Without a section there is nothing to take out.
            **{f"_cycle_{k}": F.when(section_kind.isNotNull(), value) for k, value in cycle.items()},
        })
        .withColumns({f"_cycle_kind_{k}": V.kind(F.col(f"_cycle_{k}")) for k in fixed.LIFECYCLE_FLAGS})
        .withColumns({"role": _role(), "skills": _first_by_key(F.col("flat_skills"), F.col("priorities")), "lifecycle": _lifecycle()})
        .withColumn("violations", _violations())
        .select(
            "file",
            "raw",
            "job_id",
            "job",
            "skills",
            V.texts(F.col("sections.capabilities")).alias("capabilities"),
            "role",
            "attributes",
            "lifecycle",
            F.when(rejected, "error").otherwise(F.col("status")).alias("status"),
            F.when(rejected, reason).otherwise(F.col("error")).alias("error"),
        )
    )


#: Frames staged for the step at hand, see ``scratch``.
_SCRATCH: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """What is staged within, unless it is kept, goes from the disk at the end."""
    held: list[DataFrame] = []
    token = _SCRATCH.set(held)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        discard(*held)


def stage(df: DataFrame, keep: bool = False) -> DataFrame:
    """A frame written once to the shared folder and read back, so that a lost executor costs no second run.

    What was shuffled for it goes from the disk with the write; the folder itself goes with ``discard`` or ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.staged_at = path
    if not keep and (held := _SCRATCH.get()) is not None:
        held.append(written)
    return written


def discard(*staged: DataFrame) -> None:
    """Delete the folders of staged frames that nothing reads any more."""
    for frame in staged:
        delete_path(frame.sparkSession, frame.staged_at)


def stage_documents(files: DataFrame) -> DataFrame:
    """Parsed documents, staged."""
    return stage(parse_documents(classify_documents(files)))


def accepted(staged: DataFrame) -> DataFrame:
    """Documents whose rows may enter the tables; a rejected one leaves none."""
    return staged.filter(F.col("status") == "ok")


def statuses(staged: DataFrame) -> DataFrame:
    """One row per file: ``file, status, error``."""
    return staged.select("file", "status", "error")


def ingest_summary(files: DataFrame) -> DataFrame:
    succeeded = F.count_if(F.col("status") == "ok")
    total = F.count(F.lit(1))
    return files.agg(
        total.alias("total"), succeeded.alias("succeeded"), (total - succeeded).alias("failed")
    )
