"""Datasets of scraped postings."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.operators.firsts import dedup_postings
from jobtide.session import existing_path
from jobtide.sources.documents import stage

FIELDS = {
    "jobId": "job_id", "title": "title", "company": "company", "companyUrl": "company_url",
    "location": "location", "postedAt": "posted_at", "url": "url", "description": "description",
    "seniorityLevel": "seniority_level", "employmentType": "employment_type",
    "jobFunction": "job_function", "industries": "industries", "applicants": "applicants",
}
SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])
FAILURES = "dataset string, error string, rows long"
POSITION = "struct<file_path:string,file_block_start:bigint,row:bigint>"
CORRUPT = "_corrupt"


@dataclass
class Datasets:
    """Postings of several datasets, what could not be read of them, and how many postings came twice."""

    #: The fields, dataset, dataset_no and position, which is the reading order inside a dataset.
    postings: DataFrame
    #: dataset, error and rows: a missing dataset (no rows), or its rows (with ``multi_line`` files) that are no posting.
    failures: DataFrame

    def unique(self) -> DataFrame:
        """The first posting of every id over all datasets; postings without an id all stay."""
        return dedup_postings(self.postings)

    def skipped(self) -> DataFrame:
        """One row: ``duplicates``, the postings that ``unique`` leaves out."""
        has_id = F.coalesce(F.col("job_id") != "", F.lit(False))
        copies = self.postings.filter(has_id).groupBy("job_id").agg((F.count(F.lit(1)) - 1).alias("n"))
        return copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))


def read_datasets(spark: SparkSession, paths: list[str], multi_line: bool = False) -> Datasets:
    """Several JSON datasets, files or folders, in one scan over all of them.

    A dataset is JSON lines, or with ``multi_line`` JSON arrays of postings, a file each. Broken lines (or files) are set
    aside in the same job and reported, the good ones are kept; a path that doesn't exist is left out and reported.
    What was read is staged, so no file is opened twice.
    """
    asked = list(dict.fromkeys(p.strip() for p in paths if p.strip()))
    # Local files are written with one slash or three.
    there = {p: re.sub("^file:/+", "file:/", found) for p in asked if (found := existing_path(spark, p))}
    missing = spark.createDataFrame([(p, "PATH_NOT_FOUND", 0) for p in asked if p not in there], FAILURES)
    if not there:
        empty = ", ".join(f"{n} string" for n in FIELDS.values())
        return Datasets(spark.createDataFrame([], f"{empty}, dataset string, dataset_no int, position {POSITION}"), missing)
    # The datasets are few: the longest path that a file lies below is its own.
    number, path = F.lit(None).cast("int"), F.lit(None).cast("string")
    file = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
    for name in sorted(there, key=lambda p: len(there[p])):
        below = (file == there[name]) | file.startswith(there[name] + "/")
        number = F.when(below, asked.index(name)).otherwise(number)
        path = F.when(below, name).otherwise(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).cast(POSITION)
    if multi_line:
        reader = spark.read.schema(T.StructType([*SCHEMA, T.StructField(CORRUPT, T.StringType())])).option("columnNameOfCorruptRecord", CORRUPT)
        items = reader.json(list(there), multiLine=True, encoding="UTF-8")
        fields, corrupt = [F.col(k) for k in FIELDS], F.col(CORRUPT).isNotNull()
    else:
        # Parsed as the only element of an array, so that text after the posting is an error.
        items = spark.read.text(list(there)).filter(F.trim("value") != "")
        parsed = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), T.ArrayType(SCHEMA))
        items = items.withColumn("_items", parsed)
        fields = [F.get("_items", F.lit(0))[k] for k in FIELDS]
        corrupt = F.coalesce((F.size("_items") != 1) | F.get("_items", F.lit(0)).isNull(), F.lit(True))
    named = [c.alias(v) for c, v in zip(fields, FIELDS.values())]
    rows = stage(items.select(*named, corrupt.alias(CORRUPT), path.alias("dataset"), number.alias("dataset_no"), place.alias("position")))
    broken = rows.filter(CORRUPT).groupBy("dataset").agg(F.lit("broken JSON").alias("error"), F.count(F.lit(1)).alias("rows"))
    return Datasets(rows.filter(f"NOT {CORRUPT}").drop(CORRUPT), missing.unionByName(broken))


def latest_batch(postings: DataFrame, runs: DataFrame) -> DataFrame:
    """Postings of the dataset of the last run that succeeded."""
    newest = (
        runs.filter("status = 'succeeded'")
        .agg(F.max_by("dataset_id", F.struct("completed_at", "id")).alias("dataset_id"))
        .filter("dataset_id IS NOT NULL")
    )
    # One row by construction.
    return postings.join(F.broadcast(newest), "dataset_id", "left_semi")
