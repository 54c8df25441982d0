"""Results: redacted JSON, audit lines, counts, and checks of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.functions.text import redact_row

VERSION = "predictions.v1"
STATUSES = ["success", "blocked", "failed"]


def status_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def manifest(records: DataFrame, source: str, split: str) -> DataFrame:
    """One row: version, origin and counters. The records themselves stay in files of their own, written by all tasks."""
    return status_counts(records).select(F.lit(VERSION).alias("schema_version"), F.lit(source).alias("input_source"), F.lit(split).alias("split"), "*")


def write_predictions(records: DataFrame, source: str, split: str, path: str) -> None:
    """The manifest and the redacted records, a record per JSON line with its ``record_pos``, in order within a file."""
    manifest(records, source, split).write.mode("overwrite").json(f"{path}/manifest")
    redact_row(records).withColumn("split", F.lit(split)).repartitionByRange("record_pos").sortWithinPartitions("record_pos").write.mode("overwrite").json(f"{path}/records")


def write_audit(records: DataFrame, path: str) -> None:
    """One redacted record a line, nulls kept; written once."""
    clean = redact_row(records)
    clean.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_standard(records: DataFrame, path: str) -> None:
    """Records without model, error and audit fields."""
    redact_row(records).select(*[c for c in records.columns if c not in ("model", "error", "created_at")]).write.mode("overwrite").json(path)


def record_problem() -> Column:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(blank("file_name"), "file_name is missing").when(blank("report_id"), "report_id is missing")
        .when(~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)), "status is unknown")
        .when((F.col("status") == "success") & F.col("prediction").isNull(), "success without prediction")
        .when((F.col("status") != "success") & blank("error"), "no error given")
    )


def problems(records: DataFrame) -> DataFrame:
    """Messages with the record's position; no rows if all is well."""
    return records.withColumn("problem", record_problem()).filter("problem is not null").select("record_pos", "problem")


def check_outputs(counts: dict[str, int], expected: int) -> None:
    wrong = {k: n for k, n in counts.items() if n != expected}
    if wrong:
        raise RuntimeError(f"expected {expected} of each output, found {wrong}")
