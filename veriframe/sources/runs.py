"""Batch and run files written by raters: supersession, validity, skip reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import first_verdict
from ..operators.ordered import latest, superseded
from ..operators.validate import assert_empty, duplicate_keys

# Fixed value: names of batch files; three digits or more.
BATCH_NAME = r"^batch_(\d{3,})\.json$"


def read_batches(spark: SparkSession, folder: str, schema: T.StructType | str, name: str = BATCH_NAME) -> DataFrame:
    """Rows of every batch file (a JSON array each) with the file's name."""
    df = spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("file", F.col("_metadata.file_name"))
    return df.where(F.col("file").rlike(name))


def latest_batches(rows: DataFrame, key: str, file: str = "file") -> tuple[DataFrame, DataFrame]:
    """The row of the last file per id, and the rows it superseded. Files come in the order of their number, then of their name."""
    numbered = rows.withColumn("_no", F.coalesce(F.regexp_extract(file, r"(\d+)", 1).try_cast("bigint"), F.lit(-1)))
    old = superseded(numbered, [key], ["_no", file])
    return latest(numbered, [key], ["_no", file]).drop("_no"), old.drop("_no").withColumn("superseded_by", F.struct(F.col("superseded_by")[file].alias(file)))


def unique_batches(rows: DataFrame, key: str) -> DataFrame:
    """The rows, or an error if an id occurs twice."""
    assert_empty(duplicate_keys(rows, [key], "batches"), "id in more than one batch row")
    return rows


def prefer_final(rows: DataFrame, batch: str, file: str = "file") -> DataFrame:
    """Of a final and a checkpoint file of the same batch, keep the final one's rows."""
    is_final = ~F.col(file).startswith("checkpoint_")
    has_final = rows.groupBy(batch).agg(F.bool_or(is_final).alias("_f"))
    return rows.join(has_final, batch).where(is_final | ~F.col("_f")).drop("_f")


def split_valid(rows: DataFrame, parsed: str, errors: str) -> DataFrame:
    """Add ``valid``: parsed is present and no validation error is recorded."""
    none = F.col(errors).isNull() | (F.size(errors) == 0)
    return rows.withColumn("valid", F.col(parsed).isNotNull() & none)


def skip_reason(unreadable: Column, marked_invalid: Column, parsed: Column, schema_ok: Column, has_report: Column) -> Column:
    """Why a run is left out, first reason that applies; '' if it is used."""
    return first_verdict([
        (unreadable, "unreadable_json"), (marked_invalid, "run_marked_invalid"), (~parsed, "missing_parsed_record"),
        (~schema_ok, "schema_invalid"), (~has_report, "missing_report_row")], "")


def mark_duplicates(runs: DataFrame, key: str, order: str) -> DataFrame:
    """Of the usable runs of one id only the first counts."""
    first = runs.where("skip_reason = ''").groupBy(key).agg(F.min(order).alias("_first"))
    j = runs.join(first, key, "left")
    late = (F.col("skip_reason") == "") & (F.col(order) != F.col("_first"))
    return j.withColumn("skip_reason", F.when(late, "duplicate_reference_id").otherwise(F.col("skip_reason"))).drop("_first")
