"""Finding export files by format, labelling them, and numbering their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.ordered import row_numbers
from ..operators.setops import union_all
from ..operators.skew import attach_per_key
from . import bibtex, csv_lines, records, tagged

# File name patterns per format.
FORMATS = {
    "json": "*.jsonl*", "ris": "*.ris*", "csv": "*.csv*", "bibtex": "*.bib*", "text": "*.txt*",
}


def path_label(path: Column, patterns: list[tuple[str, str]]) -> Column:
    """Label of the first pattern the path matches; '' if none does."""
    out = None
    for pattern, label in patterns:
        out = F.when(path.rlike(pattern), label) if out is None else out.when(path.rlike(pattern), label)
    return out.otherwise("")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every supported file below ``root`` with its format and labels; contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select(F.col("path").alias("source_file"), "length"))
    low = F.lower("source_file")
    fmt = path_label(low, [(p[1:].replace(".", r"\.").replace("*", "") + r"(\.gz)?$", k) for k, p in FORMATS.items()])
    return files.select("*", fmt.alias("format"), path_label(F.col("source_file"), fv.SOURCE_PATH_PATTERNS).alias("path_database"),
                        path_label(F.col("source_file"), fv.ROUTE_PATH_PATTERNS).alias("path_route")).where("format <> ''")


def label_records(recs: DataFrame, searches: DataFrame | None = None) -> DataFrame:
    """Fill database and route from the path where the record has none, and look up the search id."""
    f = F.col("source_file")
    out = recs.withColumns({
        "source_database": F.when(F.col("source_database") == "", path_label(f, fv.SOURCE_PATH_PATTERNS)).otherwise(F.col("source_database")),
        "route": F.when(F.col("route") == "", path_label(f, fv.ROUTE_PATH_PATTERNS)).otherwise(F.col("route"))})
    if searches is None:
        return out.withColumn("search_id", F.lit(""))
    s = searches.select(F.col("database").alias("source_database"), "route", F.col("id").alias("_sid"))
    return out.join(s, ["source_database", "route"], "left").withColumn("search_id", F.coalesce("_sid", F.lit(""))).drop("_sid")


def sniff_text(first_line: Column) -> Column:
    """Which text layout a file has, by a line that only its header can hold."""
    return (F.when(first_line.startswith("PT\tAU") | F.contains(first_line, F.lit("\tUT\t")), "tsv")
            .when(first_line.startswith("FN "), "tagged").otherwise("unrecognised"))


def ingest(spark: SparkSession, root: str, searches: DataFrame | None = None) -> DataFrame:
    """Every supported file below ``root`` as labelled ingest records.

    Each format is one distributed read over all of its files. Formats without a file are skipped.
    """
    files = list_files(spark, root).select("source_file", "format")
    found: dict[str, list[str]] = {}
    # File names only: one row per file, not per record.
    for r in files.orderBy("source_file").toLocalIterator():
        found.setdefault(r.format, []).append(r.source_file)
    parts = []
    if "json" in found:
        parts.append(records.json_records(records.read_json(spark, found["json"], records.JSON_SCHEMA)))
    if "ris" in found:
        parts.append(tagged.read_ris(spark, found["ris"]))
    if "csv" in found:
        parts.append(csv_lines.read_csv_records(spark, found["csv"]))
    if "bibtex" in found:
        parts.append(bibtex.bibtex_records(bibtex.read_bibtex_entries(spark, found["bibtex"])))
    if "text" in found:
        lines = spark.read.text(found["text"]).select(sniff_text(F.regexp_replace("value", "^\ufeff", "")).alias("k"), *records.provenance())
        kinds = lines.where("k <> 'unrecognised'").groupBy("source_file").agg(F.max("k").alias("k"))
        layout: dict[str, list[str]] = {}
        for r in kinds.orderBy("source_file").toLocalIterator():
            layout.setdefault(r.k, []).append(r.source_file)
        if "tsv" in layout:
            parts.append(tagged.tsv_records(tagged.read_tsv(spark, layout["tsv"])).drop("lenient"))
        if "tagged" in layout:
            parts.append(tagged.tagged_records(tagged.read_tagged_chunks(spark, layout["tagged"])).drop("stray_lines"))
    if not parts:
        raise ValueError(f"no supported file below {root}")
    return label_records(union_all(parts), searches)


def number_rows(recs: DataFrame) -> DataFrame:
    """``source_row`` in file order and a dense input index ``idx`` over all files by name.

    A file is numbered block by block, and files get their offset from their counts, so neither a
    large file nor the whole input is sorted in one task.
    """
    per_file = row_numbers(recs, ["source_seq"], F.col("source_block"), ["source_file"], "source_row")
    counts = per_file.groupBy("source_file").agg(F.count(F.lit(1)).alias("_n"))
    # One row per file.
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("source_file").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
    out = attach_per_key(per_file, offsets, ["source_file"], "_n")
    return out.withColumn("idx", F.col("_before") + F.col("source_row") - 1).drop("_n", "_before", "source_block", "source_seq")
