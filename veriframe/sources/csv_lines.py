"""CSV exports of any number and size: lines are read by many tasks, records are put together where quotes run over line ends.

A line belongs to the record before it if an odd number of quotes stands before it in its file. Each split of a file knows its own parity; the
parities of the splits before it, one number each, say how it begins. Only records of several lines are shuffled. Headers are data: every
file's header gives the places of the known fields, so files with different headers go through one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import cut_lineage
from .records import as_records, provenance, split_list

#: A field and the comma before it. A quoted field may hold commas, line ends and doubled quotes.
FIELD = r',("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'


def split_fields(record: Column) -> Column:
    """The fields of a CSV record, without their quotes."""
    def plain(f: Column) -> Column:
        inner = F.regexp_extract(f, r'(?s)^"(.*)"[^"]*$', 1)
        return F.when(f.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD), F.lit(1)), plain)


def csv_rows(lines: DataFrame) -> DataFrame:
    """``source_file, source_block, source_seq, record`` from the lines of files (``source_file, source_block, source_seq, value``).

    A record is numbered in the split it starts in. Line ends inside a record become newlines; blank records are left out. A quote that is
    never closed holds the rest of its file."""
    split = ["source_file", "source_block"]
    here, value = W.partitionBy(*split).orderBy("source_seq"), F.regexp_replace("value", "\r$", "")
    n = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    quotes = lines.select(*split, "source_seq", value.alias("value"), (n % 2).alias("_odd"))
    before = W.partitionBy("source_file").orderBy("source_block").rowsBetween(W.unboundedPreceding, -1)  # one row a split
    carry = quotes.groupBy(*split).agg(F.sum("_odd").alias("_odds")).select(*split, F.coalesce(F.sum("_odds").over(before), F.lit(0)).alias("_carry"))
    inside = (F.col("_carry") + F.coalesce(F.sum("_odd").over(here.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) % 2 == 1
    marked = quotes.join(carry, split).withColumn("_start", ~inside)
    rec = F.sum(F.col("_start").cast("bigint")).over(here.rowsBetween(W.unboundedPreceding, 0))
    told = cut_lineage(marked.withColumn("_rec", rec).select(*split, "source_seq", "value", "_start", "_rec", (F.col("_start") & (F.col("_odd") == 1)).alias("_open")))

    one = told.where("_start AND NOT _open").select(*split, F.col("_rec").alias("source_seq"), F.col("value").alias("record"))
    # Lines before the first start of a split continue the last record that started in an earlier one.
    last = told.groupBy(*split).agg(F.max("_rec").alias("_n"))
    owner = F.last(F.when(F.col("_n") > 0, F.struct(F.col("source_block").alias("b"), F.col("_n").alias("r"))), ignorenulls=True).over(before)
    heads = told.where("_rec = 0").join(last.select(*split, owner.alias("_owner")), split)
    line = F.struct("source_block", "source_seq", "value").alias("_line")
    pieces = (told.where("_rec > 0 AND (_open OR NOT _start)").select("source_file", F.col("source_block").alias("b"), F.col("_rec").alias("r"), line)
              .unionByName(heads.select("source_file", F.col("_owner.b").alias("b"), F.col("_owner.r").alias("r"), line)))
    many = (pieces.groupBy("source_file", "b", "r").agg(F.array_sort(F.collect_list("_line")).alias("_ls"))
            .select("source_file", F.col("b").alias("source_block"), F.col("r").alias("source_seq"), F.array_join(F.transform("_ls", lambda x: x["value"]), "\n").alias("record")))
    return one.unionByName(many).where(F.trim("record") != "")


def read_csv_records(spark: SparkSession, paths: str | list[str], database: str = "") -> DataFrame:
    """All records of headered CSV files as ingest records; a field is found by the synonyms of its header in each file."""
    lines = spark.read.option("lineSep", "\n").text(paths).select("value", *provenance())
    rows = csv_rows(lines)
    at = F.struct("source_block", "source_seq")
    first = rows.groupBy("source_file").agg(F.min(F.struct(at.alias("at"), "record")).alias("h")).select("source_file", "h.at", F.regexp_replace("h.record", "^﻿", "").alias("_header"))
    names = F.transform(split_fields(F.col("_header")), lambda x: F.lower(F.trim(x)))
    place = lambda f: F.coalesce(*[F.when(F.array_contains("_names", s), F.array_position("_names", s)) for s in fv.CSV_HEADER_SYNONYMS[f]])
    heads = first.select("source_file", "at", names.alias("_names")).select("source_file", F.col("at").alias("_at"), *[place(f).cast("int").alias(f"_{f}") for f in fv.CSV_HEADER_SYNONYMS])
    body = rows.join(heads, "source_file").where(at != F.col("_at")).withColumn("_fields", split_fields(F.col("record")))
    fields = {f: F.get("_fields", F.col(f"_{f}") - 1) for f in fv.CSV_HEADER_SYNONYMS if f != "eid"}
    fields["authors"] = split_list(fields["authors"], ";")
    fields["source_database"] = F.lit(database) if database else F.when(F.col("_eid").isNotNull(), "Scopus").otherwise("")
    return as_records(body, fields)
