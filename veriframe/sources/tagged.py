"""RIS, tagged plain text and tab-delimited exports, parsed with native expressions.

Files are read in records, not whole: the reader splits on the record mark, so one large file is many
rows in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from .records import as_records, provenance, split_list

# A RIS tag is two capitals or digits, two spaces, a dash and a space, anywhere in the text.
RIS_TAG = r"([A-Z0-9]{2})  - "
RIS_START = "TY  - "


def read_ris_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``(source_file, chunk)``: the text after each record start, up to the next one. The first is the preamble."""
    return spark.read.option("lineSep", RIS_START).text(path).select(
        *provenance(), F.col("value").alias("chunk"))


def ris_pairs(chunk: Column) -> Column:
    """``array<struct<tag,value>>`` of a chunk that starts right after its record mark; ends at its end tag."""
    tags = F.concat(F.array(F.lit("TY")), F.regexp_extract_all(chunk, F.lit(RIS_TAG), F.lit(1)))
    vals = F.transform(F.split(chunk, "[A-Z0-9]{2}  - ", -1), lambda v: tx.squeeze(v))
    pairs = F.zip_with(tags, vals, lambda t, v: F.struct(t.alias("tag"), v.alias("value")))
    end = F.array_position(tags, "ER")
    return F.when(end > 0, F.slice(pairs, F.lit(1), (end - 1).cast("int"))).otherwise(pairs)


def parse_ris(chunks: DataFrame, chunk: str = "chunk") -> DataFrame:
    """One row per record: its pairs, whether the end tag was missing, and tags found after the end."""
    c = F.col(chunk)
    tags = F.regexp_extract_all(c, F.lit(RIS_TAG), F.lit(1))
    end = F.array_position(tags, "ER")
    return chunks.select(*[x for x in chunks.columns if x != chunk], ris_pairs(c).alias("pairs"), (end == 0).alias("lenient"),
                         F.when(end > 0, F.size(tags) - end).otherwise(0).alias("stray_tags"))


def tag_values(pairs: Column, tag: str) -> Column:
    return F.transform(F.filter(pairs, lambda p: p["tag"] == tag), lambda p: p["value"])


def first_tag(pairs: Column, tags: list[str]) -> Column:
    """Value of the first tag of the list that is present; '' if none is."""
    return F.coalesce(*[F.try_element_at(tag_values(pairs, t), F.lit(1)) for t in tags], F.lit(""))


def ris_records(parsed: DataFrame) -> DataFrame:
    p = F.col("pairs")
    ids = [tx.strict_numeric_id(first_tag(p, [t])) for t in fv.RIS_ID_TAGS]
    texts = [tx.labelled_numeric_id(first_tag(p, [t])) for t in fv.RIS_ID_TEXT_TAGS]
    names = F.create_map(*[F.lit(x) for kv in fv.RIS_DATABASE_NAMES.items() for x in kv])
    authors = [F.when(F.size(tag_values(p, t)) > 0, tag_values(p, t)) for t in fv.RIS_AUTHOR_TAGS]
    pubtype = first_tag(p, fv.RIS_FIELD_TAGS["pubtype"])
    return as_records(parsed, {
        **{f: first_tag(p, tags) for f, tags in fv.RIS_FIELD_TAGS.items() if f != "pubtype"},
        "source_database": F.try_element_at(names, F.lower(F.trim(first_tag(p, ["DB"])))),
        "pmid": tx.first_filled(*ids, *texts), "authors": F.coalesce(*authors),
        "pubtypes": F.when(pubtype != "", F.array(pubtype))})


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """RIS files to ingest records. The preamble of a file is not a record."""
    chunks = read_ris_chunks(spark, path).where(F.col("chunk").rlike(RIS_TAG))
    return ris_records(parse_ris(chunks))


def read_tagged_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Records of a tagged plain-text export, split on the line that holds only the end tag."""
    return spark.read.option("lineSep", "\nER\n").text(path).select(
        *provenance(), F.col("value").alias("chunk"))


def tagged_pairs(chunk: Column) -> Column:
    """``array<struct<tag,value>>``: header and end lines dropped, continuation lines folded.

    A continuation of a list tag is a further item, of any other tag more text.
    """
    t = F.regexp_replace(chunk, r"\r", "")
    t = F.regexp_replace(t, r"(?m)^(FN|VR) .*$|^\s*(EF|ER)\s*$", "")
    listed = "|".join(fv.TAGGED_LIST_TAGS)
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    start = F.struct(F.array().cast("array<struct<tag:string,value:string>>").alias("out"), F.lit(None).cast("string").alias("tag"))

    def step(acc, line):
        tag = F.regexp_extract(line, r"^([A-Z]{2}) (.*)$", 1)
        val = tx.strip(F.regexp_extract(line, r"^[A-Z]{2} (.*)$", 1))
        new = F.struct(F.concat(acc["out"], F.array(F.struct(tag.alias("tag"), val.alias("value")))).alias("out"), tag.alias("tag"))
        more = line.rlike(r"^(   |\t)") & acc["tag"].isNotNull()
        item = F.struct(F.concat(acc["out"], F.array(F.struct(acc["tag"].alias("tag"), tx.strip(line).alias("value")))).alias("out"), acc["tag"].alias("tag"))
        last = F.element_at(acc["out"], -1)
        longer = F.struct(F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.struct(
            last["tag"].alias("tag"), F.concat_ws(" ", last["value"], tx.strip(line)).alias("value")))).alias("out"), acc["tag"].alias("tag"))
        return F.when(tag != "", new).when(more & acc["tag"].rlike(f"^({listed})$"), item).when(more, longer).otherwise(acc)
    return F.reduce(lines, start, step)["out"]


def stray_lines(chunk: Column) -> Column:
    """Lines that are neither a tag, a continuation, nor a header or end line."""
    lines = F.split(F.regexp_replace(chunk, r"\r", ""), "\n")
    return F.size(F.filter(lines, lambda x: (F.trim(x) != "") & ~x.rlike(r"^[A-Z]{2} |^(   |\t)|^\s*(EF|ER)\s*$")))


def tagged_records(chunks: DataFrame, database: str = "Web of Science Core Collection") -> DataFrame:
    parsed = chunks.select(*[c for c in chunks.columns if c != "chunk"], tagged_pairs(F.col("chunk")).alias("pairs"),
                           stray_lines(F.col("chunk")).alias("stray_lines")).where(F.size("pairs") > 0)
    p = F.col("pairs")
    one = lambda t: first_tag(p, [t])
    return as_records(parsed, {
        "source_database": F.lit(database), "pmid": tx.strict_numeric_id(one("PM")), "doi": one("DI"), "title": one("TI"),
        "year": one("PY"), "journal": one("SO"), "authors": tag_values(p, "AU"), "abstract": one("AB"), "language": one("LA")},
        ("stray_lines",))


def parse_delimited(lines: DataFrame, header: list[str], value: str = "value", sep: str = "\t") -> DataFrame:
    """Delimited lines to columns. One empty trailing field is expected; other lengths are padded or cut and marked ``lenient``."""
    n = len(header)
    raw = F.split(value, sep, -1)
    cells = F.when((F.size(raw) == n + 1) & (F.element_at(raw, -1) == ""), F.slice(raw, 1, n)).otherwise(raw)
    return (lines.where(F.trim(value) != "").withColumn("_c", cells)
            .select(*[c for c in lines.columns if c != value], *[F.coalesce(F.get("_c", F.lit(i)), F.lit("")).alias(h) for i, h in enumerate(header)],
                    (F.size("_c") != n).alias("lenient")))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-delimited export; the header is the first line of every file and must be the same in all."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$|^﻿", "").alias("value"), *provenance())
    is_header = F.col("value").startswith("PT\tAU") | F.contains("value", F.lit("\tUT\t"))
    headers = [r.value for r in lines.where(is_header).select("value").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError(f"expected one header line, found {len(headers)}")
    return parse_delimited(lines.where(F.col("value") != headers[0]), headers[0].split("\t"))


def tsv_records(df: DataFrame, database: str = "Web of Science Core Collection") -> DataFrame:
    s = lambda n: F.trim(n) if n in df.columns else F.lit("")
    return as_records(df, {
        "source_database": F.lit(database), "pmid": tx.strict_numeric_id(s("PM")), "doi": s("DI"), "title": s("TI"), "year": s("PY"),
        "journal": s("SO"), "authors": split_list(s("AU"), ";"), "abstract": s("AB"),
        "pubtypes": F.when(s("DT") != "", F.array(s("DT")))}, ("lenient",))
