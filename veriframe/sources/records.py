"""The ingest schema, and JSON and CSV exports mapped to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions import text as tx

LISTS = {"authors", "pubtypes", "mesh"}
BAD = "_bad"


PROVENANCE = ("source_file", "source_block", "source_seq")


def provenance() -> list[Column]:
    """Where a row was read: file, start of its block, and a number that rises within the block."""
    return [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("source_block"),
            F.monotonically_increasing_id().alias("source_seq")]


def as_records(df: DataFrame, fields: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """Project to the ingest schema; a field that is not given is '' or an empty list."""
    def one(name: str) -> Column:
        if name in LISTS:
            c = fields.get(name, F.array().cast("array<string>"))
            return F.coalesce(c, F.array().cast("array<string>")).alias(name)
        return F.coalesce(fields.get(name, F.lit("")).cast("string"), F.lit("")).alias(name)
    return df.select(*[k for k in (*PROVENANCE, *keep) if k in df.columns], *[one(f) for f in fv.RECORD_FIELDS])


def split_list(c: Column, sep: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda a: tx.strip(a)), lambda a: a != "")


def parse_json_lines(lines: DataFrame, value: str, schema: T.StructType) -> DataFrame:
    """Parse JSON lines. A line that is not an object of the schema is kept in ``_bad``, not fatal."""
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    text = F.col(value)
    obj = F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    bad = ~F.coalesce(F.ltrim(text).startswith("{"), F.lit(False)) | obj[BAD].isNotNull()
    return lines.where(F.trim(text) != "").select(
        *[c for c in lines.columns if c != value],
        *[F.when(~bad, obj[f.name]).alias(f.name) for f in schema.fields], F.when(bad, text).alias(BAD))


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType, least: float = 0.8) -> DataFrame:
    """JSON lines; a file of which under ``least`` of the lines are objects is read as one document.

    A document is ``{"records": [...]}`` or an array. All files are judged in one pass.
    """
    lines = spark.read.text(path).select("value", *provenance())
    is_obj = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    share = lines.where(F.trim("value") != "").groupBy("source_file").agg(F.avg(is_obj.cast("int")).alias("s"))
    # File names only.
    docs = [r.source_file for r in share.where(F.col("s") < least).select("source_file").toLocalIterator()]
    out = parse_json_lines(lines.where(~F.col("source_file").isin(docs)) if docs else lines, "value", schema)
    if not docs:
        return out
    doc = T.StructType([*schema.fields, T.StructField("records", T.ArrayType(schema))])
    d = spark.read.schema(doc).option("multiLine", True).json(docs).select("*", *provenance())
    own = F.array(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]))
    rows = d.select(*PROVENANCE[:2], F.explode(F.coalesce("records", own)).alias("r"))
    # Numbered after the records of a document are laid out, so a document may hold any number of them.
    rows = rows.select(*PROVENANCE[:2], F.monotonically_increasing_id().alias("source_seq"), "r.*")
    return out.unionByName(rows.withColumn(BAD, F.lit(None).cast("string")))


# The two JSON layouts, told apart by the keys present.
JSON_SCHEMA = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("pmid", "doi", "title", "abstract", "journal", "year", "language",
                                                 "eid", "dc:title", "prism:doi", "dc:creator", "prism:publicationName",
                                                 "prism:coverDate", "dc:description", "pubmed-id", "pubmed_id")],
    *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("authors", "pubtypes", "mesh", "mesh_major")],
])
SECOND_LAYOUT_KEYS = ["eid", "dc:title", "prism:doi", "dc:creator", "prism:publicationName"]


def json_records(df: DataFrame) -> DataFrame:
    """Both JSON layouts to ingest records, in one projection."""
    q = lambda n: F.col(f"`{n}`")
    second = F.lit(False)
    for k in SECOND_LAYOUT_KEYS:
        second = second | q(k).isNotNull()

    def pick(b: Column, a: Column) -> Column:
        return F.when(second, b).otherwise(a)
    creator = q("dc:creator")
    creators = (F.when(creator.startswith("["), F.from_json(creator, "array<string>")).when(creator != "", F.array(creator)))
    none = F.lit(None).cast("array<string>")
    return as_records(df.where(F.col(BAD).isNull()) if BAD in df.columns else df, {
        "source_database": pick(F.lit("Scopus"), F.lit("PubMed/MEDLINE")),
        "pmid": F.trim(pick(F.coalesce(q("pubmed-id"), q("pubmed_id")), q("pmid"))),
        "doi": F.trim(pick(q("prism:doi"), q("doi"))), "title": pick(q("dc:title"), q("title")),
        "abstract": pick(q("dc:description"), q("abstract")), "journal": pick(q("prism:publicationName"), q("journal")),
        "year": pick(F.regexp_extract(q("prism:coverDate"), r"^(\d{4})", 1), q("year")),
        "authors": pick(creators, q("authors")), "pubtypes": pick(none, q("pubtypes")),
        "mesh": pick(none, F.coalesce(q("mesh"), q("mesh_major"))), "language": pick(F.lit(""), q("language"))})


def match_headers(columns: list[str]) -> dict[str, str | None]:
    """Field to column, by case-insensitive header synonyms; the first synonym present wins."""
    low = {c.strip().lower(): c for c in columns if c}
    return {f: next((low[s] for s in syns if s in low), None) for f, syns in fv.CSV_HEADER_SYNONYMS.items()}


def csv_records(df: DataFrame, database: str = "") -> DataFrame:
    cols = match_headers(df.columns)
    fields = {f: F.col(f"`{c}`") for f, c in cols.items() if c and f not in ("eid", "authors")}
    if cols["authors"]:
        fields["authors"] = split_list(F.col(f"`{cols['authors']}`"), ";")
    fields["source_database"] = F.lit(database or ("Scopus" if cols["eid"] else ""))
    return as_records(df, fields)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headered CSV export as strings; quotes are doubled and values may span lines."""
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
            .select("*", *provenance()))
