"""BibTeX entries. Finding balanced braces is not regular, so one small Arrow function does it per entry."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.shipping import by_value_arrow_udf
from .records import as_records, provenance, split_list

ENTRY = "@ARTICLE{"


def _fields_on_batches(entries: pa.Array) -> pa.Array:
    # Self-contained, so that it is shipped to the workers by value.
    import re

    import pyarrow

    opener = re.compile(r"([A-Za-z][\w-]*)\s*=\s*\{")
    brace = re.compile(r"[{}]")

    def fields(entry: str | None) -> list[tuple[str, str]]:
        found: dict[str, str] = {}
        head = opener.search(entry or "")
        while head:
            depth, stop = 1, len(entry)
            for b in brace.finditer(entry, head.end()):
                depth += 1 if b.group() == "{" else -1
                if depth == 0:
                    stop = b.start()
                    break
            found[head.group(1).lower()] = entry[head.end():stop]
            head = opener.search(entry, stop)
        return list(found.items())

    return pyarrow.array([fields(e) for e in entries.to_pylist()], type=pyarrow.map_(pyarrow.string(), pyarrow.string()))


def bibtex_fields(entry: Column) -> Column:
    """``map<name, value>`` of an entry; a stray closing brace ends only the value it is in."""
    return by_value_arrow_udf(_fields_on_batches, T.MapType(T.StringType(), T.StringType()))(entry)


def read_bibtex_entries(spark: SparkSession, path: str) -> DataFrame:
    """``(source_file, entry)``; the reader splits on the entry mark at a line start."""
    df = spark.read.option("lineSep", "\n" + ENTRY).text(path)
    return df.select(*provenance(), F.regexp_replace("value", r"^@ARTICLE\{", "").alias("entry"))


def bibtex_records(entries: DataFrame, database: str = "Scopus") -> DataFrame:
    f = entries.select(*[c for c in entries.columns if c != "entry"], bibtex_fields(F.col("entry")).alias("f")).where(F.size("f") > 0)
    g = lambda n: tx.strip(F.coalesce(F.try_element_at("f", F.lit(n)), F.lit("")))
    return as_records(f, {
        "source_database": F.lit(database), "pmid": tx.strict_numeric_id(g("pmid")), "doi": g("doi"), "title": g("title"), "year": g("year"),
        "journal": g("journal"), "authors": split_list(g("author"), " and "), "abstract": g("abstract"),
        "pubtypes": F.when(g("type") != "", F.array(g("type")))})
