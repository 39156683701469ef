"""XML article and book records to ingest records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .records import as_records, provenance

# The parts of the record layout that are read.
_AUTHORS = "ARRAY<STRUCT<CollectiveName: STRING, LastName: STRING, Initials: STRING>>"
_ABSTRACT = "STRUCT<AbstractText: ARRAY<STRUCT<_Label: STRING, _VALUE: STRING>>>"
_IDS = "STRUCT<ArticleId: ARRAY<STRUCT<_IdType: STRING, _VALUE: STRING>>>"
ARTICLE_SCHEMA = f"""MedlineCitation STRUCT<
  PMID: STRING,
  Article: STRUCT<
    ArticleTitle: STRING, Abstract: {_ABSTRACT}, AuthorList: STRUCT<Author: {_AUTHORS}>,
    Journal: STRUCT<Title: STRING, JournalIssue: STRUCT<PubDate: STRUCT<Year: STRING, MedlineDate: STRING>>>,
    ArticleDate: ARRAY<STRUCT<Year: STRING>>, ELocationID: ARRAY<STRUCT<_EIdType: STRING, _VALUE: STRING>>,
    PublicationTypeList: STRUCT<PublicationType: ARRAY<STRING>>>,
  MedlineJournalInfo: STRUCT<MedlineTA: STRING>,
  MeshHeadingList: STRUCT<MeshHeading: ARRAY<STRUCT<
    DescriptorName: STRUCT<_MajorTopicYN: STRING, _VALUE: STRING>,
    QualifierName: ARRAY<STRUCT<_MajorTopicYN: STRING, _VALUE: STRING>>>>>>,
PubmedData STRUCT<ArticleIdList: {_IDS}>"""
BOOK_SCHEMA = f"""BookDocument STRUCT<
  PMID: STRING, ArticleTitle: STRING, Abstract: {_ABSTRACT}, AuthorList: STRUCT<Author: {_AUTHORS}>, ArticleIdList: {_IDS},
  Book: STRUCT<BookTitle: STRING, PubDate: STRUCT<Year: STRING>, Publisher: STRUCT<PublisherName: STRING>>,
  PublicationType: ARRAY<STRING>>"""
ARTICLE_TAG, BOOK_TAG = "PubmedArticle", "PubmedBookArticle"


def read_xml(spark: SparkSession, path: str, tag: str = ARTICLE_TAG, schema: str = ARTICLE_SCHEMA) -> DataFrame:
    """One row per article element; large files are split by the reader."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).select("*", *provenance())


def _abstract(parts: Column) -> Column:
    """Labelled parts as ``Label: text``, joined by a space."""
    texts = F.transform(parts, lambda p: F.struct(p["_Label"].alias("l"), tx.squeeze(F.coalesce(p["_VALUE"], F.lit(""))).alias("t")))
    return F.array_join(F.transform(F.filter(texts, lambda p: p["t"] != ""), lambda p: F.concat_ws(": ", F.when(p["l"] != "", p["l"]), p["t"])), " ")


def _authors(a: Column) -> Column:
    names = F.transform(a, lambda x: F.coalesce(F.when(x["CollectiveName"] != "", tx.squeeze(x["CollectiveName"])),
                                                F.concat_ws(" ", F.when(x["LastName"] != "", x["LastName"]), F.when(x["Initials"] != "", x["Initials"]))))
    return F.filter(names, lambda n: n != "")


def _of_type(items: Column, attr: str, wanted: str) -> Column:
    """First non-empty value of an attributed element list."""
    return F.trim(F.try_element_at(F.filter(items, lambda i: (i[attr] == wanted) & (F.trim(i["_VALUE"]) != "")), F.lit(1))["_VALUE"])


def _major(headings: Column) -> Column:
    """Major headings, alone or with their major qualifiers."""
    def one(h):
        d = tx.squeeze(h["DescriptorName"]["_VALUE"])
        own = F.when(h["DescriptorName"]["_MajorTopicYN"] == "Y", F.array(d)).otherwise(F.array().cast("array<string>"))
        quals = F.transform(F.filter(F.coalesce(h["QualifierName"], F.array().cast("array<struct<_MajorTopicYN:string,_VALUE:string>>")),
                                     lambda q: q["_MajorTopicYN"] == "Y"), lambda q: F.concat_ws("/", d, tx.squeeze(q["_VALUE"])))
        return F.concat(own, quals)
    return F.flatten(F.transform(headings, one))


def article_records(df: DataFrame, database: str = "PubMed/MEDLINE") -> DataFrame:
    m, a = F.col("MedlineCitation"), F.col("MedlineCitation.Article")
    date = a["Journal"]["JournalIssue"]["PubDate"]
    year = tx.first_filled(date["Year"], F.regexp_extract(F.coalesce(date["MedlineDate"], F.lit("")), r"\d{4}", 0),
                           F.try_element_at(a["ArticleDate"], F.lit(1))["Year"])
    doi = F.coalesce(_of_type(F.col("PubmedData.ArticleIdList.ArticleId"), "_IdType", "doi"), _of_type(a["ELocationID"], "_EIdType", "doi"))
    return as_records(df, {
        "source_database": F.lit(database), "pmid": F.trim(m["PMID"]), "title": tx.squeeze(a["ArticleTitle"]), "abstract": _abstract(a["Abstract"]["AbstractText"]),
        "authors": _authors(a["AuthorList"]["Author"]), "journal": tx.first_filled(tx.squeeze(a["Journal"]["Title"]), m["MedlineJournalInfo"]["MedlineTA"]),
        "year": year, "doi": doi, "pubtypes": a["PublicationTypeList"]["PublicationType"], "mesh": _major(m["MeshHeadingList"]["MeshHeading"])},
        ("key",))


def book_records(df: DataFrame, database: str = "PubMed/MEDLINE") -> DataFrame:
    b = F.col("BookDocument")
    return as_records(df, {
        "source_database": F.lit(database), "pmid": F.trim(b["PMID"]), "title": tx.first_filled(tx.squeeze(b["ArticleTitle"]), tx.squeeze(b["Book"]["BookTitle"])),
        "abstract": _abstract(b["Abstract"]["AbstractText"]), "authors": _authors(b["AuthorList"]["Author"]), "journal": tx.squeeze(b["Book"]["Publisher"]["PublisherName"]),
        "year": b["Book"]["PubDate"]["Year"], "doi": _of_type(b["ArticleIdList"]["ArticleId"], "_IdType", "doi"), "pubtypes": b["PublicationType"]},
        ("key",))
