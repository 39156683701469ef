"""Is a cited quote on its page? Support of single quotes, and an audit that names what is wrong with each."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.pages import first_pages
from ..functions.shipping import by_value_arrow_udf


def _nfkc_on_batches(a: pa.Array) -> pa.Array:
    import unicodedata

    import pyarrow

    return pyarrow.array([None if x is None else unicodedata.normalize("NFKC", x) for x in a.to_pylist()], type=pyarrow.string())


def compatible(c: Column) -> Column:
    """Compatibility form with squeezed white space; case is kept. Only texts beyond ASCII go to Python."""
    form = F.coalesce(by_value_arrow_udf(_nfkc_on_batches, T.StringType())(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)
    return F.trim(F.regexp_replace(form, r"(?U)\s+", " "))


def page_rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``(doc, page, text)`` of every page; of a number that stands twice in a text the first counts."""
    return (docs.select(doc, F.explode(first_pages(F.col(text))).alias("_x"))
            .select(doc, F.col("_x.page").alias("page"), F.col("_x.text").alias("text")))


def _on_page(cited: DataFrame, pages: DataFrame, doc: str) -> DataFrame:
    """``cited`` (doc, _page, _quote, ...) with ``_has_page`` and ``_verbatim``: the quote as it stands, or across hyphenated line ends.

    Pages are joined as they are, so only those that are cited are brought into the compatible form."""
    joined = tx.dehyphenate(F.col("_text"))
    j = (cited.join(pages.select(doc, F.col("page").alias("_page"), F.col("text").alias("_text")), [doc, "_page"], "left")
         .withColumns({"_t": compatible(F.col("_text")), "_j": compatible(F.when(joined != F.col("_text"), joined))}))
    hit = F.contains("_t", "_quote") | F.coalesce(F.contains("_j", "_quote"), F.lit(False))
    return j.withColumns({"_has_page": F.col("_t").isNotNull(), "_verbatim": F.coalesce(hit, F.lit(False))}).drop("_text", "_t", "_j")


def quote_supported(cited: DataFrame, docs: DataFrame, doc: str, text: str, page: str, quote: str, max_words: int = 25) -> DataFrame:
    """``cited`` with ``supported``: both page and quote are given, the quote has no ellipsis and at most ``max_words`` words, and it stands
    on its page of its document. ``page`` is a bare number; ``doc`` identifies a text. Rows are joined with one page each."""
    q, given = F.coalesce(F.col(quote), F.lit("")), lambda c: c.isNotNull() & (c != "") & ~c.isin(*fv.MISSING_CODES)
    words = F.size(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != ""))
    fit = given(F.col(quote)) & given(F.col(page)) & ~F.contains(q, F.lit("...")) & ~F.contains(q, F.lit("…")) & (words <= max_words)
    number = F.when(F.col(page).rlike(r"^\d+$"), F.col(page).try_cast("int"))
    checked = _on_page(cited.withColumns({"_fit": F.coalesce(fit, F.lit(False)), "_page": number, "_quote": compatible(q)}), page_rows(docs, doc, text), doc)
    return checked.select(*cited.columns, (F.col("_fit") & F.col("_verbatim")).alias("supported"))


def audit_quotes(records: DataFrame, docs: DataFrame, doc: str, text: str, fields: list[str], required: list[str] = (), max_words: int = 20) -> DataFrame:
    """``(doc, field, issue)`` for every fault of the quotes in ``fields`` (each ``p.3: "words"``) of a record.

    Issues: ``missing_evidence`` (a required field is blank), ``format``, ``word_limit``, ``missing_page``, ``not_verbatim_on_page``; a quote
    may be too long and also be wrong. ``missing_source`` stands once for a record without a text.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(f in required).alias("required"), F.coalesce(F.col(f), F.lit("")).alias("cell")) for f in fields])
    have = docs.select(doc, F.lit(True).alias("_source"))
    rows = records.select(doc, cells.alias("_c")).join(have, doc, "left")
    lost = rows.where("_source IS NULL").select(doc, F.lit("full_text").alias("field"), F.lit("missing_source").alias("issue"))
    shape = r'(?s)^p\.(\d+):\s*"(.*)"$'
    each = (rows.where("_source").select(doc, F.explode("_c").alias("c")).select(doc, "c.*")
            .withColumns({"_good": F.col("cell").rlike(shape), "_page": F.regexp_extract("cell", shape, 1).try_cast("int"), "_words": F.regexp_extract("cell", shape, 2)})
            .withColumn("_quote", compatible(F.col("_words"))))
    checked = _on_page(each, page_rows(docs, doc, text), doc)
    blank, n = F.col("cell") == "", F.size(F.filter(F.split("_words", r"(?U)\s+"), lambda w: w != ""))
    issue = (F.when(blank, F.when(F.col("required"), F.array(F.lit("missing_evidence")))).when(~F.col("_good"), F.array(F.lit("format")))
             .otherwise(F.array_compact(F.array(F.when(n > max_words, "word_limit"), F.when(~F.col("_has_page"), "missing_page").when(~F.col("_verbatim"), "not_verbatim_on_page")))))
    return checked.select(doc, "field", F.explode(issue).alias("issue")).unionByName(lost)
