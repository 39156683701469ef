"""Redaction and trimming of whole texts with native regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pages import mark_pages

# What is removed from a full text, and the text put in its place, in order.
# Word edges and white space of contacts and secrets are those of ASCII, spelled out because \b differs between engines and Java versions.
EMAIL = r"(?i)(?:(?<!\w)(?=\w)|(?<=\w)(?=[.%+-]))[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?!\w)"
IDENTIFIER = r"(?i)\b(?:https?://(?:dx\.)?doi\.org/|doi\s*:\s*)10\.\d{4,9}/\S+"
CITATION_ET_AL = r"\b[A-Z][a-z]{2,}(?:\s+(?:and|&)\s+[A-Z][a-z]{2,})?\s+et\s+al\.?"
CITATION_YEAR = r"\b[A-Z][a-z]{2,}\s*\((?:19|20)\d{2}[a-z]?\)"
REFERENCE_HEADING = r"(?im)^\s*(?:references|bibliography|works cited)\s*$"
BODY_HEADING = r"(?im)^\s*(?:abstract|summary|introduction|methods|materials\s+and\s+methods)\s*$"
PAGE_MARKER = r"(?m)^\[\[page\s+\d+\]\]\s*$"
NEXT_HEADING = (r"^\s*(?:abstract|introduction|methods|materials\s+and\s+methods|results|discussion|conclusion"
                r"|references)\s*$")
PERSONAL_HEADING = r"^\s*(?:acknowledg(?:e)?ments?|author contributions|correspondence(?:\s+to)?)\s*:?\s*$"
CONTACT_HEADING = r"^\s*(?:correspondence\s+to|corresponding\s+author|contact\s+author)\s*:"
IDENTITY_LINE = (r"(?im)^.*\b(?:corresponding author|correspondence to|email|e-mail|author contributions"
                 r"|acknowledg(?:e)?ments?)\b.*$")
PAGE_LINE = r"^\[\[page\s+\d+\]\]\s*$"
FIRST_MARKER = r"\A\[\[page\s+\d+\]\]"
RUNNING_HEADER = r"(?im)(^\[\[page\s+\d+\]\][^\n]*\n(?:[^\n]*\n){0,2})[^\n]*\bet\s+al\.?\s*:[^\n]*"
REFERENCE_SHARE = 0.45

# What is withheld from short context strings.
SECRET = r"(?i)(?<!\w)(?:api[_ -]?key|access[_ -]?token|secret)[\t\n\f\r ]*[:=][\t\n\f\r ]*[^\t\n\f\r ]+"
CONTEXT_CITATION = r"\b[A-Z][a-z]{2,}(?:\s+et\s+al\.?)?\s*\(?\s*(?:19|20)\d{2}\s*\)?"
SOFTWARE_VERSION = r"(?i)\b(?:software|tool|package)\s*(?:version|v\.)?\s*\d+(?:\.\d+)+\b"

# Headings that start and end back matter, and where a reference list may begin.
TRIM_REFERENCE_LINE = r"(?i)^\s*(references|reference list|bibliography|literature cited)\s*\.?$"
TRIM_REFERENCE_SHARE = 0.55
BACK_MATTER = (r"(?:acknowledg(?:e)?ments?|funding|conflicts? of interest|competing interests"
               r"|declaration of interest|author contributions|data availability)\b")
BACK_MATTER_END = r"(?:results|discussion|methods|conclusion|table|figure)\b"
REPEATED_LINE_COUNT = 5
REPEATED_LINE_LENGTH = 120


def redact(text: Column) -> Column:
    """Front matter, contacts, identifiers, citations, identity sections and a late reference list. Form feeds become page markers first."""
    t = mark_pages(text)
    body, page2 = F.regexp_instr(t, F.lit(BODY_HEADING)), F.regexp_instr(F.substr(t, F.lit(2)), F.lit(PAGE_MARKER))
    marker = F.regexp_extract(t, FIRST_MARKER, 0)
    marker = F.when(marker != "", marker).otherwise("[[page 1]]")
    t = F.when((body > 0) & ((page2 == 0) | (body <= page2)),
               F.concat(marker, F.lit("\n[front matter redacted]\n"), F.substr(t, body))).otherwise(t)
    t = F.regexp_replace(t, EMAIL, "[contact redacted]")
    t = F.regexp_replace(t, IDENTIFIER, "[identifier redacted]")
    refs = F.regexp_instr(t, F.lit(REFERENCE_HEADING))
    t = F.when(refs - 1 > F.length(t) * REFERENCE_SHARE,
               F.concat(F.substr(t, F.lit(1), refs - 1), F.lit("\n[reference list redacted]\n"))).otherwise(t)
    t = F.regexp_replace(t, CITATION_ET_AL, "[citation redacted]")
    t = F.regexp_replace(t, CITATION_YEAR, "[citation redacted]")
    t = F.regexp_replace(t, rf"(?ims){PERSONAL_HEADING}.*?(?={NEXT_HEADING}|{PAGE_LINE}|\z)",
                         "[article identity section redacted]\n")
    t = F.regexp_replace(t, rf"(?ims){CONTACT_HEADING}.*?(?:^[ \t]*$|(?={PAGE_LINE})|\z)", "[contact block redacted]\n")
    for _ in range(3):  # a running header sits within three lines of a page marker
        t = F.regexp_replace(t, RUNNING_HEADER, "$1[running header redacted]")
    return F.regexp_replace(t, IDENTITY_LINE, "[article identity line redacted]")


def redaction_counts(text: Column) -> dict[str, Column]:
    """How often each rule applies to the original text."""
    rules = {"contacts": EMAIL, "identifiers": IDENTIFIER, "citations": f"{CITATION_ET_AL}|{CITATION_YEAR}",
             "secrets": SECRET, "identity_lines": IDENTITY_LINE}
    return {k: F.regexp_count(text, F.lit(p)).cast("bigint") for k, p in rules.items()}


# The rules of a scrub, in order, each with the text put in place of what it finds.
SCRUB_RULES = {
    "contacts": (EMAIL, "[contact withheld]"),
    "credentials": (SECRET, "[credential withheld]"),
    "citations": (CONTEXT_CITATION, "[citation withheld]"),
    "software": (SOFTWARE_VERSION, "[software detail withheld]"),
}


def scrub(c: Column, rules: list[str] = tuple(SCRUB_RULES)) -> Column:
    for rule in rules:
        c = F.regexp_replace(c, *SCRUB_RULES[rule])
    return c


def _scrub_typed(c: Column, dtype: T.DataType, keep: set[str], rules: list[str]) -> Column:
    if isinstance(dtype, T.StringType):
        return scrub(c, rules)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _scrub_typed(x, dtype.elementType, keep, rules))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda k, v: F.when(k.isin(*keep), v).otherwise(
            _scrub_typed(v, dtype.valueType, keep, rules)) if keep else _scrub_typed(v, dtype.valueType, keep, rules))
    if isinstance(dtype, T.StructType):
        fields = [(c[f.name] if f.name in keep else _scrub_typed(c[f.name], f.dataType, keep, rules)).alias(f.name)
                  for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def scrub_all(df: DataFrame, keep: set[str] = frozenset({"title", "doi", "pmid", "year"}), rules: list[str] = tuple(SCRUB_RULES)) -> DataFrame:
    """Scrub every string of every nested column, apart from the fields in ``keep``, by the ``rules`` named."""
    return df.select(*[
        (F.col(f.name) if f.name in keep else _scrub_typed(F.col(f.name), f.dataType, set(keep), rules)).alias(f.name)
        for f in df.schema.fields])


def changed_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Cells changed per column between two versions with the same key."""
    cols = [c for c in before.columns if c != key]
    j = before.alias("b").join(after.alias("a"), key)
    wide = j.agg(*[F.count_if(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))).alias(c) for c in cols])
    return wide.unpivot([], cols, "field", "changed")


def drop_reference_list(text: Column) -> Column:
    """Cut the text at the first reference heading past 55% of its lines."""
    lines = F.split(text, "\n")
    at = F.array_min(F.array_compact(F.transform(lines, lambda line, i: F.when(
        (i > F.size(lines) * TRIM_REFERENCE_SHARE) & F.trim(line).rlike(TRIM_REFERENCE_LINE), i))))
    return F.when(at.isNotNull(), F.array_join(F.slice(lines, 1, at), "\n")).otherwise(text)


def drop_back_matter(text: Column) -> Column:
    """Drop back-matter sections up to the next body heading or page marker."""
    return F.regexp_replace(
        text, rf"(?ims)^[ \t]*{BACK_MATTER}.*?(?=^\[\[page \d+\]\]|^[ \t]*{BACK_MATTER_END}|\z)", "")


def drop_repeated_lines(df: DataFrame, key: str, text: str, times: int = REPEATED_LINE_COUNT,
                        shorter_than: int = REPEATED_LINE_LENGTH) -> DataFrame:
    """Remove lines that occur ``times`` or more often in their own text; the rest keep their order.

    ``(key, text, dropped_lines)``, found inside each row: the corpus is not shuffled.
    """
    lines = F.split(text, "\n")
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    worth = df.select(key, lines.alias("lines"), F.sort_array(F.filter(F.transform(lines, strip), lambda x: (x != "") & (F.length(x) < shorter_than) & ~x.startswith("[[page"))).alias("s"))
    # In sorted order a line that stands ``times`` times meets itself ``times - 1`` places on.
    again = F.array_distinct(F.filter("s", lambda x, i: F.get("s", i + (times - 1)) == x))
    kept = worth.select(key, "lines", again.alias("again")).select(
        key, "lines", F.filter("lines", lambda x: ~F.coalesce(F.array_contains("again", strip(x)), F.lit(False))).alias("left"))
    return kept.select(key, F.array_join("left", "\n").alias(text), (F.size("lines") - F.size("left")).cast("bigint").alias("dropped_lines"))


def trim_boilerplate(df: DataFrame, key: str, text: str) -> DataFrame:
    """Reference list, back matter and repeated lines removed."""
    cut = df.select(key, drop_back_matter(drop_reference_list(F.col(text))).alias(text))
    return drop_repeated_lines(cut, key, text)


def page_budget(pages: Column, max_pages: int | None, max_chars: int | None) -> Column:
    """Keep marked pages up to a page and character budget; the page that crosses it is cut.

    ``pages`` is an array of strings held by one row. The result is a struct of the kept text and the
    counts that say what was left out.
    """
    kept = F.slice(pages, 1, max_pages) if max_pages else pages
    parts = F.transform(kept, lambda p, i: F.struct(
        F.concat(F.lit("[[page "), (i + 1).cast("string"), F.lit("]]\n")).alias("mark"),
        F.regexp_replace(p, r"^\n+|\n+$", "").alias("body")))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("cut"))

    def step(acc, p):
        need = acc["used"] + F.length(p["mark"]) + F.length(p["body"])
        if not max_chars:
            over, left = F.lit(False), F.length(p["body"])
        else:
            over = need > max_chars
            left = F.greatest(F.lit(0), F.lit(max_chars) - acc["used"] - F.length(p["mark"]))
        body = F.when(over, F.substr(p["body"], F.lit(1), left.cast("int"))).otherwise(p["body"])
        out = F.concat(acc["out"], F.array(F.concat(p["mark"], body)))
        return F.when(acc["cut"], acc).otherwise(F.struct(
            out.alias("out"),
            F.when(over, acc["used"] + F.length(p["mark"]) + left).otherwise(need).cast("bigint").alias("used"), over.alias("cut")))

    run = F.reduce(parts, zero, step)
    text = F.array_join(run["out"], "\n\n")
    return F.struct(text.alias("text"), F.size(pages).alias("pages_total"), F.size(kept).alias("pages_kept"),
                    F.length(text).alias("chars_kept"),
                    ((F.size(kept) < F.size(pages)) | run["cut"]).alias("truncated"))
