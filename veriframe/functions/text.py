"""Text, identifier, date and number normalisers as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

_TOP = 0x20000


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row; an expression that a lambda names is otherwise worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility-decomposition tables derived from the Unicode database.

    ``from``/``to`` for :func:`pyspark.sql.functions.translate` (characters past the end of
    ``to`` are deleted) and a map for characters that expand to several.
    """
    one, gone, many = [], [], {}
    for cp in range(0x80, _TOP):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000:
            continue
        out = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if out == ch:
            continue
        if out == "":
            gone.append(ch)
        elif len(out) == 1 and ord(out) < 0x80:
            one.append((ch, out))
        elif any(ord(c) < 0x80 and c.isalnum() for c in out):
            many[ch] = out
    return "".join(a for a, _ in one) + "".join(gone), "".join(b for _, b in one), many


def _ranges(chars: list[str], gap: int) -> str:
    """A regex class that covers ``chars``; code points closer than ``gap`` share a range."""
    runs: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if runs and cp - runs[-1][1] <= gap:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def fold_accents(c: Column) -> Column:
    """NFKD without combining marks, for every character that decomposes to ASCII letters or digits.

    One ``translate`` does the work. Only texts that may hold a character that expands to several
    (a coarse class test, then a finer one) take the character-by-character path.
    """
    src, dst, many = _fold_tables()
    table = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])
    expanded = F.array_join(
        F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)),
                    lambda ch: F.coalesce(F.try_element_at(table, ch), ch)),
        "",
    )
    rare = c.rlike(_ranges(list(many), 0x60)) & c.rlike(_ranges(list(many), 2))
    return F.translate(F.when(rare, expanded).otherwise(c), src, dst)


def normalize_title(c: Column) -> Column:
    """Accent-folded lower case; everything but ``a-z0-9`` becomes one space. NULL becomes ''."""
    c = F.coalesce(c, F.lit(""))
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", " "))


def alnum_key(c: Column, length: int | None = None) -> Column:
    """Lower-case letters and digits only, optionally the first ``length`` of them (a filename key)."""
    k = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")
    return F.substring(k, 1, length) if length else k


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_doi(c: Column) -> Column:
    c = strip(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, r"(?i)^(https?://)?(dx\.)?doi\.org/", "")
    c = F.regexp_replace(c, r"(?i)^doi\s*:\s*", "")
    return F.lower(F.regexp_replace(c, r"^\s+|[\s.]*\.\s*$|\s+$", ""))


def strict_numeric_id(c: Column) -> Column:
    """4-9 digits and nothing else, apart from a source prefix; '' otherwise."""
    return F.regexp_extract(
        strip(F.coalesce(c, F.lit(""))), r"(?i)^(?:(?:medline|pubmed|pmid)\s*[:#-]?\s*)?(\d{4,9})$", 1)


def lenient_numeric_id(c: Column) -> Column:
    """First run of 4-9 digits anywhere; '' if none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"\d{4,9}", 0)


def labelled_numeric_id(c: Column) -> Column:
    """Digits after a ``PMID`` label inside running text; '' if none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)PMID[:\s]+(\d{4,9})", 1)


def year_of(c: Column) -> Column:
    """First year 1600-2099 in free text, as int; NULL if none."""
    return F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"1[6-9]\d{2}|20\d{2}", 0).try_cast("int")


def decade_of(c: Column, missing: str = "NR") -> Column:
    y = c.try_cast("int")
    return F.coalesce((F.floor(y / 10) * 10).cast("string"), F.lit(missing))


def year_bucket(c: Column, bands: list[tuple[int, int, str]], missing: str = "unknown") -> Column:
    """Label of the first ``(low, high, label)`` band that holds the year."""
    y = c.try_cast("int")
    out = None
    for lo, hi, label in bands:
        cond = (y >= lo) & (y <= hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(missing)


def surname_tokens(authors: Column) -> Column:
    """Sorted distinct normalised surnames: text before the comma, else the first word."""
    def one(a: Column) -> Column:
        a = strip(F.coalesce(a, F.lit("")))
        return normalize_title(F.when(F.contains(a, F.lit(",")), F.substring_index(a, ",", 1))
                               .otherwise(F.regexp_extract(a, r"^\S+", 0)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(authors, one), lambda t: t != "")))


def has_marker(c: Column, markers: list[str]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return low.rlike("|".join(m.replace(".", r"\.") for m in markers))


def is_preprint(journal: Column, pubtypes: Column | None, database: Column) -> Column:
    hit = has_marker(journal, fv.PREPRINT_MARKERS) | has_marker(database, fv.PREPRINT_DATABASE_MARKERS)
    if pubtypes is not None:
        hit = hit | F.coalesce(F.exists(pubtypes, lambda p: F.contains(F.lower(p), F.lit("preprint"))), F.lit(False))
    return hit


def first_filled(*cols: Column) -> Column:
    """First column that is neither NULL nor ''; '' if none."""
    return F.coalesce(*[F.when(c != "", c) for c in cols], F.lit(""))


def set_cell(c: Column, sep: str = ";") -> Column:
    """A separated list cell as sorted distinct items joined by '; '."""
    items = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: strip(x)), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(items)), "; ")


def count_cell(c: Column) -> Column:
    """A count cell: a whole number loses its decimal part; other text is kept."""
    num = c.try_cast("double")
    return (F.when(num.isNull(), c)
            .when(num == F.floor(num), num.cast("bigint").cast("string"))
            .otherwise(num.cast("string")))


NUMBER = r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?%?$"


def parse_number(c: Column) -> Column:
    """A cell that is a number (sign, thousands commas, %, exponent) as double; NULL otherwise."""
    s = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), ",", "")
    return F.when(s.rlike(NUMBER), F.regexp_replace(s, "%$", "").try_cast("double"))


def decimals_of(c: Column) -> Column:
    return F.length(F.regexp_extract(F.coalesce(c, F.lit("")), r"\.(\d+)", 1))


def to_hours(value: Column, unit: Column) -> Column:
    v, u = value.try_cast("double"), F.lower(F.coalesce(unit, F.lit("")))
    out = None
    for prefix, factor in fv.HOURS_PER_UNIT:
        hit = u.startswith(prefix)
        term = v / 60 if prefix == "min" else v * factor
        out = F.when(hit, term) if out is None else out.when(hit, term)
    return out


def time_bin(hours: Column) -> Column:
    """Half-open bins, closed at the top of the last bounded one; NULL hours give NULL."""
    out = F.when(hours.isNull(), F.lit(None).cast("string")).when(hours < 0, fv.TIME_BIN_BELOW)
    for label, top in fv.TIME_BINS:
        out = out.when(hours < top, label)
    return out.when(hours <= fv.TIME_BIN_CLOSED[1], fv.TIME_BIN_CLOSED[0]).otherwise(fv.TIME_BIN_ABOVE)


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.try_parse_url(c, F.lit("HOST")), r"^(www|m)\.", ""))


def canonical_url(c: Column) -> Column:
    """Host folded, scheme, query, fragment, ``.html`` and trailing slash removed."""
    path = F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))
    return F.concat(url_host(c), F.regexp_replace(path, r"(\.html?)?/*$", ""))


def normalize_entity(c: Column, synonyms: list[tuple[str, str]], prefixes: list[str] = (),
                     qualifiers: list[str] = (), missing: str = "NR") -> Column:
    """Canonical entity name: prefixes off, first synonym that matches, else qualifiers off and squeezed."""
    s = strip(F.coalesce(c, F.lit("")))
    for p in prefixes:
        s = F.regexp_replace(s, "(?i)^" + p, "")
    plain = F.regexp_replace(s, r"(?i)\b(" + "|".join(qualifiers) + r")\b", "") if qualifiers else s
    plain = F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r"^[ ,;-]+|[ ,;-]+$", "")
    out = F.when((s == "") | s.isin(*fv.MISSING_CODES), F.when(s == "", missing).otherwise(s))
    for pattern, name in synonyms:
        out = out.when(s.rlike("(?i)^(?:" + pattern + ")"), name)
    return out.otherwise(F.when(plain == "", missing).otherwise(plain))


def labelled_note(parts: list[tuple[str, Column]], sep: str = " | ") -> Column:
    """``label: text`` parts joined by ``sep``; blank parts are left out."""
    return F.concat_ws(sep, *[F.when(strip(c) != "", F.concat(F.lit(f"{label}: "), strip(c))) for label, c in parts])


def author_year(authors: Column, year: Column, sep: str = ";") -> Column:
    """First author and year as ``Roe A, 2020``; either alone where the other is blank."""
    first = strip(F.substring_index(F.coalesce(authors, F.lit("")), sep, 1))
    return F.concat_ws(", ", F.when(first != "", first), F.when(year.cast("string") != "", year.cast("string")))


def percent_encode(c: Column) -> Column:
    """Percent-encode text for a URL, keeping ``/`` and unreserved characters."""
    e = F.url_encode(c)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        e = F.replace(e, F.lit(old), F.lit(new))
    return e


def record_links(doi: Column, pmid: Column, title: Column, record_id: Column) -> dict[str, Column]:
    """Links and the file name a record's full text is saved under; '' where an identifier is blank."""
    d, p, t = (strip(F.coalesce(c, F.lit(""))) for c in (doi, pmid, title))
    return {
        "doi_link": F.when(d != "", F.concat(F.lit(fv.DOI_LINK), d)).otherwise(""),
        "pubmed_link": F.when(p != "", F.concat(F.lit(fv.PMID_LINK), p, F.lit("/"))).otherwise(""),
        "mirror_link": F.when(p != "", F.concat(F.lit(fv.MIRROR_PMID_LINK), p)).when(d != "", F.concat(F.lit(fv.MIRROR_DOI_LINK), d)).otherwise(""),
        "title_link": F.when(t != "", F.concat(F.lit(fv.TITLE_SEARCH_LINK), percent_encode(F.concat(F.lit('"'), t, F.lit('"'))))).otherwise(""),
        "save_as": F.concat(F.regexp_replace(record_id, "[^A-Za-z0-9._-]", "_"), F.lit(".pdf")),
    }


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def bigrams(ws: Column) -> Column:
    """Distinct adjacent word pairs of an array of words."""
    pairs = F.zip_with(ws, F.slice(ws, 2, F.size(ws)), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.array_compact(pairs))


def normalize_quote(c: Column) -> Column:
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def dehyphenate(c: Column) -> Column:
    """Remove soft hyphens and join words split over a line end."""
    return F.regexp_replace(F.regexp_replace(c, "­", ""), r"(?<=\w)-\s*\n\s*(?=\w)", "")


def distinctive_words(title: Column, min_len: int = 5) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_title(title), " "), lambda w: F.length(w) >= min_len))
