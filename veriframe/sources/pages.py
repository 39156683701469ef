"""Links and page-marked text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Meta tag that names the full-text file, and how links rank below it.
META_LINK = r'(?i)<meta[^>]+name="citation_pdf_url"[^>]+content="([^"]+)"'
FILE_LINK = r"\.pdf($|[?#])"
PATH_LINK = r"/pdf"


def absolute_url(href: Column, base: Column) -> Column:
    """Resolve a root-relative, protocol-relative or sibling link against its page."""
    root = F.regexp_extract(base, r"^[a-z]+://[^/?#]+", 0)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:]/)[^/]*$", "")
    return (F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^[a-z]+:", 0), href))
            .when(href.startswith("/"), F.concat(root, href))
            .when(href != "", F.concat(folder, href)))


def best_link(html: Column, base: Column, label_pattern: str = r"pdf|full text|download") -> Column:
    """The link most likely to lead to the full text: meta tag, then file link, then path, then link text."""
    anchor = r'<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
    hrefs = F.regexp_extract_all(html, F.lit(anchor), F.lit(1))
    labels = F.regexp_extract_all(html, F.lit(anchor), F.lit(2))
    ranked = F.zip_with(hrefs, labels, lambda h, t: F.struct(
        F.when(F.lower(h).rlike(FILE_LINK), 1).when(F.lower(h).rlike(PATH_LINK), 2)
        .when(F.lower(t).rlike(label_pattern), 3).alias("rank"), h.alias("href")))
    ordered = F.transform(ranked, lambda s, i: F.struct(s["rank"].alias("rank"), i.alias("i"), s["href"].alias("href")))
    best = F.array_min(F.filter(ordered, lambda s: s["rank"].isNotNull()))
    meta = F.regexp_extract(html, META_LINK, 1)
    return absolute_url(F.coalesce(F.when(meta != "", meta), best["href"]), base)
