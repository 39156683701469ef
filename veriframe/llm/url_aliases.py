"""URL filters by rules, with decisions carried over to aliases.

A rule names a host and the beginning of a path; it fits the host and its subdomains, and the longest fitting rule decides. URLs
that redirect to each other or name each other as canonical are aliases: the connected components of those links. A URL without a
rule of its own takes the decision of its component: allowed if a URL in it is explicitly allowed, else blocked if one is blocked,
else allowed. A URL's own rule always stands.

DataFrame functions only. Links are read from the pages' markup (canonical links, refresh redirects) and may be added as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage

#: Verdict, host and path of each rule.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIKELY = r"(?i)<(?:link|meta)\b[^>]*(?:canonical|refresh)"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TAGS = r"(?i)<(?:link|meta)\b[^>]*>"
CANONICAL = r"""(?is)^<link\b.*\brel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
REFRESH = r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
HREF = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
#: The SQL's own forms: they see tags on one line only.
SQL_CANONICAL = r"""(?i)^<link\b.*\brel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
SQL_REFRESH = r"""(?i)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
TARGET = r"""(?i)\burl\s*=\s*["']?\s*([^"'>\s]+)"""


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit("")),
            F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct with ``rule`` and ``verdict``, else null. Of equal length, the rule with the longer host,
    then an allowing one."""
    listed = F.array(*[F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(len(h)).alias("hosts"), F.lit(int(v == "allow")).alias("allows"), F.lit(h + p).alias("rule"),
                                F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return F.array_max(F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])))


def alias_key(url: Column) -> Column:
    """A URL without its fragment, scheme and host lower-cased, an empty path written as ``/``; null if it has no ``://``."""
    host, path = parts(url)
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query))


def resolve(base: Column, target: Column) -> Column:
    """A link target as a full URL; null for other schemes and for mere fragments. Dot segments stay as they are."""
    site = F.regexp_extract(base, r"^[^:]*://[^/?#]*", 0)
    page = F.regexp_extract(base, r"^[^:]*://[^?#]*", 0)
    folder = F.when(page == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (target == "") | target.startswith("#"), F.lit(None))
            .when(target.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), target))
            .when(target.startswith("/"), F.concat(site, target))
            .when(target.startswith("?"), F.concat(page, target))
            .otherwise(F.concat(folder, target)))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst``: alias keys of a page and of each canonical link and refresh redirect in its markup. Comments, scripts and
    styles are left out."""
    seen = F.regexp_replace(F.col("html"), HIDDEN, " ")
    tag, one = F.col("tag"), lambda pattern, c: F.concat(*[F.regexp_extract(c, pattern, i) for i in (1, 2, 3)])
    target = F.when(tag.rlike(CANONICAL), one(HREF, tag)).when(tag.rlike(REFRESH), F.regexp_extract(tag, TARGET, 1))
    return (pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.col("url").contains("://") & F.col("html").rlike(LIKELY))
            .select("url", F.explode(F.regexp_extract_all(seen, F.lit(TAGS), F.lit(0))).alias("tag"))
            .select("url", F.replace(F.trim(target), F.lit("&amp;"), F.lit("&")).alias("target"))
            .where("target IS NOT NULL").select(alias_key(F.col("url")).alias("src"), alias_key(resolve(F.col("url"), F.col("target"))).alias("dst"))
            .where("src IS NOT NULL AND dst IS NOT NULL"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, key: str = "page_id",
          url: str = "url", html: str = "html") -> DataFrame:
    """``key, host, path, rule, verdict`` for every page.

    ``rules`` is a list in the configuration (it becomes part of the plan); ``redirects`` may add links as ``src, dst`` URLs. A null
    URL, or one without ``://``, has an empty host and path, no rule and no aliases, and is allowed. Null markup has no links. Repeated
    rows give repeated rows, a null key stays null, an empty table gives an empty result; other columns play no part.
    """
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select(alias_key(F.col("src")).alias("src"), alias_key(F.col("dst")).alias("dst"))
                                  .where("src IS NOT NULL AND dst IS NOT NULL"))
    nodes = connected_components(links)
    named = nodes.withColumn("verdict", fitting_rule(*parts(F.col("node")), rules)["verdict"])
    decided = (named.groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allows"), F.max(F.col("verdict") == "block").alias("blocks"))
               .select("component", F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").otherwise("allow").alias("by_alias")))
    by_alias = cut_lineage(nodes.join(decided, "component").select(F.col("node").alias("alias"), "by_alias"))
    host, path = parts(F.col("url"))
    best = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = (pages.select(F.col(key).alias("k"), F.col(url).alias("url"))
              .select("k", host.alias("host"), path.alias("path"), alias_key(F.col("url")).alias("alias"))
              .withColumn("best", best).withColumn("alias", F.when(F.col("best").isNull(), F.col("alias"))))
    return (judged.join(by_alias, "alias", "left")
            .select(F.col("k").alias(key), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", "by_alias", F.lit("allow")).alias("verdict")))


def judge_sql(rules: list[tuple[str, str, str]] = RULES) -> str:
    """The result of ``judge`` over ``pages`` in SQL, with the components as a recursive closure."""
    q = lambda s: s.replace("'", "''")
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    lower = f"'{UPPER}', '{LOWER}'"
    host = lambda u: f"coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), {lower}), '')"
    path = lambda u: f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    alias = lambda u: (f"CASE WHEN contains({u}, '://') THEN translate(split_part({u}, '://', 1), {lower}) || '://' || {host(u)} || "  # noqa: E731
                       f"CASE WHEN {path(u)} = '' THEN '/' ELSE {path(u)} END || regexp_extract({u}, '^[^?#]*(\\?[^#]*)', 1) END")
    best = lambda t, k: (f"SELECT {k}, arg_max(v || ' ' || h || p, (length(h) + length(p)) * 100000 + length(h) * 10 + (v = 'allow')::INT) AS best FROM {t}, rules "  # noqa: E731
                         f"WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY {k}")
    return rf"""
        WITH RECURSIVE rules(v, h, p) AS (VALUES {listed}),
        tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '{q(HIDDEN)}', ' ', 'g'), '{q(TAGS)}')) AS tag FROM pages
            WHERE contains(url, '://') AND regexp_matches(html, '{q(LIKELY)}')),
        targets AS (SELECT url, replace(trim(CASE WHEN regexp_matches(tag, '{q(SQL_CANONICAL)}')
                THEN regexp_extract(tag, '{q(HREF)}', 1) || regexp_extract(tag, '{q(HREF)}', 2) || regexp_extract(tag, '{q(HREF)}', 3)
                WHEN regexp_matches(tag, '{q(SQL_REFRESH)}') THEN regexp_extract(tag, '{q(TARGET)}', 1) END), '&amp;', '&') AS t FROM tags),
        bases AS (SELECT url, t, regexp_extract(url, '^[^:]*://[^/?#]*', 0) AS site, regexp_extract(url, '^[^:]*://[^?#]*', 0) AS page FROM targets WHERE t IS NOT NULL),
        whole AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
                WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR t = '' OR starts_with(t, '#') THEN NULL
                WHEN starts_with(t, '//') THEN split_part(url, '://', 1) || ':' || t WHEN starts_with(t, '/') THEN site || t
                WHEN starts_with(t, '?') THEN page || t WHEN page = site THEN site || '/' || t
                ELSE regexp_replace(page, '[^/]*$', '') || t END AS t FROM bases),
        links AS (SELECT {alias("url")} AS a, {alias("t")} AS b FROM whole WHERE t IS NOT NULL),
        both_ways AS (SELECT a, b FROM links WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM links WHERE b IS NOT NULL AND a <> b),
        reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, s.b FROM reach r JOIN both_ways s ON r.b = s.a),
        nodes AS (SELECT DISTINCT a AS node, {host("a")} AS host, {path("a")} AS path FROM both_ways),
        node_rules AS ({best("nodes", "node")}),
        by_alias AS (SELECT a AS node, CASE WHEN bool_or(starts_with(best, 'allow')) THEN 'allow' WHEN bool_or(starts_with(best, 'block')) THEN 'block' ELSE 'allow' END AS verdict
            FROM reach LEFT JOIN node_rules ON b = node GROUP BY a),
        urls AS (SELECT row_number() OVER () AS row, page_id, {host("url")} AS host, {path("url")} AS path, {alias("url")} AS node FROM pages),
        own AS ({best("urls", "row")})
        SELECT page_id, host, path, split_part(best, ' ', 2) AS rule, coalesce(split_part(best, ' ', 1), verdict, 'allow') AS verdict
        FROM urls LEFT JOIN own USING (row) LEFT JOIN by_alias USING (node)"""
