"""Lookup, match, containment and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..operators import containment as ct
from ..operators import joins as jn
from ..operators import phrases as ph
from ..operators import setops as so
from ..operators import validate as va
from ..operators.ordered import previous
from ..operators.ranges import number_rows
from .dedup import page_records
from .registry import query
from .text import SQL_NORM

c = F.col


@query("""
SELECT o_orderkey, coalesce(c_mktsegment, '') AS c_mktsegment, coalesce(CAST(c_nationkey AS VARCHAR), '') AS c_nationkey
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def lookup_enrich(t):
    dim = t.customer.where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey")
    return jn.lookup(t.orders.select("o_orderkey", "o_custkey"), dim, "o_custkey", ["c_mktsegment", "c_nationkey"]).drop("o_custkey")


@query("""
SELECT CASE WHEN k.o_custkey IS NULL THEN 'never ordered' ELSE '' END AS missing_reason, count(*) AS n FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) k ON c_custkey = k.o_custkey GROUP BY 1
UNION ALL SELECT 'order without customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)""")
def scope_split(t):
    cust = t.customer.select(c("c_custkey").alias("k"))
    o = t.orders.select(c("o_custkey").alias("k"))
    a = jn.scope_split(cust, o, "k", "never ordered").groupBy("missing_reason").agg(F.count(F.lit(1)).alias("n"))
    b = o.join(cust, "k", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("order without customer").alias("missing_reason"), "n")
    return a.unionByName(b)


CANON_SQL = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^(www|m)\.', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '(\.html)?/*$', '')"
TITLE_SQL = SQL_NORM.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")


@query(f"""
WITH p AS (SELECT page_id, {CANON_SQL} AS canon, {TITLE_SQL} AS title, md5('w' || page_id) AS h FROM pages),
i AS (SELECT page_id, CASE WHEN h < '5' THEN CAST(page_id AS VARCHAR) ELSE '' END AS pid, CASE WHEN h < 'a' THEN canon ELSE '' END AS url, CASE WHEN h < 'e' THEN title ELSE '' END AS title FROM p),
u AS (SELECT canon, min(page_id) AS m FROM p GROUP BY 1), v AS (SELECT title, min(page_id) AS m FROM p WHERE title <> '' GROUP BY 1)
SELECT page_id, CASE WHEN pid <> '' THEN page_id WHEN u.m IS NOT NULL THEN u.m ELSE v.m END AS matched, CASE WHEN pid <> '' THEN 'id' WHEN u.m IS NOT NULL THEN 'url' WHEN v.m IS NOT NULL THEN 'title' ELSE 'none' END AS rule
FROM i LEFT JOIN u ON i.url <> '' AND u.canon = i.url LEFT JOIN v ON i.title <> '' AND v.title = i.title""")
def match_waterfall(t):
    title = tx.normalize_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    pool = t.pages.select("page_id", c("page_id").cast("string").alias("pid"), tx.canonical_url(c("url")).alias("url"), title.alias("title"))
    h = F.md5(F.concat(F.lit("w"), c("page_id").cast("string")))
    inc = pool.select("page_id", *[F.when(h < top, c(k)).otherwise("").alias(k) for k, top in (("pid", "5"), ("url", "a"), ("title", "e"))])
    return jn.match_waterfall(inc, pool, "page_id", "page_id", [("id", "pid", "pid"), ("url", "url", "url"), ("title", "title", "title")])


@query("""
WITH p AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderkey))) AS ids FROM orders GROUP BY 1),
ch AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
e AS (SELECT o_custkey, unnest(ids) AS k FROM p)
SELECT o_custkey, string_agg(k || ':' || n || ':' || CAST(q AS BIGINT), ',' ORDER BY k) AS children FROM e JOIN ch ON k = l_orderkey GROUP BY 1
UNION ALL SELECT o_custkey, NULL FROM p WHERE o_custkey NOT IN (SELECT o_custkey FROM e JOIN ch ON k = l_orderkey)""")
def attach_children(t):
    parents = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("ids"))
    ch = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("q"))
    out = jn.attach_children(parents, "o_custkey", "ids", ch, "l_orderkey")
    return out.select("o_custkey", F.array_join(F.transform("children", lambda s: F.concat_ws(":", s["l_orderkey"], s["n"], s["q"])), ",").alias("children"))


@query("""
WITH r AS (SELECT o_orderpriority AS parent, CASE WHEN o_totalprice < 80000 THEN 'NR' WHEN o_totalprice < 90000 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS link FROM orders),
t AS (SELECT DISTINCT o_orderpriority AS parent, CAST(o_custkey AS VARCHAR) AS link FROM orders WHERE o_totalprice >= 250000)
SELECT r.parent, CASE WHEN r.link IN ('', 'NA', 'NR', 'UNCLEAR', 'null') THEN 'parent_level' WHEN t.link IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS link_status, count(*) AS n
FROM r LEFT JOIN t ON r.parent = t.parent AND r.link = t.link GROUP BY 1, 2""")
def composite_link(t):
    o = t.orders.select(c("o_orderpriority").alias("parent"), c("o_totalprice").alias("price"), c("o_custkey").cast("string").alias("k"))
    rows = o.select("parent", F.when(c("price") < 80000, "NR").when(c("price") < 90000, "").otherwise(c("k")).alias("link"))
    targets = o.where("price >= 250000").select("parent", c("k").alias("link"))
    return (jn.link_status(rows, targets, ["parent"], "link", fv.NO_LINK_SENTINELS)
            .groupBy("parent", "link_status").agg(F.count(F.lit(1)).alias("n")))


@query("""
SELECT 'lineitem.order' AS "check", CAST(l_orderkey AS VARCHAR) AS key, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 2
UNION ALL SELECT 'orders.customer', CAST(o_custkey AS VARCHAR), count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 2
UNION ALL SELECT 'lineitem.part', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY 2
UNION ALL SELECT 'customer.nation', CAST(c_nationkey AS VARCHAR), count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) GROUP BY 2
UNION ALL SELECT 'lineitem.pk', l_orderkey || '|' || l_linenumber, count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'orders.pk', CAST(o_orderkey AS VARCHAR), count(*) FROM orders GROUP BY o_orderkey HAVING count(*) > 1""")
def fk_integrity(t):
    parts = [
        va.foreign_key_gaps(t.lineitem, ["l_orderkey"], t.orders, ["o_orderkey"], "lineitem.order"),
        va.foreign_key_gaps(t.orders, ["o_custkey"], t.customer, ["c_custkey"], "orders.customer"),
        va.foreign_key_gaps(t.lineitem, ["l_partkey"], t.part, ["p_partkey"], "lineitem.part"),
        va.foreign_key_gaps(t.customer, ["c_nationkey"], t.nation, ["n_nationkey"], "customer.nation"),
        va.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"], "lineitem.pk"),
        va.duplicate_keys(t.orders, ["o_orderkey"], "orders.pk"),
    ]
    return so.union_all(parts)


@query("""
WITH ch AS (SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN CAST(p_size AS VARCHAR) ELSE '' END AS sup FROM part),
b AS (SELECT DISTINCT l_partkey AS k, CAST(l_suppkey AS VARCHAR) AS sup FROM lineitem WHERE l_quantity > 48 OR l_discount = 0),
v AS (SELECT k, string_agg(sup, '; ' ORDER BY sup) AS via FROM b GROUP BY 1)
SELECT ch.k, coalesce(nullif(sup, ''), via, '') AS sup FROM ch LEFT JOIN v ON ch.k = v.k""")
def bridge_parents(t):
    ch = t.part.select(c("p_partkey").alias("k"), F.when(c("p_size") > 40, c("p_size").cast("string")).otherwise("").alias("sup"))
    link = t.lineitem.select(c("l_partkey").alias("k"), c("l_suppkey").cast("string").alias("sup"), "l_quantity", "l_discount")
    return jn.bridge_parents(ch, "k", "sup", [link.where("l_quantity > 48"), link.where("l_discount = 0")])


@query(r"""
WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents), q AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS q FROM benchmark)
SELECT item_id, doc_id FROM q JOIN n ON contains(t, q)""")
def evidence_containment(t):
    return ct.locate_verbatim(t.benchmark, "item_id", "text", t.documents, "doc_id", "text")


# Quotes of one, two and three words and whole ones; a quarter are cut inside their first and last word.
@query(r"""
WITH b AS (SELECT item_id, md5(item_id::VARCHAR) AS h, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS w FROM benchmark),
k AS (SELECT item_id, h, array_to_string(CASE WHEN h < '2' THEN w[1:1] WHEN h < '6' THEN w[1:2] WHEN h < 'c' THEN w[2:4] ELSE w END, ' ') AS q FROM b),
q AS (SELECT item_id, CASE WHEN h[2] < '4' AND length(q) > 4 THEN trim(q[2:-2]) ELSE q END AS q FROM k),
d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents)
SELECT item_id, q AS quote, count(*) AS texts, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM q JOIN d ON contains(t, q) GROUP BY 1, 2""")
def evidence_short(t):
    h, w = F.md5(c("item_id").cast("string")), F.split(tx.normalize_quote(c("text")), " ")
    words = F.when(h < "2", F.slice(w, 1, 1)).when(h < "6", F.slice(w, 1, 2)).when(h < "c", F.slice(w, 2, 3)).otherwise(w)
    q = t.benchmark.select("item_id", h.alias("h"), F.array_join(words, " ").alias("q"))
    inner = F.substr("q", F.lit(2), F.length("q") - 2)
    q = q.select("item_id", F.when((F.substring("h", 2, 1) < "4") & (F.length("q") > 4), F.trim(inner)).otherwise(c("q")).alias("quote"))
    found = ph.locate(q, "item_id", "quote", t.documents, "doc_id", "text")
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("texts"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).join(q, "item_id")


# The first three words, an ellipsis, the last two; a third of the quotes have them the other way round.
@query(r"""
WITH b AS (SELECT item_id, md5(item_id::VARCHAR) < '5' AS turned, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS w FROM benchmark),
f AS (SELECT item_id, turned, array_to_string(w[1:3], ' ') AS x, array_to_string(w[-2:], ' ') AS y FROM b),
q AS (SELECT item_id, CASE WHEN turned THEN y ELSE x END AS x, CASE WHEN turned THEN x ELSE y END AS y FROM f),
d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents)
SELECT item_id, doc_id FROM q JOIN d ON contains(t, x) AND contains(t[strpos(t, x) + length(x):], y)""")
def evidence_gapped(t):
    w = F.split(tx.normalize_quote(c("text")), " ")
    x, y = F.array_join(F.slice(w, 1, 3), " "), F.array_join(F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)), " ")
    turned = F.md5(c("item_id").cast("string")) < "5"
    q = t.benchmark.select("item_id", F.when(turned, F.concat(y, F.lit("[...] "), x)).otherwise(F.concat(x, F.lit(" \u2026 "), y)).alias("quote"))
    return ph.locate(q, "item_id", "quote", t.documents, "doc_id", "text", gaps=True)


# Half of the quotes are cut to three words, a quarter are altered.
@query(r"""
WITH b AS (SELECT item_id, md5(item_id::VARCHAR) AS h, text FROM benchmark),
q AS (SELECT item_id, trim(regexp_replace(lower(CASE WHEN h < '8' THEN array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') WHEN h < 'c' THEN text || ' unseen' ELSE text END), '\s+', ' ', 'g')) AS q FROM b),
d AS (SELECT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents)
SELECT item_id, CASE WHEN count(t) > 0 THEN 'found' ELSE 'not_found' END AS status, count(t) AS texts FROM q LEFT JOIN d ON contains(t, q) GROUP BY item_id""")
def evidence_status(t):
    h = F.md5(c("item_id").cast("string"))
    quotes = t.benchmark.select("item_id", F.when(h < "8", F.substring_index("text", " ", 3)).when(h < "c", F.concat("text", F.lit(" unseen"))).otherwise(c("text")).alias("quote"))
    return ct.quote_status(quotes, "item_id", "quote", t.documents.select("doc_id", "text"), "doc_id", "text")


BG = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"


@query(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), dg AS (SELECT doc_id, {BG} AS g FROM d),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), bg AS (SELECT item_id, {BG} AS g FROM b)
SELECT item_id, doc_id, round(len(list_intersect(bg.g, dg.g)) / len(bg.g), 6) AS share FROM bg JOIN dg ON len(bg.g) > 0 WHERE len(list_intersect(bg.g, dg.g)) / len(bg.g) >= 0.75""")
def bigram_containment(t):
    return ct.bigram_share(t.benchmark, "item_id", "text", t.documents, "doc_id", "text").select("item_id", "doc_id", F.round("share", 6).alias("share"))


@query(f"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS page, unnest(string_split(text, chr(10))) AS text, len(string_split(text, chr(10))) AS n FROM documents),
p AS (SELECT doc_id, page, n, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM l),
pg AS (SELECT doc_id, page, n, t, {BG} AS g FROM p),
q AS (SELECT doc_id, page AS id, CASE WHEN md5(doc_id || '|' || page) < '4' THEN n - page + 1 WHEN md5(doc_id || '|' || page) < '8' THEN page + 1 ELSE page END AS cited,
  CASE WHEN md5('x' || doc_id || '|' || page) < '3' THEN t || ' unseen tail words here' ELSE t END AS t FROM p WHERE len(w) >= 1),
qg AS (SELECT doc_id, id, cited, t, g FROM (SELECT *, {BG} AS g FROM (SELECT *, regexp_extract_all(t, '[a-z0-9]+') AS w FROM q))),
near AS (SELECT qg.doc_id, id, bool_or(contains(pg.t, qg.t)) AS exact, max(len(list_intersect(qg.g, pg.g)) / nullif(len(qg.g), 0)) AS share FROM qg JOIN pg ON qg.doc_id = pg.doc_id AND pg.page BETWEEN cited - 1 AND cited + 1 GROUP BY 1, 2),
far AS (SELECT qg.doc_id, id, bool_or(contains(pg.t, qg.t)) AS exact, len(list_distinct(flatten(list(list_intersect(qg.g, pg.g))))) / nullif(any_value(len(qg.g)), 0) AS share FROM qg JOIN pg ON qg.doc_id = pg.doc_id GROUP BY 1, 2)
SELECT CASE WHEN near.exact THEN 'exact' WHEN near.share >= 0.75 THEN 'fuzzy' WHEN far.exact OR far.share >= 0.75 THEN 'wrong_page' ELSE 'not_found' END AS found, count(*) AS n
FROM qg LEFT JOIN near USING (doc_id, id) LEFT JOIN far USING (doc_id, id) GROUP BY 1""")
def evidence_on_page(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"), F.size(F.split("text", "\n")).alias("n"))
    pages = lines.select("doc_id", (c("i") + 1).alias("page"), "text", "n")
    tag = F.concat_ws("|", "doc_id", "page")
    h, x = F.md5(tag), F.md5(F.concat(F.lit("x"), tag))
    quotes = (pages.where(F.size(tx.words(c("text"))) >= 1)
              .select(tag.alias("qid"), "doc_id", F.when(h < "4", c("n") - c("page") + 1).when(h < "8", c("page") + 1).otherwise(c("page")).alias("page"),
                      F.when(x < "3", F.concat(tx.normalize_quote(c("text")), F.lit(" unseen tail words here"))).otherwise(c("text")).alias("quote")))
    return ct.locate_on_page(quotes, pages, "qid", "doc_id", "page", "quote", "text").groupBy("found").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH w AS (SELECT user_id, ts AS t1, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t0 FROM events WHERE event_type = 'signup')
SELECT w.user_id, t0, t1, count(*) AS n, round(sum(value), 6) AS used FROM w JOIN events e ON e.user_id = w.user_id AND e.ts BETWEEN t0 AND t1 AND event_type = 'purchase' GROUP BY 1, 2, 3""")
def usage_windows(t):
    readings = t.events.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    wins = (previous(readings, "ts", ["ts", "event_id"], F.date_trunc("day", "ts"), ["user_id"], "t0")
            .where("t0 IS NOT NULL").select("user_id", "t0", c("ts").alias("t1")))
    pts = t.events.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return (jn.interval_join(pts, wins, ["user_id"], "ts", "t0", "t1").groupBy("user_id", "t0", "t1")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("used")))


# From every urgent order a window of ten years, from every low one a window of one day to a year.
@query("""
WITH w AS (SELECT o_orderkey, o_custkey, o_orderdate AS d0, CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 10 YEAR ELSE o_orderdate + CAST(o_orderkey % 366 AS INTEGER) * INTERVAL 1 DAY END AS DATE) AS d1
  FROM (SELECT *  REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders) WHERE o_orderpriority IN ('1-URGENT', '5-LOW'))
SELECT w.o_orderkey, count(*) AS n, round(sum(p.o_totalprice), 2) AS spent FROM w JOIN orders p ON p.o_custkey = w.o_custkey AND CAST(p.o_orderdate AS DATE) BETWEEN d0 AND d1 GROUP BY 1""")
def long_windows(t):
    day = F.to_date("o_orderdate")
    end = F.when(c("o_orderpriority") == "1-URGENT", F.add_months(day, 120)).otherwise(F.date_add(day, (c("o_orderkey") % 366).cast("int")))
    w = t.orders.where("o_orderpriority IN ('1-URGENT', '5-LOW')").select("o_orderkey", "o_custkey", day.alias("d0"), end.alias("d1"))
    pts = t.orders.select("o_custkey", day.alias("day"), "o_totalprice")
    return jn.interval_join(pts, w, ["o_custkey"], "day", "d0", "d1").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent"))


@query("SELECT s_suppkey, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0) AS found FROM supplier")
def seed_recall(t):
    pool = t.lineitem.where("l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0").select(c("l_suppkey").alias("s_suppkey"))
    return jn.recall(t.supplier.select("s_suppkey"), pool, "s_suppkey")


@query("""
WITH e AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), o AS (SELECT c_nationkey AS k, count(DISTINCT c_custkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 120000 GROUP BY 1)
SELECT coalesce(e.k, o.k) AS k, coalesce(e.n, 0) AS expected, coalesce(o.n, 0) AS observed, round((coalesce(o.n, 0) - e.n) / e.n * 100, 6) AS diff_pct, abs((coalesce(o.n, 0) - e.n) / e.n * 100) <= 5 AS within FROM e FULL JOIN o ON e.k = o.k""")
def expected_observed(t):
    e = t.customer.groupBy(c("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    big = t.orders.where("o_totalprice > 120000").select(c("o_custkey").alias("c_custkey"))
    o = t.customer.join(big, "c_custkey", "left_semi").groupBy(c("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return jn.reconcile_counts(e, o, "k", 0.05).withColumn("diff_pct", F.round("diff_pct", 6))


@query(f"""
WITH r AS (SELECT page_id, {TITLE_SQL} AS tn, 2000 + CAST(regexp_extract(url, '/(\\d+)', 1) AS BIGINT) // 200 AS y, regexp_extract(html, 'lang="(\\w+)"', 1) AS lang FROM pages),
i AS (SELECT page_id AS item, substr(tn, 1, length(tn) - 2) AS tn, y + 1 AS y, lang FROM r WHERE length(tn) > 2),
s AS (SELECT item, page_id, 1 - levenshtein(i.tn, r.tn) / greatest(length(i.tn), length(r.tn)) AS score FROM i JOIN r ON i.lang = r.lang AND split_part(i.tn, ' ', 1) = split_part(r.tn, ' ', 1) AND abs(i.y - r.y) <= 1 WHERE r.tn <> ''),
b AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, page_id) AS rn FROM s WHERE score >= 0.9)
SELECT item, page_id, round(score, 6) AS score FROM b WHERE rn = 1""")
def best_candidate(t):
    tn = tx.normalize_title(c("title"))
    r = page_records(t).select(c("idx").alias("page_id"), tn.alias("tn"), c("year").cast("int").alias("y"), c("route").alias("lang")).where("tn <> ''")
    items = r.where(F.length("tn") > 2).select(c("page_id").alias("item"), F.expr("substr(tn, 1, length(tn) - 2)").alias("tn"), (c("y") + 1).alias("y"), "lang")
    return jn.best_candidate(items, r, ["lang"], "item", "page_id", "tn", "y", 0.9, 1).withColumn("score", F.round("score", 6))


@query(f"""
WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, '10.5555/' || regexp_extract(url, '/(\\d+)', 1) AS doi, regexp_replace(regexp_extract(html, '<article>.*</article>', 0, 's'), '<[^>]*>', ' ', 'g') AS body FROM pages),
n AS (SELECT page_id, doi, body, {SQL_NORM.format('body')} AS nb, list_distinct(list_filter(string_split({SQL_NORM.format('title')}, ' '), lambda w: length(w) >= 5)) AS ws FROM p),
k AS (SELECT *, len(list_filter(ws, lambda w: contains(nb, w))) AS hit FROM n)
SELECT page_id, CASE WHEN length(body) < 300 THEN 'too_short' WHEN contains(lower(body), doi) THEN 'doi' WHEN least(3, len(ws)) > 0 AND hit >= least(3, len(ws)) THEN 'title_words' ELSE 'mismatch' END AS verdict FROM k""")
def document_verification(t):
    body = F.regexp_replace(F.regexp_extract("html", "(?s)<article>.*</article>", 0), "<[^>]*>", " ")
    doi = F.concat(F.lit("10.5555/"), F.regexp_extract("url", r"/(\d+)", 1))
    return t.pages.select("page_id", jn.verify_document(F.regexp_extract("html", "<title>([^<]*)</title>", 1), doi, body, min_chars=300).alias("verdict"))


@query(r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a[^>]*href="[^"]*"[^>]*>([^<]*)</a>', 1)) AS label, generate_subscripts(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>[^<]*</a>', 1), 1) AS i FROM pages),
r AS (SELECT page_id, href, i, CASE WHEN regexp_matches(lower(href), '\.pdf($|[?#])') THEN 1 WHEN regexp_matches(lower(href), '/pdf') THEN 2 WHEN regexp_matches(lower(label), 'the|der') THEN 3 END AS rank FROM a),
b AS (SELECT page_id, arg_min(href, (rank, i)) AS href FROM r WHERE rank IS NOT NULL GROUP BY 1)
SELECT p.page_id, CASE WHEN b.href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || b.href ELSE b.href END AS link FROM pages p LEFT JOIN b USING (page_id)""")
def best_link(t):
    from ..sources.pages import best_link as op
    return t.pages.select("page_id", op(c("html"), c("url"), label_pattern="the|der").alias("link"))


@query("""
SELECT s.conv_id AS id, CASE WHEN f.ok THEN f.role ELSE 'system' END AS role, CASE WHEN f.ok THEN 'read' ELSE 'AWAITING' END AS state, f.ok IS NULL AS defaulted
FROM (SELECT DISTINCT conv_id FROM conversations) s LEFT JOIN (SELECT conv_id, arg_min(role, turn) AS role, true AS ok FROM conversations GROUP BY 1 HAVING count(*) >= 4) f USING (conv_id)""")
def spine_defaults(t):
    res = t.conversations.groupBy(c("conv_id").alias("id")).agg(F.min_by("role", "turn").alias("role"), F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("read"))
    return jn.spine_with_defaults(t.conversations.select(c("conv_id").alias("id")).distinct(), res, "id", c("n") >= 4, {"role": "system", "state": "AWAITING"})


@query(f"""
WITH r AS (SELECT page_id, {TITLE_SQL} AS tn, md5('k' || page_id) AS h FROM pages),
k AS (SELECT CASE WHEN h < '2' THEN '' ELSE CAST(page_id AS VARCHAR) END AS id, page_id, CASE WHEN h > 'c' THEN substr(tn, 8) ELSE tn END AS tn FROM r), g AS (SELECT CAST(page_id AS VARCHAR) AS id, tn FROM r WHERE h < 'f'),
j AS (SELECT k.page_id, k.id, g.tn AS rt, CASE WHEN length(trim(k.tn)) = 0 OR length(g.tn) = 0 THEN 0 ELSE 1 - levenshtein(trim(k.tn), g.tn) / greatest(length(trim(k.tn)), length(g.tn)) END AS s FROM k LEFT JOIN g ON k.id = g.id)
SELECT page_id, round(CASE WHEN rt IS NOT NULL THEN s END, 6) AS score, CASE WHEN id = '' THEN 'no_id' WHEN rt IS NULL THEN 'lookup_failed' WHEN s > 0.8 THEN 'identity_match' ELSE 'title_review_needed' END AS verdict FROM j""")
def identity_check(t):
    h = F.md5(F.concat(F.lit("k"), c("page_id").cast("string")))
    r = t.pages.select("page_id", tx.normalize_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), h.alias("h"))
    claims = r.select(F.when(c("h") < "2", "").otherwise(c("page_id").cast("string")).alias("id"), "page_id",
                      F.when(c("h") > "c", F.expr("substr(title, 8)")).otherwise(c("title")).alias("title"))
    reg = r.where("h < 'f'").select(c("page_id").cast("string").alias("id"), "title")
    return jn.identity_check(claims, reg, "id", "title").select("page_id", F.round("score", 6).alias("score"), "verdict")


# --- sets -----------------------------------------------------------------------------------------

@query("""
SELECT 'union' AS part, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)
UNION ALL SELECT 'both', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)
UNION ALL SELECT 'only_a', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)
UNION ALL SELECT 'only_b', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def id_sets(t):
    return so.set_counts(t.lineitem.where("l_quantity > 45"), t.lineitem.where("l_discount > 0.08"), "l_partkey")


@query("""
SELECT 'disjoint' AS check_name, count(*) = 0 AS holds FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O')
UNION ALL SELECT 'covering', (SELECT count(*) FROM orders WHERE o_orderstatus IS NULL) = 0
UNION ALL SELECT 'no_extra', true""")
def partition_proof(t):
    o = t.orders.select("o_orderkey", "o_orderstatus")
    return so.partition_proof([o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O'")], o, "o_orderkey")


@query("""
WITH s AS (SELECT o_orderstatus AS part, o_custkey AS k FROM orders)
SELECT count(DISTINCT (part, k)) AS part_total, count(DISTINCT k) AS unique_total, count(DISTINCT (part, k)) - count(DISTINCT k) AS overlap, count(DISTINCT k) = (SELECT count(DISTINCT o_custkey) FROM orders) AS complete FROM s""")
def partition_completeness(t):
    return so.partition_completeness(t.orders.select(c("o_orderstatus").alias("part"), c("o_custkey").alias("k")), "part", "k",
                                     t.orders.select(c("o_custkey").alias("k")))


@query("""
WITH r AS (SELECT 'A' AS src, o_custkey AS k, o_orderpriority AS via FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'B', o_custkey, o_orderstatus FROM orders WHERE o_orderpriority LIKE '1%'),
d AS (SELECT k, count(*) AS rows, list_sort(list_distinct(list(src))) AS s, list_sort(list_distinct(list(via))) AS v FROM r GROUP BY 1)
SELECT k, rows, array_to_string(s, ';') AS src, array_to_string(v, ';') AS via FROM d""")
def union_provenance(t):
    a = t.orders.where("o_totalprice > 400000").select(F.lit("A").alias("src"), c("o_custkey").alias("k"), c("o_orderpriority").alias("via"))
    b = t.orders.where("o_orderpriority LIKE '1%'").select(F.lit("B").alias("src"), c("o_custkey").alias("k"), c("o_orderstatus").alias("via"))
    return so.union_provenance([a, b], c("k"), "k", ["src", "via"])


@query("""
WITH r AS (SELECT DISTINCT l_returnflag AS route, l_partkey AS id FROM lineitem WHERE l_quantity > 40), g AS (SELECT id, string_agg(route, '+' ORDER BY route) AS routes FROM r GROUP BY 1)
SELECT routes, count(*) AS n FROM g GROUP BY 1""")
def route_overlap(t):
    return so.route_overlap(t.lineitem.where("l_quantity > 40").select(c("l_returnflag").alias("route"), c("l_partkey").alias("id")), "route", "id")


@query("""
SELECT kind, key, amount, extra FROM (SELECT 'order' AS kind, o_orderkey AS key, o_totalprice AS amount, o_orderstatus AS extra FROM orders UNION ALL SELECT 'part', p_partkey, p_retailprice, NULL FROM part)""")
def union_heterogeneous(t):
    a = t.orders.select(F.lit("order").alias("kind"), c("o_orderkey").alias("key"), c("o_totalprice").alias("amount"), c("o_orderstatus").alias("extra"))
    b = t.part.select(F.lit("part").alias("kind"), c("p_partkey").alias("key"), c("p_retailprice").alias("amount"))
    return so.union_all([a, b])


# --- sorts and top-k ------------------------------------------------------------------------------

@query("""
SELECT o_orderkey, o_orderpriority, y, row_number() OVER (ORDER BY o_orderpriority, y DESC, o_orderkey) AS position
FROM (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE year(o_orderdate) END AS y FROM orders)""")
def priority_year_sort(t):
    y = F.when(c("o_orderstatus") == "P", "n.d.").otherwise(F.year("o_orderdate").cast("string"))
    df = t.orders.select("o_orderkey", "o_orderpriority", F.coalesce(y.try_cast("int"), F.lit(0)).alias("y"))
    return number_rows(df, ["o_orderpriority", F.desc("y"), "o_orderkey"], name="position")


@query("""
WITH g AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS rank FROM g)
SELECT p_type, p_brand, n, rank FROM k WHERE rank <= 3""")
def top_k_per_group(t):
    g = t.part.groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return so.top_k(g, ["p_type"], [F.desc("n"), c("p_brand")], 3)


@query("""
SELECT c_custkey, c_mktsegment, rank FROM (SELECT c_custkey, c_mktsegment, list_position(['MACHINERY', 'BUILDING', 'AUTOMOBILE'], c_mktsegment) AS rank FROM customer)""")
def external_rank_sort(t):
    order = ["MACHINERY", "BUILDING", "AUTOMOBILE"]
    return so.sort_by_list(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", order)


@query("""
SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ORDER BY o_orderkey LIMIT 100""")
def head_after_exclusion(t):
    ex = t.customer.where("c_acctbal < 0").select(c("c_custkey").alias("o_custkey"))
    return t.orders.join(ex, "o_custkey", "left_anti").select("o_orderkey").orderBy("o_orderkey").limit(100)
