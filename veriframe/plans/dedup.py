"""Deduplication of page records (title, identifiers, year) and of whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dedup as dd
from ..operators import fuzzy as fz
from ..session import cut_lineage
from .registry import query
from .text import SQL_NORM

c = F.col


def page_records(t) -> DataFrame:
    """Every page as an ingest record: title and abstract from the HTML, identifiers and year from the URL."""
    n = F.regexp_extract("url", r"/(\d+)", 1).cast("bigint")
    lang = F.regexp_extract("html", r'lang="(\w+)"', 1)
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return t.pages.select(
        c("page_id").alias("idx"), F.lit("pages").alias("source_file"), c("page_id").alias("source_row"),
        F.regexp_extract("url", r"example\.(\w+)", 1).alias("source_database"), lang.alias("route"), F.lit("").alias("search_id"),
        F.when(c("url").startswith("http:"), (100000 + n).cast("string")).otherwise("").alias("pmid"),
        F.when(c("url").rlike(r"^https:[^?#]*$"), F.concat(F.lit("https://doi.org/10.5555/"), n)).otherwise("").alias("doi"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        (2000 + F.floor(n / 200)).cast("int").alias("year"),
        F.when(host.startswith("blog."), "preprint server").otherwise(host).alias("journal"),
        F.when(host.startswith("m."), F.array().cast("array<string>")).otherwise(F.array(F.concat(lang, F.lit(", A. B.")))).alias("authors"),
        F.regexp_extract("html", "<p>([^<]*)</p>", 1).alias("abstract"), F.array().cast("array<string>").alias("pubtypes"))


REC_SQL = f"""rec AS (
  SELECT page_id AS idx, regexp_extract(url, 'example\\.(\\w+)', 1) AS db, regexp_extract(html, 'lang="(\\w+)"', 1) AS lang,
    CASE WHEN url LIKE 'http:%' THEN CAST(100000 + n AS VARCHAR) ELSE '' END AS pmid,
    CASE WHEN regexp_matches(url, '^https:[^?#]*$') THEN '10.5555/' || n ELSE '' END AS doi,
    title, {SQL_NORM.format('title')} AS tn, 2000 + n // 200 AS year, regexp_matches(url, '://blog[.]') AS preprint,
    regexp_matches(url, '://m[.]') AS no_authors, regexp_extract(html, '<p>([^<]*)</p>', 1) AS abstract,
    CASE WHEN regexp_matches(url, '://blog[.]') THEN 'preprint server' ELSE regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) END AS journal
  FROM (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(regexp_extract(url, '/(\\d+)', 1) AS BIGINT) AS n FROM pages)),
prs AS (
  SELECT a.idx AS i, b.idx AS j, 1 - levenshtein(a.tn, b.tn) / greatest(length(a.tn), length(b.tn)) AS score,
    a.doi <> '' AND b.doi <> '' AND a.doi <> b.doi AS doi_conflict, a.pmid <> '' AND b.pmid <> '' AND a.pmid <> b.pmid AS pmid_conflict,
    a.preprint OR b.preprint AS preprint, a.no_authors OR b.no_authors OR a.lang = b.lang AS overlap
  FROM rec a JOIN rec b ON a.idx < b.idx AND split_part(a.tn, ' ', 1) = split_part(b.tn, ' ', 1) AND abs(a.year - b.year) <= 1
  WHERE a.tn <> '' AND b.tn <> ''),
edge AS (
  SELECT a.idx AS i, b.idx AS j, 0 AS rank, NULL::DOUBLE AS score FROM rec a JOIN rec b ON a.idx < b.idx AND a.pmid = b.pmid AND a.pmid <> ''
  UNION ALL SELECT a.idx, b.idx, 1, NULL::DOUBLE FROM rec a JOIN rec b ON a.idx < b.idx AND a.doi = b.doi AND a.doi <> ''
  UNION ALL SELECT i, j, 2, score FROM prs WHERE score >= 0.95 AND NOT doi_conflict AND NOT pmid_conflict),
dir AS (SELECT i, j FROM edge UNION SELECT j, i FROM edge),
reach(node, label) AS (SELECT idx, idx FROM rec UNION SELECT dir.j, reach.label FROM reach JOIN dir ON reach.node = dir.i),
grp AS (SELECT node AS idx, min(label) AS g FROM reach GROUP BY 1),
ids AS (SELECT g, printf('FS-%06d', row_number() OVER (ORDER BY g)) AS record_id FROM (SELECT DISTINCT g FROM grp)),
ends AS (SELECT i AS idx, rank, score FROM edge UNION ALL SELECT j, rank, score FROM edge),
best AS (SELECT idx, arg_min(rank, rank) AS rank, max(score) FILTER (WHERE rank = 2) AS score FROM ends GROUP BY 1),
rule AS (SELECT idx, rank, CASE rank WHEN 0 THEN 'pmid' WHEN 1 THEN 'doi' ELSE printf('title_year_fuzzy(%.3f)', score) END AS match_rule FROM best),
repx AS (SELECT g, arg_min(idx, (CASE WHEN abstract = '' THEN 1 ELSE 0 END, CASE WHEN doi = '' THEN 1 ELSE 0 END,
  CASE WHEN pmid = '' THEN 1 ELSE 0 END, -length(title), idx)) AS rep FROM rec JOIN grp USING (idx) GROUP BY 1)"""


@query(f"""
WITH k AS (SELECT doc_id, lang, source, {SQL_NORM.format('text')} AS tn FROM documents),
g AS (SELECT md5(tn) AS text_md5, min(doc_id) AS kept_doc, count(*) AS copies, count(DISTINCT lang) AS n_langs, count(DISTINCT source) AS n_sources FROM k GROUP BY tn)
SELECT * FROM g""")
def dedup_exact_groups(t):
    return (t.documents.select("doc_id", "lang", "source", F.md5(tx.normalize_title(c("text"))).alias("text_md5"))
            .groupBy("text_md5").agg(F.min("doc_id").alias("kept_doc"), F.count(F.lit(1)).alias("copies"),
                                     F.count_distinct("lang").alias("n_langs"), F.count_distinct("source").alias("n_sources")))


@query(f"""
WITH tt AS (SELECT min(page_id) AS id, tn FROM (SELECT page_id, {SQL_NORM.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS tn FROM pages) WHERE tn <> '' GROUP BY tn)
SELECT a.id AS id_a, b.id AS id_b, round(1 - levenshtein(a.tn, b.tn) / greatest(length(a.tn), length(b.tn)), 6) AS score
FROM tt a JOIN tt b ON a.id < b.id AND split_part(a.tn, ' ', 1) = split_part(b.tn, ' ', 1)
WHERE 1 - levenshtein(a.tn, b.tn) / greatest(length(a.tn), length(b.tn)) >= 0.8""")
def fuzzy_title_pairs(t):
    titles = (t.pages.select("page_id", tx.normalize_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
              .where("title <> ''").groupBy("title").agg(F.min("page_id").alias("title_id"))
              .withColumn("block", fz.first_token(c("title"))))
    return fz.similar_titles(titles, "levenshtein", 0.8).select("id_a", "id_b", F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {REC_SQL} SELECT idx, g AS group_idx FROM grp")
def dedup_components(t):
    return dd.deduplicate(page_records(t), metric="levenshtein").groups


@query()
def dedup_components_indel(t):
    return dd.deduplicate(page_records(t), metric="indel").groups


@query()
def dedup_components_strict(t):
    return dd.deduplicate(page_records(t), conflict_policy="strict").groups


@query(f"""WITH RECURSIVE {REC_SQL}
SELECT rec.idx AS input_index, ids.record_id AS dedup_group_id, CASE WHEN repx.rep = rec.idx THEN 'TRUE' ELSE 'FALSE' END AS kept,
  coalesce(rule.match_rule, '') AS match_rule, rec.pmid, rec.doi FROM rec JOIN grp USING (idx) JOIN ids USING (g) JOIN repx USING (g) LEFT JOIN rule ON rule.idx = rec.idx""")
def dedup_audit_map(t):
    return dd.deduplicate(page_records(t), metric="levenshtein").audit.select(
        "input_index", "dedup_group_id", "kept", "match_rule", "pmid", "doi")


@query(f"""WITH RECURSIVE {REC_SQL},
m AS (SELECT rec.*, g, CASE WHEN rec.idx = rep THEN -1 ELSE rec.idx END AS pos FROM rec JOIN grp USING (idx) JOIN repx USING (g)),
l AS (SELECT g, string_agg(db, ';' ORDER BY first_at) AS source_database FROM (SELECT g, db, min(idx) AS first_at FROM m GROUP BY 1, 2) GROUP BY 1),
l2 AS (SELECT g, string_agg(lang, ';' ORDER BY first_at) AS route FROM (SELECT g, lang, min(idx) AS first_at FROM m GROUP BY 1, 2) GROUP BY 1)
SELECT ids.record_id, any_value(l.source_database) AS source_database, any_value(l2.route) AS route, coalesce(arg_min(title, pos) FILTER (WHERE title <> ''), '') AS title,
  coalesce(arg_min(lang || ', A. B.', pos) FILTER (WHERE NOT no_authors), '') AS authors, CAST(arg_min(year, pos) AS VARCHAR) AS year, arg_min(journal, pos) AS journal,
  coalesce(arg_min(doi, pos) FILTER (WHERE doi <> ''), '') AS doi, coalesce(arg_min(pmid, pos) FILTER (WHERE pmid <> ''), '') AS pmid,
  md5(coalesce(arg_min(abstract, pos) FILTER (WHERE abstract <> ''), '')) AS abstract_md5, coalesce(arg_min(db, pos) FILTER (WHERE abstract <> ''), '') AS abstract_source
FROM m JOIN ids USING (g) JOIN l USING (g) JOIN l2 USING (g) GROUP BY 1""")
def golden_record(t):
    m = dd.deduplicate(page_records(t), metric="levenshtein").master
    return m.select("record_id", "source_database", "route", "title", "authors", "year", "journal", "doi", "pmid",
                    F.md5("abstract").alias("abstract_md5"), "abstract_source")


@query(f"""WITH RECURSIVE {REC_SQL},
t AS (SELECT tn, min(idx) AS title_id FROM rec GROUP BY 1), f AS (SELECT i, j, score FROM prs WHERE score >= 0.95 AND doi_conflict AND overlap AND preprint),
d AS (SELECT i, j, score FROM f UNION ALL SELECT j, i, score FROM f)
SELECT i AS idx, title_id, round(max(score), 6) AS score FROM d JOIN rec ON rec.idx = j JOIN t USING (tn) GROUP BY 1, 2""")
def version_flags(t):
    notes = cut_lineage(dd.annotate(page_records(t)))
    pairs = dd.title_pairs(notes, 0.95, 1, "levenshtein")
    return dd.version_flags(notes, pairs, 1).select("idx", "title_id", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {REC_SQL},
m AS (SELECT grp.g, bool_or(abstract <> '') AS a, bool_or(pmid <> '') AS p, bool_or(doi <> '') AS d FROM rec JOIN grp USING (idx) GROUP BY 1)
SELECT 'input' AS section, 'total' AS item, count(*) AS value FROM rec
UNION ALL SELECT 'input_by_database', db, count(*) FROM rec GROUP BY db
UNION ALL SELECT 'input_by_route', lang, count(*) FROM rec GROUP BY lang
UNION ALL SELECT 'removed_by_rule', CASE rank WHEN 0 THEN 'pmid' WHEN 1 THEN 'doi' ELSE 'title_year_fuzzy' END, count(*)
  FROM rec JOIN grp USING (idx) JOIN repx USING (g) JOIN rule ON rule.idx = rec.idx WHERE rep <> rec.idx GROUP BY 2
UNION ALL SELECT 'unique', 'total', count(*) FROM m
UNION ALL SELECT 'unique_by_field', 'abstract' || CASE WHEN a THEN '_with' ELSE '_without' END, count(*) FROM m GROUP BY 2
UNION ALL SELECT 'unique_by_field', 'pmid' || CASE WHEN p THEN '_with' ELSE '_without' END, count(*) FROM m GROUP BY 2
UNION ALL SELECT 'unique_by_field', 'doi' || CASE WHEN d THEN '_with' ELSE '_without' END, count(*) FROM m GROUP BY 2""")
def dedup_summary(t):
    return dd.identification_summary(dd.deduplicate(page_records(t), metric="levenshtein"))


@query("""
WITH w AS (SELECT string_split(p_name, ' ')[1] AS word, p_size, count(*) AS n FROM part GROUP BY 1, 2) SELECT word, p_size, n, n > 5 AS large FROM w""")
def block_sizes(t):
    p = t.part.select(fz.first_token(c("p_name")).alias("word"), "p_size")
    return fz.block_sizes(p, ["word", "p_size"], 5)


@query(f"""WITH {REC_SQL}, w AS (SELECT *, 'FS/' || idx AS rid FROM rec)
SELECT idx, CASE WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE '' END AS doi_link, CASE WHEN pmid <> '' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' ELSE '' END AS pubmed_link,
  CASE WHEN pmid <> '' THEN 'https://europepmc.org/article/MED/' || pmid WHEN doi <> '' THEN 'https://europepmc.org/abstract/DOI/' || doi ELSE '' END AS mirror_link,
  CASE WHEN trim(title) <> '' THEN 'https://scholar.google.com/scholar?q=' || replace(url_encode('"' || trim(title) || '"'), '%2F', '/') ELSE '' END AS title_link,
  'FS_' || idx || '.pdf' AS save_as, CASE WHEN no_authors THEN CAST(year AS VARCHAR) ELSE lang || ', A. B., ' || year END AS label FROM w""")
def record_links(t):
    r = page_records(t).withColumn("doi_norm", tx.normalize_doi(c("doi")))
    links = tx.record_links(c("doi_norm"), c("pmid"), c("title"), F.concat(F.lit("FS/"), c("idx").cast("string")))
    return r.select("idx", *[v.alias(k) for k, v in links.items()], tx.author_year(F.array_join("authors", "; "), c("year")).alias("label"))
