"""Parser, source and streaming queries. The export texts are written by Spark from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators import containment as ct
from ..session import ensure_checkpoint_dir
from ..sources import articles, bibtex, csv_lines, discover, nested, records, runs, sinks, tagged
from ..streaming import ledger as sl
from .registry import query

c = F.col

FIELDS = ["source_database", "pmid", "doi", "title", "year", "journal", "abstract"]
PAGE_SQL = r"""pg AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(regexp_extract(url, '/(\d+)', 1) AS BIGINT) AS n, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(html, 'lang="(\w+)"', 1) AS lang, url FROM pages),
ps AS (SELECT *, trim(regexp_replace(title, '\s+', ' ', 'g')) AS ts, 2000 + n // 200 AS y, '10.5555/' || n AS doi, CAST(100000 + n AS VARCHAR) AS pm FROM pg)"""


def page_fields(t):
    n = F.regexp_extract("url", r"/(\d+)", 1).cast("bigint")
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), n.alias("n"), (2000 + F.floor(n / 200)).cast("string").alias("y"),
                          F.concat(F.lit("10.5555/"), n.cast("string")).alias("doi"), (100000 + n).cast("string").alias("pm"),
                          F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("html", r'lang="(\w+)"', 1).alias("lang"), "url")


@query(r"""
WITH e AS (SELECT event_type, CASE WHEN value < 2 THEN '{"k": ' WHEN value < 3 THEN '[1, 2]' ELSE props END AS line, props, value FROM events)
SELECT event_type, count(*) FILTER (WHERE value >= 3) AS parsed, count(*) FILTER (WHERE value < 3) AS bad, coalesce(sum(CAST(regexp_extract(props, '\d+') AS BIGINT)) FILTER (WHERE value >= 3), 0)::BIGINT AS total FROM e GROUP BY 1""")
def json_lines_scan(t):
    line = F.when(c("value") < 2, '{"k": ').when(c("value") < 3, "[1, 2]").otherwise(c("props"))
    out = records.parse_json_lines(t.events.select("event_type", line.alias("line")), "line", T.StructType([T.StructField("k", T.LongType())]))
    return out.groupBy("event_type").agg(F.count_if(c(records.BAD).isNull()).alias("parsed"), F.count(records.BAD).alias("bad"), F.coalesce(F.sum("k"), F.lit(0)).alias("total"))


@query(f"""WITH {PAGE_SQL} SELECT page_id, CASE WHEN n < 500 THEN 'Scopus' ELSE 'PubMed/MEDLINE' END AS source_database, CASE WHEN n < 500 THEN '' ELSE pm END AS pmid, doi, title, CAST(y AS VARCHAR) AS year, host AS journal, CASE WHEN n < 500 THEN 1 ELSE 2 END AS n_authors FROM ps""")
def json_layouts(t):
    p = page_fields(t)
    second = F.to_json(F.struct(c("doi").alias("prism:doi"), c("title").alias("dc:title"), F.concat("y", F.lit("-05-01")).alias("prism:coverDate"), c("host").alias("prism:publicationName"), F.lit("Sole, A.").alias("dc:creator")))
    first = F.to_json(F.struct(c("pm").alias("pmid"), "doi", "title", c("y").alias("year"), c("host").alias("journal"), F.array(F.lit("One, A."), F.lit("Two, B.")).alias("authors")))
    lines = p.select(c("page_id").alias("source_seq"), F.when(c("n") < 500, second).otherwise(first).alias("line"))
    r = records.json_records(records.parse_json_lines(lines, "line", records.JSON_SCHEMA))
    return r.select(c("source_seq").alias("page_id"), *FIELDS[:-1], F.size("authors").cast("bigint").alias("n_authors"))


@query(f"""WITH {PAGE_SQL} SELECT page_id, 'Scopus' AS source_database, pm AS pmid, doi, title, CAST(y AS VARCHAR) AS year, host AS journal, 2 AS n_authors FROM ps""")
def csv_synonyms(t):
    p = page_fields(t)
    df = p.select(c("page_id").alias("source_seq"), c("title").alias("Article Title"), F.concat(c("lang"), F.lit(", A.; ; Two, B.")).alias("Author(s)"), c("y").alias("PubYear"),
                  c("host").alias("Source title"), c("doi").alias("DOI"), c("pm").alias("PubMed ID"), F.lit("e1").alias("EID"))
    return records.csv_records(df).select(c("source_seq").alias("page_id"), *FIELDS[:-1], F.size("authors").cast("bigint").alias("n_authors"))


@query(f"""WITH {PAGE_SQL} SELECT page_id, CASE WHEN n < 300 THEN '' ELSE pm END AS pmid, doi, ts AS title, CASE WHEN n < 300 THEN '' ELSE CAST(y AS VARCHAR) END AS year, 'Web of Science Core Collection' AS source_database, host AS journal, '' AS abstract, n < 300 AS lenient FROM ps""")
def tsv_scan(t):
    p = page_fields(t)
    full = F.concat_ws("\t", F.lit("J"), F.concat("lang", F.lit(", A; Two, B")), F.trim("title"), "host", "doi", "y", "pm", F.lit(""))
    short = F.concat_ws("\t", F.lit("J"), F.lit("Z"), F.trim("title"), "host", "doi")
    lines = p.select(c("page_id").alias("source_seq"), F.when(c("n") < 300, short).otherwise(full).alias("value"))
    r = tagged.tsv_records(tagged.parse_delimited(lines, ["PT", "AU", "TI", "SO", "DI", "PY", "PM"]))
    return r.select(c("source_seq").alias("page_id"), *[x for x in FIELDS if x != "title"], tx.squeeze(c("title")).alias("title"), "lenient")


RIS_SQL = f"""WITH {PAGE_SQL} SELECT page_id, CASE WHEN n < 400 THEN 'Scopus' ELSE '' END AS source_database, CASE WHEN n < 700 THEN pm ELSE '' END AS pmid, CASE WHEN n < 800 THEN doi ELSE '' END AS doi, ts AS title,
  CAST(y AS VARCHAR) AS year, host AS journal, 'An abstract.' AS abstract, 2 AS n_authors, n >= 800 AS lenient FROM ps"""


def ris_chunks(t):
    """One export record per page: glued tags, repeated tags, an id in an odd tag, and some without an end tag."""
    p = page_fields(t)
    pm = F.when(c("n") < 200, F.concat(F.lit("\nPM  - "), c("pm"))).when(c("n") < 400, F.concat(F.lit("\nAN  - WOS:000123\nC2  - "), c("pm"))) \
        .when(c("n") < 700, F.concat(F.lit("\nN1  - see PMID: "), c("pm"))).otherwise("")
    body = F.concat(F.lit("JOUR\nTI  - "), c("title"), F.lit("\nAU  - One, A\nAU  - Two, BPY  - "), c("y"), F.lit("\nT2  - "), c("host"), F.lit("\nAB  - An\n  abstract."),
                    F.when(c("n") < 400, "\nDB  - Scopus").otherwise(""), pm, F.when(c("n") < 800, F.concat(F.lit("DO  - "), c("doi"), F.lit("\nER  - \n"))).otherwise("\n"))
    return p.select(c("page_id").alias("source_seq"), body.alias("chunk"))


@query(RIS_SQL)
def ris_scan(t):
    parsed = tagged.parse_ris(ris_chunks(t))
    r = tagged.ris_records(parsed).join(parsed.select("source_seq", "lenient"), "source_seq")
    return r.select(c("source_seq").alias("page_id"), *FIELDS, F.size("authors").cast("bigint").alias("n_authors"), "lenient")


@query(f"""WITH {PAGE_SQL} SELECT page_id, 'Web of Science Core Collection' AS source_database, pm AS pmid, doi, trim(ts || ' continued') AS title, CAST(y AS VARCHAR) AS year, host AS journal, 'First line second line' AS abstract, 3 AS n_authors, 1 AS stray_lines FROM ps""")
def tagged_scan(t):
    p = page_fields(t)
    chunk = F.concat(F.lit("FN Export\nVR 1.0\nPT J\nAU One, A\n   Two, B\n   Three, C\nTI "), F.trim("title"), F.lit("\n   continued\nSO "), c("host"), F.lit("\nstray text\nPY "), c("y"),
                     F.lit("\nAB First line\n   second line\nDI "), c("doi"), F.lit("\nPM "), c("pm"))
    r = tagged.tagged_records(p.select(c("page_id").alias("source_seq"), chunk.alias("chunk")))
    return r.select(c("source_seq").alias("page_id"), *[x for x in FIELDS if x != "title"], tx.squeeze(c("title")).alias("title"), F.size("authors").cast("bigint").alias("n_authors"), c("stray_lines").cast("bigint").alias("stray_lines"))


@query(f"""WITH {PAGE_SQL} SELECT page_id, 'Scopus' AS source_database, pm AS pmid, doi, trim(replace(replace(title, '{{', ''), '}}', '')) || ' {{DNA}}' AS title, CAST(y AS VARCHAR) AS year, host AS journal, CASE WHEN n < 500 THEN 'cut here' ELSE 'x = {{y}} whole' END AS abstract, 2 AS n_authors FROM ps""")
def bibtex_scan(t):
    p = page_fields(t)
    title = F.trim(F.replace(F.replace(c("title"), F.lit("{"), F.lit("")), F.lit("}"), F.lit("")))
    entry = F.concat(F.lit("key1,\n author = {One, A. and Two, B.},\n title = {"), title, F.lit(" {DNA}},\n abstract = {"), F.when(c("n") < 500, "cut here}(and lost").otherwise("x = {y} whole"),
                     F.lit("},\n year = {"), c("y"), F.lit("},\n journal = {"), c("host"), F.lit("},\n doi = {"), c("doi"), F.lit("},\n pmid = {"), c("pm"), F.lit("}\n}\n"))
    r = bibtex.bibtex_records(p.select(c("page_id").alias("source_seq"), entry.alias("entry")))
    return r.select(c("source_seq").alias("page_id"), *FIELDS, F.size("authors").cast("bigint").alias("n_authors"))


@query(f"""WITH {PAGE_SQL} SELECT page_id, 'PubMed/MEDLINE' AS source_database, pm AS pmid, CASE WHEN n < 500 THEN doi ELSE 'e-' || n END AS doi, 'T' || n AS title, CAST(y AS VARCHAR) AS year, host AS journal, 'AIM: To see. Plain.' AS abstract, 'Roe J;The Group' AS authors, 'D;D/q1' AS mesh FROM ps""")
def xml_articles(t):
    p = page_fields(t)
    ids = F.when(c("n") < 500, F.concat(F.lit('<PubmedData><ArticleIdList><ArticleId IdType="pubmed">1</ArticleId><ArticleId IdType="doi">'), c("doi"), F.lit("</ArticleId></ArticleIdList></PubmedData>"))) \
        .otherwise('<PubmedData><ArticleIdList><ArticleId IdType="pubmed">1</ArticleId></ArticleIdList></PubmedData>')
    date = F.when(c("n") < 300, F.concat(F.lit("<Year>"), c("y"), F.lit("</Year>"))).otherwise(F.concat(F.lit("<MedlineDate>Winter "), c("y"), F.lit("</MedlineDate>")))
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), c("pm"), F.lit("</PMID><Article><Journal><JournalIssue><PubDate>"), date, F.lit("</PubDate></JournalIssue><Title>"), c("host"),
        F.lit("</Title></Journal><ArticleTitle>T"), c("n").cast("string"), F.lit('</ArticleTitle><ELocationID EIdType="doi">e-'), c("n").cast("string"),
        F.lit('</ELocationID><Abstract><AbstractText Label="AIM">To see.</AbstractText><AbstractText>Plain.</AbstractText></Abstract><AuthorList><Author><LastName>Roe</LastName><Initials>J</Initials></Author>'
              '<Author><CollectiveName>The Group</CollectiveName></Author></AuthorList></Article><MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="Y">D</DescriptorName>'
              '<QualifierName MajorTopicYN="Y">q1</QualifierName><QualifierName MajorTopicYN="N">q2</QualifierName></MeshHeading></MeshHeadingList></MedlineCitation>'), ids, F.lit("</PubmedArticle>"))
    df = p.select(c("page_id").alias("key"), F.from_xml(xml, articles.ARTICLE_SCHEMA).alias("x")).select("key", "x.*")
    r = articles.article_records(df)
    return r.select(c("key").alias("page_id"), *FIELDS, F.array_join("authors", ";").alias("authors"), F.array_join("mesh", ";").alias("mesh"))


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(url, 'blog') THEN 'Blog' WHEN regexp_matches(url, '/en/') THEN 'English' ELSE '' END AS label, CASE WHEN regexp_matches(url, '/en/') AND NOT regexp_matches(url, 'blog') THEN 'S1' ELSE '' END AS search_id FROM pages""")
def path_labels(t):
    r = t.pages.select("page_id", discover.path_label(c("url"), [("blog", "Blog"), ("/en/", "English")]).alias("label"))
    known = r.select(F.lit("English").alias("label"), F.lit("S1").alias("sid")).distinct()
    return r.join(known, "label", "left").select("page_id", "label", F.coalesce("sid", F.lit("")).alias("search_id"))


@query("""
WITH v AS (SELECT conv_id, role, turn, length(text) AS len, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, role, turn, len, (SELECT count(*) FROM v o WHERE o.conv_id = v.conv_id AND o.role = v.role AND o.rn > 1) AS superseded FROM v WHERE rn = 1""")
def batch_supersede(t):
    rows = t.conversations.select(F.concat_ws("|", "conv_id", "role").alias("id"), "conv_id", "role", "turn", F.length("text").cast("bigint").alias("len"), F.format_string("batch_%03d.json", "turn").alias("file"))
    last, old = runs.latest_batches(rows, "id")
    n = old.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return last.join(n, "id", "left").select("conv_id", "role", "turn", "len", F.coalesce("n", F.lit(0)).alias("superseded"))


@query("""
WITH f AS (SELECT conv_id, turn, role = 'user' AS is_final, length(text) AS len FROM conversations), h AS (SELECT conv_id, bool_or(is_final) AS hf FROM f GROUP BY 1)
SELECT conv_id, count(*) AS n_rows, count(*) FILTER (WHERE len > 100 AND len <= 1000) AS n_valid FROM f JOIN h USING (conv_id) WHERE is_final OR NOT hf GROUP BY 1""")
def run_files(t):
    f = t.conversations.select("conv_id", F.concat(F.when(c("role") == "user", "").otherwise("checkpoint_"), F.lit("b"), c("turn")).alias("file"),
                               F.when(F.length("text") > 100, c("text")).alias("parsed"), F.when(F.length("text") > 1000, F.array(F.lit("too long"))).alias("errors"))
    out = runs.split_valid(runs.prefer_final(f, "conv_id"), "parsed", "errors")
    return out.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("valid").alias("n_valid"))


@query("""
WITH r AS (SELECT event_id, user_id, CASE WHEN value < 0.5 THEN 'unreadable_json' WHEN event_type = 'error' THEN 'run_marked_invalid' WHEN value < 1 THEN 'missing_parsed_record' WHEN value > 90 THEN 'schema_invalid' WHEN CAST(regexp_extract(props, '\\d+') AS BIGINT) = 7 THEN 'missing_report_row' ELSE '' END AS reason FROM events),
f AS (SELECT user_id, min(event_id) AS first_id FROM r WHERE reason = '' GROUP BY 1)
SELECT CASE WHEN reason = '' AND event_id <> first_id THEN 'duplicate_reference_id' ELSE reason END AS skip_reason, count(*) AS n FROM r LEFT JOIN f USING (user_id) GROUP BY 1""")
def skip_taxonomy(t):
    line = F.when(c("value") < 0.5, "{").otherwise(F.to_json(F.struct((c("event_type") != "error").alias("valid"), F.when(c("value") >= 1, F.struct(
        c("value").alias("v"), F.from_json("props", "k bigint")["k"].alias("k"))).alias("parsed"))))
    doc = F.from_json(line, "valid boolean, parsed struct<v: double, k: bigint>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    r = t.events.select("event_id", "user_id", doc.alias("d"))
    has = c("d.parsed").isNotNull()
    reason = runs.skip_reason(c("d._bad").isNotNull(), ~c("d.valid"), has, c("d.parsed.v") <= 90, c("d.parsed.k") != 7)
    out = runs.mark_duplicates(r.withColumn("skip_reason", reason), "user_id", "event_id")
    return out.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


# The pages as RIS, BibTeX and tab-delimited files, each read by its own reader.
@query(f"""WITH {PAGE_SQL}, f AS (SELECT count(*) AS n, count(DISTINCT doi) AS n_doi, sum(y)::BIGINT AS years, count(DISTINCT page_id) AS n_titles FROM ps)
SELECT unnest(['ris', 'bibtex', 'tsv']) AS kind, n, n_doi, years, n_titles FROM f""")
def format_files(t):
    root = f"{ensure_checkpoint_dir(t.spark)}/formats-{uuid.uuid4().hex}"
    p = page_fields(t).repartition(5, "page_id").withColumn("name", F.concat(F.lit("Page "), c("page_id").cast("string")))
    ris = F.concat(F.lit("TY  - JOUR\nTI  - "), c("name"), F.lit("\nPY  - "), c("y"), F.lit("\nDO  - "), c("doi"), F.lit("\nER  - \n"))
    bib = F.concat(F.lit("@ARTICLE{k"), c("page_id").cast("string"), F.lit(",\n  title = {{"), c("name"), F.lit("}},\n  year = {"), c("y"), F.lit("},\n  doi = {"), c("doi"), F.lit("}\n}\n"))
    p.select(ris.alias("value")).write.text(f"{root}/ris")
    p.select(bib.alias("value")).write.text(f"{root}/bibtex")
    tsv = p.select(F.lit("J").alias("PT"), F.lit("Roe, A").alias("AU"), c("name").alias("TI"), c("y").alias("PY"), c("doi").alias("DI"), c("page_id").alias("UT"))
    tsv.write.option("header", True).option("sep", "\t").option("quote", "").csv(f"{root}/tsv")
    parts = {"ris": tagged.read_ris(t.spark, f"{root}/ris"), "bibtex": bibtex.bibtex_records(bibtex.read_bibtex_entries(t.spark, f"{root}/bibtex")),
             "tsv": tagged.tsv_records(tagged.read_tsv(t.spark, f"{root}/tsv"))}
    out = None
    for kind, df in parts.items():
        row = df.groupBy(F.lit(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doi").alias("n_doi"), F.sum(c("year").cast("bigint")).alias("years"), F.count_distinct("title").alias("n_titles"))
        out = row if out is None else out.unionByName(row)
    return out


# A table is written once for each content: the same rows in another order are not written again.
@query("SELECT o_orderstatus, count(*) AS n, true AS first_write, false AS same_again, true AS changed FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1")
def frozen_table(t):
    path = f"{ensure_checkpoint_dir(t.spark)}/frozen-{uuid.uuid4().hex}"
    o = t.orders.select("o_orderkey", "o_orderstatus", c("o_totalprice").cast("decimal(18,2)").alias("price"))
    wrote = [sinks.freeze(o, path, ["o_orderkey"]), sinks.freeze(o.repartition(3, "price"), path, ["o_orderkey"]), sinks.freeze(o.where("o_orderkey % 5 <> 0"), path, ["o_orderkey"])]
    return (sinks.verify_frozen(t.spark, path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
            .select("*", *[F.lit(w).alias(n) for w, n in zip(wrote, ("first_write", "same_again", "changed"), strict=True)]))


# Turns as rows of batch files, every row in one batch only.
@query("SELECT conv_id, turn, role, length(text) AS len FROM conversations")
def strict_batches(t):
    path = f"{ensure_checkpoint_dir(t.spark)}/strict-{uuid.uuid4().hex}"
    rows = t.conversations.select(F.concat_ws("/", "conv_id", "turn").alias("id"), "conv_id", "turn", "role", F.length("text").alias("len"))
    sinks.write_jsonl(rows, path, ["conv_id", "turn"], 4)
    back = t.spark.read.schema("id string, conv_id bigint, turn bigint, role string, len int").json(path)
    return runs.unique_batches(back, "id").drop("id")


@query("""SELECT o_orderkey AS "doc.id", o_custkey AS "doc.customer.id", o_orderpriority AS "doc.customer.priority", o_totalprice AS total FROM orders""")
def nested_flatten(t):
    df = t.orders.select(F.struct(c("o_orderkey").alias("id"), F.struct(c("o_custkey").alias("id"), c("o_orderpriority").alias("priority")).alias("customer"), F.lit(1).alias("_meta")).alias("doc"),
                         c("o_totalprice").alias("total"), F.lit("x").alias("_hidden"))
    return nested.flatten(df)


@query("""
WITH g AS (SELECT p_partkey, p_brand || CASE WHEN p_size > 25 THEN '2' ELSE '' END AS f FROM part)
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'p. NR: "' ELSE 'p. ' || p_size || ': "' END || p_name || '"' AS brand_locator, 2 AS n_fields, p_name AS back_quote FROM part""")
def locator_maps(t):
    loc = F.array(F.struct(F.lit("brand").alias("field"), F.lit("0").alias("page"), F.lit("old").alias("quote")),
                  F.struct(F.lit("type").alias("field"), F.lit("3").alias("page"), c("p_type").alias("quote")),
                  F.struct(F.lit("brand").alias("field"), F.when(c("p_size") <= 40, c("p_size").cast("string")).alias("page"), c("p_name").alias("quote")))
    m = t.part.select("p_partkey", nested.locators_to_map(loc).alias("m"))
    back = nested.map_to_locators(c("m"))
    return m.select("p_partkey", F.try_element_at("m", F.lit("brand")).alias("brand_locator"), F.size("m").cast("bigint").alias("n_fields"), F.get(back, F.lit(0))["quote"].alias("back_quote"))


# Even documents have form feeds, where blank pages are left out, and odd ones marker lines, which take the white space behind them.
@query(r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS page, unnest(string_split(text, chr(10))) AS line, len(string_split(text, chr(10))) AS n FROM documents),
b AS (SELECT *, regexp_replace(line, '\s+', '', 'g') = '' AS blank FROM l)
SELECT doc_id, page, md5(CASE WHEN NOT blank THEN chr(10) || line || chr(10) WHEN page = n THEN '' ELSE chr(10) END) AS text_md5 FROM b WHERE NOT blank OR (doc_id % 2 = 1 OR n = 1)""")
def page_rows(t):
    lines = F.split("text", "\n")
    marked = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("[[page "), (i + 1).cast("string"), F.lit("]]\n"), x, F.lit("\n"))), "")
    # A single page has no form feed to show it.
    fed = (c("doc_id") % 2 == 0) & (F.size(lines) > 1)
    d = t.documents.select("doc_id", F.when(fed, F.array_join(lines, "\f")).otherwise(F.concat(F.lit("preamble\n"), marked)).alias("text"))
    return ct.split_pages(d, "doc_id", "text").select("doc_id", "page", F.md5("text").alias("text_md5"))


@query("""
WITH c AS (SELECT floor(l_extendedprice)::BIGINT::VARCHAR AS a, l_linenumber::VARCHAR AS b, l_orderkey::VARCHAR AS c, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS d FROM lineitem),
r AS (SELECT sha256(length(a) || ':' || a || length(b) || ':' || b || length(c) || ':' || c || coalesce(length(d) || ':' || d, '~')) AS h FROM c)
SELECT count(*) AS rows, concat_ws('-', sum(('0x' || substr(h, 1, 16))::UBIGINT)::VARCHAR, sum(('0x' || substr(h, 17, 16))::UBIGINT)::VARCHAR,
  sum(('0x' || substr(h, 33, 16))::UBIGINT)::VARCHAR, sum(('0x' || substr(h, 49, 16))::UBIGINT)::VARCHAR) AS digest FROM r""")
def table_fingerprint(t):
    return sinks.fingerprint(t.lineitem.select("l_orderkey", "l_linenumber", F.floor("l_extendedprice").alias("l_extendedprice"), F.when(c("l_returnflag") != "N", c("l_returnflag")).alias("l_returnflag")))


@query("""
SELECT CASE WHEN o_orderpriority < '3' THEN 'yes' ELSE 'no' END AS urgent, kind, count(DISTINCT id) AS n FROM (SELECT o_orderpriority, unnest(['customer', 'order']) AS kind, unnest([CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR)]) AS id FROM orders) GROUP BY 1, 2""")
def id_list_export(t):
    path = f"{ensure_checkpoint_dir(t.spark)}/ids-{uuid.uuid4().hex}"
    o = t.orders.select(F.when(c("o_orderpriority") < "3", "yes").otherwise("no").alias("urgent"), c("o_custkey").alias("customer"), c("o_orderkey").alias("order"))
    sinks.write_id_lists(o, path, ["customer", "order"], "urgent")
    back = t.spark.read.schema("id string, kind string, urgent string").csv(path)
    return back.groupBy("urgent", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN '' ELSE 'a \"quoted\", text' END AS note FROM customer")
def csv_round_trip(t):
    path = f"{ensure_checkpoint_dir(t.spark)}/csv-{uuid.uuid4().hex}"
    df = t.customer.select("c_custkey", "c_mktsegment", F.when(c("c_acctbal") < 0, "").otherwise('a "quoted", text').alias("note"))
    sinks.write_csv(df, path, ["c_custkey", "c_mktsegment", "note"], ["c_custkey"], gzip=True)
    back = records.read_csv(t.spark, path)
    return back.select(c("c_custkey").cast("bigint").alias("c_custkey"), "c_mktsegment", F.coalesce("note", F.lit("")).alias("note"))


# Documents whole, with their line ends, commas and quotes, in many files of two headers.
@query("""SELECT CASE WHEN doc_id % 2 = 0 THEN 'Scopus' ELSE '' END AS source_database, doc_id::VARCHAR AS doi, md5(replace(text, chr(13) || chr(10), chr(10))) AS title_md5, coalesce(lang, '') AS journal FROM documents""")
def csv_files(t):
    root = f"{ensure_checkpoint_dir(t.spark)}/exports-{uuid.uuid4().hex}"
    d = t.documents.repartition(7, "doc_id")
    put = lambda df, name: df.write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "").option("emptyValue", "").csv(f"{root}/{name}")
    put(d.where("doc_id % 2 = 0").select(c("doc_id").alias("EID"), c("doc_id").alias("DOI"), c("text").alias("Article Title"), c("lang").alias("Source")), "even")
    put(d.where("doc_id % 2 = 1").select(c("lang").alias("Journal"), c("text").alias("title"), F.lit("x").alias("other"), c("doc_id").alias("doi")), "odd")
    recs = csv_lines.read_csv_records(t.spark, [f"{root}/even", f"{root}/odd"])
    return recs.select("source_database", "doi", F.md5("title").alias("title_md5"), "journal")


@query(f"""WITH {PAGE_SQL}
SELECT 'Scopus' AS source_database, 'E AND I AND T' AS route, 'S1' AS search_id, count(*) AS n, count(DISTINCT doi) AS n_doi, sum(y)::BIGINT AS years FROM ps
UNION ALL SELECT 'Web of Science Core Collection', 'E AND O AND T', '', count(*), count(DISTINCT pm), sum(y)::BIGINT FROM ps""")
def ingest_files(t):
    """Write two kinds of export files from the pages and ingest the folder: formats, labels and ids from the paths."""
    root = f"{ensure_checkpoint_dir(t.spark)}/exports-{uuid.uuid4().hex}"
    p = page_fields(t)
    p.select(c("title").alias("Title"), c("y").alias("Year"), c("doi").alias("DOI"), F.lit("e").alias("EID")).write.option("header", True).option("escape", '"').csv(f"{root}/scopus_EI")
    lines = F.concat(F.lit("FN x\nPT J\nTI "), F.trim("title"), F.lit("\nPY "), c("y"), F.lit("\nDI "), c("pm"), F.lit("\nER"))
    p.select(lines.alias("value")).write.text(f"{root}/wos_EO")
    searches = p.select(F.lit("Scopus").alias("database"), F.lit("E AND I AND T").alias("route"), F.lit("S1").alias("id")).distinct()
    recs = discover.number_rows(discover.ingest(t.spark, root, searches))
    return recs.groupBy("source_database", "route", "search_id").agg(F.count_distinct("idx").alias("n"), F.count_distinct("doi").alias("n_doi"), F.sum(c("year").cast("bigint")).alias("years"))


@query("""SELECT o_orderkey AS "doc.id", o_orderpriority AS "item.standard_name", o_orderstatus AS "item.original_label", CASE WHEN o_totalprice > 100000 THEN 'min' END AS time_unit FROM orders""")
def schema_migration(t):
    """Rows of a newer nested layout brought to the older columns; a column without a destination would be refused."""
    item = F.struct(c("o_orderstatus").alias("analyte_raw"), c("o_orderpriority").alias("analyte_canonical"))
    new = nested.flatten(t.orders.select(F.struct(c("o_orderkey").alias("id")).alias("doc"), item.alias("item"), F.when(c("o_totalprice") > 100000, c("o_totalprice")).alias("time_value_min")))
    renames = {"item.analyte_raw": "item.original_label", "item.analyte_canonical": "item.standard_name", "time_value_min": "time_value"}
    unit = {"time_unit": F.when(c("time_value").isNotNull(), "min")}
    out = nested.migrate(new, renames, unit, {"doc.id", "item.original_label", "item.standard_name", "time_value", "time_unit"})
    return out.drop("time_value")


# --- streaming ------------------------------------------------------------------------------------

EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value"]


def utc_instant(ts):
    """A zone-free timestamp read as UTC, whatever the session's zone: a watermark needs an instant."""
    return F.concat(ts.cast("string"), F.lit("Z")).cast("timestamp")


def utc_wall(ts):
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def event_stream(t):
    schema = t.events.select(*EVENT_COLS).schema
    return schema, sl.read_log(t.spark, t.folder, schema, glob="events.parquet")


@query("""
SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_latest(t):
    base = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    schema, s = event_stream(t)
    q = sl.latest_state(s, ["user_id"], ["ts", "event_id"], f"{base}/changes", f"{base}/checkpoint")
    q.awaitTermination()
    return sl.read_state(t.spark, f"{base}/changes", ["user_id"], ["ts", "event_id"], schema)


@query("""
WITH w AS (SELECT date_trunc('day', ts) AS d, event_type, value FROM events)
SELECT d AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY 1, 2""")
def stream_daily_totals(t):
    base = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    _, s = event_stream(t)
    s = s.withColumn("ts", utc_instant(c("ts")))
    sl.totals_log(s, "ts", ["event_type"], "value", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    out = sl.read_totals(t.spark, f"{base}/out", ["event_type"])
    return out.select(utc_wall(c("start")).alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""
SELECT DISTINCT user_id, event_type FROM events""")
def stream_dedup(t):
    base = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    _, s = event_stream(t)
    s = s.withColumn("ts", utc_instant(c("ts")))
    q = sl.run_to_table(sl.unique_intake(s, "ts", ["user_id", "event_type"], "60 days"), f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("user_id", "event_type")


