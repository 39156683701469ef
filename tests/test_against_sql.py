"""Queries beside their SQL on small tables with values that the given ones do not have."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture
def beside_sql(spark, tmp_path):
    """Rows of a query and of its SQL over tables given as ``name=(schema, rows)``."""
    def run(name, **tables):
        con = duckdb.connect()
        for t, (schema, rows) in tables.items():
            path = f"{tmp_path}/{t}.parquet"
            spark.createDataFrame(rows, schema).write.parquet(path)
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')")
        out = entry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        return sorted(map(tuple, out.collect()), key=str), sorted(want, key=str)
    return run


def page(i, n, title):
    return i, f"http://www.example.com/{n}?x", f'<html lang="en"><title>{title}</title><p>text {i}</p></html>'


@pytest.mark.parametrize("name", ["dedup_components", "dedup_audit_map", "dedup_summary", "golden_record", "version_flags"])
def test_pages_of_any_year_are_matched(beside_sql, name):
    """Page numbers from 20,000 on give years from 2100 on."""
    title = "a long enough headline of the same piece of news"
    rows = [page(1, 40_000, title), page(2, 40_150, title), page(3, 40_450, title + "s"), page(4, 40_900, title), page(5, 12, title)]
    rows += [(6, "https://blog.example.com/40001", rows[0][2]), (7, "https://www.example.com/40002", rows[0][2])]
    got, want = beside_sql(name, pages=("page_id bigint, url string, html string", rows))
    assert got == want and got


def test_words_of_a_negation_end_where_sql_ends_them(beside_sql):
    notes = ["Noñó asó", "no ñ", "not reported", "ñot not testedé", "\x0bno value", " \tnone", "note", "éno direct"]
    got, want = beside_sql("negation_flags", documents=("doc_id bigint, text string", list(enumerate(notes)) + [(99, "\n".join(notes))]))
    assert got == want and {r[2] for r in got} >= {0, 1, 6}


def test_ids_continue_after_more_ids_than_three_digits(beside_sql):
    got, want = beside_sql("continued_ids", supplier=("s_suppkey bigint", [(k,) for k in (0, 7, 998, 1000, 5999)]),
                           customer=("c_custkey bigint, c_acctbal double", [(k, -1.0 if k % 2 else 1.0) for k in range(9)]))
    assert got == want and got[0] == (1, "FTR-999")


def test_scrub_applies_the_rules_of_its_sql(beside_sql):
    texts = ["as Smith et al. 2019 say", "Abc2012 and software v.1.2.3", "éme@x.org", "me@x.orgé", "secret:\x0bab cd", "éapi_key = x y", "a.b@c.de", None]
    got, want = beside_sql("scrub_text", documents=("doc_id bigint, text string, lang string", [(i, x, "en") for i, x in enumerate(texts)]))
    assert got == want
