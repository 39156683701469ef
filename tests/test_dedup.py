"""Deduplication against brute force, and the rules that decide what may merge."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from veriframe.functions import similarity as sim
from veriframe.operators import dedup as dd
from veriframe.operators import fuzzy as fz
from veriframe.operators.graph import connected_components
from veriframe.operators.skew import attach_per_key

SCHEMA = ("idx bigint, source_file string, source_row bigint, source_database string, route string, search_id string, pmid string, "
          "doi string, title string, year string, journal string, authors array<string>, abstract string, pubtypes array<string>")


def rec(i, title="", year="2020", pmid="", doi="", journal="", authors=("Roe, A",), abstract="", db="DB"):
    return (i, "f", i, db, "", "", pmid, doi, title, year, journal, list(authors), abstract, [])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


RATIO = {"levenshtein": lambda a, b: 1 - lev(a, b) / max(len(a), len(b)), "indel": lambda a, b: 2 * lcs(a, b) / (len(a) + len(b))}


def noisy_titles(seed, n_base=25, copies=6, edits=6):
    rng = random.Random(seed)
    words = ["alpha", "beta", "cell", "run", "immune", "acute", "of", "the", "in", "response", "x"]
    out = set()
    for _ in range(n_base):
        base = "study " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        for _ in range(copies):
            s = list(base)
            for _ in range(rng.randint(0, edits)):
                k, p = rng.random(), rng.randrange(6, len(s) + 1)
                if k < 0.34 and p < len(s):
                    del s[p]
                elif k < 0.67:
                    s.insert(p, rng.choice("abcxyz "))
                elif p < len(s):
                    s[p] = rng.choice("abcxyz")
            out.add("".join(s))
    return sorted(out)


@pytest.mark.parametrize("metric,threshold", [("levenshtein", 0.95), ("levenshtein", 0.8), ("indel", 0.95), ("indel", 0.85)])
def test_similar_titles_is_exact(spark, metric, threshold):
    titles = noisy_titles(int(threshold * 100) + len(metric))
    df = spark.createDataFrame([(i, "study", t) for i, t in enumerate(titles)], "title_id bigint, block string, title string")
    got = {(r.id_a, r.id_b) for r in fz.similar_titles(df, metric, threshold).collect()}
    want = {(i, j) for i, j in combinations(range(len(titles)), 2) if RATIO[metric](titles[i], titles[j]) >= threshold - 1e-12}
    assert want and got == want


def brute(rows, threshold, tol, metric, norm):
    """Reference semantics on a few rows: all pairs, guarded by identifiers; union-find."""
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    best = {}
    for a, b in combinations(rows, 2):
        rule = None
        if a[6] and a[6] == b[6]:
            rule = (0, 0)
        elif a[7] and a[7] == b[7]:
            rule = (1, 0)
        ta, tb = norm[a[0]], norm[b[0]]
        if ta and tb and a[9] and b[9] and abs(int(a[9]) - int(b[9])) <= tol and ta.split()[0] == tb.split()[0]:
            conflict = (a[7] and b[7] and a[7] != b[7]) or (a[6] and b[6] and a[6] != b[6])
            s = RATIO[metric](ta, tb)
            if not conflict and s >= threshold and (rule is None):
                rule = (2, -s)
        if rule:
            for x in (a[0], b[0]):
                best[x] = min(best.get(x, rule), rule)
            ra, rb = find(a[0]), find(b[0])
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}, best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    titles = noisy_titles(seed, 6, 4, 3)
    rows = []
    for i in range(120):
        kind = rng.choice(["none", "d", "p", "both"])
        rows.append(rec(i, rng.choice(titles), str(rng.choice([2018, 2019, 2020, 2021, ""])),
                        pmid=str(1000 + rng.randrange(60)) if kind in ("p", "both") else "",
                        doi=f"10.1/{rng.randrange(60)}" if kind in ("d", "both") else ""))
    norm = {r[0]: " ".join(r[8].split()) for r in rows}
    want, best = brute(rows, 0.95, 1, "levenshtein", norm)
    res = dd.deduplicate(frame(spark, rows), metric="levenshtein")
    assert {r.idx: r.group_idx for r in res.groups.collect()} == want
    names = {0: "pmid", 1: "doi"}
    for r in res.audit.collect():
        b = best.get(r.input_index)
        label = "" if b is None else names.get(b[0], f"title_year_fuzzy({-b[1]:.3f})")
        assert r.match_rule == label, r.input_index


def test_merge_rules(spark):
    t = "acute immune response to a long run in adults"
    rows = [
        rec(0, t, pmid="1234", doi="10.1/a", abstract=""), rec(1, "other words entirely", pmid="1234", doi="10.1/b", abstract="text", db="B"),
        rec(2, t + "s", "2021", doi="10.1/zz", journal="bioRxiv"), rec(3, t, "2023"), rec(4, "", ""), rec(5, t, ""),
        rec(6, "review of things", doi="https://doi.org/10.9/Q."), rec(7, "Review of things (reprint)", doi="DOI: 10.9/q"),
    ]
    res = dd.deduplicate(frame(spark, rows))
    g = {r.idx: r.group_idx for r in res.groups.collect()}
    assert g[1] == 0            # same PMID merges although the DOIs differ
    assert g[2] == 2            # similar title, differing DOI: kept apart
    assert g[3] == 3 and g[4] == 4 and g[5] == 5   # year too far, no title, no year
    assert g[7] == 6            # DOI spelled differently
    assert {(r.idx, r.partner) for r in res.flagged.collect()} == {(0, 2), (2, 0)}
    notes = {r.input_index: r.notes for r in res.audit.collect()}
    assert "FS-000002" in notes[0] and "FS-000001" in notes[2]
    m = {r.group_idx: r for r in res.master.collect()}
    assert m[0].abstract == "text" and m[0].abstract_source == "B" and m[0].rep_idx == 1
    assert m[0].source_database == "DB;B" and m[0].record_id == "FS-000001"


def test_version_flags_equal_all_pairs(spark):
    rng = random.Random(11)
    titles = noisy_titles(11, 3, 3, 2)
    rows = [rec(i, rng.choice(titles), str(rng.choice([2019, 2020, 2022])), doi=rng.choice(["", f"10.1/{rng.randrange(6)}"]),
                journal=rng.choice(["bioRxiv", "J", "J"]), authors=rng.choice([("Roe, A",), ("Li, B", "Roe, C"), ("Kim, D",), ()])) for i in range(90)]
    norm = {r[0]: " ".join(r[8].split()) for r in rows}
    sur = {r[0]: {a.split(",")[0].lower() for a in r[11]} for r in rows}
    first = {}
    for r in rows:
        first.setdefault(norm[r[0]], r[0])
    want = {}
    for a, b in combinations(rows, 2):
        x, y = norm[a[0]], norm[b[0]]
        s = RATIO["levenshtein"](x, y)
        if (x.split()[0] == y.split()[0] and abs(int(a[9]) - int(b[9])) <= 1 and a[7] and b[7] and a[7] != b[7] and s >= 0.95
                and ("bioRxiv" in (a[10], b[10])) and (sur[a[0]] & sur[b[0]] or not sur[a[0]] or not sur[b[0]])):
            for p, q in ((a, b), (b, a)):
                want.setdefault((p[0], first[norm[q[0]]]), set()).add(q[0])
    notes = dd.annotate(frame(spark, rows))
    got = {(r.idx, r.title_id): r.partner for r in dd.version_flags(notes, dd.title_pairs(notes, 0.95, 1, "levenshtein"), 1).collect()}
    assert want and got.keys() == want.keys() and all(got[k] in want[k] for k in got)


def test_strict_policy_splits_a_transitive_conflict(spark):
    t = "acute immune response to a long run in adults"
    rows = [rec(0, t, doi="10.1/a"), rec(1, t, pmid="1111"), rec(2, t, doi="10.1/b"), rec(3, t)]
    loose = {r.idx: r.group_idx for r in dd.deduplicate(frame(spark, rows)).groups.collect()}
    assert set(loose.values()) == {0}
    strict = {r.idx: r.group_idx for r in dd.deduplicate(frame(spark, rows), conflict_policy="strict").groups.collect()}
    assert strict[0] != strict[2]


def test_deduplicating_the_master_changes_nothing(spark):
    titles = noisy_titles(5, 5, 3, 2)
    rows = [rec(i, t, abstract="x") for i, t in enumerate(titles)]
    once = dd.deduplicate(frame(spark, rows))
    n = once.master.count()
    again = once.master.select(
        F.col("group_idx").alias("idx"), F.lit("m").alias("source_file"), F.col("group_idx").alias("source_row"), "source_database", "route", "search_id", "pmid", "doi",
        "title", "year", "journal", F.split("authors", "; ").alias("authors"), "abstract", F.array().cast("array<string>").alias("pubtypes"))
    assert dd.deduplicate(again).master.count() <= n


@pytest.mark.parametrize("hub_degree", [100_000, 2])
def test_components_on_shapes(spark, hub_degree):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    cycle = [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    got = connected_components(spark.createDataFrame(chain + star + cycle, "src bigint, dst bigint"), hub_degree=hub_degree)
    want = {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, **{200 + i: 200 for i in range(7)}}
    assert {r.node: r.component for r in got.collect()} == want


def test_components_without_edges(spark):
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_salted_join_equals_plain_join(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 7 + 1).alias("k"), "id")
    per = rows.groupBy("k").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("n"))
    for right in (per, per.unionByName(per.withColumn("m", F.col("m") + 1000))):
        plain = sorted(tuple(r) for r in rows.join(right, "k").select("k", "id", "m").collect())
        salted = sorted(tuple(r) for r in attach_per_key(rows, right, ["k"], "n", limit=50).select("k", "id", "m").collect())
        assert salted == plain and len(salted) in (500, 1000)


def test_length_bound_never_rejects_a_match(spark):
    titles = noisy_titles(9, 5, 5, 4)
    df = spark.createDataFrame([(a, b) for a, b in combinations(titles, 2)], "a string, b string")
    for metric in sim.METRICS:
        bad = df.where((sim.similarity(metric, F.col("a"), F.col("b")) >= 0.9) & ~sim.length_bound(metric, F.col("a"), F.col("b"), 0.9))
        assert bad.count() == 0
