import itertools
import random
import re

import duckdb
import pandas as pd
import pytest

from llm_fixtures import clashing, documents, prose
from veriframe.llm import licenses, spaced_seeds


def sql(query, **tables):
    con = duckdb.connect()
    for name, (rows, columns) in tables.items():
        frame = pd.DataFrame(rows, columns=columns)
        con.register(name, frame.astype({c: "Int64" if c.endswith("id") else "string" for c in columns}))
    return con.execute(query).fetchall()


def as_text(rows):
    return sorted(tuple("" if x is None else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("window, replaced", [(15, 3), (20, 4), (16, 3), (19, 3)])
def test_masks_miss_nothing(window, replaced):
    for away in itertools.combinations(range(window), replaced):
        assert any(all(a + o not in away for o in mask) for mask in spaced_seeds.MASKS for a in range(window - mask[-1]))


def items(rng):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "the", "of"]
    long = [(i, prose(rng, 30 + i, words)) for i in range(5)]
    return [*long, (5, prose(rng, 16, words)), (6, "seven words that must stand as written"), (7, "too few words"), (8, None), (9, ""), (10, long[0][1]), (None, long[1][1]), (11, long[2][1].upper())]


def planted(rng, bench):
    out = []
    for n, (_, text) in enumerate(b for b in bench if b[1]):
        w = re.findall(r"\w+", text)
        for m, share in enumerate((0.0, 0.1, 0.19, 0.3)):
            v = list(w)
            for i in rng.sample(range(len(v)), int(share * len(v))):
                v[i] = "other"
            out.append((200 + 10 * n + m, prose(rng, 20) + " " + " ".join(v) + ". " + prose(rng, 5), "en", "s", 1))
        out.append((900 + n, " ".join(w[:len(w) // 2]), "en", "s", 1))
        out.append((1000 + n, " - ".join(w), "en", "s", 1))
    return out


def test_decontamination_equals_sql(spark, monkeypatch):
    rng = random.Random(4)
    bench = items(rng)
    docs = clashing(documents(spark, planted(rng, bench)))
    benchmark = clashing(spark.createDataFrame(bench, "item_id long, text string"))
    rows = docs.select("doc_id", "text").collect()
    want = as_text(sql(spaced_seeds.contaminated_sql(), documents=(rows, ["doc_id", "text"]), benchmark=(bench, ["item_id", "text"])))
    got = spaced_seeds.contaminated(docs, benchmark)
    assert as_text(got.collect()) == want and len(want) > 20
    monkeypatch.setattr(spaced_seeds, "PART_WORDS", 60)  # several parts
    assert as_text(spaced_seeds.contaminated(docs, benchmark).collect()) == want
    left = spaced_seeds.remove_contaminated(docs, benchmark)
    bad = {r[0] for r in want}
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in rows if str(r.doc_id) not in bad)


def test_decontamination_of_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = documents(spark)
    assert spaced_seeds.contaminated(docs.where("false"), benchmark).collect() == []
    assert spaced_seeds.contaminated(docs, benchmark.where("false")).collect() == []
    assert spaced_seeds.remove_contaminated(docs, benchmark.where("false")).count() == docs.count()


LICENSED = [
    (300, "Released under the MIT License.\nunder the mit license", "en", "s", 1), (301, "UNDER THE\tMIT--LICENSE", "en", "s", 1), (302, "under the mit licensee", "en", "s", 1),
    (303, "Licensed under the Apache License, Version 2.0 (the \"License\")", "en", "s", 1), (304, "apache license version 2", "en", "s", 1), (305, "licensed under cc by-nc 4.0 license", "en", "s", 1),
    (306, "Copyright (c) 2020 Some Person. All rights reserved.", "en", "s", 1), (307, "copyright one two three four five six seven eight nine all rights", "en", "s", 1),
    (308, "This work is licensed under the GNU General Public License, version 3.", "en", "s", 1), (309, "Permission to use, copy, modify, and distribute this software for any purpose with or without fee "
     "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "en", "s", 1),
    (310, "Permission to use, copy, modify, and/or distribute this software for any use with or without fee is hereby granted", "en", "s", 1), (311, "under the", "en", "s", 1), (312, "mit license", "en", "s", 1),
    (313, "unéder the mit license", "en", "s", 1),
]


def test_licenses_equal_sql(spark):
    docs = clashing(documents(spark, LICENSED))
    rows = docs.select("doc_id", "text").collect()
    got = licenses.scan(docs)
    want = sql(licenses.scan_sql(), documents=(rows, ["doc_id", "text"]))
    assert as_text(got.collect()) == as_text(want)
    by_id = {r.doc_id: r for r in got.collect()}
    assert (by_id[300].n_base, by_id[300].first_word, by_id[300].last_word, by_id[300].labels) == (2, 1, 5, "mit")
    assert by_id[302].labels == "" and by_id[303].labels == "apache-2" and by_id[306].labels == "proprietary" and by_id[307].labels == ""
    assert by_id[308].labels == "gpl" and by_id[309].labels == "isc" and by_id[310].labels == "" and by_id[305].base_labels == "cc-by-nc"
    assert by_id[311].n_base == by_id[312].n_base == 0  # a wording does not run on into the next document
    assert licenses.scan(docs.where("false")).count() == 0


def test_every_template_accepts_its_own_wording():
    code = {}
    for _, template in licenses.TEMPLATES:
        for w in re.findall(licenses.WORD, re.sub(r"<<\d+>>", " ", template)):
            code.setdefault(w, len(code) + 1)
    import numpy as np

    for _, template in licenses.TEMPLATES:
        parsed = licenses.parse(template)
        automaton = licenses.Automaton(parsed, code)
        full = re.findall(licenses.WORD, re.sub(r"<<\d+>>", " filler ", template))
        least = re.findall(licenses.WORD, re.sub(r"<<\d+>>", " ", re.sub(r"\[\[[^\[\]]*\]\]", " ", re.sub(r"\[\[[^\[\]]*(\[\[[^\[\]]*\]\][^\[\]]*)*\]\]", " ", template))))
        for words in (full, least):
            codes = np.array([code.get(w, 0) for w in words])
            assert 0 in automaton.starts(codes, np.zeros(len(codes), int)).tolist() or "[[" in template[:2]
            broken = codes.copy()
            broken[len(codes) // 2] = 0
            if "<<" not in template and "[[" not in template:
                assert not len(automaton.starts(broken, np.zeros(len(codes), int)))


def test_parts_of_a_benchmark_are_not_held_at_once(spark, monkeypatch):
    rng = random.Random(6)
    bench = items(rng)
    docs = documents(spark, planted(rng, bench))
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    broadcasts = lambda: spaced_seeds.contaminated(docs, benchmark)._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")
    assert broadcasts() == 2  # index and items of the one part
    monkeypatch.setattr(spaced_seeds, "PART_WORDS", 60)
    assert broadcasts() == 0  # each part's hits were written before the next part was broadcast


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_a_row_beside_a_seed_holds_only_the_words_a_window_reaches(spark, monkeypatch, piece):
    from pyspark.sql import functions as F

    monkeypatch.setattr(spaced_seeds, "PIECE", piece)
    for n in (0, 1, 6, 7, 63, 64, 65, 200):
        h = F.expr(f"slice(sequence(0L, {n}L), 1, {n})")
        cut = spark.range(1).select(F.explode(spaced_seeds.pieces(h)).alias("x")).select("x.*").collect()
        assert sorted(w for r in cut for w in r.h[r.lo:r.hi + 1]) == list(range(n))
        reach = spaced_seeds.WINDOW - 1
        for r in cut:
            assert len(r.h) <= piece + 2 * reach and r.h == list(range(max(0, r.h[r.lo] - reach), min(n, r.h[r.hi] + reach + (piece - (r.hi - r.lo + 1)) + 1)))
    # A text in which items stand on all sides of the borders of pieces.
    rng = random.Random(piece)
    bench = items(rng)
    docs = documents(spark, [(1, prose(rng, 50) + " " + " ".join(prose(rng, 3 + i) + " " + (t or "") for i, (_, t) in enumerate(bench * 3)), "en", "s", 1)])
    rows = docs.select("doc_id", "text").collect()
    want = as_text(sql(spaced_seeds.contaminated_sql(), documents=(rows, ["doc_id", "text"]), benchmark=(bench, ["item_id", "text"])))
    assert as_text(spaced_seeds.contaminated(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()) == want
