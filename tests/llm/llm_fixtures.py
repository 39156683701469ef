"""Documents with the awkward cases every operator has to take: nulls, empty, blank and very long texts, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=None):
    words = words or ["the", "river", "stone", "under", "licence", "morning", "quiet", "walked", "against", "nothing", "window", "paper", "seven", "garden"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def documents(spark, extra=()):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(1, 120)), rng.choice(["en", None]), "s", 1) for i in range(1, 40)]
    rows += [(40, None, "en", None, None), (41, "", "en", "s", 0), (42, " \n\t ", None, "s", 3), (None, "no key at all", "en", "s", 1), (None, None, None, None, None),
             (43, "x " * 60_000, "en", "s", 1), (44, "a" * 70_000, "en", "s", 1), (1, rows[0][1], rows[0][2], "s", 1), (1, "another text under one key", "en", "s", 1),
             (45, "Ünïcödé ß 漢字 😀 ' ''s don't", "de", "s", 1), (46, "1234 5678", "en", "s", 1), *extra]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """The same rows with columns named as results and helpers are."""
    names = ["k", "t", "f", "n", "h", "p", "q", "seed", "score", "rank", "verdict", "host", "fingerprint", "component", "_row", "g", "c", "nll", "n_tokens", "labels"]
    return df.withColumns({c: F.lit(5) for c in names if c not in df.columns})
