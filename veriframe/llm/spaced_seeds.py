"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over word positions; positions outside the mask are ignored, so a seed still hits where words there were
replaced. The hashes of all seeds of the benchmark are joined with those of the documents. Around a hit the document and the item
are laid over each other, and the overlap counts if some window of ``WINDOW`` aligned words (the whole item, if it is shorter) has
at most one replaced word in five; items under 15 words must stand as they are. The masks were chosen by search over all
placements of that many replaced words: every such window contains a hit of one of them, so none is missed.

DataFrame functions only. Seeds are made, joined and verified in one pass over the documents, without a shuffle of their words. A text
goes through it in pieces of ``PIECE`` words with the words around them that a window can reach, so that no row beside a seed is longer,
however long the text is. The benchmark is broadcast in parts of at most ``PART_WORDS`` words, one pass over the documents for each part;
the passes follow each other, so one part is held at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Positions each mask looks at. Together they hit every window of 15 words with 3 replaced and of 20 with 4; the
#: first alone hits whatever has five equal words in a row.
MASKS = [(0, 1, 2, 3, 4), (0, 1, 2, 4, 5)]
WINDOW = 20
EXACT_BELOW = 15
LEAST_WORDS = 5
PART_WORDS = 500_000
#: Words of a text whose seeds go with one copy of the words around them.
PIECE = 64


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds() -> Column:
    """The seeds that begin at word ``p`` of the word hashes ``h``, as an array; null past the end of the text."""
    return F.array(*[F.when(F.col("p") + mask[-1] < F.size("h"), F.xxhash64(F.lit(i), *[F.get("h", F.col("p") + o) for o in mask]))
                     for i, mask in enumerate(MASKS)])


def pieces(h: Column) -> Column:
    """Structs of ``h``, words with those around them that windows reach, and ``lo``, ``hi``, the places in it of the first and last word of the
    piece itself. Every word of the text is in one piece; an empty text has none."""
    def piece(i):
        begin = i * PIECE
        first = F.greatest(F.lit(0), begin - (WINDOW - 1))
        return F.struct(F.slice(h, first + 1, begin - first + (PIECE + WINDOW - 1)).alias("h"), (begin - first).alias("lo"),
                        (F.least(begin + PIECE, F.size(h)) - first - 1).alias("hi"))

    return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / PIECE).cast("int")), piece))


def benchmark_items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """``item, ih, n``: distinct word sequences of at least five words, with the least key of each."""
    return (benchmark.select(F.col(key).alias("item"), hashed(F.col(text)).alias("ih")).where(F.size("ih") >= LEAST_WORDS)
            .groupBy("ih").agg(F.min("item").alias("item")).select("item", "ih", F.size("ih").alias("n"), F.xxhash64("ih").alias("number")))


def overlaps(docs: DataFrame, items: DataFrame, carry: list[Column], text: str) -> DataFrame:
    """The carried columns and ``item`` for each verified hit. ``items`` is within the broadcast bound."""
    index = (items.select("number", F.col("ih").alias("h"), F.posexplode("ih").alias("p", "w"))
             .select("number", "p", F.posexplode(seeds()).alias("m", "seed")).where("seed IS NOT NULL")
             .select("seed", F.col("number").alias("of"), F.col("p").alias("q")))
    names = docs.select(*carry).columns
    hits = (docs.select(*carry, hashed(F.col(text)).alias("h")).select(*names, F.explode(pieces(F.col("h"))).alias("piece"))
            .select(*names, "piece.h", F.explode(F.sequence("piece.lo", "piece.hi")).alias("p")).select("*", F.explode(seeds()).alias("seed"))
            .join(F.broadcast(index), "seed").join(F.broadcast(items), F.col("of") == F.col("number")))
    size = F.least(F.col("n"), F.lit(WINDOW))
    may_differ = F.when(F.col("n") < EXACT_BELOW, 0).otherwise(F.floor(size / 5)).cast("int")
    # Windows of the item around the hit, all inside the item; words of the document that are not there count as replaced.
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - size + 1), F.least(F.col("q"), F.col("n") - size))
    differ = lambda a: F.size(F.filter(F.sequence(a, a + size - 1), lambda j: ~(
        (F.col("p") - F.col("q") + j >= 0) & F.coalesce(F.get("h", F.greatest(F.lit(0), F.col("p") - F.col("q") + j)) == F.get("ih", j), F.lit(False)))))
    return hits.where(F.exists(starts, lambda a: differ(a) <= may_differ))


def find(docs: DataFrame, benchmark: DataFrame, carry: list[Column], text: str, item_key: str, item_text: str) -> DataFrame:
    """One row for each carried value and benchmark item that overlap: carried columns, ``item``."""
    items = cut_lineage(benchmark_items(benchmark, item_key, item_text))
    size = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()["words"]
    parts = max(1, -(-size // PART_WORDS))
    names = docs.select(*carry).columns
    found = [overlaps(docs, items.where(F.pmod("number", F.lit(parts)) == i), carry, text).select(*names, "item").distinct() for i in range(parts)]
    if parts == 1:
        return found[0]
    return reduce(DataFrame.unionByName, [cut_lineage(one) for one in found])


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """The documents that hold benchmark wording: ``key, item_id`` (the least item), ``n_items`` (different items), one row a key.

    Items with equal words are one item, with the least id; items under five words take no part. Null and empty texts hold nothing. Repeated
    keys give one row, null keys one row together; empty tables give an empty result; other columns play no part, whatever their names.
    """
    hits = find(docs, benchmark, [F.col(f"`{key}`").alias("k")], text, item_key, item_text)
    return (hits.groupBy("k").agg(F.min("item").alias("item_id"), F.count(F.lit(1)).alias("n_items"))
            .select(F.col("k").alias(key), "item_id", "n_items"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                        item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark wording, with their columns. A row is known by two hashes of its key and text."""
    k, t = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    a, b = F.xxhash64(k, t).alias("_row_a"), F.xxhash64(t, F.lit("/"), k).alias("_row_b")
    bad = cut_lineage(find(docs, benchmark, [a, b], text, item_key, item_text).select("_row_a", "_row_b").distinct())
    return docs.withColumns({"_row_a": a, "_row_b": b}).join(bad, ["_row_a", "_row_b"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def contaminated_sql() -> str:
    """The result of ``contaminated`` in SQL without seeds: every alignment of documents and items that share a word."""
    split = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
        WITH i AS (SELECT min(item_id) AS item, w, len(w) AS n FROM (SELECT item_id, {split} AS w FROM benchmark) WHERE len(w) >= 5 GROUP BY w),
        iw AS (SELECT item, n, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM i),
        dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM (SELECT doc_id, {split} AS w FROM documents)),
        m AS (SELECT DISTINCT doc_id, item, n, p - q AS diagonal, q FROM dw JOIN iw USING (word)),
        c AS (SELECT doc_id, item, n, count(*) OVER (PARTITION BY doc_id, item, diagonal ORDER BY q RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS same FROM m)
        SELECT doc_id, min(item) AS item_id, count(DISTINCT item) AS n_items FROM c
        WHERE same >= least(n, {WINDOW}) - CASE WHEN n < {EXACT_BELOW} THEN 0 ELSE least(n, {WINDOW}) // 5 END GROUP BY doc_id"""
