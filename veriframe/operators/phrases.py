"""Quotes of any length, with gaps, in whole texts: a positional index of words and phrase intersection by offset.

A quote is cut into fragments at every ellipsis; a fragment is a sequence of words. It stands in a text where its inner words stand whole,
one after another, its first word ends a word of the text and its last word begins one (a fragment of one word stands anywhere inside a
word). That is what ``contains`` finds on texts with squeezed white space, without comparing any quote with any text:

1. the words that can stand in a place of a fragment come from the distinct words of the corpus: whole words by equality, edges over
   character q-grams;
2. each fragment is looked up on its rarest place, which gives (text, position) candidates; the places beside it are checked on the spot;
3. the places further off are checked by joining candidates with the index on (text, position).

Only the index entries whose word some quote can use are kept, of texts that have such candidates. Words of texts are not shuffled to find
them. A quote of which every place is so common that it meets one word in ``COMMON`` would have an index row for nearly every text: it is
looked for in the texts themselves, at most ``LOOKED`` of them, the most common ones. All others are never compared with texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage
from .skew import attach_per_key, that_may_be_in

#: Characters of the grams by which edges of fragments are found in the vocabulary; shorter edges use all their characters.
Q = 3
#: Reading so many words of a text for a quote costs about what one row of the index does; so many rows of it are few in any case.
COMMON, FEW = 1_000, 10_000
#: The most quotes for which texts are read.
LOOKED = 1_000
# What stands for left-out words in a quote.
ELLIPSIS = r"\s*(?:\[\s*)?(?:\.\.\.|…)(?:\s*\])?\s*"


def fragments(quotes: DataFrame, key: str, quote: str, gaps: bool) -> DataFrame:
    """``key, frag, n_frag, place, n, word, kind``: the places of each fragment. ``kind``: whole, end, begin or inside."""
    parts = F.split(F.lower(F.col(quote)), ELLIPSIS) if gaps else F.array(F.col(quote))
    texts = F.filter(F.transform(parts, tx.normalize_quote), lambda x: x != "")
    f = (quotes.where(F.col(quote).isNotNull()).select(F.col(key).alias("q"), texts.alias("_f")).select("q", F.size("_f").alias("n_frag"), F.posexplode("_f").alias("frag", "_t"))
         .select("q", "frag", "n_frag", F.split("_t", " ").alias("_w")).select("q", "frag", "n_frag", F.size("_w").alias("n"), F.posexplode("_w").alias("place", "word")))
    kind = (F.when(F.col("n") == 1, "inside").when(F.col("place") == 0, "end").when(F.col("place") == F.col("n") - 1, "begin").otherwise("whole"))
    return f.withColumn("kind", kind)


def _grams(word: Column, q: int) -> Column:
    """Distinct q-grams of a word."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - (q - 1), F.lit(1))), lambda i: F.substr(word, i, F.lit(q))))


def usable(vocabulary: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, kind`` beside each word of ``vocabulary`` (word, ...) that can stand where ``edges`` (part, kind) has a part of a word.

    A part meets the words that hold one q-gram of it, the rarest one; parts shorter than ``Q`` are their own gram."""
    sizes = list(range(1, Q + 1))
    probe = F.when(F.length("part") < Q, F.array("part")).otherwise(_grams(F.col("part"), Q))
    probes = cut_lineage(edges.select("part", "kind", F.explode(probe).alias("g")))
    grams = F.flatten(F.array(*[F.when(F.length("word") >= q, _grams(F.col("word"), q)).otherwise(F.array().cast("array<string>")) for q in sizes]))
    # Grams are counted where they are made; the list of the rarest ones is written, so that its size is known, and the grams are made again.
    df = vocabulary.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    best = cut_lineage(probes.join(df, "g", "left").groupBy("part", "kind").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("b"))
                       .select("part", "kind", F.col("b.g").alias("g")))
    fits = (F.when(F.col("kind") == "end", F.endswith("word", "part")).when(F.col("kind") == "begin", F.startswith("word", "part")).otherwise(F.contains("word", "part")))
    return vocabulary.select("*", F.explode(grams).alias("g")).join(best, "g").where(fits).select(*vocabulary.columns, "part", "kind")


def locate(quotes: DataFrame, quote_key: str, quote: str, docs: DataFrame, doc_key: str, text: str, gaps: bool = False) -> DataFrame:
    """``(quote_key, doc_key)`` for every text that contains the quote; both are lower-cased with white space squeezed.

    With ``gaps`` an ellipsis in a quote stands for any text: its fragments must follow each other without overlap. A quote without a word
    is in no text. Keys identify a quote and a text.
    """
    frags = cut_lineage(fragments(quotes, quote_key, quote, gaps))
    ws = F.split(tx.normalize_quote(F.col(text)), " ")
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_key).alias("d"), ws.alias("_w"))

    edges = frags.where("kind <> 'whole'").select(F.col("word").alias("part"), "kind").distinct()
    vocabulary = cut_lineage(texts.select(F.explode("_w").alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    wholes = frags.where("kind = 'whole'").select(F.col("word").alias("part"), "kind").distinct()
    can = cut_lineage(usable(vocabulary, edges).unionByName(vocabulary.join(wholes, F.col("word") == F.col("part")).select("word", "n", "part", "kind")))

    # The rarest place of each fragment, by the occurrences of the words that can stand there.
    load = can.groupBy("part", "kind").agg(F.sum("n").alias("n_part"))
    weighed = frags.join(load, (frags["word"] == load["part"]) & (frags["kind"] == load["kind"]), "left").select(frags["*"], F.coalesce("n_part", F.lit(0)).alias("load"))
    anchors = cut_lineage(weighed.groupBy("q", "frag", "n_frag", "n").agg(F.min(F.struct("load", "place", "word", "kind")).alias("a"))
                          .select("q", "frag", "n_frag", "n", F.col("a.load").alias("load"), F.col("a.place").alias("place"), F.col("a.word").alias("part"), F.col("a.kind").alias("kind")))
    read = None
    if not gaps:
        least = max(FEW, vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] / COMMON)
        common = (quotes.select(F.col(quote_key).alias("q"), tx.normalize_quote(F.col(quote)).alias("_q"))
                  .join(anchors.where(F.col("load") > least).select("q", "load"), "q"))
        listed = cut_lineage(common.groupBy("_q").agg(F.max("load").alias("load")).orderBy(F.desc("load"), "_q").limit(LOOKED).select("_q"))
        read = cut_lineage(common.join(listed, "_q", "left_semi").select("q", "_q").distinct())
        anchors = anchors.join(read, "q", "left_anti")
        whole_texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_key).alias("d"), tx.normalize_quote(F.col(text)).alias("_t"))
        read = whole_texts.join(F.broadcast(listed), F.contains("_t", "_q")).select("d", "_q").join(read, "_q").select("q", "d")
    live = anchors.groupBy("q").agg(F.min("load").alias("least")).where("least > 0").select("q")  # a fragment without any candidate ends its quote
    # Written, as are the texts that count below: the planner knows the size and need not shuffle the words to meet a short list.
    anchors = cut_lineage(anchors.join(live, "q", "left_semi"))
    starts = cut_lineage(anchors.join(can.select("word", "part", "kind", F.col("n").alias("m")), ["part", "kind"])
                         .select("q", "frag", "n_frag", "n", "place", "word", "m"))
    need = frags.where("n > 1").select("q", "frag", "place", F.col("word").alias("part"), "kind")
    beside = lambda step, tag: need.select("q", "frag", (F.col("place") - step).alias("place"), F.col("part").alias(f"{tag}_part"), F.col("kind").alias(f"{tag}_kind"))
    per = starts.join(beside(-1, "before"), ["q", "frag", "place"], "left").join(beside(1, "after"), ["q", "frag", "place"], "left")
    # A word of the text with the words beside it, so that three places of a fragment are checked where its rarest one is found.
    spots = that_may_be_in(texts.select("d", F.explode(tx.bound(F.col("_w"), _with_neighbours)).alias("_x")).select("d", "_x.*").where("word <> ''"), starts, "word")
    fit = [F.coalesce(F.col(f"{tag}_part").isNull() | _fits(F.col(tag), F.col(f"{tag}_part"), F.col(f"{tag}_kind")), F.lit(False)) for tag in ("before", "after")]
    hits = cut_lineage(attach_per_key(spots, per, ["word"], "m").where(fit[0] & fit[1])
                       .select("q", "frag", "n_frag", "n", "place", "d", (F.col("p") - F.col("place")).alias("s")).where("s >= 0"))
    if gaps:  # a text must have a place for every fragment
        full = hits.groupBy("q", "d", "n_frag").agg(F.count_distinct("frag").alias("k")).where("k = n_frag")
        hits = cut_lineage(hits.join(full.select("q", "d"), ["q", "d"], "left_semi"))

    # What lies further off is checked on the index of the texts that still count: every word must be one that can stand there.
    short = F.col("place").between(F.col("n") - 2, 1)
    single, longer = hits.where(short).drop("place"), hits.where(~short)
    counting = cut_lineage((hits if gaps else longer).select("d").distinct())
    used = can if gaps else can.join(frags.join(anchors.where("n > 2"), "q", "left_semi").select(F.col("word").alias("part"), "kind").distinct(), ["part", "kind"], "left_semi")
    index = cut_lineage(that_may_be_in(texts.join(counting, "d", "left_semi").select("d", F.posexplode("_w").alias("p", "word")), used, "word"))
    others = need.withColumnRenamed("place", "at")
    wanted = (longer.join(others, ["q", "frag"]).where("abs(at - place) > 1")
              .select("q", "frag", "n_frag", "n", "place", "d", "s", (F.col("s") + F.col("at")).alias("p"), "part", "kind"))
    seen = wanted.join(index, ["d", "p"]).where(_fits(F.col("word"), F.col("part"), F.col("kind")))
    known = 1 + (F.col("place") > 0).cast("int") + (F.col("place") < F.col("n") - 1).cast("int")
    whole = seen.groupBy("q", "frag", "n_frag", "n", "place", "d", "s").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == F.col("n") - known).drop("k", "place")
    found = whole.unionByName(single)
    if not gaps:
        return found.select("q", "d").unionByName(read).distinct().select(F.col("q").alias(quote_key), F.col("d").alias(doc_key))
    return _follow(found, frags, index).select(F.col("q").alias(quote_key), F.col("d").alias(doc_key))


def _with_neighbours(words: Column) -> Column:
    return F.transform(words, lambda w, i: F.struct(i.alias("p"), w.alias("word"), F.get(words, i - 1).alias("before"), F.get(words, i + 1).alias("after")))


def _fits(word: Column, part: Column, kind: Column) -> Column:
    """Whether a word of the text can stand where a fragment of several words has ``part``."""
    return F.when(kind == "whole", word == part).when(kind == "end", F.endswith(word, part)).otherwise(F.startswith(word, part))


def _follow(found: DataFrame, frags: DataFrame, index: DataFrame) -> DataFrame:
    """``q, d`` where the fragments of a quote follow each other.

    The places of a quote's fragments in one text are few, so they are ordered in one row and taken greedily: the earliest place of a
    fragment that lies behind the end of the one before. Places are character spans (word position, offset in the word)."""
    first = frags.where("place = 0").select("q", "frag", F.col("word").alias("head"))
    last = frags.where("place = n - 1").select("q", "frag", F.col("word").alias("tail"))
    spans = (found.join(first, ["q", "frag"]).join(last, ["q", "frag"])
             .join(index.select("d", F.col("p").alias("s"), F.col("word").alias("w")), ["d", "s"]))
    # Where a fragment starts and ends inside the words of the text. One word may hold a one-word fragment several times.
    at = F.when(F.col("n") > 1, F.array(F.length("w") - F.length("head"))).otherwise(
        F.filter(F.sequence(F.lit(0), F.greatest(F.length("w") - F.length("head"), F.lit(0))), lambda i: F.substr(F.col("w"), (i + 1).cast("int"), F.length("head")) == F.col("head")))
    placed = spans.select("q", "d", "n_frag", "frag", "s", "n", F.length("tail").alias("len"), F.explode(at).alias("o"))
    begin = F.struct(F.col("s").alias("p"), F.col("o").cast("int").alias("o"))
    end = F.struct((F.col("s") + F.col("n") - 1).cast("int").alias("p"), F.when(F.col("n") > 1, F.col("len")).otherwise(F.col("o") + F.col("len")).cast("int").alias("o"))
    places = placed.groupBy("q", "d", "n_frag", "frag").agg(F.array_sort(F.collect_list(F.struct(begin.alias("b"), end.alias("e")))).alias("at"))
    rows = (places.groupBy("q", "d", "n_frag").agg(F.array_sort(F.collect_list(F.struct("frag", "at"))).alias("fs")).where(F.size("fs") == F.col("n_frag")))

    def step(acc: Column, f: Column) -> Column:
        """``acc``: the end of the fragments so far, NULL once one does not fit."""
        after = F.filter(f["at"], lambda x: x["b"] >= acc)
        return F.when(acc.isNotNull(), F.get(after, F.lit(0))["e"])

    zero = F.struct(F.lit(-1).alias("p"), F.lit(0).alias("o"))
    return rows.where(F.reduce("fs", zero, step).isNotNull()).select("q", "d")
