"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Two models share the count tables. One predicts the characters of a word, and its end, from up to three characters before, from the
word's beginning on. The other looks across words: it predicts how long ago a word last stood in the text (never, one word ago, two,
three to four, five to eight and so on) from the same of up to three words before, so that text which repeats itself as trusted text
never does is as perplexing as text of strange letters. An n-gram is a 64-bit number, 16 bits a symbol; symbols of the second model are
surrogates, which are no characters. Counts are tables spread by n-gram: raw counts at the highest order and for
n-grams at a beginning, continuation counts below. The n-grams of the corpus are joined with the counts, their contexts and
their shorter forms, order by order, which gives each distinct n-gram its log probability; documents then add up those of their
words. Both perplexities are compared with a quantile of trusted documents of the same language, taken over a fifth of them that the
counts do not include, since a model finds the text that it has counted too easy.

The table of log probabilities is broadcast in shards of at most ``SHARD`` n-grams. Every shard adds its part to the rows that come from
the one before, in one scan of the documents, so that rows need no identity.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .pretokens import slices
from .shipping import Shared, by_value

ORDER = 4
BEGIN, END, STRANGE = 2, 3, 0xFFFF
#: Symbols of the word model: RECENT for a new word, RECENT + 1 for a repeat of the last word, then one for each doubling; FIRST before a text.
RECENT, FIRST = 0xD800, 0xD8FF
SHARD = 4_000_000
SLICE_CHARS = 2_000_000
#: A document is judged as if it held this many more characters of average text, so that a few rare ones do not condemn a short text.
PRIOR = 60
#: The same for its words.
PRIOR_WORDS = 12
QUANTILE = 0.995
#: How far above the quantile a perplexity may lie: the quantile of a few held-out documents is uncertain.
SLACK = 1.25
#: The same for word order, where a text has fewer symbols.
SLACK_WORDS = 1.3
BINS = 1000
POOLED = "*"


class Words:
    """Words between ASCII white space in a slice of texts: the distinct ones, and which stands where."""

    def __init__(self, texts: list[str]):
        import pyarrow as pa

        kind = np.arange(256)
        space = (kind == 0x20) | (kind >= 9) & (kind <= 13)
        plain = np.where(np.isin(kind, [0, BEGIN, END]), 0x1A, kind).astype(np.uint8)
        values = np.frombuffer("\n".join(texts).encode(), np.uint8)
        part = ~space[values]
        edge = np.flatnonzero(np.diff(part, prepend=False, append=False))
        size = edge[1::2] - edge[::2]
        offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)])
        spans = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(plain[values[part]])])
        coded = spans.dictionary_encode()
        self.distinct, self.which = coded.dictionary, coded.indices.to_numpy()
        begins = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t.encode()) + 1 for t in texts], dtype=np.int64)])
        self.bounds = np.searchsorted(edge[::2], begins)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The n-gram of every predicted character of the distinct words, and the word it belongs to."""
        words = self.distinct.to_pylist()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = b"\x02" + b"\x03\x02".join(words) + b"\x03"
        symbol = np.minimum(np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32), STRANGE).astype(np.uint64)
        first = symbol == BEGIN
        owner = np.cumsum(first) - 1
        place = np.arange(len(symbol)) - np.flatnonzero(first)[owner]
        code = symbol.copy()
        for back in range(1, ORDER):
            code[back:] |= np.where(place[back:] >= back, symbol[:-back] << np.uint64(16 * back), np.uint64(0))
        return code[~first].view(np.int64), owner[~first]

    def recency(self) -> np.ndarray:
        """The n-gram of every word's distance to the same word before it in its text."""
        n = len(self.which)
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        order = np.argsort(text * max(len(self.distinct), 1) + self.which, kind="stable")
        same = (self.which[order][1:] == self.which[order][:-1]) & (text[order][1:] == text[order][:-1])
        symbol = np.full(n, RECENT, np.uint64)
        symbol[order[1:][same]] += np.frexp(np.diff(order)[same] - 0.5)[1].astype(np.uint64) + np.uint64(1)
        place = np.arange(n) - self.bounds[text]
        code = symbol.copy()
        for back in range(1, ORDER):
            before = np.concatenate([np.zeros(min(back, n), np.uint64), symbol[:-back]])
            code |= np.where(place >= back, before, np.where(place == back - 1, np.uint64(FIRST), np.uint64(0))) << np.uint64(16 * back)
        return code.view(np.int64)

    def per_text(self, of_word: np.ndarray) -> np.ndarray:
        """Sums over the words of each text of a value of the distinct words."""
        return self.per_place(of_word[self.which])

    def per_place(self, value: np.ndarray) -> np.ndarray:
        """Sums over the words of each text of a value of every word in its place."""
        total = np.concatenate([np.zeros(1), np.cumsum(value)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def gram_counts(texts: DataFrame, text: str) -> DataFrame:
    """``g, c``: n-grams of all texts with how often each stands there. Counted per batch first, so that a frequent one costs one row a batch."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            whole = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(whole, SLICE_CHARS):
                words = Words(whole[a:b])
                code, owner = words.grams()
                found, at = np.unique(code, return_inverse=True)
                often = np.bincount(words.which, minlength=len(words.distinct))
                count = np.bincount(at, weights=often[owner], minlength=len(found)).astype(np.int64)
                recent, times = np.unique(words.recency(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([found, recent])), pa.array(np.concatenate([count, times]))], names=["g", "c"])

    return texts.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _length(g: Column) -> Column:
    return sum((F.shiftrightunsigned(g, 16 * i) != 0).cast("int") for i in range(ORDER))


def _suffix(g: Column, order: int) -> Column:
    return g.bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1).cast("long"))


def _of_words(g: Column) -> Column:
    """Whether an n-gram predicts a symbol of the word model."""
    return g.bitwiseAND(F.lit(0xFF00).cast("long")) == RECENT


def adjusted_counts(raw: DataFrame) -> dict[int, DataFrame]:
    """Counts by order: raw ones at the highest order and at a beginning, else the number of different left neighbours."""
    sized = raw.withColumn("k", _length(F.col("g")))
    own = {k: sized.where(F.col("k") == k).select("g", "c") for k in range(1, ORDER + 1)}
    out = {ORDER: own[ORDER]}
    for k in range(ORDER - 1, 0, -1):
        continued = out[k + 1].select(_suffix(F.col("g"), k + 1).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
        out[k] = cut_lineage(own[k].unionByName(continued))
    return out


def discounts(adjusted: dict[int, DataFrame]) -> dict[tuple[int, bool], tuple[float, float, float]]:
    """Discounts for counts of one, two, and three or more, by order and model, from the numbers of n-grams with counts one to four."""
    seen = {(r["k"], r["w"], r["c"]): r["n"] for r in reduce(DataFrame.unionByName, [
        d.where("c <= 4").groupBy(_of_words(F.col("g")).alias("w"), "c").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(k))
        for k, d in adjusted.items()]).collect()}
    out = {}
    for k, w in product(adjusted, (False, True)):
        n = [0, *(seen.get((k, w, c), 0) for c in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        out[k, w] = tuple(min(c, max(0.1, c - (c + 1) * y * n[c + 1] / n[c])) if n[c] else 0.5 * c for c in (1, 2, 3))
    return out


def log_probabilities(asked: DataFrame, adjusted: dict[int, DataFrame]) -> DataFrame:
    """``g, logp`` for every n-gram asked for. Each order joins the counts, the context's totals and the next shorter form."""
    cut = discounts(adjusted)
    size = {r["w"]: r["count"] for r in adjusted[1].groupBy(_of_words(F.col("g")).alias("w")).count().collect()}
    symbols = F.when(_of_words(F.col("g")), size.get(True, 0) + 1).otherwise(size.get(False, 0) + 1)
    sized = asked.withColumn("k", _length(F.col("g")))
    wanted = {k: sized.where(F.col("k") == k).select("g") for k in range(1, ORDER + 1)}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = cut_lineage(wanted[k].unionByName(wanted[k + 1].select(_suffix(F.col("g"), k + 1).alias("g"))).distinct())
    shorter = None
    for k in range(1, ORDER + 1):
        one, two, more = (F.when(_of_words(F.col("g")), of_word).otherwise(of_character) for of_word, of_character in zip(cut[k, True], cut[k, False]))
        taken = F.when(F.col("c") == 1, one).when(F.col("c") == 2, two).otherwise(more)
        # Without symbols before, the context is the model.
        context = _of_words(F.col("g")).cast("long") if k == 1 else F.shiftrightunsigned("g", 16)
        contexts = (adjusted[k].groupBy(context.alias("h"))
                    .agg(F.sum("c").cast("double").alias("total"), F.sum(taken).alias("left_over")))
        rows = (wanted[k].withColumn("h", context).join(adjusted[k], "g", "left").join(contexts, "h", "left"))
        own = F.coalesce((F.col("c") - taken) / F.col("total"), F.lit(0.0))
        rest = F.coalesce(F.col("left_over") / F.col("total"), F.lit(1.0))
        if shorter is None:
            rows = rows.select("g", (own + rest / symbols).alias("p"))
        else:
            rows = (rows.withColumn("s", _suffix(F.col("g"), k)).join(shorter.select(F.col("g").alias("s"), F.col("p").alias("q")), "s")
                    .select("g", (own + rest * F.col("q")).alias("p")))
        shorter = cut_lineage(rows)
        wanted[k] = shorter
    return (reduce(DataFrame.unionByName, wanted.values()).join(asked.select("g"), "g", "left_semi")
            .select("g", F.log("p").cast("float").alias("logp")))


class Model:
    """Broadcast shards of the table of log probabilities."""

    def __init__(self, table: DataFrame, shard: int = SHARD):
        table = cut_lineage(table)
        size = table.count()
        n = max(1, -(-size // shard))
        self.shards = []
        for i in range(n):
            got = table.where(F.pmod(F.xxhash64("g"), F.lit(n)) == i).orderBy("g").toArrow()
            self.shards.append(Shared(table.sparkSession, (got.column("g").to_numpy(), got.column("logp").to_numpy())))


SUMS = ("nll", "n", "order_nll", "words")


def _add_scores(rows: DataFrame, shared: Shared) -> DataFrame:
    """``rows`` (the text last but for ``SUMS``) with a shard's part added to the sums."""
    import pyarrow as pa

    at_text = len(rows.columns) - len(SUMS) - 1

    def run(batches):
        known, logp = shared.derived(lambda value: value)

        def look_up(code):
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            hit = known[at] == code if len(known) else np.zeros(len(code), bool)
            return np.where(hit, -logp[at] if len(known) else 0, 0), hit

        for batch in batches:
            texts, parts = batch.column(at_text).to_pylist(), []
            for a, b in slices(texts, SLICE_CHARS):
                words = Words(texts[a:b])
                code, owner = words.grams()
                cost, hit = look_up(code)
                of_word = [np.bincount(owner, weights=v, minlength=len(words.distinct)) for v in (cost, hit)]
                parts.append([*map(words.per_text, of_word), *map(words.per_place, look_up(words.recency()))])
            sums = [np.concatenate([p[i] for p in parts] or [np.zeros(0)]) + batch.column(at_text + 1 + i).to_numpy() for i in range(len(SUMS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_text + 1], *map(pa.array, sums)], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def score(docs: DataFrame, carry: list[Column], text: str, model: Model) -> DataFrame:
    """The carried columns with ``nll`` (negative log probability) and ``n`` (characters), ``order_nll`` and ``words`` of every whole text."""
    rows = docs.select(*carry, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"), *[F.lit(0.0).alias(c) for c in SUMS])
    for shard in model.shards:
        rows = _add_scores(rows, shard)
    return rows.drop("_text").withColumns({c: F.col(c).cast("long") for c in ("n", "words")})


def train(docs: DataFrame, trusted: DataFrame, text: str) -> Model:
    """The model of ``trusted`` texts, with the log probability of every n-gram that stands in ``docs``."""
    adjusted = adjusted_counts(cut_lineage(gram_counts(trusted, text)))
    asked = cut_lineage(gram_counts(docs, text).select("g"))
    return Model(log_probabilities(asked, adjusted))


def smoothed(mean: Column, prior: int = PRIOR, nll: str = "nll", n: str = "n") -> Column:
    """Log perplexity a symbol, with the prior."""
    return (F.col(nll) + prior * mean) / (F.col(n) + prior)


def thresholds(scores: DataFrame, quantile: float = QUANTILE, prior: int = PRIOR, slack: float = SLACK) -> DataFrame:
    """``lang, mean, threshold`` of trusted documents' ``lang, nll, n``, and a pooled row for languages without any. The quantile is
    exact to a step of 1 / BINS, from counts of steps."""
    both = scores.select("lang", "nll", "n").unionByName(scores.select(F.lit(POOLED).alias("lang"), "nll", "n"))
    means = both.groupBy("lang").agg((F.sum("nll") / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    steps = (both.join(F.broadcast(means), "lang").groupBy("lang", "mean", F.ceil(smoothed(F.col("mean"), prior) * BINS).alias("step"))
             .agg(F.count(F.lit(1)).alias("m")))
    # One language has at most a few thousand steps.
    upto = Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("lang")
    return (steps.withColumns({"upto": F.sum("m").over(upto), "all": F.sum("m").over(every)}).where(F.col("upto") >= F.ceil(F.col("all") * quantile))
            .groupBy("lang").agg(F.first("mean").alias("mean"), (F.min("step") / BINS + float(np.log(slack))).alias("threshold")))


def _limits(scored: DataFrame, quantile: float) -> DataFrame:
    """``lang, mean, threshold, order_mean, order_threshold``: the limits of both models from trusted documents."""
    order = thresholds(scored.select("lang", F.col("order_nll").alias("nll"), F.col("words").alias("n")), quantile, PRIOR_WORDS, SLACK_WORDS)
    return thresholds(scored, quantile).join(order.select("lang", F.col("mean").alias("order_mean"), F.col("threshold").alias("order_threshold")), "lang")


def _judged(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """``scored`` with ``perplexity, threshold, order_perplexity, order_threshold, keep``. The limits are one row a language; they are few
    beside the documents."""
    names = [c for c in limits.columns if c != "lang"]
    pooled = limits.where(F.col("lang") == POOLED).first()
    out = (scored.join(limits.where(F.col("lang") != POOLED), "lang", "left")
           .withColumns({c: F.coalesce(c, F.lit(pooled[c] if pooled else None).cast("double")) for c in names}))
    levels = {"level": smoothed(F.coalesce("mean", F.lit(0.0))),
              "order_level": smoothed(F.coalesce("order_mean", F.lit(0.0)), PRIOR_WORDS, "order_nll", "words")}
    within = (F.col("level") <= F.col("threshold")) & (F.col("order_level") <= F.col("order_threshold"))
    return (out.withColumns({c: F.coalesce(level, F.lit(0.0)) for c, level in levels.items()})
            .withColumns({"perplexity": F.exp("level"), "order_perplexity": F.exp("order_level"), "keep": F.coalesce(within, F.lit(True))})
            .withColumns({c: F.exp(c) for c in ("threshold", "order_threshold")}).drop("mean", "order_mean", *levels))


def _language(lang: str) -> Column:
    return F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang")


def _fitted(docs: DataFrame, trusted_ids: DataFrame, key: str, text: str, lang: str, quantile: float):
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("_k")).where("_k IS NOT NULL").distinct()
    calibrating = F.crc32(F.col("_k").cast("string")) % 5 == 0
    trusted = (docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t")).where(~calibrating)
               .join(ids.where(~calibrating).hint("merge"), "_k", "left_semi"))  # ids grow with the documents: never broadcast
    named = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t"), _language(lang))
    model = train(named, trusted, "_t")
    scored = cut_lineage(score(named, [F.col("_k"), F.col("lang")], "_t", model))
    return model, scored, cut_lineage(_limits(scored.join(ids.where(calibrating), "_k", "left_semi"), quantile))


def classify(docs: DataFrame, trusted_ids: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             quantile: float = QUANTILE) -> DataFrame:
    """``key, lang, perplexity, threshold, order_perplexity, order_threshold, keep`` for every document; ``keep``: perplexity (a character) and
    order perplexity (a word) up to their language's thresholds.

    ``trusted_ids`` names the trusted documents in its first column: the counts are made from all whose key is not held out (crc32 of the key
    as text, modulo 5, is 0), the thresholds from all that are. A language without held-out documents takes the pooled threshold; without any everything is kept. A null or blank text has the mean
    perplexity of its language and is kept; a null language is ``und``. Null keys are scored and never trusted; repeated rows give repeated
    rows and count as often; empty tables give an empty result; other columns play no part.
    """
    _, scored, limits = _fitted(docs, trusted_ids, key, text, lang, quantile)
    return _judged(scored, limits).select(F.col("_k").alias(key), "lang", "perplexity", "threshold", "order_perplexity", "order_threshold", "keep")


def keep_fluent(docs: DataFrame, trusted_ids: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns, repeated rows as often as they stand there; an empty table gives an empty one.
    Rows are scored a second time beside their texts, so that no text is shuffled to meet its verdict."""
    model, _, limits = _fitted(docs, trusted_ids, key, text, lang, quantile)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    scored = score(docs.select(whole, F.col(f"`{text}`").alias("_t"), _language(lang)), [F.col("_row"), F.col("lang")], "_t", model)
    return _judged(scored, limits).where("keep").select("_row.*")


by_value(__name__)
