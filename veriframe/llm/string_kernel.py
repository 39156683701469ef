"""Language identification with a string kernel.

A text is the set of its character n-grams for n = 1..3 (blended spectrum, presence only), over lower-cased letters with every other
character as one separator. The kernel of two texts is the number of shared n-grams over the geometric mean of their set sizes.
A bounded sample of labelled texts gives landmarks; kernel values with the landmarks, whitened (Nyström), are the features of a
one-versus-rest ridge regression. A batch of texts is scored by matrix products: presence x landmarks, then kernel values x weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import LETTER, class_table, slices
from .shipping import Shared, by_value

#: Bounds of the fit: labelled texts in the sample, landmarks, n-grams, languages.
SAMPLE, LANDMARKS, GRAMS, LANGUAGES = 2000, 128, 6000, 200
RIDGE = 1e-2
BATCH = 512
SLICE_CHARS = 2_000_000
UNKNOWN = "und"
#: A document passes if its score is above this quantile of held-out labelled documents of its language, moved by a share of the way
#: towards the score of no evidence, 1 / languages, as the quantile of a few documents is uncertain.
QUANTILE, MARGIN = 0.005, 0.25
STEPS = 1000
SEPARATOR = 1  # stands for every character that is no letter; letters stand for themselves


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def letters(letter: np.ndarray) -> np.ndarray:
    """Code point by code point: its lower case if it is a letter, else the separator."""
    points = np.flatnonzero(letter)
    out = np.full(len(letter), SEPARATOR, np.int64)
    out[points] = [ord(c) if len(c := chr(p).lower()) == 1 else p for p in points.tolist()]
    return out


def grams(points: np.ndarray) -> np.ndarray:
    """The distinct n-grams of one mapped text, packed into integers."""
    if not len(points):
        return np.zeros(0, np.int64)
    two = points[:-1] << 21 | points[1:]
    every = np.unique(np.concatenate([points, two, two[:-1] << 21 | points[2:]]))
    return every[~np.isin(every, [SEPARATOR, SEPARATOR << 21 | SEPARATOR, (SEPARATOR << 21 | SEPARATOR) << 21 | SEPARATOR])]


def sample_grams(docs: DataFrame, key: str, text: str, label: str, learn: Column, size: int = SAMPLE) -> list[tuple[str, np.ndarray]]:
    """The n-gram sets of a bounded sample of labelled texts: of each language those with the least key hash."""
    import pyarrow as pa

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("y"), learn.alias("use")).where("use AND y IS NOT NULL AND t IS NOT NULL AND k IS NOT NULL")
    order = F.xxhash64(F.col("k"), F.lit("sample"))
    sizes = rows.groupBy("y").count().orderBy(F.desc("count"), "y").limit(LANGUAGES).collect()
    each = max(10, size // max(1, len(sizes)))
    # The least hashes come from the share of the hash range that is expected to hold twice as many; a language with fewer is read whole.
    limits = {r["y"]: min(1.0, 2.0 * each / r["count"] + 30.0 / r["count"]) for r in sizes}
    if not limits:
        return []
    share = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    unit = order.cast("double") / 2.0 ** 64 + 0.5
    chosen = rows.where(unit <= F.try_element_at(share, F.col("y"))).select("t", "y", order.alias("o"))
    mapped = Shared(docs.sparkSession, class_table().tobytes())

    def run(batches):
        table = mapped.derived(lambda value: letters(np.frombuffer(value, np.uint8) == LETTER))
        for batch in batches:
            sets = [grams(table[np.frombuffer(t.encode("utf-32-le"), np.uint32)]).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), batch.column(1), batch.column(2)], names=["g", "y", "o"])

    got: dict[str, list] = {}
    for r in sorted(chosen.mapInArrow(run, "g binary, y string, o long").collect(), key=lambda r: (r["o"], r["g"])):
        if len(own := got.setdefault(r["y"], [])) < each:
            own.append(np.frombuffer(r["g"], np.int64))
    return [(y, g) for y in sorted(got) for g in got[y] if len(g)]


def presence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(vocabulary)), np.float32)
    for row, g in zip(out, sets, strict=True):
        at = np.minimum(np.searchsorted(vocabulary, g), len(vocabulary) - 1)
        row[at[vocabulary[at] == g]] = 1
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sizes = np.sqrt(np.outer(a.sum(axis=1), b.sum(axis=1)))
    return (a @ b.T) / np.maximum(sizes, 1)


def fit(sample: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, most: int = GRAMS, ridge: float = RIDGE) -> dict | None:
    """The model as plain arrays; None if there is nothing to learn from."""
    if not sample:
        return None
    languages = sorted({y for y, _ in sample})
    found, count = np.unique(np.concatenate([g for _, g in sample]), return_counts=True)
    keep = np.lexsort((found, -count))[:most]
    vocabulary = np.sort(found[keep])
    x = presence([g for _, g in sample], vocabulary)
    y = np.array([[float(own == lang) for lang in languages] for own, _ in sample])
    each = max(1, landmarks // len(languages))
    place = [i for lang in languages for i in [j for j, (own, _) in enumerate(sample) if own == lang][:each]]
    mark = x[place]
    values, vectors = np.linalg.eigh(kernel(mark, mark).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = kernel(x, mark) @ whiten
    mean, base = features.mean(axis=0), y.mean(axis=0)
    centred = features - mean
    weights = np.linalg.solve(centred.T @ centred + ridge * len(sample) * np.eye(centred.shape[1]), centred.T @ (y - base))
    return {"languages": languages, "vocabulary": vocabulary, "landmarks": mark, "weights": (whiten @ weights).astype(np.float32),
            "bias": (base - mean @ weights).astype(np.float32), "classes": class_table().tobytes()}


class Scorer:
    """Lookup tables of a model and the batched products."""

    def __init__(self, model: dict):
        self.model = model
        table = np.frombuffer(model["classes"], np.uint8)
        self.letter = table == LETTER
        mapped = letters(self.letter)
        mask = (1 << 21) - 1
        split = [(v >> 42, v >> 21 & mask, v & mask) for v in model["vocabulary"].tolist()]
        chars = sorted({c for t in split for c in t if c})
        number = {c: i + 1 for i, c in enumerate(chars)}
        a = len(chars) + 1
        of = np.zeros(int(mapped.max()) + 1, np.int32)
        of[chars] = np.arange(1, a)
        self.char = of[mapped]
        self.one = np.full(a, -1, np.int32)
        self.two = np.full(a * a, -1, np.int32)
        self.pair = np.zeros(a * a, np.int32)
        pairs = sorted({(x, y) for x, y, _ in split if x})
        for i, (x, y) in enumerate(pairs):
            self.pair[number[x] * a + number[y]] = i + 1
        self.three = np.full((len(pairs) + 1) * a, -1, np.int32)
        for i, (x, y, z) in enumerate(split):
            if x:
                self.three[self.pair[number[x] * a + number[y]] * a + number[z]] = i
            elif y:
                self.two[number[y] * a + number[z]] = i
            else:
                self.one[number[z]] = i
        self.size, self.a = len(split), a

    def presence(self, char: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Presence of the known n-grams in n texts given as character numbers; number 0 stands between texts."""
        out = np.zeros(n * self.size, np.uint8)
        pair = char[:-1] * self.a + char[1:]
        for at, gram in ((0, self.one[char]), (1, self.two[pair]), (2, self.three[self.pair[pair[:-1]] * self.a + char[2:]])):
            known = gram >= 0
            out[owner[at:][known] * self.size + gram[known]] = 1
        return out.reshape(n, self.size)

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        marks = self.model["landmarks"]
        roots = np.sqrt(marks.sum(axis=1))
        for begin in range(0, len(texts), BATCH):
            part = texts[begin:begin + BATCH]
            x, lettered = np.zeros((len(part), self.size), np.uint8), np.zeros(len(part), bool)
            for a, b in slices(part, SLICE_CHARS):
                points = np.frombuffer("\0".join(part[a:b]).encode("utf-32-le"), np.uint32)
                owner = np.repeat(np.arange(a, b), [len(t) + 1 for t in part[a:b]])[:len(points)]
                breaks = np.cumsum([len(t) + 1 for t in part[a:b]])[:-1] - 1
                char = self.char[points]
                char[breaks] = 0
                lettered[np.unique(owner[self.letter[points]])] = True
                if len(char) > 2:
                    x[a:b] = self.presence(char, owner - a, b - a)
                elif len(char):
                    x[a:b] = self.presence(np.concatenate([char, np.zeros(2, char.dtype)]), np.append(owner - a, [0, 0]), b - a)
            x = x.astype(np.float32)
            k = (x @ marks.T) / np.maximum(np.outer(np.sqrt(x.sum(axis=1)), roots), 1)
            value = k @ self.model["weights"] + self.model["bias"]
            blank = x.sum(axis=1) == 0
            best = value.argmax(axis=1)
            value[blank] = 0  # nothing that is known stands in the text: a language all the same, but no evidence
            for i in np.flatnonzero(lettered).tolist():
                names[begin + i] = self.model["languages"][best[i]]
                scores[begin + i] = min(1.0, max(0.0, float(value[i, best[i]])))
        return names, scores


def predict(docs: DataFrame, model: dict | None, carry: list[Column], text: str = "text") -> DataFrame:
    """The carried columns with ``lang_pred`` and ``score``, for every row."""
    import pyarrow as pa

    rows = docs.select(*carry, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    names = rows.columns[:-1]
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = Shared(docs.sparkSession, model)

    def run(batches):
        scorer = shared.derived(lambda m: Scorer(m) if m else None)
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            lang, score = scorer.score(texts) if scorer else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(lang, pa.string()), pa.array(score)],
                                             names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``key, held_out, lang_pred, score`` for every document.

    Learned from text and label of the documents that are not held out (crc32 of the key as text, modulo 5, is 0) and have a label,
    a bounded sample of them. Text without letters and null text are ``und`` with score 0; so is everything if there are no labels.
    A null key counts as not held out and is not learned from; repeated rows give repeated rows; an empty table gives an empty result;
    other columns play no part.
    """
    model = fit(sample_grams(docs, key, text, label, ~held_out(F.col(key))))
    return predict(docs, model, [F.col(key).alias("k"), held_out(F.col(key)).alias("held_out")], text).withColumnRenamed("k", key)


def least_scores(docs: DataFrame, model: dict | None, key: str, text: str, label: str, quantile: float = QUANTILE) -> tuple[dict[str, float], float]:
    """By predicted language the score that a document must exceed, and that of languages without held-out labelled documents.

    The quantile is over all labelled documents that are held out, exact to a step of 1 / STEPS, from counts of steps."""
    if model is None:
        return {}, 0.0
    held = docs.where(held_out(F.col(f"`{key}`")) & F.col(f"`{label}`").isNotNull()).select(F.col(f"`{text}`").alias("t"))
    steps = (predict(held, model, [], "t").where(F.col("lang_pred") != UNKNOWN)
             .groupBy("lang_pred", F.floor(F.col("score") * STEPS).alias("step")).count().collect())
    chance = 1 / len(model["languages"])

    def least(rows) -> float:
        rows, total, upto = sorted((r["step"], r["count"]) for r in rows), sum(r["count"] for r in rows), 0
        for step, count in rows:
            upto += count
            if upto >= total * quantile:
                return max(0.0, step / STEPS + MARGIN * (chance - step / STEPS))
        return 0.0

    return {y: least([r for r in steps if r["lang_pred"] == y]) for y in {r["lang_pred"] for r in steps}}, least(steps)


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` whose language is identified with a score above the least of that language, with their columns.

    Text without letters, in a language that no label names, or of no language goes, as its score is lower than that of nearly all
    held-out labelled documents. A null label is filled with the language that is predicted; other labels stay as they are."""
    model = fit(sample_grams(docs, key, text, label, ~held_out(F.col(key))))
    least, pooled = least_scores(docs, model, key, text, label, quantile)
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("lang_pred")), F.lit(pooled)) if least else F.lit(pooled)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = predict(docs.select(whole, F.col(f"`{text}`").alias("judged")), model, [F.col("row")], "judged")
    named = lambda c: F.coalesce(F.col(f"row.`{c}`"), F.col("lang_pred")).alias(c) if c == label else F.col(f"row.`{c}`")
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > limit)).select(*[named(c) for c in docs.columns])


by_value(__name__)
