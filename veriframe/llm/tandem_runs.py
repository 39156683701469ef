"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a longest stretch of words that repeats itself with a smallest period. Where a run of period q ends stands a square of q that
cannot be moved right (it branches): two suffixes q words apart whose common prefix is exactly q words. Such pairs are found on the LCP
intervals of the suffix array: for an interval of depth d, every suffix i of all but its largest child looks, through the inverse suffix
array, whether suffix i + d or i - d is in the interval too. That is O(n log n) looks. Squares are then rotated left as far as the period
holds, and what one smallest period explains is merged into one run.

Nothing is a tree: suffix array, LCP, interval bounds and children are arrays, and many documents are handled in one array. Words are
numbered per document, so documents share no suffix order, and a document ends with a symbol of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import by_value

#: Words of one array; a longer document is one array on its own.
SLICE_WORDS = 300_000
#: Suffixes that look for a partner at a time.
LOOKS = 1_000_000


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse and, for each k, the order of the prefixes of 2**k symbols (equal numbers: equal prefixes).

    Prefix doubling; only suffixes that still share their prefix are sorted again. The last symbol of every document stands once."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    head = np.concatenate([[True], codes[order][1:] != codes[order][:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, width = [rank.astype(np.int32)], 1
    while True:
        size = np.diff(np.append(np.flatnonzero(head), n))
        open_at = np.flatnonzero(np.repeat(size > 1, size))  # places of the suffix array that are not settled
        if not len(open_at):
            break
        who = order[open_at]
        # The end symbol stands once, so a shared prefix of ``width`` symbols ends before it.
        key = rank[who] * np.int64(n) + rank[who + width]
        again = np.argsort(key, kind="stable")
        who, key = who[again], key[again]
        order[open_at] = who
        head[open_at] = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[who] = np.maximum.accumulate(np.where(head[open_at], open_at, 0))
        levels.append(rank.astype(np.int32))
        width *= 2
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    return order, inverse, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix in order and the one before it (0 for the first)."""
    a, b, lcp = order[:-1], order[1:], np.zeros(len(order), np.int64)
    at = np.zeros(max(len(order) - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        # Before the end symbols differ both places are inside the array.
        same = np.flatnonzero(levels[k][a + at] == levels[k][b + at])
        at[same] += 1 << k
    lcp[1:] = at
    return lcp


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest place before (else 0) and after (else n) with a smaller value, by halving over minima of 2**k places.

    ``values[0]`` must be smaller than all others that ask."""
    n = len(values)
    minima = [values]
    while 2 << (len(minima) - 1) <= n:
        half = 1 << (len(minima) - 1)
        minima.append(np.minimum(minima[-1][:-half], minima[-1][half:]))
    right, left = np.arange(1, n + 1), np.arange(n)
    for k in range(len(minima) - 1, -1, -1):
        step, low = 1 << k, minima[k]
        fits = np.flatnonzero(right + step <= n)
        fits = fits[low[right[fits]] >= values[fits]]
        right[fits] += step
        fits = np.flatnonzero(left >= step)
        fits = fits[low[left[fits] - step] >= values[fits]]
        left[fits] -= step
    return np.maximum(left - 1, 0), right


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the stretches that start at ``first`` and have ``size`` places."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def branching_squares(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and depth of every square (twice the same ``depth`` words) that cannot be moved right."""
    n = len(codes)
    order, inverse, levels = suffix_order(codes)
    lcp = common_prefixes(order, levels)
    del levels
    border = np.flatnonzero(lcp > 0)  # each is a border between two children of its interval
    if not len(border):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = nearest_smaller(lcp)
    low, high, depth = low[border], high[border] - 1, lcp[border]
    by = np.lexsort((border, high, low))
    border, low, high, depth = border[by], low[by], high[by], depth[by]
    head = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    interval = np.cumsum(head) - 1
    # Children: from the left bound or a border to the next border or the right bound.
    first = np.concatenate([low[head], border])
    owner = np.concatenate([np.arange(interval[-1] + 1), interval])
    by = np.lexsort((first, owner))
    first, owner = first[by], owner[by]
    last_child = np.append(owner[1:] != owner[:-1], True)
    size = np.where(last_child, high[head][owner] + 1, np.append(first[1:], 0)) - first
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    largest = np.maximum.reduceat(size, heads)
    # Of children of one size the first counts as the largest.
    top = np.flatnonzero(size == largest[owner])
    top = top[np.append(True, owner[top][1:] != owner[top][:-1])]
    small = np.ones(len(first), bool)
    small[top] = False
    first, size, owner = first[small], size[small], owner[small]
    low, high, depth = low[head], high[head], depth[head]
    symbols = np.append(codes, [-1])
    starts, depths, cuts = [], [], np.searchsorted(np.cumsum(size), np.arange(LOOKS, size.sum() + LOOKS, LOOKS), "left") + 1
    for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True):
        i = order[spread(first[a:b], size[a:b])]
        own = np.repeat(owner[a:b], size[a:b])
        d, lo, hi = depth[own], low[own], high[own]
        for start in (i, i - d):
            fits = np.flatnonzero((start >= 0) & (start + 2 * d <= n))
            s, e, x, y = start[fits], d[fits], lo[fits], hi[fits]
            # The partner of i, before or behind it; i itself is in the interval.
            partner = inverse[s + e] if start is i else inverse[s]
            hit = (partner >= x) & (partner <= y) & (symbols[s + e] != symbols[s + 2 * e])
            starts.append(s[hit])
            depths.append(e[hit])
    found = np.unique(np.stack([np.concatenate(starts), np.concatenate(depths)]), axis=1)
    return found[0], found[1]


def rotate(codes: np.ndarray, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The places that squares can be moved left to: as long as the word before equals the word ``depth`` later. Steps double."""
    at, open_at, width = start.copy(), np.arange(len(start)), 16
    while len(open_at):
        going = []
        for part in np.array_split(open_at, max(1, len(open_at) * width // LOOKS)):
            back = at[part, None] - 1 - np.arange(width)
            same = (back >= 0) & (codes[np.maximum(back, 0)] == codes[np.maximum(back, 0) + depth[part, None]])
            moved = np.where(same.all(axis=1), width, same.argmin(axis=1))
            at[part] -= moved
            going.append(part[moved == width])
        open_at, width = np.concatenate(going), min(width * 2, 4096)
    return at


def find_runs(codes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of every run of at least ``least`` words and ``times`` periods.

    ``codes`` holds documents one after another, each with a last symbol that stands nowhere else."""
    start, depth = branching_squares(codes)
    end = start + 2 * depth
    by = np.lexsort((depth, end))
    start, depth, end = start[by], depth[by], end[by]
    found = []
    # At one end the smallest depth that is left is a smallest period: a square whose root is itself periodic ends where the square of
    # that period ends. Its run takes the depths that are multiples with it.
    while len(start):
        head = np.append(True, end[1:] != end[:-1])
        s, d, e = start[head], depth[head], end[head]
        begin = rotate(codes, s, d)
        length = e - begin
        keep = (length >= least) & (length >= times * d)
        found.append(np.stack([begin[keep], length[keep], d[keep]]))
        group = np.cumsum(head) - 1
        left = ~head & ~((depth % d[group] == 0) & (start >= begin[group]))
        start, depth, end = start[left], depth[left], end[left]
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def runs_of(texts: list[list[bytes]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """The runs ``(start, length, period)`` of each word list, by start and period."""
    codes, begins, used = [], [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        begins.append(len(codes))
        codes.extend([used + seen.setdefault(w, len(seen)) for w in words])
        used += len(seen) + 1
        codes.append(used - 1)  # the end of the document
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    start, length, period = find_runs(np.array(codes, np.int64), least, times)
    doc = np.searchsorted(np.array(begins), start, "right") - 1
    for i, s, n, p in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        out[i].append((s - begins[i], n, p))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        change[s + p] += 1
        change[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def planted(key: str, words: list[bytes]) -> list[bytes]:
    """The word list with a periodic rest in one of ten documents, drawn by the CRC-32 of the key."""
    h = zlib.crc32(key.encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    rest = words[a:a + p]
    return words[:a] + (rest * ((n - a) // p + 1))[:n - a]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 24, times: int = 3,
                  rewrite: Callable[[str, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``key, runs, collapsed`` of every row: the runs (``start, length, period`` in words, by start and period) of at least ``least`` words
    and ``times`` periods, and the words that are left, joined by one space, when each run keeps its first period only.

    Words stand between ASCII white space. ``rewrite`` may change the words of a row first. A null text has no words; a null key is passed
    to ``rewrite`` as an empty one; repeated rows give repeated rows; an empty table gives an empty result; other columns play no part,
    whatever their names. A document is one array in its task, some 200 bytes a word at most.
    """
    import pyarrow as pa

    if least < 1 or times < 2:
        raise ValueError("a run has at least one word and two periods")
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"),
                       F.coalesce(F.col(key).cast("string"), F.lit("")).alias("s"))
    kind = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("runs", kind), T.StructField("collapsed", T.BinaryType())])
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            first, texts, size = 0, [], 0
            for i in range(batch.num_rows):
                # bytes.split() cuts at 0x20 and 0x09-0x0D, which is the white space of the definition.
                words = batch.column(1)[i].as_py().split()
                texts.append(rewrite(batch.column(2)[i].as_py(), words) if rewrite else words)
                size += len(texts[-1])
                if size >= SLICE_WORDS or i == batch.num_rows - 1:
                    found = runs_of(texts, least, times)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(texts)),
                         pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in found], arrow),
                         pa.array([b" ".join(collapse(w, r)) for w, r in zip(texts, found, strict=True)], pa.binary())], names=schema.names)
                    first, texts, size = i + 1, [], 0

    done = rows.mapInArrow(run, schema)
    return done.select(F.col("k").alias(key), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row the number of runs, the run with the greatest length / period (ties: smallest start, then period) and digests."""
    by = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]  # noqa: E731  exact comparison of length / period
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda top, r: F.when(by(r, top) > 0, r).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return (found.withColumn("_best", best)
            .select(key, F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
                    F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


def summary_sql() -> str:
    """The summary of ``planted`` documents in DuckDB SQL: equal words of a document paired by distance, stretches of neighbouring pairs."""
    crc = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""
    return r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CRC32 AS h FROM documents),
    a AS (SELECT r, doc_id, w, h % 10 = 0 AND len(w) > 0 AS made, (h // 10) % greatest(len(w), 1) AS a, 1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM d),
    t AS (SELECT r, doc_id, CASE WHEN made THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] for i in range(0, len(w))] ELSE w END AS w FROM a),
    k AS (SELECT r, len(w) AS n, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS w FROM t),
    q AS (SELECT x.r, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
    g AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM q),
    s AS (SELECT r, min(i) AS start, count(*) + q AS length, q AS period FROM g GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
    m AS (SELECT r, start, length, min(period) AS period FROM s GROUP BY r, start, length),
    o AS (SELECT r, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, count(*) AS n_runs FROM m GROUP BY r),
    b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1),
    x AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM m),
    c AS (SELECT k.r, string_agg(k.w, ' ' ORDER BY k.i) AS words FROM k ANTI JOIN x ON x.r = k.r AND x.i = k.i GROUP BY k.r)
    SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start, b.length::BIGINT AS length, b.period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
      sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
    FROM t LEFT JOIN o USING (r) LEFT JOIN b USING (r) LEFT JOIN c USING (r)""".replace("CRC32", crc)


by_value(__name__)
