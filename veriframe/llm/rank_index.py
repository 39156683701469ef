"""Fill-in-middle over a piecewise-linear learned rank index.

A text is cut into tokens (a run of A-Z and a-z letters, or any other single code point). The index maps the rank of a token boundary to
its byte offset: straight segments are fitted so that every boundary lies within ``error`` bytes of its segment, and what is left is
stored in one byte a boundary. A cut is predicted from its segment and corrected by its residual, which is exact. Texts are scanned in
windows, so that beside the text only the residuals grow with it.

Work is on UTF-8 bytes: letters are single bytes, and a code point starts at every byte that is no continuation byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import by_value

#: Bytes that a boundary may lie off its segment. Residuals are signed bytes, so at most 126.
ERROR = 48
WINDOW_BYTES = 1 << 20
#: Boundaries that a segment is tried on at a time.
STRIDE = 512
#: Bytes of output of one Arrow batch.
OUTPUT_BYTES = 16_000_000
#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_BYTES = np.arange(256)
LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128)
CONTINUES = (_BYTES & 0xC0) == 0x80


def boundaries(window: np.ndarray, after_letter: bool) -> np.ndarray:
    """Places in a window of bytes where a token starts."""
    letter = LETTER[window]
    before = np.concatenate([[after_letter], letter[:-1]])
    return np.flatnonzero(~CONTINUES[window] & ~(letter & before))


def fit(offsets: np.ndarray, error: int) -> tuple[np.ndarray, np.ndarray]:
    """First rank and slope of each segment over rising ``offsets``; a segment starts on its first boundary.

    From a segment's start every later boundary allows a range of slopes; the segment ends where the ranges have nothing in common."""
    starts, slopes, i, n = [], [], 0, len(offsets)
    while i < n:
        low, high, j = 0.0, np.inf, i + 1
        while j < n:
            rise = offsets[j:j + STRIDE] - offsets[i]
            run = np.arange(j - i, j - i + len(rise))
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            apart = lows > highs
            fits = int(apart.argmax()) if apart.any() else len(rise)
            if fits:
                low, high = lows[fits - 1], highs[fits - 1]
            j += fits
            if fits < len(rise):
                break
        starts.append(i)
        slopes.append((low + high) / 2 if np.isfinite(high) else 0.0)
        i = j
    return np.array(starts, np.int64), np.array(slopes)


class RankIndex:
    """Byte offset of every token boundary of a text, the end of the text included."""

    def __init__(self, text: bytes, error: int = ERROR):
        if not 1 <= error <= 126:
            raise ValueError("error must be 1 to 126")
        whole, parts, ranks = np.frombuffer(text, np.uint8), [], 0
        for at in range(0, len(text) + 1, WINDOW_BYTES):  # the end of the text is one more boundary
            window = whole[at:at + WINDOW_BYTES]
            offsets = boundaries(window, bool(at and LETTER[whole[at - 1]])) + at
            if at + WINDOW_BYTES > len(text):
                offsets = np.append(offsets, len(text))
            if len(offsets):
                starts, slopes = fit(offsets, error)
                own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(offsets))))
                near = self._line(starts[own], offsets[starts][own], slopes[own], np.arange(len(offsets)))
                parts.append((starts + ranks, offsets[starts], slopes, (offsets - near).astype(np.int8)))
                ranks += len(offsets)
        self.first, self.base, self.slope, self.residual = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.tokens = ranks - 1

    @staticmethod
    def _line(first, base, slope, rank):
        return base + np.rint(slope * (rank - first)).astype(np.int64)

    def predict(self, rank: int) -> int:
        s = int(np.searchsorted(self.first, rank, "right")) - 1
        return int(self._line(self.first[s], self.base[s], self.slope[s], np.int64(rank)))

    def offset(self, rank: int) -> int:
        """Exact byte offset of the boundary before token ``rank``."""
        return self.predict(rank) + int(self.residual[rank])


def code_points(text: bytes) -> int:
    return len(text) - int(np.count_nonzero(CONTINUES[np.frombuffer(text, np.uint8)]))


def transform(text: bytes, key: str, plain_above: int, spm_below: int, error: int) -> tuple[int, str, int | None, int | None, bytes]:
    """``n, form, prefix_chars, middle_chars, output`` of one text; the draws come from the SHA-256 of its key."""
    index = RankIndex(text, error)
    n = index.tokens
    digest = hashlib.sha256(b"1:" + key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= plain_above:
        return n, "plain", None, None, text
    a, b = (index.offset(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return n, "spm", code_points(prefix), code_points(middle), b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", code_points(prefix), code_points(middle), b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", plain_above: int = 90, spm_below: int = 20,
                   error: int = ERROR) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` of every row.

    ``n`` is the number of tokens. Of a hundred draws those from ``plain_above`` on leave the text as it is (``plain``); of the others those
    under ``spm_below`` put the suffix first (``spm``), the rest the prefix (``psm``). Texts that are empty or hold a mark stay plain. A null
    text is empty, a null key draws as an empty one; repeated rows give repeated rows; an empty table gives an empty result; other columns
    play no part, whatever their names.
    """
    import pyarrow as pa

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"),
                       F.coalesce(F.col(key).cast("string"), F.lit("")).alias("s"))
    kinds = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.BinaryType())]
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), *(T.StructField(c, t) for c, t in kinds)])
    arrow = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            first, found, size = 0, [], 0
            for i in range(batch.num_rows):
                found.append(transform(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), plain_above, spm_below, error))
                size += len(found[-1][4])
                if size >= OUTPUT_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(found)), *(pa.array(x, t) for x, t in zip(zip(*found, strict=True), arrow, strict=True))],
                        names=schema.names)
                    first, found, size = i + 1, [], 0

    done = rows.mapInArrow(run, schema)
    return done.select(F.col("k").alias(key), *[c for c, _ in kinds[:-1]], F.col("output").cast("string").alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from. Marks stand once each in an output that is not plain."""
    body = F.substring(output, 4, 2**31 - 1)
    tail, rest = F.substring_index(body, "<M>", -1), F.substring_index(body, "<M>", 1)
    psm = F.concat(F.substring_index(rest, "<S>", 1), tail, F.substring_index(rest, "<S>", -1))
    spm = F.concat(F.substring_index(rest, "<P>", -1), tail, F.substring_index(rest, "<P>", 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """The result of ``fill_in_middle`` with digests in place of the output: of the output itself and of the text restored from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(key, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def fill_in_middle_sql() -> str:
    """The digests in DuckDB SQL, by cutting token lists."""
    return r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
                      sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
    h AS (SELECT *, len(w) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3,
                 ('0x' || d[25:32])::BIGINT AS h4 FROM t),
    f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
    p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM f)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p"""


by_value(__name__)
