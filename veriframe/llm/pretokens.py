"""The split before the merges, as a deterministic transducer over character classes.

The split pattern of the byte-level vocabularies (contractions, letters, digits, other signs, white space; a
single space joins what follows) is regular with two characters of lookahead. The lookahead goes into the
symbol of a position, so the machine itself is deterministic and tells at once whether a position starts a
piece. A batch of texts is cut into chunks; each chunk gives a state map (for every state it may be entered in,
the state it is left in), the maps are composed by a parallel prefix scan, and a second pass over all chunks at
once, each from its now known state, marks the starts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .shipping import by_value

#: Classes of code points.
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: States: between pieces; in letters, digits, other signs; after a joining space; in white space; one or two
#: characters of a contraction to come.
BETWEEN, IN_LETTERS, IN_NUMBERS, IN_OTHER, JOINING, IN_SPACE, ONE_MORE, TWO_MORE = range(8)
#: Symbols: letter, digit, other sign, apostrophe of a contraction of two or three characters, a space or other white
#: space before a non-space, white space before white space or the end. Plus 8: at the start of a text.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_JOIN, S_LAST, S_MORE = range(8)
STATES = 8
#: The machine takes three symbols at a step; a chunk has so many steps.
TOGETHER, CHUNK = 3, 512


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, as the tokenizer libraries have it.

    Where the Unicode tables of this Python and of the pattern module differ (code points that are newer than one
    of them), the tokenizer library is asked.
    """
    import unicodedata

    import regex
    from tokenizers import pre_tokenizers

    points = np.delete(np.arange(0x110000, dtype=np.uint32), slice(0xD800, 0xE000))
    everything = points.tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            table[points[m.start():m.end()]] = cls
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for p in np.flatnonzero(table != OTHER).tolist():
        if unicodedata.category(chr(p)) == "Cn":
            table[p] = next((c for c, mate in ((LETTER, "a"), (NUMBER, "1")) if len(split(mate + chr(p))) == 1), OTHER)
    return table


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start mark for symbol * 8 + state."""
    nxt = np.zeros((16, STATES), np.uint8)
    starts = np.zeros((16, STATES), np.uint8)
    runs = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHER}
    for symbol in range(16):
        for state in range(STATES):
            s, at = symbol & 7, BETWEEN if symbol >= 8 else state
            if at == TWO_MORE:
                to, start = ONE_MORE, 0
            elif at == ONE_MORE:
                to, start = BETWEEN, 0
            elif s in runs:
                to = runs[s]
                start = at not in (to, JOINING)
            elif s in (S_SHORT, S_LONG):
                inside = at in (IN_OTHER, JOINING)
                to, start = (IN_OTHER, 0) if inside else (ONE_MORE if s == S_SHORT else TWO_MORE, 1)
            elif s == S_MORE:
                to, start = IN_SPACE, at != IN_SPACE
            else:
                to, start = JOINING if s == S_JOIN else BETWEEN, 1
            nxt[symbol, state], starts[symbol, state] = to, start
    return nxt, starts


def _three_steps() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start marks (bits, first symbol highest) for three symbols * 8 + state."""
    nxt, starts = _machine()
    state = np.broadcast_to(np.arange(STATES), (16, 16, 16, STATES))
    marks = np.zeros(state.shape, np.uint8)
    for place in range(TOGETHER):
        symbol = np.arange(16).reshape([16 if axis == place else 1 for axis in range(4)])
        marks = marks << 1 | starts[symbol, state]
        state = nxt[symbol, state]
    return state.astype(np.uint8).ravel(), marks.ravel()


NEXT, MARKS = _three_steps()


def symbols(points: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The symbol of every position of concatenated texts; ``first`` has the positions where texts start."""
    n = len(points)
    cls = table[points]
    ends = np.zeros(n + 1, bool)  # a text ends before this position
    ends[first] = True
    ends[n] = True
    out = cls.copy()
    space = np.flatnonzero(cls == SPACE)
    followed = np.zeros(len(space), bool)
    inner = ~ends[space + 1]
    followed[inner] = cls[space[inner] + 1] != SPACE
    out[space] = np.where(followed, np.where(points[space] == 0x20, S_JOIN, S_LAST), S_MORE)
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        fits_one = ~ends[quote + 1]
        fits_two = fits_one & ~ends[np.minimum(quote + 2, n)]
        short = fits_one & np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= fits_two & (one == ord(a)) & (two == ord(b))
        out[quote] = np.where(long, S_LONG, np.where(short, S_SHORT, S_OTHER))
    out[first] += 8
    return out


def chunk_maps(grid: np.ndarray) -> np.ndarray:
    """State map of each chunk (column of ``grid``), all chunks and all entry states in step."""
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (grid.shape[1], 1))
    for symbol in grid:
        maps = NEXT[symbol[:, None] + maps]
    return maps


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan under composition: row i leads through chunks 0..i."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return maps


def piece_starts(points: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A mark for every position that starts a piece."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    chunks = -(-n // (CHUNK * TOGETHER))
    padded = np.zeros(chunks * CHUNK * TOGETHER, np.uint16)
    padded[:n] = symbols(points, first, table)
    threes = (padded[0::3] << 11) + (padded[1::3] << 7) + (padded[2::3] << 3)
    grid = np.ascontiguousarray(threes.reshape(chunks, CHUNK).T)
    through = scan_maps(chunk_maps(grid))
    state = np.concatenate([np.zeros(1, np.uint8), through[:-1, BETWEEN]])
    marks = np.empty(grid.shape, np.uint8)
    for i, symbol in enumerate(grid):
        at = symbol + state
        marks[i] = MARKS[at]
        state = NEXT[at]
    flat = np.ascontiguousarray(marks.T).ravel()
    return np.stack([flat >> 2, flat >> 1 & 1, flat & 1], axis=1).ravel()[:n].view(bool)


class Pieces:
    """The pieces of a slice of texts: ``which`` piece (index into ``distinct``) stands at each place, and the place
    each text starts at (``bounds``, one more than texts)."""

    def __init__(self, distinct, which: np.ndarray, bounds: np.ndarray):
        self.distinct, self.which, self.bounds = distinct, which, bounds

    def per_text(self, of_piece: np.ndarray) -> np.ndarray:
        """Sum over each text of a figure that every distinct piece has."""
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(of_piece[self.which], dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def split_texts(texts: list[str], table: np.ndarray) -> Pieces:
    """Split texts into pieces and number the distinct ones."""
    import pyarrow as pa

    joined = "".join(texts)
    data = joined.encode()
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    starts = piece_starts(points, offsets[:-1][lengths > 0], table)
    at = np.flatnonzero(starts)
    if len(data) == len(points):
        byte_at = at
    else:
        width = np.ones(len(points), np.int64)
        for limit in (0x80, 0x800, 0x10000):
            width += points >= limit
        byte_at = (np.cumsum(width) - width)[at]
    cuts = np.append(byte_at, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    return Pieces(coded.dictionary, coded.indices.to_numpy(), np.searchsorted(at, offsets))


def slices(texts: list[str], chars: int):
    """Consecutive ranges of ``texts`` of about ``chars`` characters, one text at least."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


by_value(__name__)
