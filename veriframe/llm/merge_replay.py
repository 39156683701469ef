"""Byte-level BPE encoding and decoding by replaying the merges over a whole segment of the corpus.

A segment is a batch of whole documents. Its distinct pieces are laid out byte after byte as linked lists; an
inverted index leads from the rank of a token pair to the places where that pair stands. Merges are taken in rank
order from a heap of the ranks in the index; each is applied at all its places at once, and only the pairs with the
two touched neighbours are looked up again. Each distinct piece is merged once per segment, however often it occurs.
Documents are then written out piece by piece. Nothing is shuffled, and segments are independent of each other.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import class_table, slices, split_texts
from .shipping import Shared, by_value, read_local

SEGMENT_CHARS = 16_000_000
SLICE_CHARS = 2_000_000
NONE = np.int32(0x7FFFFFFF)


def load_ranks(content: bytes) -> list[bytes]:
    """Token bytes by rank from a rank file."""
    ranks = dict((base64.b64decode(word), int(rank)) for word, rank in map(bytes.split, content.splitlines()))
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return sorted(ranks, key=ranks.get)


class Vocabulary:
    """Tokens by rank, and which two tokens make which third."""

    def __init__(self, tokens: list[bytes]):
        import pyarrow as pa

        self.rank = {t: i for i, t in enumerate(tokens)}
        self.size = len(tokens)
        self.words = pa.array(tokens, pa.binary())
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for whole, rank in self.rank.items():
            for cut in range(1, len(whole)):
                left, right = self.rank.get(whole[:cut]), self.rank.get(whole[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key.tolist()], np.int32)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_key, key), max(len(self.pair_key) - 1, 0))
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NONE) if len(self.pair_key) else np.full(len(key), NONE)

    def encode_one(self, piece: bytes) -> list[int]:
        """The merges of one piece, lowest rank first, leftmost first."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best = min((self.rank.get(a + b, int(NONE)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == NONE:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.rank[p] for p in parts]


def replay(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all pieces after each other, and how many each has. Pieces are ``data[offsets[i]:offsets[i + 1]]``."""
    n = len(data)
    token = vocabulary.of_byte[data]
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    full = offsets[:-1] < offsets[1:]
    after[offsets[1:][full] - 1] = -1
    before[offsets[:-1][full]] = -1
    alive = np.ones(n, bool)
    pair = np.full(n, NONE, np.int32)  # rank of the pair that begins at a place
    index: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []
    odd: list[np.ndarray] = []  # places at which a merge made a pair of lower rank than its own

    def look_up(places: np.ndarray) -> np.ndarray:
        found = vocabulary.pair_ranks(token[places], token[after[places]])
        pair[places] = found
        hit = found != NONE
        places, found = places[hit], found[hit]
        if not len(found):
            return found
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        begins = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist()]
        for rank, a, b in zip(found[begins].tolist(), begins, [*begins[1:], len(found)], strict=True):
            if rank not in index:
                index[rank] = []
                heapq.heappush(ranks, rank)
            index[rank].append(places[a:b])
        return found

    look_up(np.flatnonzero(after >= 0).astype(np.int32))
    while ranks:
        rank = heapq.heappop(ranks)
        groups = index.pop(rank)
        places = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
        places = places[pair[places] == rank]
        if not len(places):
            continue
        if len(groups) == 1:
            places = np.sort(places)
            places = places[np.append(True, places[1:] != places[:-1])]
        linked = after[places[:-1]] == places[1:]
        if linked.any():  # overlapping places, as in "aaa": every second one of a run, from its left end
            runs = np.arange(len(places))
            begin = np.maximum.accumulate(np.where(np.append(False, linked), 0, runs))
            places = places[(runs - begin) % 2 == 0]
        gone = after[places]
        following = after[gone]
        token[places] = rank
        after[places] = following
        alive[gone] = False
        pair[gone] = NONE
        inner = following >= 0
        before[following[inner]] = places[inner]
        pair[places[~inner]] = NONE
        previous = before[places]
        touched = np.concatenate([places[inner], previous[previous >= 0]])
        if len(touched):
            made = look_up(touched)
            if len(made) and made[0] < rank:
                odd.append(touched[pair[touched] < rank])
    place = np.flatnonzero(alive)
    tokens = token[place]
    owner_begin = np.searchsorted(place, offsets)
    count = np.diff(owner_begin)
    if odd:  # such pieces are merged one at a time, so that order inside the piece is exactly the rank order
        parts, pieces = [], np.unique(np.searchsorted(offsets, np.concatenate(odd), side="right") - 1)
        last = 0
        for i in pieces.tolist():
            own = vocabulary.encode_one(data[offsets[i]:offsets[i + 1]].tobytes())
            parts += [tokens[last:owner_begin[i]], np.array(own, np.int32)]
            last, count[i] = owner_begin[i + 1], len(own)
        tokens = np.concatenate([*parts, tokens[last:]])
    return tokens, count


def encode_pieces(vocabulary: Vocabulary, pieces) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and token counts of an Arrow array of pieces; a piece that is a token stays whole."""
    import pyarrow.compute as pc

    known = pc.index_in(pieces, value_set=vocabulary.words)
    whole = known.is_valid().to_numpy(zero_copy_only=False)
    rest = pieces.filter(pc.invert(known.is_valid()))
    offsets = np.frombuffer(rest.buffers()[1], np.int32, len(rest) + 1, rest.offset * 4).astype(np.int64)
    data = np.frombuffer(rest.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    tokens, count = replay(vocabulary, data, offsets - offsets[0])
    counts = np.ones(len(pieces), np.int64)
    counts[~whole] = count
    begin = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    out[begin[whole]] = known.drop_null().to_numpy()
    out[np.repeat(begin[~whole] - (np.cumsum(count) - count), count) + np.arange(len(tokens))] = tokens
    return out, counts


def spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def encode_texts(vocabulary: Vocabulary, table: np.ndarray, texts: list[str]):
    """Token ids (unsigned 32-bit) of each text, in order."""
    import pyarrow as pa

    for first, last in slices(texts, SEGMENT_CHARS):
        parts = [split_texts(texts[first + a:first + b], table) for a, b in slices(texts[first:last], SLICE_CHARS)]
        together = pa.concat_arrays([p.distinct for p in parts]).dictionary_encode()
        tokens, counts = encode_pieces(vocabulary, together.dictionary)
        begins = np.cumsum(counts) - counts
        number = together.indices.to_numpy()
        for p in parts:
            own, number = number[:len(p.distinct)], number[len(p.distinct):]
            where = own[p.which]
            ids = tokens[spans(begins[where], counts[where])].astype(np.uint32)
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts[where])])[p.bounds]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield ids[a:b]


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """The bytes that token ids stand for."""
    count = vocabulary.length[ids]
    return vocabulary.bytes[spans(vocabulary.begin[ids], count)].tobytes()


def _codec(shared: Shared):
    def build(value):
        return Vocabulary(value["tokens"]), np.frombuffer(value["classes"], np.uint8)
    return lambda: shared.derived(build)


def _share(df: DataFrame, path: str) -> Shared:
    return Shared(df.sparkSession, {"tokens": load_ranks(read_local(path)), "classes": class_table().tobytes()})


def encode(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every whole text: ``key, ids`` (ids: little-endian unsigned 32-bit integers as binary).

    ``ranks`` is the path of a rank file on the driver; the vocabulary is broadcast (the file's size bounds it). A null text
    counts as empty and has no ids; repeated rows give repeated rows, a null key stays null, an empty table gives an empty
    result; other columns play no part, whatever their names.
    """
    import pyarrow as pa

    codec = _codec(_share(docs, ranks))

    def run(batches):
        vocabulary, table = codec()
        for batch in batches:
            ids = [x.astype("<u4").tobytes() for x in encode_texts(vocabulary, table, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["k", "ids"])

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def decode_ids(encoded: DataFrame, ranks: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The bytes of every row of ``encode``'s result: ``key, decoded`` (binary). Null ids give null."""
    import pyarrow as pa

    codec = _codec(_share(encoded, ranks))

    def run(batches):
        vocabulary, _ = codec()
        for batch in batches:
            out = [None if x is None else decode(vocabulary, np.frombuffer(x, "<u4").astype(np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["k", "decoded"])

    rows = encoded.select(F.col(key).alias("k"), F.col(ids).alias("i"))
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("decoded", T.BinaryType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def round_trip(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and return digests: ``key, n_tokens, ids_sha256, decoded_sha256``.

    Ids and decoded bytes do not leave the task. Nulls, repeated rows and empty tables as in ``encode``.
    """
    import pyarrow as pa

    codec = _codec(_share(docs, ranks))

    def run(batches):
        vocabulary, table = codec()
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for ids in encode_texts(vocabulary, table, batch.column(1).to_pylist()):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4")).hexdigest())
                of_bytes.append(hashlib.sha256(decode(vocabulary, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                                             names=["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


by_value(__name__)
