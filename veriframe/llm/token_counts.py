"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers stand for the tokenizer. The first (``pretokens``) marks where pieces start; chunk
state maps and a prefix scan run it over all chunks of a batch at once. The second reads the bytes of a piece. After
each byte it is in a state that says, for every position from which a longer token could still grow, which token
ends there and how many tokens fewer or more lead there; every transition carries the change in the number of
emitted tokens, so the count of a piece is the sum along its path. States and transitions are made when first met
and kept for the life of a worker process, up to a bound, beyond which the table is begun anew (results do not
change). A piece needs no tokens to be built and no merge to be replayed.

Why it is right: a token sequence is what the merges give exactly if every two neighbours are what the merges give
for their joined bytes, and each prefix has one such sequence. So the last token of a prefix is the one token that
ends it and goes with the last token before; and whether two go together is decided by undoing their merges.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import class_table, slices, split_texts
from .shipping import Shared, by_value, read_local

SLICE_CHARS = 2_000_000
MAX_TRANSITIONS = 600_000
SLOTS = 1 << 21
LOCKSTEP_BYTES = 64
BLOCK_BYTES = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the other
    bytes follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(content: bytes) -> dict:
    """Merges of a byte-level tokenizer file, as plain data: token bytes in merge order, the two parts of each, and the
    special strings that the library takes out of a text before anything else."""
    spec = json.loads(content)
    stand_in = byte_alphabet()
    to_bytes = lambda s: bytes(stand_in[c] for c in s)
    number = {bytes([b]): b for b in range(256)}
    merges = []
    for pair in spec["model"]["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        left, right = to_bytes(a), to_bytes(b)
        merges.append((number[left], number[right]))
        number.setdefault(left + right, 256 + len(merges) - 1)
    return {"merges": merges, "special": [t["content"] for t in spec["added_tokens"] if t["special"]]}


class MergeTransducer:
    """The piece transducer. Tokens are numbered 0..255 for bytes and then in merge order."""

    def __init__(self, merges: list[tuple[int, int]]):
        self.split = [None] * 256 + merges
        self.rank = {}
        for i, pair in enumerate(merges):
            self.rank.setdefault(pair, 256 + i)
        text = [bytes([b]) for b in range(256)]
        for a, b in merges:
            text.append(text[a] + text[b])
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for token, word in enumerate(text):
            node = 0
            for byte in word:
                step = self.children[node].get(byte)
                if step is None:
                    step = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = step
            if self.token_at[node] < 0:
                self.token_at[node] = token
        self.text = text
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.restart()

    def restart(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.state_of = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        # The same transitions as a hash table of arrays, for many lookups at once.
        self.slot_key = np.full(SLOTS, -1, np.int64)
        self.slot_move = np.zeros((SLOTS, 2), np.int32)

    def merged(self, word: bytes) -> list[int]:
        """The plain replay of the merges; used to see that a token stands for its own bytes."""
        parts = list(word)
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            parts[best[1]:best[1] + 2] = [best[0]]
        return parts

    def stands(self, token: int) -> bool:
        if token not in self.whole:
            self.whole[token] = token < 256 or self.merged(self.text[token]) == [token]
        return self.whole[token]

    def together(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` as they are when their bytes are joined.

        Undo the latest merge of either side again and again. The inner border pair existed until the merge just
        undone; had its own merge come before, the two would not be neighbours. Equal merges run from left to right.
        """
        key = (left, right)
        if key not in self.pairs:
            a, b, until = left, right, 1 << 60
            while True:
                if self.rank.get((a, b), 1 << 61) < until:
                    good = False
                    break
                if a < 256 and b < 256:
                    good = True
                    break
                if a > b:
                    until, a = a, self.split[a][1]
                else:
                    until, b = b + 1, self.split[b][0]
            self.pairs[key] = good
        return self.pairs[key]

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and the change in the number of tokens; made at the first call."""
        key = state << 8 | byte
        found = self.moves.get(key)
        if found is not None:
            return found
        last, emitted, live = -1, 0, []
        for node, before, ahead in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token_at[child]
            if last < 0 <= token and self.stands(token) and (before < 0 or self.together(before, token)):
                last, emitted = token, ahead + 1
            if self.children[child]:
                live.append((child, before, ahead))
        if last < 0:
            raise ValueError("the vocabulary is not closed under its merges")
        entry = (*((c, b, n - emitted) for c, b, n in live), (0, last, 0))
        to = self.state_of.get(entry)
        if to is None:
            to = self.state_of[entry] = len(self.states)
            self.states.append(entry)
        self.moves[key] = (to, emitted)
        return to, emitted

    def move_many(self, key: np.ndarray) -> np.ndarray:
        """``move`` for an array of state * 256 + byte."""
        slot = (key * 0x9E3779B1 >> 11) & SLOTS - 1
        pending = np.arange(len(key))
        out = np.empty((len(key), 2), np.int32)
        while len(pending):
            there = self.slot_key[slot[pending]]
            hit = there == key[pending]
            done = pending[hit]
            out[done] = self.slot_move[slot[done]]
            free = np.flatnonzero(there < 0)
            for i in np.unique(key[pending[free]]).tolist():
                at = (i * 0x9E3779B1 >> 11) & SLOTS - 1
                while self.slot_key[at] >= 0:
                    at = (at + 1) & SLOTS - 1
                self.slot_move[at] = self.move(i >> 8, i & 255)
                self.slot_key[at] = i
            pending = pending[~hit]
            full = there[~hit] >= 0
            slot[pending[full]] = (slot[pending[full]] + 1) & SLOTS - 1
        return out

    def count_one(self, word: bytes) -> int:
        state = total = 0
        for byte in word:
            state, emitted = self.move(state, byte)
            total += emitted
            if len(self.moves) > MAX_TRANSITIONS:
                entry = self.states[state]
                self.restart()
                state = self.state_of.setdefault(entry, len(self.states))
                self.states += [entry] * (state == len(self.states))
        return total

    def counts(self, words) -> np.ndarray:
        """Token counts of an Arrow array of pieces: short ones byte by byte in step, long ones one by one."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int32, n + 1, words.offset * 4)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        length = np.diff(offsets)
        total = np.zeros(n, np.int64)
        for i in np.flatnonzero(length > LOCKSTEP_BYTES):
            total[i] = self.count_one(data[offsets[i]:offsets[i + 1]].tobytes())
        short = np.flatnonzero(length <= LOCKSTEP_BYTES)
        block = np.cumsum(length[short]) // BLOCK_BYTES
        for words_of in np.split(short, np.flatnonzero(np.diff(block)) + 1):
            if len(self.moves) > MAX_TRANSITIONS:
                self.restart()
            order = words_of[np.argsort(-length[words_of], kind="stable")]
            state = np.zeros(len(order), np.int64)
            begins, sizes = offsets[order], length[order]
            for step in range(int(sizes[0]) if len(order) else 0):
                active = int(np.searchsorted(-sizes, -step))
                moves = self.move_many(state[:active] << 8 | data[begins[:active] + step])
                state[:active] = moves[:, 0]
                total[order[:active]] += moves[:, 1]
        return total


def token_counter(shared: Shared):
    """``texts -> counts`` for a list of texts, whole."""
    def build(value):
        return np.frombuffer(value["classes"], np.uint8), MergeTransducer(value["merges"]), value["special"]

    def count(texts: list[str]) -> np.ndarray:
        table, machine, special = shared.derived(build)
        out = np.zeros(len(texts), np.int64)
        for begin, end in slices(texts, SLICE_CHARS):
            segments, owner = [], []
            for i in range(begin, end):
                parts = [texts[i]]
                for s in special:
                    cut = [p.split(s) for p in parts] if any(s in p for p in parts) else [[p] for p in parts]
                    out[i] += sum(len(c) - 1 for c in cut)
                    parts = [p for c in cut for p in c]
                segments += parts
                owner += [i] * len(parts)
            pieces = split_texts(segments, table)
            np.add.at(out, owner, pieces.per_text(machine.counts(pieces.distinct)))
        return out

    return count


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """Tokens of every whole text: ``key, n_bytes, n_tokens, over_limit``.

    ``tokenizer`` is the path of a byte-level tokenizer file on the driver; its merges are broadcast (the file's size
    bounds them). Counts are what the tokenizer library gives without added special tokens; special strings inside
    a text are one token each, as is that library's default.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows give repeated rows, a null key stays null, an empty
    table gives an empty result; other columns of ``docs`` play no part, whatever their names.
    """
    import pyarrow as pa

    value = load_merges(read_local(tokenizer)) | {"classes": class_table().tobytes()}
    count = token_counter(Shared(docs.sparkSession, value))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(count(texts))],
                                             names=["k", "n_bytes", "n_tokens"])

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), whole.alias("t"), F.octet_length(whole).cast("long").alias("n_bytes"))
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    return (rows.mapInArrow(run, schema)
            .select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


by_value(__name__)
