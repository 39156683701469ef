import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_fixtures import clashing, documents
from veriframe.llm import merge_replay, pretokens, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BITS = ["a", "b", "the", " ", "  ", "\n", "\t", " '", "'s", "'re", "'", "''", "1", "23", "é", "ß", "日本", "!", "?!", " ", " ", "😀", "'ll", "<|endoftext|>", "don't", "THE", "\r\n", "́", "٣"]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    out = ["".join(rng.choice(BITS) for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x600), rng.randrange(0x3000, 0x9FFF), rng.randrange(0x10000, 0x32000)])) for _ in range(40)) for _ in range(n)]
    return [*out, "", "a" * 5000, " " * 3000 + "x", "'" * 100, "ab" * 3000, "<|endoftext|>" * 3]


@pytest.fixture(scope="module")
def counter():
    value = token_counts.load_merges(token_counts.read_local(JSON))
    machine = token_counts.MergeTransducer(value["merges"])

    class Here:
        def derived(self, build):
            return pretokens.class_table(), machine, value["special"]

    return token_counts.token_counter(Here()), machine


def library_counts(texts):
    return [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(counter):
    texts = random_texts(400)
    assert counter[0](texts).tolist() == library_counts(texts)


def test_a_small_transition_table_changes_nothing(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_TRANSITIONS", 500)
    counter[1].restart()
    texts = random_texts(100, 4)
    assert counter[0](texts).tolist() == library_counts(texts)


def test_chunk_maps_compose():
    text = "".join(random_texts(400, 5)[:400]) * 3  # several chunks; code points that every Unicode table knows
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    whole = pretokens.piece_starts(points, np.array([0]), pretokens.class_table())
    assert len(points) > 4 * pretokens.CHUNK * pretokens.TOGETHER
    assert [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)] == np.flatnonzero(whole).tolist()


def test_count_tokens_on_awkward_rows(spark):
    docs = clashing(documents(spark))
    got = token_counts.count_tokens(docs, JSON).collect()
    rows = docs.select("doc_id", "text").collect()
    want = library_counts([r.text or "" for r in rows])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (str(r.doc_id), len((r.text or "").encode()), n, n > 1024) for r, n in zip(rows, want, strict=True))
    assert token_counts.count_tokens(docs.where("false"), JSON).count() == 0


def test_merge_replay_equals_the_library():
    vocabulary = merge_replay.Vocabulary(merge_replay.load_ranks(merge_replay.read_local(RANKS)))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.rank, special_tokens={})
    texts = random_texts(400, 6)
    for text, ids in zip(texts, merge_replay.encode_texts(vocabulary, pretokens.class_table(), texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert merge_replay.decode(vocabulary, ids) == text.encode()


def test_merge_that_makes_an_earlier_merge_possible():
    """Ranks in which a merge brings together a pair of lower rank; such pieces keep the order inside the piece."""
    tokens = [bytes([i]) for i in range(256)] + [b"bcd", b"abc", b"bc", b"ab", b"cd", b"abcd"]
    vocabulary = merge_replay.Vocabulary(tokens)
    library = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=vocabulary.rank, special_tokens={})
    rng = random.Random(1)
    pieces = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))).encode() for _ in range(500)})
    ids, counts = merge_replay.encode_pieces(vocabulary, pa.array(pieces, pa.binary()))
    at = 0
    for piece, n in zip(pieces, counts.tolist(), strict=True):
        assert ids[at:at + n].tolist() == library.encode_ordinary(piece.decode())
        at += n


def test_round_trip_on_awkward_rows(spark):
    docs = clashing(documents(spark))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = merge_replay.round_trip(docs, RANKS).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in got) == sorted((str(r.doc_id), sha((r.text or "").encode())) for r in docs.collect())
    encoded = merge_replay.encode(docs, RANKS)
    back = merge_replay.decode_ids(encoded, RANKS)
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back.collect()) == sorted((str(r.doc_id), (r.text or "").encode()) for r in docs.collect())
    assert sorted(r.n_tokens for r in got) == sorted(r.n for r in encoded.select((F.octet_length("ids") / 4).cast("int").alias("n")).collect())
    assert merge_replay.round_trip(docs.where("false"), RANKS).count() == 0
