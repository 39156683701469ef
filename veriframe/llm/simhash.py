"""SimHash near-duplicates with a pigeonring filter.

Every whole text gets a 64-bit fingerprint of its word shingles. Fingerprints within ``distance`` bits of each other are
linked; the classes are the connected components of the links.

Candidates come from chains of segments. The bits are cut into ``distance + 1`` segments that form a ring. If two
fingerprints differ in at most ``distance`` bits, then some chain of segments keeps within its proportional budget at
every length: its first l segments hold at most l * distance / segments differing bits, rounded down (the pigeonring
principle). The first segment of the chain is therefore equal and the first two differ in at most one bit, which makes an
exact key: one side is filed under both segments, the other also looks under every one-bit change of the second (only if
that segment has an even number of ones, since a one-bit change alters the parity). Longer chains are then checked
before the full distance. All work is on distinct fingerprints, so exact copies cost nothing here.

A key may hold many fingerprints. Its rows are cut into blocks and every two blocks meet in one group, so a group has a
bounded size; a group returns one edge per fingerprint, to the least one it is connected with, and never a list of pairs.

``keep_one`` goes by the Jaccard similarity of the sets of shingles instead. A similarity of 0.8 may change 13 bits of 64 and more, where
segments of the bits are too short to select by; so there the ring is one of shingles: a hash deals them over segments, and each segment
has a SimHash of its own. A shingle that differs changes one segment only. If at most D shingles may differ, a set that has more than D
segments has an equal one in every similar set, as in a chain's first link, and the SimHash of a segment is the key. The largest D + 1
segments are enough: of the segments that two sets have in common, the first by size and place has at most D before it in either. Shingles
that stand in very many texts are not dealt, which takes no difference away from or to a pair but keeps texts with a common passage apart.
Of a set that is dealt over D segments or fewer, the D + 1 rarest shingles are keys too, by the same argument. So no link is lost. Every
link is verified on the whole sets; a pair is only spared if the parities of its shingles, counted in buckets, prove that over D differ.
The same proof keeps pairs under one key apart before clusters are made of them, or texts that share a little would chain up to one cluster.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from ..operators.skew import attach_per_key, that_may_be_in
from ..session import cut_lineage
from .shipping import Shared, by_value

BITS = 64
BLOCK = 1024
#: The fewest segments of a ring, and segments of a ring for each shingle that may differ in the largest sets of its class: some stay empty.
SEGMENTS, SPARE = 1, 9 / 7
#: Buckets in which the shingles of a set are counted for their parities: more than six for ten shingles, a power of two within these bounds.
BUCKETS = 64, 1 << 15
#: Sets under a key up to which every two are held against each other before they make a cluster; more are one cluster in any case.
PAIRS = 32
#: Bits of a shingle by which all are counted.
COUNT_BITS = 17
#: Shingles of the sets whose keys one task sorts, about.
SORTED = 1_200_000
#: Texts whose sets a worker holds at once.
SLICE = 500
#: Shingles of a block of sets.
BLOCK_SHINGLES = 1_000_000


def fingerprint(words: list[bytes], shingle: int, seed: int) -> int:
    """Fingerprint of a word sequence: the bits that are set in over half the shingles' hashes."""
    import xxhash

    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[:len(words) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)
    n = len(words) - size + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``key, fingerprint`` (signed 64-bit) of every whole text: A-Z lower-cased, words between ASCII white space, shingles of
    ``shingle`` words with repeats (fewer words: the whole sequence; none or a null text: zero)."""
    import pyarrow as pa

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("fingerprint", T.LongType())])

    def run(batches):
        for batch in batches:
            # bytes.split() cuts at 0x20 and 0x09-0x0D, which is the white space of the definition.
            found = [fingerprint(t.as_py().translate(LOWER).split(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["k", "fingerprint"])

    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    m = distance + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(f: Column, part: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(f, part[0]).bitwiseAND(F.lit((1 << part[1]) - 1).cast("long"))


def chain_keys(prints: DataFrame, distance: int) -> DataFrame:
    """``slot, f, filed``: the keys under which each fingerprint is filed, and (``filed`` false) those it looks under."""
    ring, entries = segments(distance), []
    for i, first in enumerate(ring):
        second = ring[(i + 1) % len(ring)]
        slot = lambda change, i=i, first=first, second=second: (
            F.lit(i << 56).cast("long").bitwiseOR(F.shiftleft(_segment(F.col("f"), first), second[1])).bitwiseOR(_segment(F.col("f"), second).bitwiseXOR(change)))
        looks = F.transform(F.sequence(F.lit(0), F.lit(second[1] - 1)), lambda b: F.struct(slot(F.call_function("shiftleft", F.lit(1).cast("long"), b)).alias("slot"), F.lit(False).alias("filed")))  # noqa: B023
        even = F.bit_count(_segment(F.col("f"), second)) % 2 == 0
        entries.append(F.array(F.struct(slot(F.lit(0).cast("long")).alias("slot"), F.lit(True).alias("filed"))))
        entries.append(F.when(even, looks).otherwise(F.slice(looks, 1, 0)))
    return (prints.select("f", F.explode(F.concat(*entries)).alias("e")).select(F.col("e.slot").alias("slot"), "f", F.col("e.filed").alias("filed")))


def near(a: np.ndarray, b: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Whether fingerprints are linked by the chain that starts at segment ``start``: longer and longer chains first, then the
    full distance."""
    ring = segments(distance)
    change = a ^ b
    counts = np.stack([np.bitwise_count(change >> np.uint64(s) & np.uint64((1 << w) - 1)) for s, w in ring])
    good, total = np.ones(change.shape, bool), np.zeros(change.shape, np.int16)
    grid = np.broadcast_to(start, change.shape)
    for length in range(1, len(ring)):
        total += np.take_along_axis(counts, ((grid + length - 1) % len(ring))[None], axis=0)[0]
        good &= total <= length * distance // len(ring)
    return good & (np.bitwise_count(change) <= distance)


def forest(f: np.ndarray, filed: np.ndarray, start: int, distance: int) -> np.ndarray:
    """For each fingerprint of a group the place of the least one it is connected with inside the group."""
    linked = near(f[:, None], f[None, :], np.array(start), distance)
    linked &= filed[:, None] | filed[None, :]
    label = np.arange(len(f))
    while True:
        least = np.where(linked, label[None, :], len(f)).min(axis=1)
        least = np.minimum(label, least)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _and_end(items):
    yield from items
    yield None


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Edges ``src, dst`` between distinct fingerprints ``f`` that connect exactly those connected by links."""
    import pyarrow as pa

    w = Window.partitionBy("slot")
    met = (chain_keys(prints, distance)
           .withColumns({"n": F.count(F.lit(1)).over(w), "files": F.sum(F.col("filed").cast("long")).over(w)})
           .where("n > 1 AND files > 0"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    groups = (met.withColumn("b", F.pmod(F.xxhash64("f"), blocks).cast("int"))
              .select("slot", "f", "filed", "b", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("c"))
              .select("slot", F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi"), "f", "filed"))

    def edges_of(f, filed, group, start):
        """All rows of whole groups, sorted by group."""
        size = np.diff(np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)))
        mine = np.repeat(size, size)
        src, dst = [], []
        for ahead in range(1, int(min(size.max(initial=0), 16))):  # small groups: pairs at each offset, all groups at once
            i = np.flatnonzero((group[:-ahead] == group[ahead:]) & (mine[:-ahead] <= 16))
            i = i[(filed[i] | filed[i + ahead]) & (f[i] != f[i + ahead])]
            i = i[near(f[i], f[i + ahead], start[i], distance)]
            src.append(f[i])
            dst.append(f[i + ahead])
        at = 0
        for n in size.tolist():
            if n > 16:
                own = slice(at, at + n)
                root = forest(f[own], filed[own], int(start[at]), distance)
                other = np.flatnonzero(root != np.arange(n))
                src.append(f[own][other])
                dst.append(f[own][root[other]])
            at += n
        return np.concatenate(src or [f[:0]]), np.concatenate(dst or [f[:0]])

    def run(batches):
        kept = None
        for batch in _and_end(batches):
            if batch is not None:
                arrays = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
                arrays = arrays if kept is None else [np.concatenate(x) for x in zip(kept, arrays, strict=True)]
            elif kept is None:
                return
            else:
                arrays = kept
            slot, lo, hi, f, filed = arrays
            new = np.flatnonzero((np.diff(slot) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            upto = len(slot) if batch is None else (int(new[-1]) if len(new) else 0)
            kept = [x[upto:] for x in arrays]
            if upto:
                group = np.zeros(upto, np.int64)
                group[new[new < upto]] = 1
                src, dst = edges_of(f[:upto].view(np.uint64), filed[:upto].astype(bool), np.cumsum(group), (slot[:upto] >> 56).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

    return groups.repartition("slot", "lo", "hi").sortWithinPartitions("slot", "lo", "hi").mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """Class of every document: ``key, fingerprint`` (signed 64-bit), ``component_id`` (the least key that is reachable),
    ``component`` (the least fingerprint that is reachable).

    Null and empty texts have fingerprint zero and are linked like any other. Null keys are kept and do not count for the least
    key (a class of null keys only has a null one); repeated rows give repeated rows; an empty table gives an empty result; other
    columns play no part, whatever their names.
    """
    rows = cut_lineage(fingerprints(docs, key, text, shingle, seed).select(F.col(key).alias("k"), F.col("fingerprint").alias("f")))
    per = rows.groupBy("f").agg(F.min("k").alias("first"))
    classes = connected_components(links(per.select("f"), distance))
    named = (per.join(classes.select(F.col("node").alias("f"), "component"), "f", "left")
             .select("f", "first", F.coalesce("component", "f").alias("component")))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return (rows.join(named.select("f", "component").join(least, "component"), "f")
            .select(F.col("k").alias(key), F.col("f").alias("fingerprint"), "component_id", "component"))


def shingle_set(words: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """The hashes of the word shingles, sorted (fewer words: the whole sequence; none: empty); repeats of a shingle are members of their own."""
    import xxhash

    size = min(shingle, len(words))
    found = np.sort(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i:i + size]), seed) for i in range(len(words) - size + 1)) if words else (), np.uint64))
    again = np.arange(len(found)) - np.searchsorted(found, found)
    return np.unique(found ^ again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def may_differ(n, m, similarity: float):
    """The most shingles that are in only one of two sets of ``n`` and ``m`` with that similarity."""
    return np.floor((n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6).astype(np.int64)


def _rings(n: int, similarity: float) -> list[tuple[int, int, int]]:
    """(size class, number of segments, shingles that may differ) of the rings under which a set of ``n`` is filed: that of its class, and those
    of larger similar sets. Sets that may not differ in a shingle have no similar set but copies."""
    of = lambda size: max(0, (size - 1).bit_length() - 3)
    largest = int(n / similarity + 1e-6)
    if not may_differ(n, largest, similarity):
        return []
    return [(c, max(SEGMENTS, 1 + int(np.ceil(SPARE * may_differ(8 << c, 8 << c, similarity)))), int(may_differ(n, min(8 << c, largest), similarity)))
            for c in range(of(n), of(largest) + 1)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(33)


def segment_prints(found: np.ndarray, segments: int, least: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of a set's segments that have ``least`` shingles or more (the ``most`` largest of them, by size and place), and the SimHash
    of each. A hash deals the shingles over the segments."""
    at = ((_mixed(found ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    size = np.bincount(at, minlength=segments)
    places = np.flatnonzero(size >= least)
    if most is not None and len(places) > most:
        places = np.sort(places[np.argsort(-size[places], kind="stable")[:most]])
    taken = np.zeros(segments, bool)
    taken[places] = True
    chosen = np.flatnonzero(taken[at])
    chosen = chosen[np.argsort(at[chosen], kind="stable")]
    ends, prints = np.cumsum(size[places]), [np.zeros(0, np.uint64)]
    for first in range(0, len(places), 1 << 14):
        own = size[places[first:first + (1 << 14)]]
        begin = int(ends[first] - own[0])
        bits = np.unpackbits(found[chosen[begin:begin + int(own.sum())]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.cumsum(own) - own, axis=0, dtype=np.int64)
        prints.append(np.packbits(2 * ones > own[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0])
    return places, np.concatenate(prints)


def segment_keys(found: np.ndarray, similarity: float = 0.8, often: np.ndarray | None = None) -> np.ndarray:
    """The candidate keys of a set: the SimHash of each segment, with its place and size class. Similar sets have one in common.

    ``often`` has the counts of common shingles by bucket, else zero."""
    keys = [np.zeros(0, np.uint64)]
    n = (np.zeros(1 << COUNT_BITS, np.int64) if often is None else often)[found >> np.uint64(64 - COUNT_BITS)]
    for c, m, differ in _rings(len(found), similarity):
        places, prints = segment_prints(found[n == 0], m, 1, differ + 1)
        keys.append(_mixed(prints ^ _mixed(places.astype(np.uint64) + np.uint64(1 + (c << 40)))))
        if len(places) <= differ:
            keys.append(_mixed(found[np.argsort(n, kind="stable")[:differ + 1]] ^ _mixed(np.uint64([c << 40]))))
    return np.concatenate(keys).view(np.int64)


def common_only(counts: np.ndarray) -> np.ndarray:
    """The counts of buckets that hold a shingle of very many texts: those above what chance gives to the usual bucket; else zero."""
    usual = float(np.median(counts))
    return np.where(counts > usual + 6 * usual ** 0.5 + 20, counts, 0)


def buckets(n: int) -> int:
    return min(max(BUCKETS[0], 1 << (3 * n // 5).bit_length()), BUCKETS[1])


def parities(sets: list[np.ndarray], buckets: int) -> np.ndarray:
    """A row of ``buckets`` bits for each set: whether a bucket has an odd number of its shingles. Sets differ in at least as many shingles as bits."""
    rows, step = [], max(1, (1 << 22) // buckets)
    for first in range(0, len(sets), step):
        some = sets[first:first + step]
        of = np.repeat(np.arange(len(some)), [len(x) for x in some])
        counts = np.bincount(of * buckets + (np.concatenate(some) % np.uint64(buckets)).astype(np.int64), minlength=len(some) * buckets)
        rows.append(np.packbits((counts & 1).astype(np.uint8).reshape(len(some), buckets), axis=1).view(np.uint64))
    return np.concatenate(rows)


def may_be_similar(n: np.ndarray, odd: list[bytes], m: np.ndarray, other: list[bytes], similarity: float) -> np.ndarray:
    """Whether sizes and parities of the sets of each pair leave it open that they are similar. Of more buckets, those a power of two apart are
    taken together."""
    far, found = np.zeros(len(n), np.int64), []
    lengths = np.array([[len(a), len(b)] for a, b in zip(odd, other, strict=True)], np.int64).reshape(-1, 2)
    for x, y in np.unique(lengths, axis=0).tolist():
        at, width = np.flatnonzero((lengths == (x, y)).all(axis=1)), min(x, y) // 8
        found = [np.bitwise_xor.reduce(np.frombuffer(b"".join(side[i] for i in at.tolist()), np.uint64).reshape(len(at), -1, width), axis=1) for side in (odd, other)]
        far[at] = np.bitwise_count(found[0] ^ found[1]).sum(axis=1, dtype=np.int64)
    return (far <= may_differ(n, m, similarity)) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)


def _slices(batches):
    """Parts of ``SLICE`` rows, so that a worker holds few sets at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def described(rows: DataFrame, shingle: int) -> DataFrame:
    """``k, a, b, s, n, odd``: of every row's ``text`` the number of its set of shingles, the set's size and parities. Rows without ``n``: what
    a task counted in all, the shingles ``b`` of bucket ``a``."""
    import pyarrow as pa

    schema = T.StructType([*rows.schema.fields[:3], T.StructField("s", T.LongType()), T.StructField("n", T.LongType()), T.StructField("odd", T.BinaryType())])

    def run(batches):
        total, kind = np.zeros(1 << COUNT_BITS, np.int64), pa.null()
        for batch in _slices(batches):
            sets, kind = [shingle_set(t.as_py().translate(LOWER).split(), shingle) for t in batch.column(3)], batch.column(0).type
            for x in sets:
                np.add.at(total, x >> np.uint64(64 - COUNT_BITS), 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(set_numbers(sets)), pa.array([len(x) for x in sets], pa.int64()),
                                              pa.array([parities([x], buckets(len(x))).tobytes() for x in sets], pa.binary())], names=schema.names)
        at = np.flatnonzero(total)
        if len(at):
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), kind), pa.array(at), pa.array(total[at]), none, none, pa.nulls(len(at), pa.binary())], names=schema.names)

    return rows.select("k", "a", "b", F.col("text").cast("binary")).mapInArrow(run, schema)


def set_numbers(sets: list[np.ndarray]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)


def filed(texts: DataFrame, shingle: int, similarity: float, often: Shared) -> DataFrame:
    """``s, bands``: the candidate keys of every set, once for the copies of a batch.

    The sets are made a second time: keys are a quarter of the shingles or more, and go to their shuffle without being written before."""
    import pyarrow as pa

    def run(batches):
        common = often.derived(common_only)
        for batch in _slices(batches):
            sets = [shingle_set(t.as_py().translate(LOWER).split(), shingle) for t in batch.column(0)]
            ids, once = np.unique(set_numbers(sets), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([segment_keys(sets[i], similarity, common) for i in once], pa.list_(pa.int64()))], names=["s", "bands"])

    return texts.select(F.col("text").cast("binary")).mapInArrow(run, "s long, bands array<long>")


def similar_roots(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the place of one set that it is connected with by links of at least ``similarity``, the same for all of a class.

    Classes grow from one set at a time: only sets that are in no class yet are compared with it, so a class of copies costs one comparison a set."""
    size = np.array([len(x) for x in sets])
    odd = parities(sets, buckets(int(size.max())))
    begins, flat = np.cumsum(size) - size, np.concatenate(sets)
    root, free = np.full(len(sets), -1), np.ones(len(sets), bool)
    for first in range(len(sets)):
        if not free[first]:
            continue
        root[first], free[first] = first, False
        queue = [first]
        while queue:
            i = queue.pop()
            other = np.flatnonzero(free)
            other = other[np.minimum(size[other], size[i]) >= similarity * np.maximum(size[other], size[i]) - 1e-9]
            other = other[np.bitwise_count(odd[other] ^ odd[i]).sum(axis=1, dtype=np.int64) <= may_differ(size[other], size[i], similarity)]
            if not len(other):
                continue
            lengths = size[other]
            ends = np.cumsum(lengths)
            at = np.arange(ends[-1]) + np.repeat(begins[other] - (ends - lengths), lengths)
            place = np.minimum(np.searchsorted(sets[i], flat[at]), size[i] - 1)
            shared = np.add.reduceat((sets[i][place] == flat[at]).astype(np.int64), ends - lengths)
            linked = other[shared >= similarity * (size[i] + lengths - shared) - 1e-9]
            root[linked], free[linked] = first, False
            queue.extend(linked.tolist())
    return root


def similar_edges(members: DataFrame, similarity: float) -> DataFrame:
    """Edges ``src, dst`` between sets ``s`` that connect exactly those connected by links inside a ``cluster``.

    A cluster is cut into ``blocks``; every two meet in one group, which returns one edge a set."""
    import pyarrow as pa

    groups = (members.withColumn("_b", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int"))
              .select("cluster", "s", "set", "_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_c"))
              .select("cluster", F.least("_b", "_c").alias("lo"), F.greatest("_b", "_c").alias("hi"), "s", "set"))

    def edges_of(ids, sets):
        root = similar_roots(sets, similarity)
        other = np.flatnonzero(root != np.arange(len(root)))
        ids = np.array(ids, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(ids[root[other]])], names=["src", "dst"])

    def run(batches):
        group, ids, sets = None, [], []
        for batch in batches:
            for c, lo, hi, s, found in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if group != (c, lo, hi):
                    if len(ids) > 1:
                        yield edges_of(ids, sets)
                    group, ids, sets = (c, lo, hi), [], []
                ids.append(s)
                sets.append(np.frombuffer(found.as_py(), np.uint64))
        if len(ids) > 1:
            yield edges_of(ids, sets)

    return groups.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInArrow(run, "src long, dst long").distinct()


def met(keys: DataFrame, tasks: int | None = None) -> DataFrame:
    """``src, dst, star``: the pairs of sets ``s`` under each of ``bands``; of over ``PAIRS`` sets each with the least one (``star``)."""
    import pyarrow as pa

    def run(batches):
        slots, sets, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in _and_end(batches):
            src, dst, star = [], [], []
            if batch is not None:
                slots, sets = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((slots, sets)))
            once = np.flatnonzero((np.diff(slots, prepend=~slots[:1]) != 0) | (np.diff(sets, prepend=~sets[:1]) != 0))
            slots, sets = slots[once], sets[once]
            if large and len(slots):  # the rest of a key that had too many sets before
                rest = int(np.searchsorted(slots, large[0], "right"))
                src, dst, star = [sets[:rest]], [np.full(rest, large[1])], [np.ones(rest, bool)]
                slots, sets, large = slots[rest:], sets[rest:], large if rest == len(slots) else None
            begins = np.flatnonzero(np.diff(slots, prepend=~slots[:1]) != 0)
            size = np.diff(begins, append=len(slots))
            upto = len(slots)
            if batch is not None and len(size):  # the last key may go on
                if size[-1] > PAIRS:
                    large = slots[-1], sets[begins[-1]]
                else:
                    upto, begins, size = begins[-1], begins[:-1], size[:-1]
            own, key = np.repeat(size, size), np.repeat(np.arange(len(size)), size)
            many = np.flatnonzero(own > PAIRS)
            src.append(sets[many])
            dst.append(sets[begins[key[many]]])
            star.append(np.ones(len(many), bool))
            few = np.flatnonzero((own > 1) & (own <= PAIRS))
            for ahead in range(1, int(min(size.max(initial=0), PAIRS))):
                few = few[few + ahead < upto]
                few = few[key[few] == key[few + ahead]]
                src.append(sets[few + ahead])
                dst.append(sets[few])
                star.append(np.zeros(len(few), bool))
            slots, sets = slots[upto:], sets[upto:]
            src, dst, star = (np.concatenate(x) for x in (src, dst, star))
            differ = src != dst
            yield pa.RecordBatch.from_arrays([pa.array(x[differ]) for x in (src, dst, star)], names=["src", "dst", "star"])

    # The rows of a key are a sorted stream, so they are shuffled once and at most ``PAIRS`` of a key are held.
    return (keys.select(F.explode("bands").alias("slot"), "s").repartition(*([tasks] if tasks else []), "slot").sortWithinPartitions("slot", "s")
            .mapInArrow(run, "src long, dst long, star boolean").distinct())


def that_may_be_similar(pairs: DataFrame, per: DataFrame, similarity: float) -> DataFrame:
    """``src, dst``: the pairs of sets that ``n`` and ``odd`` in ``per`` do not prove to be apart."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            src, dst, n, m = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            near = np.flatnonzero(may_be_similar(n, batch.column(3).to_pylist(), m, batch.column(5).to_pylist(), similarity))
            yield pa.RecordBatch.from_arrays([pa.array(src[near]), pa.array(dst[near])], names=["src", "dst"])

    of = lambda end, tag: per.select(F.col("s").alias(end), F.col("n").alias(f"n{tag}"), F.col("odd").alias(f"odd{tag}"))
    both = pairs.select("src", "dst").join(of("src", 0), "src").join(of("dst", 1), "dst")
    return both.select("src", "dst", "n0", "odd0", "n1", "odd1").mapInArrow(run, "src long, dst long")


def candidate_clusters(per: DataFrame, keys: DataFrame, similarity: float | None = None, tasks: int | None = None) -> DataFrame:
    """``s, cluster, blocks``: sets ``s`` (of size ``n`` in ``per``) that are connected by common ``bands`` in ``keys``, and how many blocks their
    cluster has. ``keys`` may hold a set repeatedly. With a ``similarity``, pairs that ``odd`` in ``per`` proves to be apart do not count.
    ``tasks`` sort the keys (otherwise as many as Spark is set to)."""
    edges = cut_lineage(met(keys, tasks))
    if similarity is not None:
        edges = cut_lineage(edges.where("star").select("src", "dst").unionByName(that_may_be_similar(edges.where("NOT star"), per, similarity)))
    nodes = cut_lineage(connected_components(edges).select(F.col("node").alias("s"), F.col("component").alias("cluster")).join(per.select("s", "n"), "s"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), blocks.alias("blocks"))
    return attach_per_key(nodes, sizes, ["cluster"], "m").select("s", "cluster", "blocks")


def similar_classes(rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``k, a, b, class`` of ``rows`` (``k, a, b, text``): rows are linked if the Jaccard similarity of their sets of shingles is at least
    ``similarity``. ``a, b`` identify key and text."""
    import pyarrow as pa

    seen = cut_lineage(described(rows, shingle))
    every, counts = seen.where("n IS NOT NULL"), np.zeros(1 << COUNT_BITS, np.int64)
    table = seen.where("n IS NULL").groupBy("a").agg(F.sum("b").alias("b")).toArrow()
    counts[table.column("a").to_numpy()] = table.column("b").to_numpy()
    per = cut_lineage(every.groupBy("s").agg(F.min(F.struct("a", "b")).alias("r"), F.first("n").alias("n"), F.first("odd").alias("odd")))
    clusters = candidate_clusters(per, filed(rows, shingle, similarity, Shared(rows.sparkSession, counts)), similarity, -(-int(counts.sum()) // SORTED))
    chosen = cut_lineage(per.select("s", "r.a", "r.b").join(clusters, "s"))

    def run(batches):
        for batch in _slices(batches):
            sets = [shingle_set(t.as_py().translate(LOWER).split(), shingle).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sets, pa.binary())], names=["s", "cluster", "blocks", "set"])

    # Of repeated rows (the same a and b) one is taken, after the join, as a set must not meet itself in a group.
    texts = (that_may_be_in(rows.select("a", "b", F.col("text").cast("binary").alias("t")), chosen, "a").join(chosen, ["a", "b"]).dropDuplicates(["s"])
             .select("s", "cluster", "blocks", "t").mapInArrow(run, "s long, cluster long, blocks int, set binary"))
    classes = connected_components(cut_lineage(similar_edges(cut_lineage(texts), similarity)))
    return (every.select("k", "a", "b", "s").join(classes.select(F.col("node").alias("s"), "component"), "s", "left")
            .select("k", "a", "b", F.coalesce("component", "s").alias("class")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` with one document of each class left: that with the least key (a null key counts as the least).

    Documents are linked if their sets of shingles (A-Z lower-cased, words between ASCII white space) have a Jaccard similarity of at least
    ``similarity``; the classes are the connected components. Texts without a word are one class. Of repeated rows (same key and text)
    one stays. The columns are those of ``docs``. A row is identified by two hashes of key and text, so the decision is taken without the
    texts and joined to them once.
    """
    k, t = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    a, b = F.xxhash64(k, t), F.xxhash64(t, F.lit("/"), k)
    rows = docs.select(k.alias("k"), a.alias("a"), b.alias("b"), t.alias("text"))
    stay = (similar_classes(rows, similarity, shingle).groupBy("class").agg(F.min(F.struct("k", "a", "b")).alias("r"))
            .select(F.col("r.a").alias("_stay_a"), F.col("r.b").alias("_stay_b")))
    marked = docs.withColumns({"_stay_a": a, "_stay_b": b})
    return marked.join(stay, ["_stay_a", "_stay_b"], "left_semi").dropDuplicates(["_stay_a", "_stay_b"]).select(*[F.col(f"`{c}`") for c in docs.columns])


by_value(__name__)
