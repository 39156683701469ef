"""Exact Jaccard join of n-gram sets by prefix trees.

Every text becomes the set of its word shingles, as 64-bit numbers whose order is one global order: shingles of rarer buckets come first
(a sketch of fixed size counts all shingles of the corpus). Two sets that are similar enough share a shingle among the first few of each,
so a set is a candidate only under its first shingles. Under one shingle the parity signatures of the sets are compared (each differing
member turns one bit, so more differing bits than allowed members rule a pair out); only sets that still have a partner go on, whole. A
large set is dealt into parts by a hash of the shingle: if two sets are similar enough, some part of them is, so that a signature has one
size for sets of any size.

The sets of one shingle are stored in a trie: sets with the same beginning share its nodes. A set walks the trie of the others level
by level and carries the overlap with each node, which all sets below share; a subtree is left where the overlap so far and what remains of
the set or of the longest set below cannot reach the overlap that is needed. At the end of a set its overlap is exact.

Classes grow inside a group: what is linked leaves the trie, so a group of copies is walked about once. A group returns at most one edge a
set. Groups of a frequent shingle are cut into blocks, of which every two meet. Sets go to the groups of their first few shared shingles;
after that only shingles whose sets are still in several components are joined, so that copies do not travel to every shingle they share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from ..operators.skew import attach_per_key
from ..session import cut_lineage
from .shipping import Shared, by_value

#: Buckets of the sketch; a bucket is the leading bits of a shingle's number. The counts are the one broadcast, of fixed size.
BUCKET_BITS = 17
#: Sets of a block of a group.
BLOCK = 1024
#: Shingles of the sets of a block.
BLOCK_SHINGLES = 1_000_000
#: Shared shingles under which a set is joined at first.
FIRST = 3
#: Members of a part that has a signature of its own, about; bits of a signature.
PART = 1000
SIGNATURE_BITS = 512
#: Longest stretch of a node, in shingles.
NODE = 32
#: Slots of row ids, the most that are broadcast.
SLOTS = 1 << 20
#: Words whose numbers a task keeps.
CACHE = 500_000
#: Bytes of sets of one Arrow batch.
OUTPUT_BYTES = 16_000_000

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class WordNumbers(dict):
    """Word -> 64-bit number, computed when first met."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(text: bytes, shingle: int, numbers: WordNumbers) -> np.ndarray:
    """The distinct shingles of a text as sorted numbers (fewer words: the whole sequence; none: empty)."""
    # bytes.split() cuts at 0x20 and 0x09-0x0D, which is the white space of the definition.
    words = text.translate(LOWER).split()
    w = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(w))
    if not size:
        return w
    mixed = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ w[i:i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def bucket_ranks(counts: np.ndarray) -> np.ndarray:
    """Place of each bucket when buckets are sorted by their counts, rare ones first."""
    ranks = np.empty(len(counts), np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64)
    return ranks


def ordered(found: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set in global order: the bucket in a number is replaced by the bucket's place, which keeps numbers distinct."""
    low = np.uint64(64 - BUCKET_BITS)
    return np.sort(ranks[found >> low] << low | found & np.uint64((1 << int(low)) - 1))


class Threshold:
    """Similarity as a percentage: 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        if not 1 <= percent <= 100:
            raise ValueError("percent must be 1 to 100")
        self.percent = percent

    def overlap(self, a, b):
        """Least intersection of linked sets of ``a`` and ``b`` members."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix(self, n: int) -> int:
        """So many first members of a set hold one that a linked set has among its own first."""
        return n + -self.percent * n // 100 + 1

    def differing(self, a, b):
        """Most members that only one of two linked sets of ``a`` and ``b`` members has."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def lonely(self, n):
        """Whether a set of ``n`` members can be linked with its equals only."""
        return (100 * (n - 1) < self.percent * n) & (100 * n < self.percent * (n + 1))


class Trie:
    """Distinct ordered sets as a tree of stretches. Nodes stand parents first; a set ends at a node of its own."""

    def __init__(self, sets: list[np.ndarray]):
        by = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.size = np.array([len(s) for s in sets], np.int64)
        parent, depth, stretch, ends = [-1], [0], [sets[0][:0]], [-1]
        path, before = [0], None  # nodes from the root to the end of the set before
        for i in by:
            s, shared = sets[i], 0
            if before is not None:
                n = min(len(s), len(before))
                same = s[:n] == before[:n]
                shared = n if same.all() else int(same.argmin())
            while depth[path[-1]] > shared and depth[path[-2]] >= shared:
                path.pop()
            top = path[-1]
            if depth[top] > shared:
                # The stretch parts inside: its beginning becomes a node between.
                over = len(stretch[top]) - (depth[top] - shared)
                parent.append(parent[top])
                depth.append(shared)
                stretch.append(stretch[top][:over])
                ends.append(-1)
                stretch[top], parent[top], path[-1] = stretch[top][over:], len(parent) - 1, len(parent) - 1
            # Long rests are cut, so that a walk can leave them part of the way.
            at, step = shared, max(NODE, len(s) // 16)
            while at < len(s):
                upto = min(len(s), at + step)
                parent.append(path[-1])
                depth.append(upto)
                stretch.append(s[at:upto])
                ends.append(-1)
                path.append(len(parent) - 1)
                at = upto
            ends[path[-1]] = i
            before = s
        self.depth = np.array(depth)
        self.flat = np.concatenate(stretch)
        self.length = np.array([len(x) for x in stretch])
        self.begin = np.cumsum(self.length) - self.length
        self.last = np.array([x[-1] if len(x) else 0 for x in stretch], np.uint64)
        self.ends = np.array(ends)
        up = np.array(parent)
        self.child = np.argsort(up, kind="stable")[1:]  # without the root
        self.children = np.bincount(up[1:], minlength=len(up))
        self.first_child = np.cumsum(self.children) - self.children
        # Smallest and largest set below each node, from the deepest level up.
        self.low, self.high = np.full(len(up), 1 << 60), np.zeros(len(up), np.int64)
        at = np.flatnonzero(self.ends >= 0)
        self.low[at] = self.high[at] = self.size[self.ends[at]]
        levels, front = [], np.zeros(1, np.int64)
        while len(front):
            levels.append(front)
            front = self._below(front)[0]
        self.levels, self.up = levels, up
        for level in levels[:0:-1]:
            np.minimum.at(self.low, up[level], self.low[level])
            np.maximum.at(self.high, up[level], self.high[level])

    def _below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes, and for each the place of its parent in ``nodes``."""
        n = self.children[nodes]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first_child[nodes] - (ends - n), n)
        return self.child[at], np.repeat(np.arange(len(nodes)), n)

    def alive(self, free: np.ndarray) -> np.ndarray:
        """For each node whether a free set ends below it."""
        some = np.zeros(len(self.ends), bool)
        at = np.flatnonzero(self.ends >= 0)
        some[at] = free[self.ends[at]]
        for level in self.levels[:0:-1]:
            some[self.up[level[some[level]]]] = True
        return some

    def linked(self, x: np.ndarray, free: np.ndarray, need: Threshold) -> np.ndarray:
        """The free sets that are linked with ``x``."""
        a, found = len(x), []
        alive = self.alive(free)
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while True:
            nodes, above = self._below(nodes)
            keep = alive[nodes] & (100 * np.minimum(self.high[nodes], a) >= need.percent * a) & (100 * a >= need.percent * self.low[nodes])
            nodes, overlap = nodes[keep], overlap[above[keep]]
            if not len(nodes):
                break
            n = self.length[nodes]
            ends = np.cumsum(n)
            tokens = self.flat[np.arange(ends[-1]) + np.repeat(self.begin[nodes] - (ends - n), n)]
            place = np.searchsorted(x, tokens)
            hit = x[np.minimum(place, a - 1)] == tokens
            overlap = overlap + np.add.reduceat(hit, ends - n, dtype=np.int64)
            rest = a - np.searchsorted(x, self.last[nodes], "right")
            can = ((overlap + rest >= need.overlap(a, np.maximum(self.low[nodes], -(-need.percent * a // 100))))
                   & (overlap + self.high[nodes] - self.depth[nodes] >= need.overlap(a, self.high[nodes])))
            nodes, overlap = nodes[can], overlap[can]
            end = self.ends[nodes]
            at = np.flatnonzero(end >= 0)
            at = at[free[end[at]]]
            at = at[overlap[at] >= need.overlap(a, self.size[end[at]])]
            found.append(end[at])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def roots(sets: list[np.ndarray], labels: list, need: Threshold) -> np.ndarray:
    """For each set the place of one set that it is connected with, the same for all of a class. Sets of one label are connected.

    A class grows from one set; only sets that are in no class yet stay in the trie."""
    trie, free, root = Trie(sets), np.ones(len(sets), bool), np.full(len(sets), -1)
    of: dict = {}
    for i, label in enumerate(labels):
        of.setdefault(label, []).append(i)
    for first in range(len(sets)):
        queue = of[labels[first]] if free[first] else []
        root[queue], free[queue] = first, False
        queue = list(queue)
        while queue and free.any():
            for other in trie.linked(sets[queue.pop()], free, need).tolist():
                if free[other]:
                    mates = of[labels[other]]
                    root[mates], free[mates] = first, False
                    queue.extend(mates)
    return root


def sketch(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """Counts of all shingles by bucket. Each task sums its own rows; the result has ``2**BUCKET_BITS`` numbers at any size."""
    import pyarrow as pa

    def run(batches):
        numbers, total = WordNumbers(), np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                found = shingle_set(t.as_py(), shingle, numbers)
                np.add.at(total, found >> np.uint64(64 - BUCKET_BITS), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).mapInArrow(run, "b long, n long")
    table = rows.groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[table.column("b").to_numpy()] = table.column("n").to_numpy()
    return counts


def levels(n: int, need: Threshold) -> range:
    """The levels at which a set of ``n`` members is filed: at level L it has 2**L parts. A linked set is filed at one of them too."""
    level = lambda m: max(0, (-(-m // PART) - 1).bit_length())
    return range(level(-(-need.percent * n // 100)), level(n) + 1)


def parts(found: np.ndarray, need: Threshold) -> list[dict]:
    """The parts of an ordered set: number, size, signature and the names of its first members, under which it is filed."""
    out = []
    if not len(found) or need.lonely(len(found)):
        return out
    for level in levels(len(found), need):
        of = found >> np.uint64(9) & np.uint64((1 << level) - 1)
        for p in range(1 << level):
            own = found[of == p] if level else found
            if len(own):
                odd = np.bincount((own & np.uint64(SIGNATURE_BITS - 1)).astype(np.int64), minlength=SIGNATURE_BITS) & 1
                first = (own[:need.prefix(len(own))] ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.int64)
                out.append({"part": (1 << level) + p, "m": len(own), "signature": np.packbits(odd.astype(np.uint8)).tobytes(), "first": first})
    return out


def described(docs: DataFrame, key: str, text: str, shingle: int, need: Threshold, ranks: Shared) -> DataFrame:
    """``k, a, b, s, n, parts``: key and row id of each row, the 128-bit name of its set, the set's size and its parts (none, if only equal
    sets can be linked)."""
    import pyarrow as pa

    k, t = F.col(key), F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(k.alias("k"), F.xxhash64(t, k).alias("a"), F.xxhash64(k, F.lit("/"), t).alias("b"), t.cast("binary").alias("t"))
    kind = "array<struct<part:int,m:long,signature:binary,first:array<long>>>"
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("s", T.BinaryType()), T.StructField("n", T.LongType()),
                           T.StructField("parts", T._parse_datatype_string(kind))])
    arrow = pa.list_(pa.struct([("part", pa.int32()), ("m", pa.int64()), ("signature", pa.binary()), ("first", pa.list_(pa.int64()))]))

    def run(batches):
        import xxhash

        place, numbers = ranks.derived(bucket_ranks), WordNumbers()
        for batch in batches:
            names, sizes, filed = [], [], []
            for t in batch.column(3):
                found = ordered(shingle_set(t.as_py(), shingle, numbers), place)
                names.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                filed.append(parts(found, need))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()),
                                              pa.array(filed, arrow)], names=schema.names)

    return rows.mapInArrow(run, schema)


def in_blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``g, lo, hi`` and the columns: every two blocks of a shingle's rows (``g, blocks, s``) meet in one group, sorted by group."""
    groups = (rows.withColumn("_b", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int"))
              .select("g", *columns, "_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_c"))
              .select("g", F.least("_b", "_c").alias("lo"), F.greatest("_b", "_c").alias("hi"), *columns))
    return groups.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")


def has_partner(group: np.ndarray, m: np.ndarray, signature: np.ndarray, label: np.ndarray, met: np.ndarray, need: Threshold) -> np.ndarray:
    """Whether a row can be linked with another row of its group that has another label and that it has not met (``met``: a row of numbers
    each; two that share a number have met). Groups stand one after another."""
    size = np.diff(np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)))
    mine, out = np.repeat(size, size), np.zeros(len(group), bool)

    def near(i, j):
        apart = np.bitwise_count(signature[i] ^ signature[j]).sum(axis=-1, dtype=np.int64)
        known = (met[i][..., :, None] == met[j][..., None, :]).any(axis=(-1, -2))
        return (apart <= need.differing(m[i], m[j])) & (label[i] != label[j]) & ~known

    for ahead in range(1, int(min(size.max(initial=0), 16))):  # small groups: pairs at each offset, all groups at once
        i = np.flatnonzero((group[:-ahead] == group[ahead:]) & (mine[:-ahead] <= 16))
        i = i[near(i, i + ahead)]
        out[i] = out[i + ahead] = True
    for at in np.flatnonzero(np.diff(group, prepend=-1) != 0)[size > 16].tolist():
        every = np.arange(at, at + mine[at])
        for some in np.array_split(every, -(-len(every) // 64)):
            out[some] |= near(some[:, None], every[None, :]).any(axis=1)
    return out


def near_members(rows: DataFrame, need: Threshold) -> DataFrame:
    """The rows (``g, blocks, s, m, signature, label, met``) that have a partner under their shingle: ``g, s, m, signature``. Sets that
    share one of the shingles ``met`` (as many for every set) have been compared."""
    import pyarrow as pa

    def run(batches):
        kept = None
        for batch in _and_end(batches):
            held = [x for x in (kept, batch) if x is not None and x.num_rows]
            if not held:
                continue
            table = pa.concat_batches(held)
            g, lo, hi = (table.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero((np.diff(g) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            upto = len(g) if batch is None else (int(new[-1]) if len(new) else 0)
            kept = table.slice(upto) if upto < len(g) else None
            if upto:
                group = np.zeros(upto, np.int64)
                group[new[new < upto]] = 1
                head = table.slice(0, upto)
                bits = np.frombuffer(b"".join(head.column("signature").to_pylist()), np.uint64).reshape(upto, -1)
                label = head.column("label").dictionary_encode().indices.to_numpy()
                met = head.column("met").flatten().to_numpy().reshape(upto, -1)
                found = has_partner(np.cumsum(group), head.column("m").to_numpy(), bits, label, met, need)
                yield head.filter(pa.array(found)).select(["g", "s", "m", "signature"])

    return (in_blocks(rows, ["s", "m", "signature", "label", "met"]).mapInArrow(run, "g long, s binary, m long, signature binary")
            .dropDuplicates(["g", "s"]))


def _and_end(items):
    yield from items
    yield None


def joined(members: DataFrame, need: Threshold) -> DataFrame:
    """Edges ``src, dst`` between labels that connect exactly those connected by links of sets of one shingle ``g``.

    ``members``: g, blocks, s, label, set. Every two blocks of a shingle meet in one group."""
    import pyarrow as pa

    def edges(labels, sets):
        root = roots(sets, labels, need)
        found = {(labels[i], labels[r]) for i, r in enumerate(root.tolist()) if labels[i] != labels[r]}
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], names=["src", "dst"])

    def run(batches):
        group, labels, sets = None, [], []
        for batch in batches:
            for g, lo, hi, label, found in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), batch.column(5), strict=True):
                if group != (g, lo, hi):
                    if len(set(labels)) > 1:
                        yield edges(labels, sets)
                    group, labels, sets = (g, lo, hi), [], []
                labels.append(label)
                sets.append(np.frombuffer(found.as_py(), np.uint64))
        if len(set(labels)) > 1:
            yield edges(labels, sets)

    return in_blocks(members, ["s", "label", "set"]).mapInArrow(run, "src binary, dst binary").distinct()


def with_blocks(rows: DataFrame, size: str) -> DataFrame:
    """``rows`` (g, ...) of shingles that at least two rows have, with the number of blocks of each shingle; ``size``: shingles of a row."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(size) / BLOCK_SHINGLES)).cast("int").alias("blocks")
    per = rows.groupBy("g").agg(F.count(F.lit(1)).alias("_m"), blocks).where("_m > 1")
    return attach_per_key(rows, per, ["g"], "_m").drop("_m")


def similar_classes(docs: DataFrame, key: str, text: str, percent: int, shingle: int) -> DataFrame:
    """``k, a, b, s, n, class`` of every row of ``docs``; ``class`` is null for an empty set."""
    import pyarrow as pa

    spark, need = docs.sparkSession, Threshold(percent)
    ranks = Shared(spark, sketch(docs, text, shingle))
    every = cut_lineage(described(docs, key, text, shingle, need, ranks))
    # One row for each distinct set; copies cost nothing from here on.
    per = cut_lineage(every.where(F.size("parts") > 0).groupBy("s").agg(F.min(F.struct("a", "b")).alias("r"), F.first("n").alias("n"), F.first("parts").alias("parts")))
    # A part travels under a number of its own; if two parts have one, both are taken, which only makes more candidates.
    each = per.select("s", F.explode("parts").alias("p")).withColumn("e", F.xxhash64("s", "p.part"))
    filed = each.select("e", F.explode("p.first").alias("g"))
    counts = filed.groupBy("g").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    shared = attach_per_key(filed, counts, ["g"], "_m").select("g", "e")
    signed = cut_lineage(shared.join(each.select("e", "s", "p.m", "p.signature"), "e").select("g", "s", "m", "signature"))
    # Under each shingle the sets that may be linked with another.
    near = cut_lineage(near_members(with_blocks(signed, "m").withColumns({"label": F.col("s"), "met": F.array().cast("array<long>")}), need).join(per.select("s", "n"), "s"))

    def run(batches):
        place, numbers = ranks.derived(bucket_ranks), WordNumbers()
        for batch in batches:
            first, found, size = 0, [], 0
            for i, t in enumerate(batch.column(1)):
                found.append(ordered(shingle_set(t.as_py(), shingle, numbers), place).tobytes())
                size += len(found[-1])
                if size >= OUTPUT_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(found)), pa.array(found, pa.binary())], names=["s", "set"])
                    first, found, size = i + 1, [], 0

    # A set is identified by the first of its rows; of repeated rows (the same key and text) one is taken.
    t = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.xxhash64(t, F.col(key)).alias("a"), F.xxhash64(F.col(key), F.lit("/"), t).alias("b"), t.cast("binary").alias("t"))
    wanted = cut_lineage(per.select("s", "r.a", "r.b").join(near.select("s").distinct(), "s", "left_semi"))
    # Most texts are left where they are: only those whose row id falls in a slot of a wanted one are sent to the join. There are at most SLOTS.
    slot = F.pmod("a", F.lit(SLOTS))
    some = texts.withColumn("slot", slot).join(F.broadcast(wanted.select(slot.alias("slot")).distinct()), "slot", "left_semi").drop("slot")
    sets = cut_lineage(some.join(wanted, ["a", "b"]).dropDuplicates(["s"]).select("s", "t").mapInArrow(run, "s binary, set binary"))

    # Any fixed order of shingles does: linked sets share most of their first ones.
    own = near.groupBy("s").agg(F.array_sort(F.collect_list("g")).alias("gs"), F.first("n").alias("n"))
    routes = cut_lineage(own.select("s", "n", F.transform(F.sequence(F.lit(0), F.lit(FIRST - 1)), lambda i: F.get("gs", F.least(i, F.size("gs") - 1))).alias("met")))
    first = routes.select("s", "n", F.explode(F.array_distinct("met")).alias("g"))
    once = joined(with_blocks(first, "n").withColumn("label", F.col("s")).join(sets, "s"), need)
    parted = cut_lineage(connected_components(cut_lineage(once)).select(F.col("node").alias("s"), "component"))

    # Sets that have not met yet meet under every other shingle where they may link two components.
    labelled = (near.join(routes.select("s", "met"), "s").join(parted, "s", "left")
                .select("g", "s", "n", "m", "signature", F.coalesce("component", "s").alias("label"), "met"))
    apart = labelled.groupBy("g").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("g")
    rest = cut_lineage(labelled.join(apart, "g", "left_semi"))
    left = near_members(with_blocks(rest, "m"), need).select("g", "s").join(rest.select("g", "s", "n", "label"), ["g", "s"])
    twice = joined(with_blocks(cut_lineage(left), "n").join(sets, "s"), need)
    whole = connected_components(cut_lineage(parted.select(F.col("s").alias("src"), F.col("component").alias("dst")).where("src <> dst").unionByName(twice)))
    return (every.select("k", "a", "b", "s", "n").join(whole.select(F.col("node").alias("s"), "component"), "s", "left")
            .select("k", "a", "b", "s", "n", F.when(F.col("n") > 0, F.coalesce("component", "s")).alias("class")))


def join_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 90, shingle: int = 3) -> DataFrame:
    """``key, n_shingles, component_id, set_id`` of every row: the size of its set of distinct shingles, the least key that is reachable by
    links, and the name of its set.

    Sets (A-Z lower-cased, words between ASCII white space, fewer words than a shingle: the whole sequence) are linked if
    ``100 * intersection >= percent * union``. A row without a word has an empty set, is linked with nothing and is its own component. Null
    keys are kept and do not count for the least key (a class of null keys only has a null one); repeated rows give repeated rows; an empty
    table gives an empty result; other columns play no part, whatever their names.
    """
    rows = cut_lineage(similar_classes(docs, key, text, percent, shingle))
    least = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("k").alias("least"), F.count(F.lit(1)).alias("m"))
    return (attach_per_key(rows, least, ["class"], "m", how="left")
            .select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("k")).otherwise(F.col("least")).alias("component_id"),
                    F.lower(F.hex("s")).alias("set_id")))


def join_classes_sql() -> str:
    """``key, n_shingles, component_id`` in DuckDB SQL: shared shingles of every two sets counted by a join, components by recursion."""
    return r"""
    WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS g FROM w),
    u AS (SELECT r, len(g) AS n, unnest(g) AS g FROM s),
    l AS (SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    reach AS (SELECT r AS x, r AS y FROM s UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y)
    SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(t.doc_id) AS component_id FROM s JOIN reach ON reach.x = s.r JOIN s t ON t.r = reach.y GROUP BY s.r, s.doc_id, s.g"""


by_value(__name__)
