"""Exact top-k search over a vector-approximation file.

The file is a table of blocks. A block holds up to ``block_rows`` vectors: their ids, their exact integer components, and an
approximation: for every dimension the number of the cell its component lies in, with cell marks that are spread over
the block's own range of that dimension. A search brings every block of queries together with every block of the file,
in bounded groups. In such a group the approximations are scanned first; they bound each inner product from below and
above. The exact vectors are then read in the order of their bounds, and reading ends for a query when no unread vector's
bound reaches the k-th result. The k best of every group are merged in rank order.

The queries are a stated set, met by all rows in blocks; a group returns at most k rows a query, whatever ties there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shipping import by_value

BLOCK_ROWS = 16_384
QUERY_ROWS = 512
READ_AT_ONCE = 64
#: Magnitude up to which sums of products are exact in double precision.
EXACT = 2.0 ** 53

FILE_SCHEMA = "block string, dims int, n int, ids binary, exact binary, cells binary, marks binary"
QUERY_SCHEMA = "source string, dims int, ids binary, places binary, vectors binary"


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``k, v`` with v = floor(scale * component), for the rows whose key is not null and whose components are all finite."""
    x = F.col("v")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (rows.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("k").isNotNull() & x.isNotNull() & finite)
            .select("k", F.transform(x, lambda e: F.floor(e * scale)).alias("v")))


def build(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, bits: int = 6,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The vector-approximation file of ``rows``: every vector is in exactly one block; blocks hold one vector length each."""
    import pyarrow as pa
    from pyspark import TaskContext

    def pack(name, ids, v):
        lo, hi = v.min(axis=0), v.max(axis=0)
        # Marks are integers; cell c of a dimension holds lo + marks[c] <= x <= lo + marks[c + 1] - 1.
        span = hi.astype(object) - lo.astype(object) + 1
        marks = np.array([[int(s) * c >> bits for c in range((1 << bits) + 1)] for s in span], dtype=object).reshape(len(span), (1 << bits) + 1)
        edges = (marks + lo.astype(object)[:, None])
        cells = np.empty(v.shape, np.uint8 if bits <= 8 else np.uint16)
        for d in range(v.shape[1]):
            cells[:, d] = np.searchsorted(edges[d].astype(np.float64), v[:, d].astype(np.float64), side="right") - 1
        cells = np.minimum(cells, (1 << bits) - 1)
        narrow = v.astype(np.int32) if v.size and np.abs(v.astype(np.float64)).max() < 2 ** 31 else v
        return name, v.shape[1], len(ids), ids.tobytes(), narrow.tobytes(), cells.tobytes(), edges.astype(np.float64).tobytes()

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        waiting: dict[int, list] = {}
        for batch in _and_end(batches):
            if batch is not None:
                lists = batch.column(1)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat, ids = lists.flatten().to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                for dims in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == dims)
                    place = (ends[at] - dims)[:, None] + np.arange(dims)
                    waiting.setdefault(dims, []).append((ids[at], flat[place].astype(np.int64)))
            for dims, parts in waiting.items():
                k, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                while len(k) >= block_rows or batch is None and len(k):
                    out = pack(f"{task}-{number}", k[:block_rows], v[:block_rows])
                    number += 1
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, [pa.string(), pa.int32(), pa.int32()] + [pa.binary()] * 4, strict=True)],
                                                     names=["block", "dims", "n", "ids", "exact", "cells", "marks"])
                    k, v = k[block_rows:], v[block_rows:]
                waiting[dims] = [(k, v)]

    return integer_vectors(rows, key, vector, scale).mapInArrow(run, FILE_SCHEMA)


def _and_end(items):
    yield from items
    yield None


def components(exact: bytes, n: int, dims: int) -> np.ndarray:
    """The exact vectors of a block, kept in 32 bits where they fit."""
    return np.frombuffer(exact, np.int32 if len(exact) == 4 * n * dims else np.int64).reshape(n, dims)


def query_blocks(file: DataFrame, every: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The vectors of the file whose id is divisible by ``every``, in blocks, with the place each has in the file."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for name, dims, ids, exact in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                k = np.frombuffer(ids, np.int64)
                v = components(exact, len(k), dims).astype(np.int64)
                places = np.flatnonzero(k % every == 0)
                for a in range(0, len(places), query_rows):
                    own = places[a:a + query_rows]
                    out = (name, dims, k[own].tobytes(), own.astype(np.int64).tobytes(), v[own].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, [pa.string(), pa.int32()] + [pa.binary()] * 3, strict=True)],
                                                     names=["source", "dims", "ids", "places", "vectors"])

    return file.select("block", "dims", "ids", "exact").mapInArrow(run, QUERY_SCHEMA)


def bounds(cells: np.ndarray, edges: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of ``queries`` (rows) with the approximated vectors (columns), as doubles.

    With the ends l and u of a cell, q * x lies within q * (l + u) / 2 -+ |q| * (u - l) / 2.
    """
    d = np.arange(cells.shape[1])
    low, high = edges[d, cells], edges[d, cells.astype(np.intp) + 1] - 1
    high = np.maximum(low, high)
    q = queries.astype(np.float64)
    middle, reach = q @ (low + high).T, np.abs(q) @ (high - low).T
    return (middle - reach) / 2, (middle + reach) / 2


def products(vectors: np.ndarray, query: np.ndarray, exact_in_double: bool) -> np.ndarray:
    """Integer inner products; beyond the range of long they stand at its ends."""
    if exact_in_double:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    full = vectors.astype(object) @ query.astype(object)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in full], np.int64)


def search_block(ids, vectors, cells, edges, queries, skip, k: int):
    """For every query the places and scores of its k best vectors of a block; ``skip`` is the place of its own row or -1."""
    most = lambda x: np.abs(x.astype(np.float64)).max(initial=1)
    sizes = vectors.shape[1] * most(vectors) * most(queries)
    in_double = sizes < EXACT / 4
    low, high = bounds(cells, edges, queries) if in_double else (np.full((len(queries), len(ids)), -np.inf), np.full((len(queries), len(ids)), np.inf))
    for i, q in enumerate(queries):
        lower, upper = low[i], high[i]
        if skip[i] >= 0:
            lower[skip[i]] = upper[skip[i]] = -np.inf
        left = len(ids) - (skip[i] >= 0)
        if left <= 0:
            continue
        # The k-th best lower bound: what cannot reach it is never read.
        floor = np.partition(lower, len(lower) - k)[len(lower) - k] if left > k else -np.inf
        places = np.flatnonzero(upper >= floor)
        if skip[i] >= 0:
            places = places[places != skip[i]]
        places = places[np.lexsort((ids[places], -upper[places]))]
        got, scores, at, step = places[:0], np.zeros(0, np.int64), 0, max(READ_AT_ONCE, k)
        while at < len(places):
            now = places[at:at + step]
            got, scores = np.concatenate([got, now]), np.concatenate([scores, products(vectors[now], q, in_double)])
            best = np.lexsort((ids[got], ~scores))[:k]  # ~x falls as x rises, over all of long
            got, scores = got[best], scores[best]
            at, step = at + step, step * 2
            if at < len(places) and len(got) == k and upper[places[at]] < scores[-1]:
                break
        yield i, got, scores


def top_k(rows: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0,
          bits: int = 6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k highest integer inner products of every query with all rows but its own: ``query_id, rank, vec_id, score``.

    Queries are the rows whose key is divisible by ``every``. Components become floor(scale * x); ties go to the smaller key; a query
    with fewer than k candidates gets all of them. Rows whose key or vector is null, or whose vector holds null or non-finite
    components, take no part; vectors of different length do not meet. Repeated rows each take part, and a repeated query row
    gives its results again. Scores beyond the range of long stand at its ends. An empty table gives an empty result; other
    columns play no part.
    """
    import pyarrow as pa

    file = cut_lineage(build(rows, key, vector, scale, bits, block_rows))
    wide = np.uint8 if bits <= 8 else np.uint16

    def run(batches):
        block = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:  # a block of the file; the query blocks it meets follow
                    ids, dims = np.frombuffer(row["ids"], np.int64), row["dims"]
                    block, vectors = row["block"], components(row["exact"], len(ids), dims).astype(np.int64)
                    cells = np.frombuffer(row["cells"], wide).reshape(len(ids), dims)
                    edges = np.frombuffer(row["marks"], np.float64).reshape(dims, (1 << bits) + 1)
                    continue
                assert row["block"] == block
                who, places = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["places"], np.int64)
                queries = np.frombuffer(row["exact"], np.int64).reshape(len(who), dims)
                skip = places if row["source"] == block else np.full(len(who), -1)
                out = list(search_block(ids, vectors, cells, edges, queries, skip, k))
                if out:
                    n = [len(got) for _, got, _ in out]
                    of = np.repeat([i for i, _, _ in out], n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["source"]] * len(of), pa.string()), pa.array(places[of]), pa.array(who[of]),
                         pa.array(ids[np.concatenate([g for _, g, _ in out])]), pa.array(np.concatenate([s for _, _, s in out]))],
                        names=["source", "place", "query_id", "vec_id", "score"])

    # Every query block is sent to every block of the file that holds vectors of its length, and is met there by the one copy of
    # that block: rows of a block follow each other in one task, the block itself first.
    names = file.select("block", F.col("dims").alias("file_dims"))
    sent = (query_blocks(file, every).join(names, F.col("dims") == F.col("file_dims"))
            .select("block", F.lit(1).alias("kind"), "source", "dims", "ids", F.col("vectors").alias("exact"), "places",
                    F.lit(None).cast("binary").alias("cells"), F.lit(None).cast("binary").alias("marks")))
    blocks = file.select("block", F.lit(0).alias("kind"), F.lit("").alias("source"), "dims", "ids", "exact",
                         F.lit(None).cast("binary").alias("places"), "cells", "marks")
    found = (blocks.unionByName(sent).repartition("block").sortWithinPartitions("block", "kind", "source")
             .mapInArrow(run, "source string, place long, query_id long, vec_id long, score long"))
    order = Window.partitionBy("source", "place", "query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def top_k_sql() -> str:
    return """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
        QUALIFY rank <= 20"""


by_value(__name__)
