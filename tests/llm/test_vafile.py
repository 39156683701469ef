import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.llm import vafile


def vectors(spark, n=300, dims=6, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, [0.25] * dims) for i in range(60)]  # ties
    rows += [(2000, None), (2020, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (2040, [float("nan")] * dims), (2060, [float("inf")] * dims), (None, [0.3] * dims),
             (2080, [0.5, 0.5]), (2081, [0.5, -0.5]), (2100, []), (2101, []), (2120, [1e12] * dims), (2121, [-1e12] * dims), (2140, [1e300] * dims), (40, rows[40][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("k", "v", "score", "rank", "block", "query_id", "label")})


def brute(df, k=20, every=20):
    rows = [(r.vec_id, [min((1 << 63) - 1, max(-(1 << 63), math.floor(64 * x))) for x in r.embedding]) for r in df.select("vec_id", "embedding").collect()
            if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    out = []
    for i, (q, v) in enumerate(rows):
        if q % every == 0:
            found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=True)))), c) for j, (c, w) in enumerate(rows) if j != i and len(w) == len(v))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_rows, bits", [(16_384, 6), (32, 2)])
def test_equals_brute_force(spark, block_rows, bits):
    df = vectors(spark)
    got = vafile.top_k(df, block_rows=block_rows, bits=bits)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(df)


def test_empty_table(spark):
    assert vafile.top_k(vectors(spark).where("false")).collect() == []


def test_few_exact_vectors_are_read(spark, monkeypatch):
    """Bounds prune: with six bits nearly all of a block stays unread."""
    rng = np.random.default_rng(0)
    v = np.floor(64 * rng.normal(0, 0.12, (4000, 64))).astype(np.int64)
    lo, hi = v.min(axis=0), v.max(axis=0)
    marks = np.array([[int(s) * c >> 6 for c in range(65)] for s in hi - lo + 1]) + lo[:, None]
    cells = np.stack([np.searchsorted(marks[d], v[:, d], side="right") - 1 for d in range(64)], axis=1).astype(np.uint8)
    read = []
    real = vafile.products
    monkeypatch.setattr(vafile, "products", lambda x, q, e: read.append(len(x)) or real(x, q, e))
    ids = np.arange(4000)
    for _, places, scores in vafile.search_block(ids, v, cells, marks.astype(float), v[:20], np.arange(20), 20):
        assert len(places) == 20 and (np.diff(scores) <= 0).all()
    assert sum(read) < 20 * 400
    low, high = vafile.bounds(cells, marks.astype(float), v[:20])
    exact = v[:20] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
