"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregate-and-join steps over the edge list. Minima come from partial aggregates,
so a hub is never collected, and the join of the minimum back to a hub's edges is salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import attach_per_key


def _with_min(edges: DataFrame, hub_degree: int, n_edges: int) -> DataFrame:
    """``edges(u, v)`` plus ``m``, the least ``v`` of each ``u``."""
    mins = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))
    return attach_per_key(edges, mins, ["u"], "deg", hub_degree, total=n_edges).drop("deg")


def _large_star(e: DataFrame, hub_degree: int, n: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _with_min(both, hub_degree, 2 * n)
    return m.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(e: DataFrame, hub_degree: int, n: int) -> DataFrame:
    m = _with_min(e, hub_degree, n)
    linked = m.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(m.select("u", F.col("m").alias("v"))).distinct()


def _settle(e: DataFrame) -> tuple[DataFrame, dict]:
    """Cut the lineage; the edge count and a content mark are observed while the table is written."""
    seen = Observation()
    out = cut_lineage(e.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")))
    return out, seen.get


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", hub_degree: int = 100_000,
                         max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component = least node id.

    Lineage is cut after each round in the shared checkpoint folder. The loop ends when a round
    leaves the edge set unchanged.
    """
    e, mark = _settle(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
                      .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        before, n = mark, mark["n"]
        if n == 0:
            break
        # The large star turns every edge so that u > v, which is the input the small star needs.
        e, mark = _settle(_small_star(_large_star(e, hub_degree, n), hub_degree, n))
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))


def reachable(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst", node: str = "node", max_rounds: int = 10_000) -> DataFrame:
    """``(node, hops)``: every node that a seed leads to along directed edges, with the fewest edges to it; seeds have 0.

    Each round follows the edges of the nodes that were new in the round before, so an edge is used once and cycles end. A round is a join of
    the new nodes with the edges and an anti-join with what has been reached; both are written, so lineage does not grow.
    """
    e = cut_lineage(edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).where("_s IS NOT NULL AND _d IS NOT NULL").distinct())
    new = cut_lineage(seeds.select(F.col(node).alias("_n")).where("_n IS NOT NULL").distinct())
    reached = new.withColumn("_h", F.lit(0))
    for hop in range(1, max_rounds + 1):
        seen = Observation()
        step = (e.join(new, e["_s"] == new["_n"], "left_semi").select(F.col("_d").alias("_n")).distinct()
                .join(reached.select("_n"), "_n", "left_anti"))
        new = cut_lineage(step.observe(seen, F.count(F.lit(1)).alias("n")))
        if seen.get["n"] == 0:
            return reached.select(F.col("_n").alias(node), F.col("_h").alias("hops"))
        reached = reached.unionByName(new.withColumn("_h", F.lit(hop)))
    raise RuntimeError(f"reachability did not settle in {max_rounds} rounds")
