"""Connected components of an edge table, by alternating large and small stars, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, cut, scratch

#: Edges from which a node's are not dealt by node.
HUB = 1000


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(s: Scratch, edges: DataFrame, name: str, bound: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, m) of edges (u, v), m being the least v of u; and (u, m). Nodes of `bound` edges or more get theirs by broadcast, where their edges are;
    there are as many as edges over bound at most. The others' edges are dealt by u."""
    least = s.keep(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), name)
    hubs = F.broadcast(least.where(F.col("n") >= bound).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.select("u", "m").hint("shuffle_merge"), "u")
    return edges.join(hubs, "u").unionByName(rest), least.select("u", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node of an edge between two different nodes.

    Nodes are whole numbers or strings. Edges with a null end and loops say nothing and are left out; an empty table gives an empty one. Every round
    points each neighbourhood to its minimum, which pre-aggregates by node; the edges of a node of very many stay where they are.
    Ends when a round changes nothing.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    with scratch(edges.sparkSession) as s:
        e, n = s.keep(e.distinct(), "edges0"), 0
        state = _state(e)
        while True:
            bound = max(HUB, 2 * state[0] // BROADCAST_ROWS)
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large, _ = _with_least(s, both, f"least{n}", bound)
            large = large.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            large = s.keep(large.where("u != v").distinct(), f"large{n}")
            small, least = _with_least(s, large, f"lower{n}", bound)
            small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v")))
            e = s.keep(small.distinct(), f"edges{n + 1}")
            before, state = state, _state(e)
            for name in ("edges", "large", "least", "lower"):
                s.drop(f"{name}{n}")
            n += 1
            if state == before:
                break
        roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return cut(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots))
