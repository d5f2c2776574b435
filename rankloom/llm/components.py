"""Connected components of a graph given as an edge table.

Alternating large-star and small-star steps: each step points nodes at the smallest node
they know, until every component is a star around its smallest node. A step is two
aggregations and joins over the edges, and its result is written before the next begins.
No step forms pairs of a node's neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.skew import dealt_join
from rankloom.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are linked to its smallest one."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    code = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(code), F.bit_xor(F.xxhash64(code, F.lit(1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` of longs to ``(node, component)``, for nodes that are not their component's smallest.

    Pairs in either direction and repeated pairs are fine; a null or a pair of equal nodes links nothing.
    """
    edges = cut_lineage(edges.select("a", "b").filter("a <> b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        state = _state(edges)
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state


def joined_by(known: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after more links ``(a, b)``; ``known`` is what ``components`` gave for those so far.

    Only the new links are walked, between the components that their ends are in already.
    """
    of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    more = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    if more.isEmpty():
        return known
    further = more.select(F.col("node").alias("component"), F.col("component").alias("further"))
    moved = dealt_join(known, further, ["component"], "node", "left")
    return cut_lineage(moved.select("node", F.coalesce("further", "component").alias("component")).unionByName(more))
