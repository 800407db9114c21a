"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


#: Tasks that the neighbours of one node are dealt over.
SALTS = 16


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``, component being the smallest node reachable.

    Alternating star contraction: each node points its larger neighbours, then
    its smaller ones, at the smallest neighbour.  Each round is a pre-aggregated
    minimum and a join that is salted, so a node with very many neighbours is dealt over
    ``SALTS`` tasks; each round is written to shared storage.  Nodes without an edge,
    and self-loops, don't appear.  An empty table gives an empty table.
    """
    cur = materialize(_tidy(edges), "edges")
    before = _signature(cur)
    for _ in range(max_rounds):
        large = _star(cur, larger=True)
        nxt = materialize(_tidy(_star(large, larger=False)), "edges")
        discard(cur)
        cur, last, before = nxt, before, _signature(nxt)
        if before == last:
            break
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    leaf = cur.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return leaf.union(leaf.select(F.col("component").alias("node"), "component").distinct())


def _signature(edges: DataFrame) -> tuple:
    """Number and two independent sums of hashes of distinct edges: equal for equal tables, without comparing row by row."""
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a, 7) as decimal(38, 0)))")).first())


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link every larger (or every smaller) neighbour of a node, and the node, to the least of them."""
    back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(back) if larger else back
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    kept = both.where("v > u") if larger else both
    spread = low.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = kept.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "salt"]).select(F.col("m").alias("a"), F.col("v").alias("b"))
    if not larger:
        out = out.union(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
