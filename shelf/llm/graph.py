"""Distributed union-find: connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.llm.common import Workspace, join_spread

#: Rounds after which contraction must have settled; it needs about log2(longest chain).
MAX_ROUNDS = 60


def components(ws: Workspace, edges: DataFrame, a: str, b: str, label: str = "cc") -> DataFrame:
    """Map every node of ``edges`` to the smallest node of its component.

    Returns ``(node long, component long)``. Each round is DataFrame aggregation and joins
    on node ids only; neighbour lists are never gathered. The label of a hub, a node with
    more than one edge in ``HEAVY`` of all, is broadcast to where its edges lie, so its
    edges never meet in one task. Null ends and self-loops are ignored; repeated edges
    collapse. An empty edge table gives an empty result.
    """
    now = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    now = ws.save(now, f"{label}-0")
    mark = _mark(now)
    for step in range(1, MAX_ROUNDS + 1):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_spread(both, _least(both, F.least("u", F.min("v"))), ["u"], "n", mark[0]).where("v > u")
        large = ws.save(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{label}-{step}-large")
        least = _least(large, F.min("v"))
        hooks = join_spread(large, least, ["u"], "n", mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = least.select("u", F.col("m").alias("v")).unionByName(hooks).distinct()
        nxt = ws.save(nxt, f"{label}-{step}")
        ws.drop(f"{label}-{step - 1}", f"{label}-{step}-large")
        now, before, mark = nxt, mark, _mark(nxt)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def _least(edges: DataFrame, least) -> DataFrame:
    """``u, m, n``: a label for each node from its neighbours, and its number of edges."""
    return edges.groupBy("u").agg(least.alias("m"), F.count(F.lit(1)).alias("n"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
