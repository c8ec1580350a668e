"""Connected components of an undirected edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .tables import drop_stored, stored


def _contract(batches):
    """Replace the edges of one batch by edges to the smallest node that they connect; memory follows the batch."""
    for edges in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for u, v in zip(edges["u"].tolist(), edges["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        yield pd.DataFrame({"u": pd.Series(nodes, dtype="int64"), "v": pd.Series([root(x) for x in nodes], dtype="int64")})


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round; ``edges`` hold u > v. Minima come from a pre-aggregated table, so that a hub's edges are only streamed
    past its minimum: a join that adaptive execution splits where a hub is larger than a task should be."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges(u, v)``; component: the smallest node reachable. Loops, repeated and
    reversed edges do no harm; no edges give no rows. A graph of diameter d needs about log d rounds, each of which is
    written to the shared folder, so a lost executor costs one round at most."""
    clean = edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    now = stored(clean.mapInPandas(_contract, "u long, v long").distinct(), "cc")
    sign = None
    for _ in range(max_rounds):
        new = stored(_star(_star(now, True), False), "cc")
        drop_stored(now)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == sign:
            break
        sign = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
