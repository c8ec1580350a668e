"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard, shard results merged.

Vectors of like length (within a factor of two) share shards, and within a shard one more coordinate makes all of them
equally long, so that the largest product is the nearest neighbour. Equal vectors are one row of a graph with the smallest
of their ids. Every query looks through every shard of its number of entries: queries come in blocks, and a task holds one
shard and one block. What a shard finds is scored again in double precision on the vectors as given."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import hnsw
from .tables import scratch, stored

#: Vectors of a shard on average, queries of a block, and numbers of a batch of queries within a task.
SHARD, BLOCK, AT_ONCE = 8192, 16_384, 1 << 16
#: Candidates kept while a query goes through a shard, at least.
WIDTH = 160

_SHARD_KEY = ["dim", "band", "part"]


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim, h), each once."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)).dropDuplicates(["vec_id", "embedding"])
    return good.withColumns({"dim": F.size("embedding"), "h": F.xxhash64("embedding")})


def _band():
    """The length's power of two, rounded. Squares are taken of entries over the largest, so none leaves the doubles."""
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x.cast("double") / F.col("most")) * (x.cast("double") / F.col("most")))
    return most, F.floor(F.log2("most") + F.log2(square) / 2 + 0.5).cast("int")


def _even(x: np.ndarray) -> np.ndarray:
    """Rows with one more coordinate that makes them equally long, as single-precision vectors of length up to one."""
    x = x / np.abs(x).max()
    square = np.einsum("ij,ij->i", x, x)
    return (np.column_stack([x, np.sqrt(np.maximum(square.max() - square, 0))]) / np.sqrt(square.max())).astype(np.float32)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("h", kind="stable", ignore_index=True)
    level = hnsw.levels(len(rows))
    graph = hnsw.build(_even(_matrix(rows["embedding"])), level)
    own = lambda k: np.concatenate([layer[k] for layer in graph.layers[: level[k] + 1]]).astype(np.int32)
    return rows.assign(row=np.arange(len(rows)), level=level, links=[own(k) for k in range(len(rows))])[[*_SHARD_KEY, "row", "level", "ids", "embedding", "links"]]


def build_index(vectors: DataFrame, ids: int, shard: int = SHARD) -> DataFrame:
    """A stored table of all distinct vectors: (dim, band, part) names a shard, ``row`` the vector's place in its graph,
    ``level`` its highest layer, ``links`` the neighbours' places, layer by layer in fixed widths (-1 is none), and ``ids``
    its smallest ``ids`` vec_ids in order. Null, empty and zero vectors, vectors with null or non-finite entries and rows
    with a null vec_id take no part."""
    kind = dict(_usable(vectors).dtypes)["embedding"]
    own = Window.partitionBy("h", "embedding")
    smallest = _usable(vectors).withColumn("k", F.row_number().over(own.orderBy("vec_id"))).where(F.col("k") <= ids)
    most, band = _band()
    with scratch() as keep:
        classes = smallest.groupBy("h", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("dim").alias("dim"))
        classes = stored(classes.withColumn("most", most).withColumn("band", band).drop("most"), "vectors")
        # at most 2,200 bands for each number of entries
        sizes = classes.groupBy("dim", "band").agg(F.ceil(F.count("*") / shard).alias("parts"))
        dealt = classes.join(F.broadcast(sizes), ["dim", "band"]).withColumn("part", F.pmod("h", "parts").cast("int"))
        columns = f"dim int, band int, part int, row int, level int, ids array<long>, embedding {kind}, links array<int>"
        return keep(stored(dealt.select(*_SHARD_KEY, "h", "ids", "embedding").groupBy(*_SHARD_KEY).applyInPandas(_build, columns), "index", "zstd"))


def _graph(rows: pd.DataFrame) -> tuple[hnsw.Graph, np.ndarray]:
    x = _matrix(rows["embedding"])
    level, layers, at = rows["level"].to_numpy(), [], 0
    for layer in range(int(level[0]) + 1):
        width = hnsw.LINKS if layer else 2 * hnsw.LINKS
        layers.append(np.stack([links[at : at + width] for links in rows["links"][: int((level >= layer).sum())]]).astype(np.int64))
        at += width
    return hnsw.Graph(_even(x), layers), x


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``q`` with those of ``x[row]``, added up entry by entry in double precision."""
    total = q[:, None, 0] * x[:, :, 0]
    for k in range(1, q.shape[1]):
        total += q[:, None, k] * x[:, :, k]
    return total


def _search(k: int, width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows[rows["row"].isna()].sort_values(["query_id", "q"], ignore_index=True)
        index = rows[rows["row"].notna()].sort_values("row", ignore_index=True)
        out = []
        if len(asked) and len(index):
            graph, x = _graph(index)
            first, ids = index["ids"].map(lambda v: v[0]).to_numpy(), index["ids"]
            step = max(16, AT_ONCE // x.shape[1])
            for some in (asked[a : a + step] for a in range(0, len(asked), step)):
                q = _matrix(some["embedding"])
                lead = q / np.abs(q).max(axis=1, keepdims=True)
                lead = np.pad(lead / np.linalg.norm(lead, axis=1, keepdims=True), ((0, 0), (0, 1))).astype(np.float32)
                found, _ = graph.search(lead, max(width, k + 1))
                with np.errstate(over="ignore", invalid="ignore"):
                    score = products(q, x[np.maximum(found, 0)])
                order = np.lexsort((first[np.maximum(found, 0)], -np.nan_to_num(score, nan=-np.inf), found < 0), axis=1)[:, : k + 1]
                best, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
                a, b = np.nonzero(best >= 0)
                at = best[a, b]
                out.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[a], "q": some["q"].to_numpy()[a], "score": score[a, b], "ids": [ids[r] for r in at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "q": [], "score": [], "ids": []}).astype({"query_id": "int64", "q": "int64", "ids": "object"})

    return run


def search(index: DataFrame, queries: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries(vec_id, embedding, ...)`` the ``k`` nearest found in
    ``index``, by largest inner product, equal ones by smaller vec_id, without the query's own id.

    The index must hold ``k + 1`` ids of a vector. Queries that could not be in the index get no rows; a row of queries that
    repeats is asked once, and a vec_id with several vectors once with each. Products beyond the doubles are infinite;
    those that aren't numbers come last (and are null)."""
    asked = _usable(queries)
    with scratch() as keep:
        asked = stored(asked.select("dim", F.col("vec_id").alias("query_id"), F.col("h").alias("q"), "embedding"), "queries")
        # a row for each number of entries, and for each band
        blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        layout = index.groupBy("dim", "band").agg(F.max("part").alias("last"))
        left = asked.join(F.broadcast(blocks), "dim").withColumn("block", F.pmod("q", "blocks").cast("int")).join(F.broadcast(layout), "dim")
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("blocks", "last")
        right = index.join(F.broadcast(blocks), "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        both = right.unionByName(left, allowMissingColumns=True)
        found = both.groupBy(*_SHARD_KEY, "block").applyInPandas(_search(k, width), "query_id long, q long, score double, ids array<long>")
        each = found.select("query_id", "q", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        order = Window.partitionBy("query_id", "q").orderBy(F.nanvl("score", F.lit(float("-inf"))).desc(), "vec_id")
        ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return keep(stored(ranked.select("query_id", "rank", "vec_id", F.when(~F.isnan("score"), F.col("score")).alias("score")), "nearest"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """``search`` of ``queries`` in an index of ``vectors``. Empty tables give no rows; further columns are ignored."""
    with scratch() as keep:
        return keep(search(build_index(vectors, k + 1, shard), queries, k, width))
