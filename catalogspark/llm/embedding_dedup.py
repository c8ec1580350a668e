"""Exact near-duplicate search in embeddings by PCA-ordered tiled comparison.

Unit vectors are turned to the principal axes of the whole table. Within a label they are ordered along the first axis
and cut into tiles of bounded size; a pair of tiles is compared only if the boxes of their leading coordinates are near
enough, which is asked first of blocks of tiles. In a pair of tiles the products of leading coordinates are summed block by block; ``sum + |rest a| |rest b|``
bounds each cosine, and a pair is given up as soon as the bound is under the threshold. What is left is decided by the
cosine of the vectors as given, in double precision.

A pair of tiles returns counts of links per vector and a spanning forest of its links, never the links themselves."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .graph import connected_components
from .tables import scratch, stored

TILE = 1024
#: Coordinates that are summed before the bound is looked at again.
BLOCK = 16
#: Leading coordinates in a tile's box.
BOX = 8
#: Tiles in a row (a power of two) whose boxes are compared as one, and tiles that one task compares with a tile at once.
BLOCK_TILES, PARTNERS = 256, 7
#: A class with more rows is joined back by broadcast; there are few, as each has so many rows.
HOT_ROWS = 100_000
_SLACK = 1e-9


def _moments(batches):
    """Sum and sum of products of the unit vectors of a partition, one row for each of its vector lengths."""
    total: dict[int, list] = {}
    for batch in batches:
        for x in _vectors(batch.column("embedding")):
            have = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))])
            u = _units(x)
            have[0] += len(u)
            have[1] += u.sum(0)
            have[2] += u.T @ u
    yield pa.record_batch(
        {
            "dim": pa.array(list(total), pa.int32()),
            "k": pa.array([v[0] for v in total.values()], pa.int64()),
            "v": pa.array([np.concatenate([v[1], v[2].ravel()]).tolist() for v in total.values()], pa.list_(pa.float64())),
        }
    )


def _vectors(column: pa.Array, kind: type = np.float64) -> list[np.ndarray]:
    """The vectors of a list column, a matrix for each length."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(kind)
    starts = column.offsets.to_numpy()[:-1]
    return [flat[starts[lengths == d][:, None] + np.arange(d)] for d in np.unique(lengths) if d]


def _tame(x: np.ndarray) -> np.ndarray:
    """``x`` with rows scaled by a power of two where their squares would leave the range of doubles."""
    most = np.abs(x).max(axis=1, keepdims=True)
    _, power = np.frexp(np.where((most > 1e-100) & (most < 1e100), 1.0, most))
    return np.ldexp(np.ldexp(x, -(power // 2)), -(power - power // 2)) if power.any() else x


def _units(x: np.ndarray) -> np.ndarray:
    x = _tame(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length an orthogonal matrix whose columns are the axes, the widest first. What reaches the driver is
    one matrix for each length, added up on the executors."""
    parts = vectors.select("embedding").mapInArrow(_moments, "dim int, k long, v array<double>")
    cells = parts.select("dim", "k", F.posexplode("v").alias("i", "x"))
    added = cells.groupBy("dim", "i").agg(F.sum("x").alias("x"), F.sum("k").alias("k")).toPandas()
    axes = {}
    for dim, rows in added.sort_values("i").groupby("dim"):
        x, k = rows["x"].to_numpy(), rows["k"].iloc[0]
        mean, square = x[:dim] / k, x[dim:].reshape(dim, dim) / k
        _, basis = np.linalg.eigh(square - np.outer(mean, mean))
        axes[int(dim)] = np.ascontiguousarray(basis[:, ::-1])
    return axes


def _placed(axes: dict[int, np.ndarray]):
    """Adds the coordinate along the first axis."""

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            lengths = np.diff(column.offsets.to_numpy())
            first = np.zeros(len(batch))
            for x in _vectors(column):
                d = x.shape[1]
                first[lengths == d] = _units(x) @ axes[d][:, 0]
            yield pa.record_batch({**{k: batch.column(k) for k in ("rep", "label", "n", "dim", "embedding")}, "first": first})

    return run


def _tiles(axes: dict[int, np.ndarray], size: int):
    """Numbers the rows of a sorted partition by tiles of at most ``size`` rows of one label and length."""

    def run(batches):
        tile, last, filled = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            names = []
            for key in zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True):
                if key != last or filled == size:
                    tile, last, filled = tile + 1, key, 0
                filled += 1
                names.append(tile)
            column = batch.column("embedding")
            lengths = np.diff(column.offsets.to_numpy())
            lead = np.zeros((len(batch), BOX))
            for x in _vectors(column):
                d = x.shape[1]
                lead[lengths == d, : min(BOX, d)] = _units(x) @ axes[d][:, :BOX]
            yield pa.record_batch(
                {
                    **{k: batch.column(k) for k in ("rep", "label", "n", "dim", "embedding")},
                    "tile": pa.array(names, pa.int64()),
                    "lead": pa.FixedSizeListArray.from_arrays(pa.array(lead.ravel()), BOX).cast(pa.list_(pa.float64())),
                }
            )

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    u, v = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            u.append(x)
            v.append(y)
    return u, v


def links_between(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``x`` and ``y`` with cosine >= threshold; of one tile with itself each pair once."""
    x, y = _tame(x), _tame(y)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    u, v = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    d = u.shape[1]
    rest = lambda m: np.sqrt(np.maximum(np.cumsum((m**2)[:, ::-1], 1)[:, ::-1], 0))
    ru, rv = np.pad(rest(u), ((0, 0), (0, 1))), np.pad(rest(v), ((0, 0), (0, 1)))
    done = min(BLOCK, d)
    total = u[:, :done] @ v[:, :done].T
    i, j = np.nonzero(total + ru[:, done, None] * rv[None, :, done] >= threshold - _SLACK)
    if same:
        i, j = i[i < j], j[i < j]
    total = total[i, j]
    while done < d and len(i):
        to = min(done + BLOCK, d)
        total = total + np.einsum("ij,ij->i", u[i, done:to], v[j, done:to])
        done = to
        stay = total + ru[i, done] * rv[j, done] >= threshold - _SLACK
        i, j, total = i[stay], j[stay], total[stay]
    exact = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j])
    return i[exact >= threshold], j[exact >= threshold]


def _compare(axes: dict[int, np.ndarray], threshold: float):
    """Of a tile ``a`` and some that it is compared with: links of each vector, and edges of a forest."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a = rows["a"].iloc[0]
        tiles = {b: own.sort_values("rep") for b, own in rows.groupby("tile")}
        vectors = {b: np.array(own["embedding"].tolist(), np.float64) for b, own in tiles.items()}
        left, out = tiles[a], []
        for b in rows.loc[rows["wanted"], "tile"].unique():
            right = tiles[b]
            i, j = links_between(vectors[a], vectors[b], axes[vectors[a].shape[1]], threshold, a == b)
            ids_x, ids_y = left["rep"].to_numpy(), right["rep"].to_numpy()
            out.append(pd.DataFrame({"u": ids_x, "n": np.bincount(i, right["n"].to_numpy()[j], len(ids_x))}))
            out.append(pd.DataFrame({"u": ids_y, "n": np.bincount(j, left["n"].to_numpy()[i], len(ids_y))}))
            u, v = _forest(ids_x[i], ids_y[j])
            out.append(pd.DataFrame({"u": u, "v": v, "n": 0.0}))
        found = pd.concat(out)
        if "v" not in found:
            found["v"] = None
        return found[(found["n"] > 0) | found["v"].notna()][["u", "v", "n"]].astype({"u": "int64", "v": "Int64", "n": "int64"})

    return run


def _near(size: int, threshold: float):
    """|a - b|^2 = 2 - 2 cos, from below by the gaps between the boxes lo..hi and blo..bhi."""
    gaps = [F.greatest(F.lit(0.0), F.col("lo")[k] - F.col("bhi")[k], F.col("blo")[k] - F.col("hi")[k]) for k in range(size)]
    return sum((g * g for g in gaps), F.lit(0.0)) <= 2 - 2 * threshold + _SLACK


def _near_tiles(box: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a <= b: tiles of one label whose boxes are near enough. Only blocks of tiles meet on their label; tiles
    meet on the pair of their blocks."""
    box = box.withColumn("block", F.shiftright("tile", BLOCK_TILES.bit_length() - 1))
    least = [F.min(F.col("lo")[k]) for k in range(BOX)]
    most = [F.max(F.col("hi")[k]) for k in range(BOX)]
    blocks = stored(box.groupBy("label", "dim", "block").agg(F.array(*least).alias("lo"), F.array(*most).alias("hi")), "blocks")
    renamed = lambda df, key, to: df.select("label", "dim", F.col(key).alias(to), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    met = blocks.join(renamed(blocks, "block", "other"), ["label", "dim"]).where((F.col("block") <= F.col("other")) & _near(BOX, threshold))
    met = stored(met.select("label", "dim", "block", "other"), "blockpairs")
    key = ["label", "dim", "block", "other"]
    right = box.select("label", "dim", F.col("block").alias("other"), F.col("tile").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    left = met.join(box.withColumnRenamed("tile", "a"), ["label", "dim", "block"])
    right = met.join(right, ["label", "dim", "other"])
    return left.join(right, key).where((F.col("a") <= F.col("b")) & _near(BOX, threshold)).select("a", "b")


def _linked(rows: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(label, embedding, h, n, links, component) of the vectors that have copies or links."""
    kind, label_kind = dict(rows.dtypes)["embedding"], dict(rows.dtypes)["label"]
    distinct = rows.groupBy("label", "embedding", "vec_id").agg(F.lit(1).alias("one"))
    classes = stored(distinct.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    classes = classes.withColumn("dim", F.size("embedding"))
    axes = principal_axes(classes)
    columns = f"rep long, label {label_kind}, n long, dim int, embedding {kind}"
    placed = classes.select("rep", "label", "n", "dim", "embedding").mapInArrow(_placed(axes), f"{columns}, first double")
    ordered = placed.repartitionByRange("label", "dim", "first", "rep").sortWithinPartitions("label", "dim", "first", "rep")
    tiled = stored(ordered.mapInArrow(_tiles(axes, tile), f"{columns}, tile long, lead array<double>"), "tiles")

    box = tiled.groupBy("label", "dim", "tile").agg(
        F.array(*[F.min(F.col("lead")[k]) for k in range(BOX)]).alias("lo"), F.array(*[F.max(F.col("lead")[k]) for k in range(BOX)]).alias("hi")
    )
    pairs = _near_tiles(stored(box, "boxes"), threshold)
    # a tile meets PARTNERS others in a task, so that it isn't sent along with each of them
    dealt = F.floor((F.row_number().over(Window.partitionBy("a").orderBy("b")) - 1) / PARTNERS)
    pairs = stored(pairs.withColumn("deal", dealt), "tilepairs")
    wanted = pairs.select("a", "deal", F.col("b").alias("tile"), F.lit(True).alias("wanted"))
    own = pairs.groupBy("a", "deal").agg(F.min("b").alias("b")).where("a <> b").select("a", "deal", F.col("a").alias("tile"), F.lit(False).alias("wanted"))
    side = wanted.unionByName(own).join(tiled.select("tile", "rep", "n", "embedding"), "tile")
    found = stored(side.groupBy("a", "deal").applyInPandas(_compare(axes, threshold), "u long, v long, n long"), "found")

    parts = connected_components(found.where("v is not null").select("u", "v"))
    links = found.where("v is null").groupBy("u").agg(F.sum("n").alias("links"))
    per_class = classes.select("label", "embedding", "rep", "n").join(links.withColumnRenamed("u", "rep"), "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.where("n > 1 or links is not null")  # of other classes the one row links with nothing
    per_class = per_class.select("label", "embedding", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    return stored(per_class.withColumn("h", F.xxhash64("embedding")), "linked")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors(vec_id, embedding, label, ...)``.

    Two rows link if their labels are equal and not null and the cosine of their vectors is at least ``threshold``.
    Null, empty and zero vectors, ones with null or non-finite components, vectors of different lengths and rows with a
    null vec_id link with nothing. Rows with the same vec_id, label and vector are one vector and come back as often as
    they came. An empty table gives no rows; further columns are ignored. Equal vectors of a label are compared once,
    as a class. The work is one comparison of boxes for each pair of blocks of a label, of tiles in near blocks, and a
    comparison of tiles for each pair that is near; no task holds more than PARTNERS + 1 tiles. Vectors are scaled where
    their squares leave the range of doubles."""
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>").alias("embedding"), "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce((F.col("vec_id").isNotNull()) & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = source.where(usable)
    with scratch() as kept:
        per_class = kept(_linked(rows, threshold, tile))
    hot, cold = per_class.where(F.col("n") > HOT_ROWS), per_class.where(F.col("n") <= HOT_ROWS)
    found_in = lambda left, right, how: left.alias("l").join(
        right.alias("r"), (F.col("l.label") == F.col("r.label")) & (F.col("l.h") == F.col("r.h")) & (F.col("l.embedding") == F.col("r.embedding")), how
    )
    able = rows.withColumn("h", F.xxhash64("embedding"))
    result = lambda df, vec_id, links, component: df.select(
        vec_id.alias("vec_id"),
        F.coalesce(links, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(component, vec_id).cast("long").alias("component_id"),
        (F.coalesce(component, vec_id) == vec_id).alias("kept"),
    )
    none = F.lit(None).cast("long")
    columns = (F.col("l.vec_id"), F.col("r.links"), F.col("r.component"))
    out = result(source.where(~usable), F.col("vec_id"), none, none)  # no vector, no class: these rows don't go to any join
    out = out.unionByName(result(found_in(able, F.broadcast(hot), "inner"), *columns))
    rest = found_in(able, F.broadcast(hot.select("label", "h", "embedding")), "left_anti")
    return out.unionByName(result(found_in(rest, cold, "left"), *columns))
