"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from catalogspark.llm import hnsw
from catalogspark.llm.nearest import build_index, nearest, search
from catalogspark.llm.queries import op12_nearest_neighbours

SF = "/root/testdata/sf0.01"


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def by_hand(rows: list[tuple], queries: list[tuple], k: int) -> dict:
    """(query_id, vector) -> [(vec_id, score)], nearest first; every pair is scored."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = {}
    for i, q in {(i, tuple(q)) for i, q in queries if (i, tuple(q or ())) in good}:
        near = sorted(((-dot(q, v), j) for j, v in good if j != i and len(v) == len(q)))[:k]
        out[i, q] = [(j, -s) for s, j in near]
    return out


def lists(df) -> dict:
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        assert r.rank == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


def test_graph_reaches_all_and_finds_most():
    rng = np.random.default_rng(0)
    tight = rng.normal(size=(5, 24)).repeat(80, axis=0) + 0.01 * rng.normal(size=(400, 24))
    x = np.concatenate([rng.normal(size=(1600, 24)), tight]).astype(np.float32)
    x = rng.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))
    graph = hnsw.build(x, hnsw.levels(len(x)))
    assert graph.reached() == 1 and [layer.shape[1] for layer in graph.layers[:2]] == [32, 16]
    ids, sims = graph.search(x[:300], 100)
    want = np.argsort(-(x[:300] @ x.T), axis=1)[:, :20]
    assert np.mean([len({*a[:20]} & {*b}) / 20 for a, b in zip(ids, want, strict=True)]) > 0.97
    assert (np.diff(sims, axis=1) <= 0).all() and all(len({*row}) == 100 for row in ids)


def test_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = {i: near for (i, _), near in by_hand(rows, [r for r in rows if r[0] % 20 == 0], 20).items()}
    got = lists(op12_nearest_neighbours(spark, SF))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    vectors = dict(rows)
    assert all(s == dot(vectors[i], vectors[j]) for i, near in got.items() for j, s in near)
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in near}) / 20 for i, near in want.items()]) > 0.98


def test_shards_bands_and_hot_vectors(spark):
    rng = np.random.default_rng(1)
    v = lambda x: [float(np.float32(c)) for c in x]
    base = rng.normal(size=(400, 8)) * np.exp2(rng.integers(-3, 4, size=(400, 1)))
    rows = [(k, v(x)) for k, x in enumerate(base)] + [(1000 + k, v(base[7])) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"dim": F.lit(1), "h": F.lit(1), "row": F.lit(1)}).repartition(5)
    queries = [r for r in rows if r[0] % 20 == 0]
    want = {i: near for (i, _), near in by_hand(rows, queries, 10).items()}
    got = lists(nearest(df, df.where("vec_id % 20 = 0"), k=10, shard=64))
    assert got == want  # with so many candidates kept every shard is looked through whole
    index = build_index(df, 11, shard=64)
    assert index.count() == 400 and index.select("dim", "band", "part").distinct().count() > 8 and index.where("size(ids) = 11").count() == 1
    assert lists(search(index, df.where("vec_id % 20 = 0"), 10)) == want


def test_odd_rows(spark):
    odd = [
        (0, [1.0, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (20, [3.0, 0.0]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [1.0, None]), (120, [float("nan"), 1.0]), (140, [float("inf"), 1.0]),
        (None, [1.0, 1.0]), (160, [1.0, 2.0, 3.0]), (1, [1e200, 1e200]), (2, [-1e200, 1e200]), (180, [1e200, 1e200]), (3, [1e-300, 0.0]), (4, [-0.0, 5e-324]),
    ]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id % 20 = 0"), k=3).collect()
    one = lambda i: sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
    assert one(0) == [(1, 1, 1e200), (2, 180, 1e200), (3, 20, 3.0)]
    assert len(one(20)) == 6  # two vectors, a list for each
    assert one(160) == [] and {r.query_id for r in got} == {0, 20, 180}
    assert one(180)[0] == (1, 1, float("inf")) and 180 not in {r.vec_id for r in got if r.query_id == 180}
    assert nearest(df.limit(0), df, k=3).count() == 0 and nearest(df, df.limit(0), k=3).count() == 0
    assert nearest(df.where("vec_id = 160"), df, k=3).count() == 0
