"""Whitening against a dense eigensolver, integers of Python's own, and cases of degenerate spectra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogspark.llm.queries import op11_whitening
from catalogspark.llm.whitening import inertia, leading, whiten

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("d", [1, 2, 3, 9, 40])
@pytest.mark.parametrize("kind", ["plain", "cluster", "multiple", "identity", "low rank", "zero"])
def test_leading(d, kind):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d))
    q = np.linalg.qr(a)[0]
    several = min(3, d)
    v = {
        "plain": a @ a.T,
        "cluster": q @ np.diag([5 + 1e-13 * k for k in range(several)] + [1.0] * (d - several)) @ q.T,
        "multiple": q @ np.diag([5.0] * several + [1.0] * (d - several)) @ q.T,
        "identity": np.eye(d) * 3,
        "low rank": a[:, :1] @ a[:, :1].T,
        "zero": np.zeros((d, d)),
    }[kind]
    v = (v + v.T) / 2
    want, k = np.linalg.eigvalsh(v)[::-1], min(4, d)
    for s in rng.uniform(-1, want[0] + 1, size=5):
        assert inertia(v - s * np.eye(d)) == ((want > s).sum(), (want < s).sum())
    e, x = leading(v, k)
    size = max(1.0, want[0])
    assert np.abs(e - want[:k]).max() < 1e-12 * size
    assert np.abs(x.T @ x - np.eye(k)).max() < 1e-12 and np.abs(v @ x - x * e).max() < 1e-12 * size


def by_hand(rows: list[tuple], k: int = 4) -> dict:
    """vec_id -> rows, by whole matrices and Python's integers; one vector length only."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    out = {}
    for i, x in good:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        w = np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)]) @ q / np.sqrt(e)
        out[i] = (n, dev, w, e / np.trace(v))
    return out


def agrees(got, rows):
    want = by_hand(rows)
    assert {r.vec_id for r in got} == set(want) and len(got) == sum(len(w[2]) for w in want.values())
    signs = {}
    for r in got:
        n, dev, w, explained = want[r.vec_id]
        c = r.component - 1
        assert (r.n, r.deviation) == (n, dev)
        if abs(w[c]) > 1e-6:
            signs.setdefault(c, np.sign(w[c] * r.whitened))
            assert r.whitened == pytest.approx(signs[c] * w[c], rel=1e-7, abs=1e-9)
        assert r.explained == pytest.approx(explained[c], rel=1e-9) and r.identity_error < 1e-9


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    agrees(op11_whitening(spark, SF).collect(), rows)


def test_cases(spark):
    rng = np.random.default_rng(0)
    base = [(k, [float(np.float32(x)) for x in rng.normal(size=6) * np.arange(1, 7)]) for k in range(60)]
    odd = [(100, None), (101, [None] * 6), (102, [float("nan")] * 6), (103, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, [])]
    rows = base + [(200 + k, base[0][1]) for k in range(40)]  # a vector that many share counts once
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "dim": F.lit(1), "n": F.lit(1)}).repartition(5)
    agrees(whiten(df).collect(), rows)
    assert whiten(df.limit(0)).count() == 0 and whiten(df.where("vec_id > 99 and vec_id < 105")).count() == 0


def test_lengths_repeats_and_no_variance(spark):
    rows = [(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [3.0, 2.0]), (2, [5.0]), (3, [1e300, 0.0, 0.0]), (4, [-1e300, 0.0, 0.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = lambda i, n: sorted((r for r in got if r.vec_id == i and r.n == n), key=lambda r: (r.component, r.whitened or 0))
    assert len(got) == 3 * 2 + 1 + 2 * 3
    assert [r.deviation for r in by(None, 2)] == [512**2] * 2
    assert sorted(abs(r.whitened) for r in by(1, 2) if r.component == 1) == pytest.approx([1, 1]) and all(r.whitened is None for r in by(1, 2) if r.component == 2)
    (single,) = by(2, 1)
    assert (single.deviation, single.whitened, single.explained, single.identity_error) == (0, None, None, None)
    assert by(3, 2)[0].deviation is None and abs(by(3, 2)[0].whitened) == pytest.approx(1)


def test_large_sums(spark):
    """n x - S beyond 64 bits still adds up exactly where the result fits."""
    rows = [(k, [float(k % 2) * 2.0**40, float(k)]) for k in range(6)]
    got = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    n, xs = 6, [[int(256 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    want = {k: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for k, x in enumerate(xs)}
    assert got == {k: w if w < 1 << 63 else None for k, w in want.items()}
