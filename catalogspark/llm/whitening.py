"""Whitening of embeddings along the leading components of their covariance, by spectrum slicing.

The inertia of an LDLᵀ factorisation of ``V - s I`` counts the eigenvalues above ``s``. Bisection by these counts shuts
each leading eigenvalue into an interval of its own, Rayleigh quotient iteration from there converges cubically, and
counts on both sides of the value found certify its number. Eigenvalues that no interval tells apart get vectors that
are orthogonal to each other.

Executors add up integer sums and a centred product matrix of the distinct vectors; the driver gets one matrix for each
vector length and fits on that."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .embedding_dedup import _vectors
from .tables import scratch, stored

SCALE = 256
_EPS = np.finfo(np.float64).eps
#: (1 + sqrt 17) / 8 keeps the growth of the factors least.
_ALPHA = 0.6403882032022076


def inertia(a: np.ndarray) -> tuple[int, int]:
    """(positive, negative) eigenvalues of a symmetric matrix: the signs of D in LDLᵀ with symmetric pivoting by blocks of
    one or two."""
    a, n, k = a.copy(), len(a), 0
    nothing = _EPS**3 * np.abs(a).max(initial=0)  # what rounding leaves of zero
    positive = negative = 0
    while k < n:
        below = np.abs(a[k + 1 :, k])
        r = k + 1 + int(below.argmax()) if k + 1 < n else k
        most = below.max() if k + 1 < n else 0.0
        pivot, two = k, False
        if max(abs(a[k, k]), most) <= nothing:
            k += 1
            continue
        if abs(a[k, k]) < _ALPHA * most:
            others = np.abs(a[r, k:]).copy()
            others[r - k] = 0
            row = others.max()
            if abs(a[k, k]) * row >= _ALPHA * most**2:
                pass
            elif abs(a[r, r]) >= _ALPHA * row:
                pivot = r
            else:
                pivot, two = r, True
        to = k + two
        if pivot != to:
            a[[to, pivot], k:] = a[[pivot, to], k:]
            a[k:, [to, pivot]] = a[k:, [pivot, to]]
        if two:
            (p, q), (_, t) = a[k : k + 2, k : k + 2]
            rest = a[k + 2 :, k : k + 2]
            positive, negative = positive + 1, negative + 1  # such a block is indefinite
            inverse = np.array([[t / q, -1.0], [-1.0, p / q]]) / (q * (p / q * (t / q) - 1))
            update = rest @ inverse @ rest.T
            a[k + 2 :, k + 2 :] -= (update + update.T) / 2
            k += 2
        else:
            d = a[k, k]
            positive, negative = positive + (d > 0), negative + (d < 0)
            col = a[k + 1 :, k] / np.sqrt(abs(d))
            a[k + 1 :, k + 1 :] -= np.sign(d) * np.outer(col, col)
            k += 1
    return int(positive), int(negative)


def _above(v: np.ndarray, s: float) -> int:
    return inertia(v - s * np.eye(len(v)))[0]


def _not_below(v: np.ndarray, s: float) -> int:
    return len(v) - inertia(v - s * np.eye(len(v)))[1]


def _iterate(v: np.ndarray, lo: float, hi: float, known: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray] | None:
    """An eigenpair in lo..hi orthogonal to ``known``, or None if the iteration went elsewhere. ``v`` has norm 1."""
    clean = lambda x: x - known @ (known.T @ x)
    x = clean(start)
    shift, eye, best = (lo + hi) / 2, np.eye(len(v)), None
    for step in range(60):
        try:
            y = np.linalg.solve(v - shift * eye, x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(v - (shift + 4 * _EPS) * eye, x)
        y = y / np.abs(y).max()  # its norm may leave the range of doubles
        x = clean(y / np.linalg.norm(y))
        x /= np.linalg.norm(x)
        value = float(x @ v @ x)
        left = float(np.linalg.norm(v @ x - value * x))
        if best and left >= best[0] / 2 and best[0] <= 8 * len(v) * _EPS:  # no step gains any more
            return best[1:] if lo <= best[1] <= hi else None
        if not best or left < best[0]:
            best = left, value, x
        shift = value if step >= 1 and lo <= value <= hi else shift
    return None


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    Raises ArithmeticError where the counts don't certify the numbering."""
    d = len(v)
    scale = float(np.abs(v).sum(axis=1).max())
    if scale == 0:
        return np.zeros(k), np.eye(d)[:, :k]
    v = v / scale
    slack = 16 * d * _EPS
    known, values = np.zeros((d, 0)), []
    rng = np.random.default_rng(0)
    for number in range(1, k + 1):
        lo, hi = -1 - slack, 1 + slack  # above lo: at least number; above hi: fewer
        certified = lambda x: _above(v, x + slack) < number <= _not_below(v, x - slack)  # noqa: B023, E731
        while True:
            cluster = hi - lo <= slack  # of which any vector will do, orthogonal to those before
            found = None
            if cluster or (_above(v, hi) == number - 1 and _above(v, lo) == number):
                found = _iterate(v, lo - slack * cluster, hi + slack * cluster, known, rng.normal(size=d))
            if found and certified(found[0]):
                value, x = found
                break
            if hi - lo <= slack / 4:
                raise ArithmeticError(f"eigenvalue {number} can't be told from those beside it")
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _above(v, mid) >= number else (lo, mid)
        values.append(value)
        known = np.column_stack([known, x])
    return scale * np.array(values), known


def _integers(x: np.ndarray) -> np.ndarray:
    """floor(256 c), held within 64 bits."""
    with np.errstate(over="ignore"):
        y = np.floor(SCALE * x)
    big = float(1 << 63)
    out = np.where(np.abs(y) < big, y, 0).astype(np.int64)
    out[y >= big] = np.iinfo(np.int64).max
    out[y <= -big] = np.iinfo(np.int64).min
    return out


def _with_integers(batches):
    for batch in batches:
        column = batch.column("embedding")
        lengths = np.diff(column.offsets.to_numpy())
        flat = _integers(column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].astype(np.float64))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        yield pa.record_batch({"x": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})


def _cells(total: dict[int, tuple[int, list[np.ndarray]]], kind: pa.DataType) -> pa.RecordBatch:
    """(dim, rows, i, v): what a partition has added up, a row for each row i of a matrix."""
    rows = [(d, n, i, line) for d, (n, m) in total.items() for i, line in enumerate(m)]
    return pa.record_batch(
        {
            "dim": pa.array([r[0] for r in rows], pa.int32()),
            "rows": pa.array([r[1] for r in rows], pa.int64()),
            "i": pa.array([r[2] for r in rows], pa.int32()),
            "v": pa.array([r[3].tolist() for r in rows], pa.list_(kind)),
        }
    )


def _sums(batches):
    """Upper and lower halves of the integers, so that no sum leaves 64 bits."""
    total = {}
    for batch in batches:
        for x in _vectors(batch.column("x"), np.int64):
            n, m = total.get(x.shape[1], (0, np.zeros((2, x.shape[1]), np.int64)))
            total[x.shape[1]] = n + len(x), m + np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
    yield _cells(total, pa.int64())


@dataclass
class Fit:
    """Of the distinct vectors of one length: how many, sums, and the leading components (columns) with eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray | None = None
    axes: np.ndarray | None = None
    trace: float = 0.0

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: 64 bits where they hold it, Python's integers else."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        if self.n * most + max(map(abs, self.sums), default=0) < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sums of squares of the rows of n x - S; None where that is no 64-bit integer."""
        most = max((abs(int(v)) for v in (y.max(initial=0), y.min(initial=0))), default=0)
        squares = (y * y if y.dtype != object and y.shape[1] * most**2 < 1 << 63 else y.astype(object) ** 2).sum(axis=1)
        return [int(s) if int(s) < 1 << 63 else None for s in squares]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Rows of n x - S on the components; null (nan) along a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (y.astype(np.float64) / self.n) @ self.axes / np.sqrt(np.maximum(self.values, 0))
        out[:, self.values <= 0] = np.nan
        return out


def _products(fits):
    """Products of the centred vectors of a partition."""

    def run(batches):
        total = {}
        for batch in batches:
            for x in _vectors(batch.column("x"), np.int64):
                fit = fits[x.shape[1]]
                c = fit.times_n(x).astype(np.float64) / fit.n
                n, m = total.get(x.shape[1], (0, 0))
                total[x.shape[1]] = n + len(x), m + c.T @ c
        yield _cells(total, pa.float64())

    return run


def _projected(fits, k: int):
    """The whitened vectors of the fit list."""

    def run(batches):
        for batch in batches:
            for x in _vectors(batch.column("x"), np.int64):
                fit = fits[x.shape[1]]
                w = np.zeros((len(x), k))
                w[:, : len(fit.values)] = np.nan_to_num(fit.whitened(fit.times_n(x)))
                yield pa.record_batch({"dim": pa.array(np.full(len(x), x.shape[1]), pa.int32()), **{f"w{c}": pa.array(w[:, c]) for c in range(k)}})

    return run


def _rows(fits, errors: dict[int, float]):
    """A row for each vector and component."""

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            lengths = np.diff(column.offsets.to_numpy())
            for d, c in zip(np.unique(lengths[lengths > 0]), _vectors(column), strict=True):
                ids = batch.column("vec_id").take(pa.array(np.flatnonzero(lengths == d)))
                fit = fits[int(d)]
                y = fit.times_n(_integers(c))
                w, k, rows = fit.whitened(y), len(fit.values), len(c)
                again = np.repeat(np.arange(rows), k)
                explained = np.tile(fit.values / fit.trace if fit.trace > 0 else np.full(k, np.nan), rows)
                yield pa.record_batch(
                    {
                        "vec_id": ids.take(pa.array(again)),
                        "component": pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                        "n": pa.array(np.full(rows * k, fit.n), pa.int64()),
                        "deviation": pa.array(fit.deviations(y), pa.int64()).take(pa.array(again)),
                        "whitened": pa.array(w.ravel(), from_pandas=True),
                        "explained": pa.array(explained, from_pandas=True),
                        "identity_error": pa.array(np.full(rows * k, errors[int(d)]), from_pandas=True),
                    }
                )

    return run


def _added(parts: DataFrame, kind: type) -> dict[int, tuple[int, list[list]]]:
    """Per vector length (rows, lines of the matrix summed over the partitions)."""
    cells = parts.select("dim", "rows", "i", F.posexplode("v").alias("j", "x"))
    added = cells.groupBy("dim", "i", "j").agg(F.sum("x").alias("x"), F.sum("rows").alias("rows"))
    out = {}
    for r in added.orderBy("dim", "i", "j").toLocalIterator():
        n, lines = out.setdefault(r.dim, (r.rows, []))
        if r.i == len(lines):
            lines.append([])
        lines[r.i].append(kind(r.x))
    return out


def fit_whitening(distinct: DataFrame, components: int) -> tuple[dict[int, Fit], dict[int, float]]:
    """Of a stored table of distinct integer vectors ``x``: a fit for each vector length, and the largest entry of the
    whitened vectors' covariance minus the identity (nan where a component has no variance)."""
    halves = _added(distinct.mapInArrow(_sums, "dim int, rows long, i int, v array<long>"), int)
    fits = {d: Fit(n, [(hi << 32) + lo for hi, lo in zip(*lines, strict=True)]) for d, (n, lines) in halves.items()}
    for d, (n, lines) in _added(distinct.mapInArrow(_products(fits), "dim int, rows long, i int, v array<double>"), float).items():
        v = np.array(lines) / n
        v = (v + v.T) / 2
        fits[d].trace = float(np.trace(v))
        values, fits[d].axes = leading(v, min(components, d))
        fits[d].values = np.where(values > 16 * d * _EPS * np.abs(v).sum(axis=1).max(), values, 0)  # else rounding
    names = [f"w{c}" for c in range(components)]
    w = distinct.mapInArrow(_projected(fits, components), "dim int, " + ", ".join(f"{c} double" for c in names))
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = w.groupBy("dim").agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs])
    errors = {}
    for r in found.collect():
        k = len(fits[r.dim].values)
        off = [abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < k]
        errors[r.dim] = max(off) if (fits[r.dim].values > 0).all() else float("nan")
    return fits, errors


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row of ``vectors(vec_id, embedding,
    ...)`` and component 1 to ``components``, fewer for vectors with fewer entries.

    Null vectors and vectors with null or non-finite entries give no rows, nor do vectors without entries. Each entry c
    becomes the integer ``x = floor(256 c)``, held within 64 bits. The fit list is each distinct x once: ``n`` vectors with
    sums S; vectors of each length have a fit of their own. ``deviation`` is the sum of (n x - S)^2, null if that is no
    64-bit integer; ``whitened`` is null along components without variance, ``explained`` where nothing varies, and
    ``identity_error`` then too. Rows with a null or repeated vec_id are rows of their own; an empty table gives no rows;
    further columns are ignored."""
    kind = dict(vectors.dtypes)["vec_id"]
    entries = F.col("embedding").cast("array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select("vec_id", entries.alias("embedding")).where(F.coalesce(finite, F.lit(False)))
    with scratch():
        distinct = stored(rows.select("embedding").mapInArrow(_with_integers, "x array<long>").distinct(), "distinct", "zstd")
        fits, errors = fit_whitening(distinct, components)
    columns = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(_rows(fits, errors), columns)
