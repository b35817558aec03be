"""Embedding whitening by a bidiagonal qd solver.

Entries become whole numbers (``floor(scale * entry)``), so sums and deviations are exact. The fit list holds every
different vector once. Its centred rows are reduced to one triangle R by QR, block by block in the
tasks and then over the tasks' triangles, some dozens at a time. Householder reflections from both sides turn R into a
bidiagonal B = U' R V; dqds (the differential quotient-difference algorithm with shifts) finds the squared singular
values of B to high relative accuracy, and a twisted factorisation of B'B - e gives each wanted
eigenvector, which V turns into a direction. R is the only thing the driver sees: one row and column per dimension.

A second pass over the fit list measures the covariance of the whitened values against the identity.

Defined results: vectors that are null or hold null or non-finite entries are left out, a null id is an id like any
other; repeated vectors are fitted once and every row is returned; vectors of another length are a table of their
own; a component without variance (below rounding) has no rows, so empty vectors and tables have none; a deviation
beyond a long is null; extra columns are ignored.
"""

from __future__ import annotations

import decimal
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, out_batch, releasing, ship

_EPS = float(np.finfo(np.float64).eps)
_FAN = 32                      # triangles that one task reduces to one
_ROWS = 4096                   # vectors of a block


# ------------------------------------------------------------------ singular values and vectors of one triangle
def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B = U' R V (signs made positive) and V, by Householder reflections."""
    a = r.astype(np.float64).copy()
    n = a.shape[1]
    v = np.eye(n)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        tail = np.abs(x[1:]).max(initial=0.0)
        if tail == 0:
            return None
        x = x / max(tail, abs(x[0]))
        w = x.copy()
        w[0] += math.copysign(np.linalg.norm(x), x[0])
        return w / np.linalg.norm(w)

    for k in range(n):
        if (w := mirror(a[k:, k])) is not None:
            a[k:, k:] -= 2.0 * np.outer(w, w @ a[k:, k:])
        if k + 2 < n and (w := mirror(a[k, k + 1:])) is not None:
            a[k:, k + 1:] -= 2.0 * np.outer(a[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= 2.0 * np.outer(v[:, k + 1:] @ w, w)
    d, e = np.diag(a).copy(), np.diag(a, 1).copy()
    # signs: scale the rows and columns of B by +-1 so that both diagonals are not negative
    column = np.ones(n)
    for k in range(n):
        row = -1.0 if d[k] * column[k] < 0 else 1.0
        if k + 1 < n:
            column[k + 1] = -1.0 if e[k] * row < 0 else 1.0
    return np.abs(d), np.abs(e), v * column


def dqds(d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal (d, e), falling."""
    found: list[float] = []
    top = max(np.abs(d).max(initial=0.0), np.abs(e).max(initial=0.0))
    if top == 0:
        return np.zeros(len(d))
    work = [(list((d / top) ** 2), list((e / top) ** 2), 0.0)]
    while work:
        q, f, shift = work.pop()
        tries = 0
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + shift)
                break
            small = _EPS * _EPS * (shift + max(q[-1], 0.0)) + 1e-300
            if f[-1] <= small or f[-1] <= _EPS * _EPS * q[-2]:
                found.append(q.pop() + shift)
                f.pop()
                continue
            cut = next((i for i in range(n - 2, -1, -1) if f[i] <= _EPS * _EPS * (shift + q[i]) + 1e-300), None)
            if cut is not None:                        # two blocks
                work.append((q[:cut + 1], f[:cut], shift))
                q, f = q[cut + 1:], f[cut + 1:]
                continue
            # without a shift the d of the transform bound the least value: 1 / sum(1 / d) <= it <= min(d)
            plain = _transform(q, f, 0.0)
            least = min(plain[2])
            safe = 0.0 if least <= 0 else 1.0 / sum(1.0 / x for x in plain[2])
            step = None
            if safe > _EPS * shift:
                step = _transform(q, f, safe * (1 - 8 * _EPS * n))
                if step is not None and min(step[2]) < 0:
                    step = None
            if step is None:
                q, f, _ = plain
            else:
                q, f, _ = step
                shift += safe * (1 - 8 * _EPS * n)
            tries += 1
            if tries > 200 * (n + 10):
                raise ArithmeticError("dqds does not converge")
    return np.sort(np.maximum(found, 0.0))[::-1] * top * top


def _transform(q: list[float], f: list[float], tau: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd step with shift ``tau``: new q and f, and the d's."""
    d = q[0] - tau
    ds, nq, nf = [d], [], []
    for i in range(len(q) - 1):
        s = d + f[i]
        nq.append(s)
        t = q[i + 1] / s if s else 0.0
        nf.append(f[i] * t)
        d = d * t - tau
        ds.append(d)
    nq.append(d)
    return nq, nf, ds


def _twisted(d: np.ndarray, e: np.ndarray, value: float) -> list[tuple[float, np.ndarray]]:
    """Vectors z with N D N' z = gamma * (unit vector r), for every twist r, by growing |gamma|; B'B - value = N D N'."""
    n = len(d)
    tiny = 1e-150
    big, low = d * d, np.divide(e, d[:-1], out=np.zeros(n - 1), where=d[:-1] != 0)
    if (d[:-1] == 0).any():            # no L D L' with this D: move it a little, far below rounding
        big = np.where(big == 0, (_EPS * big.max()) ** 2, big)
        low = e / np.sqrt(big[:-1])
    plus, minus, s, p = np.zeros(n - 1), np.zeros(n - 1), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        x = s[i] + big[i] or tiny
        plus[i] = low[i] * big[i] / x
        s[i + 1] = plus[i] * low[i] * s[i] - value
    p[-1] = big[-1] - value
    ratio = np.zeros(n - 1)
    for i in range(n - 2, -1, -1):
        x = p[i + 1] + big[i] * low[i] ** 2 or tiny
        ratio[i] = big[i] / x
        minus[i] = low[i] * ratio[i]
        p[i] = p[i + 1] * ratio[i] - value
    gamma = s + big
    gamma[:-1] = s[:-1] + ratio * p[1:]
    out = []
    for r in np.argsort(np.abs(gamma), kind="stable")[:n].tolist():
        z = np.zeros(n)
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -plus[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -minus[i] * z[i]
        norm = np.linalg.norm(z)
        if np.isfinite(norm):
            out.append((abs(gamma[r]) / norm, z / norm))
    return out


def directions(d: np.ndarray, e: np.ndarray, values: np.ndarray, wanted: int) -> np.ndarray:
    """Orthonormal eigenvectors (columns) of B'B for the ``wanted`` largest of ``values``."""
    n = len(d)
    out = np.zeros((n, 0))
    for k in range(wanted):
        near = [j for j in range(k) if values[j] - values[k] <= 1e-3 * values[k]]
        best, kept = None, 0.0
        choices = _twisted(d, e, values[k]) if n > 1 else [(0.0, np.ones(1))]
        for residual, z in choices:
            if best is not None and residual > 1e3 * choices[0][0] + 1e-12 * values[0]:
                break                              # not an eigenvector any more
            for _ in range(2):                     # values this close share a plane: stand upright on the ones before
                z = z - out[:, near] @ (out[:, near].T @ z)
            norm = np.linalg.norm(z)
            if norm > kept:
                best, kept = z / norm, norm
            if kept > 0.5:
                break
        out = np.column_stack([out, best])
    return out


def principal(r: np.ndarray, n: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Directions (columns), variances and the trace of the covariance R'R / n; fewer where the rank is less."""
    d, e, v = bidiagonal(r)
    values = dqds(d, e)
    trace = float((r * r).sum())
    rank = int((values > len(d) * _EPS * _EPS * values[0] * len(d)).sum()) if trace > 0 else 0
    wanted = min(wanted, rank)
    z = directions(d, e, values, wanted)
    return v @ z, values[:wanted] / n, trace / n


# ------------------------------------------------------------------ the job
def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray | list]:
    """``n * x - S`` in double precision, and the exact sums of its squares."""
    top = n * max(int(np.abs(x.astype(np.float64)).max(initial=0.0)) + 1, 1) + max(map(abs, sums), default=0)
    if top * top * max(1, x.shape[1]) < 2 ** 62:
        y = n * x - np.array(sums, np.int64)
        return y.astype(np.float64), (y * y).sum(axis=1)
    y = x.astype(object) * n - np.array(sums, object)
    exact = [int(v) for v in (y * y).sum(axis=1)]
    return y.astype(np.float64), [v if v < 2 ** 63 else None for v in exact]


def _sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For every length: how many vectors, and their exact sums per dimension. Tasks add their own up first."""
    def run(batches):
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = pa.compute.list_value_length(b.column(0)).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _matrix(b.column(0).take(pa.array(at)), dim)
                small = np.abs(x.astype(np.float64)).max(initial=0.0) * len(x) < 2 ** 62
                total = (x if small else x.astype(object)).sum(axis=0).astype(object)
                counts[dim] = counts.get(dim, 0) + len(x)
                sums[dim] = sums.get(dim, np.zeros(dim, object)) + total
        rows = [(dim, i, decimal.Decimal(int(s)), counts[dim]) for dim in sums for i, s in enumerate(sums[dim])]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()))],
                names=["dim", "at", "s", "n"])

    parts = vectors.mapInArrow(run, "dim int, at int, s decimal(38,0), n long")
    got = parts.groupBy("dim", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("dim", "at").collect()
    return {dim: (next(r["n"] for r in got if r["dim"] == dim), [int(r["s"]) for r in got if r["dim"] == dim])
            for dim in dict.fromkeys(r["dim"] for r in got)}


def _triangles(vectors: DataFrame, dim: int, n: int, sums: list[int]) -> DataFrame:
    """One triangle (dim x dim, as bytes) per task: QR of the centred vectors, block on block."""
    def run(batches):
        r = np.zeros((0, dim))
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                y, _ = deviations(_matrix(b.column(0).slice(lo, _ROWS), dim), n, sums)
                r = np.linalg.qr(np.concatenate([r, y / n]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    return vectors.mapInArrow(run, "r binary")


def _reduced(triangles: DataFrame, dim: int) -> np.ndarray:
    """The triangle of all triangles, ``_FAN`` of them at a time until few are left."""
    def stack(parts) -> np.ndarray:
        return np.linalg.qr(np.concatenate([np.frombuffer(p, np.float64).reshape(-1, dim) for p in parts]), mode="r")

    def run(batches):
        r = np.zeros((0, dim))
        for b in batches:
            for p in b.column(0).to_pylist():
                r = stack([r.tobytes(), p])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    triangles = checkpoint(triangles)
    count = triangles.count()
    while count > _FAN:
        triangles = checkpoint(triangles.repartition(-(-count // _FAN)).mapInArrow(run, "r binary"))
        count = triangles.count()
    r = stack([row["r"] for row in triangles.collect()])             # at most ``_FAN`` triangles
    return np.concatenate([r, np.zeros((dim - len(r), dim))])


def _covariances(vectors: DataFrame, dim: int, n: int, sums: list[int], onto: np.ndarray) -> np.ndarray:
    """Covariance (divisor n, centred) of the vectors' whitened values."""
    k = onto.shape[1]
    schema = T.StructType([T.StructField(f"w{i}", T.DoubleType()) for i in range(k)])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                y, _ = deviations(_matrix(b.column(0).slice(lo, _ROWS), dim), n, sums)
                yield pa.RecordBatch.from_arrays([pa.array(w) for w in (y / n @ onto).T], names=schema.names)

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = vectors.mapInArrow(run, schema).agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    out = np.zeros((k, k))
    for (i, j), c in zip(pairs, got):
        out[i, j] = out[j, i] = c
    return out


def whiten(vectors: DataFrame, components: int = 4, scale: float = 256.0, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """One row per usable row of ``vectors`` and component: ``id_col``, ``component``, ``n`` (vectors of the fit list),
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    ship(vectors.sparkSession)
    x = F.transform(F.col("vec").cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")).where(usable(F.col("vec")))
            .select("id", x.alias("x")))
    distinct = checkpoint(rows.select("x").distinct())
    fitted = {}
    for dim, (n, sums) in _sums(distinct).items():
        some = distinct.where(F.size("x") == dim)
        onto, variance, trace = principal(_reduced(_triangles(some, dim, n, sums), dim), n, components)
        if not len(variance):
            continue
        onto = onto / np.sqrt(variance)
        error = float(np.abs(_covariances(some, dim, n, sums, onto) - np.eye(len(variance))).max())
        fitted[dim] = n, sums, onto, variance / trace, error
    schema = T.StructType([
        T.StructField(id_col, rows.schema["id"].dataType), T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                b = whole.slice(lo, _ROWS)
                dims = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
                for dim in np.unique(dims).tolist():
                    if dim not in fitted:
                        continue
                    n, sums, onto, explained, error = fitted[dim]
                    part = b.take(pa.array(np.flatnonzero(dims == dim)))
                    y, exact = deviations(_matrix(part.column(1), dim), n, sums)
                    k, count = onto.shape[1], part.num_rows
                    row = np.repeat(np.arange(count), k)
                    yield out_batch(arrow, [
                        part.column(0).take(pa.array(row)), np.tile(np.arange(1, k + 1, dtype=np.int32), count),
                        np.full(count * k, n), pa.array(exact, pa.int64()).take(pa.array(row)), (y / n @ onto).ravel(),
                        np.tile(explained, count), np.full(count * k, error)])

    return rows.mapInArrow(releasing(run), schema)
