"""Whitening of embeddings by a bidiagonal qd solver.

1. Blockwise QR: every task reduces its centred rows to one triangle R, triangles are stacked and
   reduced again, a few at a time, until one is left.  R has the singular values and the right
   singular vectors of all rows, without a covariance ever being formed.
2. Householder reflections bring R to bidiagonal form B.
3. dqds (differential quotient differences with shifts) finds the squared singular values of B, the
   small ones as accurately as the large ones.
4. A twisted factorisation of B'B - s per squared singular value s gives its vector: the
   stationary and the progressive form meet where the pivot is smallest.  Vectors of values that
   lie close together are refined together.  The reflections of step 2 carry them back.

Steps 2 to 4 work on one small square matrix whose side is the vector length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohort.session import written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Neighbouring values with a smaller relative gap have their vectors refined together.
CLOSE = 1e-4
#: Triangles that one task stacks, and numbers that one QR step takes.
FAN_IN, CELLS = 16, 1 << 20
#: Entries beyond this are no whole numbers to double precision and count as non-finite.
LARGEST = 2 ** 52
LOW = (1 << 26) - 1
EPS = np.finfo(float).eps


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, right reflectors) of the bidiagonal form of a square matrix."""
    a, n, right = r.astype(float), len(r), []

    def reflector(x: np.ndarray) -> np.ndarray:
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        return v / size if size > 0 else v

    for k in range(n):
        v = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 1:
            v = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, in falling order."""
    q, e = diagonal.astype(float) ** 2, above.astype(float) ** 2
    found, stack = [], [(q, e, 0.0)]
    while stack:
        q, e, moved = stack.pop()
        n = len(q)
        if n == 0:
            continue
        if n == 1:
            found.append(moved + q[0])
            continue
        small = EPS * EPS * (moved + np.minimum(q[:-1], q[1:])) + np.finfo(float).tiny
        cut = np.flatnonzero(e <= small)
        if len(cut):
            k = int(cut[-1]) + 1
            stack += [(q[:k], e[:k - 1], moved), (q[k:], e[k:], moved)]
            continue
        if q[0] < q[-1]:  # the small end belongs at the bottom
            q, e = _flip(q, e)
        # smaller eigenvalue of the last two rows, an upper bound; if it fails, ever less of it
        low, high = q[-1] + e[-1], q[-2] + (e[-2] if n > 2 else 0.0)
        gap, cross = abs(high - low) / 2, q[-2] * e[-1]
        shift = max(0.0, min(low, high) - cross / (gap + np.hypot(gap, np.sqrt(cross))))
        for tau in (shift * (1 - 8 * EPS), shift * 0.75, shift * 0.25, 0.0):
            step = _qd(q, e, tau)
            if step is not None:
                stack.append((*step, moved + tau))
                break
    return np.sort(np.array(found))[::-1]


def _qd(q: np.ndarray, e: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential qd step with shift, or None if the shift was too large."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d = q[0] - tau
    for i in range(n - 1):
        if d < 0:
            return None
        new_q[i] = d + e[i]
        ratio = q[i + 1] / new_q[i] if new_q[i] > 0 else 1.0
        new_e[i] = e[i] * ratio
        d = d * ratio - tau
    new_q[-1] = d
    return None if d < 0 or not np.isfinite(d) else (new_q, new_e)


def _flip(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same values from the last row to the first: the array is read backwards."""
    return q[::-1].copy(), e[::-1].copy()


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit vector z with (B'B - value) z smallest, B with diagonal ``a`` and ``b`` above it."""
    n = len(a)
    if n == 1:
        return np.ones(1)
    tiny = np.finfo(float).tiny / EPS
    q, e = a * a, b * b
    stay, low = np.empty(n), np.empty(n - 1)      # stationary: L+ D+ L+'
    stay[0] = -value
    for i in range(n - 1):
        down = stay[i] + q[i]
        if abs(down) < tiny:
            down = -tiny
        low[i] = a[i] * b[i] / down
        stay[i + 1] = low[i] * b[i] / a[i] * stay[i] - value
    meet, high = np.empty(n), np.empty(n - 1)     # progressive: U- D- U-'
    meet[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        up = e[i] + meet[i + 1]
        if abs(up) < tiny:
            up = -tiny
        high[i] = a[i] * b[i] / up
        meet[i] = meet[i + 1] * q[i] / up - value
    pivot = stay + meet + value
    k = int(np.argmin(np.abs(pivot)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -low[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -high[i] * z[i]
    return z / np.linalg.norm(z)


def singular_directions(r: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as columns) of a square matrix.

    The largest ``count`` are given, without those that are zero to rounding.
    """
    n = len(r)
    size = np.abs(r).max(initial=0.0)
    if size == 0:
        return np.zeros(0), np.zeros((n, 0))
    a, b, right = bidiagonalise(r / size)
    values = dqds(a, b)
    top = values[0]
    a = np.where(np.abs(a) < EPS * EPS * np.sqrt(top), EPS * EPS * np.sqrt(top), a)
    # enough values that a cluster cut off by the count is refined whole
    wanted = int(np.sum(values[:count] > top * (8 * n * EPS) ** 2))
    last = wanted
    while last < n and wanted and values[last - 1] - values[last] < CLOSE * values[last - 1]:
        last += 1
    vectors = np.zeros((n, last))
    first = 0
    for j in range(last):
        vectors[:, j] = twisted_vector(a, b, values[j])
        end = j + 1 == last or values[j] - values[j + 1] >= CLOSE * values[j]
        if end and j > first:
            vectors[:, first:j + 1] = _together(a, b, vectors[:, first:j + 1], values[first:j + 1])
        first = j + 1 if end else first
    for k in range(len(right) - 1, -1, -1):
        v = right[k]
        vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    vectors = vectors[:, :wanted] / np.linalg.norm(vectors[:, :wanted], axis=0)
    # squared length of R v: the values once more, from the directions themselves
    values = np.linalg.norm(r @ vectors, axis=0) ** 2
    order = np.argsort(-values, kind="stable")
    vectors, values = vectors[:, order], values[order]
    lead = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(wanted)]
    return values, vectors * np.where(lead < 0, -1.0, 1.0)


def _together(a: np.ndarray, b: np.ndarray, z: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal vectors of close values: steps of inverse iteration on their span."""
    n, m = z.shape
    t = np.diag(a * a + np.r_[0.0, b * b]) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    basis = np.linalg.qr(z + 1e-10 * np.random.default_rng(n).standard_normal(z.shape))[0]
    for _ in range(3):
        solved = np.empty_like(basis)
        for j in range(m):
            shifted = t - (values[j] * (1 + 4 * EPS) + np.finfo(float).tiny) * np.eye(n)
            try:
                solved[:, j] = np.linalg.solve(shifted, basis[:, j])
            except np.linalg.LinAlgError:  # the basis vector is as good as it gets
                solved[:, j] = basis[:, j]
            solved[:, j] /= np.linalg.norm(solved[:, j])
        joined = np.linalg.qr(np.hstack([solved, basis]))[0]
        inner, turn = _jacobi(joined.T @ t @ joined)
        # the m of the span whose values lie nearest to the cluster
        near = np.argsort(np.abs(inner - values.mean()), kind="stable")[:m]
        basis = joined @ turn[:, near]
    inner, turn = _jacobi(basis.T @ t @ basis)
    return (basis @ turn)[:, np.argsort(-inner, kind="stable")]


def _jacobi(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and vectors of a small symmetric matrix by rotations."""
    s, n = (s + s.T) / 2, len(s)
    turn = np.eye(n)
    for _ in range(30):
        off = np.abs(s - np.diag(np.diag(s))).max(initial=0.0)
        if off <= EPS * np.abs(s).max(initial=0.0):
            break
        for i in range(n):
            for j in range(i):
                if abs(s[i, j]) > np.finfo(float).tiny:
                    angle = 0.5 * np.arctan2(2 * s[i, j], s[i, i] - s[j, j])
                    c, d = np.cos(angle), np.sin(angle)
                    rotation = np.array([[c, -d], [d, c]])
                    pick = [i, j]
                    s[:, pick] = s[:, pick] @ rotation
                    s[pick, :] = rotation.T @ s[pick, :]
                    turn[:, pick] = turn[:, pick] @ rotation
    return np.diag(s).copy(), turn


class Centre:
    """The number of fitted vectors and the sums of their dimensions, as whole numbers."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.sums = n, sums
        self.plain = n * max(largest, 1) < 2 ** 61

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if self.plain:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(float) / self.n

    def squares(self, x: np.ndarray) -> list[int | None]:
        """The sum of the squared deviations of each row; None where 63 bits are too few."""
        d = self.deviations(x)
        if self.plain and np.abs(d.astype(float)).max(initial=0.0) ** 2 * x.shape[1] < 2 ** 62:
            return (d * d).sum(axis=1).tolist()
        sums = (d.astype(object) ** 2).sum(axis=1).tolist()
        return [s if s < 2 ** 63 else None for s in sums]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and sums of each dimension, high and low bits apart so that nothing overflows."""
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            yield pa.record_batch([
                pa.array(np.full(x.shape[1], len(x))), pa.array(np.arange(x.shape[1])),
                pa.array((x >> 26).sum(axis=0)), pa.array((x & LOW).sum(axis=0)),
                pa.array(np.abs(x).max(axis=0))], names=["n", "at", "high", "low", "largest"])


def _triangles(centre: Centre):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            step = max(x.shape[1], CELLS // x.shape[1])
            for at in range(0, len(x), step):
                rows = centre.centred(x[at:at + step])
                r = np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
        if r is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                   pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    return run


def _stacked(dims: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b.as_py()).reshape(-1, dims) for b in table.column("r")]
        r = np.linalg.qr(np.vstack(parts), mode="r")
        return pa.table({"part": table.column("part").slice(0, 1),
                         "r": pa.array([r.tobytes()], pa.binary())})

    return run


def _gram(centre: Centre, project: np.ndarray):
    """Sums of the products of the whitened components, two at a time."""
    m = project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, m))
        for batch in batches:
            if batch.num_rows:
                w = centre.centred(_matrix(batch.column(0))) @ project
                total += w.T @ w
        i, j = np.divmod(np.arange(m * m), m)
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total.ravel())],
                              names=["i", "j", "s"])

    return run


def _whitened(centre: Centre, project: np.ndarray):
    m = project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            w = centre.centred(x) @ project
            row = pa.array(np.repeat(np.arange(len(x)), m))
            yield pa.record_batch([
                batch.column(0).take(row), pa.array(np.tile(np.arange(1, m + 1), len(x)), pa.int32()),
                pa.array(centre.squares(x), pa.int64()).take(row), pa.array(w.ravel())],
                names=["id", "component", "deviation", "whitened"])

    return run


def whole_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x, dims): rows whose entries are all finite, as whole numbers."""
    entry = lambda c: c.cast("double") * SCALE
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double"))
                   | (F.abs(entry(c)) >= LARGEST))
    return vectors.where(F.col(vector).isNotNull() & ~bad & (F.size(vector) > 0)).select(
        F.col(key).alias("id"),
        F.transform(vector, lambda c: F.floor(entry(c)).cast("bigint") + SHIFT).alias("x"),
        F.size(vector).alias("dims"))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for every usable row.

    Entries become x = floor(64 * entry) + 1000000.  The fit takes each distinct x vector once; the
    covariance V has the divisor n.  Components are numbered from 1 by falling eigenvalue e; each
    has its largest entry positive.  ``deviation`` is the sum of (n * x - S) ** 2 over the
    dimensions, null if it needs more than 63 bits; ``whitened`` the projection of x - S / n over
    sqrt(e); ``explained`` e / trace(V); ``identity_error`` the largest absolute entry of the
    covariance of ``whitened`` over the fit, minus the identity.

    Left out are vectors that are null, empty, or hold null, non-finite entries or such of 2 ** 46
    or more.  Vectors of different lengths have fits of their own.  Directions whose eigenvalue is
    zero to rounding are no components, so equal vectors alone give no rows.  Rows may repeat keys,
    also null ones.  Other columns are ignored.
    """
    rows = written(whole_vectors(vectors, key, vector), "whole-vectors")
    fit = written(rows.select("dims", "x").distinct(), "fitted-vectors")
    kind = vectors.schema[key].dataType.simpleString()
    schema = (f"id {kind}, component int, deviation bigint, whitened double, n bigint, "
              "explained double, identity_error double")
    lengths = [r["dims"] for r in fit.select("dims").distinct().collect()]
    parts = [_fitted(rows, fit, dims, kind, components) for dims in sorted(lengths)]
    parts = [p for p in parts if p is not None] or [vectors.sparkSession.createDataFrame([], schema)]
    out = reduce(DataFrame.unionByName, parts)
    return out.select(F.col("id").alias(key), "component", "n", "deviation", "whitened",
                      "explained", "identity_error")


def _fitted(rows: DataFrame, fit: DataFrame, dims: int, kind: str,
            components: int) -> DataFrame | None:
    own = fit.where(F.col("dims") == dims).select("x")
    sums = (own.mapInArrow(_sums, "n bigint, at bigint, high bigint, low bigint, largest bigint")
            .groupBy("at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"),
                               F.sum("low").alias("low"), F.max("largest").alias("largest"))
            .orderBy("at").collect())
    centre = Centre(sums[0]["n"], [(r["high"] << 26) + r["low"] for r in sums],
                    max(r["largest"] for r in sums))
    triangles = written(own.mapInArrow(_triangles(centre), "part bigint, r binary"), "triangles")
    while triangles.count() > 1:
        triangles = written(
            triangles.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("bigint"))
            .groupBy("part").applyInArrow(_stacked(dims), "part bigint, r binary"), "triangles")
    r = np.frombuffer(triangles.first()["r"]).reshape(-1, dims)
    r = np.vstack([r, np.zeros((dims - len(r), dims))])
    trace = float((r * r).sum())
    squares, directions = singular_directions(r, components)
    if not len(squares):
        return None
    values = squares / centre.n
    project = directions / np.sqrt(values)
    gram = (own.mapInArrow(_gram(centre, project), "i bigint, j bigint, s double")
            .groupBy("i", "j").agg(F.sum("s").alias("s")).collect())
    error = max(abs(g["s"] / centre.n - (g["i"] == g["j"])) for g in gram)
    explained = F.array(*(F.lit(float(s / trace)) for s in squares))
    return (rows.where(F.col("dims") == dims).select("id", "x")
            .mapInArrow(_whitened(centre, project),
                        f"id {kind}, component int, deviation bigint, whitened double")
            .select("*", F.lit(centre.n).cast("bigint").alias("n"),
                    F.element_at(explained, F.col("component")).alias("explained"),
                    F.lit(float(error)).alias("identity_error")))
