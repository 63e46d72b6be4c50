"""Embedding whitening by FEAST contour integration.

Entries become whole numbers x = floor(256 c); the fit list is every distinct
x vector once.  Spark does the work that grows with the rows: vectors are packed
into the narrowest integers that hold them, made distinct by one shuffle, and
the sums, the centred products and the check of the whitened covariance are
sums of one small partial result a task.  What reaches the driver has the size
of the covariance (width x width), never of the rows; rows are projected by a
map over the table.

Components of the covariance V come from its spectrum, cut into intervals:

* *Inertia.*  V is reduced to tridiagonal form; the signs of the pivots of
  T - s (a Sturm sequence) count the eigenvalues below s, so intervals are laid
  in gaps of the spectrum with a known number of eigenvalues inside.
* *Contour.*  Gauss-Legendre points z on the circle over an interval; the sum
  of weighted solves (z - V)^-1 Y projects a random block onto the eigenvectors
  inside (Polizzi 2009).
* *Rayleigh-Ritz* in that subspace gives eigenvalues and vectors; projection and
  Ritz step repeat until the residual is at rounding level.
* The number of Ritz values inside has to equal the inertia count, else the
  block grows; a difference that stays is an error, so no component is missed.

Edge cases: rows whose vector is null or holds null or non-finite entries are
dropped.  Vectors of the commonest width (of equally common ones, the widest)
are fitted; a row of another width, an empty vector included, returns its
components with null values.  A component without variance (eigenvalue not above
rounding) has null ``whitened`` and ``explained`` 0, and ``identity_error``
leaves it out (null if no component is left).  A ``deviation`` beyond 64 bits is
null.  Null ids, ties and repeated rows stay as they are (copies of a vector are
fitted once); other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table

SCALE = 256
COMPONENTS = 4
POINTS = 16             # contour points on the upper half circle
SPARE = 1.5             # block columns for each eigenvalue of an interval
MAX_ROUNDS = 30
BLOCK = 8192            # vectors multiplied at a time
_KINDS = ("<i1", "<i2", "<i4", "<i8")


# ---------------------------------------------------------- spectrum of V --
def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix
    (Householder reflections)."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += math.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        p = a[k + 1:, k + 1:] @ x
        w = 2 * (p - (x @ p) * x)
        a[k + 1:, k + 1:] -= np.outer(x, w) + np.outer(w, x)
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -math.copysign(norm, x[0])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(diag: np.ndarray, off: np.ndarray, shift: float) -> int:
    """Eigenvalues of the tridiagonal matrix above ``shift``: by Sylvester's law
    the positive pivots of its LDL^T factorisation."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    n, pivot = 0, 1.0
    for i in range(len(diag)):
        pivot = diag[i] - shift - (off[i - 1] * off[i - 1] / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        n += pivot > 0
    return n


def intervals(diag: np.ndarray, off: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) from the top of the spectrum
    down, together holding at least ``wanted`` eigenvalues.  Each lower end lies
    in a gap: eigenvalues are bracketed by bisection on their counts, and of the
    next ``wanted`` gaps the widest is taken; where none stands out (tied
    eigenvalues) the interval grows downwards."""
    d = len(diag)
    reach = np.abs(off)
    radius = np.concatenate([reach, [0]]) + np.concatenate([[0], reach])
    bottom, top = float((diag - radius).min()), float((diag + radius).max())
    span = max(top - bottom, abs(top), np.finfo(float).tiny)
    bottom, top = bottom - 0.01 * span, top + 0.01 * span

    def eigenvalue(k):      # the k-th largest, k from 1
        lo, hi = bottom, top
        while hi - lo > 1e-9 * span:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if count_above(diag, off, mid) >= k else (lo, mid)
        return (lo + hi) / 2

    found, out, high = 0, [], None
    while found < min(wanted, d):
        first, last = max(0, wanted - found - 1), max(wanted, found + 1)
        while True:
            last = min(d, last + wanted)
            at = [eigenvalue(k) for k in range(found + 1, last + 1)] + ([bottom] if last == d else [])
            widths = [at[i] - at[i + 1] for i in range(len(at) - 1)]
            i = max(range(first, len(widths)), key=widths.__getitem__)
            if widths[i] > 1e-3 * (at[0] - at[i + 1]) or last == d:
                break
        low = (at[i] + at[i + 1]) / 2
        if high is None:
            high = at[0] + max(0.1 * (at[0] - low), 1e-6 * span)
        inside = count_above(diag, off, low) - found
        out.append((low, high, inside))
        found, high = found + inside, low
    return out


def feast(v: np.ndarray, low: float, high: float, inside: int, seed: int = 1):
    """Eigenvalues (falling) and unit eigenvectors of ``v`` in (low, high); there
    have to be ``inside`` of them."""
    d = len(v)
    x, w = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (x + 1)
    centre, radius = (low + high) / 2, (high - low) / 2
    z = centre + radius * np.exp(1j * angles)
    weight = w / 2 * radius * np.exp(1j * angles)
    shifted = [p * np.eye(d) - v for p in z]
    norm = max(np.abs(v).sum(axis=1).max(), np.finfo(float).tiny)
    columns = inside
    while columns <= d:
        columns = min(d, max(columns + 2, math.ceil(SPARE * columns)))
        y = np.random.default_rng(seed).standard_normal((d, columns))
        best = None
        for _ in range(MAX_ROUNDS):
            projected = sum((u * np.linalg.solve(m, y)).real for u, m in zip(weight, shifted))
            q, _ = np.linalg.qr(projected)
            values, small = np.linalg.eigh(q.T @ v @ q)
            y = q @ small
            residual = np.linalg.norm(v @ y - y * values, axis=0)
            own = (values > low) & (values < high) & (residual < 1e-6 * norm)
            worst = residual[own].max() if own.any() else math.inf
            if own.sum() == inside and (worst < 1e-14 * norm or best is not None and worst >= 0.5 * best[0]):
                order = np.argsort(-values[own])
                return values[own][order], y[:, own][:, order]
            best = (worst,) if own.sum() == inside else None
        if columns == d:
            break
    raise ArithmeticError(f"inertia counts {inside} eigenvalues between {low} and {high}, other numbers were found")


def components(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (falling) and their unit eigenvectors
    as columns; those that are zero up to rounding are 0."""
    wanted = min(wanted, len(v))
    if not wanted:
        return np.zeros(0), np.zeros((len(v), 0))
    scale = float(np.trace(v))
    if scale <= 0:
        return np.zeros(wanted), np.eye(len(v))[:, :wanted]
    u = v / scale           # contours and tolerances do not depend on the units
    diag, off = tridiagonal(u)
    parts = [feast(u, low, high, inside) for low, high, inside in intervals(diag, off, wanted)]
    values = np.concatenate([p[0] for p in parts])[:wanted] * scale
    vectors = np.concatenate([p[1] for p in parts], axis=1)[:, :wanted]
    values[values <= 1e-13 * len(v) * scale] = 0
    return values, vectors


# ------------------------------------------------------ vectors as numbers --
def _whole(column: pa.Array) -> list[np.ndarray | None]:
    """Per row floor(SCALE * entry) as int64, beyond 64 bits the nearest long;
    None for rows that are dropped."""
    offsets = column.offsets.to_numpy()
    c = np.floor(SCALE * column.values.to_numpy(zero_copy_only=False).astype(np.float64))   # null entries: NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
    x = np.clip(np.where(np.isfinite(c), c, 0), -2.0 ** 63, 2.0 ** 63 - 1024).astype(np.int64)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [x[lo:hi] if ok and bad[lo] == bad[hi] else None for lo, hi, ok in zip(offsets[:-1], offsets[1:], valid)]


def _packed(x: np.ndarray) -> bytes:
    """Kind and entries in the narrowest integers, the same bytes for equal x."""
    if not len(x):
        return b"\0"
    most = max(int(x.max()), -int(x.min()) - 1)
    kind = next(i for i, bits in enumerate((7, 15, 31, 63)) if most < 1 << bits)
    return bytes([kind]) + x.astype(_KINDS[kind]).tobytes()


def _unpacked(rows: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i] = np.frombuffer(r, _KINDS[r[0]], offset=1)
    return out


def _pack(batches):
    for b in batches:
        xs = [x for x in _whole(b.column(0)) if x is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(x) for x in xs], pa.int32()), pa.array([_packed(x) for x in xs], pa.binary())],
            names=["width", "x"])


def _blocks(batches, width):
    for b in batches:
        rows = b.column(0).to_pylist()
        for i in range(0, len(rows), BLOCK):
            yield _unpacked(rows[i:i + BLOCK], width)


def _partial(fold, shape):
    """mapInArrow function that folds all of a task's blocks into one array
    (``fold(block)`` summed) and returns its entries as (i, value, rows)."""
    width = shape[0]

    def run(batches):
        total, n = np.zeros(math.prod(shape[1:])), 0
        for block in _blocks(batches, width):
            total = total + fold(block).ravel()
            n += len(block)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.tolist()),
                 pa.array(np.full(len(total), n, np.int64))], names=["i", "value", "n"])
    return run


def _summed(vectors: DataFrame, fold, width: int, *shape: int, kind: str = "double"):
    """(sum over the vectors, number of vectors); one partial array a task is
    added up by entry, so the driver gets an array of ``shape``."""
    rows = (vectors.select("x").mapInArrow(_partial(fold, (width, *shape)), "i int, value double, n long")
            .groupBy("i").agg(F.sum(F.col("value").cast(kind)).alias("value"), F.sum("n").alias("n")).collect())
    out = np.zeros(math.prod(shape), object if kind != "double" else float)
    for r in rows:
        out[r["i"]] = r["value"]
    return out.reshape(shape), (rows[0]["n"] if rows else 0)


class Whitening:
    """Fit of a table: width, n, sums (whole numbers), trace, eigenvalues,
    vectors, identity_error."""

    def __init__(self, width, n, sums, trace, values, vectors, error):
        self.width, self.n, self.sums, self.trace = width, n, sums, trace
        self.values, self.vectors, self.error = values, vectors, error

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], float)

    @property
    def projection(self) -> np.ndarray:
        scale = np.where(self.values > 0, self.values, np.inf)
        return self.vectors / np.sqrt(scale)


def fit(rows: DataFrame, column: str = "embedding", wanted: int = COMPONENTS) -> Whitening | None:
    """Mean and whitening components over the distinct vectors of ``column``."""
    packed = rows.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(_pack, "width int, x binary")
    distinct = stage(packed.distinct(), "vectors")
    widths = distinct.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not widths:
        return None
    width = widths[0]["width"]
    vectors = distinct.where(F.col("width") == width)
    if not width:
        return Whitening(0, widths[0]["count"], [], 0.0, np.zeros(0), np.zeros((0, 0)), None)
    # partial sums of a task are exact below 2^53; beyond, they are split
    whole, n = _summed(vectors, lambda x: np.concatenate([(x >> 20).sum(axis=0), (x & 0xFFFFF).sum(axis=0)]),
                       width, 2, width, kind="decimal(38,0)")
    sums = [int(hi) * (1 << 20) + int(lo) for hi, lo in zip(*whole)]
    mean = np.array([s / n for s in sums], float)

    def products(x):
        c = x - mean
        return c.T @ c

    v = _summed(vectors, products, width, width, width)[0] / n
    v = (v + v.T) / 2
    values, vectors_ = components(v, wanted)
    out = Whitening(width, n, sums, float(np.trace(v)), values, vectors_, None)
    good = np.flatnonzero(values > 0)
    if len(good):
        mean, projection = out.mean, out.projection[:, good]

        def whitened(x):
            y = (x - mean) @ projection
            return y.T @ y

        k = len(good)
        # whitened means are zero up to rounding, as the rows are centred
        seen = _summed(vectors, whitened, width, k, k)[0] / n
        out.error = float(np.abs(seen - np.eye(k)).max())
    return out


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                  ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
       "identity_error double")


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row of ``x`` the sum over its entries of (n * x - S)^2, exact."""
    most = max(max(abs(s) for s in sums), n * max(int(x.max(initial=0)), -int(x.min(initial=0))))
    if 4 * most * most * len(sums) < 1 << 63:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    y = n * x.astype(object) - np.array(sums, object)
    return [t if t < 1 << 63 else None for t in (y * y).sum(axis=1)]


def _whiten(w: Whitening):
    mean, projection, k = w.mean, w.projection, len(w.values)
    explained = w.values / w.trace if w.trace > 0 else np.zeros(k)

    def run(batches):
        for b in batches:
            xs = _whole(b.column(1))
            kept = [i for i, x in enumerate(xs) if x is not None]
            m = len(kept)
            fits = [j for j, i in enumerate(kept) if w.width and len(xs[i]) == w.width]
            dev, white = np.full(m, None, object), np.full((m, k), np.nan)
            if fits:
                x = np.array([xs[kept[j]] for j in fits])
                dev[fits] = _deviation(x, w.n, w.sums)
                white[fits] = np.where(w.values > 0, (x - mean) @ projection, np.nan)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(kept, k).astype(np.int64))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, w.n, np.int64)), pa.array(np.repeat(dev, k).tolist(), pa.int64()),
                pa.array(white.ravel(), from_pandas=True), pa.array(np.tile(explained, m)),
                pa.array([w.error] * (m * k), pa.float64())], schema=_OUT)
    return run


def whiten(rows: DataFrame, column: str = "embedding", id_column: str = "vec_id",
           wanted: int = COMPONENTS) -> DataFrame:
    """One row for each kept row and component: vec_id, component (from 1), n,
    deviation, whitened, explained, identity_error."""
    fitted = fit(rows, column, wanted)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], OUT)
    return (rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
            .mapInArrow(_whiten(fitted), OUT))


def op11_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
