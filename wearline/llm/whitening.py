"""Whitened embeddings from the leading eigenpairs of their covariance, by block Jacobi-Davidson.

The covariance is never formed. Its product with a few vectors is one pass over the rows, each task
adding up Z'(Z b) of its centred rows, and everything else is small algebra on d-vectors. A search
space is grown by approximate solutions of the correction equations, which a few MINRES steps give, all
columns sharing a pass. Rayleigh-Ritz on the space gives the pairs; those whose residual is at the
rounding of the products are locked and kept out of the search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wearline.llm.shared import limit_batches, wrap
from wearline.session import materialize

SCALE, SHIFT = 64, 1_000_000
# Entries beyond this count as not finite; products of larger ones are not exact in double precision.
MOST_ENTRY = float(2**40)
EPS = np.finfo(np.float64).eps
Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Solver:
    """``inner`` MINRES steps per correction; ``space`` times the wanted pairs bounds the search space."""

    inner: int = 4
    space: int = 3
    most_rounds: int = 200
    tolerance: float = 64 * EPS  # of the largest eigenvalue
    # Components whose variance is below this share of the first's are constant to rounding.
    least_share: float = 1e-10
    seed: int = 5


DEFAULT = Solver()


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``doc`` (all columns) and the entries ``y`` = floor(64 c), packed as 64-bit integers.

    Null vectors and those with null or non-finite entries are left out, as are those whose length is not
    the most common one (of two, the longer).
    """
    entries = F.col(f"doc.`{column}`")
    good = F.coalesce(
        (F.size(entries) > 0)
        & F.forall(entries, lambda x: F.coalesce(F.abs(x.cast("double")) * SCALE < MOST_ENTRY, F.lit(False))),
        F.lit(False),
    )
    frame = wrap(vectors).where(good)
    lengths = frame.groupBy(F.size(entries).alias("length")).count()
    widest = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    frame = frame.where(F.size(entries) == (widest["length"] if widest else 0))
    y = F.transform(entries, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    listed = frame.select("doc", y.alias("y"))
    schema = T.StructType([listed.schema["doc"], T.StructField("y", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("y")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            step = len(values) // max(len(lists), 1) * 8
            offsets = pa.py_buffer((np.arange(len(lists) + 1) * step).astype(np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, offsets, pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), packed], names=["doc", "y"])

    return materialize(listed.mapInArrow(pack, schema))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a packed column; reads the buffer in place where its rows lie side by side."""
    values = np.frombuffer(b"".join(column.to_pylist()), np.int64)
    return values.reshape(len(column), width)


def _added(rows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], width: int, kind: str) -> list:
    """The sum over all rows of ``partial(block)``, a flat array; one pass, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                value = partial(_matrix(batch.column(0), width))
                total = value if total is None else total + value
        if total is not None:
            arrays = [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "v"])

    parts = rows.select("y").mapInArrow(run, f"k int, v {kind}")
    value = F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")
    summed = parts.groupBy("k").agg(F.sum(value).alias("v")).orderBy("k").collect()
    return [r["v"] for r in summed]


@dataclass(frozen=True)
class Moments:
    """Rows, and per dimension the exact sums of y and of its square."""

    n: int
    width: int
    sums: list[int]
    squares: list[int]

    @property
    def trace(self) -> float:
        spread = sum(self.n * q - s * s for s, q in zip(self.sums, self.squares))
        return float(Decimal(spread) / Decimal(self.n) / Decimal(self.n))

    def centred(self, y: np.ndarray) -> np.ndarray:
        """x - S/n, from exact numerators where they fit 64 bits."""
        if self._reach(y) < 2**63:
            return (self.n * y - np.array(self.sums, np.int64)) / self.n
        return ((self.n * y.astype(object) - np.array(self.sums, dtype=object)) / self.n).astype(np.float64)

    def _reach(self, y: np.ndarray) -> int:
        """No entry of n y - S is larger."""
        return self.n * (int(np.abs(y).max()) + 1) + max(map(abs, self.sums))

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Per row the exact sum of (n x - S)^2; None beyond 64 bits."""
        if self._reach(y) ** 2 * self.width < 2**63:
            spread = self.n * y - np.array(self.sums, np.int64)
            return (spread * spread).sum(axis=1).tolist()
        spread = self.n * y.astype(object) - np.array(self.sums, dtype=object)
        return [v if v < 2**63 else None for v in (spread * spread).sum(axis=1)]


def _halves(y: np.ndarray) -> np.ndarray:
    """Sums of y and of the products of its upper and lower 20 bits, so that no task's sum overflows."""
    high = (y + (1 << 19)) >> 20
    low = y - (high << 20)
    return np.concatenate([y.sum(0), (high * high).sum(0), (high * low).sum(0), (low * low).sum(0)])


def moments(rows: DataFrame) -> Moments | None:
    """None if there are no rows."""
    first = rows.select((F.octet_length("y") / 8).cast("int").alias("width")).first()
    if first is None:
        return None
    width = first["width"]
    sums = [int(v) for v in _added(rows, _halves, width, "long")]
    part = [sums[i * width : (i + 1) * width] for i in range(4)]
    squares = [(h << 40) + (m << 21) + l for h, m, l in zip(*part[1:])]
    return Moments(rows.count(), width, part[0], squares)


def covariance_product(rows: DataFrame, known: Moments) -> Product:
    """b -> V b, one pass over ``rows``; ``b`` has a column per vector."""

    def product(b: np.ndarray) -> np.ndarray:
        def partial(y: np.ndarray) -> np.ndarray:
            z = known.centred(y)
            return (z.T @ (z @ b)).ravel()

        return np.array(_added(rows, partial, known.width, "double")).reshape(b.shape) / known.n

    return product


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to ``bases``; directions already there are dropped."""
    for _ in range(2):
        for basis in bases:
            new = new - basis @ (basis.T @ new)
        sizes = np.linalg.norm(new, axis=0)
        new = new[:, sizes > 1e-13] / sizes[sizes > 1e-13]
        if not new.shape[1]:
            return new
        left, values, _ = np.linalg.svd(new, full_matrices=False)
        new = left[:, values > 1e-10 * values[0]]
    return new


def minres_corrections(
    product: Product, theta: np.ndarray, u: np.ndarray, locked: np.ndarray, residual: np.ndarray, steps: int
) -> np.ndarray:
    """Columns t with (I-QQ')(I-uu')(V-theta)(I-uu')(I-QQ') t = -residual, nearly, by MINRES.

    All columns take their steps together, so that a step is one product.
    """

    def project(t: np.ndarray) -> np.ndarray:
        t = t - locked @ (locked.T @ t)
        return t - u * np.sum(u * t, axis=0)

    t = np.zeros_like(residual)
    v = project(-residual)
    beta = np.linalg.norm(v, axis=0)
    floor = np.maximum(beta, np.finfo(np.float64).tiny) * EPS
    live = beta > 0
    v = v / np.where(live, beta, 1)
    before = np.zeros_like(v)
    eta, beta = beta.copy(), np.zeros_like(beta)
    c0 = c1 = np.ones_like(eta)
    s0 = s1 = np.zeros_like(eta)
    w0 = w1 = np.zeros_like(v)
    for _ in range(steps):
        if not live.any():
            break
        a = project(product(v) - v * theta)
        alpha = np.sum(v * a, axis=0)
        after = a - alpha * v - beta * before
        next_beta = np.linalg.norm(after, axis=0)
        delta = c1 * alpha - c0 * s1 * beta
        rho = np.hypot(delta, next_beta)
        rho2, rho3 = s1 * alpha + c0 * c1 * beta, s0 * beta
        live = live & (rho > floor)
        safe = np.where(live, rho, 1)
        c0, c1, s0, s1 = c1, np.where(live, delta / safe, 1), s1, np.where(live, next_beta / safe, 0)
        w0, w1 = w1, (v - rho3 * w0 - rho2 * w1) / safe
        t = t + np.where(live, c1 * eta, 0) * w1
        eta = -s1 * eta
        before, beta = v, next_beta
        live = live & (next_beta > floor)
        v = after / np.where(next_beta > floor, next_beta, 1)
    return project(t)


@dataclass(frozen=True)
class Pairs:
    """Eigenvalues, falling, their unit vectors as columns, and the residuals of a last fresh product."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    rounds: int


def jacobi_davidson(product: Product, width: int, wanted: int, solver: Solver = DEFAULT) -> Pairs:
    """The ``wanted`` largest eigenpairs of a symmetric product, to the rounding of the product.

    A pair within a hundred times the tolerance that three rounds did not bring nearer is at its rounding too.
    Raises ArithmeticError if pairs remain open after ``most_rounds``.
    """
    wanted = min(wanted, width)
    random = np.random.default_rng(solver.seed)
    locked, values = np.zeros((width, 0)), np.zeros(0)
    basis = _orthonormal(random.standard_normal((width, wanted)))
    image = product(basis)
    best, stale = np.full(wanted, np.inf), np.zeros(wanted, int)
    for round_ in range(1, solver.most_rounds + 1):
        small = basis.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        take = np.argsort(-theta)[: wanted - locked.shape[1]]
        theta, y = theta[take], y[:, take]
        u = basis @ y
        residual = image @ y - u * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        limit = solver.tolerance * max(values.max(initial=0.0), theta.max(initial=0.0))
        full = locked.shape[1] + basis.shape[1] >= width
        stale = np.where(size < 0.9 * best, 0, stale + 1)
        best = np.minimum(best, size)
        done = (size <= limit) | ((stale >= 3) & (size <= 100 * limit)) | full
        # Only leading pairs are locked, so that no larger one can still be missing.
        count = len(done) if done.all() else int(np.argmin(done))
        if count:
            locked = np.hstack([locked, _orthonormal(u[:, :count], locked)])
            values = np.concatenate([values, theta[:count]])
            best, stale = best[count:], stale[count:]
        if locked.shape[1] >= wanted:
            return _polished(product, locked, round_)
        u, theta, residual = (a[..., count:] for a in (u, theta, residual))
        if basis.shape[1] + u.shape[1] > max(solver.space * wanted, 2 * u.shape[1]):
            basis = _orthonormal(u, locked)
            image = product(basis)
        elif count:
            basis = _orthonormal(basis, locked)
            image = product(basis)
        grown = _orthonormal(minres_corrections(product, theta, u, locked, residual, solver.inner), locked, basis)
        if not grown.shape[1]:
            grown = _orthonormal(random.standard_normal((width, u.shape[1])), locked, basis)
        basis, image = np.hstack([basis, grown]), np.hstack([image, product(grown)])
    raise ArithmeticError(f"{wanted - locked.shape[1]} eigenpairs open after {solver.most_rounds} rounds")


def _polished(product: Product, locked: np.ndarray, rounds: int) -> Pairs:
    """Rayleigh-Ritz on the locked vectors from a fresh product."""
    basis, _ = np.linalg.qr(locked)
    image = product(basis)
    small = basis.T @ image
    values, y = np.linalg.eigh((small + small.T) / 2)
    values, y = values[::-1], y[:, ::-1]
    vectors = basis @ y
    return Pairs(values, vectors, np.linalg.norm(image @ y - vectors * values, axis=0), rounds)


def _identity_error(rows: DataFrame, known: Moments, axes: np.ndarray) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, from the rows themselves."""
    width = axes.shape[1]

    def partial(y: np.ndarray) -> np.ndarray:
        w = known.centred(y) @ axes
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    total = np.array(_added(rows, partial, known.width, "double")) / known.n
    mean, square = total[:width], total[width:].reshape(width, width)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(width)).max(initial=0.0))


def whiten(
    vectors: DataFrame, components: int = 32, column: str = "embedding", solver: Solver = DEFAULT
) -> DataFrame:
    """Per vector ``doc, n, deviation, whitened, explained, identity_error``; arrays go by component.

    Vectors that are null, empty, or hold null or non-finite entries (or entries beyond 2^34) are left out,
    as are those of another length than most; repeated rows count each. Components without variance
    (below ``least_share`` of the first) don't exist, so equal or single vectors get empty arrays. A
    deviation beyond 64 bits is null. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    limit_batches(spark)
    rows = whole_vectors(vectors, column)
    schema = T.StructType(
        [rows.schema["doc"]]
        + T._parse_datatype_string(
            "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
        ).fields
    )
    known = moments(rows)
    if known is None:
        return spark.createDataFrame([], schema)
    pairs = None
    if known.trace > 0:
        pairs = jacobi_davidson(covariance_product(rows, known), known.width, components, solver)
    return _projected(spark, rows, known, pairs, schema, solver)


def _projected(
    spark: SparkSession, rows: DataFrame, known: Moments, pairs: Pairs | None, schema: T.StructType, solver: Solver
) -> DataFrame:
    axes, explained = np.zeros((known.width, 0)), np.zeros(0)
    if pairs is not None:
        kept = pairs.values > solver.least_share * pairs.values[0]
        axes = pairs.vectors[:, kept] / np.sqrt(pairs.values[kept])
        explained = pairs.values[kept] / known.trace
    error = _identity_error(rows, known, axes) if axes.shape[1] else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column("y"), known.width)
            count, width = len(y), axes.shape[1]
            offsets = pa.array(np.arange(count + 1, dtype=np.int32) * width)
            whitened = pa.ListArray.from_arrays(offsets, pa.array((known.centred(y) @ axes).ravel()))
            shares = pa.ListArray.from_arrays(offsets, pa.array(np.tile(explained, count)))
            arrays = [
                batch.column("doc"),
                pa.array(np.full(count, known.n)),
                pa.array(known.deviations(y), pa.int64()),
                whitened,
                shares,
                pa.array(np.full(count, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)
