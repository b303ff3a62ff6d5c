"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers, y = floor(scale * c), so that sums are exact; a constant added to all of them
changes neither deviations nor components. Their covariance V (divisor n, rows centred before they
are multiplied) is never formed: a pass over the rows gives V Q for a thin block Q, each task adding
up its rows' (y - m) (y - m)ᵀ Q, and the partial blocks are summed across the cluster, entry by
entry. On the driver lie only blocks of dimensions x ``block`` numbers.

A round rotates the block to its Ritz vectors (QR, then Rayleigh-Ritz on Qᵀ V Q). The residuals
|V u - e u| of the wanted ones bound what their eigenvalues miss; once all are at rounding level the
result is certified. Otherwise the next block is T_m(2 V / c - 1) U, where the Chebyshev polynomial
T_m stays within 1 on [0, c], the unwanted spectrum up to the smallest Ritz value c, and grows fast
above it.

Defined results: vectors that are null or empty, or hold null or non-finite entries (or entries whose
integer has more than 52 bits), are left out, likewise vectors whose length is not the commonest one
(the longest among equally common ones). Directions without variance are no components: their
eigenvalue is under 1e-12 of the largest. With equal vectors only, or in an empty table, there are no
components and no rows. Null or repeated ids pass through; ids and vectors are the only columns
read, so others cannot clash.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.ordering import pinned

#: Integers up to this size are exact in double precision.
LARGEST = 2.0**52
#: Share of the largest eigenvalue below which there is no variance.
NOTHING = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: n vectors, exact sums per dimension, components by falling eigenvalue."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray  # eigenvalues
    vectors: np.ndarray  # dimensions x components
    residual: float  # largest |V u - e u| as a share of the largest eigenvalue

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def integer_vectors(
    embeddings: DataFrame, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(vec_id, y) of the vectors that take part, written once."""
    entries = F.col(embedding).cast("array<double>")
    scaled = F.transform(entries, lambda c: F.floor(c * scale).cast("double"))
    fine = F.forall("y", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))  # NaN compares as largest
    rows = pinned(
        embeddings.select(F.col(vec_id).alias("vec_id"), F.when(_finite(entries), scaled).alias("y"))
        .where((F.size("y") > 0) & fine)
        .select("vec_id", F.transform("y", lambda c: c.cast("bigint")).alias("y"))
    )
    sizes = rows.groupBy(F.size("y").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).first()
    return rows.where(F.size("y") == common.d) if common else rows


def _finite(entries):
    """Floor of an infinite entry is an error, so such rows go before."""
    return F.forall(entries, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    y = batch.column(batch.schema.get_field_index("y"))
    return y.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(rows: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum of the array ``of(y)`` over all blocks of rows; one partial array leaves each task."""
    shape = of(np.zeros((0, d), dtype=np.int64)).shape
    dtype = np.int64 if kind == "bigint" else np.float64

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch, d))
        yield pa.RecordBatch.from_pydict({"at": np.arange(total.size, dtype=np.int32), "value": total.ravel()})

    parts = rows.select("y").mapInArrow(partial, f"at int, value {kind}")
    out = np.zeros(int(np.prod(shape)), dtype)
    for at, value in parts.groupBy("at").agg(F.sum("value")).collect():  # as many rows as the array has entries
        out[at] = value
    return out.reshape(shape)


def _exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """(n, sum of every dimension). High and low halves are added apart, so that neither overflows."""

    def halves(y):
        return np.vstack([(y >> 26).sum(0), (y & (2**26 - 1)).sum(0), np.full(d, len(y))])

    high, low, n = _summed(rows, d, halves, "bigint").tolist()
    return n[0], [(h << 26) + x for h, x in zip(high, low)]


def fit(rows: DataFrame, components: int = 8, block: int = 32, degree: int = 40, rounds: int = 100, seed: int = 0) -> Whitening | None:
    """Components of :func:`integer_vectors`; None when there are no rows.

    ``block`` bounds the thin blocks (it grows with ``components``), ``degree`` the passes of a round.
    """
    first = rows.select(F.size("y").alias("d")).first()
    if first is None:
        return None
    d = first.d
    n, sums = _exact_sums(rows, d)
    mean = np.array([s / n for s in sums])

    def times(q):
        def product(y):
            centred = y - mean
            return centred.T @ (centred @ q)

        return _summed(rows, d, product) / n

    trace = float(_summed(rows, d, lambda y: np.square(y - mean).sum(0)).sum()) / n
    wanted = min(components, d)
    width = min(d, max(block, 2 * components))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    before = np.inf
    for _ in range(rounds):
        vq = times(q)
        h = q.T @ vq
        ritz, turn = np.linalg.eigh((h + h.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        u, vu = q @ turn, vq @ turn
        top = max(ritz[0], 0.0)
        if top == 0:
            return Whitening(n, sums, trace, np.empty(0), np.empty((d, 0)), 0.0)
        residual = np.linalg.norm(vu - u * ritz, axis=0)[:wanted].max() / top
        # certified: at rounding level, or so near that a round no longer brings it nearer
        if residual <= 1e-14 or before / 2 < residual <= 1e-9:
            break
        before = residual
        q = np.linalg.qr(_filtered(times, u, vu, max(ritz[-1], NOTHING * top), top, degree))[0]
    else:
        raise RuntimeError(f"not certified after {rounds} rounds: residual {residual:.1e} of the largest eigenvalue")
    found = int((ritz[:wanted] > NOTHING * top).sum())
    return Whitening(n, sums, trace, ritz[:found], u[:, :found], float(residual))


def _filtered(times, u, vu, cut: float, top: float, most: int) -> np.ndarray:
    """T_m(2 V / cut - 1) u by its three-term recurrence, scaled to stay near 1 at ``top``.

    The degree m lets the gain at ``top`` reach about 1e10, beyond which digits of the others would go.
    """
    m = int(np.clip(np.arccosh(1e10) / np.arccosh(max(2 * top / cut - 1, 1 + 1e-12)), 2, most))
    half = cut / 2
    scale = first = half / (top - half)
    old, new = u, (vu - half * u) * (scale / half)
    for _ in range(m - 1):
        after = 1 / (2 / first - scale)
        old, new = new, (times(new) - half * new) * (2 * after / half) - old * (scale * after)
        scale = after
    return new / np.linalg.norm(new, axis=0)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    mean, projection = model.mean, model.projection

    def squares(y):
        z = (y - mean) @ projection
        return z.T @ z

    found = _summed(rows, len(mean), squares) / model.n
    return float(np.abs(found - np.eye(len(found))).max())


def _deviations(y: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None]:
    """Sum over dimensions of (n y - S)², exact; None from 10**38 on."""
    far = n * int(np.abs(y).max(initial=0)) + max(abs(s) for s in sums)
    if len(sums) * far * far < 2**63:
        exact = (np.square(n * y - np.array(sums, dtype=np.int64))).sum(1).tolist()
    else:
        exact = np.square(y.astype(object) * n - np.array(sums, dtype=object)).sum(1).tolist()
    return [Decimal(v) if v < 10**38 else None for v in exact]


def whiten(rows: DataFrame, model: Whitening | None, error: float | None = None) -> DataFrame:
    """vec_id, component (from 1), n, deviation decimal(38,0), whitened, explained, identity_error.

    ``rows`` are those of :func:`integer_vectors`, or others made the same way.
    """
    schema = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vec_id = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {vec_id}, {schema}"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model) if error is None else error
    mean, projection, n, sums = model.mean, model.projection, model.n, model.sums
    k, explained = len(model.values), model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch, len(mean))
            size = len(y)
            each = np.repeat(np.arange(size), k)
            deviation = pa.array(_deviations(y, n, sums), pa.decimal128(38, 0)) if size else pa.array([], pa.decimal128(38, 0))
            columns = [
                batch.column(batch.schema.get_field_index("vec_id")).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                pa.array(np.full(size * k, n, dtype=np.int64)),
                deviation.take(pa.array(each)),
                pa.array(((y - mean) @ projection).ravel()),
                pa.array(np.tile(explained, size)),
                pa.array(np.full(size * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            )

    return rows.mapInArrow(project, schema)
