"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Let A be the centred rows (n x d, far too large for one task). From a unit vector p the process alternates products with A
and its transpose, which are sums over rows and run as one Spark job a step:

    alpha_k u_k = A p_k - beta_(k-1) u_(k-1)          beta_k p_(k+1) = A' u_k - alpha_k p_k

so that A P = U B with an upper bidiagonal B of at most d x d, whose small SVD gives components (P times its right vectors)
and deviations (its singular values over sqrt(n)). Both sides are reorthogonalised in full. The p are d long and stay on the
driver. A u is n long and never stored: every u lies in the range of A, so u_k = A q_k with a d-long q_k, and its overlap with
A p is (A' u_k) p, known without another pass. By default the process runs until the space is exhausted (d steps), which also
finds repeated deviations; where alpha or beta vanishes it begins again with a fresh direction orthogonal to all p. ``tolerance``
lets wide tables stop once the wanted components' residuals fall below it.

A last pass measures residuals and the covariance of the whitened rows. Entries are integers floor(scale * c) + offset; the
sums S are exact, and rows are centred by the whole part of S/n before the rest, so that a large offset costs no digits.

Results: vectors that are null or hold null or non-finite entries take no part, nor do vectors of another length than the most
common (of several: the longest); null ids and repeated rows are kept as rows. Components without variance have no rows, so
one row, or equal rows only, give none, as does an empty table. Entries whose integer would need over 52 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.lineage import cut

LONG = 1 << 63
ROUNDING = float(np.finfo(float).eps)
#: Partial sums that the driver or one task adds up.
FAN_IN = 256
#: Size of a block's matrix.
BLOCK_BYTES = 1 << 19


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: float, offset: int) -> DataFrame:
    """(vec_id, dim, x): floor(scale * c) + offset of each entry c as double, without the vectors that take no part."""
    c = F.col(vector_col).cast("array<double>")
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.when(F.abs(v) < float(1 << 52) / scale, F.floor(v * scale) + offset).otherwise(
        F.raise_error(F.lit("an entry is too large for an integer of 52 bits")).cast("long"))
    return (vectors.where(F.col(vector_col).isNotNull()).where(sound)
            .select(F.col(id_col).alias("vec_id"), F.size(c).alias("dim"), F.transform(c, whole).alias("x")))


def packed(rows: DataFrame) -> DataFrame:
    """(dim, n, ids, x): blocks of n vectors of one length, the matrix as bytes, so that the many passes decode no lists."""
    kind = dict(rows.dtypes)["vec_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                same = batch.filter(pa.array(dims == dim)) if (dims != dim).any() else batch
                size = max(1, BLOCK_BYTES // (8 * max(1, int(dim))))
                for start in range(0, same.num_rows, size):
                    part = same.slice(start, size)
                    n, ids = part.num_rows, part.column("vec_id")
                    x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i8", copy=False)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(dim)], pa.int32()), pa.array([n], pa.int32()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids),
                         pa.array([x.tobytes()], pa.binary())], ["dim", "n", "ids", "x"])

    return rows.mapInArrow(pack, f"dim int, n int, ids array<{kind}>, x binary")


def matrices(batch: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    """The integer matrix of each block of a batch."""
    for x in batch.column("x"):
        yield np.frombuffer(x.as_buffer(), "<i8").reshape(-1, dim)


def summed(blocks: DataFrame, dim: int, kind: str, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Sum over all blocks of an array each. A task adds up its blocks and hands on one row; beyond ``FAN_IN`` tasks those
    are added up in tasks first."""
    arrow = pa.list_(pa.int64() if kind == "long" else pa.float64())

    def added(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], arrow)], ["s"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(of_block(x) for batch in batches for x in matrices(batch, dim))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(np.array(s) for batch in batches for s in batch.column("s").to_pylist())

    parts = blocks.select("x").mapInArrow(first, f"s array<{kind}>")
    tasks = blocks.rdd.getNumPartitions()
    if tasks > FAN_IN:
        parts = parts.repartition(-(-tasks // FAN_IN)).mapInArrow(second, f"s array<{kind}>")
    found = [np.array(r["s"]) for r in parts.collect()]
    return sum(found[1:], found[0]) if found else None


@dataclass
class Centred:
    """Blocks of vectors x of one length with exact sums S; ``of`` gives x - S/n."""

    blocks: DataFrame
    dim: int
    n: int
    sums: np.ndarray

    def __post_init__(self):
        self.id_kind = dict(self.blocks.dtypes)["ids"][len("array<"):-1]
        self.whole = np.array([int(s) // self.n for s in self.sums], np.int64)
        self.rest = np.array([int(s) % self.n for s in self.sums], np.int64)

    def of(self) -> Callable[[np.ndarray], np.ndarray]:
        whole, part = self.whole, self.rest / self.n
        return lambda x: (x - whole).astype(float) - part

    def products(self, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """With Y = A directions: A' Y, Y' Y and the sum of squares of A, in one pass."""
        centre, d, m = self.of(), self.dim, directions.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            a = centre(x)
            y = a @ directions
            return np.concatenate([(a.T @ y).ravel(), (y.T @ y).ravel(), [np.einsum("nd,nd->", a, a)]])

        total = summed(self.blocks, d, "double", part)
        return total[:d * m].reshape(d, m), total[d * m:-1].reshape(m, m), float(total[-1])


def centred(blocks: DataFrame) -> Centred | None:
    """Sums over the vectors of the most common length; ``blocks`` should be a written table, as every step reads it."""
    lengths = blocks.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if lengths is None or not lengths["dim"]:
        return None
    dim, n = lengths["dim"], lengths["n"]
    same = blocks.where(F.col("dim") == dim)

    def halves(x: np.ndarray) -> np.ndarray:
        """Sums of the upper and the lower 26 bits, so that no sum overflows 64 bits."""
        return np.concatenate([(x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)])

    s = summed(same, dim, "long", halves)
    return Centred(same, dim, n, np.array([(int(h) << 26) + int(low) for h, low in zip(s[:dim], s[dim:])], object))


def _fresh(rng: np.random.Generator, dim: int, p: list[np.ndarray]) -> np.ndarray:
    """A unit vector orthogonal to all p."""
    return _against(rng.standard_normal(dim), p, unit=True)


def _against(v: np.ndarray, p: list[np.ndarray], unit: bool = False) -> np.ndarray:
    """v without its part along the p (twice, so that rounding leaves nothing)."""
    if p:
        basis = np.stack(p)
        for _ in range(2):
            v = v - basis.T @ (basis @ v)
    return v / np.linalg.norm(v) if unit else v


def bidiagonalise(a: Centred, wanted: int, tolerance: float = 0.0, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """(deviations of the sums, components as columns, residual of the next step): singular values and right vectors of A."""
    rng = np.random.default_rng(seed)
    d = a.dim
    alpha, beta = [], []  # B's diagonal and the diagonal above it
    p, q, back = [], [], []  # p_k; u_k = A q_k; A' u_k
    step, largest, left = _fresh(rng, d, p), 0.0, 0.0
    for k in range(d):
        p.append(step)
        lead = beta[-1] if beta else 0.0
        direction = step.copy()
        for j, z in enumerate(back):  # full reorthogonalisation of A p_k against all u_j
            if z is not None:
                direction -= (z @ step) * q[j]
        z, y, _ = a.products(direction[:, None])
        norm = float(np.sqrt(max(y[0, 0], 0.0)))
        largest = max(largest, norm, lead)
        if norm <= d * ROUNDING * largest or not largest:
            alpha.append(0.0)  # A p_k lies in the range already seen: there is no new u
            q.append(None)
            back.append(None)
            following, left = None, 0.0
        else:
            alpha.append(norm)
            q.append(direction / norm)
            back.append(z[:, 0] / norm)
            following = _against(back[-1] - norm * step, p)
            left = float(np.linalg.norm(following))
        if k == d - 1:
            break
        if following is None or left <= d * ROUNDING * largest:
            beta.append(0.0)
            step = _fresh(rng, d, p)
            continue
        if tolerance and k + 1 >= wanted:
            u, s, _ = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
            if np.all(left * np.abs(u[-1, :wanted]) <= tolerance * s[0]):
                break
        beta.append(left)
        step = following / left
    _, s, vt = np.linalg.svd(np.diag(alpha) + np.diag(beta[:len(alpha) - 1], 1))
    return s, np.stack(p).T @ vt.T, left if len(alpha) < d else 0.0


@dataclass
class Whitener:
    """What whitening needs of the fit list, all of it d x components at most."""

    data: Centred
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    residual: float

    def rows(self) -> DataFrame:
        """(vec_id, component, n, deviation, whitened, explained, identity_error), one row per vector and component."""
        a, centre = self.data, self.data.of()
        turn = self.components / np.sqrt(self.eigenvalues)
        n, whole, rest, dim, m = a.n, a.whole, a.rest, a.dim, len(self.eigenvalues)
        explained, error = self.eigenvalues / self.trace, self.identity_error

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x, ids in zip(matrices(batch, dim), batch.column("ids")):
                    size = len(x)
                    each = pa.array(np.repeat(np.arange(size), m))
                    yield pa.RecordBatch.from_arrays(
                        [ids.values.take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)), pa.array(np.full(size * m, n, np.int64)),
                         _exact_squares(x - whole, n, rest).take(each), pa.array((centre(x) @ turn).ravel()),
                         pa.array(np.tile(explained, size)), pa.array(np.full(size * m, error))],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return a.blocks.mapInArrow(run, f"vec_id {a.id_kind}, component int, n long, deviation decimal(38,0), whitened double, "
                                        "explained double, identity_error double")


def _exact_squares(x: np.ndarray, n: int, rest: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n * x - rest)^2 without rounding; Python's integers where 64 bits don't hold it."""
    most = float(n) * (float(np.abs(x).max(initial=0)) + 1.0)
    if x.shape[1] * most * most < LONG / 2:
        delta = x * n - rest
        return pa.array(np.einsum("nd,nd->n", delta, delta)).cast(pa.decimal128(38, 0))
    delta = x.astype(object) * n - rest.astype(object)
    return pa.array([int(t) for t in (delta * delta).sum(axis=1)], pa.decimal128(38, 0))


def fit(blocks: DataFrame, components: int = 8, tolerance: float = 0.0) -> Whitener | None:
    """Components of the vectors' covariance (divisor n); None where nothing varies."""
    a = centred(blocks)
    if a is None:
        return None
    deviations, vectors, _ = bidiagonalise(a, min(components, a.dim), tolerance)
    varied = int((deviations > a.dim * ROUNDING * np.sqrt(a.n) * max(deviations[0], 0.0)).sum()) if deviations[0] > 0 else 0
    m = min(components, varied)
    if not m:
        return None
    v = vectors[:, :m] / np.linalg.norm(vectors[:, :m], axis=0)
    back, gram, squares = a.products(v)
    falling = np.argsort(-np.diag(gram), kind="stable")
    v, back, gram = v[:, falling], back[:, falling], gram[np.ix_(falling, falling)]
    eigen = np.diag(gram) / a.n
    scale = np.sqrt(np.outer(eigen, eigen))
    error = float(np.abs(gram / a.n / scale - np.eye(m)).max())
    residual = float(np.abs(back / a.n - v * eigen).max() / eigen[0])
    return Whitener(a, v, eigen, squares / a.n, error, residual)


def whitened(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0,
             offset: int = 100_000, tolerance: float = 0.0) -> DataFrame:
    """Every vector on the strongest components, each with variance one; see ``Whitener.rows``."""
    rows = integer_rows(vectors, id_col, vector_col, scale, offset)
    fitted = fit(cut(packed(rows)), components, tolerance)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation decimal(38,0), "
                                                        "whitened double, explained double, identity_error double")
    return fitted.rows()
