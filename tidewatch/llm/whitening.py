"""Whitening of embeddings by their leading principal components, found with LOBPCG.

Entries are read as fixed-point numbers x = floor(256 c), so that equal vectors are equal whatever
their float type. The *fit list* is each distinct x vector once; mean and covariance V are over it.
V is never formed: the solver only needs V times a block of directions, which is one pass over the
centred rows of the fit list,

    V B = sum of (x - mean)' ((x - mean) B) / n,

summed within tasks first, then by dimension. LOBPCG keeps a block of iterates X, the residuals
W = V X - X e and the previous directions P, and takes the Ritz vectors of V on their common span as
the next X (Rayleigh-Ritz). Every product in it comes from a pass of its own, none is carried along, so
residuals don't drift: the last ones certify the result. A block is wider than the components asked for,
as that is what makes close eigenvalues converge; if it doesn't suffice, it is doubled, and a block as
wide as the vectors is a dense solution.

Held by the driver: the mean, the block and its product, a few dozen numbers for each dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_shuffles, table

COMPONENTS = 4
#: Iterates in the block; residuals relative to the largest eigenvalue that count as none; passes before the block is doubled.
WIDTH, EXACT, PASSES = 16, 1e-13, 60
#: An eigenvalue below this share of the largest is none.
FLAT = 1e-12
#: Entries of vectors that a worker holds as doubles at once.
CELLS = 1 << 21


def fixed_point(values: np.ndarray) -> np.ndarray:
    """floor(256 c) as int64, at the ends of its range for what lies beyond."""
    x = np.floor(256.0 * values)
    return np.where(x >= 2.0**63, np.iinfo(np.int64).max, np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) of a list column; a shorter vector has zeros after its end."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(dim, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows whose vector is there and has finite entries only."""
    vec = F.col(vector_col).cast("array<double>")
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.select(F.col(id_col).alias("id"), vec.alias("vec")).where(F.col("vec").isNotNull() & finite)


def packed(x: np.ndarray) -> list[bytes]:
    """A byte string for each vector, equal for equal vectors: two bytes an entry where all fit, else eight."""
    small = (np.abs(x) < 1 << 15).all(axis=1) if x.shape[1] else np.ones(len(x), bool)
    return [(r.astype("<i2") if s else r.astype("<i8")).tobytes() for r, s in zip(x, small, strict=True)]


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for width, kind in ((2, "<i2"), (8, "<i8")):
        at = np.flatnonzero(size == width * dim)
        if len(at) and dim:
            out[at] = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), kind).reshape(-1, dim)
    return out


class Fit:
    """n vectors of the fit list, ``sums`` of each dimension (exact), eigenvalues, unit components as columns, trace of V, identity_error."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.mean = np.array([s / n for s in sums]) if n else np.zeros(len(sums))
        self.values, self.vectors, self.trace = np.zeros(0), np.zeros((len(sums), 0)), 0.0
        self.residuals, self.identity_error, self.passes = np.zeros(0), None, 0


def _sums(fit_list: DataFrame, dim: int) -> Fit:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dim, object)
        for batch in _parts(batches, dim):
            x = unpacked(batch.column(0), dim)
            large = len(x) and dim and int(np.abs(x.astype(float)).max()) * len(x) >= 1 << 62
            n, sums = n + len(x), sums + (x.astype(object) if large else x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([Decimal(int(s)) for s in (n, *sums)], pa.decimal128(38, 0))], ["dim", "s"])

    rows = fit_list.mapInArrow(run, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()  # a row a dimension
    by = {r.dim: int(r.s) for r in rows}
    return Fit(by.get(-1, 0), [by.get(k, 0) for k in range(dim)])


def _product(fit_list: DataFrame, fit: Fit, width: int) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """block -> (V block, diagonal of V), one pass each; ``width`` is the widest block."""
    dim, mean, n = len(fit.sums), fit.mean, fit.n
    names = ["dim", "square", *(f"c{k}" for k in range(width))]

    def apply(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.zeros((dim, width))
        wide[:, : block.shape[1]] = block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, square, some = np.zeros((dim, width)), np.zeros(dim), False
            for batch in _parts(batches, dim):
                x = unpacked(batch.column(0), dim) - mean
                total += x.T @ (x @ wide)
                square += (x * x).sum(axis=0)
                some = True
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(square), *(pa.array(c) for c in total.T)], names)

        shape = "dim int, " + ", ".join(f"{c} double" for c in names[1:])
        rows = fit_list.mapInArrow(run, shape).groupBy("dim").agg(*(F.sum(c).alias(c) for c in names[1:])).collect()  # a row a dimension
        out = np.zeros((dim, width + 1))
        for r in rows:
            out[r.dim] = r[1:]
        fit.passes += 1
        return out[:, 1 : block.shape[1] + 1] / n, out[:, 0] / n

    return apply


def _orthonormal(basis: np.ndarray, more: np.ndarray) -> np.ndarray:
    """``basis`` and what the columns of ``more`` add to it."""
    size = np.linalg.norm(more, axis=0)
    more = more[:, size > 0] / size[size > 0]
    for _ in range(2):
        more = more - basis @ (basis.T @ more)
    if not more.shape[1]:
        return basis
    u, s, _ = np.linalg.svd(more, full_matrices=False)
    more = u[:, s > 1e-7]
    more = more - basis @ (basis.T @ more)
    return np.linalg.qr(np.hstack([basis, more]))[0]


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dim: int, components: int, width: int, passes: int = PASSES, exact: float = EXACT) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(eigenvalues falling, unit vectors, norms of the residuals) of the largest ones, or None where the passes don't suffice.

    Residuals count as none once they are ``exact`` times the largest eigenvalue, or near that and no longer falling.
    """
    x = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, width)))[0]
    w = p = np.zeros((dim, 0))
    seen: list[float] = []
    for _ in range(passes):
        basis = _orthonormal(_orthonormal(x, w), p)
        through = product(basis)
        small = basis.T @ through
        values, c = np.linalg.eigh((small + small.T) / 2)
        values, c = values[::-1][:width], c[:, ::-1][:, :width]
        ritz, image = basis @ c, through @ c
        w = image - ritz * values
        norms = np.linalg.norm(w, axis=0)[:components]
        scale = max(values[0], np.finfo(float).tiny)
        seen.append(float(norms.max() / scale))
        stalled = len(seen) > 5 and seen[-1] <= 1e3 * exact and min(seen[-3:]) > 0.5 * min(seen[:-3])
        if seen[-1] <= exact or stalled or width == dim:
            return values[:components], ritz[:, :components], norms
        p = ritz - x @ (x.T @ ritz)
        x = ritz
    return None


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, width: int = WIDTH) -> Fit:
    """Mean and leading components over the fit list; see ``whiten`` for odd rows."""
    rows = usable(df, id_col, vector_col)
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    if not dim:
        return Fit(0, [])
    scratch = Scratch(df.sparkSession, "whitening")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, dim):
            yield pa.RecordBatch.from_arrays([pa.array(packed(fixed_point(_vectors(batch.column(0), dim))), pa.binary())], ["x"])

    # copies meet in the partial step, so a vector of very many copies is a row a task at most
    fit_list = scratch.write(rows.select("vec").mapInArrow(encode, "x binary").distinct(), "fit")
    found = _sums(fit_list, dim)
    components, block = min(components, dim), min(width, dim)
    diagonal = np.zeros(dim)
    while found.n:
        product = _product(fit_list, found, min(3 * block, dim))
        solved = lobpcg(lambda b, product=product: product(b)[0], dim, components, block)
        if solved is not None:
            found.values, found.vectors, _ = solved
            break
        block = min(2 * block, dim)
    if found.n:
        # largest entry positive, and everything that is certified comes from one more pass
        at = np.abs(found.vectors).argmax(axis=0)
        found.vectors = found.vectors * np.where(found.vectors[at, np.arange(components)] < 0, -1.0, 1.0)
        image, diagonal = product(found.vectors)
        found.values = np.maximum((found.vectors * image).sum(axis=0), 0)
        found.residuals = np.linalg.norm(image - found.vectors * found.values, axis=0)
        found.trace = float(diagonal.sum())
        some = found.values > FLAT * max(found.values[0], np.finfo(float).tiny)
        scaled = found.vectors[:, some] / np.sqrt(found.values[some])
        covariance = scaled.T @ (image[:, some] / np.sqrt(found.values[some]))
        found.identity_error = float(np.abs(covariance - np.eye(some.sum())).max()) if some.any() else None
        found.values = np.where(some, found.values, 0.0)
    scratch.drop("fit")
    free_shuffles(df.sparkSession)
    return found


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None where it is no long."""
    most = (int(np.abs(x.astype(float)).max()) if x.size else 0) * n + max(map(abs, sums), default=0)
    if most * most * max(len(sums), 1) < 1 << 62:
        apart = x * n - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = x.astype(object) * n - np.array(sums, object)
    return [int(v) if v < 1 << 63 else None for v in (apart * apart).sum(axis=1)]


def whiten(df: DataFrame, known: Fit, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each usable row and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows go whose vector is null or holds a null or an entry that isn't finite. A vector shorter than the
    longest has zeros after its end. Repeated rows and null ids stay. A component without variance
    has a null ``whitened``; ``explained`` is null where nothing varies at all, as in a single vector,
    and so is ``identity_error``. ``deviation`` is null where it doesn't fit a long. There are as many
    components as dimensions at most; an empty table gives no rows; other columns are ignored.
    """
    rows = usable(df, id_col, vector_col)
    made = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([rows.schema["id"], *(T.StructField(c, k) for c, k in made)])
    dim, k = len(known.sums), len(known.values)
    flat = known.values <= 0
    scaled = known.vectors / np.sqrt(np.where(flat, 1.0, known.values))
    explained = [float(e / known.trace) if known.trace > 0 else None for e in known.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, dim):
            x, m = fixed_point(_vectors(batch.column(1), dim)), batch.num_rows
            if not (m and k):
                continue
            values = (x - known.mean) @ scaled
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, known.n, np.int64)),
                    pa.array(_deviations(x, known.n, known.sums), pa.int64()).take(pa.array(each)), pa.array(values.ravel(), mask=np.tile(flat, m)),
                    pa.array(explained * m, pa.float64()), pa.array([known.identity_error] * (m * k), pa.float64()),
                ],
                schema.names,
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return whiten(rows, fit(rows))


QUERIES = {"op12_whitening": query}
SQL: dict[str, str] = {}
