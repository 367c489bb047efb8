"""Embedding whitening by shifted CholeskyQR.

Entries are counted in steps of a 64th, so that sums are exact integers: a vector
c becomes x = floor(64 c) + 1000000.  The fit list holds each distinct x once, and
its rows are centred exactly: n x - S is an integer, divided by n only at the end.

The centred rows A are never held together.  A pass over them gives the Gram
matrix of A R^-1, where R is the product of the triangular factors so far and each
task solves its rows against R; the sum of the tasks' matrices is factored by
Cholesky and joins R.  The first pass is shifted (a multiple of rounding is added
to the diagonal), so that it cannot break down; each further pass works on rows
that are nearer to orthogonal, and passes end when the Gram matrix is the identity
to rounding.  The singular value decomposition of R (as wide as a vector is long,
on the driver) then gives the principal axes of A and their lengths, without the
loss of half the digits that the Gram matrix of A itself would bring.  Where the
rows do not span all dimensions, further passes are shifted too, and what is left
of the last Gram matrix is taken into R by its square root.

What reaches the driver is one square matrix a pass, as wide as a vector is long;
what tasks send is one such matrix each, and a task reads many more rows than the
matrix has, so a pass moves little beside its input.

Defined cases: rows with a null vector, or with null or non-finite entries, are
left out; so are shorter vectors than the longest, whose missing entries count as
null, and entries too large for a long.  Null ids are carried.  Repeated rows are
returned each, and count once in the fit.  Directions without variance (less than
RANK of the whole) have no whitened value and no component, so equal vectors, a
single one or an empty table give no rows.  Axes of equal variance are some basis
of their plane.  ``deviation`` is null where it exceeds a long.  Other columns,
whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import cut

STEPS, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Share of the whole variance below which a direction counts as none.
RANK = 1e-20
#: Passes of CholeskyQR at most; three serve vectors that span all dimensions.
PASSES = 8
#: Rows that a task multiplies at a time.
_ROWS = 4096


def stepped(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", steps: int = STEPS, shift: int = SHIFT) -> DataFrame:
    """vec_id and x (array of longs) of the rows that take part."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    size = F.lit(2.0**52)
    usable = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * steps) < size))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0) & usable)
    longest = rows.agg(F.max(F.size("c"))).first()[0] or 0
    return rows.where(F.size("c") == longest).select("vec_id", F.transform("c", lambda v: F.floor(v * steps) + shift).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: 64-bit integers where they suffice, Python's own where not."""
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums.tolist()), default=0)
    return x * n - sums if most < 1 << 62 else x.astype(object) * n - sums.astype(object)


def _gram(rows: DataFrame, to_rows, width: int) -> np.ndarray:
    """Sum over all rows of the products of their entries; ``to_rows`` turns a matrix of x into the rows meant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = _matrix(b.column(0), width)
            for i in range(0, len(x), _ROWS):
                a = to_rows(x[i : i + _ROWS])
                total += a.T @ a
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.select("x").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((width, width))
    for i, row in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r")).select("i", "r.v").collect():
        out[i] = row
    return (out + out.T) / 2


class Whitening:
    """Number of fitted vectors, their sums, and the components that were found."""

    def __init__(self, n: int, sums: np.ndarray, axes: np.ndarray, variances: np.ndarray, trace: float):
        self.n, self.sums, self.axes, self.variances, self.trace = n, sums, axes, variances, trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (_centred(x, self.n, self.sums) / self.n).astype(np.float64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """The rows' projections on the components, each with variance one over the fit list."""
        return (self.centred(x) @ self.axes) / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2 as exact integers."""
        c = _centred(x, self.n, self.sums)
        if c.dtype != object and float(np.abs(c).max(initial=0)) ** 2 * c.shape[1] >= 2.0**62:
            c = c.astype(object)
        return [d if d < 1 << 63 else None for d in (c * c).sum(1).tolist()]


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors ``fit_list.x``, by falling variance; None where there are none."""
    found = fit_list.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    if not found:
        return None
    width, n = len(found), found[0]["n"]
    sums = np.zeros(width, object)
    for r in found:
        sums[r["i"]] = int(r["s"])
    if all(-(1 << 62) < s < 1 << 62 for s in sums):
        sums = sums.astype(np.int64)
    eps, identity, total = np.finfo(np.float64).eps, np.eye(width), np.eye(width)
    size = None
    for k in range(PASSES):
        factor = total

        def solved(x: np.ndarray, r: np.ndarray = factor) -> np.ndarray:
            # Rows q with q R = a, by substitution from the first column on.
            q = (_centred(x, n, sums) / n).astype(np.float64)
            for j in range(width):
                q[:, j] = (q[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
            return q

        g = _gram(fit_list, solved, width)
        size = float(np.trace(g)) if size is None else size
        if size == 0:
            return None
        values, vectors = np.linalg.eigh(g)
        near_identity = np.abs(g - identity).max() < 1e-10
        # Rows that do not span all dimensions settle at a projector instead.
        settled = k > 1 and np.minimum(np.abs(values - 1), np.abs(values)).max() < 1e-6
        if near_identity or settled or k == PASSES - 1:
            total = (np.sqrt(np.clip(values, 0, None))[:, None] * vectors.T) @ total
            break
        wide = values[-1]
        shift = 0.0 if values[0] > 100 * width * eps * wide and k else 11 * (width * n + width * (width + 1)) * eps * wide
        total = np.linalg.cholesky(g + min(shift, 1e-4 * wide) * identity).T @ total
    _, lengths, axes = np.linalg.svd(total)
    variances = lengths**2 / n
    trace = float(variances.sum())
    held = [i for i in range(min(components, width)) if variances[i] > RANK * trace]
    axes = axes[held].T
    # One sign for all rows: the largest entry of an axis is positive.
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(held))])
    return Whitening(n, sums, np.ascontiguousarray(axes), variances[held], trace)


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity."""
    width, k = len(model.sums), len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for b in batches:
            x = _matrix(b.column(0), width)
            for i in range(0, len(x), _ROWS):
                total += model.whiten(x[i : i + _ROWS]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], ["i", "v"])

    mean = np.zeros(k)
    for i, v in fit_list.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
        mean[i] = v / model.n

    def padded(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), width))
        out[:, :k] = model.whiten(x) - mean
        return out

    covariance = _gram(fit_list, padded, width)[:k, :k] / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per row that takes part and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = cut(stepped(vectors, vec_id, vector))
    fit_list = cut(rows.select("x").distinct())
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(fit_list, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, width, shares = identity_error(fit_list, model), len(model.sums), (model.variances / model.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                part = b.slice(i, _ROWS)
                x = _matrix(part.column("x"), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(model.deviations(x), pa.int64()), pa.array(list(model.whiten(x)), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"],
                )

    projected = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, "vec_id long, deviation long, w array<double>")
    explained = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("component"))
    return (
        projected.select("vec_id", "deviation", F.posexplode("w").alias("p", "whitened"))
        .withColumn("component", F.col("p") + 1)
        .select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
