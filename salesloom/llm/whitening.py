"""Whitening of embeddings by shifted Cholesky QR.

Vectors are whole numbers, centred exactly before anything is multiplied. A pass over the centred rows sums their Gram
matrix in each task; its Cholesky factor, shifted the first time, makes the rows more orthogonal through a triangular solve
inside the tasks of the next pass. Passes go on until the rows are orthonormal. The factors multiplied are R of the centred
rows; the singular values and right vectors of R are the components. Only matrices of the vector's length squared reach the
driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from salesloom.session import stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Larger entries have no whole number that fits a long.
LARGEST = 2.0 ** 56
#: Orthonormal enough; no variance at all; most passes.
CLOSE, NOTHING, PASSES = 1e-12, 1e-9, 12
#: Least share of the largest eigenvalue that counts as variance.
FLAT = 1e-26
BLOCK = 4096
EXACT = 1 << 62


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET))


def usable(vector: Column) -> Column:
    """Not null, no null in it, every entry finite and no larger than a long can hold."""
    good = lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False)) & ~F.isnan(c.cast("double"))
    return vector.isNotNull() & F.forall(vector, good)


@dataclass(frozen=True)
class Centre:
    """n vectors with sums S; rows are centred as n*x - S, in whole numbers."""
    n: int
    sums: tuple[int, ...]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: 64-bit numbers where they suffice, else Python's."""
        most = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums))
        if most < EXACT:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n


def matrix_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            yield matrix_of(batch.column("x").slice(at, BLOCK))


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows times the inverse of the upper triangular r, by forward substitution."""
    out = np.empty_like(rows)
    for j in range(r.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def gram(fit: DataFrame, d: int, shape: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of shape(x)^T shape(x), d by d: one partial matrix for each task, summed by entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for x in blocks(batches):
            rows = shape(x)
            total += rows.T @ rows
        for i in range(d):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, i, np.int32)), pa.array(np.arange(d, dtype=np.int32)),
                                              pa.array(total[i])], names=["i", "j", "v"])
    found = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((d, d))
    out[found["i"], found["j"]] = found["v"]
    return (out + out.T) / 2


def centre_of(fit: DataFrame, d: int) -> Centre:
    """Row count and exact sums; the halves of 64-bit numbers are summed apart, so nothing runs over."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for x in blocks(batches):
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high),
                                          pa.array(low)], names=["i", "n", "high", "low"])
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = fit.mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(wide("n"), wide("high"), wide("low"))
    rows = sorted(found.collect())
    return Centre(int(rows[0]["n"]), tuple((int(r["high"]) << 32) + int(r["low"]) for r in rows))


def cholesky(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of g, which is lifted by the shift, and by more until it has one."""
    lift = shift
    while True:
        try:
            return np.linalg.cholesky(g + lift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            lift = max(lift, np.finfo(float).eps * float(np.trace(g)), np.finfo(float).tiny) * 10


def triangular(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R of the centred rows."""
    d, factors = len(centre.sums), []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        rows = centre.rows(x)
        for r in factors:
            rows = solved(rows, r)
        return rows

    product = np.eye(d)
    for turn in range(PASSES + 1):
        g = gram(fit, d, orthogonal)
        w, v = np.linalg.eigh(g)
        if turn and (turn == PASSES or np.all((np.abs(w - 1) < CLOSE * d) | (w < NOTHING))):
            # What is left of a direction without variance is rounding: it is taken out of R.
            return np.linalg.qr((v * np.sqrt(np.where(w < NOTHING, 0.0, w))) @ v.T @ product)[1]
        trace = float(np.trace(g))
        if trace == 0:
            return np.zeros((d, d))
        # The customary shift of the first factor: 11 (m d + d (d + 1)) units of rounding of the squared norm.
        shift = 11 * (centre.n * d + d * (d + 1)) * np.finfo(float).eps / 2 * trace if turn == 0 else 0.0
        r = cholesky(g, shift)
        factors.append(r)
        product = r @ product


@dataclass(frozen=True)
class Whitening:
    """Components as rows, their eigenvalues and shares; zero eigenvalues have no whitened coordinate."""
    centre: Centre
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.values > 0, np.sqrt(self.values), np.nan)
        return self.centre.rows(x) @ self.components.T / scale


def fitted(fit: DataFrame, d: int, most: int = COMPONENTS) -> Whitening:
    """fit: stored, distinct x."""
    centre = centre_of(fit, d)
    _, sizes, right = np.linalg.svd(triangular(fit, centre))
    values = sizes ** 2 / centre.n
    values[values <= FLAT * values.max(initial=0.0)] = 0.0
    total = values.sum()
    share = values / total if total else values
    return Whitening(centre, right[:most], values[:most], share[:most])


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, over components with variance."""
    good = np.flatnonzero(model.values > 0)
    if not len(good):
        return 0.0
    # A column of ones gives the sums beside the products.
    ones = lambda x: np.c_[model.coordinates(x)[:, good], np.ones(len(x))]
    g = gram(fit, len(good) + 1, ones) / model.centre.n
    mean = g[-1, :-1]
    return float(np.abs(g[:-1, :-1] - np.outer(mean, mean) - np.eye(len(good))).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def vectors_of(rows: DataFrame, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """(vec_id, x) of the usable vectors of the length that most of them have; of two such lengths the larger one."""
    good = rows.filter(usable(F.col(vector)))
    length = good.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = length["d"] if length else 0
    return good.filter((F.size(vector) == d) & F.lit(d > 0)).select(F.col(id).cast("long").alias("vec_id"), whole(F.col(vector)).alias("x"))


def whitened(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component up to `most`, in falling order of variance.

    Goes: a vector that is null, holds a null, an entry that is not finite or beyond 2^56 (its whole number fits no long),
    or has another length than most vectors have. Repeated vectors are fitted once, and each row of theirs is returned;
    vec_id may be null or repeated. With fewer than `most` dimensions there are as many components as dimensions. A
    component without variance (all of them for a single vector) has a null coordinate and explains 0. A deviation that
    fits no long is null. Other columns are not read. An empty table gives an empty one.
    """
    vectors = vectors_of(rows)
    first = vectors.first()
    if first is None:
        return rows.sparkSession.createDataFrame([], OUT)
    fit = stored(vectors.select("x").distinct(), "whitening-fit")
    model = fitted(fit, len(first["x"]), most)
    error = identity_error(fit, model)
    parts, k = model.centre, len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                x = matrix_of(part.column("x"))
                each = np.repeat(np.arange(len(x)), k)
                flat = model.coordinates(x).ravel()
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), parts.n)),
                    squared(parts.deviations(x)).take(pa.array(each)), pa.array(flat, mask=np.isnan(flat)),
                    pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(each), error))],
                    names=[c.split()[0] for c in OUT.split(", ")])
    return vectors.mapInArrow(run, OUT)


def squared(deviations: np.ndarray) -> pa.Array:
    """Exact sums of squares; null where none fits a long."""
    if deviations.dtype != object and deviations.shape[1] * int(np.abs(deviations).max(initial=0)) ** 2 < EXACT:
        return pa.array((deviations ** 2).sum(axis=1))
    sums = [sum(int(v) ** 2 for v in row) for row in deviations]
    return pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())
