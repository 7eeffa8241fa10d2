"""Embedding whitening by one-sided Jacobi SVD of a blockwise QR factor.

Distinct integer vectors are centred by their exact mean and folded block by block into one triangular factor a task
(R of the last R over the next block); factors are folded again over a few tasks and at last on the driver, where only
``FAN`` triangles arrive. R has the singular values and right vectors of all centred rows, and squares of entries, as a
covariance has them, are never formed. Plane rotations make R's columns orthogonal: their lengths are the singular
values, small ones as accurate as large ones, and the product of the rotations holds the components.

Defined results: vectors that are null or have a null, NaN or infinite entry are dropped, and so are vectors of another
length than most have (of lengths equally frequent the larger counts); an entry whose scaled value is beyond 2**27 is an
error. Repeated rows are rows of the result and one row of the fit. Directions without variance (below 64 units of
rounding of the largest) have no component, so constant vectors, a single one or an empty table give no rows. A
deviation beyond long is null. Columns other than id and vector are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import stored, table
from loomtext.llm.vectors import matrix, scaled, task_sums, usable

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Tasks that fold the factors of all others.
FAN = 32
BLOCK = 4096
ROUNDING = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Whitening:
    """What a fit found: n vectors with per-dimension sums; all singular values, falling; the leading components as columns."""

    n: int
    sums: list[int]
    singular: np.ndarray
    components: np.ndarray

    @property
    def floor(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """Sums less n times ``floor``: 0 to n - 1."""
        return np.array([s % self.n for s in self.sums], np.int64)

    @property
    def deviations(self) -> np.ndarray:
        """Standard deviations along the components."""
        return self.singular[: self.components.shape[1]] / np.sqrt(self.n)

    @property
    def explained(self) -> np.ndarray:
        power = np.square(self.singular)
        return power[: self.components.shape[1]] / power.sum() if len(power) else power

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: the whole part of the mean goes first and exactly."""
        return (x - self.floor).astype(np.float64) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / self.deviations

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sums) ** 2, exact; null beyond long."""
        if not len(x):
            return []
        y, n = x - self.floor, self.n
        if x.shape[1] * (n * (int(np.abs(y).max()) + 1)) ** 2 < 1 << 63:
            return np.square(n * y - self.rest).sum(1).tolist()
        y, r = y.astype(object), self.rest.astype(object)
        return [d if d < 1 << 63 else None for d in ((n * y - r) ** 2).sum(1).tolist()]


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values falling, right vectors as columns) of a square matrix by one-sided rotations.

    A sweep meets every pair of columns once, in rounds of disjoint pairs as in a round-robin tournament. It ends when no
    pair's angle is off by more than rounding.
    """
    d = r.shape[1]
    odd = d % 2  # a column of zeros makes pairs of all
    a = np.concatenate([r, np.zeros((len(r), odd))], axis=1).astype(np.float64)
    v = np.eye(d + odd)
    ring = np.arange(1, d + odd)
    for _ in range(sweeps):
        turned = False
        for k in range(len(ring)):
            order = np.concatenate([[0], np.roll(ring, k)])
            half = len(order) // 2
            p, q = order[:half], order[half:][::-1]
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = np.square(ap).sum(0), np.square(aq).sum(0), (ap * aq).sum(0)
            turn = np.abs(gamma) > 4 * ROUNDING * np.sqrt(alpha) * np.sqrt(beta)
            if not turn.any():
                continue
            turned = True
            p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            for m in (a, v):
                mp, mq = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * mp - s * mq, s * mp + c * mq
        if not turned:
            break
    lengths = np.sqrt(np.square(a).sum(0))[:d]
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:d, order]


def _fold(parts: Iterator[np.ndarray], dims: int) -> np.ndarray:
    """R of all parts one over another, as a square matrix."""
    r = np.zeros((0, dims))
    for x in parts:
        for k in range(0, len(x), BLOCK):
            r = np.linalg.qr(np.concatenate([r, x[k : k + BLOCK]]), mode="r")
    return np.concatenate([r, np.zeros((dims - len(r), dims))])


def triangle(fit: DataFrame, model: Whitening, fan: int = FAN) -> np.ndarray:
    """R of all centred rows of ``fit`` (x)."""
    dims, floor, rest, n = len(model.sums), model.floor, model.rest, model.n

    def row(r: np.ndarray) -> pa.RecordBatch:
        cells = pa.ListArray.from_arrays(pa.array([0, r.size], pa.int32()), pa.array(r.ravel()))
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), cells], ["part", "r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield row(_fold(((matrix(b.column(0), dims) - floor).astype(np.float64) - rest / n for b in batches), dims))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield row(_fold((matrix(b.column(1), dims).reshape(-1, dims) for b in batches), dims))

    # Both dims of a factor travel as one array of dims * dims numbers.
    rs = fit.select("x").mapInArrow(first, "part int, r array<double>")
    rs = rs.repartition(fan, "part").sortWithinPartitions("part").mapInArrow(lambda bs: again(bs), "part int, r array<double>")
    found = sorted(rs.collect(), key=lambda r: r["part"])
    return _fold((np.array(r["r"]).reshape(dims, dims) for r in found), dims)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, int]:
    """((id, x) of the kept rows, stored, and their dimension: 0 if there are none)."""
    v = F.col(vec_col)
    kept = stored(vectors.where(usable(v)).select(F.col(id_col).alias("id"), scaled(v, scale, offset).alias("x"), F.size(v).alias("dims")), "integer-vectors")
    most = kept.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    return kept.where(F.col("dims") == (most["dims"] if most else 0)).select("id", "x"), most["dims"] if most else 0


def fit(distinct: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of stored rows (x), each taken once."""
    summed = lambda b: np.concatenate([[b.num_rows], matrix(b.column(0), dims).sum(0)])
    n, *sums = task_sums(distinct.select("x"), summed, dims + 1)
    model = Whitening(n, sums, np.zeros(0), np.zeros((dims, 0)))
    if n < 2 or not dims:
        return model
    singular, right = jacobi(triangle(distinct, model))
    kept = int((singular > 64 * ROUNDING * singular[0]).sum()) if singular[0] > 0 else 0
    right = right[:, : min(components, kept)]
    sign = np.sign(right[np.abs(right).argmax(0), np.arange(right.shape[1])]) if right.size else np.ones(0)
    return Whitening(n, sums, singular, right * sign)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance less the identity. Their mean is zero but for rounding; it is
    taken off the products all the same."""
    k, dims = model.components.shape[1], len(model.sums)

    def summed(b: pa.RecordBatch) -> np.ndarray:
        w = model.whitened(matrix(b.column(0), dims))
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    total = np.array(task_sums(distinct.select("x"), summed, k + k * k, integral=False), float) / model.n
    mean = total[:k]
    return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, component, deviation, whitened) of rows (id, x): a row for each component."""
    kind, k, dims = rows.schema["id"].dataType.simpleString(), model.components.shape[1], len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows if k else 0, BLOCK):
                part = b.slice(i, BLOCK)
                x = matrix(part.column(1), dims)
                at = pa.array(np.repeat(np.arange(len(x)), k))
                deviation = pa.array(model.deviation(x), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), deviation.take(at), pa.array(model.whitened(x).ravel())], ["id", "component", "deviation", "whitened"])

    return rows.select("id", "x").mapInArrow(run, f"id {kind}, component int, deviation long, whitened double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dims = integer_vectors(table(spark, sf_dir, "embeddings"))
    distinct = stored(rows.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, dims)
    error = identity_error(distinct, model)
    explained = F.array(*(F.lit(float(e)) for e in model.explained)) if len(model.explained) else F.array().cast("array<double>")
    return whiten(rows, model).select(F.col("id").alias("vec_id"), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
