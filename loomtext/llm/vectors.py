"""Integer vectors from embedding columns and their exact sums over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers of larger size are an error: squares of their differences would no longer be sure to fit.
MOST = 1 << 27


def usable(vector: Column) -> Column:
    """Neither null nor with null, NaN or infinite entries."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def scaled(vector: Column, scale: int, offset: int = 0) -> Column:
    """floor(scale * entry) + offset of each entry, as array<bigint>."""
    whole = F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    wide = F.exists(vector, lambda c: F.abs(F.lit(float(scale)) * c.cast("double")) > float(MOST))
    said = F.raise_error(F.lit(f"a vector's entry times {scale} is beyond {MOST}")).cast("array<bigint>")
    return F.when(wide, said).otherwise(F.transform(whole, lambda c: c + F.lit(offset)))


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """An Arrow column of full lists of ``dims`` numbers as rows."""
    return np.asarray(col.flatten()).reshape(-1, dims)


def task_sums(df: DataFrame, summed, width: int, integral: bool = True) -> list:
    """Column-wise sums over all rows of ``df``. ``summed`` gives an array of ``width`` numbers for a batch; each task adds
    its own up and emits one row, and Spark sums those by place, so ``width`` numbers reach the driver (0 where no row is).
    """
    kind = np.int64 if integral else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, kind)
        for b in batches:
            if b.num_rows:
                total += summed(b)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, width], pa.int32()), pa.array(total))], ["sums"])

    rows = df.mapInArrow(run, f"sums array<{'bigint' if integral else 'double'}>").select(F.posexplode("sums").alias("at", "x"))
    total = F.sum(F.col("x").cast("decimal(38,0)") if integral else F.col("x"))
    out = [0] * width
    for at, x in rows.groupBy("at").agg(total.alias("x")).collect():
        out[at] = int(x) if integral else x
    return out
