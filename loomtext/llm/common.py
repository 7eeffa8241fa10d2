"""What the training-data operators share: the shared folder, table reading and materialisation."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.sources.scratch import fresh_path


def stored(df: DataFrame, name: str, compression: str = "zstd", **options: str) -> DataFrame:
    """``df`` written as Parquet (with the writer's ``options``) in the shared folder and read back: lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(spark: SparkSession, least: int = 64) -> int:
    """How many pieces a hashed exchange is cut into: twice the shuffle partitions, at least ``least``."""
    return max(least, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bounds of a side that may be broadcast; beyond either Spark joins by sorting or shuffled hashing.
MOST_ROWS, MOST_BYTES = 500_000, 64 << 20


def _width(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.aggregate(c, F.lit(0), lambda n, x: n + F.octet_length(x) + 16), F.lit(0))
    return F.lit(16)


def small_side(df: DataFrame) -> DataFrame:
    """``df`` (materialised) with a broadcast hint, if its counted rows and bytes are within the bounds."""
    width = reduce(lambda x, y: x + y, (_width(f) for f in df.schema.fields))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= MOST_ROWS and size <= MOST_BYTES else df


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, after which memory that is free is given back to the system: a worker outlives its task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def ascii_lower(c: Column) -> Column:
    """A-Z only, as against ``lower``, which also changes other letters."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Edges that a task of ``connected`` holds at once.
MOST_EDGES = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the edges (a, b): each node but the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        least = np.minimum(root[x], root[y])
        for end in (root[x], root[y]):
            np.minimum.at(root, end, least)
        while (root[root] != root).any():
            root = root[root]
    leaf = root != np.arange(len(nodes))
    return nodes[leaf], nodes[root[leaf]]


def _contract(most: int):
    """Edges (a, b) -> stars of the components that a task's edges form, ``most`` edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, most):
                part = batch.slice(k, most)
                a, b = (np.concatenate([x, part.column(c).to_numpy()]) for c, x in enumerate((a, b)))
                if len(a) >= most:
                    a, b = stars(a, b)
                if len(a) > most // 2:  # what still is large would be gone through again and again
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a = b = np.zeros(0, np.int64)
        a, b = stars(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def connected(edges: DataFrame, name: str = "cc", rounds: int = 60, most: int = MOST_EDGES) -> DataFrame:
    """(node, component) of the graph with rows (a, b) of type long, for each node that is not its component's smallest;
    the component is that smallest node.

    Each task first contracts what it holds of the edge table to stars. While the table as a whole is not one of stars,
    large-star and small-star passes over it follow, and are contracted again; each round is materialised in the shared
    folder, and only the number of nodes that are out of place reaches the driver. A hub with very many neighbours is
    held by aggregation (``min``) and a join that Spark can split, never by a list.
    """

    def both(e):
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e):
        n = both(e)
        m = n.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return n.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e):
        e = e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        m = e.groupBy("a").agg(F.min("b").alias("m"))
        linked = e.join(m, "a")
        return linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(m.select("a", F.col("m").alias("b")))

    def misplaced(e):
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select("b", F.lit(0), F.lit(1)).toDF("node", "up", "down"))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").agg(F.count("*")).first()[0]

    e = edges.select("a", "b")
    for k in range(rounds):
        e = stored(e.mapInArrow(tidy(_contract(most)), "a long, b long"), f"{name}-{k}")
        if not misplaced(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        e = small(large(e).where("a <> b")).where("a <> b").distinct()
    raise RuntimeError("components did not settle")
