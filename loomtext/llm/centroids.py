"""Centroid clustering of integer vectors with screening by segment norms.

Each vector is cut into segments whose norms are computed once and stored with it; centroids get theirs every round. By
Cauchy-Schwarz the distance of a vector and a centroid is at least the distance of their norms in every segment, so

    |v - c|^2 >= sum over segments of (|v_s| - |c_s|)^2

needs eight numbers in place of 64. A vector's first candidate is the centroid of the lowest bound; its exact distance
screens the others, and only centroids whose bound is not above the best distance so far get an exact integer distance.
Bounds carry a slack for rounding, so a tie is never screened out.

Assigning is a map over the stored vectors; a round moves one row of exact integer sums from each task, never vectors.

Defined results: only vectors of exactly ``dims`` entries, none null, NaN or infinite, are kept; an entry whose scaled
value is beyond 2**27 is an error. A null id is hashed as an empty one. Repeated rows are rows of their own, and where
equal ids compete for a start the smaller vector goes first. With fewer kept vectors than centroids there are that many
centroids; an empty table gives no rows. Columns other than id and vector are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import stored, table
from loomtext.llm.vectors import matrix, scaled, task_sums, usable

DIMS, SCALE, K, ROUNDS, SEGMENTS, SEED = 64, 64, 16, 3, 8, "1"
#: Relative to the squared norms of both sides: many times the rounding of a bound.
SLACK = 1e-12


def segment_norms(x: np.ndarray, segments: int) -> np.ndarray:
    return np.sqrt(np.square(x.astype(np.float64)).reshape(len(x), segments, -1).sum(2))


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row, ties to the smaller number, and how many exact distances that took."""
    own = segment_norms(centroids, segments)
    both = np.square(norms).sum(1)[:, None] + np.square(own).sum(1)[None, :]
    bound = (1 - SLACK) * both - 2 * norms @ own.T
    exact = lambda rows, c: np.square(x[rows] - centroids[c]).sum(1)
    cluster = bound.argmin(1)
    best = exact(slice(None), cluster)
    asked, first = len(x), cluster.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        d = exact(rows, c)
        asked += len(rows)
        won = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        best[rows[won]], cluster[rows[won]] = d[won], c
    return cluster, best, asked


def compressed(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE, segments: int = SEGMENTS) -> DataFrame:
    """(id, x, norms) of the kept vectors, stored: integers and the norms of their segments."""
    v = F.col(vec_col)
    kept = vectors.where((F.size(v) == dims) & usable(v)).select(F.col(id_col).alias("id"), scaled(v, scale).alias("x"))
    width = dims // segments
    norm = lambda s: F.sqrt(F.aggregate(F.slice("x", s * width + 1, width), F.lit(0).cast("long"), lambda n, y: n + y * y).cast("double"))
    return stored(kept.withColumn("norms", F.array(*(norm(s) for s in range(segments)))), "segment-norms")


def starts(vectors: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The vectors of the ``k`` smallest SHA-256 of seed:id, in that order."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def refine(vectors: DataFrame, centroids: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """One round: every centroid that has vectors becomes the floor of their mean."""
    k, dims = centroids.shape

    def summed(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b.column(0), dims)
        cluster, _, _ = nearest(x, matrix(b.column(1), segments), centroids, segments)
        out = np.zeros((k, dims + 1), np.int64)
        np.add.at(out, cluster, np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1))
        return out.ravel()

    sums = task_sums(vectors.select("x", "norms"), summed, k * (dims + 1))
    rows = [sums[c * (dims + 1) : (c + 1) * (dims + 1)] for c in range(k)]
    return np.array([[s // r[-1] for s in r[:-1]] if r[-1] else old.tolist() for r, old in zip(rows, centroids, strict=True)], np.int64)


def assign(vectors: DataFrame, centroids: np.ndarray, segments: int = SEGMENTS) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dims = centroids.shape[1]
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance, _ = nearest(matrix(b.column(1), dims), matrix(b.column(2), segments), centroids, segments)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return vectors.select("id", "x", "norms").mapInArrow(run, f"id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, segments: int = SEGMENTS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of the kept vectors, stored, and the final centroids."""
    if dims % segments:
        raise ValueError("segments must divide a vector evenly")
    kept = compressed(vectors, id_col, vec_col, dims, scale, segments)
    centroids = starts(kept, k, seed)
    if not len(centroids):
        return assign(kept, np.zeros((1, dims), np.int64), segments), centroids
    for _ in range(rounds):
        centroids = refine(kept, centroids, segments)
    return stored(assign(kept, centroids, segments), "assigned"), centroids


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    whole = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a centroid
    of = {r["cluster"]: int(r["s"]) for r in whole}
    rows = [(c, of[c], sum(of.values()), digests[c]) for c in of]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(n: int) -> str:
    return f"""a{n} AS (SELECT rid, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (SELECT v.rid, k.c, CAST(sum((v.x - k.x) * (v.x - k.x)) AS HUGEINT) AS d FROM v JOIN c{n} k ON v.i = k.i GROUP BY v.rid, k.c) GROUP BY rid),"""


OP11_SQL = f"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS (SELECT rid, vec_id, unnest(range(1, 65)) AS i, unnest(x) AS x FROM e),
s AS (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c FROM e),
c0 AS (SELECT s.c, v.i, v.x FROM v JOIN s ON v.rid = s.rid WHERE s.c < 16),
{' '.join(_round(n) + f" c{n + 1} AS (SELECT k.c, k.i, coalesce(CAST(floor(CAST(m.s AS DOUBLE) / m.n) AS BIGINT), k.x) AS x FROM c{n} k LEFT JOIN (SELECT a.c, v.i, sum(v.x) AS s, count(*) AS n FROM a{n} a JOIN v ON a.rid = v.rid GROUP BY a.c, v.i) m ON m.c = k.c AND m.i = k.i)," for n in range(ROUNDS))}
{_round(ROUNDS)}
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT e.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM e JOIN a{ROUNDS} a ON e.rid = a.rid JOIN h ON h.c = a.c
"""
QUERIES = {"op11_centroids": op11_centroids}
ORACLES = {"op11_centroids": OP11_SQL}
