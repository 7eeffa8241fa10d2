"""Resumable incremental scoring, as batches and as a stream over arriving files.

The completed rows are a table of batches (``ledger_batch``). A run over whole inputs leaves out the keys that are there and
adds a batch. A stream never looks at what it has written: repeated keys are left out by the engine's own keyed state, a
micro-batch that is run again overwrites its own batch, and only keys that were completed before the stream began are looked
up, in those pieces of a table dealt by key hash that the micro-batch's keys fall into.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.joins import pending
from loomtext.operators.metrics import row_digest
from loomtext.sources.readers import BATCH, read_completed
from loomtext.sources.scratch import child_names, path_exists

#: Pieces of the table of keys that were completed before a stream began.
PIECES = 64


def run_pending(inputs: DataFrame, path: str, key: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores inputs whose key is not among the completed ones and adds them; the scorer is not called if none is."""
    spark = inputs.sparkSession
    todo = pending(inputs, read_completed(spark, path, key), key) if path_exists(spark, path) else inputs
    if not todo.isEmpty():
        _write_batch(score(todo), path, f"run-{uuid.uuid4().hex}")
    return read_completed(spark, path, key)


def _write_batch(rows: DataFrame, path: str, name: str) -> DataFrame:
    """The rows as batch ``name``, which a second call replaces, and a line of the ledger: (ledger_batch, rows, digest)."""
    place = f"{path}/{BATCH}={name}"
    rows.write.mode("overwrite").parquet(place)
    own = rows.sparkSession.read.schema(rows.schema).parquet(place)
    row_digest(own).coalesce(1).write.mode("overwrite").parquet(f"{path}/_ledger/{BATCH}={name}")
    return own


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(ledger_batch, rows, digest): a line for each completed batch; progress is read here, not from the rows."""
    return spark.read.schema(f"rows long, digest string, {BATCH} string").parquet(f"{path}/_ledger")


def _piece(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PIECES)).cast("int")


def _before(spark: SparkSession, path: str, key: str, own: str, place: str) -> str | None:
    """Where the keys of batches that are not this stream's are dealt by hash: written once, when the stream begins."""
    if not path_exists(spark, f"{place}/_SUCCESS"):
        others = [n for n in child_names(spark, path) if n.startswith(f"{BATCH}=") and not n.startswith(f"{BATCH}={own}")]
        if not others:
            return None
        keys = spark.read.parquet(*(f"{path}/{n}" for n in others)).select(key).withColumn("_piece", _piece(F.col(key)))
        keys.repartition("_piece").write.mode("overwrite").partitionBy("_piece").parquet(place)
    return place


def stream_scores(spark: SparkSession, source: str, schema, checkpoint: str, path: str, key: str, score: Callable[[DataFrame], DataFrame], refresh: Callable[[DataFrame], None] | None = None, files_per_batch: int | None = None) -> None:
    """The same over files that arrive in ``source``: all that is there is scored, once, and the run ends.

    What a micro-batch reads does not grow with what is done. ``refresh`` gets all completed rows after each, unread: what
    it counts can be had from the ledger for less. Runs over whole inputs may come before a stream (by its checkpoint), not
    while it goes on.
    """
    own = f"stream-{hashlib.md5(checkpoint.encode()).hexdigest()[:12]}-"
    earlier = _before(spark, path, key, own, f"{checkpoint}/earlier-keys")

    def one(batch: DataFrame, number: int) -> None:
        if earlier:
            batch = batch.withColumn("_piece", _piece(F.col(key))).persist()
            pieces = [r[0] for r in batch.select("_piece").distinct().collect()]  # at most PIECES numbers
            done = spark.read.parquet(earlier).where(F.col("_piece").isin(pieces)).select(key)
            todo = pending(batch.drop("_piece"), done, key)
        else:
            todo = batch
        _write_batch(score(todo), path, f"{own}{number:08d}")
        if earlier:
            batch.unpersist()
        if refresh:
            refresh(spark.read.parquet(path).drop(BATCH))

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    # Keys are held on disk, not in executor memory.
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = reader.parquet(source).dropDuplicates([key])
        q = rows.writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
