"""Sinks: JSONL, atomic documents, guarded and idempotent writes, fan-out, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.constraints import ConstraintError, enforce
from loomtext.operators.joins import ordered_diff, relation_diff
from loomtext.operators.metrics import ordered_digest, row_digest
from loomtext.operators.selection import with_ordinal
from loomtext.sources.readers import file_digests, in_stored_order, load_document
from loomtext.sources.scratch import path_exists, write_text


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Null fields are written; the committer makes the directory appear whole."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_document(document: dict, path: str, sort_keys: bool = True) -> None:
    """A small JSON document on any file system that Spark knows, written beside its place and moved there."""
    write_text(SparkSession.active(), path, json.dumps(document, ensure_ascii=False, indent=2, sort_keys=sort_keys) + "\n")


def append(df: DataFrame, path: str) -> None:
    """Committed whole or not at all."""
    df.write.mode("append").parquet(path)


def ensure_written(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> bool:
    """Writes what is not there yet; what is there must be equal. True if it was written.

    With ``order`` (a key that no two rows share) rows are written in that order, and those that are there must stand in it.
    """
    spark = df.sparkSession
    if not path_exists(spark, path):
        (df.orderBy(*order) if order else df).write.parquet(path)
        return True
    if order:
        there = in_stored_order(spark, path).select("ordinal", *df.columns)
        own = with_ordinal(df, *order, name="ordinal").select("ordinal", *df.columns)
        if ordered_digest(there) != ordered_digest(own):
            enforce(ordered_diff(there, own).orderBy("ordinal").limit(1), f"{path} holds other rows or another order, first at")
        return False
    there = spark.read.schema(df.schema).parquet(path)
    enforce(relation_diff(there.select(*df.columns), df).limit(5), f"{path} holds other rows")
    return False


#: Values whose files one task holds open at once; a task that meets more sorts the rest of its rows.
OPEN_FILES = 64


def fan_out(df: DataFrame, path: str, by: str, mode: str = "errorifexists") -> None:
    """A directory for each value of ``by``; an array column puts a row under each of its elements. Rows go to their files as
    they come, unsorted."""
    if df.schema[by].dataType.typeName() == "array":
        df = df.withColumn("category", F.explode(by))
        by = "category"
    conf, key = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(OPEN_FILES))
    try:
        df.write.mode(mode).partitionBy(by).json(path)
    finally:
        conf.set(key, before)


def override_template(ambiguous: DataFrame) -> DataFrame:
    return ambiguous.select("scenario_id", F.array().cast("array<string>").alias("moral_categories"), F.lit("").alias("notes"))


def manifest(tables: dict[str, DataFrame], inputs: dict[str, str] | None = None, **parameters) -> dict:
    """Counts and content digests of tables, digests of the files of inputs, and the run's parameters; one row a table or
    input file reaches the driver."""
    out = {}
    for name, df in tables.items():
        r = row_digest(df).first()
        out[name] = {"rows": r["rows"], "digest": r["digest"]}
    made = {"tables": out, "parameters": parameters}
    if inputs:
        spark = SparkSession.active()
        made["inputs"] = {n: {r["path"].rsplit("/", 1)[-1]: {"size": r["size"], "sha256": r["sha256"]} for r in file_digests(spark, p).orderBy("path").collect()} for n, p in inputs.items()}
    return made


def resume_manifest(path: str, now: dict) -> dict:
    """Writes the manifest of a new run; that of a resumed run must be the same."""
    spark = SparkSession.active()
    if path_exists(spark, path):
        there = load_document(path)
        if there != json.loads(json.dumps(now)):
            raise ConstraintError("the manifest of the earlier run differs")
        return there
    write_document(now, path)
    return now


def fail_on_ambiguous(ambiguous: DataFrame, allowed: bool = False) -> None:
    """Raises after all outputs are written, unless ambiguous rows are allowed."""
    if not allowed:
        enforce(ambiguous, "rows need review")
