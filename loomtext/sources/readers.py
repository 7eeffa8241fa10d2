"""Scans: CSV, strict and lenient JSONL, overrides, checkpoints, and a format-switching case scan."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions.parsing import lenient_label
from loomtext.functions.text import collapse, group_id, padded_id, strip_ends
from loomtext.operators.constraints import ConstraintError, duplicates, enforce
from loomtext.operators.routing import route_folded
from loomtext.operators.selection import with_ordinal
from loomtext.sources import csvblocks
from loomtext.sources.scratch import materialized, path_exists, read_text


#: The batch that a completed row was written with.
BATCH = "ledger_batch"
#: Where a row stands: its file, the start of the part of the file it was read with, and its place in the task that read it.
PLACE = "_place"


def _place() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias(PLACE)


def require_inputs(spark: SparkSession, *paths: str) -> None:
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise ConstraintError(f"inputs that are not there: {missing}")


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = (), with_place: bool = False, split: int | None = None) -> DataFrame:
    """All columns as text; quoted line breaks, doubled quotes and a byte-order mark are understood; empty is not null.

    Large files are read by many tasks (``csvblocks``; ``split`` gives the bytes of a part, Spark's own setting else), and
    files must agree in their header. Only where a file has quotes that do not hold to the rule of that scan does one task
    read each file, which turns a carriage return and line feed inside quotes into a line feed.
    """
    rows, odd = csvblocks.records(spark, path, split)
    if odd.isEmpty():
        return _from_records(rows, required, with_place)
    df = spark.read.csv(path, header=True, encoding="UTF-8", **csvblocks.OPTIONS)
    names = [c.lstrip("\ufeff") for c in df.columns]
    _require_columns(names, required)
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in zip(df.columns, names, strict=True)), *([_place()] if with_place else []))


def _require_columns(names: list[str], required: tuple[str, ...]) -> None:
    missing = [c for c in required if c not in names]
    if missing:
        raise ConstraintError(f"missing columns: {missing}")


def _from_records(rows: DataFrame, required: tuple[str, ...], with_place: bool) -> DataFrame:
    first = F.min_by("record", F.struct("block", "at"))
    heads = rows.groupBy("file").agg(first.alias("head"), F.min(F.struct("block", "at")).alias("top"))
    heads = materialized(heads, "csv-heads")
    texts = [r[0] for r in heads.select("head").distinct().limit(2).collect()]
    if not texts:
        raise ConstraintError("no header in any file")
    if len(texts) > 1:
        raise ConstraintError("files have different headers")
    head = heads.limit(1).select(F.col("head").alias("record"), "file", F.lit(0).alias("block"), F.lit(0).alias("at"))
    width = texts[0].count(",") + 1  # at least as many as there are fields
    cells = [c for c in csvblocks.parse(head, [f"c{k}" for k in range(width)]).drop("file", "block", "at").first()]
    names = [f"_c{k}" if c in (None, "") else c for k, c in enumerate(cells[: 1 + max((k for k, c in enumerate(cells) if c is not None), default=0)])]
    _require_columns(names, required)
    if len(set(names)) < len(names):
        raise ConstraintError(f"column names given twice: {names}")
    tops = heads.select(F.col("file").alias("_f"), "top")
    body = rows.join(F.broadcast(tops) if heads.count() <= csvblocks.MOST_BLOCKS else tops, (F.col("file") == F.col("_f")) & (F.struct("block", "at") == F.col("top")), "left_anti")
    inner = [f"_{k}_" for k in range(len(names))]
    d = csvblocks.parse(body, inner)
    place = F.struct("file", "block", "at").alias(PLACE)
    return d.select(*(F.coalesce(F.col(i), F.lit("")).alias(n) for i, n in zip(inner, names, strict=True)), *([place] if with_place else []))


def line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line): every line with its number from 1 in its file. Counts of a file's parts are summed, no task sees a whole file."""
    lines = spark.read.text(path).select("value", _place()).select("value", f"{PLACE}.*")
    parts = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(parts.withColumn("before", before), ["file", "block"]).select("value", "file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"))


def not_objects(value: Column) -> Column:
    """Lines that are not blank and are not exactly one JSON object.

    A line is put as the first value into an object whose last key is the line's own digest: only if the line is one whole
    value does that object have these two keys. Text behind it, a second value or a bracket that closes too early end the
    outer object, or its syntax, elsewhere. A key that stands twice is no fault (the last counts).
    """
    own = strip_ends(value)
    digest = F.md5(own.cast("binary"))
    around = F.json_object_keys(F.concat(F.lit('{"v":'), own, F.lit(',"'), digest, F.lit('":0}')))
    # Spark's own parser also takes single quotes unless told not to.
    sound = F.from_json(own, "_fault string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_fault", "allowSingleQuotes": "false"})
    one = around.eqNullSafe(F.array(F.lit("v"), digest)) & F.json_object_keys(own).isNotNull() & sound["_fault"].isNull()
    return (own != "") & ~F.coalesce(one, F.lit(False))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True, empty_ok: bool | None = None, with_place: bool = False) -> DataFrame:
    """Rows of a declared schema, stored: the source is read once. Lines that are not one JSON object each are an error that
    names file and line; blank lines (any white space) are passed over. Strict: a source without rows is an error too."""
    s = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = lambda d: d.select(*(F.col(f"r.`{f.name}`").alias(f.name) for f in s.fields), *([PLACE] if with_place else []))
    return _checked_lines(spark, path, lambda d: parsed(d.withColumn("r", F.from_json("value", s))), empty_ok if empty_ok is not None else not strict)


def _checked_lines(spark: SparkSession, path: str, of: Callable[[DataFrame], DataFrame], empty_ok: bool) -> DataFrame:
    """``of`` the lines (value, place) that hold an object, stored in one pass that also counts rows and faults."""
    seen = Observation()
    lines = spark.read.text(path).select("value", _place()).where(strip_ends(F.col("value")) != "").withColumn("_bad", not_objects(F.col("value")))
    lines = lines.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("_bad").alias("bad"))
    out = materialized(of(lines.where("NOT _bad")), "json-lines")
    if seen.get["bad"]:
        bad = line_numbers(spark, path).where(not_objects(F.col("value"))).orderBy("file", "line")
        enforce(bad.select("file", "line", F.substring("value", 1, 80)), "lines that are no JSON object")
    if not seen.get["rows"] and not empty_ok:
        raise ConstraintError(f"no rows in {path}")
    return out


def read_raw_json(spark: SparkSession, path: str, empty_ok: bool = True) -> DataFrame:
    """(json) lines as they are, each one object, for guards and rules that must see which keys a row has."""
    return _checked_lines(spark, path, lambda d: d.select(F.col("value").alias("json")), empty_ok)


def read_overrides(spark: SparkSession, path: str | None, domain: list[str]) -> DataFrame | None:
    """Checked overrides of a JSONL file, or None where no path is given."""
    if path is None:
        return None
    require_inputs(spark, path)
    return check_overrides(read_jsonl(spark, path, "scenario_id string, moral_categories array<string>", empty_ok=True), domain)


def load_document(path: str) -> dict:
    """A small JSON document (a manifest or a state) from any file system that Spark knows."""
    out = json.loads(read_text(SparkSession.active(), path))
    if not isinstance(out, dict):
        raise ConstraintError(f"{path} holds no JSON object")
    return out


def check_overrides(overrides: DataFrame, domain: list[str]) -> DataFrame:
    """(scenario_id, moral_categories) sorted and distinct; empty lists, unknown names and repeated ids are errors."""
    o = overrides.select("scenario_id", F.array_sort(F.array_distinct(F.coalesce("moral_categories", F.array().cast("array<string>")))).alias("moral_categories"))
    enforce(o.where(F.size("moral_categories") == 0).select("scenario_id"), "overrides without categories")
    known = F.array(*(F.lit(d) for d in domain))
    enforce(o.where(F.size(F.array_except("moral_categories", known)) > 0).select("scenario_id"), "overrides with unknown categories")
    enforce(duplicates(o, "scenario_id"), "overrides given twice")
    return o


def read_completed(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The completed rows of all batches; a key that stands twice is an error."""
    df = spark.read.parquet(path)
    df = df.drop(BATCH) if BATCH in df.columns else df
    enforce(duplicates(df, key), "completed keys given twice")
    return df


def nested_or_flat(df: DataFrame, name: str, parent: str) -> Column:
    """A top-level column if there is one, else the field of a nested one."""
    return F.col(name) if name in df.columns else F.col(f"{parent}.{name}")


def read_cases(spark: SparkSession, path: str, source_format: str, prefix: str, with_labels: bool, scenario: str = "scenario", response: str | None = None, label: str = "label") -> DataFrame:
    """Cases with ids, routes and group ids; labels are read only on request, and then nothing else private is."""
    if source_format == "csv":
        raw = read_csv(spark, path, (scenario, response or "excuse"), with_place=True)
        response = response or "excuse"
    elif source_format == "jsonl":
        raw = read_jsonl(spark, path, f"`{scenario}` string, response string, excuse string, `{label}` string", with_place=True)
        raw = raw.withColumn("_response", F.coalesce("response", "excuse"))
        response = "_response"
    else:
        raise ValueError(f"unknown source format {source_format!r}")
    # In the order of files by name and of lines in each, whatever the order in which their parts are read.
    n = raw.count()
    own = with_ordinal(raw, f"{PLACE}.file", f"{PLACE}.block", f"{PLACE}.at").drop(PLACE).withColumn("target_id", padded_id(prefix, F.col("source_idx"), n))
    if with_labels:
        return own.select("target_id", "source_idx", lenient_label(F.col(label)).alias("gold_verdict"))
    text = own.select("target_id", "source_idx", collapse(F.col(scenario)).alias("scenario"), collapse(F.col(response)).alias("excuse"))
    r = route_folded(F.col("scenario"), F.col("excuse"))
    return text.withColumn("input_format", r["input_format"]).withColumn("scenario_group_id", group_id(F.col("scenario")))


def in_stored_order(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet relation with ``ordinal``: the place of each row in the order of its files by name and of the rows in each."""
    rows = spark.read.parquet(path)
    return with_ordinal(rows.select(*rows.columns, _place()), f"{PLACE}.file", f"{PLACE}.block", f"{PLACE}.at", name="ordinal").drop(PLACE)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (path, size, line) in the order of files and places -> (path, size, sha256)."""
    now = digest = None
    held = size = 0

    def done() -> pa.RecordBatch:
        if held < size:
            digest.update(b"\n")  # the file ends with a line feed
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([size]), pa.array([digest.hexdigest()])], ["path", "size", "sha256"])

    for b in batches:
        for path, total, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if path != now:
                if now is not None:
                    yield done()
                now, digest, held, size = path, hashlib.sha256(), -1, total
            else:
                digest.update(b"\n")
            buffer = line.as_buffer()
            digest.update(buffer)
            held += 1 + buffer.size
    if now is not None:
        yield done()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of each file under ``path``, stored. Files are read in blocks by many tasks; the lines of a file
    meet in one task, in order, as SHA-256 asks for, which holds a line at a time."""
    source = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    lines = source.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"), _place())
    dealt = lines.repartition("path").sortWithinPartitions("path", f"{PLACE}.block", f"{PLACE}.at").select("path", "size", "line")
    hashed = materialized(dealt.mapInArrow(_hashed, "path string, size long, sha256 string"), "file-digests")
    # A scan passes over empty files; their names are in the listing that it was planned from.
    same = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    names = spark.createDataFrame([(f,) for f in source.inputFiles()], "name string")
    empty = names.join(hashed.select(same(F.col("path")).alias("_p")), same(F.col("name")) == F.col("_p"), "left_anti")
    return hashed.unionByName(empty.select(F.col("name").alias("path"), F.lit(0).cast("long").alias("size"), F.lit(hashlib.sha256().hexdigest()).alias("sha256")))
