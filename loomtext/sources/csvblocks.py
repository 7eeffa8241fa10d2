"""CSV files read by many tasks, though quoted fields hold line feeds.

Whether a line feed ends a record depends on the number of quotes before it, back to the start of the file. Each task counts
the quotes of its block and numbers, for both answers to "does the block begin inside quotes", the line at which each line's
record begins. Quotes of all blocks before (one row a block, a running sum over a file's blocks) tell which answer holds, and
a record that began in an earlier block is found from that block's last beginning. Lines that are whole records, most of
them, are never moved; only lines of records over several lines meet by their record's beginning.

That holds where a quote only ever opens a field, closes it or is doubled. Every record is checked for that; a file with
another quote, or an open one at its end, is read by one task as ``spark.read.csv`` reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.sources.scratch import materialized

#: How Spark reads a file or a record: fixed settings.
OPTIONS = {"escape": '"', "nullValue": "\u0000", "emptyValue": "", "multiLine": "true"}
#: A record whose quotes open a field, close it or are doubled.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",\r\n]*+)'
SOUND = rf"\A{_FIELD}(?:,{_FIELD})*+\z"
#: Blocks whose numbers may be broadcast.
MOST_BLOCKS = 100_000

_LINES = "value string, file string, block long, at long, quotes long, inside boolean, starts0 long, starts1 long"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (value, file, block) in file order with their place in the block, the quotes they hold, whether an odd number of
    quotes stands before them in the block, and the place where their record begins (-1: in an earlier block) if the block
    begins outside (0) or inside (1) quotes."""
    file = block = None
    at, odd, starts = 0, False, [-1, -1]
    for b in batches:
        files, blocks = b.column(1), b.column(2).to_numpy()
        col = b.column(0)
        offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset).astype(np.int64) if len(col) else np.zeros(1, np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
        upto = np.concatenate([[0], np.cumsum(data == 34)])[offsets]
        changes = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), b.num_rows] if b.num_rows else []
        # Two files follow each other with different names; blocks of one file have different starts.
        names = files.dictionary_encode()
        codes = names.indices.to_numpy()
        changes = sorted({*changes, *(np.flatnonzero(np.diff(codes)) + 1).tolist()}) if b.num_rows else []
        for i, j in zip(changes, changes[1:], strict=False):
            now = (files[i].as_py(), int(blocks[i]))
            if now != (file, block):
                (file, block), at, odd, starts = now, 0, False, [-1, -1]
            quotes = np.diff(upto[i : j + 1])
            inside = (np.concatenate([[0], np.cumsum(quotes)[:-1]]) + odd) % 2 == 1
            place = np.arange(at, at + j - i)
            begun = []
            for h in (0, 1):
                first = np.maximum.accumulate(np.where(inside == bool(h), place, -1))
                begun.append(np.maximum(first, starts[h]))
            yield pa.RecordBatch.from_arrays([col.slice(i, j - i), files.slice(i, j - i), b.column(2).slice(i, j - i), pa.array(place), pa.array(quotes), pa.array(inside), pa.array(begun[0]), pa.array(begun[1])], ["value", "file", "block", "at", "quotes", "inside", "starts0", "starts1"])
            at, odd, starts = at + j - i, bool((odd + int(quotes.sum())) % 2), [int(begun[0][-1]), int(begun[1][-1])]


def _in_blocks(spark: SparkSession, path: str, split: int | None) -> DataFrame:
    """Numbered lines of all files, stored; ``split`` is the size of a block while they are read."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if split:
        spark.conf.set(key, str(split))
    try:
        lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        return materialized(lines.mapInArrow(_numbered, _LINES), "csv-lines")
    finally:
        spark.conf.set(key, before)


def _blocks(lines: DataFrame) -> DataFrame:
    """(file, block, open, began_block, began_at): whether a block begins inside quotes, and the place of the record that is
    then open. Numbers of blocks only, one row each."""
    b = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.max("starts0").alias("last0"), F.max("starts1").alias("last1"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("open", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    own = F.when(F.col("open"), F.col("last1")).otherwise(F.col("last0"))
    last = F.when(own >= 0, F.struct(F.col("block").alias("block"), own.alias("at")))
    b = b.withColumn("began", F.last(last, ignorenulls=True).over(before))
    return b.select("file", "block", "quotes", "open", F.col("began.block").alias("began_block"), F.col("began.at").alias("began_at"))


def _trimmed(record: Column) -> Column:
    """Without the carriage return of its line end."""
    return F.regexp_replace(record, "\r\\z", "")


def records(spark: SparkSession, path: str, split: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((file, block, at, record), (file)): the records of all files by the place of their first line, and the files whose
    quotes do not hold to the rule, whose records are not to be used. Blank lines between records are no records."""
    lines = _in_blocks(spark, path, split)
    blocks = materialized(_blocks(lines), "csv-blocks")
    n = blocks.count()
    few = F.broadcast(blocks) if n <= MOST_BLOCKS else blocks
    d = lines.join(few.drop("quotes"), ["file", "block"])
    begin = F.when(F.col("open"), F.col("starts1")).otherwise(F.col("starts0"))
    d = d.withColumn("inside", F.col("inside") != F.col("open")).withColumn("begin", begin)
    whole = ~F.col("inside") & (F.col("quotes") % 2 == 0)
    single = d.where(whole).select("file", "block", "at", F.col("value").alias("record"))
    earlier = F.col("begin") < 0
    own = d.where(~whole).select("file", F.when(earlier, F.col("began_block")).otherwise(F.col("block")).alias("b"), F.when(earlier, F.col("began_at")).otherwise(F.col("begin")).alias("a"), F.struct("block", "at", "value").alias("line"))
    # The lines of one record meet: as much as the record itself, whatever the file's size.
    joined = own.groupBy("file", F.col("b").alias("block"), F.col("a").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["value"]), "\n").alias("record"))
    out = single.unionByName(joined).withColumn("record", _trimmed(F.col("record")))
    out = out.withColumn("record", F.when((F.col("block") == 0) & (F.col("at") == 0), F.regexp_replace("record", "\\A\ufeff", "")).otherwise(F.col("record")))
    open_ended = blocks.groupBy("file").agg((F.sum("quotes") % 2).alias("odd")).where("odd = 1").select("file")
    out = out.where("record <> ''").withColumn("sound", F.col("record").rlike(SOUND))
    # What one task has read stays in its order; else the place tells.
    out = materialized(out.coalesce(1).sortWithinPartitions("at") if n == 1 else out, "csv-records")
    return out, out.where("NOT sound").select("file").unionByName(open_ended).distinct()


def parse(rows: DataFrame, names: list[str]) -> DataFrame:
    """(file, block, at, one column for each name): null where a record is too short."""
    schema = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(len(names))])
    r = rows.select("file", "block", "at", F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), OPTIONS).alias("_r"))
    return r.select("file", "block", "at", *(F.col(f"_r._{k}").alias(n) for k, n in enumerate(names)))
