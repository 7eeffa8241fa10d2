"""Grouped counts, confusion, class metrics and roll-ups; each a single aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.parsing import ratio


def domain_counts(df: DataFrame, column: str, domain, *by: str) -> DataFrame:
    """Counts by column (and ``by``) with every value of the domain, zero where there is none."""
    spark = df.sparkSession
    n = df.groupBy(column, *by).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(d,) for d in domain], f"{column} string")
    for b in by:
        names = names.join(df.select(b).distinct(), F.lit(True))
    return names.join(n, [column, *by], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def duplicate_stats(df: DataFrame, group: str, *exact: str) -> DataFrame:
    """One row: distinct groups, rows in groups of more than one, exact duplicates beyond the first."""
    g = df.groupBy(group).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("distinct_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("rows_in_shared_groups")
    )
    e = df.groupBy(*exact).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("long").alias("exact_duplicates"))
    return g.join(F.broadcast(e), F.lit(True))


def accuracy_rollup(df: DataFrame, by: str = "input_format") -> DataFrame:
    """Total, completed, correct and parsed by group and overall (null group); unparsed and pending count as wrong."""
    out = df.rollup(by).agg(
        F.grouping(by).cast("int").alias("overall"),
        F.count("*").alias("total"),
        F.count_if(F.col("completed")).alias("completed"),
        F.count_if(F.col("completed") & F.col("correct")).alias("correct"),
        F.count_if(F.col("completed") & F.col("prediction").isNotNull()).alias("parsed"),
    )
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("total"))).withColumn("parse_rate", ratio(F.col("parsed"), F.col("completed")))


def _cell(gold: int, predicted: int, gold_col: str, predicted_col: str) -> Column:
    return F.count_if((F.col(gold_col) == gold) & (F.col(predicted_col) == predicted))


def confusion(df: DataFrame, gold: str = "gold_verdict", predicted: str = "predicted_verdict") -> DataFrame:
    """One row: gold_0_predicted_0 .. gold_1_predicted_1, zeros kept."""
    return df.agg(*(_cell(g, p, gold, predicted).alias(f"gold_{g}_predicted_{p}") for g in (0, 1) for p in (0, 1)))


def class_metrics(df: DataFrame, gold: str = "gold_verdict", predicted: str = "predicted_verdict") -> DataFrame:
    """(label, precision, recall, f1, support, macro_f1); 0 where there is nothing to divide by."""
    c = confusion(df, gold, predicted)
    rows = []
    for k in (0, 1):
        tp, fp, fn = F.col(f"gold_{k}_predicted_{k}"), F.col(f"gold_{1 - k}_predicted_{k}"), F.col(f"gold_{k}_predicted_{1 - k}")
        p, r = ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0)
        rows.append(F.struct(F.lit(k).alias("label"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), (tp + fn).alias("support")))
    c = c.withColumn("m", F.array(*rows)).withColumn("macro_f1", (F.get("m", F.lit(0))["f1"] + F.get("m", F.lit(1))["f1"]) / 2)
    return c.select(F.explode("m").alias("m"), "macro_f1").select("m.*", "macro_f1")


def accuracy_by(df: DataFrame, by: str = "input_format", domain=None) -> DataFrame:
    """(group, records, accuracy): over a fixed domain with 0.0 for empty groups, or over the observed groups."""
    out = df.groupBy(by).agg(F.count("*").alias("records"), F.avg(F.col("correct").cast("int").cast("double")).alias("accuracy"))
    if domain is None:
        return out
    names = df.sparkSession.createDataFrame([(d,) for d in domain], f"{by} string")
    return names.join(out, by, "left").select(by, F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def summary(df: DataFrame, flags=()) -> DataFrame:
    """One row with records, correct, accuracy, mean gold probability, the confusion and a count of each flag column."""
    cells = [_cell(g, p, "gold_verdict", "predicted_verdict").alias(f"gold_{g}_predicted_{p}") for g in (0, 1) for p in (0, 1)]
    out = df.agg(F.count("*").alias("records"), F.count_if("correct").alias("correct"), F.coalesce(F.avg("gold_probability"), F.lit(0.0)).alias("mean_gold_probability"), *cells, *(F.count_if(F.col(f)).alias(f) for f in flags))
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("records"), 0.0))


def usage_totals(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*(F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long").alias(c) for c in columns))


def format_failures(df: DataFrame, valid: str, order: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(one row with the number of failures, the failing rows' order and key); the rows are a relation, never one value."""
    bad = df.where(~F.coalesce(F.col(valid), F.lit(False))).select(*dict.fromkeys((order, key)))
    return bad.agg(F.count("*").alias("failures")), bad


def report(df: DataFrame, flags=(), domain=None) -> DataFrame:
    """``summary`` with macro-F1 and maps of the metrics by label and by format: one row in all."""
    out = summary(df, flags)
    one = F.struct("precision", "recall", "f1", "support")
    classes = class_metrics(df).agg(F.max("macro_f1").alias("macro_f1"), F.map_from_entries(F.collect_list(F.struct("label", one.alias("m")))).alias("per_label"))
    formats = accuracy_by(df, domain=domain).agg(F.map_from_entries(F.collect_list(F.struct("input_format", F.struct("records", "accuracy").alias("m")))).alias("by_input_format"))
    return out.join(F.broadcast(classes), F.lit(True)).join(F.broadcast(formats), F.lit(True))


def error_codes(jobs: DataFrame) -> DataFrame:
    """(job_key, codes): the distinct error codes of failed jobs."""
    return jobs.where(F.col("status").isin("failed", "expired", "cancelled", "cancelling")).select("job_key", F.explode_outer("error_codes").alias("code")).groupBy("job_key").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def row_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): a digest of a table that does not depend on the order or the number of its files."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def ordered_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a numbered relation: each row is hashed with its number, so that order counts, and the hashes are
    summed, so that rows need not be in order to be read."""
    r = row_digest(df).first()
    return r["rows"], r["digest"]
