"""Strict keyed joins and set comparisons; what breaks a contract is a relation of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators.selection import with_ordinal


def key_set_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys on one side only; empty if the key sets are equal."""
    l, r = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))  # noqa: E741
    both = l.join(r, key, "full_outer").where("_l IS NULL OR _r IS NULL")
    return both.select(key, F.when(F.col("_l").isNull(), "right_only").otherwise("left_only").alias("side"))


def strict_one_to_one(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(joined, violations): each key once on both sides; missing and extra keys and duplicates are violations."""
    diff = key_set_diff(left, right, key).select(F.col(key).cast("string").alias("key"), F.when(F.col("side") == "left_only", "missing").otherwise("extra").alias("problem"))
    for side, df in (("left", left), ("right", right)):
        twice = df.groupBy(key).count().where("count > 1").select(F.col(key).cast("string").alias("key"), F.lit(f"duplicate_{side}").alias("problem"))
        diff = diff.unionByName(twice)
    return left.join(right, key), diff


def strict_lookup(left: DataFrame, source: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(joined, violations): each left row finds one source row; extra source rows are allowed."""
    missing = left.join(source.select(key), key, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit("missing").alias("problem"))
    twice = source.groupBy(key).count().where("count > 1").select(F.col(key).cast("string").alias("key"), F.lit("duplicate_right").alias("problem"))
    return left.join(source, key), missing.unionByName(twice)


def mismatches(joined: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two columns differ although both are filled."""
    return joined.where((F.coalesce(F.col(a), F.lit("")) != "") & (F.coalesce(F.col(b), F.lit("")) != "") & (F.col(a) != F.col(b)))


def contradicted(joined: DataFrame, own: str, declared: str) -> DataFrame:
    """Rows whose declared value is filled and is not their own; an own value that is missing differs too."""
    return joined.where((F.coalesce(F.col(declared), F.lit("")) != "") & ~F.col(declared).eqNullSafe(F.col(own)))


def pending(inputs: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return inputs.join(done.select(*keys), list(keys), "left_anti")


def shared_keys(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys on both sides (null-safe); empty if the sides are disjoint."""
    return a.select(*keys).intersect(b.select(*keys))


def late_labels(predictions: DataFrame, labels: DataFrame, key: str = "target_id") -> DataFrame:
    """Predictions with gold_verdict, correct and gold_probability; labels meet them only here."""
    out = predictions.join(labels.select(key, "gold_verdict"), key)
    gold = F.when(F.col("gold_verdict") == 0, F.col("probability_0")).otherwise(F.col("probability_1"))
    return out.withColumn("correct", F.col("predicted_verdict") == F.col("gold_verdict")).withColumn("gold_probability", gold)


def relation_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the side; empty if the relations are equal as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def ordered_diff(a: DataFrame, b: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, left, right): the places at which two numbered relations hold different rows, as JSON; null where one has
    ended. Empty if they are equal as lists."""
    names = [c for c in a.columns if c != ordinal]
    row = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    l, r = a.select(ordinal, row.alias("left")), b.select(ordinal, row.alias("right"))  # noqa: E741
    return l.join(r, ordinal, "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def batch_results(metadata: DataFrame, output: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata with its output by custom_id, and the violations; sort by ``order`` at the sink."""
    return strict_one_to_one(metadata, output, "custom_id")


def grid(spark, **axes) -> DataFrame:
    """Every combination of the axes in their order, with a task number from 0. An axis is a list of values or a relation of
    one column; its distinct values count. Axes are small by their nature, their product need not be: it is numbered by
    ranges."""
    out = None
    for name, axis in axes.items():
        d = axis.toDF(name) if isinstance(axis, DataFrame) else spark.createDataFrame([(str(x),) for x in axis], f"{name} string")
        d = d.select(F.col(name).cast("string").alias(name)).distinct()
        out = d if out is None else out.join(F.broadcast(d), F.lit(True))
    return with_ordinal(out, *axes, name="task").select(F.col("task").cast("int").alias("task"), *axes)
