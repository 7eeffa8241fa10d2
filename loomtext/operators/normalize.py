"""Rewrite inputs normalised from raw JSON lines, so that present and absent keys are told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.parsing import canonical_type
from loomtext.functions.text import strip_ends
from loomtext.operators.constraints import leaked_keys, present_keys

#: What a source row may hold but a model may not see: fixed values.
PRIVATE = ("label", "gold", "gold_label", "gold_verdict")


def _has(keys: Column, name: str) -> Column:
    return F.array_contains(keys, name)


def present_or_nested(json: Column, name: str, parent: str = "source_reference") -> Column:
    """The top-level value if its key is present, even if null or empty, else the nested one."""
    return F.when(_has(present_keys(json, None), name), F.get_json_object(json, f"$.{name}")).otherwise(F.get_json_object(json, f"$.{parent}.{name}"))


def normalize_inputs(lines: DataFrame, expected: str, dataset: str, json: str = "json", ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(normalised rows, violations) of JSON lines numbered by ``ordinal`` from 0.

    The declared type is input_format, else task_type, else the expected one; the reference is source_idx (else the
    ordinal) with target_id where there is one; forbidden keys that are present are listed, not passed on.
    """
    j = F.col(json)
    keys = F.coalesce(present_keys(j, None), F.array().cast("array<string>"))
    get = lambda name: F.get_json_object(j, f"$.{name}")
    declared = F.when(_has(keys, "input_format"), get("input_format")).when(_has(keys, "task_type"), get("task_type")).otherwise(F.lit(expected))
    idx = F.when(_has(keys, "source_idx"), get("source_idx").try_cast("long")).otherwise(F.col(ordinal).cast("long"))
    d = lines.select(
        F.col(ordinal).cast("long").alias("ordinal"),
        F.lit(dataset).alias("source_dataset"),
        F.struct(idx.alias("source_idx"), get("target_id").alias("target_id")).alias("source_reference"),
        canonical_type(declared).alias("input_format"),
        F.struct(strip_ends(get("scenario")).alias("scenario"), strip_ends(get("excuse")).alias("excuse")).alias("input"),
        leaked_keys(j, PRIVATE, None).alias("private_fields_present_in_source"),
    )
    problem = (
        F.when(~F.col("input_format").eqNullSafe(F.lit(expected)), F.lit("wrong_type"))
        .when((F.col("input.scenario") == "") | (F.col("input.excuse") == ""), F.lit("missing_text"))
    )
    bad = d.select("ordinal", problem.alias("problem")).where("problem IS NOT NULL")
    seen = F.row_number().over(Window.partitionBy("source_reference").orderBy("ordinal"))
    twice = d.select("ordinal", seen.alias("k")).where("k > 1")
    return d, bad.unionByName(twice.select("ordinal", F.lit("duplicate_reference").alias("problem")))
