"""Constraints as relations of violations: empty means they hold; ``enforce`` raises otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import strip_ends


class ConstraintError(ValueError):
    pass


def enforce(violations: DataFrame, message: str, shown: int = 10) -> None:
    rows = violations.limit(shown).collect()
    if rows:
        raise ConstraintError(f"{message}: {[tuple(r) for r in rows]}")


def row_count(df: DataFrame, expected: int) -> DataFrame:
    """(expected, found) if they differ; 0 disables."""
    return df.agg(F.count("*").alias("found")).select(F.lit(expected).cast("long").alias("expected"), "found").where((F.col("expected") != 0) & (F.col("expected") != F.col("found")))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_fields(df: DataFrame, key: str, *required: str) -> DataFrame:
    """(key, missing): the names of the required columns that are null or hold white space only."""
    names = F.array_compact(F.array(*(F.when(strip_ends(F.col(c)) == "", F.lit(c)) for c in required)))
    return df.select(key, names.alias("missing")).where(F.size("missing") > 0)


def outside_domain(df: DataFrame, column: str, domain) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*domain))


def present_keys(json: Column, nested: str | None = "input") -> Column:
    """The keys of a JSON object and of one nested object, also those with null values."""
    empty = F.array().cast("array<string>")
    top = F.coalesce(F.json_object_keys(json), empty)
    return F.array_union(top, F.coalesce(F.json_object_keys(F.get_json_object(json, f"$.{nested}")), empty)) if nested else top


def leaked_keys(json: Column, forbidden, nested: str | None = "input") -> Column:
    """Sorted forbidden keys that are present; presence counts, not the value."""
    return F.array_sort(F.array_intersect(present_keys(json, nested), F.array(*(F.lit(f) for f in sorted(forbidden)))))


def leaks(df: DataFrame, json: str, forbidden, nested: str | None = "input") -> DataFrame:
    return df.withColumn("leaked", leaked_keys(F.col(json), forbidden, nested)).where(F.size("leaked") > 0)


def leaked_columns(df: DataFrame, forbidden) -> list[str]:
    return sorted(set(df.columns) & set(forbidden))


#: What no public row may carry: fixed values.
FORBIDDEN = ("label", "gold_verdict", "main duty", "main_duty", "alternate duty", "alternate_duty", "relation", "rationale")


def seed_bank(seeds: DataFrame, fmt: str, size: int = 16) -> DataFrame:
    """(seed_id, problem): a bank has exactly ``size`` rows, unique ids, one format, whole texts that start with Assess."""
    empty = reduce(lambda a, b: a | b, (strip_ends(F.col(c)) == "" for c in ("scenario", "excuse")))
    rules = {"wrong_format": ~F.col("input_format").eqNullSafe(F.lit(fmt)), "empty_input": empty, "not_assess": ~F.coalesce(F.col("skill_description").startswith("Assess"), F.lit(False))}
    bad = reduce(DataFrame.unionByName, (seeds.where(c).select("seed_id", F.lit(n).alias("problem")) for n, c in rules.items()))
    twice = duplicates(seeds, "seed_id").select("seed_id", F.lit("duplicate_id").alias("problem"))
    count = row_count(seeds, size).select(F.format_string("%d rows", "found").alias("seed_id"), F.lit("wrong_size").alias("problem"))
    return bad.unionByName(twice).unionByName(count)


def response_problem(error: Column, status: Column, choices: Column, text: Column) -> Column:
    """What is wrong with a batch response, or null."""
    return (
        F.when(error.isNotNull(), F.lit("error"))
        .when(~status.eqNullSafe(F.lit(200)), F.lit("status"))
        .when(F.coalesce(F.size(choices), F.lit(0)) <= 0, F.lit("no_choices"))
        .when(strip_ends(text) == "", F.lit("blank"))
    )


def positive(**parameters: int) -> None:
    for name, value in parameters.items():
        if value < 1:
            raise ValueError(f"{name} must be positive, not {value}")
