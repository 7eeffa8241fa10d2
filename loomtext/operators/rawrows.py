"""Rows of raw JSON lines whose keys are looked at row by row.

Each line becomes one VARIANT, which tells three cases apart without a schema: a key that is absent, one that holds null, and
one that holds an empty value. A key that is there wins even if its value is null; only an absent one is looked up in the
nested object. Every rule is a Column expression over that VARIANT, so a line is parsed once.

Defined results: an object with the same key twice has no VARIANT and is the violation ``no_object``, as is anything that is
not one object; null, ``""``, 0, false, ``[]`` and ``{}`` are all empty as text; a nested value that is no object counts as
absent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import strip_ends
from loomtext.operators.normalize import PRIVATE

#: Top-level names of a label, the first that is filled counts: fixed values.
LABELS = ("gold_verdict", "label", "gold", "gold_label")
REFERENCE = "source_reference"


def parsed(lines: DataFrame, json: str = "json", name: str = "_v") -> DataFrame:
    """``lines`` with the VARIANT of each, null where a line is not one object."""
    v = F.try_parse_json(F.col(json))
    return lines.withColumn(name, F.explode(F.array(F.when(F.schema_of_variant(v).startswith("OBJECT"), v))))


def at(v: Column, *path: str) -> Column:
    """The value at a path as VARIANT: SQL null if absent, a VARIANT null if it holds null."""
    return F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path), "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def present_or_nested(v: Column, name: str, parent: str = REFERENCE) -> Column:
    """The row's own value if its key is there, whatever it holds, else the nested object's."""
    return F.when(at(v, name).isNotNull(), at(v, name)).when(is_object(at(v, parent)), at(v, parent, name))


def nested_or_row(v: Column, parent: str = "input") -> Column:
    """The nested object if there is one, else the row itself."""
    return F.when(is_object(at(v, parent)), at(v, parent)).otherwise(v)


def text(v: Column) -> Column:
    """Stripped text; whatever is empty, zero or false is ''."""
    s = F.try_variant_get(v, "$", "string")
    empty = s.isNull() | s.isin("false", "[]", "{}") | F.coalesce(s.try_cast("double") == 0, F.lit(False))
    other = F.when(empty, "").when(s == "true", "True").otherwise(s)
    return F.when(F.coalesce(kind(v) == "STRING", F.lit(False)), strip_ends(s)).otherwise(strip_ends(other))


def first_text(*values: Column) -> Column:
    """The first text that is not empty, else ''."""
    return F.coalesce(*(F.nullif(text(v), F.lit("")) for v in values), F.lit(""))


def is_blank(v: Column) -> Column:
    """Absent, null or the empty string."""
    return v.isNull() | F.is_variant_null(v) | F.coalesce((kind(v) == "STRING") & (F.try_variant_get(v, "$", "string") == ""), F.lit(False))


def integer(v: Column) -> Column:
    """A whole number from a number (its fraction is cut off), true or false, or the digits of a text; else null."""
    s = strip_ends(F.try_variant_get(v, "$", "string"))
    of_text = F.when(s.rlike(r"^[+-]?[0-9]+$"), F.regexp_replace(s, "^\\+", "").try_cast("bigint"))
    return F.when(kind(v) == "STRING", of_text).when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint")).otherwise(F.try_variant_get(v, "$", "bigint"))


def held_keys(v: Column, names) -> Column:
    """Sorted names that are keys of the row or of its nested input, also if they hold null."""
    there = lambda n: at(v, n).isNotNull() | (is_object(at(v, "input")) & at(v, "input", n).isNotNull())
    return F.array_compact(F.array(*(F.when(there(n), F.lit(n)) for n in sorted(names))))


#: What can be wrong with a line of each kind.
SKILL_PROBLEMS = ("no_object", "no_source_idx", "bad_source_idx", "no_target_id", "incomplete", "leaks_labels")
LABEL_PROBLEMS = ("no_object", "no_source_idx", "no_label", "bad_label")
EXEMPLAR_PROBLEMS = ("no_object", "no_source_idx", "no_scenario_id", "incomplete")


def has_problem(name: str) -> Column:
    return F.array_contains("problems", name)


def _problems(**rules: Column) -> Column:
    """Names of the rules that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))


def skill_rows(lines: DataFrame, json: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """(source_idx, target_id, input_format, scenario, excuse, skill_description, leaked, problems) of skill lines, and the
    columns to keep."""
    d = parsed(lines, json)
    v, own = F.col("_v"), nested_or_row(F.col("_v"))
    d = d.select(
        *keep,
        v.isNull().alias("_none"),
        is_blank(present_or_nested(v, "source_idx")).alias("_no_idx"),
        integer(present_or_nested(v, "source_idx")).alias("source_idx"),
        F.when(~is_blank(present_or_nested(v, "target_id")), text(present_or_nested(v, "target_id"))).alias("target_id"),
        text(at(v, "input_format")).alias("input_format"),
        text(at(own, "scenario")).alias("scenario"),
        text(at(own, "excuse")).alias("excuse"),
        text(at(v, "skill_description")).alias("skill_description"),
        held_keys(v, PRIVATE).alias("leaked"),
    )
    empty = reduce(lambda a, b: a | b, (F.col(c) == "" for c in ("scenario", "excuse", "skill_description")))
    found = ~F.col("_none")
    problems = _problems(no_object=F.col("_none"), no_source_idx=found & F.col("_no_idx"), bad_source_idx=found & ~F.col("_no_idx") & F.col("source_idx").isNull(), no_target_id=found & F.col("target_id").isNull(), incomplete=found & (empty | ~F.col("input_format").isin("request", "duty_role")), leaks_labels=F.size("leaked") > 0)
    return d.withColumn("problems", problems).drop("_none", "_no_idx")


def label_rows(lines: DataFrame, json: str = "json") -> DataFrame:
    """(source_idx, label_target_id, gold_verdict, problems) of label lines."""
    d = parsed(lines, json)
    v = F.col("_v")
    first = F.coalesce(*(F.when(~is_blank(at(v, n)), at(v, n)) for n in LABELS))
    value = integer(first)
    d = d.select(v.isNull().alias("_none"), integer(present_or_nested(v, "source_idx")).alias("source_idx"), text(present_or_nested(v, "target_id")).alias("label_target_id"), F.when(value.isin(0, 1), value).cast("int").alias("gold_verdict"), first.isNull().alias("_no_label"))
    found = ~F.col("_none")
    problems = _problems(no_object=F.col("_none"), no_source_idx=found & F.col("source_idx").isNull(), no_label=found & F.col("_no_label"), bad_label=found & ~F.col("_no_label") & F.col("gold_verdict").isNull())
    return d.withColumn("problems", problems).drop("_none", "_no_label")


def exemplar_skill_rows(lines: DataFrame, json: str = "json") -> DataFrame:
    """(scenario_id, source_idx, skill_context, skill_framework, moral_categories, skill_description, problems) of exemplar skills."""
    d = parsed(lines, json)
    v, own = F.col("_v"), nested_or_row(F.col("_v"))
    categories = F.coalesce(F.try_variant_get(at(v, "moral_categories"), "$", "array<string>"), F.array().cast("array<string>"))
    d = d.select(v.isNull().alias("_none"), text(present_or_nested(v, "scenario_id")).alias("scenario_id"), integer(present_or_nested(v, "source_idx")).alias("source_idx"), text(at(own, "context")).alias("skill_context"), text(at(v, "framework")).alias("skill_framework"), categories.alias("moral_categories"), text(at(v, "skill_description")).alias("skill_description"))
    found = ~F.col("_none")
    return d.withColumn("problems", _problems(no_object=F.col("_none"), no_source_idx=found & F.col("source_idx").isNull(), no_scenario_id=found & (F.col("scenario_id") == ""), incomplete=found & (F.col("skill_description") == ""))).drop("_none")


def exemplar_source_rows(source: DataFrame) -> DataFrame:
    """(scenario_id, context, action1, action2, choice, chosen_action, thought_process, framework) of a CSV's text columns,
    two of which may have other names."""
    def named(*names: str) -> Column:
        own = [F.nullif(strip_ends(F.col(n)), F.lit("")) for n in names if n in source.columns]
        return F.coalesce(*own, F.lit(""))

    return source.select(named("scenario_id", "id").alias("scenario_id"), named("context").alias("context"), named("action1", "action_1").alias("action1"), named("action2", "action_2").alias("action2"), named("choice").alias("choice"), named("chosen_action").alias("chosen_action"), named("thought_process").alias("thought_process"), named("framework").alias("source_framework"))
