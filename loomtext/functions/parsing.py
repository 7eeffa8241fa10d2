"""Verdicts, labels, types and choices parsed by Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import collapse, strip_ends

#: Patterns of an explicit verdict, in rule order; the group is the verdict: fixed values.
EXPLICIT = (
    ("final_marker", r"final\s+(?:answer|verdict)\s*(?::|=|-|\bis\b)?\s*(?:[`*_~]+\s*)*(?:\\boxed\s*\{\s*)?([01])(?:\s*\})?(?:\s*[`*_~]+)?"),
    ("answer_marker", r"(?<!final\s)(?:answer|verdict)\s*(?::|=|-|\bis\b)\s*(?:[`*_~]+\s*)*(?:\\boxed\s*\{\s*)?([01])(?:\s*\})?(?:\s*[`*_~]+)?"),
    ("json_verdict", r"[\"']?(?:final_)?verdict[\"']?\s*:\s*([01])\b"),
)
#: Fixed pattern of a last line that is a verdict by itself.
STANDALONE = r"(?U)^\s*(?:[`*_~]+\s*)*(?:\\boxed\s*\{\s*)?([01])(?:\s*\})?(?:\s*[.!])?(?:\s*[`*_~]+)?\s*$"
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"


def _matches(text: Column, rule: int) -> Column:
    """array(struct(start, rule, value)) of one rule's matches, starts from the lengths of what lies between."""
    pattern = "(?iU)" + EXPLICIT[rule][1]
    whole, values, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.split(text, pattern, -1)
    length = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    one = lambda v, i: F.struct((length(between, i + 1) + length(whole, i)).alias("start"), F.lit(rule).alias("rule"), v.cast("int").alias("value"))
    return F.transform(values, one)


def explicit_verdicts(text: Column) -> Column:
    """array(struct(start, rule, value)) of all explicit verdicts in the order of the text."""
    return F.array_sort(F.concat(*(_matches(F.coalesce(text, F.lit("")), r) for r in range(len(EXPLICIT)))))


def parse_verdict(text: Column, found: Column | None = None) -> Column:
    """struct(prediction, parse_method, explicit_values, conflicting): the last explicit verdict, else a bare last line."""
    text = F.coalesce(text, F.lit(""))
    found = explicit_verdicts(text) if found is None else found
    last = F.try_element_at(found, F.lit(-1))
    values = F.transform(found, lambda m: m["value"])
    lines = F.filter(F.transform(F.split(text, LINE_BREAK, -1), strip_ends), lambda x: x != "")
    bare = F.regexp_extract(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), STANDALONE, 1)
    bare = F.when(bare != "", bare.cast("int"))
    explicit = F.size(found) > 0
    names = F.array(*(F.lit(n) for n, _ in EXPLICIT))
    return F.struct(
        F.when(explicit, last["value"]).otherwise(bare).alias("prediction"),
        F.when(explicit, F.get(names, last["rule"])).when(bare.isNotNull(), F.lit("standalone_final_line")).otherwise(F.lit("unparsed")).alias("parse_method"),
        values.alias("explicit_values"),
        (F.size(F.array_distinct(values)) > 1).alias("conflicting"),
    )


def with_verdict(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the parsed verdict as a struct. What is found in a text and the struct are each behind an explosion of
    one element, which the optimiser does not merge, so that no pattern runs once for each field that is read."""
    d = df.withColumn("__found", F.explode(F.array(explicit_verdicts(F.col(text)))))
    return d.withColumn(name, F.explode(F.array(parse_verdict(F.col(text), F.col("__found"))))).drop("__found")


def strict_label(c: Column) -> Column:
    """0 or 1 from ``0`` or ``1``, else null (a violation)."""
    t = collapse(c)
    return F.when(t.isin("0", "1"), t.try_cast("int"))


def lenient_label(c: Column) -> Column:
    """As strict_label, with ``0.0`` and ``1.0`` too."""
    return F.when(collapse(c).isin("0", "1", "0.0", "1.0"), collapse(c).try_cast("double").cast("int"))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns))


def named_label(*columns: Column, numeric: bool = False) -> Column:
    """The first non-empty of several label columns; only whole 0 and 1 count.

    ``numeric``: the columns hold numbers or booleans, whose fraction is cut off (0.7 is 0, true is 1).
    """
    if numeric:
        value = F.coalesce(*(c.cast("double") for c in columns)).cast("int")
    else:
        value = strip_ends(first_non_empty(*columns)).try_cast("int")
    return F.when(value.isin(0, 1), value)


#: Accepted names of the two formats: fixed values.
TYPE_ALIASES = {"request": "request", "requests": "request", "role": "duty_role", "duty": "duty_role", "duty_role": "duty_role", "role_duty": "duty_role"}


def canonical_type(c: Column) -> Column:
    """A format's name, or null where the alias is unknown (a violation)."""
    key = F.translate(F.lower(strip_ends(c)), "-/", "__")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for alias, name in TYPE_ALIASES.items():
        out = out.when(key == alias, F.lit(name))
    return out


#: Accepted names of the two actions: fixed values.
CHOICES = (("1", "a", "action1", "action_1", "option1", "option_1"), ("2", "b", "action2", "action_2", "option2", "option_2"))


def chosen_action(chosen: Column, choice: Column, action1: Column, action2: Column) -> Column:
    """Explicit text wins, else the action that the choice names, else null (a violation)."""
    text, key = strip_ends(chosen), F.lower(strip_ends(choice))
    return F.when(text != "", text).when(key.isin(*CHOICES[0]), action1).when(key.isin(*CHOICES[1]), action2)


def softmax2(score0: Column, score1: Column) -> Column:
    """struct(p0, p1, verdict) of two scores; shifted by the larger, so nothing overflows; a tie goes to 0."""
    top = F.greatest(score0, score1)
    e0, e1 = F.exp(score0 - top), F.exp(score1 - top)
    return F.struct((e0 / (e0 + e1)).alias("p0"), (e1 / (e0 + e1)).alias("p1"), F.when(score0 >= score1, 0).otherwise(1).alias("verdict"))


def by_label(label: Column, p0: Column, p1: Column) -> Column:
    return F.when(label == 0, p0).when(label == 1, p1)


def ratio(n: Column, of: Column, empty: float | None = None) -> Column:
    """n / of as a double; ``empty`` where there is nothing to divide by."""
    out = F.try_divide(n.cast("double"), of.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(float(empty)))
