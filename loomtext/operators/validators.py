"""Composite validators: all rules of a pair of relations counted by one job.

Row rules are boolean columns, summed by key together with how often each side has the key; one more aggregate turns that
into a count for each rule, for keys given twice and for keys on one side only. Only a rule that is broken costs another
job, which fetches a few of its rows for the message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import strip_ends
from loomtext.operators.constraints import ConstraintError

#: Counts that do not come from a row rule.
ROWS, TWICE_LEFT, TWICE_RIGHT, LEFT_ONLY, RIGHT_ONLY = "rows", "left keys given twice", "right keys given twice", "keys on the left only", "keys on the right only"


def not_empty(*columns: str) -> Column:
    """Holds for rows where one of the columns is null or white space."""
    return F.greatest(*(strip_ends(F.col(c)) == "" for c in columns), F.lit(False))


def outside(column: str, domain) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(*domain)


def counts(left: DataFrame, key: str, rules: dict[str, Column], right: DataFrame | None = None, right_rules: dict[str, Column] | None = None) -> DataFrame:
    """One row: rows of ``left``, keys twice on a side or on one side only, and the rows that break each rule."""
    right_rules = right_rules or {}
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    names = {n: f"_l{i}" for i, n in enumerate(rules)} | {("right", n): f"_r{i}" for i, n in enumerate(right_rules)}
    zero = {c: F.lit(0).alias(c) for c in names.values()}
    tagged = left.select(F.col(key).alias("_key"), F.lit(1).alias("_left"), F.lit(0).alias("_right"), *({**zero, **{names[n]: flag(c).alias(names[n]) for n, c in rules.items()}}).values())
    if right is not None:
        tagged = tagged.unionByName(right.select(F.col(key).alias("_key"), F.lit(0).alias("_left"), F.lit(1).alias("_right"), *({**zero, **{names["right", n]: flag(c).alias(names["right", n]) for n, c in right_rules.items()}}).values()))
    by_key = tagged.groupBy("_key").agg(*(F.sum(c).alias(c) for c in ("_left", "_right", *names.values())))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    both = right is not None
    return by_key.agg(
        total("_left").alias(ROWS),
        F.count_if(F.col("_left") > 1).alias(TWICE_LEFT),
        F.count_if(F.col("_right") > 1).alias(TWICE_RIGHT),
        F.count_if((F.col("_right") == 0) & F.lit(both)).alias(LEFT_ONLY),
        F.count_if(F.col("_left") == 0).alias(RIGHT_ONLY),
        *(total(names[n]).alias(n) for n in rules),
        *(total(names["right", n]).alias(n) for n in right_rules),
    )


def check(left: DataFrame, key: str, rules: dict[str, Column], right: DataFrame | None = None, right_rules: dict[str, Column] | None = None, expected_rows: int = 0, unique: bool = True, more_right: bool = False, shown: int = 10) -> int:
    """Raises with the first broken rule and some of its keys; the number of rows of ``left`` if none is.
    ``more_right``: the right side may have keys of its own."""
    right_rules = right_rules or {}
    found = counts(left, key, rules, right, right_rules).first().asDict()
    if expected_rows and found[ROWS] != expected_rows:
        raise ConstraintError(f"row count: [({expected_rows}, {found[ROWS]})]")
    one = lambda d, side: d.groupBy(key).count().where("count > 1").select(key, F.lit(side))
    alone = lambda a, b: a.select(key).join(b.select(key), key, "left_anti")
    sample = {n: left.where(F.coalesce(c, F.lit(False))).select(key) for n, c in rules.items()} | {n: right.where(F.coalesce(c, F.lit(False))).select(key) for n, c in right_rules.items()}
    if unique:
        sample[TWICE_LEFT] = one(left, "left")
        if right is not None:
            sample[TWICE_RIGHT] = one(right, "right")
    if right is not None:
        sample[LEFT_ONLY] = alone(left, right)
        if not more_right:
            sample[RIGHT_ONLY] = alone(right, left)
    for name in (*rules, *right_rules, TWICE_LEFT, TWICE_RIGHT, LEFT_ONLY, RIGHT_ONLY):
        if name in sample and found[name]:
            raise ConstraintError(f"{name}: {found[name]} in all, such as {[tuple(r) for r in sample[name].limit(shown).collect()]}")
    return found[ROWS]
