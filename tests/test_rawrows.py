"""Keys looked at row by row, and composite validators counted by one job."""

import json

import pytest
from pyspark.sql import functions as F

from loomtext.operators import constraints as C
from loomtext.operators import rawrows as K
from loomtext.operators import validators as V
from loomtext.plans import stages


def lines(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "json string")


SKILL = {"source_idx": 1, "target_id": "T1", "input_format": "request", "scenario": " s ", "excuse": "e", "skill_description": "Assess it."}


def without(row, *keys, **more):
    return {k: v for k, v in row.items() if k not in keys} | more


def test_a_key_that_is_there_wins_whatever_it_holds(spark):
    d = K.parsed(lines(spark, [{"k": None, "r": {"k": 5}}, {"r": {"k": 5}}, {"k": "", "r": {"k": 5}}, {"k": 7}, {"r": [1]}, {"r": None}, {}]))
    v = F.col("_v")
    found = K.present_or_nested(v, "k", "r")
    got = [(r.there, r.text, r.n) for r in d.select(K.is_blank(found).alias("there"), K.text(found).alias("text"), K.integer(found).alias("n")).collect()]
    assert got == [(True, "", None), (False, "5", 5), (True, "", None), (False, "7", 7), (True, "", None), (True, "", None), (True, "", None)]


def test_texts_and_integers_follow_the_value_that_is_held(spark):
    cases = [(" a ", "a", None), (0, "", 0), (0.0, "", 0), (False, "", 0), (True, "True", 1), ([], "", None), ({}, "", None), (None, "", None), ("0", "0", 0), (" +12 ", "+12", 12), ("-3", "-3", -3), (3.9, "3.9", 3), (-3.9, "-3.9", -3), ("3.9", "3.9", None), ("1e3", "1e3", None), ("\t", "", None)]
    d = K.parsed(lines(spark, [{"x": x} for x, _, _ in cases])).withColumn("x", K.at(F.col("_v"), "x"))
    assert [(r.t, r.n) for r in d.select(K.text(F.col("x")).alias("t"), K.integer(F.col("x")).alias("n")).collect()] == [c[1:] for c in cases]


def test_skill_lines_are_judged_row_by_row(spark):
    rows = [SKILL, without(SKILL, "source_idx", "target_id", source_reference={"source_idx": "2", "target_id": "T2"}), without(SKILL, "source_idx", source_idx=None, source_reference={"source_idx": 3})]
    rows += [without(SKILL, "scenario", input={"scenario": "x", "excuse": "y", "gold": None}), without(SKILL, label=None), without(SKILL, input_format="other"), "[1]", '{"a": 1, "a": 2}', without(SKILL, "target_id")]
    got = [(r.source_idx, r.target_id, r.scenario, r.leaked, r.problems) for r in K.skill_rows(lines(spark, rows)).collect()]
    assert got[0] == (1, "T1", "s", [], []) and got[1] == (2, "T2", "s", [], []) and got[2] == (None, "T1", "s", [], ["no_source_idx"])
    assert got[3] == (1, "T1", "x", ["gold"], ["leaks_labels"]) and got[4][3:] == (["label"], ["leaks_labels"]) and got[5][4] == ["incomplete"]
    assert got[6][4] == got[7][4] == ["no_object"] and got[8][4] == ["no_target_id"]


def test_raw_lines_freeze_to_queries_and_labels(spark):
    skills = lines(spark, [without(SKILL, source_idx=k, target_id=f"T{k}") for k in range(4)])
    labels = [{"source_idx": 0, "label": 1}, {"source_reference": {"source_idx": "1", "target_id": "T1"}, "gold_verdict": None, "gold": "0"}, {"source_idx": 2, "target_id": "", "gold_verdict": "", "gold_label": True}, {"source_idx": 3, "label": 0.0}]
    out = stages.freeze_queries(skills, lines(spark, labels), 4)
    assert sorted((r.source_idx, r.target_id, r.gold_verdict) for r in out["labels"].collect()) == [(0, "T0", 1), (1, "T1", 0), (2, "T2", 1), (3, "T3", 0)]
    assert set(out["queries"].columns) == {"target_id", "source_idx", "input_format", "scenario", "excuse", "skill_description"}
    for bad, why in (([*labels[:3], {"source_idx": 3, "label": 2}], "bad_label"), ([*labels[:3], {"source_idx": 3}], "no_label"), (labels[:3], "left only"), ([*labels, {"source_idx": 9, "label": 1}], "right only"), ([*labels, labels[0]], "right keys given twice"), ([*labels[:3], {"source_idx": 3, "target_id": "other", "label": 1}], "target ids")):
        with pytest.raises(C.ConstraintError, match=why):
            stages.freeze_queries(skills, lines(spark, bad))
    with pytest.raises(C.ConstraintError, match="row count"):
        stages.freeze_queries(skills, lines(spark, labels), 5)
    with pytest.raises(C.ConstraintError, match="leaks_labels"):
        stages.freeze_queries(lines(spark, [without(SKILL, source_idx=0, gold=None)]), lines(spark, labels[:1]))


def test_raw_exemplars_are_looked_up_in_their_csv(spark):
    skill = {"source_reference": {"scenario_id": " a ", "source_idx": 4}, "input": {"context": "c"}, "moral_categories": ["x"], "framework": "own", "skill_description": "Assess"}
    columns = "id string, context string, action_1 string, action2 string, choice string, chosen_action string, thought_process string, framework string"
    source = spark.createDataFrame([("a", "c ", "one", "two", "B", "", "t", ""), ("z", "", "", "", "", "", "", "")], columns)
    r = stages.freeze_exemplars(lines(spark, [skill]), source, 1).first()
    assert (r.exemplar_id, r.source_idx, r.chosen_action, r.framework, r.moral_categories, r.context) == ("a", 4, "two", "own", ["x"], "c")
    for bad, rows, why in ((without(skill, input={"context": "d"}), source, "contexts"), (skill, source.withColumn("choice", F.lit("?")), "choices"), (skill, source.withColumn("thought_process", F.lit(" ")), "missing"), (without(skill, "source_reference", scenario_id="q", source_idx=1), source, "left only"), (skill, source.unionByName(source), "given twice")):
        with pytest.raises(C.ConstraintError, match=why):
            stages.freeze_exemplars(lines(spark, [bad]), rows)


def test_all_rules_of_a_pair_are_one_job(spark):
    left = spark.createDataFrame([(1, "a"), (2, ""), (2, "b"), (3, None), (None, "c")], "k int, t string")
    right = spark.createDataFrame([(2, 0), (3, 5), (3, 0), (9, 1)], "k int, y int")
    rules, more = {"empty": V.not_empty("t"), "odd": V.outside("t", ["a", "b", "c", ""])}, {"label": ~F.col("y").isin(0, 1)}
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = V.counts(left, "k", rules, right, more).first().asDict()
    assert store.executionsCount() - before == 1
    assert got == {V.ROWS: 5, V.TWICE_LEFT: 1, V.TWICE_RIGHT: 1, V.LEFT_ONLY: 2, V.RIGHT_ONLY: 1, "empty": 2, "odd": 1, "label": 1}
    ok, labels = left.where("k IN (1, 2) AND t <> ''"), spark.createDataFrame([(1, 0), (2, 1), (8, 1)], "k int, y int")
    before = store.executionsCount()
    assert V.check(ok, "k", rules, labels, more, 2, more_right=True) == 2 and store.executionsCount() - before == 1
    for args, why in (((left, "k", rules), "empty: 2 in all"), ((ok, "k", {}, labels), "right only"), ((left, "k", {}), "left keys given twice"), ((ok, "k", {}, labels.where("k = 1")), "left only"), ((ok, "k", {}, right.where("y < 5"), more), "left only")):
        with pytest.raises(C.ConstraintError, match=why):
            V.check(*args)
    with pytest.raises(C.ConstraintError, match="row count"):
        V.check(ok, "k", {}, expected_rows=3)
    assert V.counts(left.limit(0), "k", rules).first().asDict()[V.ROWS] == 0
