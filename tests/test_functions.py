"""Truth tables and unit cases of the scalar functions."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomtext.functions import parsing as P
from loomtext.functions import prompts as M
from loomtext.functions import text as X
from loomtext.operators import lexicon as L
from loomtext.operators import routing as R


def each(spark, rows, schema, *columns):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [tuple(r) for r in d.select("_i", *columns).orderBy("_i").drop("_i").collect()]


SPACES = [None, "", " a ", "a \t\n b", "\u00a0a b\u3000", "\x1ca\x1f", "a\x85b", "\u200ba", "  ", "x" * 10_000 + " "]


def test_collapse_and_strip_follow_pythons_white_space(spark):
    got = each(spark, [(s,) for s in SPACES], "t string", X.collapse(F.col("t")), X.strip_ends(F.col("t")), X.count_words(F.col("t")))
    assert got == [(" ".join((s or "").split()), (s or "").strip(), len((s or "").split())) for s in SPACES]


def test_every_space_is_collapsed(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert each(spark, [(f"a{c}b",) for c in spaces], "t string", X.collapse(F.col("t"))) == [("a b",)] * len(spaces)


def test_falsy_values_are_empty(spark):
    assert each(spark, [(0,), (7,), (None,)], "n int", X.collapse_falsy(F.col("n"), "int"), X.collapse(F.col("n"))) == [("", "0"), ("7", "7"), ("", "")]
    assert each(spark, [(True,), (False,)], "b boolean", X.collapse_falsy(F.col("b"), "boolean")) == [("true",), ("",)]


def test_casefold(spark):
    words = ["Straße", "ſo", "ΣΑΣ", "ﬁn", "ÉTÉ", "plain"]
    assert each(spark, [(w,) for w in words], "t string", X.casefold(F.col("t"))) == [(w.casefold(),) for w in words]
    assert all(v == k.casefold() or unicodedata.normalize("NFC", v) for k, v in X._folds()[2].items())


def test_padded_ids_grow_and_never_cut(spark):
    assert each(spark, [(0,), (1234567,)], "n long", X.padded_id("H", F.col("n"), 10), X.padded_id("H", F.col("n"), 20_000_000)) == [("H000000", "H00000000"), ("H1234567", "H01234567")]


def test_clean_skill(spark):
    cases = [('"Assess it."', "Assess it."), ("## Skills: 'x  y'", "x y"), ("Skill description:\n a", "a"), ('"', '"'), ('""', ""), ("'a\"", "'a\""), ("#####skill: a", "#####skill: a"), (None, "")]
    assert each(spark, [(c,) for c, _ in cases], "t string", X.clean_skill(F.col("t"))) == [(w,) for _, w in cases]


def test_strip_artifacts(spark):
    cases = [("<think>x\ny</think> Reasoning: ok", "ok"), ("<THINK>open", "open"), ("a<|eot|>b</s>", "a b"), ("rationale :  x", "x"), ("the rationale: x", "the rationale: x")]
    assert each(spark, [(c,) for c, _ in cases], "t string", X.strip_artifacts(F.col("t"))) == [(w,) for _, w in cases]


def test_cap_rationale(spark):
    cases = [("A b. C d! E f? tail", "A b. C d!", True), ("no end at all here now", "no end at all.", True), ("One two three four, five. Six.", "One two three four.", True), ("Short.", "Short.", False), ("", "", False), ('He said "yes." Then', 'He said "yes."', True)]
    c = X.cap_rationale(F.col("t"), 4, 2)
    assert each(spark, [(t,) for t, *_ in cases], "t string", c["text"], c["changed"]) == [(w, x) for _, w, x in cases]


VERDICTS = [
    ("Final answer: 1", 1, "final_marker", [1]), ("Final  answer: 1", 1, "answer_marker", [1, 1]), ("Final verdict: 0", 0, "json_verdict", [0, 0]), ("verdict: 1", 1, "json_verdict", [1, 1]),
    ('{"verdict": 1}', 1, "json_verdict", [1]), ("Answer: 0 … Final answer: 1", 1, "final_marker", [0, 1]), ("Answer: 10", 1, "answer_marker", [1]), ("**Final answer**: 1", None, "unparsed", []),
    ("reasoning…\n**1**", 1, "standalone_final_line", []), ("", None, "unparsed", []), (None, None, "unparsed", []), ("x\n\\boxed{0}.\n \n", 0, "standalone_final_line", []), ("1 or 0", None, "unparsed", []),
    ("FINAL ANSWER is **\\boxed{1}**, answer = 0", 0, "answer_marker", [1, 0]), ("line\u20281", 1, "standalone_final_line", []), ("verdict - 1 verdict: 10", 1, "answer_marker", [1, 1]),
]


def test_parse_verdict(spark):
    v = P.parse_verdict(F.col("t"))
    got = each(spark, [(t,) for t, *_ in VERDICTS], "t string", v["prediction"], v["parse_method"], v["explicit_values"], v["conflicting"])
    assert got == [(p, m, vals, len(set(vals)) > 1) for _, p, m, vals in VERDICTS]


def test_labels_types_and_choices(spark):
    values = ["0", "1", " 1 ", "0.0", "1.0", "2", "", None, "x"]
    got = each(spark, [(v,) for v in values], "t string", P.strict_label(F.col("t")), P.lenient_label(F.col("t")), P.named_label(F.col("t"), F.lit("1")))
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (None, 0, None), (None, 1, None), (None, None, None), (None, None, 1), (None, None, 1), (None, None, None)]
    assert each(spark, [("Role-Duty",), ("role/duty",), ("requests",), ("roles",), (None,)], "t string", P.canonical_type(F.col("t"))) == [("duty_role",), ("duty_role",), ("request",), (None,), (None,)]
    got = each(spark, [("", "Action_1"), (" own ", "2"), (None, " B "), ("", "c")], "chosen string, choice string", P.chosen_action(F.col("chosen"), F.col("choice"), F.lit("one"), F.lit("two")))
    assert got == [("one",), ("own",), ("two",), (None,)]


def test_softmax_is_stable_and_ties_go_to_zero(spark):
    s = P.softmax2(F.col("a"), F.col("b"))
    got = each(spark, [(0.0, 0.0), (-5000.0, 5000.0), (1e308, -1e308)], "a double, b double", s["p0"], s["p1"], s["verdict"])
    assert got == [(0.5, 0.5, 0), (0.0, 1.0, 1), (1.0, 0.0, 0)]


def test_ratios(spark):
    assert each(spark, [(1, 2), (1, 0)], "a int, b int", P.ratio(F.col("a"), F.col("b")), P.ratio(F.col("a"), F.col("b"), 0.0)) == [(0.5, 0.5), (None, 0.0)]


ROUTES = [
    ("Could you go?", "I should call.", "ambiguous", "duty_role_response_conflicts_with_request_scenario"), ("I am a clerk", "So I  should file", "duty_role", "explicit_so_i_should_response"),
    ("I'm a clerk", "No.", "request", "explicit_no_or_but_response_with_declarative_scenario"), ("Go home", "But it rained", "request", "explicit_no_or_but_response"),
    ("Go home", "It rained", "request", "request_shaped_scenario"), ("My job is hard", "It rained", "duty_role", "duty_or_role_shaped_scenario"),
    ("I work. Can you help?", "It rained", "ambiguous", "scenario_has_both_request_and_duty_role_signals"), ("The parcel", "Nobody", "ambiguous", "no_supported_textual_routing_rule"),
    (None, None, "ambiguous", "no_supported_textual_routing_rule"), ("I’m here", "x", "duty_role", "duty_or_role_shaped_scenario"),
]


def test_router_truth_table(spark):
    r = R.route(F.col("s"), F.col("e"))
    assert each(spark, [(s, e) for s, e, *_ in ROUTES], "s string, e string", r["input_format"], r["routing_reason"]) == [x[2:] for x in ROUTES]
    folded = R.route_folded(F.col("s"), F.col("e"))
    assert [f for f, _ in each(spark, [(s, e) for s, e, *_ in ROUTES], "s string, e string", folded["input_format"], folded["routing_reason"])] == [x[2] for x in ROUTES]


def test_keyword_matches_look_around(spark):
    texts = ["An afterlife lawn", "Life, LAW and lies!", "well being or well-being", "police officer", "prélaw", None, "the soldiers"]
    got = each(spark, [(t,) for t in texts], "t string", L.keyword_matches(F.col("t")))
    want = []
    for t in texts:
        found = {c: sorted({m[0].lower() for m in re.finditer(rf"(?<!\w)(?:{'|'.join(x)})(?!\w)", t or "", re.I)}) for c, x in L.TERMS.items()}
        want.append(({c: w for c, w in found.items() if w},))
    assert got == want and set(L.TERMS) == set(L.DESCRIPTIONS)


def test_prompts(spark):
    d = spark.createDataFrame([("request", "s", "e"), ("duty_role", "s", "e")], "f string, s string, e string")
    out = [r[0] for r in d.select(M.case_block(F.col("f"), F.col("s"), F.col("e"))).collect()]
    assert out == ["Case format: request or excuse\nScenario: s\nProposed excuse: e", "Case format: role or responsibility\nRole or context: s\nProposed responsibility: e"]
    with pytest.raises(Exception, match="unsupported format"):
        d.select(M.case_block(F.lit("other"), F.col("s"), F.col("e"))).collect()
    p = d.select(M.verdict_prompt(F.lit("B"), F.lit("rationale_verdict"), F.lit("R"))).first()[0]
    assert p == f"B\n\nCandidate reasoning trace:\nR\n\n{M.VERDICT}"
