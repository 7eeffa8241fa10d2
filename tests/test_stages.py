"""The stages end to end on made cases, with in-memory stand-ins for models and the batch service."""

import json

import pytest
from pyspark.sql import functions as F

from loomtext.operators import constraints as C
from loomtext.operators import scoring as S
from loomtext.plans import jobs, stages


def raw(spark, n=40):
    return spark.range(n).select(
        F.col("id").alias("source_idx"),
        F.when(F.col("id") % 2 == 0, F.format_string("Could you do  task %d?", "id")).otherwise(F.format_string("I am a clerk for %d", "id")).alias("scenario"),
        F.when(F.col("id") % 2 == 0, "No because I am ill.").otherwise("So I should file it.").alias("excuse"),
        (F.col("id") % 3 % 2).cast("string").alias("label"),
    )


def answer(line):
    r = json.loads(line)
    text = '"Assess whether the stated reason is a real obstacle that releases someone from this request."'
    return json.dumps({"custom_id": r["custom_id"], "error": None, "response": {"status_code": 200, "body": {"model": r["body"]["model"], "choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2, "total_tokens": 5}}}})


def test_from_cases_to_metrics(spark, tmp_path):
    v = stages.curate_cases(raw(spark), expected_rows=40, out=str(tmp_path / "one"))
    assert {f: v[f].count() for f in ("request", "duty_role", "ambiguous")} == {"request": 20, "duty_role": 20, "ambiguous": 0}
    assert json.load(open(tmp_path / "one" / "summary.json"))["tables"]["private"]["rows"] == 40
    seeds = spark.range(16).selectExpr("cast(id + 1 AS int) AS position", "concat('s', id) AS seed_id", "'request' AS input_format", "'Can you?' AS scenario", "'No.' AS excuse", "'Assess it.' AS skill_description")
    requests = stages.prepare_requests(v["request"], seeds, "request", "judge-1", shard_size=8)
    client = jobs.FakeClient(answer)
    lines = stages.send_requests(requests, client, str(tmp_path / "answers"))
    assert lines.count() == 20 and client.most_active == 1 and len(client.jobs) == 3
    responses = lines.select(F.from_json("value", stages.RESPONSE).alias("r")).select("r.*")
    m = stages.materialize_skills(requests, responses)
    assert m["usage"].first().asDict() == {"prompt_tokens": 60, "completion_tokens": 40, "total_tokens": 100} and m["failures"].first().failures == 0
    with pytest.raises(C.ConstraintError):
        stages.materialize_skills(requests, responses.limit(19))
    own = v["private"].where("input_format = 'request'")
    frozen = stages.freeze_queries(m["skills"], own, expected_rows=20)
    with pytest.raises(C.ConstraintError):
        stages.freeze_queries(m["skills"], v["private"])
    with pytest.raises(C.ConstraintError, match="hold labels"):
        stages.freeze_queries(m["skills"].withColumn("gold", F.lit(1)), own)
    with pytest.raises(C.ConstraintError, match="target ids"):
        stages.freeze_queries(m["skills"], own.withColumn("target_id", F.concat("target_id", F.lit("x"))))
    again = stages.freeze_queries(m["skills"], own.select("source_idx", F.col("gold_verdict").alias("gold_label"), F.lit("").alias("label")))
    assert again["labels"].exceptAll(frozen["labels"]).isEmpty()
    g = stages.evaluate_generated(frozen["queries"], frozen["labels"], S.Deterministic, str(tmp_path / "gen"))
    total = g["summary"].where("overall = 1").first()
    assert total.total == total.completed == total.parsed == 20 and 0 <= total.accuracy <= 1
    for condition in ("direct_verdict", "rationale_verdict"):
        s = stages.evaluate_scored(frozen["queries"].drop("skill_description"), frozen["labels"], S.Deterministic, str(tmp_path / condition), condition, S.Deterministic)
        r = s["summary"].first()
        assert 0 <= r.macro_f1 <= 1 and set(r.per_label) == {0, 1} and set(r.by_input_format) == {"request", "duty_role"}
        if condition == "rationale_verdict":
            assert {"rationale", "rationale_raw", "rationale_prompt", "rationale_input_tokens"} <= set(s["predictions"].columns) and r.rationale_was_empty == 0
        assert r.records == 20 and r.correct == s["predictions"].where("correct").count() and "gold_verdict" not in s["blind"].columns
        assert {x.input_format: x.records for x in s["by_format"].collect()} == {"request": 20, "duty_role": 0}


def test_curation_refuses_bad_rows(spark, tmp_path):
    good = raw(spark, 4)
    with pytest.raises(C.ConstraintError, match="row count"):
        stages.curate_cases(good, expected_rows=5)
    with pytest.raises(C.ConstraintError, match="label"):
        stages.curate_cases(good.withColumn("label", F.lit("2")))
    with pytest.raises(C.ConstraintError, match="empty"):
        stages.curate_cases(good.withColumn("excuse", F.lit("  ")))
    with pytest.raises(C.ConstraintError, match="review"):
        stages.curate_cases(good.withColumn("scenario", F.lit("The parcel")).withColumn("excuse", F.lit("It rained")), out=str(tmp_path / "x"))
    assert (tmp_path / "x" / "ambiguous").exists()


def test_dilemmas_and_exemplars(spark):
    rows = [("a", 0, "A doctor may lie.", "Tell.", "Hide.", "1", ""), ("b", 1, "A soldier must attack.", "Go.", "Stay.", "b", ""), ("c", 2, "A lawn party.", "Go.", "Stay.", "a", "Own text"), ("d", 3, "Break a promise?", "Yes.", "No.", "a", "")]
    d = spark.createDataFrame(rows, "scenario_id string, source_idx long, context string, action1 string, action2 string, choice string, chosen_action string")
    out = stages.categorize_dilemmas(d, seed_count=2)
    assert [r.scenario_id for r in out["ambiguous"].collect()] == ["c"] and out["seeds"].count() == 2 and out["template"].count() == 1
    assert all(r.category_descriptions.keys() == set(r.moral_categories) for r in out["seeds"].collect())
    over = spark.createDataFrame([("c", ["law_and_legality"])], "scenario_id string, moral_categories array<string>")
    assert stages.categorize_dilemmas(d, overrides=over, seed_count=4)["ambiguous"].isEmpty()
    with pytest.raises(C.ConstraintError, match="unknown"):
        stages.categorize_dilemmas(d.where("scenario_id <> 'c'"), overrides=over, seed_count=1)
    skills = d.select("scenario_id", "context", "action1", "action2").where("scenario_id <> 'd'")
    frozen = stages.freeze_exemplars(skills, d)
    assert {r.scenario_id: r.chosen_action for r in frozen.collect()} == {"a": "Tell.", "b": "Stay.", "c": "Own text"}
    with pytest.raises(C.ConstraintError, match="differ"):
        stages.freeze_exemplars(skills.withColumn("context", F.lit("other")), d)


def test_requests_resume_after_any_step(spark, tmp_path):
    rows = [(f"request-part-{k // 4 + 1:04d}", k, json.dumps({"custom_id": f"c{k}", "body": {"model": "m"}})) for k in range(10)]
    requests = spark.createDataFrame(rows, "shard string, order int, request string")
    client, saved, path, out, steps = jobs.FakeClient(answer), [], str(tmp_path / "answers"), None, 0
    state = None
    while out is None:  # each step starts from what the one before it saved, as a new process would
        out = stages.send_requests(requests, client, path, json.loads(saved[-1]) if saved else state, lambda s: saved.append(json.dumps(s)), single_step=True)
        steps += 1
    assert out.count() == 10 and len(client.jobs) == 3 and client.most_active == 1 and steps > 3
    assert stages.send_requests(requests, client, path, json.loads(saved[-1])).count() == 10 and len(client.jobs) == 3
    failing = jobs.FakeClient(answer, fails={"request-part-0002": "bad"})
    state = {}
    with pytest.raises(jobs.JobFailed):
        stages.send_requests(requests, failing, str(tmp_path / "other"), state)
    assert state["batches"]["request-part-0001"]["written"]


def test_scans_name_bad_lines_and_take_white_space(spark, tmp_path):
    from loomtext.sources import readers

    (tmp_path / "a.jsonl").write_text('{"a": "1"}\n\t\n\t{"a": "2"}\n{"a": "3", "a": "4"}\n')
    for strict in (True, False):
        assert sorted(r.a for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a string", strict=strict).collect()) == ["1", "2", "4"]
    for k, bad in enumerate(("not json", "[1]", '{"a": ', '{"a": 1} x', "1")):
        (tmp_path / f"bad{k}.jsonl").write_text(f'{{"a": "1"}}\n\n{bad}\n')
        for strict in (True, False):
            with pytest.raises(C.ConstraintError, match=r"', 3, "):
                readers.read_jsonl(spark, str(tmp_path / f"bad{k}.jsonl"), "a string", strict=strict)
    with pytest.raises(C.ConstraintError, match="not there"):
        readers.require_inputs(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "none"))
    assert readers.read_overrides(spark, None, ["x"]) is None


def test_case_ids_follow_file_names_and_lines(spark, tmp_path):
    from loomtext.sources import readers

    (tmp_path / "d").mkdir()
    for name, rows in (("b", 300), ("a", 3)):  # the larger file is read first
        (tmp_path / "d" / f"{name}.csv").write_text("label,scenario,excuse\n" + "".join(f"{k % 2},{name} {k},e\n" for k in range(rows)))
    cases = readers.read_cases(spark, str(tmp_path / "d"), "csv", "H", False).orderBy("source_idx").collect()
    assert [r.scenario for r in cases] == [f"a {k}" for k in range(3)] + [f"b {k}" for k in range(300)]
    labels = {r.target_id: r.gold_verdict for r in readers.read_cases(spark, str(tmp_path / "d"), "csv", "H", True).collect()}
    assert all(labels[r.target_id] == int(r.scenario.split()[1]) % 2 for r in cases)
