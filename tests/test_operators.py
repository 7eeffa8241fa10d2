"""Constraints, joins, metrics, selection, sources, sinks, scoring, resume and jobs."""

import itertools
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomtext.operators import constraints as C
from loomtext.operators import joins as J
from loomtext.operators import lexicon as L
from loomtext.operators import metrics as A
from loomtext.operators import normalize
from loomtext.operators import scoring as S
from loomtext.operators import selection as O
from loomtext.plans import catalogue, jobs
from loomtext.sources import readers, writers
from loomtext.streaming import resume


def test_constraints_report_the_bad_row(spark):
    d = spark.createDataFrame([(1, "a"), (2, ""), (2, None)], "k int, v string")
    assert [tuple(r) for r in C.duplicates(d, "k").collect()] == [(2, 2)]
    assert [tuple(r) for r in C.missing_fields(d, "k", "v").collect()] == [(2, ["v"]), (2, ["v"])]
    assert C.row_count(d, 0).isEmpty() and C.row_count(d, 3).isEmpty() and tuple(C.row_count(d, 4).first()) == (4, 3)
    assert C.outside_domain(d, "v", ["a"]).count() == 2
    with pytest.raises(C.ConstraintError, match="twice"):
        C.enforce(C.duplicates(d, "k"), "twice")
    with pytest.raises(ValueError, match="size"):
        C.positive(size=0)


def test_leaks_see_null_values(spark):
    rows = ['{"label": null}', '{"input": {"rationale": null}}', '{"input": {"scenario": "s"}}', '{"x": {"label": 1}}', "[1]", None]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string")
    assert [(r.i, r.leaked) for r in C.leaks(d, "j", C.FORBIDDEN).orderBy("i").collect()] == [(0, ["label"]), (1, ["rationale"])]
    assert C.leaked_columns(d.withColumn("label", F.lit(1)), C.FORBIDDEN) == ["label"]


def test_seed_bank(spark):
    good = [(f"s{i}", "request", "s", "e", "Assess it.") for i in range(16)]
    schema = "seed_id string, input_format string, scenario string, excuse string, skill_description string"
    assert C.seed_bank(spark.createDataFrame(good, schema), "request").isEmpty()
    bad = [*good[:12], ("s0", "request", "s", "e", "Assess"), ("x", "duty_role", " ", "e", "Weigh it")]
    got = sorted(tuple(r) for r in C.seed_bank(spark.createDataFrame(bad, schema), "request").collect())
    assert got == sorted([("14 rows", "wrong_size"), ("s0", "duplicate_id"), ("x", "wrong_format"), ("x", "empty_input"), ("x", "not_assess")])


def test_strict_joins(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, x string"), spark.createDataFrame([(2, 0), (3, 1)], "k int, y int")
    _, bad = J.strict_one_to_one(a, b, "k")
    assert sorted(tuple(r) for r in bad.collect()) == [("1", "missing"), ("2", "duplicate_left"), ("3", "extra")]
    _, bad = J.strict_lookup(a, b, "k")
    assert [tuple(r) for r in bad.collect()] == [("1", "missing")]
    assert sorted(tuple(r) for r in J.key_set_diff(a, b, "k").collect()) == [(1, "left_only"), (3, "right_only")]
    assert J.relation_diff(a, a).isEmpty() and J.relation_diff(a, a.unionByName(a)).count() == 3
    assert J.grid(spark, model=["m"], condition=["x", "y"]).count() == 2


def brute_cover(rows, count, tie, domain):
    freq = {}
    for cats, _ in rows:
        for c in cats:
            freq[c] = freq.get(c, 0) + 1
    seen, out, covered = set(), [], set()

    def pick(options):
        best = min(options, key=lambda r: (-sum(c not in covered for c in r[0]), -sum(1 / freq[c] for c in r[0]), len(r[0]), tie[r[1]], r[1]))
        seen.add(best[1])
        covered.update(best[0])
        out.append(best[1])

    for c in domain:
        options = [r for r in rows if r[1] not in seen and c in r[0]]
        if c not in covered and options and len(out) < count:
            pick(options)
    while len(out) < count:
        pick([r for r in rows if r[1] not in seen])
    return out


@pytest.mark.parametrize("count", [1, 3, 12, 40])
def test_seed_cover_equals_a_search_over_all_rows(spark, count):
    rng = random.Random(count)
    domain = list(L.DESCRIPTIONS)
    rows = [(sorted(rng.sample(domain, rng.randrange(1, 4))), f"S{i}") for i in range(60)]
    d = spark.createDataFrame([(k, i, c) for i, (c, k) in enumerate(rows)], "scenario_id string, source_idx long, moral_categories array<string>")
    draws = random.Random(11)
    exact = {k: draws.random() for _, k in rows}
    got = [r.scenario_id for r in O.seed_cover(d, count, 11, mode="exact").orderBy("seed_no").collect()]
    assert got == brute_cover(rows, count, exact, domain)
    hashed = {r[0]: r[1] for r in d.select("scenario_id", F.xxhash64(F.lit(11), "scenario_id").cast("double")).collect()}
    assert [r.scenario_id for r in O.seed_cover(d, count, 11).orderBy("seed_no").collect()] == brute_cover(rows, count, hashed, domain)


def test_ordinals_shards_and_samples(spark):
    d = spark.range(1000).selectExpr("id * 7 % 1000 AS k").repartition(7)
    out = O.with_ordinal(d, "k").collect()
    assert sorted((r.source_idx, r.k) for r in out) == [(i, i) for i in range(1000)]
    assert O.with_ordinal(d.limit(0), "k").collect() == []
    rows = spark.range(40).selectExpr("id AS source_idx", "CASE WHEN id % 4 = 0 THEN 'request' ELSE 'duty_role' END AS input_format")
    quota = {r.input_format: (r.n, r.quota) for r in O.audit_quota(rows, 10).collect()}
    assert quota == {"request": (10, 2), "duty_role": (30, 8)}  # 2.5 rounds to even
    sample = O.audit_sample(rows, 10, 3)
    assert sorted(r.audit_id for r in sample.collect()) == list(range(1, 11)) and sample.where("input_format = 'request'").count() == 2
    assert O.audit_sample(rows, 100, 3).count() == 40
    got = spark.range(1, 6).select(O.shard_of(F.col("id"), 2).alias("s")).collect()
    assert [r.s for r in got] == [1, 1, 2, 2, 3]


def test_rows_are_fanned_out_unsorted(spark, tmp_path):
    d = spark.range(2000).select("id", (F.col("id") % 100).alias("c"))  # more values than one task holds files open
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    writers.fan_out(d.coalesce(1), str(tmp_path / "f"), "c")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    assert "Sort" not in runs.apply(runs.size() - 1).physicalPlanDescription() and spark.conf.get(key) == before
    assert sorted((r.id, r.c) for r in spark.read.json(str(tmp_path / "f")).collect()) == [(i, i % 100) for i in range(2000)]


@pytest.mark.parametrize(("most", "sentences"), [(128, 4), (128, 1), (20, 4), (5, 4), (0, 4), (128, 0)])
def test_generated_texts_stop_at_the_first_place_and_are_scanned_once(monkeypatch, most, sentences):
    model, scanned, find = S.Deterministic(max_new=most, max_sentences=sentences), [], S.re.findall
    monkeypatch.setattr(S.re, "findall", lambda p, t: scanned.append(len(t)) or find(p, t))
    got = model.generate("system", ["some prompt", "another"], [1, 2])
    assert sum(scanned) <= sum(len(g.text) for g in got)
    for g in got:
        words = g.text.split(" Final answer: ")[0].split()
        assert g.generated_tokens == len(words) and g.hit_limit == (len(words) >= most)
        assert all(not S.enough_sentences(" ".join(words[:k]), sentences) for k in range(len(words)))
        assert len(words) == most or S.enough_sentences(" ".join(words), sentences)


@pytest.mark.parametrize(("name", "query", "files"), [("csv-one", "csv_in_blocks", 16), ("arriving", "streamed_word_counts", 24)])
def test_no_task_writes_more_than_its_share(spark, tmp_path, monkeypatch, name, query, files):
    texts = [(i, 'a "b"\n,c ' * (i % 5) or None, "en") for i in range(160)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(16).write.parquet(str(tmp_path / "documents.parquet"))
    made, own, key = {}, catalogue.fresh_path, "spark.sql.files.maxPartitionBytes"
    monkeypatch.setattr(catalogue, "fresh_path", lambda s, n: made.setdefault(n, own(s, n)))
    before = spark.conf.get(key)
    spark.conf.set(key, "1m")
    try:
        out = catalogue.queries()[query](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
    assert len(list(Path(made[name].removeprefix("file:")).glob("part-*"))) == files
    if query == "csv_in_blocks":
        assert sorted((r.doc_id, r.lang, r.text) for r in out) == [(i, lang, t or "") for i, t, lang in texts]
    else:
        assert sorted((r.doc_id, r.n_words) for r in out) == [(i, len((t or "").split())) for i, t, _ in texts]


def test_a_group_is_numbered_by_many_tasks(spark):
    d = spark.range(4000).select((F.col("id") * 7919 % 4000).alias("k"), F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 == 1, "a").otherwise("b").alias("g"))
    numbered = O.with_ordinal(d, "k", name="n", by=("g",), start=1)
    plan, out = numbered._jdf.queryExecution().executedPlan().toString(), numbered.collect()
    for g in (None, "a", "b"):
        assert [r.n for r in sorted((r for r in out if r.g == g), key=lambda r: r.k)] == list(range(1, sum(r.g == g for r in out) + 1))
    assert len(out) == 4000 and "Window" not in plan
    assert O.with_ordinal(d.limit(0), "k", by=("g",)).collect() == []


def test_metrics(spark):
    rows = [(g, p) for g, p, n in ((0, 0, 5), (0, 1, 2), (1, 0, 1), (1, 1, 4)) for _ in range(n)]
    d = spark.createDataFrame(rows, "gold_verdict int, predicted_verdict int")
    assert tuple(A.confusion(d).first()) == (5, 2, 1, 4)
    m = {r.label: r for r in A.class_metrics(d).collect()}
    assert m[1].precision == pytest.approx(4 / 6) and m[1].recall == pytest.approx(4 / 5) and m[0].support == 7
    swapped = A.class_metrics(d.select((1 - F.col("gold_verdict")).alias("gold_verdict"), (1 - F.col("predicted_verdict")).alias("predicted_verdict"))).first()
    assert swapped.macro_f1 == pytest.approx(m[0].macro_f1)
    empty = A.class_metrics(d.limit(0)).collect()
    assert [(r.precision, r.recall, r.f1, r.support) for r in empty] == [(0.0, 0.0, 0.0, 0)] * 2
    r = A.accuracy_rollup(spark.createDataFrame([("a", True, None, False), ("a", False, 1, False), ("b", True, 1, True)], "input_format string, completed boolean, prediction int, correct boolean"))
    assert {x.input_format: (x.total, x.completed, x.correct, x.parsed, x.parse_rate) for x in r.collect()} == {"a": (2, 1, 0, 0, 0.0), "b": (1, 1, 1, 1, 1.0), None: (3, 2, 1, 1, 0.5)}
    codes = A.error_codes(spark.createDataFrame([("j", "failed", ["a", "a", "b"]), ("k", "completed", ["c"])], "job_key string, status string, error_codes array<string>"))
    assert [tuple(x) for x in codes.collect()] == [("j", ["a", "b"])]


def test_csv_and_jsonl(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('\ufefflabel,scenario,excuse\n1,"two\nlines, ""quoted""",\n0,back\\slash,"x"\n'.encode())
    got = [tuple(r) for r in readers.read_csv(spark, str(p), ("label",)).collect()]
    assert got == [("1", 'two\nlines, "quoted"', ""), ("0", "back\\slash", "x")]
    with pytest.raises(C.ConstraintError, match="other"):
        readers.read_csv(spark, str(p), ("other",))
    j = tmp_path / "a.jsonl"
    j.write_text('{"a": 1, "b": "é"}\n\n{"a": 2}\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_jsonl(spark, str(j), "a int, b string").collect()] == [(1, "é"), (2, None)]
    for bad in ("{bad}\n", "[1]\n", '"x"\n'):
        j.write_text('{"a": 1}\n' + bad)
        with pytest.raises(C.ConstraintError):
            readers.read_jsonl(spark, str(j), "a int")
    j.write_text("\n")
    with pytest.raises(C.ConstraintError):
        readers.read_jsonl(spark, str(j), "a int")
    assert readers.read_jsonl(spark, str(j), "a int", strict=False).count() == 0


def test_cases_are_read_blind(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('label,scenario,excuse\n1,Could you go?,No I am ill\n0.0,I am  a clerk,So I should file\n')
    blind = readers.read_cases(spark, str(p), "csv", "T_", False)
    assert "gold_verdict" not in blind.columns and [r.target_id for r in blind.orderBy("source_idx").collect()] == ["T_000000", "T_000001"]
    assert [(r.target_id, r.gold_verdict) for r in readers.read_cases(spark, str(p), "csv", "T_", True).orderBy("source_idx").collect()] == [("T_000000", 1), ("T_000001", 0)]
    j = tmp_path / "c.jsonl"
    j.write_text('{"label": 1, "scenario": "Go home", "response": "But why", "rationale": "secret"}\n')
    assert set(readers.read_cases(spark, str(j), "jsonl", "A_", False).columns) == {"target_id", "source_idx", "scenario", "excuse", "input_format", "scenario_group_id"}


def test_overrides(spark):
    schema = "scenario_id string, moral_categories array<string>"
    ok = readers.check_overrides(spark.createDataFrame([("a", ["y", "x", "y"])], schema), ["x", "y"])
    assert ok.first().moral_categories == ["x", "y"]
    for rows in ([("a", [])], [("a", None)], [("a", ["z"])], [("a", ["x"]), ("a", ["y"])]):
        with pytest.raises(C.ConstraintError):
            readers.check_overrides(spark.createDataFrame(rows, schema), ["x", "y"])


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "ä", ["x", "y"]), (2, None, ["y"])], "a int, b string, c array<string>")
    writers.write_jsonl(d, str(tmp_path / "j"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert [json.loads(x) for x in lines][1]["b"] is None and "ä" in lines[0]
    with pytest.raises(Exception, match="already exists"):
        writers.write_jsonl(d, str(tmp_path / "j"))
    assert writers.ensure_written(d, str(tmp_path / "p")) and not writers.ensure_written(d.repartition(3), str(tmp_path / "p"))
    with pytest.raises(C.ConstraintError):
        writers.ensure_written(d.limit(1), str(tmp_path / "p"))
    writers.fan_out(d, str(tmp_path / "f"), "c")
    assert spark.read.json(str(tmp_path / "f")).groupBy("category").count().where("category = 'y'").first()["count"] == 2
    m = writers.manifest({"d": d}, seed=1)
    assert m == writers.manifest({"d": d.repartition(4)}, seed=1) and m["tables"]["d"]["rows"] == 2
    assert writers.resume_manifest(str(tmp_path / "m.json"), m) == m == writers.resume_manifest(str(tmp_path / "m.json"), m)
    with pytest.raises(C.ConstraintError):
        writers.resume_manifest(str(tmp_path / "m.json"), m | {"parameters": {}})
    with pytest.raises(C.ConstraintError):
        writers.fail_on_ambiguous(d)
    assert writers.override_template(d.selectExpr("b AS scenario_id")).columns == ["scenario_id", "moral_categories", "notes"]


def cases(spark, n):
    return spark.range(n).selectExpr("concat('T', id) AS target_id", "id AS source_idx", "'request' AS input_format", "concat('case ', id) AS prompt")


def test_scoring_is_blind_and_deterministic(spark):
    d = cases(spark, 30).withColumn("label", F.lit(1))
    a = S.score_verdicts(d, S.Deterministic, "system")
    assert "label" not in a.columns and a.count() == 30
    assert a.where("abs(probability_0 + probability_1 - 1) > 1e-12 OR predicted_verdict <> CASE WHEN label_logprob_0 >= label_logprob_1 THEN 0 ELSE 1 END").isEmpty()
    assert sorted(map(str, a.collect())) == sorted(map(str, S.score_verdicts(d.repartition(5), S.Deterministic, "system").collect()))
    with pytest.raises(Exception, match="tokens"):
        S.score_verdicts(d, lambda: S.Deterministic(max_input=1), "system").collect()
    g = S.generate_texts(d, S.Deterministic, "system", seed=3)
    assert g.where("hit_max_new_tokens").isEmpty() and g.count() == 30
    assert S.enough_sentences("A. B!", 2) and not S.enough_sentences("A. B", 2)
    assert S.render("s", "p", lambda m, **k: (_ for _ in ()).throw(TypeError) if k else "plain") == "plain"


def test_resume_after_any_prefix_equals_one_run(spark, tmp_path):
    score = lambda d: S.score_verdicts(d, S.Deterministic, "system")
    want = sorted(map(str, score(cases(spark, 20)).collect()))
    for prefix in (0, 7, 20):
        path = str(tmp_path / f"r{prefix}")
        if prefix:
            resume.run_pending(cases(spark, prefix), path, "target_id", score)
        assert sorted(map(str, resume.run_pending(cases(spark, 20), path, "target_id", score).collect())) == want
    with pytest.raises(AssertionError):
        resume.run_pending(cases(spark, 21), path, "target_id", lambda d: (_ for _ in ()).throw(AssertionError))
    assert resume.run_pending(cases(spark, 20), path, "target_id", lambda d: (_ for _ in ()).throw(AssertionError)).count() == 20


def test_streaming_scores_each_row_once(spark, tmp_path):
    score = lambda d: S.score_verdicts(d, S.Deterministic, "system")
    src, seen = str(tmp_path / "in"), []
    cases(spark, 8).write.parquet(src)
    args = (spark, src, cases(spark, 1).schema, str(tmp_path / "ck"), str(tmp_path / "out"), "target_id", score, lambda d: seen.append(d.count()))
    resume.stream_scores(*args)
    cases(spark, 12).write.mode("append").parquet(src)
    resume.stream_scores(*args)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("target_id").count().where("count > 1").isEmpty()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12 and seen[-1] == 12


def test_jobs_run_one_at_a_time(tmp_path):
    shards = {f"request-part-{i:04d}": [f"{i}-{j}" for j in range(3)] for i in range(1, 4)}
    client, state, saved = jobs.FakeClient(str.upper), {"batches": {}}, []
    out = jobs.run_all(state, client, shards, save=lambda s: saved.append(len(s["batches"])))
    assert out == {k: [x.upper() for x in v] for k, v in shards.items()} and client.most_active == 1 and saved[-1] == 3
    assert jobs.step(state, client, shards) == "done"
    with pytest.raises(jobs.JobFailed):
        jobs.run_all({"batches": {}}, jobs.FakeClient(str, fails={"request-part-0002": "boom"}), shards)
    legacy = {"batches": {"request": {"batch_id": "batch-0", "status": "in_progress"}}}
    client = jobs.FakeClient(str, fails={"request": jobs.OVERSIZED})
    client.submit("request", [])
    jobs.run_all(legacy, client, shards)
    assert legacy["failed_attempts"][0]["reason"] == "replaced_by_shards" and set(legacy["batches"]) == set(shards)


def test_results_do_not_depend_on_partitions(spark):
    rows = [(i, "request" if i % 3 else "duty_role") for i in range(50)]
    d = spark.createDataFrame(rows, "source_idx long, input_format string")
    views = [sorted(map(str, O.audit_sample(x, 7, 1).collect())) for x in (d.coalesce(1), d.repartition(9))]
    assert views[0] == views[1] and list(itertools.chain(*views))


def test_inputs_are_normalised(spark, tmp_path):
    import hashlib

    lines = ['{"source_idx": 3, "scenario": "s", "excuse": "e", "label": null}', '{"source_idx": 3, "scenario": "t", "excuse": "e"}', '{"target_id": null, "scenario": "u", "excuse": "e"}', '{"input_format": null, "scenario": "u", "excuse": "e"}']
    d, bad = normalize.normalize_inputs(spark.createDataFrame(list(enumerate(lines)), "ordinal long, json string"), "request", "cases")
    assert sorted(tuple(r) for r in bad.collect()) == [(1, "duplicate_reference"), (3, "duplicate_reference"), (3, "wrong_type")]
    assert [(r.source_reference.source_idx, r.private_fields_present_in_source) for r in d.orderBy("ordinal").collect()] == [(3, ["label"]), (3, []), (2, []), (3, [])]
    j = spark.createDataFrame([('{"source_idx": null, "source_reference": {"source_idx": 5}}',), ('{"source_reference": {"source_idx": 5}}',)], "j string")
    assert [r[0] for r in j.select(normalize.present_or_nested(F.col("j"), "source_idx")).collect()] == [None, "5"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abc" * 1000)
    assert [(r.size, r.sha256) for r in readers.file_digests(spark, str(tmp_path / "f")).collect()] == [(3000, hashlib.sha256(b"abc" * 1000).hexdigest())]
