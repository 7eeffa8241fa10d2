"""The six stages from raw cases to metrics, each a function from tables to tables; parameters are arguments.

Stages write only where a path is given. Constraints are enforced before anything that depends on them is written.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions import parsing as P
from loomtext.functions import prompts as M
from loomtext.functions import text as X
from loomtext.operators import constraints as C
from loomtext.operators import joins as J
from loomtext.operators import lexicon as L
from loomtext.operators import metrics as A
from loomtext.operators import rawrows as N
from loomtext.operators import routing as R
from loomtext.operators import scoring as S
from loomtext.operators import selection as O
from loomtext.operators import validators as V
from loomtext.plans import jobs
from loomtext.sources import writers as W
from loomtext.sources.scratch import fresh_path, materialized
from loomtext.streaming.resume import run_pending


def curate_cases(raw: DataFrame, prefix: str = "H", expected_rows: int = 0, out: str | None = None, overwrite: bool = False, allow_ambiguous: bool = False, inputs: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Raw cases (source_idx, scenario, excuse, label) -> public views by format, private labels, audit, counts. The summary
    beside the written views holds their digests and those of the files of ``inputs`` (path by name)."""
    n = raw.count()
    if expected_rows and n != expected_rows:
        raise C.ConstraintError(f"row count: {[(expected_rows, n)]}")
    cases = R.routed(raw).withColumn("target_id", X.padded_id(prefix, F.col("source_idx"), n)).withColumn("label", P.strict_label(F.col("label")))
    cases = materialized(cases, "cases")
    V.check(cases, "source_idx", {"empty scenario or response": (F.col("scenario") == "") | (F.col("excuse") == ""), "label is neither 0 nor 1": F.col("label").isNull()}, unique=False)
    views = R.split_views(cases)
    for f in R.FORMATS:
        if leaked := C.leaked_columns(views[f], C.FORBIDDEN):
            raise C.ConstraintError(f"public columns hold {leaked}")
    views["counts"] = A.domain_counts(cases, "input_format", (*R.FORMATS, "ambiguous"), "label")
    views["duplicates"] = A.duplicate_stats(cases, "scenario", "scenario", "excuse")
    if out:
        for name, df in views.items():
            W.write_jsonl(df, f"{out}/{name}", "overwrite" if overwrite else "errorifexists")
        W.write_document(W.manifest({k: views[k] for k in (*R.FORMATS, "ambiguous", "private")}, inputs, prefix=prefix, rows=n), f"{out}/summary.json")
        W.fail_on_ambiguous(views["ambiguous"].select("target_id"), allow_ambiguous)
    return views


def categorize_dilemmas(raw: DataFrame, mode: str = "context", overrides: DataFrame | None = None, expected_rows: int = 0, seed_count: int = 16, seed: int = 0, tie_mode: str = "hash") -> dict[str, DataFrame]:
    """Dilemmas (scenario_id, source_idx, context, action1, action2) -> categorized, ambiguous, seeds, template, counts."""
    C.positive(seed_count=seed_count)
    V.check(raw, "scenario_id", {"missing fields": V.not_empty("scenario_id", "context", "action1", "action2")}, expected_rows=expected_rows)
    if overrides is not None:
        C.enforce(overrides.select("scenario_id").join(raw.select("scenario_id"), "scenario_id", "left_anti"), "overrides of unknown rows")
    rows = raw.withColumn("context", X.collapse(F.col("context")))
    all_rows = materialized(L.categorized(rows, mode, overrides=overrides), "categorized")
    ambiguous, good = all_rows.where("needs_human_review"), all_rows.where("NOT needs_human_review")
    picked = O.seed_cover(good, seed_count, seed, tie_mode)
    seeds = good.join(F.broadcast(picked), "scenario_id").select(
        F.format_string("seed_%02d", "seed_no").alias("seed_id"),
        F.struct("scenario_id", "source_idx").alias("source_reference"),
        "moral_categories",
        L.descriptions(F.col("moral_categories")).alias("category_descriptions"),
        F.struct("context", "action1", "action2").alias("input"),
        F.lit("").alias("skill_description"),
    )
    return {"categorized": good, "ambiguous": ambiguous, "seeds": seeds, "template": W.override_template(ambiguous), "counts": L.category_counts(all_rows), "audit": all_rows}


def prepare_requests(cases: DataFrame, seeds: DataFrame, fmt: str, model: str, prefix: str = "case", shard_size: int = 500, bank_size: int = 16, max_tokens: int = 120) -> DataFrame:
    """Cases of one format -> custom_id, order, shard and the request as JSON."""
    C.positive(shard_size=shard_size, max_tokens=max_tokens)
    C.enforce(C.seed_bank(seeds, fmt, bank_size), "seed bank")
    C.enforce(C.duplicates(cases, "source_idx"), "cases given twice")
    C.enforce(J.shared_keys(cases, seeds.where("source_idx IS NOT NULL"), "source_idx") if "source_idx" in seeds.columns else cases.limit(0), "cases that are seeds too")
    d = O.with_ordinal(cases, "source_idx", name="order", start=1)
    d = M.few_shot_prompts(d, seeds, fmt).withColumn("custom_id", O.custom_id(prefix, F.lit(fmt), F.col("order")))
    return d.withColumn("shard", O.shard_key(F.lit(fmt), F.col("order"), shard_size)).withColumn("request", F.to_json(M.request(F.col("custom_id"), F.col("prompt"), model, max_tokens)))


class _Shards(Mapping):
    """The request lines of each shard in order; only those asked for are on the driver, a shard at a time."""

    def __init__(self, requests: DataFrame):
        # Written by shard, so that asking for one reads its own piece.
        path = fresh_path(requests.sparkSession, "requests")
        requests.select("shard", "order", "request").repartition("shard").write.partitionBy("shard").parquet(path)
        self.requests = requests.sparkSession.read.schema("order long, request string, shard string").parquet(path)
        self.names = [r[0] for r in self.requests.select("shard").distinct().orderBy("shard").collect()]

    def __getitem__(self, name: str) -> list[str]:
        return [r[0] for r in self.requests.where(F.col("shard") == name).orderBy("order").select("request").collect()]

    def __iter__(self):
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def send_requests(requests: DataFrame, client: jobs.BatchClient, path: str, state: dict | None = None, save: Callable[[dict], None] = lambda _: None, wait: float = 0.0, single_step: bool = False) -> DataFrame | None:
    """Sends the shards one after another and writes each shard's answers under ``path``: (value), one row a line.

    ``state`` is that of an earlier call: complete jobs are not sent again, running ones are looked at, answers that are
    written are not fetched again. ``save`` gets it after every step. With ``single_step`` one look and at most one
    submission are made, and None is returned until all is complete.
    """
    spark, shards, state = requests.sparkSession, _Shards(requests.withColumn("order", F.col("order").cast("long"))), state if state is not None else {}
    state.setdefault("batches", {})
    while True:
        did = jobs.step(state, client, shards)
        save(state)
        for name, entry in state["batches"].items():
            if entry.get("status") == jobs.COMPLETED and entry.get("output_file_id") and not entry.get("written"):
                lines = client.download(entry["output_file_id"])
                spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
                entry["written"] = True
                save(state)
        if did == "done":
            break
        if single_step:
            return None
        time.sleep(wait)
    return spark.read.schema("value string").parquet(*(f"{path}/{name}" for name in shards.names)) if shards.names else spark.createDataFrame([], "value string")


#: What a response line holds.
RESPONSE = "custom_id string, error string, response struct<status_code int, body struct<model string, choices array<struct<message struct<content string>>>, usage struct<prompt_tokens bigint, completion_tokens bigint, total_tokens bigint>>>"


def materialize_skills(requests: DataFrame, responses: DataFrame) -> dict[str, DataFrame]:
    """Requests ⋈ responses (RESPONSE) -> skills with checks, usage totals, failures."""
    joined, bad = J.batch_results(requests, responses)
    C.enforce(bad, "requests and responses differ")
    content = F.get("response.body.choices", F.lit(0))["message"]["content"]
    problem = C.response_problem(F.col("error"), F.col("response.status_code"), F.col("response.body.choices"), content)
    C.enforce(joined.where(problem.isNotNull()).select("custom_id", problem), "responses that cannot be used")
    skills = joined.withColumn("raw_generation", content).withColumn("skill_description", X.clean_skill(F.col("raw_generation"))).withColumn("format_checks", X.skill_checks(F.col("skill_description")))
    skills = skills.withColumn("format_valid", F.col("format_checks.starts_with_assess") & F.col("format_checks.single_line") & F.col("format_checks.word_count_in_range")).withColumn("usage", F.col("response.body.usage"))
    flat = skills.select("order", "custom_id", "format_valid", "usage.*")
    kept = skills.drop("request", "response", "error", "prompt")
    failures, failing = A.format_failures(flat, "format_valid", "order", "custom_id")
    return {"skills": kept, "usage": A.usage_totals(flat, "prompt_tokens", "completion_tokens", "total_tokens"), "failures": failures, "failing": failing}


def freeze_queries(skills: DataFrame, labels: DataFrame, expected_rows: int = 0) -> dict[str, DataFrame]:
    """Skills and labels, joined strictly 1:1 by source_idx -> public queries and private labels.

    Both are raw JSON lines (json), whose keys are looked at row by row (``rawrows``), or both are typed columns. Skills may
    hold no label, at the top or in ``input``; the label is the first filled one of its four names.
    """
    if "json" in skills.columns:
        skills, named = materialized(N.skill_rows(skills), "skill-rows"), materialized(N.label_rows(labels), "label-rows")
        rules = {f"skills: {p}": N.has_problem(p) for p in N.SKILL_PROBLEMS}
        right = {f"labels: {p}": N.has_problem(p) for p in N.LABEL_PROBLEMS}
        skills, checked, named_checked = skills.drop("leaked", "problems"), skills, named
        named = named.drop("problems")
    else:
        nested = skills.schema["input"].dataType.names if "input" in skills.columns and isinstance(skills.schema["input"].dataType, T.StructType) else []
        if leaked := sorted(set(N.LABELS) & {*skills.columns, *nested}):
            raise C.ConstraintError(f"skills hold labels: {leaked}")
        names = [c for c in N.LABELS if c in labels.columns]
        if not names:
            raise C.ConstraintError(f"labels have none of the columns {N.LABELS}")
        target = F.col("target_id") if "target_id" in labels.columns else F.lit(None).cast("string")
        named = labels.select("source_idx", target.alias("label_target_id"), P.named_label(*(F.col(c) for c in names)).alias("gold_verdict"))
        checked, named_checked = skills, named
        rules = {"rows without a target id": V.not_empty("target_id"), "unknown format": V.outside("input_format", R.FORMATS), "missing fields": V.not_empty("scenario", "excuse", "skill_description")}
        right = {"labels that are neither 0 nor 1": F.col("gold_verdict").isNull()}
    V.check(checked, "source_idx", rules, named_checked, right, expected_rows)
    joined = skills.join(named, "source_idx")
    C.enforce(J.contradicted(joined, "target_id", "label_target_id").select("source_idx"), "target ids differ")
    return {"queries": joined.select(*R.PUBLIC, "skill_description"), "labels": joined.select("target_id", "source_idx", "input_format", "gold_verdict")}


def _freeze_raw_exemplars(lines: DataFrame, source: DataFrame, expected_rows: int) -> DataFrame:
    skills, own = materialized(N.exemplar_skill_rows(lines), "exemplar-skills"), materialized(N.exemplar_source_rows(source), "exemplar-source")
    V.check(skills, "scenario_id", {p: N.has_problem(p) for p in N.EXEMPLAR_PROBLEMS}, own, {}, expected_rows, more_right=True)
    d = skills.drop("problems").join(own, "scenario_id")
    d = d.withColumn("chosen_action", P.chosen_action(F.col("chosen_action"), F.col("choice"), F.col("action1"), F.col("action2")))
    differs = (F.col("skill_context") != "") & (F.col("skill_context") != F.col("context"))
    V.check(d, "scenario_id", {"missing fields": V.not_empty("context", "action1", "action2", "thought_process"), "contexts differ": differs, "choices that cannot be resolved": F.col("chosen_action").isNull()})
    framework = F.when(F.col("source_framework") != "", F.col("source_framework")).otherwise(F.col("skill_framework"))
    return d.select(F.col("scenario_id").alias("exemplar_id"), "scenario_id", "source_idx", framework.alias("framework"), "moral_categories", "skill_description", "context", "action1", "action2", "chosen_action", "thought_process")


def freeze_exemplars(skills: DataFrame, source: DataFrame, expected_rows: int = 0) -> DataFrame:
    """Exemplar skills (scenario_id, context, ...) looked up in their source: chosen action and thought process join.

    Where skills are raw JSON lines (json), ``source`` holds the text columns of a CSV, two of which may have other names, and
    an exemplar's id is its scenario's.
    """
    if "json" in skills.columns:
        return _freeze_raw_exemplars(skills, source, expected_rows)
    own = source.select("scenario_id", F.col("context").alias("source_context"), *(c for c in source.columns if c in ("choice", "chosen_action", "thought_process")))
    V.check(skills, "scenario_id", {}, own, {}, expected_rows, unique=False, more_right=True)
    C.enforce(C.duplicates(own, "scenario_id"), "source rows given twice")
    joined = skills.join(own, "scenario_id")
    out = joined.withColumn("chosen_action", P.chosen_action(F.col("chosen_action"), F.col("choice"), F.col("action1"), F.col("action2")))
    V.check(out, "scenario_id", {"contexts differ": (F.coalesce("context", F.lit("")) != "") & (F.coalesce("source_context", F.lit("")) != "") & (F.col("context") != F.col("source_context")), "choices that cannot be resolved": F.col("chosen_action").isNull()}, unique=False)
    out = O.with_ordinal(out.drop("source_context", "choice"), "scenario_id", name="_k", start=1)
    return out.withColumn("exemplar_id", F.format_string("exemplar_%06d", "_k")).drop("_k")


def _checked(public: DataFrame, labels: DataFrame, expected_rows: int) -> None:
    if leaked := C.leaked_columns(public, C.FORBIDDEN):
        raise C.ConstraintError(f"public columns hold {leaked}")
    V.check(public, "target_id", {}, labels, {}, expected_rows)


def evaluate_generated(queries: DataFrame, labels: DataFrame, make: Callable[[], S.Generator], path: str, expected_rows: int = 0, seed: int = 0) -> dict[str, DataFrame]:
    """Free text for each query, resumed at ``path``; parsed, joined to its label, and summed by format and overall."""
    _checked(queries, labels, expected_rows)
    public = queries.withColumn("prompt", M.checklist_prompt(X.strip_ends(F.col("scenario")), X.strip_ends(F.col("excuse"))))
    done = run_pending(public, path, "target_id", lambda d: S.generate_texts(d, make, M.SYSTEM, seed))
    parsed = P.with_verdict(done, "raw_output", "v").select("*", "v.*").drop("v").join(labels.select("target_id", "gold_verdict"), "target_id")
    parsed = parsed.withColumn("correct", F.coalesce(F.col("prediction") == F.col("gold_verdict"), F.lit(False)))
    every = queries.select("target_id", "input_format").join(parsed.select("target_id", "prediction", "correct", F.lit(True).alias("completed")), "target_id", "left")
    every = every.withColumn("completed", F.coalesce("completed", F.lit(False))).withColumn("correct", F.coalesce("correct", F.lit(False)))
    return {"predictions": parsed, "summary": A.accuracy_rollup(every)}


#: Flags of a rationale that the summary counts.
RATIONALE_FLAGS = ("rationale_was_empty", "rationale_was_clipped", "rationale_input_truncated", "rationale_hit_limit")


def evaluate_scored(cases: DataFrame, labels: DataFrame, make: Callable[[], S.Scorer], path: str, condition: str = "direct_verdict", generator: Callable[[], S.Generator] | None = None, expected_rows: int = 0, seed: int = 0, max_words: int = 80, max_sentences: int = 4) -> dict[str, DataFrame]:
    """Two completions scored for each case, blind and resumed at ``path``; labels join only when all are scored."""
    if condition not in ("direct_verdict", "rationale_verdict"):
        raise ValueError(f"unknown condition {condition!r}")
    C.positive(max_words=max_words, max_sentences=max_sentences)
    _checked(cases, labels, expected_rows)
    block = M.case_block(F.col("input_format"), F.col("scenario"), F.col("excuse"))

    def score(todo: DataFrame) -> DataFrame:
        if condition == "direct_verdict":
            return S.score_verdicts(todo.withColumn("prompt", M.verdict_prompt(block, F.lit(condition), F.lit(None).cast("string"))), make, M.SYSTEM)
        asked = todo.withColumn("prompt", M.rationale_prompt(block))
        counts = {"input_token_count": "rationale_input_tokens", "generated_token_count": "rationale_generated_tokens", "input_was_truncated": "rationale_input_truncated", "hit_max_new_tokens": "rationale_hit_limit"}
        texts = S.generate_texts(asked, generator, M.SYSTEM, seed).select("target_id", F.col("prompt").alias("rationale_prompt"), F.col("raw_output").alias("rationale_raw"), *(F.col(c).alias(n) for c, n in counts.items()))
        texts = texts.withColumn("_c", X.cap_rationale(X.strip_artifacts(F.col("rationale_raw")), max_words, max_sentences)).withColumn("_r", X.rationale_or(F.col("_c.text"), "No rationale was given."))
        texts = texts.select("*", F.col("_r.text").alias("rationale"), F.col("_r.was_empty").alias("rationale_was_empty"), F.col("_c.changed").alias("rationale_was_clipped")).drop("_c", "_r")
        d = todo.join(texts, "target_id")
        return S.score_verdicts(d.withColumn("prompt", M.verdict_prompt(block, F.lit(condition), F.col("rationale"))), make, M.SYSTEM, keep=tuple(c for c in texts.columns if c != "target_id"))

    blind = run_pending(cases, path, "target_id", score)
    C.enforce(J.key_set_diff(cases, blind, "target_id"), "cases without a prediction")
    out = J.late_labels(blind, labels)
    flags = RATIONALE_FLAGS if condition == "rationale_verdict" else ()
    return {"blind": blind, "predictions": out, "summary": A.report(out, flags, R.FORMATS), "classes": A.class_metrics(out), "by_format": A.accuracy_by(out, domain=R.FORMATS)}
