"""Case blocks, prompts and requests as Column expressions. The prompt texts are this library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "You judge one short case at a time. Rely on what the case states and on nothing else; add no facts and no examples."
DIRECT = "Give the verdict alone. The verdict is 1 if the excuse or responsibility is reasonable, else 0."
RATIONALE = "In two to four short sentences of at most 80 words in all, weigh whether the excuse or responsibility is reasonable. State no verdict and add no heading."
VERDICT = 'Give the verdict as one of two JSON objects and nothing more: {"verdict": 0} or {"verdict": 1}.'
TASK = "A case either asks whether an excuse releases someone from a request, or whether a responsibility follows from a role."
CHECKLIST = "Weigh only what the facts support: the task is done or impossible, another duty comes first, the responsibility belongs to the role."
DEMONSTRATIONS = "The demonstrations, if any, come from other cases; none of their facts carry over."
CLOSING = "Explain the judgment in three to six sentences. End with `Final answer: 0` or `Final answer: 1`."
FEW_SHOT = "Write one sentence that names the skill the case calls for and starts with Assess."

#: The headings of a case block by format.
BLOCKS = {"request": ("request or excuse", "Scenario", "Proposed excuse"), "duty_role": ("role or responsibility", "Role or context", "Proposed responsibility")}
#: The same in the style of demonstrations.
DEMO = {"request": ("request", "Proposed excuse or duty claim"), "duty_role": ("role", "Proposed responsibility")}


def case_block(fmt: Column, scenario: Column, excuse: Column) -> Column:
    """Three headed lines; a format that is not known raises."""
    out = F.when(F.lit(False), F.lit(""))
    for name, (kind, first, second) in BLOCKS.items():
        out = out.when(fmt == name, F.concat_ws("\n", F.lit(f"Case format: {kind}"), F.concat(F.lit(f"{first}: "), scenario), F.concat(F.lit(f"{second}: "), excuse)))
    return out.otherwise(F.raise_error(F.concat(F.lit("unsupported format: "), F.coalesce(fmt, F.lit("null")))))


def neutral_block(scenario: Column, excuse: Column) -> Column:
    return F.concat(F.lit("Scenario: "), scenario, F.lit("\nProposed response or responsibility: "), excuse)


def demo_block(fmt: Column, scenario: Column, excuse: Column) -> Column:
    def one(kind, second):
        return F.concat(F.lit(f"### Case type: {kind}\n### Scenario: "), scenario, F.lit(f"\n### {second}: "), excuse)

    return F.when(fmt == "request", one(*DEMO["request"])).otherwise(one(*DEMO["duty_role"]))


def rationale_prompt(block: Column) -> Column:
    return F.concat_ws("\n\n", block, F.lit(RATIONALE))


def verdict_prompt(block: Column, condition: Column, rationale: Column) -> Column:
    """Block, the rationale under the rationale condition or the instruction under the direct one, the verdict form."""
    middle = F.when(condition == "rationale_verdict", F.concat(F.lit("Candidate reasoning trace:\n"), F.coalesce(rationale, F.lit("")))).when(condition == "direct_verdict", F.lit(DIRECT))
    return F.concat_ws("\n\n", F.array_compact(F.array(block, middle, F.lit(VERDICT))))


def direct_prompt(block: Column) -> Column:
    return F.concat_ws("\n\n", block, F.lit(DIRECT), F.lit(VERDICT))


def checklist_prompt(scenario: Column, excuse: Column, demonstrations: str = "[]") -> Column:
    head = "\n\n".join([TASK, CHECKLIST, DEMONSTRATIONS, f"OPTIONAL DEMONSTRATIONS:\n{demonstrations}"])
    case = F.concat(F.lit("TARGET CASE:\nScenario: "), scenario, F.lit("\nProposed excuse or responsibility: "), excuse)
    return F.concat_ws("\n\n", F.lit(head), case, F.lit(CLOSING))


def seed_text(seeds: DataFrame, fmt: str) -> DataFrame:
    """One row: the instruction and all demonstrations, folded once. ``seeds`` is a bank of fixed size (16)."""
    block = demo_block(F.lit(fmt), F.col("scenario"), F.col("excuse"))
    part = F.struct("position", F.concat(F.format_string("### Demonstration %d\n", "position"), block, F.lit("\n### Skills: "), F.col("skill_description")).alias("part"))
    listed = F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"])
    return seeds.agg(F.concat_ws("\n\n", F.lit(FEW_SHOT), F.array_join(listed, "\n\n")).alias("demonstrations"))


def few_shot_prompts(cases: DataFrame, seeds: DataFrame, fmt: str) -> DataFrame:
    """``cases`` with ``prompt``; the seed side is one row by construction, so it is broadcast."""
    new = F.concat(F.lit("### New case\n"), demo_block(F.lit(fmt), F.col("scenario"), F.col("excuse")), F.lit("\n### Skills:"))
    return cases.join(F.broadcast(seed_text(seeds, fmt)), F.lit(True)).withColumn("prompt", F.concat_ws("\n\n", "demonstrations", new)).drop("demonstrations")


def request(custom_id: Column, prompt: Column, model: str, max_tokens: int = 120) -> Column:
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message).alias("messages"), F.lit(0).alias("temperature"), F.lit(max_tokens).alias("max_tokens"))
    return F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))
