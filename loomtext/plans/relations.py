"""Relations derived from the driver's tables: one SQL text each, valid in Spark and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.sources.scratch import widened

CASES = """SELECT o_orderkey AS source_idx,
  CASE o_orderkey % 6
    WHEN 0 THEN concat('Could you ship order ', CAST(o_orderkey AS STRING), '?')
    WHEN 1 THEN concat('I am a  clerk for order ', CAST(o_orderkey AS STRING))
    WHEN 2 THEN 'Go home now'
    WHEN 3 THEN 'I work nights. Could you help?'
    WHEN 4 THEN concat('As the manager of ', o_orderpriority)
    ELSE 'The parcel is late' END AS scenario,
  CASE o_orderkey % 5
    WHEN 0 THEN 'No because it was already shipped.'
    WHEN 1 THEN 'So I should file the   report.'
    WHEN 2 THEN 'But the truck broke.'
    WHEN 3 THEN 'I should call.'
    ELSE 'Because it rained.' END AS excuse,
  CAST(o_custkey % 2 AS INT) AS label
FROM orders"""
DILEMMAS = """SELECT concat('S', CAST(o_orderkey AS STRING)) AS scenario_id, o_orderkey AS source_idx,
  CASE o_orderkey % 5
    WHEN 0 THEN 'A doctor may lie to the court about a death.'
    WHEN 1 THEN 'A soldier is ordered to attack; killing would follow.'
    WHEN 2 THEN 'A friend asks to keep a promise and a secret.'
    WHEN 3 THEN 'An afterlife lawn party starts late.'
    ELSE 'An employee could steal from the employer, which is illegal.' END AS context,
  'Tell the truth.' AS action1,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Break the contract.' ELSE 'Wait quietly.' END AS action2,
  CASE o_orderkey % 4 WHEN 0 THEN '1' WHEN 1 THEN 'Option_2' WHEN 2 THEN 'a' ELSE 'b' END AS choice,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Tell the truth.' ELSE '' END AS chosen_action
FROM orders"""
RAW_OUTPUTS = """SELECT o_orderkey AS source_idx, CAST(o_orderkey % 10 AS INT) AS tmpl,
  CASE o_orderkey % 10
    WHEN 0 THEN 'Because of this. Final answer: 1'
    WHEN 1 THEN 'Final  answer: 1'
    WHEN 2 THEN 'Final verdict: 0'
    WHEN 3 THEN 'verdict: 1'
    WHEN 4 THEN '{"verdict": 1}'
    WHEN 5 THEN concat('Answer: 0', chr(10), 'Final answer: 1')
    WHEN 6 THEN 'Answer: 10'
    WHEN 7 THEN '**Final answer**: 1'
    WHEN 8 THEN concat('Some reasoning.', chr(10), '**1**')
    ELSE '' END AS raw_output
FROM orders"""
PREDICTIONS = """SELECT o_orderkey AS source_idx,
  CASE WHEN o_orderkey % 3 = 0 THEN 'request' ELSE 'duty_role' END AS input_format,
  CAST(o_custkey % 2 AS INT) AS gold_verdict,
  -(CAST(o_orderkey % 7 AS DOUBLE)) / 2.0 AS score0,
  -(CAST(o_custkey % 5 AS DOUBLE)) / 2.0 AS score1,
  (o_orderkey % 11 <> 0) AS completed
FROM orders"""
SKILLS = """SELECT o_orderkey AS source_idx,
  CASE o_orderkey % 6
    WHEN 0 THEN '  ## Skill description:  Assess whether the stated reason is  a genuine obstacle that releases the person from the request. '
    WHEN 1 THEN '"Assess the duty."'
    WHEN 2 THEN concat('Skills: Weigh the', chr(10), 'role')
    WHEN 3 THEN ''
    WHEN 4 THEN '''Assess if the role, its ordinary scope and its core obligations make the proposed responsibility a fitting one here.'''
    ELSE 'skill: "' END AS raw,
  CASE o_orderkey % 4
    WHEN 0 THEN concat('<think>a', chr(10), 'b</think>Reasoning: It rained. So  the trip was off.')
    WHEN 1 THEN '<|im_start|>Rationale : <think>open end'
    WHEN 2 THEN 'One. Two! Three? Four. Five "quoted." Six'
    ELSE 'no sentence end but many words here , ; :' END AS rationale,
  CAST(o_orderkey % 13 AS INT) AS prompt_tokens, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS INT) END AS completion_tokens
FROM orders"""


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: widened(spark.read.parquet(f"{sf_dir}/{t}.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")) for t in ("orders",)}
    escaped = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(escaped.replace("FROM orders", "FROM {orders}"), **tables)
