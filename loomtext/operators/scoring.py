"""Model inference behind injected interfaces: one model a worker, batches as Arrow feeds them.

The box has no model and no network; ``Deterministic`` stands in for both interfaces in tests and queries.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.parsing import by_label, softmax2
from loomtext.functions.text import SENTENCE_END, prompt_digest


@dataclass
class Generation:
    text: str
    input_tokens: int
    generated_tokens: int
    input_truncated: bool
    hit_limit: bool


class Scorer(Protocol):
    def score(self, system: str, prompts: list[str], completion: str) -> list[tuple[float, int, int]]:
        """(log probability, input tokens, completion tokens) of the exact completion after each prompt."""


class Generator(Protocol):
    def generate(self, system: str, prompts: list[str], seeds: list[int]) -> list[Generation]: ...


class InputTooLong(ValueError):
    pass


def render(system: str, prompt: str, template: Callable | None = None) -> str:
    """A chat rendering; a template that does not know the thinking flag is called without it."""
    messages = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
    if template is None:
        return "\n".join(f"[{m['role']}] {m['content']}" for m in messages)
    try:
        return template(messages, enable_thinking=False)
    except (TypeError, ValueError):
        return template(messages)


def enough_sentences(text: str, most: int) -> bool:
    """The stop rule of bounded generation."""
    return len(re.findall(SENTENCE_END, text)) >= most


@lru_cache(1 << 12)
def ends_in(word: str) -> int:
    """The sentences that end in one word: those of words with spaces between add up."""
    return len(re.findall(SENTENCE_END, word))


class Deterministic:
    """Scores and texts that follow from a digest of the input."""

    def __init__(self, max_input: int = 4096, max_new: int = 128, max_sentences: int = 4):
        self.max_input, self.max_new, self.max_sentences = max_input, max_new, max_sentences

    def score(self, system, prompts, completion):
        out = []
        for p in prompts:
            tokens = len(render(system, p).split())
            if tokens > self.max_input:
                raise InputTooLong(f"{tokens} tokens, {self.max_input} are allowed")
            h = hashlib.sha256(f"{p}\0{completion}".encode()).digest()
            out.append((-(h[0] + 1) / 64.0, tokens, len(completion.split())))
        return out

    def generate(self, system, prompts, seeds):
        out = []
        for p, seed in zip(prompts, seeds, strict=True):
            tokens = render(system, p).split()
            h = hashlib.sha256(f"{p}\0{seed}".encode()).digest()
            words: list[str] = []
            ends = 0
            while len(words) < self.max_new and ends < self.max_sentences:
                words.append(f"w{h[len(words) % 32] % 10}" + ("." if len(words) % 9 == 8 else ""))
                ends += ends_in(words[-1])
            text = " ".join(words) + f" Final answer: {h[0] % 2}"
            out.append(Generation(text, min(len(tokens), self.max_input), len(words), len(tokens) > self.max_input, len(words) >= self.max_new))
        return out


#: The model of this worker, by the call that scores with it: workers are reused, and another call may bring another model.
_MODELS: dict[str, object] = {}


def _model(key: str, make: Callable[[], object]):
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = make()
    return _MODELS[key]


PUBLIC = ("target_id", "source_idx", "input_format", "prompt")
COMPLETIONS = ('{"verdict": 0}', '{"verdict": 1}')


def score_verdicts(public: DataFrame, make: Callable[[], Scorer], system: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Blind predictions: the two completions scored on the public columns only, softmax, a tie going to 0; ``keep`` passes through."""
    rows, key = public.select(*PUBLIC, *keep), uuid.uuid4().hex
    schema = rows.schema.simpleString()[7:-1] + ",score0:double,score1:double,verdict_input_tokens:bigint,completion_tokens_0:bigint,completion_tokens_1:bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(key, make)
        for b in batches:
            a, z = (model.score(system, b["prompt"].tolist(), c) for c in COMPLETIONS)
            yield b.assign(score0=[x[0] for x in a], score1=[x[0] for x in z], verdict_input_tokens=[x[1] for x in a], completion_tokens_0=[x[2] for x in a], completion_tokens_1=[x[2] for x in z])

    scored = rows.mapInPandas(run, schema.replace(":", " ")).withColumn("_s", softmax2(F.col("score0"), F.col("score1")))
    return scored.select(
        *PUBLIC, *keep, prompt_digest(system, F.col("prompt")).alias("decision_prompt_sha256"), F.col("score0").alias("label_logprob_0"), F.col("score1").alias("label_logprob_1"), F.col("_s.p0").alias("probability_0"),
        F.col("_s.p1").alias("probability_1"), F.col("_s.verdict").alias("predicted_verdict"), "verdict_input_tokens", "completion_tokens_0", "completion_tokens_1",
    )


def generate_texts(public: DataFrame, make: Callable[[], Generator], system: str, seed: int = 0) -> DataFrame:
    """Generated texts with token accounting; a row's seed is ``seed + source_idx``."""
    rows, key = public.select(*PUBLIC), uuid.uuid4().hex
    schema = rows.schema.simpleString()[7:-1].replace(":", " ") + ",raw_output string,input_token_count bigint,generated_token_count bigint,input_was_truncated boolean,hit_max_new_tokens boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(key, make)
        for b in batches:
            g = model.generate(system, b["prompt"].tolist(), [seed + int(i) for i in b["source_idx"]])
            yield b.assign(raw_output=[x.text for x in g], input_token_count=[x.input_tokens for x in g], generated_token_count=[x.generated_tokens for x in g], input_was_truncated=[x.input_truncated for x in g], hit_max_new_tokens=[x.hit_limit for x in g])

    return rows.mapInPandas(run, schema)


def with_gold(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    out = predictions.join(labels.select("target_id", "gold_verdict"), "target_id")
    return out.withColumn("correct", F.col("predicted_verdict") == F.col("gold_verdict")).withColumn("gold_probability", by_label(F.col("gold_verdict"), F.col("probability_0"), F.col("probability_1")))
