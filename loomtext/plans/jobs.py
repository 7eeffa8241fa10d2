"""Remote batch jobs: a client interface, the transitions of a job as a table, and the polling loop, one active job at a time."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Status values of the remote service: fixed values.
FAILED = ("failed", "expired", "cancelled", "cancelling")
COMPLETED = "completed"
OVERSIZED = "token_limit_exceeded"


class BatchClient(Protocol):
    def submit(self, job_key: str, lines: list[str]) -> str: ...
    def status(self, batch_id: str) -> dict: ...
    def download(self, file_id: str) -> list[str]: ...


class JobFailed(RuntimeError):
    pass


@dataclass
class FakeClient:
    """An in-memory service: each job completes after ``polls`` looks; ``fails`` maps job keys to error codes."""

    answer: Callable[[str], str]
    polls: int = 2
    fails: dict[str, str] = field(default_factory=dict)
    jobs: dict[str, dict] = field(default_factory=dict)
    most_active: int = 0

    def submit(self, job_key, lines):
        batch_id = f"batch-{len(self.jobs)}"
        self.jobs[batch_id] = {"key": job_key, "lines": lines, "left": self.polls, "status": "in_progress"}
        self.most_active = max(self.most_active, sum(j["status"] == "in_progress" for j in self.jobs.values()))
        return batch_id

    def status(self, batch_id):
        j = self.jobs[batch_id]
        j["left"] -= 1
        if j["key"] in self.fails:
            j["status"] = "failed"
            return {"status": "failed", "errors": [self.fails[j["key"]]]}
        if j["left"] <= 0:
            j["status"] = COMPLETED
            return {"status": COMPLETED, "output_file_id": f"out-{batch_id}"}
        return {"status": "in_progress"}

    def download(self, file_id):
        return [self.answer(x) for x in self.jobs[file_id.removeprefix("out-")]["lines"]]


#: What follows from how a job stands: (status, what its errors are, whether it is a whole stream's) -> action. Any other
#: standing means that the job is waited for.
TRANSITIONS = {(COMPLETED, e, w): "keep" for e in ("none", "oversized", "other") for w in (False, True)} | {
    (s, e, w): "retire" if e == "oversized" and w else "fail" for s in FAILED for e in ("none", "oversized", "other") for w in (False, True)
}
WHOLE_STREAMS = ("request", "duty_role")


def standing(job_key: str, status: str | None, errors, whole: tuple[str, ...] = WHOLE_STREAMS) -> tuple[str | None, str, bool]:
    codes = {*(errors or ())}
    return status, "none" if not codes else "oversized" if codes == {OVERSIZED} else "other", job_key in whole


def job_actions(jobs: DataFrame, whole: tuple[str, ...] = WHOLE_STREAMS) -> DataFrame:
    """``jobs`` (job_key, status, error_codes) with ``action``: the transitions as a relation, joined to a table of any size."""
    table = jobs.sparkSession.createDataFrame([(*k, v) for k, v in TRANSITIONS.items()], "_status string, _errors string, _whole boolean, _action string")
    codes = F.array_distinct(F.coalesce("error_codes", F.array().cast("array<string>")))
    errors = F.when(F.size(codes) == 0, "none").when((F.size(codes) == 1) & F.array_contains(codes, OVERSIZED), "oversized").otherwise("other")
    same = (F.col("status") == F.col("_status")) & (errors == F.col("_errors")) & (F.col("job_key").isin(*whole) == F.col("_whole"))
    return jobs.join(F.broadcast(table), same, "left").withColumn("action", F.coalesce("_action", F.lit("wait"))).drop("_status", "_errors", "_whole", "_action")


def _action(key: str, entry: dict, client: BatchClient) -> str:
    """Looks at a job whose result is not known yet, notes what it sees, and says what follows."""
    if entry.get("output_file_id") and entry.get("status") == COMPLETED:
        return "keep"
    seen = client.status(entry["batch_id"])
    entry.update(status=seen["status"], output_file_id=seen.get("output_file_id"), errors=seen.get("errors"))
    action = TRANSITIONS.get(standing(key, entry["status"], entry["errors"]), "wait")
    return action if action != "keep" or entry["output_file_id"] else "wait"


def step(state: dict, client: BatchClient, shards: Mapping[str, list[str]]) -> str:
    """One look and at most one submission: ``done``, ``waiting`` or the key of the job submitted."""
    jobs = state["batches"]
    by: dict[str, list[str]] = {}
    for key in [*jobs]:
        by.setdefault(_action(key, jobs[key], client), []).append(key)
    for key in by.get("fail", ()):
        raise JobFailed(f"job {key} ended as {jobs[key]['status']}: {jobs[key]['errors']}")
    for key in by.get("retire", ()):  # what was too large as a whole is sent again in shards
        state["failed_attempts"] = [*state.get("failed_attempts", ()), {"job_key": key, "reason": "replaced_by_shards", **jobs.pop(key)}]
    if "wait" in by:
        return "waiting"
    for key in shards:
        if key not in jobs:
            jobs[key] = {"batch_id": client.submit(key, shards[key]), "status": "submitted"}
            return key
    return "done"


def run_all(state: dict, client: BatchClient, shards: dict[str, list[str]], wait: float = 0.0, save: Callable[[dict], None] = lambda _: None) -> dict[str, list[str]]:
    """Polls until all shards are complete; their outputs by shard."""
    while step(state, client, shards) != "done":
        save(state)
        time.sleep(wait)
    save(state)
    return {k: client.download(state["batches"][k]["output_file_id"]) for k in shards}
