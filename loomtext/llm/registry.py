"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import importlib

MODULES = ["toxicity", "suffixdedup", "jaccard", "decontam", "media", "mixing", "linededup", "urlfilter", "chat", "warc", "centroids", "whitening", "tokenfiles"]


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"loomtext.llm.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
