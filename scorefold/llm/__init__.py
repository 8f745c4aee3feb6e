"""Operators for preparing training text; each module holds one operator, its registered query and, where SQL can say it, its twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ["toxicity", "simhash", "chat", "decontaminate", "langid", "quality", "urls", "secrets", "mixing", "linededup", "phrases", "manifest", "exactdedup"]


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL twin when there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    """Import every operator module and the pipeline, which fills the registry."""
    for m in MODULES:
        importlib.import_module(f"scorefold.llm.{m}")
    pipeline = importlib.import_module("corpus_pipeline")
    QUERIES["pipeline"] = pipeline.run
    if pipeline.ORACLE_SQL is not None:
        ORACLES["pipeline"] = pipeline.ORACLE_SQL
