"""Registered queries: a Spark callable and, where SQL can say it, the oracle text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strandline.plans.fixtures import FIXTURES, Tables


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[Tables], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a survey id."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"registered twice: {name}")
        REGISTRY[name] = Entry(name, fn, oracle)
        return fn

    return wrap


def _named_sources(text: str) -> list[str]:
    return [w for w in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text, re.I) if w in FIXTURES]


def oracle_text(body: str) -> str:
    """Put the derived tables an oracle reads in front of it as CTEs."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for inner in re.findall(r"\{(\w+)\}", FIXTURES[name]):
            if inner in FIXTURES:
                need(inner)
        order.append(name)

    for source in _named_sources(body):
        need(source)
    ctes = [f"{name} AS ({re.sub(r'[{}]', '', FIXTURES[name])})" for name in order]
    body = body.strip()
    if body.upper().startswith("WITH "):
        own = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I)
        return "WITH RECURSIVE " + ", ".join([*ctes, own])
    return f"WITH RECURSIVE {', '.join(ctes)} {body}" if ctes else body


def load_all() -> dict[str, Entry]:
    from strandline.plans import (  # noqa: F401
        aggregate_queries,
        filter_queries,
        function_queries,
        join_queries,
        source_queries,
        stream_queries,
        template_queries,
        window_queries,
    )

    return REGISTRY


def spark_callable(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entry.run(Tables(spark, sf_dir))

    call.__name__ = entry.name
    return call
