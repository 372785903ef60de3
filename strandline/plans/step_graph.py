"""A small graph of DataFrame steps: functions of their inputs, or SQL over them.

The graph only says which step reads which; every step is a lazy DataFrame, so
Catalyst still plans the whole as one query.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Step:
    name: str
    kind: str  # "pyspark" or "spark_sql"
    body: Callable[..., DataFrame] | str


@dataclass(frozen=True)
class Edge:
    source: str
    target: str


def step(name: str, fn: Callable[..., DataFrame]) -> Step:
    """A step that is a function of its inputs, given by name."""
    return Step(name, "pyspark", fn)


def sql_step(name: str, text: str) -> Step:
    """A step in SQL that reads its inputs as ``{input}``."""
    return Step(name, "spark_sql", text)


class StepGraph:
    def __init__(self, steps: Sequence[Step], edges: Sequence[Edge]):
        self.steps = {s.name: s for s in steps}
        self.edges = list(edges)
        if len(self.steps) != len(steps):
            raise ValueError("two steps have the same name")

    def order(self) -> list[str]:
        """Step names, inputs first; unknown steps, self-loops and cycles are refused."""
        for edge in self.edges:
            for end in (edge.source, edge.target):
                if end not in self.steps:
                    raise ValueError(f"unknown step: {end}")
            if edge.source == edge.target:
                raise ValueError(f"step reads itself: {edge.source}")
        sorter = TopologicalSorter({name: [] for name in self.steps})
        for edge in self.edges:
            sorter.add(edge.target, edge.source)
        try:
            return list(sorter.static_order())
        except CycleError as error:
            raise ValueError(f"steps form a cycle: {error.args[1]}") from error

    def run(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The DataFrame of every step."""
        done: dict[str, DataFrame] = {}
        for name in self.order():
            inputs = {e.source: done[e.source] for e in self.edges if e.target == name}
            body = self.steps[name].body
            done[name] = spark.sql(body, **inputs) if isinstance(body, str) else body(**inputs)
        return done
