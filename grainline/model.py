"""The semantic model: plain frozen objects, without Spark."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

from grainline.functions.dsl import Expr
from grainline.sources.schema import TableSchema

AGGREGATIONS = ("sum", "avg", "min", "max", "count", "count_distinct")
CARDINALITIES = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")


@dataclass(frozen=True)
class Issue:
    path: str
    code: str
    message: str


@dataclass(frozen=True, kw_only=True)
class Named:
    name: str
    description: str = ""
    status: str = "active"
    replaced_by: str | None = None


@dataclass(frozen=True, kw_only=True)
class DataSource(Named):
    kind: str
    options: Mapping[str, Any]
    schema: TableSchema
    grain: tuple[str, ...]


@dataclass(frozen=True, kw_only=True)
class Dimension(Named):
    source: str
    column: str
    data_type: str


@dataclass(frozen=True, kw_only=True)
class Fact(Named):
    source: str
    data_type: str
    expression: Expr


@dataclass(frozen=True, kw_only=True)
class Measure(Named):
    fact: str
    aggregation: str


@dataclass(frozen=True, kw_only=True)
class Metric(Named):
    expression: Expr
    measures: tuple[str, ...]


@dataclass(frozen=True, kw_only=True)
class Relationship(Named):
    source: str
    target: str
    type: str
    source_column: str
    target_column: str

    def other(self, source: str) -> str:
        return self.target if source == self.source else self.source

    def expands(self, start: str) -> bool:
        """Whether a step from start may multiply rows."""
        return {"one_to_one": False, "one_to_many": start == self.source, "many_to_one": start == self.target, "many_to_many": True}[self.type]


@dataclass(frozen=True, kw_only=True)
class SemanticLayer:
    version: int
    name: str
    label: str = ""
    description: str = ""
    data_sources: Mapping[str, DataSource] = field(default_factory=dict)
    dimensions: Mapping[str, Dimension] = field(default_factory=dict)
    facts: Mapping[str, Fact] = field(default_factory=dict)
    measures: Mapping[str, Measure] = field(default_factory=dict)
    metrics: Mapping[str, Metric] = field(default_factory=dict)
    relationships: Mapping[str, Relationship] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for kind in KINDS.values():
            object.__setattr__(self, kind, MappingProxyType(dict(getattr(self, kind))))

    def objects(self) -> dict[str, Named]:
        """Every object by its typed id, sorted: source.orders, metric.revenue."""
        return dict(sorted((f"{kind}.{name}", x) for kind, plural in KINDS.items() for name, x in getattr(self, plural).items()))

    def resolve(self, typed_id: str) -> Named:
        return self.objects()[typed_id]


KINDS = {"source": "data_sources", "dimension": "dimensions", "fact": "facts", "measure": "measures", "metric": "metrics", "relationship": "relationships"}
