"""Plans as DataFrames: joins, filters, one aggregation, one projection. Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainline.functions import dsl
from grainline.functions.columns import column
from grainline.model import SemanticLayer
from grainline.plans.planner import Equals, Filter, OneOf, Plan


def name_of(source: str, field: str) -> str:
    return f"{source}.{field}"


def _at(source: str, field: str) -> Column:
    return F.col(f"`{name_of(source, field)}`")


def needed_columns(layer: SemanticLayer, plan: Plan) -> dict[str, list[str]]:
    """The columns of each source that the plan reads."""
    out: dict[str, dict[str, None]] = {s: {} for s in plan.sources}
    for dimension in (*plan.dimensions, *(d for d, _ in plan.filters)):
        out[dimension.source][dimension.column] = None
    for measure in plan.measures:
        for source, field in dsl.references(layer.facts[measure.fact].expression):
            out[source][field] = None
    for link in plan.joins:
        out[link.source][link.source_column] = None
        out[link.target][link.target_column] = None
    return {s: list(c) for s, c in out.items()}


def predicate(target: Column, kind: T.DataType, f: Filter) -> Column:
    """A filter on a column; values of timestamps take the column's type. A null bound or value matches nothing."""

    def lit(value: object) -> Column:
        return F.lit(value).cast(kind) if value is None or isinstance(value, datetime) else F.lit(value)

    if isinstance(f, Equals):
        return target == lit(f.value)
    if isinstance(f, OneOf):
        return target.isin([lit(v) for v in f.members]) if f.members else F.lit(False)
    return (target >= lit(f.start)) & (target <= lit(f.end))


def aggregate(kind: str, value: Column, data_type: T.DataType) -> Column:
    decimal = isinstance(data_type, T.DecimalType)
    if kind == "sum" and decimal:
        return F.sum(value).cast(T.DecimalType(38, data_type.scale))
    if kind == "avg":
        return F.avg(value.cast("double"))
    return {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct}[kind](value)


def lower(layer: SemanticLayer, plan: Plan, read: Callable[[str, list[str]], DataFrame]) -> DataFrame:
    """The plan's DataFrame; read gives a source's columns."""
    wanted = needed_columns(layer, plan)

    def part(source: str) -> DataFrame:
        return read(source, wanted[source]).select(*[F.col(f"`{c}`").alias(name_of(source, c)) for c in wanted[source]])

    df, joined = part(plan.anchor), {plan.anchor}
    for link in plan.joins:
        fresh = [s for s in (link.source, link.target) if s not in joined]
        if fresh:  # an edge between joined sources adds nothing
            df = df.join(part(fresh[0]), _at(link.source, link.source_column) == _at(link.target, link.target_column), "inner")
            joined.add(fresh[0])
    for dimension, f in plan.filters:
        df = df.where(predicate(_at(dimension.source, dimension.column), df.schema[name_of(dimension.source, dimension.column)].dataType, f))
    facts = {m.name: column(layer.facts[m.fact].expression, lambda path: _at(*path)) for m in plan.measures}
    types = df.select(*[c.alias(n) for n, c in facts.items()]).schema
    sums = [aggregate(m.aggregation, facts[m.name], types[m.name].dataType).alias(f"m.{m.name}") for m in plan.measures]
    keys = [_at(d.source, d.column).alias(f"d.{d.name}") for d in plan.dimensions]
    grouped = df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)
    metrics = [column(m.expression, lambda path: F.col(f"`m.{path[0]}`")).alias(m.name) for m in plan.metrics]
    return grouped.select(*[F.col(f"`d.{d.name}`").alias(d.name) for d in plan.dimensions], *metrics)
