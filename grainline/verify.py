"""Verification reports: static rules, planner compatibility, physical audits. Reports hold counts and codes only."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from itertools import combinations
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from grainline.errors import PlanningError, SourceError
from grainline.model import KINDS, SemanticLayer
from grainline.operators import audit
from grainline.plans.planner import Request, plan
from grainline.sources.readers import Profiles, prepare
from grainline.sources.schema import compare

#: What each planner code says in a report, without any name of the request.
PLANNER_MESSAGES = {
    "unknown_metric": "request references an unknown metric",
    "unknown_dimension": "request references an unknown dimension",
    "unknown_filter_dimension": "request filters an unknown dimension",
    "duplicate_output_name": "request reuses an output name across metrics and dimensions",
    "mixed_grain": "request metrics span incompatible grains",
    "no_relationship_path": "required sources have no relationship path",
    "row_expanding_path": "a required relationship path would expand rows",
    "ambiguous_relationship_path": "required sources have multiple relationship paths",
    "invalid_filter_type": "a filter value does not match its dimension type",
}


@dataclass(frozen=True)
class Outcome:
    check_id: str
    scope: str
    path: str
    status: str
    evidence: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Diagnostic:
    severity: str
    code: str
    path: str


@dataclass(frozen=True)
class Report:
    outcomes: tuple[Outcome, ...]
    diagnostics: tuple[Diagnostic, ...] = ()
    complete: bool = True

    @property
    def passed(self) -> bool:
        return self.complete and all(o.status == "passed" for o in self.outcomes) and all(d.severity != "error" for d in self.diagnostics)

    def to_json(self) -> str:
        return json.dumps({"passed": self.passed, "complete": self.complete, "outcomes": [asdict(o) for o in self.outcomes], "diagnostics": [asdict(d) for d in self.diagnostics]}, sort_keys=True)


@dataclass(frozen=True)
class StaticCheck:
    """Rules of the catalog alone."""


@dataclass(frozen=True)
class CompatibilityCheck:
    """What the planner accepts, and given requests."""

    cases: tuple[Request, ...] = ()


@dataclass(frozen=True)
class PhysicalCheck:
    """Full scans of all sources."""

    spark: SparkSession
    profiles: Profiles | None = None


def verify(layer: SemanticLayer, check: StaticCheck | CompatibilityCheck | PhysicalCheck) -> Report:
    match check:
        case StaticCheck():
            return static(layer)
        case CompatibilityCheck(cases):
            return compatibility(layer, cases)
        case PhysicalCheck(spark, profiles):
            return physical(layer, spark, profiles)
    raise TypeError("a check is static, of compatibility or physical")


def _report(outcomes: list[Outcome], diagnostics: list[Diagnostic], complete: bool = True) -> Report:
    return Report(tuple(sorted(outcomes, key=lambda o: (o.path, o.check_id))), tuple(sorted(diagnostics, key=lambda d: (d.severity, d.code, d.path))), complete)


def static(layer: SemanticLayer) -> Report:
    """The catalog is valid by construction; deprecations point to a replacement of their kind, without a cycle."""
    objects, found = layer.objects(), []
    old = {i: x for i, x in objects.items() if x.status == "deprecated"}
    for typed_id, x in old.items():
        kind = typed_id.split(".")[0]
        found.append(Diagnostic("info", "catalog.deprecation.notice", typed_id))
        if x.replaced_by is None:
            continue
        target, seen = f"{kind}.{x.replaced_by}", [typed_id]
        if target not in objects:
            other = any(f"{k}.{x.replaced_by}" in objects for k in KINDS)
            found.append(Diagnostic("error", f"catalog.deprecation.replacement_{'kind' if other else 'missing'}", typed_id))
        elif target == typed_id:
            found.append(Diagnostic("error", "catalog.deprecation.self_replacement", typed_id))
        else:
            while target in old and target not in seen and old[target].replaced_by:
                seen.append(target)
                target = f"{kind}.{old[target].replaced_by}"
            if target == typed_id:
                found.append(Diagnostic("error", "catalog.deprecation.cycle", typed_id))
    outcomes = [Outcome("catalog.static", "declaration", "catalog", "passed")]
    if old:
        failed = any(d.severity == "error" for d in found)
        outcomes.append(Outcome("catalog.deprecation", "declaration", "catalog", "failed" if failed else "passed", {"deprecated_count": len(old)}))
    return _report(outcomes, found)


def compatibility(layer: SemanticLayer, cases: Sequence[Request] = ()) -> Report:
    """Every metric, metric with dimension and pair of metrics, and given cases: which the planner accepts. A rejection is a result."""

    def outcome(name: str, request: Request) -> Outcome:
        try:
            found = plan(layer, request)
            evidence = {
                "compatible": True, "anchor_source": found.anchor, "required_sources": sorted(found.sources), "relationship_ids": sorted(r.name for r in found.joins),
                "selected_dimensions": [d.name for d in found.dimensions],
            }
            old = [x for x in (*found.metrics, *found.dimensions) if x.status == "deprecated"]
            if old:
                evidence |= {"deprecated_ids": sorted(x.name for x in old), "replacements": sorted(x.replaced_by for x in old if x.replaced_by)}
        except PlanningError as error:
            evidence = {"compatible": False, "planner_code": error.code, "message": PLANNER_MESSAGES[error.code]}
        return Outcome(f"compatibility.{name}", "planner", "compatibility", "passed", evidence)

    out = [outcome(f"metric.{m}", Request.of([m])) for m in layer.metrics]
    out += [outcome(f"metric_dimension.{m}.{d}", Request.of([m], [d])) for m in layer.metrics for d in layer.dimensions]
    out += [outcome(f"metric_pair.{a}.{b}", Request.of([a, b])) for a, b in combinations(sorted(layer.metrics), 2)]
    return _report(out + [outcome(f"explicit.{i:04}", case) for i, case in enumerate(cases)], [])


def physical(layer: SemanticLayer, spark: SparkSession, profiles: Profiles | None = None) -> Report:
    """Full scans: is every grain unique, does every relationship have its cardinality. A source that can't be read is unavailable."""
    outcomes, found, frames, complete = [], [], {}, True
    for name, source in sorted(layer.data_sources.items()):
        path = f"source.{name}.grain"
        try:
            ready = prepare(spark, source, profiles or Profiles())
            if compare(source.schema, ready.observed):
                raise SourceError("schema_mismatch", name)
            counts = audit.grain(ready.read(), source.grain).first().asDict()
            frames[name] = ready.read
        except (SourceError, PySparkException) as error:
            complete = False
            outcomes.append(Outcome(path, "full_scan", "physical", "unavailable", {"error_code": getattr(error, "code", "scan_failed")}))
            continue
        good = counts["null_grain_rows"] == counts["duplicate_grain_groups"] == 0
        evidence = {"connector": source.kind, "generation": 1, "snapshot": ready.snapshot, "schema_fingerprint": source.schema.fingerprint(), **counts}
        outcomes.append(Outcome(path, "full_scan", "physical", "passed" if good else "failed", evidence))
    for name, link in sorted(layer.relationships.items()):
        check_id = f"relationship.{name}.cardinality"
        if link.source not in frames or link.target not in frames:
            complete = False
            outcomes.append(Outcome(check_id, "full_scan", "physical", "unavailable", {"error_code": "bind_failed"}))
            continue
        ends = (frames[link.source](), link.source_column, frames[link.target](), link.target_column)
        if link.type == "many_to_one":
            ends = (*ends[2:], *ends[:2])
        count = {"one_to_one": audit.one_to_one, "many_to_many": audit.many_to_many}.get(link.type, audit.directed)
        counts = count(*ends).first().asDict()
        rules = {
            "one_side_null_rows": "one_side_null", "one_side_duplicate_groups": "one_side_duplicates", "orphan_non_null_rows": "many_side_orphans", "source_null_rows": "source_null",
            "source_duplicate_groups": "source_duplicates", "target_null_rows": "target_null", "target_duplicate_groups": "target_duplicates",
            "source_unmatched_non_null_rows": "source_unmatched", "target_unmatched_non_null_rows": "target_unmatched",
        }
        wrong = [] if link.type == "many_to_many" else [rules[k] for k, v in counts.items() if k in rules and v]
        found += [Diagnostic("error", f"relationship.{code}", check_id) for code in wrong]
        if link.type == "many_to_many":
            found.append(Diagnostic("info", "relationship.many_to_many_no_safe_traversal", check_id))
        outcomes.append(Outcome(check_id, "full_scan", "physical", "failed" if wrong else "passed", counts))
    if not complete:
        found.append(Diagnostic("error", "source.audit.unavailable", "physical"))
    return _report(outcomes, found, complete)
