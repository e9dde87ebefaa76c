"""Catalogs: YAML to a checked SemanticLayer. All issues are gathered, then raised together."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

import yaml

from grainline.errors import CatalogError, ExpressionError
from grainline.functions import dsl
from grainline.model import AGGREGATIONS, CARDINALITIES, DataSource, Dimension, Fact, Issue, KINDS, Measure, Metric, Relationship, SemanticLayer
from grainline.plans.paths import safe_path
from grainline.sources import schema as S

IDENTIFIER = re.compile(r"[a-z][a-z0-9_]*")
#: Connectors, the fields that they need and those that they may have.
CONNECTORS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "parquet": (("location",), ("credential_profile", "nullability")),
    "csv": (("location",), ("credential_profile", "delimiter", "quote_char", "escape_char", "has_header")),
    "delta": (("location",), ("credential_profile",)),
    "iceberg": (("catalog_profile", "namespace", "table"), ()),
    "sqlite": (("location", "relation"), ("key", "parts")),
    "duckdb": (("location", "relation"), ("read_only", "key", "parts")),
    "postgres": (("connection_profile", "relation"), ("key", "parts")),
    "pyarrow": (("handle",), ()),
}
_COMMON = ("type", "grain", "schema", "schema_ref", "description", "status", "replaced_by")
_SECRET = re.compile(r"password|passwd|secret|token|api_?key|access_key|credential(?!_profile)|connection_string|dsn")
_NUMERIC, _ORDERED = ("integer", "decimal", "float", "double"), ("integer", "decimal", "float", "double", "string", "boolean", "timestamp", "date")


class UniqueKeys(yaml.SafeLoader):
    """Safe YAML that rejects keys given twice."""


def _mapping(loader: UniqueKeys, node: yaml.MappingNode) -> dict:
    out: dict = {}
    for k, v in node.value:
        key = loader.construct_object(k)
        if key in out:
            raise CatalogError([Issue("catalog", "catalog.invalid", "a key is given twice")])
        out[key] = loader.construct_object(v, deep=True)
    return out


UniqueKeys.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def load(path: str | Path) -> SemanticLayer:
    path = Path(path)
    return build(yaml.load(path.read_text(), UniqueKeys), path.parent)


def loads(text: str, base: str | Path = ".") -> SemanticLayer:
    return build(yaml.load(text, UniqueKeys), Path(base))


class _Builder:
    def __init__(self, raw: Mapping, base: Path):
        self.raw, self.base, self.issues = raw, base, []
        self.made: dict[str, dict[str, Any]] = {plural: {} for plural in KINDS.values()}

    def issue(self, path: str, message: str, code: str = "catalog.invalid") -> None:
        self.issues.append(Issue(path, code, message))

    def entries(self, plural: str):
        block = self.raw.get(plural) or {}
        if not isinstance(block, Mapping):
            self.issue(plural, "must be a mapping")
            return
        for name, body in block.items():
            path = f"{plural}.{name}" if isinstance(name, str) and IDENTIFIER.fullmatch(name) else plural
            if path == plural:
                self.issue(path, "a name is lower-case letters, digits and underscores")
            elif not isinstance(body, Mapping):
                self.issue(path, "must be a mapping")
            elif (status := body.get("status", "active")) not in ("active", "deprecated"):
                self.issue(path, "status is active or deprecated")
            elif body.get("replaced_by") is not None and status != "deprecated":
                self.issue(path, "only a deprecated object is replaced")
            else:
                yield path, name, body, {"name": name, "description": str(body.get("description") or ""), "status": status, "replaced_by": body.get("replaced_by")}

    def needs(self, path: str, body: Mapping, *keys: str) -> bool:
        missing = [k for k in keys if body.get(k) is None]
        for k in missing:
            self.issue(path, f"{k} is required")
        return not missing

    def sources(self) -> None:
        for path, name, body, common in self.entries("data_sources"):
            kind = body.get("type")
            if kind not in CONNECTORS:
                self.issue(path, "unknown connector type")
                continue
            required, optional = CONNECTORS[kind]
            for k in body:
                if k not in (*required, *optional, *_COMMON):
                    self.issue(path, "a secret belongs in a runtime profile" if _SECRET.search(str(k)) else "unknown field")
            if not self.needs(path, body, *required, "grain"):
                continue
            location = str(body.get("location", ""))
            if re.match(r"[a-z][a-z0-9+.-]*://", location) and not location.startswith(("file://", "viewfs://", "hdfs://")) and "credential_profile" not in body:
                self.issue(path, "a remote location needs a credential_profile")
            if re.match(r"[a-z0-9+.-]+://[^/]*@", location):
                self.issue(path, "a location holds no user")
            if (body.get("schema") is None) == (body.get("schema_ref") is None):
                self.issue(path, "exactly one of schema and schema_ref is required")
                continue
            try:
                schema = S.declared(body["schema"] if body.get("schema") is not None else self.referred(str(body["schema_ref"])))
            except (S.SchemaError, OSError, KeyError, TypeError, yaml.YAMLError) as error:
                self.issue(f"{path}.schema", str(error) if isinstance(error, S.SchemaError) else "the schema can't be read")
                continue
            grain = body["grain"]
            if not isinstance(grain, list) or not grain or not all(isinstance(c, str) for c in grain):
                self.issue(f"{path}.grain", "is a non-empty list of columns")
                continue
            if len({*grain}) < len(grain):
                self.issue(f"{path}.grain", "a column is given twice", "catalog.grain.duplicate_column")
            for c in grain:
                if schema.get(c) is None:
                    self.issue(f"{path}.grain", f"unknown column {c}")
                elif schema.get(c).nullable:
                    self.issue(f"{path}.grain", f"column {c} may be null", "catalog.grain.nullable_column")
            self.made["data_sources"][name] = DataSource(kind=kind, options={k: body[k] for k in (*required, *optional) if k in body}, schema=schema, grain=tuple(grain), **common)

    def referred(self, ref: str) -> Any:
        target = (self.base / ref).resolve()
        if not target.is_relative_to(self.base.resolve()):
            raise S.SchemaError("schema_ref leaves the catalog's folder")
        return yaml.load(target.read_text(), UniqueKeys)

    def column(self, path: str, source: str, column: str) -> S.Field | None:
        found = self.made["data_sources"].get(source)
        if found is None:
            self.issue(path, f"unknown source {source}" if IDENTIFIER.fullmatch(str(source)) else "unknown source")
            return None
        if found.schema.get(column) is None:
            self.issue(path, f"source {source} has no such column")
        return found.schema.get(column)

    def typed(self, path: str, field: S.Field | None, data_type: str) -> None:
        if data_type not in S.DATA_TYPES:
            self.issue(path, "unknown data_type")
        elif field is not None and field.kind not in S.DATA_TYPES[data_type]:
            self.issue(path, f"data_type {data_type} doesn't fit the column's type")

    def tree(self, path: str, text: Any, metric: bool) -> dsl.Expr | None:
        try:
            tree = dsl.parse(text if isinstance(text, str) else "")
        except ExpressionError as error:
            self.issue(f"{path}.expression", str(error))
            return None
        for wrong in dsl.check(tree, metric):
            self.issue(f"{path}.expression", wrong)
        return tree

    def semantics(self) -> None:
        made = self.made
        for path, name, body, common in self.entries("dimensions"):
            if self.needs(path, body, "source", "column", "data_type"):
                self.typed(path, self.column(path, body["source"], body["column"]), body["data_type"])
                made["dimensions"][name] = Dimension(source=body["source"], column=body["column"], data_type=body["data_type"], **common)
        for path, name, body, common in self.entries("facts"):
            if self.needs(path, body, "source", "expression", "data_type") and (tree := self.tree(path, body["expression"], False)) is not None:
                refs = [r for r in dsl.references(tree) if len(r) == 2]
                fields = [self.column(path, *r) for r in refs]
                self.typed(path, fields[0] if len(refs) == 1 else None, body["data_type"])
                if body["source"] not in made["data_sources"]:
                    self.issue(path, "unknown source")
                made["facts"][name] = Fact(source=body["source"], data_type=body["data_type"], expression=tree, **common)
        for path, name, body, common in self.entries("measures"):
            if self.needs(path, body, "fact", "aggregation"):
                fact = made["facts"].get(body["fact"])
                if fact is None:
                    self.issue(path, "unknown fact")
                if body["aggregation"] not in AGGREGATIONS:
                    self.issue(path, "unknown aggregation")
                elif fact and fact.data_type not in {"sum": _NUMERIC, "avg": _NUMERIC, "min": _ORDERED, "max": _ORDERED}.get(body["aggregation"], (fact.data_type,)):
                    self.issue(path, f"{body['aggregation']} doesn't take {fact.data_type}", "catalog.measure.invalid_aggregation_type")
                made["measures"][name] = Measure(fact=body["fact"], aggregation=body["aggregation"], **common)
        for path, name, body, common in self.entries("metrics"):
            if self.needs(path, body, "expression", "measures") and (tree := self.tree(path, body["expression"], True)) is not None:
                used = [r[0] for r in dsl.references(tree) if len(r) == 1]
                for m in {*used, *body["measures"]} - made["measures"].keys():
                    self.issue(path, f"unknown measure {m}" if IDENTIFIER.fullmatch(str(m)) else "unknown measure")
                if {*used} != {*body["measures"]} or not used:
                    self.issue(path, "the declared measures are those that the expression names")
                made["metrics"][name] = Metric(expression=tree, measures=tuple(used), **common)
        for path, name, body, common in self.entries("relationships"):
            if self.needs(path, body, "source", "target", "type", "source_column", "target_column"):
                a, b = self.column(path, body["source"], body["source_column"]), self.column(path, body["target"], body["target_column"])
                if body["type"] not in CARDINALITIES:
                    self.issue(path, "unknown relationship type")
                elif a and b and _group(a) != _group(b):
                    self.issue(path, "the joined columns' types differ", "catalog.relationship.join_type_mismatch")
                made["relationships"][name] = Relationship(**{k: body[k] for k in ("source", "target", "type", "source_column", "target_column")}, **common)

    def reach(self) -> None:
        """Facts reach what they name without multiplying rows; a metric's measures share their source."""
        links = [r for r in self.made["relationships"].values() if r.type in CARDINALITIES]
        for name, fact in self.made["facts"].items():
            for source in sorted({r[0] for r in dsl.references(fact.expression)} - {fact.source}):
                if source in self.made["data_sources"] and fact.source in self.made["data_sources"] and safe_path(links, fact.source, source)[1] != 1:
                    self.issue(f"facts.{name}", f"no single row-preserving path to {source}")
        for name, metric in self.made["metrics"].items():
            facts = [self.made["facts"].get(self.made["measures"][m].fact) for m in metric.measures if m in self.made["measures"]]
            if len({f.source for f in facts if f}) > 1:
                self.issue(f"metrics.{name}", "the measures of a metric share one source")


def _group(field: S.Field) -> str:
    return "integer" if field.kind in S.INTEGERS else "number" if field.kind in S.FLOATS | {"decimal"} else str(field.type)


def build(raw: Any, base: Path = Path(".")) -> SemanticLayer:
    if not isinstance(raw, Mapping):
        raise CatalogError([Issue("catalog", "catalog.invalid", "must be a mapping")])
    builder = _Builder(raw, base)
    if type(raw.get("version")) is not int or raw["version"] != 1:
        builder.issue("version", "the version is 1", "catalog.version.unsupported")
    for key in raw:
        if key not in ("version", "name", "label", "description", *KINDS.values()):
            builder.issue("catalog", "unknown section")
    if not isinstance(raw.get("name"), str):
        builder.issue("name", "is required")
    builder.sources()
    builder.semantics()
    builder.reach()
    if builder.issues:
        raise CatalogError(builder.issues)
    return SemanticLayer(version=1, name=raw["name"], label=str(raw.get("label") or ""), description=str(raw.get("description") or ""), **builder.made)
