"""Logical table schemas: declared in catalogs, observed from Arrow or Spark, compared in order, fingerprinted."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Scalar names and their Arrow types, where there is one.
SCALARS = {
    "null": pa.null(), "boolean": pa.bool_(), "int8": pa.int8(), "int16": pa.int16(), "int32": pa.int32(), "int64": pa.int64(), "uint8": pa.uint8(), "uint16": pa.uint16(),
    "uint32": pa.uint32(), "uint64": pa.uint64(), "float16": pa.float16(), "float32": pa.float32(), "float64": pa.float64(), "utf8": pa.utf8(), "large_utf8": pa.large_utf8(),
    "binary": pa.binary(), "large_binary": pa.large_binary(), "date32": pa.date32(), "date64": pa.date64(),
}
_NAMES = {str(v): k for k, v in SCALARS.items()}
#: Semantic types and the logical kinds that they accept.
INTEGERS = frozenset(f"{u}int{b}" for u in ("", "u") for b in (8, 16, 32, 64))
FLOATS = frozenset(("float16", "float32", "float64"))
DATA_TYPES = {
    "string": frozenset(("utf8", "large_utf8")), "integer": INTEGERS, "decimal": FLOATS | {"decimal"}, "float": FLOATS, "double": frozenset(("float64",)),
    "boolean": frozenset(("boolean",)), "timestamp": frozenset(("timestamp",)), "date": frozenset(("date32", "date64")),
}


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    """One column. type: a scalar's name, or a nested JSON value such as {"decimal": {"precision": 10, "scale": 2}}."""

    name: str
    type: Any
    nullable: bool = True
    field_id: int | None = None

    @property
    def kind(self) -> str:
        return self.type if isinstance(self.type, str) else next(iter(self.type))


@dataclass(frozen=True)
class TableSchema:
    fields: tuple[Field, ...]

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def fingerprint(self) -> str:
        """SHA-256 of canonical JSON; the order of fields counts."""
        body = [{"name": f.name, "type": f.type, "nullable": f.nullable, "field_id": f.field_id} for f in self.fields]
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


_PARTS: dict[str, dict[str, Any]] = {
    "decimal": {"precision": int, "scale": int}, "timestamp": {"unit": ("s", "ms", "us", "ns"), "timezone": str}, "time": {"unit": ("s", "ms", "us", "ns"), "bit_width": (32, 64)},
    "duration": {"unit": ("s", "ms", "us", "ns")}, "interval": {"unit": ("year_month", "day_time", "month_day_nano")}, "fixed_size_binary": {"byte_width": int},
}


def checked_type(value: Any) -> Any:
    """The normal form of a declared type; SchemaError if it isn't one."""
    if isinstance(value, str):
        if value not in SCALARS:
            raise SchemaError(f"unknown type {value}" if re.fullmatch(r"[a-z_0-9]+", value) else "unknown type")
        return value
    if not isinstance(value, Mapping) or len(value) != 1:
        raise SchemaError("a type is a name or one name with its parts")
    kind, parts = next(iter(value.items()))
    if kind in ("list", "large_list", "fixed_size_list"):
        out = {"element": checked_type(parts["element"]), "nullable": bool(parts.get("nullable", True))}
        return {kind: out | ({"size": int(parts["size"])} if kind == "fixed_size_list" else {})}
    if kind == "struct":
        fields = [{"name": f["name"], "type": checked_type(f["type"]), "nullable": bool(f.get("nullable", True))} for f in parts["fields"]]
        if not fields or len({f["name"] for f in fields}) < len(fields):
            raise SchemaError("a struct has fields with distinct names")
        return {kind: {"fields": fields}}
    if kind == "map":
        if parts.get("key_nullable"):
            raise SchemaError("a map's key is never null")
        return {kind: {"key": checked_type(parts["key"]), "value": checked_type(parts["value"]), "nullable": bool(parts.get("nullable", True))}}
    if kind == "dictionary":
        return {kind: {"index": checked_type(parts["index"]), "value": checked_type(parts["value"]), "ordered": bool(parts.get("ordered", False))}}
    if kind not in _PARTS or not isinstance(parts, Mapping) or set(parts) - set(_PARTS[kind]):
        raise SchemaError("unknown nested type or part")
    for part, allowed in _PARTS[kind].items():
        got = parts.get(part)
        if got is None and part == "timezone":
            continue
        if isinstance(allowed, tuple) and got not in allowed or isinstance(allowed, type) and type(got) is not allowed:
            raise SchemaError(f"{kind} needs {part}")
    if kind == "decimal" and not (1 <= parts["precision"] <= 76 and 0 <= parts["scale"] <= parts["precision"]):
        raise SchemaError("decimal precision is 1 to 76, scale 0 to precision")
    if kind == "time" and (parts["unit"] in ("s", "ms")) != (parts["bit_width"] == 32):
        raise SchemaError("time of s or ms has 32 bits, of us or ns 64")
    return {kind: {k: v for k, v in parts.items() if v is not None}}


def declared(raw: Any) -> TableSchema:
    """The schema of a declaration: a mapping with fields, each with name, type and optionally nullable, field_id."""
    if not isinstance(raw, Mapping) or not isinstance(raw.get("fields"), list) or not raw["fields"]:
        raise SchemaError("a schema has a non-empty list of fields")
    fields = []
    for f in raw["fields"]:
        if not isinstance(f, Mapping) or not isinstance(f.get("name"), str) or "type" not in f:
            raise SchemaError("a field has a name and a type")
        fields.append(Field(f["name"], checked_type(f["type"]), bool(f.get("nullable", True)) or f["type"] == "null", f.get("field_id")))
    if len({f.name for f in fields}) < len(fields):
        raise SchemaError("field names are distinct")
    return TableSchema(tuple(fields))


def arrow_type(t: pa.DataType) -> Any:
    """The logical type of an Arrow type."""
    if str(t) in _NAMES:
        return _NAMES[str(t)]
    if pa.types.is_decimal(t):
        return {"decimal": {"precision": t.precision, "scale": t.scale}}
    if pa.types.is_timestamp(t):
        return {"timestamp": {"unit": t.unit} | ({"timezone": t.tz} if t.tz else {})}
    if pa.types.is_time(t):
        return {"time": {"unit": t.unit, "bit_width": t.bit_width}}
    if pa.types.is_duration(t):
        return {"duration": {"unit": t.unit}}
    if pa.types.is_fixed_size_binary(t):
        return {"fixed_size_binary": {"byte_width": t.byte_width}}
    if pa.types.is_fixed_size_list(t):
        return {"fixed_size_list": {"element": arrow_type(t.value_type), "nullable": t.value_field.nullable, "size": t.list_size}}
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return {"large_list" if pa.types.is_large_list(t) else "list": {"element": arrow_type(t.value_type), "nullable": t.value_field.nullable}}
    if pa.types.is_struct(t):
        return {"struct": {"fields": [{"name": f.name, "type": arrow_type(f.type), "nullable": f.nullable} for f in t]}}
    if pa.types.is_map(t):
        return {"map": {"key": arrow_type(t.key_type), "value": arrow_type(t.item_type), "nullable": t.item_field.nullable}}
    if pa.types.is_dictionary(t):
        return {"dictionary": {"index": arrow_type(t.index_type), "value": arrow_type(t.value_type), "ordered": t.ordered}}
    if str(t) == "month_day_nano_interval":
        return {"interval": {"unit": "month_day_nano"}}
    raise SchemaError("a type without a logical form")


def from_arrow(schema: pa.Schema) -> TableSchema:
    ids = [(f.metadata or {}).get(b"PARQUET:field_id") for f in schema]
    return TableSchema(tuple(Field(f.name, arrow_type(f.type), f.nullable, int(i) if i is not None and int(i) >= 0 else None) for f, i in zip(schema, ids, strict=True)))


def spark_type(kind: Any) -> T.DataType:
    """The Spark type that a logical type is read as; SchemaError where Spark has none."""
    if isinstance(kind, str):
        simple = {
            "null": T.NullType(), "boolean": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(),
            "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "float32": T.FloatType(), "float64": T.DoubleType(), "utf8": T.StringType(),
            "large_utf8": T.StringType(), "binary": T.BinaryType(), "large_binary": T.BinaryType(), "date32": T.DateType(), "date64": T.DateType(), "float16": T.FloatType(),
        }
        return simple[kind]
    name, parts = next(iter(kind.items()))
    if name == "decimal" and parts["precision"] <= 38:
        return T.DecimalType(parts["precision"], parts["scale"])
    if name == "timestamp":
        return T.TimestampType() if parts.get("timezone") else T.TimestampNTZType()
    if name in ("duration", "time"):
        return T.LongType()
    if name == "fixed_size_binary":
        return T.BinaryType()
    if name in ("list", "large_list", "fixed_size_list"):
        return T.ArrayType(spark_type(parts["element"]), parts["nullable"])
    if name == "struct":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"]), f["nullable"]) for f in parts["fields"]])
    if name == "map":
        return T.MapType(spark_type(parts["key"]), spark_type(parts["value"]), parts["nullable"])
    if name == "dictionary":
        return spark_type(parts["value"])
    raise SchemaError(f"Spark has no type for {name}")


def to_arrow(field: Field) -> pa.Field:
    """A column of batches: the declared scalar, decimal or timestamp, and Spark's form of nested types."""
    parts = None if isinstance(field.type, str) else field.type[field.kind]
    if parts is None:
        kind = SCALARS[field.type]
    elif field.kind == "decimal":
        kind = pa.decimal128(parts["precision"], parts["scale"])
    elif field.kind == "timestamp":
        kind = pa.timestamp(parts["unit"], parts.get("timezone"))
    else:
        kind = to_arrow_type(spark_type(field.type))
    return pa.field(field.name, kind, field.nullable)


def spark_schema(schema: TableSchema) -> T.StructType:
    return T.StructType([T.StructField(f.name, spark_type(f.type), f.nullable) for f in schema.fields])


def from_spark(schema: T.StructType) -> TableSchema:
    """The logical schema that Spark's own types tell; widths and names that Spark doesn't keep are the usual ones."""
    return from_arrow(pa.schema([pa.field(f.name, to_arrow_type(f.dataType), f.nullable) for f in schema]))


@dataclass(frozen=True)
class Drift:
    code: str
    field: str


def compare(declared_: TableSchema, observed: TableSchema) -> list[Drift]:
    """What differs, by position; a column that is never null satisfies a nullable declaration."""
    out = []
    for want, got in zip(declared_.fields, observed.fields, strict=False):
        if want.name != got.name:
            out.append(Drift("field_name", want.name))
            continue
        if want.type != got.type:
            out.append(Drift("field_type", want.name))
        if got.nullable and not want.nullable:
            out.append(Drift("nullable_field", want.name))
        if want.field_id is not None and want.field_id != got.field_id:
            out.append(Drift("field_id", want.name))
    n = min(len(declared_.fields), len(observed.fields))
    out += [Drift("missing_observed_field", f.name) for f in declared_.fields[n:]]
    return out + [Drift("extra_observed_field", f.name) for f in observed.fields[n:]]
