"""From a declared source to a DataFrame, its observed schema and a snapshot token."""

from __future__ import annotations

import glob
import hashlib
import os
import pickle
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyarrow.dataset as ds
import yaml
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from grainline.catalog import UniqueKeys
from grainline.errors import CatalogError, SourceError
from grainline.model import DataSource
from grainline.sources import ranges
from grainline.sources import schema as S
from grainline.sources.python_tables import DuckDBTable, SQLiteTable, quoted_name

#: Local files are digested in ranges of so many bytes; more ranges or footers than FEW are read by a Spark job.
RANGE_BYTES, FEW = 64 << 20, 8
_ENTRY = re.compile(r"[a-z][a-z0-9_]*")
_VARIABLE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Profiles:
    """Runtime values by name: reader options of stores and databases, and factories of Arrow tables. Never printed."""

    options: Mapping[str, Mapping[str, str]] = field(default_factory=dict, repr=False)
    arrow: Mapping[str, Callable[[], Any]] = field(default_factory=dict, repr=False)

    @classmethod
    def from_environment(cls, wanted: Mapping[str, Mapping[str, str]]) -> Profiles:
        """wanted: profile -> option -> name of an environment variable."""
        return cls({p: {k: os.environ[v] for k, v in o.items() if v in os.environ} for p, o in wanted.items()})

    @classmethod
    def from_file(cls, path: str | Path, environ: Mapping[str, str] = os.environ) -> Profiles:
        """A YAML file, version 1: profiles -> name -> option -> either env, a variable's name, or literal, true or false.

        No error holds a value, the path, or a name that the file gives.
        """
        try:
            raw = yaml.load(Path(path).read_text("utf-8"), UniqueKeys)
        except (OSError, ValueError, yaml.YAMLError, CatalogError):
            raw = None
        if not isinstance(raw, Mapping) or set(raw) != {"version", "profiles"} or type(raw["version"]) is not int or raw["version"] != 1 or not isinstance(raw["profiles"], Mapping) or not raw["profiles"]:
            raise SourceError("missing_profile", "profiles") from None

        def value(entry: Any) -> str | None:
            if not isinstance(entry, Mapping) or len(entry) != 1:
                return None
            if type(entry.get("literal")) is bool:
                return str(entry["literal"]).lower()
            name = entry.get("env")
            return environ.get(name) if isinstance(name, str) and _VARIABLE.fullmatch(name) else None

        found: dict[str, dict[str, str]] = {}
        for name, options in raw["profiles"].items():
            whole = isinstance(name, str) and _ENTRY.fullmatch(name) and isinstance(options, Mapping) and options
            values = {k: value(v) for k, v in options.items()} if whole else {}
            if not whole or any(v is None or not isinstance(k, str) for k, v in values.items()):
                raise SourceError("missing_profile", "profiles")
            found[name] = values
        return cls(found)

    def get(self, name: str, source: str) -> Mapping[str, str]:
        if name not in self.options:
            raise SourceError("missing_profile", source)
        return self.options[name]


@dataclass(frozen=True)
class Prepared:
    """A source that is ready: how to read it, what was seen, and a token of its content (None: it may change any time).

    rows(columns) reads these columns, or all for None; readers in Python fetch no others, Catalyst prunes the rest.
    """

    rows: Callable[[list[str] | None], DataFrame] = field(repr=False)
    observed: S.TableSchema
    snapshot: str | None

    def read(self, columns: Sequence[str] | None = None) -> DataFrame:
        return self.rows(list(columns) if columns else None)


def _files(location: str) -> list[str] | None:
    """Local files of a path, folder or pattern; None for other stores."""
    path = location.removeprefix("file://")
    if "://" in path:
        return None
    if os.path.isdir(path):
        return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.startswith((".", "_")))
    return sorted(glob.glob(path)) if glob.has_magic(path) else [path]


def each(spark: SparkSession, items: Sequence[tuple], work: Callable[..., bytes]) -> list[bytes]:
    """work on every item, in order: a few on the driver, more by tasks. Results are digests or schemas, a few bytes each.

    Python workers hold what work's module imports, and no Arrow or pandas beside it: the items go out as an Arrow table,
    which the JVM reads, to a plain function. The order is made here; a sort by Spark does all work twice, once for its sample.
    """
    if len(items) <= FEW:
        return [work(*item) for item in items]
    names = [f"c{k}" for k in range(len(items[0]))]
    rows = spark.createDataFrame(pa.table([range(len(items)), *zip(*items, strict=True)], ["i", *names]))
    dealt = rows.repartition(min(len(items), 4 * spark.sparkContext.defaultParallelism), "i")
    found = dealt.select("i", F.udf(work, "binary", useArrow=False)(*names).alias("result")).collect()
    return [r["result"] for r in sorted(found, key=lambda r: r["i"])]


def digest(spark: SparkSession, location: str, beside: Iterable[str] = ()) -> str | None:
    """SHA-256 over the sorted relative paths and contents of local files, the same however it is computed.

    beside: endings of files next to a database that belong to its content, such as journals, where these are there.
    """
    files = _files(location)
    if files is None:
        return None
    files = files + [n + end for n in files for end in beside if os.path.exists(n + end)]
    root = os.path.commonpath(files) if len(files) > 1 else os.path.dirname(files[0])
    parts = [(n, start, RANGE_BYTES) for n in files for start in range(0, max(os.path.getsize(n), 1), RANGE_BYTES)]
    out = hashlib.sha256()
    for (name, start, _), found in zip(parts, each(spark, parts, ranges.digest), strict=True):
        out.update(f"{os.path.relpath(name, root)}\0{start}\0".encode() + found)
    return out.hexdigest()


def _nanos(df: DataFrame, schema: S.TableSchema) -> DataFrame:
    """Nanosecond timestamps, read as whole numbers, become naive timestamps of microseconds."""
    for f in schema.fields:
        if f.kind == "timestamp" and f.type["timestamp"]["unit"] == "ns" and f.name in df.columns and df.schema[f.name].dataType.simpleString() == "bigint":
            df = df.withColumn(f.name, F.timestamp_micros(F.floor(F.col(f.name) / 1000).cast("long")).cast("timestamp_ntz"))
    return df


def _adopted(observed: S.TableSchema, declared: S.TableSchema) -> S.TableSchema:
    """Observed names and types with the declared nullability, for stores that don't keep it."""
    return S.TableSchema(tuple(replace(o, nullable=d.nullable) if (d := declared.get(o.name)) else o for o in observed.fields))


def _widened(observed: S.TableSchema, declared: S.TableSchema) -> S.TableSchema:
    """The declared type wherever Spark reads it as what was seen: Spark keeps fewer types apart than Arrow."""

    def same(o: S.Field, d: S.Field | None) -> bool:
        try:
            return d is not None and S.spark_type(o.type) == S.spark_type(d.type)
        except S.SchemaError:
            return False

    return S.TableSchema(tuple(replace(o, type=declared.get(o.name).type) if same(o, declared.get(o.name)) else o for o in observed.fields))


def prepare(spark: SparkSession, source: DataSource, profiles: Profiles) -> Prepared:
    """Opens a source without a job over its rows; SourceError if that fails."""
    try:
        return _READERS[source.kind](spark, source, profiles)
    except SourceError:
        raise
    except KeyError:
        raise SourceError("unsupported_connector", source.name) from None
    except (PySparkException, OSError, ValueError) as error:
        condition = getattr(error, "getCondition", lambda: None)() or ""
        absent = "DATA_SOURCE_NOT_FOUND" in condition or "CATALOG" in condition
        raise SourceError(_ABSENT.get(source.kind, "extension_unavailable") if absent else "connect_failed", source.name) from None
    except Exception:  # a driver's own error type; its text may hold secrets
        raise SourceError("connect_failed", source.name) from None


def _stored_options(source: DataSource, profiles: Profiles) -> dict[str, str]:
    name = source.options.get("credential_profile")
    return dict(profiles.get(name, source.name)) if name else {}


def _parquet(spark: SparkSession, source: DataSource, profiles: Profiles) -> Prepared:
    location, options = str(source.options["location"]), _stored_options(source, profiles)
    if any(f.kind == "timestamp" and f.type["timestamp"]["unit"] == "ns" for f in source.schema.fields) and spark.conf.get("spark.sql.legacy.parquet.nanosAsLong") != "true":
        raise SourceError("bind_failed", source.name)

    def read(columns: list[str] | None = None) -> DataFrame:
        return _nanos(spark.read.options(**options).parquet(location), source.schema)

    files = _files(location)
    if files:  # footers keep nullability, Spark's schema doesn't; of files that differ, one that isn't as declared speaks
        footers = dict.fromkeys(each(spark, [(n,) for n in files], ranges.footer))
        seen = [S.from_arrow(pa.ipc.read_schema(pa.py_buffer(f))) for f in footers]
        observed = next((o for o in seen if S.compare(source.schema, o)), seen[0])
    else:
        observed = _adopted(_widened(S.from_spark(read().schema), source.schema), source.schema)
    if source.options.get("nullability") == "declared":
        observed = _adopted(observed, source.schema)
    return Prepared(read, observed, digest(spark, location))


def _csv(spark: SparkSession, source: DataSource, profiles: Profiles) -> Prepared:
    o, location = source.options, str(source.options["location"])
    header = bool(o.get("has_header", True))
    options = {"sep": o.get("delimiter", ","), "quote": o.get("quote_char") or "", "escape": o.get("escape_char") or "\\", "header": str(header).lower(), "mode": "FAILFAST"} | _stored_options(source, profiles)
    if "quote_char" not in o:
        options["quote"] = '"'
    kind = S.spark_schema(source.schema)

    def read(columns: list[str] | None = None) -> DataFrame:
        return spark.read.schema(kind).options(**options).csv(location)

    names = source.schema.fields
    if header:
        seen = spark.read.options(**{**options, "mode": "PERMISSIVE"}).csv(location).columns  # names only; values are checked as they are read
        observed = S.TableSchema(tuple(source.schema.get(c) or S.Field(c, "utf8") for c in seen))
    else:
        observed = S.TableSchema(names)
    return Prepared(read, observed, digest(spark, location))


def _arrow(spark: SparkSession, source: DataSource, profiles: Profiles) -> Prepared:
    make = profiles.arrow.get(str(source.options["handle"]))
    if make is None:
        raise SourceError("missing_arrow_provider", source.name)

    found = make()
    schema = found.projected_schema if isinstance(found, ds.Scanner) else found.schema

    def rows(columns: list[str] | None) -> DataFrame:
        made = make()
        if isinstance(made, ds.FileSystemDataset):
            return _nanos(_fragments(spark, made, columns or made.schema.names), source.schema)
        if isinstance(made, ds.Dataset):
            table = made.to_table(columns=columns)
        else:
            table = made.to_table() if isinstance(made, ds.Scanner) else made.read_all() if hasattr(made, "read_all") else made
        return _nanos(spark.createDataFrame(table.select(columns) if columns else table), source.schema)

    return Prepared(rows, S.from_arrow(schema), None)


def _fragments(spark: SparkSession, dataset: ds.FileSystemDataset, columns: list[str]) -> DataFrame:
    """The files of an Arrow dataset, read by tasks, one file at a time in batches; only names of files pass the driver."""
    schema = dataset.schema
    kind = T.StructType([T.StructField(c, S.spark_type(S.arrow_type(schema.field(c).type))) for c in columns])
    arrow = to_arrow_schema(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fragment in map(pickle.loads, batch.column("fragment").to_pylist()):
                for part in fragment.to_batches(schema=schema, columns=columns, batch_size=8_192):
                    yield from pa.Table.from_batches([part]).cast(arrow, safe=False).to_batches()

    names = spark.createDataFrame([(i, bytearray(pickle.dumps(f))) for i, f in enumerate(dataset.get_fragments())], "i long, fragment binary")
    return names.repartitionByRange(max(len(dataset.files), 1), "i").mapInArrow(read, kind)


def _parted(source: DataSource) -> tuple[str, int]:
    """Key and parts of a source; SourceError where parts would miss rows."""
    wanted, key, parts = S.spark_schema(source.schema), str(source.options.get("key", "")), int(source.options.get("parts", 1))
    if parts < 1 or key not in wanted.names or wanted[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise SourceError("bind_failed", source.name)
    return key, parts


def _table(kind: type) -> Callable:
    def opened(spark: SparkSession, source: DataSource, profiles: Profiles) -> Prepared:
        if source.options.get("read_only", True) is not True:
            raise SourceError("connect_failed", source.name)
        spark.dataSource.register(kind)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        options = {"path": str(source.options["location"]), "relation": str(source.options["relation"])}
        wanted = S.spark_schema(source.schema)
        if "key" in source.options or "parts" in source.options:
            key, parts = _parted(source)
            options |= {"key": key, "parts": str(parts)}
        seen = spark.read.format(kind.name()).options(**options).load().schema

        def rows(columns: list[str] | None) -> DataFrame:
            """SQLite has five storage classes; where Spark can cast, the declared type is what is read."""
            fetched = T.StructType([f for f in seen if columns is None or f.name in columns])
            casts = [F.col(f"`{f.name}`").cast(wanted[f.name].dataType).alias(f.name) if f.name in wanted.names else F.col(f"`{f.name}`") for f in fetched]
            return spark.read.format(kind.name()).options(**options).schema(fetched).load().select(*casts)

        observed = S.TableSchema(tuple(source.schema.get(f.name) or S.Field(f.name, "utf8") for f in seen)) if kind is SQLiteTable else _adopted(_widened(S.from_spark(seen), source.schema), source.schema)
        return Prepared(rows, observed, digest(spark, options["path"], ("-wal", "-journal") if kind is SQLiteTable else (".wal",)))

    return opened


def _postgres(spark: SparkSession, source: DataSource, profiles: Profiles) -> Prepared:
    """One task reads the table, or parts tasks with key, a whole-number column: key modulo parts."""
    options, relation = dict(profiles.get(str(source.options["connection_profile"]), source.name)), str(source.options["relation"])
    cuts = None
    if "key" in source.options or "parts" in source.options:
        key, parts = _parted(source)
        cuts = [f"coalesce({quoted_name(key)}, 0) % {parts} in ({i}, {i - parts if i else 0})" for i in range(parts)]

    def read(columns: list[str] | None = None) -> DataFrame:
        if cuts is None:
            return spark.read.format("jdbc").options(**options | {"dbtable": relation}).load()
        return spark.read.jdbc(options["url"], relation, predicates=cuts, properties={k: v for k, v in options.items() if k != "url"})

    return Prepared(read, _adopted(_widened(S.from_spark(read().schema), source.schema), source.schema), None)


def _delta(spark: SparkSession, source: DataSource, profiles: Profiles) -> Prepared:
    location, options = str(source.options["location"]), _stored_options(source, profiles)
    version = spark.sql(f"describe history delta.`{location}` limit 1").first()["version"]

    def read(columns: list[str] | None = None) -> DataFrame:
        return spark.read.format("delta").options(**options).option("versionAsOf", version).load(location)

    return Prepared(read, _adopted(_widened(S.from_spark(read().schema), source.schema), source.schema), str(version))


def _iceberg(spark: SparkSession, source: DataSource, profiles: Profiles) -> Prepared:
    catalog = profiles.get(str(source.options["catalog_profile"]), source.name).get("catalog", "")
    name = f"{catalog}.{source.options['namespace']}.{source.options['table']}".lstrip(".")
    latest = spark.table(f"{name}.snapshots").orderBy(F.desc("committed_at")).first()

    def read(columns: list[str] | None = None) -> DataFrame:
        return spark.read.option("snapshot-id", latest["snapshot_id"]).table(name) if latest else spark.table(name)

    return Prepared(read, _adopted(_widened(S.from_spark(read().schema), source.schema), source.schema), str(latest["snapshot_id"]) if latest else None)


_ABSENT = {"delta": "missing_delta_dependency", "iceberg": "missing_iceberg_dependency"}
_READERS = {"parquet": _parquet, "csv": _csv, "pyarrow": _arrow, "sqlite": _table(SQLiteTable), "duckdb": _table(DuckDBTable), "postgres": _postgres, "delta": _delta, "iceberg": _iceberg}
