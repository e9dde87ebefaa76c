"""Spark data sources over SQLite and DuckDB files, read only.

Options: path, relation, key (a whole-number column) and parts: with a key the table is read in parts, key modulo
parts. Only the columns of the schema that a read is given are fetched; filters that a file can take are sent to it, and
Spark applies all of them again, so that a file's own rules of comparison never decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from grainline.sources.schema import arrow_type, spark_type

BATCH = 8_192
_ORDERS = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def quoted(relation: str) -> str:
    return ".".join(map(quoted_name, relation.split(".")))


def literal(value: object) -> str:
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def condition(f: Filter) -> str | None:
    """SQL that is true wherever the filter is, or None: of whole numbers, of equal texts, and of what is not null."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    column = quoted_name(f.attribute[0])
    if isinstance(f, IsNotNull):
        return f"{column} is not null"
    whole, text = (lambda v: type(v) is int), (lambda v: type(v) is str and "\0" not in v)
    if isinstance(f, EqualTo) and (whole(f.value) or text(f.value)):
        return f"{column} = {literal(f.value)}"
    if type(f) in _ORDERS and whole(f.value):
        return f"{column} {_ORDERS[type(f)]} {f.value}"
    if isinstance(f, In) and f.value and (all(map(whole, f.value)) or all(map(text, f.value))):
        return f"{column} in ({', '.join(map(literal, f.value))})"
    return None


class FileTableReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options, self.conditions = schema.names, dict(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.conditions = [c for c in map(condition, filters) if c]
        return filters

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(int(self.options.get("parts", 1)) if "key" in self.options else 1)]

    def statement(self, part: int) -> str:
        columns, parts, wanted = ", ".join(map(quoted_name, self.names)), int(self.options.get("parts", 1)), list(self.conditions)
        if "key" in self.options:
            wanted.append(f"coalesce({quoted_name(self.options['key'])}, 0) % {parts} in ({part}, {part - parts if part else 0})")
        return f"select {columns} from {quoted(self.options['relation'])}" + (f" where {' and '.join(wanted)}" if wanted else "")


class SQLiteReader(FileTableReader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import sqlite3

        connection = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        try:
            yield from connection.execute(self.statement(partition.value))
        finally:
            connection.close()


class DuckDBReader(FileTableReader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import duckdb

        connection = duckdb.connect(self.options["path"], read_only=True)
        try:
            yield from connection.sql(self.statement(partition.value)).to_arrow_reader(BATCH)
        finally:
            connection.close()


class SQLiteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grainline_sqlite"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SQLiteReader(schema, self.options)

    def schema(self) -> str:
        """Declared types of the table's columns, as wide as SQLite keeps them."""
        import sqlite3

        connection = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        try:
            rows = list(connection.execute(f"pragma table_info({quoted(self.options['relation'])})"))
        finally:
            connection.close()
        kinds = (("INT", "long"), ("CHAR", "string"), ("TEXT", "string"), ("CLOB", "string"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BOOL", "boolean"), ("BLOB", "binary"))
        return ", ".join(f"`{name}` {next((t for k, t in kinds if k in (kind or '').upper()), 'string')}" for _, name, kind, *_ in rows)


class DuckDBTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grainline_duckdb"

    def reader(self, schema: StructType) -> DataSourceReader:
        return DuckDBReader(schema, self.options)

    def schema(self) -> StructType:
        import duckdb

        connection = duckdb.connect(self.options["path"], read_only=True)
        try:
            found = connection.sql(f"select * from {quoted(self.options['relation'])} limit 0").to_arrow_table().schema
        finally:
            connection.close()
        out = StructType()
        for f in found:
            out = out.add(f.name, spark_type(arrow_type(f.type)), True)
        return out
