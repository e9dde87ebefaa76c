import hashlib
import sqlite3
import subprocess
import sys
import threading
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from grainline.catalog import loads
from grainline.engine import SemanticEngine
from grainline.errors import SourceConnectionError, SourceDependencyError, SourceError, SourceProfileError, SourceSchemaError
from grainline.operators import profile
from grainline.sources import schema as S
from grainline.sources import readers
from grainline.sources.python_tables import DuckDBReader, condition
from grainline.sources.readers import Profiles, prepare

FIELDS = "[{name: id, type: int64, nullable: false}, {name: name, type: utf8}, {name: x, type: float64}]"
ROWS = [(1, "a", 0.5), (2, None, 1.5), (3, "c, d", None)]
SEMANTICS = "dimensions:\n  name: {source: t, column: name, data_type: string}\nfacts:\n  x: {source: t, data_type: double, expression: t.x}\nmeasures:\n  x: {fact: x, aggregation: sum}\nmetrics:\n  x: {expression: x, measures: [x]}\n"


def engine(spark, source: str, profiles=None, fields: str = FIELDS):
    layer = loads(f"version: 1\nname: x\ndata_sources:\n  t: {{{source}, grain: [id], schema: {{fields: {fields}}}}}\n{SEMANTICS}")
    return SemanticEngine(layer, spark, profiles)


def table() -> pa.Table:
    schema = pa.schema([pa.field("id", pa.int64(), False), pa.field("name", pa.utf8()), pa.field("x", pa.float64())])
    return pa.table([list(c) for c in zip(*ROWS)], schema=schema)


def check(made) -> None:
    got = {r["name"]: r["x"] for r in made.query(["x"], ["name"]).collect()}
    assert got == {"a": 0.5, None: 1.5, "c, d": None}


def test_parquet(spark, tmp_path):
    pq.write_table(table(), tmp_path / "t.parquet")
    made = engine(spark, f"type: parquet, location: '{tmp_path}/t.parquet'")
    check(made)
    assert made.registry.status("t").generation == 1
    assert made.registry.reload("t")[0].changed is False
    pq.write_table(table().slice(0, 1), tmp_path / "t.parquet")
    again = made.registry.reload()
    assert again[0].changed and again[0].generation == 3
    assert made.run(["x"])["x"][0] == 0.5


def test_drift_stops_the_engine_and_a_reload(spark, tmp_path):
    pq.write_table(table(), tmp_path / "t.parquet")
    with pytest.raises(SourceError) as error:
        engine(spark, f"type: parquet, location: '{tmp_path}/t.parquet'", fields=FIELDS.replace("utf8", "large_utf8"))
    assert error.value.code == "schema_mismatch"
    made = engine(spark, f"type: parquet, location: '{tmp_path}/t.parquet'")
    pq.write_table(table().drop_columns(["x"]), tmp_path / "t.parquet")
    with pytest.raises(SourceError) as error:
        made.registry.reload("t")
    assert error.value.code == "reload_failed"
    assert not made.registry.status("t").healthy and made.registry.status("t").generation == 1


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id;name;x\n1;a;0.5\n2;;1.5\n3;\"c, d\";\n")
    check(engine(spark, f"type: csv, location: '{tmp_path}/t.csv', delimiter: ';'"))
    with pytest.raises(SourceError):
        engine(spark, f"type: csv, location: '{tmp_path}/t.csv', delimiter: ','")


def test_csv_without_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,a,0.5\n2,,1.5\n3,\"c, d\",\n")
    check(engine(spark, f"type: csv, location: '{tmp_path}/t.csv', has_header: false"))


@pytest.mark.parametrize("make", [table, lambda: pa.RecordBatchReader.from_batches(table().schema, table().to_batches())])
def test_arrow_provider(spark, make):
    made = engine(spark, "type: pyarrow, handle: h", Profiles(arrow={"h": make}))
    check(made)
    check(made)
    with pytest.raises(SourceError) as error:
        engine(spark, "type: pyarrow, handle: none", Profiles())
    assert error.value.code == "missing_arrow_provider"


def test_tables_are_read_in_parts(spark, tmp_path):
    connection = sqlite3.connect(tmp_path / "t.db")
    connection.execute("create table t (id integer not null, name text, x real)")
    connection.executemany("insert into t values (?, ?, ?)", ROWS)
    connection.commit()
    connection.close()
    made = duckdb.connect(str(tmp_path / "t.duckdb"))
    made.execute("create table t (id bigint not null, name varchar, x double)")
    made.executemany("insert into t values (?, ?, ?)", ROWS)
    made.close()
    for kind, name in (("sqlite", "t.db"), ("duckdb", "t.duckdb")):
        source = f"type: {kind}, location: '{tmp_path}/{name}', relation: t"
        cut = engine(spark, f"{source}, key: id, parts: 3")
        check(cut)
        assert cut.query(["x"], ["name"]).count() == 3
        layer = loads(f"version: 1\nname: x\ndata_sources:\n  t: {{{source}, key: id, parts: 3, grain: [id], schema: {{fields: {FIELDS}}}}}\n{SEMANTICS}")
        assert prepare(spark, layer.data_sources["t"], Profiles()).read().rdd.getNumPartitions() == 3
        for wrong in ("key: id, parts: 0", "key: x, parts: 3", "parts: 3"):
            with pytest.raises(SourceError):
                engine(spark, f"{source}, {wrong}")


def test_python_sources_fetch_what_a_query_needs(spark, tmp_path):
    made = duckdb.connect(str(tmp_path / "t.duckdb"))
    made.execute("create table t (id bigint not null, name varchar, x double)")
    made.executemany("insert into t values (?, ?, ?)", [*ROWS, (4, "it's", 9.0)])
    made.close()
    here = engine(spark, f"type: duckdb, location: '{tmp_path}/t.duckdb', relation: t")
    plan = here.query(["x"], ["name"])._jdf.queryExecution().optimizedPlan().toString()
    assert "id" not in plan.split("RelationV2[")[1].split("]")[0]
    assert here.query(["x"], ["name"], {"name": "it's"}).collect()[0].asDict() == {"name": "it's", "x": 9.0}
    assert {r["name"] for r in here.query(["x"], ["name"], {"name": ["a", "c, d", None]}).collect()} == {"a", "c, d"}
    reader = DuckDBReader(T.StructType().add("x", "double"), {"relation": "main.t", "key": "id", "parts": "2"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    given = [EqualTo(("name",), "it's"), GreaterThan(("id",), 2), In(("id",), (1, 4)), IsNotNull(("name",)), GreaterThan(("x",), 1.0), EqualTo(("a", "b"), 1)]
    assert list(reader.pushFilters(given)) == given and condition(given[4]) is None and condition(given[5]) is None
    assert reader.statement(1) == """select "x" from "main"."t" where "name" = 'it''s' and "id" > 2 and "id" in (1, 4) and "name" is not null and coalesce("id", 0) % 2 in (1, -1)"""


def test_dataset_files_are_read_by_tasks(spark, tmp_path):
    for i in range(3):
        pq.write_table(table().slice(i, 1), tmp_path / f"{i}.parquet")
    made = engine(spark, "type: pyarrow, handle: h", Profiles(arrow={"h": lambda: ds.dataset(tmp_path, schema=table().schema)}))
    check(made)
    assert made.registry.read("t").rdd.getNumPartitions() == 3 and made.registry.read("t", ["x"]).columns == ["x"]
    assert "LocalTableScan" not in made.registry.read("t", ["x"])._jdf.queryExecution().optimizedPlan().toString().replace("LocalRelation", "") and made.registry.read("t").count() == 3


def test_digests_and_footers_are_the_same_by_tasks_and_by_the_driver(spark, tmp_path, monkeypatch):
    for i in range(3):
        pq.write_table(table().slice(i, 1), tmp_path / f"{i}.parquet")
    monkeypatch.setattr(readers, "RANGE_BYTES", 256)
    here = readers.digest(spark, str(tmp_path))
    monkeypatch.setattr(readers, "FEW", 0)
    assert readers.digest(spark, str(tmp_path)) == here
    check(engine(spark, f"type: parquet, location: '{tmp_path}'"))
    pq.write_table(table().drop_columns(["x"]), tmp_path / "2.parquet")
    assert readers.digest(spark, str(tmp_path)) != here
    with pytest.raises(SourceSchemaError):  # one file of three differs
        engine(spark, f"type: parquet, location: '{tmp_path}'")


def test_tasks_and_the_driver_digest_the_same_ranges_once(spark, tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / f"{i}").write_bytes(bytes(range(i, i + 100)) * 10)
    monkeypatch.setattr(readers, "RANGE_BYTES", 256)
    monkeypatch.setattr(readers, "FEW", 100)
    here = readers.digest(spark, str(tmp_path))
    monkeypatch.setattr(readers, "FEW", 0)
    assert readers.digest(spark, str(tmp_path)) == here
    log = tmp_path / "log"

    def noted(name: str, k: int) -> bytes:
        with open(name, "a") as f:
            f.write(f"{k}\n")
        return str(k).encode()

    assert readers.each(spark, [(str(log), k) for k in range(40, 0, -1)], noted) == [str(k).encode() for k in range(40, 0, -1)]
    assert sorted(map(int, log.read_text().split())) == list(range(1, 41))


def test_a_range_is_not_held_as_a_whole_nor_with_it_pandas(tmp_path):
    data, name = bytes(range(251)) * 64_000, str(tmp_path / "t")
    (tmp_path / "t").write_bytes(data)
    code = f"""import sys, tracemalloc
from grainline.sources.ranges import digest
print(*[m for m in ("pandas", "pyarrow", "duckdb") if m in sys.modules])
tracemalloc.start()
for start, length in ((0, 64 << 20), (1_000_003, 3_000_001), (0, 0), ({len(data)}, 5)):
    print(digest({name!r}, start, length).hex())
print(tracemalloc.get_traced_memory()[1])"""
    held, *digests, peak = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True).stdout.split("\n")[:-1]
    assert digests == [hashlib.sha256(part).hexdigest() for part in (data, data[1_000_003:4_000_004], b"", b"")]
    assert held == "" and int(peak) < 4 << 20


def test_digest_of_a_database_holds_its_journal(spark, tmp_path):
    (tmp_path / "t.db").write_bytes(b"x")
    before = readers.digest(spark, str(tmp_path / "t.db"), ("-wal",))
    (tmp_path / "t.db-wal").write_bytes(b"y")
    assert readers.digest(spark, str(tmp_path / "t.db"), ("-wal",)) != before == readers.digest(spark, str(tmp_path / "t.db"))


def test_profile_files(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("version: 1\nprofiles:\n  p:\n    password:\n      env: SECRET\n    ssl:\n      literal: true\n")
    made = Profiles.from_file(path, {"SECRET": "hidden"})
    assert dict(made.get("p", "t")) == {"password": "hidden", "ssl": "true"} and "hidden" not in repr(made)
    good = path.read_text()
    for old, new in (("version: 1", "version: 2"), ("version: 1", "version: true"), ("env: SECRET", "env: OTHER"), ("literal: true", "literal: 1"), ("env: SECRET", "text: hidden"), ("  p:", "  P-1:"), ("version: 1", "version: 1\nversion: 1"), ("    ssl:", "    password:")):
        path.write_text(good.replace(old, new))
        with pytest.raises(SourceProfileError) as error:
            Profiles.from_file(path, {"SECRET": "hidden"})
        assert "hidden" not in str(error.value) and str(tmp_path) not in str(error.value)
    with pytest.raises(SourceProfileError):
        Profiles.from_file(tmp_path / "none.yaml")


def test_errors_are_of_the_class_of_their_code():
    assert isinstance(SourceError("scan_failed", "t"), SourceConnectionError) and isinstance(SourceError("missing_delta_dependency", "t"), SourceDependencyError)
    assert SourceError("password=1", "t").code == "unknown" and "password" not in str(SourceError("password=1", "t"))


def test_sqlite(spark, tmp_path):
    connection = sqlite3.connect(tmp_path / "t.db")
    connection.execute("create table t (id integer not null, name text, x real)")
    connection.executemany("insert into t values (?, ?, ?)", ROWS)
    connection.commit()
    connection.close()
    check(engine(spark, f"type: sqlite, location: '{tmp_path}/t.db', relation: t"))


def test_duckdb_file_in_parts(spark, tmp_path):
    connection = duckdb.connect(str(tmp_path / "t.duckdb"))
    connection.execute("create table t (id bigint not null, name varchar, x double)")
    connection.executemany("insert into t values (?, ?, ?)", ROWS)
    connection.close()
    check(engine(spark, f"type: duckdb, location: '{tmp_path}/t.duckdb', relation: t"))
    parts = spark.read.format("grainline_duckdb").options(path=str(tmp_path / "t.duckdb"), relation="t", key="id", parts="2").load()
    assert sorted(r["id"] for r in parts.collect()) == [1, 2, 3] and parts.rdd.getNumPartitions() == 2


@pytest.mark.parametrize("source", ["type: postgres, connection_profile: p, relation: t", "type: delta, location: /nowhere/x", "type: iceberg, catalog_profile: c, namespace: n, table: t"])
def test_absent_readers_are_typed_errors(spark, source):
    with pytest.raises(SourceError) as error:
        engine(spark, source, Profiles(options={"p": {"url": "jdbc:postgresql://host/secret", "password": "hidden"}, "c": {}}))
    assert "secret" not in str(error.value) and "hidden" not in str(error.value)


def test_scan_session(spark, tmp_path):
    pq.write_table(table(), tmp_path / "t.parquet")
    made = engine(spark, f"type: parquet, location: '{tmp_path}/t.parquet'")
    with made.scan("t", ["id", "x"], batch_size=2) as session:
        batches = list(session.batches())
        assert [b.num_rows for b in batches] == [2, 1] and batches[0].schema.names == ["id", "x"]
        running = session.batches()
        next(running)
        pq.write_table(table().slice(0, 2), tmp_path / "t.parquet")
        with pytest.raises(SourceError):
            list(running)
    with pytest.raises(SourceError):
        made.scan("t", ["none"])


def test_batches_have_the_declared_types(spark, tmp_path):
    fields = "[{name: id, type: uint32, nullable: false}, {name: name, type: large_utf8}, {name: x, type: float64}, {name: at, type: {timestamp: {unit: ms}}}, {name: l, type: {list: {element: int64}}}]"
    schema = pa.schema([pa.field("id", pa.uint32(), False), ("name", pa.large_utf8()), ("x", pa.float64()), ("at", pa.timestamp("ms")), pa.field("l", pa.list_(pa.int64()))])
    rows = pa.table([[1, 2, 3], [None, None, "c"], [None, 0.5, None], [0, None, 5], [[1], None, []]], schema=schema)
    pq.write_table(rows, tmp_path / "t.parquet")
    made = engine(spark, f"type: parquet, location: '{tmp_path}/t.parquet', nullability: declared", fields=fields)
    with made.scan("t", batch_size=2) as session:
        found = list(session.batches())
        assert {b.schema for b in found} == {session.schema}  # a batch of nulls alone has the same types
        assert [f.type for f in session.schema][:4] == [f.type for f in schema][:4]
        assert [r for b in found for r in b.to_pylist()] == rows.to_pylist()


def test_a_cancelled_session_is_of_no_use_and_reloads_wait(spark, tmp_path):
    pq.write_table(table(), tmp_path / "t.parquet")
    made = engine(spark, f"type: parquet, location: '{tmp_path}/t.parquet'")
    session, done = made.scan("t", batch_size=1), threading.Event()
    running = session.batches()
    next(running)
    with pytest.raises(SourceError):
        next(session.batches())
    waiting = threading.Thread(target=lambda: (made.registry.reload("t"), done.set()))
    waiting.start()
    assert not done.wait(1)
    session.cancel()
    with pytest.raises(SourceError):
        next(running)
    assert done.wait(60)
    with pytest.raises(SourceError):
        next(session.batches())


def test_schema_compare_and_fingerprint():
    want = S.declared({"fields": [{"name": "a", "type": "int64", "nullable": False}, {"name": "b", "type": {"decimal": {"precision": 10, "scale": 2}}}]})
    assert S.compare(want, want) == []
    seen = S.from_arrow(pa.schema([pa.field("a", pa.int64()), pa.field("c", pa.decimal128(10, 2)), pa.field("d", pa.int8())]))
    assert [d.code for d in S.compare(want, seen)] == ["nullable_field", "field_name", "extra_observed_field"]
    swapped = S.TableSchema(want.fields[::-1])
    assert want.fingerprint() != swapped.fingerprint() and len(want.fingerprint()) == 64


@pytest.mark.parametrize("kind", ["int128", {"decimal": {"precision": 77, "scale": 0}}, {"time": {"unit": "us", "bit_width": 32}}, {"struct": {"fields": []}}, {"timestamp": {"unit": "h"}}, {"map": {"key": "utf8", "value": "utf8", "key_nullable": True}}])
def test_types_that_are_none(kind):
    with pytest.raises((S.SchemaError, KeyError)):
        S.checked_type(kind)


def test_classification():
    assert profile.classify("api_key", T.StringType()) == (("credential", "free_text"), True)
    assert profile.classify("customer_email", T.StringType())[0] == ("personal", "email", "free_text")
    assert profile.classify("amount", T.DoubleType()) == (("numeric",), False)
