import re
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from grainline.errors import ExportError
from grainline.operators import profile
from grainline.operators.profile import Caps, Policy
from test_sources import engine

FIELDS = "[{name: id, type: int64, nullable: false}, {name: name, type: utf8}, {name: x, type: float64}, {name: api_key, type: utf8}]"


@pytest.fixture
def made(spark, tmp_path):
    rows = pa.table([list(range(40)), [f"n{i % 3}" for i in range(40)], [float(i) for i in range(40)], ["k"] * 40], schema=pa.schema([pa.field("id", pa.int64(), False), ("name", pa.utf8()), ("x", pa.float64()), ("api_key", pa.utf8())]))
    pq.write_table(rows, tmp_path / "t.parquet")
    return engine(spark, f"type: parquet, location: '{tmp_path}/t.parquet'", fields=FIELDS)


def test_run(made):
    found = profile.run(made.registry, "t", ["name"])
    assert (found.mode, found.outcome, found.row_count, found.duplicate_rows) == ("reopenable", "completed", 40, 37)
    by = {c["column_name"]: c for c in found.columns}
    assert by["x"]["max_value"] == "39.0" and by["name"]["max_value"] is None and by["name"]["distinct_count"] == 3
    assert found.fingerprint() == profile.run(made.registry, "t", ["name"]).fingerprint()


def test_a_run_ends_at_its_deadline_or_when_cancelled(made, monkeypatch):
    slow, read = F.udf(lambda v: __import__("time").sleep(30) or v, "long"), made.registry.read
    monkeypatch.setattr(made.registry, "read", lambda name: read(name).withColumn("id", slow("id")))
    found = profile.run(made.registry, "t", deadline=1)
    assert (found.outcome, found.reason, found.row_count, found.columns) == ("unavailable", "timeout", None, ())
    event = threading.Event()
    event.set()
    assert profile.run(made.registry, "t", cancel=event).reason == "cancelled"


def test_unsupported_types_and_failures(made, monkeypatch):
    read = made.registry.read
    monkeypatch.setattr(made.registry, "read", lambda name: read(name).withColumn("l", F.array("id")))
    assert profile.run(made.registry, "t").reason == "unsupported_type"
    monkeypatch.setattr(made.registry, "read", lambda name: read(name).withColumn("id", F.raise_error(F.lit("no"))))
    assert profile.run(made.registry, "t").reason == "iterator_failure"


def test_export(made):
    df, found = made.registry.read("t"), profile.run(made.registry, "t", ["id"])
    first = profile.propose(found, ["id"])
    assert set(first.transforms.values()) == {"omit"}
    wanted = Policy("t", ("id",), {"name": "reveal", "x": "bucket", "id": "hash", "api_key": "hash"})
    policy = profile.activate(wanted, found, df.schema)
    got = profile.export(df, policy, found, "salt")
    assert len(got.rows) == 20 and set(got.rows[0]) == {"name", "x", "id"}  # a denied column is never shown
    ids = sorted(range(40), key=lambda i: profile.hashlib.sha256(f"salt\x1ft\x1f{i}".encode()).hexdigest())[:20]
    assert [r["x"] for r in got.rows] == [f"b{min(max(-(-i * 4 // 39) - 1, 0), 3)}" for i in ids]
    small = profile.activate(Policy("t", ("id",), wanted.transforms, Caps(bytes_per_source=500)), found, df.schema)
    cut = profile.export(df, small, found, "salt")
    assert cut.bytes <= 500 and cut.rows == got.rows[: len(cut.rows)] and 0 < len(cut.rows) < 20
    assert profile.export(df, policy, found, "salt", used=256 * 1024 - 500).rows == cut.rows
    for bad, code in ((lambda: profile.export(df, wanted, found, "salt"), "policy_stale"), (lambda: profile.export(df, policy, found, "salt", used=256 * 1024), "cap_exceeded"), (lambda: profile.export(df, policy, found, "salt", used=256 * 1024 - 20), "cap_exceeded"), (lambda: Caps(rows=21), "cap_exceeded"), (lambda: Caps(rows=0), "policy_invalid"), (lambda: profile.activate(Policy("t", ("id",), {"api_key": "reveal"}), found, df.schema), "policy_invalid"), (lambda: profile.activate(Policy("t", ("id",), {"name": "reveal"}, Caps(revealed_values=2)), found, df.schema), "cap_exceeded"), (lambda: profile.activate(Policy("t", (), {"name": "reveal"}), found, df.schema), "grain_required")):
        with pytest.raises(ExportError) as error:
            bad()
        assert error.value.code == code


def test_nothing_that_looks_like_a_credential_is_exported(made):
    found = profile.run(made.registry, "t", ["id"])
    policy = profile.activate(Policy("t", ("id",), {"name": "reveal"}), found, made.registry.read("t").schema)
    leaky = made.registry.read("t").withColumn("name", F.lit("see AKIA" + "ABCDEFGHIJKLMNOP"))
    with pytest.raises(ExportError) as error:
        profile.export(leaky, policy, found, "salt")
    assert error.value.code == "canary_leak" and not re.search("AKIA", str(error.value))
