"""Exact column profiles, redacted samples and the final scan for credentials."""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainline.errors import ExportError, SourceError
from grainline.operators import audit
from grainline.sources.registry import Registry

#: What no export may hold, whatever its policy.
HARD_DENY = (
    r"-----BEGIN(?: |\r?\n)[A-Z0-9 ]*PRIVATE KEY-----",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
)
#: Parts of names that tell what a column holds.
NAME_PARTS = {
    "private_key": ("privatekey", "private_key", "privkey", "priv_key", "private", "sshkey"),
    "credential": ("password", "passwd", "pwd", "secret", "token", "credential", "apikey", "api_key", "accesskey", "access_key", "accesstoken", "access_token", "clientsecret", "client_secret"),
    "identifier": ("ssn", "social", "serial", "serialno", "serial_number", "vin", "iban"),
    "personal": ("firstname", "first_name", "lastname", "last_name", "fullname", "full_name", "username", "user", "customer", "person"),
    "email": ("email", "e-mail", "mail"),
}
#: The largest sample in rows and fields, in bytes of one source and of a session, and revealed values a column.
MAX_ROWS, MAX_FIELDS, MAX_SOURCE_BYTES, MAX_SESSION_BYTES, MAX_REVEALED = 20, 50, 64 * 1024, 256 * 1024, 100
#: Fixed value: seconds that a profile may take.
DEADLINE = 900.0
SEPARATOR = "\x1f"


def supported(kind: T.DataType) -> bool:
    return isinstance(kind, T.AtomicType | T.NullType)


def ranged(kind: T.DataType) -> bool:
    """Whether a profile tells the column's least and greatest value: never of text or truth values."""
    return isinstance(kind, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType)


def columns(df: DataFrame) -> DataFrame:
    """(column_name, row_count, null_count, distinct_count, min_value, max_value), one row per column.

    Counts and ranges are one aggregation without a shuffle of rows. Distinct values are counted by unpivoting to
    (column, value) and grouping twice, which sums on the map side and doesn't multiply rows by each distinct count.
    """
    names = [f.name for f in df.schema if supported(f.dataType)]
    kinds = {n: df.schema[n].dataType for n in names}
    at = {n: F.col(f"`{n}`") for n in names}

    def shown(value: Column, kind: T.DataType) -> Column:
        return F.when(F.isnan(value), None).otherwise(value.cast("string")) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else value.cast("string")

    def ends(n: str, f) -> Column:
        return shown(f(at[n]), kinds[n]) if ranged(kinds[n]) else F.lit(None).cast("string")

    figures = [F.struct(F.lit(n).alias("column_name"), F.count(F.lit(1)).alias("row_count"), (F.count(F.lit(1)) - F.count(at[n])).alias("null_count"), ends(n, F.min).alias("min_value"), ends(n, F.max).alias("max_value")) for n in names]
    totals = df.agg(F.array(*figures).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    as_text = {n: (at[n] + F.lit(0.0) if isinstance(kinds[n], T.DoubleType | T.FloatType) else at[n]).cast("string") for n in names}
    values = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("c"), as_text[n].alias("v")) for n in names])).alias("x")).select("x.*").where("v is not null")
    distinct = values.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("c").agg(F.count(F.lit(1)).alias("distinct_count"))
    return totals.join(distinct, F.col("column_name") == F.col("c"), "left").select("column_name", "row_count", "null_count", F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"), "min_value", "max_value")


def classify(name: str, kind: T.DataType) -> tuple[tuple[str, ...], bool]:
    """(labels, denied): by name and type only. Credentials and private keys are denied and can't be revealed."""
    low = name.lower()
    words = set(re.findall(r"[a-z0-9]+", low))
    labels = [label for label, parts in NAME_PARTS.items() if (words & set(parts)) or label != "identifier" and any(p in low for p in parts)]
    denied = bool({"private_key", "credential"} & set(labels))
    labels.append("numeric" if isinstance(kind, T.NumericType) else "temporal" if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else "free_text")
    return tuple(labels), denied


def row_key(source: str, grain: Sequence[str], salt: str) -> Column:
    """The salted SHA-256 of a row's source and grain."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in grain]
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(salt), F.lit(source), *parts), 256)


def sample(df: DataFrame, source: str, grain: Sequence[str], salt: str, rows: int = MAX_ROWS) -> DataFrame:
    """The rows with the smallest keys: a top-k, without a full sort."""
    return df.withColumn("row_key", row_key(source, grain, salt)).orderBy("row_key").limit(min(rows, MAX_ROWS))


def hashed(column: str, salt: str) -> Column:
    value = F.col(f"`{column}`")
    return F.when(value.isNotNull(), F.sha2(F.concat_ws(SEPARATOR, F.lit(salt), F.lit(column), value.cast("string")), 256))


def bucketed(column: str, kind: T.DataType, least: Column, greatest: Column) -> Column:
    """One of four equal ranges of a number; other values only say that they are there."""
    value = F.col(f"`{column}`")
    if not isinstance(kind, T.NumericType):
        return F.when(value.isNotNull(), F.lit("bucketed"))
    ratio = F.try_divide(value.cast("double") - least, greatest - least)
    label = F.when(greatest <= least, "b0").when(ratio <= 0.25, "b0").when(ratio <= 0.5, "b1").when(ratio <= 0.75, "b2").otherwise("b3")
    return F.when(value.isNotNull(), label)


def redacted(df: DataFrame, policy: Mapping[str, str], salt: str, whole: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """df by policy: omit (also what isn't named), redact, hash, bucket or reveal. Denied columns are always omitted, and so
    are fields beyond MAX_FIELDS. Buckets are ranges of whole, if df is a sample of it; keep: columns left as they are."""
    wanted = [f for f in df.schema if policy.get(f.name, "omit") != "omit" and not classify(f.name, f.dataType)[1]][:MAX_FIELDS]
    ranges = [f.name for f in wanted if policy[f.name] == "bucket" and isinstance(f.dataType, T.NumericType)]
    ends = (df if whole is None else whole).agg(F.lit(1).alias("one"), *[x for n in ranges for x in (F.min(f"`{n}`").cast("double").alias(f"least {n}"), F.max(f"`{n}`").cast("double").alias(f"greatest {n}"))])
    kinds = {
        "redact": lambda f: F.when(F.col(f"`{f.name}`").isNotNull(), F.lit("non_null")), "hash": lambda f: hashed(f.name, salt), "reveal": lambda f: F.col(f"`{f.name}`"),
        "bucket": lambda f: bucketed(f.name, f.dataType, F.col(f"`least {f.name}`") if f.name in ranges else F.lit(None), F.col(f"`greatest {f.name}`") if f.name in ranges else F.lit(None)),
    }
    with_ends = df.join(F.broadcast(ends), F.lit(True)) if ranges else df  # one row
    return with_ends.select(*keep, *[kinds[policy[f.name]](f).alias(f.name) for f in wanted])


def denied(text: Column) -> Column:
    """Whether a text holds what no export may hold."""
    found = F.lit(False)
    for pattern in HARD_DENY:
        found = found | text.rlike(pattern)
    return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class Profile:
    """What a profile run found; figures only of a completed run. No figure is a text of the source."""

    source: str
    mode: str  # reopenable: the content has a token; live: it may change any time
    outcome: str  # completed or unavailable
    reason: str | None  # timeout, cancelled, iterator_failure or unsupported_type
    schema_fingerprint: str
    snapshot: str | None
    row_count: int | None = None
    duplicate_rows: int | None = None
    columns: tuple[Mapping[str, Any], ...] = ()

    def fingerprint(self) -> str:
        return _fingerprint(asdict(self))


def _fingerprint(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def run(registry: Registry, source: str, grain: Sequence[str] = (), deadline: float = DEADLINE, cancel: threading.Event | None = None) -> Profile:
    """Profiles a source in jobs under one tag, which a watcher stops at the deadline or when cancel is set."""
    spark, status, df = registry.spark, registry.status(source), registry.read(source)
    mode = "live" if status.snapshot is None else "reopenable"

    def unavailable(reason: str) -> Profile:
        return Profile(source, mode, "unavailable", reason, status.schema_fingerprint, status.snapshot)

    if not all(supported(f.dataType) for f in df.schema):
        return unavailable("unsupported_type")
    tag, done, stopped, end = f"profile-{uuid.uuid4().hex}", threading.Event(), [], time.monotonic() + deadline

    def watch() -> None:
        while not done.wait(0.05):
            reason = "cancelled" if cancel is not None and cancel.is_set() else "timeout" if time.monotonic() >= end else None
            if reason:
                stopped.append(reason)
                spark.sparkContext.cancelJobsWithTag(tag)  # again until the run is over: a next job may have begun

    watcher = threading.Thread(target=watch, daemon=True)
    spark.sparkContext.addJobTag(tag)
    watcher.start()
    try:
        figures = tuple(r.asDict() for r in columns(df).orderBy("column_name").collect())
        counts = audit.grain(df, tuple(grain)).first() if grain and not stopped else None
        if not stopped:
            registry.check_snapshot(source, status.snapshot)
    except (PySparkException, Py4JError, SourceError):
        return unavailable(stopped[0] if stopped else "iterator_failure")
    finally:
        done.set()
        watcher.join()
        spark.sparkContext.removeJobTag(tag)
    if stopped:
        return unavailable(stopped[0])
    return Profile(source, mode, "completed", None, status.schema_fingerprint, status.snapshot, figures[0]["row_count"] if figures else 0, counts["duplicate_row_count"] if counts else None, figures)


@dataclass(frozen=True)
class Caps:
    """Limits of an export; they may be lower than the fixed ones, never higher."""

    rows: int = MAX_ROWS
    fields: int = MAX_FIELDS
    bytes_per_source: int = MAX_SOURCE_BYTES
    bytes_per_session: int = MAX_SESSION_BYTES
    revealed_values: int = MAX_REVEALED

    def __post_init__(self) -> None:
        most = (MAX_ROWS, MAX_FIELDS, MAX_SOURCE_BYTES, MAX_SESSION_BYTES, MAX_REVEALED)
        for (name, value), limit in zip(asdict(self).items(), most, strict=True):
            if type(value) is not int or value < 1:
                raise ExportError("policy_invalid", name)
            if value > limit:
                raise ExportError("cap_exceeded", name)


@dataclass(frozen=True)
class Policy:
    """What an export shows of each column; columns that aren't named are omitted. bound: what it was activated for."""

    source: str
    grain: tuple[str, ...]
    transforms: Mapping[str, str]
    caps: Caps = Caps()
    bound: str | None = None

    def binding(self, profile: Profile) -> str:
        return _fingerprint([self.source, self.grain, dict(self.transforms), asdict(self.caps), profile.fingerprint()])


def propose(profile: Profile, grain: Sequence[str]) -> Policy:
    """The policy to begin with: every column is omitted."""
    if profile.outcome != "completed":
        raise ExportError("not_available", profile.source)
    names = [c["column_name"] for c in profile.columns]
    return Policy(profile.source, tuple(c for c in grain if c in names), dict.fromkeys(names, "omit"))


def activate(policy: Policy, profile: Profile, schema: T.StructType) -> Policy:
    """The policy, bound to its profile; ExportError where it shows too much."""
    if profile.outcome != "completed" or profile.source != policy.source:
        raise ExportError("not_available", policy.source)
    if not policy.grain:
        raise ExportError("grain_required", policy.source)
    distinct = {c["column_name"]: c["distinct_count"] for c in profile.columns}
    shown = {n: t for n, t in policy.transforms.items() if t != "omit"}
    if not set(policy.transforms) <= set(distinct) or not set(shown.values()) <= {"redact", "hash", "bucket", "reveal"}:
        raise ExportError("policy_invalid", "transform")
    if len(shown) > policy.caps.fields:
        raise ExportError("cap_exceeded", "fields")
    for name, transform in shown.items():
        if classify(name, schema[name].dataType)[1] and transform == "reveal":
            raise ExportError("policy_invalid", "a denied field")
        if transform == "reveal" and distinct[name] > policy.caps.revealed_values:
            raise ExportError("cap_exceeded", "revealed_values")
    return Policy(policy.source, policy.grain, policy.transforms, policy.caps, policy.binding(profile))


@dataclass(frozen=True)
class Export:
    """Redacted rows of one source and what they are bound to."""

    source: str
    binding: str
    snapshot: str | None
    grain: tuple[str, ...]
    rows: tuple[Mapping[str, Any], ...]
    bytes: int

    def fingerprint(self) -> str:
        return hashlib.sha256(_payload(self.rows, self.grain)).hexdigest()


def _payload(rows: Sequence[Mapping[str, Any]], grain: Sequence[str]) -> bytes:
    return json.dumps({"rows": [dict(r) for r in rows], "grain": list(grain)}, sort_keys=True, ensure_ascii=False, default=str).encode()


def sampled(df: DataFrame, policy: Policy, salt: str) -> DataFrame:
    """(row_key, shown columns) of the sample's rows; buckets are ranges of the whole column."""
    return redacted(sample(df, policy.source, policy.grain, salt, policy.caps.rows), policy.transforms, salt, whole=df, keep=("row_key",))


def export(df: DataFrame, policy: Policy, profile: Profile, salt: str, used: int = 0) -> Export:
    """The sample by an activated policy; rows with the largest keys go until the bytes of the source and of what is left of
    the session hold them. ExportError if one row is too large, or if anything shown looks like a credential."""
    if policy.bound is None or policy.bound != policy.binding(profile):
        raise ExportError("policy_stale", policy.source)
    if used >= policy.caps.bytes_per_session:
        raise ExportError("cap_exceeded", "bytes_per_session")
    found = sorted((r.asDict() for r in sampled(df, policy, salt).collect()), key=lambda r: r["row_key"])  # at most MAX_ROWS
    rows = [{k: v for k, v in r.items() if k != "row_key"} for r in found]
    if any(re.search(p, str(v)) for r in rows for v in r.values() for p in HARD_DENY):
        raise ExportError("canary_leak", policy.source)
    for limit, name in ((policy.caps.bytes_per_source, "bytes_per_source"), (policy.caps.bytes_per_session - used, "bytes_per_session")):
        while len(rows) > 1 and len(_payload(rows, policy.grain)) > limit:
            rows.pop()
        if len(_payload(rows, policy.grain)) > limit:
            raise ExportError("cap_exceeded", name)
    payload = _payload(rows, policy.grain)
    if any(re.search(p, payload.decode()) for p in HARD_DENY):
        raise ExportError("canary_leak", policy.source)
    return Export(policy.source, policy.bound, profile.snapshot, policy.grain, tuple(rows), len(payload))
