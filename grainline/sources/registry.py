"""The published sources: prepared together, checked against their declarations, reloaded as a whole."""

from __future__ import annotations

import threading
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from grainline.errors import SourceError
from grainline.model import SemanticLayer
from grainline.sources import schema as S
from grainline.sources.readers import Prepared, Profiles, prepare


@dataclass(frozen=True)
class Status:
    source: str
    connector: str
    generation: int
    snapshot: str | None
    schema_fingerprint: str
    healthy: bool = True


@dataclass(frozen=True)
class Reloaded:
    source: str
    generation: int
    changed: bool


class Registry:
    """Readers of all sources of a layer. The lock guards publication only; plans run without it.

    A reload waits until scans that other threads have open are closed.
    """

    def __init__(self, spark: SparkSession, layer: SemanticLayer, profiles: Profiles | None = None):
        self.spark, self.layer, self.profiles = spark, layer, profiles or Profiles()
        self._lock, self._scans, self._open = threading.RLock(), threading.Condition(), {}
        self._ready = {name: self._candidate(name) for name in sorted(layer.data_sources)}
        self._status = {name: self._state(name, p, 1) for name, p in self._ready.items()}

    def _candidate(self, name: str) -> Prepared:
        source = self.layer.data_sources[name]
        found = prepare(self.spark, source, self.profiles)
        if S.compare(source.schema, found.observed):
            raise SourceError("schema_mismatch", name)
        return found

    def _state(self, name: str, prepared: Prepared, generation: int) -> Status:
        return Status(name, self.layer.data_sources[name].kind, generation, prepared.snapshot, self.layer.data_sources[name].schema.fingerprint())

    def read(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The source's rows: all its columns, or those named."""
        with self._lock:
            reader = self._ready[name].read
        return reader(columns)

    def status(self, name: str) -> Status:
        with self._lock:
            return self._status[name]

    def pin(self, tag: str) -> None:
        """A scan of this thread is open."""
        with self._scans:
            self._open[tag] = threading.get_ident()

    def unpin(self, tag: str) -> None:
        with self._scans:
            self._open.pop(tag, None)
            self._scans.notify_all()

    def reload(self, *names: str) -> list[Reloaded]:
        """New readers of the named sources, or of all: published together, or not at all."""
        wanted = sorted(names or self.layer.data_sources)
        with self._scans:
            self._scans.wait_for(lambda: set(self._open.values()) <= {threading.get_ident()})
        with self._lock:
            try:
                fresh = {name: self._candidate(name) for name in wanted}
            except SourceError as error:
                for name in wanted:
                    if name == error.source:
                        self._status[name] = replace(self._status[name], healthy=False)
                raise SourceError("reload_failed" if len(wanted) == 1 else "reload_all_failed", error.source) from None
            out = []
            for name, prepared in fresh.items():
                location = self.layer.data_sources[name].options.get("location")
                if location:
                    self.spark.catalog.refreshByPath(str(location))
                before, generation = self._ready[name], self._status[name].generation + 1
                self._ready[name], self._status[name] = prepared, self._state(name, prepared, generation)
                out.append(Reloaded(name, generation, prepared.snapshot is None or prepared.snapshot != before.snapshot))
            return out

    def check_snapshot(self, name: str, snapshot: str | None) -> None:
        """SourceError if the content is no longer what the token stands for."""
        if snapshot is not None and self._candidate(name).snapshot != snapshot:
            raise SourceError("snapshot_mismatch", name)
