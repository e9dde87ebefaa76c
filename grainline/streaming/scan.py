"""Bounded iteration over one source in Arrow batches, for callers that look at rows themselves."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from py4j.protocol import Py4JError

from grainline.errors import SourceError
from grainline.sources.registry import Registry
from grainline.sources.schema import to_arrow


class ScanSession:
    """Reads chosen columns in batches of at most batch_size rows and one schema, one partition in memory at a time.

    Tasks cut their rows into batches, so that the driver passes batches on and looks at no row. One iteration runs at
    once. While one runs, or within a with block, other threads' reloads wait. A cancelled or closed session stays so.
    """

    def __init__(self, registry: Registry, source: str, columns: Sequence[str] | None = None, batch_size: int = 1024):
        declared = registry.layer.data_sources[source].schema
        unknown = [c for c in columns or () if declared.get(c) is None]
        if unknown or batch_size < 1:
            raise SourceError("bind_failed", source)
        self.registry, self.source, self.batch_size = registry, source, batch_size
        self.columns = list(columns or [f.name for f in declared.fields])
        self.schema = pa.schema([to_arrow(declared.get(c)) for c in self.columns])
        self.snapshot = registry.status(source).snapshot
        self.tag, self.active, self.closed, self.within = f"scan-{uuid.uuid4().hex}", False, False, False

    def frame(self) -> DataFrame:
        return self.registry.read(self.source, self.columns).select(*[f"`{c}`" for c in self.columns])

    def batches(self) -> Iterator[pa.RecordBatch]:
        """All rows; SourceError at the end if the content changed meanwhile."""
        if self.active or self.closed:
            raise SourceError("scan_failed", self.source)
        self.active, spark, size = True, self.registry.spark, self.batch_size

        def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for start in range(0, part.num_rows, size):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as stream:
                        stream.write_batch(part.slice(start, size))
                    yield pa.record_batch({"batch": [sink.getvalue().to_pybytes()]}, schema=pa.schema([("batch", pa.binary())]))

        self.registry.pin(self.tag)
        spark.sparkContext.addJobTag(self.tag)
        try:
            for row in self.frame().mapInArrow(packed, "batch binary").toLocalIterator(prefetchPartitions=False):
                with pa.ipc.open_stream(pa.py_buffer(row["batch"])) as stream:
                    found = stream.read_all().cast(self.schema)
                if self.closed:
                    raise SourceError("scan_failed", self.source)
                yield from found.combine_chunks().to_batches()
            self.registry.check_snapshot(self.source, self.snapshot)
        except (PySparkException, Py4JError, pa.ArrowException, ValueError):
            raise SourceError("scan_failed", self.source) from None
        finally:
            spark.sparkContext.removeJobTag(self.tag)
            self.active = False
            if not self.within:
                self.registry.unpin(self.tag)

    def cancel(self) -> None:
        """Stops jobs that run; the session is of no use afterwards."""
        self.closed = True
        self.registry.spark.sparkContext.cancelJobsWithTag(self.tag)

    def close(self) -> None:
        self.cancel()
        self.within = False
        self.registry.unpin(self.tag)

    def __enter__(self) -> ScanSession:
        self.within = True
        self.registry.pin(self.tag)
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
