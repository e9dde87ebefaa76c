"""The engine: a layer, its sources, and queries as lazy DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from grainline.errors import QueryError, category
from grainline.model import SemanticLayer
from grainline.plans.lowering import lower
from grainline.plans.planner import Plan, Request, plan
from grainline.sources.readers import Profiles
from grainline.sources.registry import Registry
from grainline.streaming.scan import ScanSession


class SemanticEngine:
    """Metrics by dimensions with filters. Results are lazy; run() is eager and says only a category if it fails."""

    def __init__(self, layer: SemanticLayer, spark: SparkSession, profiles: Profiles | None = None):
        if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "+00:00"):
            raise ValueError("the session's time zone must be UTC: spark.sql.session.timeZone")
        self.layer, self.spark = layer, spark
        self.registry = Registry(spark, layer, profiles)

    def plan(self, metrics: Sequence[str], dimensions: Sequence[str] = (), filters: Mapping[str, Any] | None = None) -> Plan:
        return plan(self.layer, Request.of(metrics, dimensions, filters))

    def query(self, metrics: Sequence[str], dimensions: Sequence[str] = (), filters: Mapping[str, Any] | None = None) -> DataFrame:
        return lower(self.layer, self.plan(metrics, dimensions, filters), self.registry.read)

    def run(self, metrics: Sequence[str], dimensions: Sequence[str] = (), filters: Mapping[str, Any] | None = None):
        """The result as a pandas frame; a query's result has one row per group of dimensions."""
        try:
            return self.query(metrics, dimensions, filters).toPandas()
        except PySparkException as error:
            raise QueryError(uuid.uuid4().hex[:12], category(error)) from None

    def scan(self, source: str, columns: Sequence[str] | None = None, batch_size: int = 1024) -> ScanSession:
        return ScanSession(self.registry, source, columns, batch_size)
