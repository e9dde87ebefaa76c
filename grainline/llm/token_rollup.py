"""Token counts as rollups that signed deltas maintain.

A batch of changes holds signed rows: +1 for a document that comes, -1 for one that goes, both for one that is revised
or counted anew by another tokenizer version. A commit adds the batch's sums by source, language and tokenizer version;
totals are the sums of all committed batches, so that no document is ever counted again. Each batch has an id and a
folder of its own, and its marker is written last: a batch that failed is written over, one that is committed is left.
A compacted rollup keeps the ids of the batches that it stands for, so they can't be committed to it again. A rollup has
one writer at a time: checking an id and adding its marker are two steps, which nothing locks.

``counted`` counts by tokenizer files; a version names a file. Null texts have no tokens; null sources and languages are groups; repeated rows count each; an empty batch commits
nothing but its id; groups without documents and tokens vanish; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainline.llm.common import chunks, text_buffer
from grainline.llm.packing import CHUNK, coder

KEYS = ("source", "lang", "tokenizer_version")
CHANGES = "source string, lang string, tokenizer_version string, docs long, tokens long"


def counted(docs: DataFrame, versions: dict[str, tuple[str, Column]], keep: tuple[str, ...] = ("doc_id", "source", "lang"), text_col: str = "text") -> DataFrame:
    """The columns of keep, and for each version (path of its file, which rows) the tokens of these rows, null elsewhere."""
    paths = {name: path for name, (path, _) in versions.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for k, path in enumerate(paths.values()):
                some = np.flatnonzero(batch.column(1 + k).to_numpy(zero_copy_only=False))
                tokens = np.zeros(batch.num_rows, np.int64)
                for i, j, data, offsets in chunks(*text_buffer(batch.column(0).take(pa.array(some))), limit=CHUNK):
                    tokens[some[i:j]] = np.diff(coder(path)(data, offsets)[1]) - 1
                none = np.ones(batch.num_rows, bool)
                none[some] = False
                counts.append(pa.array(tokens, mask=none))
            yield pa.RecordBatch.from_arrays([*batch.columns[1 + len(paths) :], *counts], names=[*keep, *paths])

    wanted = [F.coalesce(which, F.lit(False)).alias(f"grain_{k}") for k, (_, which) in enumerate(versions.values())]
    out = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(name, T.LongType()) for name in paths)])
    return docs.select(F.col(text_col).cast("string").alias("grain_text"), *wanted, *keep).mapInArrow(run, out)


def signed(counted: DataFrame, version: str, sign: int, tokens: str) -> DataFrame:
    """Changes of documents that come (sign 1) or go (-1) under a tokenizer version; tokens: the column of counts."""
    return counted.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("tokenizer_version"), F.lit(sign).cast("long").alias("docs"), (F.lit(sign) * F.col(tokens)).cast("long").alias("tokens"))


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def committed(self) -> DataFrame:
        return self._read("commits", "batch string")

    def commit(self, batch: str, changes: DataFrame, stands_for: DataFrame | None = None) -> bool:
        """Adds the sums of a batch of signed changes; False if the batch is committed already.

        stands_for: ids of other batches that are committed with it, by the same marker.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError("batch ids are letters, digits, dots, dashes and underscores")
        if not self.committed().where(F.col("batch") == batch).isEmpty():
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.where("docs <> 0 or tokens <> 0").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        marker = self.spark.createDataFrame([(batch,)], "batch string")
        marker = marker if stands_for is None else marker.union(stands_for.select("batch"))
        marker.distinct().coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) over the committed batches."""
        deltas = self._read("deltas", f"{CHANGES}, batch string").join(self.committed().distinct(), "batch")
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, batch: str) -> TokenRollup:
        """A new rollup at path-batch: totals so far as its one delta, under a new id, and the ids of all batches so far."""
        if not self.committed().where(F.col("batch") == batch).isEmpty():
            raise ValueError(f"{batch} is a committed batch")
        out = TokenRollup(self.spark, f"{self.path}-{batch}")
        out.commit(batch, self.totals().select(*KEYS, F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens")), self.committed())
        return out
