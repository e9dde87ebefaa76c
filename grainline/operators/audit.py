"""Physical audits as DataFrames of one row: grain uniqueness and relationship cardinality, always exact.

Each side is folded to one row per key before anything is joined, so hot keys are summed on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grain(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """row_count, distinct_grain_count (null-safe), duplicate_row_count, null_grain_rows, duplicate_grain_groups."""
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)]
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    holes = F.lit(False)
    for i in range(len(columns)):
        holes = holes | F.col(f"k{i}").isNull()
    rows = F.coalesce(F.sum("n"), F.lit(0))
    return groups.agg(
        rows.alias("row_count"), F.count(F.lit(1)).alias("distinct_grain_count"), (rows - F.count(F.lit(1))).alias("duplicate_row_count"),
        F.coalesce(F.sum(F.when(holes, F.col("n"))), F.lit(0)).alias("null_grain_rows"), F.count_if(F.col("n") > 1).alias("duplicate_grain_groups"),
    )


def duplicate_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The keys that more than one row has, and how many; nulls are one key."""
    return df.groupBy(*[F.col(f"`{c}`").alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def _folded(df: DataFrame, column: str, n: str) -> DataFrame:
    return df.groupBy(F.col(f"`{column}`").alias(f"key_{n}")).agg(F.count(F.lit(1)).alias(n))


def _sides(a: DataFrame, a_column: str, b: DataFrame, b_column: str) -> DataFrame:
    """One row per key of either side with its rows a and b; null keys meet nothing."""
    return _folded(a, a_column, "a").join(_folded(b, b_column, "b"), F.col("key_a") == F.col("key_b"), "full")


def _total(value: Column, where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, value)), F.lit(0))


def directed(one: DataFrame, one_column: str, many: DataFrame, many_column: str) -> DataFrame:
    """Counts of a one-to-many relationship, its one side first."""
    a, b, ka, kb = F.col("a"), F.col("b"), F.col("key_a"), F.col("key_b")
    return _sides(one, one_column, many, many_column).agg(
        _total(a, ka.isNull() & a.isNotNull()).alias("one_side_null_rows"), F.count_if(a > 1).alias("one_side_duplicate_groups"), _total(b, kb.isNull() & b.isNotNull()).alias("many_side_null_rows"),
        _total(b, kb.isNotNull() & a.isNull()).alias("orphan_non_null_rows"), _total(a, b.isNull()).alias("zero_child_one_side_rows"),
        F.coalesce(F.max(F.when(a.isNotNull(), F.coalesce(b, F.lit(0)))), F.lit(0)).alias("maximum_child_multiplicity"),
    )


def one_to_one(source: DataFrame, source_column: str, target: DataFrame, target_column: str) -> DataFrame:
    a, b, ka, kb = F.col("a"), F.col("b"), F.col("key_a"), F.col("key_b")
    return _sides(source, source_column, target, target_column).agg(
        _total(a, ka.isNull() & a.isNotNull()).alias("source_null_rows"), F.count_if(a > 1).alias("source_duplicate_groups"),
        _total(b, kb.isNull() & b.isNotNull()).alias("target_null_rows"), F.count_if(b > 1).alias("target_duplicate_groups"),
        _total(a, ka.isNotNull() & b.isNull()).alias("source_unmatched_non_null_rows"), _total(b, kb.isNotNull() & a.isNull()).alias("target_unmatched_non_null_rows"),
    )


def many_to_many(source: DataFrame, source_column: str, target: DataFrame, target_column: str) -> DataFrame:
    return one_to_one(source, source_column, target, target_column).select("source_unmatched_non_null_rows", "target_unmatched_non_null_rows")


def orphans(many: DataFrame, many_column: str, one: DataFrame, one_column: str) -> DataFrame:
    """Rows of the many side whose key is not null and is in no row of the one side."""
    keys = one.select(F.col(f"`{one_column}`").alias("grain_key"))
    return many.where(F.col(f"`{many_column}`").isNotNull()).join(keys, F.col(f"`{many_column}`") == F.col("grain_key"), "left_anti")


def childless(one: DataFrame, one_column: str, many: DataFrame, many_column: str) -> DataFrame:
    """Rows of the one side without a row of the many side; a null key has none."""
    keys = many.select(F.col(f"`{many_column}`").alias("grain_key"))
    return one.join(keys, F.col(f"`{one_column}`") == F.col("grain_key"), "left_anti")
