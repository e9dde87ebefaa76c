"""Small awkward tables, and the words of texts."""

from __future__ import annotations

import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards boxed up jars of liquid oxen and quietly sang about the sea "
#: Names that the operators use inside, and values for them.
CLASHING = ("shard", "block", "n", "words", "rep", "cluster", "s", "target", "key", "range", "hist", "digest", "owner", "base", "size", "component", "id")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def awkward() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty and very long texts, ties, repeated rows, odd characters."""
    edited = PROSE.replace("seven", "eight")
    texts = [
        None, "", " \n\t", "word", "WORD", "Word ", PROSE, PROSE, PROSE.upper(), edited, edited + "x", PROSE * 30, (PROSE * 30)[:-4], "a" * 400, "é" * 120 + " ß İ ́ x", "\x00\x00 nul \x00" * 20,
        'api_key = "abcdef123456" and password:hunter2 token: short', "AKIA" + "A1" * 10 + " " + "0123456789abcdef" * 3, "12345 67890 !!", "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich", PROSE + PROSE + edited,
    ]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b", "b", "B"][i % 5]) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[1]]


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward table with clashing extra columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward(), "doc_id long, text string, lang string, source string").repartition(3)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def without_id(odd):
    from pyspark.sql import functions as F

    return odd.withColumn("doc_id", F.when(F.col("doc_id") != 9, F.col("doc_id")))
