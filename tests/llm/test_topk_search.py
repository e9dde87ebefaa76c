import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.llm import topk_search

NONE = 2**63 - 1


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (8, [1e30, 0.0]), (9, [-0.001, 0.0]), (1, [1.0, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit(1)).withColumn("score", F.lit("x"))
    got = [tuple(r) for r in topk_search.top_k(df, F.col("vec_id").isin(0, 7, 9), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8, 2**63 - 1), (0, 2, 1, 256 * 256 + 512 * 512), (0, 3, 1, 256 * 256 + 512 * 512), (7, 1, 0, 0), (7, 2, 1, 0), (7, 3, 1, 0), (9, 1, 7, 0), (9, 2, 0, -256), (9, 3, 1, -256)]
    assert topk_search.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk_search.top_k(df, F.col("vec_id") == 99).count() == 0


def brute(rows, asked, k):
    """Python integers all the way; (query, rank, id, score)."""
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for q in asked:
        own = next(v for i, v in whole if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v)), NONE if i is None else i) for i, v in whole if i != q)[:k]
        out += [(q, n + 1, None if i == NONE else i, max(-(2**63), min(NONE, -s))) for n, (s, i) in enumerate(scores)]
    return out


@pytest.mark.parametrize("scale", [1.0, 524_289.0, 3e6, 2.0**25])
def test_components_of_any_size(spark, scale):
    """Scores below 2**53, below 2**63 and beyond; ties, a row without an id, repeated rows."""
    draw = np.random.default_rng(int(scale))
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 4) * scale / 4]) for i in range(60)]
    rows += [(None, rows[3][1]), rows[7], rows[7], (60, [1e6, 0.0, 0.0, 0.0]), (61, [2e6, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == brute(rows, (0, 20, 40, 60), 5)


def test_many_blocks_equal_brute_force(spark, monkeypatch):
    for name, size in (("CANDIDATE_BYTES", 3_000), ("QUERY_BYTES", 400), ("SUPER_BYTES", 800), ("PIVOTS", 5)):
        monkeypatch.setattr(topk_search, name, size)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 8)) * 3
    values = centres[draw.choice(6, 700, p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1])] + 0.2 * draw.normal(size=(700, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == brute(rows, range(0, 700, 50), 5)


def test_text_in_the_order_of_numbers():
    numbers = [-(10**40), -100, -99, -10, -9, -1, 0, 1, 9, 10, 99, 100, 2**63, 10**40]
    assert sorted(numbers, key=topk_search.sortable) == numbers


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_search_equals_brute_force(dim):
    draw = np.random.default_rng(dim)
    centres = draw.normal(size=(20, dim))
    values = np.floor(256 * (centres[draw.integers(0, 20, 5000)] + 0.1 * draw.normal(size=(5000, dim))))
    queries_, ids = values[::100], draw.permutation(5000)
    a, b, s = topk_search.search(ids[::100], queries_, ids, values, 5)
    for q in range(len(queries_)):
        score = values @ queries_[q]
        order = [c for c in np.lexsort((ids, -score)) if ids[c] != ids[::100][q]][:5]
        assert b[a == q].tolist() == order and s[a == q].tolist() == score[order].astype(int).tolist()
