import hashlib

import numpy as np
import pytest
from llm_helpers import rows_of

from grainline.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256((t or "").encode().lower()).hexdigest(), []).append(i)
    return sorted((i, max(g), len(g), i == max(g), k) for k, g in groups.items() for i in g)


def test_awkward_rows(odd, none, without_id):
    got = rows_of(exact_dedup.dedup(odd), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert exact_dedup.dedup(none).count() == 0
    unknown = [r for r in exact_dedup.dedup(without_id).collect() if r["doc_id"] is None]
    assert len(unknown) == 1 and unknown[0]["kept"]


def test_history_and_batch(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (4, "c"), (5, "c")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in exact_dedup.dedup(docs, history=F.col("doc_id") <= 3).collect()}
    assert [out[i]["keep_id"] for i in range(1, 6)] == [2, 2, 3, 5, 5]
    assert [out[i]["in_history"] for i in range(1, 6)] == [True, True, True, False, False]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash(n):
    draw = np.random.default_rng(n)
    keys = draw.integers(0, 2**63, (n, 4), dtype=np.uint64)
    made = exact_dedup.MinimalPerfectHash(keys)
    assert sorted(made.slots(keys)) == list(range(n))
    other = made.slots(draw.integers(0, 2**63, (500, 4), dtype=np.uint64))
    assert ((other >= -1) & (other < max(n, 1))).all()


@pytest.mark.parametrize("levels", [0, 2, 48])
def test_a_stored_hash_gives_the_same_slots(monkeypatch, levels):
    monkeypatch.setattr(exact_dedup, "LEVELS", levels)
    keys = np.random.default_rng(5).integers(0, 2**63, (3000, 4), dtype=np.uint64)
    made = exact_dedup.MinimalPerfectHash(keys)
    again = exact_dedup.MinimalPerfectHash.loaded(made.dumped())
    assert (again.slots(keys) == made.slots(keys)).all() and bool(again.rest) == (levels < 48)
    assert levels < 48 or len(made.dumped()) < 3000  # some bits a key, no digests
