import numpy as np
import pytest
from helpers import SF
from llm_conftest import words
from llm_helpers import rows_of

from grainline.llm import near_dedup, queries

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def brute(rows, width=2, percent=80):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), least.get(root(k)), i is not None and i == least[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def without_none(rows):
    """kept says nothing of rows without an id where none of a component has one: one of them stays."""
    return sorted((r if r[2] is not None else (*r[:3], None) for r in map(tuple, rows)), key=str)


def test_query(spark, duck):
    assert rows_of(queries.op9_near_dedup(spark, SF), *COLUMNS) == sorted(brute(duck.sql("select doc_id, text from documents").fetchall()))


@pytest.mark.parametrize("width", [2, 5])
def test_awkward_rows(odd, none, without_id, width):
    assert rows_of(near_dedup.near_duplicates(odd, width), *COLUMNS) == sorted(brute([(r["doc_id"], r["text"]) for r in odd.collect()], width))
    assert near_dedup.near_duplicates(none, width).count() == 0
    got = near_dedup.near_duplicates(without_id, width).select(*COLUMNS).collect()
    assert without_none(got) == without_none(brute([(r["doc_id"], r["text"]) for r in without_id.collect()], width))


def test_rows_are_told_apart_by_more_than_their_ids(spark):
    """One id with different texts, rows without an id that link and bridge, repeated rows."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(20)) for x in "abcd")
    rows = [(5, a), (5, b), (3, b + " z"), (7, a + " z"), (None, c), (None, c + " z"), (None, c), (None, d), (9, d + " y"), (8, d + " x"), (5, a), (None, ""), (None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2)
    assert without_none(got.select(*COLUMNS).collect()) == without_none(brute(rows))
    none = [r for r in got.collect() if r["component_id"] is None and r["n_shingles"]]
    assert len(none) == 3 and sum(r["kept"] for r in none) == sum(r["stays"] for r in none) == 1
    assert sum(r["stays"] for r in got.collect()) == 6  # a, b, c, d and two empty texts


def test_sizes_cut_large_clusters(spark, monkeypatch):
    """Growing texts: each links to the next ones only, over many classes of sizes."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = [(i, " ".join(f"w{k}" for k in range(10 + 2 * i))) for i in range(40)] + [(100 + i, f"u{i} " + " ".join(f"w{k}" for k in range(10 + 9 * i))) for i in range(8)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert rows_of(got, *COLUMNS) == sorted(brute(rows))


def family(draw, n, length=60, edits=3):
    base = [f"w{x}" for x in draw.integers(0, 5000, length)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in draw.integers(0, length, edits):
            own[at] = f"w{draw.integers(0, 10**9)}"
        out.append(" ".join(own))
    return out


def test_large_clusters_are_compared_in_blocks(spark, monkeypatch):
    """Members near the threshold: whole components need links that do not go through one centre."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    draw = np.random.default_rng(8)
    texts = family(draw, 90) + [t for _ in range(15) for t in family(draw, int(draw.integers(1, 6)))] + family(draw, 40, edits=6)
    rows = [(int(i), t) for i, t in zip(draw.permutation(len(texts)), texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(near_dedup.near_duplicates(df, 2), *COLUMNS) == sorted(brute(rows))


def test_table_keys_agree_as_half_keys_do():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 2**63, (1, 2 * near_dedup.HALVES), dtype=np.uint64)
    b = a.copy()
    b[0, :10] += np.uint64(1)  # 4 of the first collection agree, and 12 of the second
    b[0, -2:] += np.uint64(1)
    assert (near_dedup.table_keys(a) == near_dedup.table_keys(b)).sum() == (near_dedup.HALVES - 10) * (near_dedup.HALVES - 2)
    assert len(np.unique(near_dedup.table_keys(a))) == near_dedup.HALVES**2
