"""The whole pipeline on a small table, each stage against a plain version of it."""

import hashlib

import corpus_pipeline
from helpers import SF
from llm_conftest import words
from pyspark.sql import functions as F
from test_mixing import brute_targets
from test_near_dedup import brute as near_brute
from test_packing import PATH, check_layout, pieces

from grainline.llm import packing


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r["doc_id"]: r for r in docs.collect()}
    tables = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS), name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        tables.append(docs.collect())
    known, single, apart, mixed, packed = tables
    assert {r["doc_id"] for r in known} == {i for i, r in seen.items() if any(c.isalpha() for c in r["text"])}
    groups = {}
    for r in known:
        groups.setdefault(hashlib.sha256(r["text"].encode().lower()).digest(), []).append(r["doc_id"])
    assert {r["doc_id"] for r in single} == {max(g) for g in groups.values()}
    assert {r["doc_id"] for r in apart} == {i for i, _, _, kept in near_brute([(r["doc_id"], r["text"]) for r in single], width=5) if kept}
    sizes, taken, epochs = {}, {}, {}
    for r in apart:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
        epochs[r["doc_id"]] = epochs.get(r["doc_id"], 0) + 1
    want = brute_targets(sizes)
    longest = max(len(words(r["text"])) for r in apart)
    assert max(epochs.values()) <= 2 and all(abs(taken.get(s, 0) - want[s]) <= longest for s in want)
    texts = {r["doc_id"]: r["text"] for r in apart}
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted((i, *p) for i, n in epochs.items() for p in pieces(texts[i]) for _ in range(n))
    assert check_layout(packed, packing.CAPACITY) < 1.1 * sum(r["length"] for r in packed) / packing.CAPACITY + 1
    assert PATH


def test_awkward_documents(spark, without_id, tmp_path):
    docs = without_id.withColumn("n_chars", F.length("text").cast("long"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert docs.count() > 0


def test_rows_without_an_id_collapse_too(spark):
    """Equal texts and near copies leave one row, whichever ids they have; repeated rows leave one."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(None, a), (None, a.upper()), (None, b), (4, b), (4, b), (5, c), (5, c + " z"), (None, c + " y"), (7, a + " z"), (4, "other words")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.exact(spark, docs, SF).collect()), key=str)
    assert len(left) == 7 and [x for x in left if x[1].lower() != a] == sorted([(4, b), (4, "other words"), (5, c), (5, c + " z"), (7, a + " z"), (None, c + " y")], key=str)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in left], docs.schema).repartition(3)
    near = sorted(r["text"] for r in corpus_pipeline.near(spark, docs, SF).collect())
    assert len(near) == 4 and near[0] == a + " z" and near[1] == b and near[2] in (c, c + " z") and near[3] == "other words"


def test_documents_without_a_label_stay(spark):
    texts = ["some words", "zwölf Boxkämpfer", None, "", "12345 !!"]
    docs = spark.createDataFrame([(i, t, None, "a", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.language(spark, docs, SF)
    assert out.columns == list(corpus_pipeline.COLUMNS) and sorted(r["doc_id"] for r in out.collect()) == [0, 1]


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert docs.count() == 0
