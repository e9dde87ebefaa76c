import pytest
from pyspark.sql import functions as F

from grainline.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total, out = set(names), budget * sum(sizes.values()), {}
    while left:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            total -= out[s]
        left -= over
    return out


def test_awkward_rows(odd, none):
    rows = mixing.mix(odd).collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] <= 2 * r["size"]
    want = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-5)
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(r["size"] for r in rows if r["source"] == s)
    assert sorted(map(str, mixing.mix(odd).collect())) == sorted(map(str, rows))
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixed_repeats_rows(odd):
    decided = {}
    for r in mixing.mix(odd).collect():
        decided.setdefault(r["doc_id"], []).append(r["epochs"])
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: sum(e) for i, e in decided.items() if sum(e)}


def test_hot_source_and_quality(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), (F.col("id") % 2 + 0.1).alias("q"))
    rows = mixing.mix(docs, quality=F.col("q"), budget=0.5).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3
        part = [r for r in own if r["taken"] % 6 == 3]
        if 100 < len(part) < len(own) - 100 and own[0]["target"] < own[0]["source_size"]:
            assert sum(r["doc_id"] % 2 for r in part) > 0.6 * len(part)


def test_keys_that_agree_in_any_number_of_digits(spark, monkeypatch):
    """The cut equals that of an ordered list, for keys that are close, equal or of few values."""
    import random

    draw = random.Random(2)
    for spread in (4, 5000, 2**30, 2**59):
        rows = [(draw.choice(["a", "b", None]), draw.randrange(0, 9), draw.randrange(spread)) for _ in range(400)]
        df = spark.createDataFrame(rows, "source string, grain_size long, grain_key long")
        for r in mixing.cuts(df, budget=0.6).collect():
            own, upto, want = sorted((k, n) for s, n, k in rows if s == r["s"]), 0, -1
            rest = r["target"] - r["full"] * r["source_size"]
            for key in sorted({k for k, _ in own}):
                n = sum(m for k, m in own if k == key)
                want = key if upto + n / 2 <= rest else want
                upto += n
            taken = [k for k, _ in own if r["cut"] is not None and k <= r["cut"]]
            assert [k for k, n in own if n and k <= want] == [k for k, n in own if n and k in taken], (spread, r)


def test_labels_are_the_quality(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).where("doc_id < 2000").unionByName(docs.select("doc_id", F.lit(0).alias("quality")).where("doc_id < 10"))
    rows = mixing.mix(docs, labels=labels.withColumn("source", F.lit("x")), budget=0.5).collect()
    assert len(rows) == 3000
    share = lambda part: sum(r["taken"] > 0 for r in rows if part(r["doc_id"])) / sum(part(r["doc_id"]) for r in rows)
    assert share(lambda i: i < 2000 and i % 2) > 1.5 * share(lambda i: i < 2000 and not i % 2)
