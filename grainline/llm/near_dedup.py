"""MinHash near-dedup with tensored banding.

Each document's set of word shingles gets two small collections of half keys, each half key made of ``ROWS`` minhashes.
Every pair of one half key from either collection is a table key, so ``HALVES`` squared tables cost only
2 * HALVES * ROWS minhashes. Two sets of similarity s miss each other with a chance of about 2 * (1 - s**ROWS)**HALVES.

1. sketches: set size, set hash and half keys of every row, and the row's number. Equal sets are one class;
   the row with its smallest id stands for it.
2. Table keys are dealt out in packed blocks; representatives that share one form candidate clusters.
3. Full sets are compared within the clusters, all against all, so links that no table found are found too. A cluster of
   more than ``BLOCK`` sets is cut by set size, as sets of too different sizes can't link, and each size into blocks; each
   pair of blocks of one or of neighbouring sizes is a task of its own.
4. Links give components; every document gets that of its class.

A document without words links to nothing. Rows are told apart by their number, not by their id: rows that repeat an id
may have different texts, and rows without an id link like others. They never name a component; where no row of one has an
id, component_id is null and the first row stays. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainline.llm.common import chunks, components, mix, shuffle_partitions, stored, text_buffer, word_hashes

HALVES, ROWS, BLOCK, COLUMNS = 14, 3, 512, 4096
#: Sets whose table keys are made and packed at once.
PACKED = 4096
#: Bytes of packed keys or sets that one task should get, about.
TASK_BYTES = 8 << 20
_draw = np.random.default_rng(411)
_XOR = _draw.integers(0, 2**63, 2 * HALVES * ROWS, dtype=np.uint64)
_ODD = _draw.integers(0, 2**62, 2 * HALVES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each document's begin (n + 1)."""
    words, before = word_hashes(data, offsets)
    count = np.diff(before)
    many = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), many)
    first = before[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    length = np.minimum(count[doc], width)
    value = np.zeros(len(doc), np.uint64)
    for k in range(width):
        inside = length > k
        value[inside] = mix(value[inside] * np.uint64(0x9E3779B97F4A7C15) + words[first[inside] + k])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(len(count) + 1))


def half_keys(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """2 * HALVES half keys of each set that isn't empty; begin: where the sets begin, without their end."""
    out = np.zeros((len(begin), 2 * HALVES), np.uint64)
    for k in range(2 * HALVES * ROWS):
        least = np.minimum.reduceat((values ^ _XOR[k]) * _ODD[k], begin)
        out[:, k // ROWS] = mix(out[:, k // ROWS] + least)
    return out


def table_keys(halves: np.ndarray) -> np.ndarray:
    """HALVES**2 keys of each row of half keys."""
    table = np.arange(HALVES * HALVES, dtype=np.uint64).reshape(HALVES, HALVES)
    return mix(halves[:, :HALVES, None] + mix(halves[:, None, HALVES:] + table)).reshape(len(halves), -1)


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text_hash, n, s1, s2, halves): size of the set, 128 bits of its hash, packed half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(*text_buffer(batch.column(3))):
                values, begin = shingle_sets(data, offsets, width)
                n = np.diff(begin)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(c)))]) for c in (1, 2)]
                full = np.flatnonzero(n)
                packed = [b""] * len(n)
                if len(full):
                    for row, keys in zip(full, half_keys(values, begin[full]), strict=True):
                        packed[row] = keys.tobytes()
                s1, s2 = ((s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in sums)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:3]), pa.array(n), pa.array(s1), pa.array(s2), pa.array(packed, pa.binary())], ["row", "doc_id", "text_hash", "n", "s1", "s2", "halves"])

    text = F.col(text_col).cast("string")
    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return picked.mapInArrow(run, "row long, doc_id long, text_hash long, n long, s1 long, s2 long, halves binary")


def candidates(reps: DataFrame, shards: int) -> DataFrame:
    """reps (rep, halves): edges (a, b) from the smallest representative of each table key's bucket to the others."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), PACKED):
                own = ids[at : at + PACKED]
                keys = table_keys(np.frombuffer(b"".join(batch.column(1).slice(at, len(own)).to_pylist()), np.uint64).reshape(len(own), -1))
                row = np.repeat(np.arange(len(own), dtype=np.uint16), keys.shape[1])
                keys = keys.ravel()
                shard = ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                edges = np.searchsorted(shard[order], np.arange(shards + 1))
                parts = [order[a:b] for a, b in zip(edges, edges[1:], strict=False)]
                some = [k for k, p in enumerate(parts) if len(p)]  # never more rows than keys
                parts = [parts[k] for k in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([row[p].tobytes() for p in parts], pa.binary()), pa.array([own[np.unique(row[p])].tobytes() for p in parts], pa.binary())],
                    ["shard", "keys", "places", "ids"],
                )

    def meet(blocks: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(blocks["keys"]), np.uint64)
        reps_ = np.concatenate([np.frombuffer(i, np.int64)[np.unique(np.frombuffer(p, np.uint16), return_inverse=True)[1]] for p, i in zip(blocks["places"], blocks["ids"], strict=True)] or [np.zeros(0, np.int64)])
        order = np.lexsort((reps_, keys))
        keys, reps_ = keys[order], reps_[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        head = reps_[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))] if len(keys) else reps_
        pairs = np.unique(np.stack([head, reps_], axis=1)[head != reps_], axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return reps.mapInArrow(deal, "shard int, keys binary, places binary, ids binary").groupBy("shard").applyInPandas(meet, "a long, b long")


def linked(sets: list[np.ndarray], percent: int, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with 100 * intersection >= percent * union, i < j; first: only pairs across that position."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    common = np.zeros((n, n), np.float32)
    values = np.concatenate(sets)
    row = np.repeat(np.arange(n), sizes)
    _, column, df = np.unique(values, return_inverse=True, return_counts=True)
    name = np.cumsum(df > 1) - 1
    shared = df[column] > 1
    row, column = row[shared], name[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        m = np.zeros((n, min(COLUMNS, int(column[b - 1]) - at + 1)), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    link = np.triu(100 * common >= percent * (sizes[:, None] + sizes[None, :] - common), 1)
    if first is not None:
        link[:first, :first] = link[first:, first:] = False
    return np.nonzero(link)


def smallest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest id that each id reaches by the links (a, b)."""
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y, key=lambda i: ids[i])] = min(x, y, key=lambda i: ids[i])
    return ids[[root(i) for i in range(len(ids))]]


def links(docs: DataFrame, clusters: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(node, component) of the representatives that link to another; clusters (rep, least, text_hash, s1, s2, n, cluster).

    Texts are found again by id and hash, and by the hash alone where there is no id.
    """
    spark = docs.sparkSession
    # sizes of sets that link differ by a factor of 100 / percent at most, so by one class of sizes at most
    size_class = F.floor(F.log(F.col("n")) / math.log(100 / percent) * 0.999).cast("int") if percent < 100 else F.col("n").cast("int")
    classed = clusters.withColumn("class", size_class)
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
    total, many = sizes.agg(F.sum("weight"), F.count(F.lit(1))).first()
    if not many:
        return spark.createDataFrame([], "node long, component long")
    bins = max(2 * shuffle_partitions(spark), 8 * total // TASK_BYTES)
    cut = stored(classed.groupBy("cluster", "class").agg((F.floor((F.count(F.lit(1)) - 1) / BLOCK) + 1).cast("int").alias("blocks")), "cut")
    near = [cut.select("cluster", (F.col("class") - step).alias("class"), F.col("blocks").alias(name)) for step, name in ((1, "up"), (-1, "down"))]
    around = cut.join(near[0], ["cluster", "class"], "left").join(near[1], ["cluster", "class"], "left").na.fill(0, ["up", "down"])
    wanted = classed.join(sizes, "cluster").join(around, ["cluster", "class"])
    wanted = wanted.select("rep", "least", F.col("text_hash").alias("h"), F.col("s1").alias("c1"), F.col("s2").alias("c2"), "cluster", "class", (F.col("size") > BLOCK).alias("large"), "blocks", "up", "down")
    carried = ("cluster", "class", "large", "blocks", "up", "down")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(*text_buffer(batch.column(0))):
                values, begin = shingle_sets(data, offsets, width)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(c)))]) for c in (1, 2)]
                own = {name: batch.column(name).slice(i, j - i) for name in batch.schema.names[1:]}
                same = [own[name].to_numpy() == (s[begin[1:]] - s[begin[:-1]]).view(np.int64) for name, s in zip(("c1", "c2"), sums, strict=True)]
                packed = pa.array([values[a:b].tobytes() for a, b in zip(begin, begin[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([own["rep"], *(own[c] for c in carried), packed], ["rep", *carried, "shingles"]).filter(pa.array(same[0] & same[1]))

    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    without = texts.where("doc_id is null").groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))  # any number of rows may lack an id
    texts = texts.where("doc_id is not null").unionByName(without)
    # one plan at every size: the texts are dealt out by id and hash, whatever the number of representatives
    joined = texts.hint("merge").join(wanted, (texts["text_hash"] == wanted["h"]) & texts["doc_id"].eqNullSafe(wanted["least"])).select("text", "rep", "c1", "c2", *carried)
    sets = stored(joined.mapInArrow(run, "rep long, cluster long, class int, large boolean, blocks int, up int, down int, shingles binary"), "sets")

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in rows.drop_duplicates("rep").groupby("cluster", sort=False):
            ids = own["rep"].to_numpy()
            label = smallest(ids, *linked([np.frombuffer(s, np.uint64) for s in own["shingles"]], percent))
            out.append(pd.DataFrame({"node": ids, "component": label})[ids != label])
        return pd.concat(out)

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("rep").sort_values(["first", "rep"], ascending=[False, True])
        same = bool((rows["lo"] == rows["hi"]).iloc[0])
        first = None if same else int(rows["first"].sum())
        ids = rows["rep"].to_numpy()
        label = smallest(ids, *linked([np.frombuffer(s, np.uint64) for s in rows["shingles"]], percent, first))
        return pd.DataFrame({"a": label, "b": ids})[ids != label]

    small = sets.where("not large").withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("int")).groupBy("bin").applyInPandas(within, "node long, component long")
    own = F.struct("class", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    others = lambda n, step: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: F.struct((F.col("class") + step).alias("class"), k.alias("block"))))
    nothing = F.array().cast("array<struct<class:int,block:int>>")
    large = sets.where("large").withColumn("own", own).withColumn("other", F.explode(F.concat(*[F.coalesce(others(n, step), nothing) for n, step in (("blocks", 0), ("up", 1), ("down", -1))])))
    large = large.select("rep", "cluster", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("first"), "shingles")
    names = [F.concat_ws(":", F.col(f"{side}.class"), F.col(f"{side}.block")).alias(side) for side in ("lo", "hi")]
    edges = stored(large.select("rep", "cluster", *names, "first", "shingles").groupBy("cluster", "lo", "hi").applyInPandas(across, "a long, b long"), "links")
    return small.unionByName(components(edges).where("node <> component"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest id reachable), kept, text_hash, stays (one row of each component)."""
    spark = docs.sparkSession
    rows = stored(sketches(docs, width, id_col, text_col), "sketches")
    full = rows.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "text_hash")).alias("first")
    classes = full.groupBy("n", "s1", "s2").agg(first, F.first("halves").alias("halves"))
    classes = stored(classes.select("n", "s1", "s2", F.col("first.row").alias("rep"), F.col("first.doc_id").alias("least"), "first.text_hash", "halves"), "classes")
    shards = max(3 * shuffle_partitions(spark), classes.count() * HALVES * HALVES * 8 // TASK_BYTES)
    edges = candidates(classes.select("rep", "halves"), shards)
    clusters = components(edges).withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster")
    clusters = stored(classes.select("rep", "least", "text_hash", "s1", "s2", "n").join(clusters, "rep"), "clusters")
    label = stored(links(docs, clusters, width, percent, id_col, text_col), "labels")
    found = classes.select("n", "s1", "s2", "rep", "least").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # the row that stays: that with the smallest id, or the first one where none has an id
    named = found.groupBy(F.col("component").alias("c")).agg(F.min(F.struct(F.col("least").isNull(), "least", "rep")).alias("stays"))
    found = found.join(named, found["component"] == named["c"]).select("n", "s1", "s2", F.col("stays.least").alias("component_id"), F.col("stays.rep").alias("stays"))
    alone = rows.where("n = 0").select("row", "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("stays"))
    kept = F.when(F.col("component_id").isNull(), F.col("row") == F.col("stays")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    out = full.join(found, ["n", "s1", "s2"]).select("row", "doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), (F.col("row") == F.col("stays")).alias("stays"))
    return out.unionByName(alone).select("doc_id", "n_shingles", "component_id", "kept", "text_hash", "stays")
