"""Exact dedup by a minimal perfect hash over the digests of an earlier corpus.

``digests`` hashes every normalised text. ``build_index`` turns the distinct digests of the history into shards, each a
minimal perfect hash, stored as its bits, whose slots hold the full digest, the winner's doc_id and the group's size. ``absorb`` looks the
distinct digests of a batch up: a slot that holds the very same bytes is a member and may take a larger winner, every
other digest forms a group of its own. Hot groups are folded to one row before any shuffle by digest.

Null texts count as empty; a null doc_id loses to any other; rows that repeat are rows of one group each; an empty
table gives an empty result; columns beside the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.llm.common import mix, stored

#: Digests of one shard of the index, about 1.3 MB of slots.
SHARD_DIGESTS = 25_000
LEVELS = 48


def digests(docs: DataFrame, history: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, hist, text_hash): SHA-256 of the text's UTF-8 bytes after lower-casing A-Z only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_binary())
            out = [hashlib.sha256(x.as_buffer().to_pybytes().lower()).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), *batch.columns[2:]], ["doc_id", "digest", "hist", "text_hash"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(history.cast("boolean"), F.lit(False)).alias("hist"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    return picked.mapInArrow(run, "doc_id long, digest binary, hist boolean, text_hash long")


def distinct(rows: DataFrame) -> DataFrame:
    """(digest, winner, n): the largest doc_id and the size of each group, summed on the map side first."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))


class MinimalPerfectHash:
    """n distinct 32-byte digests onto 0..n-1: levels of bit arrays hold the keys that fall alone, the rest goes on."""

    def __init__(self, keys: np.ndarray):
        """keys: n rows of four uint64."""
        self.n, self.levels, left, at = len(keys), [], np.arange(len(keys)), 0
        for level in range(LEVELS):
            if not len(left):
                break
            m = max(64, 2 * len(left))
            spot = self._spot(keys[left], level, m)
            alone = np.bincount(spot, minlength=m) == 1
            self.levels.append((m, at, alone, np.cumsum(alone) - 1))
            at += int(alone.sum())
            left = left[~alone[spot]]
        self.rest = {keys[i].tobytes(): at + k for k, i in enumerate(left)}

    def dumped(self) -> bytes:
        """The hash without its keys: levels as bits, then the keys that no level took, in slot order."""
        head = [len(self.levels), self.n, *(m for m, _, _, _ in self.levels)]
        return np.array(head, "<u8").tobytes() + b"".join([*(np.packbits(alone).tobytes() for _, _, alone, _ in self.levels), *self.rest])

    @classmethod
    def loaded(cls, data: bytes) -> MinimalPerfectHash:
        out = cls.__new__(cls)
        many, out.n = (int(x) for x in np.frombuffer(data, "<u8", 2))
        sizes, at, byte = np.frombuffer(data, "<u8", many, 16).tolist(), 0, 16 + 8 * many
        out.levels = []
        for m in sizes:
            alone = np.unpackbits(np.frombuffer(data, np.uint8, -(-m // 8), byte), count=m).astype(bool)
            out.levels.append((m, at, alone, np.cumsum(alone) - 1))
            at, byte = at + int(alone.sum()), byte + -(-m // 8)
        out.rest = {data[b : b + 32]: at + k for k, b in enumerate(range(byte, len(data), 32))}
        return out

    @staticmethod
    def _spot(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        x = np.full(len(keys), (0x9E3779B97F4A7C15 * (level + 1)) % 2**64, np.uint64)
        for word in keys.T:
            x = mix(x ^ word)
        return (x % np.uint64(m)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; for a key outside the set any slot, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (m, at, alone, rank) in enumerate(self.levels):
            spot = self._spot(keys[left], level, m)
            hit = alone[spot]
            out[left[hit]] = at + rank[spot[hit]]
            left = left[~hit]
        for i in left if self.rest else ():
            out[i] = self.rest.get(keys[i].tobytes(), -1)
        return out


def _words(digest: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digest), dtype="<u8").reshape(-1, 4)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """For each shard the hash, and the digests, winners and sizes in slot order."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        order = np.empty(len(rows), np.int64)
        found = MinimalPerfectHash(_words(rows["digest"]))
        order[found.slots(_words(rows["digest"]))] = np.arange(len(rows))
        rows = rows.iloc[order]
        return pd.DataFrame({
            "shard": [int(rows["shard"].iloc[0])], "hash": [found.dumped()], "digests": [b"".join(rows["digest"])],
            "winners": [rows["winner"].fillna(np.iinfo(np.int64).min).to_numpy(np.int64).tobytes()], "sizes": [rows["n"].to_numpy(np.int64).tobytes()],
        })

    return history.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, "shard int, hash binary, digests binary, winners binary, sizes binary")


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def absorb(index: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, group_size, known) of every digest of the index or the batch.

    batch: distinct (digest, winner, n). known: the history has the digest. The slot of a lookup counts only if all 32
    bytes agree; the nonmembers are distinct already and stay groups of their own.
    """
    none = np.iinfo(np.int64).min

    def merge(slots: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(slots["digests"].iloc[0], "<u8").reshape(-1, 4) if len(slots) else np.zeros((0, 4), np.uint64)
        winner = np.frombuffer(slots["winners"].iloc[0], np.int64).copy() if len(slots) else np.zeros(0, np.int64)
        size = np.frombuffer(slots["sizes"].iloc[0], np.int64).copy() if len(slots) else np.zeros(0, np.int64)
        asked = _words(rows["digest"]) if len(rows) else np.zeros((0, 4), np.uint64)
        new_winner, new_size = rows["winner"].fillna(none).to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        slot = MinimalPerfectHash.loaded(slots["hash"].iloc[0]).slots(asked) if len(slots) else np.full(len(asked), -1, np.int64)
        member = slot >= 0
        member[member] = (keys[slot[member]] == asked[member]).all(axis=1)
        hit = slot[member]
        winner[hit] = np.maximum(winner[hit], new_winner[member])
        size[hit] += new_size[member]
        digest = [x.tobytes() for x in keys] + list(rows["digest"][~member])
        keep = np.concatenate([winner, new_winner[~member]])
        out = pd.DataFrame({"digest": digest, "keep_id": pd.array(keep, "Int64"), "group_size": np.concatenate([size, new_size[~member]]), "known": np.arange(len(keep)) < len(keys)})
        out.loc[keep == none, "keep_id"] = pd.NA
        return out

    rows = batch.withColumn("shard", _shard(shards)).groupBy("shard")
    return index.groupBy("shard").cogroup(rows).applyInPandas(merge, "digest binary, keep_id long, group_size long, known boolean")


def dedup(docs: DataFrame, history=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, in_history, text_hash (of the text as it is).

    history: a column that says which rows make the historical corpus (all other rows are the new batch); without it,
    half of the ids do. The row with the largest doc_id of each group stays, wherever it is.
    """
    rows = stored(digests(docs, F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 2 == 0 if history is None else history, id_col, text_col), "digests")
    old, new = distinct(rows.where("hist")), distinct(rows.where("not hist"))
    shards = max(1, rows.count() // SHARD_DIGESTS)
    groups = absorb(build_index(old, shards), new, shards)
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("known").alias("in_history"), "text_hash",
    )
