"""LM scoring with a Katz backoff bigram model.

P(v | u) = d(c) * c(u, v) / c(u) for bigrams of the training documents, otherwise weight(u) * P(v); P(v) = d(c) * c(v) / N
for known words, otherwise the mass that is left, as one class. d is the Good-Turing discount of counts up to ``K``; larger
counts are discounted by ``REST`` only, so that every context keeps mass for what it never saw. weight(u) is what the
seen bigrams of u leave, over what their words' P leaves: every distribution sums to 1.

Words are 64-bit hashes. Documents are coded once, in blocks of some millions of tokens, to a table in buckets of the
block number. Each block asks for the counts of its distinct words and bigrams, dealt out by hash in packed arrays; the
shards sum what all blocks sent and store the answers, a table by shard and block. Blocks then score their tokens, ask
the shards of contexts for the weights of their distinct contexts, and add these up over the tokens that backed off.

A null text is empty: one end token; a null id is scored and trained on; each of repeated rows is a row; without
training documents every token is unknown; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.llm.common import chunks, mix, shared_dir, shuffle_partitions, stored, text_buffer, word_hashes

K, REST = 5, 1e-3
#: Bytes of text of one block.
BLOCK_BYTES = 10 << 20
#: Bytes of packed keys that one shard should get, about.
SHARD_BYTES = 8 << 20
END = np.uint64(0x5DEECE66D1234567)
_BLOCK = "block long, ids binary, nulls binary, held binary, sizes binary, words binary, tokens binary"
_BLOBS = ("ids", "nulls", "held", "sizes", "words", "tokens")
_COUNTS = [f"{kind}{i}" for kind in "wg" for i in range(K + 2)]
ANSWERED = "block long, shard long, word_n binary, word_held binary, gram_n binary, gram_own binary, " + ", ".join(f"{x} long" for x in [*_COUNTS, "known"])


def coded(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents: ids, which are held out, tokens of each, distinct word hashes, and each token's word."""

    def block(number: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, nulls, held, sizes, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        words, tokens = np.unique(hashes, return_inverse=True)
        blobs = [ids, nulls, held, sizes, words, tokens.astype(np.uint32)]
        return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=[x.split()[0] for x in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = TaskContext.get().partitionId() << 16, [], 0
        for batch in batches:
            all_ids = batch.column(0)
            nulls, held = all_ids.is_null().to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            ids = all_ids.fill_null(0).to_numpy()
            for i, j, data, offsets in chunks(*text_buffer(batch.column(1))):
                words, before = word_hashes(data, offsets)
                parts.append((ids[i:j], nulls[i:j], held[i:j], (np.diff(before) + 1).astype(np.int32), np.insert(words, before[1:], END)))
                size += len(data) + 8 * (j - i)
                if size >= BLOCK_BYTES:
                    yield block(number, parts)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield block(number, parts)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    return picked.mapInArrow(run, _BLOCK)


class Block:
    """One block's arrays, and its distinct words and bigrams in the order in which it asks for them."""

    def __init__(self, row, shards: int):
        kinds = {"ids": np.int64, "nulls": bool, "held": bool, "sizes": np.int32, "words": np.uint64, "tokens": np.uint32}
        for name, kind in kinds.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.v = self.tokens.astype(np.int64)
        end = int(np.searchsorted(self.words, END))
        self.u = np.empty_like(self.v)
        self.u[1:] = self.v[:-1]  # a document begins after an end
        self.u[:1] = end
        self.train = ~self.held[self.doc]
        codes, self.gram = np.unique(self.u * len(self.words) + self.v, return_inverse=True)
        self.gram_u, self.gram_v = codes // len(self.words), codes % len(self.words)
        grams = mix(self.words[self.gram_u] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.gram_v])
        self.word_cut, self.gram_cut = cut(self.words, shards), cut(grams, shards)
        self.grams = grams


def cut(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by shard, and where each shard's begin in it."""
    shard = ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _split(values: np.ndarray, by: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    order, edges = by
    values = values[order]
    return [values[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]


def packed(counts: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs, 8 at most; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max(initial=0)) < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpacked(parts: Iterable[bytes]) -> np.ndarray:
    """packed() numbers, end to end."""
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64) for x in parts)])


def _split_counts(values: np.ndarray, by: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    order, edges = by
    values = values[order]
    return [packed(values[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def answered(rows: pd.DataFrame) -> pd.DataFrame:
    """What all blocks are told by one shard, and the shard's share of the counts of counts, once."""
    rows = rows.sort_values("block")
    out, figures = {"block": rows["block"].to_numpy(), "shard": rows["shard"].to_numpy()}, np.zeros(len(_COUNTS), np.int64)
    for k, kind in enumerate(("word", "gram")):
        sizes = [len(x) // 8 for x in rows[f"{kind}s"]]
        keys = np.frombuffer(b"".join(rows[f"{kind}s"]), np.uint64)
        n = unpacked(rows[f"{kind}_n"])
        unique, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, at, n)
        figures[k * (K + 2) : k * (K + 2) + K + 1] = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2]
        figures[k * (K + 2) + K + 1] = total.sum() if k == 0 else (total > 0).sum()
        edges = np.cumsum([0, *sizes])
        parts = lambda x, form=np.ndarray.tobytes: [form(x[a:b]) for a, b in zip(edges, edges[1:], strict=False)]  # noqa: E731, B023
        out[f"{kind}_n"] = parts(total[at], packed)
        if kind == "word":
            held = np.bincount(at, weights=np.frombuffer(b"".join(rows["word_held"]), bool), minlength=len(unique)) > 0
            out["word_held"] = parts(held[at])
            known = int((total > 0).sum())
        else:  # one of the blocks that train on a bigram counts it for its context
            owner = np.zeros(len(keys), bool)
            trained = np.flatnonzero(n)
            owner[trained[np.unique(keys[trained], return_index=True)[1]]] = True
            out["gram_own"] = parts(owner)
    for name, x in zip([*_COUNTS, "known"], [*figures, known], strict=True):
        out[name] = np.where(np.arange(len(rows)) == 0, x, 0)
    return pd.DataFrame(out)


def counted(blocks: DataFrame, shards: int) -> DataFrame:
    """(block, shard, ...): for each block's words and bigrams their counts in all training documents."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_buffer() for name in _BLOBS}
                b = Block(row, shards)
                count = lambda x, n, who: np.bincount(x[who], minlength=n)
                words = count(b.v, len(b.words), b.train)
                held = np.zeros(len(b.words), bool)
                held[b.u[~b.train]] = True
                grams = count(b.gram, len(b.grams), b.train)
                blobs = [_split(b.words, b.word_cut), _split_counts(words, b.word_cut), _split(held, b.word_cut), _split(b.grams, b.gram_cut), _split_counts(grams, b.gram_cut)]
                some = np.flatnonzero(np.diff(b.word_cut[1]) + np.diff(b.gram_cut[1]))  # never more rows than keys
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("block")[i].as_py()] * len(some)), pa.array(some), *(pa.array([x[k] for k in some], pa.binary()) for x in blobs)], names=["block", "shard", "words", "word_n", "word_held", "grams", "gram_n"])

    asked = blocks.mapInArrow(ask, "block long, shard long, words binary, word_n binary, word_held binary, grams binary, gram_n binary")
    return asked.groupBy("shard").applyInPandas(answered, ANSWERED)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discounts of counts 0 to K + 1, the last for all larger ones; n: how many keys have counts 1 to K + 1.

    Where a ratio isn't between 0 and 1, as in small corpora, half a count is taken off instead.
    """
    out = np.full(K + 2, 1 - REST)
    out[0] = 0
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for c in range(1, K + 1):
        ratio = (c + 1) * n[c] / (c * n[c - 1]) if n[c - 1] else 0.0
        d = (ratio - common) / (1 - common) if common < 1 else 0.0
        out[c] = d if 0 < d < 1 else 1 - 0.5 / c
    return out


def weighed(asked: DataFrame) -> DataFrame:
    """(block, shard, weight): log10 of the backoff weights of the contexts that blocks ask for, each once a block."""

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        whole = lambda name, kind: np.frombuffer(b"".join(rows[name]), kind)
        words, c = whole("words", np.uint64), whole("n", np.int64)
        _, at = np.unique(words, return_inverse=True)
        kept, mass = (np.bincount(at, weights=whole(x, np.float64))[at] if len(at) else whole(x, np.float64) for x in ("kept", "mass"))
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.log10(np.maximum(1 - kept / np.maximum(c, 1), 1e-300) / np.maximum(1 - mass, 1e-15))
        edges = np.cumsum([0, *(len(x) // 8 for x in rows["words"])])
        return pd.DataFrame({"block": rows["block"], "shard": rows["shard"], "weight": [weight[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)]})

    return asked.groupBy("shard").applyInPandas(weigh, "block long, shard long, weight binary")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    partitions = shuffle_partitions(spark)
    buckets = max(partitions, 2 * int(size) // BLOCK_BYTES)
    name = f"katz_{uuid.uuid4().hex}"
    coded(docs, held_out, id_col, text_col).write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, "block").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay in the shared folder; only the catalog forgets them
    tokens = blocks.select(F.sum(F.length("tokens")) * 2).first()[0] or 0
    shards = max(2 * partitions, int(tokens) // SHARD_BYTES + 1)
    answers = stored(counted(blocks, shards), "counts")
    sums = answers.agg(*[F.sum(c).alias(c) for c in [*_COUNTS, "known"]]).first()
    sums = [int(sums[c] or 0) for c in [*_COUNTS, "known"]]
    total, known = sums[K + 1], sums[-1]
    of_words, of_grams = discounts(sums[: K + 1]), discounts(sums[K + 2 : 2 * K + 3])
    small = np.arange(1, K + 1)
    seen_mass = (of_words[1 : K + 1] * small * sums[:K]).sum() + of_words[K + 1] * (total - (small * sums[:K]).sum())
    unknown = 1 - seen_mass / total if total else 1.0

    def unigram(c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, of_words[np.minimum(c, K + 1)] * c / max(total, 1), unknown)

    def judged(blocks_: pd.DataFrame, replies: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """A block's asks for weights by shard, and its sums by document with what is to be added to them."""
        row = blocks_.iloc[0]
        b, replies = Block(row, shards), replies.sort_values("shard")

        def told(column: str, kind, by) -> np.ndarray:
            """A column of replies in the block's order; without a kind packed counts."""
            values = unpacked(replies[column]) if kind is None else np.frombuffer(b"".join(replies[column]), kind)
            out = np.empty_like(values)
            out[by[0]] = values
            return out

        c, needed = told("word_n", None, b.word_cut), told("word_held", bool, b.word_cut)
        gram, mine = told("gram_n", None, b.gram_cut), told("gram_own", bool, b.gram_cut)
        p = unigram(c)
        # as a context a word counts as often as it is one: every token but an end is followed by one, every end begins
        kept = of_grams[np.minimum(gram, K + 1)] * gram
        with np.errstate(divide="ignore"):
            seen, backed = np.log10(kept / np.maximum(c[b.gram_u], 1)), np.log10(p[b.gram_v])
            base = np.log10((c + 1) / (total + known + 1))
        gram_score = np.where(gram > 0, seen, backed)
        n = len(b.sizes)
        add = lambda x: np.bincount(b.doc, weights=x, minlength=n)
        # contexts that some held-out document has: what their seen bigrams keep, and what the words of these have alone
        use = mine & needed[b.gram_u]
        context = np.zeros(len(c), bool)
        context[b.gram_u[use]] = True
        off = (gram[b.gram] == 0) & (c[b.u] > 0)  # after an unknown context the unigram stands
        context[b.u[off]] = True
        held_mass = np.bincount(b.gram_u[use], weights=kept[use], minlength=len(c))
        word_mass = np.bincount(b.gram_u[use], weights=p[b.gram_v[use]], minlength=len(c))
        picked = np.flatnonzero(context)
        order, edges = cut(b.words[picked], shards)
        picked = picked[order]
        place = np.full(len(c), -1)
        place[picked] = np.arange(len(picked))
        parts = lambda x: [x[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)]
        asks = pd.DataFrame({"block": row["block"], "shard": np.arange(shards), "words": parts(b.words[picked]), "n": parts(c[picked]), "kept": parts(held_mass[picked]), "mass": parts(word_mass[picked])})
        asks = asks[np.diff(edges) > 0]
        posts, times = np.unique(place[b.u[off]] * n + b.doc[off], return_counts=True)
        docs_ = {"id": b.ids, "null": b.nulls, "held": b.held, "tokens": b.sizes, "seen": add(c[b.v] > 0), "base": add(base[b.v]), "score": add(gram_score[b.gram]), "post_word": posts // n, "post_doc": posts % n, "post_n": times}
        return asks, pd.DataFrame({"block": [row["block"]]} | {k: [docs_[k].astype(kind).tobytes()] for k, kind in kinds.items()})

    kinds = {"id": np.int64, "null": bool, "held": bool, "tokens": np.int64, "seen": np.int64, "base": np.float64, "score": np.float64, "post_word": np.uint32, "post_doc": np.uint32, "post_n": np.uint32}

    def finished(sums: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        x = {k: np.frombuffer(sums[k].iloc[0], kind) for k, kind in kinds.items()}
        weight = np.frombuffer(b"".join(weights.sort_values("shard")["weight"]), np.float64)
        more = np.bincount(x["post_doc"], weights=weight[x["post_word"]] * x["post_n"], minlength=len(x["id"]))
        out = pd.DataFrame({"doc_id": x["id"], "held_out": x["held"], "n_tokens": x["tokens"], "n_known": x["seen"], "base_score": x["base"], "score": x["score"] + more})
        return out.assign(doc_id=out["doc_id"].astype("Int64").mask(x["null"]))

    answers = answers.select("block", "shard", "word_n", "word_held", "gram_n", "gram_own")
    # judged twice rather than stored: its input is shuffled once, and blocks need not wait on disk
    met = lambda which, schema: blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(lambda left, right: judged(left, right)[which], schema)
    asked = met(0, "block long, shard long, words binary, n binary, kept binary, mass binary")
    sums = met(1, "block long, " + ", ".join(f"{x} binary" for x in kinds))
    out = sums.groupBy("block").cogroup(weighed(asked).groupBy("block")).applyInPandas(finished, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
