import collections
import math
import zlib

import numpy as np
import pytest
from helpers import SF
from llm_conftest import words
from pyspark.sql import functions as F

from grainline.llm import katz, queries


class Brute:
    """The model on words, without hashes or blocks."""

    def __init__(self, texts):
        self.uni, self.bi, self.ctx = collections.Counter(), collections.Counter(), collections.Counter()
        for t in texts:
            w = [*words(t), None]
            self.uni.update(w)
            self.bi.update(zip([None, *w[:-1]], w, strict=True))
            self.ctx.update([None, *w[:-1]])
        self.n = sum(self.uni.values())
        counts = [[sum(1 for v in c.values() if v == r) for r in range(1, katz.K + 2)] for c in (self.uni, self.bi)]
        self.dw, self.dg = map(katz.discounts, counts)
        self.unknown = 1 - sum(self.dw[min(c, katz.K + 1)] * c for c in self.uni.values()) / self.n if self.n else 1.0
        self.kept, self.mass = collections.Counter(), collections.Counter()
        for (u, v), c in self.bi.items():
            self.kept[u] += self.dg[min(c, katz.K + 1)] * c
            self.mass[u] += self.p(v)

    def p(self, v):
        c = self.uni.get(v, 0)
        return self.dw[min(c, katz.K + 1)] * c / self.n if c else self.unknown

    def given(self, u, v):
        c = self.bi.get((u, v), 0)
        if c:
            return self.dg[min(c, katz.K + 1)] * c / self.ctx[u]
        return self.p(v) if u not in self.ctx else (1 - self.kept[u] / self.ctx[u]) / (1 - self.mass[u]) * self.p(v)

    def row(self, text):
        w = [*words(text), None]
        base = sum(math.log10((self.uni.get(v, 0) + 1) / (self.n + len(self.uni) + 1)) for v in w)
        return len(w), sum(v in self.uni for v in w), self.n, base, sum(math.log10(self.given(u, v)) for u, v in zip([None, *w[:-1]], w, strict=True))


def compare(got, rows, held):
    model = Brute([t for i, t in rows if not held(i)])
    for u in [None, *list(model.ctx)[:5]]:
        assert sum(model.given(u, v) for v in model.uni) + model.given(u, "no such word") == pytest.approx(1)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(model.row(t))
    assert len(got) == len(rows)
    for r in got:
        want = min(texts[r["doc_id"]], key=lambda x: abs(x[4] - r["score"]))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3] and r["held_out"] == held(r["doc_id"])
        assert r["base_score"] == pytest.approx(want[3], rel=1e-9) and r["score"] == pytest.approx(want[4], rel=1e-9)
    return model


def test_query(spark, duck):
    rows, shown = duck.sql("select doc_id, text from documents").fetchall(), queries.op5_lm_score(spark, SF).collect()
    got = katz.score(spark.read.parquet(f"{SF}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()
    exact = {r["doc_id"]: r for r in got}
    assert len(shown) == len(got) and all(abs(r[c] - exact[r["doc_id"]][c]) <= 6e-7 for r in shown for c in ("base_score", "score"))  # shown to six digits
    compare(got, rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_awkward_rows(odd, none, without_id):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    compare(katz.score(odd, F.col("doc_id") % 4 == 1).collect(), rows, lambda i: i % 4 == 1)
    assert katz.score(none, F.lit(False)).count() == 0
    alone = katz.score(odd, F.lit(True)).collect()
    assert len(alone) == len(rows) and all(r["train_tokens"] == 0 and r["score"] == 0 for r in alone)
    assert sum(r["doc_id"] is None for r in katz.score(without_id, F.lit(False)).collect()) == 1


def test_many_blocks_and_shards(odd, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_BYTES", 200)
    monkeypatch.setattr(katz, "SHARD_BYTES", 100)
    compare(katz.score(odd, F.col("doc_id") % 4 == 1).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], lambda i: i % 4 == 1)


def test_blocks_ask_once_for_a_context(spark, monkeypatch):
    """What a block sends for a word doesn't grow with the tokens that back off after it."""
    sent, weigh = [], katz.weighed
    monkeypatch.setattr(katz, "weighed", lambda asked: (sent.append(asked), weigh(asked))[1])
    rows = [(0, "the cat the dog the end")] + [(i, " ".join(f"the unseen{i}x{k}" for k in range(50))) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    compare(katz.score(df, F.col("doc_id") > 0).collect(), rows, lambda i: i > 0)
    asks = sent[0].collect()
    assert len({r["block"] for r in asks}) == 1
    assert sum(len(v) for r in asks for v in r if isinstance(v, bytes | bytearray)) <= 32 * 5  # the, cat, dog, end and the end of a document


def test_counts_of_any_size():
    draw = np.random.default_rng(1)
    parts = [draw.integers(0, 1 << bits, 9) for bits in (1, 8, 9, 16, 17, 32, 33, 62)] + [np.zeros(0, np.int64), np.array([2**32 - 1, 2**32, 2**63 - 1])]
    assert (katz.unpacked(map(katz.packed, parts)) == np.concatenate(parts)).all()
    assert [len(katz.packed(np.array([x]))) for x in (255, 256, 2**16, 2**32)] == [2, 3, 5, 9]


def test_shards_sum_beyond_32_bits(spark):
    """Two blocks that each saw a word 3 * 2**31 times are told the sum."""
    n, one = 3 * 2**31, np.array([7], np.uint64).tobytes()
    rows = [(b, 0, bytearray(one), bytearray(katz.packed(np.array([n]))), bytearray(b"\x00"), bytearray(one), bytearray(katz.packed(np.array([n])))) for b in (0, 1)]
    asked = spark.createDataFrame(rows, "block long, shard long, words binary, word_n binary, word_held binary, grams binary, gram_n binary")
    for r in asked.groupBy("shard").applyInPandas(katz.answered, katz.ANSWERED).collect():
        assert katz.unpacked([bytes(r["word_n"])]).tolist() == katz.unpacked([bytes(r["gram_n"])]).tolist() == [2 * n]


def test_discounts():
    d = katz.discounts([1000, 400, 200, 120, 80, 55])
    assert d[0] == 0 and all(0 < x < 1 for x in d[1:])
    assert all(0 < x < 1 for x in katz.discounts([0] * 6)[1:])
