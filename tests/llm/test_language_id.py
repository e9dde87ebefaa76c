import zlib

import numpy as np
from helpers import SF
from pyspark.sql import functions as F

from grainline.llm import language_id, queries


def test_query(spark, duck):
    lang = dict(duck.sql("select doc_id, lang from documents").fetchall())
    rows = queries.op4_language_id(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.93
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_rows(odd, none):
    rows = {r["doc_id"]: r for r in language_id.identify(odd, F.lit(True)).collect()}
    for i in (0, 1, 2, 18):
        assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in rows.values()} <= {"en", "de", "und"}
    assert language_id.identify(odd, F.lit(False)).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert language_id.identify(none, F.lit(True)).count() == 0


def test_gradients():
    draw = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in language_id.fresh(3).items()}
    x, y = draw.integers(97, 103, (5, 4)), np.array([0, 1, 2, 1])

    def loss(p):
        hidden = {d: np.zeros((5, language_id.HIDDEN, 4)) for d in "fb"}
        for d in "fb":
            for t, h in language_id._walk(p, d, x):
                hidden[d][t] = h
        return -np.mean([np.log(language_id._softmax(p["out_f"] @ hidden["f"][t] + p["out_b"] @ hidden["b"][t] + p["bias"])[y, np.arange(4)]) for t in range(5)])

    grad = language_id._gradients(p, x, y)
    for k in p:
        for _ in range(4):
            at = (draw.integers(p[k].shape[0]), int(draw.choice(x.ravel())) if k.startswith("wx") else draw.integers(p[k].shape[1]))
            moved = {n: v.copy() for n, v in p.items()}
            moved[k][at] += 1e-3
            up = loss(moved)
            moved[k][at] -= 2e-3
            assert abs((up - loss(moved)) / 2e-3 - grad[k][at]) < 2e-4, (k, at)


def test_pooling_is_per_document():
    p, draw = language_id.fresh(3), np.random.default_rng(1)
    texts = [bytes(draw.integers(97, 123, n).astype(np.uint8)) for n in (1, 127, 128, 129, 1000, 0)]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    together = language_id.pooled(p, data, offsets)
    for i, t in enumerate(texts):
        alone = language_id.pooled(p, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        assert np.allclose(together[i], alone, atol=1e-6)
        assert not len(t) or abs(alone.sum() - 1) < 1e-5


def plain(p, text):
    """The mean probabilities of one text, position by position, without lanes."""
    n, size, wide = len(text), language_id.HIDDEN, language_id.CONTEXT
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(d, places):
        h, out = np.zeros(size), {}
        for t in places:
            g, u = p[f"wx_{d}"][:, text[t]].astype(float), p[f"wh_{d}"].astype(float) @ h
            z, r = sig(g[:size] + u[:size]), sig(g[size : 2 * size] + u[size : 2 * size])
            h = (1 - z) * np.tanh(g[2 * size :] + r * u[2 * size :]) + z * h
            out[t] = h
        return out

    total = np.zeros(len(p["bias"]))
    for a in range(0, n, language_id.SEGMENT):
        b = min(n, a + language_id.SEGMENT)
        ahead, back = states("f", range(max(0, a - wide), b)), states("b", range(min(n, b + wide) - 1, a - 1, -1))
        for t in range(a, b):
            e = np.exp(p["out_f"] @ ahead[t] + p["out_b"] @ back[t] + p["bias"][:, 0])
            total += e / e.sum()
    return total / n


def test_network_equals_a_plain_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    languages, p = language_id.learned(docs, F.col("lang").isNotNull())
    rows = language_id.predict(docs, languages, p, keep=("doc_id", "text")).collect()
    assert max(len(r["text"]) for r in rows) > 2 * language_id.SEGMENT
    for r in sorted(rows, key=lambda r: len(r["text"]))[:40]:
        want = plain(p, r["text"].encode())
        assert languages[int(want.argmax())] == r["lang_pred"] and abs(want.max() - r["score"]) < 1e-4


def test_a_sample_is_the_same_size_at_any_count(spark, monkeypatch):
    """Many rows of a language, few of another, and a row that repeats."""
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 5)
    rows = [(i, f"text number {i}", "en") for i in range(500)] + [(1000 + i, "texte", "fr") for i in range(3)] + [(2000, "wort", "de")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = [lang for _, lang in language_id.sample(docs, F.lit(True), "doc_id", "text", "lang")]
    assert {lang: found.count(lang) // language_id.TRAIN_SLICES for lang in set(found)} == {"en": 5, "fr": 3, "de": 5}
