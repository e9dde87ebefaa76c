import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from helpers import SF
from tokenizers import Tokenizer

from grainline.llm import packing
from grainline.llm.common import text_buffer
from grainline.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def pieces(text, capacity=2048):
    ids = np.array(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
    return [(p, at // 4, len(part) // 4, zlib.crc32(part)) for p, at in enumerate(range(0, len(ids), 4 * capacity)) if (part := ids[at : at + 4 * capacity])]


def check_layout(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [2048, 100])
def test_awkward_rows(odd, none, capacity):
    rows = packing.pack_documents(odd, PATH, capacity).collect()
    want = sorted((r["doc_id"], *p) for r in odd.collect() for p in pieces(r["text"], capacity))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert check_layout(rows, capacity) >= -(-sum(r["length"] for r in rows) // capacity)
    assert packing.pack_documents(none, PATH).count() == 0


def test_coder_equals_tokenizer():
    draw, whole, coder = random.Random(3), Tokenizer.from_file(PATH), packing.Coder(PATH)
    alphabet = "abcXYZ'sdlmrtve 0129.,!?\n\t\réßÿŉİ\xa0\xad́ \x0b\x1c漢<|>_"
    texts = ["".join(draw.choices(alphabet, k=draw.randrange(40))) for _ in range(800)] + ["a<|endoftext|>b", "I'll we've IT'S '' 'S", "x" * 3000]
    ids, ends = coder(*text_buffer(pa.array(texts)))
    assert coder.known
    for text, a, b in zip(texts, ends, ends[1:], strict=False):
        assert ids[a:b].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0], text


def test_any_other_tokenizer_is_asked_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, coder, texts = Tokenizer.from_file(path), packing.Coder(path), ["It's a TEST of 12 things", "", "zwölf\n\nBoxkämpfer"]
    ids, ends = coder(*text_buffer(pa.array(texts)))
    assert not coder.known
    for text, a, b in zip(texts, ends, ends[1:], strict=False):
        assert ids[a:b].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0]


def test_memory_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY_WORDS", 3)
    whole, coder = Tokenizer.from_file(PATH), packing.Coder(PATH)
    for text in ("one two three four", "five one six", "seven eight nine ten one", "two"):
        ids, _ = coder(*text_buffer(pa.array([text])))
        assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0]
    assert len(coder.young) + len(coder.old) <= 8


@pytest.mark.parametrize("limits", [{}, {"max_documents": 2}, {"max_attention": 6_000.0, "rule": "dot"}])
def test_pack_meets_limits_that_bind(spark, limits):
    draw = random.Random(9)
    sizes = [draw.randrange(1, 70) for _ in range(700)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long"), 100, **limits).collect()
    assert sorted(r["length"] for r in rows) == sorted(sizes)
    least = check_layout(rows, 100)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append(r["length"])
    assert all(len(x) <= limits.get("max_documents", 100) and sum(n * n for n in x) <= limits.get("max_attention", 1e9) for x in bins.values())
    assert least >= max(len(sizes) / limits.get("max_documents", 100), sum(n * n for n in sizes) / limits.get("max_attention", 1e9))
    if limits:
        assert any(len(x) == limits.get("max_documents") for x in bins.values()) or any(sum(n * n for n in x) > 5_000 for x in bins.values())


def test_query(spark):
    """Every piece of the whole table as the tokenizer gives it, in as many sequences as first fit needs or fewer."""
    rows = QUERIES["op7_best_fit_packing"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((r["doc_id"], *p) for r in docs for p in pieces(r["text"]))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    left = []
    for size in sorted((w[3] for w in want), reverse=True):
        at = next((i for i, x in enumerate(left) if x >= size), None)
        if at is None:
            left.append(2048 - size)
        else:
            left[at] -= size
    assert check_layout(rows, 2048) <= len(left)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"max_documents": 3}, {"max_attention": 40_000.0}])
def test_plan_keeps_every_limit(rule, limits):
    draw = random.Random(5)
    histogram = [(n, draw.randrange(1, 40)) for n in draw.sample(range(1, 200), 60)]
    bins = {}
    placed = {}
    for length, a, b, first, offset in packing.plan(histogram, 256, rule=rule, **limits):
        assert placed.get(length, 0) == a
        placed[length] = b
        for k in range(b - a):
            bins.setdefault(first + k, []).append((offset, length))
    assert placed == dict(histogram)
    for own in bins.values():
        assert sum(n for _, n in own) <= 256 and len(own) <= limits.get("max_documents", 256) and sum(n * n for _, n in own) <= limits.get("max_attention", 1e9)
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
    if not limits:
        assert len(bins) <= 1.15 * sum(n * c for n, c in histogram) / 256 + 1


def test_a_piece_that_fits_nowhere():
    with pytest.raises(ValueError):
        packing.plan([(300, 1)], 256)
