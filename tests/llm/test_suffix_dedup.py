import collections
import hashlib

import numpy as np
import pytest
from helpers import SF
from llm_helpers import rows_of

from grainline.llm import queries, suffix_dedup

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, length=100):
    seen, out = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            if seen.setdefault(data[at : at + length], (i, at)) != (i, at):
                gone[at : at + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(data) else 0
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0]))


def test_query(spark, duck):
    got = rows_of(queries.op2_suffix_dedup(spark, SF), *COLUMNS)
    assert got == brute(duck.sql("select doc_id, text from documents").fetchall())
    assert sum(r[2] for r in got) > 0


def test_awkward_rows(odd, none, without_id):
    assert rows_of(suffix_dedup.dedup(odd), *COLUMNS) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert suffix_dedup.dedup(none).count() == 0
    assert rows_of(suffix_dedup.dedup(without_id), *COLUMNS) == brute([(r["doc_id"], r["text"]) for r in without_id.collect()])


@pytest.mark.parametrize("often", [2, 10**6])
def test_hot_anchors_go_window_by_window(spark, monkeypatch, often):
    """Counted before the shuffle where partitions have them often, found in their shard otherwise."""
    monkeypatch.setattr(suffix_dedup, "MANY", 3)
    monkeypatch.setattr(suffix_dedup, "OFTEN", often)
    draw = np.random.default_rng(2)
    passage = "".join(draw.choice(list("abcdefgh "), 110))
    rows = [(i, "".join(draw.choice(list("abcdefgh "), 60)) + passage + "".join(draw.choice(list("abcdefgh "), 60))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = rows_of(suffix_dedup.dedup(df), *COLUMNS)
    assert got == brute(rows) and sum(r[2] >= 110 for r in got) == 29


@pytest.mark.parametrize("often", [2, 10**6])
def test_hot_windows_are_folded_before_they_meet(spark, monkeypatch, often):
    """A passage in many contexts brings one row per window and salt to the suffix sort, not one per document."""
    monkeypatch.setattr(suffix_dedup, "MANY", 3)
    monkeypatch.setattr(suffix_dedup, "OFTEN", often)
    sent, sort = [], suffix_dedup.sorted_out
    monkeypatch.setattr(suffix_dedup, "sorted_out", lambda segments, *rest: (sent.append(segments), sort(segments, *rest))[1])
    draw = np.random.default_rng(3)
    passage = "".join(draw.choice(list("abcdefgh "), 110))
    rows = [(i, "".join(draw.choice(list("abcdefgh "), 40)) + passage + "".join(draw.choice(list("abcdefgh "), 40))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = rows_of(suffix_dedup.dedup(df), *COLUMNS)
    assert got == brute(rows)
    windows = collections.Counter()
    for r in sent[0].collect():
        data, at = bytes(r["bytes"]), 0
        for size in np.frombuffer(r["sizes"], np.uint32).tolist():
            windows.update({data[k : k + 100] for k in range(at, at + size - 99)})
            at += size
    shared = [windows[passage[k : k + 100].encode()] for k in range(11)]
    blocks = suffix_dedup.prime(2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert max(windows.values()) <= suffix_dedup.salts_of(blocks) and any(shared)


def test_rows_without_an_id_have_places_of_their_own(spark):
    draw = np.random.default_rng(4)
    a, b, c, d = ("".join(draw.choice(list("abcdefgh "), 150)) for _ in range(4))
    rows = [(None, a + b), (1, b), (None, c), (None, c), (None, d + a), (2**63 - 6, d), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, *r[1:])
    for df in (df, df.repartition(4)):
        got = sorted((tuple(r[k] for k in COLUMNS) for r in suffix_dedup.dedup(df).collect()), key=key)
        numbered = [[(2**63 + k if i is None else i, t) for k, (i, t) in enumerate(x)] for x in (rows, rows[::-1])]  # these come in any order
        orders = [sorted(((None if i >= 2**63 else i, *r) for i, *r in brute(x)), key=key) for x in numbered]
        assert got in orders
        assert sum(r[2] for r in got) == 600
    with pytest.raises(ValueError):
        suffix_dedup.dedup(spark.createDataFrame([(2**63 - 1, a), (None, b)], "doc_id long, text string"))
    last = suffix_dedup.dedup(spark.createDataFrame([(2**63 - 1, a)], "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in last] == [2**63 - 1]


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    """Each loses what an earlier one has, and nothing else; repeated rows are one place."""
    draw = np.random.default_rng(7)
    a, b, c, d = ("".join(draw.choice(list("abcdefgh "), 150)) for _ in range(4))
    rows = [(5, a), (5, b + c), (5, d), (5, d), (7, c + "x" + a), (6, b), (-2, "short"), (None, d), (8, None)]
    got = {}
    for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
    assert {i: sorted(x) for i, x in got.items()} == {5: [(150, 0), (150, 0), (150, 0), (300, 0)], 7: [(301, 300)], 6: [(150, 150)], -2: [(5, 0)], None: [(150, 150)], 8: [(0, 0)]}


def test_segment_hashes_tell_strings_apart():
    """Strings of two letters on which sums over bytes modulo 2**64 agree, and equal strings at other places."""
    word = "ab"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((word + other + "x" + word).encode(), np.uint8)
    n, sums = len(word), suffix_dedup.segment_sums(data)
    h = suffix_dedup.segment_hash(sums, np.array([0, n, 2 * n + 1]), np.array([n, 2 * n, 3 * n + 1]))
    assert h[0] == h[2] != h[1]


def test_kept_text(spark):
    text = "0123456789" * 9 + "abcdefghij" * 3
    df = spark.createDataFrame([(1, text), (2, "x" + text + "y")], "doc_id long, text string")
    assert [bytes(r["kept"]) for r in suffix_dedup.dedup(df, with_text=True).orderBy("doc_id").collect()] == [text.encode(), b"xy"]


@pytest.mark.parametrize("symbols", [1, 2, 4, 256])
def test_suffix_array(symbols):
    draw = np.random.default_rng(symbols)
    for _ in range(25):
        text = draw.integers(0, symbols, draw.integers(0, 300)).astype(np.uint8)
        data = text.tobytes()
        assert suffix_dedup.suffix_array(text, 1000).tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        short = [data[i : i + 16] for i in suffix_dedup.suffix_array(text, 16)]
        assert short == sorted(short)


def test_common_prefix():
    draw = np.random.default_rng(0)
    text = draw.integers(0, 2, 500).astype(np.uint8)
    text[200:320] = text[:120]
    data, words = text.tobytes(), suffix_dedup.words_of(text, 116)
    a, b = draw.integers(0, 380, 200), draw.integers(0, 380, 200)
    a[:3], b[:3] = [0, 5, 30], [200, 205, 230]
    want = [next((k for k in range(100) if data[i + k] != data[j + k]), 100) for i, j in zip(a, b, strict=True)]
    assert suffix_dedup.common_prefix(words, a, b, 100).tolist() == want
