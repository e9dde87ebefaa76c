import collections

import public_tokenizers
import pytest
from helpers import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grainline.llm import queries
from grainline.llm.token_rollup import TokenRollup, counted, signed

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_query(spark, duck):
    """Every document counted by the tokenizer that counts it last."""
    whole = {name: Tokenizer.from_file(public_tokenizers.path(f"{name}.json")) for name in ("word_bpe_49k", "byte_bpe_50k")}
    want = collections.defaultdict(lambda: [0, 0])
    for i, text, source, lang in duck.sql("select doc_id, text, source, lang from documents").fetchall():
        if i % 17:
            version = "word_bpe_49k" if i % 10 else "byte_bpe_50k"
            own = want[source, lang, version]
            own[0] += 1
            own[1] += len(whole[version].encode(text or "", add_special_tokens=False).ids)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in queries.op3_token_rollup(spark, SF).collect()} == {k: tuple(v) for k, v in want.items()}


def with_counts(odd):
    return counted(odd, {"words-1": (WORDS, F.lit(True)), "half": (WORDS, F.col("doc_id") % 2 == 0)}).withColumnRenamed("words-1", "t")


def test_counts(odd):
    whole = Tokenizer.from_file(WORDS)
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in with_counts(odd).collect():
        n = len(whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["t"], r["half"]) == (n, n if r["doc_id"] % 2 == 0 else None)


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def test_deltas(spark, odd, tmp_path):
    docs = with_counts(odd)
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    assert totals(rollup) == {}
    assert rollup.commit("a", signed(docs, "words-1", 1, "t"))
    first = totals(rollup)
    assert sum(n for n, _ in first.values()) == docs.count() and (None, None, "words-1") in first
    assert not rollup.commit("a", signed(docs, "words-1", 1, "t")) and totals(rollup) == first
    rollup.commit("b", signed(docs.where("source = 'a'"), "words-1", -1, "t"))
    assert not any(k[0] == "a" for k in totals(rollup))
    rollup.commit("c", signed(docs.limit(0), "words-1", 1, "t"))
    assert totals(rollup) == {k: v for k, v in first.items() if k[0] != "a"}
    small = rollup.compact("d")
    assert totals(TokenRollup(spark, f"{tmp_path}/r-d")) == totals(small) == totals(rollup)
    for batch in "abcd":  # the batches that it stands for count once
        assert not small.commit(batch, signed(docs, "words-1", 1, "t"))
    assert totals(small) == totals(rollup)
    assert small.commit("e", signed(docs.where("source = 'a'"), "words-1", 1, "t")) and totals(small) == first
    assert totals(small.compact("f")) == first
    with pytest.raises(ValueError):
        small.compact("a")


def test_a_batch_without_its_marker_is_written_again(spark, odd, tmp_path):
    docs = with_counts(odd)
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    spark.createDataFrame([("x", "y", "words-1", 5, 5)], "source string, lang string, tokenizer_version string, docs long, tokens long").write.parquet(f"{tmp_path}/r/deltas/batch=a")
    assert totals(rollup) == {}
    rollup.commit("a", signed(docs, "words-1", 1, "t"))
    assert ("x", "y", "words-1") not in totals(rollup)
    with pytest.raises(ValueError):
        rollup.commit("../a", docs)
