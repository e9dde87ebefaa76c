import numpy as np
import pyarrow as pa
from llm_conftest import WORD, awkward

from grainline.llm import common


def buffers(texts):
    return common.text_buffer(pa.array(texts, pa.string()))


def test_words():
    texts = [t for _, t, *_ in awkward()]
    data, offsets = buffers(texts)
    starts, ends, before = common.word_bounds(data, offsets)
    for i, t in enumerate(texts):
        got = [data[a:b].tobytes().decode() for a, b in zip(starts[before[i] : before[i + 1]], ends[before[i] : before[i + 1]], strict=True)]
        assert got == WORD.findall(t or "")


def test_word_hashes_fold_case_and_do_not_depend_on_place():
    data, offsets = buffers(["one TWO", "xx two  one", "", "two"])
    h, before = common.word_hashes(data, offsets)
    assert before.tolist() == [0, 2, 5, 5, 6]
    assert h[0] == h[4] and h[1] == h[3] == h[5] and len(np.unique(h)) == 3


def test_chunks_hold_every_row_once():
    data, offsets = buffers(["a" * n for n in (3, 0, 10, 1, 1, 1, 0)])
    parts = list(common.chunks(data, offsets, 4))
    assert [(i, j) for i, j, *_ in parts] == [(0, 2), (2, 3), (3, 7)]
    assert all(o[0] == 0 and o[-1] == len(d) for _, _, d, o in parts)


def test_slices_of_arrays():
    data, offsets = common.text_buffer(pa.array(["abc", None, "de", "f"]).slice(1, 2))
    assert data.tobytes() == b"de" and offsets.tolist() == [0, 0, 2]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 40)] + [(3, 3), (50, 60), (60, 70), (70, 50), (60, 50)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 40)} | {50: 50, 60: 50, 70: 50}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
