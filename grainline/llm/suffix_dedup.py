"""Suffix-array dedup: every byte covered by a ``LENGTH``-byte string that also starts earlier in the corpus.

Each string (a window) is anchored at the least fingerprint of the ``GRAM``-byte strings inside it, so equal windows have
equal anchors at equal distances, and the windows of a document fall into runs with one anchor, one every 35 bytes or so.

1. Runs, as fingerprints of anchor and segment (the bytes of all windows of the run), are dealt out by anchor. Segments
   that repeat whole leave only their earliest; an anchor that occurs once, or with one segment, needs no more.
2. The other segments, which differ near their anchor, are fetched from the texts and dealt out by anchor. Each task
   sorts their suffixes in two stages: those smaller than their successors directly, the rest induced by bucket scans.
   Adjacent common prefixes of LENGTH or more make classes of equal windows, of which all but the earliest go. An anchor
   with very many segments is dealt out window by window instead; equal windows are folded before they meet in a task.
3. Per document the windows that go become removed bytes.

Anchors have 64-bit fingerprints from sums over bytes, segments from sums over scrambled groups of eight bytes: two ways
that know nothing of each other, 128 bits together.

A null text is empty. Windows are compared by (doc_id, start). Rows without an id come last, each with a place of its own.
Rows that repeat an id and a text are one place. Texts that share an id are documents of their own, in the order of their
hashes. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainline.llm.common import chunks, mix, powers, prefix_hash, shuffle_partitions, stored, substring_hash, text_buffer

LENGTH, GRAM = 100, 32
#: Anchors with more segments than this are dealt out window by window. Those that a partition has OFTEN segments of are
#: counted before any shuffle, and up to HOT_ANCHORS of the most frequent never meet in one shard.
MANY, OFTEN, HOT_ANCHORS = 2_000, 32, 50_000
#: Bytes of text that are fingerprinted at once, of a document block, of packed runs of a shard, and of segments whose suffixes one task sorts, about.
CODE_BYTES, TEXT_BYTES, RUN_BYTES, SORT_BYTES = 1 << 20, 4 << 20, 4 << 20, 3 << 18
#: Runs that a task folds and sends at once.
FLUSH_RUNS = 400_000
LAST = int(np.iinfo(np.int64).max)


def runs(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of every run, as positions in data."""
    n = len(data) - gram + 1
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n)
    least = (substring_hash(sums, at, at + gram) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # fingerprint, then place: the leftmost of equals
    width, have = length - gram + 1, 1
    while have < width:  # the least of have places becomes the least of twice as many
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    window = np.flatnonzero(np.arange(len(least)) + length <= ends)
    anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    return window[new], window[np.concatenate([new[1:], [len(window)]]) - 1] if len(new) else new, anchor[new]


def segment_sums(data: np.ndarray) -> np.ndarray:
    """Running sums over the scrambled eight bytes at every place; segment_hash turns two of them into a fingerprint."""
    n = max(0, len(data) - 7)
    out = np.zeros(n + 1, np.uint64)
    if n:
        eight = np.ndarray((n,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,))
        np.cumsum(mix(eight + np.uint64(0xA0761D6478BD642F)) * powers(n)[0], out=out[1:])
    return out


def segment_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the bytes [start, end), eight at least."""
    _, down = powers(len(sums))
    return mix((sums[end - 7] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _join(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


_RUN = {"anchor": np.uint64, "segment": np.uint64, "doc": np.int64, "lo": np.uint32, "many": np.uint8, "ahead": np.uint8}
_OFTEN = {"o_anchor": np.int64, "o_n": np.int64}
_GONE = {"g_doc": np.int64, "g_lo": np.uint32, "g_many": np.uint32}
_SEGMENT = {"bytes": bytes, "sizes": np.uint32, "s_doc": np.int64, "s_lo": np.uint32}
_ASK = {"a_doc": np.int64, "a_lo": np.uint32, "a_many": np.uint8, "a_anchor": np.uint64}


def _schema(kinds: dict) -> str:
    return ", ".join(f"{k} binary" for k in kinds)


def _earliest(*order: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted order, whether each is the first of its group); order: most significant first, the first ``by`` name the group."""
    at = np.lexsort(order[::-1])
    first = np.ones(len(at), bool)
    first[1:] = np.any([o[at][1:] != o[at][:-1] for o in order[:by]], axis=0)
    return at, first


def _others(at: np.ndarray, first: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Those of each group that are elsewhere than its first."""
    head = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
    return at[~first & ((doc[at] != doc[head]) | (lo[at] != lo[head]))]


def dealt(docs: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """Packed runs by shard of the anchor; of equal segments in a partition only the earliest, the others are gone."""

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        anchor, segment, doc, lo, many, ahead = (np.concatenate(x) for x in zip(*parts, strict=True))
        at, first = _earliest(anchor, segment, doc, lo, by=2)
        gone, at = _others(at, first, doc, lo), at[first]
        shard = ((anchor[at] >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        at, edges = at[order], np.searchsorted(shard[order], np.arange(shards + 1))
        full = np.flatnonzero(np.diff(edges))  # never more rows than runs
        deal = np.array_split(gone, max(1, len(full)))
        columns = [pa.array(full.astype(np.int32))]
        for x, kind in zip((anchor, segment, doc, lo, many, ahead), _RUN.values(), strict=True):
            x = x.astype(kind)[at]
            columns.append(pa.array([x[edges[k] : edges[k + 1]].tobytes() for k in full], pa.binary()))
        for x, kind in zip((doc, lo, many), _GONE.values(), strict=True):
            columns.append(pa.array([x[g].astype(kind).tobytes() for g in deal[: len(full)]], pa.binary()))
        names, n = np.unique(anchor[at], return_counts=True)
        for x in (names.view(np.int64), n):
            columns.append(pa.array(([x[n >= OFTEN].tobytes()] + [b""] * len(full))[: len(full)], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=["shard", *_RUN, *_GONE, *_OFTEN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, _, data, offsets in chunks(*text_buffer(batch.column(1)), limit=CODE_BYTES):
                sums = prefix_hash(data)
                lo, hi, anchor = runs(data, offsets, sums, length, gram)
                doc = np.searchsorted(offsets, lo, side="right") - 1
                parts.append((substring_hash(sums, anchor, anchor + gram), segment_hash(segment_sums(data), lo, hi + length), ids[i + doc], (lo - offsets[doc]).astype(np.uint32), (hi - lo + 1).astype(np.uint8), (anchor - lo).astype(np.uint8)))
                size += len(lo)
                if size > FLUSH_RUNS:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    return docs.mapInArrow(run, f"shard int, {_schema(_RUN)}, {_schema(_GONE)}, {_schema(_OFTEN)}")


def hot_anchors(rows: DataFrame) -> np.ndarray:
    """The anchors with more than MANY segments, HOT_ANCHORS at most, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_join(batch.column(i).to_pylist(), kind)) for i, kind in enumerate(_OFTEN.values())], names=["anchor", "n"])

    counts = rows.where(F.length("o_n") > 0).select(*_OFTEN).mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > MANY).orderBy(F.desc("n"), "anchor").limit(HOT_ANCHORS).collect()  # a bounded list
    return np.sort(np.array([r["anchor"] for r in found], np.int64).view(np.uint64))


def _is_hot(anchor: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor


def without(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """Packed runs without those of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            for k in range(len(_RUN)):
                columns[k + 1] = []
            for i in range(batch.num_rows):
                arrays = [_join([batch.column(k)[i].as_py()], kind) for k, kind in _RUN.items()]
                cold = ~_is_hot(arrays[0], hot)
                for k, x in enumerate(arrays):
                    columns[k + 1].append(x[cold].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) if isinstance(c, list) else c for c in columns], names=batch.schema.names)

    return rows.select("shard", *_RUN, *_GONE).mapInArrow(run, f"shard int, {_schema(_RUN)}, {_schema(_GONE)}")


def hot_asks(rows: DataFrame, hot: np.ndarray, blocks: int, length: int) -> DataFrame:
    """Per document block, the segments of hot anchors, which are compared window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, _, doc, lo, many, _ = (_join(batch.column(k).to_pylist(), kind) for k, kind in _RUN.items())
            at = np.flatnonzero(_is_hot(anchor, hot))
            if len(at):
                made = _asks(doc[at], lo[at], many[at], anchor[at], True, blocks, length)
                yield pa.RecordBatch.from_pandas(made, preserve_index=False)

    return rows.select(*_RUN).mapInArrow(run, f"block long, {_schema(_ASK)}, a_bytes long, a_hot boolean")


def _by_block(doc: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by document block and where each block begins; the block is that of block_of()."""
    block = doc % blocks
    order = np.argsort(block, kind="stable")
    return order, np.searchsorted(block[order], np.arange(blocks + 1))


def _packed(arrays: list[np.ndarray], kinds: dict, blocks: int, weight: np.ndarray | None = None) -> pd.DataFrame:
    """One row per document block that the arrays have documents of; the first array holds their ids. weight: summed as a_bytes."""
    order, edges = _by_block(arrays[0], blocks)
    full = np.flatnonzero(np.diff(edges))
    out = {"block": full}
    for x, (name, kind) in zip(arrays, kinds.items(), strict=True):
        x = x[order].astype(kind)
        out[name] = [x[edges[b] : edges[b + 1]].tobytes() for b in full]
    if weight is not None:
        out["a_bytes"] = np.add.reduceat(weight[order], edges[full]) if len(full) else full
    return pd.DataFrame(out)


def _asks(doc: np.ndarray, lo: np.ndarray, many: np.ndarray, anchor: np.ndarray, hot: bool, blocks: int, length: int) -> pd.DataFrame:
    """Asks for windows by document block, with the bytes that they bring: window by window where hot, or as one segment."""
    n = many.astype(np.int64)
    return _packed([doc, lo, many, anchor], _ASK, blocks, n * length if hot else n + length - 1).assign(a_hot=hot)


def met(rows: DataFrame, blocks: int, length: int) -> DataFrame:
    """Per document block: windows that go (g_) and segments that must be compared (a_)."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        anchor, segment, doc, lo, many, _ = (_join(rows[k], kind) for k, kind in _RUN.items())
        gone = [_join(rows[k], kind) for k, kind in _GONE.items()]
        at, first = _earliest(anchor, segment, doc, lo, by=2)
        again, kept = _others(at, first, doc, lo), at[first]
        _, which, kinds = np.unique(anchor[kept], return_inverse=True, return_counts=True)
        ask, hot = kept[kinds[which] > 1], (kinds[which] > MANY)[kinds[which] > 1]
        out = [_packed([np.concatenate([g, x[again]]) for g, x in zip(gone, (doc, lo, many), strict=True)], _GONE, blocks)]
        out += [_asks(doc[at], lo[at], many[at], anchor[at], is_hot, blocks, length) for is_hot, at in ((False, ask[~hot]), (True, ask[hot]))]
        out = pd.concat(out)
        return out.astype(object).where(out.notna(), None)

    return rows.groupBy("shard").applyInPandas(meet, f"block long, {_schema(_GONE)}, {_schema(_ASK)}, a_bytes long, a_hot boolean")


def _spans(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first window, how many) of runs of windows."""
    by = np.lexsort((at, doc))
    doc, at = doc[by], at[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    return doc[first], at[first], at[last] - at[first] + 1


def _places(places: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    both = np.array(places, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _texts(texts: pd.DataFrame) -> dict[int, bytes]:
    return {int(i): t.encode() for i, t in zip(texts["id"], texts["text"], strict=True)}


def fetched(texts: DataFrame, asks: DataFrame, shards: int, length: int) -> DataFrame:
    """Segments asked for, by shard of their anchor."""

    def fetch(texts: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(asks):
            return pd.DataFrame({name: [] for name in ("shard", *_SEGMENT, *_GONE)})
        text = _texts(texts)
        doc, lo, many, anchor = (_join(asks[k], kind) for k, kind in _ASK.items())
        found: dict[int, list] = {}
        for d, at, n, a in zip(doc.tolist(), lo.tolist(), many.tolist(), anchor.tolist(), strict=True):
            part = text[d][at : at + n - 1 + length]
            if len(part) == n - 1 + length:
                found.setdefault((a >> 20) % shards, []).append((part, d, at))
        return _segments("shard", found, (np.zeros(0, np.int64),) * 3, 0)

    return texts.groupBy("block").cogroup(asks.groupBy("block")).applyInPandas(fetch, f"shard long, {_schema(_SEGMENT)}, {_schema(_GONE)}")


def _segments(key: str, found: dict[int, list], gone: tuple[np.ndarray, ...], turn: int) -> pd.DataFrame:
    """One row per key of found, with its (bytes, doc, start) packed. What is gone goes with one of the rows, by turns."""
    out = [
        {key: k, "bytes": b"".join(p[0] for p in x), "sizes": np.array([len(p[0]) for p in x], np.uint32).tobytes(), "s_doc": np.array([p[1] for p in x], np.int64).tobytes(), "s_lo": np.array([p[2] for p in x], np.uint32).tobytes()} | dict.fromkeys(_GONE, b"")
        for k, x in sorted(found.items())
    ]
    if out:
        out[turn % len(out)] |= {name: x.astype(kind).tobytes() for x, (name, kind) in zip(gone, _GONE.items(), strict=True)}
    return pd.DataFrame(out, columns=[key, *_SEGMENT, *_GONE])


def earliest(windows: Iterator[tuple[bytes, tuple[int, int]]]) -> tuple[dict[bytes, tuple[int, int]], list[tuple[int, int]]]:
    """The earliest (doc, start) of each window, and the other places of equal windows."""
    first: dict[bytes, tuple[int, int]] = {}
    gone = []
    for window, place in windows:
        had = first.setdefault(window, place)
        if place < had:
            first[window] = place
            gone.append(had)
        elif place != had:
            gone.append(place)
    return first, gone


def _number(window: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little")


def hot_windows(texts: DataFrame, asks: DataFrame, blocks: int, shards: int, folds: int, length: int) -> DataFrame:
    """The windows of hot anchors, by shard of their content, one row of each content per salt at most.

    Equal windows are folded twice: in their document block, then among the blocks of one salt, about as many as there
    are salts. So a window brings as many rows to a fold or a shard as the square root of the number of blocks.
    """
    salts = salts_of(blocks)

    def fetch(texts: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(asks):
            return pd.DataFrame({name: [] for name in ("fold", *_SEGMENT, *_GONE)})
        text, block = _texts(texts), int(asks["block"].iloc[0])
        doc, lo, many = (_join(asks[k], _ASK[k]).tolist() for k in ("a_doc", "a_lo", "a_many"))
        first, gone = earliest((text[d][k : k + length], (d, k)) for d, at, n in zip(doc, lo, many, strict=True) for k in range(at, min(at + n, len(text[d]) - length + 1)))
        found: dict[int, list] = {}
        for window, place in first.items():
            found.setdefault(_number(window) % folds * salts + block % salts, []).append((window, *place))
        return _segments("fold", found, _spans(*_places(gone)), block // salts)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        data, doc, lo = (b"".join(rows["bytes"]), *(_join(rows[k], kind).tolist() for k, kind in (("s_doc", np.int64), ("s_lo", np.uint32))))
        first, gone = earliest((data[i * length : (i + 1) * length], place) for i, place in enumerate(zip(doc, lo, strict=True)))
        found: dict[int, list] = {}
        for window, place in first.items():
            found.setdefault((_number(window) >> 20) % shards, []).append((window, *place))
        before = [_join(rows[k], kind).astype(np.int64) for k, kind in _GONE.items()]
        return _segments("shard", found, tuple(np.concatenate(x) for x in zip(before, _spans(*_places(gone)), strict=True)), int(rows["fold"].iloc[0]) // salts)

    kinds = f"{_schema(_SEGMENT)}, {_schema(_GONE)}"
    folded = texts.groupBy("block").cogroup(asks.groupBy("block")).applyInPandas(fetch, f"fold long, {kinds}")
    return folded.groupBy("fold").applyInPandas(fold, f"shard long, {kinds}")


def salts_of(blocks: int) -> int:
    return math.isqrt(blocks) + 1


def words_of(text: np.ndarray, spare: int) -> np.ndarray:
    """At every position, and spare positions of zeros after the end, the next 8 bytes as one big-endian number."""
    padded = np.concatenate([text, np.zeros(spare + 8, np.uint8)])
    out = np.zeros(len(text) + spare, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes by their first depth bytes or more, in two stages."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    # stage 1: the suffixes that are smaller than their successors, directly, eight bytes at a time
    up = np.sign(np.diff(text.astype(np.int16)))
    last = np.where(up != 0, np.arange(n - 1), n - 1)
    decides = np.minimum.accumulate(last[::-1])[::-1]  # equal bytes go as the run that they lead
    smaller = np.append(np.append(up, -1)[decides] > 0, False)
    words = words_of(text, depth + 16)
    order = np.flatnonzero(smaller)
    group = np.zeros(len(order), np.int64)
    open_ = np.arange(len(order))  # places of those that are not alone in their group
    for at in range(0, depth, 8):
        own = order[open_]
        key = words[own + at]
        by = np.lexsort((key, group[open_]))
        order[open_] = own[by]
        g, key = group[open_], key[by]
        new = np.ones(len(by), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else open_
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
        if not len(open_):
            break
    # stage 2: bucket by bucket, a suffix larger than its successor goes behind those that its successor's order puts first
    starts = np.searchsorted(text[order], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[int(text[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        front, wave = [], np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(wave):
            front.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & ~smaller[before]]
        bucket = np.concatenate([*front, order[starts[c] : starts[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & ~smaller[before]]
        by = np.argsort(text[before], kind="stable")
        before = before[by]
        for part in np.split(before, np.flatnonzero(np.diff(text[before])) + 1) if len(before) else ():
            induced[int(text[part[0]])].append(part)
    return np.concatenate(out)


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """The common prefix in bytes of the suffixes at a and b, limit at most."""
    out, open_ = np.full(len(a), limit), np.arange(len(a))
    for at in range(0, limit, 8):
        differ = words[a[open_] + at] ^ words[b[open_] + at]
        other = differ != 0
        equal, rest = np.zeros(int(other.sum()), np.int64), differ[other]
        for k in range(1, 8):
            equal += rest < np.uint64(1 << (8 * k))
        out[open_[other]] = np.minimum(limit, at + equal)
        open_ = open_[~other]
    return out


def repeated(text: np.ndarray, sizes: np.ndarray, doc: np.ndarray, lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows that also start earlier; text: segments end to end."""
    begin = np.cumsum(sizes) - sizes
    part = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(text)) - begin[part]
    order = suffix_array(text, length)
    order = order[inside[order] + length <= sizes[part[order]]]  # suffixes that are windows of their segment
    if len(order) < 2:
        return doc[:0], lo[:0].astype(np.int64)
    words = words_of(text, length + 16)
    same = common_prefix(words, order[:-1], order[1:], length) >= length
    group = np.concatenate([[0], np.cumsum(~same)])
    of, at = doc[part[order]], lo[part[order]].astype(np.int64) + inside[order]
    by, first = _earliest(group, of, at, by=1)
    gone = _others(by, first, of, at)
    return of[gone], at[gone]


def sorted_out(segments: DataFrame, blocks: int, length: int) -> DataFrame:
    """Per document block the windows that go: those known before, and those from the suffix arrays of the segments."""

    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        doc, at = repeated(_join(rows["bytes"], np.uint8), _join(rows["sizes"], np.uint32).astype(np.int64), _join(rows["s_doc"], np.int64), _join(rows["s_lo"], np.uint32), length)
        before = [_join(rows[k], kind) for k, kind in _GONE.items()]
        return _packed([np.concatenate(x) for x in zip(before, _spans(doc, at), strict=True)], _GONE, blocks)

    return segments.groupBy("shard").applyInPandas(sort, f"block long, {_schema(_GONE)}")


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with the ranks of (id, hash of the text) as ids, for tables in which texts share ids; and (rank, id).

    Ranks are counts: rows are ordered in ranges, and each range begins where those before it end.
    """
    keys = docs.where("id is not null").select("id", F.xxhash64("text").alias("h")).distinct()
    keys = stored(keys.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "h", F.monotonically_increasing_id().alias("at")), "ranks")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit(2**33 - 1))
    counts = keys.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row per range
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ranks = stored(keys.join(F.broadcast(before), part == F.col("part")).select("id", "h", (F.col("before") + inside).alias("rank")), "ranked")
    named = docs.where("id is not null").withColumn("h", F.xxhash64("text")).join(ranks, ["id", "h"]).select(F.col("rank").alias("id"), "text")
    return named.unionByName(docs.where("id is null")), ranks.select(F.col("rank"), F.col("id").alias("own"))


def prime(n: int) -> int:
    """The least prime number from n on: blocks of ids in equal steps stay even."""
    return next(k for k in range(max(n, 2), 2 * n + 3) if all(k % d for d in range(2, math.isqrt(k) + 1)))


def placed(docs: DataFrame, largest: int | None) -> tuple[DataFrame, int]:
    """docs with the last of all numbers as ids of the rows without one, and how many these are.

    Rows without an id are stored with their numbers, so that every later reading finds the same ones.
    """
    rest = stored(docs.where("id is null").select(F.monotonically_increasing_id().alias("at"), "text"), "without_id")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit(2**33 - 1))
    counts = {r["part"]: r["n"] for r in rest.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    many = sum(counts.values())
    if largest is not None and largest > LAST - many:
        raise ValueError("the largest id leaves no numbers for the rows without an id")
    parts = sorted(counts)
    before = np.cumsum([0, *(counts[p] for p in parts)]).tolist()
    begins = F.create_map(*[F.lit(x) for p, b in zip(parts, before, strict=False) for x in (int(p), LAST - many + 1 + b)])
    return docs.where("id is not null").unionByName(rest.select((begins[part.cast("long")] + inside).alias("id"), "text")), many


def cleaned(texts: DataFrame, gone: DataFrame, length: int, with_text: bool, without_id: int) -> DataFrame:
    """Per document what is removed and what is kept."""

    def clean(texts: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        doc, lo, many = (_join(gone[k], kind).astype(np.int64) for k, kind in _GONE.items())
        by = np.argsort(doc, kind="stable")
        doc, lo, many = doc[by], lo[by], many[by]
        ids = texts["id"].to_numpy(np.int64)
        starts, ends = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
        out = []
        for i, text, a, b in zip(ids.tolist(), texts["text"], starts.tolist(), ends.tolist(), strict=True):
            data, removed, spans = text.encode(), 0, 0
            kept = data
            if a < b:
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, np.minimum(lo[a:b], len(data)), 1)
                np.add.at(edge, np.minimum(lo[a:b] + many[a:b] - 1 + length, len(data)), -1)
                gone_ = np.cumsum(edge[:-1]) > 0
                removed, spans = int(gone_.sum()), int((gone_ & ~np.concatenate([[False], gone_[:-1]])).sum())
                kept = np.frombuffer(data, np.uint8)[~gone_].tobytes()
            row = {"doc_id": None if i > LAST - without_id else i, "n_bytes": len(data), "n_removed": removed, "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}
            out.append(row | ({"kept": kept} if with_text else {}))
        out = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)
        return out.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts.groupBy("block").cogroup(gone.groupBy("block")).applyInPandas(clean, schema)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for."""
    if not 8 <= gram <= length or length - gram > 254:
        raise ValueError("gram is 8 bytes or more, and length at most 254 bytes longer")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size, largest, without_id = docs.agg(F.sum(F.octet_length("text")), F.max("id"), F.count_if(F.col("id").isNull())).first()
    size, own = int(size or 0), None
    text_hash = F.xxhash64("text")
    if not docs.where("id is not null").groupBy("id").agg(F.min(text_hash).alias("a"), F.max(text_hash).alias("b")).where("a <> b").isEmpty():
        docs, own = numbered(docs)
        largest = own.agg(F.max("rank")).first()[0]
    if without_id:
        docs, without_id = placed(docs, largest)
    partitions = shuffle_partitions(spark)
    blocks = prime(max(2 * partitions, size // TEXT_BYTES))
    shards = max(2 * partitions, size // RUN_BYTES)  # packed runs take about as many bytes as the text
    packed = stored(dealt(docs, shards, length, gram), "runs")
    hot = hot_anchors(packed)
    found = stored(met(without(packed, hot) if len(hot) else packed, blocks, length), "met")
    texts = docs.withColumn("block", F.pmod(F.col("id"), F.lit(blocks)))
    asks = found.where("a_doc is not null").select("block", *_ASK, "a_bytes", "a_hot")
    if len(hot):
        asks = asks.unionByName(hot_asks(packed, hot, blocks, length))
    sums = asks.agg(F.sum("a_bytes"), F.sum(F.when(F.col("a_hot"), F.col("a_bytes")))).first()
    asked, asked_hot = (int(x or 0) for x in sums)
    gone = found.where("g_doc is not null").select("block", *_GONE)
    sort_shards = max(2 * partitions, asked // SORT_BYTES)
    segments = fetched(texts, asks.where("not a_hot"), sort_shards, length)
    if asked_hot:
        folds = max(1, max(2 * partitions, asked_hot // SORT_BYTES) // salts_of(blocks))
        segments = segments.unionByName(hot_windows(texts, asks.where("a_hot"), blocks, sort_shards, folds, length))
    more = sorted_out(segments, blocks, length)
    out = cleaned(texts, gone.unionByName(more), length, with_text, without_id)
    return out if own is None else out.join(own, out["doc_id"] == own["rank"], "left").withColumn("doc_id", F.col("own")).drop("rank", "own")
