"""Best-fit packing of documents into sequences under several capacities at once.

Pieces of equal length are interchangeable, so the plan needs the histogram of piece lengths only: at most ``capacity``
rows, whatever the corpus. The driver packs that histogram, length class by length class, longest first; a class goes to
the group of equal bins that the rule likes best among those that meet every constraint. Spark then ranks the pieces
within their length, in buckets of bounded size with prefix-summed counts, and joins ranks to the plan.

Ids come from distinct pre-tokens, told apart by 64-bit hashes within a chunk of text and by their bytes beyond it.

A null text is empty and gives one piece with the separator alone; repeated rows are packed one by one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainline.llm.common import chunks, prefix_hash, stored, substring_hash, text_buffer

CAPACITY, SEPARATOR = 2048, 0
#: Pre-tokens of one generation of a Python worker's memory, of which two are kept, and bytes of text coded at once.
MEMORY_WORDS, CHUNK = 80_000, 1 << 20
#: The normaliser and pre-tokens that Coder finds by itself.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_FAR = 0x180


def _kinds() -> np.ndarray:
    """The kind of every code point to U+017F, and _OTHER for _FAR and for those that normalising changes beyond case."""
    out = np.full(_FAR + 1, _OTHER, np.uint8)
    for point in (0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x130), *range(0x131, _FAR)):
        letter = chr(point)
        out[point] = _SPACE if letter.isspace() else {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(letter)[0], _SIGN)
    return out


_KIND = _kinds()
#: Pieces of one length that one ranking bucket holds, about.
BUCKET_PIECES = 50_000
_coders: dict[str, Coder] = {}


class Coder:
    """A tokenizer file's ids, exactly, with the model asked once for each distinct pre-token where that is safe.

    That is where the file has the normaliser and the pre-tokens of ``KNOWN`` and a text is in Latin letters and simple
    white space: normalising is lower-casing then, and bytes tell where pre-tokens begin. Any other text, and any text
    that may hold an added token, goes through the tokenizer whole; so does every text of any other file.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        form = json.loads(self.whole.to_str())
        self.added = [t["content"].encode() for t in form.get("added_tokens", [])]
        self.known = {"normalizer": form["normalizer"], "pre_tokenizer": form["pre_tokenizer"]} == KNOWN and form["model"]["type"] == "BPE"
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level models write as themselves
        other = iter(range(256, 512))
        self.letter = [chr(b) if b in plain else chr(next(other)) for b in range(256)]
        self.model, self.young, self.old = self.whole.model, {}, {}

    def _new(self, token: bytes) -> bytes:
        text = token.decode() if token.isascii() else "".join([self.letter[b] for b in token])
        return array("I", [x.id for x in self.model.tokenize(text)]).tobytes()

    def _ids(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of distinct pre-tokens. Those not asked for while MEMORY_WORDS others were are forgotten."""
        young, old, out = self.young, self.old, []
        for token in tokens:
            found = young.get(token)
            if found is None:
                found = young[token] = old.get(token) or self._new(token)
            out.append(found)
        if len(young) > MEMORY_WORDS:
            self.young, self.old = {}, young
        return out

    def forget(self) -> None:
        """Between tasks a worker remembers no words."""
        self.young, self.old = {}, {}

    def _alone(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts go through the tokenizer whole."""
        if not self.known:
            return np.ones(len(offsets) - 1, bool)
        point, _ = _points(data)
        bad = [np.flatnonzero(_KIND[point] == _OTHER)]
        raw = data.tobytes()
        for token in self.added:
            bad.append(np.array([m.start() for m in re.finditer(re.escape(token[:2]), raw)], np.int64))
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, np.concatenate(bad), side="right") - 1] = True
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each text's followed by SEPARATOR, and n + 1 offsets into them."""
        n, alone = len(offsets) - 1, self._alone(data, offsets)
        doc, ids = self._by_words(data, offsets, alone)
        if alone.any():
            at = np.flatnonzero(alone)
            found = [self.whole.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids for i in at]
            doc = np.concatenate([doc, np.repeat(at, [len(x) for x in found])])
            ids = np.concatenate([ids, *(np.array(x, "<u4") for x in found)])
            order = np.argsort(doc, kind="stable")
            doc, ids = doc[order], ids[order]
        ends = np.cumsum(np.bincount(doc, minlength=n))
        return np.insert(ids, ends, SEPARATOR), np.concatenate([[0], ends + np.arange(1, n + 1)])

    def _by_words(self, data: np.ndarray, offsets: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, id) of the texts that don't go alone, in order."""
        spaced = np.insert(data, offsets[1:-1], 0x20)  # pre-tokens end with their text
        begin = offsets[:-1] + np.arange(len(offsets) - 1)
        size = np.diff(offsets)
        for i in np.flatnonzero(alone):
            spaced[begin[i] : begin[i] + size[i]] = 0x20
        low = np.frombuffer(spaced.tobytes().decode().lower().encode(), np.uint8)  # these letters keep their length
        point, lead = _points(low)
        kind = _KIND[point]
        start = (kind != _SPACE) & lead
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        for at in np.flatnonzero(start & (low == 0x27)).tolist():  # contractions, where no other sign stands before
            for tail in CONTRACTIONS:
                if low[at + 1 : at + 1 + len(tail)].tobytes() == tail:
                    after = at + 1 + len(tail)
                    start[at + 1] = False
                    if after < len(low) and kind[after] == _LETTER:
                        start[after] = True
                    break
        starts = np.flatnonzero(start)
        if not len(starts):
            return starts, np.zeros(0, "<u4")
        stop = kind == _SPACE
        spaces = np.append(np.flatnonzero(stop), len(low))
        ends = np.minimum(np.append(starts[1:], len(low)), spaces[np.searchsorted(spaces, starts)])
        sums = prefix_hash(low)
        _, first, which = np.unique(substring_hash(sums, starts, ends), return_index=True, return_inverse=True)
        raw = low.tobytes()
        found = self._ids([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        flat, many = np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found])
        each = many[which]
        at = np.repeat((np.cumsum(many) - many)[which] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        return np.repeat(np.searchsorted(begin, starts, side="right") - 1, each), flat[at]


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code point that each byte belongs to, _FAR beyond two bytes and U+017F, and whether it leads."""
    point = data.astype(np.uint16)
    lead = (data & 0xC0) != 0x80
    two = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
    point[two] = ((data[two] & np.uint16(0x1F)) << 6) | (data[two + 1] & 0x3F)
    point[two + 1] = point[two]
    point[data >= 0xC6] = _FAR
    return point, lead


def coder(path: str) -> Coder:
    """The file's coder, one a Python worker."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the document's ids and a separator, cut only beyond capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, _, data, offsets in chunks(*text_buffer(batch.column(1)), limit=CHUNK):
                all_ids, ends = coder(tokenizer_path)(data, offsets)
                pieces = -(-np.diff(ends) // capacity)
                row = np.repeat(np.arange(len(pieces)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(ends[row + 1] - ends[row] - piece * capacity, capacity)
                raw, at = memoryview(all_ids.astype("<u4", copy=False).tobytes()), 4 * (ends[row] + piece * capacity)
                crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), (4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(i + row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        coder(tokenizer_path).forget()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: list[tuple[int, int]], capacity: int = CAPACITY, max_documents: int | None = None, max_attention: float | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): ranks [first, end) of a length go to neighbouring sequences.

    histogram: (length, pieces). Each piece costs its tokens, one document and length**2 of attention. rule "norm" takes
    the bins with the smallest weighted norm of what would be left, "dot" those with the largest weighted dot-product
    of need and residual. Equal bins with neighbouring numbers are one group: first, how many, what is left of each
    capacity, and the tokens used.
    """
    full = np.array([capacity, max_documents or capacity, max_attention or float(capacity) ** 2])
    scale = np.asarray(weights) / full**2
    first, many, used, left = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3))
    entries, sequences = [], 0
    for length, count in sorted(histogram, reverse=True):
        need, rank, new = np.array([length, 1.0, float(length) ** 2]), 0, []
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while rank < count:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if not len(fits):
                break
            rest = left[fits]
            at = fits[np.argmin((scale * (rest - need) ** 2).sum(axis=1)) if rule == "norm" else np.argmax((scale * rest * need).sum(axis=1))]
            take = min(int(many[at]), count - rank)
            if take < many[at]:
                first, many, used, left = np.append(first, first[at] + take), np.append(many, many[at] - take), np.append(used, used[at]), np.append(left, left[at : at + 1], axis=0)
                many[at] = take
            entries.append((length, rank, rank + take, int(first[at]), int(used[at])))
            left[at] -= need
            used[at] += length
            rank += take
        each = int(np.min(full // need))
        for per, bins in ((each, (count - rank) // each), ((count - rank) % each, 1)):
            if per and bins:
                for slot in range(per):
                    entries.append((length, rank, rank + bins, sequences, slot * length))
                    rank += bins
                new.append((sequences, bins, per * length, full - per * need))
                sequences += bins
        if new:
            a, b, c, d = zip(*new, strict=True)
            first, many, used, left = np.append(first, a), np.append(many, b), np.append(used, c), np.append(left, np.array(d), axis=0)
        some = (left >= 1).all(axis=1)
        first, many, used, left = first[some], many[some], used[some], left[some]
    return entries


def pack(pieces: DataFrame, capacity: int = CAPACITY, **limits) -> DataFrame:
    """pieces (any columns, with length) and sequence_id, offset. limits: see plan()."""
    spark = pieces.sparkSession
    columns = pieces.columns
    key = [F.xxhash64(*columns).alias("grain_hash")]
    histogram = [(int(r["length"]), int(r["n"])) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()]  # one row a length: capacity rows at most
    entries = spark.createDataFrame(plan(histogram, capacity, **limits), "p_length long, p_from long, p_to long, p_sequence long, p_offset long")
    buckets = 1 + sum(n for _, n in histogram) // BUCKET_PIECES
    dealt = pieces.select("*", *key).withColumn("grain_bucket", F.pmod("grain_hash", F.lit(buckets)))
    counts = dealt.groupBy("length", "grain_bucket").agg(F.count(F.lit(1)).alias("grain_n"))
    before = counts.select("length", "grain_bucket", (F.sum("grain_n").over(Window.partitionBy("length").orderBy("grain_bucket")) - F.col("grain_n")).alias("grain_before"))
    within = F.row_number().over(Window.partitionBy("length", "grain_bucket").orderBy("grain_hash", *columns)) - 1
    ranked = dealt.withColumn("grain_within", within).join(before, ["length", "grain_bucket"]).withColumn("grain_rank", F.col("grain_before") + F.col("grain_within"))
    at = (F.col("length") == F.col("p_length")) & (F.col("grain_rank") >= F.col("p_from")) & (F.col("grain_rank") < F.col("p_to"))
    placed = ranked.join(F.broadcast(entries), at)  # the plan's size depends on capacity alone
    return placed.select(*columns, (F.col("p_sequence") + F.col("grain_rank") - F.col("p_from")).alias("sequence_id"), F.col("p_offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **limits) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(tokenized(docs, tokenizer_path, capacity), "pieces"), capacity, **limits)
