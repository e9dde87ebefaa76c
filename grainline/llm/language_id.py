"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained on the driver by backpropagation through time, in numpy, on a bounded sample: up to
``TRAIN_DOCS`` documents of each language, ``TRAIN_SLICES`` slices of each. In use it reads whole texts in segments of
``SEGMENT`` bytes, gives every byte a probability of each language, and pools them to the document's mean; segments of
many documents run side by side. Each direction reads ``CONTEXT`` bytes before it comes to a segment, so that its state is
warm where the segment begins.

A text that is null or has no letter is ``und`` with score 0, as is every text when nothing was learned; rows without a
language are never learned from; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainline.llm.common import chunks, text_buffer

HIDDEN, SEGMENT, CONTEXT, LANES = 8, 128, 32, 2048
TRAIN_DOCS, TRAIN_SLICES, SLICE, STEPS, BATCH, RATE = 400, 4, 96, 260, 128, 0.02
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def fresh(languages: int, seed: int = 7) -> dict[str, np.ndarray]:
    """wx: input weights of each byte; wh: recurrent weights; rows are update, reset and candidate. out: per direction."""
    draw = np.random.default_rng(seed)
    p = {}
    for d in ("f", "b"):
        p[f"wx_{d}"] = draw.normal(0, 0.3, (3 * HIDDEN, 256)).astype(np.float32)
        p[f"wh_{d}"] = draw.normal(0, HIDDEN**-0.5, (3 * HIDDEN, HIDDEN)).astype(np.float32)
        p[f"out_{d}"] = draw.normal(0, 0.3, (languages, HIDDEN)).astype(np.float32)
    p["bias"] = np.zeros((languages, 1), np.float32)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _walk(p: dict[str, np.ndarray], d: str, x: np.ndarray, kept: list | None = None, mask: np.ndarray | None = None, stop: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(position, hidden state) in the order of the direction, to position stop or the end; x: positions by lanes. Padding leaves the state at 0."""
    wx, wh, h = p[f"wx_{d}"], p[f"wh_{d}"], np.zeros((HIDDEN, x.shape[1]), np.float32)
    for t in range(len(x) if stop is None else stop + 1) if d == "f" else range(len(x) - 1, -1 if stop is None else stop - 1, -1):
        g, u = np.take(wx, x[t], axis=1, mode="clip"), wh @ h
        zr = _sigmoid(g[: 2 * HIDDEN] + u[: 2 * HIDDEN])
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        n = np.tanh(g[2 * HIDDEN :] + r * u[2 * HIDDEN :])
        before, h = h, n + z * (h - n)
        if mask is not None:
            h *= mask[t]
        if kept is not None:
            kept.append((t, before, z, r, n, u[2 * HIDDEN :]))
        yield t, h


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=0))
    return e / e.sum(axis=0)


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy over all positions; x: positions by lanes of bytes, y: the label of each lane."""
    kept: dict[str, list] = {"f": [], "b": []}
    hidden = {d: np.empty((len(x), HIDDEN, x.shape[1]), np.float32) for d in kept}
    for d, steps in kept.items():
        for t, h in _walk(p, d, x, steps):
            hidden[d][t] = h
    error = np.empty((len(x), len(p["bias"]), x.shape[1]), np.float32)
    for t in range(len(x)):
        error[t] = _softmax(p["out_f"] @ hidden["f"][t] + p["out_b"] @ hidden["b"][t] + p["bias"])
        error[t][y, np.arange(len(y))] -= 1
    error /= x.size
    grad = {"bias": error.sum(axis=(0, 2))[:, None]}
    order = np.argsort(x, axis=None, kind="stable")
    values, first = np.unique(x.ravel()[order], return_index=True)
    for d, steps in kept.items():
        grad[f"out_{d}"] = np.einsum("tlb,thb->lh", error, hidden[d])
        dh, dwh = np.zeros_like(hidden[d][0]), np.zeros_like(p[f"wh_{d}"])
        at_input = np.empty((len(x), 3 * HIDDEN, x.shape[1]), np.float32)
        for t, before, z, r, n, un in reversed(steps):
            dh = dh + p[f"out_{d}"].T @ error[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r])
            at_input[t] = np.concatenate([dz, dr, dn])
            dwh += du @ before.T
            dh = dh * z + p[f"wh_{d}"].T @ du
        grad[f"wh_{d}"] = dwh
        flat = at_input.transpose(1, 0, 2).reshape(3 * HIDDEN, -1)[:, order]
        grad[f"wx_{d}"] = np.zeros_like(p[f"wx_{d}"])
        grad[f"wx_{d}"][:, values] = np.add.reduceat(flat, first, axis=1)
    return grad


def train(slices: list[tuple[bytes, int]], languages: int, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """slices: bytes, cut or filled with spaces to SLICE, and their label. At least so many steps of BATCH slices, in whole epochs."""
    p, draw = fresh(languages, seed), np.random.default_rng(seed)
    x = np.frombuffer(b"".join(s[:SLICE].ljust(SLICE) for s, _ in slices), np.uint8).reshape(-1, SLICE).T.astype(np.intp)
    y = np.array([label for _, label in slices])
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    epoch = -(-len(y) // BATCH)
    step, epochs = 0, -(-steps // epoch)
    steps = epochs * epoch
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for at in range(0, len(y), BATCH):
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, g in _gradients(p, x[:, order[at : at + BATCH]], y[order[at : at + BATCH]]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return p


def pooled(p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mean over a document's positions of each language's probability: documents by languages."""
    sizes = np.diff(offsets)
    many = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), many)
    begin = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * SEGMENT
    length = np.minimum(offsets[doc + 1] - begin, SEGMENT)
    order = np.argsort(-length, kind="stable")  # the short ones run together
    sums = np.zeros((len(p["bias"]), len(sizes)))
    for at in range(0, len(order), LANES):
        own = order[at : at + LANES]
        top = int(length[own[0]])
        at_ = begin[own] - CONTEXT + np.arange(top + 2 * CONTEXT)[:, None]
        inside = (at_ >= offsets[doc[own]]) & (at_ < offsets[doc[own] + 1])
        x = data[np.clip(at_, 0, len(data) - 1)].astype(np.intp)
        mask, counts = inside.astype(np.float32), (np.arange(top)[:, None] < length[own]).astype(np.float32)
        ahead = np.empty((top, len(p["bias"]), len(own)), np.float32)
        for t, h in _walk(p, "f", x, mask=mask, stop=top + CONTEXT - 1):
            if t >= CONTEXT:
                np.matmul(p["out_f"], h, out=ahead[t - CONTEXT])
        total = np.zeros((len(p["bias"]), len(own)), np.float32)
        for t, h in _walk(p, "b", x, mask=mask, stop=CONTEXT):
            if t < top + CONTEXT:
                total += _softmax(ahead[t - CONTEXT] + p["out_b"] @ h + p["bias"]) * counts[t - CONTEXT]
        for k in range(len(total)):
            sums[k] += np.bincount(doc[own], weights=total[k], minlength=len(sizes))
    return (sums / np.maximum(sizes, 1)).T


def sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """(slice, language): TRAIN_DOCS documents a language, or all if fewer, the first by hash; TRAIN_SLICES slices of each.

    Languages are counted first, and a hash threshold leaves a few times TRAIN_DOCS rows of each to be ranked.
    """
    text, span = F.col(text_col).cast("string"), F.greatest(F.length(text_col) - SLICE, F.lit(1))
    slices = F.array(*[F.substring(text, (F.pmod(F.xxhash64(F.lit(k), id_col), span) + 1).cast("int"), F.lit(SLICE)) for k in range(TRAIN_SLICES)])
    rows = docs.where(learn & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, slices).alias("h"), F.col(id_col).alias("id"), slices.alias("slices"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return []
    margin = 4
    while True:
        share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, margin * TRAIN_DOCS / n))]), F.col("lang"))
        few = rows.where(F.pmod("h", F.lit(2**30)) < share * float(2**30))
        first = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(2**30)), "h", "id", "slices"))).where(F.col("n") <= TRAIN_DOCS)
        found = first.select("lang", "n", "slices").collect()  # TRAIN_DOCS rows a language at most
        had = {lang: sum(r["lang"] == lang for r in found) for lang in counts}
        if all(had[lang] >= min(n, TRAIN_DOCS) for lang, n in counts.items()):
            return [(s, r["lang"]) for r in sorted(found, key=lambda r: (r["lang"], r["n"])) for s in r["slices"]]
        margin *= 4  # many rows alike share a hash


def predict(docs: DataFrame, languages: list[str], p: dict[str, np.ndarray] | None, keep: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """The columns of keep and lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, offsets = text_buffer(batch.column(0))
            for i, j, data, own in chunks(whole, offsets):
                best, score = [UNKNOWN] * (j - i), np.zeros(j - i)
                if p is not None and len(data):
                    means = pooled(p, data, own)
                    top = means.argmax(axis=1)
                    for k in range(j - i):
                        text = data[own[k] : own[k + 1]].tobytes()
                        if _ASCII_LETTER.search(text) or _LETTER.search(text.decode()):
                            best[k], score[k] = languages[top[k]], min(1.0, float(means[k, top[k]]))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), pa.array(best, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(text_col).cast("string").alias("grain_text"), *[F.col(c) for c in keep]).mapInArrow(run, out)


def learned(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], dict[str, np.ndarray] | None]:
    """Languages and network, from the rows for which learn holds."""
    slices = sample(docs, learn, id_col, text_col, lang_col)
    languages = sorted({lang for _, lang in slices})
    if not languages:
        return [], None
    return languages, train([(s.encode(), languages.index(lang)) for s, lang in slices], len(languages))


def identify(docs: DataFrame, learn: Column, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    languages, p = learned(docs, learn, id_col, text_col, lang_col)
    return predict(docs, languages, p, keep, text_col)
