"""Exact top-k inner-product search by multi-resolution segment statistics.

Vectors become integers floor(scale * x). Cut into segments of length l, two vectors q and x have
|q - x|**2 >= sum of l * ((mean_q - mean_x)**2 + (dev_q - dev_x)**2); since 2 q.x = |q|**2 + |x|**2 - |q - x|**2, that is a
bound on the score. Bounds go from one segment to many; exact scores are computed for what stays at or above the worst
of the k best scores so far.

1. Vectors are dealt to cells, by the nearest of ``PIVOTS`` drawn vectors, and each cell into blocks of bounded bytes.
   A block is one packed row with the bounding box of its statistics.
2. Each block of queries meets one block of candidates of its own cell: that gives every query a k-th best score.
3. Pairs of a query block and a candidate block whose boxes bound every score below those go. Only boxes are compared.
4. Query blocks are sent to the candidate blocks that are left, so that queries, not candidates, are copied; a
   candidate block is copied only once for every ``SUPER_BYTES`` of queries that need it. The k best are merged per query.

Vectors that are null or hold null or non-finite components take no part; a shorter vector counts as padded with zeros. A
candidate without an id comes after all others of its score and is nobody's own row (the largest long stands for it inside
and is no id); a query needs an id. Rows that repeat a vec_id are rows, but never candidates of the query with that id; of
different query vectors with one id the smallest is asked. Ranks are by exact scores at any size of components; a score
that a long can't hold is returned as the nearest long. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainline.llm.common import shuffle_partitions, stored

#: Vectors that name cells; bytes of a candidate block, of a query block and of the queries that meet a candidate block at once.
PIVOTS, CANDIDATE_BYTES, QUERY_BYTES, SUPER_BYTES = 64, 4 << 20, 1 << 20, 16 << 20
#: Candidates that are bounded at once, segments of the boxes, and the id of candidates without one.
STEP, BOX, NO_ID = 2_048, 8, int(np.iinfo(np.int64).max)
#: Doubles hold whole numbers below 2**53, longs below 2**63.
_FLOAT, _LONG = 2.0**53, 2.0**63
_FOUND = "query_id long, vec_id long, score long, place string"
_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("place", pa.string())])


def statistics(values: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length: n rows of 2 * segments."""
    parts = np.array_split(values, segments, axis=1)
    root = np.sqrt([p.shape[1] for p in parts])
    mean = np.stack([p.mean(axis=1) for p in parts], axis=1)
    dev = np.stack([p.std(axis=1) for p in parts], axis=1)
    return np.concatenate([mean * root, dev * root], axis=1)


def sortable(score: int) -> str:
    """Text in the order of any whole numbers: sign, count of digits, digits; complements for negative ones."""
    digits = str(abs(score))
    text = f"{len(digits):05d}{digits}"
    return "1" + text if score >= 0 else "0" + "".join(chr(105 - ord(c)) for c in text) + ":"


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k best of each query among these candidates.

    worst: what a score must reach for each query. Scores are int64, or Python integers where these don't do.
    """
    dim = queries.shape[1]
    size = dim * np.abs(queries).max(initial=0) * np.abs(values).max(initial=0)
    if not size < _LONG:
        return _plain(query_ids, queries, ids, values, k)
    levels = [s for s in (1, 2, 4, 8, 16) if 2 * s <= dim] or ([1] if dim else [])
    of_queries = [statistics(queries, s) for s in levels]
    norms = (queries**2).sum(axis=1)
    worst = np.full(len(queries), -np.inf) if worst is None else worst.copy()
    best_q, best_c, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(values), STEP):
        part = values[at : at + STEP]
        own = (part**2).sum(axis=1)
        q, c = np.nonzero(query_ids[:, None] != ids[None, at : at + STEP])
        if np.isfinite(worst).any():
            for of_q, segments in zip(of_queries, levels, strict=True):
                of_c = statistics(part, segments)
                if segments == levels[0] or len(q) * 8 > len(queries) * len(part):
                    low = (of_q**2).sum(axis=1)[q] + (of_c**2).sum(axis=1)[c] - 2 * (of_q @ of_c.T)[q, c]
                else:
                    low = ((of_q[q] - of_c[c]) ** 2).sum(axis=1)
                total = norms[q] + own[c]
                stay = (total - low) / 2 + 1e-9 * total + 1 >= worst[q]  # the slack covers rounding
                q, c = q[stay], c[stay]
        if size >= _FLOAT:
            score = (queries[q].astype(np.int64) * part[c].astype(np.int64)).sum(axis=1)
        elif len(q) * 8 > len(queries) * len(part):
            score = (queries @ part.T)[q, c].astype(np.int64)
        else:
            score = np.einsum("ij,ij->i", queries[q], part[c]).astype(np.int64)
        stay = score >= worst[q]
        best_q, best_c, best_s = np.concatenate([best_q, q[stay]]), np.concatenate([best_c, c[stay] + at]), np.concatenate([best_s, score[stay]])
        order = np.lexsort((ids[best_c], -best_s, best_q))
        best_q, best_c, best_s = best_q[order], best_c[order], best_s[order]
        place = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
        best_q, best_c, best_s, place = best_q[place < k], best_c[place < k], best_s[place < k], place[place < k]
        last = place == k - 1
        worst[best_q[last]] = np.maximum(worst[best_q[last]], best_s[last] - np.abs(best_s[last]) * 1e-15)
    return best_q, best_c, best_s


def _plain(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """search() in Python integers, one query at a time, for components whose products no long holds."""
    whole = np.array([[int(x) for x in row] for row in values], dtype=object).reshape(len(values), -1)
    found: list[tuple[int, int, int]] = []
    for q, row in enumerate(queries):
        scores = whole @ np.array([int(x) for x in row], dtype=object)
        others = [c for c in range(len(ids)) if ids[c] != query_ids[q]]
        found += [(q, c, scores[c]) for c in sorted(others, key=lambda c: (-scores[c], ids[c]))[:k]]  # noqa: B023
    q, c, s = zip(*found, strict=True) if found else ((), (), ())
    return np.array(q, np.int64), np.array(c, np.int64), np.array(s, object)


def quantized(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, as whole numbers in doubles, which hold every floor(scale * x) exactly."""
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * scale)
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < _FLOAT, F.floor(x).cast("double")).otherwise(x))  # larger ones have no fraction
    return vectors.where(F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def celled(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows (vec_id, v, ...) with the number of the nearest pivot."""
    half = (pivots**2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("v").to_pylist(), pivots.shape[1])
            with np.errstate(over="ignore", invalid="ignore"):
                cell = np.argmax(np.nan_to_num(values @ pivots.T - half), axis=1) if len(pivots) else np.zeros(len(values), np.int64)
            yield batch.append_column("cell", pa.array(cell.astype(np.int32)))

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell int")


def places(counts: dict[int, int], most: int) -> tuple[dict[int, int], dict[int, int]]:
    """How many blocks each cell has, and the number of its first."""
    parts = {c: -(-n // most) for c, n in counts.items()}
    return parts, dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))


def _look(of_cell: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in of_cell.items() for x in kv]), F.col("cell"))  # PIVOTS entries at most


def blocks(rows: DataFrame, counts: dict[int, int], most: int, dim: int) -> DataFrame:
    """(block, cell, part, ids, values, box): at most about so many vectors each; box: least and largest norms and statistics."""
    parts, first = places(counts, most)

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        values = _matrix(list(own["v"]), dim)
        figures = np.concatenate([(values**2).sum(axis=1, keepdims=True), statistics(values, min(BOX, max(1, dim // 2)))], axis=1) if dim else np.zeros((len(values), 1))
        box = np.concatenate([figures.min(axis=0), figures.max(axis=0)])
        ids = own["vec_id"].to_numpy(np.int64)
        return pd.DataFrame({"block": [int(own["block"].iloc[0])], "cell": [int(own["cell"].iloc[0])], "part": [int(own["part"].iloc[0])], "ids": [ids.tobytes()], "values": [values.tobytes()], "box": [box.tolist()]})

    part = F.pmod(F.xxhash64("vec_id", "v"), _look(parts)).cast("int")
    dealt = rows.withColumn("part", part).withColumn("block", (_look(first) + F.col("part")).cast("int"))
    return dealt.groupBy("block").applyInPandas(pack, "block int, cell int, part int, ids binary, values binary, box array<double>")


def most_of(a: Column, b: Column) -> Column:
    """The largest score that a vector in box a can have with one in box b, and a little more for rounding."""
    n = F.size(a) / 2
    pair = lambda box: F.arrays_zip(F.slice(box, F.lit(2), (n - 1).cast("int")).alias("lo"), F.slice(box, (n + 2).cast("int"), (n - 1).cast("int")).alias("hi"))
    gap = F.zip_with(pair(a), pair(b), lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"], F.lit(0.0)))
    norms = F.element_at(a, (n + 1).cast("int")) + F.element_at(b, (n + 1).cast("int"))
    return (norms - F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)) / 2 + 1e-9 * norms + 1


def _rows(query_ids: np.ndarray, ids: np.ndarray, found: tuple, wide: bool) -> dict:
    q, c, s = found
    exact = [int(x) for x in s]
    return {
        "query_id": query_ids[q], "vec_id": ids[c], "score": np.array([max(-(2**63), min(2**63 - 1, x)) for x in exact], np.int64), "place": [sortable(x) if wide else "" for x in exact],
    }


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of every row for which is_query holds, the k best other rows."""
    spark = vectors.sparkSession
    asked = quantized(vectors.where(is_query & F.col(id_col).isNotNull()), scale, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = quantized(vectors, scale, id_col, vector_col).withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    rows = rows.withColumn("vec_id", F.coalesce("vec_id", F.lit(NO_ID)))
    seen = rows.agg(F.max(F.size("v")), F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)))).first()
    dim, largest = int(seen[0] or 0), float(seen[1] or 0)
    wide = not dim * largest * largest < _LONG
    pivots = _matrix([r["v"] for r in rows.where("not asks").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOTS).select("v").collect()], dim)  # PIVOTS vectors
    rows = stored(celled(rows, pivots), "cells")
    counts: dict[bool, dict[int, int]] = {False: {}, True: {}}
    for r in rows.groupBy("asks", "cell").agg(F.count(F.lit(1)).alias("n")).collect():  # two rows a pivot at most
        counts[r["asks"]][r["cell"]] = r["n"]
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not counts[True]:
        return none
    total = {asks: sum(c.values()) for asks, c in counts.items()}
    at_once = lambda limit, n: max(1, min(limit // max(8 * dim, 8), -(-n // (2 * shuffle_partitions(spark)))))
    candidates_each = at_once(CANDIDATE_BYTES, total[False])
    c = stored(blocks(rows.where("not asks"), counts[False], candidates_each, dim), "candidates")
    queries_each = at_once(QUERY_BYTES, total[True])
    q = stored(blocks(rows.where("asks"), counts[True], queries_each, dim), "queries")

    def vectors_of(row: dict | pd.Series) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["values"]).reshape(-1, dim)

    def begin(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        """The query blocks of a cell part against a block of candidates: thresholds and what was found."""
        ids, values = vectors_of(near.iloc[0]) if len(near) else (np.zeros(0, np.int64), np.zeros((0, dim)))  # a part may be empty
        out = []
        for _, row in own.iterrows():
            query_ids, queries = vectors_of(row)
            a, b, s = search(query_ids, queries, ids, values, k)
            worst = np.full(len(query_ids), -np.inf)
            place = np.arange(len(a)) - np.searchsorted(a, a)
            if not wide:
                worst[a[place == k - 1]] = s[place == k - 1].astype(float) - np.abs(s[place == k - 1].astype(float)) * 1e-15
            out.append({"block": row["block"], "worst": worst.tobytes(), "least": float(worst.min()), "query_rows": a.tobytes(), "found": ids[b].tobytes(), "scores": [str(x) for x in s]})
        return pd.DataFrame(out)

    # rounding may put a query in a cell without candidates: it begins in the largest one; a cell's parts take turns
    parts, begins = places(counts[False], candidates_each)
    home = {cell: cell if cell in parts else max(parts, key=parts.get) for cell in counts[True]}
    turn = _look({cell: begins[h] for cell, h in home.items()}) + F.pmod(F.col("part"), _look({cell: parts[h] for cell, h in home.items()}))
    q_near = q.withColumn("g", turn.cast("int"))
    found = ("block", "worst", "least", "query_rows", "found", "scores")
    first = stored(
        q_near.groupBy("g").cogroup(c.select(F.col("block").alias("of"), "ids", "values").groupBy("of")).applyInPandas(
            lambda own, near: begin(own, near) if len(own) else pd.DataFrame(columns=found, dtype=object),
            "block int, worst binary, least double, query_rows binary, found binary, scores array<string>",
        ), "first",
    )
    met = q_near.select("block", "g")
    pairs = q.join(first.select("block", "least"), "block").select("block", F.col("box").alias("q_box"), "least", F.explode(F.sequence(F.lit(0), F.lit(sum(parts.values()) - 1))).alias("g"))
    pairs = pairs.join(c.select(F.col("block").alias("g"), F.col("box").alias("c_box")), "g")
    if not wide:
        pairs = pairs.where(most_of(F.col("q_box"), F.col("c_box")) >= F.col("least"))
    each = max(1, SUPER_BYTES // max(1, queries_each * dim * 8))
    pairs = stored(pairs.select("block", "g").join(met, ["block", "g"], "left_anti").withColumn("super", F.floor(F.col("block") / each).cast("int")), "pairs")

    def meet(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["query_id", "vec_id", "score", "place"], dtype=object)]
        if not len(near):
            return out[0]
        ids, values = vectors_of(near.iloc[0])
        for _, row in own.iterrows():
            query_ids, queries = vectors_of(row)
            out.append(pd.DataFrame(_rows(query_ids, ids, search(query_ids, queries, ids, values, k, np.frombuffer(row["worst"])), wide)))
        return pd.concat(out)

    sent = pairs.join(q.join(first.select("block", "worst"), "block").select("block", "ids", "values", "worst"), "block").groupBy("g", "super")
    wanted = pairs.select(F.col("g").alias("w"), F.col("super").alias("w_super")).distinct()
    waiting = wanted.join(c.select(F.col("block").alias("w"), "ids", "values"), "w").groupBy("w", "w_super")
    later = sent.cogroup(waiting).applyInPandas(meet, _FOUND)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = np.frombuffer(row["query_rows"], np.int64), np.arange(len(row["scores"])), row["scores"]
                yield pa.RecordBatch.from_pydict(_rows(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["found"], np.int64), found, wide), schema=_ARROW)

    soon = first.join(q.select("block", "ids"), "block").select("ids", "query_rows", "found", "scores").mapInArrow(told, _FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("place"), F.desc("score"), "vec_id"))
    best = soon.unionByName(later).withColumn("rank", place).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
