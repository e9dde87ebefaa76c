"""The registered queries of the operators and the DuckDB twins of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.llm import exact_dedup, katz, language_id, mixing, near_dedup, packing, secret_scan, suffix_dedup, token_rollup, topk_search
from grainline.llm.common import WORD, shared_dir, ship, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come; a tenth is counted anew by another tokenizer, twice by mistake; a seventeenth goes."""
    import public_tokenizers

    anew, goes = F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False)), F.coalesce(F.col("doc_id") % 17 == 0, F.lit(False))
    first, second = "word_bpe_49k", "byte_bpe_50k"
    versions = {name: (public_tokenizers.path(f"{name}.json"), which) for name, which in ((first, F.lit(True)), (second, anew))}
    docs = stored(token_rollup.counted(table(spark, sf_dir, "documents"), versions), "counted")
    rollup = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("1", token_rollup.signed(docs, first, 1, first))
    revised = token_rollup.signed(docs.where(anew), first, -1, first).union(token_rollup.signed(docs.where(anew), second, 1, second))
    rollup.commit("2", revised)
    rollup.commit("2", revised)
    gone = docs.where(goes)
    rollup.commit("3", token_rollup.signed(gone.where(~anew), first, -1, first).union(token_rollup.signed(gone.where(anew), second, -1, second)))
    return rollup.totals()


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = language_id.identify(docs, F.coalesce(~held_out, F.lit(False)))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = katz.score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    return found.withColumn("base_score", F.round("base_score", 6)).withColumn("score", F.round("score", 6))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2).drop("text_hash", "stays")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: crc32 of doc_id's digits, in DuckDB: a fold over their bytes with the table's rule for each of their eight bits.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda r, c: list_reduce(list_prepend(xor(r, c), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _discounts(of: str) -> str:
    """Good-Turing discounts of counts 1 to K from the table's column c, and of all larger ones as K + 1."""
    k, rest = katz.K, katz.REST
    return f"""(WITH n AS (SELECT r, (SELECT count(*) FROM {of} WHERE c = r)::DOUBLE AS n FROM range(1, {k + 2}) x(r)),
    q AS (SELECT r, n, lead(n) OVER (ORDER BY r) AS m, CASE WHEN first_value(n) OVER (ORDER BY r) > 0 THEN {k + 1} * (SELECT n FROM n WHERE r = {k + 1}) / first_value(n) OVER (ORDER BY r) ELSE 1 END AS common FROM n),
    t AS (SELECT r, CASE WHEN common < 1 THEN (CASE WHEN n > 0 THEN (r + 1) * m / (r * n) ELSE 0 END - common) / (1 - common) ELSE 0 END AS d FROM q)
    SELECT r, CASE WHEN r > {k} THEN {1 - rest} WHEN d > 0 AND d < 1 THEN d ELSE 1 - 0.5 / r END AS d FROM t)"""


def _spans_sql() -> str:
    """All matches of each kind, in DuckDB: gaps and matches are summed as in secret_scan."""
    out = []
    for k, (kind, pattern, group, least) in enumerate(secret_scan.PATTERNS):
        pattern = pattern if group else pattern[:-1] + "{%d,}" % (least - 4 if kind == "access" else least)
        pattern = pattern.replace("'", "''")
        out.append(f"SELECT doc_id, source, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, '{pattern}', 0) AS whole, regexp_extract_all(text, '{pattern}', {group}) AS vals, string_split_regex(text, '{pattern}') AS gaps FROM t")
    return " UNION ALL ".join(out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_suffix_dedup, op3_token_rollup, op4_language_id, op5_lm_score, op6_secret_scan, op7_best_fit_packing, op8_topk_search, op9_near_dedup, op10_exact_dedup)
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, text, len(coalesce(regexp_extract_all(text, '{WORD}'), [])) AS size FROM documents),
q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
k AS (SELECT d.*, -ln((('0x' || substr(md5('0:' || d.doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
        / CASE WHEN quality > 0 THEN 1.0 WHEN quality IS NOT NULL THEN 0.2 WHEN length(text) / greatest(size, 1) BETWEEN 3 AND 12 THEN 1.0 ELSE 0.25 END AS key FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2 * source_size AS bound FROM s),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - (sum(bound) OVER o - bound)) / (sum(w) OVER () - sum(w) OVER o + w) AS level
      FROM w WINDOW o AS (ORDER BY bound / w, source NULLS LAST)),
f AS (SELECT arg_min(level, bound / w) AS final FROM l WHERE level * w <= bound),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN bound ELSE least(bound, final * w) END AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        sum(size) OVER (PARTITION BY k.source ORDER BY key) - size / 2.0 AS middle
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, round(target, 6) AS target,
  ((epochs + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r""",
    "op2_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, length(hex(coalesce(text, ''))) // 2 AS n FROM documents),
b AS (SELECT doc_id, n, h, unnest(range(0, greatest(n - 99, 0), 1000)) AS o FROM d),
p AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2198) AS s, least(1000, n - 99 - o) AS many FROM b),
j AS (SELECT doc_id, o, s, unnest(range(0, many)) AS j FROM p),
w AS (SELECT doc_id, o + j AS a, md5_number(substr(s, 2 * j + 1, 200)) AS m FROM j),
f AS (SELECT m, min(doc_id::HUGEINT * 4294967296 + a) AS first FROM w GROUP BY m HAVING count(*) > 1),
g AS (SELECT doc_id, a, CASE WHEN a <= lag(a) OVER (PARTITION BY doc_id ORDER BY a) + 100 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (m) WHERE doc_id::HUGEINT * 4294967296 + a <> first),
i AS (SELECT doc_id, a, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS island FROM g),
r AS (SELECT doc_id, min(a) AS lo, max(a) + 100 AS hi FROM i GROUP BY doc_id, island),
k AS (SELECT r.doc_id, lo, hi, substr(h, 2 * coalesce(lag(hi) OVER (PARTITION BY r.doc_id ORDER BY lo), 0) + 1, 2 * (lo - coalesce(lag(hi) OVER (PARTITION BY r.doc_id ORDER BY lo), 0))) AS before FROM r JOIN d USING (doc_id)),
x AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans, max(hi) AS hi, string_agg(before, '' ORDER BY lo) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(hi, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)""",
    "op5_lm_score": rf"""
WITH d AS (SELECT doc_id, xor({_CRC}, 4294967295) % 7 = 2 AS held, list_append(coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}'), []), '') AS w FROM documents),
i AS (SELECT doc_id, held, w, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT doc_id, held, CASE WHEN i = 1 THEN '' ELSE w[i - 1] END AS u, w[i] AS v FROM i),
u AS (SELECT v, count(*) AS c FROM t WHERE NOT held GROUP BY v),
g AS (SELECT u, v, count(*) AS c FROM t WHERE NOT held GROUP BY u, v),
s AS (SELECT sum(c)::DOUBLE AS n, count(*) AS words FROM u),
du AS {_discounts("u")},
dg AS {_discounts("g")},
p AS (SELECT v, c, d * c / n AS p FROM u JOIN du ON r = least(c, {katz.K + 1}), s),
z AS (SELECT 1 - sum(p) AS unknown FROM p),
k AS (SELECT g.u, g.v, g.c, d * g.c AS kept, p FROM g JOIN dg ON r = least(g.c, {katz.K + 1}) JOIN p ON p.v = g.v),
a AS (SELECT k.u, any_value(x.c) AS c, log10((1 - sum(kept) / any_value(x.c)) / (1 - sum(k.p))) AS weight FROM k JOIN p x ON x.v = k.u GROUP BY k.u),
o AS (SELECT t.doc_id, held, p.c IS NOT NULL AS known, log10((coalesce(p.c, 0) + 1) / (s.n + s.words + 1)) AS base,
        CASE WHEN k.c IS NOT NULL THEN log10(k.kept / a.c) ELSE coalesce(a.weight, 0) + log10(coalesce(p.p, unknown)) END AS score
      FROM t LEFT JOIN p ON p.v = t.v LEFT JOIN k ON k.u = t.u AND k.v = t.v LEFT JOIN a ON a.u = t.u, s, z)
SELECT doc_id, held AS held_out, count(*)::BIGINT AS n_tokens, count(*) FILTER (WHERE known)::BIGINT AS n_known, any_value(s.n)::BIGINT AS train_tokens,
  round(sum(base), 6) AS base_score, round(sum(score), 6) AS score FROM o, s GROUP BY doc_id, held""",
    "op6_secret_scan": rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
m AS ({_spans_sql()}),
i AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m),
e AS (SELECT doc_id, source, k, kind, least, vals[i] AS v, length(whole[i]) AS n, sum(length(gaps[i]) + length(whole[i])) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM i),
b AS (SELECT doc_id, source, k, kind, v, (e - n)::BIGINT AS s, e::BIGINT AS e FROM e WHERE length(v) >= least),
o AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT source || ':' || doc_id) AS repositories FROM b GROUP BY v),
j AS (SELECT DISTINCT doc_id, e - length(v) AS s, e, owners, repositories, CASE WHEN owners >= {secret_scan.EXAMPLE_OWNERS} OR repositories >= {secret_scan.EXAMPLE_REPOSITORIES} THEN 'example'
        WHEN len(list_distinct(string_split(v, ''))) >= {secret_scan.DISTINCT} AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND NOT regexp_matches(v, '{secret_scan.FILLER}') THEN 'live' ELSE 'weak' END AS kind
      FROM b JOIN o USING (v)),
x AS (SELECT doc_id, k, kind, s, e FROM b UNION ALL SELECT doc_id, CASE kind WHEN 'live' THEN 3 WHEN 'example' THEN 4 ELSE 5 END, kind, s, e FROM j),
y AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (WHERE k < 3) AS base,
        {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secret_scan.ORDER)} FROM x GROUP BY doc_id),
q AS (SELECT doc_id, string_agg(s || ':' || e || ':' || owners || ':' || repositories, ',' ORDER BY s, e, owners, repositories) AS ownership FROM j GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secret_scan.ORDER)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(ownership, '') AS ownership
FROM t LEFT JOIN y USING (doc_id) LEFT JOIN q USING (doc_id)""",
    "op9_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT node AS doc_id, any_value(coalesce(n, 0))::BIGINT AS n_shingles, min(reach) AS component_id, node = min(reach) AS kept FROM r LEFT JOIN n ON n.doc_id = node GROUP BY node""",
    "op8_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256 FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
