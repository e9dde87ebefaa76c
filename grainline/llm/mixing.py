"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of a budget by its weight, at most ``max_epochs`` times its own size; the excess is shared
again among the others. A source is taken whole as many times as fits its target; the rest comes from a weighted sample
without replacement: each document has the key -ln(u) / quality, and the documents with the smallest keys whose sizes
add up to the rest are taken once more. The last key taken is found digit by digit: sizes are summed by source and
digit, and the digit that the rest ends in is the prefix of the next pass. A pass meets at most ``2**DIGIT`` sums a source,
whatever the distribution of keys, and no rows are ordered or gathered.

A null text has size 0; a null source is a source, sorted last; repeated rows are drawn together; a quality that is null
or no number counts as the smallest; an empty table gives an empty result; names of columns that begin with grain_ are the
operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainline.llm.common import WORD, stored

BUDGET, WEIGHTS, MAX_EPOCHS = 1.5, (5.0, 2.0, 1.0), 2.0
#: Keys are whole numbers of 2**-SCALE, below 2**BITS, read in digits of DIGIT bits.
SCALE, BITS, DIGIT = 50, 60, 12
LEAST_QUALITY = 0.05
#: Qualities of documents that a table of labels calls bad and good.
LABELLED = (0.2, 1.0)
#: The table of sources, a row each, is broadcast up to so many bytes, and joined by shuffles beyond.
BROADCAST_BYTES = 16 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column, size: Column) -> Column:
    """1 for texts whose words have ordinary lengths, less for others: a stand-in where no quality is known."""
    each = F.length(text) / F.greatest(size, F.lit(1))
    return F.when(each.between(3, 12), 1.0).otherwise(0.25)


def source_targets(sizes: DataFrame, budget: float = BUDGET, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size), one row a source: and target, the source's share of the budget.

    With sources in the order of max_epochs * size / weight, those before some point reach their bound and the others
    share what is left by weight; both sums are running sums over that order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source; sources are summed before
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    bound = sizes.withColumn("w", weight).withColumn("bound", F.lit(max_epochs) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last())
    shared = bound.select(
        "*", (F.lit(budget) * F.sum("source_size").over(everything)).alias("total"),
        (F.sum("bound").over(order) - F.col("bound")).alias("bounds_before"), (F.sum("w").over(everything) - F.sum("w").over(order) + F.col("w")).alias("w_from"),
    ).withColumn("level", (F.col("total") - F.col("bounds_before")) / F.col("w_from"))
    # the level that holds: that of the first source in order which stays below its bound
    final = F.min(F.when(F.col("level") * F.col("w") <= F.col("bound"), F.struct(F.col("bound") / F.col("w"), "bounds_before", "level"))).over(everything)["level"]
    return shared.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull(), F.col("bound")).otherwise(F.least(F.col("bound"), F.col("final") * F.col("w"))).alias("target"))


def unit_draw(id_text: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from the id: 52 bits of its MD5, so that reruns and other engines draw the same."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit("")))), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)


def keyed(docs: DataFrame, size: Column | None, quality: Column | None, seed: int, id_col: str, text_col: str) -> DataFrame:
    """docs with grain_size, grain_draw, the exponential draw, and grain_quality."""
    rows = docs.withColumn("grain_size", (word_count(F.col(text_col)) if size is None else size).cast("long"))
    quality = text_quality(F.col(text_col), F.col("grain_size")) if quality is None else quality
    return rows.withColumn("grain_draw", -F.log(unit_draw(F.col(id_col).cast("string"), seed))).withColumn("grain_quality", quality.cast("double"))


def scaled(draw: Column, quality: Column) -> Column:
    """The key: the draw over the quality."""
    usable = F.greatest(F.coalesce(F.nanvl(quality, F.lit(0.0)), F.lit(0.0)), F.lit(LEAST_QUALITY))
    return F.floor(draw / usable * float(2**SCALE)).cast("long")


def _with_sources(rows: DataFrame, sources: DataFrame, how: Column) -> DataFrame:
    """rows joined with a table of one row a source, broadcast where that is small."""
    size = sources.agg(F.sum(F.coalesce(F.octet_length(sources.columns[0]), F.lit(0)) + 100)).first()[0] or 0
    return rows.join(F.broadcast(sources) if size <= BROADCAST_BYTES else sources, how)


def cuts(rows: DataFrame, budget: float = BUDGET, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """rows (source, grain_size, grain_key): one row per source with source_size, target, full epochs and the last key
    that the sample takes (null: none). Rows with one key are taken together, where half of their size fits."""
    targets = source_targets(rows.groupBy("source").agg(F.sum("grain_size").alias("source_size")), budget, weights, max_epochs)
    targets = targets.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = stored(targets.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")).withColumnRenamed("source", "s"), "targets")
    at = targets.where("rest > 0").select("s", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), "rest")
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        inside = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("grain_key", shift + DIGIT) == F.col("prefix"))
        sums = _with_sources(rows.select("source", "grain_size", "grain_key"), at, inside).groupBy("s", "before", "rest", F.shiftright("grain_key", shift).alias("prefix")).agg(F.sum("grain_size").alias("n"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy("s").orderBy("prefix"))  # a row a digit
        at = sums.withColumn("upto", upto).where((F.col("upto") - F.col("n") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
        at = stored(at.select("s", "prefix", (F.col("upto") - F.col("n")).alias("before"), "rest", "n"), "digits")
    last = at.select(F.col("s").alias("e"), F.when(F.col("before") + F.col("n") / 2 <= F.col("rest"), F.col("prefix")).otherwise(F.col("prefix") - 1).alias("cut"))
    out = targets.join(last, F.col("s").eqNullSafe(F.col("e")), "left")
    return stored(out.select("s", "source_size", F.round("target", 6).alias("target"), "full", "cut"), "cuts")


def decided(rows: DataFrame, cut: DataFrame, source: Column) -> DataFrame:
    """keyed rows with grain_epochs, and cuts' other columns as grain_ ones."""
    cut = cut.select(*[F.col(c).alias(f"grain_{c}") for c in cut.columns])
    epochs = F.col("grain_full") + F.when(F.col("grain_key") <= F.col("grain_cut"), 1).otherwise(0)
    return _with_sources(rows.withColumn("grain_from", source), cut, F.col("grain_from").eqNullSafe(F.col("grain_s"))).withColumn("grain_epochs", epochs)


def mix(docs: DataFrame, size: Column | None = None, quality: Column | None = None, labels: DataFrame | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken = epochs * size, epochs.

    size: words or tokens of a row, words of the text by default. quality: the weight of the keys; labels (doc_id,
    quality: 0 or 1) go before it, the best where a document has several.
    """
    rows = keyed(docs, size, quality, seed, id_col, text_col)
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), "grain_size", "grain_draw", "grain_quality")
    if labels is not None:
        known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("quality").alias("l_quality"))
        given = F.when(F.col("l_quality") > 0, LABELLED[1]).when(F.col("l_quality").isNotNull(), LABELLED[0])
        rows = rows.join(known, F.col("doc_id") == F.col("l_id"), "left").withColumn("grain_quality", F.coalesce(given, "grain_quality"))
    rows = stored(rows.select("doc_id", "source", "grain_size", scaled(F.col("grain_draw"), F.col("grain_quality")).alias("grain_key")), "keys")
    out = decided(rows, cuts(rows, **shares), F.col("source"))
    return out.select(
        "doc_id", "source", F.col("grain_size").alias("size"), F.col("grain_source_size").alias("source_size"), F.col("grain_target").alias("target"),
        (F.col("grain_epochs") * F.col("grain_size")).alias("taken"), F.col("grain_epochs").alias("epochs"),
    )


def mixed(docs: DataFrame, size: Column | None = None, quality: Column | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs. No text is shuffled."""
    columns = docs.columns
    rows = keyed(docs, size, quality, seed, id_col, text_col).withColumn("grain_key", scaled(F.col("grain_draw"), F.col("grain_quality")))
    slim = stored(rows.select(F.col(source_col).cast("string").alias("source"), "grain_size", "grain_key"), "keys")
    out = decided(rows, cuts(slim, **shares), F.col(source_col).cast("string")).where("grain_epochs > 0")
    return out.withColumn("grain_copy", F.explode(F.sequence(F.lit(1), F.col("grain_epochs").cast("int")))).select(*columns)
