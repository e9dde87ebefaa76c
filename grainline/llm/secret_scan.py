"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Three patterns find candidates (base spans). The hash of every candidate value is then counted over distinct owners and
distinct repositories of the whole corpus. A value that ``example_owners`` owners or ``example_repositories`` repositories
or more share is a copied example; any other is owner-specific, ``live`` if it looks like a credential and ``weak`` if not.
Each candidate adds a span of its value with that verdict; the base spans stay. Positions are code points: the text is split at the matches, and the lengths of gaps and matches are summed.

A null text is empty; a null owner is an owner of its own; repeated rows get equal results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.llm.common import stored

#: Kind, pattern, the group that is the value, and least characters of that value.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
ORDER = ("assign", "access", "hex", "live", "example", "weak")
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 20
#: What a value that looks live has: so many distinct characters, a letter, a digit, and none of these words.
DISTINCT, FILLER = 6, "(?i)example|sample|dummy|placeholder|change|your|test|foobar|secret|password|xxxx|0000|1234|abcd"
#: Matches that are summed one by one; sums of such runs are summed again.
RUN = 128
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """The pattern's matches with values of at least so many characters.

    Runs that can't hold a long enough value don't change later matches where the pattern is one greedy class, so there
    the class gets the length as its least count.
    """
    if group == 0:
        head, tail = pattern[:-1], "{%d,}" % (least - 4 if pattern.startswith("AKIA") else least)
        pattern = head + tail
    pat = F.lit(pattern)
    whole, values, gaps = F.regexp_extract_all(text, pat, F.lit(0)), F.regexp_extract_all(text, pat, F.lit(group)), F.split(text, pattern, -1)
    each = F.arrays_zip(F.transform(whole, lambda x: F.length(x)).alias("m"), values.alias("v"), F.transform(F.slice(gaps, 1, F.size(whole)), lambda x: F.length(x)).alias("g"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / RUN)), lambda i: F.slice(each, (i * RUN + 1).cast("int"), RUN))
    nothing = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        end = acc["pos"] + x["g"] + x["m"]
        found = F.struct((end - x["m"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value"))
        return F.struct(end.alias("pos"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    def join(acc: Column, run: Column) -> Column:
        own = F.aggregate(run, F.struct(acc["pos"].alias("pos"), nothing.alias("out")), step)
        return F.struct(own["pos"].alias("pos"), F.concat(acc["out"], own["out"]).alias("out"))

    folded = F.aggregate(runs, F.struct(F.lit(0).alias("pos"), nothing.alias("out")), join)["out"]
    return F.when(text.rlike(pattern), folded).otherwise(nothing)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    return F.array_sort(F.concat(*[_spans(text, k, pattern, group, least) for k, (_, pattern, group, least) in enumerate(PATTERNS)]))


def looks_live(value: Column) -> Column:
    """Whether a value looks drawn at random rather than typed as a filler."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT) & value.rlike("[A-Za-z]") & value.rlike("[0-9]") & ~value.rlike(FILLER)


def ownership(candidates: DataFrame) -> DataFrame:
    """candidates (hash, owner, repository): hash, owners, repositories. Partial sums first, so a hot hash is one row a task."""
    pairs = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owned = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return owned.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_weak, ownership
    (start:end:owners:repositories of the values, comma-joined by start and end)."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository"), base_spans(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("base"),
    )
    rows = stored(rows, "spans")
    none = rows.where(F.size("base") == 0).withColumn("added", F.array().cast(SPAN)).withColumn("ownership", F.lit(""))
    hits = rows.where(F.size("base") > 0).withColumn("key", F.sha2(F.to_json(F.struct("doc_id", "owner", "repository", "base")), 256))
    found = hits.dropDuplicates(["key"]).select("key", "owner", "repository", F.explode("base").alias("s"))
    found = stored(found.select("key", "owner", "repository", F.sha2("s.value", 256).alias("hash"), looks_live(F.col("s.value")).alias("looks"), (F.col("s.end") - F.length("s.value")).alias("start"), F.col("s.end").alias("end")).distinct(), "candidates")
    shared = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    verdict = F.when(shared, ORDER.index("example")).when(F.col("looks"), ORDER.index("live")).otherwise(ORDER.index("weak"))
    known = F.struct("start", "end", "owners", "repositories")
    judged = found.join(ownership(found), "hash").select("key", F.struct("start", verdict.alias("kind"), "end", F.lit("").alias("value")).alias("s"), known.alias("o"))
    added = judged.groupBy("key").agg(F.collect_list("s").cast(SPAN).alias("added"), F.array_sort(F.collect_list("o")).alias("owned"))
    owned = F.array_join(F.transform("owned", lambda o: F.concat_ws(":", *[o[x].cast("string") for x in ("start", "end", "owners", "repositories")])), ",")
    added = added.select("key", "added", owned.alias("ownership"))
    everything = none.unionByName(hits.join(added, "key").drop("key"))
    count = lambda spans, name: F.size(F.filter(spans, lambda s: s["kind"] == ORDER.index(name))).cast("long")
    return everything.select(
        "doc_id", *[count("base", k).alias(f"n_{k}") for k in ORDER[:3]], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"), *[count("added", k).alias(f"n_{k}") for k in ORDER[3:]], "ownership",
    )
