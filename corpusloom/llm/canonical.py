"""Records that differ only in white space, case, punctuation or the order of their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.llm.blocks import SHARD, repeats
from corpusloom.plans.lineage import materialize
from corpusloom.plans.skew import lookup_join


def canonical(text: Column) -> Column:
    """The multiset of a record's pieces as one string; null for a record without pieces.

    Pieces lie between line feeds and bars, in lower case and only with their
    letters and digits; empty pieces do not count.
    """
    piece = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")
    pieces = F.filter(F.transform(F.split(text, r"[\n|]"), piece), lambda p: p != "")
    return let(F.array_join(F.array_sort(pieces), "\n"), lambda s: F.when(s != "", s))


def collapsed(df: DataFrame, key: str = "record_id", text: str = "text", max_bytes: int = SHARD) -> DataFrame:
    """(key, keep, copies) for every row: the smallest key of its set of copies, and the set's size.

    Canonical forms are hashed in the JVM.  Only rows that may have a copy, by
    blocks.repeats, are shuffled for exact grouping; the others are singletons.
    A set may hold any share of the rows: groups are pre-aggregated and hot ones
    looked up by broadcast.  Rows without pieces (null, empty, punctuation only)
    are singletons, never each other's copies.
    """
    form = let(canonical(F.col(text)), lambda c: F.struct(F.md5(c.cast("binary")).alias("h"), F.when(c.isNotNull(), F.xxhash64(c)).alias("short")))
    hashed = materialize(df.select(F.col(key).alias("key"), form.alias("f")).select("key", "f.h", "f.short"), "hashes")
    real = hashed.where("h is not null")
    probed = materialize(repeats(real, "short", real.count(), max_bytes).select("key", "h", "maybe"), "probed")
    maybe = probed.where("maybe").select("key", "h")
    sets = materialize(maybe.groupBy("h").agg(F.min("key").alias("keep"), F.count(F.lit(1)).alias("copies")), "sets")
    single = probed.where("not maybe").select("key").union(hashed.where("h is null").select("key"))
    return (
        lookup_join(maybe, sets, "h")
        .select("key", "keep", "copies")
        .union(single.select("key", "key", F.lit(1).cast("bigint")))
        .withColumnsRenamed({"key": key})
    )
