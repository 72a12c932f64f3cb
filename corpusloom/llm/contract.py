"""Connected groups of records by randomised graph contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.components import at_once
from corpusloom.plans.lineage import counted, materialize, release
from corpusloom.plans.skew import lookup_join


def contracted(edges: DataFrame, a: str, b: str, seed: int = 17, max_rounds: int = 200, tail: int = 0) -> DataFrame:
    """(id, group) for every id that an edge (a, b) between different ids links; group is the smallest id linked to it.

    Each round every vertex hooks to the neighbour (or itself) that comes first
    in a fresh hash order, the edges are relabelled and deduplicated and loops
    dropped; when no edge is left the rounds' mappings are expanded from the
    last to the first.  A round removes a constant share of the vertices on
    average, whatever the graph's shape: chains need O(log n) rounds.

    Once at most ``tail`` edges are left, one task takes them together: that
    bounds its memory, and the rounds' jobs are only run while they do work.

    Edges with a null end or equal ends link nothing; an id of such edges alone
    has no row.  Repeated and reversed edges count once.  No edges give no rows.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both, n = counted(e.union(e.select("b", "a")).distinct(), "edges")
    maps: list[DataFrame] = []
    while n > tail:
        if len(maps) >= max_rounds:
            raise RuntimeError("no end of contraction")
        fresh = F.lit(seed * 1_000_003 + len(maps))
        order = lambda c: F.struct(F.xxhash64(fresh, c).alias("h"), c.alias("x"))  # noqa: B023, E731
        hook = (
            both.groupBy(F.col("a").alias("v"))
            .agg(F.min(order(F.col("b"))).alias("m"))
            .select("v", F.when(order(F.col("v")) < F.col("m"), F.col("v")).otherwise(F.col("m").getField("x")).alias("r"))
        )
        hook = materialize(hook, "hook")
        half = lookup_join(both, hook.select(F.col("v").alias("a"), F.col("r").alias("ra")), "a", rows=n).select("b", "ra")
        if n >= 100_000:  # the next lookup reads it more than once
            half = materialize(half, "half")
        whole = lookup_join(half, hook.select(F.col("v").alias("b"), F.col("r").alias("rb")), "b", rows=n)
        nxt, n = counted(whole.select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct(), "edges")
        release(both, half)
        both = nxt
        maps.append(hook)
    if n:
        maps.append(materialize(at_once(both).toDF("v", "r"), "tail"))
    release(both)
    if not maps:
        return e.select(F.col("a").alias("id"), F.col("a").alias("group"))
    done = maps.pop()
    labels = done.select(F.col("v").alias("id"), F.col("r").alias("rep"))
    while maps:
        up = labels.select(F.col("id").alias("r"), F.col("rep"))
        m = maps.pop()
        labels = materialize(lookup_join(m, up, "r", "left").select(F.col("v").alias("id"), F.coalesce("rep", "r").alias("rep")), "labels")
        release(m, done)
        done = labels
    least = labels.groupBy("rep").agg(F.min("id").alias("group"))
    return lookup_join(labels, least, "rep").select("id", "group")


def match_groups(pairs: DataFrame, a: str = "doc_id_a", b: str = "doc_id_b", matched: str = "is_match") -> DataFrame:
    """(doc_id, dup_cluster) of all ids that a pair with ``matched`` true links to a different id.

    Ids are compared in lower case without surrounding white space; dup_cluster
    is the smallest id of the group as a string.  Null or blank ids, null and
    false verdicts, and self pairs link nothing, whatever other rows say.
    """
    clean = lambda c: F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))
    e = pairs.where(F.col(matched)).select(clean(a).alias("a"), clean(b).alias("b"))
    return contracted(e, "a", "b").select(F.col("id").alias("doc_id"), F.col("group").alias("dup_cluster"))
