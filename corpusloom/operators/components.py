"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.lineage import materialize, release
from corpusloom.plans.skew import LOOKUP_ROWS, lookup_join


#: Edges that one task takes together; more go through rounds of star steps.
TAIL = 500_000


def least_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the numbers under n that each is linked to by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        while (low[low] != low).any():
            low = low[low]
        if (low == root).all():
            return root
        root = low


def at_once(edges: DataFrame) -> DataFrame:
    """(id, root) of every end of the edges (two columns of one type, no nulls), found in one task; root is the smallest id linked to it."""
    a, b = edges.columns
    kind = edges.schema[a].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, ids = pd.factorize(pd.concat([pdf[a], pdf[b]], ignore_index=True), sort=True)
        half = len(pdf)
        return pd.DataFrame({"id": ids, "root": np.asarray(ids)[least_linked(codes[:half], codes[half:], len(ids))]})

    return edges.groupBy(F.lit(1).alias("_one")).applyInPandas(run, f"id {kind}, root {kind}")


def _print(e: DataFrame) -> tuple:
    """The number of edges and two sums of hashes, which differ for different sets of edges."""
    return tuple(e.agg(F.count(F.lit(1)), *(F.sum(F.xxhash64(F.lit(i), "u", "v").cast("decimal(38,0)")) for i in (1, 2))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, tail: int = TAIL) -> DataFrame:
    """(id, root) of every id of an edge between different ids; root is the smallest id it is linked to.

    Every round hangs a vertex's larger neighbours, then its smaller ones, on
    the smallest of them (Kiveris et al. 2014); edges never grow in number and
    a fixed star forest ends it.  At most ``tail`` edges are taken together in
    one task.  Null ends and loops are ignored.
    """
    e = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    if e.count() <= tail:
        return at_once(e)
    now = _print(e)
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
        large = lookup_join(both, low, "u", rows=2 * now[0], weight="_n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large") if now[0] >= LOOKUP_ROWS else large
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
        small = lookup_join(large, least, "u", rows=now[0], weight="_n").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        nxt = materialize(small.where("u <> v").distinct(), "star")
        release(e)
        e, was, now = nxt, now, _print(nxt)
        if now == was:
            break
    else:
        raise RuntimeError("no fixed point of the star steps")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
