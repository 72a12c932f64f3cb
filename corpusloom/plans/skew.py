"""Lookup joins that keep hot keys away from the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one row in HOT_SHARE, so that there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 512
#: A table of fewer rows is joined as it is: no key of it can fill a task.
LOOKUP_ROWS = 100_000


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None, weight: str | None = None) -> DataFrame:
    """left joined with right, whose ``key`` is unique; left is read more than once, so pass a written table.

    Keys holding more than 1/512 of left's rows number fewer than 512, whatever
    the data: their rows of right are broadcast (a proven bound) and the rest
    is joined by an ordinary shuffle, which has no hot key left.  ``weight``
    names a column of right with the number of left's rows of the key, which
    saves counting them; it does not come out.
    """
    n = left.count() if rows is None else rows
    bare = right.drop(weight) if weight else right
    if n < LOOKUP_ROWS:
        return left.join(bare, key, how)
    counts = right.select(key, F.col(weight).alias("count")) if weight else left.groupBy(key).count()
    hot = [r[0] for r in counts.where((F.col("count") > n // HOT_SHARE) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return left.join(bare, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    top = left.where(is_hot).join(F.broadcast(bare.where(F.col(key).isin(hot))), key, how)
    return top.unionByName(left.where(~is_hot).join(bare.where(~F.col(key).isin(hot)), key, how))
