"""Samples with target category shares: raked weights, exponential keys, minimums, gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.lineage import materialize

_BUCKETS = 4096
#: Rates of more cells than this are joined by a shuffle instead of sent to every task.
_CELLS = 100_000


def rake(counts: np.ndarray, rows: np.ndarray, cols: np.ndarray, rounds: int = 200, tol: float = 1e-9) -> np.ndarray:
    """Iterative proportional fitting of ``counts`` (categories x groups) to row sums ``rows`` and column shares ``cols``.

    No cell exceeds its count, as rows are drawn without replacement; row sums
    are met last, so where the caps and margins contradict each other the
    category targets win as far as the rows allow.
    """
    want = np.minimum(rows, counts.sum(1))
    x = counts * np.divide(want, counts.sum(1), out=np.zeros(len(want)), where=counts.sum(1) > 0)[:, None]
    share = cols / cols.sum() if cols.sum() else cols
    for _ in range(rounds):
        old = x.copy()
        have = x.sum(0)
        x = np.minimum(x * np.divide(share * x.sum(), have, out=np.ones(len(have)), where=have > 0), counts)
        for _ in range(20):
            have = x.sum(1)
            room = np.where(x < counts, x, 0).sum(1)
            fixed = have - room
            scale = np.divide(want - fixed, room, out=np.ones(len(want)), where=room > 0)
            x = np.where(x < counts, np.minimum(x * scale[:, None], counts), x)
            if np.abs(x.sum(1) - want).max(initial=0) < tol:
                break
        if np.abs(x - old).max(initial=0) < tol:
            break
    return x


class TargetSample:
    """A sample of each split whose category shares follow targets and keep minimums, and what could not be met.

    rows needs the columns ``split`` (cleaned), ``category`` and ``group`` (a
    second margin, the source) beside the key; rows without split or category
    are not drawn.  n of a split is the share 1 / ``part`` of its rows with a
    category, rounded down; a target needs the larger of min_rows and
    permille * n / 1000 rounded up.

    Weights come from raking the table of counts by category and group to the
    category targets and to the groups' own shares of the split.  Rows are drawn
    by weighted exponential keys -ln(u) / w, u from the key's hash; where a
    minimum exceeds the share, the next smallest keys fill it up.  The k-th key
    is found by a histogram, and only its bucket is sorted, so a category may
    hold any share of the rows.

    The table of counts by category and group of one split is raked in one task:
    margins have few values, whatever the rows' number.

    A null group is a group of its own, a null target counts as 0; a target
    given twice counts with the larger need.  Rows of one key are drawn alike.
    """

    def __init__(self, rows: DataFrame, targets: DataFrame, key: str, part: int = 5, seed: int = 5):
        self.key, self.seed = key, seed
        self.rows = materialize(
            rows.where("split is not null and category is not null").select(F.col(key).alias("key"), "split", "category", F.coalesce("group", F.lit("")).alias("group")), "rows"
        )
        cells = materialize(self.rows.groupBy("split", "category", "group").agg(F.count(F.lit(1)).alias("rows")), "cells")
        n = cells.groupBy("split").agg(F.floor(F.sum("rows") / part).alias("n"))
        need = targets.select("split", F.col("label_name").alias("category"), F.coalesce("target_permille", F.lit(0)).alias("permille"), F.coalesce("min_rows", F.lit(0)).alias("least")).join(n, "split", "left").na.fill(0, ["n"])
        need = need.withColumn("share", F.floor((F.col("permille") * F.col("n") + 999) / 1000)).withColumn("need", F.greatest("share", F.col("least").cast("bigint")))
        need = need.groupBy("split", "category").agg(F.max(F.struct("need", "share", "permille", "least")).alias("x")).select("split", "category", "x.*")
        available = cells.groupBy("split", "category").agg(F.sum("rows").alias("available"))
        self.needs = materialize(need.join(available, ["split", "category"], "left").na.fill(0, ["available"]), "needs")

        schema = "split string, category string, `group` string, rate double"

        def raked(pdf: pd.DataFrame) -> pd.DataFrame:
            t = pdf.pivot_table(index="category", columns="group", values="rows", aggfunc="sum", fill_value=0)
            want = pdf.groupby("category")["need"].first().reindex(t.index).fillna(0).to_numpy(float)
            counts = t.to_numpy(float)
            x = rake(counts, want, counts.sum(0))
            rate = np.divide(x, counts, out=np.zeros_like(x), where=counts > 0)
            out = pd.DataFrame(rate, index=t.index, columns=t.columns).stack().rename("rate").reset_index()
            out.insert(0, "split", pdf["split"].iloc[0])
            out.columns = ["split", "category", "group", "rate"]
            return out[out["rate"] > 0]

        joined = cells.join(self.needs.select("split", "category", "need"), ["split", "category"], "left")
        self.rates = materialize(joined.groupBy("split").applyInPandas(raked, schema), "rates")

    def drawn(self) -> DataFrame:
        """(key, split, category, reason) of the drawn rows; reason is share, or minimum for a row that only the minimum asks for."""
        reason = F.when(F.col("rank") <= F.col("share"), "share").otherwise("minimum").alias("reason")
        return self._chosen().select(F.col("key").alias(self.key), "split", "category", reason)

    def _chosen(self) -> DataFrame:
        u = (F.xxhash64(F.lit(self.seed), F.col("key").cast("string")).bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))
        needs = self.needs.where("need > 0 and available > 0")
        # keys in units of the category's mean rate spread over the buckets whatever the rates are
        mean = F.least(F.col("need") / F.col("available"), F.lit(1.0))
        rates = F.broadcast(self.rates) if self.rates.count() <= _CELLS else self.rates
        keyed = self.rows.join(rates, ["split", "category", "group"]).join(F.broadcast(needs.select("split", "category", "need", "share", mean.alias("mean"))), ["split", "category"])
        e = -F.log(u) * F.col("mean") / F.col("rate")
        keyed = keyed.withColumn("e", e).withColumn("bucket", F.floor((1 - F.exp(-F.col("e"))) * _BUCKETS).cast("int"))
        counts = keyed.groupBy("split", "category", "bucket", "need").agg(F.count(F.lit(1)).alias("here"))
        upto = F.sum("here").over(Window.partitionBy("split", "category").orderBy("bucket"))
        cut = materialize(counts.withColumn("upto", upto).where(F.col("upto") - F.col("here") < F.col("need")).select("split", "category", "bucket", (F.col("upto") - F.col("here")).alias("before")), "cut")
        near = keyed.join(cut, ["split", "category", "bucket"])
        rank = F.col("before") + F.row_number().over(Window.partitionBy("split", "category", "bucket").orderBy("e", "key"))
        return near.withColumn("rank", rank).where("rank <= need")

    def report(self) -> DataFrame:
        """(split, label_name, target_permille, min_rows, need, available, drawn, gap) of every target.

        drawn is counted from the rows of the sample; the gap is what the sample
        lacks of the need.
        """
        got = self.drawn().groupBy("split", "category").agg(F.count(F.lit(1)).alias("drawn"))
        out = self.needs.join(got, ["split", "category"], "left").na.fill(0, ["drawn"])
        return out.select(
            "split", F.col("category").alias("label_name"), F.col("permille").alias("target_permille"), F.col("least").alias("min_rows"), "need", "available", "drawn", (F.col("need") - F.col("drawn")).alias("gap")
        )

    def margins(self) -> DataFrame:
        """(split, group, rows, drawn, share_permille, drawn_permille, residual_permille): how far the groups' shares of the sample are from their shares of the split.

        A residual remains where the categories' targets and the groups' shares
        contradict each other; a null group is written as the empty one.
        """
        got = self._chosen().groupBy("split", "group").agg(F.count(F.lit(1)).alias("drawn"))
        by = self.rows.groupBy("split", "group").agg(F.count(F.lit(1)).alias("rows")).join(got, ["split", "group"], "left").na.fill(0, ["drawn"])
        share = lambda c: F.round(F.try_divide(F.col(c) * 1000.0, F.sum(c).over(Window.partitionBy("split"))), 3)
        out = by.withColumns({"share_permille": share("rows"), "drawn_permille": share("drawn")})
        return out.withColumn("residual_permille", F.round(F.col("drawn_permille") - F.col("share_permille"), 3))
