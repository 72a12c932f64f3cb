"""Leakage-safe splits: whole clusters, filled by quota in a random or temporal order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.lineage import materialize
from corpusloom.plans.skew import lookup_join

SPLITS = ("train", "dev", "calib", "test")


@dataclass(frozen=True)
class SplitConfig:
    fractions: tuple[float, float, float, float] = (0.70, 0.10, 0.10, 0.10)
    mode: str = "random"
    group: str = "dup_cluster"
    date: str = "date"
    seed: int = 7

    def check(self, columns: list[str]) -> None:
        if len(self.fractions) != len(SPLITS) or abs(sum(self.fractions) - 1) > 1e-9:
            raise ValueError("four fractions that sum to 1 are needed")
        if self.mode not in ("random", "temporal"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.group not in columns:
            raise ValueError(f"no column {self.group}: run dedup first")
        if self.mode == "temporal" and self.date not in columns:
            raise ValueError(f"no column {self.date}")


def _running(groups: DataFrame, bucket: Column, order: list[Column]) -> DataFrame:
    """groups with cum, the running sum of size in the order of bucket and then ``order``.

    Sums of buckets are few (hash prefixes, days), and a bucket's own running
    sum is one task's work, so no window spans the whole table.
    """
    g = materialize(groups.withColumn("bucket", bucket), "groups")
    sums = g.groupBy("bucket").agg(F.sum("size").alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(Window.orderBy("bucket")) - F.col("_s")).select("bucket", "_before")
    inside = F.sum("size").over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return g.withColumn("_in", inside).join(F.broadcast(before), "bucket").withColumn("cum", F.col("_in") + F.col("_before")).drop("_in", "_before", "bucket")


def assign_splits(df: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """df with ``split``; rows of one group share it, rows without a group have none.

    Groups are walked in order of md5(seed:group), or of their smallest date
    (groups without a date last), and each split is filled until its quota is
    reached; what overshoots does not count for the next.  The walk is a closed
    form over the running sum: the first split ends at the first sum of at
    least its quota, each next one at the first sum its own quota further.
    """
    cfg.check(df.columns)
    g = df.where(F.col(cfg.group).isNotNull()).groupBy(F.col(cfg.group).alias("g"))
    if cfg.mode == "random":
        groups = g.agg(F.count(F.lit(1)).alias("size")).withColumn("k", F.md5(F.concat(F.lit(f"{cfg.seed}:"), F.col("g").cast("string"))))
        run = _running(groups, F.substring("k", 1, 3), [F.col("k"), F.col("g")])
    else:
        groups = g.agg(F.count(F.lit(1)).alias("size"), F.min(cfg.date).alias("k"))
        run = _running(groups, F.coalesce(F.to_date("k"), F.lit("9999-12-31").cast("date")), [F.col("k").asc_nulls_last(), F.col("g")])
    run = materialize(run, "run")
    total = run.agg(F.sum("size").alias("t"))
    ends = total
    for i, f in enumerate(cfg.fractions[:3]):
        start = F.col(f"c{i - 1}") if i else F.lit(0).cast("bigint")
        quota = F.lit(float(f)) * F.col("t")
        point = run.select("cum").union(run.sparkSession.createDataFrame([(0,)], "cum bigint"))
        hit = point.crossJoin(F.broadcast(ends)).where((F.col("cum") >= start) & (F.col("cum") - start >= quota)).agg(F.min("cum").alias(f"c{i}"))
        ends = ends.crossJoin(hit).withColumn(f"c{i}", F.coalesce(f"c{i}", F.lit(2**62)))
    e = F.col("cum") - F.col("size")
    split = F.when(e < F.col("c0"), "train").when(e < F.col("c1"), "dev").when(e < F.col("c2"), "calib").otherwise("test")
    placed = run.crossJoin(F.broadcast(ends)).select(F.col("g").alias(cfg.group), split.alias("split"), F.col("size").alias("_rows"))
    return lookup_join(df.drop("split"), placed, cfg.group, "left", rows=total.first()[0] or 0, weight="_rows").select(*[c for c in df.columns if c != "split"], "split")


def split_report(df: DataFrame, group: str = "dup_cluster", label: str = "label", split: str = "split") -> DataFrame:
    """(split, n_docs, n_clusters, majority_share, n_classes) of all four splits; an empty one has a NaN share."""
    names = df.sparkSession.createDataFrame([(s,) for s in SPLITS], f"`{split}` string")
    main = df.groupBy(split).agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct(group).alias("n_clusters"), F.count_distinct(label).alias("n_classes"), F.count(label).alias("_l"))
    top = df.where(F.col(label).isNotNull()).groupBy(split, label).agg(F.count(F.lit(1)).alias("n")).groupBy(split).agg(F.max("n").alias("_top"))
    out = names.join(main, split, "left").join(top, split, "left").na.fill(0, ["n_docs", "n_clusters", "n_classes"])
    share = F.round(F.coalesce(F.try_divide("_top", "_l"), F.lit(float("nan"))), 6)
    return out.select(split, "n_docs", "n_clusters", share.alias("majority_share"), "n_classes")


def label_pivot(df: DataFrame, label: str = "label_name", split: str = "split") -> DataFrame:
    """Rows of each label by split; a missing cell is 0."""
    return df.groupBy(label).pivot(split, list(SPLITS)).agg(F.count(F.lit(1))).na.fill(0, list(SPLITS))


def split_support(pivot: DataFrame, least: int = 10) -> DataFrame:
    """(absent_in_dev, with_least_in_dev): classes without a row in dev, and with ``least`` or more."""
    return pivot.agg(F.count_if(F.col("dev") == 0).alias("absent_in_dev"), F.count_if(F.col("dev") >= least).alias("with_least_in_dev"))


def straddling(df: DataFrame, group: str, split: str) -> DataFrame:
    """(groups, straddling, rows_straddling): how many groups lie in two splits or more."""
    n = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(split).alias("s"), F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("s") > 1).alias("straddling"), F.coalesce(F.sum(F.when(F.col("s") > 1, F.col("n"))), F.lit(0)).alias("rows_straddling"))
