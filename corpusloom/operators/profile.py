"""Describing a corpus: lengths, class shares, cluster sizes, differences of clusterings."""

from __future__ import annotations

import resource
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import word_count


def describe_words(df: DataFrame, text: str = "text") -> DataFrame:
    """(n, mean, std, min, q25, q50, q75, max) of the word counts of non-null texts; quartiles interpolate linearly."""
    w = df.where(F.col(text).isNotNull()).select(word_count(F.col(text)).alias("w"))
    q = lambda p: F.percentile("w", p)
    return w.agg(
        F.count("w").alias("n"), F.round(F.avg("w"), 6).alias("mean"), F.round(F.stddev_samp("w"), 6).alias("std"), F.min("w").alias("min"),
        q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("w").alias("max"),
    )


def short_docs(df: DataFrame, key: str, text: str = "text", under: int = 10) -> DataFrame:
    """(key, words) of non-null texts with fewer words."""
    return df.where(F.col(text).isNotNull()).select(key, word_count(F.col(text)).alias("words")).where(F.col("words") < under)


def class_share(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share) of non-null labels."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = n.agg(F.sum("n").alias("_all"))
    return n.crossJoin(F.broadcast(whole)).select(label, "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


def cluster_sizes(clusters: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(size, clusters): how many clusters have each size."""
    return clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


def duplicate_rate(clusters: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(docs, clusters, clustered_docs, rate, largest): rows in a cluster of two or more."""
    n = clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    out = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("clustered_docs"), F.max("n").alias("largest"))
    return out.withColumn("rate", F.round(F.try_divide("clustered_docs", "docs"), 6))


def canonical_partition(clusters: DataFrame, key: str, cluster: str = "cluster_id") -> DataFrame:
    """(key, head): the smallest key of each row's cluster, so that equal partitions are equal tables."""
    head = clusters.groupBy(cluster).agg(F.min(key).alias("head"))
    return clusters.join(head, cluster).select(key, "head")


def partition_diff(x: DataFrame, y: DataFrame, key: str) -> DataFrame:
    """(key, head_x, head_y) of rows that two clusterings place differently; empty for equal partitions."""
    a, b = (canonical_partition(c, key).withColumnRenamed("head", f"head_{s}") for c, s in ((x, "x"), (y, "y")))
    return a.join(b, key, "full_outer").where(~F.col("head_x").eqNullSafe(F.col("head_y")))


def peak_mb(spark) -> float:
    """Megabytes of memory that the driver's program and its JVM's heap have taken at most so far."""
    pools = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    return round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024 + sum(p.getPeakUsage().getUsed() for p in pools) / 2**20, 1)


def phases(df: DataFrame, key: str, text: str) -> DataFrame:
    """(phase, seconds, docs_per_sec, share, clusters, largest, peak_mb) of clustering by bands: hashing, then linking and numbering.

    Each phase is run to its end and written; share is its part of the time.
    """
    from corpusloom.operators import neardup
    from corpusloom.operators.components import components
    from corpusloom.plans.lineage import materialize

    spark = df.sparkSession
    docs = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).count()
    began = time.time()
    edges = materialize(neardup.text_edges(df, key, text, *neardup.band_shape(0.8, 128)), "edges")
    hashed = time.time() - began
    began = time.time()
    roots = materialize(components(edges), "roots")
    linked = time.time() - began
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.max("n"), F.lit(1)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    found, peak = docs - sizes["rows"] + sizes["k"], peak_mb(spark)
    rows = [(n, round(t, 3), round(docs / max(t, 1e-9), 1), round(t / max(hashed + linked, 1e-9), 4), found, sizes["most"], peak) for n, t in (("signatures and bands", hashed), ("linking", linked))]
    return spark.createDataFrame(rows, "phase string, seconds double, docs_per_sec double, share double, clusters bigint, largest bigint, peak_mb double")
