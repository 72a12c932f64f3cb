"""Exact-size samples, exclusions, numbering and label merges, all in portable hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 7) -> DataFrame:
    """The n rows (all, if fewer) that come first by md5(seed:key); a top-k, not a global sort."""
    return df.orderBy(hash_order(seed, key), key).limit(n)


def numbered(df: DataFrame, order: list[Column], start: int = 0, width: int = 3, to: str = "doc_index") -> DataFrame:
    """A sample (a bounded number of rows) numbered from start, padded with zeros to width."""
    n = F.row_number().over(Window.orderBy(*order)) - 1 + start
    return df.withColumn(to, F.lpad(n.cast("string"), width, "0"))


def excluding(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the seen ones; a null key is not seen."""
    return df.join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def merge_labels(df: DataFrame, merges: dict[str, str], label: str, to: str = "merged") -> DataFrame:
    """Labels replaced once by the map; others stay."""
    if not merges:
        return df.withColumn(to, F.col(label))
    table = F.create_map(*(F.lit(x) for kv in merges.items() for x in kv))
    return df.withColumn(to, F.coalesce(F.try_element_at(table, F.col(label)), F.col(label)))


def random_merges(df: DataFrame, label: str, pairs: int = 6, seed: int = 7) -> DataFrame:
    """(from_label, to_label): 2 * pairs of the distinct labels in hash order, paired one after another."""
    labels = df.where(F.col(label).isNotNull()).select(label).distinct()
    top = labels.orderBy(hash_order(seed, label), label).limit(2 * pairs)
    place = F.row_number().over(Window.orderBy(hash_order(seed, label), label)) - 1
    top = top.withColumn("i", place)
    return top.groupBy(F.floor(F.col("i") / 2).alias("p")).agg(F.max_by(label, "i").alias("from_label"), F.min_by(label, "i").alias("to_label"), F.count(F.lit(1)).alias("n")).where("n = 2").select("from_label", "to_label")


def chunked(df: DataFrame, key: str, n: int, to: str = "chunk") -> DataFrame:
    """df with the number of its slice: contiguous in order of the unique key, each of ceil(rows / n) rows but the last, so maybe fewer than n."""
    from corpusloom.operators.neardup import dense_ids

    if n < 1:
        raise ValueError("at least one chunk")
    size = max(1, -(-df.count() // n))
    place = dense_ids(df.select(key, F.col(key).alias("_at")), key, "_at").select(key, F.floor(F.col("cluster_id") / size).cast("int").alias(to))
    return df.join(place, key)
