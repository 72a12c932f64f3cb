"""Cleaning of loosely spelled splits, categories and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def plain(c: Column) -> Column:
    """Lower case without surrounding blanks."""
    return F.lower(stripped(c))


def with_split(df: DataFrame, aliases: DataFrame, split: str = "split", to: str = "side") -> DataFrame:
    """df with the split that the alias table (a small fixed vocabulary) gives to its spelling; null without an entry."""
    table = aliases.select(F.col("alias").alias("_alias"), F.col("split").alias(to)).where("_alias is not null").dropDuplicates(["_alias"])
    return df.drop(to).join(F.broadcast(table), plain(F.col(split)) == F.col("_alias"), "left").drop("_alias")


def with_category(df: DataFrame, names: DataFrame, label: str = "label", name: str = "label_name", to: str = "category") -> DataFrame:
    """df with the name of its label; where the label is null, the name equal to its own but for case and blanks."""
    same = lambda c: F.regexp_replace(plain(c), r"(?U)\s+", " ")
    by_id = names.select(F.col("label").alias("_label"), F.col("label_name").alias("_by_id")).dropDuplicates(["_label"])
    by_name = names.select(same(F.col("label_name")).alias("_name"), F.col("label_name").alias("_by_name")).where("_name is not null").dropDuplicates(["_name"])
    out = df.drop(to).join(F.broadcast(by_id), F.col(label) == F.col("_label"), "left").join(F.broadcast(by_name), F.col(label).isNull() & (same(F.col(name)) == F.col("_name")), "left")
    return out.withColumn(to, F.coalesce("_by_id", "_by_name")).drop("_label", "_by_id", "_name", "_by_name")
