"""Table scans, sinks, sizes, the vector table, and model artifacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import content_id


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A parquet table, of which only the named columns are read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A scan of a table of too few files to keep the session's cores busy, dealt out evenly; any other scan as it is.

    Only a table of less than a few megabytes a core is ever shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """table(), spread for work on its texts."""
    return spread(table(spark, folder, name, *columns))


def corpus(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """A labelled corpus with the content id of each text."""
    return spark.read.parquet(path).withColumn("content_id", content_id(F.col(text)))


def save(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def folder_size_mb(spark: SparkSession, path: str) -> float:
    """Megabytes of a file or folder on any file system Spark knows; NaN if absent."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() / 2**20 if fs.exists(p) else float("nan")


def vector_table(spark: SparkSession, rows: list[tuple[str, list[float]]], view: str) -> DataFrame:
    """A temporary table (id, label, embedding), numbered from 1 in order; spark.catalog.dropTempView removes it."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "id int, label string, embedding array<float>")
    df.createOrReplaceTempView(view)
    return df


def save_model(model, path: str, manifest: dict) -> None:
    """A fitted model and, beside it, what it was fitted on and scored."""
    spark = SparkSession.active()
    model.save(f"{path}/model", spark)
    text = json.dumps(manifest, sort_keys=True, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_model(path: str):
    """(model, manifest), or (None, None) where nothing was saved."""
    from corpusloom.operators.classify import Model

    spark = SparkSession.active()
    if folder_size_mb(spark, path) != folder_size_mb(spark, path):
        return None, None
    text = "\n".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect())
    return Model.load(f"{path}/model", spark), json.loads(text)
