"""Streams of documents: stateless extraction, and near-duplicates against what came before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.patterns import DEFINED_TERM, GOVERNING_LAW
from corpusloom.operators.entities import captures
from corpusloom.operators.neardup import band_keys, band_shape, signatures


def entity_stream(docs: DataFrame, key: str = "clause_id", text: str = "text") -> DataFrame:
    """(key, label, entity) of a stream of documents, in the JVM and without state."""

    def labelled(label: str, pattern: str) -> Column:
        return F.transform(captures(F.col(text), pattern), lambda e: F.struct(F.lit(label).alias("label"), e.alias("entity")))

    found = F.concat(labelled("GOVERNING_LAW", GOVERNING_LAW), labelled("DEFINED_TERM", DEFINED_TERM))
    return docs.select(key, F.explode(found).alias("x")).select(key, "x.label", "x.entity")


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, by, n) of tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


class IncrementalDedup:
    """Band keys of all documents so far, as a table; each batch is linked to it and added to it.

    A document's candidates are the smallest earlier id of every bucket it
    falls into and of those within its batch.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "clause_id", text: str = "text", threshold: float = 0.8, perms: int = 128, k: int = 5):
        self.spark, self.path, self.key, self.text, self.k = spark, path, key, text, k
        self.bands, self.rows = band_shape(threshold, perms)

    def keys(self, df: DataFrame) -> DataFrame:
        return band_keys(signatures(df, self.key, self.text, self.bands * self.rows, self.k, distinct=False), self.bands, self.rows)

    def batch(self, df: DataFrame, number: int) -> None:
        """Link one batch: writes path/links and path/keys under the batch's number, so that a repeated batch replaces itself."""
        new = self.keys(df).persist()
        old = self._old(number)
        heads = new.unionByName(old).groupBy("band", "bucket").agg(F.min("id").alias("a"))
        links = new.join(heads, ["band", "bucket"]).where("id <> a").select("a", F.col("id").alias("b")).distinct()
        links.write.mode("overwrite").parquet(f"{self.path}/links/batch={number}")
        new.groupBy("band", "bucket").agg(F.min("id").alias("id")).select("id", "band", "bucket").write.mode("overwrite").parquet(f"{self.path}/keys/batch={number}")
        new.unpersist()

    def _old(self, number: int) -> DataFrame:
        kind = "id bigint, band int, bucket string"
        if number == 0:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind + ", batch int").option("basePath", f"{self.path}/keys").parquet(f"{self.path}/keys").where(F.col("batch") < number).select("id", "band", "bucket")

    def links(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/links").select("a", "b").distinct()

    def sink(self) -> Callable[[DataFrame, int], None]:
        return self.batch
