"""Queries of the operators in this package, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import canonical, contract, groupsplit, labels, mixing, neardup, sampling, spans, tokens, truncation
from corpusloom.llm.sql import SQL
from corpusloom.sources.tables import spread


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(_t(spark, d, name))


def _clauses(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = _t(spark, d, "clauses").select(*columns, "split")
    return labels.with_split(rows, _t(spark, d, "split_aliases"))


def _sample(spark: SparkSession, d: str) -> sampling.TargetSample:
    rows = labels.with_category(_clauses(spark, d, "clause_id", "label", "label_name", "source").drop("split"), _t(spark, d, "label_names"))
    rows = rows.select("clause_id", F.col("side").alias("split"), "category", labels.plain(F.col("source")).alias("group"))
    return sampling.TargetSample(rows, _t(spark, d, "sample_targets"), "clause_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report().where("gap > 0").select("split", "label_name")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).drawn()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report()


def p1_margins(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).margins()


def _across(spark: SparkSession, d: str, find: Callable) -> DataFrame:
    return find(_clauses(spark, d, "clause_id", "text"), F.col("side") == "train", F.col("side").isin("dev", "calib", "test"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _across(spark, d, neardup.cross_pairs).select(F.least("a", "b").alias("clause_id_a"), F.greatest("a", "b").alias("clause_id_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation clauses with a partner in train, and pairs, by split and source."""
    rows = _clauses(spark, d, "clause_id", "source").select(F.col("clause_id").alias("id"), "side", labels.plain(F.col("source")).alias("source"))
    return _across(spark, d, neardup.cross_counts).join(rows, "id").groupBy(F.col("side").alias("split"), "source").agg(F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("clauses"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(_t(spark, d, "clauses"))


def _split(spark: SparkSession, d: str) -> groupsplit.GroupSplit:
    rows = _clauses(spark, d, "clause_id", "dup_cluster", "label")
    return groupsplit.GroupSplit(rows.select(F.col("clause_id").alias("key"), F.col("dup_cluster").alias("cluster"), "label", "side"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).broken().select(F.col("cluster").cast("int").alias("dup_cluster"))


def p4_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).rows_split().select(F.col("key").alias("clause_id"), "cluster", "split")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).report()


def p4_whole(spark: SparkSession, d: str) -> DataFrame:
    """Rows and splits of every cluster under the assignment: one split each."""
    rows = _split(spark, d).rows_split().where("cluster is not null")
    return rows.groupBy(F.col("cluster").alias("dup_cluster")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("split").alias("splits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_t(spark, d, "documents"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return spans.shared_shares(docs, spans.shared_spans(docs))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = canonical.collapsed(_t(spark, d, "raw_records"))
    return rows.where("record_id <> keep").select(F.col("keep").alias("keep_id"), F.col("record_id").alias("copy_id"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    rows = canonical.collapsed(_t(spark, d, "raw_records"))
    return rows.where("record_id = keep").select("record_id", "copies")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return contract.match_groups(_t(spark, d, "match_pairs"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(_texts(spark, d, "documents"))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(_texts(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report().where("unreachable").select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).documents()


def p9_caps(spark: SparkSession, d: str) -> DataFrame:
    """Documents of every target feed, and how many of them the mix holds more often than it may: none."""
    drawn = _mix(spark, d).counts()
    return drawn.groupBy(F.col("feed").alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("copies") > F.col("cap")).alias("over"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report()


def _cuts(spark: SparkSession, d: str) -> truncation.Truncation:
    return truncation.Truncation(_texts(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).flagged().where("cut").select("doc_id")


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).report()


def p10_hazards(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).hazards().where("significant").select("feed", "unit", "length", "ended", "at_risk")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (p1_found, p1_sample, p1_report, p1_margins, p2_found, p2_report, p3_found, p4_found, p4_split, p4_report, p4_whole, p5_found, p5_shares, p6_found, p6_records, p7_found, p8_ids, p9_found, p9_mix, p9_caps, p9_shares, p10_found, p10_report, p10_hazards)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
