"""Decision and scaling tables over experiment results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The names, metrics and the head of the table below are fixed values: readers of the report look for them.
#: (decision, experiment, metric)
DECISIONS = (
    ("Document classification", "classify.baselines", "f1_macro"),
    ("Probability quality", "classify.calibration", "brier"),
    ("NER", "ner.extraction", "f1"),
    ("Retrieval", "retrieval.methods", "ndcg@10"),
    ("Processing", "dask.scaling", "docs_per_sec"),
    ("Storage", "storage.options", "p95_latency_ms"),
)
LOWER_IS_BETTER = ("brier", "log_loss", "p95_latency_ms")


def of_split(results: DataFrame, split: str) -> DataFrame:
    """Results that count for a split: those of classification only for that split, others always."""
    return results.where(~F.col("experiment").startswith("classify.") | (F.col("split") == split))


def decision_table(results: DataFrame, split: str = "dev", alpha: float = 0.05, decisions=DECISIONS) -> DataFrame:
    """(decision, metric, methods, winner, best, margin, p_value, significance) of each decision, in order of ``place``.

    The margin is best minus runner-up, negative where lower is better.  The
    p-value is that of the significance result of the pair in either order.
    Undecided: winner null, methods ``_not run_``.
    """
    spark = results.sparkSession
    wanted = spark.createDataFrame([(i, *d, d[2] in LOWER_IS_BETTER) for i, d in enumerate(decisions)], "place int, decision string, experiment string, metric string, lower boolean")
    runs = of_split(results, split).join(F.broadcast(wanted), "experiment").withColumn("v", F.try_element_at("metrics", F.col("metric"))).where("v is not null")
    order = Window.partitionBy("place").orderBy(F.when(F.col("lower"), F.col("v")).otherwise(-F.col("v")), "variant")
    ranked = runs.withColumns({"rank": F.row_number().over(order), "next_v": F.lead("v").over(order), "next_variant": F.lead("variant").over(order)})
    names = ranked.groupBy("place").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "variant"))), lambda x: x.variant), ", ").alias("methods"))
    best = ranked.where("rank = 1").select("place", F.col("variant").alias("winner"), F.col("v").alias("best"), F.round(F.col("v") - F.col("next_v"), 6).alias("margin"), "next_variant")
    sig = results.where("experiment = 'classify.significance'").select(F.split("variant", "_vs_").alias("s"), F.try_element_at("metrics", F.lit("p_value")).alias("p_value"))
    sig = sig.select(F.array_min("s").alias("lo"), F.array_max("s").alias("hi"), "p_value").groupBy("lo", "hi").agg(F.min("p_value").alias("p_value"))
    best = best.join(sig, (F.least("winner", "next_variant") == F.col("lo")) & (F.greatest("winner", "next_variant") == F.col("hi")), "left")
    said = F.when(F.col("winner").isNull(), "not run").when(F.col("p_value").isNull(), "not tested").when(F.col("p_value") < alpha, "significant").otherwise("not significant")
    out = wanted.join(names, "place", "left").join(best, "place", "left")
    return out.select("place", "decision", "metric", F.coalesce("methods", F.lit("_not run_")).alias("methods"), "winner", "best", "margin", "p_value", said.alias("significance"))


def markdown(table: DataFrame, split: str) -> list[str]:
    """The decision table as lines of Markdown; there are as many rows as decisions."""
    lines = [f"# Results (`{split}` split)", "", "| Decision | Methods tested | Metric | Winner | Margin | Significant? |", "|---|---|---|---|---|---|"]
    for r in table.orderBy("place").collect():
        won = f"**{r['winner']}** ({r['best']:.4f})" if r["winner"] else "—"
        margin = f"{r['margin']:+.4f}" if r["margin"] is not None else "—"
        sig = "—" if not r["winner"] else r["significance"] + (f" (p={r['p_value']:.4f})" if r["p_value"] is not None else "")
        lines.append(f"| {r['decision']} | {r['methods']} | {r['metric']} | {won} | {margin} | {sig} |")
    return lines


def scaling_table(runs: DataFrame) -> DataFrame:
    """(split, variant, workers, rate, speedup, efficiency, lifecycle_seconds, scatter_share) against the baseline of the same split.

    runs: split, variant, workers (null for the baseline), rate, startup, teardown, scatter and compute seconds.
    """
    base = runs.where("workers is null").groupBy("split").agg(F.max("rate").alias("base"))
    speed = F.try_divide("rate", "base")
    return runs.where("workers is not null").join(F.broadcast(base), "split", "left").select(
        "split", "variant", "workers", "rate", F.round(speed, 6).alias("speedup"), F.round(speed / F.col("workers"), 6).alias("efficiency"),
        F.round(F.col("startup") + F.col("teardown"), 6).alias("lifecycle_seconds"), F.round(F.try_divide(100.0 * F.col("scatter"), F.col("compute")), 6).alias("scatter_share"),
    )
