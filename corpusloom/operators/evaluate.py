"""Classification and extraction metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b), F.lit(0.0))


def confusion(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """(true, pred, n) of wrong predictions."""
    return df.where(F.col(true) != F.col(pred)).groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def top_confusions(df: DataFrame, k: int = 50, true: str = "true", pred: str = "pred") -> DataFrame:
    return confusion(df, true, pred).orderBy(F.desc("n"), "true", "pred").limit(k)


def class_counts(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """(label, tp, support, predicted) of every label that is true or predicted somewhere."""
    ends = F.explode(F.array(F.struct(F.col(true).alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("s"), F.lit(1).alias("p"))))
    hit = (F.col(true) == F.col(pred)).cast("int").alias("hit")
    long = df.select(ends.alias("x"), hit).select("x.label", "x.s", "x.p", "hit").where("label is not null")
    return long.groupBy("label").agg(F.sum(F.col("s") * F.col("hit")).alias("tp"), F.sum("s").alias("support"), F.sum("p").alias("predicted"))


def per_class(df: DataFrame, true: str = "true", pred: str = "pred", supported: bool = False) -> DataFrame:
    """(label, precision, recall, f1, support); a metric without a denominator is 0.  supported: only labels with a true row."""
    c = class_counts(df, true, pred)
    c = c.where("support > 0") if supported else c
    f1 = _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return c.select("label", F.round(_ratio("tp", "predicted"), 6).alias("precision"), F.round(_ratio("tp", "support"), 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def f1_summary(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """(macro_f1, micro_f1, accuracy, n, n_classes); a label predicted but never true counts 0 in the macro mean."""
    c = class_counts(df, true, pred)
    f1 = _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return c.agg(
        F.round(F.avg(f1), 6).alias("macro_f1"),
        F.round(F.try_divide(F.sum("tp"), F.sum("support")), 6).alias("micro_f1"),
        F.round(F.try_divide(F.sum("tp"), F.sum("support")), 6).alias("accuracy"),
        F.sum("support").alias("n"),
        F.count(F.lit(1)).alias("n_classes"),
    )


def zero_support(df: DataFrame, n_classes: int, true: str = "true") -> DataFrame:
    """(zero_support): configured classes without a true row."""
    return df.agg((F.lit(n_classes).cast("bigint") - F.count_distinct(true)).alias("zero_support"))


def extremes(table: DataFrame, k: int = 10) -> DataFrame:
    """The k worst and k best labels by F1."""
    worst = table.orderBy("f1", "label").limit(k).withColumn("side", F.lit("worst"))
    return worst.unionByName(table.orderBy(F.desc("f1"), "label").limit(k).withColumn("side", F.lit("best")))


def confusion_examples(df: DataFrame, key: str, text: str, k: int = 3, chars: int = 300, true: str = "true", pred: str = "pred") -> DataFrame:
    """(key, true, pred, example): the first k rows of the most frequent confusion."""
    top = top_confusions(df, 1, true, pred).select(F.col("true").alias(true), F.col("pred").alias(pred))
    return df.join(F.broadcast(top), [true, pred]).orderBy(key).limit(k).select(key, true, pred, F.substring(text, 1, chars).alias("example"))


def brier(df: DataFrame, probabilities: str, label_index: str) -> DataFrame:
    """(brier, n): mean over rows of the squared distance of the probabilities from the true class."""
    miss = F.aggregate(F.transform(probabilities, lambda p, i: F.pow(p - (i == F.col(label_index)).cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)
    return df.agg(F.round(F.avg(miss), 6).alias("brier"), F.count(F.lit(1)).alias("n"))


def entity_outcomes(pred: DataFrame, gold: DataFrame, doc: str = "doc_index") -> DataFrame:
    """(doc, label, entity, outcome) with outcome TP, FP or FN, by (document, label, lower-case text) once each."""
    keys = [doc, "label", "entity"]
    p, g = (d.select(*keys).where("entity is not null and label is not null").distinct() for d in (pred, gold))
    both = p.withColumn("_p", F.lit(1)).join(g.withColumn("_g", F.lit(1)), keys, "full_outer")
    return both.select(*keys, F.when(F.col("_g").isNull(), "FP").when(F.col("_p").isNull(), "FN").otherwise("TP").alias("outcome"))


def precision_recall(outcomes: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) by label and, with label null, over all; NaN without a denominator."""
    counts = outcomes.groupingSets([[], [F.col("label")]], "label").agg(*(F.count_if(F.col("outcome") == k.upper()).alias(k) for k in ("tp", "fp", "fn")))
    nan = F.lit(float("nan"))
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), nan)
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), nan)
    f = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), nan)
    undefined = F.isnan(p) | F.isnan(r) | (F.col("tp") == 0)
    return counts.select("label", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(undefined, nan).otherwise(f), 6).alias("f1"))
