"""Rule-based entities: captures, spans with offsets, overlap suppression, grouping, surveys."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P

RULES = {"GOVERNING_LAW": P.GOVERNING_LAW, "DEFINED_TERM": P.DEFINED_TERM}
SPAN = "array<struct<text:string,label:string,start:int,end:int,source:string>>"


def captures(text: Column, pattern: str, group: int = 1) -> Column:
    """All captures of a pattern, in the JVM; null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), group), F.array().cast("array<string>"))


def captured(df: DataFrame, key: str, text: str, pattern: str, to: str = "entity") -> DataFrame:
    """(key, pos, entity), one row a capture."""
    return df.select(key, F.posexplode(captures(F.col(text), pattern)).alias("pos", to))


def rule_spans(text: Column, rules: dict[str, str] = RULES) -> Column:
    """Spans of the rules' captures with code-point offsets, sorted by start.

    No built-in gives the offsets of all matches, so this is an Arrow function
    over whole batches.
    """
    compiled = [(label, re.compile(P.for_python(p))) for label, p in rules.items()]

    @F.pandas_udf(SPAN)
    def spans(s: pd.Series) -> pd.Series:
        def of(t: str | None) -> list[dict]:
            found = [{"text": m.group(1), "label": lab, "start": m.start(1), "end": m.end(1), "source": "rule"} for lab, p in compiled for m in p.finditer(t or "")]
            return sorted(found, key=lambda e: e["start"])

        return s.map(of, na_action=None)

    return spans(text)


def rule_entities(df: DataFrame, key: str, text: str, rules: dict[str, str] = RULES) -> DataFrame:
    """(key, text, label, start, end, source), one row a rule span."""
    return df.select(key, F.explode(rule_spans(F.col(text), rules)).alias("e")).select(key, "e.*")


def suppress_overlaps(general: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """General spans that no rule span of the same document overlaps; spans are half-open, so touching ones stay."""
    g, r = general.alias("g"), rules.select(key, "start", "end").alias("r")
    hit = (F.col(f"g.{key}") == F.col(f"r.{key}")) & (F.col("g.start") < F.col("r.end")) & (F.col("r.start") < F.col("g.end"))
    return g.join(r, hit, "left_anti")


def all_entities(general: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Rule spans and the general spans beside them."""
    return suppress_overlaps(general, rules, key).unionByName(rules)


def grouped(entities: DataFrame, key: str) -> DataFrame:
    """(key, entities): a map from label to texts in order of appearance, general spans before rule spans at one start."""
    rank = F.when(F.col("source") == "rule", 1).otherwise(0)
    by = entities.groupBy(key, "label").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "text"))).alias("x"))
    return by.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", F.col("x.text").alias("texts"))))).alias("entities"))


def label_profile(entities: DataFrame, docs: int, key: str) -> DataFrame:
    """(label, mentions, docs, share) of entity rows."""
    n = entities.groupBy("label").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct(key).alias("docs"))
    return n.withColumn("share", F.round(F.col("docs") / F.lit(docs), 6))


def capture_frequency(df: DataFrame, key: str, text: str, pattern: str, k: int = 15) -> DataFrame:
    """(entity, mentions) of the k most frequent captures."""
    return captured(df, key, text, pattern).groupBy("entity").agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), "entity").limit(k)


def survey(df: DataFrame, text: str) -> DataFrame:
    """One row: documents with each of the survey's patterns, and defined terms in all and different ones."""
    n = lambda p: F.coalesce(F.sum(F.col(text).rlike(p).cast("int")), F.lit(0))
    terms = df.select(F.explode(captures(F.col(text), P.SURVEY_DEFINED_TERM)).alias("t")).agg(F.count(F.lit(1)).alias("term_mentions"), F.count_distinct("t").alias("unique_terms"))
    counts = df.agg(
        F.count(F.lit(1)).alias("docs"),
        n(P.SURVEY_DEFINED_TERM).alias("defined_term_docs"),
        n(P.SURVEY_GOVERNING_LAW).alias("governing_law_docs"),
        n(P.MONEY).alias("money_docs"),
        n(P.SLASH_DATE).alias("slash_date_docs"),
    )
    return counts.crossJoin(F.broadcast(terms))


def without_entities(df: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(docs, without, share): documents that have no entity row."""
    has = entities.select(key).distinct().withColumn("_e", F.lit(1))
    n = df.select(key).join(has, key, "left").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("_e").isNull()).alias("without"))
    return n.withColumn("share", F.round(F.try_divide("without", "docs"), 6))


def quote_contexts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, before, phrase): quoted phrases with the up to 50 characters before them."""
    t = F.col(text)
    pairs = F.arrays_zip(captures(t, P.QUOTE_CONTEXT, 1).alias("before"), captures(t, P.QUOTE_CONTEXT, 2).alias("phrase"))
    return df.select(key, F.posexplode(pairs).alias("pos", "x")).select(key, "pos", F.col("x.before").alias("before"), F.col("x.phrase").alias("phrase"))


def with_model(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[str], list[tuple[str, str, int, int]]]]) -> DataFrame:
    """(key, text, label, start, end, source) of a general model; load() runs once in each worker and gives text -> spans."""

    def run(batches):
        model = load()
        for pdf in batches:
            rows = [(k, *span, "general") for k, t in zip(pdf[key], pdf[text]) for span in (model(t) if t else [])]
            yield pd.DataFrame(rows, columns=[key, "text", "label", "start", "end", "source"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string, label string, start int, end int, source string")
