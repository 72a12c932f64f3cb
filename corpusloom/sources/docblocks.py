"""Files of numbered document blocks, gold labels, and labelling sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The line that opens a block: a three-digit number and the id.
HEADER = r"(?m)^=== DOC (\d{3}) \(id=.*?\) ===\s*$"
CANDIDATES = r"(?m)^\[CANDIDATES\]:.*\n?"
GOLD = "doc_index string, entity_text string, label string"


def parse_blocks(files: DataFrame, content: str = "value", numbered: str | None = None) -> DataFrame:
    """(doc_index, text) of the blocks of whole file contents.

    What stands before the first header is ignored, lines of candidates are
    dropped, texts are trimmed.  A number in two blocks is an error.  With
    numbered, a column of files that stays beside doc_index, each of its values
    is a set with numbers of its own.
    """
    keys = [numbered] if numbered else []
    numbers = F.regexp_extract_all(content, F.lit(HEADER), 1)
    bodies = F.split(content, HEADER)
    blocks = F.arrays_zip(numbers.alias("doc_index"), F.slice(bodies, F.lit(2), F.size(bodies)).alias("body"))
    body = F.regexp_replace(F.regexp_replace("x.body", CANDIDATES, ""), r"(?U)^\s+|\s+$", "")
    out = files.where(F.col(content).rlike(HEADER)).select(*keys, F.explode(blocks).alias("x")).select(*keys, F.col("x.doc_index").alias("doc_index"), body.alias("text"))
    twice = out.groupBy(*keys, "doc_index").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"document numbers in two blocks: {sorted(r['doc_index'] for r in twice)}")
    return out


def read_blocks(spark: SparkSession, *paths: str) -> DataFrame:
    return parse_blocks(spark.read.text(list(paths), wholetext=True))


def clean_gold(rows: DataFrame) -> DataFrame:
    """(doc_index, label, entity): trimmed fields, lower-case entity, once each; rows lacking a field are dropped."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    out = rows.select(trim("doc_index").alias("doc_index"), trim("label").alias("label"), F.lower(trim("entity_text")).alias("entity"))
    return out.where("doc_index <> '' and label <> '' and entity <> ''").distinct()


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold labels of a CSV file with a header; all fields are strings, so numbers keep their zeros."""
    return clean_gold(spark.read.csv(path, header=True, schema=GOLD))


def check_gold(gold: DataFrame, docs: DataFrame) -> None:
    """Gold labels of documents that are not there are an error."""
    lost = gold.join(docs.select("doc_index"), "doc_index", "left_anti").select("doc_index").distinct().orderBy("doc_index").limit(5).collect()
    if lost:
        raise ValueError(f"gold labels without a document: {[r[0] for r in lost]}")


def write_blocks(docs: DataFrame, path: str, key: str, text: str = "text", index: str = "doc_index", candidates: str | None = None) -> None:
    """Blocks in order of index, one file; with candidates, a line of them under each header."""
    head = F.format_string("=== DOC %s (id=%s) ===", F.col(index), F.col(key).cast("string"))
    line = F.concat(F.lit("\n[CANDIDATES]: "), F.coalesce(F.array_join(candidates, "; "), F.lit(""))) if candidates else F.lit("")
    block = F.concat(head, line, F.lit("\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    docs.select(index, block.alias("value")).orderBy(index).coalesce(1).select("value").write.mode("overwrite").text(path)


def write_template(spark: SparkSession, path: str) -> None:
    """An empty label file with its header; an existing one stays."""
    spark.createDataFrame([], GOLD).coalesce(1).write.mode("ignore").option("header", True).csv(path)


def write_candidates(entities: DataFrame, path: str) -> None:
    """Candidate labels (doc_index, entity_text, label) as CSV, quoted where needed."""
    entities.select("doc_index", "entity_text", "label").orderBy("doc_index", "label", "entity_text").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
