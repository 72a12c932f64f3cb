"""BM25 as joins over postings, vector neighbours, and ranking metrics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import STOP_WORDS
from corpusloom.functions.tokens import term_lists
from corpusloom.functions.vectors import l2_distance
from corpusloom.plans.lineage import materialize
from corpusloom.sources.tables import folder_size_mb


def _terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, terms, tf, length), counted within each row; null texts and texts of stop words only have no terms."""
    return term_lists(df.select(F.col(key).alias("doc"), F.col(text).alias("_t")), "doc", "_t", accents=False, stop=STOP_WORDS)


def _long(lists: DataFrame) -> DataFrame:
    """(term, doc, tf, length) of term lists."""
    return lists.select("doc", F.explode(F.arrays_zip("terms", "tf")).alias("x"), "length").select(F.col("x.terms").alias("term"), "doc", F.col("x.tf").alias("tf"), "length")


#: Queries that are scored in one pass over the documents.
BLOCK = 4096


@dataclass
class BM25Index:
    """All documents (doc, terms, tf, length), document frequencies (term, df), and the documents' number and mean length.

    Scores are idf * tf / (tf + k1 * (1 - b + b * dl / mean)), with idf
    ln(1 + (N - df + 0.5) / (df + 0.5)); a query's repeated terms count each time.
    """

    documents: DataFrame
    frequencies: DataFrame
    docs: int
    mean_length: float
    k1: float = 1.5
    b: float = 0.75

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, k1: float = 1.5, b: float = 0.75) -> BM25Index:
        """Null texts and texts of stop words only are documents of length 0.

        A document's postings are one row, so that a partition holds whole
        documents and scores them without a shuffle.
        """
        documents = materialize(_terms(df, key, text), "documents")
        n, total = documents.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        frequencies = materialize(_long(documents).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
        return cls(documents, frequencies, n, total / n if n else 0.0, k1, b)

    @property
    def postings(self) -> DataFrame:
        """(term, doc, tf, dl)."""
        return _long(self.documents).withColumnRenamed("length", "dl")

    def _idf(self) -> Column:
        return F.log(1 + (F.lit(self.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))

    def term_stats(self) -> DataFrame:
        """(term, df, idf)."""
        return self.frequencies.select("term", "df", F.round(self._idf(), 6).alias("idf"))

    def search(self, queries: DataFrame, key: str, text: str, k: int = 10) -> DataFrame:
        """(query_id, rank, doc, score) of the best min(k, N) documents of each query; ties go to the smaller doc.

        Documents without a term of the query have score 0 and fill up the
        places left, smallest first.  Queries go to the documents in blocks, and
        every partition scores its documents in arrays and keeps its best k of
        each query; so what is shuffled is k rows a query and partition, however
        many documents share a common term.
        """
        weighed = materialize(
            _long(_terms(queries, key, text)).join(self.frequencies, "term").groupBy(F.col("doc").alias("q")).agg(F.collect_list(F.struct("term", (F.col("tf") * self._idf()).alias("w"))).alias("t")), "queries"
        )
        out, held = None, []
        for r in weighed.toLocalIterator(prefetchPartitions=True):
            held.append((r["q"], {x["term"]: x["w"] for x in r["t"]}))
            if len(held) == BLOCK:
                part = materialize(self._best(held, k), "best")
                out, held = part if out is None else out.unionByName(part), []
        last = self._best(held, k)
        best = last if out is None else out.unionByName(last)
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
        top = materialize(best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "doc", "score"), "top")
        # of the 2k smallest documents at most k are found, so the others fill any places left
        few = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)
        need = queries.select(F.col(key).alias("query_id")).distinct().join(few, "query_id", "left").join(top.groupBy("query_id").agg(F.lit(True).alias("found")), "query_id", "left").where("n is not null or found is null").select("query_id")
        fill = need.crossJoin(F.broadcast(self.documents.select("doc").orderBy("doc").limit(2 * k))).join(top, ["query_id", "doc"], "left_anti").withColumn("score", F.lit(0.0))
        return top.unionByName(fill).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "doc", "score")

    def _best(self, block: list, k: int) -> DataFrame:
        """(query_id, doc, score): the best k documents with a score of each query, for every partition of the documents."""
        spark = self.documents.sparkSession
        kind = self.documents.schema["doc"].dataType.simpleString()
        schema = f"query_id {kind}, doc {kind}, score double"
        if not block:
            return spark.createDataFrame([], schema)
        terms = sorted({t for _, ws in block for t in ws})
        code = {t: i for i, t in enumerate(terms)}
        packed = [(q, np.array([code[t] for t in ws], np.int64), np.array(list(ws.values()))) for q, ws in block]
        shared = spark.sparkContext.broadcast((pa.array(terms, pa.string()), packed))
        k1, b, mean = self.k1, self.b, self.mean_length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, packed = shared.value
            best: dict[int, tuple] = {}
            of = None
            for piece in batches:
                of = piece.column(0).type
                at = pc.index_in(piece.column(1).flatten(), terms)
                kept = at.is_valid().to_numpy(zero_copy_only=False)
                code = at.drop_null().to_numpy()
                doc = pc.list_parent_indices(piece.column(1)).to_numpy()[kept]
                ids = piece.column(0).to_numpy(zero_copy_only=False)
                tf, dl = piece.column(2).flatten().to_numpy()[kept].astype(float), piece.column(3).to_numpy()[doc].astype(float)
                part = tf / (tf + k1 * (1 - b + b * dl / mean))
                o = np.argsort(code, kind="stable")
                doc, part, starts = doc[o], part[o], np.searchsorted(code[o], np.arange(len(terms) + 1))
                for i, (_, cs, ws) in enumerate(packed):
                    lo, hi = starts[cs], starts[cs + 1]
                    n = hi - lo
                    if not n.sum():
                        continue
                    take = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                    score = np.round(np.bincount(doc[take], part[take] * np.repeat(ws, n), len(ids)), 6)
                    hit = np.flatnonzero(np.bincount(doc[take], minlength=len(ids)))
                    if len(hit) > k:  # all that reach the k-th score, so that ties are decided by the document
                        hit = hit[score[hit] >= np.partition(score[hit], len(hit) - k)[len(hit) - k]]
                    d, s = ids[hit], score[hit]
                    if i in best:
                        d, s = np.concatenate([best[i][0], d]), np.concatenate([best[i][1], s])
                    first = np.lexsort((d, -s))[:k]
                    best[i] = d[first], s[first]
            if best:
                q = [packed[i][0] for i, (d, _) in best.items() for _ in d]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, of), "doc": pa.array(np.concatenate([d for d, _ in best.values()]), of), "score": pa.array(np.concatenate([s for _, s in best.values()]))})

        return self.documents.mapInArrow(run, schema)

    def save(self, path: str) -> None:
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        self.frequencies.write.mode("overwrite").parquet(f"{path}/frequencies")
        stats = [(self.docs, self.mean_length, self.k1, self.b)]
        self.documents.sparkSession.createDataFrame(stats, "docs bigint, mean double, k1 double, b double").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark, path: str) -> BM25Index:
        s = spark.read.parquet(f"{path}/stats").first()
        return cls(spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/frequencies"), s["docs"], s["mean"], s["k1"], s["b"])

    @staticmethod
    def size_mb(spark, path: str) -> float:
        """Size of a saved index; NaN if there is none."""
        return folder_size_mb(spark, path)


def knn(vectors: DataFrame, query: list[float], key: str, vector: str = "embedding", k: int = 5) -> DataFrame:
    """(key, distance) of the k nearest vectors: a scan and a top-k, ties by key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.where(F.col(vector).isNotNull()).select(key, F.round(l2_distance(F.col(vector), q), 6).alias("distance")).orderBy("distance", key).limit(k)


def check_ranking(ranked: DataFrame) -> None:
    """A ranking that lists a document twice for a query is refused."""
    if not ranked.groupBy("query_id", "doc").count().where("count > 1").isEmpty():
        raise ValueError("a document is ranked twice for one query")


def _judged(judgements: DataFrame) -> DataFrame:
    return judgements.groupBy("query_id", "doc").agg(F.max("grade").alias("grade"))


def recall_at_k(ranked: DataFrame, judgements: DataFrame, queries: DataFrame, k: int = 10, totals: DataFrame | None = None) -> DataFrame:
    """(query_id, recall) of every query; NaN without a relevant document (grade over 0).

    totals (query_id, grade, n): how many documents of each grade a query has;
    with it, judgements need only hold those of ranked documents.
    """
    rel = _judged(judgements).where("grade > 0")
    hits = ranked.where(F.col("rank") <= k).select("query_id", "doc").distinct().join(rel, ["query_id", "doc"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    n = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")) if totals is None else totals.where("grade > 0 and n > 0").groupBy("query_id").agg(F.sum("n").alias("n"))
    out = queries.select("query_id").distinct().join(n, "query_id", "left").join(hits, "query_id", "left")
    return out.select("query_id", F.round(F.when(F.col("n").isNull(), float("nan")).otherwise(F.coalesce("hits", F.lit(0)) / F.col("n")), 6).alias("recall"))


def reciprocal_rank(ranked: DataFrame, judgements: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rr): 1 / the first relevant rank, 0 if none is found."""
    first = ranked.join(_judged(judgements).where("grade > 0"), ["query_id", "doc"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    out = queries.select("query_id").distinct().join(first, "query_id", "left")
    return out.select("query_id", F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def ndcg_at_k(ranked: DataFrame, judgements: DataFrame, queries: DataFrame, k: int = 10, totals: DataFrame | None = None) -> DataFrame:
    """(query_id, ndcg) with gains as graded and discount 1 / log2(rank + 1); NaN if the ideal is 0.

    The ideal follows from the number of documents of each grade (totals, as in
    recall_at_k), so no list of judgements is ever sorted.
    """
    j = _judged(judgements)
    gain = lambda g, r: F.sum(F.col(g) / F.log2(F.col(r) + 1.0))
    got = ranked.where(F.col("rank") <= k).join(j, ["query_id", "doc"]).groupBy("query_id").agg(gain("grade", "rank").alias("dcg"))
    totals = j.groupBy("query_id", "grade").agg(F.count(F.lit(1)).alias("n")) if totals is None else totals
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("grade")))
    runs = totals.where("n > 0").withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n") + 1).where(F.col("from") <= k)
    places = runs.select("query_id", "grade", F.explode(F.sequence("from", F.least("upto", F.lit(k).cast("bigint")))).alias("place"))
    ideal = places.groupBy("query_id").agg(gain("grade", "place").alias("ideal"))
    out = queries.select("query_id").distinct().join(ideal, "query_id", "left").join(got, "query_id", "left")
    ndcg = F.when(F.coalesce("ideal", F.lit(0.0)) == 0, float("nan")).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"))
    return out.select("query_id", F.round(ndcg, 6).alias("ndcg"))


def knn_batch(vectors: DataFrame, queries: DataFrame, key: str, vector: str = "embedding", k: int = 5, block: int = 4096) -> DataFrame:
    """(query_id, rank, key, distance): the k nearest vectors of each query, the query itself left out.

    Queries are sent to the scan in blocks of at most ``block``; each partition
    keeps its best k of every query, so k rows a query and partition are
    shuffled, whatever the vectors' number.
    """
    import pandas as pd

    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"query_id {kind}, `{key}` {kind}, distance double"
    rows = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).alias("v")).orderBy("q")
    out = None
    held: list = []

    def scan(part: list) -> DataFrame:
        ids, mat = np.array([r["q"] for r in part]), np.array([r["v"] for r in part], dtype=float)
        shared = spark.sparkContext.broadcast((ids, mat))

        def run(batches):
            qid, q = shared.value
            best = None
            for pdf in batches:
                x, xid = np.stack(pdf[vector].to_numpy()).astype(float), pdf[key].to_numpy()
                by_key = np.argsort(xid, kind="stable")
                x, xid = x[by_key], xid[by_key]
                for at in range(0, len(xid), 2048):
                    d = np.sqrt(((q[:, None, :] - x[None, at : at + 2048]) ** 2).sum(2)) if len(q) <= 256 else np.stack([np.sqrt(((v - x[at : at + 2048]) ** 2).sum(1)) for v in q])
                    ids_ = xid[at : at + 2048]
                    # rounded first and in order of the key, so that a stable sort keeps the smallest keys of a tie
                    d = np.round(np.where(qid[:, None] == ids_[None], np.inf, d), 6)
                    top = np.argsort(d, axis=1, kind="stable")[:, :k]
                    f = pd.DataFrame({"query_id": np.repeat(qid, top.shape[1]), key: ids_[top].ravel(), "distance": np.take_along_axis(d, top, 1).ravel()})
                    best = f if best is None else pd.concat([best, f])
                best = best.sort_values(["query_id", "distance", key]).groupby("query_id").head(k)
            if best is not None:
                yield best[np.isfinite(best["distance"])]

        return vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, schema)

    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == block:  # each block's k rows a query and partition are written, so that the plan does not grow
            part = materialize(scan(held), "nearest")
            out, held = part if out is None else out.union(part), []
    if held or out is None:
        part = scan(held) if held else spark.createDataFrame([], schema)
        out = part if out is None else out.union(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "distance")
