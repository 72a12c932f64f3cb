"""The engine's queries over the standard tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import text as T
from corpusloom.operators import classify, entities, evaluate, machines, neardup, profile, retrieval, sampling, splits, stats
from corpusloom.plans import report
from corpusloom.plans.lineage import materialize, scratch
from corpusloom.sources import docblocks, results, tables
from corpusloom.sources.tables import spread, table, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CLASSES = 38


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- shared pieces of SQL

_WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NORM = f"trim(regexp_replace(lower(text), '{_WS}+', ' ', 'g'))"
_STRIP = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_SIDE = f"(SELECT a.split FROM split_aliases a WHERE a.alias = lower({_STRIP('c.split')}))"
_WORDS = f"CASE WHEN {_NORM} = '' THEN 0 ELSE len(string_split({_NORM}, ' ')) END"
_SHINGLES = f"""
 d AS (SELECT min(clause_id) AS id, {_NORM} AS t FROM clauses WHERE clause_id IS NOT NULL AND text IS NOT NULL GROUP BY 2),
 w AS (SELECT id, t, string_split(t, ' ') AS w FROM d),
 s AS (SELECT DISTINCT id, sh FROM (SELECT id, unnest(CASE WHEN len(w) < 5 THEN [t]
       ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w)),
 rep AS (SELECT c.clause_id, d.id FROM clauses c JOIN d ON d.t = trim(regexp_replace(lower(c.text), '{_WS}+', ' ', 'g')) WHERE c.text IS NOT NULL)"""
_PAIRS = """
 n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
 o AS (SELECT x.id AS a, y.id AS b, count(*) AS o FROM s x JOIN s y ON x.sh = y.sh AND x.id < y.id GROUP BY 1, 2),
 exact AS (SELECT a, b, round(o::DOUBLE / (p.n + q.n - o), 6) AS likeness FROM o JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE o * 5 >= (p.n + q.n - o) * 4)"""
_BANDS, _ROWS = 9, 13
_PERMS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(neardup.permutations(_BANDS * _ROWS)))
_MINHASH = f"""
 perm(i, a, b) AS (VALUES {_PERMS}),
 h AS (SELECT id, ('0x' || substr(md5(sh), 1, 8))::BIGINT % {neardup.PRIME} AS h FROM s),
 m AS (SELECT id, i, min((h * a + b) % {neardup.PRIME}) AS m FROM h, perm GROUP BY 1, 2),
 band AS (SELECT id, i // {_ROWS} AS band, md5(string_agg(m::VARCHAR, ',' ORDER BY i)) AS bucket FROM m GROUP BY 1, 2),
 lsh AS (SELECT DISTINCT f.id AS a, t.id AS b FROM band t JOIN (SELECT band, bucket, min(id) AS id FROM band GROUP BY 1, 2) f USING (band, bucket) WHERE t.id <> f.id)"""


def _cluster_sql(edges: str, name: str) -> str:
    return f"""
 {name}_e AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
 {name}_r(id, r) AS (SELECT id, id FROM d UNION SELECT x.id, e.b FROM {name}_r x JOIN {name}_e e ON x.r = e.a),
 {name} AS (SELECT clause_id, dense_rank() OVER (ORDER BY root) - 1 AS cluster_id FROM rep JOIN (SELECT id, min(r) AS root FROM {name}_r GROUP BY id) USING (id))"""


_VERIFIED = " lshv AS (SELECT l.a, l.b FROM lsh l JOIN exact x ON x.a = l.a AND x.b = l.b)"
_EXACT_SQL = f"WITH RECURSIVE {_SHINGLES}, {_PAIRS}, {_cluster_sql('exact', 'ce')}"
_LSH_SQL = f"WITH RECURSIVE {_SHINGLES}, {_MINHASH}, {_cluster_sql('lsh', 'cl')}"


def _clauses(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Clauses with ``side``, the split that their spelling stands for."""
    aliases = F.broadcast(table(spark, d, "split_aliases").select("alias", F.col("split").alias("side")))
    key = F.lower(F.regexp_replace("split", r"(?U)^\s+|\s+$", ""))
    c = table(spark, d, "clauses", *dict.fromkeys([*cols, "split"]))
    c = spread(c) if "text" in cols else c
    return c.join(aliases, key == F.col("alias"), "left").drop("alias")


# ---- scans, projections, profiles


@query("SELECT clause_id, substr(sha1(text), 1, 16) AS content_id FROM clauses")
def doc_ids_sha1(spark, d):
    return table(spark, d, "clauses", "clause_id", "text").select("clause_id", T.content_id(F.col("text")).alias("content_id"))


@query(f"""SELECT count(w) AS n, round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS std, min(w)::INT AS min, quantile_cont(w, 0.25) AS q25,
 quantile_cont(w, 0.5) AS q50, quantile_cont(w, 0.75) AS q75, max(w)::INT AS max FROM (SELECT {_WORDS} AS w FROM documents WHERE text IS NOT NULL)""")
def word_count_describe(spark, d):
    return profile.describe_words(table(spark, d, "documents", "text"))


@query(f"SELECT doc_id, words::INT AS words FROM (SELECT doc_id, {_WORDS} AS words FROM documents WHERE text IS NOT NULL) WHERE words < 10")
def short_docs(spark, d):
    return profile.short_docs(table(spark, d, "documents", "doc_id", "text"), "doc_id")


@query("SELECT label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM clauses WHERE label IS NOT NULL GROUP BY label")
def class_share(spark, d):
    return profile.class_share(table(spark, d, "clauses", "label"), "label")


@query("SELECT min(n) AS rarest FROM (SELECT count(*) AS n FROM clauses WHERE label IS NOT NULL GROUP BY label)")
def rarest_class(spark, d):
    return profile.class_share(table(spark, d, "clauses", "label"), "label").agg(F.min("n").alias("rarest"))


@query("SELECT c.clause_id, n.label_name AS name FROM clauses c LEFT JOIN label_names n ON n.label = c.label")
def label_lookup(spark, d):
    names = table(spark, d, "label_names").select("label", F.col("label_name").alias("name"))
    return table(spark, d, "clauses", "clause_id", "label").join(F.broadcast(names), "label", "left").select("clause_id", "name")


@query("SELECT clause_id FROM clauses ORDER BY md5('7:' || clause_id), clause_id LIMIT 200")
def sample_exact_n(spark, d):
    return sampling.sample_exact(table(spark, d, "clauses", "clause_id"), 200, "clause_id")


@query("""SELECT clause_id, lpad((row_number() OVER (ORDER BY md5('7:' || clause_id), clause_id) - 1 + 30)::VARCHAR, 3, '0') AS doc_index FROM
 (SELECT clause_id FROM clauses c WHERE NOT EXISTS (SELECT 1 FROM gold_labels g WHERE g.doc_index = lpad(c.clause_id::VARCHAR, 9, '0')) ORDER BY md5('7:' || clause_id), clause_id LIMIT 100)""")
def sample_excluding(spark, d):
    c = table(spark, d, "clauses", "clause_id").withColumn("doc_index", F.lpad(F.col("clause_id").cast("string"), 9, "0"))
    rest = sampling.excluding(c, table(spark, d, "gold_labels", "doc_index"), "doc_index")
    some = sampling.sample_exact(rest, 100, "clause_id").select("clause_id")
    return sampling.numbered(some, [sampling.hash_order(7, "clause_id"), F.col("clause_id")], 30)


@query("SELECT doc_id, substr(text, 1, 300) AS shown FROM documents")
def display_clip(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.clipped(F.col("text")).alias("shown"))


@query("SELECT clause_id, ((row_number() OVER (ORDER BY clause_id) - 1) // ((SELECT count(*) + 6 FROM clauses) // 7))::INT AS chunk FROM clauses")
def chunks(spark, d):
    return sampling.chunked(table(spark, d, "clauses", "clause_id"), "clause_id", 7)


# ---- near-duplicates


@query(f"WITH {_SHINGLES} SELECT id AS clause_id, count(*) AS shingles FROM s GROUP BY id")
def shingle_counts(spark, d):
    return neardup.shingled(texts(spark, d, "clauses", "clause_id", "text"), "clause_id", "text").groupBy(F.col("id").alias("clause_id")).agg(F.count(F.lit(1)).alias("shingles"))


@query(f"WITH {_SHINGLES}, {_MINHASH} SELECT id AS clause_id, md5(string_agg(m::VARCHAR, ',' ORDER BY i)) AS signature FROM m GROUP BY id")
def minhash_signatures(spark, d):
    n = _BANDS * _ROWS
    sigs = neardup.signatures(texts(spark, d, "clauses", "clause_id", "text"), "clause_id", "text", n)
    return sigs.select(F.col("id").alias("clause_id"), F.md5(F.array_join(F.col("m").cast("array<string>"), ",")).alias("signature"))


@query(f"WITH {_SHINGLES}, {_MINHASH} SELECT a, b FROM lsh")
def lsh_candidate_pairs(spark, d):
    return neardup.band_edges(neardup.signatures(texts(spark, d, "clauses", "clause_id", "text"), "clause_id", "text", _BANDS * _ROWS), _BANDS, _ROWS)


@query(f"WITH {_SHINGLES}, {_PAIRS} SELECT a, b, likeness FROM exact")
def neardup_exact_pairs(spark, d):
    return neardup.exact_pairs(texts(spark, d, "clauses", "clause_id", "text"), "clause_id", "text")


def _clusters(spark, d, mode):
    return neardup.clusters(texts(spark, d, "clauses", "clause_id", "text"), "clause_id", "text", mode)


@query(f"{_EXACT_SQL} SELECT clause_id, cluster_id FROM ce")
def clusters_exact(spark, d):
    return _clusters(spark, d, "exact")


@query(f"{_LSH_SQL} SELECT clause_id, cluster_id FROM cl")
def clusters_lsh(spark, d):
    return _clusters(spark, d, "lsh")


@query(f"WITH RECURSIVE {_SHINGLES}, {_PAIRS}, {_MINHASH}, {_VERIFIED}, {_cluster_sql('lshv', 'cv')} SELECT clause_id, cluster_id FROM cv")
def clusters_lsh_verified(spark, d):
    return _clusters(spark, d, "lsh_verified")


@query(f"{_EXACT_SQL} SELECT size, count(*) AS clusters FROM (SELECT cluster_id, count(*) AS size FROM ce GROUP BY 1) GROUP BY size")
def cluster_size_histogram(spark, d):
    return profile.cluster_sizes(_clusters(spark, d, "exact"))


@query(f"""{_EXACT_SQL}, z AS (SELECT cluster_id, count(*) AS n FROM ce GROUP BY 1)
 SELECT sum(n)::BIGINT AS docs, count(*) AS clusters, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS clustered_docs, max(n) AS largest, round(coalesce(sum(n) FILTER (n > 1), 0)::DOUBLE / sum(n), 6) AS rate FROM z""")
def duplicate_rate(spark, d):
    return profile.duplicate_rate(_clusters(spark, d, "exact"))


@query(f"""WITH RECURSIVE {_SHINGLES}, {_PAIRS}, {_MINHASH}, {_cluster_sql('exact', 'ce')}, {_cluster_sql('lsh', 'cl')},
 x AS (SELECT clause_id, min(clause_id) OVER (PARTITION BY cluster_id) AS head_x FROM ce), y AS (SELECT clause_id, min(clause_id) OVER (PARTITION BY cluster_id) AS head_y FROM cl)
 SELECT clause_id, head_x, head_y FROM x FULL JOIN y USING (clause_id) WHERE head_x IS DISTINCT FROM head_y""")
def partition_diff_lsh_vs_exact(spark, d):
    return profile.partition_diff(_clusters(spark, d, "exact"), _clusters(spark, d, "lsh"), "clause_id")


# ---- splits

_FILL = """
 run AS (SELECT *, sum(size) OVER (ORDER BY k NULLS LAST, g) AS cum, sum(size) OVER () AS t FROM groups),
 pts AS (SELECT 0 AS cum UNION SELECT cum FROM run),
 c0 AS (SELECT coalesce(min(cum), 4e18) AS c FROM pts WHERE cum >= 0.7::DOUBLE * (SELECT sum(size) FROM groups)),
 c1 AS (SELECT coalesce(min(cum), 4e18) AS c FROM pts, c0 WHERE cum >= c0.c AND cum - c0.c >= 0.1::DOUBLE * (SELECT sum(size) FROM groups)),
 c2 AS (SELECT coalesce(min(cum), 4e18) AS c FROM pts, c1 WHERE cum >= c1.c AND cum - c1.c >= 0.1::DOUBLE * (SELECT sum(size) FROM groups)),
 placed AS (SELECT g, CASE WHEN cum - size < c0.c THEN 'train' WHEN cum - size < c1.c THEN 'dev' WHEN cum - size < c2.c THEN 'calib' ELSE 'test' END AS split FROM run, c0, c1, c2)"""
_GROUPED = "SELECT clause_id, label, label_name, CASE WHEN dup_cluster >= 0 THEN dup_cluster END AS dup_cluster FROM clauses"
_RANDOM = f"""WITH rows AS ({_GROUPED}), groups AS (SELECT dup_cluster AS g, count(*) AS size, md5('7:' || dup_cluster) AS k FROM rows WHERE dup_cluster IS NOT NULL GROUP BY 1), {_FILL},
 done AS (SELECT r.*, p.split FROM rows r LEFT JOIN placed p ON p.g = r.dup_cluster)"""


def _random_split(spark, d):
    c = table(spark, d, "clauses", "clause_id", "label", "label_name", "dup_cluster")
    return splits.assign_splits(c.withColumn("dup_cluster", F.when(F.col("dup_cluster") >= 0, F.col("dup_cluster"))))


@query(f"{_RANDOM} SELECT clause_id, dup_cluster, split FROM done")
def split_random(spark, d):
    return _random_split(spark, d).select("clause_id", "dup_cluster", "split")


@query(f"""WITH rows AS (SELECT DISTINCT doc_id, dup_cluster, date, label FROM split_frame), groups AS (SELECT dup_cluster AS g, count(*) AS size, min(date) AS k FROM rows WHERE dup_cluster IS NOT NULL GROUP BY 1), {_FILL}
 SELECT r.doc_id, r.dup_cluster, r.date, p.split FROM rows r LEFT JOIN placed p ON p.g = r.dup_cluster""")
def split_temporal(spark, d):
    rows = table(spark, d, "split_frame").distinct()
    return splits.assign_splits(rows, splits.SplitConfig(mode="temporal")).select("doc_id", "dup_cluster", "date", "split")


@query(f"""{_RANDOM}, top AS (SELECT split, max(n) AS m, sum(n) AS l FROM (SELECT split, label, count(*) AS n FROM done WHERE label IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
 SELECT n.split, count(r.clause_id) AS n_docs, count(DISTINCT r.dup_cluster) AS n_clusters, round(coalesce(any_value(top.m)::DOUBLE / any_value(top.l), 'NaN'::DOUBLE), 6) AS majority_share, count(DISTINCT r.label) AS n_classes
 FROM (VALUES ('train'), ('dev'), ('calib'), ('test')) n(split) LEFT JOIN done r ON r.split = n.split LEFT JOIN top ON top.split = n.split GROUP BY n.split""")
def split_report(spark, d):
    return splits.split_report(_random_split(spark, d))


_PIVOT = "SELECT label, " + ", ".join(f"count(*) FILTER (split = '{s}') AS {s}" for s in splits.SPLITS) + " FROM done GROUP BY label"


@query(f"{_RANDOM} {_PIVOT}")
def label_split_pivot(spark, d):
    return splits.label_pivot(_random_split(spark, d), "label")


@query(f"{_RANDOM} SELECT count(*) FILTER (dev = 0) AS absent_in_dev, count(*) FILTER (dev >= 10) AS with_least_in_dev FROM ({_PIVOT})")
def split_support(spark, d):
    return splits.split_support(splits.label_pivot(_random_split(spark, d), "label"))


@query(f"""WITH rows AS ({_GROUPED}), x AS (SELECT dup_cluster, count(DISTINCT substr(md5('3:' || clause_id), 1, 1) < 'b') AS s, count(*) AS n FROM rows WHERE dup_cluster IS NOT NULL GROUP BY 1)
 SELECT count(*) AS groups, count(*) FILTER (s > 1) AS straddling, coalesce(sum(n) FILTER (s > 1), 0)::BIGINT AS rows_straddling FROM x""")
def naive_vs_group_leakage(spark, d):
    c = table(spark, d, "clauses", "clause_id", "dup_cluster").withColumn("dup_cluster", F.when(F.col("dup_cluster") >= 0, F.col("dup_cluster")))
    return splits.straddling(c.withColumn("split", F.substring(sampling.hash_order(3, "clause_id"), 1, 1) < "b"), "dup_cluster", "split")


# ---- labels and evaluation

MERGES = {"Rent Abatement": "Quiet Enjoyment", "Signage Approval": "Roof Licences", "Kiln Downtime": "Mill Access"}
_MERGE_CASE = "CASE label_name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in MERGES.items()) + " ELSE label_name END"
_RANDOM_PAIRS = """p AS (SELECT label_name, row_number() OVER (ORDER BY md5('7:' || label_name), label_name) - 1 AS i FROM (SELECT DISTINCT label_name FROM label_names)),
 pairs AS (SELECT y.label_name AS from_label, x.label_name AS to_label FROM p x JOIN p y ON y.i = x.i + 1 WHERE x.i % 2 = 0 AND x.i < 12)"""


@query(f"SELECT {_MERGE_CASE} AS merged, count(*) AS n FROM clauses WHERE label_name IS NOT NULL GROUP BY 1")
def label_merge(spark, d):
    c = table(spark, d, "clauses", "label_name").where("label_name is not null")
    return sampling.merge_labels(c, MERGES, "label_name").groupBy("merged").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RANDOM_PAIRS} SELECT coalesce(q.to_label, c.label_name) AS merged, count(*) AS n FROM clauses c LEFT JOIN pairs q ON q.from_label = c.label_name WHERE c.label_name IS NOT NULL GROUP BY 1")
def label_merge_random(spark, d):
    pairs = sampling.random_merges(table(spark, d, "label_names"), "label_name")
    c = table(spark, d, "clauses", "label_name").where("label_name is not null")
    return c.join(F.broadcast(pairs), F.col("label_name") == F.col("from_label"), "left").groupBy(F.coalesce("to_label", "label_name").alias("merged")).agg(F.count(F.lit(1)).alias("n"))


_PRED = """pr AS (SELECT clause_id, text, label AS actual, CASE WHEN substr(md5(text), 1, 1) IN ('0', '1', '2') THEN (label + 1) % 38 ELSE label END AS pred,
 CASE WHEN substr(md5(text), 2, 1) IN ('0', '1') THEN (label + 2) % 38 ELSE label END AS pred2 FROM clauses WHERE label IS NOT NULL AND text IS NOT NULL)"""
_COUNTS = f"""WITH {_PRED}, c AS (SELECT label, sum(s * hit)::BIGINT AS tp, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted FROM
 (SELECT actual AS label, 1 AS s, 0 AS p, (actual = pred)::INT AS hit FROM pr UNION ALL SELECT pred, 0, 1, (actual = pred)::INT FROM pr) GROUP BY label),
 m AS (SELECT label, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0 * tp / nullif(support + predicted, 0), 0)::DOUBLE AS f1, tp, support FROM c)"""


def _predictions(spark, d):
    """Labels of a fixed predictor that is wrong on some texts, and of another."""
    c = table(spark, d, "clauses", "clause_id", "text", "label").where("label is not null and text is not null")
    digit = lambda i: F.substring(F.md5("text"), i, 1)
    wrong = lambda k: (F.col("label") + k) % CLASSES
    return c.select(
        "clause_id", "text", F.col("label").alias("true"), F.when(digit(1).isin("0", "1", "2"), wrong(1)).otherwise(F.col("label")).alias("pred"),
        F.when(digit(2).isin("0", "1"), wrong(2)).otherwise(F.col("label")).alias("pred2"),
    )


@query(f"""WITH {_PRED} SELECT actual AS "true", pred, count(*) AS n FROM pr WHERE actual <> pred GROUP BY 1, 2 ORDER BY n DESC, actual, pred LIMIT 50""")
def confusion_pairs(spark, d):
    return evaluate.top_confusions(_predictions(spark, d))


@query(f"{_COUNTS} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m WHERE support > 0")
def per_class_report(spark, d):
    return evaluate.per_class(_predictions(spark, d), supported=True)


@query(f"""{_COUNTS}, r AS (SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m)
 (SELECT *, 'worst' AS side FROM r ORDER BY f1, label LIMIT 10) UNION ALL (SELECT *, 'best' FROM r ORDER BY f1 DESC, label LIMIT 10)""")
def class_extremes(spark, d):
    return evaluate.extremes(evaluate.per_class(_predictions(spark, d)))


@query(f"""{_COUNTS} SELECT round(avg(f1), 6) AS macro_f1, round(sum(tp)::DOUBLE / sum(support), 6) AS micro_f1, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
 sum(support)::BIGINT AS n, count(*) AS n_classes FROM m""")
def f1_summary(spark, d):
    return evaluate.f1_summary(_predictions(spark, d))


@query("SELECT 40 - count(DISTINCT label) AS zero_support FROM clauses WHERE label IS NOT NULL AND text IS NOT NULL")
def zero_support(spark, d):
    return evaluate.zero_support(_predictions(spark, d), 40)


@query(f"""WITH {_PRED}, t AS (SELECT actual, pred FROM pr WHERE actual <> pred GROUP BY 1, 2 ORDER BY count(*) DESC, actual, pred LIMIT 1)
 SELECT clause_id, pr.actual AS "true", pr.pred, substr(text, 1, 300) AS example FROM pr JOIN t ON t.actual = pr.actual AND t.pred = pr.pred ORDER BY clause_id LIMIT 3""")
def confusion_examples(spark, d):
    return evaluate.confusion_examples(_predictions(spark, d), "clause_id", "text")


@query(f"""WITH {_PRED}, v AS (SELECT list_transform(range(0, 38), lambda i: CASE WHEN i = pred THEN 0.63::DOUBLE ELSE 0.01::DOUBLE END) AS p, actual FROM pr),
 b AS (SELECT list_sum(list_transform(range(0, 38), lambda i: power(p[i + 1] - CASE WHEN i = actual THEN 1 ELSE 0 END, 2))) AS x FROM v) SELECT round(avg(x), 6) AS brier, count(*) AS n FROM b""")
def brier_score(spark, d):
    p = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda i: F.when(i == F.col("pred"), 0.63).otherwise(0.01))
    return evaluate.brier(_predictions(spark, d).withColumn("p", p), "p", "true")


# ---- entities

_SQL_SPACE = _WS
_GL = P.for_python(P.GOVERNING_LAW).replace(r"\s", _SQL_SPACE)
_DT = P.for_python(P.DEFINED_TERM).replace(r"\s", _SQL_SPACE)
_SDT = P.for_python(P.SURVEY_DEFINED_TERM).replace(r"\s", _SQL_SPACE)
_SGL = P.for_python(P.SURVEY_GOVERNING_LAW).replace(r"\s", _SQL_SPACE)
_QC = P.for_python(P.QUOTE_CONTEXT)


def _captured_sql(pattern: str, source: str = "clauses", key: str = "clause_id") -> str:
    return f"SELECT {key}, pos::INT AS pos, entity FROM (SELECT {key}, unnest(regexp_extract_all(text, '{pattern}', 1)) AS entity, generate_subscripts(regexp_extract_all(text, '{pattern}', 1), 1) - 1 AS pos FROM {source})"


@query(_captured_sql(_GL))
def ner_governing_law(spark, d):
    return entities.captured(texts(spark, d, "clauses", "clause_id", "text"), "clause_id", "text", P.GOVERNING_LAW)


@query(_captured_sql(_DT))
def ner_defined_term(spark, d):
    return entities.captured(texts(spark, d, "clauses", "clause_id", "text"), "clause_id", "text", P.DEFINED_TERM)


@query(f"SELECT entity, count(*) AS mentions FROM ({_captured_sql(_DT)}) GROUP BY entity ORDER BY mentions DESC, entity LIMIT 15")
def ner_top_terms(spark, d):
    return entities.capture_frequency(texts(spark, d, "clauses", "clause_id", "text"), "clause_id", "text", P.DEFINED_TERM)


@query(f"""WITH t AS (SELECT unnest(regexp_extract_all(text, '{_SDT}', 1)) AS t FROM documents), k AS (SELECT count(*) AS term_mentions, count(DISTINCT t) AS unique_terms FROM t),
 c AS (SELECT count(*) AS docs, coalesce(sum(regexp_matches(text, '{_SDT}')::INT), 0)::BIGINT AS defined_term_docs, coalesce(sum(regexp_matches(text, '{_SGL}')::INT), 0)::BIGINT AS governing_law_docs,
 coalesce(sum(regexp_matches(text, '{P.MONEY}')::INT), 0)::BIGINT AS money_docs, coalesce(sum(regexp_matches(text, '{P.SLASH_DATE}')::INT), 0)::BIGINT AS slash_date_docs FROM documents) SELECT * FROM c, k""")
def ner_regex_survey(spark, d):
    return entities.survey(texts(spark, d, "documents", "text"), "text")


@query(f"""SELECT clause_id, (i - 1)::INT AS pos, b[i] AS before, p[i] AS phrase FROM (SELECT clause_id, b, p, unnest(range(1, len(p) + 1)) AS i FROM
 (SELECT clause_id, regexp_extract_all(text, '{_QC}', 1) AS b, regexp_extract_all(text, '{_QC}', 2) AS p FROM clauses))""")
def quote_context(spark, d):
    return entities.quote_contexts(texts(spark, d, "clauses", "clause_id", "text"), "clause_id", "text")


# the pieces between matches give SQL the offsets that the engine takes from the matcher
def _offsets_sql(name: str, label: str, pattern: str) -> str:
    return f"""{name}_m AS (SELECT clause_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', 1) AS g FROM clauses),
 {name}_i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m WHERE len(m) > 0),
 {name} AS (SELECT clause_id, g[i] AS text, '{label}' AS label, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + instr(m[i], g[i]) - 1)::INT AS "start" FROM {name}_i)"""


_SPAN_SQL = f"""{_offsets_sql('gl', 'GOVERNING_LAW', _GL.replace("'", "''"))}, {_offsets_sql('dt', 'DEFINED_TERM', _DT.replace("'", "''"))},
 rule AS (SELECT *, "start" + length(text)::INT AS "end", 'rule' AS source FROM (SELECT * FROM gl UNION ALL SELECT * FROM dt)),
 general AS (SELECT clause_id, 'State of' AS text, 'ORG' AS label, "start" - 9 AS "start", "start" - 1 AS "end", 'general' AS source FROM rule WHERE label = 'GOVERNING_LAW'
  UNION ALL SELECT clause_id, 'x' || text, 'GPE', "start" - 1, "end", 'general' FROM rule)"""
_KEPT_SQL = """kept AS (SELECT * FROM general g WHERE NOT EXISTS (SELECT 1 FROM rule r WHERE r.clause_id = g.clause_id AND g."start" < r."end" AND r."start" < g."end")), ents AS (SELECT * FROM kept UNION ALL SELECT * FROM rule)"""


def _rule_spans(spark, d):
    """Spans of both rules in all clauses, however many match."""
    return materialize(entities.rule_entities(texts(spark, d, "clauses", "clause_id", "text"), "clause_id", "text"), "spans")


def _general_spans(rules):
    """Stand-in spans of a general model: one that touches a governing law's sentence part without overlap, and one that overlaps each span."""
    cols = lambda t, lab, s, e: rules.select("clause_id", t.alias("text"), F.lit(lab).alias("label"), s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit("general").alias("source"), F.col("label").alias("of"))
    start, end = F.col("start"), F.col("end")
    return cols(F.lit("State of"), "ORG", start - 9, start - 1).where("of = 'GOVERNING_LAW'").unionByName(cols(F.concat(F.lit("x"), "text"), "GPE", start - 1, end)).drop("of")


@query(f"WITH {_SPAN_SQL} SELECT * FROM rule")
def ner_offsets(spark, d):
    return _rule_spans(spark, d)


@query(f"WITH {_SPAN_SQL}, {_KEPT_SQL} SELECT * FROM ents")
def ner_overlap_suppress(spark, d):
    rules = _rule_spans(spark, d)
    return entities.all_entities(_general_spans(rules), rules, "clause_id")


@query(f"""WITH {_SPAN_SQL}, {_KEPT_SQL} SELECT clause_id, string_agg(label || '=' || texts, ';' ORDER BY label) AS grouped FROM
 (SELECT clause_id, label, string_agg(text, '|' ORDER BY "start", "end") AS texts FROM ents GROUP BY 1, 2) GROUP BY 1""")
def ner_grouped(spark, d):
    rules = _rule_spans(spark, d)
    g = entities.grouped(entities.all_entities(_general_spans(rules), rules, "clause_id"), "clause_id")
    text = F.array_join(F.transform(F.map_entries("entities"), lambda e: F.concat(e.key, F.lit("="), F.array_join(e.value, "|"))), ";")
    return g.select("clause_id", text.alias("grouped"))


_GOLD = f"""gold AS (SELECT DISTINCT {_STRIP('doc_index')} AS doc_index, {_STRIP('label')} AS label, lower({_STRIP('entity_text')}) AS entity FROM gold_labels WHERE doc_index IS NOT NULL AND label IS NOT NULL AND entity_text IS NOT NULL
 AND {_STRIP('doc_index')} <> '' AND {_STRIP('label')} <> '' AND {_STRIP('entity_text')} <> '')"""
_PREDICTED = f"""pred AS (SELECT DISTINCT lpad(clause_id::VARCHAR, 9, '0') AS doc_index, label, lower(entity) AS entity FROM (SELECT clause_id, 'GOVERNING_LAW' AS label, entity FROM ({_captured_sql(_GL)})
 UNION ALL SELECT clause_id, 'DEFINED_TERM', entity FROM ({_captured_sql(_DT)})))"""
_OUTCOME = f"""{_GOLD}, {_PREDICTED}, docs AS (SELECT DISTINCT doc_index FROM gold), p AS (SELECT * FROM pred WHERE doc_index IN (SELECT doc_index FROM docs)),
 outc AS (SELECT coalesce(p.label, g.label) AS label, CASE WHEN g.doc_index IS NULL THEN 'FP' WHEN p.doc_index IS NULL THEN 'FN' ELSE 'TP' END AS outcome FROM p FULL JOIN gold g ON p.doc_index = g.doc_index AND p.label = g.label AND p.entity = g.entity)"""


@query(f"""WITH {_OUTCOME}, c AS (SELECT label, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn FROM outc GROUP BY GROUPING SETS ((), (label)))
 SELECT label, tp, fp, fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 'NaN'::DOUBLE), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 'NaN'::DOUBLE), 6) AS recall,
 round(CASE WHEN tp + fp = 0 OR tp + fn = 0 OR tp = 0 THEN 'NaN'::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c""")
def ner_prf(spark, d):
    """Rule entities of the clauses that have gold labels, against these."""
    gold = docblocks.clean_gold(table(spark, d, "gold_labels"))
    c = table(spark, d, "clauses", "clause_id", "text").withColumn("doc_index", F.lpad(F.col("clause_id").cast("string"), 9, "0"))
    c = c.join(gold.select("doc_index").distinct(), "doc_index", "left_semi")
    found = entities.rule_entities(c, "doc_index", "text").select("doc_index", "label", F.lower("text").alias("entity"))
    return evaluate.precision_recall(evaluate.entity_outcomes(found, gold))


@query(f"""WITH e AS (SELECT clause_id, 'GOVERNING_LAW' AS label FROM ({_captured_sql(_GL)}) UNION ALL SELECT clause_id, 'DEFINED_TERM' FROM ({_captured_sql(_DT)}))
 SELECT label, count(*) AS mentions, count(DISTINCT clause_id) AS docs, round(count(DISTINCT clause_id)::DOUBLE / (SELECT count(*) FROM clauses), 6) AS share FROM e GROUP BY label""")
def ner_label_profile(spark, d):
    c = table(spark, d, "clauses", "clause_id", "text")
    return entities.label_profile(entities.rule_entities(c, "clause_id", "text"), c.count(), "clause_id")


@query(f"""WITH e AS (SELECT clause_id FROM ({_captured_sql(_GL)}) UNION SELECT clause_id FROM ({_captured_sql(_DT)}))
 SELECT count(*) AS docs, count(*) FILTER (e.clause_id IS NULL) AS without, round(count(*) FILTER (e.clause_id IS NULL)::DOUBLE / count(*), 6) AS share FROM clauses c LEFT JOIN e USING (clause_id)""")
def ner_without_entities(spark, d):
    c = table(spark, d, "clauses", "clause_id", "text")
    return entities.without_entities(c, entities.rule_entities(c, "clause_id", "text"), "clause_id")


@query(f"WITH {_GOLD} SELECT DISTINCT doc_index FROM gold WHERE doc_index NOT IN (SELECT lpad(clause_id::VARCHAR, 9, '0') FROM clauses)")
def gold_integrity(spark, d):
    """Gold documents that are not in the corpus: an empty table, or labels to mend."""
    gold = docblocks.clean_gold(table(spark, d, "gold_labels"))
    docs = table(spark, d, "clauses", "clause_id").select(F.lpad(F.col("clause_id").cast("string"), 9, "0").alias("doc_index"))
    return gold.join(docs, "doc_index", "left_anti").select("doc_index").distinct()


@query(f"""SELECT clause_id // 1000 AS numbered, lpad((clause_id % 1000)::VARCHAR, 3, '0') AS doc_index, {_STRIP("coalesce(text, '')")} AS text FROM clauses""")
def docs_parse_blocks(spark, d):
    """All clauses, as sets of 1,000 that three-digit numbers can name; a text that holds a header line has no form as a block and is an error."""
    c = table(spark, d, "clauses", "clause_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    if not c.where(F.col("text").rlike(docblocks.HEADER)).isEmpty():
        raise ValueError("a clause holds a header line")
    head = F.format_string("=== DOC %03d (id=%d) ===\n[CANDIDATES]: none\n", F.pmod("clause_id", F.lit(1000)), F.col("clause_id"))
    numbered = F.floor(F.col("clause_id") / 1000).cast("bigint").alias("numbered")
    blocks = c.select(numbered, F.struct("clause_id", F.concat(head, "text", F.lit("\n")).alias("b")).alias("x"))
    files = blocks.groupBy("numbered").agg(F.concat(F.lit("preamble\n"), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.b), "")).alias("value"))
    return docblocks.parse_blocks(files, numbered="numbered")


# ---- retrieval

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _terms_sql(name: str, source: str, key: str, where: str = "true") -> str:
    return f"{name} AS (SELECT {key} AS doc, term FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {source} WHERE {where}) WHERE term NOT IN ({_STOP}))"


_BM25 = f"""{_terms_sql('dt', 'documents', 'doc_id')}, tf AS (SELECT doc, term, count(*) AS tf FROM dt GROUP BY 1, 2), dl AS (SELECT doc, sum(tf) AS dl FROM tf GROUP BY 1),
 dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM tf)::DOUBLE / (SELECT count(*) FROM documents) AS mean)"""
_TOP = f"""{_BM25}, {_terms_sql('qt', 'documents', 'doc_id', 'doc_id % 100 = 0')}, q AS (SELECT doc AS query_id, term, count(*) AS times FROM qt GROUP BY 1, 2),
 sc AS (SELECT query_id, tf.doc, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score
  FROM q JOIN dfr USING (term) JOIN tf USING (term) JOIN dl ON dl.doc = tf.doc, st GROUP BY 1, 2),
 few AS (SELECT doc_id AS doc FROM documents ORDER BY doc_id LIMIT 20), pad AS (SELECT * FROM sc UNION ALL SELECT d.doc_id, few.doc, 0 FROM documents d, few WHERE d.doc_id % 100 = 0 AND NOT EXISTS (SELECT 1 FROM sc WHERE sc.query_id = d.doc_id AND sc.doc = few.doc)),
 ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank, doc, score FROM pad QUALIFY rank <= 10)"""
_JUDGED = """queries AS (SELECT doc_id AS query_id, agreement_id, source FROM documents WHERE doc_id % 100 = 0),
 judged AS (SELECT q.query_id, d.doc_id AS doc, CASE WHEN d.agreement_id = q.agreement_id THEN 2.0 ELSE 1.0 END::DOUBLE AS grade FROM queries q JOIN documents d ON (d.agreement_id = q.agreement_id OR d.source = q.source) AND d.doc_id <> q.query_id)"""


def _index(spark, d):
    return retrieval.BM25Index.build(texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def _ranking(spark, d):
    """Every document whose id is divisible by 100 as a query against all documents."""
    return _index(spark, d).search(texts(spark, d, "documents", "doc_id", "text").where("doc_id % 100 = 0"), "doc_id", "text")


def _judged(spark, d, ranked):
    """(queries, judgements of the ranked documents, totals): grade 2 for the query's agreement, 1 for its feed, itself left out.

    A feed holds any share of the documents, so pairs of a query and all of its
    feed are never formed: the totals follow from counts by agreement and feed.
    """
    docs = table(spark, d, "documents", "doc_id", "agreement_id", "source")
    q = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("agreement_id").alias("qa"), F.col("source").alias("qs"))
    near = ranked.select("query_id", "doc").join(q, "query_id").join(docs.withColumnRenamed("doc_id", "doc"), "doc").where("doc <> query_id")
    grade = F.when(F.col("agreement_id") == F.col("qa"), 2.0).when(F.col("source") == F.col("qs"), 1.0)
    judgements = near.select("query_id", "doc", grade.alias("grade")).where("grade is not null")
    n = F.count(F.lit(1))
    a = docs.where("agreement_id is not null").groupBy(F.col("agreement_id").alias("qa")).agg(n.alias("na"))
    s = docs.where("source is not null").groupBy(F.col("source").alias("qs")).agg(n.alias("ns"))
    both = docs.where("agreement_id is not null and source is not null").groupBy(F.col("agreement_id").alias("qa"), F.col("source").alias("qs")).agg(n.alias("nb"))
    sizes = q.join(a, "qa", "left").join(s, "qs", "left").join(both, ["qa", "qs"], "left").na.fill(0, ["na", "ns", "nb"])
    own = lambda c: F.col(c).isNotNull().cast("int")
    graded = F.array(F.struct(F.lit(2.0).alias("grade"), (F.col("na") - own("qa")).alias("n")), F.struct(F.lit(1.0).alias("grade"), (F.col("ns") - F.col("nb") - F.when(F.col("qa").isNull(), own("qs")).otherwise(0)).alias("n")))
    return q.select("query_id"), judgements, sizes.select("query_id", F.explode(graded).alias("x")).select("query_id", "x.*")


@query(f"WITH {_BM25} SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM dfr, st")
def bm25_term_stats(spark, d):
    return _index(spark, d).term_stats()


@query(f"WITH {_TOP} SELECT query_id, rank::INT AS rank, doc, score FROM ranked")
def bm25_topk(spark, d):
    return _ranking(spark, d)


@query(f"""WITH {_TOP}, {_JUDGED}, n AS (SELECT query_id, count(*) AS n FROM judged GROUP BY 1), h AS (SELECT r.query_id, count(*) AS h FROM ranked r JOIN judged j USING (query_id, doc) GROUP BY 1)
 SELECT q.query_id, round(CASE WHEN n.n IS NULL THEN 'NaN'::DOUBLE ELSE coalesce(h.h, 0)::DOUBLE / n.n END, 6) AS recall FROM queries q LEFT JOIN n USING (query_id) LEFT JOIN h USING (query_id)""")
def recall_at_k(spark, d):
    r = materialize(_ranking(spark, d), "ranking")
    q, j, t = _judged(spark, d, r)
    return retrieval.recall_at_k(r, j, q, totals=t)


@query(f"""WITH {_TOP}, {_JUDGED}, f AS (SELECT r.query_id, min(rank) AS f FROM ranked r JOIN judged j USING (query_id, doc) GROUP BY 1)
 SELECT q.query_id, round(coalesce(1.0::DOUBLE / f.f, 0), 6) AS rr FROM queries q LEFT JOIN f USING (query_id)""")
def mrr(spark, d):
    r = materialize(_ranking(spark, d), "ranking")
    q, j, t = _judged(spark, d, r)
    return retrieval.reciprocal_rank(r, j, q)


@query(f"""WITH {_TOP}, {_JUDGED}, g AS (SELECT query_id, sum(grade / log2(rank + 1.0::DOUBLE)) AS dcg FROM ranked JOIN judged USING (query_id, doc) GROUP BY 1),
 i AS (SELECT query_id, sum(grade / log2(place + 1.0::DOUBLE)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc) AS place FROM judged QUALIFY place <= 10) GROUP BY 1)
 SELECT q.query_id, round(CASE WHEN coalesce(ideal, 0) = 0 THEN 'NaN'::DOUBLE ELSE coalesce(dcg, 0) / ideal END, 6) AS ndcg FROM queries q LEFT JOIN i USING (query_id) LEFT JOIN g USING (query_id)""")
def ndcg_at_k(spark, d):
    r = materialize(_ranking(spark, d), "ranking")
    q, j, t = _judged(spark, d, r)
    return retrieval.ndcg_at_k(r, j, q, totals=t)


_L2 = "round(sqrt(list_sum(list_transform(list_zip(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), lambda p: power(p[1] - p[2], 2)))), 6)"


@query("WITH z AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(list_distance(embedding::DOUBLE[], e::DOUBLE[]), 6) AS distance FROM embeddings, z ORDER BY 2, 1 LIMIT 5")
def knn_l2(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return retrieval.knn(e, e.orderBy("vec_id").first()["embedding"], "vec_id")


@query("""SELECT query_id, rank::INT AS rank, vec_id, distance FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 5""")
def knn_batch(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return retrieval.knn_batch(e, e.where("vec_id % 100 = 0"), "vec_id")


# ---- statistics


def _scores(spark, d):
    hit = lambda p: (F.col("true") == F.col(p)).cast("double")
    return _predictions(spark, d).select("clause_id", hit("pred").alias("a"), hit("pred2").alias("b"))


def _paired_sql(perms: int) -> str:
    return f"""WITH {_PRED}, x AS (SELECT clause_id, (actual = pred)::INT::DOUBLE - (actual = pred2)::INT AS d FROM pr), o AS (SELECT avg(d) AS m, count(*) AS n FROM x),
 dig AS (SELECT d, j, md5('0:' || j || ':' || clause_id) AS h FROM x, range(0, {-(-perms // 32)}) r(j)),
 nul AS (SELECT j, i, sum(d * CASE WHEN substr(h, i::INT + 1, 1) < '8' THEN 1 ELSE -1 END) / count(*) AS m FROM dig, range(0, 32) r(i) WHERE j * 32 + i < {perms} GROUP BY j, i)
 SELECT round(o.m, 6) AS mean_diff, round(avg((abs(nul.m) >= abs(o.m) - 1e-12)::INT), 6) AS p_value, o.n FROM nul, o GROUP BY o.m, o.n"""


@query(_paired_sql(200))
def paired_randomization(spark, d):
    return stats.paired_test(_scores(spark, d), "clause_id", perms=200)


@query(_paired_sql(10_000))
def paired_randomization_sampled(spark, d):
    return stats.paired_test(_scores(spark, d), "clause_id")


def _drawn_sql(source: str, reps: int) -> str:
    """dr: the rows of a source, with the replicate and how often it draws them."""
    count = " + ".join(f"(u >= {t})::INT" for t in stats.STEPS)
    return f"""dig AS (SELECT *, md5('0:' || j || ':' || clause_id) AS h FROM {source}, range(0, {-(-reps // 8)}) r(j)),
 uu AS (SELECT * EXCLUDE (h, j), j * 8 + i AS rep, ('0x' || substr(h, 4 * i::INT + 1, 4))::INT AS u FROM dig, range(0, 8) r(i) WHERE j * 8 + i < {reps}), dr AS (SELECT *, {count} AS w FROM uu)"""


@query(f"""WITH {_PRED}, x AS (SELECT clause_id, (actual = pred)::INT::DOUBLE AS a FROM pr), {_drawn_sql('x', 2000)}, v AS (SELECT rep, sum(w * a) / sum(w) AS v FROM dr GROUP BY 1)
 SELECT (SELECT round(avg(a), 6) FROM x) AS point, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM v""")
def bootstrap_mean_ci(spark, d):
    return stats.bootstrap_ci(_scores(spark, d), "clause_id", "a", reps=2000)


@query(f"""WITH {_PRED}, x AS (SELECT clause_id, actual, pred FROM pr), {_drawn_sql('x', 500)},
 e AS (SELECT rep, actual AS label, w AS s, 0 AS p, w * (actual = pred)::INT AS tp FROM dr UNION ALL SELECT rep, pred, 0, w, 0 FROM dr),
 f AS (SELECT rep, label, 2.0::DOUBLE * sum(tp) / (sum(s) + sum(p)) AS f FROM e GROUP BY 1, 2 HAVING sum(s) + sum(p) > 0), v AS (SELECT rep, avg(f) AS v FROM f GROUP BY 1),
 g AS (SELECT label, 2.0::DOUBLE * sum(tp) / (sum(s) + sum(p)) AS f FROM (SELECT actual AS label, 1 AS s, 0 AS p, (actual = pred)::INT AS tp FROM x UNION ALL SELECT pred, 0, 1, 0 FROM x) GROUP BY 1)
 SELECT (SELECT round(avg(f), 6) FROM g) AS point, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM v""")
def bootstrap_macro_f1(spark, d):
    return stats.bootstrap_macro_f1(_predictions(spark, d), "clause_id", reps=500)


# ---- TF-IDF, naive Bayes and pipelines


def _grams_sql() -> str:
    return """tk AS (SELECT clause_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}_]{2,}') AS t FROM clauses),
 gr AS (SELECT clause_id, unnest(list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM tk),
 tf AS (SELECT clause_id, term, count(*) AS tf FROM gr GROUP BY 1, 2)"""


_TRAIN = f"sides AS (SELECT clause_id, label, {_SIDE} AS side FROM clauses c), tr AS (SELECT clause_id, label FROM sides WHERE side = 'train' AND label IS NOT NULL)"
_TFIDF = f"""WITH {_grams_sql()}, {_TRAIN}, nd AS (SELECT count(*) AS n FROM tr),
 dfr AS (SELECT term, count(*) AS df FROM tf WHERE clause_id IN (SELECT clause_id FROM tr) GROUP BY 1),
 kept AS (SELECT term, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1 AS idf FROM dfr, nd WHERE df >= 3 AND df <= 0.9::DOUBLE * n),
 w AS (SELECT clause_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN kept USING (term)),
 we AS (SELECT clause_id, term, w / norm AS weight FROM w JOIN (SELECT clause_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) USING (clause_id))"""


def _weights(spark, d):
    c = _clauses(spark, d, "clause_id", "text", "label")
    train = materialize(c.where("side = 'train' and label is not null").select("clause_id", "label"), "labels")
    counts = materialize(classify.term_counts(c, "clause_id", "text"), "counts")
    fitted = classify.Tfidf.fit(counts.join(train.select("clause_id"), "clause_id", "left_semi"), train.count())
    return c, train, fitted.weights(counts, "clause_id")


@query(f"{_TFIDF} SELECT clause_id, count(*) AS terms, round(sum(weight), 6) AS mass, round(max(weight), 6) AS heaviest FROM we GROUP BY 1")
def tfidf_weights(spark, d):
    w = _weights(spark, d)[2]
    return w.groupBy("clause_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 6).alias("mass"), F.round(F.max("weight"), 6).alias("heaviest"))


@query(f"""{_TFIDF}, tw AS (SELECT we.*, label FROM we JOIN tr USING (clause_id)), v AS (SELECT count(DISTINCT term) AS v FROM tw), pri AS (SELECT label, ln(count(*)::DOUBLE / (SELECT n FROM nd)) AS prior FROM tr GROUP BY 1),
 s AS (SELECT label, term, sum(weight) AS s FROM tw GROUP BY 1, 2), t AS (SELECT p.label, coalesce(sum(s), 0) AS t FROM pri p LEFT JOIN s USING (label) GROUP BY 1),
 vt AS (SELECT DISTINCT term FROM tw), dev AS (SELECT clause_id FROM sides WHERE side = 'dev'),
 base AS (SELECT d.clause_id, p.label, prior + coalesce((SELECT sum(weight) FROM we JOIN vt USING (term) WHERE we.clause_id = d.clause_id), 0) * ln(0.1::DOUBLE / (t.t + 0.1::DOUBLE * v)) AS b FROM dev d, pri p JOIN t USING (label), v),
 g AS (SELECT we.clause_id, s.label, sum(weight * (ln((s.s + 0.1::DOUBLE) / (t.t + 0.1::DOUBLE * v)) - ln(0.1::DOUBLE / (t.t + 0.1::DOUBLE * v)))) AS g FROM we JOIN dev USING (clause_id) JOIN s USING (term) JOIN t ON t.label = s.label, v GROUP BY 1, 2)
 SELECT clause_id, label AS pred FROM (SELECT base.clause_id, base.label, row_number() OVER (PARTITION BY base.clause_id ORDER BY round(b + coalesce(g, 0), 9) DESC, base.label) AS r FROM base LEFT JOIN g ON g.clause_id = base.clause_id AND g.label = base.label) WHERE r = 1""")
def nb_predict(spark, d):
    c, train, w = _weights(spark, d)
    w = materialize(w, "weights")
    nb = classify.NaiveBayesTable.fit(w.join(train.select("clause_id"), "clause_id", "left_semi"), train, "clause_id", "label")
    dev = c.where("side = 'dev'").select("clause_id")
    return nb.predict(w.join(dev, "clause_id", "left_semi"), dev, "clause_id", "label")


def _sides(spark, d):
    names = table(spark, d, "label_names").select("label", F.col("label_name").alias("name"))
    c = _clauses(spark, d, "clause_id", "text", "label").join(F.broadcast(names), "label").select("clause_id", "text", F.col("name").alias("label_name"), "side")
    return {s: c.where(F.col("side") == s).drop("side") for s in splits.SPLITS}


def _fitted(spark, d, name, tune=True):
    s = _sides(spark, d)
    return classify.fit_and_score(name, s["train"], s["dev"], tune=tune)


def _metrics(spark, r):
    row = (r.name, r.best["value"], r.best["min_df"], r.best["bigrams"], *(round(r.metrics[m], 6) for m in ("macro_f1", "micro_f1", "accuracy")))
    return spark.createDataFrame([row], "model string, value double, min_df int, bigrams boolean, macro_f1 double, micro_f1 double, accuracy double")


@query()
def ml_logreg(spark, d):
    return _metrics(spark, _fitted(spark, d, "logreg"))


@query()
def ml_linear_svm(spark, d):
    return _metrics(spark, _fitted(spark, d, "linear_svm"))


@query()
def ml_naive_bayes(spark, d):
    return _metrics(spark, _fitted(spark, d, "naive_bayes"))


@query()
def ml_cv(spark, d):
    """All candidates of all models, an equal budget, by 3-fold cross-validation on macro F1."""
    s = _sides(spark, d)
    rows = [(n, v, m, b, round(f1, 6)) for n in sorted(classify.GRIDS) for f1, v, m, b in classify.fit_and_score(n, s["train"], s["dev"]).scores]
    return spark.createDataFrame(rows, "model string, value double, min_df int, bigrams boolean, macro_f1 double")


@query()
def ml_calibrated(spark, d):
    """Brier scores on dev of the tuned linear machine and logistic regression, raw and after both calibrations on the calib split."""
    s, out = _sides(spark, d), None
    for name in ("linear_svm", "logreg"):
        model = classify.fit_and_score(name, s["train"], s["dev"]).model
        known = F.broadcast(spark.createDataFrame(list(enumerate(model.labels)), "label int, label_name string"))
        calib, dev = (materialize(model.apply(s[x].join(known, "label_name").select("label", "text"), "text").select("label", "scores", "p"), "scored") for x in ("calib", "dev"))
        parts = [("raw", dev)] if name == "logreg" else []
        parts += [(m, classify.Calibrated.fit(calib, len(model.labels), m).apply(dev)) for m in ("sigmoid", "isotonic")]
        for method, scored in parts:
            b = evaluate.brier(scored, "p", "label").select(F.lit(name).alias("model"), F.lit(method).alias("method"), "brier", "n")
            out = b if out is None else out.union(b)
    return out


@query()
def ml_label_merge(spark, d):
    """Macro F1 on dev as the labels are, with confused labels merged, and with as many random pairs merged as a control; each refitted."""
    s = _sides(spark, d)
    pairs = sampling.random_merges(table(spark, d, "label_names"), "label_name", len(MERGES))
    control = {r["from_label"]: r["to_label"] for r in pairs.collect()}
    variants = {"as is": {}, "merged": MERGES, "random control": control}
    r = machines.merged_machines(s["train"], s["dev"], variants)
    rows = []
    for variant, merges in variants.items():
        f1 = evaluate.f1_summary(r.predictions.where(F.col("variant") == variant)).first()
        rows.append((variant, len(merges), r.classes[variant], round(f1["macro_f1"], 6), round(f1["micro_f1"], 6)))
    return spark.createDataFrame(rows, "variant string, merges int, classes int, macro_f1 double, micro_f1 double")


@query()
def ml_held_out(spark, d):
    """The tuned linear machine on the test split, which nothing before has seen, with a bootstrap interval of its macro F1."""
    s = _sides(spark, d)
    r = classify.fit_and_score("linear_svm", s["train"], s["test"])
    f1 = stats.bootstrap_macro_f1(r.predictions, "clause_id", reps=1000)
    return f1.crossJoin(_metrics(spark, r).drop("macro_f1"))


# ---- reports

_RUNS = [("full", "baseline", None, 1436.5, 0.0, 0.0, 0.0, 41.77), ("full", "w1", 1, 1271.4, 1.5, 0.4, 0.6, 44.54), ("full", "w4", 4, 3705.0, 1.6, 0.5, 0.7, 13.08), ("full", "w8", 8, 5490.6, 1.7, 0.6, 0.8, 7.69)]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


def _macro_sql(pred: str) -> str:
    return f"""(WITH {_PRED} SELECT round(avg(f), 6) FROM (SELECT label, coalesce(2.0::DOUBLE * sum(tp) / nullif(sum(s) + sum(p), 0), 0) AS f FROM
  (SELECT actual AS label, 1 AS s, 0 AS p, (actual = {pred})::INT AS tp FROM pr UNION ALL SELECT {pred}, 0, 1, 0 FROM pr) GROUP BY label))"""


_MEASURED = f"""SELECT 'classify.baselines' AS experiment, 'first' AS variant, 'dev' AS split, 'f1_macro' AS metric, {_macro_sql('pred')} AS v UNION ALL SELECT 'classify.baselines', 'second', 'dev', 'f1_macro', {_macro_sql('pred2')}
 UNION ALL SELECT 'classify.significance', 'second_vs_first', 'dev', 'p_value', (SELECT p_value FROM ({SQL['paired_randomization']})) UNION ALL SELECT 'ner.extraction', 'rules', 'gold', 'f1', (SELECT f1 FROM ({SQL['ner_prf']}) WHERE label IS NULL)
 UNION ALL SELECT 'retrieval.methods', 'bm25', 'queries', 'ndcg@10', (SELECT round(avg(ndcg), 6) FROM ({SQL['ndcg_at_k']}) WHERE NOT isnan(ndcg))"""


@query(f"""WITH r AS ({_MEASURED}),
 w(place, decision, experiment, metric, lower) AS (VALUES {", ".join(f"({i}, '{a}', '{b}', '{c}', {str(c in report.LOWER_IS_BETTER).lower()})" for i, (a, b, c) in enumerate(report.DECISIONS))}),
 k AS (SELECT w.place, r.variant, v, row_number() OVER z AS rank, lead(v) OVER z AS nv, lead(variant) OVER z AS nx FROM r JOIN w ON w.experiment = r.experiment AND w.metric = r.metric WHERE NOT starts_with(r.experiment, 'classify.') OR split = 'dev'
  WINDOW z AS (PARTITION BY place ORDER BY CASE WHEN lower THEN v ELSE -v END, variant)),
 m AS (SELECT place, string_agg(variant, ', ' ORDER BY rank) AS methods FROM k GROUP BY 1), s AS (SELECT string_split(variant, '_vs_') AS p, v AS p_value FROM r WHERE experiment = 'classify.significance'),
 b AS (SELECT k.*, s.p_value FROM k LEFT JOIN s ON (s.p[1] = variant AND s.p[2] = nx) OR (s.p[2] = variant AND s.p[1] = nx) WHERE rank = 1)
 SELECT w.place, decision, metric, coalesce(methods, '_not run_') AS methods, b.variant AS winner, b.v AS best, round(b.v - b.nv, 6) AS margin, p_value,
 CASE WHEN b.variant IS NULL THEN 'not run' WHEN p_value IS NULL THEN 'not tested' WHEN p_value < 0.05 THEN 'significant' ELSE 'not significant' END AS significance FROM w LEFT JOIN m USING (place) LEFT JOIN b USING (place)""")
def decision_report(spark, d):
    """The decisions that follow from results measured on the tables, stored one by one and loaded again."""
    at = f"{scratch(spark, 'sink')}/results"
    pred = _predictions(spark, d)
    mean = ndcg_at_k(spark, d).where("not isnan(ndcg)").agg(F.round(F.avg("ndcg"), 6)).first()[0]
    for experiment, variant, split, metrics in (
        ("classify.baselines", "first", "dev", {"f1_macro": evaluate.f1_summary(pred).first()["macro_f1"]}),
        ("classify.baselines", "second", "dev", {"f1_macro": evaluate.f1_summary(pred, pred="pred2").first()["macro_f1"]}),
        ("classify.significance", "second_vs_first", "dev", {"p_value": paired_randomization(spark, d).first()["p_value"]}),
        ("ner.extraction", "rules", "gold", {"f1": ner_prf(spark, d).where("label is null").first()["f1"]}),
        ("retrieval.methods", "bm25", "queries", {"ndcg@10": mean}),
    ):
        results.Result(experiment, variant, split, {}, metrics).save(spark, at)
    return report.decision_table(results.load_results(spark, at))


@query(f"""WITH r(split, variant, workers, rate, startup, teardown, scatter, compute) AS (VALUES {_values(_RUNS)}), b AS (SELECT split, max(rate) AS base FROM r WHERE workers IS NULL GROUP BY 1)
 SELECT split, variant, workers::INT AS workers, rate, round(rate / base, 6) AS speedup, round(rate / base / workers, 6) AS efficiency, round(startup + teardown, 6) AS lifecycle_seconds, round(100.0::DOUBLE * scatter / compute, 6) AS scatter_share
 FROM r LEFT JOIN b USING (split) WHERE workers IS NOT NULL""")
def scaling_table(spark, d):
    rows = spark.createDataFrame(_RUNS, "split string, variant string, workers int, rate double, startup double, teardown double, scatter double, compute double")
    return report.scaling_table(rows)


@query()
def entity_stream(spark, d):
    """The clauses as a stream of one file, their entities written by one available-now run and read back."""
    from corpusloom.streaming.incremental import entity_stream as run

    at = scratch(spark, "stream")
    table(spark, d, "clauses", "clause_id", "text").write.parquet(f"{at}/in")
    docs = spark.readStream.schema("clause_id bigint, text string").parquet(f"{at}/in")
    run(docs).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


SQL["entity_stream"] = f"SELECT clause_id, 'GOVERNING_LAW' AS label, entity FROM ({_captured_sql(_GL)}) UNION ALL SELECT clause_id, 'DEFINED_TERM', entity FROM ({_captured_sql(_DT)})"


# ---- sinks, written and read back


@query("SELECT clause_id, label, substr(sha1(text), 1, 16) AS content_id FROM clauses")
def sink_corpus(spark, d):
    """The corpus written by split, and scanned with the content id of each text."""
    at = f"{scratch(spark, 'sink')}/corpus"
    tables.save(table(spark, d, "clauses", "clause_id", "text", "label", "split"), at, by="split")
    return tables.corpus(spark, at).select("clause_id", "label", "content_id")


@query("SELECT label::VARCHAR AS label, label_name FROM label_names")
def sink_csv(spark, d):
    at = f"{scratch(spark, 'sink')}/csv"
    tables.save_csv(table(spark, d, "label_names"), at)
    return spark.read.csv(at, header=True)


@query(f"WITH {_BM25} SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM dfr, st")
def sink_index(spark, d):
    """The statistics of an index that was saved and loaded."""
    at = f"{scratch(spark, 'sink')}/index"
    _index(spark, d).save(at)
    return retrieval.BM25Index.load(spark, at).term_stats()


@query(f"WITH {_GOLD} SELECT doc_index, label, entity FROM gold")
def sink_gold(spark, d):
    """Gold labels written as a review batch, read back and cleaned."""
    at = f"{scratch(spark, 'sink')}/gold"
    docblocks.write_candidates(table(spark, d, "gold_labels"), at)
    return docblocks.read_gold(spark, at).select("doc_index", "label", "entity")


@query("SELECT 'profile' AS experiment, label_name AS variant, 'full' AS split, count(c.label)::DOUBLE AS rows FROM label_names n LEFT JOIN clauses c USING (label) GROUP BY label_name".replace("label_name AS variant", "n.label_name AS variant").replace("GROUP BY label_name", "GROUP BY n.label_name"))
def sink_results(spark, d):
    """The number of clauses of each label, stored as experiment results and loaded again in the order of their paths."""
    at = f"{scratch(spark, 'sink')}/results"
    n = table(spark, d, "clauses", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    for r in table(spark, d, "label_names").join(n, "label", "left").na.fill(0, ["n"]).collect():  # one result a label
        results.Result("profile", r["label_name"], "full", {}, {"rows": float(r["n"])}).save(spark, at)
    return results.load_results(spark, at, "profile").select("experiment", "variant", "split", F.col("metrics").getItem("rows").alias("rows"))


@query(f"""SELECT lpad((row_number() OVER (ORDER BY md5('7:' || clause_id), clause_id) - 1)::VARCHAR, 3, '0') AS doc_index, {_STRIP("coalesce(text, '')")} AS text FROM
 (SELECT clause_id, text FROM clauses ORDER BY md5('7:' || clause_id), clause_id LIMIT 300)""")
def sink_blocks(spark, d):
    """A labelling set of 300 clauses, written as numbered blocks with an empty label file beside it, and read back."""
    at = scratch(spark, "sink")
    c = sampling.sample_exact(table(spark, d, "clauses", "clause_id", "text"), 300, "clause_id")
    docblocks.write_blocks(sampling.numbered(c, [sampling.hash_order(7, "clause_id"), F.col("clause_id")], 0), f"{at}/docs", "clause_id")
    docblocks.write_template(spark, f"{at}/labels")
    return docblocks.read_blocks(spark, f"{at}/docs").select("doc_index", "text")


@query("SELECT id::INT AS id, label, size::INT AS size FROM (SELECT row_number() OVER (ORDER BY label) AS id, label::VARCHAR AS label, 64 AS size FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL))")
def sink_vectors(spark, d):
    """A vector table of one mean vector a label."""
    e = table(spark, d, "embeddings", "label", "embedding").where("label is not null").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = e.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    rows = [(str(r["label"]), [x["x"] for x in r["v"]]) for r in mean.orderBy("label").collect()]  # one row a label
    return tables.vector_table(spark, rows, "label_vectors").select("id", "label", F.size("embedding").alias("size"))


@query()
def sink_report(spark, d):
    """The lines of the decision report, written as Markdown and read back."""
    at = f"{scratch(spark, 'sink')}/report.md"
    results.write_report(report.markdown(decision_report(spark, d), "dev"), spark, at)
    return spark.read.text(at)


@query()
def sink_model(spark, d):
    """All clauses, classified by a model that was saved and loaded, with the manifest's score."""
    at, s = f"{scratch(spark, 'sink')}/model", _sides(spark, d)
    r = classify.fit_and_score("naive_bayes", s["train"], s["dev"], tune=False)
    tables.save_model(r.model, at, {"macro_f1": round(r.metrics["macro_f1"], 6)})
    model, manifest = tables.load_model(at)
    return classify.classify(model, table(spark, d, "clauses", "clause_id", "text")).select("clause_id", "pred", "confidence", F.lit(manifest["macro_f1"]).alias("dev_macro_f1"))


@query()
def phase_profile(spark, d):
    """Seconds, documents a second and share of the time of the two phases of clustering, and what they found."""
    return profile.phases(texts(spark, d, "clauses", "clause_id", "text"), "clause_id", "text")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Cluster, split whole clusters, report."""
    c = texts(spark, d, "clauses", "clause_id", "text", "label")
    rows = c.join(neardup.clusters(c, "clause_id", "text"), "clause_id", "left").withColumnRenamed("cluster_id", "dup_cluster")
    return splits.split_report(splits.assign_splits(rows))


__all__ = ["QUERIES", "SQL", "flagship", "tables"]
