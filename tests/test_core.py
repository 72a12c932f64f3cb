import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import text as T
from corpusloom.functions.hashing import RangeHash, U, bloom_add, bloom_bits, bloom_has, mix
from corpusloom.operators import classify, entities, evaluate, linear, neardup, profile, retrieval, sampling, splits, stats
from corpusloom.operators.components import components
from corpusloom.plans import lineage, report, skew
from corpusloom.sources import docblocks, results, tables


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


# ---- text


def test_normalised_words_and_shingles(spark):
    rows = [(1, " A  b C d e F "), (2, "one two"), (3, ""), (4, None), (5, "a b c d e a b c d e")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r for r in df.select("id", T.normalised(F.col("text")).alias("n"), T.word_count(F.col("text")).alias("w"), T.shingles(F.col("text")).alias("s")).collect()}
    assert got[1]["n"] == "a b c d e f" and got[1]["w"] == 6 and got[1]["s"] == ["a b c d e", "b c d e f"]
    assert got[2]["s"] == ["one two"] and got[3]["s"] == [""] and got[3]["w"] == 0
    assert got[4]["n"] is None and len(got[5]["s"]) == 5


def test_tokens_bigrams_accents(spark):
    r = spark.createDataFrame([("Él a b_c dé 42",)], "t string").select(T.tokens(F.col("t")).alias("t"), T.with_bigrams(T.tokens(F.col("t"))).alias("b"), T.without_accents(F.col("t")).alias("a")).first()
    assert r["t"] == ["él", "b_c", "dé", "42"] and r["b"][-3:] == ["él b_c", "b_c dé", "dé 42"] and r["a"] == "El a b_c de 42"


def test_range_hash_and_bloom():
    s = mix(np.arange(40, dtype=U) % U(5))
    rh = RangeHash(s)
    a = rh(np.array([0, 5, 10, 1]), np.array([7, 12, 17, 8]))
    assert a[0] == a[1] == a[2] != a[3]
    bits = bloom_bits(1000)
    f = np.zeros(bits, np.uint8)
    keys = mix(np.arange(1000, dtype=U))
    bloom_add(f, keys)
    packed = np.packbits(f, bitorder="little")
    assert bloom_has(packed, keys).all() and bloom_has(packed, mix(np.arange(5000, 9000, dtype=U))).mean() < 0.05


# ---- plans


def test_lookup_join_with_hot_keys(spark):
    left = lineage.materialize(spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("id")).cast("bigint").alias("k"), "id"))
    right = left.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("lo"))
    for weight in (None, "m"):
        out = skew.lookup_join(left, right, "k", weight=weight)
        assert out.count() == left.where("k is not null").count() and ("m" in out.columns) == (weight is None)
    assert skew.lookup_join(left, right.where("k <> 7"), "k", "left").count() == 200_000
    lineage.release(left)


class Session:
    """What shared_dir asks of a session."""

    def __init__(self, at, master):
        self.conf = self.sparkContext = self
        self.at, self.master, self.applicationId = at, master, f"app-{master}"

    def get(self, key, default=None):
        return self.at if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self


def test_shared_folder_is_read_from_the_session(spark):
    assert lineage.shared_dir(Session("hdfs://x/cp/", "yarn")) == "hdfs://x/cp"
    assert lineage.shared_dir(Session(None, "local[2]")).startswith("file:///")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Session(None, "local-cluster[2,1,1024]"))
    t = lineage.materialize(spark.range(5))
    path = t._corpusloom_path.removeprefix("file://")
    assert t.count() == 5 and os.path.exists(path)
    lineage.release(t)
    assert not os.path.exists(path)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookups_of_hot_keys_equal_plain_joins(spark, monkeypatch, how):
    from corpusloom.plans import skew

    monkeypatch.setattr(skew, "LOOKUP_ROWS", 1)
    left = lineage.materialize(spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 400).alias("k"), F.col("id").alias("x")))
    right = left.where("k is not null and k <> 11").groupBy("k").agg(F.max("x").alias("y"), F.count(F.lit(1)).alias("w"))
    want = sorted(map(repr, left.join(right.drop("w"), "k", how).select("k", "x", "y").collect()))
    for got in (skew.lookup_join(left, right, "k", how, weight="w"), skew.lookup_join(left, right.drop("w"), "k", how)):
        assert sorted(map(repr, got.select("k", "x", "y").collect())) == want
    assert components(left.where("k is not null").select(F.col("k").alias("a"), F.col("x").alias("b")), tail=0).count() == components(left.where("k is not null").select(F.col("k").alias("a"), F.col("x").alias("b"))).count()


# ---- near-duplicates


def test_components_on_chain_star_and_cycle(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000, 2001), (2001, 2002), (2002, 2000), (5, 5), (None, 3)]
    got = dict(values(components(spark.createDataFrame(edges, "a bigint, b bigint"), tail=0), "id", "root"))
    assert got == dict(values(components(spark.createDataFrame(edges, "a bigint, b bigint")), "id", "root"))
    assert {got[i] for i in range(201)} == {0} and got[1049] == 1000 and got[2002] == 2000 and len(got) == 254
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == components(spark.createDataFrame([], "a bigint, b bigint"), tail=-1).collect() == []


@pytest.mark.parametrize("mode", ["exact", "lsh", "lsh_verified"])
def test_clusters(spark, mode):
    base = "this agreement shall be governed by the laws of the state without regard to any conflict of laws rule at all in force"
    rows = [(i, base if i % 2 else base.upper() + " ") for i in range(6)] + [(6, "other words entirely for this one here"), (7, ""), (8, ""), (9, None)]
    got = dict(values(neardup.clusters(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", mode), "id", "cluster_id"))
    assert [got[i] for i in range(9)] == [0] * 6 + [1, 2, 2] and 9 not in got


def test_clusters_do_not_depend_on_order(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(words[: 20 + i % 10])) for i in range(40)]
    a = neardup.clusters(spark.createDataFrame(rows, "id bigint, text string"), "id", "text")
    rng.shuffle(rows)
    b = neardup.clusters(spark.createDataFrame(rows, "id bigint, text string"), "id", "text")
    assert profile.partition_diff(a, b, "id").collect() == []
    with pytest.raises(ValueError):
        neardup.clusters(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", "other")


def test_band_shape():
    assert neardup.band_shape(0.8, 128) == (9, 13) and neardup.band_shape(0.6, 64) == (10, 6)


# ---- splits


def frame(spark, n=200):
    return spark.sql(f"select concat('d', id) as doc_id, cast(id div 4 as int) as dup_cluster, timestampadd(DAY, cast(id as int), timestamp'2000-01-01') as date, cast(id % 5 as int) as label from range({n})")


def loop_fill(sizes, fractions):
    total, at, filled, out = sum(sizes), 0, 0, []
    for s in sizes:
        while at < 3 and filled >= fractions[at] * total:
            at, filled = at + 1, 0
        out.append(splits.SPLITS[at])
        filled += s
    return out


@pytest.mark.parametrize("mode", ["random", "temporal"])
def test_no_cluster_straddles_and_quotas_hold(spark, mode):
    out = splits.assign_splits(frame(spark), splits.SplitConfig(mode=mode))
    assert out.groupBy("dup_cluster").agg(F.count_distinct("split").alias("n")).agg(F.max("n")).first()[0] == 1
    n = {r["split"]: r["n_docs"] for r in splits.split_report(out).collect()}
    assert set(n) == set(splits.SPLITS) and n["train"] == 140 and n["dev"] == 20
    if mode == "temporal":
        last, first = out.where("split = 'train'").agg(F.max("date")).first()[0], out.where("split = 'test'").agg(F.min("date")).first()[0]
        assert last < first


@pytest.mark.parametrize("seed", range(4))
def test_closed_form_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 1, 2, 5, 40]) for _ in range(30)]
    fractions = [(0.7, 0.1, 0.1, 0.1), (0.5, 0.0, 0.2, 0.3), (0.0, 0.4, 0.3, 0.3), (1.0, 0.0, 0.0, 0.0)][seed]
    rows = [(g, g) for g, s in enumerate(sizes) for _ in range(s)]
    df = spark.createDataFrame(rows, "dup_cluster int, day int").withColumn("date", F.timestamp_add("DAY", F.col("day"), F.lit("2001-01-01").cast("timestamp")))
    got = dict(values(splits.assign_splits(df, splits.SplitConfig(fractions, "temporal")).select("dup_cluster", "split").distinct(), "dup_cluster", "split"))
    assert [got[g] for g in range(30)] == loop_fill(sizes, fractions)


def test_split_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, None)], "dup_cluster int, date timestamp")
    out = splits.assign_splits(df, splits.SplitConfig(mode="temporal"))
    assert values(out.where("dup_cluster = 1"), "split") == ["train", "train"] and out.where("dup_cluster is null").first()["split"] is None
    assert splits.assign_splits(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="dedup"):
        splits.assign_splits(df.drop("dup_cluster"))
    with pytest.raises(ValueError):
        splits.assign_splits(df, splits.SplitConfig((0.5, 0.1, 0.1, 0.1)))
    with pytest.raises(ValueError):
        splits.assign_splits(df, splits.SplitConfig(mode="by moon"))


# ---- entities


def found(spark, text):
    rows = entities.rule_entities(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").collect()
    return [(r["label"], r["text"], text[r["start"] : r["end"]]) for r in rows]


@pytest.mark.parametrize(
    "text, label, wanted",
    [
        ("governed by the laws of the State of New York without regard", "GOVERNING_LAW", ["New York"]),
        ("laws of the State of Georgia.", "GOVERNING_LAW", ["Georgia"]),
        ("BY THE LAWS OF THE STATE OF NEW YORK.", "GOVERNING_LAW", ["NEW YORK"]),
        ("title and estate of Seller in the leases", "GOVERNING_LAW", []),
        ("under the laws of its State of organization and is", "GOVERNING_LAW", []),
        ("the State of Delaware and construed", "GOVERNING_LAW", ["Delaware"]),
        ("STATE OF AFRICA WITHOUT", "GOVERNING_LAW", ["AFRICA WITHOUT"]),
        ('(this "Amendment") and (the "Company")', "DEFINED_TERM", ["Amendment", "Company"]),
        ("(collectively, the “ Transaction Expenses ”).", "DEFINED_TERM", ["Transaction Expenses"]),
        ('annual base salary ("Base Salary"), paid', "DEFINED_TERM", ["Base Salary"]),
        ('that undated "Term Sheet" only', "DEFINED_TERM", []),
        ('The term "Closing" as used herein', "DEFINED_TERM", []),
        ('The "X" and bathe "Foo Bar"', "DEFINED_TERM", ["Foo Bar"]),
        ("\U0001F600 the “Net Sum” (the “Sum”)", "DEFINED_TERM", ["Sum"]),
    ],
)
def test_rules(spark, text, label, wanted):
    got = [(t, at) for lab, t, at in found(spark, text) if lab == label]
    assert got == [(w, w) for w in wanted]
    jvm = spark.createDataFrame([(text,)], "t string").select(entities.captures(F.col("t"), entities.RULES[label])).first()[0]
    assert jvm == wanted


def test_suppression_grouping_and_models(spark):
    def load():
        return lambda t: [("Georgia.", "GPE", 9, 17), ("State", "ORG", 0, 5), ("x", "ORG", 17, 18)]

    df = spark.createDataFrame([(1, "State of Georgia.x"), (2, None)], "id int, text string")
    rules, general = entities.rule_entities(df, "id", "text"), entities.with_model(df, "id", "text", load)
    both = entities.all_entities(general, rules, "id")
    assert values(both, "text") == ["Georgia", "State", "x"]
    assert entities.grouped(both, "id").first()["entities"] == {"GOVERNING_LAW": ["Georgia"], "ORG": ["State", "x"]}
    touching = spark.createDataFrame([(1, "a", "L", 0, 9, "general"), (1, "b", "L", 8, 10, "general")], general.schema)
    assert values(entities.suppress_overlaps(touching, rules, "id"), "text") == ["a"]


# ---- metrics


def test_classification_metrics(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "ghost"), ("lost", "a")]
    df = spark.createDataFrame(rows, "true string, pred string")
    f = {r["label"]: r for r in evaluate.per_class(df).collect()}
    assert f["ghost"]["f1"] == 0 and f["lost"]["recall"] == 0 and f["a"]["precision"] == 0.5
    s = evaluate.f1_summary(df).first()
    assert s["n_classes"] == 4 and s["accuracy"] == 0.4 and math.isclose(s["macro_f1"], 0.25, abs_tol=1e-6)
    assert evaluate.confusion(df).count() == 3 and evaluate.zero_support(df, 5).first()[0] == 2
    p = df.limit(1).select(F.array(F.lit(0.5), F.lit(0.5)).alias("p"), F.lit(0).alias("y"))
    assert evaluate.brier(p, "p", "y").first()["brier"] == 0.5
    assert evaluate.f1_summary(df.limit(0)).first()["macro_f1"] is None


def test_entity_outcomes(spark):
    pred = spark.createDataFrame([("1", "G", "x"), ("1", "G", "x"), ("2", "D", "y")], "doc_index string, label string, entity string")
    gold = spark.createDataFrame([("1", "G", "x"), ("3", "D", "z")], "doc_index string, label string, entity string")
    m = {r["label"]: r for r in evaluate.precision_recall(evaluate.entity_outcomes(pred, gold)).collect()}
    assert (m[None]["tp"], m[None]["fp"], m[None]["fn"]) == (1, 1, 1) and m["G"]["f1"] == 1.0 and m["D"]["precision"] == 0.0 and m["D"]["recall"] == 0.0 and math.isnan(m["D"]["f1"])


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, "a", 3.0), (1, 2, "b", 2.0), (2, 1, "c", 1.0)], "query_id int, rank int, doc string, score double")
    judged = spark.createDataFrame([(1, "b", 2.0), (1, "z", 1.0), (2, "q", 1.0)], "query_id int, doc string, grade double")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    recall = dict(values(retrieval.recall_at_k(ranked, judged, q), "query_id", "recall"))
    assert recall[1] == 0.5 and recall[2] == 0 and math.isnan(recall[3])
    assert dict(values(retrieval.reciprocal_rank(ranked, judged, q), "query_id", "rr")) == {1: 0.5, 2: 0.0, 3: 0.0}
    n = dict(values(retrieval.ndcg_at_k(ranked, judged, q), "query_id", "ndcg"))
    assert math.isclose(n[1], (2 / math.log2(3)) / (2 + 1 / math.log2(3)), abs_tol=1e-6) and n[2] == 0 and math.isnan(n[3])
    with pytest.raises(ValueError):
        retrieval.check_ranking(ranked.union(ranked.limit(1)))


def test_bm25_by_hand_and_saved(spark, tmp_path):
    docs = spark.createDataFrame([(1, "lease rent rent"), (2, "lease term"), (3, None), (4, "the of")], "id int, text string")
    index = retrieval.BM25Index.build(docs, "id", "text")
    got = index.search(spark.createDataFrame([(9, "Rent rent lease")], "id int, text string"), "id", "text").collect()
    mean, idf = 5 / 4, lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    w = lambda tf, dl, df: idf(df) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / mean))
    assert [(r["rank"], r["doc"]) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4)] and [r["score"] for r in got[2:]] == [0.0, 0.0]  # filled up to min(k, N)
    assert math.isclose(got[0]["score"], 2 * w(2, 3, 1) + w(1, 3, 2), abs_tol=1e-6) and math.isclose(got[1]["score"], w(1, 2, 2), abs_tol=1e-6)
    assert math.isnan(retrieval.BM25Index.size_mb(spark, f"{tmp_path}/none"))
    index.save(f"{tmp_path}/i")
    again = retrieval.BM25Index.load(spark, f"{tmp_path}/i")
    assert again.docs == 4 and retrieval.BM25Index.size_mb(spark, f"{tmp_path}/i") > 0 and again.term_stats().count() == 3


def test_vectors(spark):
    v = tables.vector_table(spark, [("A", [1.0, 0.0, 0.0, 0.0]), ("B", [0.9, 0.1, 0.0, 0.0]), ("C", [0.0, 0.0, 1.0, 0.0])], "vecs")
    assert [(r["id"], round(r["distance"], 4)) for r in retrieval.knn(v, [1, 0, 0, 0], "id").collect()] == [(1, 0.0), (2, 0.1414), (3, 1.4142)]
    got = retrieval.knn_batch(v, v, "id", k=1, block=2).orderBy("query_id").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(1, 2), (2, 1), (3, 2)]
    assert retrieval.knn_batch(v, v.limit(0), "id").collect() == []
    spark.catalog.dropTempView("vecs")


# ---- statistics


def test_statistics(spark):
    same = spark.createDataFrame([(i, float(i % 3), float(i % 3)) for i in range(50)], "id int, a double, b double")
    assert stats.paired_test(same, "id", perms=200).first()["p_value"] == 1.0
    better = same.withColumn("a", F.col("a") + 0.5)
    assert stats.paired_test(better, "id", perms=500).first()["p_value"] < 0.01
    with pytest.raises(ValueError):
        stats.paired_test(same.withColumn("b", F.lit(None).cast("double")), "id")
    ci = stats.bootstrap_ci(same, "id", "a", reps=500).first()
    assert ci["lo"] <= ci["point"] <= ci["hi"] and ci["point"] == pytest.approx(0.98, abs=0.01)
    assert stats.bootstrap_ci(same.repartition(7), "id", "a", reps=200, seed=3).first() == stats.bootstrap_ci(same.coalesce(1), "id", "a", reps=200, seed=3).first()
    mean = stats.bootstrap_ci(same, "id", "a", lambda x, w: (x * w).sum() / w.sum(), reps=500).first()
    assert tuple(mean) == pytest.approx(tuple(ci), abs=1e-6)
    median = stats.bootstrap_ci(same, "id", "a", lambda x, w: x[np.searchsorted(np.cumsum(w), w.sum() / 2)], reps=300).first()
    assert median["point"] == 1.0 and median["lo"] <= 1.0 <= median["hi"]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate([("a", "a"), ("b", "a"), ("b b", "b b")] * 20)], "id int, true string, pred string")
    m = stats.bootstrap_macro_f1(p, "id", reps=200).first()
    assert m["point"] == pytest.approx(evaluate.f1_summary(p).first()["macro_f1"], abs=1e-6) and m["lo"] < m["point"] < m["hi"]
    none = same.limit(0)
    assert stats.bootstrap_ci(none, "id", "a", reps=10).first()["point"] is None and stats.paired_test(none, "id", perms=10).collect() == []


def test_draws():
    """Poisson weights have mean and variance 1; signs are even."""
    w = stats.poisson_weights([str(i) for i in range(4000)], 50, 1)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1
    assert abs(stats.signs([str(i) for i in range(4000)], 50, 1).mean()) < 0.01


def test_alignment(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id int, x double")
    assert stats.aligned(a, a.withColumn("x", F.col("x") + 1e-12), "id", "x") is a
    for other in (a.withColumn("x", F.col("x") + 1e-6), a.where("id = 1"), a.withColumn("x", F.lit(None).cast("double"))):
        with pytest.raises(ValueError, match="not aligned"):
            stats.aligned(a, other, "id", "x")


def test_chunks(spark):
    got = sampling.chunked(spark.range(10).withColumn("chunk", F.lit(9)).drop("chunk"), "id", 4).orderBy("id").collect()
    assert [r["chunk"] for r in got] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert {r["chunk"] for r in sampling.chunked(spark.range(9), "id", 4).collect()} == {0, 1, 2}  # fewer than asked for
    assert sampling.chunked(spark.range(0), "id", 3).collect() == []


# ---- sampling and labels


def test_sampling(spark):
    df = spark.range(50).withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string")))
    a = values(sampling.sample_exact(df, 10, "id"), "id")
    assert len(a) == 10 and a == values(sampling.sample_exact(df.repartition(5), 10, "id"), "id") and len(values(sampling.sample_exact(df, 99, "id"), "id")) == 50
    n = sampling.numbered(sampling.sample_exact(df, 3, "id"), [sampling.hash_order(7, "id")], 30)
    assert values(n, "doc_index") == ["030", "031", "032"]
    assert sampling.excluding(df, df.where("id < 45"), "id").count() == 5
    assert values(sampling.merge_labels(df.limit(3), {"n0": "n1"}, "name"), "merged")[0] == "n1"
    pairs = sampling.random_merges(df, "name")
    assert pairs.count() == 6 and len({x for r in pairs.collect() for x in r}) == 12


# ---- sources


def test_doc_blocks(spark, tmp_path):
    text = "preamble\n=== DOC 004 (id=a) ===\n[CANDIDATES]: X\n First text \n\n=== DOC 007 (id=b (c)) ===\nSecond\n"
    (tmp_path / "one.txt").write_text(text)
    assert values(docblocks.read_blocks(spark, f"{tmp_path}/one.txt"), "doc_index", "text") == [("004", "First text"), ("007", "Second")]
    (tmp_path / "two.txt").write_text("=== DOC 004 (id=z) ===\nagain")
    with pytest.raises(ValueError, match="004"):
        docblocks.read_blocks(spark, f"{tmp_path}/one.txt", f"{tmp_path}/two.txt")
    (tmp_path / "none.txt").write_text("no header")
    assert docblocks.read_blocks(spark, f"{tmp_path}/none.txt").collect() == []


def test_labelling_files(spark, tmp_path):
    docs = spark.createDataFrame([("004", 1, "Text, one", ["A", "B"]), ("005", 2, None, None)], "doc_index string, id int, text string, c array<string>")
    docblocks.write_blocks(docs, f"{tmp_path}/blocks", "id", candidates="c")
    back = docblocks.read_blocks(spark, f"{tmp_path}/blocks")
    assert values(back, "doc_index", "text") == [("004", "Text, one"), ("005", "")]
    docblocks.write_template(spark, f"{tmp_path}/t")
    docblocks.write_template(spark, f"{tmp_path}/t")
    (tmp_path / "gold.csv").write_text('doc_index,entity_text,label\n004," New York ",GOVERNING_LAW\n004,new york,GOVERNING_LAW\n009,,X\n008,"a, b",DEFINED_TERM\n')
    gold = docblocks.read_gold(spark, f"{tmp_path}/gold.csv")
    assert values(gold, "doc_index", "entity") == [("004", "new york"), ("008", "a, b")]
    with pytest.raises(ValueError, match="008"):
        docblocks.check_gold(gold, docs)
    docblocks.write_candidates(gold.withColumnRenamed("entity", "entity_text"), f"{tmp_path}/cand")
    assert docblocks.read_gold(spark, f"{tmp_path}/cand").count() == 2


def test_result_store_and_report(spark, tmp_path):
    root = f"{tmp_path}/results"
    assert results.load_results(spark, root).collect() == []
    kw = {"git_sha": "x", "created_at": 1.0}
    results.Result("classify.baselines", "svm", "dev", {"z": 1, "a": [2]}, {"f1_macro": 0.8}, {"train": None}, **kw).save(spark, root)
    results.Result("classify.baselines", "nb", "dev", {}, {"f1_macro": 0.7}, **kw).save(spark, root)
    results.Result("classify.baselines", "svm", "test", {}, {"f1_macro": 0.1}, **kw).save(spark, root)
    results.Result("classify.significance", "nb_vs_svm", "dev", {}, {"p_value": 0.2}, **kw).save(spark, root)
    path = results.Result("classify.calibration", "iso", "dev", {}, {"brier": 0.3}, **kw).save(spark, root)
    results.Result("classify.calibration", "iso", "dev", {}, {"brier": 0.2}, **kw).save(spark, root)
    assert json.loads(open(path).read())["metrics"] == {"brier": 0.2}
    all_ = results.load_results(spark, root)
    assert all_.count() == 5 and results.load_results(spark, root, "classify.baselines").count() == 3
    t = {r["decision"]: r for r in report.decision_table(all_).collect()}
    doc = t["Document classification"]
    assert doc["winner"] == "svm" and doc["margin"] == pytest.approx(0.1) and doc["significance"] == "not significant" and t["Storage"]["methods"] == "_not run_"
    assert t["Probability quality"]["margin"] is None
    lines = report.markdown(report.decision_table(all_), "dev")
    results.write_report(lines, spark, f"{tmp_path}/r.md")
    assert "| Document classification | svm, nb |" in open(f"{tmp_path}/r.md").read()
    assert results.config_hash({"a": 1, "b": 2}) == results.config_hash({"b": 2, "a": 1})


def test_table_helpers(spark, tmp_path, sf):
    df = spark.createDataFrame([(1, "x", "train")], "id int, text string, split string")
    tables.save(df, f"{tmp_path}/a.parquet", by="split")
    assert tables.table(spark, str(tmp_path), "a", "id").columns == ["id"] and tables.corpus(spark, f"{tmp_path}/a.parquet").first()["content_id"] == "11f6ad8ec52a2984"
    tables.save_csv(df, f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 1


# ---- classification


def corpus(spark, n=120):
    rng = random.Random(1)
    topics = {"law": "court statute judge appeal", "farm": "grain harvest silo tractor", "ship": "vessel berth cargo port"}
    rows = [(i, (k := rng.choice(list(topics))), " ".join(rng.choices(topics[k].split() + ["the", "of", "and"], k=12))) for i in range(n)]
    return spark.createDataFrame(rows, "clause_id bigint, label_name string, text string")


@pytest.mark.parametrize("name", ["logreg", "naive_bayes", "linear_svm"])
def test_models(spark, tmp_path, name):
    c = corpus(spark)
    r = classify.fit_and_score(name, c.where("clause_id < 90"), c.where("clause_id >= 90"))
    assert r.metrics["accuracy"] > 0.9 and len(r.scores) == classify.BUDGET and r.best["value"] in classify.GRIDS[name]
    tables.save_model(r.model, f"{tmp_path}/m", {"metrics": r.metrics})
    model, manifest = tables.load_model(f"{tmp_path}/m")
    odd = c.limit(3).unionByName(spark.createDataFrame([(900, "law", None), (901, "law", ""), (902, "law", "zzz " * 50_000)], c.schema))
    out = classify.classify(model, odd).collect()
    assert all(x["pred"] in ("law", "farm", "ship") for x in out) and manifest["metrics"] == r.metrics and len(out) == 6
    assert all(x["confidence"] is None if name == "linear_svm" else 0 < x["confidence"] <= 1 for x in out)
    assert tables.load_model(f"{tmp_path}/none") == (None, None)
    few = classify.fit_and_score(name, c.where("clause_id < 90"), c.limit(0), tune=False)
    assert few.predictions.collect() == []


def test_fits_are_at_their_optimum():
    """The gradient of a long fit vanishes, and naive Bayes equals its closed form."""
    rng = np.random.default_rng(0)
    docs = linear.Docs.of(([rng.choice(60, 8, replace=False) for _ in range(200)], [rng.integers(1, 4, 8) for _ in range(200)]))
    y = rng.integers(0, 3, 200)
    x = linear.Design(linear.Space.fit(docs, 1), docs)
    whole = linear.Design(linear.Space.fit(docs, 1), docs, share=2.0)  # nothing is dense
    w = rng.normal(size=(x.d, 3)).astype(np.float32)
    assert np.allclose(x.times(w), whole.times(w), atol=1e-5) and np.allclose(x.back(x.times(w)), whole.back(x.times(w)), atol=1e-4)
    for fit in (linear.fit_logreg, linear.fit_svm):
        ends = [fit(x, y, 3, 1.0, most)[:2] for most in (1, 300)]
        scores = [x.times(a) + b for a, b in ends]
        assert (scores[1].argmax(1) == y).mean() > (scores[0].argmax(1) == y).mean()
    a, b, _ = linear.fit_bayes(x, y, 3, 0.1)
    dense = x.times(np.eye(x.d, dtype=np.float32))
    s = np.stack([dense[y == c].sum(0) for c in range(3)], 1) + 0.1
    assert np.allclose(a, np.log(s / s.sum(0)), atol=1e-4) and np.allclose(np.exp(b), np.bincount(y, minlength=3) / 200)


def test_grid_budget(monkeypatch):
    assert len(classify.grid("logreg")) == classify.BUDGET
    monkeypatch.setitem(classify.GRIDS, "logreg", (1.0,))
    with pytest.raises(ValueError, match="budget"):
        classify.grid("logreg")


def test_tfidf_weights_agree_with_the_space(spark):
    c = corpus(spark, 40)
    counts = classify.term_counts(c, "clause_id", "text")
    w = classify.Tfidf.fit(counts, 40, 2, 0.9).weights(counts, "clause_id")
    a = w.groupBy("clause_id").agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("clause_id").collect()
    docs = classify._docs(classify.vectors(c.orderBy("clause_id"), ["clause_id"], "text").orderBy("clause_id").toPandas(), True)
    row, _, val = linear.Space.fit(docs, 2).place(docs)
    assert [r["n"] for r in a] == np.bincount(row).tolist() and np.allclose([r["s"] for r in a], np.bincount(row, val), atol=1e-4)


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibration(spark, method):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(600):
        y = int(rng.integers(3))
        s = rng.normal(0, 1, 3)
        s[y] += 2
        rows.append(([float(x) for x in s], y))
    df = spark.createDataFrame(rows, "scores array<double>, label int")
    c = classify.Calibrated.fit(df, 3, method)
    p = c.apply(df)
    assert p.select(F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("t")).where("abs(t - 1) > 1e-9").count() == 0
    assert evaluate.brier(p, "p", "label").first()["brier"] < 0.3
    with pytest.raises(ValueError):
        classify.Calibrated.fit(df, 3, "other")
    flat = classify.Calibrated.fit(df.where("label = 0").withColumn("scores", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))), 3, method)
    assert abs(flat.of(np.zeros((1, 3))).sum() - 1) < 1e-9


# ---- streams


def test_incremental_dedup_equals_one_batch(spark, tmp_path):
    from corpusloom.streaming.incremental import IncrementalDedup

    base = " ".join(f"w{i}" for i in range(40))
    rows = [(i, base + f" v{i}" if i % 3 == 0 else f"text number {i} of its own kind entirely") for i in range(30)]
    kind = "clause_id bigint, text string"
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    d = IncrementalDedup(spark, f"{tmp_path}/state")
    docs = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    docs.writeStream.foreachBatch(d.sink()).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    whole = neardup.band_edges(neardup.signatures(spark.createDataFrame(rows, kind), "clause_id", "text", 117), 9, 13)
    assert set(components(d.links()).collect()) == set(components(whole).collect())


def test_windowed_counts(spark, tmp_path):
    from corpusloom.streaming.incremental import windowed_counts

    rows = [("2024-01-01 01:00:00", "a"), ("2024-01-01 05:00:00", "a"), ("2024-01-02 01:00:00", "b"), ("2024-01-09 01:00:00", "b")]
    spark.createDataFrame(rows, "ts string, kind string").select(F.col("ts").cast("timestamp").alias("ts"), "kind").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("ts timestamp, kind string").parquet(f"{tmp_path}/in")
    q = windowed_counts(s, "ts", "kind").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert values(spark.table("w"), "kind", "n") == [("a", 2), ("b", 1), ("b", 1)]


def test_patterns_have_python_forms():
    import re

    for p in (P.GOVERNING_LAW, P.DEFINED_TERM, P.SURVEY_DEFINED_TERM, P.SURVEY_GOVERNING_LAW, P.MONEY, P.SLASH_DATE, P.QUOTE_CONTEXT):
        re.compile(P.for_python(p))
