"""Queries and operators do the whole job: no input is left out, and no size switches the method."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import patterns as P
from corpusloom.functions import tokens
from corpusloom.operators import classify, linear, neardup, retrieval
from corpusloom.sources import docblocks

TEXTS = [
    'laws of the State of New York or the State of Delaware, (the "Company") and (this "Note")',
    "laws of the State of Georgia.",
    'the "Agreement" under the state of Texas, the State of Ohio and the STATE OF UTAH',
    "no rule matches",
    "",
    None,
    'the State of "x" (the "Lender") (the "Lender") State of Delaware State of Nevada',
]


def spans(text):
    rules = {"GOVERNING_LAW": P.GOVERNING_LAW, "DEFINED_TERM": P.DEFINED_TERM}
    return [(m.group(1), lab, m.start(1), m.end(1), "rule") for lab, p in rules.items() for m in re.finditer(P.for_python(p), text or "")]


def with_general(text):
    """Rule spans and the stand-in spans that overlap none, pair by pair."""
    rules = spans(text)
    general = [("State of", "ORG", s - 9, s - 1, "general") for _, lab, s, _, _ in rules if lab == "GOVERNING_LAW"]
    general += [("x" + t, "GPE", s - 1, e, "general") for t, _, s, e, _ in rules]
    return rules + [g for g in general if not any(g[2] < r[3] and r[2] < g[3] for r in rules)]


def test_spans_of_all_matches_and_rules(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "clause_id bigint, text string").write.parquet(f"{tmp_path}/clauses.parquet")
    order = ["clause_id", "text", "label", "start", "end", "source"]
    got = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).select(*order).collect()))
    wanted = sorted((i, *s) for i, t in enumerate(TEXTS) for s in spans(t))
    assert got("ner_offsets") == wanted and {s[2] for s in wanted} == {"GOVERNING_LAW", "DEFINED_TERM"}
    assert any(len(spans(t)) > 2 for t in TEXTS) and all(TEXTS[s[0]][s[3] : s[4]] == s[1] for s in wanted)
    assert got("ner_overlap_suppress") == sorted((i, *s) for i, t in enumerate(TEXTS) for s in with_general(t))
    grouped = {r["clause_id"]: r["grouped"] for r in catalog.QUERIES["ner_grouped"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        found = sorted(with_general(t), key=lambda s: (s[1], s[2], s[4] == "rule", s[3]))
        labels = sorted({s[1] for s in found})
        assert grouped.get(i, "") == ";".join(f"{lab}=" + "|".join(s[0] for s in found if s[1] == lab) for lab in labels)


def test_neighbours_at_a_tie_are_the_smallest_keys(spark):
    """40 copies of one vector, and 20 that differ from it after the sixth digit only, in falling order of ids."""
    rows = [(i, [1.0 + (i % 3 == 0) * 1e-9, 0.0]) for i in range(60, 0, -1)] + [(100, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "id bigint, embedding array<double>").coalesce(1)
    got = retrieval.knn_batch(v, v.where("id = 100"), "id").orderBy("rank").collect()
    assert [(r["id"], r["distance"]) for r in got] == [(i, 1.0) for i in range(1, 6)]


def test_all_clauses_become_blocks(spark, tmp_path):
    rows = [(i, None if i == 7 else f" text {i}\n") for i in (0, 7, 999, 1000, 1007, 25999)]
    spark.createDataFrame(rows, "clause_id bigint, text string").write.parquet(f"{tmp_path}/clauses.parquet")
    got = catalog.QUERIES["docs_parse_blocks"](spark, str(tmp_path)).collect()
    assert {(r["numbered"] * 1000 + int(r["doc_index"]), r["text"]) for r in got} == {(i, (t or "").strip()) for i, t in rows} and len(got) == len(rows)
    block = "=== DOC 001 (id=1) ===\nx\n"
    files = spark.createDataFrame([(1, block), (2, block)], "numbered int, value string")
    assert docblocks.parse_blocks(files, numbered="numbered").count() == 2
    with pytest.raises(ValueError):
        docblocks.parse_blocks(files.union(files), numbered="numbered")


def test_no_term_is_cut_from_a_large_vocabulary(spark):
    terms = 270_000
    text = " ".join(f"w{i}" for i in range(terms))
    df = spark.createDataFrame([(1, text), (2, text), (3, "once only")], "key int, text string")
    docs = classify._docs(classify.vectors(df, ["key"], "text").toPandas(), False)
    assert len(linear.Space.fit(docs, 2).terms) == terms


def test_models_are_tuned(monkeypatch):
    seen = []
    monkeypatch.setattr(catalog, "_sides", lambda spark, d: {"train": None, "dev": None})
    monkeypatch.setattr(catalog, "_metrics", lambda spark, r: r)
    monkeypatch.setattr(classify, "fit_and_score", lambda name, train, dev, tune=True: seen.append((name, tune)))
    for name in ("ml_logreg", "ml_linear_svm", "ml_naive_bayes"):
        catalog.QUERIES[name](None, "")
    assert seen == [("logreg", True), ("linear_svm", True), ("naive_bayes", True)]
    assert classify.MOST_STEPS["logreg"] == 2000 and classify.MOST_STEPS["linear_svm"] == 1000


def test_tokens_strip_accents_and_count_pairs(spark):
    df = spark.createDataFrame([(1, "Café résumé"), (2, "cafe resume x"), (3, None)], "key int, text string")
    got = tokens.term_counts(df, "key", "text", pairs=True).collect()
    assert {(r["key"], r["term"], r["tf"], r["length"]) for r in got} == {(k, t, 1, 2) for k in (1, 2) for t in ("cafe", "resume", "cafe resume")}
    kept = tokens.term_counts(df, "key", "text", accents=False, stop=("resume",)).collect()
    assert {(r["key"], r["term"]) for r in kept} == {(1, "café"), (1, "résumé"), (2, "cafe")}
    lists = {r["key"]: (sorted(r["terms"]), r["length"]) for r in tokens.term_lists(df, "key", "text").collect()}
    assert lists == {1: (["cafe", "resume"], 2), 2: (["cafe", "resume"], 2), 3: ([], 0)}


def test_search_equals_brute_force(spark, monkeypatch):
    """Ties go to the smaller document, documents without a score fill up, blocks of queries change nothing."""
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 2 + i % 5))) for i in range(40)] + [(40, None), (41, "the of"), (42, "alone")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    docs = {i: [w for w in (t or "").split() if w not in ("the", "of")] for i, t in rows}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    dfs = Counter(w for ws in docs.values() for w in set(ws))

    def score(q, d):
        return round(sum(np.log(1 + (n - dfs[w] + 0.5) / (dfs[w] + 0.5)) * docs[d].count(w) / (docs[d].count(w) + 1.5 * (0.25 + 0.75 * len(docs[d]) / mean)) for w in docs[q]), 6)

    for block in (4096, 5):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        got = retrieval.BM25Index.build(df.repartition(5), "id", "text").search(df, "id", "text", 6)
        found = {}
        for r in got.orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append((r["doc"], r["score"]))
        for q in docs:
            want = sorted(((d, score(q, d)) for d in docs), key=lambda x: (-x[1], x[0]))[:6]
            assert [d for d, _ in found[q]] == [d for d, _ in want] and np.allclose([s for _, s in found[q]], [s for _, s in want], atol=2e-6), q


def test_exact_modes_on_odd_texts(spark):
    """Short and empty texts are single shingles; all modes give every text a cluster, null texts none."""
    rows = [(1, "a b c"), (2, " A  b C"), (3, ""), (4, "  "), (5, None), (6, "a b"), (7, " ".join(f"w{i}" for i in range(40))), (8, " ".join(f"w{i}" for i in range(41))), (9, "x " * 50_000), (10, "x x x x x")]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumns({"t": F.lit(1), "n": F.lit(1), "s": F.lit(1)})
    for mode in ("exact", "lsh_verified", "lsh"):
        got = {r["id"]: r["cluster_id"] for r in neardup.clusters(df, "id", "text", mode).collect()}
        assert 5 not in got and len(got) == 9 and got[1] == got[2] and got[3] == got[4] and got[7] == got[8] and got[9] == got[10] and len(set(got.values())) == 5
    assert neardup.clusters(df.limit(0), "id", "text").collect() == []
