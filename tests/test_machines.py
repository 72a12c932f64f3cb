"""Machines over all rows: no row is left out of a fit, whatever the number of rows and the memory of a task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.operators import classify, evaluate, linear, machines

TOPICS = {
    "Rent Abatement": "rent premises landlord notice relief", "Quiet Enjoyment": "premises landlord peace possession notice",
    "Signage Approval": "sign facade landlord paint", "Roof Licences": "roof antenna facade ladder", "Kiln Downtime": "kiln heat repair notice", "Mill Access": "mill gate repair road",
}


def corpus(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(list(TOPICS))
        said = name if rng.random() < 0.9 else rng.choice(list(TOPICS))
        rows.append((i, said, " ".join(rng.choices(TOPICS[name].split() + ["the", "of", "shall", "tenant", "landlord"], k=10)), "dev" if i % 4 == 0 else "train"))
    return rows + [(n, "Mill Access", None, "train"), (n + 1, "Mill Access", "", "dev"), (n + 2, None, "roof", "train"), (n + 3, "Unseen", "roof", "dev")]


def by_hand(spark, rows, merges):
    """{key: label} of linear.fit_svm's machines, fitted on all rows to the end."""
    df = spark.createDataFrame([r for r in rows if r[1] is not None], "clause_id bigint, label_name string, text string, side string")
    sides = [classify.vectors(df.where(F.col("side") == s), ["clause_id", "label_name"], "text").toPandas() for s in ("train", "dev")]
    names = [np.array([merges.get(t, t) for t in p["label_name"]]) for p in sides]
    labels = sorted(set(names[0]))
    docs = [classify._docs(p, True) for p in sides]
    space = linear.Space.fit(docs[0], 3)
    w, b, _ = linear.fit_svm(linear.Design(space, docs[0]), np.searchsorted(labels, names[0]), len(labels), 1.0, 5000, tol=1e-7)
    scores = linear.Design(space, docs[1]).times(w) + b
    return {k: (labels[s.argmax()], np.diff(np.sort(s)[-2:])[0]) for k, s in zip(sides[1]["clause_id"], scores)}


@pytest.mark.parametrize("kept", [machines.KEPT, 2000])
def test_machines_are_at_the_optimum_of_all_rows(spark, monkeypatch, kept):
    monkeypatch.setattr(linear, "LEAST", 1e-12)
    monkeypatch.setattr(machines, "LEAST", 1e-9)
    monkeypatch.setattr(machines, "KEPT", kept)
    rows = corpus(600)
    df = spark.createDataFrame(rows, "clause_id bigint, label_name string, text string, side string").repartition(3)
    variants = {"as is": {}, "merged": catalog.MERGES}
    r = machines.merged_machines(df.where("side = 'train'"), df.where("side = 'dev'"), variants)
    assert r.classes == {"as is": 6, "merged": 3}
    for variant, merges in variants.items():
        got = {x["clause_id"]: (x["true"], x["pred"]) for x in r.predictions.where(F.col("variant") == variant).collect()}
        want = by_hand(spark, rows, merges)
        assert set(got) == set(want) == {i for i, t, _, s in rows if s == "dev"}
        assert all(got[i][0] == merges.get(t, t) for i, t, _, s in rows if s == "dev")
        assert all(got[i][1] == pred for i, (pred, lead) in want.items() if lead > 1e-3) and sum(lead > 1e-3 for _, lead in want.values()) > 140


def test_label_merge_fits_all_rows(spark, tmp_path, monkeypatch):
    """The bounds of the tuned models' samples have no say."""
    for bound in ("TUNE_ROWS", "FIT_ROWS"):
        monkeypatch.setattr(classify, bound, 30)
    rows = corpus(400)
    ids = {t: i for i, t in enumerate([*TOPICS, "Unseen"])}
    spark.createDataFrame([(k, text, ids.get(t), s) for k, t, text, s in rows], "clause_id bigint, text string, label int, split string").write.parquet(f"{tmp_path}/clauses.parquet")
    spark.createDataFrame([(i, t) for t, i in ids.items()], "label int, label_name string").write.parquet(f"{tmp_path}/label_names.parquet")
    spark.createDataFrame([("train", "train"), ("dev", "dev")], "alias string, split string").write.parquet(f"{tmp_path}/split_aliases.parquet")
    got = {r["variant"]: r for r in catalog.QUERIES["ml_label_merge"](spark, str(tmp_path)).collect()}
    assert {v: (r["merges"], r["classes"]) for v, r in got.items()} == {"as is": (0, 6), "merged": (3, 3), "random control": (3, got["random control"]["classes"])}
    true = {k: t for k, t, _, s in rows}
    for variant, merges in (("as is", {}), ("merged", catalog.MERGES)):
        want = by_hand(spark, rows, merges)
        f1 = evaluate.f1_summary(spark.createDataFrame([(merges.get(true[k], true[k]), p) for k, (p, _) in want.items()], "true string, pred string")).first()
        assert abs(got[variant]["macro_f1"] - f1["macro_f1"]) < 0.03 and abs(got[variant]["micro_f1"] - f1["micro_f1"]) < 0.03


def test_tables_without_labels_or_rows(spark):
    schema = "clause_id bigint, label_name string, text string"
    none = spark.createDataFrame([], schema)
    some = spark.createDataFrame([(1, "a", "x y"), (2, "b", "y z")], schema)
    assert machines.merged_machines(none, some, {"as is": {}}).predictions.collect() == []
    assert machines.merged_machines(some, none, {"as is": {}}).predictions.collect() == []
    one = machines.merged_machines(some.where("label_name = 'a'"), some, {"as is": {}}).predictions.collect()
    assert {r["pred"] for r in one} == {"a"} and len(one) == 2
