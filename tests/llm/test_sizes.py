"""Operators do the whole job, and no size switches the method."""

from collections import Counter

import numpy as np

from corpusloom.llm import groupsplit, truncation


def split_of(spark, rows):
    df = spark.createDataFrame(rows, "key bigint, cluster int, label int, side string")
    return groupsplit.GroupSplit(df).rows_split().collect()


def test_large_clusters_leave_room_for_small_ones(spark):
    """Clusters of 33 % and 20 %: both fit into train, and single rows complete all splits."""
    cluster = lambda i: 0 if i < 990 else 1 if i < 1590 else None
    share = Counter(r["split"] for r in split_of(spark, [(i, cluster(i), i % 3, None) for i in range(3000)]))
    assert all(abs(share[n] / 3000 - f) < 0.01 for n, f in zip(groupsplit.SPLITS, groupsplit.FRACTIONS))


def test_small_tables_are_annealed_by_label(spark):
    """400 rows in clusters of one label each: every component is a large one."""
    rows = [(i, i // 4, i // 4 % 5, None) for i in range(400)]
    out = split_of(spark, rows)
    label = {key: lab for key, _, lab, _ in rows}
    cells = Counter((r["split"], label[r["key"]]) for r in out)
    assert max(abs(cells[n, lab] - f * 80) for n, f in zip(groupsplit.SPLITS, groupsplit.FRACTIONS) for lab in range(5)) <= 4
    assert len({(r["cluster"], r["split"]) for r in out}) == 100


def test_large_components_are_never_worse_than_any_start():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 40, 60).astype(float)
    cells = np.zeros((60, 3))
    cells[np.arange(60), rng.integers(0, 3, 60)] = sizes
    f = np.array(groupsplit.FRACTIONS)
    want, want_label = f * sizes.sum(), np.outer(f, cells.sum(0))
    found = groupsplit.anneal_large(sizes, cells, [[0] * 60], want, want_label, 1)
    size = np.bincount(found, sizes, 4)
    assert np.abs(size / sizes.sum() - f).max() < 0.02


def test_a_limit_behind_a_larger_one_is_found(spark):
    """1,000 texts end at 300; of the 10 longer ones 8 end at 310."""
    lengths = [50 + i % 240 for i in range(480)] + [300] * 1000 + [310] * 8 + [320, 330]
    df = spark.createDataFrame([(i, f"{i:04d}" + "x" * (n - 4), "feed") for i, n in enumerate(lengths)], "doc_id bigint, text string, source string")
    rows = {r["length"]: r for r in truncation.Truncation(df).hazards().where("unit = 'chars'").collect()}
    assert rows[300]["significant"] and rows[310]["significant"] and not rows[320]["significant"]
    for at, r in rows.items():
        near = [j for j in range(max(1, at - 25), at + 26) if j != at]
        ended, risk = sum(lengths.count(j) for j in near), sum(sum(n >= j for n in lengths) for j in near)
        assert abs(r["expected"] - r["at_risk"] * min((ended + 0.5) / risk, 1.0)) < 1e-9
