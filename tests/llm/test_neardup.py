import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.shingling import hashed, normal, ordered
from corpusloom.llm import blocks, labels, neardup
from corpusloom.llm.blocks import least_overlap
from corpusloom.llm.shingles import sketches

import numpy as np


def sets(rows, k=5):
    out = {}
    for i, t in rows:
        w = (t or "").lower().split()
        if i is not None and len(w) >= k:
            out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    return out


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def groups(rows):
    s = sets(rows)
    ids = sorted(s)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = set()
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if alike(s[i], s[j]):
                linked |= {i, j}
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in linked}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            k = rng.randrange(len(w))
            rng.choice([lambda: w.__setitem__(k, rng.choice(vocab)), lambda: w.insert(k, rng.choice(vocab)), lambda: w.pop(k)])()
        sep = rng.choice([" ", " ", "  ", "\n"])
        rows.append((i + 1, sep.join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows + [(900, None), (901, ""), (902, "one two three four"), (903, "a b c d e"), (904, " A b\tc d E "), (None, "a b c d e")]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "clause_id bigint, text string").withColumns({"id": F.lit(1), "n": F.lit("x"), "set": F.lit(2), "group_id": F.lit(0)})
    got = {r["clause_id"]: r["group_id"] for r in neardup.near_groups(df).collect()}
    assert got == groups(rows)


def test_cross_pairs_equal_brute_force(spark):
    rows = corpus(3)
    side = {i: ("train", "test", "none")[n % 3] for n, (i, _) in enumerate(rows)}
    df = spark.createDataFrame([(i, t, side[i]) for i, t in rows if i is not None], "clause_id bigint, text string, side string")
    got = sorted(map(tuple, neardup.cross_pairs(df, F.col("side") == "train", F.col("side") == "test").collect()))
    s = sets(rows)
    want = sorted((i, j) for i in s for j in s if side[i] == "train" and side[j] == "test" and alike(s[i], s[j]))
    assert got == want and want


@pytest.mark.parametrize("shards", [1, 3])
def test_cut_lists_and_joins_without_filters(spark, monkeypatch, shards):
    """Lists cut into blocks and ranges of length, and keys that no single filter holds, give the same groups and pairs."""
    monkeypatch.setattr(neardup, "LIST", 3)
    if shards > 1:
        monkeypatch.setattr(blocks, "shards_of", lambda n, max_bytes=0: shards)
        monkeypatch.setattr(neardup, "shards_of", lambda n, max_bytes=0: shards)
    rows = corpus(5, 90)
    df = spark.createDataFrame(rows, "clause_id bigint, text string")
    assert {r["clause_id"]: r["group_id"] for r in neardup.near_groups(df).collect()} == groups(rows)
    s = sets(rows)
    df = df.withColumn("side", F.when(F.col("clause_id") % 3 == 0, "test").otherwise("train"))
    got = sorted(map(tuple, neardup.cross_pairs(df, F.col("side") == "train", F.col("side") == "test").collect()))
    assert got == sorted((i, j) for i in s for j in s if i % 3 and j % 3 == 0 and alike(s[i], s[j]))
    counts = {r["id"]: r["pairs"] for r in neardup.cross_counts(df, F.col("side") == "train", F.col("side") == "test").collect()}
    assert counts == Counter(j for _, j in got)


def test_shared_sentences_form_few_candidates(spark, monkeypatch):
    """Texts of sentences from one pool share many lists; what is verified grows with the texts, not with their square."""
    seen = {}
    write = neardup.materialize

    def watch(df, name="t"):
        out = write(df, name)
        if name in ("star", "rest"):
            seen[name] = out.count()
        return out

    monkeypatch.setattr(neardup, "materialize", watch)
    rng = random.Random(6)
    pool = [" ".join(f"w{rng.randrange(2000)}" for _ in range(12)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(8))) for i in range(800)]
    df = spark.createDataFrame(rows, "clause_id bigint, text string")
    assert {r["clause_id"]: r["group_id"] for r in neardup.near_groups(df).collect()} == groups(rows)
    assert seen["star"] + seen["rest"] <= len(rows)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(8)
    whole = rng.integers(0, 2**63, 300).astype(np.uint64)
    for n, m in ((100, 90), (200, 10), (300, 300)):
        a, b = np.sort(whole[:n]), np.sort(whole[300 - m :])
        x, y = (sketches(np.array([0]), s) for s in (a, b))
        bits = sum(int(np.bitwise_xor(i, j)[0].view(np.uint64)).bit_count() for i, j in zip(x, y))
        assert bits <= len(np.setxor1d(a, b)) and (n != m or bits == 0)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "clause_id bigint, text string")
    assert neardup.near_groups(df).collect() == []
    assert neardup.cross_pairs(df, F.col("text") == "a", F.col("text") == "b").collect() == []


def test_long_list_of_near_copies(spark):
    """A group larger than a block, in which every text shares its words with all others."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base + f" x{i}") for i in range(1300)]
    got = neardup.near_groups(spark.createDataFrame(rows, "clause_id bigint, text string")).collect()
    assert len(got) == 1300 and {r["group_id"] for r in got} == {0}


def test_divide_skip_equals_merge():
    rng = np.random.default_rng(4)
    base = np.sort(rng.choice(2**60, 80, replace=False).astype(np.uint64))
    docs = []
    for _ in range(60):
        keep = rng.random(80) > rng.choice([0.02, 0.1, 0.2])
        docs.append(np.sort(np.concatenate([base[keep], rng.integers(0, 2**60, rng.integers(0, 10)).astype(np.uint64)])))
    a, b = np.triu_indices(60, 1)
    assert (blocks.divide_skip(docs, a, b) == blocks.merge_pairs(docs, a, b)).all()
    assert blocks.merge_pairs(docs, a, b).any()


def test_shingle_hashes():
    texts = ["A b c  d e f", None, "", "a b c d", "a b c d e f", "é " * 40]
    by = {}
    for lo, _, doc, h in hashed(texts):
        d, h = ordered(doc, h, None)
        for i, x in zip(d, h):
            by.setdefault(lo + int(i), set()).add(int(x))
    assert by[0] == by[4] and len(by[0]) == 2 and set(by) == {0, 4, 5} and len(by[5]) == 1
    assert normal(" A B ") == "a b" and least_overlap(5) == 4 and least_overlap(6) == 5


def test_a_very_long_text_is_hashed_in_segments():
    text = " ".join(str(i % 1_000_003) for i in range(1_400_000))
    (_, _, doc, h), *rest = hashed([text])
    assert not rest and len(h) == 1_400_000 - 4 and len(np.unique(h)) > 900_000


def test_splits_and_categories_are_cleaned(spark):
    aliases = spark.createDataFrame([("trn", "train"), ("valid", "dev")], "alias string, split string")
    names = spark.createDataFrame([(1, "Mill Access"), (2, "Roof Licences")], "label int, label_name string")
    rows = [(1, " TRN ", 1, "x"), (2, "valid", None, " mill   ACCESS"), (3, "other", None, None), (4, None, 9, "Mill Access")]
    df = spark.createDataFrame(rows, "id int, split string, label int, label_name string").withColumn("side", F.lit("old"))
    got = labels.with_category(labels.with_split(df, aliases), names).orderBy("id").select("side", "category").collect()
    assert list(map(tuple, got)) == [("train", "Mill Access"), ("dev", "Mill Access"), (None, None), (None, None)]
