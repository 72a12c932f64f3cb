import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import blocks, canonical, contract, groupsplit, mixing, sampling, spans, tokens, truncation

VOCAB = tokens.VOCABULARY


# ---- contraction


def closure(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def shapes():
    rng = random.Random(5)
    chain = [(f"c{i:04}", f"c{i + 1:04}") for i in range(300)]
    star = [("hub", f"s{i:03}") for i in range(200)]
    ring = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    loose = [(f"x{rng.randrange(80):02}", f"x{rng.randrange(80):02}") for _ in range(50)]
    return chain + star + ring + loose


def test_match_groups(spark):
    pairs = [(a, b) for a, b in shapes() if a != b]
    rows = [(a.upper() if i % 7 == 0 else a, f" {b} " if i % 5 == 0 else b, True) for i, (a, b) in enumerate(pairs)]
    rows += [(b, a, True) for a, b in pairs[:40]] + [("only", "only", True), (None, "c0000", True), ("zz", "c0001", False), ("zy", "c0001", None), (*pairs[0], False)]
    df = spark.createDataFrame(rows, "doc_id_a string, doc_id_b string, is_match boolean").withColumns({"a": F.lit(1), "b": F.lit(2), "id": F.lit(3)})
    got = {r["doc_id"]: r["dup_cluster"] for r in contract.match_groups(df).collect()}
    assert got == closure(pairs)


def test_no_matches(spark):
    assert contract.match_groups(spark.createDataFrame([], "doc_id_a string, doc_id_b string, is_match boolean")).collect() == []


@pytest.mark.parametrize("tail", [0, 25, 10_000])
def test_the_tail_in_one_task(spark, tail):
    rng = random.Random(3)
    edges = [(f"d{rng.randrange(300)}", f"d{rng.randrange(300)}") for _ in range(170)] + [(f"c{i}", f"c{i + 1}") for i in range(60)] + [(None, "x"), ("y", "y")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {x: find(x) for x in root}
    got = contract.contracted(spark.createDataFrame(edges, "a string, b string"), "a", "b", tail=tail).collect()
    assert {r["id"]: r["group"] for r in got} == want and len(got) == len(want)


# ---- canonical copies


def test_collapsed(spark):
    texts = ["Heading: A\nParty: B", "PARTY - b | heading: a!", "heading a party b", None, "", " | \n ...", "x|x", "x", "X\nx", "x"]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "record_id bigint, text string").withColumns({"h": F.lit(1), "key": F.lit(1)})
    got = {r["record_id"]: (r["keep"], r["copies"]) for r in canonical.collapsed(df).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (6, 1), 7: (7, 2), 8: (8, 2), 9: (7, 2), 10: (8, 2)}
    assert canonical.collapsed(spark.createDataFrame([], "record_id bigint, text string")).collect() == []


def test_a_third_are_copies_of_one(spark):
    df = spark.range(3000).select(F.col("id").alias("record_id"), F.when(F.col("id") % 3 == 0, "Same; text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text")).repartition(6)
    got = canonical.collapsed(df).groupBy("copies").count().collect()
    assert {r["copies"]: r["count"] for r in got} == {1000: 1000, 1: 2000}


def test_hot_groups_are_looked_up(spark, monkeypatch):
    """A third of all records are copies of one, and a third of all pairs hang on one id: the hot path gives the same."""
    from corpusloom.plans import skew

    monkeypatch.setattr(skew, "LOOKUP_ROWS", 1)
    df = spark.range(3000).select(F.col("id").alias("record_id"), F.when(F.col("id") % 3 == 0, "Same; text").otherwise(F.concat(F.lit("t"), F.col("id") % 1500)).alias("text"))
    got = {(r["copies"]): r["count"] for r in canonical.collapsed(df).groupBy("copies").count().collect()}
    assert got == {1000: 1000, 2: 2000}
    pairs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hub")).otherwise(F.concat(F.lit("a"), F.col("id"))).alias("doc_id_a"), F.concat(F.lit("b"), F.col("id")).alias("doc_id_b"), F.lit(True).alias("is_match"))
    sizes = contract.match_groups(pairs).groupBy("dup_cluster").count().groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["count"]: r["n"] for r in sizes} == {1001: 1, 2: 2000}


def test_filters_by_shards(spark):
    """With a small bound on filters the copies are the same, and the share of single rows that is shuffled does not grow with the rows."""
    for n in (3_000, 30_000):
        rows = spark.range(n).select(F.col("id").alias("record_id"), F.concat(F.lit("t "), F.when(F.col("id") < n // 10, F.col("id") % 50).otherwise(F.col("id"))).alias("text")).repartition(5)
        got = canonical.collapsed(rows, max_bytes=1 << 10).where("copies > 1").agg(F.count(F.lit(1)), F.count_distinct("keep")).first()
        assert tuple(got) == (n // 10, 50)
        assert blocks.shards_of(n, 1 << 10) >= n // 1000
        h = rows.select("record_id", F.xxhash64("text").alias("h"))
        passed = blocks.repeats(h, "h", n, 1 << 10).where("maybe").count()
        assert n // 10 <= passed <= n // 10 + n * 0.08


def test_canonical_is_any_order_and_script(spark):
    rows = [("Straße|ÉTÉ 5\nb", "B\n été5 | strasse"), ("Straße|ÉTÉ 5\nb", "b!|STRAßE\n\nété, 5"), ("x" * 100_000 + "|y", "Y\n" + "X" * 100_000)]
    got = spark.createDataFrame(rows, "a string, b string").select((canonical.canonical(F.col("a")) == canonical.canonical(F.col("b"))).alias("same")).collect()
    assert [r["same"] for r in got] == [False, True, True]


# ---- tokens


@pytest.fixture(scope="module")
def reference_tokenizer():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def test_encoding_equals_the_public_library(reference_tokenizer):
    rng = random.Random(8)
    alphabet = "abcdefgh ABC 012,.-_'éüøñ日本\U0001F600 \n\t​<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(3000)]
    texts += ["a" * n for n in range(1, 80)] + [" " * n + "x" + " " * n for n in range(40)] + ["=-" * n + "=" * n for n in range(40)] + ["it's we'LL 'S", "x\n y", " lead", "trail ", "  "]
    ids, off = tokens.bpe(VOCAB).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == reference_tokenizer(texts)


def test_exact_merging_equals_speculation():
    b = tokens.Bpe(VOCAB)
    words = [" agreement", "ing", "zzzz", "ééé", " 1234567", "aaaaaaa"]
    b.learn(words)
    assert [list(b.words[w]) for w in words] == [b.exact(w.encode()) for w in words]


def test_encoded_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "x")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r["doc_id"] or 0), r["ids"]) for r in tokens.encoded(df).collect())
    assert got == [(0, [87]), (1, []), (2, []), (3, [15496, 995]), (3, [15496, 995])]


# ---- mixing


def test_mix_shares_and_caps(spark):
    docs = [(i, "word " * 20, ("Big ", "small", "other")[0 if i < 900 else 1 if i < 950 else 2]) for i in range(1000)] + [(1000, None, "big"), (1001, "x", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("feed", F.lit(1))
    goal = spark.createDataFrame([("big", 500, 2), ("small", 300, 3), ("none", 200, 5)], "source string, target_permille int, max_repeats int")
    mix = mixing.Mix(df, goal)
    report = {r["source"]: r for r in mix.report().collect()}
    assert {s for s, r in report.items() if r["unreachable"]} == {"small", "none"}
    assert report["small"]["drawn"] == 150 and report["small"]["most_repeats"] == 3
    assert abs(report["big"]["tokens"] / report["big"]["expected_tokens"] - 1) < 0.15
    rows = mix.documents().collect()
    times = Counter(r["doc_id"] for r in rows)
    assert max(times.values()) <= 3 and len(rows) == sum(r["drawn"] for r in report.values())
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in mixing.Mix(df, goal).documents().collect()]


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("big", 1000, 2)], "source string, target_permille int, max_repeats int")
    mix = mixing.Mix(df, goal)
    assert mix.documents().collect() == [] and not mix.report().first()["unreachable"]


def test_capped_rate():
    for mean, cap in ((0.3, 1), (1.5, 2), (2.9, 3), (0.01, 5)):
        lam = mixing.capped_rate(mean, cap)
        draws = np.minimum(np.random.default_rng(1).poisson(lam, 200_000), cap)
        assert abs(draws.mean() - mean) < 0.01
    assert mixing.capped_rate(2, 2) == float("inf") and mixing.capped_rate(0, 3) == 0
    assert abs(mixing.capped_rate(900, 5000) - 900) < 1e-3 and mixing.capped_rate(1199.9, 1200) > 1200


def test_reachable():
    assert mixing.reachable([500, 300, 200], [1000, 1000, 1000], 100) == [50, 30, 20]
    assert mixing.reachable([500, 300, 200], [10, 1000, 1000], 100) == [10, 54, 36]
    assert mixing.reachable([500, 300, 200], [10, 50, 1000], 100) == [10, 50, 40]  # the second is full only by what the first lacks
    assert mixing.reachable([500, 500, 0], [10, 20, 99], 100) == [10, 20, 0] and mixing.reachable([], [], 5) == []


def test_mix_shares_with_a_feed_out_of_reach(spark):
    """Feeds within reach get their reachable shares, within the error of drawing; what the short feed lacks goes to them by their targets."""
    rng = random.Random(4)
    rows = [(i, "word " * rng.randint(5, 60), ("big", "mid", "tiny")[(i % 20 == 0) + (i % 60 == 0)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("big", 500, 2), ("mid", 200, 9), ("tiny", 300, 2)], "source string, target_permille int, max_repeats int")
    report = {r["source"]: r for r in mixing.Mix(df, goal).report().collect()}
    assert [s for s, r in report.items() if r["unreachable"]] == ["tiny"] and report["tiny"]["tokens"] == 2 * report["tiny"]["t"]
    assert abs(sum(r["reached_permille"] for r in report.values()) - 1000) < 0.01
    assert abs(report["big"]["reachable_permille"] / report["mid"]["reachable_permille"] - 2.5) < 0.01
    for s in ("big", "mid"):
        assert abs(report[s]["reached_permille"] - report[s]["reachable_permille"]) < 25


# ---- spans


def brute_spans(rows, length):
    where = defaultdict(set)
    for i, t in rows:
        for j in range(len(t or "") - length + 1):
            where[t[j : j + length]].add(i)
    out = []
    for i, t in rows:
        run = None
        for j in range(len(t or "") - length + 1):
            if len(where[t[j : j + length]]) > 1:
                if run and j <= run[1]:
                    run[1] = j + length
                else:
                    run = [j, j + length]
                    out.append((i, run))
    return sorted((i, *r) for i, r in out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = "abé\U0001F600 " if seed == 2 else "abcdefgh "
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(15, 90))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [rng.choice(passages)[rng.randrange(5) : rng.randint(20, 90)] if rng.random() < 0.6 else "".join(rng.choice("ijklmnop") for _ in range(rng.randrange(40))) for _ in range(rng.randint(1, 4))]
        rows.append((i, "".join(parts)))
    rows += [(50, None), (51, ""), (52, "ab" * 100), (53, rows[0][1]), (54, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"doc": F.lit(1), "first": F.lit(1), "anchor": F.lit(1)})
    got = sorted(map(tuple, spans.shared_spans(df, length=20, gram=10).collect()))
    assert got == brute_spans(rows, 20) and got


def test_spans_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spans, "_PIECE", 64)
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(120))
    one, two = spans._factors(text, 20, 10), None
    monkeypatch.setattr(spans, "_PIECE", 1 << 20)
    two = spans._factors(text, 20, 10)
    assert sum(one[2] - one[1] + 1) == sum(two[2] - two[1] + 1) == len(text) - 19


def test_shared_shares(spark):
    df = spark.createDataFrame([(1, "x" * 50), (2, "x" * 60 + "y"), (3, None)], "doc_id bigint, text string")
    s = spans.shared_spans(df, length=20, gram=10)
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in spans.shared_shares(df, s).collect()}
    assert got == {1: (50, 50), 2: (61, 60), 3: (0, 0)}
    assert spans.shared_spans(df.limit(0)).collect() == []


# ---- samples


def clauses(spark, n=2000):
    rng = random.Random(2)
    rows = [(i, rng.choice(["train"] * 3 + ["dev", None]), rng.choice(["A"] * 6 + ["B", "B", "C", None]), rng.choice(["s1", "s1", "s2", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key bigint, split string, category string, group string").withColumn("rate", F.lit(1))


def test_sample_meets_targets(spark):
    rows, df = clauses(spark)
    goal = [("train", "A", 300, 1), ("train", "B", 600, 5), ("train", "D", 100, 3), ("dev", "C", 0, 30), ("dev", "A", 1000, 0)]
    s = sampling.TargetSample(df, spark.createDataFrame(goal, "split string, label_name string, target_permille int, min_rows int"), "key")
    n = Counter(r[1] for r in rows if r[1] and r[2])
    have = Counter((r[1], r[2]) for r in rows)
    for r in s.report().collect():
        k = n[r["split"]] // 5
        need = max(r["min_rows"], -(-r["target_permille"] * k // 1000))
        assert (r["need"], r["gap"]) == (need, max(0, need - have[r["split"], r["label_name"]]))
    drawn = s.drawn().collect()
    got = Counter((r["split"], r["category"]) for r in drawn)
    assert all(got[r["split"], r["label_name"]] == r["drawn"] for r in s.report().collect())
    assert len({r["key"] for r in drawn}) == len(drawn)
    assert {r["reason"] for r in drawn if r["category"] == "C"} == {"minimum"}
    # within a category the groups keep about their shares
    group = {r[0]: r[3] for r in rows}
    share = sum(group[r["key"]] == "s1" for r in drawn) / len(drawn)
    assert 0.35 < share < 0.65


def test_rake_margins():
    counts = np.array([[40.0, 10.0], [30.0, 60.0]])
    x = sampling.rake(counts, np.array([20.0, 30.0]), np.array([60.0, 40.0]))
    assert np.allclose(x.sum(1), [20, 30]) and np.allclose(x.sum(0), [30, 20], atol=1e-3) and (x <= counts + 1e-9).all()


def test_empty_sample(spark):
    _, df = clauses(spark, 0)
    goal = spark.createDataFrame([("train", "A", 500, 2), (None, None, None, None)], "split string, label_name string, target_permille int, min_rows int")
    s = sampling.TargetSample(df, goal, "key")
    assert s.drawn().collect() == [] and {r["gap"] for r in s.report().collect()} == {2, 0}


# ---- group splits


def test_group_split(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, -1, rng.randrange(300), 7 if i % 5 == 0 else 3]), rng.choice([0, 0, 1, 2, None]), rng.choice(["train", "dev", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "key bigint, cluster int, label int, side string").withColumns({"unit": F.lit(1), "comp": F.lit(2), "split": F.lit(3)})
    g = groupsplit.GroupSplit(df)
    seen = defaultdict(set)
    for _, c, _, s in rows:
        if c is not None and c >= 0 and s:
            seen[c].add(s)
    assert {r["cluster"] for r in g.broken().collect()} == {c for c, s in seen.items() if len(s) > 1}
    out = g.rows_split().collect()
    assert sorted(r["key"] for r in out) == list(range(3000))
    by = defaultdict(set)
    for r in out:
        if r["cluster"] is not None:
            by[r["cluster"]].add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    share = Counter(r["split"] for r in out)
    assert all(abs(share[n] / 3000 - f) < 0.02 for n, f in zip(groupsplit.SPLITS, groupsplit.FRACTIONS))


def test_group_split_of_nothing(spark):
    g = groupsplit.GroupSplit(spark.createDataFrame([], "key bigint, cluster int, label int, side string"))
    assert g.broken().collect() == [] and g.rows_split().collect() == []
    with pytest.raises(ValueError):
        groupsplit.GroupSplit(spark.createDataFrame([], "key bigint, cluster int, label int, side string"), (0.5, 0.6), ("a", "b"))


def test_anneal_improves():
    rng = random.Random(1)
    sizes = [rng.randint(1, 9) for _ in range(400)]
    labels = [[(rng.randrange(5), s)] for s in sizes]
    want = np.array([0.7, 0.1, 0.1, 0.1]) * sum(sizes)
    tot = np.zeros(5)
    for row in labels:
        for lab, m in row:
            tot[lab] += m
    want_label = np.outer([0.7, 0.1, 0.1, 0.1], tot)
    start = [0] * 400
    before = groupsplit.anneal(sizes, labels, start, want, want_label, random.Random(0), sweeps=0)[1]
    split, cost = groupsplit.anneal(sizes, labels, start, want, want_label, random.Random(0), sweeps=30)
    size = np.bincount(split, weights=sizes, minlength=4)
    cell = np.zeros((4, 5))
    for s, row in zip(split, labels):
        for lab, m in row:
            cell[s, lab] += m
    assert cost < before / 20
    assert abs(groupsplit.deviation(size, want) + groupsplit.deviation(cell, want_label) - cost) < 1e-6 * max(1, cost)


def test_margins_of_a_sample(spark):
    """Drawn rows are counted by group; shares of the groups sum to one in each split."""
    rng = random.Random(12)
    rows = [(i, rng.choice(("train", "dev")), rng.choice("abc"), rng.choice(("x", "x", "y", None))) for i in range(2000)] + [(9000, None, "a", "x"), (9001, "dev", None, "x")]
    df = spark.createDataFrame(rows, "id bigint, split string, category string, `group` string")
    goal = spark.createDataFrame([(s, c, p, 5) for s in ("train", "dev") for c, p in (("a", 600), ("b", 300), ("c", 100))] + [("dev", "z", 0, 4)], "split string, label_name string, target_permille int, min_rows int")
    t = sampling.TargetSample(df, goal, "id")
    drawn = t.drawn().groupBy("split", "category").count().collect()
    report = {(r["split"], r["label_name"]): r for r in t.report().collect()}
    assert {(r["split"], r["category"]): r["count"] for r in drawn} == {k: r["drawn"] for k, r in report.items() if r["drawn"]}
    assert report["dev", "z"]["gap"] == 4 and all(r["gap"] == 0 for k, r in report.items() if k[1] != "z")
    m = t.margins().collect()
    assert sum(r["drawn"] for r in m) == sum(r["drawn"] for r in report.values()) and {r["group"] for r in m} == {"x", "y", ""}
    for s in ("train", "dev"):
        assert abs(sum(r["drawn_permille"] for r in m if r["split"] == s) - 1000) < 0.01 and max(abs(r["residual_permille"]) for r in m if r["split"] == s) < 60
    assert sampling.TargetSample(df.limit(0), goal, "id").margins().collect() == []


def test_rare_labels_over_many_blocks(spark, monkeypatch):
    """A label with one or two components a block keeps the shares over all blocks, as do components of many rows."""
    monkeypatch.setattr(groupsplit, "BLOCK", 100)
    rng = random.Random(2)
    rows, key = [], 0
    for c in range(4000):
        label = 7 if c % 100 == 0 else 8 if c % 50 == 1 else 9 if c % 100 == 2 else c % 5
        for _ in range(12 if label == 9 else rng.choice((1, 1, 1, 2, 3))):
            rows.append((key, c, label, None))
            key += 1
    df = spark.createDataFrame(rows, "key bigint, cluster int, label int, side string")
    out = groupsplit.GroupSplit(df).rows_split().groupBy("label", "split").count().collect()
    n = Counter()
    for r in out:
        n[r["label"], r["split"]] += r["count"]
    for label in (*range(5), 7, 8, 9):
        whole = sum(n[label, s] for s in groupsplit.SPLITS)
        for s, f in zip(groupsplit.SPLITS, groupsplit.FRACTIONS):
            assert abs(n[label, s] / whole - f) <= 0.05, (label, s, n[label, s], whole)


def test_broken_by_comparison(spark):
    rows = [(1, 5, 0, "train"), (2, 5, 0, "dev"), (3, 6, 0, "dev"), (4, 6, 1, "dev"), (5, None, 1, "train"), (6, -1, 1, "dev"), (7, 7, 0, None), (8, 7, 0, "test"), (9, 5, None, None)]
    df = spark.createDataFrame(rows, "key bigint, cluster int, label int, side string")
    got = groupsplit.GroupSplit(df).broken().collect()
    assert [(r["cluster"], r["rows"]) for r in got] == [(5, 2)] and got[0]["moved"] >= 1


@pytest.mark.parametrize("hot", [-1, 3, 8192])
def test_spans_by_blocks_and_windows_equal_brute_force(spark, monkeypatch, hot):
    """Reference blocks of one anchor each, windows of hot anchors, and both together."""
    monkeypatch.setattr(spans, "HOT", hot)
    monkeypatch.setattr(spans, "BLOCK", 2)
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdé🙂 ") for _ in range(n))
    shared = [text(rng.randint(30, 90)) for _ in range(6)]
    rows = []
    for i in range(30):
        t = "".join(rng.choice(shared) if rng.random() < 0.4 else text(rng.randint(5, 60)) for _ in range(5))
        if rng.random() < 0.5 and len(t) > 40:  # an edit inside a passage
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        rows.append((i, t))
    rows += [(90, None), (91, ""), (92, rows[0][1]), (93, "x" * 200), (94, "x" * 150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"doc": F.lit(1), "first": F.lit(1), "n": F.lit(1)})
    got = sorted(map(tuple, spans.shared_spans(df, length=20, gram=10).collect()))
    assert got == sorted(brute_spans(rows, 20)) and got


def test_names_are_ranks_of_stretches():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 3, 300).astype(np.uint32)
    for length in (1, 2, 3, 5, 8, 20):
        names = spans.names(codes, length)
        whole = [tuple(codes[i : i + length].tolist()) for i in range(300 - length + 1)]
        order = {w: r for r, w in enumerate(sorted(set(whole)))}
        first = names[: len(whole)]
        assert len(set(zip(first.tolist(), whole))) == len(set(whole)) and (np.argsort(first, kind="stable") == np.argsort([order[w] for w in whole], kind="stable")).all()


# ---- truncation

WHOLE = [None, "", "  ", "It ends here.", "Annex 4 - Torwick LLC", "Ends.\n\n* * *", "Ends.\n\n- 12 -", "Ends.\n\nPage 3 of 9", "Ends.\n\nBy: ____\nIts: Secretary", "Sum.\n\nItem 1  fee  $3.50\nTotal  $3.50",
         "Ends.\n\nSchedule 3: Roof Licences", 'He said "yes."', "under Section 4.2(d).", "Ends. [End.]", "Ends.\n\nEND OF DOCUMENT", "the last one (emphasis added)", "a quoted part”", "\n\n* * *"]
CUT = ["It ends he", "bis zum 27.", "the sum of $3,", "the sum of $3.", "Ends her…", "Ends her...", "a word\\u20", "a word%E2%8", "Toll conse&#", "It ends he\n\n* * *", "It ends he\n\nPage 3 of 9", "under Section 4", "he ends �", "has sixty ("]
DOUBT = ["payable to Norra Glass Ltd.", "Ends.\n\n14.3 Ferry Timetables."]


def test_endings(spark):
    texts = [(t, truncation.WHOLE) for t in WHOLE] + [(t, truncation.OPEN) for t in CUT] + [(t, truncation.DOUBT) for t in DOUBT]
    texts += [("a. " * 100_000 + "\n" + t, kind) for t, kind in texts if t and t.strip()]
    df = spark.createDataFrame(texts, "_text string, kind int")
    end, state = truncation.ending(F.col("_text"))
    wrong = df.withColumn("_end", end).withColumn("state", state).where("state <> kind").select(F.substring("_text", -40, 40), "kind", "state").collect()
    assert not wrong


def test_small_feeds_are_tested_together(spark):
    """Twelve feeds of ten texts with one incomplete ending each: none shows it alone, all together do."""
    rows = [(10 * f + i, f"{f} {i} " + "w " * (3 + 7 * i + f) + ("cut" if i == 0 else "whole."), f"feed {f}") for f in range(12) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r["doc_id"] for r in truncation.Truncation(df).flagged().where("cut").collect()} == {10 * f for f in range(12)}
    one = df.withColumn("text", F.when(F.col("doc_id") > 0, F.concat("text", F.lit(" end."))).otherwise(F.col("text")))
    assert truncation.Truncation(one).flagged().where("cut").count() == 0  # one of 120 may be chance


def test_truncation_table(spark):
    rng = random.Random(9)
    rows = [(i, f"{i} " + "a " * rng.randint(20, 400) + "b.", "feed") for i in range(600)]
    rows += [(1000 + i, f"{i:03d}" + ("c " * 150)[:296] + "c", " FEED") for i in range(60)]  # cut at 300 characters
    rows += [(2000 + i, f"{i} " + "d " * rng.randint(20, 400) + "d", "broken") for i in range(20)] + [(2100 + i, f"{i} " + "e " * rng.randint(20, 400) + "e.", "broken") for i in range(100)]
    rows += [(2500 + i, f"{i} " + "f " * rng.randint(20, 400) + "f.", "clean") for i in range(300)] + [(2900, "one stray endin", "clean")]
    rows += [(2950 + i, "delivered again and again.", "clean") for i in range(50)]  # one text, no limit
    rows += [(3000, None, "feed"), (3001, "", None), (3002, "whole.", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"feed": F.lit(1), "state": F.lit(1), "chars": F.lit(1), "_end": F.lit(1)})
    t = truncation.Truncation(df)
    sig = {(r["feed"], r["unit"], r["length"]) for r in t.hazards().where("significant").collect()}
    assert sig == {("feed", "chars", 300), ("feed", "bytes", 300)}
    assert {r["feed"] for r in t.transfers().where("significant").collect()} == {"broken"}
    cut = {r["doc_id"] for r in t.flagged().where("cut").collect()}
    assert cut == set(range(1000, 1060)) | set(range(2000, 2020))
    report = {r["source"]: r for r in t.report().collect()}
    assert report["feed"]["docs"] == 661 and report["feed"]["cut_at_limit"] == 60 and report["broken"]["cut"] == 20 and report[None]["cut"] == 0
    assert truncation.Truncation(df.limit(0)).flagged().collect() == []


# ---- every query runs, with the columns its statement gives


def test_queries(spark, sf):
    from corpusloom.llm.queries import oracle_sql, queries

    columns = {
        "p1_found": ["split", "label_name"], "p2_found": ["clause_id_a", "clause_id_b"], "p3_found": ["clause_id", "group_id"], "p4_found": ["dup_cluster"], "p5_found": ["doc_id", "span_start", "span_end"],
        "p6_found": ["keep_id", "copy_id"], "p7_found": ["doc_id", "dup_cluster"], "p8_ids": ["doc_id", "ids"], "p9_found": ["source"], "p10_found": ["doc_id"],
    }
    made = queries()
    assert set(columns) <= set(made) and set(oracle_sql()) <= set(made)
    for name, want in columns.items():
        df = made[name](spark, sf)
        assert df.columns == want and df.count() > 0, name
    assert re.fullmatch(r"p\d+_\w+", " ".join(made).split()[0])


def test_queries_equal_their_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    from corpusloom.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, sf)
        r = con.execute(sql)
        columns = [c[0] for c in r.description]
        assert sorted(columns) == sorted(df.columns), name
        assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, r.fetchall())), name
