"""Near-duplicates by likeness of word shingles: groups in one collection, pairs across splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import U, bloom_has, mix
from corpusloom.llm.blocks import DEN, NUM, divide_skip, key_filter, least_overlap, merge_pairs, repeat_filter, repeats, shards_of, verified
from corpusloom.llm.contract import contracted
from corpusloom.llm.shingles import EACH, SHARED, SKETCH, WORDS, prefixes, rarity, sets_of, shared_short
from corpusloom.plans.lineage import materialize, release
from corpusloom.plans.skew import lookup_join

#: Sets of one inverted list that are merged in one task.
LIST = 4096
#: Links that are consolidated in one task; more go through rounds of contraction first.
TAIL = 500_000
_KEYS = [f"k{i}" for i in range(SKETCH)]


def _copies(described: DataFrame, *by: str) -> DataFrame:
    """(id, rep) of rows whose shingle set a smaller id has too; only the sets' signatures are shuffled."""
    keys = ["s1", "s2", "n", *by]
    many = described.groupBy(*keys).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    return materialize(described.select("id", *keys).join(many, keys).where("id <> rep").select("id", "rep"), "copies")


def _picked(rows: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """The rows whose id may be one of the ``count`` rows of keys (id): by a Bloom filter, or by a join where they are too many for one."""
    wanted = key_filter(keys, count)
    return rows.join(keys, "id", "left_semi") if wanted is None else _filtered(rows, wanted, True)


def _filtered(rows: DataFrame, wanted: np.ndarray, inside: bool) -> DataFrame:
    """The rows whose id may be in a packed Bloom filter, or is surely not."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(bloom_has(shared.value, mix(b.column(0).to_numpy().view(U))) == inside))

    return rows.mapInArrow(run, rows.schema)


def _sets(described: DataFrame, copies: DataFrame) -> DataFrame:
    """One row a distinct set.  What a filter of the copies surely lacks stays where it is; only the rest is joined."""
    rows = described.select("id", "n", "prefix", *_KEYS, *[c for c in described.columns if c == "side"])
    wanted = key_filter(copies.select("id"), copies.count())
    if wanted is None:
        return rows.join(copies.select("id"), "id", "left_anti")
    return _filtered(rows, wanted, False).unionByName(_filtered(rows, wanted, True).join(copies.select("id"), "id", "left_anti"))


def _postings(sets: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """(s, id, n, pos, k0..) of the prefix shingles, of those that may be in a packed Bloom filter if one is given.

    A set of which fewer are left than its shortest partner must share has none.
    """
    shared = sets.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for b in batches:
            lists = b.column(2)
            s = lists.flatten().to_numpy().view(U)
            lens = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), lens)
            pos = np.arange(len(s)) - np.repeat(np.cumsum(lens) - lens, lens)
            if shared.value is not None:
                ok = bloom_has(shared.value, mix(s))
                few = np.bincount(row[ok], minlength=b.num_rows) < shared_short(least_overlap(b.column(1).to_numpy().astype(np.int64)))
                keep = np.flatnonzero(ok & ~few[row])
                s, row, pos = s[keep], row[keep], pos[keep]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(pos.astype(np.int32)), *(b.column(i).take(at) for i in range(3, 3 + SKETCH))], names=["s", "id", "n", "pos", *_KEYS]
            )

    return sets.select("id", "n", "prefix", *_KEYS).mapInArrow(run, "s bigint, id bigint, n int, pos int" + "".join(f", {k} bigint" for k in _KEYS))


def _repeated(sets: DataFrame, prefixes_: DataFrame, size: int) -> DataFrame:
    """The postings of shingles that may stand in two prefixes of the ``size`` shingles of prefixes_ (prefix)."""
    if shards_of(size) == 1:
        return _postings(sets, repeat_filter(prefixes_, size))
    posts = materialize(_postings(sets), "postings")
    return repeats(posts, "s", size).where("maybe").drop("maybe")


def _lists(posts: DataFrame) -> DataFrame:
    """The postings of lists with two sets or more, and each list's length m; posts is a written table."""
    lists = posts.groupBy("s").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("s", "m")
    return materialize(lookup_join(posts, lists.withColumn("_m", F.col("m")), "s", weight="_m"), "lists")


def _least(n: Column) -> Column:
    """shared_short() of a column."""
    t = F.floor((NUM * n + DEN - 1) / DEN)
    return F.least(F.greatest(F.lit(SHARED), F.floor(t / EACH)), t)


def _alike(x: str, y: str) -> Column:
    """Whether two postings of one list can be of sets alike enough, by length, position and sketch.

    The c-th shingle in common leaves room for c and what lies behind it in the
    shorter rest, and sketches differ in no more bits than the sets differ in
    shingles, of which a pair alike enough has (DEN - NUM) / (DEN + NUM) of n1 + n2.
    """
    n1, n2 = F.col(f"{x}.n"), F.col(f"{y}.n")
    room = F.least(n1 - F.col(f"{x}.pos"), n2 - F.col(f"{y}.pos")) + (_least(F.least(n1, n2)) - 1)
    bits = sum((F.bit_count(F.col(f"{x}.k{i}").bitwiseXOR(F.col(f"{y}.k{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col(f"{x}.k0").bitwiseXOR(F.col(f"{y}.k0"))))
    length = F.least(n1, n2) * DEN >= F.greatest(n1, n2) * NUM
    return length & (bits * (NUM + DEN) <= (n1 + n2) * (DEN - NUM)) & (room * (NUM + DEN) >= (n1 + n2) * NUM)


def _cut(posts: DataFrame, left: bool) -> DataFrame:
    """posts with the columns part and other, by which a list is cut into tasks.

    A list of more than LIST sets is cut into blocks by id, and each pair of
    blocks into ranges of length a quarter wide: a set goes to its own range
    and, on the right, to those beside it, which hold all that can be alike.  A
    shorter list is one task.
    """
    blocks = F.ceil(F.col("m") / LIST).cast("int")
    own, all_ = F.pmod(F.xxhash64("id"), blocks).cast("int"), F.sequence(F.lit(0), blocks - 1)
    long, width = F.col("m") > LIST, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    cell = lambda j, w: F.struct((own if left else j).alias("i"), (j if left else own).alias("j"), w.alias("w"))
    ranges = F.array(width) if left else F.array(width - 1, width, width + 1)
    cells = F.flatten(F.transform(all_, lambda j: F.transform(ranges, lambda w: cell(j, w))))
    none = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("w")))
    return posts.withColumn("cell", F.explode(F.when(long, cells).otherwise(none)))


def _candidates(both: DataFrame, exact: bool) -> DataFrame:
    """(a, b, w, m) of joined postings x and y: each pair once, with one list it shares and that list's length.

    A pair alike enough shares c lists or more (shingles.shared_short); not
    exact: one is enough, where x and y are not whole lists.
    """
    n = F.least("x.n", "y.n")
    out = both.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.min("x.s").alias("w"), F.max("y.m").alias("m"), F.count(F.lit(1)).alias("shared"), F.min(n).alias("n"))
    return (out.where(F.col("shared") >= _least(F.col("n"))) if exact else out).select("a", "b", "w", "m")


def _pairs(x: DataFrame, y: DataFrame, more: Column) -> DataFrame:
    """The candidates of two sides of the same lists, both with m."""
    x, y = _cut(x, True).alias("x"), _cut(y, False).alias("y")
    return _candidates(x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.cell") == F.col("y.cell")) & more & _alike("x", "y")), True)


def _prepare(df: DataFrame, key: str, text: str, k: int, flags: list[Column]) -> DataFrame:
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), *flags, F.col(text).alias("text"))
    rank = rarity(rows, "text", k)
    return materialize(prefixes(rows, rank, "id", "text", k, tuple(c for c in rows.columns if c not in ("id", "text"))), "sets")


def near_groups(df: DataFrame, key: str = "clause_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """(key, group_id): every row with likeness of at least 0.8 to some other row; group_id is the smallest key linked to it.

    Exact.  A T-occurrence search over inverted lists, each set a query: its
    T - c longest lists are set aside, the others (those of its rarest n - T + c
    shingles) are shuffled by shingle and merged, by counting for each query how
    many of them a set stands in; sets found c times go on and are probed in the
    lists set aside (blocks.divide_skip), and those that reach T are retained.

    Of rows with equal shingle sets the smallest id goes on.  Each list first
    links its members to its smallest only, and only members that these
    verified links leave in different components are merged with each other, so
    a list of near-copies costs its length.  A set enters a merge only where its
    length, its position and the sketch that every posting carries allow T, so
    few pairs come out of a merge that are not alike, however many sets share
    a sentence; lists of more than LIST sets are merged block by block in
    ranges of length.

    Null and empty texts and texts of fewer than k words are never cases; rows
    with a null key have no row; a repeated key counts as a copy.
    """
    described = _prepare(df, key, text, k, [])
    copies = _copies(described)
    distinct = _sets(described, copies)
    size = described.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    lists = _lists(materialize(_repeated(distinct, described.select("prefix"), size), "repeated"))
    release(described)
    ids = materialize(lists.select("id").distinct(), "ids")
    sets = materialize(sets_of(df, key, text, k, ids, ids.count()), "some")
    posts = lists
    heads = posts.groupBy("s").agg(F.min(F.struct("id", "n", "pos", *_KEYS)).alias("f"), F.count(F.lit(1)).alias("_m")).where("_m > 1").select("s", "f", "_m")
    pair = lookup_join(posts, heads, "s", weight="_m").select("s", F.struct("s", "id", "n", "pos", "m", *_KEYS).alias("y"), F.struct("s", "f.*").alias("x")).where((F.col("x.id") < F.col("y.id")) & _alike("x", "y"))
    star = materialize(_candidates(pair, False), "star")
    near = materialize(verified(star, sets, divide_skip), "near")

    known = materialize(contracted(near, "a", "b", tail=TAIL).withColumnRenamed("group", "c"), "known")
    tagged = lambda rows: rows.join(known, "id", "left").withColumn("c", F.coalesce("c", "id"))
    mixed = tagged(posts.select("s", "id")).groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("_m")).where("lo < hi").select("s", "_m")
    open_ = materialize(tagged(lookup_join(posts, materialize(mixed, "mixed"), "s", weight="_m")), "open")
    apart = (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c"))
    rest = materialize(_pairs(open_, open_, apart).join(star.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    ends = rest.select(F.col("a").alias("id")).union(rest.select("b"))
    more = materialize(verified(rest, _picked(sets, ends, 2 * rest.count()), divide_skip), "more")
    release(ids, star, sets, posts, open_, rest)

    # links between components, then the groups of all their members, then the copies
    at = lambda c, to: known.select(F.col("id").alias(c), F.col("c").alias(to))
    between = more.join(at("a", "ca"), "a", "left").join(at("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = materialize(contracted(between, "a", "b", tail=TAIL), "joined")
    lone = joined.join(known.select("id"), "id", "left_anti").select(F.col("id").alias("rep"), "group")
    linked = known.join(joined.select(F.col("id").alias("c"), "group"), "c", "left").select(F.col("id").alias("rep"), F.coalesce("group", "c").alias("group")).union(lone)
    groups = copies.select("rep").union(linked.select("rep")).distinct().join(linked, "rep", "left").select("rep", F.coalesce("group", "rep").alias("group"))
    hidden = copies.join(groups, "rep").select("id", "group")
    return groups.union(hidden).select(F.col("rep").alias(key), F.col("group").alias("group_id"))


def cross_classes(df: DataFrame, train: Column, other: Column, key: str = "clause_id", text: str = "text", k: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(near (a, b), members (rep, id)): pairs of classes of equal shingle sets of different sides alike enough, and the classes' rows.

    a is the smallest id of a class where ``other`` holds, b of one where
    ``train`` does.  Exact.  The evaluation sets' prefixes (rarest n - T + c
    shingles) are the index; the training sets' prefixes probe it with length,
    position and sketch filters; the surviving pairs are verified on whole sets.
    Lists of any length are joined in blocks.

    Null and empty texts, texts of fewer than k words, rows of neither side and
    rows with a null key have no pair.
    """
    side = F.when(train, 1).when(other, 2)
    rows = df.where(train | other)
    described = _prepare(rows, key, text, k, [side.alias("side")])
    copies = _copies(described, "side")
    distinct = _sets(described, copies)
    wanted = described.where("side = 2").select("prefix")
    size = described.where("side = 2").agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    probe = materialize(_postings(distinct.where("side = 1"), key_filter(wanted, size)), "probe")
    probed = probe.select("s")
    index = materialize(_postings(distinct.where("side = 2"), key_filter(probed, probed.count())), "index")
    sizes = index.select("s", F.lit(1).alias("i")).union(probe.select("s", F.lit(0))).groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.max("i").alias("hi"), F.min("i").alias("lo"))
    sizes = materialize(sizes.where("hi = 1 and lo = 0").select("s", "m", F.col("m").alias("_m")), "sizes")
    met = lambda posts: lookup_join(posts, sizes, "s", weight="_m")
    both = materialize(met(index).withColumn("e", F.lit(True)).unionByName(met(probe).withColumn("e", F.lit(False))), "both")
    pairs = materialize(_pairs(both.where("e"), both.where("not e"), F.lit(True)), "pairs")
    release(index, probe, both, described)
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    near = materialize(verified(pairs, sets_of(rows, key, text, k, ids, ids.count()), merge_pairs), "near")
    release(pairs)
    ends = near.select(F.col("a").alias("rep")).union(near.select("b")).distinct()
    return near, materialize(ends.select("rep", F.col("rep").alias("id")).union(copies.join(ends, "rep").select("rep", "id")), "members")


def cross_pairs(df: DataFrame, train: Column, other: Column, key: str = "clause_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """(a, b): all pairs of a row where ``train`` holds and one where ``other`` holds whose likeness is at least 0.8; a is of train.

    The classes of cross_classes with all their rows.
    """
    near, members = cross_classes(df, train, other, key, text, k)
    e, t = members.select(F.col("rep").alias("a"), F.col("id").alias("eval_id")), members.select(F.col("rep").alias("b"), F.col("id").alias("train_id"))
    return near.join(e, "a").join(t, "b").select(F.col("train_id").alias("a"), F.col("eval_id").alias("b"))


def cross_counts(df: DataFrame, train: Column, other: Column, key: str = "clause_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """(id, pairs): every row where ``other`` holds that has a partner, and how many it has; no pair of copies is formed."""
    near, members = cross_classes(df, train, other, key, text, k)
    size = members.groupBy(F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("rows"))
    found = near.join(size, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("rows").alias("pairs"))
    return members.join(found, "rep").select("id", "pairs")
