"""Verification of candidate pairs in blocks: each document's set travels once to each block that needs it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import U, bloom_add, bloom_bits, bloom_has, bloom_probes, mix
from corpusloom.plans.arrays import merged_array
from corpusloom.plans.lineage import materialize

#: Likeness of at least NUM / DEN counts as near-duplicate.
NUM, DEN = 4, 5
#: Documents of one inverted list that share a block; a longer list is cut into blocks of about this size.
BLOCK = 512
#: Bytes of one Bloom filter: about 13 million keys.
SHARD = 16 << 20


def _flat(column) -> np.ndarray:
    """The values of a column of bigints or of lists of them."""
    values = column.flatten() if pa.types.is_list(column.type) else column
    return values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(U)


def key_filter(ids: DataFrame, n: int, max_bytes: int = SHARD) -> np.ndarray | None:
    """A packed Bloom filter of a column of bigints or of lists of them; None if n keys need more than one shard of max_bytes.

    It only spares work: where it is None, callers join by the keys instead.
    """
    if shards_of(n, max_bytes) > 1:
        return None
    bits = bloom_bits(max(n, 1))

    def add(batches):
        filt = np.zeros(bits, np.uint8)
        for b in batches:
            bloom_add(filt, mix(_flat(b.column(0))))
        return np.packbits(filt, bitorder="little")

    out = merged_array(ids, add, lambda a, b: np.bitwise_or(a, b, out=a), "uint8")
    return out if len(out) else np.zeros(bits // 8, np.uint8)


def shards_of(n: int, max_bytes: int = SHARD) -> int:
    """How many filters of at most max_bytes hold n keys at ten bits each."""
    return max(1, -(-n * 10 // (max_bytes * 8)))


def repeat_filter(hashes: DataFrame, n: int) -> np.ndarray:
    """A packed Bloom filter that holds every value that a column of bigints, or of lists of distinct ones, has twice, and few others.

    Each partition keeps two filters, of values seen once and of values seen
    again; when two partitions are merged, what both saw once counts as seen
    again.  The merge works bit by bit, so it never misses a repeated value.
    n keys are one shard's (see repeats).
    """
    bits = bloom_bits(max(n, 1))

    def seen(batches):
        once, again = np.zeros(bits, np.uint8), np.zeros(bits, np.uint8)
        for b in batches:
            keys, counts = np.unique(mix(_flat(b.column(0))), return_counts=True)
            probes = bloom_probes(keys, bits)
            old = np.ones(len(keys), bool)
            for p in probes:
                old &= once[p] == 1
            old |= counts > 1
            for p in probes:
                once[p] = 1
                again[p[old]] = 1
        low, high = np.packbits(once, bitorder="little"), np.packbits(again, bitorder="little")
        return low.astype(np.uint16) | high.astype(np.uint16) << np.uint16(8)

    def merge(a, b):
        return a | b | ((a & b & np.uint16(255)) << np.uint16(8))

    both = merged_array(hashes, seen, merge, "uint16")
    return (both >> 8).astype(np.uint8) if len(both) else np.zeros(bits // 8, np.uint8)


def repeats(rows: DataFrame, column: str, n: int, max_bytes: int = SHARD) -> DataFrame:
    """rows with the boolean ``maybe``: false only if no other row has the same value of ``column`` (a bigint hash, not null).

    n is the number of rows.  Values are cut by hash range into as many shards
    as filters of max_bytes need; the rows are written once, in order of the
    shard within each file, so that each shard's filter is built from and
    probes its own rows only.  The driver holds one shard's filter at a time,
    and the share of single rows taken for repeated ones is the same for any n.
    """
    count = shards_of(n, max_bytes)
    if count > 1:
        rows = materialize(rows.withColumn("_shard", F.pmod(F.xxhash64(column), F.lit(count)).cast("int")).sortWithinPartitions("_shard"), "shards")
    schema = f"{_ddl(rows.drop('_shard'))}, maybe boolean"
    at = rows.columns.index(column)

    def one(i: int) -> DataFrame:
        part = rows if count == 1 else rows.where(F.col("_shard") == i).drop("_shard")
        shared = rows.sparkSession.sparkContext.broadcast(repeat_filter(part.select(column), -(-n // count)))

        def probe(batches):
            for b in batches:
                ok = bloom_has(shared.value, mix(b.column(at).to_numpy().view(U)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok)], names=[*b.schema.names, "maybe"])

        return part.mapInArrow(probe, schema)

    out = one(0)
    for i in range(1, count):
        out = out.unionByName(one(i))
    return out


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def least_overlap(n: np.ndarray | int):
    """The overlap that any partner of likeness NUM / DEN has with a set of n at least."""
    return (NUM * n + DEN - 1) // DEN


def enough(o, n1, n2):
    """Whether an overlap o of sets of n1 and n2 is a likeness of NUM / DEN."""
    return o * (NUM + DEN) >= NUM * (n1 + n2)


def merge_pairs(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of the sorted sets are alike enough."""
    ok = np.zeros(len(a), bool)
    order = np.argsort(a, kind="stable")
    i = 0
    while i < len(order):
        x = a[order[i]]
        j = i
        while j < len(order) and a[order[j]] == x:
            j += 1
        own, mine = sets[x], order[i:j]
        theirs = [sets[y] for y in b[mine]]
        lens = np.fromiter(map(len, theirs), np.int64, len(theirs))
        flat = np.concatenate(theirs)
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        hit = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(lens)[:-1]]))
        ok[mine] = enough(hit, len(own), lens)
        i = j
    return ok


def divide_skip(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, mu: float = 0.0085) -> np.ndarray:
    """Which of the pairs (a, b) are alike enough, by T-occurrence search over the block's inverted lists.

    For each query the lists of its shingles are divided: the L longest are set
    aside, with L = T / (mu * log2(longest) + 1), the short ones are merged,
    documents found at least T - L times go on, and the long lists are probed
    for these by binary search.  T is the least overlap that any partner needs.
    """
    if len(sets) <= 2:
        return merge_pairs(sets, a, b)
    lens = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), lens)
    o = np.lexsort((owner, flat))
    flat, owner = flat[o], owner[o]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    uniq, bounds = flat[first], np.append(first, len(flat))
    ok = np.zeros(len(a), bool)
    order = np.argsort(a, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1], [True]])) if len(a) else [0]
    for i, j in zip(cuts[:-1], cuts[1:]):
        mine = order[i:j]
        q = a[mine[0]]
        at = np.searchsorted(uniq, sets[q])
        size = bounds[at + 1] - bounds[at]
        t = int(least_overlap(lens[q]))
        long = min(int(t / (mu * np.log2(size.max() + 1) + 1)), t - 1)
        by = np.argsort(size, kind="stable")
        short, probed = at[by[: len(by) - long]], at[by[len(by) - long :]]
        counts = np.bincount(np.concatenate([owner[bounds[s] : bounds[s + 1]] for s in short]), minlength=len(sets))
        left = mine[counts[b[mine]] >= t - long]
        if not len(left):
            continue
        who = b[left]
        got = counts[who].copy()
        for s in probed:
            lst = owner[bounds[s] : bounds[s + 1]]
            p = np.minimum(np.searchsorted(lst, who), len(lst) - 1)
            got += lst[p] == who
        ok[left] = enough(got, lens[q], lens[who])
    return ok


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole keys from batches sorted by column 0."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if rest and (cut or rest[-1].column(0)[-1].as_py() != keys[0]):
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)] if cut else rest)
            rest = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def verified(pairs: DataFrame, sets: DataFrame, check: Callable = divide_skip) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (a, b, w, m) whose sets are alike enough.

    w is the inverted list that brought a pair up and m that list's length: the
    block is (w, part of a, part of b), where lists are cut into ceil(m / BLOCK)
    parts by id, so no block holds more than about 2 * BLOCK documents.
    """
    part = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col("m") / BLOCK))
    keyed = pairs.select("a", "b", F.xxhash64("w", part("a"), part("b")).alias("key"))
    need = keyed.select("key", F.col("a").alias("id")).union(keyed.select("key", F.col("b").alias("id"))).distinct()
    none = F.lit(None)
    rows = (
        need.join(sets, "id")
        .select("key", F.lit(0).alias("kind"), "id", none.cast("bigint").alias("other"), "set")
        .union(keyed.select("key", F.lit(1), "a", "b", none.cast("array<bigint>")))
        .repartition("key")
        .sortWithinPartitions("key")
    )

    def run(batches):
        for table in _groups(batches):
            table = table.combine_chunks()
            keys, kind = table.column(0).to_numpy(), table.column(1).to_numpy()
            ids = table.column(2).to_numpy()
            lists = table.column(4).combine_chunks()
            flat, offs = lists.values.to_numpy().view(U), lists.offsets.to_numpy()
            other = table.column(3).fill_null(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            got_a, got_b = [], []
            for i, j in zip(cuts[:-1], cuts[1:]):
                docs = i + np.flatnonzero(kind[i:j] == 0)
                prs = i + np.flatnonzero(kind[i:j] == 1)
                if not len(docs) or not len(prs):
                    continue
                docs = docs[np.argsort(ids[docs], kind="stable")]
                own = ids[docs]
                sets_ = [flat[offs[d] : offs[d + 1]] for d in docs]
                ok = check(sets_, np.searchsorted(own, ids[prs]), np.searchsorted(own, other[prs]))
                got_a.append(ids[prs][ok])
                got_b.append(other[prs][ok])
            if got_a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(got_a)), "b": pa.array(np.concatenate(got_b))})

    return rows.mapInArrow(run, "a bigint, b bigint")
