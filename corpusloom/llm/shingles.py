"""Distinct word shingles of texts, hashed and ordered by corpus-wide rarity.

Shingles are hashed by functions.shingling.  The rarity order comes from a table of counts by hash bucket over *all* rows: any total order
keeps prefix filtering exact, the counts only make it selective.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import U, bloom_has, mix
from corpusloom.functions.shingling import WORDS, hashed, ordered
from corpusloom.llm.blocks import key_filter, least_overlap
from corpusloom.plans.arrays import merged_array

#: Short lists a pair must share, of those that are not set aside as long: this many, or one in EACH of the least overlap.
SHARED, EACH = 3, 25
#: Words of 64 bits of a set's sketch.
SKETCH = 4


def rarity_bits(rows: int) -> int:
    """Cells for about 32 a row, which keeps unrelated shingles apart; at most 2**24, so that 16 MB are broadcast whatever the rows.

    Past half a million rows cells are shared.  A shingle of many texts still
    stands out of its cell's neighbours by its count, so it stays out of the
    prefixes; among rare ones the order is any, which costs nothing.
    """
    return min(24, max(18, int(rows * 32).bit_length()))


def rarity(df: DataFrame, text: str = "text", k: int = WORDS) -> np.ndarray:
    """Quantised logarithms (8 bits, steps of a tenth) of the counts, by hash bucket, of the shingles of all rows; at most 16 MB."""
    bits = rarity_bits(df.count())

    def count(batches):
        total = np.zeros(1 << bits, np.uint32)
        held: list[np.ndarray] = []
        n = 0

        def flush() -> None:
            if held:
                total[:] += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
                held.clear()

        for batch in batches:
            for _, _, _, h in hashed(batch.column(0).to_pylist(), k):
                held.append((h & U((1 << bits) - 1)).astype(np.int32))
                n += len(h)
                if n > 1 << 22:
                    flush()
                    n = 0
        flush()
        return total

    def add(a, b):
        return np.minimum(a.astype(np.uint64) + b, (1 << 32) - 1).astype(np.uint32)

    def level(total: np.ndarray) -> np.ndarray:
        return np.round(np.log2(total.astype(np.float64) + 1) * 7.5).astype(np.uint8)

    levels = merged_array(df.select(text), count, add, "uint32", level, "uint8")
    return levels if len(levels) else np.zeros(1 << bits, np.uint8)


def shared_short(n):
    """c = min(max(SHARED, T / EACH), T): how many of the first shingles in common lie in both prefixes; it grows with n."""
    t = least_overlap(n)
    return np.minimum(np.maximum(SHARED, t // EACH), t)


def sketches(first: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """SKETCH words for each set (sets start at ``first`` in h): bit i says whether an odd number of its hashes fall on i.

    The bits in which two sketches differ are no more than the hashes that only
    one of the sets has, so they bound the overlap from above.
    """
    bit, word = U(1) << (h >> U(58)), (h >> U(56)) & U(SKETCH - 1)
    return [np.bitwise_xor.reduceat(np.where(word == U(w), bit, U(0)), first).view(np.int64) for w in range(SKETCH)]


def prefixes(df: DataFrame, rank: np.ndarray, key: str, text: str = "text", k: int = WORDS, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, *extra, s1, s2, n, prefix, k0..): set signature, set size, the rarest n - T + c shingles and the sketch of each text that has k words.

    Sets of likeness NUM / DEN have T shingles or more in common; behind the
    c-th of these in the common order lie T - c others, so that the first c are
    in both prefixes.
    """
    shared = df.sparkSession.sparkContext.broadcast(rank)
    out = df.select(key, *extra, text)
    words = [f"k{i}" for i in range(SKETCH)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1]) + ", s1 bigint, s2 bigint, n int, prefix array<bigint>" + "".join(f", {w} bigint" for w in words)

    def run(batches):
        for batch in batches:
            for lo, hi, doc, h in hashed(batch.column(batch.num_columns - 1).to_pylist(), k):
                doc, h = ordered(doc, h, shared.value)
                if not len(doc):
                    continue
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                rows = doc[first]
                n = np.diff(np.concatenate([first, [len(doc)]]))
                s1, s2 = np.add.reduceat(h, first), np.add.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), first)
                take = n - least_overlap(n) + shared_short(n)
                keep = (np.arange(len(doc)) - np.repeat(first, n)) < np.repeat(take, n)
                flat = pa.array(h[keep].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), flat)
                ids = batch.slice(lo, hi - lo).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [ids.column(i) for i in range(batch.num_columns - 1)]
                    + [pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(n.astype(np.int32)), lists]
                    + [pa.array(x) for x in sketches(first, h)],
                    names=[*batch.schema.names[:-1], "s1", "s2", "n", "prefix", *words],
                )

    return out.mapInArrow(run, schema)


def sets_of(df: DataFrame, key: str, text: str, k: int, ids: DataFrame, count: int) -> DataFrame:
    """(id, set): the sorted distinct hashes of each row whose key is one of the ``count`` rows of ids (id).

    A Bloom filter of the ids spares hashing the other texts; where there are
    too many for one, the texts are joined by id first.
    """
    wanted = key_filter(ids, count)
    rows = df.where(df[key].isNotNull()).select(df[key].cast("bigint").alias("id"), F.col(text).alias("text"))
    rows = rows.join(ids, "id", "left_semi") if wanted is None else rows
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            some = batch
            if shared.value is not None:
                some = batch.filter(pa.array(bloom_has(shared.value, mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)))))
            for lo, hi, doc, h in hashed(some.column(1).to_pylist(), k):
                doc, h = ordered_plain(doc, h)
                if not len(doc):
                    continue
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(h.view(np.int64)))
                own = some.column(0).slice(lo, hi - lo).take(pa.array(doc[first]))
                yield pa.RecordBatch.from_arrays([own, lists], names=["id", "set"])

    out = rows.mapInArrow(run, "id bigint, `set` array<bigint>")
    return out if wanted is None else out.join(ids, "id", "left_semi")


def ordered_plain(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, hash) by doc and unsigned hash."""
    return ordered(doc, h, None)
