"""Near-duplicate clustering: MinHash bands, verified bands, or exact likeness.

A document is a row (id, text); rows with a null id or text take no part.
"""

from __future__ import annotations

import random
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import U
from corpusloom.functions.shingling import hashed, ordered
from corpusloom.functions.text import normalised, shingles
from corpusloom.operators.components import components
from corpusloom.plans.arrays import merged_array
from corpusloom.plans.lineage import materialize, release
from corpusloom.plans.skew import lookup_join

PRIME = 2**31 - 1
_SEED = 20260905


def permutations(n: int, seed: int = _SEED) -> list[tuple[int, int]]:
    """Multipliers and offsets of n random permutations modulo PRIME."""
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(n)]


def band_shape(threshold: float, perms: int, steps: int = 200) -> tuple[int, int]:
    """(bands, rows a band) with the least sum of false positive and false negative area of the S-curve."""
    best = (float("inf"), 1, 1)
    for b in range(1, perms + 1):
        for r in range(1, perms // b + 1):
            fp = sum(1 - (1 - (threshold * (i + 0.5) / steps) ** r) ** b for i in range(steps)) * threshold / steps
            fn = sum((1 - (threshold + (1 - threshold) * (i + 0.5) / steps) ** r) ** b for i in range(steps)) * (1 - threshold) / steps
            best = min(best, (fp + fn, b, r))
    return best[1], best[2]


def representatives(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, rep): rep is the smallest id of the same normalised text; equal texts are one document from here on."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.md5(normalised(F.col(text)).cast("binary")).alias("h"))
    reps = rows.groupBy("h").agg(F.min("id").alias("rep"))
    return rows.join(reps, "h").select("id", "rep")


def distinct_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, t): the smallest id of each normalised text.  Digests are grouped; texts only meet the ids that stay."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), normalised(F.col(text)).alias("t"))
    first = rows.groupBy(F.md5(F.col("t").cast("binary")).alias("h")).agg(F.min("id").alias("id")).select("id")
    return rows.join(first, "id", "left_semi")


def shingled(df: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """(id, shingle) of the smallest id of each normalised text."""
    return distinct_texts(df, key, text).select("id", F.explode(shingles(F.col("t"), k)).alias("shingle"))


def _grams(t: str, k: int) -> set[str]:
    w = t.split(" ")
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {t}


def _minima(texts: list[str], k: int, pairs: np.ndarray) -> np.ndarray:
    """(texts, permutations): the least permuted hash of each normalised text's shingles, which any engine's md5 repeats."""
    sets = [_grams(t, k) for t in texts]
    raw = b"".join(md5(s.encode("utf-8", "surrogatepass")).digest()[:4] for grams in sets for s in grams)
    h = np.frombuffer(raw, ">u4").astype(np.int64) % PRIME
    first = np.concatenate([[0], np.cumsum([len(g) for g in sets])[:-1]])
    out = np.empty((len(texts), len(pairs)), np.int64)
    for i, (a, c) in enumerate(pairs):
        out[:, i] = np.minimum.reduceat((h * a + c) % PRIME, first)
    return out


def _slices(batches, rows: int = 2048):
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def signatures(df: DataFrame, key: str, text: str, perms: int = 128, k: int = 5, distinct: bool = True) -> DataFrame:
    """(id, m): m[i] is the minimum of permutation i over the document's shingle hashes.

    Hashes and permutations are array operations over whole Arrow batches, so
    nothing is exploded or shuffled by shingle.  distinct: one row a normalised
    text, else one a row of df.
    """
    kept = F.col(key).isNotNull() & F.col(text).isNotNull()
    rows = distinct_texts(df, key, text) if distinct else df.where(kept).select(F.col(key).alias("id"), normalised(F.col(text)).alias("t"))
    pairs = np.array(permutations(perms), np.int64)

    def run(batches):
        for b in _slices(batches):
            m = _minima(b.column(1).to_pylist(), k, pairs)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, perms, dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["id", "m"])

    return rows.select("id", "t").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, m array<bigint>")


def band_keys(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, band, bucket)."""
    part = lambda i: F.md5(F.array_join(F.slice("m", F.lit(1) + i * rows, rows).cast("array<string>"), ","))
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), part(i).alias("bucket")))
    return sigs.select("id", F.explode(keys).alias("x")).select("id", "x.band", "x.bucket")


def _linked(long: DataFrame) -> DataFrame:
    """(a, b): each id linked to the smallest of every bucket (band, bucket) it shares; a bucket of any size costs its length.

    Buckets that hold more than a share of the rows are looked up by broadcast.
    """
    long = materialize(long.select("id", F.concat_ws(":", "band", F.hex("bucket")).alias("at")), "bands")
    heads = long.groupBy("at").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return lookup_join(long, heads, "at", weight="n").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def band_edges(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(a, b): each document linked to the smallest of every bucket it shares."""
    return _linked(band_keys(sigs, bands, rows))


def text_edges(df: DataFrame, key: str, text: str, bands: int, rows: int, k: int = 5) -> DataFrame:
    """(a, b): band_edges of all rows, copies too, from one pass over the texts, which are not shuffled.

    Rows of equal normalised text share all buckets, so no search for copies is
    needed before.
    """
    pairs = np.array(permutations(bands * rows), np.int64)
    src = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), normalised(F.col(text)).alias("t"))

    def run(batches):
        for b in _slices(batches):
            m = _minima(b.column(1).to_pylist(), k, pairs).reshape(b.num_rows * bands, rows)
            raw, width = np.ascontiguousarray(m).tobytes(), 8 * rows
            buckets = [md5(raw[i : i + width]).digest() for i in range(0, len(raw), width)]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), bands)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(bands, dtype=np.int32), b.num_rows)), pa.array(buckets, pa.binary())], names=["id", "band", "bucket"])

    return _linked(src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, band int, bucket binary"))


def ordered_sets(rows: DataFrame, k: int = 5) -> DataFrame:
    """(id, n, s): the different shingles of each (id, t) by how rare their bucket is in all rows, as 64-bit hashes; a written table.

    The order comes from counts by hash bucket (2**22 of them), so no shingle is
    shuffled for it; any order keeps a prefix filter exact.
    """
    cells = 1 << 22
    rows = materialize(rows.select("id", "t"), "texts")

    def count(batches):
        total, held, n = np.zeros(cells, np.uint32), [], 0
        for b in batches:
            for _, _, _, h in hashed(b.column(1).to_pylist(), k, True, True):
                held.append((h & U(cells - 1)).astype(np.int32))
                n += len(h)
                if n > cells:
                    total += np.bincount(np.concatenate(held), minlength=cells).astype(np.uint32)
                    held, n = [], 0
        return total + np.bincount(np.concatenate(held), minlength=cells).astype(np.uint32) if held else total

    def level(total):
        return np.round(np.log2(total.astype(np.float64) + 1) * 7.5).astype(np.uint8)

    rank = merged_array(rows, count, lambda a, b: np.minimum(a.astype(np.uint64) + b, (1 << 32) - 1).astype(np.uint32), "uint32", level, "uint8")
    shared = rows.sparkSession.sparkContext.broadcast(rank if len(rank) else np.zeros(cells, np.uint8))

    def run(batches):
        for b in batches:
            for lo, hi, doc, h in hashed(b.column(1).to_pylist(), k, True, True):
                doc, h = ordered(doc, h, shared.value)
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                n = np.diff(np.concatenate([first, [len(doc)]]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(doc[first])), pa.array(n.astype(np.int32)), lists], names=["id", "n", "s"])

    out = materialize(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n int, s array<bigint>"), "sets")
    release(rows)
    return out


def exact_pairs(df: DataFrame, key: str, text: str, num: int = 4, den: int = 5, k: int = 5) -> DataFrame:
    """(a, b, likeness) of all pairs of different normalised texts with likeness num / den or more, by prefix filtering."""
    sets = ordered_sets(distinct_texts(df, key, text), k)
    least = F.ceil(F.col("n") * num / den).cast("int")
    prefix = sets.select("id", "n", F.posexplode(F.slice("s", F.lit(1), F.col("n") - least + 1)).alias("pos", "h"))
    x, y = prefix.alias("x"), prefix.alias("y")
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    both = (F.col("x.h") == F.col("y.h")) & (F.col("x.id") < F.col("y.id"))
    size = (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num) & (room * (num + den) >= (F.col("x.n") + F.col("y.n")) * num)
    cand = x.join(y, both & size).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    return verified_pairs(cand, sets, num, den)


def verified_pairs(cand: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, likeness) of the candidates (a, b) whose sets (id, s) are alike enough; overlaps are counted over whole Arrow batches."""
    kind = cand.schema["a"].dataType.simpleString()
    full = cand.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = b.column(2), b.column(3)
            nx, ny = (np.diff(c.offsets.to_numpy()) for c in (x, y))
            row = np.concatenate([np.repeat(np.arange(b.num_rows), nx), np.repeat(np.arange(b.num_rows), ny)])
            h = np.concatenate([x.flatten().to_numpy(), y.flatten().to_numpy()])
            o = np.lexsort((h, row))
            row, h = row[o], h[o]
            both = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=b.num_rows)
            union = nx + ny - both
            keep = pa.array(np.flatnonzero(both * den >= union * num))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(both.astype(float)).take(keep), pa.array(union.astype(float)).take(keep)], names=["a", "b", "o", "u"])

    return full.mapInArrow(run, f"a {kind}, b {kind}, o double, u double").select("a", "b", F.round(F.col("o") / F.col("u"), 6).alias("likeness"))


def clusters(df: DataFrame, key: str, text: str, mode: str = "exact", threshold: tuple[int, int] = (4, 5), perms: int = 128, k: int = 5) -> DataFrame:
    """(key, cluster_id) of every document with a text; ids are dense, in the order of each cluster's smallest key.

    mode lsh links whatever shares a band, without verification; lsh_verified
    keeps linked pairs of likeness enough; exact finds all such pairs.
    """
    num, den = threshold
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    if mode == "lsh":
        bands, width = band_shape(num / den, perms)
        roots = components(text_edges(df, key, text, bands, width, k))
        linked = rows.select(F.col(key).alias("id")).join(roots, "id", "left").select(F.col("id").alias(key), F.coalesce("root", "id").alias("root"))
        return dense_ids(linked, key, "root")
    if mode == "exact":
        edges = exact_pairs(df, key, text, num, den, k).select("a", "b")
    elif mode == "lsh_verified":
        bands, width = band_shape(num / den, perms)
        texts = distinct_texts(df, key, text)
        edges = band_edges(signatures(df, key, text, bands * width, k), bands, width)
        edges = verified_pairs(edges, ordered_sets(texts, k), num, den).select("a", "b")
    else:
        raise ValueError(f"unknown mode {mode}")
    roots = components(edges)
    reps = representatives(df, key, text)
    linked = reps.join(roots.withColumnsRenamed({"id": "rep"}), "rep", "left").select(F.col("id").alias(key), F.coalesce("root", "rep").alias("root"))
    return dense_ids(linked, key, "root")


def dense_ids(linked: DataFrame, key: str, root: str) -> DataFrame:
    """(key, cluster_id): roots numbered from 0 in order, by counts of ranges and positions in them, without one global window."""
    roots = materialize(linked.select(root).distinct(), "roots")
    parts = roots.repartitionByRange(root).withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "parts")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offset = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    place = F.row_number().over(Window.partitionBy("part").orderBy(root)) - 1 + F.col("before")
    ids = parts.join(F.broadcast(offset), "part").select(root, place.cast("bigint").alias("cluster_id"))
    return linked.join(ids, root).select(key, "cluster_id")
