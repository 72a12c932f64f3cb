"""Long spans that stand character for character in other documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import RangeHash, U, bloom_has, mix
from corpusloom.llm.blocks import key_filter
from corpusloom.plans.lineage import materialize, release
from corpusloom.plans.skew import lookup_join

_PIECE = 1 << 20


def _least_in(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    n = len(h)
    p = np.concatenate([h, np.full(-n % w, np.iinfo(np.uint64).max, U)]).reshape(-1, w)
    ahead = np.minimum.accumulate(p, axis=1).ravel()
    behind = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _symbols(text: str) -> np.ndarray:
    return mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(0x1F3D5B79))


def _factors(text: str, length: int, gram: int):
    """(anchor, first window, last window, hash of what these windows cover) of each phrase of the text.

    A window of ``length`` characters belongs to the gram with the least hash
    in it; consecutive windows of one gram form a phrase.  Equal windows have
    equal anchors at equal places, in whatever texts they stand.
    """
    out = []
    n = len(text)
    for at in range(0, n - length + 1, _PIECE):  # very long texts by pieces of windows
        part = text[at : at + _PIECE + length - 1]
        rh = RangeHash(_symbols(part))
        i = np.arange(len(part) - gram + 1)
        least = _least_in(rh(i, i + gram), length - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(first[1:], len(least)) - 1
        out.append((least[first], first + at, last + at, rh(first, last + length)))
    return [np.concatenate(c) for c in zip(*out)]


def _windows(text: str, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, hash) of the windows of the given ranges."""
    lo, hi = int(first.min()), int(last.max()) + length
    at = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    rh = RangeHash(_symbols(text[lo:hi]))
    return at, rh(at - lo, at - lo + length)


def names(codes: np.ndarray, length: int) -> np.ndarray:
    """A number for each position such that equal numbers are equal stretches of ``length`` codes, in lexicographic order.

    These are the ranks of a suffix array over the first ``length`` codes,
    built by prefix doubling: stretches of three codes are packed into one key,
    and two ranks of stretches give that of both together.  Codes are under
    2**21; past the end all stretches are alike.
    """

    def rank(key: np.ndarray) -> np.ndarray:
        return np.unique(key, return_inverse=True)[1].astype(np.int64)

    def later(r: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([r[k:] + 1, np.zeros(min(k, len(r)), np.int64)]) if k else r + 1

    c = codes.astype(np.int64)
    have = min(3, length)
    key = c + 1
    for k in range(1, have):
        key = key << 21 | np.concatenate([c[k:] + 1, np.zeros(min(k, len(c)), np.int64)])
    r = rank(key)
    while have < length:
        step = min(have, length - have)
        r = rank(r * (len(r) + 2) + later(r, step))
        have += step
    return r


def parsed(docs: np.ndarray, texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, last): runs of positions from which a piece has a factor of ``length`` characters or more in the reference.

    The reference of each piece is all pieces of other documents in the block.
    Its suffix array, cut at ``length``, says for every position whether the
    longest factor there is long enough; a factor as long as the run and
    ``length`` less one is what the greedy parse takes at the run's start, and
    positions about its end are looked at one by one, as are all others.
    """
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    # a code of its own ends each piece, so that no factor runs over it
    codes = np.concatenate([np.append(p, 0x110000 + i) for i, p in enumerate(parts)])
    start = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    r = names(codes, length)
    n = np.maximum(lens - length + 1, 0)
    piece = np.repeat(np.arange(len(parts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    r, doc = r[start[piece] + at], docs[piece]
    o = np.argsort(r, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], r[o][1:] != r[o][:-1]])) if len(o) else np.zeros(0, np.int64)
    if not len(first):
        return piece, at, at
    many = np.minimum.reduceat(doc[o], first) != np.maximum.reduceat(doc[o], first)
    hit = np.zeros(len(r), bool)
    hit[o] = np.repeat(many, np.diff(np.append(first, len(o))))
    piece, at = piece[hit], at[hit]
    if not len(piece):
        return piece, at, at
    new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)])
    begin = np.flatnonzero(new)
    return piece[begin], at[begin], at[np.append(begin[1:], len(at)) - 1]


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that two different documents have, and the number of rows of each."""
    counts = rows.groupBy(*keys).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("m"))
    return materialize(counts.where("lo < hi"), "shared")


#: Pieces in a reference block, about; an anchor of more open pieces than HOT has its windows looked up by hash instead.
BLOCK, HOT = 4096, 8192


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, gram: int = 100) -> DataFrame:
    """(key, span_start, span_end): each longest run of stretches of ``length`` characters that also occur in another key's text.

    A parse of every document relative to all others.  Documents are cut into
    phrases at content-defined anchors; equal stretches lie in phrases of equal
    anchors, so the reference of a phrase is the phrases of its anchor.  Phrases
    that another document has as a whole are factors as they stand, found by
    anchor and content (128 bits of hash).  The other phrases whose anchor is
    shared are factored by relative Lempel-Ziv parsing: their texts and, of each
    whole phrase, those of two documents go to reference blocks by anchor; a
    suffix array of the block gives the factors, compared character by
    character, and the places about their ends are checked (see parsed).  So
    every document meets only the blocks that its anchors name, and no pair of
    documents is formed: a passage that a third of all documents hold costs its
    occurrences.  An anchor with more than HOT different open phrases would make
    a block of any size; its single windows are looked up by anchor and hash.

    Offsets count code points from 0, the end is exclusive.  Repeats within one
    key's text are not shared.  Null and shorter texts and rows of a null key
    have no span; keys are meant to be unique: repeated rows count once, and
    different texts under one key as texts of one document.
    """
    docs = df.where(F.col(key).isNotNull() & (F.length(text) >= length)).select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))

    def parse(batches):
        for b in batches:
            cols = [[], [], [], [], []]
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                anchor, first, last, cover = _factors(t, length, gram)
                for c, v in zip(cols, (np.full(len(anchor), doc, np.int64), anchor.view(np.int64), first.astype(np.int32), last.astype(np.int32), cover.view(np.int64))):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["doc", "anchor", "first", "last", "cover"])

    phrases = materialize(docs.mapInArrow(parse, "doc bigint, anchor bigint, first int, last int, cover bigint"), "phrases")
    known = materialize(lookup_join(phrases, _shared(phrases, "anchor").select("anchor", "m"), "anchor", weight="m"), "known")
    release(phrases)
    whole = _shared(known, "anchor", "cover").select(F.struct("anchor", "cover").alias("at"), "lo", "hi", "m")
    factors = lookup_join(known.select("doc", "first", "last", "anchor", F.struct("anchor", "cover").alias("at")), whole, "at", "left", weight="m")
    factors = materialize(factors.select("doc", "anchor", "first", "last", F.col("lo").isNotNull().alias("whole"), F.coalesce(F.col("doc").isin(F.col("lo"), F.col("hi")), F.lit(False)).alias("named")), "factors")
    release(known)

    open_ = materialize(factors.where("not whole").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), "anchors")
    look = lookup_join(factors.where("named or not whole"), open_, "anchor").select("doc", F.struct("first", "last", "anchor", "n").alias("x"))
    edge = materialize(look.groupBy("doc").agg(F.array_sort(F.collect_set("x")).alias("at")), "edge")
    wanted = key_filter(edge.select("doc"), edge.count())
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def pick(batches):
        for b in batches:
            yield b.filter(pa.array(bloom_has(shared.value, mix(b.column(0).to_numpy(zero_copy_only=False).view(U)))))

    # the filter spares a shuffle of texts; where there are too many documents for one, the join alone does it
    texts = (docs if wanted is None else docs.mapInArrow(pick, docs.schema)).join(edge, "doc").select("doc", "text", "at")

    def expand(batches):
        for b in batches:
            cols = [[], [], [], []]
            for doc, t, at in zip(*(c.to_pylist() for c in b.columns)):
                for x in at:
                    if x["n"] <= HOT and x["last"] + length <= len(t):
                        for c, v in zip(cols, (x["anchor"], doc, x["first"], t[x["first"] : x["last"] + length])):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["anchor", "doc", "at", "piece"])

    blocks = max(1, -(-edge.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0] // BLOCK))

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, at = pdf["doc"].to_numpy(), pdf["at"].to_numpy()
        piece, first, last = parsed(doc, pdf["piece"].tolist(), length)
        return pd.DataFrame({"doc": doc[piece], "first": (at[piece] + first).astype(np.int32), "last": (at[piece] + last).astype(np.int32)})

    routed = texts.mapInArrow(expand, "anchor bigint, doc bigint, at int, piece string").withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
    pieces = factors.where("whole").select("doc", "first", "last").union(routed.groupBy("block").applyInPandas(factor, "doc bigint, first int, last int"))
    if not open_.where(F.col("n") > HOT).isEmpty():
        pieces = pieces.union(_by_windows(texts, length))
    return _joined(pieces, length).withColumnsRenamed({"doc": key})


def _by_windows(texts: DataFrame, length: int) -> DataFrame:
    """(doc, first, last) of the single windows, of phrases of hot anchors, that another document has; by anchor and 64 bits of hash."""

    def expand(batches):
        for b in batches:
            cols = [[], [], [], []]
            for doc, t, at in zip(*(c.to_pylist() for c in b.columns)):
                for x in at:
                    if x["n"] > HOT and x["last"] + length <= len(t):
                        w, h = _windows(t, np.array([x["first"]]), np.array([x["last"]]), length)
                        for c, v in zip(cols, (np.full(len(w), x["anchor"], np.int64), np.full(len(w), doc, np.int64), w.astype(np.int32), h.view(np.int64))):
                            c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["anchor", "doc", "at", "h"])

    windows = materialize(texts.mapInArrow(expand, "anchor bigint, doc bigint, at int, h bigint").select("doc", "at", "anchor", "h", F.struct("anchor", "h").alias("key")), "windows")
    both = _shared(windows, "anchor", "h").select(F.struct("anchor", "h").alias("key"), "m")
    return lookup_join(windows.select("doc", "at", "key"), both, "key", weight="m").select("doc", F.col("at").alias("first"), F.col("at").alias("last"))


def _joined(pieces: DataFrame, length: int) -> DataFrame:
    """Runs of windows (doc, first, last) that overlap or touch, as spans of characters."""
    from pyspark.sql import Window

    by = Window.partitionBy("doc").orderBy("first", "last")
    reach = F.max(F.col("last") + length).over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = pieces.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    return runs.groupBy("doc", "run").agg(F.min("first").alias("span_start"), (F.max("last") + length).alias("span_end")).drop("run")


def shared_shares(df: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, shared_chars, shared_share) of every row: how much of its text is shared elsewhere; a null text has 0 characters."""
    sums = spans.groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    out = df.select(key, F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars")).join(sums, key, "left").na.fill(0, ["shared_chars"])
    return out.withColumn("shared_share", F.round(F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)), 6))
