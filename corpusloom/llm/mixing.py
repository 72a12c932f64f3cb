"""Mixing feeds to target shares by Poisson replication."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.labels import plain
from corpusloom.llm.tokens import VOCABULARY, sized
from corpusloom.plans.lineage import materialize


def _below(rate: float, cap: int) -> np.ndarray:
    """P(count <= k) of a Poisson distribution for k = 0, 1, ... under cap, as far as it differs from 1."""
    n = min(cap, int(rate + 12 * math.sqrt(rate) + 60))
    log = np.zeros(n) if n else np.zeros(0)
    if n > 1:
        log[1:] = np.cumsum(np.log(rate) - np.log(np.arange(1, n))) if rate > 0 else -np.inf
    return np.minimum(np.cumsum(np.exp(log - rate)), 1.0)


def capped_rate(mean: float, cap: int) -> float:
    """The rate of a Poisson distribution that, cut off at cap, has the given mean; infinite at or above cap.

    The mean of the cut count is the sum of P(count > k) over k under cap.
    """
    if mean <= 0:
        return 0.0
    if mean >= cap:
        return math.inf
    cut_mean = lambda rate: float((1 - _below(rate, cap)).sum())
    lo, hi = 0.0, 1.0
    while cut_mean(hi) < mean:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cut_mean(mid) < mean else (lo, mid)
    return hi


def reachable(targets: list[float], limits: list[float], total: float) -> list[float]:
    """The sizes that share out ``total`` by the targets where no size exceeds its limit.

    What a limited one cannot take goes to the others in proportion to their
    targets, again and again until none is over its limit; if all with a target
    are at their limits, the whole is smaller than ``total``.
    """
    out = [0.0] * len(targets)
    open_, left = [i for i, p in enumerate(targets) if p > 0], total
    while open_:
        scale = left / sum(targets[i] for i in open_)
        full = [i for i in open_ if targets[i] * scale >= limits[i]]
        if not full:
            for i in open_:
                out[i] = targets[i] * scale
            break
        for i in full:
            out[i] = limits[i]
            left -= limits[i]
        open_ = [i for i in open_ if i not in full]
        left = max(left, 0.0)
    return out


class Mix:
    """A mix of documents with target shares by feed.

    sizes: (doc columns kept, feed, n_tokens) of the documents of target feeds;
    report: one row a feed with target, reachable and reached share; documents:
    one row a copy, globally shuffled.
    """

    def __init__(self, df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, seed: int = 23):
        """Feeds are compared in lower case without surrounding blanks.

        T is the number of ids of all documents of target feeds and the size of
        the mix.  A feed gives at most max_repeats of each of its documents; one
        that cannot give permille * T / 1000 gives all it can, and what it lacks
        is shared out among the others by their targets (see reachable), so that
        their shares keep their proportions and the mix its size.  A feed's
        expected size over its own is the mean of its documents' numbers of
        copies, which are Poisson distributed and cut off at max_repeats.

        Documents of other feeds and of none take no part; null and empty texts
        have no ids and are drawn at their feed's rate.  A null permille or
        max_repeats counts as 0; a feed named twice in the targets counts with
        its first spelling in order.  The target table is a fixed small one and
        is collected, with one sum a feed.
        """
        feeds = targets.select(plain(F.col(source)).alias("feed"), F.coalesce("target_permille", F.lit(0)).alias("permille"), F.coalesce("max_repeats", F.lit(0)).alias("cap"))
        feeds = feeds.where("feed is not null").groupBy("feed").agg(F.min(F.struct("permille", "cap")).alias("x")).select("feed", "x.*")
        rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), plain(F.col(source)).alias("feed")).join(F.broadcast(feeds.select("feed")), "feed")
        self.sizes = materialize(sized(rows, ["key", "feed"], "text", vocabulary), "sizes")
        self.key, self.seed = key, seed
        stats = feeds.join(self.sizes.groupBy("feed").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("docs")), "feed", "left").na.fill(0, ["t", "docs"])
        self.feeds = sorted(stats.collect(), key=lambda r: r["feed"])
        self.total = sum(r["t"] for r in self.feeds)
        # the target is a share of T; targets that do not sum to 1000 leave the rest of T empty or ask for more
        whole = self.total * sum(r["permille"] for r in self.feeds) / 1000
        self.expected = reachable([r["permille"] for r in self.feeds], [r["cap"] * r["t"] for r in self.feeds], whole)
        self.rates = {r["feed"]: capped_rate(e / r["t"], r["cap"]) if r["t"] else (math.inf if r["permille"] * self.total else 0.0) for r, e in zip(self.feeds, self.expected)}

    def counts(self) -> DataFrame:
        """The sizes with ``copies`` and ``cap``: a uniform draw from the key's hash put through the inverse of the feed's distribution."""
        table = [(r["feed"], r["cap"], self.rates[r["feed"]] == math.inf, [] if self.rates[r["feed"]] == math.inf else _below(self.rates[r["feed"]], r["cap"]).tolist()) for r in self.feeds]
        steps = self.sizes.sparkSession.createDataFrame(table, "feed string, cap int, full boolean, steps array<double>")
        u = (F.xxhash64(F.lit(self.seed), F.col("key")).bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))
        copies = F.when(F.col("full"), F.col("cap")).otherwise(F.size(F.filter("steps", lambda s: s < F.col("u"))))
        return self.sizes.withColumn("u", u).join(F.broadcast(steps), "feed").withColumn("copies", copies).drop("u", "full", "steps")

    def documents(self) -> DataFrame:
        """(key, copy, feed, n_tokens), each document as often as it was drawn, in a global random order."""
        order = F.xxhash64(F.lit(self.seed + 1), "key", "copy")
        drawn = self.counts().where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        return drawn.select(F.col("key").alias(self.key), "copy", "feed", "n_tokens", order.alias("_o")).orderBy("_o").drop("_o")

    def report(self) -> DataFrame:
        """(source, target_permille, max_repeats, t, docs, expected_tokens, tokens, drawn, most_repeats, reachable_permille, reached_permille, residual_permille, unreachable) a feed.

        All of it but the expected sizes is counted from the copies drawn.  The
        residual is reached less target.  A feed is unreachable if all its
        documents are drawn as often as they may be and their ids still are
        fewer than its target asks for.
        """
        spark = self.sizes.sparkSession
        drawn = self.counts().groupBy(F.col("feed").alias("source")).agg(
            F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").cast("bigint").alias("drawn"), F.max("copies").alias("most_repeats"), F.min(F.col("copies") >= F.col("cap")).alias("_full")
        )
        all_ = sum(self.expected)
        known = spark.createDataFrame(
            [(r["feed"], r["permille"], r["cap"], r["t"], r["docs"], int(e), round(1000.0 * e / all_, 3) if all_ else None) for r, e in zip(self.feeds, self.expected)],
            "source string, target_permille int, max_repeats int, t bigint, docs bigint, expected_tokens bigint, reachable_permille double",
        )
        out = known.join(drawn, "source", "left").na.fill(0, ["tokens", "drawn", "most_repeats"])
        reached = F.round(F.try_divide(F.col("tokens") * 1000.0, F.col("_all")), 3)
        short = F.coalesce("_full", F.lit(True)) & (F.col("tokens").cast("decimal(28,0)") * 1000 < F.col("target_permille") * F.lit(self.total).cast("decimal(28,0)"))
        out = out.crossJoin(F.broadcast(out.agg(F.sum("tokens").alias("_all")))).withColumns({"reached_permille": reached, "unreachable": short})
        return out.withColumn("residual_permille", F.round(F.col("reached_permille") - F.col("target_permille"), 3)).drop("_all", "_full")
