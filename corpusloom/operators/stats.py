"""Bootstrap intervals and paired permutation tests from hashed draws: partial sums a partition, whatever the rows' number.

Replicate r of the row with key k draws from md5("seed:block:k"), so that
rows need not meet and any engine repeats the draws.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 65,536 times P(count <= k) of a Poisson distribution of mean 1, for k = 0, 1, ...: a 16-bit draw's count is how many of them it reaches.
STEPS = np.array([24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535])
#: Entries of a batch's table of draws.
_CELLS = 8_000_000


def _digests(keys: list[str], seed: int, blocks: int) -> np.ndarray:
    """(keys, blocks, 16) bytes."""
    raw = b"".join(md5(f"{seed}:{j}:{k}".encode("utf-8", "surrogatepass")).digest() for k in keys for j in range(blocks))
    return np.frombuffer(raw, np.uint8).reshape(len(keys), blocks, 16)


def poisson_weights(keys: list[str], reps: int, seed: int) -> np.ndarray:
    """(keys, reps): how often each replicate draws each row; eight draws of 16 bits a digest."""
    draws = _digests(keys, seed, -(-reps // 8)).view(">u2").reshape(len(keys), -1)[:, :reps]
    return np.searchsorted(STEPS, draws.ravel(), side="right").reshape(draws.shape)


def signs(keys: list[str], reps: int, seed: int) -> np.ndarray:
    """(keys, reps) of 1 and -1: thirty-two hexadecimal digits a digest, of which those under 8 are 1."""
    d = _digests(keys, seed, -(-reps // 32))
    digits = np.stack([d >> 4, d & 15], axis=-1).reshape(len(keys), -1)[:, :reps]
    return np.where(digits < 8, 1.0, -1.0)


def _pieces(batches: Iterator[pa.RecordBatch], reps: int) -> Iterator[pa.RecordBatch]:
    step = max(1, _CELLS // max(reps, 1))
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def _summed(df: DataFrame, reps: int, sums: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """(part, rep, v): sums(piece) gives an array of reps values for each part (a string); they are added up over all rows.

    A partition yields one row a part and chunk of replicates, so what is
    shuffled does not depend on its rows.
    """

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in _pieces(batches, reps):
            for part, v in sums(b).items():
                total[part] = total[part] + v if part in total else v
        if total:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.string()), "v": pa.array([v.astype(float).tolist() for v in total.values()], pa.list_(pa.float64()))})

    out = df.mapInArrow(run, "part string, v array<double>")
    return out.select("part", F.posexplode("v").alias("rep", "v")).groupBy("part", "rep").agg(F.sum("v").alias("v"))


def _interval(values: DataFrame, alpha: float) -> DataFrame:
    """(lo, hi): the percentile interval of a column v."""
    return values.agg(F.round(F.percentile("v", alpha / 2), 6).alias("lo"), F.round(F.percentile("v", 1 - alpha / 2), 6).alias("hi"))


def bootstrap_ci(df: DataFrame, key: str, score: str, statistic: Callable[[np.ndarray, np.ndarray], float] | None = None, reps: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(point, lo, hi): the mean of a score and its percentile interval over Poisson resamples of the rows.

    A row without a score takes no part; a key given twice is drawn alike both
    times.  statistic(values, weights) replaces the mean: each replicate then
    sees the different values, in order, with the sum of their rows' draws, in
    one task.  No rows give nulls.
    """
    rows = df.where(F.col(score).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(score).cast("double").alias("x"))

    if statistic is None:

        def sums(b):
            w = poisson_weights(b.column(0).to_pylist(), reps, seed)
            return {"n": w.sum(0), "x": b.column(1).to_numpy() @ w}

        wide = _summed(rows, reps, sums).groupBy("rep").pivot("part", ["n", "x"]).agg(F.first("v"))
        values, point = wide.select(F.try_divide("x", "n").alias("v")), rows.agg(F.round(F.avg("x"), 6).alias("point"))
        return point.crossJoin(F.broadcast(_interval(values, alpha)))

    def weighed(b):
        w = poisson_weights(b.column(0).to_pylist(), reps, seed)
        xs, at = np.unique(b.column(1).to_numpy(), return_inverse=True)
        return {repr(float(x)): w[at == i].sum(0) for i, x in enumerate(xs)}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w = pdf["part"].astype(float).to_numpy(), pdf["v"].to_numpy()
        o = np.argsort(x)
        return pd.DataFrame({"v": [float(statistic(x[o], w[o]))]})

    values = _summed(rows, reps, weighed).groupBy("rep").applyInPandas(one, "v double")
    whole = rows.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("v")).withColumn("part", F.col("x").cast("string")).withColumn("all", F.lit(1))
    point = whole.groupBy("all").applyInPandas(one, "v double").agg(F.round(F.first("v"), 6).alias("point"))
    return point.crossJoin(F.broadcast(_interval(values, alpha)))


def bootstrap_macro_f1(df: DataFrame, key: str, true: str = "true", pred: str = "pred", reps: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(point, lo, hi) of macro F1 over Poisson resamples of the rows; a replicate's classes are those it drew.

    Rows are summed by class, so a partition yields three rows a class.  Rows
    without a label or a prediction take no part.
    """
    rows = df.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(true).cast("string").alias("t"), F.col(pred).cast("string").alias("p"))

    def sums(b):
        w = poisson_weights(b.column(0).to_pylist(), reps, seed).astype(np.float64)
        t, p = b.column(1).to_pandas().to_numpy(), b.column(2).to_pandas().to_numpy()
        out = {}
        for kind, lab, use in (("tp", t, t == p), ("support", t, slice(None)), ("predicted", p, slice(None))):
            for c in set(lab[use]):
                out[f"{kind} {c}"] = w[use][lab[use] == c].sum(0)
        return out

    long = _summed(rows, reps, sums).select(F.substring_index("part", " ", 1).alias("kind"), F.expr("substring(part, instr(part, ' ') + 1)").alias("label"), "rep", "v")
    by = long.groupBy("rep", "label").pivot("kind", ["tp", "support", "predicted"]).agg(F.first("v")).na.fill(0.0)
    f1 = lambda d: d.where("support + predicted > 0").select("*", (2 * F.col("tp") / (F.col("support") + F.col("predicted"))).alias("f"))
    values = f1(by).groupBy("rep").agg(F.avg("f").alias("v"))
    ends = rows.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p")), F.struct(F.col("p").alias("label"), F.lit(0).alias("s"), F.lit(1).alias("p")))).alias("x"), (F.col("t") == F.col("p")).cast("int").alias("hit"))
    whole = ends.select("x.*", "hit").groupBy("label").agg(F.sum(F.col("s") * F.col("hit")).alias("tp"), F.sum("s").alias("support"), F.sum("p").alias("predicted"))
    return f1(whole).agg(F.round(F.avg("f"), 6).alias("point")).crossJoin(F.broadcast(_interval(values, alpha)))


def paired_test(df: DataFrame, key: str, a: str = "a", b: str = "b", perms: int = 10_000, seed: int = 0) -> DataFrame:
    """(mean_diff, p_value, n): two-sided sign-flip test of paired scores, without correction, so that p can be 0.

    A missing score is an error, as the pairs would not be aligned.
    """
    if not df.where(F.col(a).isNull() | F.col(b).isNull()).isEmpty():
        raise ValueError("paired scores must be aligned: a score is missing")
    rows = df.select(F.col(key).cast("string").alias("k"), (F.col(a).cast("double") - F.col(b).cast("double")).alias("d"))
    null = _summed(rows, perms, lambda p: {"d": p.column(1).to_numpy() @ signs(p.column(0).to_pylist(), perms, seed)})
    obs = rows.agg(F.avg("d").alias("mean_diff"), F.count(F.lit(1)).alias("n"))
    hit = (F.abs(F.col("v") / F.col("n")) >= F.abs("mean_diff") - 1e-12).cast("double")
    return null.crossJoin(F.broadcast(obs)).groupBy("mean_diff", "n").agg(F.round(F.avg(hit), 6).alias("p_value")).select(F.round("mean_diff", 6).alias("mean_diff"), "p_value", "n")


def aligned(df: DataFrame, stored: DataFrame, key: str, value: str, within: float = 1e-9) -> DataFrame:
    """df, after checking that its values of ``value`` and the stored ones of the same keys differ by no more than ``within``."""
    other = stored.select(key, F.col(value).alias("_stored"))
    off = df.select(key, value).join(other, key, "full").where(F.col(value).isNull() | F.col("_stored").isNull() | (F.abs(F.col(value) - F.col("_stored")) > within))
    first = off.first()
    if first is not None:
        raise ValueError(f"not aligned with what is stored: {first.asDict()}")
    return df
