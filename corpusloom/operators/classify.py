"""Text classification: TF-IDF in long form, naive Bayes as aggregates, and tuned linear models with calibration."""

from __future__ import annotations

import io
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.tokens import counted, pair_rows, token_rows
from corpusloom.functions.tokens import term_counts as _term_counts
from corpusloom.operators import linear
from corpusloom.operators.evaluate import f1_summary
from corpusloom.plans.lineage import materialize, release

#: Candidates of a model, the same number for all.
BUDGET = 12
#: The reference's bounds on steps of a fit; convergence ends it before.
MOST_STEPS = {"logreg": 2000, "linear_svm": 1000, "naive_bayes": 1}
#: Labelled rows, in hash order, that candidates are compared on and that a model is fitted on, at most.
TUNE_ROWS, FIT_ROWS = 8_000, 40_000


# ---- TF-IDF and naive Bayes in long form


def term_counts(df: DataFrame, key: str, text: str, bigrams: bool = True, accents: bool = True) -> DataFrame:
    """(key, term, tf), counted within each row; a null text has no terms.  With accents, they are stripped."""
    return _term_counts(df, key, text, bigrams, accents).select(key, "term", "tf")


@dataclass
class Tfidf:
    """Terms (term, df, idf) of the training documents: df at least min_df and at most max_share of them."""

    terms: DataFrame
    docs: int

    @classmethod
    def fit(cls, counts: DataFrame, docs: int, min_df: int = 3, max_share: float = 0.9) -> Tfidf:
        df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_share)) * docs))
        return cls(materialize(df.withColumn("idf", F.log((1.0 + docs) / (1.0 + F.col("df"))) + 1.0), "terms"), docs)

    def weights(self, counts: DataFrame, key: str) -> DataFrame:
        """(key, term, weight): (1 + ln tf) * idf, rows of length 1."""
        w = counts.join(self.terms, "term").select(key, "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
        return w.select(key, "term", (F.col("w") / norm).alias("weight"))


@dataclass
class NaiveBayesTable:
    """Multinomial naive Bayes over weights: log priors by class, log likelihoods by class and term."""

    prior: DataFrame
    likelihood: DataFrame

    @classmethod
    def fit(cls, weights: DataFrame, labels: DataFrame, key: str, label: str, alpha: float = 0.1) -> NaiveBayesTable:
        """labels: (key, label) of the training documents; a class without terms has only its prior and smoothing."""
        n = labels.count()
        prior = labels.groupBy(label).agg(F.log(F.count(F.lit(1)) / F.lit(n)).alias("prior"))
        s = weights.join(labels, key).groupBy(label, "term").agg(F.sum("weight").alias("s"))
        terms = weights.select("term").distinct()
        v = terms.count()
        total = labels.select(label).distinct().join(s.groupBy(label).agg(F.sum("s").alias("t")), label, "left").na.fill(0.0, ["t"])
        # seen pairs only; log(alpha / (t + alpha * v)) stands for all others
        bound = total.withColumn("floor", F.log(F.lit(alpha) / (F.col("t") + alpha * v))).withColumn("den", F.col("t") + alpha * v)
        lik = s.join(bound, label).select(label, "term", (F.log((F.col("s") + alpha) / F.col("den")) - F.col("floor")).alias("gain"))
        return cls(prior.join(bound.select(label, "floor"), label), lik)

    def predict(self, weights: DataFrame, docs: DataFrame, key: str, label: str) -> DataFrame:
        """(key, pred): the best class of every document, the smallest one on a tie.

        The classes are few and broadcast with their priors: a document meets
        each class once for the smoothing, and its terms' seen pairs by a join.
        """
        mass = docs.join(weights.groupBy(key).agg(F.sum("weight").alias("mass")), key, "left").na.fill(0.0, ["mass"])
        base = mass.crossJoin(F.broadcast(self.prior)).select(key, label, (F.col("prior") + F.col("mass") * F.col("floor")).alias("base"))
        gain = weights.join(self.likelihood, "term").groupBy(key, label).agg(F.sum(F.col("weight") * F.col("gain")).alias("g"))
        score = F.round(F.col("base") + F.coalesce("g", F.lit(0.0)), 9)
        best = base.join(gain, [key, label], "left").select(key, label, score.alias("score")).groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(label).alias("pred"))).alias("b"))
        return best.select(key, F.col("b.pred").alias("pred"))


# ---- tuned models


GRIDS = {"logreg": (0.1, 1.0, 10.0), "naive_bayes": (0.01, 0.1, 1.0), "linear_svm": (0.1, 1.0, 10.0)}


def grid(name: str) -> list[tuple[float, int, bool]]:
    """(value, min_df, bigrams) of the candidates of a model; all models have the same number."""
    if name not in GRIDS:
        raise ValueError(f"unknown model {name}")
    out = [(v, m, b) for v in GRIDS[name] for m in (2, 3) for b in (False, True)]
    if len(out) != BUDGET:
        raise ValueError(f"{name}: {len(out)} candidates, the budget is {BUDGET}")
    return out


_VECTORS = "words array<bigint>, word_counts array<bigint>, pairs array<bigint>, pair_counts array<bigint>"


def _lists(flat: pa.Array, row: np.ndarray, n: int) -> list[pa.Array]:
    r, code, count, terms = counted(flat, row)
    hashes = pd.util.hash_array(terms.to_numpy(zero_copy_only=False).astype(object)).view(np.int64) if len(terms) else np.zeros(0, np.int64)
    offsets = pa.array(np.searchsorted(r, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(hashes[code])), pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int64)))]


def _vectorised(batch: pa.RecordBatch) -> list[pa.Array]:
    """The columns of _VECTORS for the texts in a batch's last column."""
    flat, row = token_rows(batch.column(batch.num_columns - 1))
    return [*_lists(flat, row, batch.num_rows), *_lists(*pair_rows(flat, row), batch.num_rows)]


def vectors(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` and the hashed terms of each text with their counts: single tokens, without accents, and pairs."""
    out = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1]) + ", " + _VECTORS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *_vectorised(b)], names=[*b.schema.names[:-1], "words", "word_counts", "pairs", "pair_counts"])

    return out.mapInArrow(run, schema)


def _docs(t, bigrams: bool) -> linear.Docs:
    """Documents of vector columns in pandas."""
    parts = [(t["words"].tolist(), t["word_counts"].tolist())]
    return linear.Docs.of(*parts, (t["pairs"].tolist(), t["pair_counts"].tolist())) if bigrams else linear.Docs.of(*parts)


@dataclass
class Model:
    """A fitted model: scores are joint log likelihoods (naive Bayes), logits (logreg) or margins (linear_svm)."""

    name: str
    labels: list[str]
    bigrams: bool
    space: linear.Space
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, t: pd.DataFrame) -> np.ndarray:
        docs = _docs(t, self.bigrams)
        row, col, val = self.space.place(docs)
        out = np.zeros((len(docs), len(self.labels)), np.float32)
        part = linear.Design._cut(row, col, val)
        return linear.Design._sum(part, self.weights, out).astype(np.float64) + self.bias

    def probabilities(self, scores: np.ndarray) -> np.ndarray | None:
        if self.name == "linear_svm":
            return None
        e = np.exp(scores - scores.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def apply(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with pred, the label of the largest score (the first of equal ones), scores, and p (null without probabilities)."""
        own, model = df.columns, df.sparkSession.sparkContext.broadcast(self)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", pred string, scores array<double>, p array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.value
            for b in batches:
                if not b.num_rows:
                    continue
                t = pa.Table.from_arrays(_vectorised(b), names=["words", "word_counts", "pairs", "pair_counts"]).to_pandas()
                s = m.scores(t)
                p = m.probabilities(s)
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel()))
                pred = pa.array([m.labels[i] for i in s.argmax(1)], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pred, lists(s), lists(p) if p is not None else pa.nulls(b.num_rows, pa.list_(pa.float64()))], names=[*own, "pred", "scores", "p"])

        return df.select("*", F.col(text).alias("_text")).mapInArrow(run, schema)

    def save(self, path: str, spark) -> None:
        """One row of a parquet table: the settings as JSON, the arrays in numpy's format."""
        raw = io.BytesIO()
        np.savez_compressed(raw, terms=self.space.terms, idf=self.space.idf, weights=self.weights, bias=self.bias)
        about = json.dumps({"name": self.name, "labels": self.labels, "bigrams": self.bigrams})
        spark.createDataFrame([(about, bytearray(raw.getvalue()))], "about string, arrays binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str, spark) -> Model:
        r = spark.read.parquet(path).first()
        x, about = np.load(io.BytesIO(bytes(r["arrays"]))), json.loads(r["about"])
        return cls(about["name"], about["labels"], about["bigrams"], linear.Space(x["terms"], x["idf"]), x["weights"], x["bias"])


@dataclass
class FitResult:
    name: str
    best: dict
    train_seconds: float
    predict_seconds_per_1k: float
    metrics: dict
    predictions: DataFrame
    model: Model
    scores: list = field(default_factory=list)


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 3, seed: int = 0, to: str = "fold") -> DataFrame:
    """A fold of each row such that every class is spread evenly, in hash order within the class."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), key), key))
    return df.withColumn(to, ((place - 1) % k).cast("int"))


def _bounded(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """All rows, or about ``most`` of them in hash order."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(n)) < most)


def cross_validated(name: str, ready: DataFrame, k: int) -> list[tuple[float, float, int, bool]]:
    """(mean macro F1 over the folds, value, min_df, bigrams) of the whole budget.

    ready: fold, y and vector columns of a bounded sample.  Each pair of feature
    settings and fold is one task, in which the candidates of its values are
    fitted one after the other, each from where the last ended.
    """
    wanted = grid(name)
    most = MOST_STEPS[name]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        min_df, bigrams, fold = int(pdf["min_df"].iloc[0]), bool(pdf["bigrams"].iloc[0]), int(pdf["hold"].iloc[0])
        held = (pdf["fold"] == fold).to_numpy()
        if held.all() or not held.any():
            return pd.DataFrame({"value": [], "min_df": [], "bigrams": [], "f1": []})
        train, test = _docs(pdf[~held], bigrams), _docs(pdf[held], bigrams)
        space = linear.Space.fit(train, min_df)
        x, y = linear.Design(space, train), pdf["y"].to_numpy()
        z, start, out = linear.Design(space, test), None, []
        for v in sorted(v for v, m, b in wanted if (m, b) == (min_df, bigrams)):
            w, bias, _ = linear.FITS[name](x, y[~held], k, v, most, start=start)
            start = np.concatenate([w, bias[None]]).astype(np.float32) if most > 1 else None
            out.append((v, min_df, bigrams, linear.macro_f1(y[held], (z.times(w) + bias).argmax(1))))
        return pd.DataFrame(out, columns=["value", "min_df", "bigrams", "f1"])

    settings = F.array(*(F.struct(F.lit(m).alias("min_df"), F.lit(b).alias("bigrams"), F.lit(f).alias("hold")) for m in sorted({m for _, m, _ in wanted}) for b in (False, True) for f in range(3)))
    tasks = ready.withColumn("x", F.explode(settings)).select("*", "x.*").drop("x").repartition(12, "min_df", "bigrams", "hold")
    got = tasks.groupBy("min_df", "bigrams", "hold").applyInPandas(run, "value double, min_df int, bigrams boolean, f1 double")
    return [(r["f1"], r["value"], r["min_df"], r["bigrams"]) for r in got.groupBy("value", "min_df", "bigrams").agg(F.avg("f1").alias("f1")).collect()]


def fit(name: str, ready: DataFrame, labels: list[str], value: float, min_df: int, bigrams: bool) -> Model:
    """A model of one candidate on a bounded sample (y and vector columns), fitted in one task."""
    k, most = len(labels), MOST_STEPS[name]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = _docs(pdf, bigrams)
        space = linear.Space.fit(docs, min_df)
        w, bias, _ = linear.FITS[name](linear.Design(space, docs), pdf["y"].to_numpy(), k, value, most)
        raw = io.BytesIO()
        np.savez_compressed(raw, terms=space.terms, idf=space.idf, weights=w.astype(np.float32), bias=np.asarray(bias, np.float64))
        return pd.DataFrame({"arrays": [raw.getvalue()]})

    r = ready.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "arrays binary").first()
    if r is None:
        return Model(name, labels, bigrams, linear.Space(np.zeros(0, np.int64), np.zeros(0)), np.zeros((0, k), np.float32), np.zeros(k))
    x = np.load(io.BytesIO(bytes(r["arrays"])))
    return Model(name, labels, bigrams, linear.Space(x["terms"], x["idf"]), x["weights"], x["bias"])


def fit_and_score(
    name: str, train: DataFrame, dev: DataFrame, label: str = "label_name", text: str = "text", key: str = "clause_id", seed: int = 0, tune: bool = True, candidate: tuple[float, int, bool] = (1.0, 3, True)
) -> FitResult:
    """Tune on train by 3-fold cross-validation on macro F1 (the whole budget), fit the best candidate, and score all of dev.

    Texts are counted once.  Candidates are compared on TUNE_ROWS labelled rows
    and the best is fitted on FIT_ROWS, in hash order, or on all if there are no
    more; both bound the memory of a task, whatever the table.  Ties go to the
    smaller value, the smaller min_df and no bigrams.  Rows without a label are
    left out; classes that train lacks are never predicted.
    """
    train = train.where(F.col(label).isNotNull()).select(key, text, F.col(label).alias("_label"))
    dev = dev.where(F.col(label).isNotNull()).select(key, text, F.col(label).alias("true"))
    began = time.time()
    labels = [r[0] for r in train.select("_label").distinct().orderBy("_label").collect()]
    known = train.sparkSession.createDataFrame(list(enumerate(labels)), "y int, _label string")
    some = _bounded(train, key, FIT_ROWS, seed).join(F.broadcast(known), "_label")
    ready = materialize(stratified_folds(vectors(some, [key, "y"], text), "y", key, 3, seed), "train")
    scores = cross_validated(name, _bounded(ready, key, TUNE_ROWS, seed + 1), len(labels)) if tune else []
    best = max(scores, key=lambda s: (s[0], -s[1], -s[2], not s[3]))[1:] if scores else candidate
    model = fit(name, ready, labels, *best)
    release(ready)
    took = time.time() - began
    began = time.time()
    predictions = materialize(model.apply(dev, text).select(key, "true", "pred"), "predictions")
    summary = f1_summary(predictions).first()
    per_1k = (time.time() - began) / max(summary["n"] or 0, 1) * 1000
    metrics = {m: summary[m] for m in ("macro_f1", "micro_f1", "accuracy")}
    return FitResult(name, dict(zip(("value", "min_df", "bigrams"), best)), took, per_1k, metrics, predictions, model, scores)


# ---- calibration of a frozen model

#: Steps of a class's range of scores by which held-out rows are counted before a map is fitted.
LEVELS = 1 << 16


def platt(s: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a s + b))) by Newton's method; targets are (n1 + 1) / (n1 + 2) and 1 / (n0 + 2)."""
    n1, n0 = pos.sum(), neg.sum()
    n = pos + neg
    t = (pos * (n1 + 1) / (n1 + 2) + neg / (n0 + 2)) / n
    mean, scale = float((n * s).sum() / n.sum()), float(np.sqrt((n * (s - (n * s).sum() / n.sum()) ** 2).sum() / n.sum())) or 1.0
    z = (s - mean) / scale
    x = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    loss = lambda x: float((n * (np.logaddexp(0, x[0] * z + x[1]) - t * (x[0] * z + x[1]))).sum())
    now = loss(x)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x[0] * z + x[1])))
        g = np.array([(n * (p - t) * z).sum(), (n * (p - t)).sum()])
        if np.abs(g).max() < 1e-9 * n.sum():
            break
        h = n * p * (1 - p)
        m = np.array([[(h * z * z).sum() + 1e-12, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-12]])
        d, step = np.linalg.solve(m, g), 1.0
        while loss(x - step * d) > now and step > 1e-10:
            step /= 2
        x = x - step * d
        now = loss(x)
    return float(x[0] / scale), float(x[1] - x[0] * mean / scale)


def isotonic(s: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries and values of the nearest rising step function, by pooling neighbours that fall; the ends of each pool are kept."""
    pools: list[list[float]] = []
    for a, y, m in zip(s, pos, n):
        pools.append([a, a, float(y), float(m)])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    xs = np.array([v for p in pools for v in (p[0], p[1])])
    return xs, np.array([p[2] / p[3] for p in pools for _ in (0, 1)])


@dataclass
class Calibrated:
    """Per-class sigmoid or isotonic maps of scores, renormalised to sum to 1."""

    models: list
    method: str

    @classmethod
    def fit(cls, scored: DataFrame, k: int, method: str = "sigmoid", scores: str = "scores", label: str = "label") -> Calibrated:
        """scored: (scores array of k, label index) of held-out rows.

        Rows are first counted by class and level of score (LEVELS over the
        class's range, each standing for the mean of its scores), so that a
        class's map is fitted in one task from a bounded table.
        """
        if method not in ("sigmoid", "isotonic"):
            raise ValueError(f"unknown method {method}")
        long = scored.select(F.posexplode(scores).alias("c", "s"), F.col(label).cast("int").alias("label")).select("c", "s", (F.col("c") == F.col("label")).cast("int").alias("y"))
        span = long.groupBy("c").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
        level = F.floor(F.when(F.col("hi") > F.col("lo"), (F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * LEVELS).otherwise(0))
        binned = long.join(F.broadcast(span), "c").groupBy("c", level.alias("level")).agg(F.avg("s").alias("s"), F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("s")
            s, pos, n = (pdf[c].to_numpy(float) for c in ("s", "pos", "n"))
            if method == "sigmoid":
                a, b = platt(s, pos, n - pos)
                xs, ys = [a], [b]
            else:
                xs, ys = isotonic(s, pos, n)
            return pd.DataFrame({"c": [int(pdf["c"].iloc[0])], "xs": [list(map(float, xs))], "ys": [list(map(float, ys))]})

        maps = {r["c"]: (np.array(r["xs"]), np.array(r["ys"])) for r in binned.groupBy("c").applyInPandas(run, "c int, xs array<double>, ys array<double>").collect()}
        none = (np.zeros(1), np.full(1, -np.inf)) if method == "sigmoid" else (np.zeros(2), np.zeros(2))
        return cls([maps.get(c, none) for c in range(k)], method)

    def of(self, scores: np.ndarray) -> np.ndarray:
        """Probabilities (rows x classes) that sum to 1; uniform where all are 0."""
        p = np.empty_like(scores, dtype=float)
        for c, (x, y) in enumerate(self.models):
            p[:, c] = 1 / (1 + np.exp(-(x[0] * scores[:, c] + y[0]))) if self.method == "sigmoid" else np.interp(scores[:, c], x, y)
        total = p.sum(1, keepdims=True)
        return np.where(total > 0, p / np.where(total > 0, total, 1), 1.0 / max(p.shape[1], 1))

    def apply(self, df: DataFrame, scores: str = "scores", to: str = "p") -> DataFrame:
        """df with the column ``to`` of calibrated probabilities."""
        own = df.drop(to)
        maps = df.sparkSession.sparkContext.broadcast(self)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields) + f", `{to}` array<double>"
        at = own.columns.index(scores)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    k = len(maps.value.models)
                    p = maps.value.of(b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, k))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k, dtype=np.int32)), pa.array(p.ravel()))
                    yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, to])

        return own.mapInArrow(run, schema)


def classify(model: Model, df: DataFrame, text: str = "text", calibrated: Calibrated | None = None) -> DataFrame:
    """df with pred, confidence (the largest probability, null for a model without) and the calibration's name."""
    out = model.apply(df, text)
    out = calibrated.apply(out) if calibrated else out
    return out.select(*df.columns, "pred", F.array_max("p").alias("confidence"), F.lit(calibrated.method if calibrated else "none").alias("calibration"))
