"""Fitting of linear text classifiers on bounded samples: TF-IDF spaces, sparse designs, and a quasi-Newton search.

These are array operations of one task.  A study has many fits (settings times
folds), each of which is a task of its own, so a grid search is one Spark stage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Docs:
    """Different terms (64-bit hashes) of each document and their counts: rows lie between offsets."""

    terms: np.ndarray
    counts: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, *parts: tuple) -> Docs:
        """Documents from columns of lists; several (terms, counts) pairs of columns are joined row by row."""
        n = len(parts[0][0])
        lens = [np.fromiter(map(len, t), np.int64, n) for t, _ in parts]
        row = np.concatenate([np.repeat(np.arange(n), k) for k in lens])
        terms = np.concatenate([np.concatenate([*map(np.asarray, t), np.zeros(0, np.int64)]) for t, _ in parts]).astype(np.int64)
        counts = np.concatenate([np.concatenate([*map(np.asarray, c), np.zeros(0, np.int64)]) for _, c in parts]).astype(np.int64)
        o = np.argsort(row, kind="stable")
        return cls(terms[o], counts[o], np.concatenate([[0], np.cumsum(sum(lens))]))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))


@dataclass
class Space:
    """The terms of training documents with df at least min_df and at most max_share of them, sorted, and their idf."""

    terms: np.ndarray
    idf: np.ndarray

    @classmethod
    def fit(cls, docs: Docs, min_df: int, max_share: float = 0.9) -> Space:
        terms, df = np.unique(docs.terms, return_counts=True)
        keep = (df >= min_df) & (df <= max_share * len(docs))
        return cls(terms[keep], np.log((1.0 + len(docs)) / (1.0 + df[keep])) + 1.0)

    def place(self, docs: Docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value): (1 + ln tf) * idf, rows of length 1; unknown terms are left out."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        at = np.minimum(np.searchsorted(self.terms, docs.terms), len(self.terms) - 1)
        ok = self.terms[at] == docs.terms
        row, col = docs.rows()[ok], at[ok]
        w = (1.0 + np.log(docs.counts[ok])) * self.idf[col]
        norm = np.sqrt(np.bincount(row, w * w, len(docs)))
        return row, col, (w / norm[row]).astype(np.float32)


class Design:
    """A matrix of documents by terms; frequent terms lie in a dense block, the others in rows and in columns."""

    def __init__(self, space: Space, docs: Docs, share: float = 0.05, most: int = 32_000_000):
        row, col, val = space.place(docs)
        self.n, self.d = len(docs), len(space.terms)
        df = np.bincount(col, minlength=self.d)
        common = np.flatnonzero(df > max(share * self.n, 1))
        common = common[np.argsort(-df[common], kind="stable")][: most // max(self.n, 1)]
        self.common = common
        at = np.full(self.d, -1)
        at[common] = np.arange(len(common))
        dense = at[col] >= 0
        self.block = np.zeros((self.n, len(common)), np.float32)
        self.block[row[dense], at[col[dense]]] = val[dense]
        row, col, val = row[~dense], col[~dense], val[~dense]
        self.by_row = self._cut(row, col, val)
        o = np.argsort(col, kind="stable")
        self.by_col = self._cut(col[o], row[o], val[o])

    @staticmethod
    def _cut(outer, inner, val):
        """(outer values, starts, inner, value) of entries in order of the outer index."""
        first = np.flatnonzero(np.concatenate([[True], outer[1:] != outer[:-1]])) if len(outer) else np.zeros(0, np.int64)
        return outer[first], first, inner, val[:, None]

    @staticmethod
    def _sum(part, x: np.ndarray, out: np.ndarray, chunk: int = 1 << 17) -> np.ndarray:
        outer, first, inner, val = part
        i = 0
        while i < len(first):  # whole runs, about a chunk of entries at a time
            j = max(i + 1, int(np.searchsorted(first, first[i] + chunk)))
            lo, hi = first[i], first[j] if j < len(first) else len(inner)
            out[outer[i:j]] = np.add.reduceat(x[inner[lo:hi]] * val[lo:hi], first[i:j] - lo, axis=0)
            i = j
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        out = self._sum(self.by_row, w, np.zeros((self.n, w.shape[1]), np.float32))
        return out + self.block @ w[self.common] if len(self.common) else out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = self._sum(self.by_col, r, np.zeros((self.d, r.shape[1]), np.float32))
        if len(self.common):
            out[self.common] = self.block.T @ r
        return out


#: A step that lowers the objective by less than this part of it ends a fit.
LEAST = 1e-4


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, tol: float, most: int, memory: int = 8) -> tuple[np.ndarray, int]:
    """(x, steps) where the largest part of the gradient is under tol or a step gains less than LEAST, by L-BFGS with backtracking; at most ``most`` steps."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for step in range(most):
        if np.abs(g).max(initial=0) <= tol:
            return x, step
        q, alphas = g.copy(), []
        for s, y, rho in reversed(past):
            a = rho * float(np.vdot(s, q))
            alphas.append(a)
            q -= np.float32(a) * y
        if past:
            s, y, rho = past[-1]
            q *= np.float32(1.0 / (rho * float(np.vdot(y, y))))
        for (s, y, rho), a in zip(past, reversed(alphas)):
            q += np.float32(a - rho * float(np.vdot(y, q))) * s
        slope = -float(np.vdot(g, q))
        if slope >= 0:
            q, slope, past = g.copy(), -float(np.vdot(g, g)), []
        t = 1.0 if past else min(1.0, 1.0 / max(float(np.abs(g).sum()), 1e-12)) * 10
        for _ in range(30):
            nx = x - np.float32(t) * q
            nvalue, ng = f(nx)
            if nvalue <= value + 1e-4 * t * slope:
                break
            t *= 0.5
        else:
            return x, step
        s, y = nx - x, ng - g
        sy = float(np.vdot(s, y))
        if sy > 1e-12:
            past = [*past, (s, y, 1.0 / sy)][-memory:]
        done = value - nvalue <= LEAST * max(abs(value), 1e-12)
        x, value, g = nx, nvalue, ng
        if done:
            return x, step + 1
    return x, most


def balance(y: np.ndarray, k: int) -> np.ndarray:
    """n / (classes seen * rows of the class) of each class; 0 for a class without rows."""
    n = np.bincount(y, minlength=k)
    return np.divide(len(y), n * max((n > 0).sum(), 1), out=np.zeros(k), where=n > 0)


def _with_bias(fun, d: int, k: int):
    def f(x):
        value, gw, gb = fun(x[:-1], x[-1])
        return value, np.concatenate([gw, gb[None]]).astype(np.float32)

    return f, np.zeros((d + 1, k), np.float32)


def fit_logreg(x: Design, y: np.ndarray, k: int, c: float, most: int, tol: float = 1e-4, start=None):
    """Multinomial logistic regression: balanced cross-entropy plus |W|^2 / (2 c n); (weights, biases, steps)."""
    sw = balance(y, k)[y].astype(np.float32)[:, None] / max(len(y), 1)
    at = np.arange(len(y))
    penalty = 1.0 / (c * max(len(y), 1))

    def fun(w, b):
        s = x.times(w) + b
        s -= s.max(1, keepdims=True)
        e = np.exp(s)
        total = e.sum(1, keepdims=True)
        value = float((sw[:, 0] * (np.log(total[:, 0]) - s[at, y])).sum()) + penalty / 2 * float(np.vdot(w, w))
        r = e / total
        r[at, y] -= 1
        r *= sw
        return value, x.back(r) + np.float32(penalty) * w, r.sum(0)

    f, zero = _with_bias(fun, x.d, k)
    out, steps = minimise(f, zero if start is None else start, tol, most)
    return out[:-1], out[-1], steps


def fit_svm(x: Design, y: np.ndarray, k: int, c: float, most: int, tol: float = 1e-4, start=None):
    """One-vs-rest machines with squared hinge loss, positives balanced, plus |W|^2 / (2 c n); (weights, biases, steps)."""
    sign = np.full((len(y), k), -1, np.float32)
    sign[np.arange(len(y)), y] = 1
    sw = np.where(sign > 0, balance(y, k).astype(np.float32), np.float32(1)) / max(len(y), 1)
    penalty = 1.0 / (2 * c * max(len(y), 1))

    def fun(w, b):
        gap = np.maximum(1 - sign * (x.times(w) + b), 0)
        r = sw * gap
        value = float((r * gap).sum(dtype=np.float64)) + penalty * float(np.vdot(w, w))
        r *= -2 * sign
        return value, x.back(r) + np.float32(2 * penalty) * w, r.sum(0)

    f, zero = _with_bias(fun, x.d, k)
    out, steps = minimise(f, zero if start is None else start, tol, most)
    return out[:-1], out[-1], steps


def fit_bayes(x: Design, y: np.ndarray, k: int, alpha: float, most: int = 0, tol: float = 0, start=None):
    """Multinomial naive Bayes over the weights: log likelihoods and log priors; a class without rows has prior 0."""
    hot = np.zeros((len(y), k), np.float32)
    hot[np.arange(len(y)), y] = 1
    s = x.back(hot).astype(np.float64) + alpha
    with np.errstate(divide="ignore"):
        return np.log(s / s.sum(0)).astype(np.float32) if x.d else s.astype(np.float32), np.log(hot.sum(0) / max(len(y), 1)), 1


FITS = {"logreg": fit_logreg, "linear_svm": fit_svm, "naive_bayes": fit_bayes}


def macro_f1(y: np.ndarray, p: np.ndarray) -> float:
    """Unweighted mean of F1 over classes that are true or predicted."""
    k = int(max(y.max(initial=-1), p.max(initial=-1))) + 1
    both = np.bincount(y, minlength=k) + np.bincount(p, minlength=k)
    return float((2 * np.bincount(y[y == p], minlength=k)[both > 0] / both[both > 0]).mean()) if k else 0.0
