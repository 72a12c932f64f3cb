"""One-vs-rest linear machines over all rows, for several ways to merge the labels at once.

A machine's solution depends only on the rows inside its margin.  Rows are
encoded once and stay in the shared folder; a task fits some of the machines:
it reads all rows block by block, holds those inside a machine's margin, solves
for them by Newton's method, and repeats until the rows left out add nothing.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.tokens import counted, pair_rows, token_rows
from corpusloom.plans.lineage import materialize, release

#: A fit ends where this part of the objective, at most, can still be gained.
LEAST = 1e-4
#: A fit starts from its positives and one of so many rows; where it ends is decided on all rows.
START = 16
#: Systems are solved to this part of their squared residual, and a start to this part of its objective.
FORCE = 3e-2
#: Bytes of blocks, and of one machine's rows, that a task keeps in memory; what is beyond is read again or lies in a local file.
KEPT = 96 << 20
#: Rows whose terms are counted, and kept, together.
BLOCK = 2048


def _terms(texts: pa.Array, bigrams: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the different terms of each text, in order of rows."""
    flat, row = token_rows(texts)
    parts = [counted(flat, row)] + ([counted(*pair_rows(flat, row))] if bigrams else [])
    hashes = [pd.util.hash_array(t.to_numpy(zero_copy_only=False).astype(object)).view(np.int64)[c] if len(t) else np.zeros(0, np.int64) for _, c, _, t in parts]
    rows = np.concatenate([p[0] for p in parts])
    o = np.argsort(rows, kind="stable")
    return rows[o], np.concatenate(hashes)[o], np.concatenate([p[2] for p in parts])[o]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK))


def vocabulary(df: DataFrame, text: str, n: int, min_df: int, bigrams: bool, max_share: float = 0.9) -> DataFrame:
    """(term, df): hashed terms in at least min_df and at most max_share of the n texts, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            terms, df = np.unique(_terms(b.column(0), bigrams)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df.astype(np.int64))], names=["term", "df"])

    got = df.select(text).mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return materialize(got.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_share)) * n)), "vocabulary")


def _files(path: str) -> list[tuple]:
    """(file system, file) of a table of the shared folder, within a task."""
    import pyarrow.fs as fs

    system, at = fs.FileSystem.from_uri(path)
    return [(system, x.path) for x in sorted(system.get_file_info(fs.FileSelector(at)), key=lambda x: x.path) if x.path.endswith(".parquet")]


def _batches(files: list[tuple], rows: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    for system, at in files:
        with system.open_input_file(at) as raw:
            yield from pq.ParquetFile(raw).iter_batches(batch_size=rows)


def _space(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(terms, df) of a vocabulary, sorted."""
    parts = [(b.column("term").to_numpy(), b.column("df").to_numpy()) for b in _batches(_files(path), 1 << 16)]
    terms, df = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (0, 1))
    o = np.argsort(terms)
    return terms[o], df[o]


@dataclass
class Rows:
    """Encoded rows: label, 1 / length, offsets, columns and 1 + ln tf.  The idf is left to the weights; both factors may lie in val, without a scale."""

    y: np.ndarray
    scale: np.ndarray | None
    ptr: np.ndarray
    cols: np.ndarray
    val: np.ndarray

    def of(self, mask: np.ndarray) -> Rows:
        lens = np.diff(self.ptr)
        e = np.repeat(mask, lens)
        return Rows(self.y[mask], self.scale[mask], np.concatenate([[0], np.cumsum(lens[mask])]), self.cols[e], self.val[e])

    def times(self, v: np.ndarray) -> np.ndarray:
        out, some = np.zeros(len(self.y)), np.diff(self.ptr) > 0
        if some.any():
            x = v.astype(np.float32, copy=False)[self.cols]
            x *= self.val
            out[some] = np.add.reduceat(x, self.ptr[:-1][some])
        return out if self.scale is None else out * self.scale

    def back(self, r: np.ndarray, d: int, square: bool = False) -> np.ndarray:
        """Sums by column; of a table without a scale."""
        each = np.repeat(r.astype(np.float32), np.diff(self.ptr))
        each *= self.val
        if square:
            each *= self.val
        return np.bincount(self.cols, each, d)

    def size(self) -> int:
        return sum(a.nbytes for a in (self.y, self.scale, self.ptr, self.cols, self.val) if a is not None)


def encoded(df: DataFrame, text: str, words: DataFrame, n: int, bigrams: bool) -> DataFrame:
    """df's other columns (lists) and Rows, one row a block, written to the shared folder; y is one of df's columns."""
    own = [c for c in df.columns if c != text]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    path = words._corpusloom_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df_ = _space(path)
        idf = np.log((1.0 + n) / (1.0 + df_)) + 1.0
        for b in _slices(batches):
            row, term, tf = _terms(b.column(b.num_columns - 1), bigrams)
            at = np.minimum(np.searchsorted(terms, term), max(len(terms) - 1, 0))
            ok = terms[at] == term if len(terms) else np.zeros(len(term), bool)
            row, at, val = row[ok], at[ok], 1.0 + np.log(tf[ok])
            norm = np.sqrt(np.bincount(row, (val * idf[at]) ** 2, b.num_rows))
            scale = np.divide(1.0, norm, out=np.zeros(b.num_rows), where=norm > 0)
            parts = [np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int64), at.astype(np.int32), val.astype(np.float32), scale]
            lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), c) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*lists, *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=[*own, "ptr", "cols", "val", "scale"])

    schema = ", ".join(f"`{c}` array<{kinds[c]}>" for c in own) + ", ptr binary, cols binary, val binary, scale binary"
    return materialize(df.select(*own, text).mapInArrow(run, schema), "encoded")


def _blocks(files: list[tuple]) -> Iterator[tuple[Rows, pa.RecordBatch]]:
    for b in _batches(files, 1):
        raw = lambda c, t: np.frombuffer(b.column(c)[0].as_buffer(), t)  # noqa: B023, E731
        y = b.column("y").flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        yield Rows(y, raw("scale", np.float64), raw("ptr", np.int64), raw("cols", np.int32), raw("val", np.float32)), b


class _Held:
    """Pieces of rows; those beyond KEPT bytes lie in local files."""

    def __init__(self):
        self.pieces: list[Rows] = []
        self.loose: list[Rows] = []
        self.bytes, self.folder = 0, None

    def add(self, r: Rows) -> None:
        self.bytes += r.size()
        if self.bytes <= KEPT:
            self.loose.append(r)
            return
        self.folder = self.folder or tempfile.TemporaryDirectory()
        kept = []
        for name in ("cols", "val"):
            np.save(at := f"{self.folder.name}/{len(self.pieces)}-{name}.npy", getattr(r, name))
            kept.append(np.load(at, mmap_mode="r") if len(getattr(r, name)) else getattr(r, name))
        self.pieces.append(Rows(r.y, r.scale, r.ptr, *kept))

    def all(self) -> list[Rows]:
        return self.loose + self.pieces

    def joined(self) -> _Held:
        """The rows in memory in one piece."""
        if len(x := self.loose) > 1:
            join = lambda c: np.concatenate([getattr(r, c) for r in x])
            ptr = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(r.ptr) for r in x]))])
            self.loose = [Rows(join("y"), None if x[0].scale is None else join("scale"), ptr, join("cols"), join("val"))]
        return self

    def parts(self, v: np.ndarray) -> Iterator[tuple[Rows, np.ndarray]]:
        """Each piece with the values of its rows."""
        i = 0
        for p in self.all():
            yield p, v[i : i + len(p.y)]
            i += len(p.y)

    def times(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float32)
        return np.concatenate([r.times(v) for r in self.all()] or [np.zeros(0)])

    def back(self, r: np.ndarray, d: int, square: bool = False) -> np.ndarray:
        return sum((p.back(x, d, square) for p, x in self.parts(r)), np.zeros(d))

    def only(self, mask: np.ndarray, idf: np.ndarray) -> tuple[_Held, np.ndarray]:
        """Some rows with whole values over the columns that they have, and these columns."""
        seen = np.zeros(len(idf), bool)
        for p, m in self.parts(mask):
            seen[p.cols[np.repeat(m, np.diff(p.ptr))]] = True
        place, out = np.cumsum(seen) - 1, _Held()
        for p, m in self.parts(mask):
            r = p.of(m)
            val = idf.astype(np.float32)[r.cols] * r.val * np.repeat(r.scale.astype(np.float32), np.diff(r.ptr))
            out.add(Rows(r.y, None, r.ptr, place[r.cols], val))
        return out.joined(), np.flatnonzero(seen)


def solve(x: _Held, sign: np.ndarray, weight: np.ndarray, idf: np.ndarray, w: np.ndarray, least: float, most: int = 50) -> np.ndarray:
    """The minimum of sum(weight * max(1 - sign * score, 0)^2) + |w|^2 / 2; w ends with the bias, which is free.

    Newton's method: the Hessian is that of the rows inside the margin, systems
    are solved by conjugate gradients, and steps go to the minimum along them.
    Columns that these rows lack meet only the penalty.  The step that can gain
    no more than ``least`` of the objective is the last.
    """
    d = len(idf)
    score = lambda p: x.times(p[:d] * idf) + p[d]
    s = score(w)
    for _ in range(most):
        gap = 1 - sign * s
        inside = gap > 0
        (near, cols), h = x.only(inside, idf), 2 * weight[inside]
        k = len(cols)
        back = lambda r: np.append(near.back(r, k), r.sum())  # noqa: B023, E731
        g = back(-h * gap[inside] * sign[inside])
        g[:k] += w[cols]
        value = float((weight[inside] * gap[inside] ** 2).sum() + w[:d] @ w[:d] / 2)
        scale = np.append(1 + near.back(h, k, True), max(h.sum(), 1e-9))
        step, r = np.zeros(k + 1), -g
        z = r / scale
        q, rz, first = z.copy(), float(r @ z), float(r @ z)
        for _ in range(60):
            if rz <= FORCE * first or rz == 0:
                break
            hq = back(h * (near.times(q[:k]) + q[k]))
            hq[:k] += q[:k]
            a = rz / max(float(q @ hq), 1e-300)
            step += a * q
            r -= a * hq
            z = r / scale
            rz, old = float(r @ z), rz
            q *= rz / old
            q += z
        p = -w
        p[cols], p[d] = step[:k], step[k]
        gain = (float(w[:d] @ w[:d]) - float(w[cols] @ w[cols]) - float(g @ step)) / 2
        if gain <= 0:
            return w
        along, pp, wp, t = score(p), float(p[:d] @ p[:d]), float(w[:d] @ p[:d]), 1.0
        lo, hi = 0.0, np.inf
        for _ in range(30):  # the slope along the step rises, so its zero is unique
            gap = 1 - sign * (s + t * along)
            i = gap > 0
            slope = wp + t * pp - 2 * float((weight[i] * gap[i] * sign[i] * along[i]).sum())
            lo, hi = (t, hi) if slope < 0 else (lo, t)
            if abs(slope) <= 1e-6 * gain:
                break
            t -= slope / max(pp + 2 * float((weight[i] * along[i] ** 2).sum()), 1e-300)
            if not lo < t < hi:
                t = (lo + hi) / 2 if np.isfinite(hi) else 2 * lo
        w = w + t * p
        s = s + t * along
        if gain <= least * value:
            return w
    return w


def fitted(blocks: Callable[[], Iterator[Rows]], idf: np.ndarray, sets: list[tuple[frozenset, list[float]]], c: float) -> list[list[np.ndarray]]:
    """Weights (and a bias) of a machine for each set of labels that are its positives and each weight of a positive; negatives weigh 1."""
    d = len(idf)
    masks: list[dict[int, np.ndarray]] = [{} for _ in sets]
    w = [[np.zeros(d + 1) for _ in weights] for _, weights in sets]
    open_ = {(i, j) for i, (_, weights) in enumerate(sets) for j in range(len(weights))}
    turn = 0
    while open_:
        left, total = dict.fromkeys(open_, 0.0), dict.fromkeys(open_, 0.0)
        room = dict.fromkeys(range(len(sets)), 0)
        scaled = {(i, j): (w[i][j][:d] * idf).astype(np.float32) for i, j in open_} if turn else {}
        for b, rows in enumerate(blocks()):
            wide = replace(rows, cols=rows.cols.astype(np.intp)) if turn else rows  # once for all machines
            for i in {i for i, _ in open_}:
                pos = np.isin(rows.y, list(sets[i][0]))
                if turn:
                    held = masks[i][b] if turn > 1 else np.zeros(len(pos), bool)
                    mask = held.copy()
                    for j in (j for a, j in open_ if a == i):
                        gap = 1 - np.where(pos, 1, -1) * (wide.times(scaled[i, j]) + w[i][j][d])
                        loss = c * np.where(pos, sets[i][1][j], 1.0) * np.maximum(gap, 0) ** 2
                        left[i, j] += float(loss[~held].sum())
                        total[i, j] += float(loss.sum())
                        mask |= gap > 0
                else:
                    mask = pos | (np.arange(len(pos)) % START == 0)
                masks[i][b] = mask
                room[i] += int(np.diff(rows.ptr)[mask].sum()) * 8
        if turn > 1:
            open_ = {(i, j) for i, j in open_ if left[i, j] > LEAST * (total[i, j] + w[i][j][:d] @ w[i][j][:d] / 2)}
        wait = sorted({i for i, _ in open_})
        while wait:  # as many sets in a reading as fit together
            now = [i for n, i in enumerate(wait) if not n or sum(room[k] for k in wait[: n + 1]) <= KEPT]
            wait = wait[len(now) :]
            near = {i: _Held() for i in now}
            for b, rows in enumerate(blocks()):
                for i in now:
                    near[i].add(rows.of(masks[i][b]))
            for i in now:
                x = near.pop(i)
                pos = np.concatenate([np.isin(r.y, list(sets[i][0])) for r in x.all()])
                for j in sorted(j for a, j in open_ if a == i):
                    weight = c * np.where(pos, sets[i][1][j], 1.0 if turn else float(START))
                    start = w[i][j - 1] if turn < 2 and j else w[i][j]
                    w[i][j] = solve(x, np.where(pos, 1, -1), weight, idf, start, LEAST if turn else FORCE)
        turn += 1
    return w


def _kept(path: str) -> Callable[[], Iterator[Rows]]:
    """Reads the blocks of a table again and again; files of the first KEPT bytes stay in memory."""
    held: dict[str, list[Rows]] = {}

    def run() -> Iterator[Rows]:
        for f in _files(path):
            if f[1] in held:
                yield from held[f[1]]
                continue
            keep = sum(r.size() for rows in held.values() for r in rows) < KEPT
            rows = []
            for r, _ in _blocks([f]):
                if keep:
                    rows.append(r)
                yield r
            if keep:
                held[f[1]] = rows

    return run


@dataclass
class Merged:
    predictions: DataFrame
    classes: dict[str, int]


def merged_machines(train: DataFrame, dev: DataFrame, variants: dict[str, dict[str, str]], label: str = "label_name", text: str = "text", key: str = "clause_id", value: float = 1.0, min_df: int = 3, bigrams: bool = True) -> Merged:
    """Machines with squared hinge loss on all labelled rows of train, and (variant, key, true, pred) of all of dev, for each map of labels.

    The objective is that of linear.fit_svm.  A machine whose positives and
    weights are the same in two variants is fitted once.  Ties go to the first
    label; labels that train lacks are never predicted.
    """
    spark = train.sparkSession
    train, dev = (t.where(F.col(label).isNotNull()) for t in (train, dev))
    counts = {r[0]: r[1] for r in train.groupBy(label).agg(F.count(F.lit(1))).collect()}
    labels, n = sorted(counts), sum(counts.values())
    known = F.broadcast(spark.createDataFrame([(i, t) for i, t in enumerate(labels)], f"y int, `{label}` string"))
    words = vocabulary(train, text, n, min_df, bigrams)
    rows = encoded(train.join(known, label).select("y", text), text, words, n, bigrams)
    held_out = encoded(dev.join(known, label, "left").select(F.col(key).alias("_key"), F.col(label).alias("_true"), "y", text), text, words, n, bigrams)
    uses: dict[frozenset, dict[float, list[tuple[int, int]]]] = {}
    classes = {}
    for v, (variant, merges) in enumerate(variants.items()):
        names = sorted({merges.get(t, t) for t in labels})
        classes[variant] = len(names)
        for at, name in enumerate(names):
            own = frozenset(i for i, t in enumerate(labels) if merges.get(t, t) == name)
            weight = n / (len(names) * sum(counts[labels[i]] for i in own))
            uses.setdefault(own, {}).setdefault(weight, []).append((v, at))
    # dealt out by their rows, there and back
    order = sorted(uses, key=lambda s: (-sum(counts[labels[i]] for i in s), sorted(s)))
    width = max(1, min(spark.sparkContext.defaultParallelism, len(order)))
    groups = [[s for k, s in enumerate(order) if (k % width if k // width % 2 == 0 else width - 1 - k % width) == g] for g in range(width)]
    paths, kind = (words._corpusloom_path, rows._corpusloom_path, held_out._corpusloom_path), dev.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in (int(i) for b in batches for i in b.column(0).to_pylist()):
            if not groups[g]:
                continue
            idf = np.log((1.0 + n) / (1.0 + _space(paths[0])[1])) + 1.0
            d, sets = len(idf), [(s, sorted(uses[s])) for s in groups[g]]
            w = fitted(_kept(paths[1]), idf, sets, value)
            scaled = [[(one[:d] * idf).astype(np.float32) for one in ws] for ws in w]
            for x, b in _blocks(_files(paths[2])):
                best = {}
                for (s, weights), ws, vs in zip(sets, w, scaled):
                    for weight, one, v32 in zip(weights, ws, vs):
                        score = x.times(v32) + one[d]
                        for v, at in uses[s][weight]:
                            old = best.setdefault(v, (np.full(len(score), -np.inf), np.zeros(len(score), np.int32)))
                            better = (score > old[0]) | ((score == old[0]) & (at < old[1]))
                            best[v] = (np.where(better, score, old[0]), np.where(better, at, old[1]).astype(np.int32))
                for v, (score, at) in best.items():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, np.int32)), b.column("_key").flatten(), b.column("_true").flatten(), pa.array(score), pa.array(-at)], names=["v", "_key", "_true", "score", "at"])

    scored = materialize(spark.range(0, width, 1, width).mapInArrow(run, f"v int, _key {kind}, _true string, score double, at int"), "scores")
    best = scored.groupBy("v", "_key", "_true").agg(F.max(F.struct("score", "at")).alias("b"))
    names = [(v, variant, -at, t) for v, (variant, merges) in enumerate(variants.items()) for at, t in enumerate(sorted({merges.get(t, t) for t in labels}))]
    true = [(v, a, b) for v, merges in enumerate(variants.values()) for a, b in merges.items()]
    pred = best.select("v", "_key", "_true", F.col("b.at").alias("at")).join(F.broadcast(spark.createDataFrame(names, "v int, variant string, at int, pred string")), ["v", "at"])
    pred = pred.join(F.broadcast(spark.createDataFrame(true, "v int, _true string, _to string")), ["v", "_true"], "left")
    out = materialize(pred.select("variant", F.col("_key").alias(key), F.coalesce("_to", "_true").alias("true"), "pred"), "predictions")
    release(words, rows, held_out, scored)
    return Merged(out, classes)
