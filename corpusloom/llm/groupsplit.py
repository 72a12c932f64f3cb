"""Splits that keep related records together, by annealed moves and swaps of whole components."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import U, mix
from corpusloom.plans.lineage import materialize
from corpusloom.plans.skew import lookup_join

SPLITS = ("train", "dev", "calib", "test")
FRACTIONS = (0.70, 0.10, 0.10, 0.10)
#: A component larger than the rows' number divided by this is annealed on the driver; there are fewer than so many.
LARGE = 1000
#: Steps of annealing for each large component, and at most for all.
LARGE_STEPS = (200, 20_000)
#: Components annealed together.
BLOCK = 8192


def deviation(size: np.ndarray, want: np.ndarray) -> float:
    """The sum of squared differences over the wanted numbers."""
    return float((((size - want) ** 2) / (want + 1.0)).sum())


def anneal(sizes: list[int], labels: list[list[tuple[int, int]]], start: list[int], want: np.ndarray, want_label: np.ndarray, rng: random.Random, sweeps: float = 3.0) -> tuple[list[int], float]:
    """The best assignment met, and its deviation.

    sizes, labels: rows and (label, rows) of each component; want: rows wanted
    by split; want_label: by split and label.  A step moves one component to
    another split or swaps two of different splits, and is taken by the rule of
    Metropolis under a falling temperature.
    """
    k, n = len(want), len(sizes)
    split = list(start)
    size = [0.0] * k
    cell = [[0.0] * want_label.shape[1] for _ in range(k)]
    for i, s in enumerate(split):
        size[s] += sizes[i]
        for lab, m in labels[i]:
            cell[s][lab] += m
    want_, wl = want.tolist(), want_label.tolist()
    inv = [1 / (w + 1.0) for w in want_]
    inv_l = [[1 / (w + 1.0) for w in row] for row in wl]
    cost = deviation(np.array(size), want) + deviation(np.array(cell), want_label)

    def change(i: int, a: int, b: int) -> float:
        m = sizes[i]
        da, db = size[a] - want_[a], size[b] - want_[b]
        d = (m * m - 2 * m * da) * inv[a] + (m * m + 2 * m * db) * inv[b]
        for lab, m in labels[i]:
            da, db = cell[a][lab] - wl[a][lab], cell[b][lab] - wl[b][lab]
            d += (m * m - 2 * m * da) * inv_l[a][lab] + (m * m + 2 * m * db) * inv_l[b][lab]
        return d

    def put(i: int, a: int, b: int) -> None:
        size[a] -= sizes[i]
        size[b] += sizes[i]
        for lab, m in labels[i]:
            cell[a][lab] -= m
            cell[b][lab] += m
        split[i] = b

    best, best_cost, now = list(split), cost, cost
    steps = int(sweeps * n)
    heat = max(cost / max(n, 1), 1e-3)
    look = n // 8 + 1
    for step in range(steps):
        t = heat * (1 - step / steps) ** 2 + 1e-9
        i = rng.randrange(n)
        a = split[i]
        if rng.random() < 0.5 or n < 2:
            b = rng.randrange(k - 1)
            b += b >= a
            d = change(i, a, b)
            if d <= 0 or rng.random() < math.exp(-d / t):
                put(i, a, b)
                now += d
        else:
            j = rng.randrange(n)
            b = split[j]
            if a != b:
                d = change(i, a, b)
                put(i, a, b)
                d += change(j, b, a)
                if d <= 0 or rng.random() < math.exp(-d / t):
                    put(j, b, a)
                    now += d
                else:
                    put(i, b, a)
        if step % look == 0 and now < best_cost:
            best, best_cost = list(split), now
    return (list(split), now) if now <= best_cost else (best, best_cost)


def shares_left(size: np.ndarray, cell: np.ndarray, want: np.ndarray, want_label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How rows beside those placed (size by split, cell by split and label) go to the splits: in proportion to the room left."""
    left, pos = np.maximum(want - size, 0), np.maximum(want_label - cell, 0)
    share = left / max(left.sum(), 1e-12) if left.any() else want / max(want.sum(), 1e-12)
    return share, np.where(pos.sum(0) > 0, pos / np.maximum(pos.sum(0), 1e-12), share[:, None])


def anneal_large(sizes: np.ndarray, cells: np.ndarray, starts: list[list[int]], want: np.ndarray, want_label: np.ndarray, seed: int) -> list[int]:
    """Splits of the large components, the best met from all starts.

    sizes, cells: rows of each, by label too.  want and want_label are of all
    rows: the small components' rows count as they will be shared out, so that
    an assignment that they can complete costs nothing.  Steps are those of
    anneal().
    """
    k, n = len(want), len(sizes)
    rest, rest_label = want.sum() - sizes.sum(), want_label.sum(0) - cells.sum(0)

    def cost(size: np.ndarray, cell: np.ndarray) -> float:
        share, share_label = shares_left(size, cell, want, want_label)
        return deviation(size + share * rest, want) + deviation(cell + share_label * rest_label, want_label)

    best, best_cost = [], math.inf
    steps = min(LARGE_STEPS[0] * n, LARGE_STEPS[1])
    for at, start in enumerate(starts):
        rng, split = random.Random(seed * 7919 + at), np.array(start)
        size, cell = np.zeros(k), np.zeros((k, cells.shape[1]))
        np.add.at(size, split, sizes)
        np.add.at(cell, split, cells)
        now = cost(size, cell)
        if now < best_cost:
            best, best_cost = split.tolist(), now
        heat = max(now / n, 1e-3)
        for step in range(steps):
            t = heat * (1 - step / steps) ** 2 + 1e-9
            i, j = rng.randrange(n), -1
            a = int(split[i])
            if rng.random() < 0.5 or n < 2:
                b = rng.randrange(k - 1)
                b += b >= a
                m, c = sizes[i], cells[i]
            else:
                j = rng.randrange(n)
                b = int(split[j])
                if a == b:
                    continue
                m, c = sizes[i] - sizes[j], cells[i] - cells[j]
            size[a] -= m
            size[b] += m
            cell[a] -= c
            cell[b] += c
            d = cost(size, cell) - now
            if d <= 0 or rng.random() < math.exp(-d / t):
                split[i], now = b, now + d
                if j >= 0:
                    split[j] = a
                if now < best_cost:
                    best, best_cost = split.tolist(), now
            else:
                size[a] += m
                size[b] -= m
                cell[a] += c
                cell[b] -= c
    return best


def quotas(labels: list[list[tuple[int, int]]], before: dict[int, int], share_label: np.ndarray) -> np.ndarray:
    """Rows wanted by split and label in a block, in whole components.

    The components that have a label stand in one line over all blocks, and the
    j-th of them counts for the split at j times the golden ratio (modulo 1) on
    the line of the splits' shares.  Any stretch of that sequence meets the
    shares within a few components, so the blocks' quotas add up to them even
    for a label with one component a block; a share of each block's own rows
    would ask every block for the same largest split.  before: how many
    components of earlier blocks have the label.
    """
    want = np.zeros(share_label.shape)
    ends = np.cumsum(share_label, axis=0)
    at = dict(before)
    for row in labels:
        for lab, m in row:
            j = at.get(lab, 0)
            at[lab] = j + 1
            x = (j * 0.6180339887498949 + lab * 0.7548776662466927) % 1.0
            want[min(int(np.searchsorted(ends[:, lab], x * ends[-1, lab], side="right")), len(want) - 1), lab] += m
    return want


class GroupSplit:
    """A split for each row that keeps every cluster whole, and the clusters that a stored split breaks.

    rows needs ``key``, ``cluster`` (null or negative: the row is a component
    of its own), ``label`` (null is a label of its own) and ``side``, the
    stored split (null: none).  Components start at a split by their hash and
    are annealed in blocks of about 8,192, each towards its part of the wanted
    sizes and its quotas of the labels, which add up over the blocks, from
    several starts of which the best is kept.  Components of more than a
    thousandth of the rows, fewer than 1,000 in number, are annealed first, by
    size and labels, with the others' rows as what fills the room left.

    No rows give no components; a repeated key is two rows.
    """

    def __init__(self, rows: DataFrame, fractions: tuple[float, ...] = FRACTIONS, names: tuple[str, ...] = SPLITS, seed: int = 11, starts: int = 2):
        if len(fractions) != len(names) or abs(sum(fractions) - 1) > 1e-9:
            raise ValueError("fractions must match the splits and sum to 1")
        self.fractions, self.names, self.seed, self.starts = fractions, names, seed, starts
        own = (F.col("cluster").isNull()) | (F.col("cluster") < 0)
        base = rows.select("key", F.when(own, F.col("key")).otherwise(F.col("cluster")).cast("bigint").alias("unit"), own.alias("single"), F.coalesce("label", F.lit(-1)).cast("int").alias("label"), "side")
        self.rows = materialize(base.withColumn("comp", F.xxhash64("single", "unit")), "rows")

    def broken(self) -> DataFrame:
        """(cluster, split, rows, moved): clusters whose stored rows stand in two splits or more, the split assigned, and how many rows it moves."""
        stored = self.rows_split().where("cluster is not null and side is not null")
        seen = stored.groupBy("cluster").agg(
            F.min("split").alias("split"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("side") != F.col("split")).alias("moved"), F.min("side").alias("_lo"), F.max("side").alias("_hi")
        )
        return seen.where("_lo < _hi").drop("_lo", "_hi")

    def components(self) -> DataFrame:
        """(single, unit, comp, size, labels): labels is a list of (label, rows), as long as there are labels."""
        by_label = self.rows.groupBy("single", "unit", "comp", "label").agg(F.count(F.lit(1)).alias("rows"))
        return by_label.groupBy("single", "unit", "comp").agg(F.sum("rows").alias("size"), F.sort_array(F.collect_list(F.struct("label", "rows"))).alias("labels"))

    def assigned(self) -> DataFrame:
        """(single, unit, comp, size, split) of every component."""
        comps = materialize(self.components(), "components")
        totals = {r["label"]: r["rows"] for r in self.rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).collect()}
        total, count = sum(totals.values()), comps.count()
        names, fractions, seed, starts = self.names, np.array(self.fractions), self.seed, self.starts
        order = {lab: i for i, lab in enumerate(sorted(totals))}
        large = comps.where(F.col("size") * LARGE > total).collect()
        whole = fractions * total
        whole_label = np.outer(fractions, [totals[lab] for lab in sorted(totals)]) if totals else np.zeros((len(names), 0))
        large.sort(key=lambda r: (-r["size"], r["comp"]))
        placed = {}
        size, cell = np.zeros(len(names)), np.zeros(whole_label.shape)
        if large:
            sizes_, cells_ = np.array([float(r["size"]) for r in large]), np.zeros((len(large), len(order)))
            for i, r in enumerate(large):
                for lab, m in r["labels"]:
                    cells_[i, order[lab]] = m
            greedy, left = [], whole.copy()
            for m in sizes_:
                greedy.append(int(np.argmax(left / (whole + 1))))
                left[greedy[-1]] -= m
            rng = random.Random(seed)
            dealt = [rng.choices(range(len(names)), fractions.tolist(), k=len(large)) for _ in range(starts)]
            chosen = anneal_large(sizes_, cells_, [greedy, *dealt], whole, whole_label, seed)
            placed = {r["comp"]: names[s] for r, s in zip(large, chosen)}
            np.add.at(size, chosen, sizes_)
            np.add.at(cell, chosen, cells_)
        share, share_label = shares_left(size, cell, whole, whole_label)
        blocks = max(1, -(-(count - len(large)) // BLOCK))
        small = comps.where(F.col("size") * LARGE <= total).withColumn("block", F.pmod(F.xxhash64("comp", F.lit(seed)), F.lit(blocks)))
        having = small.select("block", F.explode("labels.label").alias("label")).groupBy("block", "label").agg(F.count(F.lit(1)).alias("here"))
        place = F.sum("here").over(Window.partitionBy("label").orderBy("block")) - F.col("here")
        places = having.select("block", F.struct("label", place.alias("before")).alias("x")).groupBy("block").agg(F.collect_list("x").alias("at"))

        def run(pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("comp", ignore_index=True)
            sizes = pdf["size"].astype(int).tolist()
            labels = [[(order[x["label"]], int(x["rows"])) for x in row] for row in pdf["labels"]]
            before = {order[x["label"]]: int(x["before"]) for row in at["at"] for x in row}
            want, want_label = share * sum(sizes), quotas(labels, before, share_label)
            best = None
            for k in range(starts):
                u = mix(pdf["comp"].to_numpy().view(U) ^ U(seed * 1009 + k)).astype(np.float64) / 2.0**64
                start = np.minimum(np.searchsorted(np.cumsum(share), u, side="right"), len(names) - 1).tolist()
                got = anneal(sizes, labels, start, want, want_label, random.Random(seed * 7919 + k))
                if best is None or got[1] < best[1]:
                    best = got
            return pd.DataFrame({"single": pdf["single"], "unit": pdf["unit"], "comp": pdf["comp"], "size": pdf["size"], "split": [names[s] for s in best[0]]})

        schema = "single boolean, unit bigint, comp bigint, size bigint, split string"
        out = small.groupBy("block").cogroup(places.groupBy("block")).applyInPandas(run, schema)
        if placed:
            top = self.rows.sparkSession.createDataFrame([(r["single"], r["unit"], r["comp"], r["size"], placed[r["comp"]]) for r in large], schema)
            out = out.unionByName(top)
        return materialize(out, "assigned")

    def rows_split(self, assigned: DataFrame | None = None) -> DataFrame:
        """(key, cluster, label, side, split) of every row; a null label is -1."""
        a = (assigned if assigned is not None else self.assigned()).select("comp", F.struct("single", "unit").alias("_of"), "split")
        out = lookup_join(self.rows, a, "comp").where(F.struct("single", "unit") == F.col("_of"))
        return out.select("key", F.when(~F.col("single"), F.col("unit")).alias("cluster"), "label", "side", "split")

    def report(self) -> DataFrame:
        """(split, rows, share, target, label_gap, worst_label, worst_gap) of the assignment.

        label_gap is the share of the split's rows that would have to change for
        all labels to meet the target; worst_label is the label with the largest
        gap in rows, worst_gap that gap (rows had less rows wanted).
        """
        goal = self.rows.sparkSession.createDataFrame(list(zip(self.names, map(float, self.fractions))), "split string, target double")
        cells = materialize(self.rows_split().groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows")), "cells")
        totals = cells.groupBy("label").agg(F.sum("rows").alias("of"))
        full = goal.crossJoin(F.broadcast(totals)).join(cells, ["split", "label"], "left").na.fill(0, ["rows"])
        gap = F.col("rows") - F.col("target") * F.col("of")
        by = full.withColumn("gap", gap).groupBy("split").agg(F.sum("rows").alias("rows"), F.sum(F.abs("gap")).alias("_off"), F.max(F.struct(F.abs("gap").alias("g"), F.col("label").alias("label"), F.col("gap").alias("gap"))).alias("_x"))
        whole = totals.agg(F.sum("of").alias("_all"))
        out = goal.join(by, "split", "left").na.fill(0, ["rows"]).crossJoin(F.broadcast(whole))
        return out.select(
            "split", "rows", F.round(F.try_divide("rows", "_all"), 6).alias("share"), "target", F.round(F.try_divide(F.col("_off") / 2, "rows"), 6).alias("label_gap"),
            F.col("_x.label").alias("worst_label"), F.round("_x.gap", 3).alias("worst_gap"),
        )
