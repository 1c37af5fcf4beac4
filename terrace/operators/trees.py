"""Extremely randomised trees and softmax boosting, grown level by level: one aggregation over all rows a level, for all trees at once.

Tasks walk their rows down the trees so far and add up what the next splits need; the sums of all tasks meet by node. Extra trees draw a
few features and a place for each within the node's range, and take the best of these draws: no places are searched. A pass brings
the class counts and the ranges of both sides of each draw, so the children know theirs. Boosting grows a tree for each class a round on
the gradients of the softmax loss, whose sums by bin of each feature (a histogram a node) say where to split. Trees are small and go to
every task; rows are never gathered. A wide level is grown in slices of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.scratch import materialize

#: Bytes of sums that a task holds, and rounds of boosting after which margins are written down.
SUMS_BYTES, WRITTEN_ROUNDS = 32 << 20, 10


class Tree:
    """Nodes in the order in which they were made; feature -1 is a leaf. A row goes left if its feature is below the threshold."""

    def __init__(self) -> None:
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def add(self, value) -> int:
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.left.append(-1)
        self.right.append(-1)
        self.value.append(value)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, threshold: float, left, right) -> tuple[int, int]:
        self.feature[node], self.threshold[node] = feature, threshold
        self.left[node], self.right[node] = self.add(left), self.add(right)
        return self.left[node], self.right[node]

    def packed(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(v) for v in (self.feature, self.threshold, self.left, self.right, self.value))


def reached(packed: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The node of a tree where each row ends."""
    feature, threshold, left, right, _ = packed
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        f = feature[at[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        at[rows] = np.where(x[rows, f] < threshold[at[rows]], left[at[rows]], right[at[rows]])
    return at


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class TreesModel(Model):
    """Fitted trees. transform adds probability (a vector by label) and prediction; `boosted`: values are margins that a softmax takes, else shares that are averaged."""

    def __init__(self, trees: list[tuple[int, Tree]], classes: int, base: np.ndarray | None, features: str, width: int) -> None:
        super().__init__()
        self.trees, self.classes, self.base, self.features, self.width = trees, classes, base, features, width

    @property
    def boosted(self) -> bool:
        return self.base is not None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast([(c, t.packed()) for c, t in self.trees])
        classes, base, width = self.classes, self.base, self.width

        @F.arrow_udf("array<double>")
        def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                x = _matrix(batch, width)
                p = probabilities(shared.value, x, classes, base)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * classes, pa.int32()), pa.array(p.ravel()))

        made = dataset.withColumn("probability", probability(vector_to_array(F.col(self.features))))
        best = (F.array_position("probability", F.array_max("probability")) - 1).cast("double")
        return made.withColumn("prediction", best).withColumn("probability", array_to_vector("probability"))


def probabilities(trees: list[tuple[int, tuple]], x: np.ndarray, classes: int, base: np.ndarray | None) -> np.ndarray:
    if base is None:
        p = np.zeros((len(x), classes))
        for _, t in trees:
            p += t[4][reached(t, x)]
        return p / max(len(trees), 1)
    return softmax(margins(trees, x, np.tile(base, (len(x), 1))))


def margins(trees: list[tuple[int, tuple]], x: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = start.copy()
    for c, t in trees:
        out[:, c] += t[4][reached(t, x)]
    return out


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _labelled(dataset: DataFrame, features: str, label: str) -> tuple[DataFrame, int, int]:
    """x (an array), y of rows with a label, written down; how many features and classes (labels count from 0)."""
    own = materialize(dataset.where(F.col(label).isNotNull()).select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("int").alias("y")), "points")
    low, high, least, most = own.agg(F.min("y"), F.max("y"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if high is None:
        raise ValueError("there are no labelled rows")
    if low < 0 or least != most:
        raise ValueError("labels count from 0, and all rows have as many features")
    return own, most, high + 1


class ExtraTrees(Estimator):
    """candidates: features drawn a node (None: the root of their number). Every tree sees all rows. Draws depend on the seed, the tree and the node alone."""

    def __init__(self, *, features: str = "features", label: str = "label", trees: int = 100, max_depth: int = 12, least_split: int = 2, candidates: int | None = None, seed: int = 42) -> None:
        super().__init__()
        self.features, self.label, self.trees, self.max_depth, self.least_split, self.candidates, self.seed = features, label, trees, max_depth, least_split, candidates, seed

    def draw(self, tree: int, node: int, low: np.ndarray, high: np.ndarray) -> tuple[list[int], list[float]]:
        """Features of a node that vary there, and a place in each one's range: above the lowest value, at most the highest."""
        rng = np.random.default_rng((self.seed, tree, node))
        varied = np.flatnonzero(low < high)
        many = min(self.candidates or max(1, round(math.sqrt(len(low)))), len(varied))
        chosen = rng.choice(varied, many, replace=False)
        # 1 less a number from 0 to below 1: never the lowest value, so neither side is empty.
        return chosen.tolist(), [float(max(low[f] + (1 - rng.random()) * (high[f] - low[f]), np.nextafter(low[f], np.inf))) for f in chosen]

    def goes_on(self, counts: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> bool:
        return depth < self.max_depth and counts.sum() >= self.least_split and np.count_nonzero(counts) > 1 and bool((low < high).any())

    def _fit(self, dataset: DataFrame) -> TreesModel:
        points, width, classes = _labelled(dataset, self.features, self.label)
        first = points.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[f(F.col("x")[k]).alias(f"{s}{k}") for k in range(width) for s, f in (("l", F.min), ("h", F.max))]).collect()
        counts = np.zeros(classes)
        for r in first:
            counts[r["y"]] = r["n"]
        low, high = np.array([min(r[f"l{k}"] for r in first) for k in range(width)]), np.array([max(r[f"h{k}"] for r in first) for k in range(width)])
        trees = [Tree() for _ in range(self.trees)]
        level = [(t, tree.add(counts / counts.sum()), counts, low, high) for t, tree in enumerate(trees)]
        for depth in range(self.max_depth):
            level = [node for node in level if self.goes_on(*node[2:], depth)]
            if not level:
                break
            drawn = [self.draw(t, node, lo, hi) for t, node, _, lo, hi in level]
            most = max(len(f) for f, _ in drawn)
            step = max(1, SUMS_BYTES // (16 * most * (classes + 2 * width)))
            below = []
            for a in range(0, len(level), step):
                below += self._split(points, trees, level[a : a + step], drawn[a : a + step], most, classes, width)
            level = below
        return TreesModel([(0, t) for t in trees], classes, None, self.features, width)

    def _split(self, points: DataFrame, trees: list[Tree], nodes: list[tuple], drawn: list[tuple], most: int, classes: int, width: int) -> list[tuple]:
        """The children of these nodes, by the draw that leaves the least impurity."""
        feature, place = np.full((len(nodes), most), -1), np.zeros((len(nodes), most))
        for k, (f, p) in enumerate(drawn):
            feature[k, : len(f)], place[k, : len(p)] = f, p
        slots = {}
        for k, (t, node, *_) in enumerate(nodes):
            slots.setdefault(t, np.full(len(trees[t].feature), -1))[node] = k
        packed = {t: trees[t].packed() for t in slots}

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = len(nodes) * most * 2
            count, low, high = np.zeros((size, classes)), np.full((size, width), np.inf), np.full((size, width), -np.inf)
            for b in batches:
                x, y = _matrix(b.column(0), width), b.column(1).to_numpy()
                for t, slot in slots.items():
                    at = slot[reached(packed[t], x)]
                    rows = np.flatnonzero(at >= 0)
                    for k in range(most):
                        own = rows[feature[at[rows], k] >= 0]
                        if not len(own):
                            continue
                        which = at[own]
                        part = (which * most + k) * 2 + (x[own, feature[which, k]] >= place[which, k])
                        count += np.bincount(part * classes + y[own], minlength=size * classes).reshape(size, classes)
                        order = np.argsort(part, kind="stable")
                        parts, begin = np.unique(part[order], return_index=True)
                        sorted_x = x[own[order]]
                        low[parts] = np.minimum(low[parts], np.minimum.reduceat(sorted_x, begin))
                        high[parts] = np.maximum(high[parts], np.maximum.reduceat(sorted_x, begin))
            kept = np.flatnonzero(count.any(axis=1))
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * m.shape[1], pa.int32()), pa.array(m[kept].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(kept), lists(count), lists(low), lists(high)], names=["part", "n", "l", "h"])

        found = points.mapInArrow(sums, "part long, n array<double>, l array<double>, h array<double>").groupBy("part")
        every = found.agg(*[F.sum(F.col("n")[k]) for k in range(classes)], *[f(F.col(s)[k]) for s, f in (("l", F.min), ("h", F.max)) for k in range(width)]).collect()
        sides = {r[0]: np.array(r[1:]) for r in every}
        below = []
        for k, (t, node, counts, _, _) in enumerate(nodes):
            best = None
            for j, (f, p) in enumerate(zip(*drawn[k], strict=True)):
                left, right = (sides.get((k * most + j) * 2 + s) for s in (0, 1))
                if left is None or right is None:
                    continue
                impurity = sum(n.sum() - (n**2).sum() / n.sum() for n in (left[:classes], right[:classes]))
                if best is None or impurity < best[0]:
                    best = impurity, f, p, left, right
            if best is None:
                continue
            _, f, p, left, right = best
            share = lambda s: s[:classes] / s[:classes].sum()
            made = trees[t].split(node, f, p, share(left), share(right))
            below += [(t, child, s[:classes], s[classes : classes + width], s[classes + width :]) for child, s in zip(made, (left, right), strict=True)]
        return below


class SoftmaxBoosting(Estimator):
    """rounds of a tree for each class, on the gradients of the softmax loss, from the classes' shares on. bins: of each feature, by its quantiles.

    model.losses: the mean log loss of the rows before each round. Leaves are -rate * G / (H + smoothing); a side has a hessian of least_weight.
    """

    def __init__(self, *, features: str = "features", label: str = "label", rounds: int = 20, max_depth: int = 3, rate: float = 0.3, bins: int = 32, smoothing: float = 1.0, least_weight: float = 1e-3) -> None:
        super().__init__()
        if not 2 <= bins <= 256:
            raise ValueError("bins are 2 to 256")
        self.features, self.label, self.rounds, self.max_depth, self.rate, self.bins, self.smoothing, self.least_weight = features, label, rounds, max_depth, rate, bins, smoothing, least_weight

    def _fit(self, dataset: DataFrame) -> TreesModel:
        points, width, classes = _labelled(dataset, self.features, self.label)
        shares = [k / self.bins for k in range(1, self.bins)]
        quantiles = points.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.col("x")[k], shares, 10_000).alias(f"q{k}") for k in range(width)]).first()
        edges = [np.unique(np.array(quantiles[f"q{k}"], float)) for k in range(width)]
        counts = {r["y"]: r["count"] for r in points.groupBy("y").count().collect()}
        base = np.log(np.array([max(counts.get(c, 0) / quantiles["n"], 1e-15) for c in range(classes)]))
        rows = points.select("x", "y", F.array(*map(F.lit, base.tolist())).alias("m"))
        trees: list[tuple[int, Tree]] = []
        losses, written = [], 0
        for r in range(self.rounds):
            recent = trees[written:]
            if r and r % WRITTEN_ROUNDS == 0:
                rows, written, recent = materialize(self._moved(rows, recent, width, classes), f"margins-{r}"), len(trees), []
            grown, loss = self._round(rows, recent, edges, width, classes, quantiles["n"])
            losses.append(loss)
            trees += grown
        model = TreesModel(trees, classes, base, self.features, width)
        model.losses = losses
        return model

    def _moved(self, rows: DataFrame, recent: list[tuple[int, Tree]], width: int, classes: int) -> DataFrame:
        packed = [(c, t.packed()) for c, t in recent]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = margins(packed, _matrix(b.column(0), width), _matrix(b.column(2), classes))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * classes, pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["x", "y", "m"])

        return rows.mapInArrow(run, "x array<double>, y int, m array<double>")

    def _round(self, rows: DataFrame, recent: list[tuple[int, Tree]], edges: list[np.ndarray], width: int, classes: int, many: int) -> tuple[list[tuple[int, Tree]], float]:
        grown = [(c, Tree()) for c in range(classes)]
        for _, t in grown:
            t.add(0.0)
        level, loss = [(c, 0) for c in range(classes)], 0.0
        for depth in range(self.max_depth):
            below = []
            step = max(1, SUMS_BYTES // (16 * width * self.bins))
            for a in range(0, len(level), step):
                for s in self._splits(rows, recent, grown, level[a : a + step], edges, width, classes):
                    if s["slot"] < 0:
                        loss = s["gl"] / many
                        continue
                    c, node = level[a + s["slot"]]
                    value = lambda g, h: -self.rate * g / (h + self.smoothing)
                    if s["feature"] < 0:
                        grown[c][1].value[node] = value(s["g"], s["h"])
                        continue
                    # A row goes left if it is at most the bin's upper edge.
                    place = float(np.nextafter(edges[s["feature"]][s["bin"]], np.inf))
                    made = grown[c][1].split(node, s["feature"], place, value(s["gl"], s["hl"]), value(s["g"] - s["gl"], s["h"] - s["hl"]))
                    below += [(c, child) for child in made]
            level = sorted(below)
            if not level:
                break
        return grown, loss

    def _splits(self, rows: DataFrame, recent: list[tuple[int, Tree]], grown: list[tuple[int, Tree]], level: list[tuple[int, int]], edges: list[np.ndarray], width: int, classes: int) -> list:
        """slot, feature (-1: none is worth it), bin, gl, hl, g, h of each node of the level, and a row of slot -1 whose gl is the sum of losses."""
        bins, smoothing, least, names = self.bins, self.smoothing, self.least_weight, ["slot", "feature"]
        before, now = [(c, t.packed()) for c, t in recent], {c: grown[c][1].packed() for c in {c for c, _ in level}}
        slots = {c: np.full(len(grown[c][1].feature), -1) for c in now}
        for k, (c, node) in enumerate(level):
            slots[c][node] = k

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g_sums, h_sums, loss = np.zeros((len(level), width, bins)), np.zeros((len(level), width, bins)), 0.0
            for b in batches:
                x, y = _matrix(b.column(0), width), b.column(1).to_numpy()
                p = softmax(margins(before, x, _matrix(b.column(2), classes)))
                loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
                binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
                for c, tree in now.items():
                    at = slots[c][reached(tree, x)]
                    own = np.flatnonzero(at >= 0)
                    g, h = p[own, c] - (y[own] == c), np.maximum(p[own, c] * (1 - p[own, c]), 1e-16)
                    for f in range(width):
                        where = at[own] * bins + binned[own, f]
                        g_sums[:, f] += np.bincount(where, g, len(level) * bins).reshape(-1, bins)
                        h_sums[:, f] += np.bincount(where, h, len(level) * bins).reshape(-1, bins)
            slot, feature = np.nonzero(h_sums.any(axis=2))
            lists = lambda s: pa.ListArray.from_arrays(pa.array(np.arange(len(slot) + 2) * bins, pa.int32()), pa.array(s))
            told = np.zeros(bins)
            told[0] = loss
            yield pa.RecordBatch.from_arrays([pa.array([*slot, -1], pa.int64()), pa.array([*feature, -1], pa.int64()), lists(np.concatenate([g_sums[slot, feature].ravel(), told])), lists(np.concatenate([h_sums[slot, feature].ravel(), np.zeros(bins)]))], names=["slot", "feature", "g", "h"])

        def best(pdf: pd.DataFrame) -> pd.DataFrame:
            slot = int(pdf["slot"].iloc[0])
            pdf = pdf.sort_values("feature")
            g, h = (pdf[[f"{s}{k}" for k in range(bins)]].to_numpy() for s in "gh")
            whole = g[0].sum(), h[0].sum()
            if slot < 0:
                return pd.DataFrame([(slot, -1, -1, whole[0], 0.0, 0.0, 0.0)], columns=columns)
            gl, hl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
            score = lambda a, b: a * a / (b + smoothing)
            gain = score(gl, hl) + score(whole[0] - gl, whole[1] - hl) - score(*whole)
            gain[(hl < least) | (whole[1] - hl < least)] = -np.inf
            k, at = np.unravel_index(np.argmax(gain), gain.shape)
            if not gain[k, at] > 1e-9:
                return pd.DataFrame([(slot, -1, -1, 0.0, 0.0, *whole)], columns=columns)
            return pd.DataFrame([(slot, int(pdf["feature"].iloc[k]), int(at), gl[k, at], hl[k, at], *whole)], columns=columns)

        columns = ["slot", "feature", "bin", "gl", "hl", "g", "h"]
        found = rows.mapInArrow(sums, "slot long, feature long, g array<double>, h array<double>").groupBy(*names)
        total: list[Column] = [F.sum(F.col(s)[k]).alias(f"{s}{k}") for s in "gh" for k in range(bins)]
        return found.agg(*total).groupBy("slot").applyInPandas(best, "slot long, feature long, bin long, gl double, hl double, g double, h double").collect()
