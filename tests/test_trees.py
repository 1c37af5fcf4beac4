"""Extra trees and boosting against plain growth on one machine."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from terrace.operators import learning, trees
from terrace.operators.trees import ExtraTrees, SoftmaxBoosting


def _data(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    y = ((x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 2] > 0.8)).clip(0, 2)
    x[:, 4] = 3.0  # never varies
    return x, y


def _frame(spark, x, y):
    df = spark.createDataFrame([(k, *map(float, v), float(c)) for k, (v, c) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, e double, label double")
    return learning.assemble(df.repartition(4), ["a", "b", "c", "d", "e"])


def _plain_tree(how, t, x, y, classes):
    """One tree over all rows, level by level, with the same draws."""
    tree = trees.Tree()
    count = lambda rows: np.bincount(y[rows], minlength=classes).astype(float)
    rows = np.arange(len(x))
    level = [(tree.add(count(rows) / len(rows)), rows)]
    for depth in range(how.max_depth):
        below = []
        for node, rows in level:
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            if not how.goes_on(count(rows), low, high, depth):
                continue
            best = None
            for f, p in zip(*how.draw(t, node, low, high)):
                sides = rows[x[rows, f] < p], rows[x[rows, f] >= p]
                gini = sum(len(s) * (1 - ((count(s) / len(s)) ** 2).sum()) for s in sides)
                if best is None or gini < best[0] - 1e-9:
                    best = gini, f, p, sides
            made = tree.split(node, best[1], best[2], *[count(s) / len(s) for s in best[3]])
            below += list(zip(made, best[3]))
        level = below
    return tree


@pytest.mark.parametrize("small", [True, False])
def test_extra_trees_equal_plain_growth(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(trees, "SUMS_BYTES", 4_000)  # levels in slices of a few nodes
    x, y = _data()
    how = ExtraTrees(trees=3, max_depth=5, seed=7)
    model = how.fit(_frame(spark, x, y))
    want = [_plain_tree(how, t, x, y, 3) for t in range(3)]
    for (_, got), plain in zip(model.trees, want):
        assert got.feature == plain.feature and got.threshold == plain.threshold and np.allclose(got.value, plain.value)
    done = model.transform(_frame(spark, x, y)).select("id", vector_to_array("probability").alias("p"), "prediction").collect()
    p = trees.probabilities([(0, t.packed()) for t in want], x, 3, None)
    for r in done:
        assert r.p == pytest.approx(p[r.id].tolist()) and r.prediction == np.argmax(p[r.id])


def test_extra_trees_hold_out(spark):
    x, y = _data(900)
    train, test = _frame(spark, x[:600], y[:600]), _frame(spark, x[600:], y[600:])
    model = learning.build_classifier("extra_trees", trees=25, max_depth=9).fit(train)
    assert learning.score_of(model.transform(test), scoring="accuracy") >= 0.85
    table, best = learning.tune(train.drop("prediction"), "et", {"trees": [2, 6], "max_depth": [3]}, folds=2)
    assert table.count() == 2 and learning.score_of(best.transform(test)) > 0.5
    with pytest.raises(ValueError, match="no labelled rows"):
        ExtraTrees().fit(train.limit(0))
    with pytest.raises(ValueError, match="count from 0"):
        ExtraTrees().fit(train.withColumn("label", F.lit(-1.0)))
    one = ExtraTrees(trees=2).fit(train.withColumn("label", F.lit(0.0)))
    assert one.transform(test).where("prediction = 0").count() == 300


def _plain_boosting(how, x, y, classes, edges):
    base = np.log(np.bincount(y, minlength=classes) / len(y))
    m, losses = np.tile(base, (len(x), 1)), []
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    for _ in range(how.rounds):
        p = trees.softmax(m)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        for c in range(classes):
            g, h = p[:, c] - (y == c), p[:, c] * (1 - p[:, c])

            def grow(rows, depth):
                whole, best = (g[rows].sum(), h[rows].sum()), None
                for f in range(x.shape[1]):
                    for b in range(len(edges[f])):
                        left = rows[binned[rows, f] <= b]
                        gl, hl = g[left].sum(), h[left].sum()
                        if hl >= how.least_weight and whole[1] - hl >= how.least_weight:
                            s = lambda a, b: a * a / (b + how.smoothing)
                            gain = s(gl, hl) + s(whole[0] - gl, whole[1] - hl) - s(*whole)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                                best = gain, left, rows[binned[rows, f] > b]
                if depth == how.max_depth or best is None:
                    m[rows, c] -= how.rate * whole[0] / (whole[1] + how.smoothing)
                    return
                grow(best[1], depth + 1)
                grow(best[2], depth + 1)

            grow(np.arange(len(x)), 0)
    return m, losses


def test_boosting_equals_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(trees, "WRITTEN_ROUNDS", 2)
    x, y = _data(300, 4)
    how = SoftmaxBoosting(rounds=5, max_depth=2, bins=8)
    df = _frame(spark, x, y)
    model = how.fit(df)
    quantiles = df.agg(*[F.percentile_approx(c, [k / 8 for k in range(1, 8)], 10_000) for c in "abcde"]).first()
    m, losses = _plain_boosting(how, x, y, 3, [np.unique(q) for q in quantiles])
    assert model.losses == pytest.approx(losses) and all(a > b for a, b in zip(model.losses, model.losses[1:]))
    want = trees.softmax(m)
    for r in model.transform(df).select("id", vector_to_array("probability").alias("p")).collect():
        assert r.p == pytest.approx(want[r.id].tolist()) and sum(r.p) == pytest.approx(1, abs=1e-12)


def test_boosting_holds_out(spark):
    x, y = _data(900)
    model = learning.build_classifier("lightgbm", rounds=6).fit(_frame(spark, x[:600], y[:600]))
    assert learning.score_of(model.transform(_frame(spark, x[600:], y[600:])), scoring="accuracy") >= 0.85
    with pytest.raises(ValueError):
        SoftmaxBoosting(bins=1)
