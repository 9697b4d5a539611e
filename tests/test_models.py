"""Linear models from sums, scorers and tree models against plain versions."""
import json
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from larder.operators import gram, scorers, trees


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        a, b, c = rng.random(), rng.choice([0.0, 1.0, 2.0]), rng.choice([0.0, 1.0])
        rows.append((i, a, b, c, None if i % 50 == 7 else a * 3, 10 * a + 4 * b * c + rng.random()))
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, y double").repartition(4)


def columns(df, names):
    rows = df.orderBy("row_id").select(*names).collect()
    return np.array([[np.nan if v is None else v for v in r] for r in rows])


# --- sums

def test_moments_and_ridge(frame):
    names = ["a", "b", "c", "d"]
    m = gram.moments(frame, {n: F.col(n) for n in names}, F.col("y"))
    x, y = np.nan_to_num(columns(frame, names)), columns(frame, ["y"])[:, 0]
    e = np.column_stack([np.ones(len(x)), x, y])
    assert np.allclose(m.sums, e.T @ e) and m.n == 600
    for feats in (["a"], ["b", "d"], names):
        at = [names.index(f) for f in feats]
        xc, yc = x[:, at] - x[:, at].mean(0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(len(at)), xc.T @ yc)
        fit = gram.ridge(m, feats, alpha=2.0)
        assert np.allclose(fit.weights, w) and np.isclose(fit.intercept, y.mean() - w @ x[:, at].mean(0))


def test_descent_never_rises_and_nears_the_ridge_objective(frame):
    names = ["a", "b", "c"]
    m = gram.moments(frame, {n: F.col(n) for n in names}, F.col("y"))
    losses = [loss for loss, _ in gram.descent(m, names, 4000)]
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:]))
    xx, xy, yy, _, _ = m.centred(names)
    w = np.array(gram.ridge(m, names).weights)
    assert losses[-1] == pytest.approx((yy - 2 * xy @ w + w @ (xx + np.eye(3)) @ w) / m.n / 2)


def test_no_rows_are_refused(frame):
    m = gram.moments(frame.limit(0), {"a": F.col("a")}, F.col("y"))
    with pytest.raises(ValueError, match="no training rows"):
        gram.ridge(m, ["a"])
    with pytest.raises(ValueError, match="no training rows"):
        trees.gbt_fit(frame.limit(0), "row_id", ["a"], "y", rounds=1)


# --- scorers

def test_three_carriers_keep_rows_and_columns(spark, frame, tmp_path):
    fit = gram.LinearFit(["a", "d"], [2.0, -1.0], 0.5)
    ranges = {"a": (0.0, 1.0), "d": (0.0, 2.0), "y": (-5.0, 5.0)}
    path = str(tmp_path / "linear")
    scorers.save_scorer(spark, path, "linear", "ridge", "7", fit.features,
                        {"weights": fit.weights, "intercept": fit.intercept, "ranges": ranges, "target": "y"})
    linear = scorers.load_scorer(spark, path)
    x = columns(frame, ["a", "d"])
    want = np.maximum(0, (0.5 + 2 * x[:, 0] - x[:, 1] / 2) * 10 - 5)
    got = columns(linear.transform(frame), ["predicted"])[:, 0]
    assert np.allclose(got, want, equal_nan=True) and np.isnan(got).sum() == 12  # a missing input: no prediction
    assert (linear.name, linear.version, linear.is_mock) == ("ridge", "7", False)

    stages = [VectorAssembler(inputCols=["_in_a", "_in_d"], outputCol="features"), LinearRegression(labelCol="y", maxIter=20)]
    inputs = frame.withColumns({f"_in_{c}": F.coalesce(c, F.lit(0.0)) for c in ("a", "d")})
    model = Pipeline(stages=stages).fit(inputs)
    model.write().overwrite().save(str(tmp_path / "stored/model"))
    scorers.save_scorer(spark, str(tmp_path / "stored"), "pipeline", "ols", "1", ["a", "d"], is_mock=True)
    stored = scorers.load_scorer(spark, str(tmp_path / "stored"))
    out = stored.transform(frame, "units")
    assert out.columns == [*frame.columns, "units"] and stored.is_mock
    got, want = columns(out, ["units"])[:, 0], columns(model.transform(inputs), ["prediction"])[:, 0]
    assert np.allclose(got[~np.isnan(got)], want[~np.isnan(got)]) and np.isnan(got).sum() == 12

    scorers.save_scorer(spark, str(tmp_path / "own"), "sum", "sum", "1", ["a", "d"], {"times": 3})
    own = scorers.load_scorer(spark, str(tmp_path / "own"), {"sum": lambda payload: lambda m: json.loads(payload)["times"] * m.sum(axis=1)})
    out = own.transform(frame, "total")
    assert out.columns == [*frame.columns, "total"]
    assert np.allclose(columns(out, ["total"])[:, 0], 3 * x.sum(axis=1), equal_nan=True)
    with pytest.raises(ValueError, match="unknown model carrier"):
        scorers.load_scorer(spark, str(tmp_path / "own"))


# --- trees

def plain_trees(bins, y, pred, numbers, s):
    """Trees grown node by node with loops over rows, features and cuts."""
    out = []
    for number in numbers:
        tree, waiting = trees.Tree(), [0]
        while waiting:
            node = waiting.pop(0)
            w = s.weights(s.seed, number, KEYS)
            rest = y - np.rint(pred * trees.UNIT).astype(np.int64)
            rows = [i for i in range(len(y)) if tree.nodes(bins[i:i + 1])[0] == node and w[i]]
            n, total = sum(int(w[i]) for i in rows), sum(int(w[i] * rest[i]) for i in rows)
            if node == 0:
                tree.value[0] = total / (n + s.penalty) / trees.UNIT
            best = None
            for f in s.columns(number, node).tolist():
                for cut in sorted({int(bins[i, f]) for i in rows}):
                    nl = sum(int(w[i]) for i in rows if bins[i, f] <= cut)
                    sl = sum(int(w[i] * rest[i]) for i in rows if bins[i, f] <= cut)
                    if nl < n:
                        def part(a, b):
                            return float(a) * float(a) / (b + s.penalty)
                        gain = part(sl, nl) + part(total - sl, n - nl) - part(total, n)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, f, cut, sl, nl)
            if best:
                _, f, cut, sl, nl = best
                sides = ((sl, nl), (total - sl, n - nl))
                left = tree.split(node, f, cut, tuple(a / (k + s.penalty) / trees.UNIT for a, k in sides))
                if tree.depth[left] < s.max_depth:
                    waiting += [left + i for i, (_, k) in enumerate(sides) if k > 1]
        out.append(tree)
    return out


KEYS = None


@pytest.mark.parametrize("kind", ["share", "bootstrap"])
def test_grown_trees_equal_plain_ones(spark, frame, kind):
    global KEYS
    feats = ["a", "b", "c", "d"]
    small = frame.where("row_id < 150")
    cuts = trees.cut_points(small, feats, 6)
    rows = trees.binned(small, "row_id", feats, cuts, "y", (0.0, 25.0))
    got = sorted(rows.collect(), key=lambda r: r["key"])
    KEYS = np.array([r["key"] for r in got])
    bins = np.array([list(r["bins"]) for r in got], dtype=np.uint8)
    y, pred = np.array([r["y"] for r in got]), np.zeros(len(got))
    if kind == "share":
        s = trees.Settings(4, 6, 3, 42, trees.share(0.8), lambda t, n: trees.drawn_columns(42, t, 0, 4, 3), 1.0)
        numbers = [4]
    else:
        s = trees.Settings(4, 6, 4, 1, trees.bootstrap, lambda t, n: trees.drawn_columns(1, t, n, 4, 2), 0.0, slots=3)
        numbers = [0, 1, 2]
    grown, before = trees.grow(rows.repartition(3), numbers, [], 1.0, s)
    want = plain_trees(bins, y, pred, numbers, s)
    for number, tree in zip(numbers, want):
        assert grown[number] == tree and len(tree.feature) > 3
    assert before[1] == 150 and before[0] == pytest.approx(float(((y / trees.UNIT) ** 2).sum()))


def test_forest_does_not_depend_on_layout_or_memory_bound(frame):
    feats = ["a", "b", "c"]
    one = trees.random_forest_fit(frame, "row_id", feats, "y", trees=4, max_depth=5, slots=1024)
    two = trees.random_forest_fit(frame.repartition(7, "a"), "row_id", feats, "y", trees=4, max_depth=5, slots=5)
    assert one.description() == two.description()


def test_boosting_lowers_the_loss_and_keeps_through_storage(spark, frame, tmp_path):
    feats = ["a", "b", "c", "d"]
    model = trees.gbt_fit(frame, "row_id", feats, "y", rounds=5, rate=0.4, max_depth=3, keep=2)
    assert len(model.losses) == 6 and all(b < a for a, b in zip(model.losses, model.losses[1:]))
    again = trees.gbt_fit(frame.repartition(2), "row_id", feats, "y", rounds=5, rate=0.4, max_depth=3, keep=100)
    assert again.description() == model.description()  # neither layout nor storing in between matters
    path = str(tmp_path / "gbt")
    model.save(spark, path, "gbt", "3")
    scorer = scorers.load_scorer(spark, path, trees.BUILDERS)
    rows = scorer.transform(frame.fillna(0.0)).select("y", "predicted").collect()
    assert len(rows) == 600 and all(r["predicted"] >= 0 for r in rows)
    mean = sum(r["y"] for r in rows) / 600
    assert sum((r["y"] - r["predicted"]) ** 2 for r in rows) < 0.3 * sum((r["y"] - mean) ** 2 for r in rows)


def test_forest_learns(frame):
    model = trees.random_forest_fit(frame, "row_id", ["a", "b", "c"], "y", trees=10, max_depth=6)
    rows = model.scorer("forest").transform(frame).select("y", "predicted").collect()
    mean = sum(r["y"] for r in rows) / 600
    assert sum((r["y"] - r["predicted"]) ** 2 for r in rows) < 0.5 * sum((r["y"] - mean) ** 2 for r in rows)


def test_row_weights():
    keys = np.arange(20000)
    assert abs(trees.share(0.8)(1, 2, keys).mean() - 0.8) < 0.02
    w = trees.bootstrap(1, 2, keys)
    assert abs(w.mean() - 1) < 0.03 and abs((w == 0).mean() - 0.3679) < 0.02
    assert (trees.uniform(1, 2, keys) == trees.uniform(1, 2, keys)).all() and (trees.uniform(1, 3, keys) != trees.uniform(1, 2, keys)).any()
