"""Trees of all series at once against a plain NumPy version."""

import itertools
import math

import numpy as np
import pytest

from seriesloom.operators import histogram

KEYS = ["k", "part"]


def weight(g, n, p):
    w = -np.sign(g) * max(abs(g) - p["reg_alpha"], 0) / (n + p["reg_lambda"])
    return float(np.clip(w, -p["max_delta_step"], p["max_delta_step"])) if p["max_delta_step"] else w


def score(g, n, p):
    w = weight(g, n, p)
    return -(2 * g * w + (n + p["reg_lambda"]) * w * w + 2 * p["reg_alpha"] * abs(w))


def plain_tree(x, g, p, at=1, depth=0):
    best = None
    if depth < p["max_depth"]:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                if min(left.sum(), (~left).sum()) >= p["min_child_weight"]:
                    gain = score(g[left].sum(), left.sum(), p) + score(g[~left].sum(), (~left).sum(), p) - score(g.sum(), len(g), p)
                    if gain > p["min_split_loss"] and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, cut)
    if best is None:
        return {at: (None, None, p["learning_rate"] * weight(g.sum(), len(g), p), len(g))}
    gain, f, cut = best
    left = x[:, f] <= cut
    here = {at: (f, float(cut), None, len(g))}
    return here | plain_tree(x[left], g[left], p, 2 * at, depth + 1) | plain_tree(x[~left], g[~left], p, 2 * at + 1, depth + 1)


def plain_fit(x, y, p):
    f, trees = np.full(len(y), y.mean()), []
    for _ in range(p["n_estimators"]):
        tree = plain_tree(x, f - y, p)
        trees.append(tree)
        f = f + np.array([walk(tree, row) for row in x])
    return trees, f


def walk(tree, row):
    at = 1
    while tree[at][0] is not None:
        at = 2 * at + (row[tree[at][0]] > tree[at][1])
    return tree[at][2]


def data(seed=1, hot=600):
    rng, out = np.random.default_rng(seed), []
    for key, n in (("hot", hot), ("a", 60), ("b", 7), ("flat", 20), (None, 40), ("one", 1)):
        x = np.stack([rng.integers(0, 12, n), rng.integers(-4, 4, n), rng.integers(0, 2, n)], axis=1).astype(float)
        y = np.zeros(n) + 5 if key == "flat" else np.round(3 * (x[:, 0] > 5) + x[:, 1] * x[:, 2] + rng.normal(0, 0.5, n), 3)
        out.append((key, x, y))
    return out


def frame(spark, series, extra=()):
    rows = [(k, 1, *map(float, r), float(v)) for k, x, y in series for r, v in zip(x, y)]
    return spark.createDataFrame([*rows, *extra], "k string, part int, a double, b double, c double, y double").repartition(5)


CASES = [
    {"n_estimators": 1, "max_depth": 1},
    {"n_estimators": 2, "max_depth": 3, "learning_rate": 0.5},
    {"n_estimators": 2, "max_depth": 2, "reg_alpha": 2.0, "reg_lambda": 3.0, "max_delta_step": 0.7, "min_split_loss": 1.5, "min_child_weight": 4},
    {"n_estimators": 1, "max_depth": 0},
]


@pytest.mark.parametrize("given", CASES)
def test_trees_equal_plain_ones(spark, given):
    p, series = histogram.parameters(given), data()
    broken = [("a", 1, None, 1.0, 1.0, 9.0), ("a", 1, 1.0, float("nan"), 1.0, 9.0), ("b", 1, 1.0, 1.0, 1.0, None)]
    rows = frame(spark, series, broken)
    model = histogram.fit_trees(rows, KEYS, ["a", "b", "c"], "y", given, max_bin=64)
    nodes = {}
    for r in model.collect():
        nodes.setdefault(r["k"], {}).setdefault(r["tree"], {})[r["node"]] = r
    scored = histogram.score_trees(rows, model, KEYS, ["a", "b", "c"])
    got = {}
    for r in scored.collect():
        got.setdefault(r["k"], {})[r["a"], r["b"], r["c"]] = r["predictions"]
    for key, x, y in series:
        trees, f = plain_fit(x, y, p)
        assert nodes[key][-1][1]["value"] == pytest.approx(y.mean())
        for t, tree in enumerate(trees):
            have = nodes[key][t]
            assert sorted(have) == sorted(tree)
            for at, (feature, cut, value, cover) in tree.items():
                assert (have[at]["feature"], have[at]["cover"]) == (feature, cover)
                assert have[at]["threshold"] == cut and (value is None or have[at]["value"] == pytest.approx(value, abs=1e-9))
        for row, want in zip(x, f):
            assert got[key][tuple(row)] == pytest.approx(want, abs=1e-9)
    assert got["a"][None, 1.0, 1.0] is None


def test_bins_rows_and_refusals(spark):
    many = [("m", np.arange(5000.0)[:, None].repeat(3, 1), np.arange(5000.0))]
    rows = frame(spark, many)
    model = histogram.fit_trees(rows, KEYS, ["a"], "y", {"n_estimators": 2, "max_depth": 3, "learning_rate": 1}, max_bin=16)
    thresholds = {r[0] for r in model.select("threshold").collect()} - {None}
    assert 7 <= len(thresholds) <= 15
    out = histogram.score_trees(rows, model, KEYS, ["a"])
    assert out.selectExpr("max(abs(predictions - y))").first()[0] < 700
    assert histogram.gain_importance(model, KEYS, ["a"]).count() == 1
    other = frame(spark, [("new", np.ones((1, 3)), np.ones(1))])
    assert histogram.score_trees(other, model, KEYS, ["a"]).first()["predictions"] is None
    with pytest.raises(KeyError):
        histogram.parameters({"depth": 3})
    with pytest.raises(ValueError):
        histogram.parameters({"reg_alpha": -1})


def test_a_hot_series_sends_sums_only(spark):
    """No exchange of a level carries rows: each has a partial aggregate below it."""
    rows = frame(spark, data()).selectExpr("k", "part", "array(int(a), int(b)) AS x", "y AS g")
    cells = rows.selectExpr("k", "part", "1 AS node", "g", "posexplode(x) AS (feature, bin)").groupBy("k", "part", "node", "feature", "bin").sum("g")
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


def brute_shapley(tree_nodes, x):
    """Over all subsets of features: a known one leads the way, an unknown one splits the row by the covers."""

    def value(tree, known, at=1):
        feature, threshold, leaf, cover = tree[at]
        if feature is None:
            return leaf
        sides = (2 * at, 2 * at + 1)
        if feature in known:
            return value(tree, known, sides[int(x[feature] > threshold)])
        return sum(tree[s][3] / cover * value(tree, known, s) for s in sides)

    p, out = len(x), []
    for f in range(p):
        rest, total = [k for k in range(p) if k != f], 0.0
        for size in range(p):
            for known in itertools.combinations(rest, size):
                w = math.factorial(size) * math.factorial(p - size - 1) / math.factorial(p)
                total += w * sum(value(t, {*known, f}) - value(t, set(known)) for t in tree_nodes)
        out.append(total)
    return out, sum(value(t, set()) for t in tree_nodes)


@pytest.mark.parametrize("salts", [1, 5])
def test_attributions_are_exact(spark, salts):
    series = [s for s in data(hot=120) if s[0] != "one"]
    rows = frame(spark, series, [("a", 1, None, 1.0, 1.0, 9.0)])
    features = ["a", "b", "c"]
    model = histogram.fit_trees(rows, KEYS, features, "y", {"n_estimators": 2, "max_depth": 2, "reg_lambda": 0.5})
    trees = {}
    for r in model.collect():
        trees.setdefault(r["k"], {}).setdefault(r["tree"], {})[r["node"]] = (r["feature"], r["threshold"], r["value"], r["cover"])
    unknown = frame(spark, [("new", np.ones((2, 3)), np.ones(2))])
    scored = histogram.score_trees(rows.unionByName(unknown), model, KEYS, features).where("a IS NOT NULL")
    phi = histogram.attributions(scored, model, KEYS, [*features, "predictions"], features, salts).collect()
    assert {r["k"] for r in phi} == {s[0] for s in series}
    held, times = {}, {}
    for r in phi:
        row = (r["k"], r["a"], r["b"], r["c"])
        held.setdefault(row, {})[r["feature"]] = (r["phi"], r["predictions"], r["expected"])
        times[row] = times.get(row, 0) + 1
    assert sum(times.values()) == 3 * sum(len(y) for _, _, y in series)
    for (key, *x), parts in held.items():
        want, expected = brute_shapley(trees[key].values(), x)
        assert [parts[f][0] for f in features] == pytest.approx(want, abs=1e-9)
        _, prediction, mean = parts["a"]
        assert mean == pytest.approx(expected, abs=1e-9)
        assert sum(p for p, _, _ in parts.values()) == pytest.approx(prediction - mean, abs=1e-9)
