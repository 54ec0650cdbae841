"""Boosted trees of all series at once, grown from histograms of gradients.

Rows are binned once by sketched edges. Each level of a tree is one aggregate, combined on the map side, of gradient sums by (series, node,
feature, bin), whatever the number of series; a series that holds a third of all rows sends as many sums as any other. What
is left per series are its nodes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.session import materialize

# User-level parameter names with what they are when left out.
DEFAULTS = {
    "n_estimators": 100,
    "max_depth": 6,
    "learning_rate": 0.3,
    "subsample": 1.0,
    "min_child_weight": 1.0,
    "min_split_loss": 0.0,
    "reg_lambda": 1.0,
    "reg_alpha": 0.0,
    "max_delta_step": 0.0,
}
#: Trees whose nodes are joined to a row at a time when it is scored.
TREES_AT_A_TIME = 16


def parameters(given: dict) -> dict:
    """Named parameters over the defaults; a prefix up to ``__`` is dropped."""
    out = dict(DEFAULTS)
    for name, value in given.items():
        name = name.split("__")[-1]
        if name not in DEFAULTS:
            raise KeyError(f"unknown boosted-tree parameter {name!r}")
        out[name] = type(DEFAULTS[name])(value)
    if out["n_estimators"] < 1 or not 0 <= out["max_depth"] <= 16 or not 0 < out["subsample"] <= 1:
        raise ValueError(f"out of range: {out}")
    if min(out[n] for n in ("learning_rate", "min_child_weight", "min_split_loss", "reg_lambda", "reg_alpha", "max_delta_step")) < 0:
        raise ValueError(f"negative: {out}")
    return out


def leaf_weight(g: Column, n: Column, p: dict) -> Column:
    """The best step of a node with gradient sum ``g`` and ``n`` rows: shrunk by reg_alpha, damped by reg_lambda, cut at max_delta_step."""
    shrunk = F.signum(g) * F.greatest(F.abs(g) - p["reg_alpha"], F.lit(0.0))
    step = -shrunk / (n + p["reg_lambda"])
    most = p["max_delta_step"]
    return F.greatest(F.least(step, F.lit(most)), F.lit(-most)) if most else step


def node_score(g: Column, n: Column, p: dict) -> Column:
    """Twice what the best step saves."""
    w = leaf_weight(g, n, p)
    return -(2 * g * w + (n + p["reg_lambda"]) * w * w + 2 * p["reg_alpha"] * F.abs(w))


def with_series(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of a table with one row per series; null keys are keys like others. The rows stay on the left, so a hot series can be split."""
    own = table.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(own[f"_of_{k}"]) for k in keys])
    return rows.join(own, same, "left").drop(*[f"_of_{k}" for k in keys])


def bin_edges(rows: DataFrame, keys: Sequence[str], features: Sequence[str], max_bin: int = 64) -> DataFrame:
    """keys, and ``edges``: for each feature the distinct quantiles that cut a series' values into at most ``max_bin`` bins.

    A value that holds more than a ``max_bin``-th of a series is an edge, so a feature of few even values is cut at each.
    """
    shares = F.array(*[F.lit(k / max_bin) for k in range(1, max_bin)])
    cut = [F.array_sort(F.array_distinct(F.percentile_approx(F.col(f).cast("double"), shares, 100 * max_bin))) for f in features]
    return rows.groupBy(*keys).agg(F.array(*cut).alias("edges"))


def bin_of(value: Column, edges: Column, max_bin: int) -> Column:
    """The number of edges below a value, by bisection."""
    steps = [F.lit(1 << k) for k in reversed(range(max_bin.bit_length()))]
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) < value, at + step).otherwise(at))


def node_of(x: Column, nodes: Column, depth: int, field: str) -> Column:
    """The node where a row ends: from 1, node k leads to 2 k, or to 2 k + 1 if the feature is beyond ``field`` of the node."""

    def down(at: Column, _: Column) -> Column:
        node = F.try_element_at(nodes, at)
        beyond = F.get(x, node["feature"]) > node[field]
        return F.when(node["feature"].isNull(), at).otherwise(2 * at + beyond.cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), down) if depth else F.lit(1)


def _nodes_map(nodes: DataFrame, keys: Sequence[str], *fields: str, by: Sequence[str] = ()) -> DataFrame:
    entry = F.struct("node", F.struct(*fields))
    return nodes.groupBy(*keys, *by).agg(F.map_from_entries(F.collect_list(entry)).alias("nodes"))


def grow(rows: DataFrame, keys: Sequence[str], p: dict) -> DataFrame:
    """One tree for each series: keys, node, g, n, feature, cut, gain; feature is null in leaves. ``rows``: keys, x (bins), g."""
    keys, levels, last = list(keys), [], None
    for level in range(p["max_depth"]):
        at = rows.withColumn("node", F.lit(1))
        if level:
            so_far = _nodes_map(reduce(DataFrame.unionByName, levels).where("feature IS NOT NULL"), keys, "feature", "cut")
            at = with_series(rows, so_far, keys).withColumn("node", node_of(F.col("x"), F.col("nodes"), level, "cut")).where(F.col("node") >= 1 << level)
        cells = at.select(*keys, "node", "g", F.posexplode("x").alias("feature", "bin"))
        sums = cells.groupBy(*keys, "node", "feature", "bin").agg(F.sum("g").alias("g"), F.count("*").alias("n"))
        one = Window.partitionBy(*keys, "node", "feature")  # a row for each bin
        upto = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cuts = sums.select(*keys, "node", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("n").over(upto).alias("nl"), F.sum("g").over(one).alias("g"), F.sum("n").over(one).alias("n"))
        cuts = cuts.withColumns({"gr": F.col("g") - F.col("gl"), "nr": F.col("n") - F.col("nl")})
        gain = node_score(F.col("gl"), F.col("nl"), p) + node_score(F.col("gr"), F.col("nr"), p) - node_score(F.col("g"), F.col("n"), p)
        fits = (F.col("nl") >= p["min_child_weight"]) & (F.col("nr") >= p["min_child_weight"]) & (F.col("nr") > 0)
        cuts = cuts.withColumn("gain", F.when(fits & (gain > p["min_split_loss"]), gain))
        split = F.when(F.col("gain").isNotNull(), F.struct("gain", "feature", F.col("bin").alias("cut"), "gl", "nl", "gr", "nr"))
        best = cuts.groupBy(*keys, "node").agg(F.max_by("g", -F.col("feature")).alias("g"), F.max("n").alias("n"), F.max_by(split, F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("s"))
        found = materialize(best.select(*keys, "node", "g", "n", "s.*"))
        levels.append(found.select(*keys, "node", "g", "n", "feature", "cut", "gain"))
        last = found.where("feature IS NOT NULL")
    if last is None:
        return rows.groupBy(*keys).agg(F.lit(1).alias("node"), F.sum("g").alias("g"), F.count("*").alias("n"), F.lit(None).cast("int").alias("feature"), F.lit(None).cast("int").alias("cut"), F.lit(None).cast("double").alias("gain"))
    sides = F.array(*[F.struct((2 * F.col("node") + k).alias("node"), F.col(g).alias("g"), F.col(n).alias("n")) for k, g, n in ((0, "gl", "nl"), (1, "gr", "nr"))])
    leaves = last.select(*keys, F.inline(sides)).select(*keys, "node", "g", "n", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("int").alias("cut"), F.lit(None).cast("double").alias("gain"))
    return reduce(DataFrame.unionByName, [*levels, leaves])


def fit_trees(train: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, params: dict | None = None, max_bin: int = 64, seed: int = 7) -> DataFrame:
    """Models of all series as a table of nodes: keys, tree, node, feature (its place, null in leaves), threshold, value, gain, cover.

    Squared error; a row's gradient is prediction less label, and its weight 1, so ``min_child_weight`` counts rows. Tree -1 is the mean of
    the labels. A row goes right if its feature is beyond the threshold. A split must gain more than ``min_split_loss``;
    ties go to the first feature, then the smallest threshold. ``value`` already has the learning rate. A tree trains on the rows that
    a hash picks (``subsample``). Rows with a null or NaN label or feature are left out; a series without complete rows has no model.
    """
    p, keys = parameters(params or {}), list(keys)
    clean = train.select(*keys, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"), F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f"_f{k}") for k, f in enumerate(features)])
    clean = clean.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in ("_y", *[f"_f{k}" for k in range(len(features))])]))
    of = clean.groupBy(*keys).agg(F.avg("_y").alias("base"), F.count("*").alias("n"))
    series = materialize(with_series(of, bin_edges(clean, keys, [f"_f{k}" for k in range(len(features))], max_bin), keys))
    bins = F.array(*[bin_of(F.col(f"_f{k}"), F.get("edges", F.lit(k)), max_bin) for k in range(len(features))])
    rows = with_series(clean, series, keys).select(*keys, bins.alias("x"), F.col("_y").alias("y"), F.col("base").alias("f"), F.monotonically_increasing_id().alias("_row"))
    rows = materialize(rows)
    none = {"feature": "int", "threshold": "double", "gain": "double"}
    parts = [series.select(*keys, F.lit(-1).alias("tree"), F.lit(1).alias("node"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.col("base").alias("value"), F.col("n").alias("cover"))]
    for tree in range(p["n_estimators"]):
        given = rows.where(F.pmod(F.xxhash64("_row", F.lit(seed), F.lit(tree)), F.lit(1 << 20)) < int(p["subsample"] * (1 << 20)))
        nodes = materialize(grow(given.select(*keys, "x", (F.col("f") - F.col("y")).alias("g")), keys, p))
        nodes = nodes.withColumn("value", p["learning_rate"] * leaf_weight(F.col("g"), F.col("n"), p))
        at = with_series(nodes, series.select(*keys, "edges"), keys)
        threshold = F.get(F.get("edges", "feature"), "cut")
        parts.append(at.select(*keys, F.lit(tree).alias("tree"), "node", "feature", threshold.alias("threshold"), "gain", F.when(F.col("feature").isNull(), F.col("value")).alias("value"), F.col("n").alias("cover")))
        if tree + 1 < p["n_estimators"]:
            held = with_series(rows, _nodes_map(nodes, keys, "feature", "cut", "value"), keys)
            step = F.try_element_at("nodes", node_of(F.col("x"), F.col("nodes"), p["max_depth"], "cut"))["value"]
            rows = materialize(held.withColumn("f", F.col("f") + F.coalesce(step, F.lit(0.0))).drop("nodes"))
    order = [*keys, "tree", "node", "feature", "threshold", "gain", "value", "cover"]
    return materialize(reduce(DataFrame.unionByName, [part.select(*order) for part in parts]))


def score_trees(rows: DataFrame, model: DataFrame, keys: Sequence[str], features: Sequence[str], into: str = "predictions") -> DataFrame:
    """``rows`` with the sum of their series' trees; null where a feature is null or the series has no model."""
    keys = list(keys)
    depth = model.agg(F.max(F.floor(F.log2("node")))).first()[0] or 0
    trees = model.agg(F.max("tree")).first()[0]
    out = with_series(rows, model.where("tree = -1").select(*keys, F.col("value").alias("_sum")), keys)
    x = F.array(*[F.col(f).cast("double") for f in features])
    of_tree = materialize(_nodes_map(model.where("tree >= 0"), keys, "feature", "threshold", "value", by=["tree"]))
    for first in range(0, (trees if trees is not None else -1) + 1, TREES_AT_A_TIME):
        some = of_tree.where(F.col("tree").between(first, first + TREES_AT_A_TIME - 1))
        out = with_series(out, some.groupBy(*keys).agg(F.collect_list("nodes").alias("_trees")), keys)
        total = F.aggregate("_trees", F.lit(0.0), lambda s, nodes: s + F.try_element_at(nodes, node_of(x, nodes, int(depth), "threshold"))["value"])
        out = out.withColumn("_sum", F.col("_sum") + F.coalesce(total, F.lit(0.0))).drop("_trees")
    complete = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    return out.withColumn(into, F.when(complete, F.col("_sum"))).drop("_sum")


def gain_importance(model: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """keys, feature (its name), importance: the summed gain of its splits."""
    names = F.array(*[F.lit(f) for f in features])
    return model.where("feature IS NOT NULL").groupBy(*keys, F.get(names, "feature").alias("feature")).agg(F.sum("gain").alias("importance"))


def paths(nodes: list[dict]) -> tuple[float, list[tuple[float, dict[int, list]]]]:
    """The mean of a model over its training rows, and for every leaf its value and, by feature, the bounds of its path and the share of rows that keep to it."""
    trees: dict[int, dict[int, dict]] = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["node"]] = n
    mean, leaves = 0.0, []
    for tree in trees.values():
        left = [(1, {}, 1.0)]
        while left:
            at, path, share = left.pop()
            node = tree[at]
            if node["feature"] is None:
                mean += share * node["value"]
                leaves.append((node["value"], path))
                continue
            for child, beyond in ((2 * at, False), (2 * at + 1, True)):
                ratio = tree[child]["cover"] / node["cover"]
                low, high, kept = path.get(node["feature"], [-np.inf, np.inf, 1.0])
                low, high = (max(low, node["threshold"]), high) if beyond else (low, min(high, node["threshold"]))
                left.append((child, path | {node["feature"]: [low, high, kept * ratio]}, share * ratio))
    return mean, [(value, path) for value, path in leaves if path]


def shapley(x: np.ndarray, leaves: list[tuple[float, dict[int, list]]]) -> np.ndarray:
    """Exact attributions of rows. A leaf gives each feature of its path the mean, over all orders of these features, of what knowing it changes.

    Coefficient k sums the products over all subsets of k other features that are known: those known count 1 or 0, the rest their share.
    """
    out = np.zeros(x.shape)
    for value, path in leaves:
        m = len(path)
        known = {f: ((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, (low, high, _) in path.items()}
        for f, (_, _, share) in path.items():
            sums = [np.ones(len(x))]
            for other, (_, _, kept) in path.items():
                if other != f:
                    grown = [s * kept for s in sums] + [np.zeros(len(x))]
                    for k, s in enumerate(sums):
                        grown[k + 1] = grown[k + 1] + s * known[other]
                    sums = grown
            weight = sum(s * (factorial(k) * factorial(m - k - 1) / factorial(m)) for k, s in enumerate(sums))
            out[:, f] += value * (known[f] - share) * weight
    return out


def attributions(rows: DataFrame, model: DataFrame, keys: Sequence[str], row_id: Sequence[str], features: Sequence[str], salts: int = 16) -> DataFrame:
    """keys, row_id, feature, phi, expected: path-dependent attributions of every row, exact, without sampling.

    ``phi`` of a row's features add up to its prediction less ``expected``, the mean of its series' trees over their training rows. Rows are dealt over
    ``salts`` tasks for each series, and each of them gets the series' nodes first; a task holds one model at a time. Rows with
    a null or NaN feature, and those of a series without a model, give nothing. Null keys are keys like others.
    """
    keys, ids = list(keys), [c for c in row_id if c not in keys]
    x = F.array(*[F.col(f).cast("double") for f in features])
    whole = rows.where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)))
    key, row = F.struct(*keys).alias("key"), F.struct(*[F.col(c) for c in ids], F.lit(0).alias("_none")).alias("row")
    data = whole.select(key, F.pmod(F.xxhash64(*ids, x), F.lit(salts)).alias("salt"), x.alias("x"), row)
    nodes = model.groupBy(*keys).agg(F.collect_list(F.struct("tree", "node", "feature", "threshold", "value", "cover")).alias("nodes"))
    held = nodes.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"), "nodes")
    both = data.unionByName(held, allowMissingColumns=True).withColumn("place", F.xxhash64("key", "salt"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, "key", "salt").sortWithinPartitions("place", "key", "salt", F.col("nodes").isNull())
    out = T.StructType([both.schema["key"], data.schema["row"], T.StructField("phi", T.ArrayType(T.DoubleType())), T.StructField("expected", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made = None, None
        for batch in batches:
            place, given = batch.column("place").to_numpy(), np.asarray(batch.column("nodes").is_valid())
            cuts = np.unique(np.append(np.flatnonzero(given | np.append(True, place[1:] != place[:-1])), [0, len(place)]))
            for a, b in zip(cuts, cuts[1:]):
                if place[a] != now:
                    now, made = place[a], None
                if given[a]:
                    made = paths(batch.column("nodes")[int(a)].as_py())
                    a += 1
                if made is None or a >= b:
                    continue
                part = batch.slice(int(a), int(b - a))
                phi = shapley(np.array(part.column("x").to_pylist(), float), made[1])
                lists = pa.array(phi.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("row"), lists, pa.array(np.full(len(phi), made[0]))], names=["key", "row", "phi", "expected"])

    found = dealt.select("key", "salt", "x", "row", "nodes", "place").mapInArrow(run, out)
    names = F.array(*[F.lit(f) for f in features])
    flat = found.select("key.*", *[F.col("row")[c].alias(c) for c in ids], F.posexplode("phi").alias("_k", "phi"), "expected")
    return flat.select(*keys, *ids, F.get(names, "_k").alias("feature"), "phi", "expected")
