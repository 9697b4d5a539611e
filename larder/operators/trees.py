"""Boosted trees and random forests from distributed histograms.

Inputs are quantised once: a feature's cut points are exact quantiles of the
training rows, a row keeps one byte a feature, and the target is a whole number
of ``1 / UNIT`` of its range. All sums are sums of whole numbers, so a fit gives
the same trees on any layout, on a rerun and after a lost executor.

A pass over the stored rows sums, for a bounded number of open nodes
(``slots``), weight and target by (node, feature, bin): a task holds one table
of slots x features x bins, an aggregation adds the tasks' tables, a window over
the bins of a node and feature (``bins`` rows at most) rates all cuts, and one row a node reaches
the driver. Nodes beyond the bound wait for the next pass, so memory does not
grow with depth or the number of trees.

Rows are drawn by a hash of (seed, tree, row key): a share of the rows for
boosting, Poisson weights for the bootstrap of a forest. Columns are drawn by a
hash of (seed, tree) or (seed, tree, node). Boosting keeps the running
prediction beside the rows and writes it to shared storage every ``keep``
rounds, which cuts the lineage; in between, a task adds the few trees since.

A missing input lies below the first cut. Without training rows a fit raises.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.operators import stats as st
from larder.operators.scorers import ArrowScorer, save_scorer
from larder.session import stored

UNIT = 1 << 20
#: Distribution function of the Poisson(1) distribution, as far as 64 bits tell it from 1.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values (a splitmix step)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seed: int, number: int, keys: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from (seed, number, key)."""
    start = _mixed(np.array([seed * 1_000_003 + number], dtype=np.uint64))
    return (_mixed(keys.astype(np.int64).view(np.uint64) ^ start) >> np.uint64(11)) / float(1 << 53)


def share(part: float) -> Callable[[int, int, np.ndarray], np.ndarray]:
    """Row weights that keep a share of the rows."""
    return lambda seed, tree, keys: (uniform(seed, tree, keys) < part).astype(np.int64)


def bootstrap(seed: int, tree: int, keys: np.ndarray) -> np.ndarray:
    """Poisson(1) row weights."""
    return np.searchsorted(_POISSON, uniform(seed, tree, keys), side="right")


def drawn_columns(seed: int, tree: int, node: int, columns: int, count: int) -> np.ndarray:
    """``count`` columns for a node, ascending."""
    return np.sort(np.argsort(uniform(seed + 17, tree * 1_000_003 + node, np.arange(columns)), kind="stable")[:max(1, count)])


@dataclass
class Tree:
    """Nodes in order of creation; a node without a feature is a leaf, the right child follows the left one."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> int:
        """Give a node two children with their values; returns the left one."""
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for value in values:
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.depth.append(self.depth[node] + 1)
            self.value.append(value)
        return self.left[node]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, left = (np.array(c) for c in (self.feature, self.cut, self.left))
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(max(self.depth)):
            f = feature[at]
            down = left[at] + (bins[rows, f] > cut[at])
            at = np.where(f >= 0, down, at)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class TreeModel:
    """Trees over quantised features; a prediction is base + factor x the sum of the trees, on the target's range."""

    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree]
    base: float
    factor: float
    target_range: tuple[float, float]
    losses: list[float] = field(default_factory=list)

    def description(self) -> dict:
        return {"cuts": self.cuts, "base": self.base, "factor": self.factor, "target_range": list(self.target_range),
                "trees": [[t.feature, t.cut, t.left, t.depth, t.value] for t in self.trees]}

    def scorer(self, name: str, version: str = "1") -> ArrowScorer:
        return ArrowScorer(name, version, self.features, json.dumps(self.description()).encode(), build)

    def save(self, spark, path: str, name: str, version: str = "1") -> None:
        save_scorer(spark, path, "trees", name, version, self.features, self.description())


def build(payload: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """The prediction function of a described model: a matrix of inputs to predictions, clipped at 0."""
    d = json.loads(payload)
    cuts = [np.array(c) for c in d["cuts"]]
    trees = [Tree(*t) for t in d["trees"]]
    lo, hi = d["target_range"]

    def predict(rows: np.ndarray) -> np.ndarray:
        bins = quantised(rows, cuts)
        total = np.zeros(len(rows))
        for t in trees:
            total += t.predict(bins)
        return np.maximum(0.0, (d["base"] + d["factor"] * total) * (hi - lo) + lo)

    return predict


#: Builders of ``scorers.load_scorer``.
BUILDERS = {"trees": build}


def cut_points(train: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Exact quantiles of the training rows, repeated ones and those at the maximum left out; at most bins - 1 a feature."""
    long = st.long_numeric(train, features)
    names = {f"q{i}": i / bins for i in range(1, bins)}
    highest = {r["column"]: r["hi"] for r in long.groupBy("column").agg(F.max("value").alias("hi")).collect()}  # one row a feature
    found = {r["column"]: sorted({r[q] for q in names} - {highest[r["column"]]}) for r in st.exact_quantiles(long, ["column"], names).collect()}
    return [found.get(f, []) for f in features]


def quantised(rows: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """One byte a feature: the number of cuts below the value."""
    out = np.zeros(rows.shape, dtype=np.uint8)
    for i, c in enumerate(cuts):
        x = rows[:, i]
        out[:, i] = np.searchsorted(c, np.where(np.isnan(x), -np.inf, x), side="left")
    return out


def binned(df: DataFrame, key: str, features: list[str], cuts: list[list[float]], target: str, target_range: tuple[float, float]) -> DataFrame:
    """(key, bins, y, pred): stored training rows; rows without a target are left out."""
    lo, hi = target_range
    ready = df.where(F.col(target).isNotNull()).select(F.xxhash64(key).alias("key"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
                                                       F.col(target).cast("double").alias("y"))
    points = [np.array(c) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(points))
            y = np.rint((b.column(2).to_numpy() - lo) / ((hi - lo) or 1.0) * UNIT).astype(np.int64)
            bins = _packed(quantised(x, points))
            yield pa.RecordBatch.from_arrays([b.column(0), bins, pa.array(y), pa.array(np.zeros(len(y)))], names=["key", "bins", "y", "pred"])

    return stored(ready.mapInArrow(run, "key bigint, bins binary, y bigint, pred double"), "trees-binned")


def _bins(column: pa.Array, features: int) -> np.ndarray:
    """The rows' bytes as a matrix, read in place."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]].reshape(-1, features)


def _entries(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the bytes above 0, found in one run over the flat bytes."""
    at = np.flatnonzero(bins != 0)
    row = at // bins.shape[1]
    return row, at - row * bins.shape[1], bins.reshape(-1)[at]


def _packed(bins: np.ndarray) -> pa.Array:
    """A matrix of bytes as one binary value a row."""
    ends = np.arange(len(bins) + 1, dtype=np.int32) * bins.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bins))])


@dataclass
class Settings:
    """What one growing pass needs to know about the kind of model."""

    features: int
    bins: int
    max_depth: int
    seed: int
    weights: Callable[[int, int, np.ndarray], np.ndarray]
    columns: Callable[[int, int], np.ndarray]  # (tree, node) -> columns that may split it
    penalty: float = 0.0
    slots: int = 1024


def histograms(rows: DataFrame, open_nodes: list[tuple[int, int]], trees: dict[int, Tree], added: list[Tree], factor: float, s: Settings) -> DataFrame:
    """(slot, feature, bin, w, sum, loss): sums of the rows that reach the open nodes; slot -1 holds the loss of all rows."""
    wanted: dict[int, list[tuple[int, int]]] = {}
    for slot, (tree, node) in enumerate(open_nodes):
        wanted.setdefault(tree, []).append((node, slot))
    allowed = np.zeros((len(open_nodes), s.features), dtype=bool)
    for slot, (tree, node) in enumerate(open_nodes):
        allowed[slot, s.columns(tree, node)] = True
    shared = rows.sparkSession.sparkContext.broadcast((wanted, {t: trees[t] for t in wanted}, added, allowed))
    features, bins, seed, weights = s.features, s.bins, s.seed, s.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, trees, added, allowed = shared.value
        size = len(allowed) * features * bins
        count, total = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        n, loss = 0, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            keys, y, pred = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
            x = _bins(b.column(1), features)
            for t in added:
                pred = pred + factor * t.predict(x)
            rest = y - np.rint(pred * UNIT).astype(np.int64)
            n, loss = n + len(rest), loss + float(((rest / UNIT) ** 2).sum())
            for tree, nodes in wanted.items():
                slot_of = np.full(len(trees[tree].feature), -1, dtype=np.int64)
                for node, slot in nodes:
                    slot_of[node] = slot
                slot = slot_of[trees[tree].nodes(x)]
                w = weights(seed, tree, keys)
                reach = np.flatnonzero((slot >= 0) & (w > 0))
                if not len(reach):
                    continue
                # A tree's slots are near each other: its table holds only those.
                low, high = int(slot[reach].min()), int(slot[reach].max()) + 1
                one, wr, sr = slot[reach] - low, w[reach], w[reach] * rest[reach]
                xr = x[reach]
                # Only bins above 0 are counted one by one (a row of one-hot columns has few); bin 0 is what a node's rows leave.
                row, column, value = _entries(xr)
                at = (one[row] * features + column) * bins + value
                # Sums over one batch are whole numbers far below 2^53: exact as doubles.
                for table, amount in ((count, wr), (total, sr)):
                    part = np.bincount(at, amount[row], minlength=(high - low) * features * bins).astype(np.int64).reshape(high - low, features, bins)
                    whole = np.bincount(one, amount, minlength=high - low).astype(np.int64)
                    part[:, :, 0] = whole[:, None] - part.sum(axis=2)
                    table[low * features * bins:high * features * bins] += part.ravel()
        used = np.flatnonzero((count > 0) & np.repeat(allowed.ravel(), bins))
        slot, place = np.divmod(used, features * bins)
        ones = [pa.array(slot.astype(np.int32)), pa.array((place // bins).astype(np.int32)), pa.array((place % bins).astype(np.int32)),
                pa.array(count[used]), pa.array(total[used]), pa.nulls(len(used), pa.float64())]
        yield pa.RecordBatch.from_arrays(ones, names=["slot", "feature", "bin", "w", "sum", "loss"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([n]),
                                          pa.array([0]), pa.array([loss])], names=["slot", "feature", "bin", "w", "sum", "loss"])

    parts = rows.mapInArrow(run, "slot int, feature int, bin int, w bigint, sum bigint, loss double")
    return parts.groupBy("slot", "feature", "bin").agg(F.sum("w").alias("w"), F.sum("sum").alias("sum"), F.sum("loss").alias("loss"))


def best_cuts(sums: DataFrame, penalty: float) -> DataFrame:
    """One row a slot: weight and sum, loss, and the best cut (gain, feature, bin, weight and sum left of it), null if none."""
    upto = Window.partitionBy("slot", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # bins at most
    whole = Window.partitionBy("slot", "feature")
    x = sums.select("slot", "feature", "bin", "loss", F.sum("w").over(upto).alias("wl"), F.sum("sum").over(upto).alias("sl"),
                    F.sum("w").over(whole).alias("w"), F.sum("sum").over(whole).alias("s"))

    def part(total, weight):
        return total.cast("double") * total.cast("double") / (weight + F.lit(penalty))

    gain = part(F.col("sl"), F.col("wl")) + part(F.col("s") - F.col("sl"), F.col("w") - F.col("wl")) - part(F.col("s"), F.col("w"))
    best = F.when(F.col("wl") < F.col("w"), F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "wl", "sl"))
    return x.groupBy("slot").agg(F.max("w").alias("w"), F.max_by("s", "w").alias("s"), F.max("loss").alias("loss"), F.max(best).alias("best"))


def grow(rows: DataFrame, numbers: list[int], added: list[Tree], factor: float, s: Settings) -> tuple[dict[int, Tree], tuple[float, int]]:
    """Trees of the given numbers grown together, and (squared error, rows) before them."""
    trees = {t: Tree() for t in numbers}
    waiting = [(t, 0) for t in numbers]
    before = (0.0, 0)
    while waiting:
        open_nodes, waiting = waiting[:s.slots], waiting[s.slots:]
        found = best_cuts(histograms(rows, open_nodes, trees, added, factor, s), s.penalty).collect()  # one row an open node
        for r in sorted(found, key=lambda r: r["slot"]):
            if r["slot"] < 0:
                before = (r["loss"], r["w"])
                continue
            tree, node = open_nodes[r["slot"]]
            t, total, weight, best = trees[tree], r["s"], r["w"], r["best"]
            if node == 0:
                t.value[0] = total / (weight + s.penalty) / UNIT
            if best is None or best["gain"] <= 0:
                continue
            sides = ((best["sl"], best["wl"]), (total - best["sl"], weight - best["wl"]))
            left = t.split(node, -best["f"], -best["b"], tuple(a / (n + s.penalty) / UNIT for a, n in sides))
            if t.depth[left] < s.max_depth:
                waiting += [(tree, left + i) for i, (_, n) in enumerate(sides) if n > 1]
    return trees, before


def _prepared(train: DataFrame, key: str, features: list[str], target: str, bins: int):
    ends = train.agg(F.min(target).cast("double").alias("lo"), F.max(target).cast("double").alias("hi")).first()
    if ends["lo"] is None:
        raise ValueError("no training rows")
    cuts = cut_points(train, features, bins)
    return cuts, (ends["lo"], ends["hi"]), binned(train, key, features, cuts, target, (ends["lo"], ends["hi"]))


def _with_trees(rows: DataFrame, added: list[Tree], factor: float, features: int) -> DataFrame:
    """Rows with the trees added to their running prediction, stored."""
    shared = rows.sparkSession.sparkContext.broadcast(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, pred = _bins(b.column(1), features), b.column(3).to_numpy()
                for t in shared.value:
                    pred = pred + factor * t.predict(x)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(pred)], names=b.schema.names)

    return stored(rows.mapInArrow(run, rows.schema), "trees-binned")


def gbt_fit(train: DataFrame, key: str, features: list[str], target: str, rounds: int = 1000, rate: float = 0.03, max_depth: int = 8,
            row_share: float = 0.8, column_share: float = 0.8, bins: int = 32, seed: int = 42, penalty: float = 1.0, keep: int = 10) -> TreeModel:
    """Boosted trees on squared error; ``losses`` has the mean squared error (target scaled to 0..1) before each round and after the last."""
    cuts, ends, rows = _prepared(train, key, features, target, bins)
    mean = rows.agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).first()
    base = mean["s"] / mean["n"] / UNIT
    rows = rows.withColumn("pred", F.lit(base))
    width = len(features)
    chosen = max(1, int(column_share * width))
    s = Settings(width, bins, max_depth, seed, share(row_share), lambda tree, node: drawn_columns(seed, tree, 0, width, chosen), penalty)
    model = TreeModel(features, cuts, [], base, rate, ends)
    added: list[Tree] = []
    for number in range(rounds):
        if len(added) == keep:
            rows, added = _with_trees(rows, added, rate, width), []
        trees, (loss, n) = grow(rows, [number], added, rate, s)
        model.losses.append(loss / n)
        model.trees.append(trees[number])
        added = [*added, trees[number]]
    last = _with_trees(rows, added, rate, width)
    rest = F.col("y") - F.rint(F.col("pred") * UNIT)
    model.losses.append(last.agg(F.avg(rest * rest)).first()[0] / UNIT / UNIT)
    return model


def random_forest_fit(train: DataFrame, key: str, features: list[str], target: str, trees: int = 500, max_depth: int = 20,
                      columns: int | None = None, bins: int = 32, seed: int = 42, slots: int = 1024) -> TreeModel:
    """Bagged trees: Poisson row weights, ``columns`` (the root of all, if not given) drawn anew for each node."""
    cuts, ends, rows = _prepared(train, key, features, target, bins)
    width = len(features)
    chosen = columns or max(1, int(width ** 0.5))
    s = Settings(width, bins, max_depth, seed, bootstrap, lambda tree, node: drawn_columns(seed, tree, node, width, chosen), 0.0, slots)
    grown, _ = grow(rows, list(range(trees)), [], 1.0, s)
    return TreeModel(features, cuts, [grown[i] for i in range(trees)], 0.0, 1.0 / trees, ends)
