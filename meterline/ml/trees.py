"""Forests and boosted trees of regression, grown level by level on binned rows.

The library's trees (`maxBins` bins a feature, variance, the same stopping rules, its model classes)
by other steps. Rows become blocks of small integers once. For each level a task sums count and
label by node and bin, one tree at a time, so that the sums in work stay in the processor's cache;
the library keeps those of all nodes of all trees at once and misses it with every row. Sums of a
tree meet in one task, which finds the splits; the driver gets splits alone. Bootstrap weights are
drawn anew for each level from a seed of tree and block and are never stored.
"""

from __future__ import annotations

import json
import math
import pickle
import time
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline.sources.staging import new_path, use_checkpoints

#: Rows of a block, of a task (at most, beside a block), and of a task where there are few.
BLOCK_ROWS, MOST_ROWS, LEAST_ROWS = 1 << 16, 1 << 22, 20_000
#: Values that stand for a feature's distribution in a partition; fewer distinct ones are exact.
POINTS = 4096
#: Nodes of a tree that are summed at a time.
NODES = 2048
#: Bytes of sums that a job shuffles (or two per row, if that is more), and that it may send to the driver.
ROOM, SMALL = 1 << 28, 1 << 22
#: Cut of a leaf: no bin is above it.
NEVER = 255
#: Levels that are walked with one comparison a node.
TOP = 3
#: Cells that features are counted in together, for all nodes of a group.
CELLS = 1 << 13


# --- bins ---------------------------------------------------------------------------


def summary(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values with their weights, at most about `POINTS`: the weight up to each is exact."""
    if weights is None:
        values, weights = np.unique(values, return_counts=True)
    else:
        values, where = np.unique(values, return_inverse=True)
        weights = np.bincount(where, weights, len(values))
    if len(values) <= POINTS:
        return values, np.asarray(weights, float)
    upto = np.cumsum(weights, dtype=float)
    kept = np.searchsorted(upto, (np.arange(POINTS) + 0.5) / POINTS * upto[-1])
    kept = np.unique(np.concatenate([[0], kept, [len(values) - 1]]))
    return values[kept], np.diff(upto[kept], prepend=0.0)


def merged(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return summary(np.concatenate([v for v, _ in parts]), np.concatenate([w for _, w in parts]))


def cuts_of(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Thresholds between `most` bins at most: one between any two values if there are so few,
    else those nearest to bins of equal weight."""
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) < most:
        return middle
    stride = weights.sum() / most
    target, upto, out = stride, np.cumsum(weights), []
    for i in range(len(middle)):
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            out.append(middle[i])
            target += stride
    return np.array(out[: most - 1])


def _columns(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)  # null: not a number
            yield batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), y


def _packed(found: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found, 5)], pa.binary())], ["data"])


def _summaries(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows, rows with a value that is no finite number, sum of the label, summary of each feature."""
    rows, bad, total, parts, held, size = 0, 0, 0.0, [], [], 0

    def put() -> None:
        x = np.concatenate(held)
        parts.append([summary(x[:, k]) for k in range(width)])

    for x, y in _columns(batches, width):
        rows, bad, total = rows + len(y), bad + int((~(np.isfinite(y) & np.isfinite(x).all(1))).sum()), total + float(y.sum())
        held.append(x)
        size += len(y)
        if size >= 4 * BLOCK_ROWS:
            put()
            held, size = [], 0
    if held:
        put()
    if rows:
        whole = [merged([p[k] for p in parts]) for k in range(width)]
        yield _packed((TaskContext.get().partitionId(), rows, bad, total, whole))


def _merged_group(found: Iterable[tuple]) -> tuple:
    """In the order of partitions, so that a repeated run gets the same."""
    found = sorted(found, key=lambda x: x[0])
    widths = range(len(found[0][4]))
    return (
        found[0][0],
        {k: v for x in found for k, v in (x[1] if isinstance(x[1], dict) else {x[0]: x[1]}).items()},
        sum(x[2] for x in found),
        sum(x[3] for x in found),
        [merged([x[4][k] for x in found]) for k in widths],
    )


def _blocks(batches: Iterable[pa.RecordBatch], width: int, cuts: list[np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition: its number, the block's, bins (a row per feature) and label. Rows
    are ordered by what they hold, whatever order they come in, since weights hang on the place."""
    bins, labels = [], []
    for x, y in _columns(batches, width):
        bins.append(np.stack([np.searchsorted(c, np.ascontiguousarray(x[:, k])).astype(np.uint8) for k, c in enumerate(cuts)]))
        labels.append(y)
    if not labels:
        return
    whole, y = np.concatenate(bins, axis=1), np.concatenate(labels)
    key = (y + 0.0).view(np.uint64).copy()
    for row in whole:
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key += row
    order = np.argsort(key, kind="stable")
    part = TaskContext.get().partitionId()
    for number, rows in enumerate(np.array_split(order, math.ceil(len(y) / most))):
        yield _packed((part, number, np.ascontiguousarray(whole[:, rows]), y[rows]))


@dataclass
class Binned:
    """Rows as blocks of bins, and what their bins are."""

    blocks: RDD  # (partition, block, bins, label)
    cuts: list[np.ndarray]
    rows: int
    mean: float

    @property
    def bins(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts]


def binned(df: DataFrame, features: str, label: str, most_bins: int) -> Binned:
    """Reads the rows twice; the blocks are kept until the caller lets them go."""
    width_row = df.select(features).head(1)
    if not width_row:
        raise ValueError("no training rows")
    width = len(width_row[0][0])
    flat = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    seen = flat.mapInArrow(partial(_summaries, width=width), "data binary").rdd.map(_unpacked)
    groups = seen.map(lambda s: (s[0] // 16, s)).groupByKey().mapValues(_merged_group).values().collect()
    _, counts, bad, total, found = _merged_group(groups)
    if bad:
        raise ValueError(f"{bad} rows have a label or feature that is no finite number")
    rows = sum(counts.values())
    cuts = [cuts_of(v, w, min(most_bins, rows)) for v, w in found]
    tasks = max(min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / LEAST_ROWS)), math.ceil(rows / MOST_ROWS))
    most = min(BLOCK_ROWS, math.ceil(rows / tasks))
    first, n = {}, 0  # the block of all blocks that a partition begins with
    for part in sorted(counts):
        first[part], n = n, n + math.ceil(counts[part] / most)
    made = flat.mapInArrow(partial(_blocks, width=width, cuts=cuts, most=most), "data binary").rdd.map(_unpacked)
    dealt = made.map(lambda b: (first[b[0]] + b[1], b)).partitionBy(tasks, _same).values()
    return Binned(dealt.persist(StorageLevel.MEMORY_AND_DISK), cuts, rows, total / rows)


def _unpacked(row: Sequence[bytes]) -> Any:
    return pickle.loads(row[0])


def _same(key: int) -> int:
    return key


# --- trees ----------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in the order they were made, so that children follow their parent. A leaf's child is the
    leaf itself."""

    number: int
    feature: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.full(1, NEVER, np.uint8))
    child: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # the left one, the right one is next
    gain: np.ndarray = field(default_factory=lambda: np.full(1, -1.0))
    stats: np.ndarray = field(default_factory=lambda: np.zeros((1, 3)))  # count, sum, sum of squares
    open: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # nodes of the level to split

    @property
    def values(self) -> np.ndarray:
        return self.stats[:, 1] / self.stats[:, 0]

    def split(self, best: Sequence[np.ndarray]) -> None:
        """The open nodes get their sums and, where there is a split, children, open next."""
        stats, feature, cut, gain, sides = best
        self.stats[self.open] = stats
        parents, sides = self.open[feature >= 0], sides[feature >= 0]
        feature, cut, gain = (x[feature >= 0] for x in (feature, cut, gain))
        n, more = len(self.feature), 2 * len(parents)
        self.feature[parents], self.cut[parents], self.gain[parents] = feature, cut, gain
        self.child[parents] = n + 2 * np.arange(len(parents))
        self.open = np.arange(n, n + more)
        self.feature = np.concatenate([self.feature, np.zeros(more, np.int64)])
        self.cut = np.concatenate([self.cut, np.full(more, NEVER, np.uint8)])
        self.child = np.concatenate([self.child, self.open])
        self.gain = np.concatenate([self.gain, np.full(more, -1.0)])
        self.stats = np.concatenate([self.stats, sides.reshape(-1, 3)])


def places(
    bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, depth: int,
    rows: np.ndarray | None = None, flat: np.ndarray | None = None,
) -> np.ndarray:
    """The node that each row (of `rows`, if given) is in after `depth` steps. `flat`: the bins row by row."""
    small, level = np.zeros(bins.shape[1], np.uint8), [0]
    for _ in range(min(depth, TOP)):  # a few nodes: bytes are compared, nothing is looked up
        found, below = np.zeros(bins.shape[1], np.uint8), []
        for j in level:
            if child[j] == j:
                found += (small == j) * np.uint8(j)
                below.append(j)
            else:
                found += (small == j) * ((bins[feature[j]] > cut[j]).view(np.uint8) + np.uint8(child[j]))
                below += [int(child[j]), int(child[j]) + 1]
        small, level = found, below
    node = (small if rows is None else small.take(rows)).astype(np.int64)
    if depth > TOP:
        flat = bins.T.ravel() if flat is None else flat
        begin = (np.arange(bins.shape[1]) if rows is None else rows) * len(bins)
    for _ in range(depth - TOP):
        where = feature.take(node)
        where += begin
        right = flat.take(where) > cut.take(node)
        node = child.take(node)
        node += right
    return node


def chances(rate: float, bootstrap: bool) -> np.ndarray | None:
    """The weight for each of 65,536 equal chances: Poisson for a bootstrap, else taken or not."""
    if not bootstrap and rate >= 1:
        return None
    if not bootstrap:
        return (np.arange(65536) < rate * 65536).astype(np.uint8)
    upto = np.cumsum([math.exp(-rate) * rate**k / math.factorial(k) for k in range(40)])
    return np.searchsorted(upto, (np.arange(65536) + 0.5) / 65536).astype(np.uint8)


def drawn(table: np.ndarray, seed: int, tree: int, part: int, number: int, rows: int) -> np.ndarray:
    raw = np.random.SFC64([seed & 0xFFFFFFFF, tree, part, number]).random_raw((rows + 3) // 4)
    return table.take(raw.view(np.uint16)[:rows])


@dataclass
class Plan:
    """What a fit was asked for."""

    depth: int
    least: int  # rows of a node
    gain: float
    seed: int
    bootstrap: bool
    rate: float
    subset: int  # features that a node may be split by
    bins: list[int]


def together(bins: Sequence[int], nodes: int) -> tuple[tuple[int, ...], ...]:
    """Features that are counted in one pass by all their bins at once: while nodes are few, their
    cells fit the cache, and the sums by single features follow from them."""
    groups: list[tuple[list[int], list[int]]] = []
    for f in sorted((f for f, b in enumerate(bins) if b > 1), key=lambda f: -bins[f]):
        for features, size in groups:
            if size[0] * bins[f] * nodes <= CELLS:
                features.append(f)
                size[0] *= bins[f]
                break
        else:
            groups.append(([f], [bins[f]]))
    return tuple(tuple(features) for features, _ in groups)


def _joined(bins: np.ndarray, features: Sequence[int], sizes: Sequence[int]) -> np.ndarray:
    out = bins[features[0]].astype(np.uint16)
    for f in features[1:]:
        out = out * np.uint16(sizes[f]) + bins[f]
    return out


def _sums(index: int, blocks: Iterable[tuple], asked: list[tuple], plan: Plan, level: int, origin: float) -> Iterator[tuple]:
    """For each tree and group of nodes: count and sum of the label (at the last level of its square too)
    by node and bin, then count, sum and sum of squares by node."""
    blocks = [(part, number, bins, bins.T.ravel(), y - origin, {}) for part, number, bins, y in blocks]
    table, width = chances(plan.rate, plan.bootstrap), len(plan.bins)
    kinds = 3 if level == plan.depth - 1 else 2
    for key, tree, feature, cut, child, nodes in asked:
        slot, m = np.full(len(feature), -1, np.int64), len(nodes)
        slot[nodes] = np.arange(m)
        groups = together(plan.bins, 1 << (m - 1).bit_length())
        sizes = [math.prod(plan.bins[f] for f in g) for g in groups]
        wide = max(sizes, default=1)
        sums, own = np.zeros((len(groups), kinds, m * wide)), np.zeros((3, m))
        for part, number, bins, flat, y, made in blocks:
            columns = [made.setdefault(g, None) for g in groups]
            for k, g in enumerate(groups):
                if columns[k] is None:
                    columns[k] = made[g] = _joined(bins, g, plan.bins)
            w = rows = None
            if table is not None:
                w = drawn(table, plan.seed, tree, part, number, len(y))
                rows = np.flatnonzero(w != 0)
            at = slot.take(places(bins, feature, cut, child, level, rows, flat)) if level else np.zeros(len(y) if rows is None else len(rows), np.int64)
            if m < 1 << level:  # some rows are in leaves, or in nodes of another group
                inside = np.flatnonzero(at >= 0)
                at, rows = at.take(inside), inside if rows is None else rows.take(inside)
            if rows is not None:
                y, columns = y.take(rows), [c.take(rows) for c in columns]
                w = None if w is None else w.take(rows).astype(float)
            wy = y if w is None else w * y
            moments = [w, wy, wy * y]
            for k in range(0 if not groups else kinds, 3):
                own[k] += np.bincount(at, moments[k], m)
            at *= wide
            for g, column in enumerate(columns):
                place = at + column
                for k in range(kinds):
                    sums[g, k] += np.bincount(place, moments[k], m * wide)
        cells = [np.zeros((kinds, m, b)) for b in plan.bins]
        for g, features in enumerate(groups):
            whole = sums[g].reshape(kinds, m, wide)[:, :, : sizes[g]]
            if not g:
                own[:kinds] += whole.sum(2)
            whole = whole.reshape(kinds, m, *[plan.bins[f] for f in features])
            for k, f in enumerate(features):
                cells[f] = whole.sum(tuple(2 + j for j in range(len(features)) if j != k)) if len(features) > 1 else whole
        yield key, (index, np.concatenate(cells, axis=2), own)


def best_splits(key: tuple[int, int], cells: np.ndarray, own: np.ndarray, plan: Plan, level: int, origin: float) -> tuple:
    """Sums, feature (-1: a leaf), cut, gain and the sums of both sides (as far as known) of each node."""
    n, s, q = own
    m = len(n)
    best, feature, cut = np.full(m, -np.inf), np.full(m, -1, np.int64), np.zeros(m, np.uint8)
    sides = np.zeros((m, 2, 3))
    allowed = None
    if plan.subset < len(plan.bins):
        order = np.random.default_rng([plan.seed & 0xFFFFFFFF, *key, level]).random((m, len(plan.bins))).argsort(1)
        allowed = order.argsort(1) < plan.subset
    whole, begin, rows = s * s / n, 0, np.arange(m)
    for f, b in enumerate(plan.bins):
        upto = np.cumsum(cells[:, :, begin : begin + b], axis=2)[:, :, :-1]
        begin += b
        if b < 2:
            continue
        left, right = upto[0], n[:, None] - upto[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = upto[1] ** 2 / left + (s[:, None] - upto[1]) ** 2 / right - whole[:, None]
        value[(left < max(plan.least, 1)) | (right < max(plan.least, 1))] = -np.inf
        if allowed is not None:
            value[~allowed[:, f]] = -np.inf
        k = value.argmax(1)
        found = value[rows, k]
        better = found > best
        best[better], feature[better], cut[better] = found[better], f, k[better]
        for kind in range(len(cells)):
            sides[better, 0, kind] = upto[kind][rows, k][better]
    sides[:, 1] = own.T - sides[:, 0]
    gain = best / n
    stays = ~(gain > 0) | (gain < plan.gain) | (q - whole <= 1e-12 * q)
    feature[stays] = -1
    shift = np.array([[1.0, origin, origin * origin], [0.0, 1.0, 2 * origin], [0.0, 0.0, 1.0]])
    return own.T @ shift, feature, cut, gain, sides @ shift


def _added(parts: Sequence[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """In the order of tasks, so that a repeated run gets the same sums."""
    parts = sorted(parts, key=lambda x: x[0])
    cells, own = parts[0][1].copy(), parts[0][2].copy()
    for _, a, b in parts[1:]:
        cells += a
        own += b
    return cells, own


def _reduced(found: Iterable[tuple], plan: Plan, level: int, origin: float) -> Iterator[tuple]:
    groups = defaultdict(list)
    for key, part in found:
        groups[key].append(part)
    for key in list(groups):
        yield key, best_splits(key, *_added(groups.pop(key)), plan, level, origin)


def grow(blocks: RDD, trees: Sequence[Tree], plan: Plan, rows: int, origin: float) -> None:
    """All trees, a level at a time."""
    tasks = blocks.getNumPartitions()
    for level in range(plan.depth):
        a_node = 8 * (3 if level == plan.depth - 1 else 2) * sum(plan.bins) * tasks
        jobs, size = [[]], 0
        for tree in trees:
            for g, begin in enumerate(range(0, len(tree.open), NODES)):
                nodes = tree.open[begin : begin + NODES]
                if size and size + a_node * len(nodes) > max(ROOM, 2 * rows):
                    jobs.append([])
                    size = 0
                size += a_node * len(nodes)
                jobs[-1].append(((tree.number, g), tree.number, tree.feature, tree.cut, tree.child, nodes))
        found = {}
        for asked in filter(None, jobs):
            sums = blocks.mapPartitionsWithIndex(partial(_sums, asked=asked, plan=plan, level=level, origin=origin))
            args = (plan, level, origin)
            if a_node * sum(len(x[-1]) for x in asked) <= SMALL:
                found |= _reduced(sums.collect(), *args)
                continue
            place = {key: k for k, (key, *_) in enumerate(asked)}
            met = sums.map(lambda x, place=place: (place[x[0]], x)).partitionBy(min(tasks, len(asked)), _same).values()
            best = met.mapPartitions(partial(_reduced, plan=plan, level=level, origin=origin))
            found |= best.collect()
            best._jrdd.rdd().cleanShuffleDependencies(False)
        for tree in trees:
            parts = [found[key] for key in sorted(k for k in found if k[0] == tree.number)]
            if parts:
                tree.split([np.concatenate(x) for x in zip(*parts, strict=True)])


def _rest(block: tuple, tree: Tree, depth: int, scale: float, step: float) -> tuple:
    """What a boosted tree leaves: the negative gradient of the squared error."""
    part, number, bins, y = block
    known = tree.values.take(places(bins, tree.feature, tree.cut, tree.child, depth))
    return part, number, bins, scale * y - 2.0 * step * known


# --- estimators -------------------------------------------------------------------------


def features_of_node(strategy: str, width: int, trees: int) -> int:
    """How many features a node may be split by, as the library reads its parameter."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "onethird"
    named = {"all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width))), "onethird": math.ceil(width / 3)}
    if strategy in named:
        return named[strategy]
    if strategy.isdigit():
        return min(int(strategy), width)
    return math.ceil(float(strategy) * width)


def _plan(est: Any, data: Binned, trees: int, bootstrap: bool) -> Plan:
    return Plan(
        depth=est.getMaxDepth(), least=est.getMinInstancesPerNode(), gain=est.getMinInfoGain(), seed=est.getSeed(),
        bootstrap=bootstrap, rate=est.getSubsamplingRate(), bins=data.bins,
        subset=features_of_node(est.getFeatureSubsetStrategy(), len(data.cuts), trees),
    )


def _beyond(est: Any, dataset: DataFrame) -> bool:
    """Whether something is asked for that only the library does."""
    odd = ["weightCol", "validationIndicatorCol"]
    kinds = dataset.schema[est.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
    return (
        not kinds.keys() <= {"numeric"}
        or any(est.hasParam(p) and est.isSet(p) for p in odd)
        or est.getMinWeightFractionPerNode() > 0
        or est.getMaxBins() > NEVER
        or est.getMaxDepth() < 1
        or (est.hasParam("lossType") and est.getOrDefault("lossType") != "squared")
    )


class BinnedForest(RandomForestRegressor):
    """A forest for the library's parameters."""

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        if _beyond(self, dataset):
            return super()._fit(dataset)
        data = binned(dataset, self.getFeaturesCol(), self.getLabelCol(), self.getMaxBins())
        try:
            trees = [Tree(k) for k in range(self.getNumTrees())]
            grow(data.blocks, trees, _plan(self, data, len(trees), self.getBootstrap()), data.rows, data.mean)
        finally:
            data.blocks.unpersist()
        return _model(dataset.sparkSession, self, ForestModel, data, trees, [1.0] * len(trees))


class BinnedBoosting(GBTRegressor):
    """Boosted trees of the squared error for the library's parameters."""

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        if _beyond(self, dataset):
            return super()._fit(dataset)
        spark, step = dataset.sparkSession, self.getStepSize()
        use_checkpoints(spark)
        data = binned(dataset, self.getFeaturesCol(), self.getLabelCol(), self.getMaxBins())
        plan = _plan(self, data, 1, False)
        trees, state, was, marked, every = [], data.blocks, None, None, self.getCheckpointInterval()
        try:
            for k in range(self.getMaxIter()):
                trees.append(tree := Tree(k))
                grow(state, [tree], plan, data.rows, 0.0 if k else data.mean)  # its first job makes `state`
                if was is not None:
                    was.unpersist()
                if state.is_checkpointed and state.isCheckpointed():
                    _drop(spark, marked)
                    marked = state.getCheckpointFile()
                if k + 1 == self.getMaxIter():
                    break
                scale, weight = (1.0, step) if k else (2.0, 1.0)
                was, state = state, state.map(partial(_rest, tree=tree, depth=plan.depth, scale=scale, step=weight))
                state.persist(StorageLevel.MEMORY_AND_DISK)
                if every > 0 and (k + 1) % every == 0:
                    state.checkpoint()
        finally:
            for kept in (was, state, data.blocks):
                if kept is not None:
                    kept.unpersist()
            _drop(spark, marked)
        weights = [1.0] + [step] * (len(trees) - 1)
        return _model(spark, self, BoostedModel, data, trees, weights)


def _drop(spark: SparkSession, path: str | None) -> None:
    """A checkpoint that a later one, or the end, has made useless."""
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _nodes(trees: Sequence[Tree], cuts: list[np.ndarray]) -> pa.Table:
    """The rows of the library's file of a model."""
    feature, cut, gain, stats, child = (np.concatenate([getattr(t, k) for t in trees]) for k in ("feature", "cut", "gain", "stats", "child"))
    node = np.concatenate([np.arange(len(t.feature)) for t in trees])
    leaf = child == node
    value = stats[:, 1] / stats[:, 0]
    impurity = np.maximum(stats[:, 2] / stats[:, 0] - value * value, 0.0)
    at = [float(cuts[f][c]) for f, c in zip(feature[~leaf], cut[~leaf], strict=True)]

    def listed(values: Any, begin: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(values, pa.float64()))

    split = {
        "featureIndex": pa.array(np.where(leaf, -1, feature), pa.int32()),
        "leftCategoriesOrThreshold": listed(at, np.concatenate([[0], np.cumsum(~leaf)])),
        "numCategories": pa.array(np.full(len(leaf), -1), pa.int32()),
    }
    columns = {
        "id": pa.array(node, pa.int32()),
        "prediction": pa.array(value),
        "impurity": pa.array(impurity),
        "impurityStats": listed(stats.ravel(), np.arange(len(leaf) + 1) * 3),
        "rawCount": pa.array(np.rint(stats[:, 0]).astype(np.int64)),
        "gain": pa.array(gain),
        "leftChild": pa.array(np.where(leaf, -1, child), pa.int32()),
        "rightChild": pa.array(np.where(leaf, -1, child + 1), pa.int32()),
        "split": pa.StructArray.from_arrays(list(split.values()), list(split)),
    }
    tree = np.concatenate([np.full(len(t.feature), k) for k, t in enumerate(trees)])
    data = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.table({"treeID": pa.array(tree, pa.int32()), "nodeData": data})


def _model(spark: SparkSession, est: Any, kind: type, data: Binned, trees: Sequence[Tree], weights: Sequence[float]) -> Any:
    """The library's model, by way of its file: its constructors are closed."""
    path = new_path(spark, "trees")
    given = {p.name: v for p, v in est._paramMap.items()}
    default = {p.name: v for p, v in est._defaultParamMap.items()}

    def about(name: str, uid: str, given: dict, default: dict, **more: Any) -> str:
        head = {"class": f"org.apache.spark.ml.regression.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
        return json.dumps(head | {"uid": uid, "paramMap": given, "defaultParamMap": default} | more)

    of_tree = ("featuresCol", "labelCol", "predictionCol", "maxDepth", "maxBins", "minInstancesPerNode", "minInfoGain", "seed", "checkpointInterval")
    one, usual = ({k: v for k, v in x.items() if k in of_tree} for x in (given, default))
    rows = [(k, about("DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", one, usual), float(w)) for k, w in enumerate(weights)]
    whole = about(kind.library.__name__, est.uid, given, default, numFeatures=len(data.cuts), numTrees=len(trees))
    nodes = _nodes(trees, data.cuts)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(rows, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes).write.parquet(f"{path}/data")
    return kind.of(kind.library.load(path), nodes)


# --- models -----------------------------------------------------------------------------


@dataclass
class Scorer:
    """Trees as arrays over bins of their own cuts."""

    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]  # feature, cut, child, share, depth

    def __call__(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(c, np.ascontiguousarray(x[:, k])).astype(np.uint8) for k, c in enumerate(self.cuts)])
        out = np.zeros(len(x))
        for feature, cut, child, share, depth in self.trees:
            out += share.take(places(bins, feature, cut, child, depth))
        return out

    def batches(self, held: Sequence[pa.Array]) -> Iterator[pa.Array]:
        """Several batches of vectors in one go, since a tree is fetched anew for each."""
        if any(map(len, held)):
            flat = [x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(self.cuts)) for x in held]
            out = self(np.concatenate(flat))
        begin = 0
        for x in held:
            yield pa.array(out[begin : begin + len(x)] if len(x) else np.zeros(0))
            begin += len(x)


def scorer(nodes: pa.Table, weights: Sequence[float], width: int) -> Scorer | None:
    """From the nodes of a saved model, in whatever order they are numbered; None if a feature has
    classes, or more cuts than a byte can tell apart."""
    data = nodes.column("nodeData").combine_chunks()
    tree = nodes.column("treeID").to_numpy()
    ids, left, right, value = (data.field(k).to_numpy() for k in ("id", "leftChild", "rightChild", "prediction"))
    split = data.field("split")
    if (split.field("numCategories").to_numpy() >= 0).any():
        return None
    feature, at = split.field("featureIndex").to_numpy(), np.full(len(tree), np.nan)
    at[left >= 0] = split.field("leftCategoriesOrThreshold").flatten().to_numpy()
    cuts = [np.unique(at[feature == f]) for f in range(width)]
    if max(map(len, cuts)) >= NEVER:
        return None
    trees = []
    for k, weight in enumerate(weights):
        rows = np.flatnonzero(tree == k)
        rows = rows[ids[rows].argsort()]
        l, r, depth, order = left[rows].tolist(), right[rows].tolist(), [0], [0]
        child = []
        for place, j in enumerate(order):  # children side by side, after their parents
            child.append(len(order) if l[j] >= 0 else place)
            if l[j] >= 0:
                order += [l[j], r[j]]
                depth += [depth[place] + 1] * 2
        rows = rows[order]
        leaf = left[rows] < 0
        named = np.where(leaf, 0, feature[rows]).astype(np.int64)
        cut = np.array([NEVER if x else cuts[f].searchsorted(v) for x, f, v in zip(leaf, named, at[rows], strict=True)], np.uint8)
        trees.append((named, cut, np.array(child, np.int64), value[rows] * weight, max(depth)))
    return Scorer(cuts, trees)


class _Scored:
    """A model of the library that scores batches of rows: tree after tree, not row after row."""

    library: type
    _scorer: Scorer | None = None

    @classmethod
    def of(cls, model: Any, nodes: pa.Table) -> Any:
        out = cls()
        out._scorer = scorer(nodes, cls.shares(model), model.numFeatures)
        out._java_obj, model._java_obj = model._java_obj, None  # it would end with `model`
        out._create_params_from_java()
        out._resetUid(model.uid)
        out._transfer_params_from_java()
        return out

    @classmethod
    def load(cls, path: str) -> Any:
        model = cls.library.load(path)
        return cls.of(model, SparkSession.active().read.parquet(f"{path}/data").toArrow())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = self._scorer
        if score is None or self.getOrDefault("leafCol"):
            return super()._transform(dataset)

        @F.arrow_udf("double")
        def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            held, size = [], 0
            for x in batches:
                held.append(x)
                size += len(x)
                if size >= BLOCK_ROWS:
                    yield from score.batches(held)
                    held, size = [], 0
            yield from score.batches(held)

        return dataset.withColumn(self.getPredictionCol(), predicted(vector_to_array(self.getFeaturesCol())))


class ForestModel(_Scored, RandomForestRegressionModel):
    library = RandomForestRegressionModel

    @staticmethod
    def shares(model: Any) -> list[float]:
        return [1.0 / model.getNumTrees] * model.getNumTrees


class BoostedModel(_Scored, GBTRegressionModel):
    library = GBTRegressionModel

    @staticmethod
    def shares(model: Any) -> list[float]:
        return list(model.treeWeights)
