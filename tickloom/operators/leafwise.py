"""Boosted trees that grow leaf by leaf, from histograms that Spark adds up.

Features become bin numbers once. For a tree, gradients are summed by node,
feature and bin where the rows lie; the sums, whose number is bounded by leaves,
features and bins, choose the splits. The leaf with the greatest gain is split
next. One pass counts the children of all leaves that may be split, so a tree
takes about as many passes as it is deep, not as many as it has leaves.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import exact
from tickloom.sources.scratch import stored

#: Trees whose margins are worked out anew in each pass before they are written.
PENDING = 8


@dataclass(frozen=True)
class Growth:
    """How trees grow."""

    rounds: int = 300
    leaves: int = 31
    rate: float = 0.05
    l2: float = 1.0
    least_rows: int = 200
    least_hessian: float = 1e-3
    row_share: float = 0.8
    column_share: float = 0.8
    bins: int = 255
    seed: int = 7


@dataclass
class Tree:
    """Nodes by number: ``feature`` -1 for a leaf, else rows with a bin up to ``cut`` go ``left``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> int:
        """Give ``node`` two leaves; the number of the left one, the right one follows."""
        child = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, child
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(0.0)
        return child

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row; children have larger numbers than their parents. A row is looked at once for each level above its leaf."""
        node = np.zeros(len(bins), dtype=np.int64)
        rows = {0: np.arange(len(bins))}
        for i, f in enumerate(self.feature):
            if f < 0:
                node[rows.pop(i)] = i
                continue
            here = rows.pop(i)
            right = bins[here, f] > self.cut[i]
            rows[self.left[i]], rows[self.left[i] + 1] = here[~right], here[right]
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass
class Leafwise:
    """A fitted model: bin edges of each feature, the base margin and the trees."""

    names: tuple[str, ...]
    edges: list[list[float]]
    base: float
    trees: list[Tree]

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        return binned(columns, self.edges)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return sum((t.values(bins) for t in self.trees), np.full(len(bins), self.base))

    def predict(self, rows: DataFrame, out: str) -> DataFrame:
        """``rows`` with the probability of 1 as ``out``; 0.5 where a feature is null or NaN."""
        sent = rows.sparkSession.sparkContext.broadcast(self)  # bounded by rounds and leaves

        def probability(columns: pd.DataFrame) -> pd.Series:
            values = [columns[c].to_numpy(dtype=float, na_value=np.nan) for c in columns.columns]
            whole = ~np.isnan(np.column_stack(values)).any(axis=1)
            p = 1 / (1 + np.exp(-sent.value.margin(sent.value.binned(values))))
            return pd.Series(np.where(whole, p, 0.5))

        used = F.struct(*(F.col(n).cast("double").alias(f"f{i}") for i, n in enumerate(self.names)))
        return rows.withColumn(out, F.pandas_udf(probability, "double")(used))

    def to_json(self) -> str:
        return json.dumps({"names": self.names, "edges": self.edges, "base": self.base, "trees": [asdict(t) for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Leafwise:
        said = json.loads(text)
        return cls(tuple(said["names"]), said["edges"], said["base"], [Tree(**t) for t in said["trees"]])


def binned(columns: list[np.ndarray], edges: list[list[float]]) -> np.ndarray:
    """Bin numbers: how many edges lie below a value; NaN is below all."""
    return np.column_stack([np.where(np.isnan(x), 0, np.searchsorted(np.array(e), x, side="left")) for x, e in zip(columns, edges, strict=True)]).astype(np.uint8)


def bin_edges(rows: DataFrame, names: tuple[str, ...], bins: int) -> list[list[float]]:
    """Up to ``bins - 1`` quantiles of each feature, without repeats; the largest value is no edge."""
    shares = [i / bins for i in range(1, bins)] + [1.0]
    found = exact.quantiles(rows, {n: shares for n in names})
    return [sorted({e for e in found[n][:-1] if e is not None and e < found[n][-1]}) for n in names]


def packed(bins: np.ndarray) -> pa.Array:
    """Rows of bin numbers as bytes, one value a row."""
    n, width = bins.shape
    ends = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bins, dtype=np.uint8))])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """What :func:`packed` made, read from the column's buffer; no value becomes an object."""
    if not len(column):
        return np.zeros((0, width), dtype=np.uint8)
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = int(np.frombuffer(ends, dtype=kind)[column.offset])
    return np.frombuffer(data, dtype=np.uint8, count=len(column) * width, offset=at).reshape(len(column), width)


def added(total: np.ndarray, bins: np.ndarray, slot: np.ndarray, weights: tuple[np.ndarray, ...]) -> None:
    """Add ``weights`` to ``total`` (``[slot, feature, bin, weight]``), one pass a feature over the rows of all slots."""
    slots, width, size, _ = total.shape
    first = slot * size
    for f in range(width):
        place = first + bins[:, f]
        for j, weight in enumerate(weights):
            total[:, f, :, j] += np.bincount(place, weight, minlength=slots * size).reshape(slots, size)


def sampled(key: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Rows that a tree learns from: a hash of key, tree and seed below ``share``."""
    if share >= 1:
        return np.ones(len(key), dtype=bool)
    mix = (seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = key.astype(np.int64).view(np.uint64) + np.uint64(mix)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) < share * (1 << 53)


def columns_of(n: int, tree: int, share: float, seed: int) -> list[int]:
    """Features that a tree may split on: at least one, chosen by the seed."""
    count = max(1, round(n * share))
    return sorted(np.random.default_rng([seed, tree]).permutation(n)[:count].tolist())


def histograms(rows: DataFrame, pending: list[Tree], tree: Tree, nodes: list[int], number: int, n_features: int, how: Growth) -> dict[int, np.ndarray]:
    """Sums of gradient, hessian and rows by feature and bin (``[feature, bin, 3]``) of some nodes of a growing tree.

    ``rows`` has ``key``, ``y``, ``bins`` and ``margin``, to which ``pending``
    trees are added. What reaches the driver is bounded by nodes, features and bins.
    """
    size = n_features * how.bins

    def part(batches):
        total = np.zeros((len(nodes), n_features, how.bins, 3))
        slots = np.full(len(tree.feature), -1, dtype=np.int64)
        slots[nodes] = np.arange(len(nodes))
        for batch in batches:
            key = batch.column(0).to_numpy()
            used = np.flatnonzero(sampled(key, number, how.row_share, how.seed))
            bins = unpacked(batch.column(2), n_features)[used]
            slot = slots[tree.leaf_of(bins)]
            own = np.flatnonzero(slot >= 0)  # margins are worked out for the rows that count
            bins, slot, rows = bins[own], slot[own], used[own]
            y = batch.column(1).to_numpy()[rows]
            margin = sum((t.values(bins) for t in pending), batch.column(3).to_numpy()[rows])
            p = 1 / (1 + np.exp(-margin))
            added(total, bins, slot, (p - y, p * (1 - p), np.ones(len(own))))
        total = total.reshape(len(nodes), size, 3)
        i, at = np.nonzero(total[:, :, 2])
        found = total[i, at]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(at.astype(np.int32)), *(pa.array(np.ascontiguousarray(found[:, j])) for j in range(3))], ["node", "place", "g", "h", "n"])

    sums = rows.select("key", "y", "bins", "margin").mapInArrow(part, "node int, place int, g double, h double, n double").groupBy("node", "place").agg(*(F.sum(c).alias(c) for c in ("g", "h", "n")))
    out = {node: np.zeros((size, 3)) for node in nodes}
    found = sums.toArrow()
    for i, node in enumerate(nodes):
        own = found.filter(pc.equal(found["node"], i))
        out[node][own["place"].to_numpy()] = np.column_stack([own[c].to_numpy() for c in ("g", "h", "n")])
    return {node: x.reshape(n_features, how.bins, 3) for node, x in out.items()}


def best_split(hist: np.ndarray, allowed: list[int], how: Growth) -> tuple[float, int, int]:
    """Gain, feature and cut of a node's best split; a gain of 0 if there is none. Of equal gains the first feature and bin."""
    best = (0.0, -1, 0)
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + how.l2)
    for f in allowed:
        left = np.cumsum(hist[f], axis=0)[:-1]
        whole = hist[f].sum(axis=0)
        right = whole - left
        ok = (left[:, 2] >= how.least_rows) & (right[:, 2] >= how.least_rows) & (left[:, 1] >= how.least_hessian) & (right[:, 1] >= how.least_hessian)
        if ok.any():
            gain = np.where(ok, score(left) + score(right) - score(whole), -np.inf)
            at = int(gain.argmax())
            if gain[at] > best[0] + 1e-9 * max(1.0, best[0]):
                best = (float(gain[at]), f, at)
    return best


def grow(rows: DataFrame, pending: list[Tree], number: int, n_features: int, how: Growth) -> Tree:
    """One tree: the leaf with the greatest gain is split until there are ``how.leaves`` leaves or none gains."""
    allowed = columns_of(n_features, number, how.column_share, how.seed)
    tree, trial = Tree(), Tree()  # trial: the same with all splits that have been counted ahead
    in_trial = {0: 0}  # node of the tree: its node in the trial
    hist = histograms(rows, pending, trial, [0], number, n_features, how)  # by node of the trial
    plans = {0: best_split(hist[0], allowed, how)}
    leaves = [0]
    while len(leaves) < how.leaves:
        gain, node = max(((plans[in_trial[x]][0], -x) for x in leaves), default=(0.0, 0))
        node = -node
        if gain <= 0:
            break
        if trial.feature[in_trial[node]] < 0:  # count the children of every leaf that may be split
            ahead = [x for x in leaves if trial.feature[in_trial[x]] < 0 and plans[in_trial[x]][0] > 0]
            lefts = {trial.split(in_trial[x], *plans[in_trial[x]][1:]): in_trial[x] for x in ahead}
            for child, found in histograms(rows, pending, trial, [*lefts], number, n_features, how).items():
                hist[child], hist[child + 1] = found, hist[lefts[child]] - found
                for x in (child, child + 1):
                    plans[x] = best_split(hist[x], allowed, how)
        at = in_trial[node]
        child = tree.split(node, trial.feature[at], trial.cut[at])
        in_trial[child], in_trial[child + 1] = trial.left[at], trial.left[at] + 1
        leaves = [x for x in leaves if x != node] + [child, child + 1]
    for x in leaves:
        g, h, _ = hist[in_trial[x]][0].sum(axis=0)
        tree.value[x] = float(-how.rate * g / (h + how.l2))
    return tree


def fit(rows: DataFrame, names: tuple[str, ...], keys: tuple[str, ...], y: str = "y", how: Growth = Growth()) -> Leafwise:
    """Boosted trees for a label of 0 and 1. Rows without a label are left out; ``keys`` name a row, for sampling."""
    if not 2 <= how.bins <= 256:
        raise ValueError("bins are bytes")
    width = len(names)
    chosen = rows.filter(F.col(y).isNotNull()).select(F.xxhash64(*keys).alias("key"), F.col(y).cast("double").alias("y"), *(F.col(n).cast("double").alias(n) for n in names))
    edges = bin_edges(chosen, names, how.bins)
    share = chosen.agg(F.avg("y")).first()[0]
    if share is None or not 0 < share < 1:
        raise ValueError("both labels are needed")
    base = math.log(share / (1 - share))

    def encode(batches):
        for batch in batches:
            bins = binned([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(width)], edges)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(bins), pa.array(np.full(batch.num_rows, base))], ["key", "y", "bins", "margin"])

    schema = "key long, y double, bins binary, margin double"
    held = stored(chosen.mapInArrow(encode, schema), "binned")
    trees, pending = [], []
    for number in range(how.rounds):
        tree = grow(held, pending, number, width, how)
        trees.append(tree)
        pending = [*pending, tree]
        if len(pending) == PENDING and number + 1 < how.rounds:
            held, pending = stored(held.mapInArrow(_advance(pending, width), schema), "margins"), []
    return Leafwise(tuple(names), edges, base, trees)


def _advance(trees: list[Tree], width: int):
    def rows(batches):
        for batch in batches:
            bins = unpacked(batch.column(2), width)
            margin = sum((t.values(bins) for t in trees), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margin)], ["key", "y", "bins", "margin"])

    return rows
