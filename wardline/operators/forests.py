"""Random forests over any number of rows.

Trees are grown on binned features, by weighted Gini impurity, from Poisson
bootstraps; every node draws its features.  Nodes of many rows are split from
sums of all trees, one Spark aggregate per level; a task finds the best split of
a tree's nodes.  As soon as a node has at most ``GROUP_ROWS`` sampled rows, these
rows are dealt to a group of their own (tree, node), and a task grows what is
below it.  Deep trees have nearly as many nodes as rows, so only the nodes above
the groups are held by the driver: what is below stays a stored table with a row
per group, and rows to be scored are dealt to the same groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.boosting import Bins, Joint, _code_type, _columns, binned, quantile_bins
from wardline.session import cut_lineage, stored_rows

#: Sampled rows that one task grows a part of a tree from, at most: a parameter.
GROUP_ROWS = 100_000
BINS = 32
#: Shares of rows that a Poisson bootstrap takes at most 0, 1, 2 ... times.
_POISSON = np.cumsum([np.exp(-1) / float(np.prod(np.arange(1, k + 1))) for k in range(12)])
_PARTS = 4096
#: Values of the codes that rows are dealt by: several features in two bytes.
DEALT_CELLS = 1 << 16


def drawn_times(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's bootstrap takes each row, the same in every pass."""
    x = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(((seed * 1_000_003 + tree) & 0xFFFFFFFF) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), side="right")


def purity(ones: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Weight times (1 - Gini impurity), from the weights of label 1 and of all."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(whole > 0, (ones ** 2 + (whole - ones) ** 2) / whole, 0.0)


def best_cuts(sums: np.ndarray, features: np.ndarray, leaf: int):
    """Per node the best cut: (gain, feature, last bin that goes left, sums of
    the left side), from nodes x drawn features x bins x (ones, all, rows)."""
    left = np.cumsum(sums, axis=2)
    whole = left[:, :1, -1:]
    right = whole - left
    can = (left[..., 2] >= leaf) & (right[..., 2] >= leaf)
    gain = np.where(can, purity(left[..., 0], left[..., 1]) + purity(right[..., 0], right[..., 1]) - purity(whole[..., 0], whole[..., 1]), -np.inf)
    flat = gain.reshape(len(sums), -1)
    at = flat.argmax(axis=1)
    node, (which, cut) = np.arange(len(sums)), np.divmod(at, sums.shape[2])
    return flat[node, at], features[node, which], cut, left[node, which, cut]


def drawn_features(rng: np.random.Generator, nodes: int, n_features: int, k: int) -> np.ndarray:
    return rng.random((nodes, n_features), np.float32).argpartition(k - 1, axis=1)[:, :k] if k < n_features else np.tile(np.arange(n_features), (nodes, 1))


@dataclass
class Part:
    """Nodes of a tree or of a part of one; the right child follows the left."""
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    ones: list = field(default_factory=lambda: [0.0])
    whole: list = field(default_factory=lambda: [0.0])
    rows: list = field(default_factory=lambda: [0.0])
    depth: list = field(default_factory=lambda: [0])
    closed: set = field(default_factory=set)  # nodes that no cut was found for

    def split(self, node: int, feature: int, cut: int, left: np.ndarray) -> None:
        total = np.array([self.ones[node], self.whole[node], self.rows[node]])
        self.feature[node], self.cut[node], self.left[node] = int(feature), int(cut), len(self.left)
        for s in (left, total - left):
            self.feature.append(-1), self.cut.append(0), self.left.append(-1), self.depth.append(self.depth[node] + 1)
            self.ones.append(float(s[0])), self.whole.append(float(s[1])), self.rows.append(float(s[2]))

    def place(self, columns: np.ndarray) -> np.ndarray:
        return placed(columns, np.array(self.feature), np.array(self.cut), np.array(self.left))


def placed(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The last node that each row (a column of bin numbers) comes to."""
    node = np.zeros(columns.shape[1], np.int64)
    rows = np.arange(columns.shape[1]) if left[0] >= 0 else np.zeros(0, np.int64)
    while len(rows):
        at = node[rows]
        node[rows] = left[at] + (columns[feature[at], rows] > cut[at])
        rows = rows[left[node[rows]] >= 0]
    return node


def grow_part(columns: np.ndarray, y: np.ndarray, w: np.ndarray, times: np.ndarray, depth: int, k: int, leaf: int, bins: int, rng: np.random.Generator,
              min_split: int = 0):
    """All nodes below a group's: (feature, cut, left, probability of label 1),
    level by level, from rows held in memory.  Nodes of fewer than ``min_split``
    rows stay leaves."""
    weight, ones = w * times, w * times * (y == 1)
    feature, cut, left, share = [np.array([-1])], [np.array([0])], [np.array([-1])], [np.zeros(1)]
    rows, slot, n, made = np.arange(len(y)), np.zeros(len(y), np.int64), 1, 1
    for level in range(depth + 1):
        whole, one = np.bincount(slot, weight[rows], n), np.bincount(slot, ones[rows], n)
        share[level][:] = np.divide(one, whole, out=np.zeros(n), where=whole > 0)
        mixed = (one > 0) & (one < whole)
        if min_split:
            mixed &= np.bincount(slot, times[rows], n) >= min_split
        if level == depth or not mixed.any():
            break
        # only nodes that hold both labels go on
        number = np.cumsum(mixed) - 1
        kept = mixed[slot]
        rows, slot, at, m = rows[kept], number[slot[kept]], np.flatnonzero(mixed), int(mixed.sum())
        features = drawn_features(rng, m, columns.shape[0], k)
        best = np.full(m, 1e-12 * whole[at])
        f, c = np.full(m, -1), np.zeros(m, np.int64)
        of_row, ones_of, times_of = weight[rows], ones[rows], times[rows]
        for j in range(features.shape[1]):
            drawn = features[:, j]
            key = slot * bins + columns[drawn[slot], rows]
            sums = np.stack([np.bincount(key, v, m * bins).reshape(m, 1, bins) for v in (ones_of, of_row, times_of)], axis=3)
            gain, _, where, _ = best_cuts(sums, drawn[:, None], leaf)
            better = gain > best
            best, f, c = np.where(better, gain, best), np.where(better, drawn, f), np.where(better, where, c)
        split = f >= 0
        if not split.any():
            break
        child = made + np.where(split, 2 * (np.cumsum(split) - 1), 0)
        feature[level][at], cut[level][at], left[level][at] = f, c, np.where(split, child, -1)
        kept = split[slot]
        rows, slot = rows[kept], slot[kept]
        slot = child[slot] - made + (columns[f[slot], rows] > c[slot])
        n = 2 * int(split.sum())
        made += n
        feature.append(np.full(n, -1)), cut.append(np.zeros(n, np.int64)), left.append(np.full(n, -1)), share.append(np.zeros(n))
    return tuple(np.concatenate(x) for x in (feature, cut, left, share))


_GROUP = "tree int, node int, n int, codes binary, y binary, w binary, times binary"
_MODEL = "tree int, node int, feature binary, cut binary, left binary, share binary"


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _matrix(group: pa.Table, kind: str, joint: Joint) -> np.ndarray:
    """Features x rows of a group's joint codes."""
    parts = [np.frombuffer(c, joint.kind).reshape(len(joint.sizes), -1) for c in group.column("codes").to_pylist()]
    return joint.columns(np.concatenate(parts, axis=1), kind)


@dataclass
class ForestClassifier:
    """``subset``: ``sqrt`` (rounded up), ``log2`` or ``all`` features a node,
    or ``features`` of them.  ``bins``: of the rows, where they are known."""
    label: str
    weight: str | None
    trees: int = 100
    depth: int = 30
    leaf: int = 1
    subset: str = "sqrt"
    seed: int = 42
    group_rows: int = GROUP_ROWS
    features: int | None = None
    min_split: int = 0
    bins: Bins | None = None

    def fit(self, df: DataFrame, vector_col: str = "features") -> "ForestModel":
        bins = self.bins or quantile_bins(df, vector_col, BINS)
        rows = binned(df, bins, vector_col, self.label, self.weight)
        n_features, kind, joint = len(bins.cuts), _code_type(bins), Joint(bins, DEALT_CELLS)
        k = self.features or {"sqrt": int(np.ceil(n_features ** 0.5)), "log2": max(1, int(np.ceil(np.log2(n_features)))), "all": n_features}[self.subset]
        tops = self._tops(rows, n_features, k, kind)
        # leaves already: of one label, too deep, or without a cut
        leaves = [{i for i, f in enumerate(top.feature) if f < 0 and (i in top.closed or top.depth[i] == self.depth or not 0 < top.ones[i] < top.whole[i])} for top in tops]
        seed, depth, leaf, min_split = self.seed, self.depth, self.leaf, self.min_split

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                columns, row, y, w = _columns(b.column("codes"), kind, n_features), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "y", "w"))
                codes, ones = joint.codes(columns), (y == 1).astype("<u1")
                for t, top in enumerate(tops):
                    times = drawn_times(row, t, seed)
                    at = np.flatnonzero((times > 0) & (w > 0))
                    place = top.place(columns[:, at]) if top.left[0] >= 0 else np.zeros(len(at), np.int64)
                    for node, some in _by_node(place, at):
                        if node in leaves[t]:
                            continue
                        yield pa.record_batch([[t], [node], [len(some)], *([x.tobytes()] for x in (codes[:, some], ones[some], w[some], times[some].astype("<u1")))],
                                              schema=_arrow(_GROUP))

        def below(group: pa.Table) -> pa.Table:
            t, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
            columns = _matrix(group, kind, joint)
            y, w, times = _joined(group.column("y"), "<u1"), _joined(group.column("w"), "<f8"), _joined(group.column("times"), "<u1").astype(float)
            found = grow_part(columns, y, w, times, depth - tops[t].depth[node], k, leaf, BINS, np.random.default_rng((seed, t, node)), min_split)
            return pa.table([[t], [node], *([x.astype(d).tobytes()] for x, d in zip(found, ("<i4", "<u4", "<i4", "<f8")))], schema=_arrow(_MODEL))

        count = min(_PARTS, sum(f < 0 for top in tops for f in top.feature))
        groups = rows.mapInArrow(deal, _GROUP).repartition(count, "tree", "node").groupBy("tree", "node")
        alone = [(t, i, *(np.array([v], d).tobytes() for v, d in ((-1, "<i4"), (0, "<u4"), (-1, "<i4"), (tops[t].ones[i] / max(tops[t].whole[i], 1e-300), "<f8"))))
                 for t, some in enumerate(leaves) for i in sorted(some)]
        parts = groups.applyInArrow(below, _MODEL)
        return ForestModel(bins, tops, stored_rows(parts.unionByName(df.sparkSession.createDataFrame(alone, _MODEL)) if alone else parts))

    def _tops(self, rows: DataFrame, n_features: int, k: int, kind: str) -> list[Part]:
        """The nodes above the groups, all trees a level at a time."""
        tops, seed, leaf, most = [Part() for _ in range(self.trees)], self.seed, self.leaf, self.group_rows
        n = rows.count()
        for top in tops:  # until its sums are known, a root counts as all rows
            top.ones[0], top.whole[0], top.rows[0] = 0.5, 1.0, float(n)
        rng = np.random.default_rng(self.seed)
        for level in range(self.depth):
            wanted = {t: [i for i, d in enumerate(top.depth) if d == level and top.rows[i] > most and 0 < top.ones[i] < top.whole[i]] for t, top in enumerate(tops)}
            wanted = {t: nodes for t, nodes in wanted.items() if nodes}
            if not wanted:
                break
            features = {t: drawn_features(rng, len(nodes), n_features, k) for t, nodes in wanted.items()}

            def sums(batches: Iterator[pa.RecordBatch], wanted=wanted, features=features) -> Iterator[pa.RecordBatch]:
                total = {t: np.zeros((len(nodes) * BINS * k, 3)) for t, nodes in wanted.items()}
                for b in batches:
                    if not b.num_rows:
                        continue
                    columns, row, y, w = _columns(b.column("codes"), kind, n_features), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "y", "w"))
                    for t, nodes in wanted.items():
                        slot = np.full(len(tops[t].left), -1)
                        slot[nodes] = np.arange(len(nodes))
                        times = drawn_times(row, t, seed)
                        at = np.flatnonzero((times > 0) & (w > 0))
                        s = slot[tops[t].place(columns[:, at])]
                        at, s = at[s >= 0], s[s >= 0]
                        times, weight = times[at].astype(float), w[at] * times[at]
                        ones = weight * (y[at] == 1)
                        for j in range(k):
                            key = (s * k + j) * BINS + columns[features[t][s, j], at]
                            for i, v in enumerate((ones, weight, times)):
                                total[t][:, i] += np.bincount(key, v, len(total[t]))
                for t, part in total.items():
                    yield pa.record_batch([[t], [part.tobytes()]], schema=_arrow("tree int, sums binary"))

            def cuts(group: pa.Table) -> pa.Table:
                t = group.column("tree")[0].as_py()
                m = len(wanted[t])
                total = sum(np.frombuffer(x.as_buffer(), "<f8") for x in group.column("sums")).reshape(m, k, BINS, 3)
                gain, f, cut, left = best_cuts(total, features[t], leaf)
                whole = total[:, 0].sum(axis=1)
                return pa.table([[t] * m, wanted[t], gain > 1e-12 * whole[:, 1], f.astype(np.int32), cut.astype(np.int32), list(left), list(whole)],
                                schema=_arrow("tree int, node int, split boolean, feature int, cut int, left array<double>, whole array<double>"))

            parts = rows.mapInArrow(sums, "tree int, sums binary").repartition(len(wanted), "tree").groupBy("tree")
            for r in parts.applyInArrow(cuts, "tree int, node int, split boolean, feature int, cut int, left array<double>, whole array<double>").collect():
                top = tops[r.tree]
                top.ones[r.node], top.whole[r.node], top.rows[r.node] = r.whole
                if r.split:
                    top.split(r.node, r.feature, r.cut, np.array(r.left))
                else:
                    top.closed.add(r.node)
        return tops


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])


def _by_node(node: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(node, kind="stable")
    first = np.flatnonzero(np.diff(node[order], prepend=-1))
    for a, b in zip(first, np.append(first[1:], len(order))):
        yield int(node[order[a]]), at[order[a:b]]


@dataclass
class ForestModel:
    bins: Bins
    tops: list[Part]
    parts: DataFrame  # a stored row per group: the nodes below it

    def score(self, df: DataFrame, keep: Sequence[str], vector_col: str = "features", threshold: float = 0.5) -> DataFrame:
        """``(*keep, probability, prediction)``: the trees' shares of label 1,
        averaged."""
        bins, tops, kind, joint = self.bins, self.tops, _code_type(self.bins), Joint(self.bins, DEALT_CELLS)
        rows = cut_lineage(df.select(*keep, F.monotonically_increasing_id().alias("__row"), vector_to_array(vector_col).alias("__x")))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                columns = np.ascontiguousarray((bins.codes(x) - bins.first[:-1]).astype(kind).T)
                row, codes = b.column("__row").to_numpy(), joint.codes(columns)
                for t, top in enumerate(tops):
                    for node, some in _by_node(top.place(columns), np.arange(len(row))):
                        yield pa.record_batch([[t], [node], [codes[:, some].tobytes()], [row[some].tobytes()]], schema=_arrow("tree int, node int, codes binary, rows binary"))

        def found(model: pa.Table, group: pa.Table) -> pa.Table:
            if not group.num_rows or not model.num_rows:
                return pa.table([[], []], schema=_arrow("__row long, share double"))
            feature, cut, left, share = (np.frombuffer(model.column(c)[0].as_buffer(), d) for c, d in (("feature", "<i4"), ("cut", "<u4"), ("left", "<i4"), ("share", "<f8")))
            return pa.table([_joined(group.column("rows"), "<i8"), share[placed(_matrix(group, kind, joint), feature, cut, left)]], schema=_arrow("__row long, share double"))

        parts = min(_PARTS, sum(f < 0 for top in tops for f in top.feature))
        dealt = rows.select("__row", "__x").mapInArrow(deal, "tree int, node int, codes binary, rows binary").repartition(parts, "tree", "node")
        model = self.parts.repartition(parts, "tree", "node")
        shares = model.groupBy("tree", "node").cogroup(dealt.groupBy("tree", "node")).applyInArrow(found, "__row long, share double")
        p = shares.groupBy("__row").agg((F.sum("share") / len(tops)).alias("probability"))
        out = rows.drop("__x").join(p, "__row")
        return out.select(*keep, "probability", (F.col("probability") >= threshold).cast("int").alias("prediction"))
