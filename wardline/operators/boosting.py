"""Second-order boosted trees on binned features (M11, X9), and averaged trees
on the same histograms (M10).

Features are cut into at most ``bins`` quantile bins, once.  A tree grows level
by level from the sums of gradients and Hessians per (node, bin); the split gain
and the leaf values are those of the regularised second-order objective
(Chen & Guestrin 2016): ``-T(G) / (H + lambda)`` with ``T`` the soft threshold
by ``alpha``.  With the loss ``residual`` trees are fitted to the first-order
residuals alone, ``4 y / (1 + exp(2 y F))`` for labels -1 and 1, and leaves are
their weighted means (Friedman 2001, as in Spark's own gradient-boosted trees).
The sums come either from one Spark aggregate per level over the
stored binned rows (``fit_spark``; the driver holds two tree levels of sums), or
from arrays within one task (``fit_rows``, and ``fit_columns`` for the many fits
of a search), for bounded row sets.  All grow the same trees from the same sums."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.trees import Forest
from wardline.session import cut_lineage

MAX_BINS = 64
#: Rounds between reliable checkpoints of the margins.
CHECKPOINT_EVERY = 10
#: Cells of features that are counted together, and where there are fewer than
#: ``FINE_ROWS`` rows a node, so that rows and not cells make the work.
JOINT_CELLS = 1024
FINE_CELLS = 64
FINE_ROWS = 2000
#: Rows of a block that is passed to a task's sums at once, and of a task's
#: blocks (fewer where cores would be idle): a pass is short, so tasks are few.
BLOCK_ROWS = 1 << 17
PART_ROWS = 1 << 20


@dataclass(frozen=True)
class Params:
    """``max_depth`` None: until nothing can be split.  ``features``: share of
    the features that a node may split on (forests; 1.0: all)."""
    rounds: int = 100
    max_depth: int | None = 6
    rate: float = 0.3
    subsample: float = 1.0
    columns: float = 1.0
    min_child_weight: float = 1.0
    gamma: float = 0.0
    alpha: float = 0.0
    lam: float = 1.0
    features: float = 1.0
    min_split: int = 2
    min_leaf: int = 1
    loss: str = "logistic"  # logistic, residual, squared, or mean: independent trees of weighted means
    seed: int = 42


class Bins:
    """Cut points per feature; bin ``k`` holds ``cuts[k-1] < x <= cuts[k]``, the
    last one everything above (and NaN).  ``first``: where a feature's bins
    begin among all bins."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts = cuts
        sizes = np.array([len(c) + 1 for c in cuts], np.int64)
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.total = int(self.first[-1])
        self.feature = np.repeat(np.arange(len(cuts)), sizes)
        self.last = np.zeros(self.total, bool)
        self.last[self.first[1:] - 1] = True

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers (rows x features) among all bins."""
        out = np.empty(x.shape, np.int32)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.searchsorted(cuts, x[:, f], side="left") + self.first[f]
        return out

    def threshold(self, t: int) -> float:
        f = self.feature[t]
        return float(self.cuts[f][t - self.first[f]])


def quantile_bins(df: DataFrame, vector_col: str, bins: int = MAX_BINS, accuracy: int = 2000) -> Bins:
    """Cut points at approximate quantiles, in one aggregate over the rows; a
    feature of few distinct values has a bin for each."""
    n = len(df.select(vector_col).first()[0])
    x = df.select(vector_to_array(vector_col).alias("x"))
    probs = [k / bins for k in range(1, bins)] + [1.0]
    row = x.agg(*[F.percentile_approx(F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]), probs, accuracy).alias(f"q{i}") for i in range(n)]).first()
    return Bins([np.unique(np.array(row[i] or [0.0]))[:-1] for i in range(n)])


NODE = "feature int, cut int, left int, right int, value double, cover double, threshold double"


# -- growing one tree -------------------------------------------------------------
@dataclass
class Tree:
    feature: np.ndarray    # -1 at leaves
    cut: np.ndarray        # last bin (among all bins) that goes left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray      # Hessian sum
    threshold: np.ndarray

    def leaf_of(self, goes_left: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> np.ndarray:
        """Leaf per row; ``goes_left(rows, nodes)`` decides."""
        node = np.zeros(n, np.int64)
        rows = np.arange(n) if self.left[0] >= 0 else np.zeros(0, np.int64)
        while len(rows):
            at = node[rows]
            node[rows] = np.where(goes_left(rows, at), self.left[at], self.right[at])
            rows = rows[self.left[node[rows]] >= 0]
        return node

    def of_codes(self, codes: np.ndarray) -> np.ndarray:
        return self.leaf_of(lambda rows, at: codes[rows, self.feature[at]] <= self.cut[at], len(codes))

    def of_values(self, x: np.ndarray) -> np.ndarray:
        return self.leaf_of(lambda rows, at: x[rows, self.feature[at]] <= self.threshold[at], len(x))


def soft(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaf_value(g, h, p: Params):
    return -soft(g, p.alpha) / (h + p.lam) if p.loss != "mean" else -g / np.maximum(h, 1e-12)


def _objective(g, h, p: Params):
    return soft(g, p.alpha) ** 2 / np.maximum(h + p.lam, 1e-300) if p.loss != "mean" else g ** 2 / np.maximum(h, 1e-12)


def best_splits(sums: np.ndarray, bins: Bins, p: Params, allowed: np.ndarray):
    """(gain, bin, left sums) per node from ``sums``: nodes x bins x
    (G, H, rows).  ``allowed``: nodes x bins."""
    run = np.cumsum(sums, axis=1)
    before = np.concatenate([np.zeros_like(run[:, :1]), run], axis=1)[:, bins.first[:-1]]
    left = run - before[:, bins.feature]
    whole = run[:, bins.first[1] - 1][:, None]
    right = whole - left
    can = allowed & ~bins.last & (left[..., 2] >= p.min_leaf) & (right[..., 2] >= p.min_leaf) & (whole[..., 2] >= p.min_split)
    if p.loss != "mean":
        can &= (left[..., 1] >= p.min_child_weight) & (right[..., 1] >= p.min_child_weight)
    gain = _objective(left[..., 0], left[..., 1], p) + _objective(right[..., 0], right[..., 1], p) - _objective(whole[..., 0], whole[..., 1], p)
    gain = np.where(can, gain, -np.inf)
    at = gain.argmax(axis=1)
    rows = np.arange(len(sums))
    return gain[rows, at], at, left[rows, at], whole[:, 0]


def grow(histograms: Callable[[list[int], Tree], np.ndarray], bins: Bins, p: Params, rng: np.random.Generator, siblings: bool = False) -> Tree:
    """One tree.  ``histograms(frontier, tree)`` gives the sums of the frontier's
    nodes; rows find their node by the tree so far.  Nodes whose gain stays
    under ``gamma`` are cut back from the leaves up.  ``siblings``: of two
    siblings only the one of fewer rows is asked for; the other's sums are what
    it leaves of their parent's."""
    n_features = len(bins.cuts)
    feature, cut, left, right, total, gains = [-1], [-1], [-1], [-1], [None], [0.0]
    columns = np.zeros(n_features, bool)
    columns[rng.permutation(n_features)[:max(1, round(p.columns * n_features))]] = True
    frontier, depth = [0], 0
    parent, above = {}, {}  # node -> parent; sums of the level above

    def so_far() -> Tree:
        none = np.zeros(len(feature))
        return Tree(np.array(feature), np.array(cut), np.array(left), np.array(right), none, none, none)

    def level_sums() -> np.ndarray:
        if not siblings or not above:
            return histograms(frontier, so_far())
        ups = sorted({parent[i] for i in frontier})
        small = {u: left[u] if total[left[u]][2] <= total[right[u]][2] else right[u] for u in ups}
        found = dict(zip(ups, histograms([small[u] for u in ups], so_far())))
        return np.stack([found[parent[i]] if small[parent[i]] == i else above[parent[i]] - found[parent[i]] for i in frontier])

    while frontier:
        sums = level_sums()
        if siblings:
            above = dict(zip(frontier, sums))
        allowed = np.broadcast_to(columns[bins.feature], (len(frontier), bins.total))
        if p.features < 1:
            draw = rng.random((len(frontier), n_features))
            k = max(1, int(p.features * n_features))
            allowed = allowed & (draw <= np.partition(draw, k - 1, axis=1)[:, k - 1:k])[:, bins.feature]
        gain, at, left_sums, whole = best_splits(sums, bins, p, allowed)
        below = []
        for i, node in enumerate(frontier):
            total[node] = whole[i]
            if gain[i] > 1e-6 and (p.max_depth is None or depth < p.max_depth):
                feature[node], cut[node], gains[node] = int(bins.feature[at[i]]), int(at[i]), float(gain[i])
                left[node], right[node] = len(feature), len(feature) + 1
                for s in (left_sums[i], whole[i] - left_sums[i]):
                    feature.append(-1), cut.append(-1), left.append(-1), right.append(-1), total.append(s), gains.append(0.0)
                parent[left[node]] = parent[right[node]] = node
                below += [left[node], right[node]]
        depth += 1
        last = p.max_depth is not None and depth >= p.max_depth
        # a node that cannot give both children enough needs no sums
        least = (0.0 if p.loss == "mean" else 2 * p.min_child_weight, max(p.min_split, 2 * p.min_leaf))
        frontier = [] if last else [i for i in below if total[i][1] >= least[0] and total[i][2] >= least[1]]
    for node in range(len(feature) - 1, -1, -1):
        if left[node] >= 0 and left[left[node]] < 0 and left[right[node]] < 0 and gains[node] < p.gamma:
            feature[node], cut[node], left[node], right[node] = -1, -1, -1, -1
    sums = np.array(total)
    threshold = np.array([bins.threshold(c) if c >= 0 else 0.0 for c in cut])
    rate = p.rate if p.loss != "mean" else 1.0
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(right), rate * leaf_value(sums[:, 0], sums[:, 1], p), sums[:, 1], threshold)


def of_round(p: Params, r: int) -> Params:
    """``residual`` starts from a whole tree of the labels as -1 and 1, which
    are half the first residuals."""
    return dataclasses.replace(p, rate=0.5) if p.loss == "residual" and r == 0 else p


def gradients(y: np.ndarray, w: np.ndarray, margin: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    if loss == "logistic":
        q = 1 / (1 + np.exp(-margin))
        return w * (q - y), w * np.maximum(q * (1 - q), 1e-16)
    if loss == "residual":
        side = 2 * y - 1
        return -4 * w * side / (1 + np.exp(np.clip(2 * side * margin, -700, 700))), w
    return (w * (margin - y), w) if loss == "squared" else (-w * y, w)


# -- within one task ----------------------------------------------------------------
class Entries:
    """The bins of bounded rows.  A feature's most frequent bin is left out:
    its sums follow from the node's."""

    def __init__(self, codes: np.ndarray, bins: Bins):
        counts = np.bincount(codes.ravel(), minlength=bins.total)
        self.default = np.array([bins.first[f] + counts[bins.first[f]:bins.first[f + 1]].argmax() for f in range(len(bins.cuts))])
        kept = codes != self.default
        self.row, _ = np.nonzero(kept)
        self.code, self.codes, self.bins = codes[kept].astype(np.int64), codes, bins

    def sums(self, values: Sequence[np.ndarray], slot: np.ndarray, n: int) -> np.ndarray:
        """Nodes x bins x values; rows of slot ``n`` belong to no node."""
        t = self.bins.total
        at = slot[self.row] * t + self.code
        out = np.empty((n, t, len(values)))
        for k, v in enumerate(values):
            part = np.bincount(at, v[self.row], (n + 1) * t).reshape(n + 1, t)[:n]
            whole = np.bincount(slot, v, n + 1)[:n]
            part[:, self.default] = whole[:, None] - np.add.reduceat(part, self.bins.first[:-1], axis=1)
            out[..., k] = part
        return out


def fit_rows(codes: np.ndarray, bins: Bins, y: np.ndarray, w: np.ndarray, p: Params, each: Callable[[int, np.ndarray], None] | None = None) -> list[Tree]:
    """All trees from rows held in memory.  Rows of weight 0 are not learned
    from but are scored: ``each(round, margin)`` sees the margins (for ``mean``
    the summed tree values) after every tree."""
    entries, rng = Entries(codes, bins), np.random.default_rng(p.seed)
    margin, trees, learned = np.zeros(len(y)), [], w > 0
    for r in range(p.rounds):
        share = learned.astype(float)
        if p.loss == "mean":  # bootstrap
            picked = np.flatnonzero(learned)
            share = np.bincount(rng.choice(picked, len(picked)), minlength=len(y)).astype(float) if len(picked) else share
        elif p.subsample < 1:
            share *= rng.random(len(y)) < p.subsample
        g, h = gradients(y, w, margin, p.loss)
        values = [g * share, h * share, share]
        place = np.zeros(len(y), np.int64)

        def histograms(frontier: list[int], tree: Tree) -> np.ndarray:
            at = np.flatnonzero(tree.left[place] >= 0)
            while len(at):  # one step a level
                node = place[at]
                place[at] = np.where(codes[at, tree.feature[node]] <= tree.cut[node], tree.left[node], tree.right[node])
                at = at[tree.left[place[at]] >= 0]
            slot = np.full(len(tree.left), len(frontier))
            slot[frontier] = np.arange(len(frontier))
            return entries.sums(values, slot[place], len(frontier))

        tree = grow(histograms, bins, of_round(p, r), rng)
        trees.append(tree)
        margin += tree.value[tree.of_codes(codes)]
        if each:
            each(r + 1, margin)
    return trees


# -- by Spark aggregates --------------------------------------------------------------
def _code_type(bins: Bins) -> str:
    """The narrowest unsigned type that a feature's bin numbers fit."""
    most = int(np.diff(bins.first).max(initial=1)) - 1
    return next(t for t in ("<u1", "<u2", "<u4") if most <= np.iinfo(t).max)


def binned(df: DataFrame, bins: Bins, vector_col: str, label: str, weight: str | None, keep: Sequence[str] = ()) -> DataFrame:
    """``row, y, w, *keep, codes`` (a feature's own bin numbers, side by side), checkpointed."""
    kind, passed = _code_type(bins), ["row", "y", "w", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                codes = (bins.codes(x) - bins.first[:-1]).astype(kind)
                yield pa.record_batch([*(b.column(c) for c in passed), pa.array([c.tobytes() for c in codes], pa.binary())], names=[*passed, "codes"])

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(label).cast("double").alias("y"), w.alias("w"), *keep, vector_to_array(vector_col).alias("x"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema) if keep else ""
    return cut_lineage(rows.where("y IS NOT NULL").mapInArrow(run, f"row long, y double, w double, {kept}codes binary"))


def _columns(column: pa.Array, kind: str, n_features: int) -> np.ndarray:
    """Features x rows of the stored codes, each feature's side by side."""
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, "<i4", 1, 4 * column.offset)[0]
    flat = np.frombuffer(data, kind, len(column) * n_features, first)
    return np.ascontiguousarray(flat.reshape(len(column), n_features).T)


class Joint:
    """Features side by side in one code, as many as have together at most
    ``cells`` values: sums over a code's values hold those over each of its
    features' bins.  ``forms``: what is counted together, (code, its values' part
    of it or None, features, size), by whole codes and by parts of at most
    ``fine`` values."""

    def __init__(self, bins: Bins, cells: int = JOINT_CELLS, fine: int = FINE_CELLS):
        self.bins, sizes = bins, np.diff(bins.first)
        self.members: list[list[int]] = []
        self.sizes: list[int] = []
        for f in np.argsort(-sizes, kind="stable").tolist():
            at = next((g for g, size in enumerate(self.sizes) if size * sizes[f] <= cells), len(self.sizes))
            if at == len(self.sizes):
                self.members.append([])
                self.sizes.append(1)
            self.members[at].append(f)
            self.sizes[at] *= int(sizes[f])
        self.kind = next(t for t in ("<u1", "<u2", "<u4") if max(self.sizes) - 1 <= np.iinfo(t).max)
        self.of, self.stride = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        for g, members in enumerate(self.members):
            self.of[members], self.stride[members] = g, np.cumprod([1, *sizes[members[:-1]]])
        whole = [(g, None, members, size) for g, (members, size) in enumerate(zip(self.members, self.sizes))]
        parts = []
        for g, members in enumerate(self.members):
            some: list[int] = []
            for k, f in enumerate(members):
                some.append(f)
                size = int(np.prod(sizes[some]))
                if k + 1 == len(members) or size * sizes[members[k + 1]] > fine:
                    parts.append((g, np.arange(self.sizes[g]) // self.stride[some[0]] % size, some, size))
                    some = []
        self.forms = whole, parts

    def codes(self, columns: np.ndarray) -> np.ndarray:
        """Codes x rows from a feature's own bin numbers (features x rows)."""
        out = np.zeros((len(self.sizes), columns.shape[1]), self.kind)
        for f, column in enumerate(columns):
            out[self.of[f]] += column.astype(self.kind) * np.array(self.stride[f], self.kind)
        return out

    def columns(self, codes: np.ndarray, kind: str) -> np.ndarray:
        """A feature's own bin numbers, features x rows, from joint codes."""
        sizes = np.diff(self.bins.first)
        out = np.empty((len(sizes), codes.shape[1]), kind)
        for code, members in zip(codes, self.members):
            for f in members:
                rest = code // np.array(sizes[f], self.kind) if sizes[f] <= np.iinfo(self.kind).max else np.zeros_like(code)
                out[f] = code - rest * np.array(sizes[f] if rest.any() else 0, self.kind)
                code = rest
        return out

    def goes_left(self, tree: Tree) -> np.ndarray:
        """Nodes x values: whether a row of that code goes left."""
        out = np.zeros((len(tree.left), max(self.sizes)), bool)
        sizes = np.diff(self.bins.first)
        for node in np.flatnonzero(tree.left >= 0):
            f = tree.feature[node]
            values = np.arange(self.sizes[self.of[f]])
            out[node, :len(values)] = values // self.stride[f] % sizes[f] <= tree.cut[node] - self.bins.first[f]
        return out

    def leaves(self, tree: Tree, codes: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Leaf of each row, or of each of ``rows``."""
        to_left, group = self.goes_left(tree), self.of[np.maximum(tree.feature, 0)]
        of = (lambda at: at) if rows is None else (lambda at: rows[at])
        return tree.leaf_of(lambda at, node: to_left[node, codes[group[node], of(at)]], codes.shape[1] if rows is None else len(rows))

    def sums(self, n: int, blocks: Iterator[tuple[np.ndarray, ...]]) -> np.ndarray:
        """Nodes x bins x (G, H, rows) of blocks (codes, rows, their nodes, g, h)."""
        total, form = [], self.forms[0]
        for codes, at, slot, g, h in blocks:
            if not total:
                form = self.forms[len(at) < FINE_ROWS * n]
                total = [np.zeros((3, n * size)) for *_, size in form]
            of, own, base = -1, None, {size: slot * size for size in {size for *_, size in form}}
            for t, (group, part, _, size) in zip(total, form):
                if group != of:
                    of, own = group, codes[group][at]
                cells = base[size] + (own if part is None else part[own])
                t[0] += np.bincount(cells, g, t.shape[1])
                t[1] += np.bincount(cells, h, t.shape[1])
                t[2] += np.bincount(cells, None, t.shape[1])
        sizes, first = np.diff(self.bins.first), self.bins.first
        out = np.zeros((3, n, self.bins.total))
        for t, (_, _, members, _) in zip(total, form):
            rest = t.reshape(3, n, -1)
            for f in members:
                rest = rest.reshape(3, n, -1, sizes[f])
                out[..., first[f]:first[f + 1]] = rest.sum(axis=2)
                rest = rest.sum(axis=3)
        return np.ascontiguousarray(np.moveaxis(out, 0, 2))


def fit_columns(codes: np.ndarray, joint: Joint, y: np.ndarray, w: np.ndarray, p: Params, each: Callable[[int, np.ndarray], None]) -> list[Tree]:
    """All trees from joint codes held in memory, as ``fit_rows``, for many rows."""
    rng, margin, trees, learned = np.random.default_rng(p.seed), np.zeros(len(y)), [], np.flatnonzero(w > 0)
    for r in range(p.rounds):
        picked = rng.random(len(learned)) < p.subsample if p.subsample < 1 else np.ones(len(learned), bool)
        rows = learned[picked]
        g, h = gradients(y[rows], w[rows], margin[rows], p.loss)
        place = np.zeros(len(rows), np.int64)

        def go_on(tree: Tree) -> None:
            at = np.flatnonzero(tree.left[place] >= 0)
            to_left, group = joint.goes_left(tree), joint.of[np.maximum(tree.feature, 0)]
            while len(at):
                node = place[at]
                place[at] = np.where(to_left[node, codes[group[node], rows[at]]], tree.left[node], tree.right[node])
                at = at[tree.left[place[at]] >= 0]

        def histograms(frontier: list[int], tree: Tree) -> np.ndarray:
            go_on(tree)
            n = len(frontier)
            slot = np.full(len(tree.left), n)
            slot[frontier] = np.arange(n)
            slot = slot[place]
            at = np.flatnonzero(slot < n)
            return joint.sums(n, iter([(codes, rows[at], slot[at], g[at], h[at])]))

        tree = grow(histograms, joint.bins, of_round(p, r), rng, siblings=True)
        trees.append(tree)
        margin += tree.value[joint.leaves(tree, codes)]
        each(r + 1, margin)
    return trees


def _kept(row: np.ndarray, share: float, seed: int, r: int) -> np.ndarray:
    """A row's draw for round ``r``, the same in every pass over the rows."""
    x = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + r) & 0xFFFFFFFF) * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53) < share


def _blocks(rows: DataFrame, kind: str, joint: Joint) -> RDD:
    """Blocks of binned rows, one an element: (row, y, w, joint codes)."""
    n_features = len(joint.of)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def block() -> pa.RecordBatch:
            whole = [np.concatenate(parts, axis=-1).tobytes() for parts in zip(*held)]
            held.clear()
            return pa.record_batch([pa.array([x], pa.binary()) for x in whole], names=["row", "y", "w", "codes"])

        for b in batches:
            if b.num_rows:
                held.append([*(b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "y", "w")), joint.codes(_columns(b.column("codes"), kind, n_features))])
            if sum(len(h[0]) for h in held) >= BLOCK_ROWS:
                yield block()
        if held:
            yield block()

    def arrays(r):
        row, y, w = (np.frombuffer(x, d) for x, d in ((r.row, "<i8"), (r.y, "<f8"), (r.w, "<f8")))
        return row, y, w, np.frombuffer(r.codes, joint.kind).reshape(len(joint.sizes), -1)

    return _single(rows.coalesce(parts).mapInArrow(run, "row binary, y binary, w binary, codes binary").rdd.map(arrays))


def _single(rdd: RDD) -> RDD:
    """Every element pickled alone: two such lists are zipped without being pickled again."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _added(parts: RDD, shape: tuple[int, ...]) -> np.ndarray:
    """The tasks' sums, added up in their order; in two levels where there are
    many tasks."""
    n = parts.getNumPartitions()
    if n > 64:
        some = int(n ** 0.5) + 1
        parts = (parts.mapPartitionsWithIndex(lambda i, x: [(i // some, (i, s)) for s in x]).groupByKey(n // some + 1)
                 .map(lambda g: (g[0], sum(s for _, s in sorted(g[1], key=lambda x: x[0])))))
        found = [s for _, s in sorted(parts.collect(), key=lambda x: x[0])]
    else:
        found = parts.collect()
    return sum(found, np.zeros(shape))


def fit_spark(df: DataFrame, vector_col: str, label: str, weight: str | None, p: Params, bins: Bins | None = None) -> "BoostedTrees":
    """Boosted trees over any number of rows: one aggregate per tree level, over
    blocks of binned rows.  A task sends its sums of the level's nodes (of two
    siblings, the one of fewer rows); they are added up on the driver, beyond 64
    tasks by groups of tasks first.  The blocks are persisted once, beside them
    the margins, one tree further each round and every ``CHECKPOINT_EVERY``
    rounds checkpointed, so a lost executor costs a few trees' scoring; a round's
    margins are let go once the next round's are there."""
    if p.loss == "mean":
        raise ValueError("forests of independent trees are fitted within tasks")
    bins = bins or quantile_bins(df, vector_col)
    joint, rng = Joint(bins), np.random.default_rng(p.seed)
    blocks = _blocks(binned(df, bins, vector_col, label, weight), _code_type(bins), joint).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    margins = _single(blocks.map(lambda b: np.zeros(len(b[1])))).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    old, trees = None, []
    for r in range(p.rounds):
        rows = blocks.zip(margins)

        def histograms(frontier: list[int], tree: Tree, r=r, rows=rows) -> np.ndarray:
            n = len(frontier)

            def run(parts):
                of_node = np.full(len(tree.left), n)
                of_node[frontier] = np.arange(n)

                def some(block):
                    (row, y, w, codes), margin = block
                    slot = of_node[joint.leaves(tree, codes)]
                    learned = (w > 0) & (slot < n)
                    if p.subsample < 1:
                        learned &= _kept(row, p.subsample, p.seed, r)
                    at = np.flatnonzero(learned)
                    return codes, at, slot[at], *gradients(y[at], w[at], margin[at], p.loss)

                return [joint.sums(n, map(some, parts))]

            return _added(rows.mapPartitions(run), (n, bins.total, 3))

        tree = grow(histograms, bins, of_round(p, r), rng, siblings=True)
        trees.append(tree)
        if old is not None:  # this round's passes have read it for the last time
            old.unpersist()

        def further(x, tree=tree):
            (_, _, _, codes), margin = x
            return margin + tree.value[joint.leaves(tree, codes)]

        old, margins = margins, _single(rows.map(further)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        if (r + 1) % CHECKPOINT_EVERY == 0:
            margins.checkpoint()
    for x in (blocks, old, margins):
        if x is not None:
            x.unpersist()
    return BoostedTrees(trees, p.loss)


# -- the model --------------------------------------------------------------------
class BoostedTrees:
    def __init__(self, trees: list[Tree], loss: str = "logistic"):
        self.trees, self.loss = trees, loss

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        total = sum((t.value[t.of_values(x)] for t in self.trees), np.zeros(len(x)))
        return total / max(1, len(self.trees)) if self.loss == "mean" else total

    def probability(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return m if self.loss == "mean" else 1 / (1 + np.exp(-m * (2 if self.loss == "residual" else 1)))

    def forest(self) -> Forest:
        """The trees as one node table, for attributions."""
        sizes = [len(t.left) for t in self.trees]
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(int)
        shift = lambda part: np.concatenate([np.where(getattr(t, part) >= 0, getattr(t, part) + b, -1) for t, b in zip(self.trees, begin)])
        whole = lambda part: np.concatenate([getattr(t, part) for t in self.trees])
        each = 1.0 / len(self.trees) if self.loss == "mean" else 1.0
        return Forest(np.full(len(sizes), each), begin, shift("left"), shift("right"), whole("feature"), whole("threshold"),
                      [None] * sum(sizes), whole("value"), whole("cover"))

    def table(self, spark) -> DataFrame:
        """A row per node, as large as the model."""
        rows = [(k, n, *(getattr(t, f.name)[n].item() for f in dataclasses.fields(t))) for k, t in enumerate(self.trees) for n in range(len(t.left))]
        return spark.createDataFrame(rows, "tree int, node int, " + NODE)

    def score(self, df: DataFrame, keep: Sequence[str], vector_col: str = "features", threshold: float = 0.5) -> DataFrame:
        """``(*keep, probability, prediction)``; the model is as large as its
        trees, whatever it was learned from."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        rows = df.select(*keep, vector_to_array(vector_col).alias("__x"))
        names = list(keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
                q = shared.value.probability(x) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(q, pa.float64()), pa.array((q >= threshold).astype(np.int32))], [*names, "probability", "prediction"])

        kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)
        return rows.mapInArrow(run, f"{kept}probability double, prediction int")


def from_grid(point: dict, seed: int = 42) -> Params:
    """A point of the boosted or of the forest grid, every dimension of it."""
    if "learning_rate" in point:
        return Params(point["n_estimators"], point["max_depth"], point["learning_rate"], point["subsample"], point["colsample_bytree"],
                      point["min_child_weight"], point["gamma"], point["reg_alpha"], point["reg_lambda"], seed=seed)
    return Params(point["n_estimators"], point["max_depth"], min_split=point["min_samples_split"], min_leaf=point["min_samples_leaf"], loss="mean", seed=seed,
                  features=-1.0 if point["max_features"] == "sqrt" else -2.0)


def resolved(p: Params, n_features: int) -> Params:
    """Forests: the share of features for the square root or the binary logarithm of their number."""
    if p.features >= 0:
        return p
    k = int(n_features ** 0.5) if p.features == -1.0 else int(np.log2(n_features))
    return dataclasses.replace(p, features=max(1, k) / n_features + 1e-9)
