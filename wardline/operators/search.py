"""Randomised search over tree models (M13), staged.

The grid's points are fitted on all training rows, binned once.  While the bin
numbers fit a task (``SEARCH_BYTES``), a Spark task makes the fits of a (point,
fold) from all rows; beyond that, fits follow one another, each over Spark
aggregates.  Points that differ only in the number of trees share a fit, which
is scored after each of those numbers.  Folds go in waves: after each, points
are left out whose mean AUC could not become the best even if all their other
folds were perfect; that rule is exact.  The winner is fitted again on all
training rows."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import boosting as B
from wardline.operators import evaluate as E
from wardline.operators import forests as FO
from wardline.operators.ml_prep import draw

#: Bytes of bin numbers of all training rows up to which a search's tasks hold
#: them; beyond, each fit is made over Spark aggregates.
SEARCH_BYTES = 128 << 20
#: Training rows up to which the final fit runs in one task; beyond, by aggregates.
TASK_ROWS = 50_000


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """ROC-AUC, ties half; 0.5 with one class only."""
    pos = y == 1
    n1, n0 = int(pos.sum()), int((~pos).sum())
    if not n1 or not n0:
        return 0.5
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    return float((rank[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


@dataclass
class Sample:
    codes: np.ndarray  # rows x features, numbers among all bins
    y: np.ndarray
    w: np.ndarray
    fold: np.ndarray
    bins: B.Bins

    def rows(self) -> "Rows":
        own = (self.codes - self.bins.first[:-1]).astype(B._code_type(self.bins))
        return Rows(np.ascontiguousarray(own.T), self.y, self.w, self.fold, self.bins)


@dataclass
class Rows:
    columns: np.ndarray  # features x rows, a feature's own bin numbers
    y: np.ndarray
    w: np.ndarray
    fold: np.ndarray
    bins: B.Bins


def sample_rows(train: DataFrame, id_col: str, label: str, fold_col: str, weight: str | None, vector_col: str = "features",
                rows: int | None = None) -> Sample:
    """All training rows in the order of seeded draws, or for a trial the first
    ``rows`` of them; no query asks for fewer.  Bins come from all rows."""
    bins = B.quantile_bins(train, vector_col)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    some = train.where(F.col(label).isNotNull()).withColumn("__d", draw(id_col, 7)).orderBy("__d")
    some = (some if rows is None else some.limit(rows)).select(
        F.col(label).cast("double").alias("y"), w.alias("w"), F.col(fold_col).alias("fold"), vector_to_array(vector_col).alias("x"), "__d").collect()
    some.sort(key=lambda r: r["__d"])
    x = np.array([r.x for r in some]).reshape(len(some), -1)
    return Sample(bins.codes(x), np.array([r.y for r in some]), np.array([r.w for r in some]), np.array([r.fold for r in some]), bins)


def training_rows(train: DataFrame, id_col: str, label: str, fold_col: str, weight: str | None, bins: B.Bins, vector_col: str = "features") -> Rows:
    """All training rows with a label, in an order of their own values."""
    w = F.col(weight) if weight else F.lit(1.0)
    keyed = train.withColumn("__key", F.xxhash64(id_col, label, w, vector_to_array(vector_col)))
    t = B.binned(keyed, bins, vector_col, label, weight, [fold_col, "__key"]).select("y", "w", fold_col, "__key", "codes").toArrow()
    order = np.argsort(t.column("__key").to_numpy(), kind="stable")
    y, w, fold = (t.column(c).to_numpy()[order] for c in ("y", "w", fold_col))
    kind, n = B._code_type(bins), len(bins.cuts)
    parts = [B._columns(c, kind, n) for c in t.column("codes").chunks if len(c)]
    columns = np.concatenate(parts, axis=1) if parts else np.zeros((n, 0), kind)
    for f in range(n):
        columns[f] = columns[f][order]
    return Rows(columns, y, w, fold, bins)


def fold_scores(s: Sample | Rows, points: Sequence[dict], fold: int, seed: int = 42) -> list[float]:
    """Held-out AUC of points that differ in their number of trees only."""
    s = s.rows() if isinstance(s, Sample) else s
    p = B.resolved(B.from_grid(dict(points[0], n_estimators=max(q["n_estimators"] for q in points)), seed), len(s.bins.cuts))
    wanted, out, held = {q["n_estimators"] for q in points}, {}, s.fold == fold

    def each(r: int, margin: np.ndarray) -> None:
        if r in wanted:
            out[r] = auc(s.y[held], margin[held])

    if p.loss == "mean":
        _averaged(s, held, p, each)
    else:
        joint = B.Joint(s.bins)
        B.fit_columns(joint.codes(s.columns), joint, s.y, np.where(held, 0.0, s.w), p, each)
    return [out[q["n_estimators"]] for q in points]


def _averaged(s: Rows, held: np.ndarray, p: B.Params, each: Callable[[int, np.ndarray], None]) -> None:
    """Independent trees from bootstraps of the other folds' rows; only the
    features that a node draws are counted, so deep trees stay small."""
    rng, total = np.random.default_rng(p.seed), np.zeros(len(s.y))
    learned, scored = np.flatnonzero(~held & (s.w > 0)), np.flatnonzero(held)
    aside, most = s.columns[:, scored], int(np.diff(s.bins.first).max(initial=1))
    k = max(1, int(p.features * len(s.bins.cuts)))
    for r in range(p.rounds):
        times = np.bincount(rng.choice(learned, len(learned)), minlength=len(s.y)) if len(learned) else np.zeros(len(s.y), np.int64)
        at = np.flatnonzero(times)
        feature, cut, left, share = FO.grow_part(s.columns[:, at], s.y[at], s.w[at], times[at].astype(float), len(at) if p.max_depth is None else p.max_depth,
                                                 k, p.min_leaf, most, rng, p.min_split)
        total[scored] += share[FO.placed(aside, feature, cut, left)]
        each(r + 1, total)


def spread_scores(train: DataFrame, label: str, fold_col: str, weight: str | None, bins: B.Bins, points: Sequence[dict], fold: int,
                  seed: int = 42, vector_col: str = "features") -> list[float]:
    """``fold_scores`` over any number of rows: a fit over Spark aggregates."""
    learned, held = train.where(F.col(fold_col) != fold), train.where(F.col(fold_col) == fold)
    p = B.resolved(B.from_grid(dict(points[0], n_estimators=max(q["n_estimators"] for q in points)), seed), len(bins.cuts))

    def found(model) -> float:
        value = E.roc_auc(model.score(held, [label], vector_col), label, "probability", places=None).first()["roc_auc"]
        return 0.5 if value is None else value

    if p.loss == "mean":
        k, depth = max(1, int(p.features * len(bins.cuts))), p.max_depth or 1 << 30
        return [found(FO.ForestClassifier(label, weight, q["n_estimators"], depth, p.min_leaf, seed=seed, features=k, min_split=p.min_split).fit(learned, vector_col)) for q in points]
    trees = B.fit_spark(learned, vector_col, label, weight, p, bins).trees
    return [found(B.BoostedTrees(trees[:q["n_estimators"]], p.loss)) for q in points]


def grouped(points: Sequence[dict]) -> list[list[int]]:
    """Numbers of the points that share a fit."""
    by: dict[tuple, list[int]] = {}
    for i, q in enumerate(points):
        by.setdefault(tuple((k, v) for k, v in sorted(q.items()) if k != "n_estimators"), []).append(i)
    return list(by.values())


def staged_search(spark, s: Sample | Rows, points: Sequence[dict], folds: int = 5, seed: int = 42) -> pd.DataFrame:
    """``candidate, fold_auc (list), mean, stopped`` per point; ``mean`` is over
    the folds that ran, and ``stopped`` points are not candidates to win.  The
    rows are held by every task."""
    shared = spark.sparkContext.broadcast(s.rows() if isinstance(s, Sample) else s)

    def wave(fold: int, work: list[list[int]]) -> list[tuple[int, float]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for g in b["g"]:
                    yield pd.DataFrame({"candidate": work[g], "auc": fold_scores(shared.value, [points[i] for i in work[g]], fold, seed)})

        tasks = spark.createDataFrame(spark.sparkContext.parallelize([(g,) for g in range(len(work))], len(work)), "g int")
        return [(r.candidate, r.auc) for r in tasks.mapInPandas(run, "candidate int, auc double").collect()]

    points = list(points)
    found = _staged(points, folds, wave)
    shared.unpersist()
    return found


def _staged(points: list[dict], folds: int, wave: Callable[[int, list[list[int]]], list[tuple[int, float]]]) -> pd.DataFrame:
    groups = grouped(points)
    found: list[list[float]] = [[] for _ in points]
    open_points = set(range(len(points)))
    for fold in range(folds):
        work = [members for members in groups if open_points.intersection(members)]
        # long fits first, one task each
        work.sort(key=lambda members: -max(points[i]["n_estimators"] * (points[i]["max_depth"] or 12) for i in members))
        for candidate, value in wave(fold, work):
            found[candidate].append(value)
        left = folds - fold - 1
        least = max(sum(found[i]) for i in open_points)
        open_points = {i for i in open_points if sum(found[i]) + left >= least}
    return pd.DataFrame({"candidate": range(len(points)), "fold_auc": found, "mean": [float(np.mean(f)) if f else None for f in found],
                         "stopped": [i not in open_points and len(found[i]) < folds for i in range(len(points))]})


def search(train: DataFrame, id_col: str, label: str, fold_col: str, weight: str | None, points: Sequence[dict], folds: int = 5, seed: int = 42,
           vector_col: str = "features", most_bytes: int = SEARCH_BYTES) -> pd.DataFrame:
    """The staged search over all training rows, however many."""
    train, points = train.where(F.col(label).isNotNull()), list(points)
    bins = B.quantile_bins(train, vector_col)
    if train.count() * len(bins.cuts) * np.dtype(B._code_type(bins)).itemsize <= most_bytes:
        return staged_search(train.sparkSession, training_rows(train, id_col, label, fold_col, weight, bins, vector_col), points, folds, seed)

    def wave(fold: int, work: list[list[int]]) -> list[tuple[int, float]]:
        return [x for members in work for x in zip(members, spread_scores(train, label, fold_col, weight, bins, [points[i] for i in members], fold, seed, vector_col))]

    return _staged(points, folds, wave)


def winner(table: pd.DataFrame) -> int:
    """The best mean; equal means: the first."""
    full = table[~table["stopped"]]
    return int(full.sort_values(["mean", "candidate"], ascending=[False, True])["candidate"].iloc[0])


def fit_all(train: DataFrame, label: str, weight: str | None, p: B.Params, bins: B.Bins, vector_col: str = "features", task_rows: int = TASK_ROWS) -> B.BoostedTrees:
    """The winner on all training rows: in one task while these are at most
    ``task_rows``, beyond that by one Spark aggregate per tree level (forests of
    independent trees then come from ``models.forest``).  Both ways sum the
    same gradients."""
    spark = train.sparkSession
    p = B.resolved(p, len(bins.cuts))
    if train.count() > task_rows:
        if p.loss == "mean":
            raise ValueError("more rows than a task holds: fit the forest with models.forest")
        return B.fit_spark(train, vector_col, label, weight, p, bins)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = train.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), w.alias("w"), vector_to_array(vector_col).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        b = pd.concat(parts)
        x = np.stack(b["x"].to_numpy())
        order = np.lexsort((*x.T, b["y"].to_numpy()))  # rows in an order of their own
        trees = B.fit_rows(bins.codes(x[order]), bins, b["y"].to_numpy()[order], b["w"].to_numpy()[order], p)
        for k, t in enumerate(trees):
            yield pd.DataFrame({"tree": k, "node": range(len(t.left)), **{f.name: getattr(t, f.name) for f in dataclasses.fields(t)}})

    table = rows.repartition(1).mapInPandas(run, "tree int, node int, " + B.NODE).toPandas().sort_values(["tree", "node"])
    trees = [B.Tree(**{f.name: t[f.name].to_numpy() for f in dataclasses.fields(B.Tree)}) for _, t in table.groupby("tree")]
    return B.BoostedTrees(trees, p.loss)
