"""Score functions, feature selectors, splits, searches, calibration, pipelines and simplex search."""

from __future__ import annotations

import itertools
import math
import random
from collections import namedtuple
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import special, stats
from millrace.functions.core import Classifier, Estimator, Predictor, Transformer, columns, dense_rows, names, settled

# --- scores of single features ---------------------------------------------------------


def f_classif(df: DataFrame, features, label: str) -> tuple[np.ndarray, np.ndarray]:
    """ANOVA F and p of each feature: one grouped aggregation."""
    cols = columns(df, features)
    aggs = [F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("v", F.var_pop))]]
    rows = df.groupBy(F.col(label).alias("y")).agg(*aggs).collect()
    if len(rows) < 2:
        raise ValueError("two classes at least")
    n = np.array([r["n"] for r in rows], float)
    m, v = (np.array([[r[f"{k}{i}"] for i in range(len(cols))] for r in rows], float) for k in "mv")
    total, k = n.sum(), len(rows)
    mean = (n[:, None] * m).sum(axis=0) / total
    between, within = (n[:, None] * (m - mean) ** 2).sum(axis=0) / (k - 1), (n[:, None] * v).sum(axis=0) / (total - k)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = np.where(within > 0, between / within, np.nan)
    return f, np.array([special.f_sf(x, k - 1, total - k) for x in f])


def f_regression(df: DataFrame, features, label: str) -> tuple[np.ndarray, np.ndarray]:
    """F and p of the correlation of each feature with the target."""
    cols = columns(df, features)
    y = F.col(label).cast("double")
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.corr(c, y).alias(f"r{i}") for i, c in enumerate(cols)]).first()
    dof = r["n"] - 2
    c = np.array([np.nan if r[f"r{i}"] is None else r[f"r{i}"] for i in range(len(cols))], float)
    with np.errstate(divide="ignore"):
        f = c**2 / (1 - c**2) * dof
    return f, np.array([special.f_sf(x, 1, dof) for x in f])


def chi2(df: DataFrame, features, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Chi-square of summed non-negative features against the classes' shares."""
    cols = [F.when(c < 0, F.raise_error(F.lit("negative value")).cast("double")).otherwise(c) for c in columns(df, features)]
    rows = df.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]).collect()
    n = np.array([r["n"] for r in rows], float)
    seen = np.array([[r[f"s{i}"] for i in range(len(cols))] for r in rows], float)
    want = n[:, None] / n.sum() * seen.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(want > 0, (seen - want) ** 2 / want, 0).sum(axis=0)
    return x, np.array([special.chi2_sf(v, len(rows) - 1) for v in x])


def chi2_sparse(df: DataFrame, targets: DataFrame, n_features: int, row: str = "row_id", feature: str = "feature_idx", value: str = "value", label: str = "y") -> tuple[np.ndarray, np.ndarray]:
    """``chi2`` of long-form rows: what is absent adds nothing to the sums."""
    n = {r["y"]: r["n"] for r in targets.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    at, seen = {c: k for k, c in enumerate(sorted(n))}, np.zeros((len(n), n_features))
    v = F.when(F.col(value) < 0, F.raise_error(F.lit("negative value")).cast("double")).otherwise(F.col(value).cast("double"))
    for r in df.join(targets, row).groupBy(F.col(label).alias("y"), F.col(feature).alias("i")).agg(F.sum(v).alias("s")).collect():
        seen[at[r["y"]], r["i"]] = r["s"]
    share = np.array([n[c] for c in sorted(n)], float)
    want = share[:, None] / share.sum() * seen.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(want > 0, (seen - want) ** 2 / want, 0).sum(axis=0)
    return x, np.array([special.chi2_sf(t, len(n) - 1) for t in x])


def _counted(values: np.ndarray, at: np.ndarray, d: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """How many of the sorted values lie within d of each place, by |place - value| / scale <= d as it is rounded."""
    v, n = np.unique(values, return_counts=True)
    below = np.r_[0, np.cumsum(n)]
    low, high = np.searchsorted(v, at - d * scale, "left"), np.searchsorted(v, at + d * scale, "right")

    def off(k):
        return ~(np.abs(at - v[np.clip(k, 0, len(v) - 1)]) / scale <= d)

    while (move := (low > 0) & ~off(low - 1)).any():
        low = low - move
    while (move := (low < len(v)) & (v[np.minimum(low, len(v) - 1)] < at) & off(low)).any():
        low = low + move
    while (move := (high < len(v)) & ~off(high)).any():
        high = high + move
    while (move := (high > 0) & (v[np.maximum(high - 1, 0)] > at) & off(high - 1)).any():
        high = high - move
    return below[high] - below[low]


def _kth_on_line(own: np.ndarray, k: int) -> np.ndarray:
    """The distance from each of the sorted values to its k-th nearest other."""
    n, out = len(own), np.full(len(own), np.inf)
    for left in range(k + 1):  # the k nearest are so many on the left and the rest on the right
        at = np.arange(left, n - (k - left))
        out[at] = np.minimum(out[at], np.maximum(own[at] - own[at - left], own[at + k - left] - own[at]))
    return out


def _kth_on_plane(x: np.ndarray, y: np.ndarray, sx: float, sy: float, k: int, cells: int = 4_000_000) -> np.ndarray:
    """The distance from each row to its k-th nearest other, by the larger of the scaled gaps in x and in y.

    Rows go in order of x: those near by in that order bound the distance, and only rows within it in x and y are compared.
    """
    n, order = len(x), np.lexsort((y, x))
    px, py, out = x[order], y[order], np.empty(len(x))

    def gaps(i, j):
        return np.maximum(np.abs(px[i, None] - px[None, j]) / sx, np.abs(py[i, None] - py[None, j]) / sy)

    parts = [(a, min(a + 256, n)) for a in range(0, n, 256)]
    while parts:
        a, b = parts.pop()
        near, mine = np.arange(max(0, a - 2 * k - 64), min(n, b + 2 * k + 64)), np.arange(a, b)
        r = np.partition(gaps(mine, near), k, axis=1)[:, k].max() * (1 + 1e-9)
        first, last = np.searchsorted(px, px[a] - r * sx - 1e-9 * sx, "left"), np.searchsorted(px, px[b - 1] + r * sx + 1e-9 * sx, "right")
        low, high = py[a:b].min() - r * sy - 1e-9 * sy, py[a:b].max() + r * sy + 1e-9 * sy
        j = first + np.flatnonzero((py[first:last] >= low) & (py[first:last] <= high))
        if len(j) * (b - a) > cells and b - a > 1:
            parts += [(a, (a + b) // 2), ((a + b) // 2, b)]
            continue
        out[order[a:b]] = np.partition(gaps(mine, j), k, axis=1)[:, k]
    return out


def _mutual(df: DataFrame, features, label: str, k: int, discrete: bool) -> tuple[np.ndarray, None]:
    """Nearest-neighbour mutual information, one feature a task: neighbours and counts come from sorted values."""
    cols = columns(df, features)
    each = df.select(F.col(label).cast("double").alias("y"), F.posexplode(F.array(*cols)).alias("f", "x"))

    def one(pdf):
        import pandas as pd

        x, y, n = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), len(pdf)
        if discrete:
            total, got = 0.0, 0
            for c in np.unique(y):
                own = np.sort(x[y == c])
                if len(own) < 2:
                    continue
                kk = min(k, len(own) - 1)
                # Nearer than the k-th neighbour, by differences: sums of places and distances would be rounded over it.
                m = _counted(x, own, np.nextafter(_kth_on_line(own, kk), 0))
                total += (special.digamma(float(kk))[0] - special.digamma(float(len(own)))[0]) * len(own) - special.digamma(np.maximum(m, 1).astype(float)).sum()
                got += len(own)
            value = special.digamma(float(got))[0] + total / got if got else 0.0
        else:
            sx, sy = (float(v.std()) or 1.0 for v in (x, y))
            d = np.nextafter(_kth_on_plane(x, y, sx, sy, k), 0)
            nx, ny = _counted(x, x, d, sx), _counted(y, y, d, sy)
            value = special.digamma(float(n))[0] + special.digamma(float(k))[0] - (special.digamma(nx.astype(float)) + special.digamma(ny.astype(float))).mean()
        return pd.DataFrame({"f": [int(pdf["f"].iloc[0])], "v": [max(0.0, float(value))]})

    got = {r["f"]: r["v"] for r in each.groupBy("f").applyInPandas(one, "f int, v double").collect()}
    return np.array([got[i] for i in range(len(cols))]), None


def mutual_info_classif(df, features, label, n_neighbors: int = 3):
    return _mutual(df, features, label, n_neighbors, True)


def mutual_info_regression(df, features, label, n_neighbors: int = 3):
    return _mutual(df, features, label, n_neighbors, False)


# --- selectors ---------------------------------------------------------------------------


class _Selector(Transformer):
    def get_support(self) -> list[bool]:
        self._ready_only()
        return [bool(v) for v in self.support_]

    def get_support_indices(self) -> list[int]:
        return [i for i, v in enumerate(self.get_support()) if v]

    def _ready_only(self):
        if not self.fitted:
            from millrace.functions.core import NotFittedError

            raise NotFittedError(type(self).__name__)

    def selected(self) -> list[str]:
        return [n for n, v in zip(names(self.features, self.width), self.get_support()) if v]

    def transform(self, df, features=None):
        """Without the features that weren't selected; an array column keeps its selected elements."""
        self._ready(df, features)
        if isinstance(self.features, str):
            return df.withColumn(self.features, F.array(*[F.col(self.features)[i] for i in self.get_support_indices()]))
        return df.drop(*[n for n, v in zip(self.features, self.support_) if not v])

    def inverse_transform(self, df, features=None):
        """Features that were dropped come back as zeros."""
        return df.withColumns({n: F.lit(0.0) for n, v in zip(names(self.features, self.width), self.support_) if not v})


class VarianceThreshold(_Selector):
    defaults = {"threshold": 0.0}

    def fit(self, df, features, label=None):
        cols = self._start(df, features)
        r = df.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
        if r[0] is None:
            raise ValueError("empty input")
        return self._keep(np.array(r, float))

    def fit_sparse(self, df, n_rows, width, row="row_id", feature="feature_idx", value="value"):
        self.features, self.width = [f"x{i}" for i in range(width)], width
        s, q = np.zeros(width), np.zeros(width)
        v = F.col(value).cast("double")
        for r in df.groupBy(F.col(feature).alias("i")).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q")).collect():
            s[r["i"]], q[r["i"]] = r["s"], r["q"]
        return self._keep(np.maximum(q / n_rows - (s / n_rows) ** 2, 0))

    def _keep(self, variances):
        self.variances_, self.support_, self.fitted = variances, variances > self.threshold, True
        if not self.support_.any():
            raise ValueError("no feature has a variance over the threshold")
        return self


class SelectKBest(_Selector):
    defaults = {"score_func": f_classif, "k": 10}

    def fit(self, df, features, label=None):
        self._start(df, features, label)
        self.scores_, self.pvalues_ = self.score_func(df, features, label)
        return self._keep()

    def fit_sparse(self, df, targets, width, row="row_id", feature="feature_idx", value="value", label="y"):
        """Long-form rows (absent = 0): chi2 from its sums, other scores from gathered arrays."""
        self.features, self.label, self.width = [f"x{i}" for i in range(width)], label, width
        if self.score_func is chi2:
            self.scores_, self.pvalues_ = chi2_sparse(df, targets, width, row, feature, value, label)
        else:
            self.scores_, self.pvalues_ = self.score_func(dense_rows(df, targets, width, row, feature, value), "_x", label)
        return self._keep()

    def _keep(self):
        if self.k > self.width:
            raise ValueError("k is larger than the number of features")
        order = sorted(range(self.width), key=lambda i: (math.isnan(self.scores_[i]), -np.nan_to_num(self.scores_[i]), i))
        self.support_ = np.isin(np.arange(self.width), order[: self.k])
        self.fitted = True
        return self


def importances(model: Any) -> np.ndarray:
    for name in ("coef_", "feature_importances_"):
        v = model.__dict__.get(name)
        if v is not None:
            v = np.abs(np.asarray(v, float))
            return v.sum(axis=0) if v.ndim > 1 else v
    raise ValueError(f"{type(model).__name__} has neither coef_ nor feature_importances_")


class SelectFromModel(_Selector):
    """Features whose weight is at least a threshold: mean, median, "k*mean" or a number."""

    defaults = {"estimator": None, "threshold": "mean", "prefit": False, "max_features": None}

    def set_param(self, name, value):
        if name == "threshold" and not isinstance(value, str):
            self.params[name] = value
            return self
        return super().set_param(name, value)

    def fit(self, df, features, label=None):
        self._start(df, features, label)
        model = self.estimator if self.prefit else self.estimator.clone().fit(df, features, label)
        w = importances(model)
        t = self.threshold
        if isinstance(t, str):
            scale, _, base = t.rpartition("*")
            if base.strip() not in ("mean", "median"):
                raise ValueError(f"unknown threshold {t!r}")
            t = (float(scale) if scale else 1.0) * float(np.mean(w) if base.strip() == "mean" else np.median(w))
        self.threshold_value_, keep = t, w >= t
        if self.max_features is not None:
            top = sorted(range(len(w)), key=lambda i: (-w[i], i))[: self.max_features]
            keep &= np.isin(np.arange(len(w)), top)
        self.support_, self.estimator_, self.fitted = keep, model, True
        return self


class RFE(_Selector):
    """The least important features go, round by round; each round adds one to the rank of all that are gone."""

    defaults = {"estimator": None, "n_features_to_select": None, "step": 1, "verbose": 0}

    def set_param(self, name, value):
        if name == "step":
            self.params[name] = value
            return self
        return super().set_param(name, value)

    def fit(self, df, features, label=None):
        from millrace.operators.linear import LinearModel

        cols = self._start(df, features, label)
        p, use = self.width, names(features, self.width)
        want = p // 2 if self.n_features_to_select is None else self.n_features_to_select
        step = max(1, int(self.step * p)) if isinstance(self.step, float) and self.step < 1 else int(self.step)
        if not 1 <= want <= p or step < 1:
            raise ValueError("n_features_to_select or step is out of range")
        alive, rank = list(range(p)), np.ones(p, int)
        # Models on moments are refitted from one pass, whatever the number of rounds.
        m = stats.moments(df, [*cols, F.col(label).cast("double")]) if isinstance(self.estimator, LinearModel) else None
        flat = df if not isinstance(features, str) else df.withColumns(dict(zip(use, cols)))

        def fitted():
            e = self.estimator.clone()
            if m is not None:
                e.features, e.label, e.width = [use[i] for i in alive], label, len(alive)
                return e.fit_moments(m.pick([*alive, p]))
            return e.fit(flat, [use[i] for i in alive], label)

        while len(alive) > want:
            w = importances(fitted())
            gone = [alive[i] for i in sorted(range(len(alive)), key=lambda i: (w[i], i))[: min(step, len(alive) - want)]]
            alive = [i for i in alive if i not in gone]
            rank[[i for i in range(p) if i not in alive]] += 1
        self.estimator_ = fitted()
        self.n_features_, self.ranking_, self.support_, self.fitted = len(alive), rank, np.isin(np.arange(p), alive), True
        return self

    def predict(self, df, features=None, out="prediction"):
        return self.estimator_.predict(df, None, out)


# --- splits and searches ---------------------------------------------------------------

Split = namedtuple("Split", "train test")


def hash_order(id_col: str, seed: int):
    return F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col)


def ranked(df: DataFrame, order: Sequence, name: str = "_rank") -> DataFrame:
    """Global ranks 0.. without one task for all rows: sorted ranges, then offsets by range."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    parts = df.withColumns(keys).repartitionByRange(ranges, *keys).withColumn("_part", F.spark_partition_id())
    parts = settled(parts)
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
    total, before = 0, []
    for k in sorted(counts):
        before.append((k, total))
        total += counts[k]
    if not before:
        return parts.withColumn(name, F.lit(0).cast("long")).drop("_part", *keys)
    # A row for each range: its size doesn't depend on the number of rows.
    first = df.sparkSession.createDataFrame(before, "_part int, _first long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return parts.withColumn("_own", own).join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_own") - 1).drop("_part", "_own", "_first", *keys)


def train_test_split(df: DataFrame, id_col: str, test_size: float = 0.25, seed: int = 42, order: Sequence | None = None) -> Split:
    """The first n - round(n * test_size) rows in hash order train, the others test."""
    if not 0 < test_size < 1:
        raise ValueError("test_size lies between 0 and 1")
    n = df.count()
    n_test = int(math.floor(n * test_size + 0.5))
    if not n_test or n_test == n:
        raise ValueError("one side would be empty")
    rows = ranked(df, order or hash_order(id_col, seed))
    return Split(rows.filter(F.col("_rank") < n - n_test).drop("_rank"), rows.filter(F.col("_rank") >= n - n_test).drop("_rank"))


def with_folds(df: DataFrame, id_col: str, cv: int = 5, shuffle: bool = True, seed: int = 42, order: Sequence | None = None, name: str = "fold") -> DataFrame:
    """A fold number for each row: fold f takes ranks from floor(n f / cv) to floor(n (f + 1) / cv)."""
    n = df.count()
    if not 2 <= cv <= n:
        raise ValueError("cv lies between 2 and the number of rows")
    rows = ranked(df, order or (hash_order(id_col, seed) if shuffle else [F.col(id_col)]))
    fold = F.lit(0)
    for f in range(1, cv):
        fold = F.when(F.col("_rank") >= n * f // cv, f).otherwise(fold)
    return rows.withColumn(name, fold).drop("_rank")


def cross_val_score(estimator: Estimator, df: DataFrame, features, label: str, id_col: str | None = None, cv: int = 5, seed: int = 42, fold_col: str | None = None) -> list[float]:
    """Scores of the folds.  Models on moments are trained on total minus fold: one grouped pass for all folds."""
    from millrace.operators.linear import LinearModel

    rows = df if fold_col else with_folds(df, id_col, cv, True, seed, name="_fold")
    fold_col = fold_col or "_fold"
    if isinstance(estimator, LinearModel):
        return _moment_scores(estimator, _fold_moments(rows, features, label, fold_col), features, label)
    rows = rows.persist()
    out = []
    for f in sorted(r[0] for r in rows.select(fold_col).distinct().collect()):
        model = estimator.clone().fit(rows.filter(F.col(fold_col) != f), features, label)
        out.append(model.score(rows.filter(F.col(fold_col) == f), label))
    rows.unpersist()
    return out


def _fold_moments(rows, features, label, fold_col):
    return stats.moments(rows, [*columns(rows, features), F.col(label).cast("double")], F.col(fold_col))


def _moment_scores(estimator, by: dict, features, label) -> list[float]:
    """R squared on each fold of the model of all others, from moments alone."""
    parts = list(by.values())
    total = sum(parts[1:], parts[0])
    out = []
    for m in parts:
        e = estimator.clone()
        e.features, e.label, e.width = features, label, len(m.mean) - 1
        e.fit_moments(total - m)
        v = np.r_[-e.coef_, 1.0]
        gap = v @ m.mean - e.intercept_
        res, tot = v @ m.scatter @ v + m.n * gap**2, m.scatter[-1, -1]
        out.append(float(1 - res / tot) if tot else 0.0)
    return out


class ParameterGrid:
    """All combinations of lists of values; the last name varies fastest."""

    def __init__(self, grid: dict[str, Sequence[Any]]) -> None:
        if any(not len(v) for v in grid.values()):
            raise ValueError("a list of values is empty")
        self.grid = grid

    def __len__(self) -> int:
        return math.prod(len(v) for v in self.grid.values())

    def __iter__(self):
        for values in itertools.product(*self.grid.values()):
            yield dict(zip(self.grid, values))


class _Search(Predictor):
    def _points(self):
        raise NotImplementedError

    def fit(self, df, features, label, id_col: str | None = None, fold_col: str | None = None):
        from millrace.operators.linear import LinearModel

        self.features, self.label = features, label
        rows = (df if fold_col else with_folds(df, id_col, self.cv, True, 42, name="_fold")).persist()
        fold_col = fold_col or "_fold"
        self.cv_results_params_, self.cv_results_mean_score_ = [], []
        moments = _fold_moments(rows, features, label, fold_col) if isinstance(self.estimator, LinearModel) else None
        for point in self._points():
            e = self.estimator.clone()
            for k, v in point.items():
                e.set_param(k, v)
            s = _moment_scores(e, moments, features, label) if moments else cross_val_score(e, rows, features, label, fold_col=fold_col)
            self.cv_results_params_.append(point)
            self.cv_results_mean_score_.append(float(np.mean(s)))
        rows.unpersist()
        self.best_index_ = int(np.argmax(self.cv_results_mean_score_))
        self.best_params_, self.best_score_ = self.cv_results_params_[self.best_index_], self.cv_results_mean_score_[self.best_index_]
        if self.refit:
            best = self.estimator.clone()
            for k, v in self.best_params_.items():
                best.set_param(k, v)
            self.best_estimator_ = best.fit(df, features, label)
        self.fitted = True
        return self

    def predict(self, df, features=None, out="prediction"):
        return self.best_estimator_.predict(df, features, out)

    def score(self, df, label=None):
        return self.best_estimator_.score(df, label)


class GridSearchCV(_Search):
    defaults = {"estimator": None, "param_grid": None, "cv": 5, "refit": True, "n_jobs": 1}

    def _points(self):
        return self.param_grid if isinstance(self.param_grid, ParameterGrid) else ParameterGrid(self.param_grid)


class RandomizedSearchCV(_Search):
    defaults = {"estimator": None, "param_distributions": None, "n_iter": 10, "cv": 5, "refit": True, "random_state": None}

    def _points(self):
        r = random.Random(self.random_state)
        return [{k: r.choice(list(v)) for k, v in self.param_distributions.items()} for _ in range(self.n_iter)]


# --- calibration --------------------------------------------------------------------------


def platt(d: np.ndarray, positive: np.ndarray, max_iter: int = 100) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a d + b)) on smoothed targets, by Newton steps with halving."""
    n1, n0 = positive.sum(), (~positive).sum()
    t = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.column_stack([d, np.ones(len(d))])
    w = np.array([0.0, math.log((n0 + 1) / (n1 + 1))])

    def loss(w):
        f = z @ w
        return float((np.logaddexp(0, f) - (1 - t) * f).sum())

    now = loss(w)
    for _ in range(max_iter):
        p = special.sigmoid(-(z @ w))
        g, h = z.T @ (t - p), (z * (p * (1 - p))[:, None]).T @ z + 1e-12 * np.eye(2)
        if np.abs(g).max() < 1e-8:
            break
        step, k = np.linalg.solve(h, g), 1.0
        while k > 1e-10:
            new = loss(w - k * step)
            if new < now + 1e-12:
                w, now = w - k * step, new
                break
            k /= 2
        else:
            break
    return float(w[0]), float(w[1])


def apply_platt(d, a: float, b: float):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(d * float(a) + float(b)))


class CalibratedClassifierCV(Classifier):
    """Out-of-fold decisions, calibrated by a sigmoid or isotonic map for each class; folds are averaged or one model refitted."""

    defaults = {"estimator": None, "method": "sigmoid", "cv": 5, "n_jobs": 1, "ensemble": True, "random_state": 42}
    max_rows = 200_000

    def _scores(self, model, df):
        """The decision of each class as an array column."""
        if hasattr(model, "decision_function"):
            d = model.decision_function(df, out="_d")
            return d.withColumn("_d", F.array(-F.col("_d"), F.col("_d"))) if len(self.classes_) == 2 and dict(d.dtypes)["_d"] == "double" else d
        return model.predict_proba(df, out="_d")

    def fit(self, df, features, label, id_col: str = "id"):
        from millrace.functions.core import classes_of
        from millrace.operators.linear import pool_adjacent

        self._start(df, features, label)
        self.classes_ = classes_of(df, label)
        k = len(self.classes_)
        if self.method not in ("sigmoid", "isotonic"):
            raise ValueError(f"unknown method {self.method!r}")
        rows = with_folds(df, id_col, self.cv, True, self.random_state, name="_fold").persist()
        self.folds_, held = [], []

        def maps(d, y):
            out = []
            for j in range(1 if k == 2 else 0, k):
                pos = y == j
                if self.method == "sigmoid":
                    out.append(platt(d[:, j], pos))
                else:
                    order = np.argsort(d[:, j], kind="stable")
                    out.append((d[order, j], pool_adjacent(pos[order].astype(float), np.ones(len(y)))))
            return out

        code = F.lit(0)
        for j, c in enumerate(self.classes_):
            code = F.when(F.col(label) == F.lit(c), j).otherwise(code)
        for f in range(self.cv):
            model = self.estimator.clone().fit(rows.filter(F.col("_fold") != f), features, label)
            got = self._scores(model, rows.filter(F.col("_fold") == f)).select("_d", code.alias("_y")).limit(self.max_rows + 1).collect()
            if len(got) > self.max_rows:
                raise ValueError(f"a fold has more than {self.max_rows} rows")
            d, y = np.array([r["_d"] for r in got], float), np.array([r["_y"] for r in got])
            if self.ensemble:
                self.folds_.append((model, maps(d, y)))
            else:
                held.append((d, y))
        if not self.ensemble:
            d, y = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            self.folds_ = [(self.estimator.clone().fit(df, features, label), maps(d, y))]
        rows.unpersist()
        self.fitted = True
        return self

    def predict_proba(self, df, features=None, out="probability"):
        k, total, now = len(self.classes_), None, df
        for f, (model, maps) in enumerate(self.folds_):
            now = self._scores(model, now).withColumnRenamed("_d", f"_d{f}")
            each = []
            for j, m in zip(range(1 if k == 2 else 0, k), maps):
                d = F.col(f"_d{f}")[j]
                if self.method == "sigmoid":
                    each.append(apply_platt(d, *m))
                else:
                    from millrace.functions.core import row_function

                    x, y = m
                    each.append(row_function(lambda v, x=x, y=y: np.interp(v[:, 0], x, y), [d]))
            if k == 2:
                p = F.array(F.lit(1.0) - each[0], each[0])
            else:
                s = sum(each[1:], each[0])
                p = F.array(*[F.when(s > 0, e / s).otherwise(1.0 / k) for e in each])
            now = now.withColumn(f"_p{f}", p)
        n = len(self.folds_)
        total = F.array(*[sum((F.col(f"_p{f}")[j] for f in range(n)), F.lit(0.0)) / n for j in range(k)])
        return now.withColumn(out, total).drop(*[f"_{c}{f}" for c in "dp" for f in range(n)])

    def predict(self, df, features=None, out="prediction"):
        p = self.predict_proba(df, features, "_p")
        return p.withColumn(out, F.get(F.array(*[F.lit(c) for c in self.classes_]), (F.array_position("_p", F.array_max("_p")) - 1).cast("int"))).drop("_p")


# --- pipeline -------------------------------------------------------------------------------


class Pipeline:
    """Named steps: transformers, then an optional predictor.  Parameters are set as ``step__name``."""

    def __init__(self, steps: Sequence[tuple[str, Estimator]]) -> None:
        self.steps = list(steps)
        if len({n for n, _ in self.steps}) != len(self.steps):
            raise ValueError("names of steps repeat")
        self.fitted = False

    def named_step(self, name: str | int) -> Estimator:
        return self.steps[name][1] if isinstance(name, int) else dict(self.steps)[name]

    @property
    def step_names(self) -> list[str]:
        return [n for n, _ in self.steps]

    def set_param(self, name: str, value: Any) -> Pipeline:
        step, sep, rest = name.partition("__")
        if not sep:
            raise ValueError("a parameter is named step__name")
        self.named_step(int(step) if step.isdigit() else step).set_param(rest, value)
        return self

    def get_params(self) -> dict[str, Any]:
        return {f"{n}__{k}": v for n, s in self.steps for k, v in s.get_params().items()}

    def clone(self) -> Pipeline:
        return Pipeline([(n, s.clone()) for n, s in self.steps])

    @staticmethod
    def _after(step, features):
        """The features that a transformer leaves."""
        if hasattr(step, "selected"):
            return features if isinstance(features, str) else step.selected()
        if hasattr(step, "output_names"):
            return step.output_names()
        if "components_" in step.__dict__:
            return [f"pc{k}" for k in range(len(step.components_))]
        return names(features, step.width) if isinstance(features, str) else features

    def fit(self, df: DataFrame, features, label: str | None = None) -> Pipeline:
        self.label = label
        for _, step in self.steps[:-1]:
            df = step.fit(df, features, label).transform(df)
            features = self._after(step, features)
        last = self.steps[-1][1]
        last.fit(df, features, *([label] if label else []))
        self.fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps[:-1]:
            df = step.transform(df)
        last = self.steps[-1][1]
        return last.transform(df) if hasattr(last, "transform") else df

    def predict(self, df: DataFrame, features=None, out: str = "prediction") -> DataFrame:
        if not self.fitted:
            from millrace.functions.core import NotFittedError

            raise NotFittedError("Pipeline")
        for _, step in self.steps[:-1]:
            df = step.transform(df)
        return self.steps[-1][1].predict(df, None, out)

    def score(self, df: DataFrame, label: str | None = None) -> float:
        for _, step in self.steps[:-1]:
            df = step.transform(df)
        return self.steps[-1][1].score(df, label or self.label)


def make_pipeline(*steps: Estimator) -> Pipeline:
    return Pipeline([(f"step{i}", s) for i, s in enumerate(steps)])


class NelderMead(Estimator):
    """Simplex search; both the simplex's and the values' spread must fall below their limits."""

    defaults = {"max_iter": 1000, "xatol": 1e-8, "fatol": 1e-8, "initial_step": 0.05}

    def minimize(self, f: Callable[[np.ndarray], float], x0: Sequence[float]) -> np.ndarray:
        x0 = np.asarray(x0, float)
        simplex = [x0, *[x0 + np.eye(len(x0))[i] * (self.initial_step * x0[i] if x0[i] else self.initial_step) for i in range(len(x0))]]
        return self.minimize_simplex(f, simplex)

    def minimize_simplex(self, f, simplex):
        pts = [(float(f(np.asarray(x, float))), np.asarray(x, float)) for x in simplex]
        for self.n_iter_ in range(1, self.max_iter + 1):
            pts.sort(key=lambda p: p[0])
            if max(np.abs(p[1] - pts[0][1]).max() for p in pts[1:]) <= self.xatol and pts[-1][0] - pts[0][0] <= self.fatol:
                break
            center, worst = np.mean([p[1] for p in pts[:-1]], axis=0), pts[-1]

            def at(k, center=center, worst=worst):
                x = center + k * (center - worst[1])
                return float(f(x)), x

            r = at(1.0)
            if r[0] < pts[0][0]:
                e = at(2.0)
                pts[-1] = min(e, r, key=lambda p: p[0])
            elif r[0] < pts[-2][0]:
                pts[-1] = r
            else:
                c = at(0.5) if r[0] < worst[0] else at(-0.5)
                if c[0] < min(r[0], worst[0]):
                    pts[-1] = c
                else:
                    low = pts[0][1]
                    pts = [pts[0], *[(float(f(low + 0.5 * (p[1] - low))), low + 0.5 * (p[1] - low)) for p in pts[1:]]]
        pts.sort(key=lambda p: p[0])
        self.fun_, self.x_, self.fitted = pts[0][0], pts[0][1], True
        return self.x_
