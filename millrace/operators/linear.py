"""Linear models from one Gram pass, logistic regression by aggregates, and stochastic models in one group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.functions.core import MAX_ROWS, Classifier, Predictor, argmax, classes_of, collect_bounded, collect_rows, columns, dot, row_function
from millrace.functions.interior import box_program
from millrace.functions.special import sigmoid


class LinearModel(Predictor):
    """A model that needs only moments of features and targets; several targets share the pass."""

    def fit(self, df: DataFrame, features, label):
        labels = [label] if isinstance(label, str) else list(label)
        cols = self._start(df, features, label if isinstance(label, str) else labels[0])
        m = stats.moments(df, [*cols, *[F.col(c).cast("double") for c in labels]])
        return self.fit_moments(m, len(labels), isinstance(label, str))

    def fit_multi(self, df: DataFrame, features, labels: Sequence[str]):
        return self.fit(df, features, list(labels))

    def fit_sparse(self, df: DataFrame, targets: DataFrame, width: int, row: str = "row_id", feature: str = "feature_idx", value: str = "value", label: str = "y"):
        """Long-form rows (absent = 0) and a (row, label) table with a row for every sample."""
        n = targets.count()
        y = targets.select(F.col(row).alias("r"), F.lit(width).alias("i"), F.col(label).cast("double").alias("v"))
        x = df.select(F.col(row).alias("r"), F.col(feature).alias("i"), F.col(value).cast("double").alias("v"))
        m = stats.sparse_moments(x.union(y), n, width + 1, "r", "i", "v")
        self.features, self.label, self.width = [f"x{i}" for i in range(width)], label, width
        return self.fit_moments(m, 1, True)

    def fit_moments(self, m: stats.Moments, n_targets: int = 1, single: bool = True):
        p = len(m.mean) - n_targets
        self.width, self.n_targets_ = getattr(self, "width", p), n_targets
        center = self.params.get("fit_intercept", True)
        s = m.scatter if center else m.raw()
        g, c, yy = s[:p, :p], s[:p, p:], np.diag(s[p:, p:])
        self.n_ = m.n
        w = np.column_stack([self._solve(g, c[:, k], yy[k], m.n) for k in range(n_targets)])
        b = m.mean[p:] - m.mean[:p] @ w if center else np.zeros(n_targets)
        self.coef_matrix_, self.intercept_vector_ = w.T, b
        self.coef_, self.intercept_, self.fitted = (w[:, 0], float(b[0]), True) if single else (w.T, b, True)
        self._offset = m.mean[:p]
        return self

    def _solve(self, g: np.ndarray, c: np.ndarray, yy: float, n: int) -> np.ndarray:
        raise NotImplementedError

    def predict(self, df, features=None, out="prediction"):
        cols = self._ready(df, features)
        if self.n_targets_ > 1:
            return df.withColumn(out, F.array(*[dot(cols, w, b) for w, b in zip(self.coef_matrix_, self.intercept_vector_)]))
        return df.withColumn(out, dot(cols, self.coef_matrix_[0], self.intercept_vector_[0]))

    predict_multi = predict


class LinearRegression(LinearModel):
    defaults = {"fit_intercept": True}

    def _solve(self, g, c, yy, n):
        w, _, self.rank_, _ = np.linalg.lstsq(g, c, rcond=len(g) * float(np.finfo(float).eps))
        return w


class Ridge(LinearModel):
    """Squared error plus alpha times the squared weights; the intercept is free."""

    defaults = {"alpha": 1.0, "fit_intercept": True}

    def _solve(self, g, c, yy, n):
        if self.alpha < 0:
            raise ValueError("alpha is negative")
        return np.linalg.solve(g + self.alpha * np.eye(len(g)), c)


def coordinate_descent(g: np.ndarray, c: np.ndarray, l1: float, l2: float, max_iter: int, tol: float) -> tuple[np.ndarray, int]:
    """Cyclic soft-thresholding on the Gram matrix; stops when no weight moves by ``tol``."""
    w, d = np.zeros(len(g)), np.diag(g)
    for sweep in range(1, max_iter + 1):
        most = 0.0
        for j in range(len(w)):
            if d[j] + l2 <= 0:
                continue
            r = c[j] - g[j] @ w + d[j] * w[j]
            new = np.sign(r) * max(abs(r) - l1, 0.0) / (d[j] + l2)
            most, w[j] = max(most, abs(new - w[j])), new
        if most < tol:
            break
    return w, sweep


class ElasticNet(LinearModel):
    """Half the mean squared error plus alpha (l1_ratio |w| + (1 - l1_ratio) w^2 / 2)."""

    defaults = {"alpha": 1.0, "l1_ratio": 0.5, "fit_intercept": True, "max_iter": 1000, "tol": 1e-4}

    def _solve(self, g, c, yy, n):
        ratio = self.params.get("l1_ratio", 1.0)
        w, self.n_iter_ = coordinate_descent(g, c, n * self.alpha * ratio, n * self.alpha * (1 - ratio), self.max_iter, self.tol)
        return w


class Lasso(ElasticNet):
    defaults = {"alpha": 1.0, "fit_intercept": True, "max_iter": 1000, "tol": 1e-4}


class BayesianRidge(LinearModel):
    """Evidence maximisation of noise (alpha) and weight (lambda) precision, on the Gram matrix's eigenvalues."""

    defaults = {"max_iter": 300, "tol": 1e-3, "alpha_1": 1e-6, "alpha_2": 1e-6, "lambda_1": 1e-6, "lambda_2": 1e-6, "alpha_init": None, "lambda_init": None, "compute_score": False, "fit_intercept": True, "copy_X": True, "verbose": False}
    ignored = ("copy_X", "verbose")

    def _solve(self, g, c, yy, n):
        values, vectors = np.linalg.eigh(g)
        values, rotated = np.maximum(values, 0), vectors.T @ c
        alpha = self.alpha_init if self.alpha_init is not None else 1 / (yy / n + float(np.finfo(float).eps))
        lam = self.lambda_init if self.lambda_init is not None else 1.0
        old, self.scores_ = None, []
        for self.n_iter_ in range(1, self.max_iter + 1):
            w = vectors @ (rotated / (values + lam / alpha))
            rss = max(yy - 2 * w @ c + w @ g @ w, 0.0)
            if self.compute_score:
                self.scores_.append(self._evidence(values, w, alpha, lam, rss, n))
            gamma = (alpha * values / (lam + alpha * values)).sum()
            lam = (gamma + 2 * self.lambda_1) / (w @ w + 2 * self.lambda_2)
            alpha = (n - gamma + 2 * self.alpha_1) / (rss + 2 * self.alpha_2)
            if old is not None and np.abs(w - old).sum() < self.tol:
                break
            old = w
        self.alpha_, self.lambda_ = float(alpha), float(lam)
        self.sigma_ = (vectors / (lam + alpha * values)) @ vectors.T
        return vectors @ (rotated / (values + lam / alpha))

    def _evidence(self, values, w, alpha, lam, rss, n):
        prior = self.lambda_1 * np.log(lam) - self.lambda_2 * lam + self.alpha_1 * np.log(alpha) - self.alpha_2 * alpha
        return float(prior + 0.5 * (len(values) * np.log(lam) + n * np.log(alpha) - alpha * rss - lam * w @ w - np.log(lam + alpha * values).sum() - n * np.log(2 * np.pi)))

    def predict_std(self, df, features=None, out="prediction", std="std"):
        """Prediction and its standard deviation, sqrt(x S x' + 1 / alpha)."""
        cols = self._ready(df, features)
        sigma, noise, at = self.sigma_, 1 / self.alpha_, getattr(self, "_kept", None)
        full = sigma if at is None else np.zeros((self.width, self.width))
        if at is not None:
            full[np.ix_(at, at)] = sigma
        var = sum((cols[i] * cols[j] * float(full[i, j]) for i in range(self.width) for j in range(self.width) if full[i, j]), F.lit(float(noise)))
        return self.predict(df, features, out).withColumn(std, F.sqrt(var))


class ARDRegression(BayesianRidge):
    """A precision for each weight; weights whose precision passes the threshold are pruned."""

    defaults = {"max_iter": 300, "tol": 1e-3, "alpha_1": 1e-6, "alpha_2": 1e-6, "lambda_1": 1e-6, "lambda_2": 1e-6, "compute_score": False, "threshold_lambda": 1e4, "fit_intercept": True, "copy_X": True, "verbose": False}

    def _solve(self, g, c, yy, n):
        p = len(g)
        alpha, lam, keep = 1 / (yy / n + float(np.finfo(float).eps)), np.ones(p), np.ones(p, bool)
        w, old, self.scores_ = np.zeros(p), None, []
        for self.n_iter_ in range(1, self.max_iter + 1):
            at = np.flatnonzero(keep)
            sigma = np.linalg.pinv(alpha * g[np.ix_(at, at)] + np.diag(lam[at]), hermitian=True)
            w = np.zeros(p)
            w[at] = alpha * sigma @ c[at]
            rss = max(yy - 2 * w @ c + w @ g @ w, 0.0)
            gamma = 1 - lam[at] * np.diag(sigma)
            lam[at] = (gamma + 2 * self.lambda_1) / (w[at] ** 2 + 2 * self.lambda_2)
            alpha = (n - gamma.sum() + 2 * self.alpha_1) / (rss + 2 * self.alpha_2)
            keep = lam < self.threshold_lambda
            w[~keep] = 0
            if old is not None and np.abs(w - old).sum() < self.tol or not keep.any():
                break
            old = w.copy()
        at = np.flatnonzero(keep)
        self._kept = at
        self.sigma_ = np.linalg.pinv(alpha * g[np.ix_(at, at)] + np.diag(lam[at]), hermitian=True) if len(at) else np.zeros((0, 0))
        w = np.zeros(p)
        if len(at):
            w[at] = alpha * self.sigma_ @ c[at]
        self.alpha_, self.lambda_ = float(alpha), lam
        return w


class LinearClassifier(Classifier):
    """Scores linear in the features: one column for two classes, else one a class."""

    def decision_function(self, df, features=None, out="decision"):
        cols = self._ready(df, features)
        scores = [dot(cols, w, b) for w, b in zip(self.coef_, self.intercept_)]
        return df.withColumn(out, scores[0] if len(scores) == 1 else F.array(*scores))

    def predict(self, df, features=None, out="prediction"):
        cols = self._ready(df, features)
        scores = [dot(cols, w, b) for w, b in zip(self.coef_, self.intercept_)]
        if len(scores) == 1:
            return df.withColumn(out, F.when(scores[0] > 0, F.lit(self.classes_[1])).otherwise(F.lit(self.classes_[0])))
        return df.withColumn(out, argmax(scores, self.classes_))


class RidgeClassifier(LinearClassifier):
    """Ridge on targets of -1 and 1, one against the rest."""

    defaults = {"alpha": 1.0, "fit_intercept": True}

    def fit(self, df, features, label):
        cols = self._start(df, features, label)
        self.classes_ = classes_of(df, label)
        if len(self.classes_) < 2:
            raise ValueError("one class only")
        heads = self.classes_[1:] if len(self.classes_) == 2 else self.classes_
        targets = [F.when(F.col(label) == F.lit(c), 1.0).otherwise(-1.0) for c in heads]
        m = stats.moments(df, [*cols, *targets])
        ridge = Ridge(alpha=self.alpha, fit_intercept=self.fit_intercept)
        ridge.fit_moments(m, len(heads), False)
        self.coef_, self.intercept_, self.fitted = ridge.coef_matrix_, ridge.intercept_vector_, True
        return self


class LogisticRegression(LinearClassifier):
    """Mean log loss plus |w|^2 / (2 C), by Newton steps with the Hessian's diagonal; one against the rest.

    Each iteration is one aggregation of gradient and curvature sums of all heads.
    """

    defaults = {"C": 1.0, "fit_intercept": True, "max_iter": 100, "tol": 1e-4}

    def fit(self, df, features, label):
        cols = self._start(df, features, label)
        self.classes_ = classes_of(df, label)
        if len(self.classes_) < 2:
            raise ValueError("one class only")
        heads, p = (self.classes_[1:] if len(self.classes_) == 2 else self.classes_), len(cols)
        rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)], F.col(label).alias("y")).cache()
        x = [F.col(f"x{i}") for i in range(p)] + ([F.lit(1.0)] if self.fit_intercept else [])
        w, open_ = np.zeros((len(heads), len(x))), list(range(len(heads)))
        try:
            for self.n_iter_ in range(1, self.max_iter + 1):
                aggs = [F.count(F.lit(1)).alias("n")]
                for k in open_:
                    s = F.lit(1.0) / (F.lit(1.0) + F.exp(-dot(x, w[k])))
                    e, h = s - (F.col("y") == F.lit(heads[k])).cast("double"), s * (F.lit(1.0) - s)
                    aggs += [F.sum(e * c).alias(f"g{k}_{j}") for j, c in enumerate(x)] + [F.sum(h * c * c).alias(f"h{k}_{j}") for j, c in enumerate(x)]
                r = rows.agg(*aggs).first()
                reg = np.r_[np.full(p, 1 / self.C), [0.0] * (len(x) - p)]
                for k in list(open_):
                    g = np.array([r[f"g{k}_{j}"] for j in range(len(x))]) / r["n"] + reg * w[k]
                    h = np.array([r[f"h{k}_{j}"] for j in range(len(x))]) / r["n"] + reg
                    step = g / np.maximum(h, 1e-12)
                    w[k] -= step
                    if np.abs(step).max() < self.tol:
                        open_.remove(k)
                if not open_:
                    break
        finally:
            rows.unpersist()
        self.coef_ = w[:, :p]
        self.intercept_ = w[:, p] if self.fit_intercept else np.zeros(len(heads))
        self.fitted = True
        return self

    def predict_proba(self, df, features=None, out="probability"):
        cols = self._ready(df, features)
        s = [F.lit(1.0) / (F.lit(1.0) + F.exp(-dot(cols, w, b))) for w, b in zip(self.coef_, self.intercept_)]
        if len(s) == 1:
            return df.withColumn(out, F.array(F.lit(1.0) - s[0], s[0]))
        total = sum(s[1:], s[0])
        return df.withColumn(out, F.array(*[v / total for v in s]))


class _Stochastic:
    """Order-dependent passes over at most ``max_rows`` rows, in id order, shuffled by a seed each epoch.

    More rows stay in Spark: tasks pass over their own rows, and their weights are averaged after each epoch.
    Passes also end once steps, and what an epoch of them comes to, are no more than rounding of the weights.
    """

    max_rows = MAX_ROWS * 20

    @staticmethod
    def _rounded(old, new, step):
        unit = float(np.finfo(float).eps) * max(1.0, float(np.abs(new).max()))
        return step <= 4 * unit and np.abs(new - old).max() <= 64 * unit

    def _many(self, df):
        return df.limit(self.max_rows + 1).count() > self.max_rows

    def _far(self, rows, w, b, loss, start, stop, target=lambda y: y):
        eta, alpha, tol, seed = self.eta0, self.alpha, self.tol, self.random_state or 0

        def epoch(x, y, s, k, seen):
            w, b, t, moved = s[:-1], s[-1], target(y[:, 0]), 0.0
            rate = eta / (1 + eta * alpha * k)
            for i in np.random.default_rng([seed, k, seen]).permutation(len(x)):
                g = loss(x[i] @ w + b, t[i])
                step = rate * (g * x[i] + alpha * w)
                w, b = w - step, b - rate * g
                moved += np.abs(step).mean()
            return np.r_[w, b], float(moved)

        s, _, self.n_iter_ = stats.mixed_epochs(rows, np.r_[w, b], epoch, start, stop, lambda old, new, step: np.abs(new - old).max() < tol * eta or self._rounded(old, new, step))
        return s[:-1], float(s[-1])

    def _epochs(self, x, y, w, b, loss, start, stop):
        rng = np.random.default_rng(self.random_state)
        for epoch in range(start, stop):
            rate, moved, old = self.eta0 / (1 + self.eta0 * self.alpha * epoch), 0.0, np.r_[w, b]
            for i in rng.permutation(len(x)):
                g = loss(x[i] @ w + b, y[i])
                step = rate * (g * x[i] + self.alpha * w)
                w, b = w - step, b - rate * g
                moved += np.abs(step).mean()
            self.n_iter_ = epoch + 1
            if moved / len(x) < self.tol or self._rounded(old, np.r_[w, b], moved / len(x)):
                break
        return w, b


LOSSES = {
    "hinge": lambda f, y: -y if y * f < 1 else 0.0,
    "log": lambda f, y: -y * float(sigmoid(np.array(-y * f))),
    "perceptron": lambda f, y: -y if y * f <= 0 else 0.0,
}


class SGDClassifier(_Stochastic, LinearClassifier):
    """Hinge, log or perceptron loss with L2, one against the rest."""

    defaults = {"loss": "hinge", "alpha": 1e-4, "max_iter": 1000, "tol": 1e-3, "eta0": 0.01, "random_state": 42}

    def _run(self, x, y, start, stop):
        heads = self.classes_[1:] if len(self.classes_) == 2 else self.classes_
        for k, c in enumerate(heads):
            self.coef_[k], self.intercept_[k] = self._epochs(x, np.where(y == c, 1.0, -1.0), self.coef_[k], self.intercept_[k], LOSSES[self.loss], start, stop)

    def _reset(self, classes):
        self.classes_ = list(classes)
        n = 1 if len(self.classes_) == 2 else len(self.classes_)
        self.coef_, self.intercept_, self.epoch_ = np.zeros((n, self.width)), np.zeros(n), 0

    def fit(self, df, features, label, id_col=None):
        cols = self._start(df, features, label)
        if self._many(df):
            self._reset(classes_of(df, label))
            if len(self.classes_) < 2:
                raise ValueError("one class only")
            rows = stats.training_rows(df, cols, [F.col(label)])
            for k, c in enumerate(self.classes_[1:] if len(self.classes_) == 2 else self.classes_):
                self.coef_[k], self.intercept_[k] = self._far(rows, self.coef_[k], self.intercept_[k], LOSSES[self.loss], 0, self.max_iter, lambda y, c=c: np.where(y == c, 1.0, -1.0))
            self.fitted = True
            return self
        x, y, _ = collect_bounded(df, features, label, id_col, self.max_rows)
        self._reset([int(c) if float(c).is_integer() else c for c in np.unique(y)])
        if len(self.classes_) < 2:
            raise ValueError("one class only")
        self._run(x, y, 0, self.max_iter)
        self.fitted = True
        return self

    def partial_fit(self, df, features, label, classes=None, id_col=None):
        """One epoch over a batch; the first call names the classes."""
        if not self.fitted:
            if classes is None:
                raise ValueError("the first call of partial_fit needs classes")
            self._start(df, features, label)
            self._reset(sorted(classes))
        x, y, _ = collect_bounded(df, features, label, id_col, self.max_rows)
        if x.shape[1] != self.width:
            raise ValueError(f"X has {x.shape[1]} features, but the first batch had {self.width}")
        self._run(x, y, self.epoch_, self.epoch_ + 1)
        self.epoch_ += 1
        self.fitted = True
        return self


class Perceptron(SGDClassifier):
    defaults = {"max_iter": 1000, "tol": 1e-3, "eta0": 1.0, "random_state": 42}
    loss, alpha = "perceptron", 0.0


class SGDRegressor(_Stochastic, Predictor):
    """Squared loss with L2."""

    defaults = {"alpha": 1e-4, "max_iter": 1000, "tol": 1e-3, "eta0": 0.01, "random_state": 42}

    def fit(self, df, features, label, id_col=None):
        self.fitted = False
        return self._more(df, features, label, id_col, self.max_iter)

    def partial_fit(self, df, features, label, id_col=None):
        return self._more(df, features, label, id_col, 1)

    def _more(self, df, features, label, id_col, epochs):
        if not self.fitted:
            self._start(df, features, label)
            self.coef_, self.intercept_, self.epoch_ = np.zeros(self.width), 0.0, 0
        if self._many(df):
            rows = stats.training_rows(df, self._ready(df, features) if self.fitted else columns(df, features), [F.col(label)])
            self.coef_, self.intercept_ = self._far(rows, self.coef_, self.intercept_, lambda f, t: f - t, self.epoch_, self.epoch_ + epochs)
            self.epoch_, self.fitted = self.epoch_ + epochs, True
            return self
        x, y, _ = collect_bounded(df, features, label, id_col, self.max_rows)
        self.coef_, self.intercept_ = self._epochs(x, y, self.coef_, self.intercept_, lambda f, t: f - t, self.epoch_, self.epoch_ + epochs)
        self.epoch_, self.fitted = self.epoch_ + epochs, True
        return self

    def predict(self, df, features=None, out="prediction"):
        return df.withColumn(out, dot(self._ready(df, features), self.coef_, float(self.intercept_)))


class QuantileRegressor(Predictor):
    """Pinball loss plus n alpha |w|, as a linear program: its dual by a primal-dual interior point.

    The dual has bounds on the rows' shares and a constraint for each weight; then the weights go to the corner of the rows
    that are free in it.  The driver holds all rows' numbers.
    """

    defaults = {"quantile": 0.5, "alpha": 1.0, "fit_intercept": True, "solver": "interior-point"}

    def fit(self, df, features, label, id_col=None):
        if not 0 < self.quantile < 1:
            raise ValueError("quantile lies between 0 and 1")
        self._start(df, features, label)
        x, y = collect_rows(df, features, label)
        if not len(y):
            raise ValueError("empty input")
        (n, p), share = x.shape, 1 - self.quantile
        one = np.c_[x, np.ones(n)] if self.fit_intercept else x
        cost, wide, least = -y, one, share * one.sum(axis=0)
        upper = np.ones(n)
        if self.alpha:  # the penalty: each weight's constraint may be off by n alpha
            bound = n * self.alpha
            cost, wide, upper = np.r_[cost, np.zeros(p)], np.r_[one, np.eye(one.shape[1])[:p]], np.r_[upper, np.full(p, 2 * bound)]
            least = least + np.r_[np.full(p, bound), np.zeros(one.shape[1] - p)]
        a, _, w, self.n_iter_ = box_program(np.zeros((len(wide), 0)), cost, wide, least, upper)

        def loss(w):
            r = y - one @ w
            return float(np.maximum(self.quantile * r, -share * r).sum() + n * self.alpha * np.abs(w[:p]).sum())

        # A corner: rows (and weights of zero) whose shares are free, the freest first, as long as they are independent.
        corner, goal = np.zeros((0, one.shape[1])), []
        for i in np.argsort(-np.minimum(a, upper - a) / upper, kind="stable")[: 50 * one.shape[1]]:
            more = np.r_[corner, wide[i : i + 1]]
            if np.linalg.matrix_rank(more / np.maximum(np.abs(wide).max(axis=0), 1e-300)) > len(corner):
                corner, goal = more, [*goal, -cost[i]]
            if len(corner) == one.shape[1]:
                best = np.linalg.solve(corner, goal)
                w = best if loss(best) <= loss(w) * (1 + 1e-9) else w
                break
        self.coef_, self.intercept_, self.fitted = w[:p], float(w[p]) if self.fit_intercept else 0.0, True
        return self

    def predict(self, df, features=None, out="prediction"):
        return df.withColumn(out, dot(self._ready(df, features), self.coef_, self.intercept_))


def interior_point(c: np.ndarray, a: np.ndarray, b: np.ndarray, tol: float = 1e-9, max_iter: int = 200) -> tuple[np.ndarray, int]:
    """min c'x, a x = b, x >= 0 by predictor-corrector steps."""
    m, n = a.shape
    normal = a @ a.T + 1e-10 * np.eye(m)
    x, y = a.T @ np.linalg.solve(normal, b), np.linalg.solve(normal, a @ c)
    s = c - a.T @ y
    x, s = x + max(-1.5 * x.min(), 0.0), s + max(-1.5 * s.min(), 0.0)
    gap = x @ s
    x, s = x + 0.5 * gap / max(s.sum(), 1e-12) + 1e-9, s + 0.5 * gap / max(x.sum(), 1e-12) + 1e-9

    def step(v, d):
        low = d < 0
        return min(1.0, 0.99 * float((-v[low] / d[low]).min())) if low.any() else 1.0

    for k in range(1, max_iter + 1):
        rp, rd, mu = b - a @ x, c - a.T @ y - s, x @ s / n
        if max(np.abs(rp).max() / (1 + np.abs(b).max()), np.abs(rd).max() / (1 + np.abs(c).max()), mu) < tol:
            break
        d = x / s
        kkt = (a * d) @ a.T
        kkt[np.diag_indices(m)] += 1e-12 * max(1.0, np.trace(kkt) / m)
        inv = np.linalg.inv(kkt)

        def direction(rc, inv=inv, d=d, rp=rp, rd=rd, x=x, s=s):
            dy = inv @ (rp + a @ (d * rd - rc / s))
            ds = rd - a.T @ dy
            return (rc - x * ds) / s, dy, ds

        dx, dy, ds = direction(-x * s)
        affine = (x + step(x, dx) * dx) @ (s + step(s, ds) * ds) / n
        dx, dy, ds = direction((affine / mu) ** 3 * mu - x * s - dx * ds)
        ap, ad = step(x, dx), step(s, ds)
        x, y, s = np.maximum(x + ap * dx, 1e-300), y + ad * dy, np.maximum(s + ad * ds, 1e-300)
    return x, k


def kernel_pair(name: str, gamma: float, degree: int, coef0: float):
    """A kernel's matrix and diagonal as functions of rows, for a factor: the sigmoid is none of a scalar product."""
    from millrace.functions.metrics import kernel

    if name == "sigmoid":
        raise ValueError(f"more than {MAX_ROWS} rows: the sigmoid kernel is indefinite and needs all of them in one place; raise max_rows or use another")

    def k(x, z):
        return kernel(name, x, z, gamma, degree, coef0)

    def own(x):
        return np.array([k(r[None], r[None])[0, 0] for r in x]) if name not in ("rbf", "linear") else np.ones(len(x)) if name == "rbf" else (x * x).sum(axis=1)

    return k, own


class KernelRidge(Predictor):
    """(K + alpha I) a = y; scoring is batched numpy against the fitted rows.

    Beyond ``max_rows`` rows they stay in Spark, and the kernel's pivots take their place.
    """

    defaults = {"alpha": 1.0, "kernel": "linear", "gamma": 0.0, "degree": 3, "coef0": 1.0}
    max_rows = MAX_ROWS

    def fit(self, df, features, label, id_col=None):
        cols = self._start(df, features, label)
        self.gamma_ = self.gamma or 1 / self.width
        if df.limit(self.max_rows + 1).count() > self.max_rows:
            return self._fit_far(stats.training_rows(df, cols, [F.col(label)]))
        self.X_fit_, y, _ = collect_bounded(df, features, label, id_col, self.max_rows)
        k = self._kernel(self.X_fit_)
        self.dual_coef_, self.fitted = np.linalg.solve(k + self.alpha * np.eye(len(k)), y), True
        return self

    def _fit_far(self, rows):
        from millrace.functions import lowrank

        k, own = kernel_pair(self.kernel, self.gamma_, self.degree, self.coef0)
        f = lowrank.factor(rows, k, own, self.width)
        w, _, _, _ = lowrank.ridge(rows, f, self.width, self.alpha)
        self.X_fit_, self.dual_coef_, self.fitted = f.pivots, f.dual(w), True
        return self

    def _kernel(self, x):
        from millrace.functions.metrics import kernel

        return kernel(self.kernel, x, self.X_fit_, self.gamma_, self.degree, self.coef0)

    def predict(self, df, features=None, out="prediction"):
        from millrace.functions.metrics import kernel

        fit, a, args = self.X_fit_, self.dual_coef_, (self.gamma_, self.degree, self.coef0)
        name = self.kernel
        return df.withColumn(out, row_function(lambda x: kernel(name, x, fit, *args) @ a, self._ready(df, features)))


class IsotonicRegression(Predictor):
    """Pool adjacent violators over mean-merged ties; only the merged points reach the driver."""

    defaults = {"y_min": None, "y_max": None, "increasing": True, "out_of_bounds": "nan"}
    max_points = 1_000_000

    def fit(self, df, features, label):
        c = self._start(df, features, label)[0]
        y = F.col(label).cast("double")
        points = df.groupBy(c.alias("x")).agg(F.sum(y).alias("s"), F.count(y).alias("n"), F.sum(y * y).alias("q"))
        rows = sorted((r["x"], r["s"], r["n"]) for r in points.limit(self.max_points + 1).collect())
        if not rows:
            raise ValueError("empty input")
        if len(rows) > self.max_points:
            raise ValueError(f"more than {self.max_points} distinct values of x")
        x, s, n = (np.array(v, float) for v in zip(*rows))
        mean = s / n
        rising = self.increasing
        if rising == "auto":
            rising = float(((x - np.average(x, weights=n)) * mean * n).sum()) >= 0
        self.increasing_resolved_ = bool(rising)
        fitted = pool_adjacent(mean if rising else -mean, n) * (1 if rising else -1)
        low, high = -np.inf if self.y_min is None else self.y_min, np.inf if self.y_max is None else self.y_max
        fitted = np.clip(fitted, low, high)
        keep = np.ones(len(x), bool)
        keep[1:-1] = (fitted[1:-1] != fitted[:-2]) | (fitted[1:-1] != fitted[2:])
        self.X_min_, self.X_max_ = float(x[0]), float(x[-1])
        self.X_thresholds_, self.y_thresholds_, self.fitted = x[keep], fitted[keep], True
        return self

    def predict(self, df, features=None, out="prediction"):
        """Linear interpolation between thresholds; outside: nan, clip or an error."""
        c = self._ready(df, features)[0]
        x, y = self.X_thresholds_, self.y_thresholds_
        p = row_function(lambda v: np.interp(v[:, 0], x, y), [c])
        outside = (c < self.X_min_) | (c > self.X_max_)
        if self.out_of_bounds == "nan":
            p = F.when(outside, F.lit(float("nan"))).otherwise(p)
        elif self.out_of_bounds == "raise":
            p = F.when(outside, F.raise_error(F.lit("x lies outside the fitted range")).cast("double")).otherwise(p)
        elif self.out_of_bounds != "clip":
            raise ValueError("out_of_bounds is nan, clip or raise")
        return df.withColumn(out, p)

    transform = predict


def pool_adjacent(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted means of the blocks into which violators pool."""
    value, weight, size = [], [], []
    for v, k in zip(y, w):
        value.append(v)
        weight.append(k)
        size.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            k = weight[-2] + weight[-1]
            value[-2:] = [(value[-2] * weight[-2] + value[-1] * weight[-1]) / k]
            weight[-2:], size[-2:] = [k], [size[-2] + size[-1]]
    return np.repeat(value, size)


__all__ = [n for n in dir() if n[0].isupper()] + ["columns", "coordinate_descent", "interior_point", "pool_adjacent"]
