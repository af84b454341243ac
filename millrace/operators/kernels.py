"""Support vector machines, multilayer perceptrons and Gaussian processes.

Kernel machines up to ``max_rows`` rows work on the kernel's matrix, beyond on its pivots' features, which the driver holds
for all rows; Gaussian processes leave the rows in Spark then.  Linear
machines and perceptrons do up to that number, for passes in a set order; more rows stay in Spark, where tasks
pass over their own rows and their weights are averaged after each epoch.  Scoring is batched numpy
against the fitted arrays, on any number of rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import interior, lowrank, stats
from millrace.functions.core import MAX_ROWS, Classifier, Estimator, Predictor, argmax, classes_of, collect_bounded, collect_rows, dot, row_function
from millrace.functions.metrics import kernel
from millrace.functions.special import erf, sigmoid, softmax


def _labels(y):
    return [int(c) if float(c).is_integer() else float(c) for c in np.unique(y)]


class LinearSVC(Classifier):
    """Hinge or squared hinge by stochastic gradients, one against the rest; beyond ``max_rows`` by averaged passes."""

    defaults = {"C": 1.0, "loss": "squared_hinge", "tol": 1e-4, "max_iter": 1000, "fit_intercept": True, "random_state": None}
    max_rows = MAX_ROWS * 20

    def fit(self, df, features, label, id_col=None):
        cols = self._start(df, features, label)
        if df.limit(self.max_rows + 1).count() > self.max_rows:
            self.classes_ = classes_of(df, label)
            if len(self.classes_) < 2:
                raise ValueError("one class only")
            rows = stats.training_rows(df, cols, [F.col(label)])
            got = [self._head_far(rows, c) for c in (self.classes_[1:] if len(self.classes_) == 2 else self.classes_)]
            self.coef_, self.intercept_ = np.array([w for w, _ in got]), np.array([b for _, b in got])
            self.fitted = True
            return self
        x, y, _ = collect_bounded(df, features, label, id_col, self.max_rows)
        self.classes_ = _labels(y)
        if len(self.classes_) < 2:
            raise ValueError("one class only")
        heads = self.classes_[1:] if len(self.classes_) == 2 else self.classes_
        got = [self._head(x, np.where(y == c, 1.0, -1.0)) for c in heads]
        self.coef_, self.intercept_ = np.array([w for w, _ in got]), np.array([b for _, b in got])
        self.fitted = True
        return self

    def _head_far(self, rows, c):
        n, scale, each = _sizes(rows)
        lam, squared, tol, seed, free = 1 / (self.C * n), self.loss == "squared_hinge", self.tol, self.random_state or 0, self.fit_intercept

        def epoch(x, y, s, k, seen):
            w, b, t, y = s[:-1].copy(), s[-1], k * each + seen, np.where(y[:, 0] == c, 1.0, -1.0)
            for i in np.random.default_rng([seed, k, seen]).permutation(len(x)):
                t += 1
                rate = 1 / (2 * scale + lam * t)
                m = 1 - y[i] * (x[i] @ w + b)
                w *= 1 - rate * lam
                if m > 0:
                    step = rate * y[i] * (2 * m if squared else 1)
                    w += step * x[i]
                    b += step * free
            return np.r_[w, b], 0.0

        s, _, _ = stats.mixed_epochs(rows, np.zeros(self.width + 1), epoch, 0, self.max_iter, lambda old, new, _: np.abs(new - old)[:-1].max() < tol)
        return s[:-1], float(s[-1])

    def _head(self, x, y):
        rng, n = np.random.default_rng(self.random_state), len(x)
        lam, scale = 1 / (self.C * n), float((x * x).sum(axis=1).max()) + 1
        w, b, t = np.zeros(x.shape[1]), 0.0, 0
        for _ in range(self.max_iter):
            before = w.copy()
            for i in rng.permutation(n):
                t += 1
                rate = 1 / (2 * scale + lam * t)
                m = 1 - y[i] * (x[i] @ w + b)
                w *= 1 - rate * lam
                if m > 0:
                    k = rate * y[i] * (2 * m if self.loss == "squared_hinge" else 1)
                    w += k * x[i]
                    b += k * self.fit_intercept
            if np.abs(w - before).max() < self.tol:
                break
        return w, b

    def decision_function(self, df, features=None, out="decision"):
        s = [dot(self._ready(df, features), w, b) for w, b in zip(self.coef_, self.intercept_)]
        return df.withColumn(out, s[0] if len(s) == 1 else F.array(*s))

    def predict(self, df, features=None, out="prediction"):
        s = [dot(self._ready(df, features), w, b) for w, b in zip(self.coef_, self.intercept_)]
        if len(s) == 1:
            return df.withColumn(out, F.when(s[0] >= 0, F.lit(self.classes_[1])).otherwise(F.lit(self.classes_[0])))
        return df.withColumn(out, argmax(s, self.classes_))


class LinearSVR(Predictor):
    """Epsilon-insensitive loss (plain or squared) by stochastic gradients; beyond ``max_rows`` by averaged passes."""

    defaults = {"C": 1.0, "epsilon": 0.0, "loss": "epsilon_insensitive", "tol": 1e-4, "max_iter": 1000, "fit_intercept": True, "random_state": None}
    max_rows = MAX_ROWS * 20

    def fit(self, df, features, label, id_col=None):
        cols = self._start(df, features, label)
        if df.limit(self.max_rows + 1).count() > self.max_rows:
            return self._fit_far(stats.training_rows(df, cols, [F.col(label)]))
        x, y, _ = collect_bounded(df, features, label, id_col, self.max_rows)
        rng, n = np.random.default_rng(self.random_state), len(x)
        lam, scale = 1 / (self.C * n), float((x * x).sum(axis=1).max()) + 1
        w, b, t = np.zeros(x.shape[1]), float(y.mean()) if self.fit_intercept else 0.0, 0
        for _ in range(self.max_iter):
            before = w.copy()
            for i in rng.permutation(n):
                t += 1
                r = y[i] - x[i] @ w - b
                far = abs(r) - self.epsilon
                rate = 1 / (scale * (2 if "squared" in self.loss else 1) + lam * t) if "squared" in self.loss else float(np.std(y) + 1e-12) / (scale * math.sqrt(t))
                w *= 1 - rate * lam
                if far > 0:
                    k = rate * np.sign(r) * (2 * far if "squared" in self.loss else 1)
                    w += k * x[i]
                    b += k * self.fit_intercept
            if np.abs(w - before).max() < self.tol:
                break
        self.coef_, self.intercept_, self.fitted = w, float(b), True
        return self

    def _fit_far(self, rows):
        n, scale, each = _sizes(rows)
        r = rows.agg(F.avg(F.col("y")[0]).alias("m"), F.stddev_pop(F.col("y")[0]).alias("s")).first()
        lam, squared, spread, eps, seed, free, tol = 1 / (self.C * n), "squared" in self.loss, r["s"] + 1e-12, self.epsilon, self.random_state or 0, self.fit_intercept, self.tol

        def epoch(x, y, s, k, seen):
            w, b, t = s[:-1].copy(), s[-1], k * each + seen
            for i in np.random.default_rng([seed, k, seen]).permutation(len(x)):
                t += 1
                gap = y[i, 0] - x[i] @ w - b
                far = abs(gap) - eps
                rate = 1 / (2 * scale + lam * t) if squared else spread / (scale * math.sqrt(t))
                w *= 1 - rate * lam
                if far > 0:
                    step = rate * np.sign(gap) * (2 * far if squared else 1)
                    w += step * x[i]
                    b += step * free
            return np.r_[w, b], 0.0

        s, _, _ = stats.mixed_epochs(rows, np.r_[np.zeros(self.width), r["m"] if free else 0.0], epoch, 0, self.max_iter, lambda old, new, _: np.abs(new - old)[:-1].max() < tol)
        self.coef_, self.intercept_, self.fitted = s[:-1], float(s[-1]), True
        return self

    def predict(self, df, features=None, out="prediction"):
        return df.withColumn(out, dot(self._ready(df, features), self.coef_, self.intercept_))


def _sizes(rows):
    """The number of rows, the largest squared length and one, and the rows of a task on the average."""
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("q")).first()
    return r["n"], float(r["q"]) + 1, r["n"] / max(1, rows.rdd.getNumPartitions())


def pair_steps(q: np.ndarray, p: np.ndarray, y: np.ndarray, a: np.ndarray, upper: np.ndarray, tol: float, max_iter: int, same_sign: bool = False) -> tuple[np.ndarray, float]:
    """min a'Qa/2 + p'a with y'a fixed and 0 <= a <= upper, by maximal violating pairs of second order.

    ``same_sign``: pairs come from one class at a time, which keeps each class's sum (nu classification).
    Returns a and the mean threshold of the free points.
    """
    g = q @ a + p
    diag = np.diag(q)
    for _ in range(max_iter):
        best = (tol, None)
        for s in (1, -1) if same_sign else (0,):
            own = y == s if s else np.ones(len(y), bool)
            v = -y * g
            up = own & np.where(y > 0, a < upper - 1e-12, a > 1e-12)
            low = own & np.where(y > 0, a > 1e-12, a < upper - 1e-12)
            if not up.any() or not low.any():
                continue
            i = int(np.where(up, v, -np.inf).argmax())
            gap = v[i] - np.where(low, v, np.inf).min()
            if gap > best[0]:
                curve = np.maximum(diag[i] + diag - 2 * y[i] * y * q[i], 1e-12)
                j = int(np.where(low & (v < v[i]), (v[i] - v) ** 2 / curve, -np.inf).argmax())
                best = (gap, (i, j, (v[i] - v[j]) / curve[j]))
        if best[1] is None:
            break
        i, j, step = best[1]
        step = min(step, upper[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else upper[j] - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += step * (y[i] * q[i] - y[j] * q[j])
    return a, g


class _Kernel(Estimator):
    max_rows = MAX_ROWS

    def _load(self, df, features, label, id_col):
        """X and y; beyond ``max_rows`` rows ``_factor`` is the kernel's, and its features stand for the matrix."""
        self._start(df, features, label)
        self._factor = None
        far = df.limit(self.max_rows + 1).count() > self.max_rows
        x, y = collect_rows(df, features, label) if far else collect_bounded(df, features, label, id_col, self.max_rows)[:2]
        self.gamma_ = self.gamma or 1 / (x.shape[1] * max(float(x.var()), 1e-300))
        if far:
            from millrace.operators.linear import kernel_pair

            self._factor = lowrank.Factor(*kernel_pair(self.kernel, self.gamma_, self.degree, self.coef0), self.width)
            self._factor.grow(x)
        return x, y

    def _matrix(self, x, z):
        return kernel(self.kernel, x, z, self.gamma_, self.degree, self.coef0)

    def _keep(self, x, dual, b):
        at = np.flatnonzero(np.abs(dual) > 1e-10)
        self.support_, self.n_support_, self.dual_coef_, self.support_vectors_, self.intercept_ = at, len(at), dual[at], x[at], float(b)
        self.fitted = True
        return self

    def _keep_far(self, a, upper, w, b):
        """The pivots and their weights score as the support vectors would; ``support_`` has the rows' numbers."""
        self.support_ = np.flatnonzero(np.abs(a) > 1e-7 * upper)
        self.n_support_, self.dual_coef_, self.support_vectors_, self.intercept_ = len(self.support_), self._factor.dual(w), self._factor.pivots, float(b)
        self.fitted = True
        return self

    def _decide(self, df, features):
        args = (self.gamma_, self.degree, self.coef0)
        v, d, b, name = self.support_vectors_, self.dual_coef_, self.intercept_, self.kernel
        return row_function(lambda x: kernel(name, x, v, *args) @ d + b, self._ready(df, features))

    def decision_function(self, df, features=None, out="decision"):
        return df.withColumn(out, self._decide(df, features))


class _Binary(_Kernel, Classifier):
    def _two(self, y):
        self.classes_ = _labels(y)
        if len(self.classes_) != 2:
            raise ValueError("two classes are needed")
        return np.where(y == self.classes_[1], 1.0, -1.0)

    def predict(self, df, features=None, out="prediction"):
        d = self.decision_function(df, features, "_d")
        return d.withColumn(out, F.when(F.col("_d") >= 0, F.lit(self.classes_[1])).otherwise(F.lit(self.classes_[0]))).drop("_d")


class SVC(_Binary):
    """C-classification; ``probability`` fits a sigmoid on five-fold decisions."""

    defaults = {"C": 1.0, "kernel": "rbf", "degree": 3, "gamma": 0.0, "coef0": 0.0, "probability": False, "tol": 1e-3, "max_passes": 50, "random_state": None}

    def _solve(self, x, y):
        q = self._matrix(x, x) * np.outer(y, y)
        a, g = pair_steps(q, -np.ones(len(y)), y, np.zeros(len(y)), np.full(len(y), self.C), self.tol, max(self.max_passes, 1000) * (len(y) + 1))
        free = (a > 1e-8) & (a < self.C - 1e-8)
        v = -y * g
        b = v[free].mean() if free.any() else (v.max() + v.min()) / 2
        return a * y, b

    def _solve_far(self, v, y):
        upper = np.full(len(y), self.C)
        a, w, b, _ = interior.box_program(v * y[:, None], -np.ones(len(y)), y[:, None], np.zeros(1), upper)
        return a, w, float(b[0])

    def fit(self, df, features, label, id_col=None):
        x, t = self._load(df, features, label, id_col)
        y = self._two(t)
        v = self._factor.features(x) if self._factor else None
        if self._factor:
            a, w, b = self._solve_far(v, y)
            self._keep_far(a, self.C, w, b)
        else:
            self._keep(x, *self._solve(x, y))
        if self.probability:
            from millrace.operators.selection import platt

            order = np.random.default_rng(self.random_state).permutation(len(y))
            d = np.zeros(len(y))
            for part in np.array_split(order, 5):
                rest = np.setdiff1d(order, part)
                if self._factor:
                    _, w, b = self._solve_far(v[rest], y[rest])
                    d[part] = v[part] @ w + b
                    continue
                w, b = self._solve(x[rest], y[rest])
                d[part] = self._matrix(x[part], x[rest]) @ w + b
            self.platt_ = platt(d, y > 0)
        return self

    def predict_proba(self, df, features=None, out="probability"):
        if not self.probability:
            raise ValueError("fit with probability=True first")
        a, b = self.platt_
        d = self.decision_function(df, features, "_d")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("_d") * float(a) + float(b)))
        return d.withColumn(out, F.array(F.lit(1.0) - p, p)).drop("_d")


class NuSVC(_Binary):
    """nu-classification: each class has the same share of the dual mass."""

    defaults = {"nu": 0.5, "kernel": "rbf", "degree": 3, "gamma": 0.0, "coef0": 0.0, "tol": 1e-3, "max_passes": 50, "random_state": None}

    def fit(self, df, features, label, id_col=None):
        x, t = self._load(df, features, label, id_col)
        y = self._two(t)
        n = len(y)
        mass = self.nu * n / 2
        if not 0 < self.nu <= 1 or mass > min((y > 0).sum(), (y < 0).sum()):
            raise ValueError("nu is infeasible")
        if self._factor:
            v = self._factor.features(x)
            a, w, level, _ = interior.box_program(v * y[:, None], np.zeros(n), np.c_[y > 0, y < 0].astype(float), np.full(2, mass), np.ones(n))
            r = -level
            rho = (r[0] + r[1]) / 2 or 1.0
            return self._keep_far(a, 1.0, w / rho, -(r[0] - r[1]) / 2 / rho)
        a = np.zeros(n)
        for s in (1, -1):
            left = mass
            for i in np.flatnonzero(y == s):
                a[i] = min(1.0, left)
                left -= a[i]
        q = self._matrix(x, x) * np.outer(y, y)
        a, g = pair_steps(q, np.zeros(n), y, a, np.ones(n), self.tol, max(self.max_passes, 1000) * (n + 1), same_sign=True)
        r = [np.mean(g[(y == s) & (a > 1e-8) & (a < 1 - 1e-8)]) if ((y == s) & (a > 1e-8) & (a < 1 - 1e-8)).any() else g[y == s].mean() for s in (1, -1)]
        rho = (r[0] + r[1]) / 2 or 1.0
        return self._keep(x, a * y / rho, -(r[0] - r[1]) / 2 / rho)


class _Regression(_Kernel, Predictor):
    def predict(self, df, features=None, out="prediction"):
        return df.withColumn(out, self._decide(df, features))

    def _svr_far(self, v, y, c, epsilon):
        """Differences of the duals, the weights and the threshold; without a tube a row has one dual between -c and c."""
        one = np.ones((len(y), 1))
        if epsilon:
            a, w, b, _ = interior.box_program(np.r_[v, -v], np.r_[epsilon - y, epsilon + y], np.r_[one, -one], np.zeros(1), np.full(2 * len(y), c))
            return a[: len(y)] - a[len(y) :], w, float(b[0])
        # The program's unknowns are the duals and c; what c adds to the weights comes off again.
        shift = c * v.sum(axis=0)
        a, u, b, _ = interior.box_program(v, -y - v @ shift, one, np.array([c * len(y)]), np.full(len(y), 2 * c))
        return a - c, u - shift, float(b[0])

    def _svr(self, x, y, c, epsilon):
        n = len(y)
        k = self._matrix(x, x)
        q = np.block([[k, -k], [-k, k]])
        sign = np.r_[np.ones(n), -np.ones(n)]
        p = np.r_[epsilon - y, epsilon + y]
        a, g = pair_steps(q, p, sign, np.zeros(2 * n), np.full(2 * n, c), self.tol, max(self.max_iter, 100) * (n + 1))
        v = -sign * g
        free = (a > 1e-8) & (a < c - 1e-8)
        b = v[free].mean() if free.any() else (v.max() + v.min()) / 2
        return a[:n] - a[n:], float(b), k


class SVR(_Regression):
    """Epsilon-insensitive regression by its dual."""

    defaults = {"C": 1.0, "kernel": "rbf", "degree": 3, "gamma": 0.0, "coef0": 0.0, "epsilon": 0.1, "tol": 1e-3, "max_iter": 1000, "random_state": None}

    def fit(self, df, features, label, id_col=None):
        x, y = self._load(df, features, label, id_col)
        if self._factor:
            dual, w, b = self._svr_far(self._factor.features(x), y, self.C, self.epsilon)
            return self._keep_far(dual, self.C, w, b)
        dual, b, _ = self._svr(x, y, self.C, self.epsilon)
        return self._keep(x, dual, b)


class NuSVR(_Regression):
    """The tube's width is the (1 - nu) quantile of a first fit's residuals."""

    defaults = {"nu": 0.5, "C": 1.0, "kernel": "rbf", "degree": 3, "gamma": 0.0, "coef0": 0.0, "tol": 1e-3, "max_iter": 1000, "random_state": None}

    def fit(self, df, features, label, id_col=None):
        if not 0 < self.nu <= 1:
            raise ValueError("nu lies in (0, 1]")
        x, y = self._load(df, features, label, id_col)
        if self._factor:
            v = self._factor.features(x)
            _, w, b = self._svr_far(v, y, self.C, 0.0)
            self.epsilon_fitted_ = float(np.quantile(np.abs(y - v @ w - b), 1 - self.nu))
            dual, w, b = self._svr_far(v, y, self.C, self.epsilon_fitted_)
            return self._keep_far(dual, self.C, w, b)
        dual, b, k = self._svr(x, y, self.C, 0.0)
        self.epsilon_fitted_ = float(np.quantile(np.abs(y - k @ dual - b), 1 - self.nu))
        dual, b, _ = self._svr(x, y, self.C, self.epsilon_fitted_)
        return self._keep(x, dual, b)


class OneClassSVM(_Kernel):
    """Support of the rows' distribution: about a share nu lies outside."""

    defaults = {"kernel": "rbf", "degree": 3, "gamma": 0.0, "coef0": 0.0, "nu": 0.5, "tol": 1e-3, "max_passes": 50, "random_state": None}

    def fit(self, df, features, id_col=None):
        if not 0 < self.nu <= 1:
            raise ValueError("nu lies in (0, 1]")
        x, _ = self._load(df, features, None, id_col)
        n = len(x)
        if self._factor:
            v, upper = self._factor.features(x), 1 / (self.nu * n)
            a, w, _, _ = interior.box_program(v, np.zeros(n), np.ones((n, 1)), np.ones(1), np.full(n, upper))
            scores = np.sort(self._factor.k(x, self._factor.pivots) @ self._factor.dual(w))
            self.offset_ = float(scores[max(math.ceil(self.nu * n * (1 - 1e-12)) - 1, 0)])
            return self._keep_far(a, upper, w, -self.offset_)
        q, upper = self._matrix(x, x), 1 / (self.nu * n)
        a, g = pair_steps(q, np.zeros(n), np.ones(n), np.full(n, 1 / n), np.full(n, upper), self.tol * 1e-2, max(self.max_passes, 1000) * (n + 1))
        s = np.sort(g)
        level = float(s[min(int(self.nu * n), n - 1)])
        free = (a > 1e-10) & (a < upper - 1e-10)
        rho = min(float(g[free][np.abs(g[free] - level).argmin()]), level) if free.any() else level
        self.offset_ = rho
        return self._keep(x, a, -rho)

    def score_samples(self, df, features=None, out="score"):
        return df.withColumn(out, self._decide(df, features) + self.offset_)

    def predict(self, df, features=None, out="prediction"):
        return self.decision_function(df, features, "_d").withColumn(out, F.when(F.col("_d") >= 0, 1).otherwise(-1)).drop("_d")


ACTIVATIONS = {
    "identity": (lambda z: z, lambda a: np.ones_like(a)),
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "logistic": (sigmoid, lambda a: a * (1 - a)),
}


class _Perceptrons(Estimator):
    """Beyond ``max_rows`` rows stay in Spark and passes are averaged."""

    defaults = {"hidden_layer_sizes": (100,), "activation": "relu", "solver": "adam", "alpha": 1e-4, "learning_rate_init": 1e-3, "max_iter": 200, "tol": 1e-4, "batch_size": 0, "random_state": None, "beta_1": 0.9, "beta_2": 0.999, "epsilon": 1e-8}
    max_rows = MAX_ROWS * 20

    def _train(self, x, t, head):
        """``head``: raw outputs to predictions whose error against ``t`` is the output layer's gradient."""
        if self.solver not in ("adam", "sgd"):
            raise ValueError("solver is adam or sgd")
        rng, n = np.random.default_rng(self.random_state), len(x)
        params = self._first(rng, x.shape[1], t.shape[1])
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        last, still = np.inf, 0
        for self.n_iter_run_ in range(1, self.max_iter + 1):
            total, step = self._epoch(x, t, rng.permutation(n), params, m, v, step, head, self.batch_size or min(200, n))
            self.loss_ = total / n
            still = still + 1 if last - self.loss_ < self.tol else 0
            last = min(last, self.loss_)
            if still >= 10:
                break
        self._keep(params)
        return self

    def _first(self, rng, p, q):
        sizes = [p, *self.hidden_layer_sizes, q]
        bound = [math.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:])]
        return [*[rng.uniform(-s, s, (a, b)) for s, a, b in zip(bound, sizes, sizes[1:])], *[np.zeros(b) for b in sizes[1:]]]

    def _keep(self, params):
        half = len(params) // 2
        self.coefs_, self.intercepts_, self.fitted = params[:half], params[half:], True

    def _epoch(self, x, t, order, params, m, v, step, head, batch):
        """One pass in the order given, changing weights and moments in place; the summed loss and the number of steps."""
        f, slope = ACTIVATIONS[self.activation]
        ws, bs, total = params[: len(params) // 2], params[len(params) // 2 :], 0.0
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            acts = [x[rows]]
            for w, b in zip(ws[:-1], bs[:-1]):
                acts.append(f(acts[-1] @ w + b))
            out = head(acts[-1] @ ws[-1] + bs[-1])
            total += self._loss(out, t[rows]) * len(rows)
            d, gw, gb = (out - t[rows]) / len(rows), [], []
            for k in range(len(ws) - 1, -1, -1):
                gw.insert(0, acts[k].T @ d + self.alpha * ws[k])
                gb.insert(0, d.sum(axis=0))
                if k:
                    d = (d @ ws[k].T) * slope(acts[k])
            step += 1
            for i, (p, g) in enumerate(zip(params, [*gw, *gb])):
                if self.solver == "sgd":
                    p -= self.learning_rate_init * g
                    continue
                m[i][...] = self.beta_1 * m[i] + (1 - self.beta_1) * g
                v[i][...] = self.beta_2 * v[i] + (1 - self.beta_2) * g * g
                p -= self.learning_rate_init * (m[i] / (1 - self.beta_1**step)) / (np.sqrt(v[i] / (1 - self.beta_2**step)) + self.epsilon)
        return total, step

    def _train_far(self, rows, q, target, head):
        """Averaged passes: the state holds the weights, their moments and the number of steps."""
        if self.solver not in ("adam", "sgd"):
            raise ValueError("solver is adam or sgd")
        first = self._first(np.random.default_rng(self.random_state), self.width, q)
        shapes, seed, size, watch = [p.shape for p in first], self.random_state or 0, sum(p.size for p in first), {"last": np.inf, "still": 0}

        def split(s):
            out, at = [], 0
            for _ in range(3):
                own = []
                for shape in shapes:
                    own.append(s[at : at + math.prod(shape)].reshape(shape).copy())
                    at += math.prod(shape)
                out.append(own)
            return out

        def epoch(x, y, s, k, seen):
            params, m, v = split(s)
            order = np.random.default_rng([seed, k, seen]).permutation(len(x))
            total, step = self._epoch(x, target(y), order, params, m, v, round(s[-1]), head, self.batch_size or 200)
            return np.r_[np.concatenate([a.ravel() for a in (*params, *m, *v)]), float(step)], total

        def done(old, new, loss):
            watch["still"] = watch["still"] + 1 if watch["last"] - loss < self.tol else 0
            watch["last"] = min(watch["last"], loss)
            return watch["still"] >= 10

        start = np.r_[np.concatenate([p.ravel() for p in first]), np.zeros(2 * size + 1)]
        state, self.loss_, self.n_iter_run_ = stats.mixed_epochs(rows, start, epoch, 0, self.max_iter, done)
        self._keep(split(state)[0])
        return self

    def _forward(self, head):
        f, ws, bs = ACTIVATIONS[self.activation][0], self.coefs_, self.intercepts_

        def run(x):
            for w, b in zip(ws[:-1], bs[:-1]):
                x = f(x @ w + b)
            return head(x @ ws[-1] + bs[-1])

        return run


class MLPRegressor(_Perceptrons, Predictor):
    def fit(self, df, features, label, id_col=None):
        labels = [label] if isinstance(label, str) else list(label)
        cols = self._start(df, features, labels[0])
        self.n_outputs_ = len(labels)
        if df.limit(self.max_rows + 1).count() > self.max_rows:
            return self._train_far(stats.training_rows(df, cols, [F.col(c) for c in labels]), len(labels), lambda y: y, lambda z: z)
        x, y, _ = collect_bounded(df, features, labels, id_col, self.max_rows)
        return self._train(x, y, lambda z: z)

    def fit_multi(self, df, features, labels, id_col=None):
        return self.fit(df, features, list(labels), id_col)

    def _loss(self, out, t):
        return float(((out - t) ** 2).sum(axis=1).mean() / 2)

    def predict(self, df, features=None, out="prediction"):
        v = row_function(self._forward(lambda z: z), self._ready(df, features), "array<double>")
        return df.withColumn(out, v if self.n_outputs_ > 1 else v[0])

    predict_multi = predict


class MLPClassifier(_Perceptrons, Classifier):
    def fit(self, df, features, label, id_col=None):
        cols = self._start(df, features, label)
        if df.limit(self.max_rows + 1).count() > self.max_rows:
            self.classes_ = classes_of(df, label)
            self.n_classes_ = k = len(self.classes_)
            if k < 2:
                raise ValueError("one class only")
            named = np.array(self.classes_, float)[1 if k == 2 else 0 :]
            return self._train_far(stats.training_rows(df, cols, [F.col(label)]), len(named), lambda y: (y == named[None]).astype(float), self._head())
        x, y, _ = collect_bounded(df, features, label, id_col, self.max_rows)
        self.classes_ = _labels(y)
        self.n_classes_ = len(self.classes_)
        if self.n_classes_ < 2:
            raise ValueError("one class only")
        hot = (y[:, None] == np.array(self.classes_)[None]).astype(float)
        return self._train(x, hot[:, 1:] if self.n_classes_ == 2 else hot, self._head())

    def _head(self):
        return sigmoid if self.n_classes_ == 2 else softmax

    def _loss(self, out, t):
        p = np.clip(out, 1e-12, 1 - 1e-12)
        return float(-(t * np.log(p) + ((1 - t) * np.log(1 - p) if t.shape[1] == 1 else 0)).sum(axis=1).mean())

    def predict_proba(self, df, features=None, out="probability"):
        run = self._forward(self._head())
        two = self.n_classes_ == 2
        return df.withColumn(out, row_function(lambda x: np.hstack([1 - run(x), run(x)]) if two else run(x), self._ready(df, features), "array<double>"))

    def predict(self, df, features=None, out="prediction"):
        p = self.predict_proba(df, features, "_p")
        return p.withColumn(out, F.get(F.array(*[F.lit(c) for c in self.classes_]), (F.array_position("_p", F.array_max("_p")) - 1).cast("int"))).drop("_p")


def gp_kernel(p: dict, x: np.ndarray, z: np.ndarray, same: bool = False) -> np.ndarray:
    """Covariance functions of the Gaussian processes, by name."""
    name, c, ell = p["kernel"], p["constant_value"], p["length_scale"]
    d = np.sqrt(np.maximum(((x[:, None] - z[None]) ** 2).sum(axis=2), 0))
    if name == "rbf":
        return c * np.exp(-(d**2) / (2 * ell**2))
    if name == "matern":
        r = d / ell
        if p["nu"] == 0.5:
            return c * np.exp(-r)
        if p["nu"] == 1.5:
            return c * (1 + math.sqrt(3) * r) * np.exp(-math.sqrt(3) * r)
        if p["nu"] == 2.5:
            return c * (1 + math.sqrt(5) * r + 5 * r * r / 3) * np.exp(-math.sqrt(5) * r)
        raise ValueError("nu is 0.5, 1.5 or 2.5")
    if name == "rational_quadratic":
        a = p["rational_quadratic_alpha"]
        return c * (1 + d**2 / (2 * a * ell**2)) ** -a
    if name == "exp_sine_squared":
        return c * np.exp(-2 * np.sin(math.pi * d / p["periodicity"]) ** 2 / ell**2)
    if name == "dot_product":
        return c * (p["sigma_0"] ** 2 + x @ z.T)
    if name == "white":
        return p["noise_level"] * np.eye(len(x)) if same else np.zeros(d.shape)
    if name == "constant":
        return np.full(d.shape, c)
    raise ValueError(f"unknown kernel {name!r}")


def gp_pair(p: dict):
    """The covariance without noise, and its diagonal, as functions of rows; and the noise."""
    if p["kernel"] == "white":
        return lambda x, z: np.zeros((len(x), len(z))), lambda x: np.zeros(len(x)), p["noise_level"]
    c = p["constant_value"]
    own = (lambda x: c * (p["sigma_0"] ** 2 + (x * x).sum(axis=1))) if p["kernel"] == "dot_product" else lambda x: np.full(len(x), float(c))
    return lambda x, z: gp_kernel(p, x, z), own, 0.0


_GP = {"kernel": "rbf", "length_scale": 1.0, "constant_value": 1.0, "noise_level": 1.0, "nu": 1.5, "rational_quadratic_alpha": 1.0, "periodicity": 1.0, "sigma_0": 1.0}


class GaussianProcessRegressor(Predictor):
    """Fixed hyperparameters; the noise on the diagonal grows tenfold, up to six times, until the matrix factors.

    Beyond ``max_rows`` rows they stay in Spark, and the kernel's pivots take their place.
    """

    defaults = {**_GP, "alpha": 1e-10, "normalize_y": False}
    max_rows = 3_000

    def fit(self, df, features, label, id_col=None):
        cols, self._far = self._start(df, features, label), None
        if df.limit(self.max_rows + 1).count() > self.max_rows:
            return self._fit_far(df, cols, label)
        self.X_train_, y, _ = collect_bounded(df, features, label, id_col, self.max_rows)
        self.y_train_mean_ = float(y.mean()) if self.normalize_y else 0.0
        y = y - self.y_train_mean_
        k, jitter = gp_kernel(self.params, self.X_train_, self.X_train_, True), max(self.alpha, 1e-300)
        for _ in range(7):
            try:
                self.L_ = np.linalg.cholesky(k + jitter * np.eye(len(k)))
                break
            except np.linalg.LinAlgError:
                jitter *= 10
        else:
            raise ValueError("the kernel matrix is not positive definite; raise alpha")
        self.dual_coef_ = np.linalg.solve(self.L_.T, np.linalg.solve(self.L_, y))
        self.log_marginal_likelihood_value_ = float(-0.5 * y @ self.dual_coef_ - np.log(np.diag(self.L_)).sum() - len(y) / 2 * math.log(2 * math.pi))
        self.fitted = True
        return self

    def _fit_far(self, df, cols, label):
        y = F.col(label).cast("double")
        self.y_train_mean_ = float(df.agg(F.avg(y)).first()[0]) if self.normalize_y else 0.0
        rows = stats.training_rows(df, cols, [y - self.y_train_mean_])
        k, own, noise = gp_pair(self.params)
        f, alpha = lowrank.factor(rows, k, own, self.width), max(self.alpha, 1e-300) + noise
        w, upper, left, n = lowrank.ridge(rows, f, self.width, alpha)
        self.X_train_, self.dual_coef_, self._far, self.fitted = f.pivots, f.dual(w), (f, upper, alpha, noise), True
        self.log_marginal_likelihood_value_ = float(-0.5 * left / alpha - np.log(np.abs(np.diag(upper))).sum() - (n - len(w)) / 2 * math.log(alpha) - n / 2 * math.log(2 * math.pi))
        return self

    def predict(self, df, features=None, out="prediction"):
        p, x, a, m = self.params, self.X_train_, self.dual_coef_, self.y_train_mean_
        return df.withColumn(out, row_function(lambda q: gp_kernel(p, q, x) @ a + m, self._ready(df, features)))

    def predict_std(self, df, features=None, out="std"):
        if self._far:
            f, upper, alpha, noise = self._far

            def far(q):
                v = f.features(q)
                return np.sqrt(np.maximum(f.rest(q, v) + noise, 0) + alpha * (np.linalg.solve(upper.T, v.T) ** 2).sum(axis=0))

            return df.withColumn(out, row_function(far, self._ready(df, features)))
        p, x, low = self.params, self.X_train_, self.L_

        def std(q):
            v = np.linalg.solve(low, gp_kernel(p, q, x).T)
            own = np.array([gp_kernel(p, r[None], r[None], True)[0, 0] for r in q])
            return np.sqrt(np.maximum(own - (v * v).sum(axis=0), 0))

        return df.withColumn(out, row_function(std, self._ready(df, features)))

    def predict_covariance(self, df, features=None, id_col=None):
        """The joint covariance of a bounded set of queries."""
        self._ready(df, features)
        q, _, _ = collect_bounded(df, features or self.features, None, id_col, self.max_rows)
        if self._far:
            f, upper, alpha, _ = self._far
            v = f.features(q)
            u = np.linalg.solve(upper.T, v.T)
            return gp_kernel(self.params, q, q, True) - v @ v.T + alpha * u.T @ u
        v = np.linalg.solve(self.L_, gp_kernel(self.params, q, self.X_train_).T)
        return gp_kernel(self.params, q, q, True) - v.T @ v


class GaussianProcessClassifier(Classifier):
    """Two classes by the Laplace approximation; probabilities by the probit-style shrinkage of the latent.

    Beyond ``max_rows`` rows they stay in Spark: Newton's steps are taken on weights of the kernel's pivots.
    """

    defaults = {**_GP, "alpha": 1e-10, "max_iter": 100, "tol": 1e-6}
    max_rows = 3_000

    def fit(self, df, features, label, id_col=None):
        cols, self._far = self._start(df, features, label), None
        if df.limit(self.max_rows + 1).count() > self.max_rows:
            return self._fit_far(df, cols, label)
        self.X_train_, y, _ = collect_bounded(df, features, label, id_col, self.max_rows)
        self.classes_ = _labels(y)
        if len(self.classes_) != 2:
            raise ValueError("two classes are needed")
        t = (y == self.classes_[1]).astype(float)
        k = gp_kernel(self.params, self.X_train_, self.X_train_, True) + self.alpha * np.eye(len(t))
        f = np.zeros(len(t))
        for self.n_iter_ in range(1, self.max_iter + 1):
            p = sigmoid(f)
            w = np.maximum(p * (1 - p), 1e-12)
            root = np.sqrt(w)
            b = np.eye(len(t)) + root[:, None] * k * root[None]
            r = w * f + t - p
            a = r - root * np.linalg.solve(b, root * (k @ r))
            new = k @ a
            moved, f = np.abs(new - f).max(), new
            if moved < self.tol:
                break
        p = sigmoid(f)
        self._root = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        self._b = np.eye(len(t)) + self._root[:, None] * k * self._root[None]
        self.latent_mean_, self.dual_coef_, self.fitted = f, t - p, True
        return self

    def _fit_far(self, df, cols, label):
        self.classes_ = classes_of(df, label)
        if len(self.classes_) != 2:
            raise ValueError("two classes are needed")
        if self.kernel == "white":
            raise ValueError("white noise has no pivots: raise max_rows or use another kernel")
        rows = stats.training_rows(df, cols, [(F.col(label) == F.lit(self.classes_[1])).cast("double")])
        k, own, _ = gp_pair(self.params)
        f = lowrank.factor(rows, k, own, self.width)
        m = len(f.pivots)
        w = old = np.zeros(m)
        for self.n_iter_ in range(1, self.max_iter + 2):
            # The last pass only takes the sums at the weights that were reached.
            def sums(v, t, w=w, old=old):
                g = v @ w
                p = sigmoid(g)
                h = np.maximum(p * (1 - p), 1e-12)
                return np.r_[((v * h[:, None]).T @ v).ravel(), v.T @ (h * g + t - p), v.T @ (t - p)], np.abs(v @ (w - old)).max()

            s, moved = lowrank.summed(rows, f, self.width, sums)
            inner = s[: m * m].reshape(m, m) + np.eye(m)
            if self.n_iter_ > 1 and moved < self.tol or self.n_iter_ > self.max_iter:
                break
            w, old = np.linalg.solve(inner, s[m * m : m * m + m]), w
        self.n_iter_ -= 1
        self.X_train_, self.dual_coef_, self._far, self.fitted = f.pivots, f.dual(s[m * m + m :]), (f, inner), True
        return self

    def decision_function(self, df, features=None, out="decision"):
        p, x, a = self.params, self.X_train_, self.dual_coef_
        return df.withColumn(out, row_function(lambda q: gp_kernel(p, q, x) @ a, self._ready(df, features)))

    def predict(self, df, features=None, out="prediction"):
        d = self.decision_function(df, features, "_d")
        return d.withColumn(out, F.when(F.col("_d") >= 0, F.lit(self.classes_[1])).otherwise(F.lit(self.classes_[0]))).drop("_d")

    def predict_proba(self, df, features=None, out="probability"):
        if self._far:
            (f, inner), dual = self._far, self.dual_coef_

            def far(q):
                v = f.features(q)
                mean, var = f.k(q, f.pivots) @ dual, np.maximum(f.rest(q, v), 0) + (v.T * np.linalg.solve(inner, v.T)).sum(axis=0)
                one = sigmoid(mean / np.sqrt(1 + math.pi * var / 8))
                return np.column_stack([1 - one, one])

            return df.withColumn(out, row_function(far, self._ready(df, features), "array<double>"))
        p, x, a, root, b = self.params, self.X_train_, self.dual_coef_, self._root, self._b

        def proba(q):
            k = gp_kernel(p, q, x)
            mean = k @ a
            v = root[:, None] * k.T
            own = np.array([gp_kernel(p, r[None], r[None], True)[0, 0] for r in q])
            var = np.maximum(own - (v * np.linalg.solve(b, v)).sum(axis=0), 0)
            one = sigmoid(mean / np.sqrt(1 + math.pi * var / 8))
            return np.column_stack([1 - one, one])

        return df.withColumn(out, row_function(proba, self._ready(df, features), "array<double>"))


__all__ = [n for n in dir() if n[0].isupper()] + ["erf", "gp_kernel", "pair_steps"]
