"""Naive Bayes, discriminant analysis: grouped sufficient statistics, scores as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.functions.core import Classifier, argmax, dot
from millrace.functions.special import softmax  # noqa: F401  (same definition in numpy)


class ScoreClassifier(Classifier):
    """One log score a class; probabilities are their softmax."""

    def _scores(self, cols: list[Column]) -> list[Column]:
        raise NotImplementedError

    def joint_log_likelihood(self, df, features=None, out="scores"):
        return df.withColumn(out, F.array(*self._scores(self._ready(df, features))))

    decision_function = joint_log_likelihood

    def predict(self, df, features=None, out="prediction"):
        scored = df.withColumn("_s", F.array(*self._scores(self._ready(df, features))))
        return scored.withColumn(out, argmax([F.col("_s")[i] for i in range(len(self.classes_))], self.classes_)).drop("_s")

    def predict_log_proba(self, df, features=None, out="log_probability"):
        scored = df.withColumn("_s", F.array(*self._scores(self._ready(df, features))))
        top = F.array_max("_s")
        total = top + F.log(F.aggregate(F.transform("_s", lambda s: F.exp(s - F.array_max("_s"))), F.lit(0.0), lambda a, v: a + v))
        return scored.withColumn("_t", total).withColumn(out, F.transform("_s", lambda s: s - F.col("_t"))).drop("_s", "_t")

    def predict_proba(self, df, features=None, out="probability"):
        return self.predict_log_proba(df, features, out).withColumn(out, F.transform(out, lambda s: F.exp(s)))


class _NaiveBayes(ScoreClassifier):
    """Per-class counts and feature sums; batches add up."""

    def _sums(self, cols: list[Column]) -> list[Column]:
        raise NotImplementedError

    def _collect(self, df: DataFrame, cols, label):
        rows = df.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"), *self._sums(cols)).collect()
        if not rows:
            raise ValueError("empty input")
        return {r["y"]: r for r in rows}

    def fit(self, df, features, label):
        self.fitted = False
        return self.partial_fit(df, features, label, classes=None, first=True)

    def partial_fit(self, df, features, label, classes=None, first=False):
        """Adds a batch; the first call names the classes."""
        if self.fitted:
            cols = self._ready(df, features)
        else:
            if classes is None and not first:
                raise ValueError("the first call of partial_fit needs classes")
            cols = self._start(df, features, label)
        found = self._collect(df, cols, label)
        if not self.fitted:
            self.classes_ = sorted(found if classes is None else classes)
            self._empty(len(self.classes_), self.width)
        if set(found) - set(self.classes_):
            raise ValueError("a label is not among the classes")
        self._add(found)
        self.fitted = True
        self._finish()
        return self

    def _priors(self, given, uniform=False):
        k = len(self.classes_)
        if given:
            return np.asarray(given, float)
        if uniform:
            return np.full(k, 1 / k)
        return self.class_count_ / self.class_count_.sum()


class GaussianNB(_NaiveBayes):
    """Normal densities with population variances plus a share of the largest column variance."""

    defaults = {"priors": None, "var_smoothing": 1e-9}

    def _sums(self, cols):
        out = []
        for i, c in enumerate(cols):
            out += [F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}")]
        return out

    def _empty(self, k, p):
        self.class_count_, self._theta, self._var = np.zeros(k), np.zeros((k, p)), np.zeros((k, p))

    def _add(self, found):
        batch = None
        for k, c in enumerate(self.classes_):
            if c in found:
                r = found[c]
                m, v = (np.array([r[f"{a}{i}"] for i in range(self.width)], float) for a in "mv")
                own = stats.Moments(r["n"], m, np.diag(v * r["n"]))
                old = stats.Moments(int(self.class_count_[k]), self._theta[k], np.diag(self._var[k] * self.class_count_[k]))
                both = old + own
                self.class_count_[k], self._theta[k], self._var[k] = both.n, both.mean, np.diag(both.scatter) / both.n
                batch = own if batch is None else batch + own
        # The smoothing follows the latest batch's variances.
        self.epsilon_ = self.var_smoothing * float((np.diag(batch.scatter) / batch.n).max())

    def _finish(self):
        self.theta_, self.var_ = self._theta, self._var + self.epsilon_
        self.class_prior_ = self._priors(self.priors)

    def _scores(self, cols):
        out = []
        for k in range(len(self.classes_)):
            s = F.lit(float(np.log(self.class_prior_[k]) - 0.5 * np.log(2 * np.pi * self.var_[k]).sum()))
            for c, m, v in zip(cols, self.theta_[k], self.var_[k]):
                s = s - (c - float(m)) * (c - float(m)) / float(2 * v)
            out.append(s)
        return out


class _Counting(_NaiveBayes):
    def _empty(self, k, p):
        self.class_count_, self.feature_count_ = np.zeros(k), np.zeros((k, p))

    def _add(self, found):
        for k, c in enumerate(self.classes_):
            if c in found:
                self.class_count_[k] += found[c]["n"]
                self.feature_count_[k] += np.array([found[c][f"s{i}"] for i in range(self.width)], float)

    def _alpha(self):
        return self.alpha if self.force_alpha else max(self.alpha, 1e-10)


class MultinomialNB(_Counting):
    """Log shares of smoothed feature counts."""

    defaults = {"alpha": 1.0, "force_alpha": True, "fit_prior": True, "class_prior": None}

    def _sums(self, cols):
        checked = [F.when(c < 0, F.raise_error(F.lit("negative count")).cast("double")).otherwise(c) for c in cols]
        return [F.sum(c).alias(f"s{i}") for i, c in enumerate(checked)]

    def _finish(self):
        n = self.feature_count_ + self._alpha()
        self.feature_log_prob_ = np.log(n) - np.log(n.sum(axis=1, keepdims=True))
        self.class_log_prior_ = np.log(np.maximum(1e-300, self._priors(self.class_prior, not self.fit_prior)))

    def _scores(self, cols):
        return [dot(cols, w, b) for w, b in zip(self.feature_log_prob_, self.class_log_prior_)]


class BernoulliNB(_Counting):
    """Features over ``binarize`` are on; both on and off count."""

    defaults = {"alpha": 1.0, "force_alpha": True, "binarize": 0.0, "fit_prior": True, "class_prior": None}

    def _on(self, c):
        return (c > float(self.binarize)).cast("double")

    def _sums(self, cols):
        return [F.sum(self._on(c)).alias(f"s{i}") for i, c in enumerate(cols)]

    def _finish(self):
        a = self._alpha()
        n = np.maximum(self.class_count_, 1e-300)[:, None]
        self.feature_log_prob_ = np.log(self.feature_count_ + a) - np.log(n + 2 * a)
        self._off = np.log(n + a - self.feature_count_) - np.log(n + 2 * a)
        self.class_log_prior_ = np.log(np.maximum(1e-300, self._priors(self.class_prior, not self.fit_prior)))

    def _scores(self, cols):
        on = [self._on(c) for c in cols]
        return [dot(on, w - o, b + o.sum()) for w, o, b in zip(self.feature_log_prob_, self._off, self.class_log_prior_)]


class LinearDiscriminantAnalysis(ScoreClassifier):
    """Pooled within-class covariance over n - k, plus a ridge; linear scores."""

    defaults = {"reg_param": 1e-9}

    def fit(self, df, features, label):
        cols = self._start(df, features, label)
        by = stats.moments(df, cols, F.col(label))
        self.classes_ = list(by)
        if len(by) < 2:
            raise ValueError("one class only")
        n, k = sum(m.n for m in by.values()), len(by)
        self.priors_ = np.array([m.n / n for m in by.values()])
        self.means_ = np.array([m.mean for m in by.values()])
        self.covariance_ = sum(m.scatter for m in by.values()) / max(1, n - k) + self.reg_param * np.eye(self.width)
        self.coef_ = np.linalg.solve(self.covariance_, self.means_.T).T
        self.intercept_ = -0.5 * (self.means_ * self.coef_).sum(axis=1) + np.log(self.priors_)
        self.fitted = True
        return self

    def _scores(self, cols):
        return [dot(cols, w, b) for w, b in zip(self.coef_, self.intercept_)]


class QuadraticDiscriminantAnalysis(ScoreClassifier):
    """A covariance for each class, shrunk towards the unit matrix; quadratic scores."""

    defaults = {"reg_param": 0.0}

    def fit(self, df, features, label):
        cols = self._start(df, features, label)
        by = stats.moments(df, cols, F.col(label))
        self.classes_, n = list(by), sum(m.n for m in by.values())
        if len(by) < 2:
            raise ValueError("one class only")
        if min(m.n for m in by.values()) < 2:
            raise ValueError("a class has fewer than two rows")
        self.priors_ = np.array([m.n / n for m in by.values()])
        self.means_ = np.array([m.mean for m in by.values()])
        r = self.reg_param
        self.covariance_ = [(1 - r) * m.scatter / (m.n - 1) + r * np.eye(self.width) for m in by.values()]
        self._inverse, self._logdet = [], []
        for c in self.covariance_:
            values, vectors = np.linalg.eigh(c)
            if values.min() <= float(np.finfo(float).eps) * max(values.max(), 1e-300) * self.width:
                raise ValueError("a class's covariance is rank deficient; raise reg_param")
            self._inverse.append((vectors / values) @ vectors.T)
            self._logdet.append(float(np.log(values).sum()))
        self.fitted = True
        return self

    def _scores(self, cols):
        out = []
        for m, s, d, p in zip(self.means_, self._inverse, self._logdet, self.priors_):
            at = [c - float(v) for c, v in zip(cols, m)]
            q = F.lit(0.0)
            for i in range(self.width):
                q = q + at[i] * dot(at, s[i])
            out.append(F.lit(float(np.log(p) - 0.5 * d)) - F.lit(0.5) * q)
        return out
