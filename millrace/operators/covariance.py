"""Covariance estimators, elliptic envelope and isolation forest."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.functions.core import Estimator, row_function


class EmpiricalCovariance(Estimator):
    defaults = {"assume_centered": False}

    def fit(self, df: DataFrame, features):
        cols = self._start(df, features)
        m = stats.moments(df, cols)
        self.n_, p = m.n, self.width
        self.location_ = np.zeros(p) if self.assume_centered else m.mean
        s = (m.raw() if self.assume_centered else m.scatter) / m.n
        self.covariance_ = self._shrink(s, m.n, df, cols)
        self.fitted = True
        return self

    def _shrink(self, s, n, df, cols):
        return s

    def score(self, df: DataFrame) -> float:
        """Mean Gaussian log-likelihood of the rows."""
        m = stats.moments(df, self._ready(df))
        d = m.mean - self.location_
        s = m.cov + np.outer(d, d)
        sign, logdet = np.linalg.slogdet(self.covariance_)
        if sign <= 0:
            raise ValueError("the covariance is not positive definite")
        return float(-0.5 * (np.trace(np.linalg.solve(self.covariance_, s)) + logdet + self.width * math.log(2 * math.pi)))

    def _towards_unit(self, s, shrinkage):
        self.shrinkage_ = float(shrinkage)
        return (1 - shrinkage) * s + shrinkage * np.trace(s) / len(s) * np.eye(len(s))


class LedoitWolf(EmpiricalCovariance):
    """Shrinkage from the rows' fourth moments: a second aggregation."""

    def _shrink(self, s, n, df, cols):
        p, mu = len(s), np.trace(s) / len(s)
        delta = ((s - mu * np.eye(p)) ** 2).sum() / p
        if delta < 1e-30:
            self.shrinkage_ = 0.0
            return s
        norm = sum(((c - float(m)) * (c - float(m)) for c, m in zip(cols, self.location_)), F.lit(0.0))
        fourth = df.agg(F.sum(norm * norm).alias("v")).first()["v"]
        beta = (fourth / n - (s**2).sum()) / (n * p)
        return self._towards_unit(s, min(max(beta / delta, 0.0), 1.0))


class OAS(EmpiricalCovariance):
    """Oracle approximating shrinkage in closed form."""

    def _shrink(self, s, n, df, cols):
        p, mu, alpha = len(s), np.trace(s) / len(s), (s**2).mean()
        num, den = alpha + mu**2, (n + 1) * (alpha - mu**2 / p)
        return self._towards_unit(s, 1.0 if den <= 0 else min(max(num / den, 0.0), 1.0))


def floor_quantile(df: DataFrame, column: str, share: float) -> float:
    """The value at place floor(share * n) of the sorted column, by counting only: no global sort.

    The bin of that place is narrowed until few rows are left in it.
    """
    r = df.agg(F.count(column).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).first()
    if not r["n"]:
        raise ValueError("empty input")
    k, low, high = min(int(share * r["n"]), r["n"] - 1), r["a"], r["b"]
    below, rows = 0, df.select(F.col(column).alias("v"))
    while high > low:
        n = rows.filter((F.col("v") >= low) & (F.col("v") <= high)).count()
        if n <= 10_000:
            break
        step = (high - low) / 256
        bins = rows.filter((F.col("v") >= low) & (F.col("v") <= high)).groupBy(F.least(F.lit(255), F.floor((F.col("v") - low) / step)).alias("i")).agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        for x in sorted(bins, key=lambda x: x["i"]):
            if below + x["n"] > k:
                break
            below += x["n"]
        if (x["a"], x["b"]) == (low, high):
            break
        low, high = x["a"], x["b"]
    if high == low:
        return float(low)
    values = sorted(x["v"] for x in rows.filter((F.col("v") >= low) & (F.col("v") <= high)).collect())
    return float(values[k - below])


class EllipticEnvelope(Estimator):
    """Squared Mahalanobis distance under the plain covariance plus a ridge; outliers are the farthest share."""

    defaults = {"contamination": 0.1, "assume_centered": False, "regularization": 1e-9}

    def fit(self, df, features):
        if not 0 < self.contamination <= 0.5:
            raise ValueError("contamination lies in (0, 0.5]")
        cols = self._start(df, features)
        m = stats.moments(df, cols)
        self.location_ = np.zeros(self.width) if self.assume_centered else m.mean
        s = (m.raw() if self.assume_centered else m.scatter) / m.n
        self.covariance_ = s + self.regularization * np.eye(self.width)
        self.precision_, self.fitted = np.linalg.inv(self.covariance_), True
        self.offset_ = floor_quantile(self.score_samples(df), "score", self.contamination)
        return self

    def score_samples(self, df, features=None, out="score"):
        at = [c - float(m) for c, m in zip(self._ready(df, features), self.location_)]
        d = F.lit(0.0)
        for i in range(self.width):
            for j in range(self.width):
                d = d + at[i] * at[j] * float(self.precision_[i, j])
        return df.withColumn(out, -d)

    def decision_function(self, df, features=None, out="decision"):
        return self.score_samples(df, features, out).withColumn(out, F.col(out) - self.offset_)

    def predict(self, df, features=None, out="prediction"):
        return self.decision_function(df, features, "_d").withColumn(out, F.when(F.col("_d") >= 0, 1).otherwise(-1)).drop("_d")


def _harmonic_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest(Estimator):
    """Random isolation trees over samples of rows; each tree is grown in a task of its own.

    A row's draws are hashes of the tree's number and its id (without an id column its place), so equal rows are drawn
    one by one.  A tree takes the ``max_samples`` smallest.

    A row outside a node's sampled range meets the cut as if it had been drawn (``as_sampled``): a cut of the range that
    reaches to the row takes it off with the chance gap / (gap + range), and its path is the mean over both outcomes.
    Without this (as in the reference) it goes on with the nearest rows, so that one between two sampled groups counts
    as a near one unless a cut happens to fall into the gap.  Rows inside the ranges have the same path in both.
    """

    defaults = {"n_estimators": 100, "max_samples": 256, "contamination": 0.1, "max_depth": -1, "random_state": 42, "as_sampled": True}

    def fit(self, df, features, id_col: str | None = None):
        cols = self._start(df, features)
        n = df.count()
        if n < self.max_samples:
            raise ValueError(f"max_samples is {self.max_samples} but there are {n} rows")
        size, seed, trees = self.max_samples, self.random_state, self.n_estimators
        depth = self.max_depth if self.max_depth > 0 else max(1, math.ceil(math.log2(size)))
        x, row = F.array(*cols), F.col(id_col) if id_col else F.monotonically_increasing_id()
        # Twice the rows that a tree needs, by a hash of its number and the row; only draws become rows.
        share = min(1.0, 2.0 * size / n + 20 / n)

        def draw(t):
            return F.struct(t.alias("tree"), (F.pmod(F.xxhash64(F.lit(seed), t, F.col("row")), F.lit(1 << 40)) / float(1 << 40)).alias("u"))

        drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), draw), lambda d: d["u"] < share)
        picked = df.select(x.alias("x"), row.alias("row")).select("x", F.explode(drawn).alias("d")).select("x", "d.tree", "d.u")

        def grow(pdf):
            import pandas as pd

            rows = np.array(pdf.sort_values("u")["x"].tolist(), float)[:size]
            rng, nodes = np.random.default_rng([seed, int(pdf["tree"].iloc[0])]), []

            def add(at, d):
                k = len(nodes)
                nodes.append([-1, 0.0, 0, 0, d + _harmonic_path(len(at)), -math.inf, math.inf])
                spread = np.flatnonzero(rows[at].min(axis=0) < rows[at].max(axis=0)) if len(at) > 1 else []
                if d < depth and len(spread):
                    f = int(rng.choice(spread))
                    a, b = float(rows[at, f].min()), float(rows[at, f].max())
                    t = float(rng.uniform(a, b))
                    low = rows[at, f] < t
                    nodes[k] = [f, t, add(at[low], d + 1), add(at[~low], d + 1), 0.0, a, b]
                return k

            add(np.arange(len(rows)), 0)
            return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])]} | {k: [list(v)] for k, v in zip("ftlrpab", zip(*nodes))})

        grown = picked.groupBy("tree").applyInPandas(grow, "tree int, f array<int>, t array<double>, l array<int>, r array<int>, p array<double>, a array<double>, b array<double>").collect()
        self.trees_ = [tuple(np.array(g[k]) for k in "ftlrpab") for g in sorted(grown, key=lambda g: g["tree"])]
        self.fitted = True
        self.offset_ = floor_quantile(self.score_samples(df), "score", self.contamination)
        return self

    def score_samples(self, df, features=None, out="score"):
        trees, norm, as_sampled = self.trees_, _harmonic_path(self.max_samples), self.as_sampled

        def score(x):
            total, every = np.zeros(len(x)), np.arange(len(x))
            for f, t, left, right, path, a, b in trees:
                at, d, rest = np.zeros(len(x), int), 0, np.ones(len(x))
                span = np.where(f >= 0, b - a, 1.0)  # a leaf's range has no bounds: nothing is cut off there
                while (inner := f[at] >= 0).any():
                    v, d = x[every, np.maximum(f[at], 0)], d + 1
                    if as_sampled:
                        gap = np.fmax(np.fmax(a[at] - v, v - b[at]), 0.0)
                        stays = rest * (span[at] / (span[at] + gap))
                        total += (rest - stays) * d
                        rest = stays
                    at = np.where(inner, np.where(v < t[at], left[at], right[at]), at)
                total += rest * path[at]
            return -(2.0 ** (-total / len(trees) / norm))

        return df.withColumn(out, row_function(score, self._ready(df, features)))

    def decision_function(self, df, features=None, out="decision"):
        return self.score_samples(df, features, out).withColumn(out, F.col(out) - self.offset_)

    def predict(self, df, features=None, out="prediction"):
        return self.decision_function(df, features, "_d").withColumn(out, F.when(F.col("_d") >= 0, 1).otherwise(-1)).drop("_d")
