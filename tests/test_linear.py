"""Linear models against numpy."""

import numpy as np
import pytest
from millrace.functions import stats
from millrace.functions.core import NotFittedError
from millrace.operators import linear
from pyspark.sql import functions as F

RNG = np.random.default_rng(0)
X = RNG.normal(size=(120, 4)) + [0, 5, -3, 100]
Y = X @ [1.5, -2.0, 0.5, 3.0] + 1 + RNG.normal(scale=0.1, size=120)


def test_ols_and_ridge(frame):
    df, f = frame(X, Y)
    a = np.c_[X, np.ones(len(X))]
    want = np.linalg.lstsq(a, Y, rcond=None)[0]
    m = linear.LinearRegression().fit(df, f, "y")
    assert np.allclose(np.r_[m.coef_, m.intercept_], want, atol=1e-8)
    assert m.rank_ == 4
    assert m.score(df) > 0.999
    c = X - X.mean(axis=0)
    r = linear.Ridge(alpha=2.0).fit(df, f, "y")
    assert np.allclose(r.coef_, np.linalg.solve(c.T @ c + 2 * np.eye(4), c.T @ (Y - Y.mean())), atol=1e-8)


def test_lasso_matches_residual_descent(frame):
    df, f = frame(X, Y)
    m = linear.Lasso(alpha=0.3, tol=1e-10).fit(df, f, "y")
    c, r0 = X - X.mean(axis=0), Y - Y.mean()
    w = np.zeros(4)
    for _ in range(2000):
        for j in range(4):
            r = c[:, j] @ (r0 - c @ w) + (c[:, j] @ c[:, j]) * w[j]
            w[j] = np.sign(r) * max(abs(r) - len(Y) * 0.3, 0) / (c[:, j] @ c[:, j])
    assert np.allclose(m.coef_, w, atol=1e-6)


def test_bayesian_models_find_the_weights(frame):
    df, f = frame(X, Y)
    for m in (linear.BayesianRidge(), linear.ARDRegression()):
        m.fit(df, f, "y")
        assert np.allclose(m.coef_, [1.5, -2.0, 0.5, 3.0], atol=0.05)
        assert 50 < m.alpha_ < 200
        assert m.predict_std(df).agg(F.min("std")).first()[0] > 0


def test_multi_target_equals_single(frame, spark):
    df, f = frame(X, Y)
    df = df.withColumn("z", F.col("x0") * 2 + F.col("x1"))
    both = linear.LinearRegression().fit_multi(df, f, ["y", "z"])
    one = linear.LinearRegression().fit(df, f, "z")
    assert np.allclose(both.coef_matrix_[1], one.coef_)
    assert len(both.predict(df).first()["prediction"]) == 2


def test_sparse_equals_dense(frame, spark):
    x = X * (RNG.random(X.shape) < 0.3)
    df, f = frame(x, Y)
    rows = [(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v]
    long = spark.createDataFrame(rows, "row_id int, feature_idx int, value double")
    y = spark.createDataFrame([(i, float(v)) for i, v in enumerate(Y)], "row_id int, y double")
    a, b = linear.Ridge().fit(df, f, "y"), linear.Ridge().fit_sparse(long, y, 4)
    assert np.allclose(a.coef_, b.coef_) and np.isclose(a.intercept_, b.intercept_)


def test_logistic_reaches_its_optimum(frame):
    y = (X[:, 0] + 0.3 * RNG.normal(size=120) > 0).astype(int)
    df, f = frame(X[:, :2] - X[:, :2].mean(axis=0), y)
    m = linear.LogisticRegression(C=10.0, max_iter=300, tol=1e-8).fit(df, f, "y")
    z = X[:, :2] - X[:, :2].mean(axis=0)
    p = 1 / (1 + np.exp(-(z @ m.coef_[0] + m.intercept_[0])))
    assert np.abs(z.T @ (p - y) / len(y) + m.coef_[0] / 10).max() < 1e-6
    assert m.score(df) > 0.85
    assert abs(sum(m.predict_proba(df).first()["probability"]) - 1) < 1e-12


def test_stochastic_and_kernel_models_learn(frame):
    y = (X[:, 0] > 0).astype(int)
    z = (X - X.mean(axis=0)) / X.std(axis=0)
    df, f = frame(z, y)
    assert linear.SGDClassifier(max_iter=50).fit(df, f, "y", "id").score(df) > 0.9
    assert linear.Perceptron(max_iter=50).fit(df, f, "y", "id").score(df) > 0.9
    assert linear.RidgeClassifier().fit(df, f, "y").score(df) > 0.9
    df, f = frame(z, Y)
    assert linear.SGDRegressor(max_iter=50).fit(df, f, "y", "id").score(df) > 0.95
    centred, f = frame(z, Y - Y.mean())  # it has no intercept
    assert linear.KernelRidge(alpha=0.1, kernel="rbf", gamma=0.1).fit(centred, f, "y", "id").score(centred) > 0.9
    p = linear.SGDClassifier().partial_fit(*frame(z, (Y > 0).astype(int)), "y", classes=[0, 1])
    with pytest.raises(ValueError, match="classes"):
        linear.SGDClassifier().partial_fit(*frame(z, (Y > 0).astype(int)), "y")
    assert p.epoch_ == 1


def test_quantile_regression_is_the_median(frame):
    df, f = frame(np.zeros((41, 1)), np.arange(41.0) ** 2)
    m = linear.QuantileRegressor(quantile=0.5, alpha=0.0).fit(df, f, "y", "id")
    assert abs(m.intercept_ - 400) < 1e-3


def test_isotonic(frame):
    df, f = frame(np.array([[1], [1], [2], [3], [4], [5]]), np.array([1.0, 3.0, 1.0, 4.0, 3.0, 6.0]))
    m = linear.IsotonicRegression().fit(df, f, "y")
    got = {r["x0"]: r["prediction"] for r in m.predict(df).collect()}
    assert np.allclose([got[k] for k in (1, 2, 3, 4, 5)], [5 / 3, 5 / 3, 3.5, 3.5, 6])
    out, _ = frame(np.array([[9.0]]), np.array([0.0]))
    assert np.isnan(m.predict(out).first()["prediction"])
    assert linear.IsotonicRegression(out_of_bounds="clip").fit(df, f, "y").predict(out).first()["prediction"] == 6


def test_moments_survive_large_means(frame):
    x = RNG.normal(size=(2000, 2)) + 1e6
    df, f = frame(x)
    m = stats.moments(df, [F.col(c) for c in f])
    assert np.allclose(m.cov, np.cov(x.T, ddof=0), rtol=1e-9)
    half = stats.moments(df.filter("id < 700"), [F.col(c) for c in f])
    rest = stats.moments(df.filter("id >= 700"), [F.col(c) for c in f])
    assert np.allclose((half + rest).cov, m.cov) and np.allclose((m - half).cov, rest.cov)


def test_wide_moments(frame):
    x = RNG.normal(size=(50, 20))
    df, f = frame(x)
    assert np.allclose(stats.moments(df, [F.col(c) for c in f]).cov, np.cov(x.T, ddof=0))


def test_errors(frame, spark):
    df, f = frame(X, Y)
    with pytest.raises(NotFittedError):
        linear.LinearRegression().predict(df, f)
    with pytest.raises(ValueError, match="features"):
        linear.LinearRegression().fit(df, f, "y").predict(df, f[:2])
    with pytest.raises(ValueError, match="empty"):
        linear.LinearRegression().fit(df.filter("id < 0"), f, "y")
    with pytest.raises(ValueError, match="no parameter"):
        linear.Ridge(alfa=1)
    with pytest.raises(ValueError, match="NULL"):
        linear.Ridge().fit(df.withColumn("x0", F.lit(None).cast("double")), f, "y")


def test_stochastic_passes_end_at_rounding(frame):
    x = RNG.normal(size=(200, 2))
    df, f = frame(x, x @ [2.0, -3.0] + 1)
    for rows in (1000, 10):  # on the driver, and in tasks
        m = linear.SGDRegressor(max_iter=3000 if rows == 1000 else 60, alpha=0.0, tol=0.0)
        m.max_rows = rows
        m.fit(df, f, "y", "id")
        assert np.allclose([*m.coef_, m.intercept_], [2, -3, 1], atol=1e-12) and m.n_iter_ < 60


@pytest.mark.parametrize("kernel", ["linear", "rbf", "poly"])
def test_kernel_ridge_without_a_bound_of_rows(frame, kernel):
    x = RNG.normal(size=(150, 2))
    df, f = frame(x, np.sin(x[:, 0]) + x[:, 1])
    near, far = linear.KernelRidge(kernel=kernel, alpha=0.5), linear.KernelRidge(kernel=kernel, alpha=0.5)
    far.max_rows = 50
    got = [[r["prediction"] for r in m.fit(df, f, "y", "id").predict(df).orderBy("id").collect()] for m in (near, far)]
    assert np.allclose(*got, atol=1e-8) and len(far.X_fit_) < 150


@pytest.mark.parametrize("alpha", [0.0, 0.05, 0.4])
@pytest.mark.parametrize("quantile", [0.5, 0.8])
def test_quantile_regression_without_a_bound_of_rows(frame, alpha, quantile):
    x = np.random.default_rng(3).normal(size=(151, 2))
    df, f = frame(x, x @ [2.0, 0.1] + np.random.default_rng(4).gumbel(size=151) + 1)
    m = linear.QuantileRegressor(quantile=quantile, alpha=alpha).fit(df, f, "y", "id")
    y = np.array([r["y"] for r in df.orderBy("id").collect()])

    def loss(w):
        r = y - x @ w[:2] - w[2]
        return np.maximum(quantile * r, (quantile - 1) * r).sum() + len(y) * alpha * np.abs(w[:2]).sum()

    # The loss is convex: what is least near by is least.
    best = np.r_[m.coef_, m.intercept_]
    assert all(loss(best + d) >= loss(best) - 1e-9 for d in np.random.default_rng(5).normal(scale=1e-3, size=(500, 3)))


def test_quantile_regression_of_many_rows(spark):
    df = spark.range(6000).select((F.col("id") % 7).cast("double").alias("x"), F.pmod(F.hash("id"), F.lit(1000)).cast("double").alias("e"))
    m = linear.QuantileRegressor(alpha=0.0).fit(df.withColumn("y", F.col("x") * 3 + F.col("e") / 1e6), ["x"], "y")
    assert abs(m.coef_[0] - 3) < 1e-3
