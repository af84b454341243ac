"""Preprocessing, imputation, naive Bayes, discriminants, covariance, decomposition, selection."""

import numpy as np
import pytest
from millrace.functions import metrics, special
from millrace.operators import bayes, covariance, decomposition, impute, linear, preprocessing, selection
from pyspark.sql import functions as F

RNG = np.random.default_rng(1)
X = RNG.normal(size=(90, 3)) * [1, 2, 5] + [0, 1, -2]
Y = np.repeat([0, 1, 2], 30)
X += Y[:, None] * [1.0, -1.0, 2.0]


def matrix(df, names):
    return np.array([[r[n] for n in names] for r in df.orderBy("id").collect()], float)


def test_scalers_and_inverse(frame):
    df, f = frame(X)
    want = {
        preprocessing.StandardScaler: (X - X.mean(0)) / X.std(0),
        preprocessing.MinMaxScaler: (X - X.min(0)) / np.ptp(X, axis=0),
        preprocessing.MaxAbsScaler: X / np.abs(X).max(0),
        preprocessing.RobustScaler: (X - np.median(X, 0)) / (np.quantile(X, 0.75, 0) - np.quantile(X, 0.25, 0)),
    }
    for cls, z in want.items():
        s = cls().fit(df, f)
        assert np.allclose(matrix(s.transform(df), f), z, atol=1e-10), cls
        assert np.allclose(matrix(s.inverse_transform(s.transform(df)), f), X), cls


def test_partial_fit_equals_fit(frame):
    df, f = frame(X, Y)
    parts = [df.filter("id < 10"), df.filter("id >= 10 and id < 61"), df.filter("id >= 61")]
    for cls in (preprocessing.StandardScaler, preprocessing.MinMaxScaler, preprocessing.MaxAbsScaler):
        a, b = cls().fit(df, f), cls()
        for p in parts:
            b.partial_fit(p, f)
        assert np.allclose(a.scale_, b.scale_) and a.n_samples_seen_ == b.n_samples_seen_
    for cls in (bayes.GaussianNB, bayes.BernoulliNB):
        a, b = cls().fit(df, f, "y"), cls()
        for i, p in enumerate(parts):
            b.partial_fit(p, f, "y", classes=[0, 1, 2] if not i else None)
        assert np.allclose(a.class_count_, b.class_count_)
        assert a.predict(df).select("prediction").collect() == b.predict(df).select("prediction").collect()


def test_constant_column_and_zero_row(frame):
    df, f = frame([[1, 0], [1, 0], [1, 0]])
    for cls in (preprocessing.StandardScaler, preprocessing.MinMaxScaler, preprocessing.RobustScaler):
        assert np.isfinite(matrix(cls().fit_transform(df, f), f)).all()
    df, f = frame([[3, 4], [0, 0]])
    assert np.allclose(matrix(preprocessing.Normalizer().fit_transform(df, f), f), [[0.6, 0.8], [0, 0]])


def test_label_encoder(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], ["s"])
    e = preprocessing.LabelEncoder().fit(df, "s")
    assert [r["s_code"] for r in e.transform(df).collect()] == [1, 0, 2, 0]
    assert [r["label"] for r in e.inverse_transform(e.transform(df)).collect()] == ["b", "a", "c", "a"]
    with pytest.raises(Exception, match="not seen"):
        e.transform(spark.createDataFrame([("z",)], ["s"])).collect()


def test_imputers(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None), (3.0, None)], "a double, b double")
    s = impute.SimpleImputer(strategy="mean").fit(df, ["a", "b"])
    out = s.transform(df)
    assert out.columns == ["a"] and abs(out.agg(F.sum("a")).first()[0] - 28 / 3) < 1e-12
    assert impute.SimpleImputer(strategy="median").fit(df, ["a"]).statistics_ == [3.0]
    assert impute.SimpleImputer(strategy="most_frequent", keep_empty_features=True).fit(df, ["a", "b"]).statistics_ == [3.0, 0.0]
    m = impute.MissingIndicator().fit(df, ["a", "b"])
    assert m.transform(df).agg(F.sum("missing_a"), F.sum("missing_b")).first() == (1.0, 4.0)


def test_discriminants_and_bayes(frame):
    df, f = frame(X, Y)
    for m in (bayes.LinearDiscriminantAnalysis(), bayes.QuadraticDiscriminantAnalysis(), bayes.GaussianNB()):
        assert m.fit(df, f, "y").score(df) > 0.6
        assert abs(sum(m.predict_proba(df).first()["probability"]) - 1) < 1e-9
    g = bayes.GaussianNB().fit(df, f, "y")
    assert np.allclose(g.theta_, [X[Y == c].mean(0) for c in range(3)])
    n = np.abs(np.round(X))
    df, f = frame(n, Y)
    m = bayes.MultinomialNB().fit(df, f, "y")
    c = np.array([n[Y == k].sum(0) for k in range(3)]) + 1
    assert np.allclose(m.feature_log_prob_, np.log(c / c.sum(1, keepdims=True)))
    with pytest.raises(Exception, match="negative"):
        bayes.MultinomialNB().fit(*frame(X, Y), "y")


def test_covariances(frame):
    df, f = frame(X)
    s = np.cov(X.T, ddof=0)
    assert np.allclose(covariance.EmpiricalCovariance().fit(df, f).covariance_, s)
    m = covariance.LedoitWolf().fit(df, f)
    c, n, p = X - X.mean(0), len(X), 3
    mu = np.trace(s) / p
    beta = sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / n**2 / p
    assert np.isclose(m.shrinkage_, min(beta / (((s - mu * np.eye(p)) ** 2).sum() / p), 1), rtol=1e-9)
    assert 0 <= covariance.OAS().fit(df, f).shrinkage_ <= 1
    e = covariance.EllipticEnvelope(contamination=0.1).fit(df, f)
    assert e.predict(df).filter("prediction = -1").count() == 9
    i = covariance.IsolationForest(n_estimators=20, max_samples=64).fit(df, f)
    assert 5 <= i.predict(df).filter("prediction = -1").count() <= 9
    with pytest.raises(ValueError, match="max_samples"):
        covariance.IsolationForest().fit(df, f)


def test_decompositions(frame):
    df, f = frame(X, X[:, 0] + 2 * X[:, 2])
    m = decomposition.PCA().fit(df, f)
    u, s, v = np.linalg.svd(X - X.mean(0), full_matrices=False)
    assert np.allclose(m.singular_values_, s) and np.allclose(np.abs(m.components_), np.abs(v))
    assert np.allclose(matrix(m.inverse_transform(m.transform(df)), f), X)
    assert np.allclose(decomposition.TruncatedSVD(n_components=2).fit(df, f).singular_values_, np.linalg.svd(X)[1][:2])
    fa = decomposition.FactorAnalysis(n_components=1).fit(df, f)
    assert np.allclose(np.diag(fa.covariance_), X.var(0), rtol=0.05)
    assert decomposition.PLSRegression(n_components=3).fit(df, f, "y").score(df) > 0.999
    assert decomposition.CCA(n_components=1).fit(df, f, "y").score(df) > 0.999


def test_pls_matches_row_iterations(frame):
    y = np.c_[X[:, 0] + RNG.normal(size=90), X[:, 1] - X[:, 2]]
    df, f = frame(np.c_[X, y])
    m = decomposition.PLSRegression(n_components=2, tol=1e-14, max_iter=2000).fit(df, f[:3], f[3:])
    a, b = (X - X.mean(0)) / X.std(0, ddof=1), (y - y.mean(0)) / y.std(0, ddof=1)
    for k in range(2):
        u = np.linalg.svd(a.T @ b)[0][:, 0]
        assert np.allclose(np.abs(u), np.abs(m.x_weights_[:, k]), atol=1e-5)
        t = a @ u
        a, b = a - np.outer(t, a.T @ t / (t @ t)), b - np.outer(t, b.T @ t / (t @ t))


def test_scores_and_selectors(frame):
    df, f = frame(X, Y)
    s, p = selection.f_classif(df, f, "y")
    groups = [X[Y == k] for k in range(3)]
    between = sum(len(g) * (g.mean(0) - X.mean(0)) ** 2 for g in groups) / 2
    within = sum(((g - g.mean(0)) ** 2).sum(0) for g in groups) / 87
    assert np.allclose(s, between / within) and (p < 1).all()
    k = selection.SelectKBest(k=1).fit(df, f, "y")
    assert k.selected() == [f[int(s.argmax())]] and k.transform(df).columns == ["id", k.selected()[0], "y"]
    mi, _ = selection.mutual_info_classif(df, f, "y")
    assert (mi >= 0).all() and mi.max() > 0.1
    assert selection.RFE(estimator=linear.LinearRegression(), n_features_to_select=1).fit(df, f, "y").ranking_.max() == 3
    with pytest.raises(ValueError):
        selection.VarianceThreshold(threshold=1e9).fit(df, f)


def test_special_functions():
    assert np.isclose(special.chi2_sf(3.841458820694124, 1), 0.05)
    assert np.isclose(special.f_sf(4.964602743730711, 1, 10), 0.05)
    assert np.isclose(special.digamma(1.0)[0], -0.5772156649015329)


def test_metrics_quirks(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    labels, m = metrics.confusion_matrix(df, "y", "p")
    assert labels == [0, 1, 2] and m.tolist() == [[1, 1, 0], [0, 1, 0], [0, 1, 0]]
    assert np.isclose(metrics.precision_score(df, "y", "p"), (1 + 1 / 3) / 2)
    assert np.isclose(metrics.recall_score(df, "y", "p"), (0.5 + 1 + 0) / 3)
    assert metrics.r2_score(spark.createDataFrame([(1.0, 1.0)] * 3, "y double, p double"), "y", "p") == 0


def test_splits_and_searches(frame):
    y = X @ [1.0, 2.0, 3.0] + RNG.normal(size=90)
    df, f = frame(X, y)
    a, b = selection.train_test_split(df, "id", 0.2)
    assert (a.count(), b.count()) == (72, 18) and not a.join(b, "id").count()
    folds = selection.with_folds(df, "id", 4).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in folds] == [22, 23, 22, 23]
    rows = selection.with_folds(df, "id", 3)
    fast = selection.cross_val_score(linear.Ridge(), rows, f, "y", fold_col="fold")
    slow = [linear.Ridge().fit(rows.filter(F.col("fold") != k), f, "y").score(rows.filter(F.col("fold") == k)) for k in range(3)]
    assert np.allclose(fast, slow)
    g = selection.GridSearchCV(estimator=linear.Ridge(), param_grid={"alpha": [1e4, 0.1]}).fit(df, f, "y", "id")
    assert g.best_params_ == {"alpha": 0.1} and g.score(df) > 0.9
    assert list(selection.ParameterGrid({"a": [1, 2], "b": [3, 4]}))[1] == {"a": 1, "b": 4}
    assert np.allclose(selection.NelderMead().minimize(lambda v: (v[0] - 1) ** 2 + (v[1] + 2) ** 2, [0.0, 0.0]), [1, -2], atol=1e-4)


def test_pipeline_and_calibration(frame):
    df, f = frame(X[:60], Y[:60])
    p = selection.make_pipeline(preprocessing.StandardScaler(), linear.LogisticRegression(max_iter=20))
    assert p.fit(df, f, "y").score(df) > 0.7
    p.set_param("step1__C", 2.0)
    assert p.named_step(1).C == 2.0
    for method in ("sigmoid", "isotonic"):
        c = selection.CalibratedClassifierCV(estimator=linear.LogisticRegression(max_iter=10), cv=3, method=method).fit(df, f, "y", "id")
        assert c.score(df) > 0.7
        assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in c.predict_proba(df).collect())
