"""Neighbours, clusters, trees, kernels, embeddings, streams and saved models."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from millrace.functions import pairwise, paths
from millrace.operators import cluster, covariance, kernels, linear, manifold, neighbors, preprocessing, selection, trees
from millrace.sources import tables
from millrace.streaming import incremental
from pyspark.sql import functions as F

RNG = np.random.default_rng(2)
C = np.array([[-4.0, -4.0], [0.0, 4.0], [4.0, -4.0]])
Y = np.repeat([0, 1, 2], 30)
X = C[Y] + RNG.normal(scale=0.6, size=(90, 2))
T = X[:, 0] * 2 + np.sin(X[:, 1])


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_neighbours_by_both_paths(frame):
    df, f = frame(X, Y)
    d = ((X[:, None] - X[None]) ** 2).sum(2)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    cols = [F.col(c) for c in f]
    for held in (pairwise.HELD, 0):
        index = pairwise.Index(df, cols, "id", held=held)
        got = pairwise.top_k(index, df, cols, "id", 5).orderBy("query_id", "rank").collect()
        assert np.array([r["id"] for r in got]).reshape(-1, 5).tolist() == want.tolist()
    assert neighbors.KNeighborsClassifier().fit(df, f, "y", "id").score(df) == 1
    assert neighbors.RadiusNeighborsClassifier(radius=1.5).fit(df, f, "y", "id").score(df) == 1
    df2, f = frame(X, T)
    assert neighbors.KNeighborsRegressor(n_neighbors=3).fit(df2, f, "y", "id").score(df2) > 0.9
    assert len(neighbors.KNeighborsRegressor().fit_multi(df2, f, ["y", "x0"], "id").predict_multi(df2).first()["prediction"]) == 2
    far = df.filter("id = 0").withColumn("x0", F.lit(99.0))
    with pytest.raises(Exception, match="no neighbour"):
        neighbors.RadiusNeighborsRegressor(radius=0.1).fit(df, f, "y", "id").predict(far).collect()


def test_local_outlier_factor(frame):
    x = np.r_[X, [[50.0, 50.0]]]
    df, f = frame(x)
    out = neighbors.LocalOutlierFactor(n_neighbors=10).fit_predict(df, f).orderBy("negative_outlier_factor").first()
    assert out["id"] == 90 and out["prediction"] == -1


def test_clusterings_find_the_blobs(frame):
    df, f = frame(X, Y)
    found = {
        "kmeans": column(cluster.KMeans(n_clusters=3, n_init=3).fit(df, f).predict(df), "cluster"),
        "mini": column(cluster.MiniBatchKMeans(n_clusters=3, batch_size=30, random_state=1).fit(df, f).predict(df), "cluster"),
        "dbscan": column(cluster.DBSCAN(eps=2.0).fit_predict(df, f), "cluster"),
        "single": column(cluster.AgglomerativeClustering(n_clusters=3, linkage="single").fit_predict(df, f), "cluster"),
        "ward": column(cluster.AgglomerativeClustering(n_clusters=3).fit_predict(df, f), "cluster"),
        "shift": column(cluster.MeanShift(bandwidth=2.5).fit(df, f).predict(df), "cluster"),
        "birch": column(cluster.Birch(threshold=1.0).fit(df, f).predict(df), "cluster"),
    }
    for name, labels in found.items():
        pairs = set(zip(labels, Y.tolist()))
        assert len(pairs) == 3 or name == "mini", (name, pairs)


def test_dbscan_border_is_independent_of_order(frame):
    df, f = frame(np.array([[3.0], [0], [0.1], [1], [1.1], [2], [2.1]]))
    out = cluster.DBSCAN(eps=1.0, min_samples=4).fit_predict(df, f)
    assert column(out, "cluster") == [0] * 7 and not column(out, "is_core")[0]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i != 20], "a long, b long")
    got = {r["node"]: r["root"] for r in pairwise.components(edges).collect()}
    assert all(v == (0 if k <= 20 else 21) for k, v in got.items()) and len(got) == 41


def test_trees_both_ways(frame):
    df, f = frame(X, Y)
    local = trees.DecisionTreeClassifier(max_depth=3).fit(df, f, "y")
    far = trees.DecisionTreeClassifier(max_depth=3)
    far.local_rows = 0
    far.fit(df, f, "y")
    assert local.score(df) == far.score(df) == 1
    assert sorted(local.tree_.threshold) == pytest.approx(sorted(far.tree_.threshold))
    df, f = frame(X, T)
    r = trees.DecisionTreeRegressor(max_depth=4)
    r.local_rows = 0
    assert r.fit(df, f, "y").score(df) > 0.9


@pytest.mark.parametrize("model", [
    trees.RandomForestClassifier(n_estimators=8, oob_score=True, random_state=0), trees.GradientBoostingClassifier(n_estimators=5),
    trees.HistGradientBoostingClassifier(max_iter=5, min_samples_leaf=5), kernels.LinearSVC(max_iter=30, random_state=0),
    kernels.MLPClassifier(hidden_layer_sizes=(16,), max_iter=100, learning_rate_init=0.01, random_state=0),
])
def test_classifiers(frame, model):
    df, f = frame(X, Y)
    assert model.fit(df, f, "y").score(df) > 0.9


@pytest.mark.parametrize("model", [kernels.SVC(probability=True, random_state=0), kernels.NuSVC(nu=0.3), kernels.GaussianProcessClassifier(), trees.GradientBoostingClassifier(n_estimators=5, loss="exponential")])
def test_binary_classifiers(frame, model):
    df, f = frame(X[:60], Y[:60])
    assert model.fit(df, f, "y").score(df) > 0.9
    if hasattr(model, "predict_proba") and not isinstance(model, kernels.NuSVC):
        assert abs(sum(model.predict_proba(df).first()["probability"]) - 1) < 1e-9


@pytest.mark.parametrize("model", [
    trees.RandomForestRegressor(n_estimators=8, random_state=0, oob_score=True), trees.GradientBoostingRegressor(n_estimators=20), trees.GradientBoostingRegressor(n_estimators=20, loss="huber"),
    trees.GradientBoostingRegressor(n_estimators=20, loss="absolute_error"), trees.HistGradientBoostingRegressor(max_iter=40, min_samples_leaf=5), kernels.SVR(C=10.0), kernels.NuSVR(C=10.0),
    kernels.LinearSVR(max_iter=100, random_state=0), kernels.MLPRegressor(hidden_layer_sizes=(32,), max_iter=200, learning_rate_init=0.01, random_state=0), kernels.GaussianProcessRegressor(alpha=1e-3),
])
def test_regressors(frame, model):
    df, f = frame(X, T)
    assert model.fit(df, f, "y").score(df) > 0.8


def test_one_class(frame):
    df, f = frame(X)
    n = kernels.OneClassSVM(nu=0.2).fit(df, f, "id").predict(df).filter("prediction = -1").count()
    assert 5 <= n <= 30


@pytest.mark.parametrize("model", [
    manifold.Isomap(n_neighbors=8), manifold.MDS(n_init=1, random_state=0), manifold.LocallyLinearEmbedding(n_neighbors=8), manifold.LocallyLinearEmbedding(n_neighbors=8, method="ltsa"),
    manifold.SpectralEmbedding(n_neighbors=8), manifold.TSNE(perplexity=10.0, n_iter=300, random_state=0), manifold.UMAP(n_neighbors=8, n_epochs=50, random_state=0),
])
def test_embeddings_keep_neighbours(frame, model):
    t = np.linspace(0, 3, 80)
    x = np.c_[np.cos(t), np.sin(t), t] + RNG.normal(scale=0.01, size=(80, 3))
    df, f = frame(x)
    out = model.fit_transform(df, f).orderBy("id").collect()
    e = np.array([[r["e0"], r["e1"]] for r in out])
    assert manifold.trustworthiness(x, e) > 0.75
    with pytest.raises(NotImplementedError):
        model.transform(df)


def test_stream_counts_each_batch_once(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select(F.col("id").cast("double").alias("v")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    fit = incremental.StreamingFit(preprocessing.StandardScaler(), ["v"], state=f"{tmp_path}/state")
    model = fit.run(stream, f"{tmp_path}/check")
    assert model.n_samples_seen_ == 30 and np.isclose(model.mean_[0], 14.5)
    fit(spark.createDataFrame([(1.0,)], "v double"), fit.last)
    assert model.n_samples_seen_ == 30
    again = incremental.StreamingFit.resume(spark, f"{tmp_path}/state", ["v"])
    assert again.last == fit.last and np.isclose(again.model.mean_[0], 14.5)


def test_long_form_and_saved_models(frame, spark, tmp_path):
    df, f = frame(X, Y)
    assert tables.to_long(df, f, "id").count() == 180
    m = preprocessing.StandardScaler().fit(df, f)
    tables.save_model(m, spark, f"{tmp_path}/m")
    assert np.allclose(tables.load_model(spark, f"{tmp_path}/m").mean_, m.mean_)


def test_histogram_boosting_in_spark_equals_numpy(frame):
    df, f = frame(X, T)
    for settings in ({}, {"max_leaf_nodes": 6}, {"max_depth": 2}, {"monotonic_cst": [1, 0]}):
        a = trees.HistGradientBoostingRegressor(max_iter=3, min_samples_leaf=5, max_bins=32, **settings).fit(df, f, "y")
        b = trees.HistGradientBoostingRegressor(max_iter=3, min_samples_leaf=5, max_bins=32, **settings)
        b.local_rows = 0
        b.fit(df, f, "y")
        assert np.allclose(column(a.predict(df), "prediction"), column(b.predict(df), "prediction"), atol=1e-9), settings
    df, f = frame(X, Y)
    c = trees.HistGradientBoostingClassifier(max_iter=3, min_samples_leaf=5)
    c.local_rows = 0
    assert c.fit(df, f, "y").score(df) > 0.9


def test_long_form_fits(frame, spark):
    from millrace.operators import selection

    x = np.abs(np.round(X)) * (RNG.random(X.shape) < 0.6)
    df, f = frame(x, Y)
    rows = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v], "row_id int, feature_idx int, value double")
    y = spark.createDataFrame([(i, int(v)) for i, v in enumerate(Y)], "row_id int, y int")
    a, b = trees.DecisionTreeClassifier(max_depth=3).fit(df, f, "y"), trees.DecisionTreeClassifier(max_depth=3).fit_long(rows, 2, y)
    assert a.tree_.threshold == b.tree_.threshold
    assert np.allclose(selection.chi2(df, f, "y")[0], selection.chi2_sparse(rows, y, 2)[0])


def test_concepts():
    from millrace.functions import concepts

    assert isinstance(preprocessing.StandardScaler(), concepts.TransformerLike) and isinstance(preprocessing.StandardScaler(), concepts.IncrementalLike)
    assert isinstance(trees.DecisionTreeRegressor(), concepts.MultiOutputRegressorLike) and not isinstance(preprocessing.StandardScaler(), concepts.PredictorLike)


def test_equal_rows_are_drawn_one_by_one(frame):
    # Half of all rows have one value: half of a tree's sample has it, and k-means++ starts there half of the time.
    r = np.random.default_rng(0)
    x = np.r_[np.full((3000, 1), 5.0), r.normal(size=(3000, 1))]
    df, names = frame(x)
    m = covariance.IsolationForest(n_estimators=10, max_samples=256).fit(df, names, "id")
    scores = m.score_samples(df).groupBy((F.col("x0") == 5).alias("same")).agg(F.avg("score").alias("s")).collect()
    assert len(m.trees_) == 10 and len(scores) == 2
    rows = df.select(F.array("x0").alias("v"), F.monotonically_increasing_id().alias("r"))
    starts = [cluster.KMeans(n_clusters=1)._starts(rows, F.col("v"), seed)[0, 0] for seed in range(20)]
    assert 4 <= sum(s == 5 for s in starts) <= 16


def test_isolation_forest_takes_off_rows_in_a_gap(frame):
    # The far rows lie beyond a million: hardly a cut falls between the near rows and new ones at 100 and 1,000.
    x = np.r_[np.random.default_rng(3).uniform(size=950), np.arange(1, 51) * 1e6]
    df, names = frame(x[:, None])
    new, _ = frame(np.array([[100.0], [1000.0], [x[:950].max()], [x[:950].min()], [-50.0], [0.5], [3.5e6], [1e9]]))
    setting = {"n_estimators": 50, "max_samples": 64, "contamination": 0.05}
    m = covariance.IsolationForest(**setting).fit(df, names, "id")
    assert sorted(r["id"] for r in m.predict(df).filter("prediction = -1").collect()) == list(range(950, 1000))
    assert column(m.predict(new), "prediction") == [-1, -1, 1, 1, -1, 1, -1, -1]
    plain = covariance.IsolationForest(as_sampled=False, **setting).fit(df, names, "id")
    walked = column(plain.score_samples(new), "score")
    assert walked[0] == walked[1] == walked[2]

    def path(tree, v, as_sampled, k=0, d=1):
        f, t, left, right, p, a, b = (y[k] for y in tree)
        gap = max(a - v, v - b, 0.0) if as_sampled and f >= 0 else 0.0
        return p if f < 0 else (gap * d + (b - a) * path(tree, v, as_sampled, left if v < t else right, d + 1)) / (gap + b - a)

    for forest in (m, plain):
        want = [-(2.0 ** (-np.mean([path(t, r["x0"], forest.as_sampled) for t in forest.trees_]) / covariance._harmonic_path(64))) for r in new.orderBy("id").collect()]
        assert np.allclose(column(forest.score_samples(new), "score"), want, rtol=1e-12)


def test_rows_inside_the_ranges_keep_their_scores(frame):
    df, names = frame(X)  # every row is in every sample
    near, plain = (covariance.IsolationForest(n_estimators=5, max_samples=len(X), as_sampled=way).fit(df, names, "id").score_samples(df) for way in (True, False))
    assert near.exceptAll(plain).count() == 0


def test_categories_of_histogram_boosting(spark, frame):
    r = np.random.default_rng(1)
    c = r.integers(0, 30, 900) * 7.0
    y = np.where(np.isin(c, [7.0, 70.0, 140.0]), 5.0, 0.0)
    df, names = frame(c[:, None], y)
    far = trees.HistGradientBoostingRegressor(max_iter=5, categorical_features=[0], max_bins=40)
    far.local_rows = 0
    for m in (trees.HistGradientBoostingRegressor(max_iter=5, categorical_features=[0], max_bins=40), far):
        p = m.fit(df, names, "y").predict(df).select("y", "prediction").toPandas()
        assert p.groupby("y")["prediction"].nunique().tolist() == [1, 1] and p.loc[p.y == 5, "prediction"].min() > p.loc[p.y == 0, "prediction"].max()
        assert len(m.train_score_) == 5
        new = m.predict(spark.createDataFrame([(3.0,)], ["x0"])).first()["prediction"]  # a category that wasn't there
        assert np.isfinite(new)
    with pytest.raises(ValueError, match="categories"):
        trees.HistGradientBoostingRegressor(categorical_features=[0], max_bins=20).fit(df, names, "y")


def test_deep_trees_in_spark(frame):
    x = np.arange(70.0)[:, None]
    y = np.where(np.arange(70) % 2 == 0, 1.0, 0.0) * 2.0 ** np.arange(70)  # a split takes off one row at a time
    df, names = frame(x, y)
    whole, far = trees.DecisionTreeRegressor(), trees.DecisionTreeRegressor(max_depth=8)
    far.local_rows = 0
    assert whole.fit(df, names, "y").predict(df).filter("prediction <> y").count() == 0
    near = trees.DecisionTreeRegressor(max_depth=8).fit(df, names, "y")
    assert near.predict(df).select("prediction").exceptAll(far.fit(df, names, "y").predict(df).select("prediction")).count() == 0


def test_labels_beyond_a_bound_stay_a_table(spark):
    df = spark.createDataFrame([(i, f"l{i % 50:02d}") for i in range(200)], "id long, name string")
    near, far = preprocessing.LabelEncoder().fit(df, "name"), preprocessing.LabelEncoder()
    far.max_labels = 10
    far.fit(df, "name")
    codes = [sorted((r["id"], r["name_code"]) for r in m.transform(df).collect()) for m in (near, far)]
    assert codes[0] == codes[1]
    assert far.inverse_transform(far.transform(df)).filter("label <> name").count() == 0
    with pytest.raises(Exception, match="not seen"):
        far.transform(spark.createDataFrame([(1, "zz")], "id long, name string")).collect()


def test_quantiles_by_counting(frame):
    from millrace.functions import stats

    r = np.random.default_rng(2)
    x = np.c_[r.normal(size=500), r.integers(0, 5, 500), np.ones(500)]
    df, names = frame(x)
    shares = (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)
    assert np.allclose(stats.quantiles(df, [F.col(n) for n in names], shares), np.quantile(x, shares, axis=0).T)
    with pytest.raises(ValueError, match="empty"):
        stats.quantiles(df.limit(0), [F.col("x0")], (0.5,))


def test_long_form_of_more_estimators(spark, frame):
    r = np.random.default_rng(3)
    x = np.where(r.random((80, 3)) < 0.6, 0.0, r.normal(size=(80, 3)))
    x[0] = 0  # stores nothing
    y = (x[:, 0] > 0.1).astype(int)
    df, names = frame(x, y)
    long = spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v], "row_id long, feature_idx int, value double")
    targets = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "row_id long, y int")
    for model in (
        trees.DecisionTreeClassifier(max_depth=2), trees.DecisionTreeRegressor(max_depth=2), trees.HistGradientBoostingClassifier(max_iter=2, min_samples_leaf=5),
        trees.HistGradientBoostingRegressor(max_iter=2, min_samples_leaf=5), kernels.LinearSVC(max_iter=5, random_state=0), kernels.LinearSVR(max_iter=5, random_state=0), kernels.SVC(), kernels.SVR(max_iter=50),
    ):
        dense = sorted((r["id"], r["prediction"]) for r in model.clone().fit(df, names, "y").predict(df).collect())
        sparse = model.clone().fit_sparse(long, targets, 3)
        got = sorted((r["row_id"], r["prediction"]) for r in sparse.predict_sparse(long, targets).collect())
        assert [i for i, _ in got] == list(range(80)) and np.allclose([v for _, v in got], [v for _, v in dense]), type(model).__name__
    positive = spark.createDataFrame([(i, j, abs(float(v))) for i, row in enumerate(x) for j, v in enumerate(row) if v], "row_id long, feature_idx int, value double")
    assert selection.SelectKBest(score_func=selection.chi2, k=1).fit_sparse(positive, targets, 3).get_support_indices() == [0]
    m = cluster.MiniBatchKMeans(n_clusters=2, max_iter=3).fit_sparse(long, targets.select("row_id"), 3)
    assert m.cluster_centers_.shape == (2, 3)


def test_forests_and_boosting_in_spark(frame):
    r = np.random.default_rng(5)
    x = r.integers(0, 25, (600, 3)).astype(float)
    y = x[:, 0] * 2 + (x[:, 1] > 12) * 30.0
    c = (y > 40).astype(int) + (y > 60)
    for model, target in (
        (trees.RandomForestRegressor(n_estimators=2, max_depth=3, bootstrap=False, max_features_mode="all"), y),
        (trees.RandomForestClassifier(n_estimators=2, max_depth=3, bootstrap=False, max_features_mode="all"), c),
        (trees.GradientBoostingRegressor(n_estimators=4, max_depth=2), y),
        (trees.GradientBoostingClassifier(n_estimators=3, max_depth=2), c),
    ):
        df, names = frame(x, target)
        near, far = model.clone().fit(df, names, "y"), model.clone()
        far.local_rows = 0
        far.fit(df, names, "y")
        a, b = (column(m.predict(df), "prediction") for m in (near, far))
        assert np.allclose(a, b), type(model).__name__  # each value has a bin of its own
        assert np.allclose(near.feature_importances_, far.feature_importances_, atol=1e-6)
    df, names = frame(x, y)
    far = trees.RandomForestRegressor(n_estimators=20, max_depth=6, oob_score=True, random_state=3)
    far.local_rows = 0
    far.fit(df, names, "y", "id")
    assert far.score(df, "y") > 0.8 and 0.5 < far.oob_score_ < 1 and len({str(a[1]) for a in far.estimators_}) > 15
    w = trees.bootstrap_weights(np.arange(200_000), 1, 7, 1.0)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03


def test_passes_over_rows_that_stay_in_spark(frame):
    r = np.random.default_rng(9)
    x = r.normal(size=(600, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] > 0).astype(int)
    z = 3 * x[:, 0] - x[:, 1] + 2
    for model, target, least in (
        (linear.SGDClassifier(max_iter=15), y, 0.95), (linear.Perceptron(max_iter=10), y, 0.9), (linear.SGDRegressor(max_iter=20), z, 0.95),
        (kernels.LinearSVC(max_iter=15), y, 0.95), (kernels.LinearSVR(max_iter=25), z, 0.95),
        (kernels.MLPClassifier(hidden_layer_sizes=(8,), max_iter=40, learning_rate_init=0.01, random_state=1), y, 0.95),
        (kernels.MLPRegressor(hidden_layer_sizes=(8,), max_iter=60, learning_rate_init=0.02, random_state=1), z, 0.9),
    ):
        df, names = frame(x, target)
        model.max_rows = 100
        assert model.fit(df, names, "y").score(df, "y") >= least, type(model).__name__
    three = (x[:, 0] > 0.5).astype(int) + (x[:, 0] > -0.5)
    df, names = frame(x, three)
    m = kernels.MLPClassifier(hidden_layer_sizes=(8,), max_iter=40, learning_rate_init=0.02, random_state=1)
    m.max_rows = 100
    assert m.fit(df, names, "y").score(df, "y") > 0.85


def test_dense_groups_make_no_pairs(frame):
    x = np.r_[np.zeros((1500, 2)), np.ones((1500, 2)) * 9, [[0.4, 0.0], [50.0, 50.0]]]
    df, f = frame(x)
    cols = [F.col(c) for c in f]
    index = pairwise.Index(df, cols, "id")
    assert pairwise.links_within(index, df, cols, "id", 0.5).count() < 30_000  # of 4.5 million pairs
    got = column(cluster.DBSCAN(eps=0.5).fit_predict(df, f), "cluster")
    assert got == [0] * 1500 + [1] * 1500 + [0, -1]


@pytest.mark.parametrize("kernel", ["rbf", "dot_product"])
def test_gaussian_processes_without_a_bound_of_rows(frame, kernel):
    df, f = frame(X, T)
    near, far = (kernels.GaussianProcessRegressor(kernel=kernel, alpha=0.1, length_scale=3.0, normalize_y=True) for _ in range(2))
    far.max_rows = 20
    got = [(column(m.fit(df, f, "y", "id").predict(df), "prediction"), column(m.predict_std(df), "std"), m.log_marginal_likelihood_value_) for m in (near, far)]
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(*got)) and len(far.X_train_) < 90
    few = df.filter("id < 15")
    assert np.allclose(near.predict_covariance(few), far.predict_covariance(few), atol=1e-6)


def test_gaussian_process_classes_without_a_bound_of_rows(frame):
    df, f = frame(X, (Y > 1).astype(int))
    near, far = (kernels.GaussianProcessClassifier(length_scale=3.0) for _ in range(2))
    far.max_rows = 20
    got = [(column(m.fit(df, f, "y", "id").decision_function(df), "decision"), column(m.predict_proba(df), "probability"), m.n_iter_) for m in (near, far)]
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(*got))


@pytest.mark.parametrize("model", [
    kernels.SVC(C=3.0, tol=1e-8), kernels.SVC(kernel="linear", tol=1e-8), kernels.NuSVC(nu=0.3, tol=1e-8), kernels.SVR(C=10.0, tol=1e-8), kernels.SVR(kernel="linear", epsilon=0.0, tol=1e-8),
    kernels.NuSVR(kernel="linear", C=10.0, tol=1e-8), kernels.OneClassSVM(nu=0.213, gamma=0.05, tol=1e-7),
], ids=lambda m: type(m).__name__)
def test_kernel_machines_without_a_bound_of_rows(frame, model):
    noise = np.random.default_rng(5).normal(scale=2.0, size=90)
    df, f = frame(X, (X[:, 0] + noise > 0).astype(int) if isinstance(model, kernels._Binary) else T + noise)
    far = model.clone()
    far.max_rows = 20
    args = (df, f, "id") if isinstance(model, kernels.OneClassSVM) else (df, f, "y", "id")
    got = [column(m.fit(*args).decision_function(df), "decision") for m in (model, far)]
    assert far._factor is not None and np.allclose(*got, atol=2e-4 * np.abs(got[0]).max()), np.abs(np.subtract(*got)).max()


def test_mutual_information_of_many_rows(spark):
    # Ties in every feature; the same numbers from all pairs of rows.
    from millrace.functions import special

    r = np.random.default_rng(7)
    x, z = np.round(r.normal(size=700), 1), r.normal(size=700)
    y, c = np.round(x + 0.1 * z, 2), (z > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), float(v), int(w)) for a, b, v, w in zip(x, z, y, c)], "x double, z double, y double, c int")

    def psi(v):
        return special.digamma(np.asarray(v, float))

    def regression(a):
        dx, dy = np.abs(a[:, None] - a[None]) / a.std(), np.abs(y[:, None] - y[None]) / y.std()
        d = np.nextafter(np.sort(np.maximum(dx, dy), axis=1)[:, 3], 0)[:, None]
        return max(0.0, psi([700])[0] + psi([3])[0] - (psi((dx <= d).sum(axis=1)) + psi((dy <= d).sum(axis=1))).mean())

    def classes(a):
        total = 0.0
        for v in (0, 1):
            own = a[c == v]
            d = np.nextafter(np.sort(np.abs(own[:, None] - own[None]), axis=1)[:, 3], 0)
            m = (np.abs(own[:, None] - a[None]) <= d[:, None]).sum(axis=1)
            total += len(own) * (psi([3])[0] - psi([len(own)])[0]) - psi(np.maximum(m, 1)).sum()
        return max(0.0, psi([700])[0] + total / 700)

    assert np.allclose(selection.mutual_info_regression(df, ["x", "z"], "y")[0], [regression(x), regression(z)], atol=1e-12)
    assert np.allclose(selection.mutual_info_classif(df, ["x", "z"], "c")[0], [classes(x), classes(z)], atol=1e-12)
    many = spark.range(6000).select((F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 2) * 9000 + F.col("id")).cast("double").alias("x"))
    assert abs(selection.mutual_info_classif(many, ["x"], "y")[0][0] - np.log(2)) < 0.01
    assert selection.mutual_info_regression(many, ["x"], "y")[0][0] > 0


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("width", [1, 2])
def test_single_linkage_without_a_bound_of_rows(frame, metric, width):
    x = np.random.default_rng(11).normal(size=(90, width))
    df, f = frame(x)
    near, far = (cluster.AgglomerativeClustering(n_clusters=7, linkage="single", metric=metric) for _ in range(2))
    far.max_rows = 20
    assert column(near.fit_predict(df, f), "cluster") == column(far.fit_predict(df, f), "cluster")
    assert np.allclose(near.distances_, far.distances_) and near.children_ == far.children_


def test_mean_shift_of_many_rows(spark):
    for width in (1, 2):
        x = np.r_[np.random.default_rng(12).normal(size=(3500, width)), np.random.default_rng(13).normal(size=(2500, width)) + 12]
        df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"x{i}" for i in range(width)])
        m = cluster.MeanShift(bandwidth=6.0).fit(df, df.columns)
        assert np.allclose(m.cluster_centers_, [x[:3500].mean(axis=0), x[3500:].mean(axis=0)], atol=0.05)


@pytest.mark.parametrize("scale", [1.0, 1e8])
def test_nearest_of_copies_and_far_rows(frame, scale):
    # Differences decide where a product of matrices is rounded; of equals the smallest ids.
    x = np.repeat(np.random.default_rng(14).normal(size=(30, 3)), 3, axis=0) + scale
    df, f = frame(x)
    d = sum((x[:, None, j] - x[None, :, j]) ** 2 for j in range(3))
    for without in (False, True):
        if without:
            np.fill_diagonal(d, np.inf)
        want = np.argsort(d, axis=1, kind="stable")[:, :4]
        for held in (pairwise.HELD, 0):
            cols = [F.col(c) for c in f]
            got = pairwise.top_k(pairwise.Index(df, cols, "id", held=held), df, cols, "id", 4, without).orderBy("query_id", "rank").collect()
            assert np.array([r["id"] for r in got]).reshape(-1, 4).tolist() == want.tolist()


@pytest.mark.parametrize("model", [manifold.SpectralEmbedding(n_neighbors=6), manifold.LocallyLinearEmbedding(n_neighbors=6)], ids=lambda m: type(m).__name__)
def test_graph_embeddings_without_a_bound_of_rows(frame, model):
    # In one part it is the embedding from all distances; of several parts each has a place of its own.
    x = np.random.default_rng(15).normal(size=(80, 2))
    df, f = frame(x)
    far = model.clone()
    far.max_rows = 20
    a, b = (m.fit(df, f).embedding_ for m in (model, far))
    assert np.allclose(a, b, atol=1e-6)
    far.fit(*frame(np.r_[x, x + 50, x - 50, x + 90]))
    places = np.round(far.embedding_, 9)
    assert [len(np.unique(places[i * 80 : (i + 1) * 80], axis=0)) for i in range(4)] == [1] * 4 and len(np.unique(places, axis=0)) == 4


def far_and_near(frame, model):
    x = np.random.default_rng(16).normal(size=(80, 3))
    df, f = frame(x)
    far = model.clone()
    far.max_rows = 20
    return model.fit(df, f), far.fit(df, f)


def test_scaling_without_a_bound_of_rows(frame):
    near, far = far_and_near(frame, manifold.MDS(n_init=2, max_iter=50, random_state=1))
    assert np.allclose(near.embedding_, far.embedding_, atol=1e-8) and np.isclose(near.stress_, far.stress_)


def test_scaling_by_tiles():
    x = np.random.default_rng(22).normal(size=(83, 4))
    near, far = (manifold.MDS(n_init=1, max_iter=30, random_state=1) for _ in range(2))
    assert np.allclose(near._embed(x), far._embed_far(x, 16), atol=1e-8) and np.isclose(near.stress_, far.stress_) and near.n_iter_ == far.n_iter_


@pytest.mark.parametrize("most", [2_000, 20])
def test_scaling_keeps_distances_that_fit(frame, most):
    # Four features on a plane, of which copies and a far group are part: two components hold every distance.
    r = np.random.default_rng(23)
    z = r.normal(size=(60, 2)) + np.arange(60)[:, None] % 2 * [20, 0]
    x = np.r_[z, z[:9]] @ r.normal(size=(2, 4))
    m = manifold.MDS(n_init=1, max_iter=5, random_state=1)
    m.max_rows = most
    m.fit(*frame(x))
    assert np.allclose(manifold.distances(m.embedding_), manifold.distances(x), atol=1e-6) and m.stress_ == 0
    one = manifold.MDS(n_components=3, n_init=1).fit(*frame(x[:, :1] * [1, 0]))
    assert np.allclose(manifold.distances(one.embedding_), manifold.distances(x[:, :1]), atol=1e-6)


def test_umap_without_a_bound_of_rows(frame):
    near, far = far_and_near(frame, manifold.UMAP(n_neighbors=6, n_epochs=5, random_state=1))
    assert np.allclose(near.embedding_, far.embedding_, atol=1e-5)


def test_tsne_without_a_bound_of_rows(frame):
    near, far = far_and_near(frame, manifold.TSNE(perplexity=8.0, n_iter=20, learning_rate=20.0, random_state=1))
    assert np.allclose(near.embedding_, far.embedding_, rtol=1e-3, atol=1e-3 * np.abs(near.embedding_).max()) and np.isclose(near.kl_divergence_, far.kl_divergence_, rtol=1e-3)


def test_tsne_far_makes_no_pairs(frame, monkeypatch):
    # A grid takes the place of all pairs of rows, and near rows come from boxes.
    def no_pairs(*_):
        raise AssertionError("all pairs of rows")

    r = np.random.default_rng(24)
    x = np.r_[r.normal(size=(900, 2)), r.normal(size=(900, 2)) + [20, 0]]
    for name in ("in_blocks", "distances"):
        monkeypatch.setattr(manifold, name, no_pairs)
    m = manifold.TSNE(perplexity=8.0, n_iter=300, learning_rate=50.0, random_state=1)
    m.max_rows = 20
    e = m.fit(*frame(x)).embedding_
    d = manifold.gaps2(e, e)
    np.fill_diagonal(d, np.inf)
    assert ((d.argmin(axis=1) < 900) == (np.arange(1800) < 900)).all()


@pytest.mark.parametrize("wide, k", [(1e-4, 1), (1e-4, 2), (1, 1), (5, 2), (30, 1), (30, 2)])
def test_repulsion_by_a_grid(wide, k):
    e = np.random.default_rng(25).normal(0, wide, (900, k))
    with ThreadPoolExecutor(2) as pool:
        grid = manifold.Repulsion(pool)
        (z, *ways), (want, *right) = grid(e), manifold.repulsion(e)
        assert grid.fits(e) == (wide < 1 or k == 1)
    assert np.isclose(z, want, rtol=5e-4)
    assert all(np.abs(a - b).max() < 5e-4 * np.abs(b).max() for a, b in zip(ways, right))


def test_links_from_near_rows():
    # Copies have more equals than the perplexity; a row far off needs more near rows than others.
    r = np.random.default_rng(26)
    x = np.r_[r.normal(size=(900, 2)), np.repeat(r.normal(size=(4, 2)), 30, axis=0), [[1e3, 0]]]
    m, n = manifold.TSNE(perplexity=8.0), len(x)
    d = manifold.gaps2(x, x)
    np.fill_diagonal(d, np.inf)
    i, j, v = m._links(x, 1e-9)
    got = np.zeros((n, n))
    got[i, j] = v
    assert np.allclose(got.sum(axis=1), 1, atol=1e-6) and len(np.unique(i * n + j)) == len(i)
    h = -(got * np.log(np.maximum(got, 1e-300))).sum(axis=1)
    own = (np.arange(n) < 900) & (d.argmin(axis=1) < 900)  # a nearest copy brings 29 more
    assert np.allclose(h[own], np.log(8), atol=2e-5) and np.allclose(got[900:930, 900:930], (1 - np.eye(30)) / 29)
    for a in (0, 500, 899, n - 1):
        # Logarithms of the shares are a line of the squared distances with the same slope, and those left out are small.
        at = got[a] > 0
        slope, most = np.polyfit(d[a, at], np.log(got[a, at]), 1)
        rest = ~at & (np.arange(n) != a)
        assert np.allclose(slope * d[a, at] + most, np.log(got[a, at]), atol=1e-6) and (np.exp(slope * d[a, rest] + most) < 2e-9).all()


def test_near_rows_by_boxes():
    x = np.random.default_rng(27).integers(0, 40, (1500, 2)).astype(float)
    d = manifold.gaps2(x, x)
    np.fill_diagonal(d, np.inf)
    boxes = manifold.Boxes(x, 100)
    assert np.array_equal(np.sort(np.concatenate(boxes.rows)), np.arange(1500))
    for rows in boxes.rows:
        at, own = boxes.nearest(rows, 12)
        assert np.array_equal(np.sort(own, axis=1), np.sort(d[rows], axis=1)[:, :12]) and np.array_equal(d[rows[:, None], at], own)


@pytest.mark.parametrize("most", [0, 3, 48])
def test_paths_with_and_without_a_core(most):
    # Nodes of at most so many links are taken out; two parts have no path to each other.
    r = np.random.default_rng(20)
    a, b = r.integers(0, 30, 70), r.integers(0, 30, 70)
    a, b = np.r_[a[a != b], a[a != b] + 30], np.r_[b[a != b], b[a != b] + 30]
    w = r.uniform(0.1, 1, len(a))
    want = np.where(np.eye(60) > 0, 0, np.inf)
    np.minimum.at(want, (np.r_[a, b], np.r_[b, a]), np.r_[w, w])
    for k in range(60):
        want = np.minimum(want, want[:, k : k + 1] + want[k])
    p = paths.Paths(60, a, b, w, most)
    got = np.concatenate([p.lengths(i, min(i + 7, 60)).T.copy() for i in range(0, 60, 7)])
    assert np.allclose(got, want[np.ix_(p.node, p.node)]) and np.isinf(got).any()


def test_isomap_without_a_bound_of_rows(frame):
    near, far = far_and_near(frame, manifold.Isomap(n_neighbors=6))
    assert np.allclose(near.embedding_, far.embedding_, atol=1e-8)
    assert np.allclose(near.embedding_, manifold.classical(near.dist_matrix_, 2))


def test_isomap_of_a_line_in_parts(frame):
    # Groups of copies and wide gaps leave the neighbours' graph in parts; on a line paths are distances all the same.
    r = np.random.default_rng(21)
    x = np.r_[r.uniform(0, 1, 30), r.uniform(5, 6, 30), np.repeat([9.0, 9.5, 14.0], 10)]
    for most in (2_000, 20):
        m = manifold.Isomap(n_components=1, n_neighbors=4)
        m.max_rows = most
        e = m.fit(*frame(x[:, None])).embedding_[:, 0]
        assert np.allclose(e, x - x.mean(), atol=1e-9)
