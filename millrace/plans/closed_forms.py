"""Queries of iterative estimators in settings whose result SQL can reach by a formula or step by step.

The estimators are the ones of any other setting; only the tables and parameters are chosen so.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import pairwise
from millrace.functions.core import settled
from millrace.operators import cluster, covariance, decomposition, kernels, linear, manifold, preprocessing, selection, trees
from millrace.plans.catalogue import LABELLED, LINE, OLS2, X2, _coefficients, _orders_folded, _ridge_scores, _FOLDS, _vector, embedded, labelled, numbers, query
from millrace.sources.tables import table

# --- linear models --------------------------------------------------------------------------

#: Moments of three features and the price.
M3 = (
    "m AS (SELECT count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_tax) AS m3, avg(l_extendedprice) AS my, var_pop(l_quantity) AS g11, covar_pop(l_quantity, l_discount) AS g12, "
    "covar_pop(l_quantity, l_tax) AS g13, var_pop(l_discount) AS g22, covar_pop(l_discount, l_tax) AS g23, var_pop(l_tax) AS g33, covar_pop(l_quantity, l_extendedprice) AS c1, "
    "covar_pop(l_discount, l_extendedprice) AS c2, covar_pop(l_tax, l_extendedprice) AS c3 FROM lineitem)"
)


def _soft(r, l1, d):
    return f"sign({r}) * greatest(abs({r}) - {l1}, 0) / {d}"


@query(
    f"WITH RECURSIVE {M3}, r AS (SELECT 0 AS k, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3 UNION ALL "
    f"SELECT k + 1, a, b, {_soft('(c3 - g13 * a - g23 * b)', 0.5, 'g33')} FROM (SELECT *, {_soft('(c2 - g12 * a - g23 * w3)', 0.5, 'g22')} AS b FROM "
    f"(SELECT *, {_soft('(c1 - g12 * w2 - g13 * w3)', 0.5, 'g11')} AS a FROM r, m WHERE k < 50))), "
    "w AS (SELECT * FROM r, m WHERE k = 50) " + _vector("w1", "w2", "w3", "my - w1 * m1 - w2 * m2 - w3 * m3", digits=3)
)
def lasso_cd(spark, sf):
    return _coefficients(spark, linear.Lasso(alpha=0.5, tol=1e-12).fit(table(spark, sf, "lineitem"), LINE[:3], "l_extendedprice"), 3)


def _evidence(ard: bool, steps: int = 12) -> str:
    """Evidence maximisation on one feature, step by step."""
    w = "c / (g + lam / alpha)"
    gamma = "1 - lam / (alpha * g + lam)" if ard else "alpha * g / (lam + alpha * g)"
    return (
        "WITH RECURSIVE m AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) * count(*) AS g, covar_pop(l_quantity, l_extendedprice) * count(*) AS c, var_pop(l_extendedprice) * count(*) AS yy FROM lineitem), "
        "r AS (SELECT 0 AS k, n / yy AS alpha, 1.0::DOUBLE AS lam FROM m UNION ALL "
        "SELECT k + 1, (n - gamma + 2e-6) / (greatest(yy - 2 * w * c + w * w * g, 0) + 2e-6), (gamma + 2e-6) / (w * w + 2e-6) "
        f"FROM (SELECT *, {w} AS w, {gamma} AS gamma FROM r, m WHERE k < {steps})), "
        f"w AS (SELECT {w} AS w, my - {w} * mx AS b, alpha, lam FROM r, m WHERE k = {steps}) " + _vector("w", "b", "alpha * 1e9", "lam", digits=3)
    )


def _evidence_values(spark, m):
    return numbers(spark, [m.coef_[0], m.intercept_, m.alpha_ * 1e9, float(np.ravel(m.lambda_)[0])], 3)


@query(_evidence(False))
def bayesian_ridge(spark, sf):
    return _evidence_values(spark, linear.BayesianRidge(tol=0.0, max_iter=12).fit(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice"))


@query(_evidence(True))
def ard_regression(spark, sf):
    return _evidence_values(spark, linear.ARDRegression(tol=0.0, max_iter=12).fit(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice"))


@query(
    "WITH g AS (SELECT l_quantity AS x, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY 1), "
    "a AS (SELECT i.x AS i, j.x AS j, sum(k.s) / sum(k.n) AS mean FROM g i JOIN g j ON i.x <= j.x JOIN g k ON k.x BETWEEN i.x AND j.x GROUP BY ALL), "
    "l AS (SELECT g.x, a.i, min(a.mean) AS low FROM g JOIN a ON a.i <= g.x AND a.j >= g.x GROUP BY ALL) "
    "SELECT x AS l_quantity, round(max(low), 4) AS fitted FROM l GROUP BY x"
)
def isotonic_predict(spark, sf):
    """The largest of the smallest means of runs of x around each value."""
    m = linear.IsotonicRegression(out_of_bounds="clip").fit(df := table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return m.predict(df).groupBy("l_quantity").agg(F.round(F.avg("prediction"), 4).alias("fitted"))


@query(
    "WITH t AS (SELECT s_suppkey AS i, s_suppkey % 97 / 10.0::DOUBLE AS x, s_acctbal AS y FROM supplier), l AS (SELECT (b.y - a.y) / (b.x - a.x) AS s, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS c FROM t a JOIN t b ON a.i < b.i AND a.x <> b.x), "
    "w AS (SELECT s, c FROM l, t GROUP BY s, c ORDER BY sum(abs(y - c - s * x)) LIMIT 1) " + _vector("s", "c", digits=3)
)
def quantile_regressor(spark, sf):
    """The best of all lines through two rows."""
    df = table(spark, sf, "supplier").withColumn("k", F.col("s_suppkey") % 97 / 10.0)
    return _coefficients(spark, linear.QuantileRegressor(alpha=0.0).fit(df, ["k"], "s_acctbal", "s_suppkey"), 3)


_SUPPLIER = "t AS (SELECT s_suppkey, s_nationkey / 10.0::DOUBLE AS x, s_acctbal / 1000.0::DOUBLE AS y FROM supplier)"


def suppliers(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") / 10.0).alias("x"), (F.col("s_acctbal") / 1000.0).alias("y"))


@query(f"WITH {_SUPPLIER} SELECT s_suppkey, round(x * (SELECT sum(x * y) / (sum(x * x) + 1) FROM t), 6) AS prediction FROM t")
def kernel_ridge(spark, sf):
    m = linear.KernelRidge(kernel="linear").fit(df := suppliers(spark, sf), ["x"], "y", "s_suppkey")
    return m.predict(df).select("s_suppkey", F.round("prediction", 6).alias("prediction"))


@query(
    f"WITH {_SUPPLIER}, s AS (SELECT count(*) + 0.1 AS a, sum(x) AS b, sum(x * x) + 0.1 AS d, sum(y) AS e, sum(x * y) AS f FROM t), w AS (SELECT (e * d - b * f) / (a * d - b * b) AS c, (a * f - b * e) / (a * d - b * b) AS s FROM s) "
    "SELECT s_suppkey, round(c + s * x, 5) AS prediction FROM t, w"
)
def gaussian_process_regressor(spark, sf):
    """With the kernel 1 + x z it is a ridge on (1, x)."""
    m = kernels.GaussianProcessRegressor(kernel="dot_product", alpha=0.1).fit(df := suppliers(spark, sf), ["x"], "y", "s_suppkey")
    return m.predict(df).select("s_suppkey", F.round("prediction", 5).alias("prediction"))


# --- decomposition, selection -----------------------------------------------------------------


@query("WITH w AS (SELECT var_pop(l_quantity) AS a, covar_pop(l_quantity, l_extendedprice / 1000) AS b, var_pop(l_extendedprice / 1000) AS d FROM lineitem) " + _vector("a", "b", "b", "d", digits=4))
def factor_analysis(spark, sf):
    """One factor fits the covariance of two features as it is."""
    df = table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000)
    return numbers(spark, decomposition.FactorAnalysis(n_components=1, tol=1e-12, max_iter=20_000).fit(df, ["l_quantity", "price"]).covariance_, 4)


@query(
    f"WITH {OLS2}, u AS (SELECT covar_pop(l_quantity, l_tax) AS h, covar_pop(l_discount, l_tax) AS k FROM lineitem), z AS (SELECT w1 AS p1, w2 AS p2, (h * d - b * k) / (a * d - b * b) AS q1, (a * k - b * h) / (a * d - b * b) AS q2 FROM w, u) "
    + _vector("p1", "p2", "q1", "q2", digits=4).replace("FROM w)", "FROM z)")
)
def cca_2c(spark, sf):
    """With as many components as features the targets' regression on them is the least squares."""
    m = decomposition.CCA(n_components=2).fit(table(spark, sf, "lineitem"), X2, ["l_extendedprice", "l_tax"])
    return numbers(spark, m.coef_, 4)


def _det3(a, b, c):
    """The determinant of a matrix by its three columns."""
    return f"({a[0]} * ({b[1]} * {c[2]} - {c[1]} * {b[2]}) - {b[0]} * ({a[1]} * {c[2]} - {c[1]} * {a[2]}) + {c[0]} * ({a[1]} * {b[2]} - {b[1]} * {a[2]}))"


def _solve3(ridge: str = "0") -> list[str]:
    g = [[f"(g11 + {ridge})", "g12", "g13"], ["g12", f"(g22 + {ridge})", "g23"], ["g13", "g23", f"(g33 + {ridge})"]]
    c = ["c1", "c2", "c3"]
    return [f"{_det3(*[c if k == j else g[k] for k in range(3)])} / {_det3(*g)}" for j in range(3)]


def _pair(i, j):
    """The weight of feature i beside j only."""
    low, high = min(i, j), max(i, j)
    return f"(c{i} * g{j}{j} - g{low}{high} * c{j}) / (g{i}{i} * g{j}{j} - g{low}{high} * g{low}{high})"


@query(
    f"WITH {M3}, f AS (SELECT *, " + ", ".join(f"abs({e}) AS a{k + 1}" for k, e in enumerate(_solve3())) + " FROM m), "
    "o AS (SELECT *, CASE WHEN a1 <= a2 AND a1 <= a3 THEN 1 WHEN a2 <= a3 THEN 2 ELSE 3 END AS gone FROM f), "
    f"p AS (SELECT gone, CASE gone WHEN 1 THEN CASE WHEN abs({_pair(2, 3)}) <= abs({_pair(3, 2)}) THEN 2 ELSE 3 END WHEN 2 THEN CASE WHEN abs({_pair(1, 3)}) <= abs({_pair(3, 1)}) THEN 1 ELSE 3 END "
    f"ELSE CASE WHEN abs({_pair(1, 2)}) <= abs({_pair(2, 1)}) THEN 1 ELSE 2 END END AS second FROM o) "
    "SELECT (k - 1)::INT AS i, (CASE WHEN k = gone THEN 3 WHEN k = second THEN 2 ELSE 1 END)::DOUBLE AS value FROM p, (SELECT unnest([1, 2, 3]) AS k)"
)
def rfe_ranking(spark, sf):
    return numbers(spark, selection.RFE(estimator=linear.LinearRegression(), n_features_to_select=1).fit(table(spark, sf, "lineitem"), LINE[:3], "l_extendedprice").ranking_)


@query(
    f"WITH {M3}, f AS (SELECT [" + ", ".join(f"abs({e})" for e in _solve3("1.0 / n")) + "] AS a FROM m) "
    "SELECT (k - 1)::INT AS i, (a[k] >= list_avg(a))::INT::DOUBLE AS value FROM f, (SELECT unnest([1, 2, 3]) AS k)"
)
def select_from_model(spark, sf):
    return numbers(spark, selection.SelectFromModel(estimator=linear.Ridge()).fit(table(spark, sf, "lineitem"), LINE[:3], "l_extendedprice").get_support())


#: The digamma function at whole numbers is a harmonic number less a constant.
_PSI = "psi AS (SELECT k, -0.57721566490153286 + coalesce(sum(1.0 / (k - 1)) FILTER (k > 1) OVER (ORDER BY k), 0) AS p FROM (SELECT unnest(range(1, 100001)) AS k))"
_CELLS = "c AS (SELECT vec_id AS id, label AS y, u.f, embedding[u.f]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS f) u)"


@query(
    f"WITH {_PSI}, {_CELLS}, n AS (SELECT label AS y, count(*) AS n, least(3, count(*) - 1) AS k FROM embeddings GROUP BY 1 HAVING count(*) > 1), "
    "d AS (SELECT f, id, any_value(x) AS x, any_value(n) AS n, any_value(k) AS k, nextafter(list_sort(list(gap))[any_value(k)], 0) AS d FROM "
    "(SELECT a.f, a.id, a.x, n.n, n.k, abs(a.x - b.x) AS gap FROM c a JOIN n ON n.y = a.y JOIN c b ON b.f = a.f AND b.y = a.y AND b.id <> a.id) GROUP BY f, id), "
    "e AS (SELECT d.f, d.id, any_value(d.n) AS n, any_value(d.k) AS k, greatest(count(*) FILTER (abs(c.x - d.x) <= d.d), 1) AS m FROM d JOIN c ON c.f = d.f GROUP BY d.f, d.id) "
    "SELECT (e.f - 1)::INT AS i, round(greatest(0, any_value(pt.p) + avg(pk.p - pn.p - pm.p)), 6) + 0.0 AS value FROM e JOIN psi pk ON pk.k = e.k JOIN psi pn ON pn.k = e.n JOIN psi pm ON pm.k = e.m "
    "JOIN psi pt ON pt.k = (SELECT sum(n) FROM n) GROUP BY e.f"
)
def mutual_information(spark, sf):
    return numbers(spark, selection.mutual_info_classif(embedded(spark, sf), "embedding", "label")[0])


@query(
    f"WITH {_PSI}, t AS (SELECT s_suppkey AS id, s_nationkey / 10.0::DOUBLE AS x0, s_acctbal / 1000.0::DOUBLE AS x1, s_acctbal * (1 + s_nationkey) AS y FROM supplier), "
    "c AS (SELECT id, y, 0 AS f, x0 AS x FROM t UNION ALL SELECT id, y, 1, x1 FROM t), s AS (SELECT f, stddev_pop(x) AS sx, stddev_pop(y) AS sy, count(*) AS n FROM c GROUP BY f), "
    "g AS (SELECT a.f, a.id, abs(a.x - b.x) / sx AS dx, abs(a.y - b.y) / sy AS dy, a.id = b.id AS own FROM c a JOIN c b ON b.f = a.f JOIN s ON s.f = a.f), "
    "d AS (SELECT f, id, nextafter(list_sort(list(greatest(dx, dy)) FILTER (NOT own))[3], 0) AS d FROM g GROUP BY f, id), "
    "e AS (SELECT g.f, g.id, count(*) FILTER (dx <= d) AS nx, count(*) FILTER (dy <= d) AS ny FROM g JOIN d ON d.f = g.f AND d.id = g.id GROUP BY g.f, g.id) "
    "SELECT e.f::INT AS i, round(greatest(0, any_value(pn.p) + (SELECT p FROM psi WHERE k = 3) - avg(px.p + py.p)), 6) + 0.0 AS value "
    "FROM e JOIN s ON s.f = e.f JOIN psi pn ON pn.k = s.n JOIN psi px ON px.k = e.nx JOIN psi py ON py.k = e.ny GROUP BY e.f"
)
def mutual_information_regression(spark, sf):
    df = table(spark, sf, "supplier").select((F.col("s_nationkey") / 10.0).alias("x0"), (F.col("s_acctbal") / 1000.0).alias("x1"), (F.col("s_acctbal") * (F.col("s_nationkey") + 1)).alias("y"))
    return numbers(spark, selection.mutual_info_regression(df, ["x0", "x1"], "y")[0])


# --- model selection ----------------------------------------------------------------------------

_ALPHAS, _DRAW = [0.1, 10.0, 1000.0, 100000.0], random.Random(1)
#: What the seed draws.
_DRAWN = [_DRAW.choice(_ALPHAS) for _ in range(3)]


@query(
    f"WITH f AS (SELECT fold, o_custkey / 1000.0::DOUBLE AS x, o_totalprice / 1000.0::DOUBLE AS y FROM ({_FOLDS})) "
    + " UNION ALL ".join(f"SELECT {i} AS i, round(avg(r2), 7) AS value FROM {_ridge_scores(a)}" for i, a in enumerate(_DRAWN))
)
def randomized_search_ridge(spark, sf):
    m = selection.RandomizedSearchCV(estimator=linear.Ridge(), param_distributions={"alpha": _ALPHAS}, n_iter=3, random_state=1).fit(_orders_folded(spark, sf), ["x"], "y", fold_col="fold")
    return numbers(spark, m.cv_results_mean_score_, 7)


@query("SELECT (row_number() OVER (ORDER BY a, d) - 1)::INT AS i, a AS alpha, d::INT AS depth FROM (SELECT unnest([0.1::DOUBLE, 1.0, 10.0]) AS a), (SELECT unnest([1, 2]) AS d)")
def parameter_grid(spark, sf):
    rows = [(i, float(p["alpha"]), int(p["depth"])) for i, p in enumerate(selection.ParameterGrid({"alpha": [0.1, 1.0, 10.0], "depth": [1, 2]}))]
    return spark.createDataFrame(rows, "i int, alpha double, depth int")


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, (SELECT round(avg({c}), 4) FROM lineitem))" for i, c in enumerate(X2)) + ") t(i, value)")
def named_step(spark, sf):
    pipe = selection.Pipeline([("scale", preprocessing.StandardScaler()), ("fit", linear.Ridge())]).fit(table(spark, sf, "lineitem"), X2, "l_extendedprice")
    return numbers(spark, pipe.named_step("scale").mean_, 4)


_DECISION = f"(SELECT x - 1 AS d, y FROM {LABELLED})"


def _platt(steps: int = 12) -> str:
    """Newton steps of the sigmoid's two numbers on smoothed targets."""
    out = [
        f"t AS {_DECISION}, n AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y <> 1) AS n0 FROM t)",
        "z AS (SELECT d, CASE WHEN y = 1 THEN (n1 + 1.0) / (n1 + 2.0) ELSE 1.0 / (n0 + 2.0) END AS g FROM t, n), w0 AS (SELECT 0.0::DOUBLE AS a, ln((n0 + 1.0) / (n1 + 1.0)) AS b FROM n)",
    ]
    for k in range(steps):
        out.append(
            f"h{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(d * (g - p)) AS ga, sum(g - p) AS gb, sum(d * d * p * (1 - p)) + 1e-12 AS aa, sum(d * p * (1 - p)) AS ab, sum(p * (1 - p)) + 1e-12 AS bb "
            f"FROM (SELECT d, g, a, b, 1 / (1 + exp(a * d + b)) AS p FROM z, w{k})), w{k + 1} AS (SELECT a - (bb * ga - ab * gb) / (aa * bb - ab * ab) AS a, b - (aa * gb - ab * ga) / (aa * bb - ab * ab) AS b FROM h{k})"
        )
    return f"WITH {', '.join(out)}, w AS (SELECT * FROM w{steps}) "


def _fitted_platt(spark, sf):
    """The decisions are those of a model that is given; few rows have labels."""
    df = labelled(spark, sf).withColumn("d", F.col("x") - 1.0)
    rows = df.select("d", "y").collect()
    return df, selection.platt(np.array([r["d"] for r in rows]), np.array([r["y"] == 1 for r in rows]))


@query(_platt() + _vector("a", "b", digits=5))
def platt_sigmoid_fit(spark, sf):
    return numbers(spark, _fitted_platt(spark, sf)[1], 5)


@query(_platt() + "SELECT y, round(avg(1 / (1 + exp(a * d + b))), 6) AS mean_probability, count(*)::BIGINT AS n FROM t, w GROUP BY y")
def platt_sigmoid_apply(spark, sf):
    df, (a, b) = _fitted_platt(spark, sf)
    return df.withColumn("p", selection.apply_platt(F.col("d"), a, b)).groupBy("y").agg(F.round(F.avg("p"), 6).alias("mean_probability"), F.count(F.lit(1)).alias("n"))


@query("WITH w AS (SELECT sum(l_quantity * l_extendedprice / 1000) / sum(l_quantity * l_quantity) AS s FROM lineitem) " + _vector("s"))
def nelder_mead(spark, sf):
    from millrace.functions import stats

    m = stats.moments(table(spark, sf, "lineitem"), [F.col("l_quantity"), F.col("l_extendedprice") / 1000])
    g = m.raw()
    best = selection.NelderMead().minimize(lambda w: (g[1, 1] - 2 * w[0] * g[0, 1] + w[0] ** 2 * g[0, 0]) / m.n, [1.0])
    return numbers(spark, best, 5)


# --- clustering, embeddings ---------------------------------------------------------------------


@query(
    "WITH RECURSIVE r AS (SELECT s_suppkey AS i, s_acctbal::DOUBLE AS seed, 1e300::DOUBLE AS gap, 0 AS k, 1::BIGINT AS support FROM supplier UNION ALL "
    "SELECT r.i, avg(x.s_acctbal), abs(avg(x.s_acctbal) - any_value(r.seed)), any_value(r.k) + 1, count(*) FROM r JOIN supplier x ON abs(x.s_acctbal - r.seed) <= 3000 WHERE r.gap >= 3 AND r.k < 300 GROUP BY r.i), "
    "e AS (SELECT i, arg_max(seed, k) AS seed, arg_max(support, k) AS support FROM r GROUP BY i), l AS (SELECT list([seed] ORDER BY support DESC, seed) AS seeds FROM e), "
    "c AS (SELECT list_reduce(seeds, lambda a, b: CASE WHEN list_min(list_transform(a, lambda z: abs(z - b[1]))) > 3000 THEN list_concat(a, b) ELSE a END) AS c FROM l), "
    "n AS (SELECT s_suppkey, list_position(list_transform(c, lambda z: abs(z - s_acctbal)), list_min(list_transform(c, lambda z: abs(z - s_acctbal)))) - 1 AS k FROM supplier, c) "
    "SELECT k::INT AS cluster, count(*)::BIGINT AS n FROM n GROUP BY k"
)
def mean_shift(spark, sf):
    m = cluster.MeanShift(bandwidth=3000.0).fit(df := table(spark, sf, "supplier"), ["s_acctbal"], id_col="s_suppkey")
    return m.predict(df).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH g AS (SELECT s_suppkey, s_acctbal, s_acctbal - lag(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) AS gap FROM supplier), c AS (SELECT *, gap IS NOT NULL AND row_number() OVER (ORDER BY gap DESC NULLS LAST) <= 2 AS cut FROM g), "
    "s AS (SELECT *, sum(cut::INT) OVER (ORDER BY s_acctbal, s_suppkey) AS part FROM c), m AS (SELECT *, min(s_suppkey) OVER (PARTITION BY part) AS first FROM s) "
    "SELECT s_suppkey, (dense_rank() OVER (ORDER BY first) - 1)::INT AS cluster FROM m"
)
def agglomerative(spark, sf):
    """Single linkage on a line cuts the two widest gaps."""
    return cluster.AgglomerativeClustering(n_clusters=3, linkage="single").fit_predict(table(spark, sf, "supplier"), ["s_acctbal"], "s_suppkey").select("s_suppkey", "cluster")


@query(
    "WITH t AS (SELECT s_suppkey, s_acctbal / 1000 - (SELECT avg(s_acctbal / 1000) FROM supplier) AS x FROM supplier), s AS (SELECT arg_max(sign(x), abs(x)) AS s FROM t) SELECT s_suppkey, round(x * s, 7) + 0.0 AS e0 FROM t, s"
)
def isomap(spark, sf):
    """On a line the paths are the distances."""
    df = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("a"))
    return manifold.Isomap(n_components=1, n_neighbors=9).fit_transform(df, ["a"], "s_suppkey").select("s_suppkey", (F.round("e0", 7) + 0.0).alias("e0"))


# --- trees: one feature with few values, so that SQL finds every split from its counts ------------------------


def parts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") * 7 % 10 < 4).cast("int").alias("two"), (F.col("p_partkey") % 3).cast("int").alias("three"))


_PARTS = "p AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y, (p_partkey * 7 % 10 < 4)::INT AS two, (p_partkey % 3)::INT AS three FROM part)"


def _tree2(sums: list[str]) -> str:
    """Leaves of a tree of depth two: x, its leaf's number of rows n and means of the targets m0.."""
    cols = ", ".join(f"sum({s}) AS s{j}" for j, s in enumerate(sums))
    out = [f"{_PARTS}, g AS (SELECT x, count(*) AS n, {cols} FROM p GROUP BY x)"]

    def best(name, source):
        run = ", ".join(f"sum(s{j}) OVER w AS a{j}, sum(s{j}) OVER () AS t{j}" for j in range(len(sums)))
        left = " + ".join(f"a{j} * a{j}" for j in range(len(sums)))
        right = " + ".join(f"(t{j} - a{j}) * (t{j} - a{j})" for j in range(len(sums)))
        out.append(
            f"{name} AS (SELECT (x + x2) / 2 AS cut FROM (SELECT x, lead(x) OVER (ORDER BY x) AS x2, sum(n) OVER w AS nl, sum(n) OVER () AS nt, {run} FROM {source} WINDOW w AS (ORDER BY x)) "
            f"WHERE x2 IS NOT NULL ORDER BY ({left})::DOUBLE / nl + ({right})::DOUBLE / (nt - nl) DESC, x LIMIT 1)"
        )

    best("c0", "g")
    best("c1", "(SELECT g.* FROM g, c0 WHERE x <= cut)")
    best("c2", "(SELECT g.* FROM g, c0 WHERE x > cut)")
    leaf = "(x > c0.cut)::INT * 2 + CASE WHEN x <= c0.cut THEN coalesce((x > c1.cut)::INT, 0) ELSE coalesce((x > c2.cut)::INT, 0) END"
    out.append(f"l AS (SELECT g.*, {leaf} AS leaf FROM g, c0 LEFT JOIN c1 ON true LEFT JOIN c2 ON true)")
    out.append("f AS (SELECT x, " + ", ".join(f"sum(s{j}) OVER (PARTITION BY leaf) / sum(n) OVER (PARTITION BY leaf) AS m{j}" for j in range(len(sums))) + " FROM l)")
    return "WITH " + ", ".join(out)


_MEANS = _tree2(["y"]) + " SELECT x, round(m0, 5) AS prediction FROM f"
_VOTES = _tree2([f"(three = {c})::INT" for c in range(3)]) + " SELECT x, (list_position([m0, m1, m2], greatest(m0, m1, m2)) - 1)::INT AS prediction FROM f"


def _by_size(spark, sf, model, label, digits=5):
    p = model.fit(df := parts(spark, sf), ["x"], label).predict(df).select("x", "prediction").distinct()
    return p if digits is None else p.select("x", F.round("prediction", digits).alias("prediction")).distinct()


def _trees(name, sql, model, label, digits=5):
    def f(spark, sf):
        return _by_size(spark, sf, model(), label, digits)

    f.__name__ = name
    query(sql)(f)


_trees("decision_tree_regressor", _MEANS, lambda: trees.DecisionTreeRegressor(max_depth=2), "y")
_trees("decision_tree_classifier", _VOTES, lambda: trees.DecisionTreeClassifier(max_depth=2), "three", None)
# Without drawing rows all trees of a forest are that tree.
_trees("random_forest_regressor", _MEANS, lambda: trees.RandomForestRegressor(n_estimators=3, max_depth=2, bootstrap=False, max_features_mode="all", random_state=1), "y")
_trees("random_forest_classifier", _VOTES, lambda: trees.RandomForestClassifier(n_estimators=3, max_depth=2, bootstrap=False, max_features_mode="all", random_state=1), "three", None)


def _boosted(y: str, classes: bool, newton: bool, least: int, stages: int = 3) -> str:
    """Stumps on gradients, stage by stage: x and the raw score f."""
    first = f"ln(sum({y}) * 1.0 / (count(*) - sum({y})))" if classes else f"avg({y})"
    p = "1 / (1 + exp(-f))" if classes else "f"
    out = [f"{_PARTS}, f0 AS (SELECT x, count(*) AS n, sum({y}) AS s, (SELECT {first} FROM p) AS f FROM p GROUP BY x)"]
    for k in range(stages):
        out.append(f"g{k} AS (SELECT x, n, s, f, n * ({p}) - s AS g, {f'n * ({p}) * (1 - ({p}))' if newton else 'n'} AS h FROM f{k})")
        out.append(
            f"c{k} AS (SELECT x AS cut FROM (SELECT x, sum(g) OVER w AS a, sum(h) OVER w AS b, sum(n) OVER w AS nl, sum(g) OVER () AS gt, sum(h) OVER () AS ht, sum(n) OVER () AS nt FROM g{k} WINDOW w AS (ORDER BY x)) "
            f"WHERE nl >= {least} AND nt - nl >= {least} ORDER BY a * a / b + (gt - a) * (gt - a) / (ht - b) DESC, x LIMIT 1)"
        )
        out.append(f"f{k + 1} AS (SELECT x, n, s, f - 0.1 * sum(g) OVER (PARTITION BY x <= cut) / sum(h) OVER (PARTITION BY x <= cut) AS f FROM g{k}, c{k})")
    return "WITH " + ", ".join(out) + f" SELECT x, round({p}, 6) AS prediction FROM f{stages}"


def _probabilities(name, sql, model):
    def f(spark, sf):
        p = model().fit(df := parts(spark, sf), ["x"], "two").predict_proba(df)
        return p.select("x", F.round(F.col("probability")[1], 6).alias("prediction")).distinct()

    f.__name__ = name
    query(sql)(f)


_trees("gradient_boosting_regressor", _boosted("y", False, False, 1), lambda: trees.GradientBoostingRegressor(n_estimators=3, max_depth=1), "y", 6)
_probabilities("gradient_boosting_classifier", _boosted("two", True, False, 1), lambda: trees.GradientBoostingClassifier(n_estimators=3, max_depth=1))
_trees("hist_gradient_boosting_regressor", _boosted("y", False, True, 20).replace("n * (f) * (1 - (f))", "n"), lambda: trees.HistGradientBoostingRegressor(max_iter=3, max_leaf_nodes=2), "y", 6)
_probabilities("hist_gradient_boosting_classifier", _boosted("two", True, True, 20), lambda: trees.HistGradientBoostingClassifier(max_iter=3, max_leaf_nodes=2))


# --- separated groups and lines without noise: what every estimator of its kind must find -------------------------


_GROUPS = "t AS (SELECT s_suppkey AS id, (s_suppkey % 2)::INT AS y, (s_suppkey % 2 * 2 - 1) * (1 + s_nationkey / 25.0::DOUBLE) AS x, s_acctbal / 10000.0::DOUBLE AS z FROM supplier)"


def groups(spark, sf):
    """Two groups, two apart at least in x, with noise in z."""
    df = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 2).cast("int").alias("y"), F.col("s_nationkey").alias("n"), (F.col("s_acctbal") / 10000.0).alias("z"))
    return df.withColumn("x", (F.col("y") * 2 - 1) * (F.col("n") / 25.0 + 1))


def _separates(name, model):
    def f(spark, sf):
        m = model().fit(df := groups(spark, sf), ["x", "z"], "y", "id")
        return m.predict(df).select("id", F.col("prediction").cast("int").alias("prediction"))

    f.__name__ = name
    query(f"WITH {_GROUPS} SELECT id, y AS prediction FROM t")(f)


_separates("sgd_classifier", lambda: linear.SGDClassifier(max_iter=50))
_separates("perceptron", lambda: linear.Perceptron(max_iter=50))
_separates("linear_svc", lambda: kernels.LinearSVC(max_iter=50, random_state=1))
_separates("mlp_classifier", lambda: kernels.MLPClassifier(hidden_layer_sizes=(16,), max_iter=300, learning_rate_init=0.01, random_state=1))
_separates("gaussian_process_classifier", lambda: kernels.GaussianProcessClassifier(max_iter=20))
_separates("nu_svc", lambda: kernels.NuSVC(nu=0.3))
_separates("calibrated_classifier", lambda: selection.CalibratedClassifierCV(estimator=linear.LogisticRegression(max_iter=20), cv=3))


@query(f"WITH {_GROUPS}, g AS (SELECT max(x) FILTER (y = 0) AS a, min(x) FILTER (y = 1) AS b FROM t) SELECT id, round((2 * x - a - b) / (b - a), 4) AS decision FROM t, g")
def svc(spark, sf):
    """On one feature the widest margin lies between the nearest rows of the classes."""
    m = kernels.SVC(kernel="linear", C=1000.0, tol=1e-9).fit(df := groups(spark, sf), ["x"], "y", "id")
    return m.decision_function(df).select("id", F.round("decision", 4).alias("decision"))


_LINE = f"WITH {_GROUPS} SELECT id, round(2 * x - 3 * z + 1, 2) + 0.0 AS prediction FROM t"


def _on_a_line(name, model):
    def f(spark, sf):
        df = groups(spark, sf).withColumn("y", F.col("x") * 2 - F.col("z") * 3 + 1)
        return model().fit(df, ["x", "z"], "y", "id").predict(df).select("id", (F.round("prediction", 2) + 0.0).alias("prediction"))

    f.__name__ = name
    query(_LINE)(f)


_on_a_line("sgd_regressor", lambda: linear.SGDRegressor(max_iter=3000, alpha=0.0, tol=0.0))
_on_a_line("linear_svr", lambda: kernels.LinearSVR(max_iter=3000, C=1e6, loss="squared_epsilon_insensitive", tol=1e-9, random_state=1))
_on_a_line("svr", lambda: kernels.SVR(kernel="linear", C=1000.0, epsilon=0.0, tol=1e-6))
_on_a_line("nu_svr", lambda: kernels.NuSVR(kernel="linear", C=1000.0, nu=0.5, tol=1e-6))


# Without a hidden layer it is a linear model.
_on_a_line("mlp_regressor", lambda: kernels.MLPRegressor(hidden_layer_sizes=(), max_iter=3000, learning_rate_init=0.02, alpha=0.0, tol=0.0, random_state=1))


_FAR = "t AS (SELECT s_suppkey AS id, s_nationkey + CASE WHEN s_suppkey % 4 = 0 THEN 1000000 ELSE 0 END::DOUBLE AS x FROM supplier)"
_RANGES = f"WITH {_FAR} SELECT min(x) AS low, max(x) AS high, count(*)::BIGINT AS n FROM t GROUP BY x > 500000"


def far_groups(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") + F.when(F.col("s_suppkey") % 4 == 0, 1000000.0).otherwise(0.0)).alias("x"))


def _ranges(df):
    return df.groupBy("cluster").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")).drop("cluster")


@query(_RANGES)
def kmeans(spark, sf):
    return _ranges(cluster.KMeans(n_clusters=2, n_init=2).fit(df := far_groups(spark, sf), ["x"]).predict(df))


@query(f"WITH {_FAR} SELECT (x > 500000)::INT AS i, round(avg(x), 4) AS value FROM t GROUP BY 1")
def mini_batch_kmeans(spark, sf):
    """Batches of all rows: the centres are the groups' means."""
    m = cluster.MiniBatchKMeans(n_clusters=2, max_iter=5, batch_size=1_000_000_000).fit(far_groups(spark, sf), ["x"])
    return numbers(spark, np.sort(m.cluster_centers_[:, 0]), 4)


@query(_RANGES)
def birch(spark, sf):
    return _ranges(cluster.Birch(threshold=3.0, n_clusters=2).fit(df := far_groups(spark, sf), ["x"], id_col="id").predict(df))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 20 = 0 THEN -1 ELSE 1 END AS prediction FROM supplier")
def isolation_forest(spark, sf):
    """A twentieth of the rows lies far off."""
    df = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10000 + F.when(F.col("s_suppkey") % 20 == 0, (F.col("s_suppkey") + 20) * 1000.0).otherwise(0.0)).alias("x"))
    size = min(64, df.limit(64).count())  # small tables have fewer rows than a sample
    return covariance.IsolationForest(n_estimators=50, max_samples=size, contamination=0.05).fit(df, ["x"], "id").predict(df).select("id", "prediction")


@query(
    "WITH t AS (SELECT s_suppkey AS id, 1 + s_suppkey / 7.0::DOUBLE AS x FROM supplier), n AS (SELECT count(*) AS n FROM t), r AS (SELECT *, row_number() OVER (ORDER BY x) AS k FROM t, n), "
    "s AS (SELECT max(x) FILTER (k <= ceil(0.2551 * n)) AS x0 FROM r) SELECT id, CASE WHEN x > x0 THEN 1 ELSE -1 END AS prediction FROM t, s WHERE x <> x0"
)
def one_class_svm(spark, sf):
    """With x z as kernel the rows nearest to zero are outside; the row on the border isn't judged."""
    df = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") / 7.0 + 1).alias("x"))
    p = kernels.OneClassSVM(kernel="linear", nu=0.2551, tol=1e-9).fit(df, ["x"], "id")
    scored = p.decision_function(df)
    return scored.filter(F.abs("decision") > 1e-6).select("id", F.when(F.col("decision") > 0, 1).otherwise(-1).alias("prediction"))


def _keeps_groups(name, model):
    def f(spark, sf):
        df = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 2).cast("int").alias("g"), (F.col("s_nationkey") / 25.0).alias("a"), (F.col("s_acctbal") / 10000.0).alias("b"))
        df = df.withColumn("a", F.col("a") + F.col("g") * 20.0)
        e = model().fit_transform(df, ["a", "b"], "s_suppkey").select("s_suppkey", "g", "e0", "e1")
        e = settled(e)
        cols = [F.col("e0"), F.col("e1")]
        near = pairwise.top_k(pairwise.Index(e, cols, "s_suppkey"), e, cols, "s_suppkey", 1, without_self=True)
        return near.select(F.col("query_id").alias("s_suppkey"), (F.col("id") % 2).cast("int").alias("nearest"))

    f.__name__ = name
    f.__doc__ = "The group of each row's nearest neighbour in the embedding: its own."
    query("SELECT s_suppkey, (s_suppkey % 2)::INT AS nearest FROM supplier")(f)


_keeps_groups("mds", lambda: manifold.MDS(n_init=1, max_iter=100, random_state=1))
_keeps_groups("spectral_embedding", lambda: manifold.SpectralEmbedding(n_neighbors=5))
_keeps_groups("tsne", lambda: manifold.TSNE(perplexity=8.0, n_iter=600, learning_rate=50.0, random_state=1))
_keeps_groups("umap", lambda: manifold.UMAP(n_neighbors=4, n_epochs=100, random_state=1))
_keeps_groups("locally_linear_embedding", lambda: manifold.LocallyLinearEmbedding(n_neighbors=5))
