"""The registered queries of the engine's own operators, and their SQL.

Every query runs over its whole table.  Doubles are rounded to at most ten significant
digits, since the order of sums differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import metrics, pairwise
from millrace.functions.core import shared_folder
from millrace.operators import bayes, cluster, covariance, decomposition, impute, kernels, linear, manifold, neighbors, preprocessing, selection, trees
from millrace.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

LINE = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
X2 = ["l_quantity", "l_discount"]
FLAG = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from millrace.plans import closed_forms  # noqa: F401  (registers its queries)

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


def numbers(spark: SparkSession, values, digits: int = 6, name: str = "value") -> DataFrame:
    """(i, value) of a vector."""
    rows = [(i, float(v)) for i, v in enumerate(np.ravel(values))]
    return spark.createDataFrame(rows, f"i int, {name} double").select("i", (F.round(name, digits) + 0.0).alias(name))


def flagged(spark, sf):
    return table(spark, sf, "lineitem").withColumn("flag", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))


def spread(df: DataFrame, cols, by=None, digits: int = 6) -> DataFrame:
    """Sums of each column and of its square: a digest of all rows."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [(F.round(F.sum(c), digits) + 0.0).alias(f"s_{c}"), (F.round(F.sum(F.col(c) * F.col(c)), min(digits, 6 if digits > 1 else -5)) + 0.0).alias(f"q_{c}")]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def spread_sql(exprs: dict[str, str], source: str, digits: int = 6) -> str:
    inner = ", ".join(f"{e} AS {c}" for c, e in exprs.items())
    outer = ", ".join(f"round(sum({c}), {digits}) + 0.0 AS s_{c}, round(sum({c} * {c}), {min(digits, 6 if digits > 1 else -5)}) + 0.0 AS q_{c}" for c in exprs)
    return f"SELECT count(*)::BIGINT AS n, {outer} FROM (SELECT {inner} FROM {source})"


#: Coefficients of the least squares on two features, from moments.
OLS2 = """
m AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, var_pop(l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b,
  var_pop(l_discount) AS d, covar_pop(l_quantity, l_extendedprice) AS e, covar_pop(l_discount, l_extendedprice) AS f, count(*) AS n FROM lineitem),
w AS (SELECT *, (e * d - b * f) / (a * d - b * b) AS w1, (a * f - b * e) / (a * d - b * b) AS w2 FROM m)"""


# --- scalers, imputers, encoders -------------------------------------------------------------


@query(
    f"WITH {OLS2}, p AS (SELECT l_returnflag, l_extendedprice AS y, my + w1 * (l_quantity - m1) + w2 * (l_discount - m2) AS p FROM lineitem, w) "
    "SELECT l_returnflag, round(avg((y - p) * (y - p)), 2) AS mse, round(avg(p), 4) AS mean_prediction, count(*)::BIGINT AS n FROM p GROUP BY 1"
)
def pipeline_scaled_ols(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("y", F.col("l_extendedprice"))
    pipe = selection.make_pipeline(preprocessing.StandardScaler(), linear.LinearRegression()).fit(df, X2, "y")
    p, gap = pipe.predict(df), F.col("y") - F.col("prediction")
    return p.groupBy("l_returnflag").agg(F.round(F.avg(gap * gap), 2).alias("mse"), F.round(F.avg("prediction"), 4).alias("mean_prediction"), F.count(F.lit(1)).alias("n"))


def _scaled(model, cols=tuple(LINE)):
    def run(spark, sf):
        return spread(model().fit_transform(table(spark, sf, "lineitem"), list(cols)), cols, digits=3)

    return run


def _scaler(name, model, expr, stats):
    f = _scaled(model)
    f.__name__ = name
    fields = ", ".join(s.format(c=c) + f" AS {k}_{c}" for c in LINE for k, s in stats.items())
    query(spread_sql({c: expr.format(c=c) for c in LINE}, f"lineitem, (SELECT {fields} FROM lineitem)", 3))(f)


_scaler("standard_scaler", preprocessing.StandardScaler, "({c} - m_{c}) / s_{c}", {"m": "avg({c})", "s": "stddev_pop({c})"})
_scaler("minmax_scaler", preprocessing.MinMaxScaler, "({c} - a_{c}) / (b_{c} - a_{c})", {"a": "min({c})", "b": "max({c})"})
_scaler("maxabs_scaler", preprocessing.MaxAbsScaler, "{c} / m_{c}", {"m": "max(abs({c}))"})
_scaler("robust_scaler", preprocessing.RobustScaler, "({c} - m_{c}) / (b_{c} - a_{c})", {"a": "quantile_cont({c}, 0.25)", "m": "quantile_cont({c}, 0.5)", "b": "quantile_cont({c}, 0.75)"})


@query(spread_sql({c: c for c in LINE}, "lineitem", 1))
def scaler_inverse_roundtrip(spark, sf):
    s = preprocessing.StandardScaler().fit(df := table(spark, sf, "lineitem"), LINE)
    return spread(s.inverse_transform(s.transform(df)), LINE, digits=1)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, (SELECT round(avg({c}), 4) FROM lineitem), (SELECT round(stddev_pop({c}), 4) FROM lineitem))" for i, c in enumerate(LINE)) + ") t(i, mean, scale)")
def scaler_partial_fit_merge(spark, sf):
    df, s = table(spark, sf, "lineitem"), preprocessing.StandardScaler()
    for (status,) in sorted(df.select("l_linestatus").distinct().collect()):
        s.partial_fit(df.filter(F.col("l_linestatus") == status), LINE)
    return numbers(spark, s.mean_, 4, "mean").join(numbers(spark, s.scale_, 4, "scale"), "i")


def _normalizer(norm, size):
    def f(spark, sf):
        return spread(preprocessing.Normalizer(norm=norm).fit_transform(table(spark, sf, "part"), ["p_size", "p_retailprice"]), ["p_size", "p_retailprice"], digits=5)

    f.__name__ = f"normalizer_{norm}"
    query(spread_sql({c: f"CASE WHEN {size} > 0 THEN {c} / {size} ELSE {c} END" for c in ("p_size", "p_retailprice")}, "part", 5))(f)


_normalizer("l1", "(abs(p_size) + abs(p_retailprice))")
_normalizer("l2", "sqrt(p_size * p_size + p_retailprice * p_retailprice)")
_normalizer("max", "greatest(abs(p_size), abs(p_retailprice))")


@query("SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS code FROM customer")
def label_encoder(spark, sf):
    return preprocessing.LabelEncoder().fit_transform(table(spark, sf, "customer"), "c_mktsegment").select("c_custkey", F.col("c_mktsegment_code").alias("code"))


@query("SELECT p_partkey, 1.0::DOUBLE AS poly_0, p_size::DOUBLE AS poly_1, p_retailprice AS poly_2, (p_size * p_size)::DOUBLE AS poly_3, round(p_size * p_retailprice, 4) AS poly_4, round(p_retailprice * p_retailprice, 2) AS poly_5 FROM part")
def polynomial_features(spark, sf):
    df = preprocessing.PolynomialFeatures().fit_transform(table(spark, sf, "part"), ["p_size", "p_retailprice"])
    return df.select("p_partkey", "poly_0", "poly_1", "poly_2", "poly_3", F.round("poly_4", 4).alias("poly_4"), F.round("poly_5", 2).alias("poly_5"))


def _imputer(strategy, value):
    def f(spark, sf):
        df = table(spark, sf, "lineitem").select(F.nullif("l_linenumber", F.lit(7)).cast("double").alias("x"))
        out = impute.SimpleImputer(strategy=strategy, fill_value=-1.0).fit_transform(df, ["x"])
        return out.groupBy(F.round("x", 6).alias("x")).agg(F.count(F.lit(1)).alias("n"))

    f.__name__ = f"imputer_{strategy}"
    query(f"WITH t AS (SELECT nullif(l_linenumber, 7)::DOUBLE AS x FROM lineitem) SELECT round(coalesce(x, {value}), 6) AS x, count(*)::BIGINT AS n FROM t GROUP BY 1")(f)


_imputer("mean", "(SELECT avg(x) FROM t)")
_imputer("median", "(SELECT median(x) FROM t)")
_imputer("most_frequent", "(SELECT x FROM t WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 1)")
_imputer("constant", "-1.0")


@query("SELECT (l_linenumber = 7)::INT::DOUBLE AS missing_x, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def missing_indicator(spark, sf):
    df = table(spark, sf, "lineitem").select(F.nullif("l_linenumber", F.lit(7)).cast("double").alias("x"), F.col("l_quantity").alias("q"))
    return impute.MissingIndicator().fit_transform(df, ["x", "q"]).groupBy("missing_x").agg(F.count(F.lit(1)).alias("n"))


# --- linear models --------------------------------------------------------------------------


def _coefficients(spark, m, digits=5):
    return numbers(spark, np.r_[np.ravel(m.coef_), np.ravel(m.intercept_)], digits)


def _vector(*exprs, digits=5):
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, (SELECT round({e}, {digits}) + 0.0 FROM w))" for i, e in enumerate(exprs)) + ") t(i, value)"


@query("WITH w AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem) " + _vector("s", "b"))
def linear_regression_1f(spark, sf):
    return _coefficients(spark, linear.LinearRegression().fit(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice"))


@query(f"WITH {OLS2} " + _vector("w1", "w2", "my - w1 * m1 - w2 * m2", digits=4))
def linear_regression_2f(spark, sf):
    return _coefficients(spark, linear.LinearRegression().fit(table(spark, sf, "lineitem"), X2, "l_extendedprice"), 4)


@query(f"WITH {OLS2.replace('w AS (SELECT *,', 'v AS (SELECT * REPLACE (a + 1.0 / n AS a, d + 1.0 / n AS d) FROM m), w AS (SELECT *,').replace('AS w2 FROM m)', 'AS w2 FROM v)')} " + _vector("w1", "w2", "my - w1 * m1 - w2 * m2", digits=4))
def ridge_2f(spark, sf):
    return _coefficients(spark, linear.Ridge().fit(table(spark, sf, "lineitem"), X2, "l_extendedprice"), 4)


@query(
    "WITH w AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s1, regr_intercept(l_extendedprice, l_quantity) AS b1, regr_slope(l_tax, l_quantity) AS s2, regr_intercept(l_tax, l_quantity) AS b2 FROM lineitem) "
    + _vector("s1", "s2", "b1", "b2")
)
def multi_target_ols(spark, sf):
    return _coefficients(spark, linear.LinearRegression().fit_multi(table(spark, sf, "lineitem"), ["l_quantity"], ["l_extendedprice", "l_tax"]))


def _soft(l1, l2):
    return (
        f"WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) AS v, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem), "
        f"w AS (SELECT *, sign(c) * greatest(abs(c) - {l1}, 0) / (v + {l2}) AS s FROM m) " + _vector("s", "my - s * mx")
    )


@query(_soft(1000.0, 0.0))
def lasso_1f(spark, sf):
    return _coefficients(spark, linear.Lasso(alpha=1000.0, tol=1e-12).fit(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice"))


@query(_soft(500.0, 500.0))
def elastic_net_1f(spark, sf):
    return _coefficients(spark, linear.ElasticNet(alpha=1000.0, tol=1e-12).fit(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice"))


LABELLED = "(SELECT n_chars / 1000.0::DOUBLE AS x, quality AS y FROM documents JOIN labels USING (doc_id))"


def labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", (F.col("n_chars") / 1000.0).alias("x"), F.col("quality").alias("y"), "toxic")


def _newton(steps):
    out, w = [f"t AS {LABELLED}", "w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"], 0
    for w in range(steps):
        out.append(
            f"w{w + 1} AS (SELECT any_value(a) - (avg((s - y) * x) + any_value(a)) / greatest(avg(s * (1 - s) * x * x) + 1, 1e-12) AS a, "
            f"any_value(b) - avg(s - y) / greatest(avg(s * (1 - s)), 1e-12) AS b FROM (SELECT x, y, a, b, 1 / (1 + exp(-(a * x + b))) AS s FROM t, w{w}))"
        )
    return f"WITH {', '.join(out)}, w AS (SELECT * FROM w{steps}) " + _vector("a", "b")


@query(_newton(3))
def logistic_fixed_iters(spark, sf):
    return _coefficients(spark, linear.LogisticRegression(max_iter=3, tol=0.0).fit(labelled(spark, sf), ["x"], "y"))


@query(
    f"WITH t AS (SELECT l_quantity AS x, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE -1.0 END::DOUBLE AS y FROM lineitem), w AS (SELECT covar_pop(x, y) / (var_pop(x) + 1.0 / count(*)) AS s, avg(x) AS mx, avg(y) AS my FROM t) "
    + _vector("s", "my - s * mx", digits=8)
)
def ridge_classifier(spark, sf):
    return _coefficients(spark, linear.RidgeClassifier().fit(table(spark, sf, "lineitem").withColumn("y", (F.col("l_linestatus") == "O").cast("int")), ["l_quantity"], "y"), 8)


# --- discriminants, naive Bayes, covariance ------------------------------------------------------


@query(
    f"""WITH t AS (SELECT {FLAG} AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem),
c AS (SELECT y, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) * count(*) AS a, covar_pop(x1, x2) * count(*) AS b, var_pop(x2) * count(*) AS d FROM t GROUP BY y),
s AS (SELECT sum(a) / (sum(n) - 3) + 1e-9 AS a, sum(b) / (sum(n) - 3) AS b, sum(d) / (sum(n) - 3) + 1e-9 AS d, sum(n) AS n FROM c),
w AS (SELECT y, (s.d * m1 - s.b * m2) / (s.a * s.d - s.b * s.b) AS w1, (s.a * m2 - s.b * m1) / (s.a * s.d - s.b * s.b) AS w2, m1, m2, c.n * 1.0 / s.n AS prior FROM c, s)
SELECT y AS class, round(w1, 7) AS w1, round(w2, 5) AS w2, round(-0.5 * (w1 * m1 + w2 * m2) + ln(prior), 6) AS b FROM w"""
)
def lda_2f(spark, sf):
    m = bayes.LinearDiscriminantAnalysis().fit(flagged(spark, sf), X2, "flag")
    rows = [(int(c), float(w[0]), float(w[1]), float(b)) for c, w, b in zip(m.classes_, m.coef_, m.intercept_)]
    return spark.createDataFrame(rows, "class int, w1 double, w2 double, b double").select("class", F.round("w1", 7).alias("w1"), F.round("w2", 5).alias("w2"), F.round("b", 6).alias("b"))


@query(
    f"""WITH t AS (SELECT {FLAG} AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem),
c AS (SELECT y, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_samp(x1) AS a, covar_samp(x1, x2) AS b, var_samp(x2) AS d FROM t GROUP BY y),
s AS (SELECT t.y, c.y AS k, -0.5 * ((x1 - m1) * (x1 - m1) * d - 2 * (x1 - m1) * (x2 - m2) * b + (x2 - m2) * (x2 - m2) * a) / (a * d - b * b) - 0.5 * ln(a * d - b * b) + ln(n * 1.0 / (SELECT count(*) FROM t)) AS score FROM t, c)
SELECT k AS class, round(avg(score), 6) AS mean_score, count(*)::BIGINT AS n FROM s GROUP BY k"""
)
def qda_2f(spark, sf):
    scored = bayes.QuadraticDiscriminantAnalysis().fit(df := flagged(spark, sf), X2, "flag").decision_function(df)
    each = scored.select(F.posexplode("scores").alias("class", "score"))
    return each.groupBy("class").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH t AS (SELECT {FLAG} AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem), e AS (SELECT 1e-9 * greatest(var_pop(x1), var_pop(x2)) AS e FROM t)
SELECT y AS class, round(avg(x1), 7) AS theta1, round(avg(x2), 9) AS theta2, round(var_pop(x1) + any_value(e), 6) AS var1, round(var_pop(x2) + any_value(e), 10) AS var2, round(count(*) * 1.0 / (SELECT count(*) FROM t), 9) AS prior FROM t, e GROUP BY y"""
)
def gaussian_nb(spark, sf):
    m = bayes.GaussianNB().fit(flagged(spark, sf), X2, "flag")
    rows = [(int(c), *map(float, (*t, *v, p))) for c, t, v, p in zip(m.classes_, m.theta_, m.var_, m.class_prior_)]
    out = spark.createDataFrame(rows, "class int, theta1 double, theta2 double, var1 double, var2 double, prior double")
    return out.select("class", *[F.round(c, d).alias(c) for c, d in (("theta1", 7), ("theta2", 9), ("var1", 6), ("var2", 10), ("prior", 9))])


TYPES = "SELECT user_id, user_id % 2 AS y{} FROM events GROUP BY user_id"


def by_user(spark, sf):
    types = [r[0] for r in table(spark, sf, "events").select("event_type").distinct().orderBy("event_type").collect()]
    df = table(spark, sf, "events").groupBy("user_id").pivot("event_type", types).count().na.fill(0)
    return df.select("user_id", (F.col("user_id") % 2).cast("int").alias("y"), *[F.col(t).cast("double").alias(f"x{i}") for i, t in enumerate(types)]), [f"x{i}" for i in range(len(types))]


_USERS = "k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events)), u AS (SELECT DISTINCT user_id, user_id % 2 AS y FROM events), g AS (SELECT u.user_id, u.y, k.i, count(e.event_id) AS x FROM u CROSS JOIN k LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = k.event_type GROUP BY ALL)"


@query(f"WITH {_USERS}, s AS (SELECT y, i, sum(x) AS s FROM g GROUP BY y, i) SELECT y::INT AS class, i::INT AS i, round(ln((s + 1) / (sum(s) OVER (PARTITION BY y) + count(*) OVER (PARTITION BY y))), 9) AS log_prob FROM s")
def multinomial_nb(spark, sf):
    df, x = by_user(spark, sf)
    m = bayes.MultinomialNB().fit(df, x, "y")
    return spark.createDataFrame([(int(c), i, float(v)) for c, row in zip(m.classes_, m.feature_log_prob_) for i, v in enumerate(row)], "class int, i int, v double").select("class", "i", F.round("v", 9).alias("log_prob"))


@query(f"WITH {_USERS} SELECT y::INT AS class, i::INT AS i, round(ln((sum((x > 0)::INT) + 1.0) / (count(*) + 2.0)), 9) AS log_prob FROM g GROUP BY y, i")
def bernoulli_nb(spark, sf):
    df, x = by_user(spark, sf)
    m = bayes.BernoulliNB().fit(df, x, "y")
    return spark.createDataFrame([(int(c), i, float(v)) for c, row in zip(m.classes_, m.feature_log_prob_) for i, v in enumerate(row)], "class int, i int, v double").select("class", "i", F.round("v", 9).alias("log_prob"))


_COV = "WITH w AS (SELECT var_pop(l_quantity) AS a, covar_pop(l_quantity, l_tax) AS b, var_pop(l_tax) AS d, count(*) AS n, avg(l_quantity) AS m1, avg(l_tax) AS m2 FROM lineitem)"
_QT = ["l_quantity", "l_tax"]


@query(f"{_COV} " + _vector("a", "b", "b", "d", digits=8))
def empirical_covariance(spark, sf):
    return numbers(spark, covariance.EmpiricalCovariance().fit(table(spark, sf, "lineitem"), _QT).covariance_, 8)


@query(
    f"{_COV.replace('WITH w AS', 'WITH m AS')}, f AS (SELECT sum(pow((l_quantity - m1) * (l_quantity - m1) + (l_tax - m2) * (l_tax - m2), 2)) AS q FROM lineitem, m), "
    "s AS (SELECT *, (a + d) / 2 AS mu FROM m, f), t AS (SELECT *, (pow(a - mu, 2) + 2 * b * b + pow(d - mu, 2)) / 2 AS delta, (q / n - (a * a + 2 * b * b + d * d)) / (n * 2) AS beta FROM s), "
    "w AS (SELECT *, least(greatest(beta / delta, 0), 1) AS r FROM t) " + _vector("r", "(1 - r) * a + r * mu", "(1 - r) * b", "(1 - r) * d + r * mu", digits=8)
)
def ledoit_wolf(spark, sf):
    m = covariance.LedoitWolf().fit(table(spark, sf, "lineitem"), _QT)
    return numbers(spark, [m.shrinkage_, *m.covariance_[np.triu_indices(2)]], 8)


@query(
    f"{_COV.replace('WITH w AS', 'WITH m AS')}, s AS (SELECT *, (a + d) / 2 AS mu, (a * a + 2 * b * b + d * d) / 4 AS al FROM m), "
    "w AS (SELECT *, least(greatest((al + mu * mu) / ((n + 1) * (al - mu * mu / 2)), 0), 1) AS r FROM s) " + _vector("r", "(1 - r) * a + r * mu", "(1 - r) * b", "(1 - r) * d + r * mu", digits=8)
)
def oas(spark, sf):
    m = covariance.OAS().fit(table(spark, sf, "lineitem"), _QT)
    return numbers(spark, [m.shrinkage_, *m.covariance_[np.triu_indices(2)]], 8)


@query(
    f"{_COV}, s AS (SELECT -((l_quantity - m1) * (l_quantity - m1) * (d + 1e-9) - 2 * (l_quantity - m1) * (l_tax - m2) * b + (l_tax - m2) * (l_tax - m2) * (a + 1e-9)) / ((a + 1e-9) * (d + 1e-9) - b * b) AS s FROM lineitem, w), "
    "o AS (SELECT s AS t FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r FROM s) WHERE r = (SELECT floor(0.1 * count(*))::BIGINT FROM s)) SELECT round(t, 6) AS cut, round(avg(s), 6) AS mean_score FROM s, o GROUP BY t"
)
def elliptic_envelope(spark, sf):
    m = covariance.EllipticEnvelope().fit(df := table(spark, sf, "lineitem"), _QT)
    return m.score_samples(df).agg(F.round(F.lit(m.offset_), 6).alias("cut"), F.round(F.avg("score"), 6).alias("mean_score"))


# --- decomposition --------------------------------------------------------------------------


_EIG = (
    "e AS (SELECT *, (p + r) / 2 + sqrt((p - r) * (p - r) / 4 + q * q) AS l1, (p + r) / 2 - sqrt((p - r) * (p - r) / 4 + q * q) AS l2 FROM c), "
    "v AS (SELECT *, l1 - r AS x, q AS y FROM e), w AS (SELECT *, x / sqrt(x * x + y * y) * CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END AS u1, y / sqrt(x * x + y * y) * CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END AS u2 FROM v) "
)


@query(f"WITH c AS (SELECT var_samp(l_quantity) AS p, covar_samp(l_quantity, l_tax) AS q, var_samp(l_tax) AS r FROM lineitem), {_EIG}" + _vector("l1", "l2", "u1", "abs(u2)", digits=7))
def pca_2d(spark, sf):
    m = decomposition.PCA().fit(table(spark, sf, "lineitem"), _QT)
    return numbers(spark, [*m.explained_variance_, m.components_[0, 0], abs(m.components_[0, 1])], 7)


@query(f"WITH c AS (SELECT sum(l_discount * l_discount) AS p, sum(l_discount * l_tax) AS q, sum(l_tax * l_tax) AS r FROM lineitem), {_EIG}" + _vector("sqrt(l1)", "sqrt(l2)", "u1", "u2", digits=6))
def truncated_svd_2d(spark, sf):
    m = decomposition.TruncatedSVD().fit(table(spark, sf, "lineitem"), ["l_discount", "l_tax"])
    return numbers(spark, [*m.singular_values_, *m.components_[0]], 6)


@query(
    "WITH m AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_extendedprice) AS b, corr(l_quantity, l_discount) AS c FROM lineitem), "
    "n AS (SELECT *, sqrt(a * a + b * b) AS s FROM m), w AS (SELECT *, a / s AS w1, b / s AS w2 FROM n) " + _vector("w1", "w2", "(w1 * a + w2 * b) / (w1 * w1 + w2 * w2 + 2 * w1 * w2 * c)", digits=7)
)
def pls_1c(spark, sf):
    m = decomposition.PLSRegression(n_components=1).fit(table(spark, sf, "lineitem"), X2, "l_extendedprice")
    return numbers(spark, [*m.x_weights_[:, 0], m.y_loadings_[0, 0]], 7)


# --- feature selection ------------------------------------------------------------------------


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, (SELECT round(var_pop({c}), 4) FROM lineitem), (SELECT var_pop({c}) > 1 FROM lineitem))" for i, c in enumerate(LINE)) + ") t(i, variance, kept)")
def variance_threshold(spark, sf):
    m = selection.VarianceThreshold(threshold=1.0).fit(table(spark, sf, "lineitem"), LINE)
    return numbers(spark, m.variances_, 4, "variance").join(spark.createDataFrame(list(enumerate(m.get_support())), "i int, kept boolean"), "i")


@query(
    "WITH "
    + ", ".join(
        f"g{i} AS (SELECT {FLAG} AS y, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY 1), "
        f"f{i} AS (SELECT (sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / 2 / (sum(n * v) / (sum(n) - 3)) AS f FROM g{i})"
        for i, c in enumerate(LINE[:3])
    )
    + " SELECT * FROM (VALUES "
    + ", ".join(f"({i}, (SELECT round(f, 4) FROM f{i}))" for i in range(3))
    + ") t(i, value)"
)
def select_k_best_f_classif(spark, sf):
    return numbers(spark, selection.SelectKBest(k=2).fit(flagged(spark, sf), LINE[:3], "flag").scores_, 4)


@query(
    "WITH r AS (SELECT "
    + ", ".join(f"corr({c}, l_extendedprice) AS r{i}" for i, c in enumerate(LINE[:3]))
    + ", count(*) AS n FROM lineitem) SELECT * FROM (VALUES "
    + ", ".join(f"({i}, (SELECT round(r{i} * r{i} / (1 - r{i} * r{i}) * (n - 2), 3) FROM r))" for i in range(3))
    + ") t(i, value)"
)
def select_k_best_f_regression(spark, sf):
    return numbers(spark, selection.SelectKBest(score_func=selection.f_regression, k=2).fit(table(spark, sf, "lineitem"), LINE[:3], "l_extendedprice").scores_, 3)


@query(f"WITH {_USERS}, s AS (SELECT y, i, sum(x) AS o FROM g GROUP BY y, i), p AS (SELECT y, count(*) * 1.0 / (SELECT count(*) FROM u) AS p FROM u GROUP BY y), e AS (SELECT i, o, p * sum(o) OVER (PARTITION BY i) AS e FROM s JOIN p USING (y)) SELECT i::INT AS i, round(sum((o - e) * (o - e) / e), 7) AS value FROM e GROUP BY i")
def select_k_best_chi2(spark, sf):
    df, x = by_user(spark, sf)
    return numbers(spark, selection.SelectKBest(score_func=selection.chi2, k=2).fit(df, x, "y").scores_, 7)


# --- neighbours, clustering ---------------------------------------------------------------------


def embedded(spark, sf):
    return table(spark, sf, "embeddings")


_D2 = "list_sum(list_transform(range(1, 65), lambda i: pow(q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE, 2)))"
_NEAR = f"WITH d AS (SELECT q.vec_id AS query_id, t.vec_id AS id, t.label, {_D2} AS d2 FROM embeddings q, embeddings t), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 9), id) AS rank FROM d QUALIFY rank <= 5)"


@query(f"{_NEAR} SELECT query_id, id, rank::INT AS rank, round(sqrt(d2), 6) AS distance FROM k")
def knn_indices(spark, sf):
    m = neighbors.NearestNeighbors().fit(e := embedded(spark, sf), "embedding", id_col="vec_id")
    return m.kneighbors(e).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


@query(f"{_NEAR}, v AS (SELECT query_id, label, count(*) AS n FROM k GROUP BY ALL) SELECT query_id AS vec_id, label::INT AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1")
def knn_classify(spark, sf):
    m = neighbors.KNeighborsClassifier().fit(e := embedded(spark, sf), "embedding", "label", "vec_id")
    return m.predict(e).select("vec_id", "prediction")


@query(f"{_NEAR} SELECT query_id AS vec_id, round(avg(label), 6) AS prediction FROM k GROUP BY 1")
def knn_regress(spark, sf):
    m = neighbors.KNeighborsRegressor().fit(e := embedded(spark, sf), "embedding", "label", "vec_id")
    return m.predict(e).select("vec_id", F.round("prediction", 6).alias("prediction"))


@query(f"WITH d AS (SELECT q.vec_id AS query_id, t.label FROM embeddings q, embeddings t WHERE {_D2} <= 1.21), v AS (SELECT query_id, label, count(*) AS n FROM d GROUP BY ALL) SELECT query_id AS vec_id, label::INT AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1")
def radius_classify(spark, sf):
    m = neighbors.RadiusNeighborsClassifier(radius=1.1).fit(e := embedded(spark, sf), "embedding", "label", "vec_id")
    return m.predict(e).select("vec_id", "prediction")


@query(f"SELECT q.vec_id, round(avg(t.label), 6) AS prediction FROM embeddings q, embeddings t WHERE {_D2} <= 1.21 GROUP BY 1")
def radius_regress(spark, sf):
    m = neighbors.RadiusNeighborsRegressor(radius=1.1).fit(e := embedded(spark, sf), "embedding", "label", "vec_id")
    return m.predict(e).select("vec_id", F.round("prediction", 6).alias("prediction"))


@query(
    f"WITH d AS (SELECT q.vec_id AS a, t.vec_id AS b, sqrt({_D2}) AS d FROM embeddings q, embeddings t WHERE q.vec_id <> t.vec_id), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 20), "
    "r AS (SELECT a AS b, max(d) AS kd FROM k GROUP BY a), l AS (SELECT a, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM k JOIN r USING (b) GROUP BY a) "
    "SELECT k.a AS vec_id, round(-avg(o.lrd) / any_value(l.lrd), 6) AS negative_outlier_factor FROM k JOIN l ON l.a = k.a JOIN l o ON o.a = k.b GROUP BY k.a"
)
def local_outlier_factor(spark, sf):
    m = neighbors.LocalOutlierFactor().fit(embedded(spark, sf), "embedding", id_col="vec_id")
    return m.factors_.select("vec_id", F.round("negative_outlier_factor", 6).alias("negative_outlier_factor"))


_ROUND = "SELECT q.vec_id AS a, t.vec_id AS b, round({}, 6) AS value FROM embeddings q, embeddings t WHERE q.vec_id % 50 = 0"


@query(_ROUND.format(f"sqrt({_D2})"))
def euclidean_distances(spark, sf):
    """A stated query set (every fiftieth id) against all rows."""
    e = embedded(spark, sf)
    cols = [F.get("embedding", i).cast("double") for i in range(64)]
    d = pairwise.within(pairwise.Index(e, cols, "vec_id"), e.filter("vec_id % 50 = 0"), cols, "vec_id", float("inf"))
    return d.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round("distance", 6).alias("value"))


@query(_ROUND.format("list_cosine_similarity(list_transform(q.embedding, lambda v: v::DOUBLE), list_transform(t.embedding, lambda v: v::DOUBLE))"))
def cosine_similarity(spark, sf):
    e = embedded(spark, sf)
    cols = [F.get("embedding", i).cast("double") for i in range(64)]
    d = pairwise.cosine(pairwise.Index(e, cols, "vec_id"), e.filter("vec_id % 50 = 0"), cols, "vec_id")
    return d.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round("similarity", 6).alias("value"))


def _lloyd(steps):
    d = "pow(p_size - c{k}x, 2) + pow((p_retailprice - c{k}y) / 100, 2)"
    out = ["c0 AS (SELECT 10.0::DOUBLE AS c0x, 1000.0::DOUBLE AS c0y, 25.0::DOUBLE AS c1x, 1200.0::DOUBLE AS c1y, 40.0::DOUBLE AS c2x, 1500.0::DOUBLE AS c2y)"]
    pick = f"CASE WHEN {d.format(k='0')} <= least({d.format(k='1')}, {d.format(k='2')}) THEN 0 WHEN {d.format(k='1')} <= {d.format(k='2')} THEN 1 ELSE 2 END"
    for s in range(steps):
        out.append(f"a{s} AS (SELECT p_size AS x, p_retailprice AS y, {pick} AS k FROM part, c{s})")
        out.append(f"c{s + 1} AS (SELECT " + ", ".join(f"avg(x) FILTER (k = {k}) AS c{k}x, avg(y) FILTER (k = {k}) AS c{k}y" for k in range(3)) + f" FROM a{s})")
    return f"WITH {', '.join(out)}, w AS (SELECT * FROM c{steps}) " + _vector("c0x", "c0y / 100", "c1x", "c1y / 100", "c2x", "c2y / 100", digits=6)


@query(_lloyd(4))
def kmeans_fixed_init(spark, sf):
    df = table(spark, sf, "part").withColumn("price", F.col("p_retailprice") / 100)
    m = cluster.KMeans(n_clusters=3, max_iter=4, init=[[10, 10], [25, 12], [40, 15]])
    # With a limit of four steps and no convergence the centres are those of the last update.
    return numbers(spark, m.fit(df, ["p_size", "price"]).cluster_centers_, 6)


@query(
    f"WITH RECURSIVE d AS (SELECT q.vec_id AS a, t.vec_id AS b FROM embeddings q, embeddings t WHERE {_D2} <= 1.0), core AS (SELECT a FROM d GROUP BY a HAVING count(*) >= 5), "
    "e AS (SELECT a, b FROM d WHERE a IN (FROM core) AND b IN (FROM core)), r(a, root) AS (SELECT a, a FROM core UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a WHERE r.root < e.b), "
    "c AS (SELECT a, min(root) AS root FROM r GROUP BY a), n AS (SELECT a, dense_rank() OVER (ORDER BY root) - 1 AS k FROM c) "
    "SELECT t.vec_id, coalesce((SELECT k FROM n WHERE n.a = t.vec_id), (SELECT min(k) FROM d JOIN n ON n.a = d.b WHERE d.a = t.vec_id), -1)::INT AS cluster FROM embeddings t"
)
def dbscan(spark, sf):
    return cluster.DBSCAN(eps=1.0).fit_predict(embedded(spark, sf), "embedding", "vec_id").select("vec_id", "cluster")


# --- metrics ------------------------------------------------------------------------------------


_PRED = "(SELECT l_extendedprice AS y, 1500.0 * l_quantity AS p FROM lineitem)"


@query(f"SELECT round(avg((y - p) * (y - p)), 2) AS mse, round(sqrt(avg((y - p) * (y - p))), 5) AS rmse, round(avg(abs(y - p)), 5) AS mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 8) AS r2 FROM {_PRED}")
def regression_metrics(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    values = [float(f(df, "y", "p")) for f in (metrics.mean_squared_error, metrics.root_mean_squared_error, metrics.mean_absolute_error, metrics.r2_score)]
    return spark.createDataFrame([tuple(values)], "a double, b double, c double, d double").select(F.round("a", 2).alias("mse"), F.round("b", 5).alias("rmse"), F.round("c", 5).alias("mae"), F.round("d", 8).alias("r2"))


_SAID = "(SELECT quality AS y, (n_chars > 1000)::INT AS p FROM documents JOIN labels USING (doc_id))"


def said(spark, sf):
    return labelled(spark, sf).withColumn("p", (F.col("x") > 1.0).cast("int"))


@query(f"SELECT y AS actual, p AS predicted, count(*)::BIGINT AS n FROM {_SAID} GROUP BY ALL")
def confusion_matrix(spark, sf):
    return metrics.confusion_counts(said(spark, sf), "y", "p")


@query(
    f"WITH t AS {_SAID}, pr AS (SELECT avg(v) AS v FROM (SELECT avg((y = p)::INT) AS v FROM t GROUP BY p)), re AS (SELECT avg(v) AS v FROM (SELECT avg((y = p)::INT) AS v FROM t GROUP BY y)) "
    "SELECT round((SELECT avg((y = p)::INT) FROM t), 9) AS accuracy, round(pr.v, 9) AS precision, round(re.v, 9) AS recall, round(2 * pr.v * re.v / (pr.v + re.v), 9) AS f1 FROM pr, re"
)
def classification_metrics(spark, sf):
    df = said(spark, sf)
    values = [float(f(df, "y", "p")) for f in (metrics.accuracy_score, metrics.precision_score, metrics.recall_score, metrics.f1_score)]
    return spark.createDataFrame([tuple(values)], "a double, b double, c double, d double").select(*[F.round(c, 9).alias(n) for c, n in zip("abcd", ("accuracy", "precision", "recall", "f1"))])


# --- model selection --------------------------------------------------------------------------


_HASH = "(o_orderkey * 7919 + 42) % 1000"


def _order():
    return [(F.col("o_orderkey") * 7919 + 42) % 1000, F.col("o_orderkey")]


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_HASH}, o_orderkey) <= (SELECT count(*) - floor(count(*) * 0.25 + 0.5) FROM orders) AS train FROM orders")
def train_test_split(spark, sf):
    a, b = selection.train_test_split(table(spark, sf, "orders"), "o_orderkey", order=_order())
    return a.select("o_orderkey", F.lit(True).alias("train")).union(b.select("o_orderkey", F.lit(False)))


_FOLDS = f"SELECT *, (SELECT max(f) FROM range(5) t(f) WHERE r >= floor(n * f / 5))::INT AS fold FROM (SELECT *, row_number() OVER (ORDER BY {_HASH}, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)"


@query(f"SELECT o_orderkey, fold FROM ({_FOLDS})")
def kfold_assignment(spark, sf):
    return selection.with_folds(table(spark, sf, "orders"), "o_orderkey", order=_order()).select("o_orderkey", "fold")


def _orders_folded(spark, sf):
    df = selection.with_folds(table(spark, sf, "orders"), "o_orderkey", order=_order())
    return df.withColumn("x", F.col("o_custkey") / 1000.0).withColumn("y", F.col("o_totalprice") / 1000.0)


def _ridge_scores(alpha):
    return f"""(SELECT h.fold, 1 - sum(pow(h.y - (my + s * (h.x - mx)), 2)) / (var_pop(h.y) * count(*)) AS r2 FROM f h JOIN (
  SELECT k.fold, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + {alpha}) AS s FROM f, (SELECT DISTINCT fold FROM f) k WHERE f.fold <> k.fold GROUP BY k.fold) m ON m.fold = h.fold GROUP BY h.fold)"""


@query(f"WITH f AS (SELECT fold, o_custkey / 1000.0::DOUBLE AS x, o_totalprice / 1000.0::DOUBLE AS y FROM ({_FOLDS})) SELECT fold AS i, round(r2, 7) AS value FROM {_ridge_scores(1.0)}")
def cv_ridge_scores(spark, sf):
    return numbers(spark, selection.cross_val_score(linear.Ridge(), _orders_folded(spark, sf), ["x"], "y", fold_col="fold"), 7)


@query(
    f"WITH f AS (SELECT fold, o_custkey / 1000.0::DOUBLE AS x, o_totalprice / 1000.0::DOUBLE AS y FROM ({_FOLDS})) "
    + " UNION ALL ".join(f"SELECT {i} AS i, round(avg(r2), 7) AS value FROM {_ridge_scores(a)}" for i, a in enumerate((0.1, 10.0, 100000.0)))
)
def grid_search_ridge(spark, sf):
    m = selection.GridSearchCV(estimator=linear.Ridge(), param_grid={"alpha": [0.1, 10.0, 100000.0]}).fit(_orders_folded(spark, sf), ["x"], "y", fold_col="fold")
    return numbers(spark, m.cv_results_mean_score_, 7)


# --- trees, kernels, embeddings -------------------------------------------------------------------


@query(
    f"WITH t AS (SELECT l_quantity AS v, {FLAG} AS y FROM lineitem), g AS (SELECT v, count(*) AS n, count(*) FILTER (y = 0) AS a, count(*) FILTER (y = 1) AS b, count(*) FILTER (y = 2) AS c FROM t GROUP BY v), "
    "r AS (SELECT v, lead(v) OVER w AS v2, sum(n) OVER w AS nl, sum(a) OVER w AS al, sum(b) OVER w AS bl, sum(c) OVER w AS cl, sum(n) OVER () AS n, sum(a) OVER () AS a, sum(b) OVER () AS b, sum(c) OVER () AS c FROM g WINDOW w AS (ORDER BY v)), "
    "s AS (SELECT (v + v2) / 2 AS threshold, (al * al + bl * bl + cl * cl) * 1.0 / nl + (pow(a - al, 2) + pow(b - bl, 2) + pow(c - cl, 2)) / (n - nl) - (a * a + b * b + c * c) * 1.0 / n AS gain FROM r WHERE v2 IS NOT NULL) "
    "SELECT threshold, round(gain, 5) AS gain FROM s ORDER BY gain DESC, threshold LIMIT 1"
)
def decision_stump(spark, sf):
    m = trees.DecisionTreeClassifier(max_depth=1)
    m.local_rows = 0  # grown by aggregations
    t = m.fit(flagged(spark, sf), ["l_quantity"], "flag").tree_
    return spark.createDataFrame([(float(t.threshold[0]), float(t.gain[0]))], "threshold double, g double").select("threshold", F.round("g", 5).alias("gain"))


# --- streaming ----------------------------------------------------------------------------------


@query("SELECT count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS scale FROM events")
def streaming_scaler(spark, sf):
    import uuid

    from millrace.streaming import incremental

    base = shared_folder(spark)
    fit = incremental.StreamingFit(preprocessing.StandardScaler(), ["value"])
    s = fit.run(incremental.stream_table(spark, sf, "events"), f"{base}/stream-{uuid.uuid4().hex}")
    return spark.createDataFrame([(s.n_samples_seen_, float(s.mean_[0]), float(s.scale_[0]))], "n long, m double, s double").select("n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("scale"))
