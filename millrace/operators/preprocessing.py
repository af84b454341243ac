"""Scalers, normalizer, label encoder and polynomial features: one aggregation to fit, a projection to apply."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.functions.core import Transformer, columns, names

#: A spread below this counts as none, and scales by 1.
TINY = 10 * float(np.finfo(float).eps)


class _Affine(Transformer):
    """(x - offset_) / scale_ for each feature."""

    def _fitted(self, offset, scale) -> _Affine:
        self.offset_, self.scale_, self.fitted = np.asarray(offset, float), np.asarray(scale, float), True
        return self

    def _clip(self, c: Column) -> Column:
        return c

    def transform(self, df: DataFrame, features=None) -> DataFrame:
        cols = self._ready(df, features)
        use = names(features or self.features, self.width)
        out = [self._clip((c - float(o)) / float(s)) for c, o, s in zip(cols, self.offset_, self.scale_)]
        return df.withColumns(dict(zip(use, out)))

    def inverse_transform(self, df: DataFrame, features=None) -> DataFrame:
        features = features or (names(self.features, self.width) if isinstance(self.features, str) else self.features)
        cols = self._ready(df, features)
        return df.withColumns({n: c * float(s) + float(o) for n, c, o, s in zip(features, cols, self.offset_, self.scale_)})


class StandardScaler(_Affine):
    """(x - mean) / population standard deviation."""

    defaults = {"with_mean": True, "with_std": True}

    def _set(self) -> StandardScaler:
        std = np.sqrt(self.var_)
        unit = np.where(std < TINY, 1.0, std)
        self.std_scale_ = unit if self.with_std else np.ones(self.width)
        return self._fitted(self.mean_ if self.with_mean else np.zeros(self.width), self.std_scale_)

    def fit(self, df, features, label=None):
        cols = self._start(df, features)
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(cols):
            aggs += [F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}")]
        r = df.agg(*aggs).first()
        if not r["n"]:
            raise ValueError("empty input")
        self.n_samples_seen_ = r["n"]
        self.mean_, self.var_ = (np.array([r[f"{k}{i}"] for i in range(self.width)], float) for k in "mv")
        return self._set()

    def partial_fit(self, df, features, label=None):
        """Merges a batch's count, means and variances."""
        if not self.fitted:
            return self.fit(df, features)
        seen = stats.Moments(self.n_samples_seen_, self.mean_, np.diag(self.var_ * self.n_samples_seen_))
        own = type(self)(**self.params).fit(df, features)
        if own.width != self.width:
            raise ValueError(f"X has {own.width} features, but the first batch had {self.width}")
        both = seen + stats.Moments(own.n_samples_seen_, own.mean_, np.diag(own.var_ * own.n_samples_seen_))
        self.n_samples_seen_, self.mean_, self.var_ = both.n, both.mean, np.diag(both.scatter) / both.n
        return self._set()


class _Ranged(_Affine):
    """Scalers that need minima and maxima only."""

    def _extremes(self, df, features):
        cols = self._start(df, features)
        r = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("a", F.min), ("b", F.max))]).first()
        if not r["n"]:
            raise ValueError("empty input")
        return r["n"], *(np.array([r[f"{k}{i}"] for i in range(self.width)], float) for k in "ab")


class MinMaxScaler(_Ranged):
    defaults = {"feature_range": (0.0, 1.0), "clip": False}

    def _set(self):
        low, high = self.feature_range
        if low >= high:
            raise ValueError("feature_range must rise")
        span = self.data_max_ - self.data_min_
        self.data_range_ = span
        factor = (high - low) / np.where(span < TINY, 1.0, span)
        self.min_ = low - self.data_min_ * factor
        self.factor_ = factor
        return self._fitted(self.data_min_ - low / factor, 1 / factor)

    def fit(self, df, features, label=None):
        self.n_samples_seen_, self.data_min_, self.data_max_ = self._extremes(df, features)
        return self._set()

    def partial_fit(self, df, features, label=None):
        if not self.fitted:
            return self.fit(df, features)
        n, low, high = self._extremes(df, features)
        self.n_samples_seen_ += n
        self.data_min_, self.data_max_ = np.minimum(self.data_min_, low), np.maximum(self.data_max_, high)
        return self._set()

    def _clip(self, c):
        low, high = self.feature_range
        return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))) if self.clip else c

    def transform(self, df, features=None):
        cols = self._ready(df, features)
        use = names(features or self.features, self.width)
        return df.withColumns({n: self._clip(c * float(f) + float(m)) for n, c, f, m in zip(use, cols, self.factor_, self.min_)})


class MaxAbsScaler(_Ranged):
    defaults = {"clip": False}

    def _set(self):
        return self._fitted(np.zeros(self.width), np.where(self.max_abs_ < TINY, 1.0, self.max_abs_))

    def fit(self, df, features, label=None):
        self.n_samples_seen_, low, high = self._extremes(df, features)
        self.max_abs_ = np.maximum(np.abs(low), np.abs(high))
        return self._set()

    def partial_fit(self, df, features, label=None):
        if not self.fitted:
            return self.fit(df, features)
        n, low, high = self._extremes(df, features)
        self.n_samples_seen_ += n
        self.max_abs_ = np.maximum(self.max_abs_, np.maximum(np.abs(low), np.abs(high)))
        return self._set()

    def _clip(self, c):
        return F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)) if self.clip else c


class RobustScaler(_Affine):
    """(x - median) / (upper - lower quantile), exact with linear interpolation."""

    defaults = {"with_centering": True, "with_scaling": True, "quantile_range": (25.0, 75.0)}

    def fit(self, df, features, label=None):
        cols = self._start(df, features)
        low, high = self.quantile_range
        if not 0 <= low <= high <= 100:
            raise ValueError("quantile_range lies in 0..100 and rises")
        q = stats.quantiles(df, cols, (low / 100, 0.5, high / 100))
        self.center_, spread = q[:, 1], q[:, 2] - q[:, 0]
        unit = np.where(spread < TINY, 1.0, spread)
        return self._fitted(self.center_ if self.with_centering else np.zeros(self.width), unit if self.with_scaling else np.ones(self.width))


class Normalizer(Transformer):
    """Each row divided by its norm (l1, l2 or max); a row of zeros stays."""

    defaults = {"norm": "l2"}

    def fit(self, df, features, label=None):
        self._start(df, features)
        if self.norm not in ("l1", "l2", "max"):
            raise ValueError(f"unknown norm {self.norm!r}")
        self.fitted = True
        return self

    def transform(self, df, features=None):
        features = features or self.features
        if isinstance(features, str):
            x = F.transform(features, lambda v: v.cast("double"))
            size = {
                "l1": F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v)),
                "l2": F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)),
                "max": F.aggregate(x, F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v))),
            }[self.norm]
            return df.withColumn("_norm", size).withColumn(features, F.when(F.col("_norm") > 0, F.transform(x, lambda v: v / F.col("_norm"))).otherwise(x)).drop("_norm")
        cols = self._ready(df, features)
        total = {"l1": sum((F.abs(c) for c in cols), F.lit(0.0)), "l2": F.sqrt(sum((c * c for c in cols), F.lit(0.0))), "max": F.greatest(*[F.abs(c) for c in cols], F.lit(0.0))}[self.norm]
        out = df.withColumn("_norm", total)
        return out.withColumns({n: F.when(F.col("_norm") > 0, c / F.col("_norm")).otherwise(c) for n, c in zip(features, columns(df, features))}).drop("_norm")

    def transform_sparse(self, df: DataFrame, row: str = "row_id", value: str = "value") -> DataFrame:
        """Long form: the norm of a row is that of its stored values."""
        v = F.col(value).cast("double")
        size = {"l1": F.sum(F.abs(v)), "l2": F.sqrt(F.sum(v * v)), "max": F.max(F.abs(v))}[self.norm]
        of = df.groupBy(row).agg(size.alias("_norm"))
        return df.join(of, row).withColumn(value, F.when(F.col("_norm") > 0, v / F.col("_norm")).otherwise(v)).drop("_norm")


class LabelEncoder(Transformer):
    """Sorted distinct labels to 0..k-1.

    Up to ``max_labels`` are in ``classes_``; more stay a table of labels and codes (``table_``), and are joined.
    """

    max_labels = 100_000

    def fit(self, df, features, label=None):
        self.features, self.label = features, label
        column = features if isinstance(features, str) else features[0]
        self.column, self.width, self.fitted = column, 1, True
        labels = df.select(F.col(column).alias("_label")).filter("_label IS NOT NULL").distinct()
        found, self.table_ = [r[0] for r in labels.limit(self.max_labels + 1).collect()], None
        if not found:
            raise ValueError("empty input")
        if len(found) > self.max_labels:
            from millrace.operators.selection import ranked

            self.table_ = ranked(labels, [F.col("_label")], "_code")
            self.__dict__.pop("classes_", None)
        else:
            self.classes_ = sorted(found)
        return self

    def _codes(self) -> Column:
        return F.create_map(*[F.lit(v) for i, c in enumerate(self.classes_) for v in (c, i)])

    def transform(self, df, features=None, out: str | None = None):
        """The code column; any label that wasn't there at ``fit`` raises when the rows are read."""
        if not self.fitted:
            self._ready(df)
        c = F.col(self.column)
        if self.table_ is not None:
            found, code = df.join(self.table_, c == F.col("_label"), "left"), F.col("_code")
        elif len(self.classes_) <= 64:
            code = F.lit(None).cast("int")
            for i, v in enumerate(self.classes_):
                code = F.when(c == F.lit(v), F.lit(i)).otherwise(code)
            found = df
        else:
            spark = df.sparkSession
            known = spark.createDataFrame([(v, i) for i, v in enumerate(self.classes_)], ["_label", "_code"])
            found, code = df.join(F.broadcast(known), c == F.col("_label"), "left"), F.col("_code").cast("int")
        checked = F.when(code.isNull(), F.raise_error(F.lit("label not seen at fit"))).otherwise(code)
        return found.withColumn(out or f"{self.column}_code", checked.cast("int" if self.table_ is None else "long")).drop("_label", "_code")

    def inverse_transform(self, df, features=None, out: str = "label"):
        code = F.col(features or f"{self.column}_code")
        if self.table_ is not None:
            found = df.join(self.table_, code == F.col("_code"), "left")
            return found.withColumn(out, F.when(F.col("_code").isNull(), F.raise_error(F.lit("code out of range"))).otherwise(F.col("_label"))).drop("_label", "_code")
        value = F.get(F.array(*[F.lit(v) for v in self.classes_]), code.cast("int"))
        bad = code.isNull() | (code < 0) | (code >= len(self.classes_))
        return df.withColumn(out, F.when(bad, F.raise_error(F.lit("code out of range"))).otherwise(value))


class PolynomialFeatures(Transformer):
    """All monomials up to a degree, by degree, with powers of early features first."""

    defaults = {"degree": 2, "include_bias": True, "interaction_only": False}

    def fit(self, df, features, label=None):
        self._start(df, features)
        choose = combinations if self.interaction_only else combinations_with_replacement
        self.powers_ = [p for d in range(0 if self.include_bias else 1, self.degree + 1) for p in choose(range(self.width), d)]
        self.n_output_features_, self.fitted = len(self.powers_), True
        return self

    def output_names(self) -> list[str]:
        return [f"poly_{i}" for i in range(self.n_output_features_)]

    def transform(self, df, features=None):
        cols, out = self._ready(df, features), {}
        for name, power in zip(self.output_names(), self.powers_):
            c = F.lit(1.0)
            for i in power:
                c = c * cols[i]
            out[name] = c
        return df.withColumns(out)
