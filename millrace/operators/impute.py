"""Imputer and missing indicator: NULL, NaN and an optional sentinel are missing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.functions.core import Transformer, names


def missing(c: Column, sentinel) -> Column:
    gone = c.isNull() | F.isnan(c)
    return gone if sentinel is None or math.isnan(sentinel) else gone | (c == float(sentinel))


class SimpleImputer(Transformer):
    """Mean, median, most frequent (smallest of equals) or a constant for missing values."""

    defaults = {"missing_values": None, "strategy": "mean", "fill_value": 0.0, "add_indicator": False, "keep_empty_features": False}

    def fit(self, df, features, label=None):
        cols = self._start(df, features)
        use = [F.when(~missing(c, self.missing_values), c) for c in cols]
        if self.strategy not in ("mean", "median", "most_frequent", "constant"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(use)]).first()
        if not counts["n"]:
            raise ValueError("empty input")
        self.n_missing_ = [counts["n"] - counts[f"c{i}"] for i in range(self.width)]
        if self.strategy == "most_frequent":
            values = []
            for c in use:
                r = df.select(c.alias("v")).filter("v IS NOT NULL").groupBy("v").count().orderBy(F.desc("count"), "v").limit(1).collect()
                values.append(r[0]["v"] if r else None)
        elif self.strategy == "constant":
            values = [float(self.fill_value)] * self.width
        elif self.strategy == "median":
            full = [i for i in range(self.width) if counts[f"c{i}"]]
            found = stats.quantiles(df, [use[i] for i in full], (0.5,))[:, 0] if full else []
            values = [None] * self.width
            for i, v in zip(full, found):
                values[i] = float(v)
        else:
            r = df.agg(*[F.avg(c).alias(f"v{i}") for i, c in enumerate(use)]).first()
            values = [r[f"v{i}"] for i in range(self.width)]
        empty = [counts[f"c{i}"] == 0 for i in range(self.width)]
        kept = float(self.fill_value) if self.strategy == "constant" else 0.0
        self.statistics_ = [(kept if self.keep_empty_features else None) if e else v for e, v in zip(empty, values)]
        self.indicator_features_ = [i for i, n in enumerate(self.n_missing_) if n]
        self.fitted = True
        return self

    def transform(self, df, features=None):
        """Missing values filled; columns without any value at ``fit`` are dropped unless kept."""
        cols, use = self._ready(df, features), names(features or self.features, self.width)
        gone = [missing(c, self.missing_values) for c in cols]
        out = df
        if self.add_indicator:
            out = out.withColumns({f"missing_{use[i]}": gone[i].cast("double") for i in self.indicator_features_})
        fill = {u: F.when(g, F.lit(float(v))).otherwise(c) for u, c, g, v in zip(use, cols, gone, self.statistics_) if v is not None}
        return out.withColumns(fill).drop(*[u for u, v in zip(use, self.statistics_) if v is None])


class MissingIndicator(Transformer):
    """1 where a value is missing, for columns with any at ``fit`` or (``features="all"``) for all."""

    defaults = {"missing_values": None, "features": "missing-only", "error_on_new": True}

    def fit(self, df, features, label=None):
        mode = self.params["features"]
        cols = self._start(df, features)
        r = df.agg(*[F.max(missing(c, self.missing_values).cast("int")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        if r[0] is None:
            raise ValueError("empty input")
        self.had_ = [i for i in range(self.width) if r[f"m{i}"]]
        self.features_indices_ = list(range(self.width)) if mode == "all" else self.had_
        self.fitted = True
        return self

    def transform(self, df: DataFrame, features=None) -> DataFrame:
        cols, use = self._ready(df, features), names(features or self.features, self.width)
        gone = [missing(c, self.missing_values) for c in cols]
        out = {f"missing_{use[i]}": gone[i].cast("double") for i in self.features_indices_}
        if self.error_on_new and self.params["features"] != "all":
            for i in set(range(self.width)) - set(self.had_):
                if out:
                    first = next(iter(out))
                    out[first] = F.when(gone[i], F.raise_error(F.lit(f"feature {use[i]} has missing values but had none at fit")).cast("double")).otherwise(out[first])
        return df.withColumns(out)
