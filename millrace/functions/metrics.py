"""Metrics as one aggregation each, and pairwise distances and kernels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(df: DataFrame, c: Column) -> float:
    v = df.agg(c.alias("v")).first()["v"]
    if v is None:
        raise ValueError("empty input")
    return float(v)


def mean_squared_error(df: DataFrame, y: str, p: str) -> float:
    return _one(df, F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))))


def root_mean_squared_error(df: DataFrame, y: str, p: str) -> float:
    return math.sqrt(mean_squared_error(df, y, p))


def mean_absolute_error(df: DataFrame, y: str, p: str) -> float:
    return _one(df, F.avg(F.abs(F.col(y) - F.col(p))))


def r2_score(df: DataFrame, y: str, p: str) -> float:
    """1 - residual / total; 0 where the target doesn't vary, also for a perfect fit."""
    r = df.agg(F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))).alias("res"), (F.var_pop(y) * F.count(y)).alias("tot")).first()
    if r["tot"] is None:
        raise ValueError("empty input")
    return 1 - r["res"] / r["tot"] if r["tot"] else 0.0


def accuracy_score(df: DataFrame, y: str, p: str) -> float:
    return _one(df, F.avg((F.col(y) == F.col(p)).cast("double")))


def confusion_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, y: str, p: str) -> tuple[list, np.ndarray]:
    """Sorted labels of both columns, and counts: rows actual, columns predicted."""
    rows = confusion_counts(df, y, p).collect()
    labels = sorted({r["actual"] for r in rows} | {r["predicted"] for r in rows})
    at = {v: i for i, v in enumerate(labels)}
    m = np.zeros((len(labels), len(labels)), np.int64)
    for r in rows:
        m[at[r["actual"]], at[r["predicted"]]] = r["n"]
    return labels, m


def _macro(df: DataFrame, y: str, p: str) -> tuple[float, float]:
    _, m = confusion_matrix(df, y, p)
    hit, said, real = np.diag(m), m.sum(axis=0), m.sum(axis=1)
    precision = (hit[said > 0] / said[said > 0]).mean() if (said > 0).any() else 0.0
    recall = (hit[real > 0] / real[real > 0]).mean() if (real > 0).any() else 0.0
    return float(precision), float(recall)


def precision_score(df: DataFrame, y: str, p: str) -> float:
    """Mean over the classes that are predicted at all."""
    return _macro(df, y, p)[0]


def recall_score(df: DataFrame, y: str, p: str) -> float:
    """Mean over the classes that occur at all."""
    return _macro(df, y, p)[1]


def f1_score(df: DataFrame, y: str, p: str) -> float:
    """Harmonic mean of macro precision and macro recall."""
    a, b = _macro(df, y, p)
    return 2 * a * b / (a + b) if a + b else 0.0


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Norms are at least the double's epsilon."""
    eps = float(np.finfo(float).eps)
    norm = lambda c: F.greatest(F.sqrt(inner_product(c, c)), F.lit(eps))
    return inner_product(a, b) / (norm(a) * norm(b))


def kernel(name: str, x: np.ndarray, y: np.ndarray, gamma: float = 1.0, degree: int = 3, coef0: float = 0.0) -> np.ndarray:
    """Kernel matrix of the support-vector family: linear, rbf, poly or sigmoid."""
    if name == "rbf":
        d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
        return np.exp(-gamma * np.maximum(d, 0))
    k = x @ y.T
    if name == "linear":
        return k
    if name == "poly":
        return (gamma * k + coef0) ** degree
    if name == "sigmoid":
        return np.tanh(gamma * k + coef0)
    raise ValueError(f"unknown kernel {name!r}")
