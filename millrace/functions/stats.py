"""Sufficient statistics: counts, means and scatter matrices in one pass over the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.core import settled

#: Up to this many columns products are summed by column expressions, beyond in blocks per partition.
WIDE = 16


@dataclass
class Moments:
    """Count, means, and the sum of products of deviations from the means."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @property
    def cov(self) -> np.ndarray:
        """Population covariance."""
        return self.scatter / self.n

    def pick(self, at: Sequence[int]) -> Moments:
        return Moments(self.n, self.mean[list(at)], self.scatter[np.ix_(list(at), list(at))])

    def raw(self) -> np.ndarray:
        """Sum of products without centring."""
        return self.scatter + self.n * np.outer(self.mean, self.mean)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        d = other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.scatter + other.scatter + np.outer(d, d) * (self.n * other.n / n))

    def __sub__(self, other: Moments) -> Moments:
        """What is left without some of the rows: training sets of folds."""
        n = self.n - other.n
        mean = (self.n * self.mean - other.n * other.mean) / n
        d = other.mean - mean
        return Moments(n, mean, self.scatter - other.scatter - np.outer(d, d) * (n * other.n / self.n))


def _products(cols: Sequence[Column], shift: Sequence[float]) -> list[Column]:
    at = [c - F.lit(float(s)) for c, s in zip(cols, shift)]
    p = len(cols)
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(at)]
    return [F.count(F.lit(1)).alias("n"), *sums, *[F.sum(at[i] * at[j]).alias(f"p{i}_{j}") for i in range(p) for j in range(i, p)]]


def _moments(row, p: int, shift: np.ndarray) -> Moments:
    n = row["n"]
    s = np.array([row[f"s{i}"] for i in range(p)], float)
    m = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            m[i, j] = m[j, i] = row[f"p{i}_{j}"]
    return Moments(n, shift + s / n, m - np.outer(s, s) / n)


def _shift(df: DataFrame, cols: Sequence[Column]) -> np.ndarray:
    """Any row's values: close enough to the means to avoid cancellation."""
    row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    if row is None:
        raise ValueError("empty input")
    if any(v is None for v in row):
        raise ValueError("NULL in features or label; use an imputer first")
    return np.array(row, float)


def moments(df: DataFrame, cols: Sequence[Column], group: Column | None = None) -> Moments | dict:
    """Moments of all rows, or a dict of them by group.

    Sums are taken of deviations from one row's values.  If that row turns out to be far
    from the means for their spread, a second pass takes deviations from the means.
    """
    shift, p = _shift(df, cols), len(cols)
    if p > WIDE and group is None:
        return _wide(df, cols, shift)
    for last in (False, True):
        sums = _products(cols, shift)
        rows = [df.agg(*sums).first()] if group is None else df.groupBy(group.alias("g")).agg(*sums).collect()
        if any(r[k] is None for r in rows for k in r.asDict() if k[0] in "sp"):
            raise ValueError("NULL in features or label; use an imputer first")
        out = {(None if group is None else r["g"]): _moments(r, p, shift) for r in rows}
        total = next(iter(out.values())) if len(out) == 1 else sum(list(out.values())[1:], next(iter(out.values())))
        far = np.abs(total.mean - shift) > 1e3 * np.sqrt(np.maximum(np.diag(total.cov), 1e-300))
        if last or not (far & (np.abs(total.mean - shift) > 0)).any():
            break
        shift = total.mean
    return out[None] if group is None else dict(sorted(out.items()))


def _wide(df: DataFrame, cols: Sequence[Column], shift: np.ndarray) -> Moments:
    """A block X'X for each partition, summed by place; p * p numbers reach the driver."""
    p = len(cols)

    def block(batches):
        import pyarrow as pa

        n, s, m = 0, np.zeros(p), np.zeros((p, p))
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten(), float).reshape(-1, p) - shift
                n, s, m = n + len(x), s + x.sum(axis=0), m + x.T @ x
        yield pa.RecordBatch.from_pydict({"v": [np.r_[float(n), s, m.ravel()].tolist()]})

    blocks = df.select(F.array(*cols).alias("x")).mapInArrow(block, "v array<double>")
    found = blocks.select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(1 + p + p * p)
    for r in found:
        flat[r["at"]] = r["v"]
    n, s, m = flat[0], flat[1 : p + 1], flat[p + 1 :].reshape(p, p)
    return Moments(int(n), shift + s / n, m - np.outer(s, s) / n)


def sparse_moments(df: DataFrame, n_rows: int, width: int, row: str = "row_id", feature: str = "feature_idx", value: str = "value") -> Moments:
    """Moments of a long-form sparse matrix (absent = 0): products from a self-join on the row."""
    a = df.select(F.col(row).alias("r"), F.col(feature).alias("i"), F.col(value).cast("double").alias("v"))
    sums = np.zeros(width)
    for r in a.groupBy("i").agg(F.sum("v").alias("s")).collect():
        sums[r["i"]] = r["s"]
    b = a.select("r", F.col("i").alias("j"), F.col("v").alias("u"))
    m = np.zeros((width, width))
    for r in a.join(b, "r").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("u")).alias("s")).collect():
        m[r["i"], r["j"]] = r["s"]
    return Moments(n_rows, sums / n_rows, m - np.outer(sums, sums) / n_rows)


def training_rows(df: DataFrame, cols: Sequence[Column], labels: Sequence[Column]) -> DataFrame:
    """(x, y) arrays, checkpointed, for algorithms that go over them many times."""
    rows = df.select(F.array(*cols).alias("x"), F.array(*[c.cast("double") for c in labels]).alias("y"))
    bad = F.exists("x", lambda v: v.isNull()) | F.exists("y", lambda v: v.isNull())
    return settled(rows.withColumn("x", F.when(bad, F.raise_error(F.lit("NULL in features or label; use an imputer first"))).otherwise(F.col("x"))))


def mixed_epochs(rows: DataFrame, state: np.ndarray, epoch: Callable, start: int, stop: int, done: Callable) -> tuple[np.ndarray, float, int]:
    """Stochastic passes over rows that stay in Spark: in each epoch every task goes over its own rows from the
    same state, and the states are averaged by their numbers of rows.

    ``epoch(x, y, state, epoch, seen)`` returns the state after a batch and the batch's loss;
    ``done(old, new, mean loss)`` ends.  The state, the mean loss and the number of epochs come back.
    """
    loss, k = 0.0, start
    for k in range(start, stop):
        now, number = state, k

        def run(batches):
            import pyarrow as pa

            s, n, total = now.copy(), 0, 0.0
            for b in batches:
                if b.num_rows:
                    x = np.asarray(b.column(0).flatten(), float).reshape(b.num_rows, -1)
                    y = np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1)
                    s, more = epoch(x, y, s, number, n)
                    n, total = n + len(x), total + more
            if n:
                yield pa.RecordBatch.from_pydict({"v": [np.r_[float(n), total, n * s].tolist()]})

        flat = np.zeros(2 + len(state))
        for r in rows.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
            flat[r["at"]] = r["v"]
        if not flat[0]:
            raise ValueError("empty input")
        new, loss = flat[2:] / flat[0], float(flat[1] / flat[0])
        finished, state = done(state, new, loss), new
        if finished:
            break
    return state, loss, k + 1


def quantiles(df: DataFrame, cols: Sequence[Column], shares: Sequence[float]) -> np.ndarray:
    """Exact linear-interpolated quantiles, one row a column (nulls don't count).

    Values are counted and ordered in ranges; the values at the few ranks that are asked for
    are looked up in theirs.  No buffer holds all values of a column.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = df.select(F.posexplode(F.array(*cols)).alias("i", "v")).filter("v IS NOT NULL").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    parts = settled(each.repartitionByRange(ranges, "i", "v").withColumn("part", F.spark_partition_id()))
    sums = sorted(tuple(r) for r in parts.groupBy("i", "part").agg(F.sum("n").alias("n")).collect())  # a number for each range and column
    total = np.zeros(len(cols), np.int64)
    firsts = []
    for i, part, n in sums:
        firsts.append((i, part, int(total[i]), int(total[i]) + n))
        total[i] += n
    if not total.all():
        raise ValueError("empty input")
    places = np.outer(total - 1, np.asarray(shares, float))
    ranks = sorted({(i, int(r)) for i in range(len(cols)) for x in places[i] for r in (np.floor(x), np.ceil(x))})
    asked = [(i, part, first, r) for i, part, first, end in firsts for k, r in ranks if k == i and first <= r < end]
    wanted = spark.createDataFrame(asked, "i int, part int, first long, rank long")
    own = Window.partitionBy("i", "part").orderBy("v")
    run = parts.join(F.broadcast(wanted.select("i", "part").distinct()), ["i", "part"], "left_semi").withColumn("end", F.sum("n").over(own))
    at = (F.col("first") + F.col("end") > F.col("rank")) & (F.col("first") + F.col("end") - F.col("n") <= F.col("rank"))
    found = {(r["i"], r["rank"]): r["v"] for r in run.join(F.broadcast(wanted), ["i", "part"]).filter(at).select("i", "rank", "v").collect()}
    low, high = (np.array([[found[i, int(f(x))] for x in places[i]] for i in range(len(cols))], float) for f in (np.floor, np.ceil))
    return low + (high - low) * (places - np.floor(places))
