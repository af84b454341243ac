"""Decision trees, forests and gradient boosting.

Small inputs (up to ``local_rows``) are grown in numpy, forests one tree a task.  Larger ones
are grown level by level in Spark.  A single tree takes one aggregation by (node, feature,
value), whose running sums give every exact midpoint split.  Forests and boosting take sums by
(node, feature, bin), for many trees or leaves in one pass over the rows; their thresholds are
quantiles of the features then.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.core import Classifier, Predictor, classes_of, collect_bounded, row_function, settled
from millrace.functions.special import sigmoid, softmax


class Tree:
    """Flat arrays: feature (-1: leaf), threshold (``<=`` goes left), children, values (a row a node), weights, gains."""

    def __init__(self) -> None:
        self.feature, self.threshold, self.left, self.right, self.value, self.n, self.gain = [], [], [], [], [], [], []

    def add(self, value, n) -> int:
        for a, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, np.atleast_1d(value)), (self.n, n), (self.gain, 0.0)):
            a.append(v)
        return len(self.feature) - 1

    def split(self, k, f, t, left, right, gain) -> None:
        self.feature[k], self.threshold[k], self.left[k], self.right[k], self.gain[k] = f, t, left, right, gain

    def arrays(self):
        return np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.right), np.array(self.value, float)

    def importances(self, p: int) -> np.ndarray:
        out = np.zeros(p)
        for f, g in zip(self.feature, self.gain):
            if f >= 0:
                out[f] += g
        return out


def leaves(arrays, x: np.ndarray) -> np.ndarray:
    f, t, left, right, _ = arrays
    at = np.zeros(len(x), int)
    while True:
        inner = f[at] >= 0
        if not inner.any():
            return at
        go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at]
        at = np.where(inner, np.where(go, left[at], right[at]), at)


def values(arrays, x: np.ndarray) -> np.ndarray:
    return arrays[4][leaves(arrays, x)]


def n_features(mode, value, p: int) -> int:
    """Features that a split looks at: all, sqrt, log2, third, a share or a number."""
    n = {"all": p, None: p, 0: p, "sqrt": int(math.sqrt(p)), "log2": int(math.log2(p)) if p > 1 else 1, "third": p // 3}.get(mode)
    if n is None:
        n = int(value * p) if mode == "fraction" else int(value)
    return min(p, max(1, n))


def build(x: np.ndarray, y: np.ndarray, max_depth=None, min_split: int = 2, take: int | None = None, rng=None) -> Tree:
    """CART by sums of squares: with one-hot ``y`` that is the Gini impurity, else the squared error."""
    tree, p = Tree(), x.shape[1]
    take = take or p
    todo = [(tree.add(y.mean(axis=0), len(y)), np.arange(len(y)), 0)]
    while todo:
        k, rows, depth = todo.pop()
        n, own = len(rows), y[rows]
        total = own.sum(axis=0)
        spread = float((own * own).sum() - (total @ total) / n)
        if n < min_split or max_depth is not None and depth >= max_depth or spread <= 1e-12:
            continue
        look = np.arange(p) if take >= p else np.sort(rng.choice(p, take, replace=False))
        best = (1e-12 * max(1.0, spread), None)
        for f in look:
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            v = v[order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cut):
                continue
            a = np.cumsum(own[order], axis=0)[cut - 1]
            b = total - a
            gain = (a * a).sum(axis=1) / cut + (b * b).sum(axis=1) / (n - cut) - (total @ total) / n
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), (int(f), float((v[cut[i] - 1] + v[cut[i]]) / 2)))
        if best[1]:
            f, t = best[1]
            low = x[rows, f] <= t
            a, b = rows[low], rows[~low]
            if not len(a) or not len(b):
                continue
            kids = tree.add(y[a].mean(axis=0), len(a)), tree.add(y[b].mean(axis=0), len(b))
            tree.split(k, f, t, *kids, best[0])
            todo += [(kids[0], a, depth + 1), (kids[1], b, depth + 1)]
    return tree


def build_distributed(rows: DataFrame, p: int, m: int, max_depth=None, min_split: int = 2) -> Tree:
    """The same splits from Spark aggregations; ``rows`` has x0.. and the targets y0.., one-hot for classes."""
    tree = Tree()
    y = [F.col(f"y{j}") for j in range(m)]
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{j}") for j, c in enumerate(y)]]
    r = rows.agg(*sums).first()
    if not r["n"]:
        raise ValueError("empty input")
    root = np.array([r[f"s{j}"] for j in range(m)], float)
    tree.add(root / r["n"], r["n"])
    open_, depth = {0}, 0
    limit = math.inf if max_depth is None else max_depth
    spark = rows.sparkSession
    rows = rows.select(F.array(*[F.col(f"x{i}") for i in range(p)]).alias("x"), *[F.col(f"y{j}") for j in range(m)], F.lit(0).alias("node"))
    while open_ and depth < limit:
        each = rows.select("node", F.posexplode("x").alias("f", "v"), *y)
        by = each.groupBy("node", "f", "v").agg(*sums)
        w = Window.partitionBy("node", "f").orderBy("v")
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy("node", "f")
        cum = by.select("node", "f", "v", F.lead("v").over(w).alias("v2"), F.sum("n").over(run).alias("nl"), F.sum("n").over(whole).alias("n"), *[F.sum(f"s{j}").over(run).alias(f"a{j}") for j in range(m)], *[F.sum(f"s{j}").over(whole).alias(f"t{j}") for j in range(m)]).filter("v2 IS NOT NULL")
        left = sum((F.col(f"a{j}") * F.col(f"a{j}") for j in range(m)), F.lit(0.0)) / F.col("nl")
        right = sum(((F.col(f"t{j}") - F.col(f"a{j}")) * (F.col(f"t{j}") - F.col(f"a{j}")) for j in range(m)), F.lit(0.0)) / (F.col("n") - F.col("nl"))
        base = sum((F.col(f"t{j}") * F.col(f"t{j}") for j in range(m)), F.lit(0.0)) / F.col("n")
        best = cum.withColumn("gain", left + right - base).groupBy("node").agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), (-F.col("v")).alias("v"), "v2", "nl", "n", *[f"a{j}" for j in range(m)], *[f"t{j}" for j in range(m)])).alias("b")).collect()
        depth, splits, grown = depth + 1, [], set()
        for r in best:
            b = r["b"]
            if b["gain"] <= 1e-12 or b["n"] < min_split:
                continue
            f, t = -b["f"], (-b["v"] + b["v2"]) / 2
            a, s = (np.array([b[f"{c}{j}"] for j in range(m)], float) for c in "at")
            kids = tree.add(a / b["nl"], b["nl"]), tree.add((s - a) / (b["n"] - b["nl"]), b["n"] - b["nl"])
            tree.split(r["node"], f, t, *kids, b["gain"])
            splits.append((r["node"], int(f), float(t), *kids))
            grown |= {k for k in kids if tree.n[k] >= min_split}
        if not grown:
            break
        # Rows of nodes that are done fall out; a level's splits are a small table.
        table = F.broadcast(spark.createDataFrame(splits, "node int, f int, t double, a int, b int"))
        moved = rows.join(table, "node").withColumn("node", F.when(F.get("x", F.col("f")) <= F.col("t"), F.col("a")).otherwise(F.col("b"))).drop("f", "t", "a", "b")
        rows, open_ = moved, grown
        if depth % 4 == 0:  # the plan of a deep tree stays short
            rows = settled(rows)
    return tree


class _Tree(Predictor):
    local_rows = 100_000
    defaults = {"max_depth": -1, "min_samples_split": 2, "max_features_mode": "all", "max_features_value": 0.0, "random_state": None}

    def _targets(self, df, label):
        return [F.col(c).cast("double") for c in ([label] if isinstance(label, str) else label)]

    def fit(self, df, features, label, id_col=None):
        cols = self._start(df, features, label if isinstance(label, str) else label[0])
        self._prepare(df, label)
        y = self._targets(df, label)
        rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)], *[c.alias(f"y{j}") for j, c in enumerate(y)])
        depth, p, m = (None if self.max_depth is None or self.max_depth < 0 else self.max_depth), len(cols), len(y)
        take = n_features(self.max_features_mode, self.max_features_value, p)
        if take < p or rows.limit(self.local_rows + 1).count() <= self.local_rows:
            x, t, _ = collect_bounded(rows, [f"x{i}" for i in range(p)], [f"y{j}" for j in range(m)], None, self.local_rows)
            self.tree_ = build(x, t, depth, self.min_samples_split, take, np.random.default_rng(self.random_state))
        else:
            self.tree_ = build_distributed(rows, p, m, depth, self.min_samples_split)
        imp = self.tree_.importances(p)
        self.feature_importances_ = imp / imp.sum() if imp.sum() else imp
        self.fitted = True
        return self

    def _prepare(self, df, label):
        self.n_targets_ = 1 if isinstance(label, str) else len(label)

    def _values(self, df, features):
        a = self.tree_.arrays()
        return row_function(lambda x: values(a, x), self._ready(df, features), "array<double>")


class DecisionTreeRegressor(_Tree):
    """Squared error, mean leaves; several targets share the structure."""

    def fit_multi(self, df, features, labels):
        return self.fit(df, features, list(labels))

    def predict(self, df, features=None, out="prediction"):
        v = self._values(df, features)
        return df.withColumn(out, v if self.n_targets_ > 1 else v[0])

    predict_multi = predict


class _ClassTree(Classifier):
    def _prepare(self, df, label):
        self.classes_ = classes_of(df, label)
        self.n_classes_ = len(self.classes_)

    def _targets(self, df, label):
        return [(F.col(label) == F.lit(c)).cast("double") for c in self.classes_]

    def predict_proba(self, df, features=None, out="probability"):
        return df.withColumn(out, self._values(df, features))

    def predict(self, df, features=None, out="prediction"):
        p = self.predict_proba(df, features, "_p")
        names = F.array(*[F.lit(c) for c in self.classes_])
        return p.withColumn(out, F.get(names, (F.array_position("_p", F.array_max("_p")) - 1).cast("int"))).drop("_p")


class DecisionTreeClassifier(_ClassTree, _Tree):
    """Gini impurity, leaf shares as probabilities."""


_FOREST = {
    "n_estimators": 100, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1, "min_weight_fraction_leaf": 0.0, "max_features_value": None, "max_leaf_nodes": None,
    "min_impurity_decrease": 0.0, "bootstrap": True, "oob_score": False, "n_jobs": 1, "random_state": None, "verbose": 0, "warm_start": False, "ccp_alpha": None, "max_samples": None,
}


#: Bins of a feature in forests that are grown in Spark, and numbers that a task sums at once.
FOREST_BINS, HISTOGRAM_NUMBERS = 64, 4_000_000


def bootstrap_weights(ids: np.ndarray, seed: int, tree: int, rate: float) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample: Poisson numbers by a hash of the row's id."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) & 0xFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = (x ^ (x >> np.uint64(31))).astype(float) / 2.0**64
    terms = np.cumsum([math.exp(-rate) * rate**k / math.factorial(k) for k in range(int(20 + 10 * rate))])
    return np.searchsorted(terms, u, side="right").astype(float)


def grow_forest(data: DataFrame, edges: list[np.ndarray], m: int, n_trees: int, weigh, max_depth, min_split: int, take: int, seed: int) -> list[Tree]:
    """Trees on binned rows (c array<short>, t array<double>, id long), all of a level's nodes in as few passes as their sums fit a task.

    ``weigh(ids, tree)`` gives the rows' weights.  Reach the driver: (m + 1) numbers for each open node, feature and bin.
    """
    p, nb = len(edges), max(len(e) for e in edges) + 1
    forest, rngs = [Tree() for _ in range(n_trees)], [np.random.default_rng([seed, k, 2]) for k in range(n_trees)]
    bins: list[dict[int, int]] = [{} for _ in forest]
    open_, depth = [(k, 0) for k in range(n_trees)], 0
    for tree in forest:
        tree.add(np.zeros(m), 0)
    at_once = max(1, HISTOGRAM_NUMBERS // (p * nb * (m + 1)))

    def sums_of(nodes):
        slots = {k: {} for k, _ in nodes}
        for i, (k, node) in enumerate(nodes):
            slots[k][node] = i
        walks = {k: (np.array(forest[k].feature), np.array([bins[k].get(i, 0) for i in range(len(forest[k].feature))]), np.array(forest[k].left), np.array(forest[k].right), None) for k in slots}

        def sums(batches):
            import pyarrow as pa

            out = np.zeros((p, len(nodes) * nb, m + 1))
            for b in batches:
                codes = np.asarray(b.column(0).flatten()).reshape(-1, p)
                t, ids = np.asarray(b.column(1).flatten(), float).reshape(len(codes), m), b.column(2).to_numpy()
                for k, own in slots.items():
                    slot = np.full(len(walks[k][0]), -1)
                    slot[list(own)] = list(own.values())
                    at, w = slot[leaves(walks[k], codes)], weigh(ids, k)
                    rows = np.flatnonzero((at >= 0) & (w > 0))
                    for j in range(p):
                        key = at[rows] * nb + codes[rows, j]
                        out[j, :, 0] += np.bincount(key, w[rows], len(nodes) * nb)
                        for y in range(m):
                            out[j, :, y + 1] += np.bincount(key, w[rows] * t[rows, y], len(nodes) * nb)
            place = np.flatnonzero(out)
            yield pa.RecordBatch.from_pydict({"i": pa.array(place), "v": pa.array(out.ravel()[place])})

        flat = np.zeros(p * len(nodes) * nb * (m + 1))
        for r in data.mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            flat[r["i"]] = r["v"]
        return flat.reshape(p, len(nodes), nb, m + 1)

    while open_ and (max_depth is None or depth < max_depth or depth == 0):
        grown = []
        for at in range(0, len(open_), at_once):
            nodes = open_[at : at + at_once]
            hist = sums_of(nodes)
            for i, (k, node) in enumerate(nodes):
                tree, own = forest[k], hist[:, i]
                n, total = own[0, :, 0].sum(), own[0, :, 1:].sum(axis=0)
                if not n:
                    continue
                tree.n[node], tree.value[node] = n, total / n
                if n < min_split or max_depth is not None and depth >= max_depth:
                    continue
                look = np.arange(p) if take >= p else np.sort(rngs[k].choice(p, take, replace=False))
                cum = np.cumsum(own[look], axis=1)[:, :-1]
                nl, a = cum[:, :, 0], cum[:, :, 1:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = (a * a).sum(axis=2) / nl + ((total - a) ** 2).sum(axis=2) / (n - nl) - (total @ total) / n
                gain = np.where((nl > 0) & (nl < n), gain, -np.inf)
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if not gain[f, b] > 1e-12 * max(1.0, float(total @ total) / n):
                    continue
                j = int(look[f])
                left, right = a[f, b], total - a[f, b]
                kids = tree.add(left / nl[f, b], nl[f, b]), tree.add(right / (n - nl[f, b]), n - nl[f, b])
                tree.split(node, j, float(edges[j][b]), *kids, float(gain[f, b]))
                bins[k][node] = int(b)
                grown += [(k, x) for x in kids if tree.n[x] >= min_split]
        open_, depth = grown, depth + 1
    return forest


def binned_rows(rows: DataFrame, p: int, m: int, max_bins: int) -> tuple[DataFrame, list[np.ndarray]]:
    """(c, t, id) of rows with x0.., y0.. and _id, and the edges: quantiles of mergeable sketches, at most ``max_bins`` - 1 a feature."""
    shares = [k / max_bins for k in range(1, max_bins)]
    r = rows.agg(*[F.percentile_approx(f"x{i}", F.array(*map(F.lit, shares)), F.lit(QUANTILE_ACCURACY)).alias(f"q{i}") for i in range(p)]).first()
    edges = [np.unique(q) for q in r]

    def binned(batches):
        import pyarrow as pa

        for b in batches:
            x = np.asarray(b.column(0).flatten(), float).reshape(-1, p)
            codes = np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.int16)
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * p)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(codes.ravel())), b.column(1), b.column(2)], names=["c", "t", "id"])

    own = rows.select(F.array(*[F.col(f"x{i}") for i in range(p)]).alias("x"), F.array(*[F.col(f"y{j}") for j in range(m)]).alias("t"), F.xxhash64("_id").alias("id"))
    return settled(own.mapInArrow(binned, "c array<short>, t array<double>, id long")), edges


class _Forest:
    """A tree a task, on bootstrap draws of at most ``local_rows`` rows that go to every task.

    More rows stay in Spark: all trees grow level by level on histograms, each on Poisson weights of its own.
    """

    local_rows = 50_000
    ignored = ("min_samples_leaf", "min_weight_fraction_leaf", "max_leaf_nodes", "min_impurity_decrease", "n_jobs", "verbose", "warm_start", "ccp_alpha")

    def fit(self, df, features, label, id_col=None):
        cols = self._start(df, features, label if isinstance(label, str) else label[0])
        self._prepare(df, label)
        y = self._targets(df, label)
        p, m = len(cols), len(y)
        rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)], *[c.alias(f"y{j}") for j, c in enumerate(y)], *([F.col(id_col).alias("_id")] if id_col else []))
        if rows.limit(self.local_rows + 1).count() > self.local_rows:
            return self._fit_far(rows if id_col else rows.withColumn("_id", F.monotonically_increasing_id()), p, m)
        x, t, _ = collect_bounded(rows, [f"x{i}" for i in range(p)], [f"y{j}" for j in range(m)], "_id" if id_col else None, self.local_rows)
        n = len(x)
        seed = 0 if self.random_state is None else self.random_state
        take, depth, least, boot = n_features(self.max_features_mode, self.max_features_value, p), self.max_depth, self.min_samples_split, self.bootstrap
        draws = n if self.max_samples is None else int(self.max_samples * n) if isinstance(self.max_samples, float) else min(n, self.max_samples)

        def picks(k):
            return np.random.default_rng([seed, k, 1]).integers(0, n, draws) if boot else np.arange(n)

        def grow(batches):
            import pickle

            import pandas as pd

            for b in batches:
                for k in b["id"]:
                    rows = picks(int(k))
                    tree = build(x[rows], t[rows], depth, least, take, np.random.default_rng([seed, int(k), 2]))
                    yield pd.DataFrame({"k": [k], "tree": [pickle.dumps((tree.arrays(), tree.importances(p)))]})

        import pickle

        spark = df.sparkSession
        found = spark.range(0, self.n_estimators, 1, min(self.n_estimators, 64)).mapInPandas(grow, "k long, tree binary").collect()
        got = [pickle.loads(r["tree"]) for r in sorted(found, key=lambda r: r["k"])]
        self.estimators_ = [a for a, _ in got]
        each = [i / i.sum() if i.sum() else i for _, i in got]
        self.feature_importances_ = np.mean(each, axis=0)
        if self.oob_score and boot:
            total, count = np.zeros((n, m)), np.zeros(n)
            for k, a in enumerate(self.estimators_):
                out = np.ones(n, bool)
                out[picks(k)] = False
                total[out] += values(a, x[out])
                count[out] += 1
            seen = count > 0
            self._oob(total[seen] / count[seen, None], t[seen])
        self.fitted = True
        return self

    def _fit_far(self, rows, p, m):
        seed = 0 if self.random_state is None else self.random_state
        data, edges = binned_rows(rows, p, m, FOREST_BINS)
        n = data.count()
        share = 1.0 if self.max_samples is None else self.max_samples if isinstance(self.max_samples, float) else min(1.0, self.max_samples / n)
        boot = self.bootstrap

        def weigh(ids, tree):
            return bootstrap_weights(ids, seed, tree, share) if boot else np.ones(len(ids))

        take = n_features(self.max_features_mode, self.max_features_value, p)
        grown = grow_forest(data, edges, m, self.n_estimators, weigh, self.max_depth, self.min_samples_split, take, seed)
        self.estimators_ = [t.arrays() for t in grown]
        each = [i / i.sum() if i.sum() else i for i in (t.importances(p) for t in grown)]
        self.feature_importances_ = np.mean(each, axis=0)
        if self.oob_score and boot:
            self._far_oob(data, edges, p, m, weigh)
        self.fitted = True
        return self

    def _far_oob(self, data, edges, p, m, weigh):
        """The out-of-bag score from sums over the rows."""
        trees, classes = self.estimators_, "classes_" in self.__dict__

        def score(batches):
            import pyarrow as pa

            out = np.zeros(5)  # rows, right ones, squared gaps, targets, their squares
            for b in batches:
                codes = np.asarray(b.column(0).flatten()).reshape(-1, p)
                t, ids = np.asarray(b.column(1).flatten(), float).reshape(len(codes), m), b.column(2).to_numpy()
                total, count = np.zeros((len(codes), m)), np.zeros(len(codes))
                # A row's bin stands for its values: the edge of the bin is on the same side of every threshold.
                x = np.column_stack([np.r_[e, np.inf][codes[:, i]] for i, e in enumerate(edges)])
                for k, a in enumerate(trees):
                    away = weigh(ids, k) == 0
                    total[away] += values(a, x[away])
                    count[away] += 1
                seen = count > 0
                q, own = total[seen] / count[seen, None], t[seen]
                right = (q.argmax(axis=1) == own.argmax(axis=1)).sum() if classes else 0
                out += [seen.sum(), right, ((own - q) ** 2).sum(), own.sum(), (own * own).sum()]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(5), pa.int32()), "v": out.tolist()})

        got = {r["i"]: r["v"] for r in data.mapInArrow(score, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        spread = got[4] - got[3] ** 2 / max(got[0], 1)
        self.oob_score_ = float(got[1] / max(got[0], 1)) if classes else float(1 - got[2] / spread) if spread else 0.0

    def _values(self, df, features):
        trees = self.estimators_
        return row_function(lambda x: sum(values(a, x) for a in trees) / len(trees), self._ready(df, features), "array<double>")


class RandomForestClassifier(_Forest, _ClassTree):
    """Soft votes of Gini trees on bootstrap draws."""

    defaults = {**_FOREST, "criterion": "gini", "max_features_mode": "sqrt"}

    def _oob(self, p, t):
        self.oob_decision_function_, self.oob_score_ = p, float((p.argmax(axis=1) == t.argmax(axis=1)).mean())


class RandomForestRegressor(_Forest, DecisionTreeRegressor):
    defaults = {**_FOREST, "criterion": "squared_error", "max_features_mode": "third"}

    def _oob(self, p, t):
        self.oob_prediction_ = p
        tot = ((t - t.mean(axis=0)) ** 2).sum()
        self.oob_score_ = float(1 - ((t - p) ** 2).sum() / tot) if tot else 0.0


_BOOST = {
    "learning_rate": 0.1, "n_estimators": 100, "subsample": 1.0, "criterion": "friedman_mse", "min_samples_split": 2, "min_samples_leaf": 1, "min_weight_fraction_leaf": 0.0, "max_depth": 3,
    "min_impurity_decrease": 0.0, "random_state": None, "verbose": 0, "max_leaf_nodes": None, "warm_start": False, "validation_fraction": 0.1, "n_iter_no_change": None, "tol": 1e-4, "ccp_alpha": 0.0,
}
_UNUSED = ("criterion", "min_samples_leaf", "min_weight_fraction_leaf", "min_impurity_decrease", "max_leaf_nodes", "warm_start", "validation_fraction", "n_iter_no_change", "tol", "ccp_alpha", "verbose")


def _boost_binned(model, kind, df, features, cols, targets, heads, gradients, init):
    """Fits ``model`` on histograms in Spark: mean gradients in the leaves, thresholds at quantiles."""
    far = kind(learning_rate=model.learning_rate, max_iter=model.n_estimators, max_depth=model.max_depth, max_leaf_nodes=0, min_samples_leaf=1)
    far.local_rows, far.features, far.label, far.width = -1, model.features, model.label, model.width
    if "classes_" in model.__dict__:
        far.classes_, far.n_classes_ = model.classes_, model.n_classes_
    far._boost(df, features, cols, targets, heads, gradients, init)
    model._far, model.estimators_, model.train_score_, model.feature_importances_ = far, far.estimators_, far.train_score_, far.feature_importances_
    model.fitted = True
    return model


class GradientBoostingRegressor(Predictor):
    """Trees on negative gradients; for losses other than the squared one each stage's step is found on a grid.

    Beyond ``local_rows`` the trees grow on histograms in Spark.
    """

    defaults = {**_BOOST, "loss": "squared_error", "alpha": 0.9}
    ignored = _UNUSED
    local_rows = 50_000

    def _loss(self, y, f):
        r = y - f
        if self.loss == "squared_error":
            return float((r * r).mean())
        if self.loss == "absolute_error":
            return float(np.abs(r).mean())
        if self.loss == "quantile":
            return float(np.where(r >= 0, self.alpha * r, (self.alpha - 1) * r).mean())
        d = np.quantile(np.abs(r), self.alpha)
        return float(np.where(np.abs(r) <= d, r * r / 2, d * (np.abs(r) - d / 2)).mean())

    def _gradient(self, y, f):
        r = y - f
        if self.loss == "squared_error":
            return r
        if self.loss == "absolute_error":
            return np.sign(r)
        if self.loss == "quantile":
            return np.where(r >= 0, self.alpha, self.alpha - 1)
        if self.loss == "huber":
            d = np.quantile(np.abs(r), self.alpha)
            return np.clip(r, -d, d)
        raise ValueError(f"unknown loss {self.loss!r}")

    def fit(self, df, features, label, id_col=None):
        cols = self._start(df, features, label)
        self._far = None
        if df.limit(self.local_rows + 1).count() > self.local_rows:
            if self.loss != "squared_error" or self.subsample < 1:
                raise ValueError(f"beyond {self.local_rows} rows only the squared error on all rows is supported")
            y = F.col(label).cast("double")
            self.init_ = float(df.agg(F.avg(y).alias("m")).first()["m"])
            return _boost_binned(self, HistGradientBoostingRegressor, df, features, cols, [y], 1, lambda f, t: (f - t, np.ones_like(f)), np.array([self.init_]))
        x, y, _ = collect_bounded(df, features, label, id_col, self.local_rows)
        self.init_ = float(y.mean() if self.loss == "squared_error" else np.quantile(y, self.alpha if self.loss == "quantile" else 0.5))
        f, rng = np.full(len(y), self.init_), np.random.default_rng(self.random_state)
        self.estimators_, self.train_score_, imp = [], [], np.zeros(self.width)
        for _ in range(self.n_estimators):
            rows = np.arange(len(y)) if self.subsample >= 1 else rng.choice(len(y), max(1, int(self.subsample * len(y))), replace=False)
            g = self._gradient(y, f)
            tree = build(x[rows], g[rows, None], self.max_depth, self.min_samples_split)
            h, step = values(tree.arrays(), x)[:, 0], 1.0
            if self.loss != "squared_error":
                tries = np.linspace(0, 4 * max(1e-12, np.abs(y - f).mean()) / max(1e-12, np.abs(h).mean()), 81)
                step = float(tries[int(np.argmin([self._loss(y, f + s * h) for s in tries]))])
            f = f + self.learning_rate * step * h
            self.estimators_.append((tree.arrays(), self.learning_rate * step))
            self.train_score_.append(self._loss(y, f))
            imp += tree.importances(self.width)
        self.feature_importances_ = imp / imp.sum() if imp.sum() else imp
        self.fitted = True
        return self

    def predict(self, df, features=None, out="prediction"):
        if getattr(self, "_far", None) is not None:
            self._ready(df, features)
            return self._far.predict(df, features, out)
        trees, init = self.estimators_, self.init_
        return df.withColumn(out, row_function(lambda x: init + sum(s * values(a, x)[:, 0] for a, s in trees), self._ready(df, features)))


class GradientBoostingClassifier(_ClassTree):
    """Log loss (K trees a stage for K > 2 classes) or exponential loss for two classes."""

    defaults = {**_BOOST, "loss": "log_loss"}
    ignored = _UNUSED
    local_rows = 50_000

    def fit(self, df, features, label, id_col=None):
        if self.subsample < 1:
            raise ValueError("subsample below 1 is not supported")
        cols = self._start(df, features, label)
        self._prepare(df, label)
        k = len(self.classes_)
        if k < 2:
            raise ValueError("one class only")
        if self.loss == "exponential" and k > 2:
            raise ValueError("the exponential loss takes two classes")
        rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)], *[c.alias(f"y{j}") for j, c in enumerate(self._targets(df, label))])
        self._far, heads = None, 1 if k == 2 else k
        if rows.limit(self.local_rows + 1).count() > self.local_rows:
            if self.loss != "log_loss":
                raise ValueError(f"beyond {self.local_rows} rows only the log loss is supported")
            r = rows.agg(*[F.avg(f"y{j}").alias(f"y{j}") for j in range(k)]).first()
            share = np.clip(np.array(r, float), 1e-12, 1)
            self.init_ = np.array([np.log(share[1] / share[0])]) if heads == 1 else np.log(share)

            def gradients(f, t):
                return (sigmoid(f) if heads == 1 else softmax(f)) - (t[:, 1:] if heads == 1 else t), np.ones_like(f)

            return _boost_binned(self, HistGradientBoostingClassifier, df, features, cols, self._targets(df, label), heads, gradients, self.init_)
        x, t, _ = collect_bounded(rows, [f"x{i}" for i in range(len(cols))], [f"y{j}" for j in range(k)], None, self.local_rows)
        share = np.clip(t.mean(axis=0), 1e-12, 1)
        scale = 0.5 if self.loss == "exponential" else 1.0
        self.init_ = np.array([scale * np.log(share[1] / share[0])]) if heads == 1 else np.log(share)
        f, imp = np.tile(self.init_, (len(x), 1)), np.zeros(self.width)
        self.estimators_, self.train_score_ = [], []
        for _ in range(self.n_estimators):
            if self.loss == "exponential":
                s = 2 * t[:, 1] - 1
                g = (s * np.exp(-s * f[:, 0]))[:, None]
            else:
                g = t[:, 1:] - sigmoid(f) if heads == 1 else t - softmax(f)
            stage = [build(x, g[:, j : j + 1], self.max_depth, self.min_samples_split) for j in range(heads)]
            f = f + self.learning_rate * np.column_stack([values(a.arrays(), x)[:, 0] for a in stage])
            self.estimators_.append([a.arrays() for a in stage])
            p = np.column_stack([1 - sigmoid(f[:, 0]), sigmoid(f[:, 0])]) if heads == 1 else softmax(f)
            self.train_score_.append(float(-np.log(np.maximum((p * t).sum(axis=1), 1e-300)).mean()))
            imp += sum(a.importances(self.width) for a in stage)
        self.feature_importances_ = imp / imp.sum() if imp.sum() else imp
        self.fitted = True
        return self

    def _raw(self):
        if getattr(self, "_far", None) is not None:
            return self._far._raw()
        trees, init, rate = self.estimators_, self.init_, self.learning_rate
        return lambda x: init + rate * sum(np.column_stack([values(a, x)[:, 0] for a in stage]) for stage in trees)

    def _values(self, df, features):
        raw, scale = self._raw(), 2.0 if self.loss == "exponential" else 1.0

        def proba(x):
            f = raw(x)
            if f.shape[1] > 1:
                return softmax(f)
            p = sigmoid(scale * f[:, 0])
            return np.column_stack([1 - p, p])

        return row_function(proba, self._ready(df, features), "array<double>")

    def decision_function(self, df, features=None, out="decision"):
        v = row_function(self._raw(), self._ready(df, features), "array<double>")
        return df.withColumn(out, v if len(self.classes_) > 2 else v[0])


_HIST = {
    "learning_rate": 0.1, "max_iter": 100, "max_leaf_nodes": 31, "max_depth": None, "min_samples_leaf": 20, "l2_regularization": 0.0, "max_bins": 255,
    "categorical_features": None, "monotonic_cst": None, "early_stopping": False, "validation_fraction": 0.1, "n_iter_no_change": 10, "tol": 1e-7, "random_state": None,
}


#: Ranks of the quantiles are right to one in this many rows.
QUANTILE_ACCURACY = 100_000


class _Hist:
    """Best-first growth on histograms of gradients; rows are bins, gradients stay in Spark or, when few, in numpy."""

    local_rows = 200_000
    ignored = ()

    def _bins(self, df, cols):
        """Edges at quantiles of each feature (of mergeable sketches): at most max_bins - 1; of a categorical feature its values."""
        if not 2 <= self.max_bins <= 255:
            raise ValueError("max_bins lies between 2 and 255")
        shares = [k / self.max_bins for k in range(1, self.max_bins)]
        row = df.agg(*[F.percentile_approx(c, F.array(*map(F.lit, shares)), F.lit(QUANTILE_ACCURACY)).alias(f"q{i}") for i, c in enumerate(cols)]).first()
        if row[0] is None:
            raise ValueError("empty input")
        cats = set(self.categorical_features or ())
        return [np.unique(q) if i not in cats else self._categories(df, cols[i], i) for i, q in enumerate(row)]

    def _categories(self, df, col, i):
        found = [r[0] for r in df.select(col).filter(col.isNotNull()).distinct().limit(self.max_bins + 1).collect()]
        if len(found) > self.max_bins:
            raise ValueError(f"categorical feature {i} has more than max_bins = {self.max_bins} categories")
        return np.array(sorted(found), float)

    def _grow(self, codes, g, h):
        """One tree as (feature, bin, left, right, value) with ``bin <= b`` (or, categorical, ``bin in set``) to the left."""
        p, nb, lam, cats = codes.shape[1], self.max_bins + 1, self.l2_regularization, set(self.categorical_features or ())
        mono = self.monotonic_cst or [0] * p
        f_, b_, l_, r_, v_, gain_ = [], [], [], [], [], []

        def value(gs, hs, lo, hi):
            return float(np.clip(-gs / (hs + lam + 1e-15), lo, hi))

        def add(rows, depth, lo, hi):
            gs, hs = g[rows].sum(), h[rows].sum()
            for a, v in ((f_, -1), (b_, None), (l_, 0), (r_, 0), (v_, value(gs, hs, lo, hi)), (gain_, 0.0)):
                a.append(v)
            best = (1e-12, None)
            if len(rows) >= 2 * self.min_samples_leaf and (self.max_depth is None or depth < self.max_depth):
                for j in range(p):
                    c = codes[rows, j]
                    hg, hh, hn = (np.bincount(c, w, nb) for w in (g[rows], h[rows], np.ones(len(rows))))
                    order = np.argsort(np.where(hn > 0, hg / (hh + lam + 1e-15), np.inf), kind="stable") if j in cats else np.arange(nb)
                    cg, ch, cn = np.cumsum(hg[order])[:-1], np.cumsum(hh[order])[:-1], np.cumsum(hn[order])[:-1]
                    ok = (cn >= self.min_samples_leaf) & (len(rows) - cn >= self.min_samples_leaf)
                    gain = cg**2 / (ch + lam + 1e-15) + (gs - cg) ** 2 / (hs - ch + lam + 1e-15) - gs**2 / (hs + lam + 1e-15)
                    if mono[j]:
                        left, right = -cg / (ch + lam + 1e-15), -(gs - cg) / (hs - ch + lam + 1e-15)
                        ok &= (right - left) * mono[j] >= 0
                    gain = np.where(ok, gain, -np.inf)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), (j, np.sort(order[: i + 1]) if j in cats else i))
            return len(f_) - 1, rows, depth, lo, hi, best

        heap, n_leaves = [add(np.arange(len(g)), 0, -np.inf, np.inf)], 1
        limit = self.max_leaf_nodes or 1 << 30
        while n_leaves < limit:
            heap.sort(key=lambda e: e[5][0])
            if not heap or heap[-1][5][1] is None:
                break
            k, rows, depth, lo, hi, (gain, (j, b)) = heap.pop()
            low = np.isin(codes[rows, j], b) if j in cats else codes[rows, j] <= b
            a, c = rows[low], rows[~low]
            mid = (lo, hi, lo, hi)
            if mono[j]:
                m = (value(g[a].sum(), h[a].sum(), lo, hi) + value(g[c].sum(), h[c].sum(), lo, hi)) / 2
                mid = (lo, m, m, hi) if mono[j] > 0 else (m, hi, lo, m)
            kids = add(a, depth + 1, *mid[:2]), add(c, depth + 1, *mid[2:])
            f_[k], b_[k], l_[k], r_[k], gain_[k] = j, b, kids[0][0], kids[1][0], gain
            self.gains_[j] += gain
            heap += kids
            n_leaves += 1
        return np.array(f_), b_, np.array(l_), np.array(r_), np.array(v_)

    @staticmethod
    def _walk(tree, codes):
        f, b, left, right, v = tree
        at = np.zeros(len(codes), int)
        while True:
            inner = f[at] >= 0
            if not inner.any():
                return v[at]
            new = at.copy()
            for k in np.unique(at[inner]):
                rows = np.flatnonzero(at == k)
                c = codes[rows, f[k]]
                go = np.isin(c, b[k]) if isinstance(b[k], np.ndarray) else c <= b[k]
                new[rows] = np.where(go, left[k], right[k])
            at = new

    @staticmethod
    def _codes(x, edges, cats=()):
        """Bin numbers; a category's is its place among the categories, one that wasn't there at ``fit`` comes after them."""
        out = [np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]
        for i in cats:
            e = edges[i]
            known = e[np.minimum(out[i], len(e) - 1)] == x[:, i]
            out[i] = np.where(known, out[i], len(e))
        return np.column_stack(out)

    def _split(self, hg, hh, hn, j, lo, hi):
        """The best cut of one feature's histogram: (gain, bin or bins to the left, sums to the left)."""
        lam, mono = self.l2_regularization, (self.monotonic_cst or [0] * self.width)[j]
        cat = j in set(self.categorical_features or ())
        gs, hs, ns = hg.sum(), hh.sum(), hn.sum()
        order = np.argsort(np.where(hn > 0, hg / (hh + lam + 1e-15), np.inf), kind="stable") if cat else np.arange(len(hn))
        cg, ch, cn = np.cumsum(hg[order])[:-1], np.cumsum(hh[order])[:-1], np.cumsum(hn[order])[:-1]
        ok = (cn >= self.min_samples_leaf) & (ns - cn >= self.min_samples_leaf)
        gain = cg**2 / (ch + lam + 1e-15) + (gs - cg) ** 2 / (hs - ch + lam + 1e-15) - gs**2 / (hs + lam + 1e-15)
        if mono:
            ok &= (-(gs - cg) / (hs - ch + lam + 1e-15) + cg / (ch + lam + 1e-15)) * mono >= 0
        gain = np.where(ok, gain, -np.inf)
        i = int(gain.argmax())
        return float(gain[i]), (np.sort(order[: i + 1]) if cat else i), (cg[i], ch[i], cn[i])

    def _grow_far(self, rows, gradients, head):
        """One tree from Spark aggregations: each pass sums the histograms of all open leaves' children.

        Children of every open leaf are counted in one pass, so the best-first order needs
        about as many passes as the tree is deep.  Leaves * features * bins * 3 numbers
        reach the driver, whatever the number of rows.
        """
        p, nb, lam = self.width, self.max_bins + 1, self.l2_regularization
        tree, span = ([-1], [None], [0], [0], [0.0]), {0: (-np.inf, np.inf)}
        mono = self.monotonic_cst or [0] * p

        def value(g, h, k):
            return float(np.clip(-g / (h + lam + 1e-15), *span[k]))

        def histograms(of):
            now = (np.array(tree[0]), list(tree[1]), np.array(tree[2]), np.array(tree[3]), np.arange(len(tree[0])).astype(float))
            slot = {k: i for i, k in enumerate(of)}
            walk = self._walk

            def sums(batches):
                import pyarrow as pa

                out = np.zeros((len(slot), p, nb, 3))
                for b in batches:
                    codes = np.asarray(b.column(0).flatten()).reshape(-1, p)
                    t = np.asarray(b.column(1).flatten(), float).reshape(len(codes), -1)
                    g, h = (v[:, head] for v in gradients(np.asarray(b.column(2).flatten(), float).reshape(len(codes), -1), t))
                    at = walk(now, codes).astype(int)
                    for k, i in slot.items():
                        own = np.flatnonzero(at == k)
                        for j in range(p):
                            c = codes[own, j]
                            for m, w in enumerate((g[own], h[own], None)):
                                out[i, j, :, m] += np.bincount(c, w, nb)
                at = np.flatnonzero(out)
                yield pa.RecordBatch.from_pydict({"i": pa.array(at), "v": pa.array(out.ravel()[at])})

            flat = np.zeros(len(of) * p * nb * 3)
            for r in rows.mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
                flat[r["i"]] = r["v"]
            return dict(zip(of, flat.reshape(len(of), p, nb, 3)))

        def best(hist, k, depth):
            if hist[0, :, 2].sum() < 2 * self.min_samples_leaf or self.max_depth is not None and depth >= self.max_depth:
                return None
            found = max(((*self._split(*hist[j].T, j, *span[k]), j) for j in range(p)), key=lambda x: x[0])
            return found if found[0] > 1e-12 else None

        def leaf(depth):
            for a, v in zip(tree, (-1, None, 0, 0, 0.0)):
                a.append(v)
            return len(tree[0]) - 1, depth

        root = histograms([0])[0]
        tree[4][0] = value(root[0, :, 0].sum(), root[0, :, 1].sum(), 0)
        open_, known, n_leaves, limit = {0: (best(root, 0, 0), 0)}, {}, 1, self.max_leaf_nodes or 1 << 30
        open_ = {k: v for k, v in open_.items() if v[0]}
        while open_ and n_leaves < limit:
            k = max(open_, key=lambda k: open_[k][0][0])
            if k not in known:  # split all open leaves for a trial, and count their children at once
                made = {}
                for q, ((_, b, _, j), depth) in open_.items():
                    if q not in known:
                        a, c = leaf(depth + 1)[0], leaf(depth + 1)[0]
                        tree[0][q], tree[1][q], tree[2][q], tree[3][q] = j, b, a, c
                        made[q] = (a, c)
                hist = histograms([x for pair in made.values() for x in pair])
                for q, (a, c) in made.items():
                    known[q] = (a, c, hist[a], hist[c])
                    tree[0][q] = -1
            (gain, b, _, j), depth = open_.pop(k)
            self.gains_[j] += gain
            a, c, ha, hc = known.pop(k)
            tree[0][k] = j
            lo, hi = span[k]
            span[a] = span[c] = (lo, hi)
            if mono[j]:
                m = (value(ha[0, :, 0].sum(), ha[0, :, 1].sum(), a) + value(hc[0, :, 0].sum(), hc[0, :, 1].sum(), c)) / 2
                span[a], span[c] = ((lo, m), (m, hi)) if mono[j] > 0 else ((m, hi), (lo, m))
            for x, hx in ((a, ha), (c, hc)):
                tree[4][x] = value(hx[0, :, 0].sum(), hx[0, :, 1].sum(), x)
                found = best(hx, x, depth + 1)
                if found:
                    open_[x] = (found, depth + 1)
            n_leaves += 1
        return np.array(tree[0]), tree[1], np.array(tree[2]), np.array(tree[3]), np.array(tree[4])

    def _boost(self, df, features, cols, targets, heads, gradients, init):
        rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)], *[c.alias(f"y{j}") for j, c in enumerate(targets)])
        self.bin_edges_, self.init_, self.gains_ = self._bins(df, cols), init, np.zeros(len(cols))
        if rows.limit(self.local_rows + 1).count() > self.local_rows:
            return self._boost_far(rows, len(cols), len(targets), heads, gradients)
        x, t, _ = collect_bounded(rows, [f"x{i}" for i in range(len(cols))], [f"y{j}" for j in range(len(targets))], None, self.local_rows)
        codes, rng = self._codes(x, self.bin_edges_, self.categorical_features or ()), np.random.default_rng(self.random_state)
        held = np.zeros(len(x), bool)
        if self.early_stopping:  # held-out rows take no part in growing at all
            held[rng.permutation(len(x))[: max(1, int(self.validation_fraction * len(x)))]] = True
        f = np.tile(init, (len(x), 1))
        self.estimators_, self.train_score_, best, since = [], [], np.inf, 0
        for self.n_iter_ in range(1, self.max_iter + 1):
            g, h = gradients(f, t)
            stage = []
            for j in range(heads):
                tree = self._grow(codes[~held], g[~held, j], h[~held, j])
                f[:, j] += self.learning_rate * self._walk(tree, codes)
                stage.append(tree)
            self.estimators_.append(stage)
            self.train_score_.append(self._objective(f[~held], t[~held]))
            if self.early_stopping:
                now = self._objective(f[held], t[held])
                best, since = (now, 0) if now < best - self.tol else (best, since + 1)
                if since >= self.n_iter_no_change:
                    break
        self._importances()
        return self

    def _importances(self):
        self.feature_importances_ = self.gains_ / self.gains_.sum() if self.gains_.sum() else self.gains_
        self.fitted = True

    def _boost_far(self, rows, p, m, heads, gradients):
        """Rows stay in Spark as bin numbers and targets; early stopping watches rows held out by a hash."""
        edges, code, cats, init = self.bin_edges_, self._codes, tuple(self.categorical_features or ()), self.init_

        def binned(batches):
            import pyarrow as pa

            for b in batches:
                x = np.asarray(b.column(0).flatten(), float).reshape(-1, p)
                at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * p)
                start = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(init)), pa.array(np.tile(init, len(x))))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(code(x, edges, cats).ravel().astype(np.int16))), b.column(1), start], names=["c", "t", "f"])

        data = rows.select(F.array(*[F.col(f"x{i}") for i in range(p)]).alias("x"), F.array(*[F.col(f"y{j}") for j in range(m)]).alias("t")).mapInArrow(binned, "c array<short>, t array<double>, f array<double>")
        data = settled(data)
        share = int(self.validation_fraction * 1000) if self.early_stopping else 0
        draw = F.pmod(F.xxhash64(F.lit(self.random_state or 0), "c", "t"), F.lit(1000))
        self.estimators_, self.train_score_, best, since = [], [], np.inf, 0
        for self.n_iter_ in range(1, self.max_iter + 1):
            # The rows carry their raw scores: a pass scores no earlier trees, however many there are.
            self.estimators_.append([self._grow_far(data.filter(draw >= share), gradients, j) for j in range(heads)])
            data = settled(data.mapInArrow(self._rescored(self.estimators_[-1], p), "c array<short>, t array<double>, f array<double>"))
            self.train_score_.append(self._mean_objective(data.filter(draw >= share), heads))
            if share:
                now = self._mean_objective(data.filter(draw < share), heads)
                best, since = (now, 0) if now < best - self.tol else (best, since + 1)
                if since >= self.n_iter_no_change:
                    break
        self._importances()
        return self

    def _rescored(self, stage, p):
        rate, walk = self.learning_rate, self._walk

        def run(batches):
            import pyarrow as pa

            for b in batches:
                codes = np.asarray(b.column(0).flatten()).reshape(-1, p)
                f = np.array(b.column(2).flatten(), float).reshape(len(codes), len(stage))
                for j, tree in enumerate(stage):
                    f[:, j] += rate * walk(tree, codes)
                at = pa.array(np.arange(len(f) + 1, dtype=np.int32) * len(stage))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(at, pa.array(f.ravel()))], names=["c", "t", "f"])

        return run

    def _mean_objective(self, rows, heads):
        objective = self._objective

        def total(batches):
            import pyarrow as pa

            s, n = 0.0, 0
            for b in batches:
                if b.num_rows:
                    f = np.asarray(b.column(2).flatten(), float).reshape(-1, heads)
                    s, n = s + objective(f, np.asarray(b.column(1).flatten(), float).reshape(len(f), -1)) * len(f), n + len(f)
            yield pa.RecordBatch.from_pydict({"s": [s], "n": [float(n)]})

        r = rows.mapInArrow(total, "s double, n double").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
        return r["s"] / r["n"] if r["n"] else 0.0

    def _raw(self):
        trees, init, rate, edges = self.estimators_, self.init_, self.learning_rate, self.bin_edges_
        walk, code, cats = self._walk, self._codes, tuple(self.categorical_features or ())

        def raw(x):
            c = code(x, edges, cats)
            return init + rate * sum(np.column_stack([walk(a, c) for a in stage]) for stage in trees)

        return raw


class HistGradientBoostingRegressor(_Hist, Predictor):
    defaults = {**_HIST, "loss": "squared_error"}

    def fit(self, df, features, label):
        if self.loss != "squared_error":
            raise ValueError("only the squared error is supported")
        cols, y = self._start(df, features, label), F.col(label).cast("double")
        init = df.agg(F.avg(y).alias("m")).first()["m"]
        if init is None:
            raise ValueError("empty input")
        return self._boost(df, features, cols, [y], 1, lambda f, t: (f - t, np.ones_like(f)), np.array([float(init)]))

    def _objective(self, f, t):
        return float(((f - t) ** 2).mean() / 2) if len(f) else 0.0

    def predict(self, df, features=None, out="prediction"):
        raw = self._raw()
        return df.withColumn(out, row_function(lambda x: raw(x)[:, 0], self._ready(df, features)))


class HistGradientBoostingClassifier(_Hist, _ClassTree):
    defaults = {**_HIST, "loss": "log_loss"}

    def fit(self, df, features, label):
        if self.loss != "log_loss":
            raise ValueError("only the log loss is supported")
        cols = self._start(df, features, label)
        self._prepare(df, label)
        k = len(self.classes_)
        if k < 2:
            raise ValueError("one class only")
        share = {r["y"]: r["count"] for r in df.groupBy(F.col(label).alias("y")).count().collect()}
        p = np.array([share[c] for c in self.classes_], float)
        p /= p.sum()
        heads = 1 if k == 2 else k

        def gradients(f, t):
            q = sigmoid(f) if heads == 1 else softmax(f)
            return q - (t[:, 1:] if heads == 1 else t), np.maximum(q * (1 - q), 1e-16)

        return self._boost(df, features, cols, self._targets(df, label), heads, gradients, np.array([np.log(p[1] / p[0])]) if heads == 1 else np.log(p))

    def _objective(self, f, t):
        p = np.column_stack([1 - sigmoid(f[:, 0]), sigmoid(f[:, 0])]) if f.shape[1] == 1 else softmax(f)
        return float(-np.log(np.maximum((p * t).sum(axis=1), 1e-300)).mean()) if len(f) else 0.0

    def _values(self, df, features):
        raw = self._raw()

        def proba(x):
            f = raw(x)
            return softmax(f) if f.shape[1] > 1 else np.column_stack([1 - sigmoid(f[:, 0]), sigmoid(f[:, 0])])

        return row_function(proba, self._ready(df, features), "array<double>")
