"""Distances of queries to all training rows in blocks, top-k and radius searches, connected components.

Training rows become blocks of a few thousand rows (arrays of bytes).  Blocks that hold no
more than ``HELD`` numbers altogether go to every task; more are dealt by an equi-join on the
block's number, so that each task holds one block of queries and one of training rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.core import settled

BLOCK = 4_096
#: Numbers (8 bytes each) that may go to every task.
HELD = 8_000_000


def blocks(df: DataFrame, cols: list[Column], id_col: str, extra: Column | None = None) -> DataFrame:
    """Columns block, ids, x and y (bytes of int64 and float64 arrays)."""
    p = len(cols)

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                s = b.slice(at, BLOCK)
                x = np.asarray(s.column(1).flatten(), float).reshape(-1, p)
                yield pa.RecordBatch.from_pydict({"block": [k], "ids": [s.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], "x": [x.tobytes()], "y": [s.column(2).to_numpy(zero_copy_only=False).astype("<f8").tobytes()]})
                k += 1

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.array(*cols).alias("x"), (F.lit(0.0) if extra is None else extra.cast("double")).alias("y"))
    return rows.mapInArrow(cut, "block long, ids binary, x binary, y binary")


def unblock(row, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["x"], "<f8").reshape(-1, p), np.frombuffer(row["y"], "<f8")


def squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances by direct differences: exact for equal rows."""
    out = np.zeros((len(q), len(x)))
    for j in range(x.shape[1]):
        d = q[:, j, None] - x[None, :, j]
        out += d * d
    return out


class Index:
    """Training rows in blocks."""

    def __init__(self, df: DataFrame, cols: list[Column], id_col: str, label: str | None = None, held: int = HELD) -> None:
        self.p = len(cols)
        self.blocks = blocks(df, cols, id_col, None if label is None else F.col(label)).persist()
        self.n = self.blocks.agg(F.sum(F.length("ids") / 8).cast("long").alias("n")).first()["n"] or 0
        if not self.n:
            raise ValueError("empty input")
        self.local = [unblock(r, self.p) for r in self.blocks.collect()] if self.n * self.p <= held else None

    def search(self, df: DataFrame, cols: list[Column], id_col: str, f, schema: str, merge=None) -> DataFrame:
        """Rows of f(query ids, queries, training ids, rows, labels) -> dict of arrays, for each pair of blocks.

        ``merge`` makes one of such dicts of a few queries where a task has all blocks of training rows.
        """
        if merge and self.n > BLOCK:  # one file of rows is work for all tasks
            df = df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, min(self.n // BLOCK, 1_000)), F.col(id_col))
        queries, p, local = blocks(df, cols, id_col), self.p, self.local

        def all_local(batches):
            import pyarrow as pa

            for b in batches:
                for row in b.to_pylist():
                    ids, q, _ = unblock(row, p)
                    if merge:
                        for at in range(0, len(ids), 512):
                            yield pa.RecordBatch.from_pydict(merge([f(ids[at : at + 512], q[at : at + 512], *t) for t in local]))
                        continue
                    for t in local:
                        for at in range(0, len(ids), 512):
                            out = f(ids[at : at + 512], q[at : at + 512], *t)
                            if len(next(iter(out.values()))):
                                yield pa.RecordBatch.from_pydict(out)

        def pair(batches):
            import pyarrow as pa

            for b in batches:
                for row in b.to_pylist():
                    ids, q, _ = unblock({"ids": row["qids"], "x": row["qx"], "y": b""}, p)
                    t = unblock(row, p)
                    for at in range(0, len(ids), 512):
                        out = f(ids[at : at + 512], q[at : at + 512], *t)
                        if len(next(iter(out.values()))):
                            yield pa.RecordBatch.from_pydict(out)

        if local is not None:
            return queries.mapInArrow(all_local, schema)
        names = [r["block"] for r in self.blocks.select("block").collect()]  # one number for thousands of rows
        each = queries.select(F.col("ids").alias("qids"), F.col("x").alias("qx"), F.explode(F.array(*[F.lit(n) for n in names])).alias("block"))
        return each.join(self.blocks, "block").mapInArrow(pair, schema)


def top_k(index: Index, df: DataFrame, cols: list[Column], id_col: str, k: int, without_self: bool = False) -> DataFrame:
    """query_id, id, distance, label, rank (from 1) of the k nearest, by distance, then id."""
    if k > index.n - without_self:
        raise ValueError(f"k is {k} but there are {index.n} rows")

    def nearest(qids, q, ids, x, y):
        # A product of matrices tells who may be among the k nearest, whatever its rounding; their distances are by differences.
        n, qq, xx = min(k, len(ids)), (q * q).sum(axis=1), (x * x).sum(axis=1)
        near = qq[:, None] + xx[None] - 2 * (q @ x.T)
        own = qids[:, None] == ids[None, :] if without_self else None
        if without_self:
            near[own] = np.inf
        near = np.nan_to_num(near, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        limit = np.partition(near, n - 1, axis=1)[:, n - 1] + 1e-14 * (len(q.T) + 8) * (qq + xx.max(initial=0.0))
        rows, at = np.nonzero(~(near > limit[:, None]))
        if without_self:
            keep = ~own[rows, at]
            rows, at = rows[keep], at[keep]
        d = np.zeros(len(rows))
        for j in range(x.shape[1]):
            gap = q[rows, j] - x[at, j]
            d += gap * gap
        keep = np.isfinite(d)
        return first({"query_id": qids[rows[keep]], "id": ids[at[keep]], "d2": d[keep], "label": y[at[keep]]})

    def first(found):
        order = np.lexsort((found["id"], found["d2"], found["query_id"]))
        found = {c: v[order] for c, v in found.items()}
        who = found["query_id"]
        start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, int)
        keep = np.arange(len(who)) - np.repeat(start, np.diff(np.r_[start, len(who)])) < k
        return {c: v[keep] for c, v in found.items()}

    def merge(parts):
        return first({c: np.concatenate([part[c] for part in parts]) for c in parts[0]})

    found = index.search(df, cols, id_col, nearest, "query_id long, id long, d2 double, label double", merge)
    w = Window.partitionBy("query_id").orderBy("d2", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "id", F.sqrt("d2").alias("distance"), "label", "rank")


def _gaps(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    return np.sqrt(squared(q, x)) if metric == "euclidean" else np.abs(q[:, None, :] - x[None, :, :]).sum(axis=2)


def counts_within(index: Index, df: DataFrame, cols: list[Column], id_col: str, radius: float, metric: str = "euclidean") -> DataFrame:
    """query_id, n: the number of training rows within the radius; a number for each block leaves a task, no pairs."""

    def count(qids, q, ids, x, y):
        n = (_gaps(q, x, metric) <= radius).sum(axis=1)
        return {"query_id": qids[n > 0], "n": n[n > 0]}

    return index.search(df, cols, id_col, count, "query_id long, n long").groupBy("query_id").agg(F.sum("n").alias("n"))


def least_label_within(index: Index, df: DataFrame, cols: list[Column], id_col: str, radius: float, metric: str = "euclidean") -> DataFrame:
    """query_id, label: the least label of the training rows within the radius, for queries that have any."""

    def least(qids, q, ids, x, y):
        low = np.where(_gaps(q, x, metric) <= radius, y[None, :], np.inf).min(axis=1)
        return {"query_id": qids[np.isfinite(low)], "label": low[np.isfinite(low)]}

    return index.search(df, cols, id_col, least, "query_id long, label double").groupBy("query_id").agg(F.min("label").alias("label"))


def links_within(index: Index, df: DataFrame, cols: list[Column], id_col: str, radius: float, metric: str = "euclidean") -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within the radius: a spanning forest for each two blocks."""

    def forest(qids, q, ids, x, y):
        nodes, place = np.unique(np.r_[qids, ids], return_inverse=True)
        mine, theirs = place[: len(qids)], place[len(qids) :]
        up, a, b = np.arange(len(nodes)), [], []

        def top(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        near = _gaps(q, x, metric) <= radius
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            own = theirs[near[i]]
            while (up[own] != up[up[own]]).any():  # all roots at once
                up[own] = up[up[own]]
            for j in own[np.unique(up[own], return_index=True)[1]].tolist():
                r, s = top(mine[i]), top(j)
                if r != s:
                    up[max(r, s)] = min(r, s)
                    a.append(mine[i])
                    b.append(j)
        return {"a": nodes[np.array(a, int)], "b": nodes[np.array(b, int)]}

    return index.search(df, cols, id_col, forest, "a long, b long")


def within(index: Index, df: DataFrame, cols: list[Column], id_col: str, radius: float, metric: str = "euclidean") -> DataFrame:
    """query_id, id, distance, label of all training rows within the radius."""

    def near(qids, q, ids, x, y):
        d = _gaps(q, x, metric)
        a, b = np.nonzero(d <= radius)
        return {"query_id": qids[a], "id": ids[b], "distance": d[a, b], "label": y[b]}

    return index.search(df, cols, id_col, near, "query_id long, id long, distance double, label double")


def cosine(index: Index, df: DataFrame, cols: list[Column], id_col: str) -> DataFrame:
    """query_id, id, similarity of a set of queries and all training rows; norms are at least the double's epsilon."""
    eps = float(np.finfo(float).eps)

    def similar(qids, q, ids, x, y):
        norms = np.maximum(np.linalg.norm(q, axis=1), eps)[:, None] * np.maximum(np.linalg.norm(x, axis=1), eps)[None]
        s = q @ x.T / norms
        return {"query_id": np.repeat(qids, len(ids)), "id": np.tile(ids, len(qids)), "similarity": s.ravel()}

    return index.search(df, cols, id_col, similar, "query_id long, id long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node reachable) of every node with an edge (a, b); rounds are checkpointed."""
    both = settled(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct())
    label = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        to = label.select(F.col("node").alias("b"), F.col("root").alias("seen"))
        near = both.join(to, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        new = settled(label.join(near, "node").join(jump, "root", "left").select("node", "root", F.least("root", "seen", F.coalesce("higher", "root")).alias("now")))
        changed = new.filter("now <> root").limit(1).count()
        label = new.select("node", F.col("now").alias("root"))
        if not changed:
            return label
