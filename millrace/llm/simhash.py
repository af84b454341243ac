"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has a bit for each bit that is set in over half its shingles'
XXH64 hashes.  Distinct fingerprints are ordered by the bit counts of their four 16-bit
quarters and cut into equal tiles, which are stored in the shared folder.  Two tiles are
compared - exclusive or and bit counts in numpy - unless their bit counts differ by more
than the radius; inside large tiles the same test skips cells of equal counts.  A task
emits a spanning forest of the links that it finds, never all pairs, so a group of n near
copies costs about n edges; components follow by contraction.  Wide fingerprints (several
times 64 bits) find candidates for a given similarity of shingle sets; their tiles go by the
sets' sizes, and they are compared by their first 64 bits and, where those are near, in full.
The sets of texts with a candidate are then cut into tiles of their own, whose comparison makes
an edge only of pairs whose exact Jaccard similarity is at least RATIO.

With 64 bits every pair within the radius is found: the sum of the differences of the quarters' bit
counts never exceeds the Hamming distance.  Only exact fingerprints' representatives are
compared, so copies cost nothing.

Hot keys: copies are one node, and rows of a key with many copies get its class by a broadcast of
the hot keys alone; in contraction, where many nodes may point at one root, the joins' left
sides are written tables that Spark's adaptive execution splits when one key is large.

Defined results: null and empty texts, and those without words, have fingerprint zero and
are linked like any other; texts of any length give all their shingles; a null doc_id never
names a component unless all its members' ids are null (then the component is null); a
component's tie of equal smallest ids is one id; repeated rows are one node and give a row
each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _shared as S

RADIUS = 3
WORDS = 3
SEED = 42
#: Candidates for a share of equal five-word shingles of 0.8 or more: fingerprints of 4 x 64 bits.  At 0.8 they differ
#: in 39 bits on the average, with a standard deviation of 6; those of unrelated texts in 128, give or take 8.
#: Binomial tails at 0.8: one pair in a million is missed, of sets of 4 and 5 shingles one in 20,000.
WIDE, WIDE_RADIUS = 4, 76
#: Sets are near copies from this Jaccard similarity on.  Their sizes have that ratio at least, too: wide
#: fingerprints are told apart by sizes first.
RATIO = 0.8
#: Wide fingerprints are compared in full where their first 64 bits differ in no more than this (10 expected at 0.8).
FIRST_RADIUS = 25
#: Cells of equal counts are worth telling apart up to this radius.
CELLS_RADIUS = 8
#: Tiles are about this many in a run, from 1,024 up to 65,536 fingerprints each.
TILES = 200
LEAST_TILE, LARGEST_TILE = 1_024, 65_536
#: From this size on, tiles are compared cell by cell.
CELLS_FROM = 4_096
#: Keys with their classes go to every task up to this number.
FEW_KEYS = 50_000
#: Shingles in the sets of a tile with sets, about, and those looked up at once.
TILE_SHINGLES, LOOKED_UP = 1_000_000, 500_000


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS, seed: int = SEED, repeats: bool = True) -> np.ndarray:
    """The XXH64 hashes of a text's word shingles: with their repeats in order, or each once, ascending."""
    import xxhash

    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    n = max(1, len(own) - words + 1)
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    stops = ends[min(words, len(own)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)
    return hashes if repeats else np.unique(hashes)


def majority(hashes: np.ndarray, width: int = 1) -> list[int]:
    """The unsigned 64-bit SimHashes (``width`` of them) of shingles' hashes."""
    n, out = len(hashes), []
    if not n:
        return [0] * width
    for k in range(width):
        each, counts = _spread(hashes, k) if k else hashes, np.zeros(64, np.int64)
        for at in range(0, n, 65_536):
            bits = np.unpackbits(each[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]))
    return out


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED, width: int = 1, repeats: bool = True) -> tuple[list[int], int]:
    """The unsigned 64-bit SimHashes (``width`` of them) of a text's word shingles, with their repeats or each once, and their number."""
    hashes = shingles(text, words, seed, repeats)
    return majority(hashes, width), len(hashes)


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, width: int = 1, repeats: bool = True, uri: str | None = None) -> DataFrame:
    """doc_id, fps (the fingerprint's words as signed longs), size (its shingles) and key. No shuffle.

    A narrow fingerprint's key is itself, a wide one's a 64-bit hash of its shingles.  Below
    ``uri`` the shingles' hashes are stored: ``path`` is a row's file, ``at`` the place of its first.
    """

    def run(batches):
        import pyarrow as pa
        import xxhash

        S.forget()
        name, stored = f"{uri}/{uuid.uuid4().hex}.sh", 0
        with contextlib.ExitStack() as stack:
            if uri:
                fs, path = S.open_fs(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = stack.enter_context(fs.open_output_stream(path, compression=None))
            for batch in (b for whole in batches for b in S.slices(whole, 1)):
                found = [shingles(t.as_py(), words, seed, repeats) for t in batch.column(1)]
                fps = np.array([majority(h, width) for h in found], np.uint64).reshape(-1).view(np.int64)
                sizes = np.array([len(h) for h in found], np.int64)
                keys = fps if width == 1 else np.array([xxhash.xxh64_intdigest(np.sort(h).tobytes()) for h in found], np.uint64).view(np.int64)
                at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
                columns = [batch.column(0), pa.ListArray.from_arrays(at, pa.array(fps)), pa.array(sizes), pa.array(keys)]
                if uri:
                    columns += [pa.array([name] * len(found), pa.string()), pa.array(stored + np.cumsum(sizes) - sizes)]
                    stored += int(sizes.sum())
                    out.write(np.concatenate(found).tobytes())
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fps", "size", "key", "path", "at"][: len(columns)])
        S.trim()

    schema = "doc_id long, fps array<long>, size long, key long" + (", path string, at long" if uri else "")
    return S.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def read_sets(places: list[tuple[str, int, int]]) -> list[np.ndarray]:
    """The stored shingles of each (file, place of the first, number); a file is opened once and read forwards."""
    out, at = [np.zeros(0, np.uint64)] * len(places), 0
    order = sorted(range(len(places)), key=places.__getitem__)
    while at < len(order):
        name = places[order[at]][0]
        fs, path = S.open_fs(name)
        with fs.open_input_file(path) as f:
            while at < len(order) and places[order[at]][0] == name:
                _, first, n = places[order[at]]
                out[order[at]] = np.frombuffer(f.read_at(8 * n, 8 * first), np.uint64)
                at += 1
    return out


def quarters(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the four 16-bit quarters, one row a fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, 4)).astype(np.int16)


class Forest:
    """Union-find over array places; keeps the edges that joined two trees."""

    def __init__(self, n: int) -> None:
        self.up, self.edges = np.arange(n), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def tops(self, at: np.ndarray) -> np.ndarray:
        """The roots of several places."""
        up = self.up
        top = up[at]
        while True:
            higher = up[top]
            if (higher == top).all():
                break
            top = higher
        up[at] = top
        return top


class Sets:
    """A tile's shingle sets: ascending hashes, set by set."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.sizes, self.starts = flat, sizes, np.cumsum(sizes) - sizes

    def similar(self, i: int, other: Sets, places: np.ndarray) -> np.ndarray:
        """Whether set ``i`` and each of the other's at ``places`` have a Jaccard similarity of RATIO or more."""
        own, out = self.flat[self.starts[i] : self.starts[i] + self.sizes[i]], np.zeros(len(places), bool)
        part = np.cumsum(other.sizes[places]) // LOOKED_UP
        for which in np.split(np.arange(len(places)), np.flatnonzero(np.diff(part)) + 1):
            sizes = other.sizes[places[which]]
            before = np.cumsum(sizes) - sizes
            theirs = other.flat[np.repeat(other.starts[places[which]] - before, sizes) + np.arange(sizes.sum())]
            at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            shared = np.add.reduceat((own[at] == theirs).astype(np.int64), before)
            out[which] = shared >= RATIO * (len(own) + sizes - shared) - 1e-9
        return out


def confirm(i: int, place: int, others: np.ndarray, first: int, sets: tuple[Sets, Sets], near: np.ndarray, forest: Forest) -> None:
    """Joins ``place`` with every tree that holds a set similar to set ``i``; ``near`` are the candidates' bits that differ.

    Of each tree the nearest are looked at first, and no more of it once it is joined.
    """
    others, step = others[np.argsort(near, kind="stable")], 1
    while True:
        top = forest.tops(first + others)
        apart = top != forest.root(place)
        others, top = others[apart], top[apart]
        if not len(others):
            return
        order = np.argsort(top, kind="stable")
        new = np.r_[True, np.diff(top[order]) != 0]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        now = others[rank < step]
        for j in now[sets[0].similar(i, sets[1], now)].tolist():
            forest.join(place, first + j)
        others, step = others[rank >= step], 4 * step


def compare(a: np.ndarray, b: np.ndarray, first_a: int, first_b: int, radius: int, forest: Forest, sizes: tuple[np.ndarray, np.ndarray] | None = None, sets: tuple[Sets, Sets] | None = None) -> None:
    """Joins places of ``a`` and ``b`` (a row of words a fingerprint) that differ in at most ``radius`` bits.

    ``sizes``, ascending, of wide fingerprints: pairs whose sizes are too far apart aren't looked at.
    With ``sets`` only pairs are joined whose sets are similar.
    """
    whole, all_first = b, first_b
    step = max(1, 131_072 // max(1, len(b)))  # a step stays in the cache
    for at in range(0, len(a), step):
        part = a[at : at + step]
        if sizes:
            low = int(np.searchsorted(sizes[1], RATIO * sizes[0][at] - 1e-9, side="left"))
            high = int(np.searchsorted(sizes[1], sizes[0][at + len(part) - 1] / RATIO + 1e-9, side="right"))
            b, first_b = whole[low:high], all_first + low
            if not len(b):
                continue
        near = np.bitwise_count(part[:, None, 0] ^ b[None, :, 0]) <= (min(radius, FIRST_RADIUS) if sizes else radius)
        if first_a == all_first:
            near &= first_b + np.arange(len(b))[None, :] > first_a + np.arange(at, at + len(part))[:, None]
        if sizes:
            i, j = np.nonzero(near)
            one, other = sizes[0][at + i], sizes[1][first_b - all_first + j]
            far = (np.minimum(one, other) < RATIO * np.maximum(one, other)) | (np.bitwise_count(part[i] ^ b[j]).sum(axis=1, dtype=np.int64) > radius)
            near[i[far], j[far]] = False
        rows = np.flatnonzero(near.any(axis=1))
        for i in rows.tolist():
            others = np.flatnonzero(near[i])
            if sets:
                bits = np.bitwise_count(part[i] ^ b[others]).sum(axis=1, dtype=np.int64)
                confirm(at + i, first_a + at + i, first_b - all_first + others, all_first, sets, bits, forest)
                continue
            # Most of a dense group is joined already: look at roots, once each.
            _, where = np.unique(forest.tops(first_b + others), return_index=True)
            for j in others[where].tolist():
                forest.join(first_a + at + i, first_b + j)


def cells(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal bit counts in a sorted tile: their starts (and the end), and their counts."""
    change = np.flatnonzero((counts[1:] != counts[:-1]).any(axis=1)) + 1
    starts = np.r_[0, change]
    return np.r_[starts, len(counts)], counts[starts]


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, forest: Forest, sizes: tuple[np.ndarray, np.ndarray] | None = None, sets: tuple[Sets, Sets] | None = None) -> None:
    """All links inside tile ``a``, or between ``a`` and ``b``; tiles are sorted by bit counts, or by sizes."""
    other, shift = (a, 0) if b is None else (b, len(a))
    if sizes or radius > CELLS_RADIUS or len(a) < CELLS_FROM and len(other) < CELLS_FROM:
        compare(a, other, 0, shift, radius, forest, sizes, sets)
        return
    at, mine = cells(quarters(a[:, 0]))
    bt, theirs = cells(quarters(other[:, 0]))
    for i in range(len(mine)):
        close = np.flatnonzero(np.abs(theirs - mine[i]).sum(axis=1) <= radius)
        for j in close.tolist():
            if b is None and j < i:
                continue
            compare(a[at[i] : at[i + 1]], other[bt[j] : bt[j + 1]], int(at[i]), shift + int(bt[j]), radius, forest)


@functools.lru_cache(maxsize=24)
def _load(uri: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tile's keys, sizes and fingerprints, a row each."""
    rows = np.frombuffer(S.read_blob(uri), np.uint64).reshape(-1, 2 + width)
    return rows[:, 0].view(np.int64), np.ascontiguousarray(rows[:, 1]).view(np.int64), np.ascontiguousarray(rows[:, 2:])


@functools.lru_cache(maxsize=2)
def _load_sets(uri: str) -> np.ndarray:
    """The shingles of a tile's sets."""
    return np.frombuffer(S.read_blob(f"{uri}.sets"), np.uint64)


def make_tiles(distinct: DataFrame, uri: str, n: int, width: int, shingles: int = 0) -> DataFrame:
    """Stores the sorted tiles of the distinct fingerprints (key, size, fps); returns the committed list of them.

    With a number of ``shingles`` the rows have the ``path`` and place (``at``) of theirs, which are stored beside each tile.

    ``low`` and ``high`` bound the quarters' bit counts or, of wide fingerprints, the size's
    logarithm to the base 1 / RATIO: tiles more than 1 apart in it hold no pair.
    """
    tiles = max(1, -(-n // min(LARGEST_TILE, max(LEAST_TILE, n // TILES))), -(-shingles // TILE_SHINGLES))
    limit = 2 * LARGEST_TILE

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        parts, sets_at = [], []
        for b in batches:
            if b.num_rows:
                parts.append(np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy(), np.asarray(b.column(2).flatten()).reshape(-1, width)]))
                if shingles:
                    sets_at += zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(1).to_pylist())
        if not parts:
            return
        rows = np.concatenate(parts).astype(np.int64).view(np.uint64)
        if width > 1:
            order = np.lexsort((rows[:, 0], rows[:, 1]))
            place = np.floor(np.log(np.maximum(rows[:, 1], 1).astype(float)) / -np.log(RATIO)).astype(np.int32)[:, None]
        else:
            place = quarters(np.ascontiguousarray(rows[:, 2]))
            order = np.lexsort((rows[:, 2], *place.T[::-1]))
        rows, place = rows[order], place[order]
        # The number of output partitions may be more than asked for: a tile still has its bound.
        edges = [*range(0, len(rows), limit), len(rows)]
        if shingles:  # a tile's sets have a bound, too
            ends = np.cumsum(rows[:, 1].view(np.int64)) // (2 * TILE_SHINGLES)
            edges = sorted({*edges, *(np.flatnonzero(np.diff(ends)) + 1).tolist()})
        for k, (at, end) in enumerate(zip(edges, edges[1:])):
            own, spot = rows[at:end], place[at:end]
            name = f"{uri}/tiles/{uuid.uuid4().hex}.fp"
            S.write_blob(name, [own.tobytes()])
            if shingles:
                S.write_blob(f"{name}.sets", (h.tobytes() for h in read_sets([sets_at[i] for i in order[at:end].tolist()])))
            row = {"tile": [TaskContext.get().partitionId() * 1_000_000 + k], "path": [name], "n": [len(own)], "low": [spot.min(axis=0).tolist()], "high": [spot.max(axis=0).tolist()]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("tile", pa.int64()), ("path", pa.string()), ("n", pa.int64()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))]))

    first = F.col("fps")[0]
    if width > 1:
        keys = {"q0": F.col("size")}
    else:
        keys = {f"q{i}": F.bit_count(F.shiftrightunsigned(first, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)}
    names = ["key", "size", "fps", *(["path", "at"] if shingles else [])]
    ordered = distinct.select(*names, first.alias("f"), *[c.alias(k) for k, c in keys.items()]).repartitionByRange(tiles, *keys, "f", "key").select(*names)
    return S.written(ordered.mapInArrow(write, "tile long, path string, n long, low array<int>, high array<int>"), f"{uri}/tile_list")


def tile_pairs(tiles: DataFrame, radius: int, parts: int = 4) -> DataFrame:
    """Pairs of tiles whose places (quarters' bit counts, or sizes) don't differ beyond the radius: an equi-join on the first."""
    left = tiles.select(F.col("tile").alias("a"), F.col("path").alias("path_a"), F.col("n").alias("n_a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence(F.col("low")[0] - radius, F.col("high")[0] + radius)).alias("q"))
    right = tiles.select(F.col("tile").alias("b"), F.col("path").alias("path_b"), F.col("n").alias("n_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(F.col("low")[0], F.col("high")[0])).alias("q"))
    gap = [F.greatest(F.col("low_a")[i] - F.col("high_b")[i], F.col("low_b")[i] - F.col("high_a")[i], F.lit(0)) for i in range(parts)]
    pairs = left.join(right, "q").filter((F.col("a") <= F.col("b")) & (sum(gap[1:], gap[0]) <= radius))
    return pairs.select("a", "b", "path_a", "path_b", "n_a", "n_b").distinct()


def links(distinct: DataFrame, radius: int, uri: str, n: int, width: int = 1, shingles: int = 0) -> DataFrame:
    """Edges (a, b) between keys whose components are those of all links within the radius.

    With a number of ``shingles`` the rows have stored sets, and links are pairs with similar sets only.
    """
    tiles = make_tiles(distinct, uri, n, width, shingles)
    pairs = S.written(tile_pairs(tiles, 1, 1) if width > 1 else tile_pairs(tiles, radius), f"{uri}/pairs")

    def run(batches):
        import pyarrow as pa

        S.forget()
        for batch in batches:
            for row in batch.to_pylist():
                keys, size_a, a = _load(row["path_a"], width)
                size_b, b = size_a, None
                sets = [Sets(_load_sets(row["path_a"]), size_a)] * 2 if shingles else None
                if row["a"] != row["b"]:
                    more, size_b, b = _load(row["path_b"], width)
                    keys = np.concatenate([keys, more])
                    if shingles:
                        sets[1] = Sets(_load_sets(row["path_b"]), size_b)
                forest = Forest(len(keys))
                tile_links(a, b, radius, forest, (size_a, size_b) if width > 1 else None, sets)
                if forest.edges:
                    e = np.array(forest.edges)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[e[:, 0]]), pa.array(keys[e[:, 1]])], names=["a", "b"])
        if shingles:  # the worker stays: what it read goes
            _load_sets.cache_clear()
            S.trim()

    tasks = max(8, 4 * int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Dealt by a number of their own, so that no task gets a tile's pairs only.
    dealt = pairs.repartition(tasks, F.xxhash64("a", "b"))
    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, uri: str, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node reachable) of every node with an edge, by contraction.

    In each round every node points at the smallest node in its neighbourhood; pointers are
    followed once; edges move on to the pointers' ends, where most become loops or equal.
    Each round is a written table, so a lost executor costs a round's tasks at most.
    """
    spark = edges.sparkSession
    now = S.written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), f"{uri}/edges-0")
    label, k = None, 0
    while S.row_count(now):
        k += 1
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        point = S.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), f"{uri}/point-{k}")
        up = point.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        point = S.written(point.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), f"{uri}/jump-{k}")
        if label is None:
            label = point
        else:
            next_ = point.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            label = label.join(next_, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
            label = S.written(label, f"{uri}/label-{k}")
        for end in ("a", "b"):
            to = point.select(F.col("node").alias(end), F.col("root").alias(f"to_{end}"))
            now = now.join(to, end, "left").withColumn(end, F.coalesce(f"to_{end}", end)).drop(f"to_{end}")
        now = S.written(now.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), f"{uri}/edges-{k}")
        S.drop(f"{uri}/edges-{k - 1}", f"{uri}/point-{k}", *([f"{uri}/jump-{k}", f"{uri}/label-{k - 1}"] if k > 2 else []))
    if label is None:
        return spark.createDataFrame([], "node long, root long")
    return label


def similar_sets(distinct: DataFrame, candidates: DataFrame, radius: int, uri: str, width: int) -> DataFrame:
    """Edges whose components are those of all pairs within the radius with similar sets.

    A spanning forest of candidates names every text that has one; those texts' sets are compared
    tile by tile again, because a forest of confirmed pairs isn't part of a forest of candidates.
    """
    found = S.written(candidates.select("a", "b"), f"{uri}/candidates")
    keys = found.select(F.col("a").alias("key")).union(found.select("b")).distinct()
    sets = S.written(distinct.join(keys, "key", "left_semi").select("key", "size", "fps", "stored.path", "stored.at"), f"{uri}/sets")
    total = sets.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).first()
    if not total["n"]:
        return found
    return links(sets, radius, f"{uri}/confirmed", total["n"], width, total["shingles"])


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, seed: int = SEED, width: int = 1, repeats: bool = True) -> DataFrame:
    """doc_id, fp (the first 64 bits) and component_id (the smallest doc_id reachable by links) of every row.

    Wide fingerprints of sets (no repeats) within the radius are candidates only; links are
    those whose sets have a Jaccard similarity of RATIO or more.
    """
    uri = S.shared_dir(docs.sparkSession)
    exact = width > 1 and not repeats
    marked = S.written(fingerprints(docs, words, seed, width, repeats, f"{uri}/shingles" if exact else None), f"{uri}/fingerprints")
    stored = [F.min(F.struct("path", "at")).alias("stored")] if exact else []
    distinct = S.written(marked.groupBy("key").agg(F.any_value("fps").alias("fps"), F.any_value("size").alias("size"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), *stored), f"{uri}/distinct")
    edges = links(distinct.select("key", "size", "fps"), radius, uri, S.row_count(distinct), width)
    if exact:
        edges = similar_sets(distinct, edges, radius, uri, width)
    classes = components(edges, uri).select(F.col("node").alias("key"), "root")
    # The tiles have been read and their links are in the classes.
    S.drop(*[f"{uri}/{t}" for t in ("shingles", "tiles", "candidates", "sets", "confirmed")])
    rooted = distinct.select("key", "least", "n").join(classes, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = S.written(rooted.join(least, "root").select("key", "component_id", "n"), f"{uri}/classes")
    # Copies share a key: those of a hot one (the empty text, say) stay where they are.
    return S.join_keys(marked, of, ["key"], "n", S.row_count(marked), few=FEW_KEYS).select("doc_id", F.col("fps")[0].alias("fp"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(S.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, that with the smallest doc_id.

    The stage takes sets of five-word shingles of a similarity of 0.8 and more; wide fingerprints find
    the candidates.  A row without a doc_id stays: nothing names its
    group; rows that repeat a doc_id stay or go together.
    """
    inner, back = S.aside(docs, "doc_id", "text")
    found = near_duplicates(inner, WIDE_RADIUS, words=5, width=WIDE, repeats=False)
    keep = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_keep")).distinct()
    kept = inner.join(keep, F.col("doc_id").cast("long") == F.col("_keep"), "left_semi")
    return back(kept.union(inner.filter(F.col("doc_id").isNull())))


ORACLE_SQL = None
