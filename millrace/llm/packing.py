"""Best-fit packing by a configuration linear program over the length histogram.

Documents are encoded, cut into pieces of at most ``capacity`` ids, and packed into
sequences.  Only the histogram of lengths (at most ``capacity`` numbers) reaches the
driver: the configuration program - cover every length's count with as few sequence
layouts as possible - is solved by multiplicative weights, layouts being priced by a
knapsack dynamic program.  Its fullest layouts are rounded to whole numbers, those with the
largest shares first, and the program is solved again for what is left, until some 95 % of the
pieces have their places; the last few are placed by best fit, largest first.  Pieces then
take their places by rank within their length.

Defined results: a null text is the empty text, so only its end id; a text of any length is
cut into pieces, none is dropped; null doc_id and repeated rows are packed like any other,
each row by itself; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import logging
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import _shared as S

CAPACITY = 2048
#: Share of the remaining demand that a layout may take in one round.
STEP = 0.05
ROUNDS = 40
#: Times that the program is solved for what its rounded layouts have left over; share of pieces from which best fit takes the rest.
PASSES, ENOUGH = 8, 0.95
#: How fast a length's price falls as its demand is met.
ETA = 0.02
#: Over 1, so that of equally full layouts those of longer pieces are dearer, and short ones stay for the gaps.
POWER = 1.05
#: Rows of one length that a ranking task takes, about.
RANK_ROWS = 100_000

Layouts = list[tuple[tuple[int, ...], int]]


def price(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the largest value that fits in c; last[c]: a length in such a filling (0: c - 1 is as good)."""
    lengths = np.flatnonzero(values > 0)
    worth = values[lengths]
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = np.searchsorted(lengths, c, side="right")
        if k:
            tries = best[c - lengths[:k]] + worth[:k]
            i = int(tries.argmax())
            if tries[i] > best[c]:
                best[c], last[c] = tries[i], lengths[i]
    return best, last


def filling(last: np.ndarray, c: int) -> list[int]:
    out = []
    while c > 0:
        if last[c]:
            out.append(int(last[c]))
            c -= int(last[c])
        else:
            c -= 1
    return out


def solve_program(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], float]:
    """Fractional layouts that cover nearly all of ``counts``, and the program's lower bound.

    Weights fall exponentially with the share of a length's count that is covered.  In
    each round one dynamic program prices every layout; for each length with demand left,
    longest first, the best layout that holds it takes a step, bounded by the demand of
    all its lengths.  Any prices, scaled to at most 1 for the best layout, bound the
    program from below.
    """
    counts = counts.astype(float)
    total = np.where(counts > 0, counts, 1)
    sizes = np.arange(len(counts))
    left, chosen, bound = counts.copy(), Counter(), float((counts * sizes).sum() / capacity)
    for _ in range(rounds):
        open_ = left > 1e-9
        if not open_.any():
            break
        covered = 1 - left / total
        weights = np.where(open_, (sizes / capacity) ** POWER * np.exp(ETA * (covered[open_].mean() - covered)), 0.0)
        best, last = price(weights, capacity)
        bound = max(bound, float((counts * weights).sum() / best[capacity]))
        for n in np.flatnonzero(open_)[::-1]:
            if left[n] <= 1e-9:
                continue
            layout = Counter([int(n), *filling(last, capacity - int(n))])
            step = min(left[m] / k if m == n else STEP * total[m] / k for m, k in layout.items())
            step = min(step, max(STEP * total[n] / layout[int(n)], 1.0), min(left[m] / k for m, k in layout.items()))
            if step <= 1e-9:
                continue
            chosen[tuple(sorted(layout.elements(), reverse=True))] += step
            for m, k in layout.items():
                left[m] -= k * step
    return dict(chosen), bound


def best_fit(counts: np.ndarray, capacity: int) -> Layouts:
    """Best fit, largest first, on a histogram; equal sequences stay together."""
    spare: dict[int, Counter] = {}  # spare room: layouts and their number
    free = np.zeros(capacity + 1, bool)

    def put(room: int, layout: tuple[int, ...], n: int) -> None:
        spare.setdefault(room, Counter())[layout] += n
        free[room] = True

    for size in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[size])
        while n:
            fits = int(free[size:].argmax()) + size
            if not free[fits]:
                k = capacity // size  # new sequences hold as many of this length as fit
                if n >= k:
                    put(capacity - k * size, (size,) * k, n // k)
                if n % k:
                    put(capacity - n % k * size, (size,) * (n % k), 1)
                break
            layout, have = next(iter(spare[fits].items()))
            take = min(n, have)
            spare[fits][layout] -= take
            if not spare[fits][layout]:
                del spare[fits][layout]
                free[fits] = bool(spare[fits])
            put(fits - size, (*layout, size), take)
            n -= take
    return [(layout, n) for own in spare.values() for layout, n in own.items()]


def rounded(fractional: dict[tuple[int, ...], float], left: np.ndarray, least: int) -> Layouts:
    """Whole numbers of the fullest layouts, the largest shares first, as far as ``left`` has their pieces (it loses them) down to ``least``."""
    out: Layouts = []
    full = max(map(sum, fractional), default=0)
    for layout, x in sorted(fractional.items(), key=lambda t: (-t[1], t[0])):
        if sum(layout) < full:
            continue
        own = Counter(layout)
        n = min([max(1, round(x)), *(int(left[m]) // k for m, k in own.items())])
        if n:
            out.append((layout, n))
            for m, k in own.items():
                left[m] -= k * n
            if left.sum() <= least:
                break
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[Layouts, float, float]:
    """Layouts with whole numbers that hold every piece, the lower bound on their number, and the share of pieces that the program placed."""
    alone = int(counts[capacity]) if len(counts) > capacity else 0
    left = counts.copy()
    left[capacity:] = 0
    total, chosen, bound = int(left.sum()), [], 0.0
    for k in range(PASSES):
        fractional, least = solve_program(left, capacity, rounds)
        bound = least if k == 0 else bound
        new = rounded(fractional, left, int((1 - ENOUGH) * total))
        chosen += new
        if not new or left.sum() <= (1 - ENOUGH) * total:
            break
    share = 1 - left.sum() / total if total else 1.0
    chosen += best_fit(left, capacity)
    return ([((capacity,), alone)] if alone else []) + chosen, alone + bound, float(share)


def places(layouts: Layouts) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks, first sequences, how many in a sequence, and first offsets of its places."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    first = 0
    for layout, n in layouts:
        offset = 0
        for size, k in sorted(Counter(layout).items(), reverse=True):
            rows.setdefault(size, []).append((taken[size], first, k, offset))
            taken[size] += k * n
            offset += k * size
        first += n
    return {size: tuple(np.array(own, np.int64).T) for size, own in rows.items()}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int | None, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, with their ids if asked for. No shuffle."""

    def cut(batches):
        import struct

        import pyarrow as pa

        encode = S.memo(tokenizer, spaced)
        end = b"" if end_id is None else struct.pack("<I", end_id)
        for batch in batches:
            for part in S.slices(batch, 1):
                rows = []
                for key, raw in zip(part.column(0).to_pylist(), encode(part.column(1))):
                    raw += end
                    for i, start in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[start : start + 4 * capacity]
                        rows.append((key, i, start // 4, len(own) // 4, zlib.crc32(own), *([own] if with_ids else [])))
                if rows:
                    cols = list(zip(*rows))
                    arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                    arrays += [pa.array(cols[5], pa.binary())] if with_ids else []
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return S.pick(docs, "doc_id", "text").mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def pack(
    docs: DataFrame,
    tokenizer: str,
    spaced: bool = False,
    end_id: int | None = 0,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Every piece with its sequence_id and offset (and its ids if asked for)."""
    spark = docs.sparkSession
    uri = S.shared_dir(spark)
    # With numbers of their own, so that repeated rows can be told apart and dealt to several tasks.
    cut = S.written(pieces(docs, tokenizer, spaced, end_id, capacity, with_ids).withColumn("_row", F.monotonically_increasing_id()), f"{uri}/pieces")
    # At most `capacity` rows.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    layouts, bound, share = plan(counts, capacity)
    logging.getLogger(__name__).info("%d sequences, %.2f at least; the program placed %.3f of the cut pieces", sum(n for _, n in layouts), bound, share)
    where = places(layouts)
    # Rank within a length, in salted shares: a length that a third of all pieces have is no one task's.
    n = int(counts.sum())
    salts = max(32, 1 << max(0, (n // RANK_ROWS)).bit_length())
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    shares = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_salt").orderBy("_row")
    ranked = salted.withColumn("_rank", F.row_number().over(own))
    if salts * len(histogram) <= 200_000:  # rows of three numbers: some MB
        shares = F.broadcast(shares)
    ranked = ranked.join(shares, ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    names = [*[f.split()[0] for f in PIECES.split(", ")], *(["ids"] if with_ids else [])]

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            rank, size = batch.column("_rank").to_numpy(), batch.column("length").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(size).tolist():
                rows = np.flatnonzero(size == one)
                ranks, firsts, in_each, offsets = where[one]
                i = np.searchsorted(ranks, rank[rows], side="right") - 1
                within = rank[rows] - ranks[i]
                sequence[rows] = firsts[i] + within // in_each[i]
                offset[rows] = offsets[i] + within % in_each[i] * one
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(S.table(spark, sf_dir, "documents"), S.tokenizer_path("word_bpe_49k.json"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the surviving documents' pieces with their places."""
    return pack(docs, S.tokenizer_path("word_bpe_49k.json"))
