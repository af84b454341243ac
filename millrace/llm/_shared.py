"""Shared storage, written tables and the memoised tokenizer of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import logging
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that a worker remembers with their ids, some 50 bytes each; beyond, those that weren't met lately are forgotten.
MEMO_WORDS = 400_000
#: White space other than single spaces and line feeds between two other characters.
ODD = "[\\t\\x01\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|^[ \\n]|[ \\n]$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting (tests, a single machine) gets a temporary
    folder of its own, which is logged.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or "cluster" in context.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        logging.getLogger(__name__).warning("spark.checkpoint.dir is unset: intermediate tables go to %s", base)
        context.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}" if base.startswith("/") else base
    here = f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"
    atexit.register(_remove, here)
    return here


def _remove(uri: str) -> None:
    """Deletes a folder by Spark's own file system where a session runs, since every scheme is known to that."""
    with contextlib.suppress(Exception):
        spark = SparkSession.getActiveSession()
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return
    with contextlib.suppress(Exception):
        fs, path = open_fs(uri)
        fs.delete_dir(path)


def drop(*uris: str) -> None:
    """Deletes intermediate tables and files that nothing reads any more: all that came of them is written."""
    for uri in uris:
        _remove(uri)


def open_fs(uri: str):
    """File system and path of a URI; works on the driver and on every executor."""
    from pyarrow import fs

    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri)


def write_blob(uri: str, chunks: Iterable[bytes]) -> int:
    """Writes a file whose name no other task attempt uses; returns its size.

    Readers learn names only from a table that Spark committed, so what a lost or
    repeated attempt has left behind is never read.
    """
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    size = 0
    with fs.open_output_stream(path, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    return size


def read_blob(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def written(df: DataFrame, uri: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: lineage ends here."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of a table's size from its files' sizes, without reading it; at most 10 TB."""
    return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 10_000_000_000_000)


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"]


#: Keys that go to every task, some 40 bytes each; more are joined by shuffle.
BROADCAST_KEYS = 500_000
#: From this many rows on a key is hot, or from a 100,000th of all rows on: there are 100,000 hot keys at most.
HOT_ROWS = 100_000


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], n: str, total: int, keep: bool = False, few: int | None = None) -> DataFrame:
    """``rows`` joined with ``keys``, which has each key once and in column ``n`` its number of rows, ``total`` at most in all.

    Few keys go to every task.  Of many the hot ones do, whose number has a bound, and the
    others are joined by shuffle, where no key has more than that share of the rows.  With
    ``keep`` every row stays (a left join).
    """
    if row_count(keys) <= (BROADCAST_KEYS if few is None else few):
        return rows.join(F.broadcast(keys.drop(n)), on, "left" if keep else "inner")
    hot = keys.filter(F.col(n) >= max(HOT_ROWS, total // 100_000)).drop(n)
    if not row_count(hot):  # by shuffle at every size, so that a small run shows what a large one does
        return rows.join(keys.drop(n).hint("merge"), on, "left" if keep else "inner")
    cold = keys.filter(F.col(n) < max(HOT_ROWS, total // 100_000)).drop(n)
    split = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    others = split.filter("_hot IS NULL").select(*rows.columns).join(cold.hint("merge"), on, "left" if keep else "inner")
    return split.filter("_hot").drop("_hot").unionByName(others)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, with exact (case-sensitive) names when a table has clashing ones."""
    own = []
    for name in names:
        same = [c for c in df.columns if c == name] or [c for c in df.columns if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"column {name!r} is missing; there are {df.columns}")
        own.append(same[0])
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(own, names)])
    # Names that differ in case only can't be told apart by Spark: rename all by place.
    at = [df.columns.index(c) for c in own]
    renamed = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names)])


def aside(df: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with only the needed columns' names; all others get names that nothing clashes with.

    The second value puts a result's columns back in their order and under their names, with
    further columns after them.
    """
    at = {}
    for name in needed:
        same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"column {name!r} is missing; there are {df.columns}")
        at[same[0]] = name
    inner = [at.get(i, f"_x{i}") for i in range(len(df.columns))]
    own = list(df.columns)
    return df.toDF(*inner), lambda out, *more: out.select(*[F.col(f"`{c}`") for c in inner], *more).toDF(*own, *[free_name(own, m) for m in more])


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores after it if a column has that name already."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


class WordMemo:
    """Encodes whole texts with a tokenizers file, each distinct space-delimited word once.

    Both supported pre-tokenizers end a token at every single space (or line feed) between
    two other characters, so a text's ids are its words' ids in a row.  Texts for which that
    isn't certain - other or repeated white space, special tokens' strings - are encoded whole.

    ``spaced``: the space belongs to the following word (byte-level BPE); otherwise white
    space is dropped.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        # A task has one core: threads of the library's own would only wait for it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self._start()
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # What goes between words that share a text: it is one token, and in no word.
        self.gap = "\n" if spaced else " \x01 "
        (self.gap_id,) = self.tokenizer.encode(self.gap, add_special_tokens=False).ids

    def _encode(self, texts: Sequence[str]) -> list[bytes]:
        import numpy as np

        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _start(self) -> None:
        """An empty memory: words, their ids in a row, where each word's start, how many they are, and whether it was met lately."""
        import numpy as np
        import pyarrow as pa

        first = ["\n"] if self.spaced else []
        ids = np.frombuffer(self._encode(first)[0], "<u4") if first else np.zeros(0, "<u4")
        self.words, self.flat = pa.array(first, pa.large_string()), ids
        self.lengths = np.array([len(ids)] if first else [], np.int64)
        self.met = np.ones(len(first), bool)

    def _encode_words(self, words: list[str]):
        """The ids of words without white space in a row, and their numbers; many words share a text, with a gap after each."""
        import numpy as np

        gap, flat, lengths = self.gap, [], []
        for at in range(0, len(words), 20_000):
            parts = [words[i : i + 1000] for i in range(at, min(at + 20_000, len(words)), 1000)]
            for part, e in zip(parts, self.tokenizer.encode_batch_fast([gap.join(p) + gap for p in parts], add_special_tokens=False)):
                ids = np.asarray(e.ids, dtype="<u4")
                ends = np.flatnonzero(ids == self.gap_id)
                if len(ends) != len(part):
                    raise ValueError("a word holds the gap")
                flat.append(np.delete(ids, ends))
                lengths.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate(flat), np.concatenate(lengths)

    def __call__(self, texts) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text of a list or Arrow array; null is the empty text."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = (texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())).cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, ODD)
        for mark in self.marks:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        plain = pc.and_(pc.invert(odd), pc.greater(pc.binary_length(texts), 0))
        out = [b""] * len(texts)
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._encode([texts[i].as_py()])[0]  # one at a time: a very long text's offsets are large
        rows = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        if not len(rows):
            return out
        own = texts.filter(plain)
        if self.spaced:
            # Words keep the space before them; line feeds become words of their own.
            own = pc.replace_substring(pc.replace_substring(own, " ", "\t "), "\n", "\t\n\t")
            split = pc.split_pattern(own, "\t")
        else:
            split = pc.split_pattern(pc.replace_substring(own, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        at = self._of(coded.dictionary)[coded.indices.to_numpy()]
        starts = np.cumsum(self.lengths) - self.lengths
        # Each word's ids in a row, without a Python object a word.
        sizes = self.lengths[at]
        ends = np.cumsum(sizes)
        placed = self.flat[np.repeat(starts[at] - (ends - sizes), sizes) + np.arange(ends[-1])]
        edges = np.r_[0, ends][np.asarray(split.offsets) - split.offsets[0].as_py()].tolist()
        for i, a, b in zip(rows.tolist(), edges, edges[1:]):
            out[i] = placed[a:b].tobytes()
        return out

    def _of(self, words):
        """The places of the words (an Arrow array) in the memory, which learns those it hasn't; a word starts with what stands before it."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.words) > MEMO_WORDS:
            keep = self.met.copy()
            self.flat = self.flat[np.repeat(keep, self.lengths)]
            self.words, self.lengths = self.words.filter(pa.array(keep)), self.lengths[keep]
            self.met = np.zeros(len(self.words), bool)
        found = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(found))
        at, n = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64), len(self.words)
        if len(new):
            flat, lengths = self._encode_words(new.to_pylist())
            self.flat, self.lengths = np.r_[self.flat, flat], np.r_[self.lengths, lengths]
            self.words, self.met = pa.concat_arrays([self.words, new]), np.r_[self.met, np.zeros(len(new), bool)]
            at[at < 0] = n + np.arange(len(new))
        self.met[at[at < n]] = True
        return at


_memos: dict[tuple[str, bool], WordMemo] = {}


def memo(path: str, spaced: bool) -> WordMemo:
    """This worker's memoised tokenizer of a file."""
    key = (path, spaced)
    if key not in _memos:
        _memos[key] = WordMemo(path, spaced)
    return _memos[key]


#: Bytes of text that are encoded at once: the more, the fewer distinct words there are to look up.
SLICE_BYTES = 4_000_000


def slices(batch, column: int):
    """Parts of an Arrow batch with about SLICE_BYTES of text in a column."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    edges = np.flatnonzero(part[1:] != part[:-1]) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def forget() -> None:
    """Frees the memories of encoded words that an earlier stage has left in this worker."""
    if _memos:
        _memos.clear()
        trim()


def trim() -> None:
    """Gives memory that Python has freed back to the system."""
    import ctypes
    import gc

    gc.collect()
    with contextlib.suppress(Exception):
        ctypes.CDLL(None).malloc_trim(0)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]
