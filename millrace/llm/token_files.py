"""Token-id files with bit- or byte-plane shuffled, zstandard-compressed chunks.

A file holds the ids of a run of documents in ascending ``doc_id`` order::

    MRTOKEN1 | chunk 0 | chunk 1 | ... | footer (zstd) | footer size u64 | MRTOKEN1

Each chunk is a block of ``chunk_ids`` ids (the last may be shorter), transposed into 4
byte planes or 32 bit planes, each plane compressed by itself (a plane of zeros takes no
bytes).  The footer holds the chunk index (offset, ids, plane sizes, crc32) and the
documents' ids and lengths, so any range of ids can be read by decoding only its chunks.

Defined results: a null text is the empty text (only the end id); null ``doc_id`` come
first; rows of one ``doc_id`` go by a hash of their texts; repeated rows are written once each,
and may be in several files; a text of any length is encoded whole; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import _shared as S

MAGIC = b"MRTOKEN1"
#: Ids in a chunk: 256 KB before compression.
CHUNK_IDS = 65_536
#: Bytes of input to a file, about, as Spark estimates them; there are as many files as shuffle partitions at least.
FILE_BYTES = 256_000_000

MANIFEST = "part int, path string, n_docs long, n_ids long, n_bytes long"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block of ids; a plane of zeros is empty."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        rows = np.ascontiguousarray(octets.T)
    elif planes == "bit":
        rows = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        raise ValueError(f"planes is 'byte' or 'bit', not {planes!r}")
    return [row.tobytes() if row.any() else b"" for row in rows]


def from_planes(rows: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "byte":
        octets = np.zeros((4, n), np.uint8)
        for i, row in enumerate(rows):
            if row:
                octets[i] = np.frombuffer(row, np.uint8)
        return np.ascontiguousarray(octets.T).view("<u4").reshape(-1)
    bits = np.zeros((32, n), np.uint8)
    for i, row in enumerate(rows):
        if row:
            bits[i] = np.unpackbits(np.frombuffer(row, np.uint8), count=n, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").reshape(-1)


def file_chunks(documents: Iterable[tuple[int | None, bytes]], planes: str, chunk_ids: int, totals: dict) -> Iterator[bytes]:
    """The bytes of a file, chunk by chunk; ``documents``: ids as little-endian u32 bytes."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    index, keys, lengths, waiting, size, at, n_ids = [], [], [], [], 0, len(MAGIC), 0
    yield MAGIC

    def chunk(raw: bytes) -> bytes:
        rows = [press.compress(row) if row else b"" for row in to_planes(np.frombuffer(raw, "<u4"), planes)]
        body = b"".join(rows)
        index.append([at, len(raw) // 4, zlib.crc32(raw), *map(len, rows)])
        return body

    full = 4 * chunk_ids
    for key, raw in documents:
        keys.append(key)
        lengths.append(len(raw) // 4)
        n_ids += len(raw) // 4
        waiting.append(raw)
        size += len(raw)
        if size >= full:
            joined = b"".join(waiting)
            for start in range(0, size - size % full, full):
                body = chunk(joined[start : start + full])
                at += len(body)
                yield body
            waiting, size = [joined[size - size % full :]], size % full
    if size:
        body = chunk(b"".join(waiting))
        at += len(body)
        yield body
    footer = press.compress(json.dumps({"planes": planes, "chunk_ids": chunk_ids, "chunks": index, "docs": keys, "lengths": lengths}).encode())
    totals |= {"n_docs": len(keys), "n_ids": n_ids, "n_bytes": at + len(footer) + 8 + len(MAGIC)}
    yield footer + struct.pack("<Q", len(footer)) + MAGIC


class TokenFile:
    """Random access to a file's ids through its chunk index."""

    def __init__(self, uri: str) -> None:
        import zstandard

        self.unpress = zstandard.ZstdDecompressor()
        fs, path = S.open_fs(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), end - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} isn't a whole token file")
        (n,) = struct.unpack("<Q", tail[:8])
        footer = json.loads(self.unpress.decompress(self.file.read_at(n, end - 8 - len(MAGIC) - n)))
        self.planes, self.chunk_ids, self.chunks = footer["planes"], footer["chunk_ids"], footer["chunks"]
        self.doc_ids, self.lengths = footer["docs"], footer["lengths"]

    def chunk(self, k: int) -> np.ndarray:
        at, n, crc, *sizes = self.chunks[k]
        body, rows = self.file.read_at(sum(sizes), at), []
        for size in sizes:
            rows.append(self.unpress.decompress(body[:size]) if size else b"")
            body = body[size:]
        ids = from_planes(rows, n, self.planes)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the file, from the chunks that hold them."""
        first, last = start // self.chunk_ids, (start + n - 1) // self.chunk_ids
        if n <= 0:
            return np.zeros(0, "<u4")
        ids = np.concatenate([self.chunk(k) for k in range(first, last + 1)])
        return ids[start - first * self.chunk_ids :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """Each document's id, place in the file and ids' bytes; holds two chunks and a document."""
        held, k, at = b"", 0, 0
        for key, n in zip(self.doc_ids, self.lengths):
            parts, size = [held], len(held)
            while size < 4 * n:
                parts.append(self.chunk(k).tobytes())
                size += len(parts[-1])
                k += 1
            joined = b"".join(parts) if len(parts) > 1 else held
            yield key, at, joined[: 4 * n]
            held, at = joined[4 * n :], at + n


def write_token_files(
    docs: DataFrame,
    uri: str,
    tokenizer: str,
    spaced: bool = True,
    end_id: int | None = 2,
    planes: str = "byte",
    chunk_ids: int = CHUNK_IDS,
    files: int | None = None,
) -> DataFrame:
    """Writes ``docs`` (doc_id, text) below ``uri``; returns the committed manifest with each file's first id's place.

    Documents are dealt by ranges of ``doc_id`` (then a hash of the text, then the row's place,
    so that no id or copy is one task's): equal shares at any size, one shuffle of the texts.  A task names its file by a fresh uuid; only files in the manifest, which
    Spark commits as a table, count, so repeated attempts leave nothing that is read.
    """
    spark = docs.sparkSession
    docs = S.pick(docs, "doc_id", "text")
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), S.estimated_bytes(docs) // FILE_BYTES)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = S.memo(tokenizer, spaced)
        end = b"" if end_id is None else struct.pack("<I", end_id)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def documents():
            for batch in (b for own in ([first], batches) for b in own):
                for part in S.slices(batch, 1):
                    for key, raw in zip(part.column(0).to_pylist(), encode(part.column(1))):
                        yield key, raw + end

        part, totals = TaskContext.get().partitionId(), {}
        name = f"{uri}/tokens/part-{part:06d}-{uuid.uuid4().hex}.mrt"
        S.write_blob(name, file_chunks(documents(), planes, chunk_ids, totals))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], **{k: pa.array([v], pa.int64()) for k, v in totals.items()}})

    order = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_row"))
    rows = order.repartitionByRange(files, "doc_id", "_h", "_row").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    manifest = S.written(rows.mapInArrow(write, MANIFEST), f"{uri}/manifest")
    # One row a file: the running sum is over as many rows as there are files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (if asked for) ids, little-endian u32 bytes, of every document in the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def read(batches):
        import pyarrow as pa

        types = [pa.int64()] * 4 + [pa.binary()] * with_ids
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(types)]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                for key, at, raw in TokenFile(row["path"]).documents():
                    held.append((key, row["first"] + at, len(raw) // 4, zlib.crc32(raw), *([raw] if with_ids else [])))
                    size += len(raw) if with_ids else 100
                    if size > 8_000_000:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "first").repartition(tasks).mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, S.shared_dir(spark), S.tokenizer_path("byte_bpe_50k.json"))
    return read_token_files(manifest, with_ids=False)
