"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

Writer: a gzip member per record (HTTP response blocks), in archives that end once they have
``ARCHIVE_BYTES``.  Of records with equal payloads of at least ``least_bytes`` bytes, that with
the largest page_id is a response and the others are revisits of it.  Reader: archives are
read in windows; every member or record is checked (gzip trailer, version line, header
fields, lengths, payload digest).  After a failed check it goes to the end that the record
states, if another record or the archive's end is there, or else looks for the next valid gzip
member or version line; it recovers the records from there on, and gives the bytes between as
a gap.  What it finds inside the stated length of a damaged record is marked ``doubtful``: it
may be part of that record's payload.  Nothing that an archive holds makes the reader fail.

Defined results: null html is the empty payload; a null url has no target URI (control
characters are percent-encoded); a null page_id is smaller than all others and reads back
as null; rows that share the largest page_id of their payload are all responses; payloads of
any length are written whole; an empty table gives no records; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import logging
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _shared as S

#: An archive is closed once it has as many bytes.
ARCHIVE_BYTES = 64_000_000
#: Bytes that are read at once, and the most that a record's headers take.
WINDOW, HEADERS = 4_000_000, 65_536
DATE = "2024-01-01T00:00:00Z"
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: The end of the headers, or a version line where none may be.
HEADERS_END = re.compile(rb"\r\n(?:(\r\n)|WARC/1\.[01]\r\n)")
NUMBER = re.compile(r"[0-9]{1,18}", re.ASCII)
MANIFEST = "path string, n_records long, n_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]{1,18})>", name or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A record's bytes, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=-._~"))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes | None
    payload_bytes: int
    doubtful: bool = False

    @property
    def payload_digest(self) -> str:
        return self.headers.get("warc-payload-digest", "").rpartition(":")[2]


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Damaged(ValueError):
    """A record fails a check.

    ``stop``: its end, where it is known for certain; ``stated``: the end that its headers state.
    """

    def __init__(self, reason: str, stop: int | None = None, stated: int | None = None) -> None:
        super().__init__(reason)
        self.stop, self.stated = stop, stated


class Cut(Damaged):
    """The bytes end before the record does."""


def _fields(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        if line:
            key, sep, value = line.decode("utf-8", "replace").partition(":")
            if not sep:
                raise Damaged("a header line has no colon")
            out[key.strip().lower()] = value.strip()
    return out


def _number(text: str | None) -> int:
    if not NUMBER.fullmatch(text or ""):
        raise Damaged("a length is no number")
    return int(text)


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes | None, int, int]:
    """The record at a place: its headers, HTTP headers, payload, the payload's size, and its end; Damaged if a check fails."""
    m = VERSION.match(raw, at)
    if not m:
        raise Damaged("no version line")
    end = HEADERS_END.search(raw, m.end() - 2, m.end() + HEADERS)
    if not end:
        if len(raw) >= m.end() + HEADERS:
            raise Damaged("the headers have no end")
        raise Cut("the headers have no end")
    if not end[1]:
        raise Damaged("another record starts in the headers")
    headers = _fields(raw[m.end() : end.start()])
    start = end.end()
    stop = start + _number(headers.get("content-length"))
    if stop + 4 > len(raw):
        raise Cut("the block doesn't end where its length says", stated=stop + 4)
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("the block doesn't end where its length says", stated=stop + 4)
    # From here on the record's end is certain if something starts there, or nothing is left.
    sure = stop + 4 if START.match(raw, stop + 4) or stop + 4 == len(raw) else None
    try:
        block = raw[start:stop]
        http: dict[str, str] = {}
        payload: bytes | None = block
        if headers.get("content-type", "").startswith("application/http"):
            head, sep, payload = block.partition(b"\r\n\r\n")
            if not sep:
                raise Damaged("the HTTP headers have no end")
            http = _fields(head.partition(b"\r\n")[2])
        size = len(payload)
        if headers.get("warc-type") == "revisit":
            payload, size = None, _number(http.get("content-length", "0"))
        elif "warc-payload-digest" in headers and headers["warc-payload-digest"].rpartition(":")[2] != digest(payload):
            raise Damaged("the payload doesn't have its digest")
    except Damaged as e:
        raise Damaged(str(e), sure, stop + 4) from None
    return headers, http, payload, size, stop + 4


def _unpacked(data: bytes, at: int) -> tuple[bytes, int]:
    """A gzip member's content and its end."""
    # Few bytes at first, then more: what is read beyond the member's end is copied for nothing.
    unpress, step, place = zlib.decompressobj(31), 256, at + 256
    try:
        parts = [unpress.decompress(data[at:place], 10)]
        if len(parts[0]) == 10 and not VERSION.match(parts[0]):
            raise Damaged("a member without a version line")
        parts.append(unpress.decompress(unpress.unconsumed_tail))
        while not unpress.eof and place < len(data):
            step = min(4 * step, WINDOW)
            parts.append(unpress.decompress(data[place : place + step]))
            place += step
    except zlib.error as e:
        raise Damaged(f"member: {e}") from None
    if not unpress.eof:
        raise Cut("the member is cut off")
    return b"".join(parts), min(place, len(data)) - len(unpress.unused_data)


def _record(data: bytes, at: int) -> Record:
    if not data.startswith(MEMBER, at):
        *found, stop = parse(data, at)
        return Record(at, stop - at, *found)
    raw, end = _unpacked(data, at)
    try:
        *found, stop = parse(raw)
    except Damaged as e:  # the member is whole, its record isn't
        raise Damaged(str(e), end) from None
    if stop != len(raw):
        raise Damaged("bytes after the member's record", end)
    return Record(at, end - at, *found)


class _Window:
    """The part of an archive that is being read; ``at`` is the place in it, ``base`` what was before it."""

    def __init__(self, read: Callable[[int], bytes]) -> None:
        self.read, self.data, self.base, self.at = read, b"", 0, 0

    def more(self) -> bool:
        """Forgets what is done and reads on, twice as much each time for a record that isn't whole."""
        got = self.read(max(WINDOW, len(self.data) - self.at))
        if got:
            self.data, self.base, self.at = self.data[self.at :] + got, self.base + self.at, 0
        return bool(got)

    def record(self) -> Record:
        while True:
            try:
                one = _record(self.data, self.at)
                one.offset += self.base
                return one
            except Cut:
                if not self.more():
                    raise

    def search(self) -> bool:
        """Goes on to the next place where a record may start."""
        while True:
            m = START.search(self.data, self.at + 1)
            if m:
                self.at = m.start()
                return True
            self.at = max(self.at, len(self.data) - 10)
            if not self.more():
                return False


def salvage(source: bytes | Callable[[int], bytes]) -> Iterator[Record | Gap]:
    """All valid records of an archive in order, and the gaps between them; the source is its bytes or reads so many more."""
    w = _Window(io.BytesIO(source).read if isinstance(source, bytes) else source)
    while w.at < len(w.data) or w.more():
        try:
            one = w.record()
        except Damaged as e:
            start, stated = w.base + w.at, w.base + (e.stated or 0)
            if e.stop is not None:
                w.at = e.stop
                yield Gap(start, w.base + w.at - start, str(e))
                continue
            one = None
            while one is None and w.search():
                try:
                    one = w.record()
                except Damaged:
                    continue
            end = one.offset if one else w.base + len(w.data)
            yield Gap(start, end - start, str(e))
            if one is None:
                return
            one.doubtful = one.offset < stated
        yield one
        w.at += one.length


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, and ``last``: the page_id to revisit (null for responses)."""
    own = S.pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumn("_d", F.unhex(F.sha1("payload")))
    long_ = own.filter(F.octet_length("payload") >= least_bytes) if least_bytes else own
    groups = long_.groupBy("_d").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = S.written(groups, f"{S.shared_dir(pages.sparkSession)}/groups")
    rows = groups.agg(F.sum("n").alias("n")).first()["n"] or 0
    # Beyond the size of a broadcast the payloads are shuffled by digest, but for hot ones (empty and error pages).
    joined = S.join_keys(own, groups, ["_d"], "n", rows, keep=True)
    again = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    if least_bytes:
        again &= F.octet_length("payload") >= least_bytes
    return joined.select("page_id", "url", "payload", F.when(again, F.col("last")).alias("last"))


def write_archives(pages: DataFrame, uri: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes each partition's records below ``uri``, in archives of about ``archive_bytes``; the committed list of archives."""

    def write(batches):
        import pyarrow as pa

        rows = (row for b in batches for row in zip(*(b.column(i) for i in range(4))))
        waiting = next(rows, None)
        while waiting is not None:
            name, n, size = f"{uri}/warc/{uuid.uuid4().hex}.warc.gz", 0, 0

            def members():
                nonlocal waiting, n, size
                while waiting is not None and size < archive_bytes:
                    page_id, url, payload, last = (x.as_py() for x in waiting)
                    packed = member(record(page_id, url, payload, last, last is not None))
                    n, size, waiting = n + 1, size + len(packed), next(rows, None)
                    yield packed

            S.write_blob(name, members())
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    return S.written(with_revisits(pages, least_bytes).mapInArrow(write, MANIFEST), f"{uri}/archives")


READ = "path string, offset long, length long, gap string, doubtful boolean, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(paths: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record and each gap (``gap``: the reason; null for records) of the archives in column ``path``.

    Gaps are logged, too.  Where ``paths`` has the number of records that were written
    (``n_records``), an archive that gives another number of them is an error.
    """
    counted = "n_records" in paths.columns

    def read(batches):
        import pyarrow as pa

        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if with_payload else [])]
        names = [f.split()[0] for f in READ.split(", ")] + (["payload"] if with_payload else [])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, n = [], 0, 0
                fs, place = S.open_fs(path)
                with fs.open_input_stream(place, compression=None) as source:
                    for x in salvage(source.read):
                        if isinstance(x, Gap):
                            logging.getLogger(__name__).warning("%s: a gap of %d bytes at %d: %s", path, x.length, x.offset, x.reason)
                            row = (path, x.offset, x.length, x.reason, *[None] * 7)
                        else:
                            h, n = x.headers, n + 1
                            row = (path, x.offset, x.length, None, x.doubtful, _page_id(h.get("warc-record-id")), h.get("warc-target-uri"), x.payload_bytes, x.payload_digest, h.get("warc-type"), _page_id(h.get("warc-refers-to")))
                            held += len(x.payload or b"") if with_payload else 0
                        rows.append(row + ((getattr(x, "payload", None),) if with_payload else ()))
                        if len(rows) >= 10_000 or held > 8_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)
                if expected is not None and n != expected:
                    raise ValueError(f"{path} has {n} valid records of {expected}")

    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = paths.select("path", F.col("n_records") if counted else F.lit(None).cast("long").alias("n_records"))
    return own.repartition(tasks).mapInArrow(read, READ + (", payload binary" if with_payload else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(S.table(spark, sf_dir, "pages"), S.shared_dir(spark))
    # A gap is an error here: the number of records is that of the manifest.
    return read_archives(archives).filter("gap IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 of the hexadecimal SHA-1: five digits are four characters.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last, count(*) AS n FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(p.h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN n > 1 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n > 1 AND page_id <> last THEN last END AS refers_to
FROM p JOIN g ON g.h = p.h
"""
