"""Operator 10, WARC archives compressed with Zstandard (.warc.zst), written and read.

An archive starts with a skippable frame that holds the dictionary, then has one frame for each record. The writer fits
a dictionary to the first records of each archive (at most ``DICT_SAMPLES``) and rolls over to a new archive when one
is large; it stores a payload once and writes revisit records for its repeats. The reader loads the dictionary from the
leading frame, decodes a frame at a time, and checks version, headers, lengths and digests of every record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_weight, make_folder, new_path, scratch

SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
#: Bounds of the sample that a dictionary is fitted to: records, bytes of each, and the dictionary's own size.
DICT_SAMPLES, SAMPLE_BYTES, DICT_BYTES = 64, 16 << 10, 16 << 10
#: An archive is closed once it has so many compressed bytes.
ARCHIVE_BYTES = 256 << 20
PIECE = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, payload_digest: str | None = None) -> bytes:
    """The bytes of a response or revisit record. A revisit has the HTTP headers, with the full length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'null' if page is None else page}>", f"WARC-Date: {date}"]
    if url is not None:
        clean = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        head.append(f"WARC-Target-URI: {clean}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:x-page:{refers_to}>")
    head += [
        f"WARC-Payload-Digest: sha1:{payload_digest or digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def fit_dictionary(samples: list[bytes]):
    """A dictionary for the samples, or None if they are too few or too short for one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, [s[:SAMPLE_BYTES] for s in samples])
    except zstandard.ZstdError:
        return None


class Archive:
    """Writes one archive to a stream. The first records wait until the dictionary is fitted to them."""

    def __init__(self, stream):
        self.stream, self.waiting, self.compressor, self.bytes, self.records = stream, [], None, 0, 0

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def _start(self) -> None:
        import zstandard

        fitted = fit_dictionary(self.waiting)
        if fitted is not None:
            body = zstandard.ZstdCompressor(level=9).compress(fitted.as_bytes())
            self._put(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=fitted, write_checksum=True, write_content_size=True)
        for r in self.waiting:
            self._put(self.compressor.compress(r))
        self.waiting = []

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compressor:
            self._put(self.compressor.compress(data))
        else:
            self.waiting.append(data)
            if len(self.waiting) == DICT_SAMPLES:
                self._start()

    def close(self) -> None:
        if not self.compressor:
            self._start()
        self.stream.close()


def frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive, one after the other; memory holds one of them."""
    import zstandard

    fitted, data = None, stream.read(8)
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", data[4:])[0]
        body = stream.read(size)
        if len(body) != size:
            raise ValueError("the dictionary frame is cut off")
        if body[:4] == FRAME:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        fitted, data = zstandard.ZstdCompressionDict(body), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=fitted)
    while True:
        data = data or stream.read(PIECE)
        if not data:
            return
        if len(data) < 4:
            data += stream.read(PIECE)
        if data[:4] != FRAME:
            raise ValueError("no Zstandard frame where a record must start")
        one, out = decompressor.decompressobj(), []
        while True:
            out.append(one.decompress(data))
            if one.eof:
                data = one.unused_data
                break
            data = stream.read(PIECE)
            if not data:
                raise ValueError("the last frame is cut off")
        yield b"".join(out)


def _headers(raw: bytes, what: str) -> tuple[str, dict[str, str]]:
    first, *rest = raw.decode("utf-8", "surrogatepass").split("\r\n")
    out = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed {what} header {line!r}")
        out[name.lower()] = value.strip()
    return first, out


def _page(uri: str) -> int | None:
    if not (uri.startswith("<urn:x-page:") and uri.endswith(">")):
        raise ValueError(f"not a page's record id: {uri}")
    return None if uri == "<urn:x-page:null>" else int(uri[12:-1])


def parse(data: bytes) -> dict:
    """Check a record and take it apart; ValueError says what is wrong with it."""
    head, gap, body = data.partition(b"\r\n\r\n")
    version, h = _headers(head, "WARC")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in h:
            raise ValueError(f"header {name} is missing")
    length = int(h["content-length"])
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length} doesn't fit a record of {len(body)} bytes")
    http, gap, payload = body[:length].partition(b"\r\n\r\n")
    status, fields = _headers(http, "HTTP")
    if not gap or not status.startswith("HTTP/") or "content-length" not in fields:
        raise ValueError("the block is not an HTTP response")
    full, kind, stated = int(fields["content-length"]), h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != full:
            raise ValueError(f"a payload of {len(payload)} bytes, {full} stated")
        if digest(payload) != stated:
            raise ValueError("the payload doesn't have the stated digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in h:
        raise ValueError(f"not a proper {kind} record")
    return {
        "page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": kind, "payload_bytes": full, "payload_digest": stated,
        "refers_to": _page(h["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def _open(uri: str, mode: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri.removeprefix("file:")
    uri = uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri  # the name that Arrow knows it by
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path) if mode == "w" else system.open_input_stream(path)


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with ``first_id``: the least page_id with the same payload, null if there's no other row."""
    src = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("sha1_", F.sha1(F.col("html").cast("binary")))
    same = scratch(
        src.filter(F.octet_length("html") >= min_bytes)
        .groupBy("sha1_")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n_same"))
        .filter("n_same > 1"),
        "same-payload",
    )
    total = same.agg(F.sum("n_same")).first()[0] or 0
    return join_by_weight(src, same, ["sha1_"], "n_same", total)


def write_archives(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of ``pages``; (path, records, bytes) of each archive of the tasks that succeeded.

    ``path`` is a folder that all executors reach (default: in the shared folder). Archives of tasks that were lost or
    tried twice aren't in the returned table, which is the only list of what counts. Of rows with equal payloads of at
    least ``min_bytes`` bytes, that with the least page_id is a response and the others revisit it; rows that repeat
    the least id are responses, too, and so are rows whose payload has no page_id at all. A null payload is empty, a
    null url is left out, a null page_id is written as such. An empty table gives no archives.
    """
    spark = pages.sparkSession
    folder = make_folder(spark, path or new_path(spark, "warc"))
    src = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, archive, done = uuid.uuid4().hex, 0, None, []

        def close() -> None:
            archive.close()
            done.append((name, archive.records, archive.bytes))

        for b in batches:
            for page, target, text, sha, first in zip(*(b.column(c) for c in ("page_id", "url", "html", "sha1_", "first_id"))):
                page, first, payload = page.as_py(), first.as_py(), text.as_py().encode("utf-8", "surrogatepass")
                revisit = first is not None and page != first
                if archive is None:
                    name = f"{folder}/{task}-{n:05d}.warc.zst"
                    archive, n = Archive(_open(name, "w")), n + 1
                known = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                archive.add(record("revisit" if revisit else "response", page, target.as_py(), payload, first, date, known))
                if archive.bytes >= archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*done)], names=["path", "records", "bytes"])

    return scratch(mark_revisits(src, min_bytes).mapInArrow(run, "path string, records long, bytes long"), "archives")


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives listed in the column ``path``, with the payloads (responses only) if asked for.

    An archive is read by one task, in pieces. A malformed record raises ValueError with the archive's path.
    """
    schema = RECORD + (", payload binary" if payloads else "")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                try:
                    with _open(path, "r") as stream:
                        for data in frames(stream):
                            r = parse(data)
                            held += len(r["payload"] or b"") if payloads else 0
                            rows.append(r if payloads else r | {"payload": None})
                            if len(rows) == 4096 or held > 16 << 20:
                                yield batch(rows)
                                rows, held = [], 0
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                if rows:
                    yield batch(rows)

    n = archives.count()
    return archives.select("path").repartition(max(1, n)).mapInArrow(run, schema)
