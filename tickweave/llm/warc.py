"""WARC archives: one gzip member per record, revisits of equal payloads, and a reader that salvages what is left of broken files."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import shared_folder, slices, written
from tickweave.llm.files import attempt_name, reader, writer

VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
#: payload bytes of one archive, about; the number of archives grows with the pages
ARCHIVE_BYTES = 64 << 20
#: bytes read at a time
CHUNK = 1 << 20
#: where a header must have ended, and a record's length must fit; beyond, bytes are taken for damage
HEADER_MOST, RECORD_MOST = 4 << 20, 1 << 31
_DATE = "2020-01-01T00:00:00Z"  # pages have no fetch time


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", uri)
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not yet compressed. A revisit has the payload's digest and length, not the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_uri(page_id)}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {page_uri(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, least_payload: int = 0, key: str = "page_id", url: str = "url", html: str = "html", compress: bool = True) -> DataFrame:
    """Write every page; returns the manifest, written itself: path, records.

    Of pages with equal payloads of at least `least_payload` bytes that with the largest key is a response and the others revisit
    it. Equal payloads are found by their SHA-1 on narrow rows; pages then meet their response in a join that can be split where
    many pages have one payload. Null html: empty payload. Null key: a response of its own. Rows that repeat a key and payload: one of
    them can't be told from the other, so all of that key are responses. Empty table: an empty manifest.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    first = rows.filter(F.length("payload") >= least_payload).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("page_id").alias("n"))
    placed = rows.join(first.filter("n > 1").select(F.col("sha").alias("same"), "first"), F.col("sha") == F.col("same"), "left")
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, records, number = None, 0, 0, 0
        done: list[tuple[str, int]] = []
        for batch in slices(batches):
            for page_id, link, payload, first_, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = attempt_name(folder, f"-{number:04d}.warc" + ".gz" * compress)
                    out = writer(path)
                    sink = out.__enter__()
                raw = record(page_id, link, payload, first_, again)
                if compress:
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = member.compress(raw) + member.flush()
                sink.write(raw)
                size, records = size + len(payload), records + 1
                if size >= ARCHIVE_BYTES:
                    out.__exit__(None, None, None)
                    done.append((path, records))
                    out, size, records, number = None, 0, 0, number + 1
        if out is not None:
            out.__exit__(None, None, None)
            done.append((path, records))
        if done:
            yield pa.record_batch({"path": pa.array([p for p, _ in done]), "records": pa.array([n for _, n in done])})

    manifest = placed.select("page_id", "url", "payload", "first", revisit.alias("again")).mapInArrow(write, "path string, records long")
    return written(manifest, "archives")


class Salvage:
    """Records of a stream of bytes, with the gaps that held none.

    `records()` yields ("record", offset, header, block) and ("gap", offset, length, reason). A record is taken if its header is
    whole, its block has the announced length and digest, and two line ends follow; for compressed files also if the member
    inflates and its checksum fits. After a failed check the reader looks for the next place where a member or a version line
    begins and tries there; what lies between is a gap.
    """

    def __init__(self, source):
        self.source, self.held, self.at, self.ended = source, bytearray(), 0, False

    def _fill(self, n: int) -> bool:
        while len(self.held) < n and not self.ended:
            more = self.source.read(CHUNK)
            self.ended = not more
            self.held += more
        return len(self.held) >= n

    def _drop(self, n: int) -> None:
        del self.held[:n]
        self.at += n

    def records(self) -> Iterator[tuple]:
        gap, reason = None, ""
        while self._fill(1):
            found, why = self._try()
            if found is not None:
                if gap is not None:
                    yield ("gap", gap, self.at - gap, reason)
                    gap = None
                header, block, length = found
                yield ("record", self.at, header, block)
                self._drop(length)
                continue
            if gap is None:
                gap, reason = self.at, why
            self._seek()
        if gap is not None:
            yield ("gap", gap, self.at - gap, reason)

    def _seek(self) -> None:
        """On to the next byte where a record may begin."""
        start = 1
        while True:
            self._fill(start + CHUNK)
            places = [p for p in (self.held.find(GZIP, start), self.held.find(VERSION[:5], start)) if p >= 0]
            if places:
                return self._drop(min(places))
            if self.ended:
                return self._drop(len(self.held))
            start = max(1, len(self.held) - 4)
            self._drop(start - 1)
            start = 1

    def _try(self) -> tuple[tuple[dict[str, str], bytes, int] | None, str]:
        self._fill(5)
        if self.held.startswith(GZIP):
            return self._member()
        if self.held.startswith(VERSION[:5]):
            return self._plain()
        return None, "no record begins here"

    def _member(self):
        inflate, raw, used = zlib.decompressobj(31), bytearray(), 0
        try:
            while not inflate.eof:
                if not self._fill(used + 1):
                    return None, "member is cut off"
                piece = bytes(self.held[used : used + CHUNK])
                # no more than tells that it is too much, whatever a few bytes unpack to
                raw += inflate.decompress(piece, RECORD_MOST + 1 - len(raw))
                used += len(piece)
                if len(raw) > RECORD_MOST:
                    return None, "member is too long"
        except zlib.error as e:
            return None, f"member is broken: {e}"
        used -= len(inflate.unused_data)
        parsed, why = _parse(bytes(raw))
        if parsed is None:
            return None, why
        header, block, length = parsed
        return ((header, block, used), "") if length == len(raw) else (None, "member holds more than a record")

    def _plain(self):
        end = -1
        while end < 0:
            end = self.held.find(b"\r\n\r\n")
            if end < 0 and (len(self.held) > HEADER_MOST or not self._fill(len(self.held) + 1)):
                return None, "header doesn't end"
        length = _length(_fields(bytes(self.held[:end])))
        if length is None:
            return None, "header has no length"
        if not self._fill(end + 4 + length + 4):
            return None, "record is cut off"
        return _parse(bytes(self.held[: end + 4 + length + 4]))


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0], **{k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines[1:]) if colon}}


def _length(header: dict[str, str]) -> int | None:
    text = header.get("content-length", "")
    return int(text) if re.fullmatch(r"\d{1,10}", text) and int(text) <= RECORD_MOST else None


def _parse(raw: bytes):
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None, "header doesn't end"
    header = _fields(raw[:end])
    length = _length(header)
    if not re.fullmatch(r"WARC/\d+\.\d+", header[""]) or length is None or "warc-type" not in header or "warc-record-id" not in header:
        return None, "header is broken"
    block, tail = raw[end + 4 : end + 4 + length], raw[end + 4 + length : end + 8 + length]
    if len(block) != length or tail != b"\r\n\r\n":
        return None, "length doesn't fit"
    named = header.get("warc-block-digest")
    if named is not None and named != f"sha1:{digest(block)}":
        return None, "digest doesn't fit"
    return (header, block, end + 8 + length), ""


READ = (
    "path string, offset long, kind string, page_id long, url string, record_type string, refers_to long, payload binary, "
    "payload_bytes long, payload_digest string, gap_bytes long, reason string"
)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records (`kind` record) and quarantined stretches (`kind` gap, with gap_bytes and reason) of the archives in `path`.

    One task per file, read in pieces. A revisit has no payload; its length and digest are those that its headers give.
    """
    tasks = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with reader(path) as source:
                    rows, size = [], 0
                    for item in Salvage(source).records():
                        rows.append(_row(path, item))
                        size += len(rows[-1]["payload"] or b"")
                        if size > 8 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema(
        [(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in READ.split(", "))]
    )
    return manifest.select("path").repartitionByRange(tasks, "path").mapInArrow(read, READ)


def _row(path: str, item: tuple) -> dict:
    if item[0] == "gap":
        return {"path": path, "offset": item[1], "kind": "gap", "gap_bytes": item[2], "reason": item[3]}
    _, offset, header, block = item
    head, _, payload = block.partition(b"\r\n\r\n")
    again = header["warc-type"] == "revisit"
    length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
    return {
        "path": path, "offset": offset, "kind": "record", "page_id": page_of(header["warc-record-id"]), "url": header.get("warc-target-uri"),
        "record_type": header["warc-type"], "refers_to": page_of(header.get("warc-refers-to", "")), "payload": None if again else payload,
        "payload_bytes": int(length[1]) if again and length else len(payload),
        "payload_digest": header.get("warc-payload-digest", "").removeprefix("sha1:") if again else digest(payload),
    }
