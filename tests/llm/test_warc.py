"""Archives: round trip, revisits, and what survives damage."""

import io
import random
import zlib

import pytest

from tests.llm.helpers import SF
from tickweave.llm import queries, warc
from tickweave.llm.warc import Salvage, read_archives, record, write_archives

PAGES = [
    (1, "http://a/ b\n", "<p>same</p>"), (2, None, None), (3, "http://c", ""), (4, "http://d", "<p>same</p>"), (5, "http://e", "é" * 100_000),
    (6, "http://f", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3), (None, "http://g", "<p>same</p>"), (7, "http://h", "alone\r\n\r\n"), (7, "http://h", "alone\r\n\r\n"),
]


def pages(spark, rows):
    full = [(k, u, h, b"x", "y", 1) for k, u, h in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, payload binary, sha string, first int")


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, monkeypatch, compress):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    got = read_archives(write_archives(pages(spark, PAGES).repartition(3), compress=compress)).collect()
    assert all(r.kind == "record" for r in got)
    first = {}
    for k, _, h in PAGES:
        if k is not None:
            first[h or ""] = max(first.get(h or "", k), k)
    want = []
    for k, _, h in PAGES:
        data = (h or "").encode()
        again = k is not None and k != first[h or ""]
        want.append((str(k), len(data), warc.digest(data), "revisit" if again else "response", first[h or ""] if again else None, None if again else data))
    have = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_least_payload(spark):
    rows = read_archives(write_archives(pages(spark, PAGES), least_payload=5)).collect()
    assert {r.page_id: r.record_type for r in rows if r.payload_bytes == 0} == {2: "response", 3: "response"}


@pytest.mark.parametrize("compress", [True, False])
def test_very_long_url(spark, compress):
    url = "http://a/" + "é" * 100_000
    rows = read_archives(write_archives(pages(spark, [(1, url, "x"), (2, "http://b", "y")]), compress=compress)).collect()
    assert {r.page_id: (r.kind, bytes(r.payload)) for r in rows} == {1: ("record", b"x"), 2: ("record", b"y")}
    assert max(len(r.url) for r in rows) >= len(url)


def test_empty(spark):
    assert read_archives(write_archives(pages(spark, []))).count() == 0


def packed(raw, compress):
    if not compress:
        return raw
    member = zlib.compressobj(1, zlib.DEFLATED, 31)
    return member.compress(raw) + member.flush()


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_damage(monkeypatch, compress, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    rng = random.Random(4)
    for _ in range(25):
        parts = [packed(record(i, f"http://x/{i}", bytes(rng.choices(range(256), k=rng.randrange(0, 400))), None, False), compress) for i in range(8)]
        starts = [sum(map(len, parts[:i])) for i in range(9)]
        data = bytearray(b"".join(parts))
        hit = rng.randrange(8)
        kind = rng.choice(["flip", "cut", "insert", "tail"])
        at = rng.randrange(starts[hit], starts[hit + 1])
        if kind == "flip":
            data[at] ^= 0xFF
        elif kind == "cut":
            del data[at : min(starts[hit + 1], at + 9)]
        elif kind == "insert":
            data[starts[hit] : starts[hit]] = b"garbage" * 3
        else:
            data = data[:at]
        found = list(Salvage(io.BytesIO(bytes(data))).records())
        ids = [warc.page_of(f[2]["warc-record-id"]) for f in found if f[0] == "record"]
        whole = range(8) if kind == "insert" else range(hit) if kind == "tail" else [i for i in range(8) if i != hit]
        assert set(whole) <= set(ids)  # a flipped bit that no check covers may leave its record whole
        spans = sorted((f[1], f[2]) for f in found if f[0] == "gap")
        assert all(n > 0 for _, n in spans) and sum(n for _, n in spans) <= len(data)
        if kind == "insert":
            assert spans == [(starts[hit], 21)]


def test_query(spark):
    assert queries.op2_warc(spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()
