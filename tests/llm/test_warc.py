from __future__ import annotations

import hashlib
import io
import struct

import pytest
import zstandard

from lumencat.llm import warc

PAGES = "page_id long, url string, html string, digest string, payload int"


def _pages(spark):
    body = "<p>" + "ab" * 60
    rows = [
        (5, "http://a/é b\r\nX: y", body, "d", 1), (3, "http://b", body, None, None), (9, None, body, None, None), (9, None, body, None, None),
        (None, "http://n", body, None, None), (1, "http://s", "short", None, None), (2, "http://t", "short", None, None),
        (4, None, None, None, None), (6, "u", "", None, None), (7, "u", "é" * 50, None, None), (8, "u", "é" * 50, None, None),
        (10, "u", "x" * 3_000_000, None, None), (11, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20, None, None),
    ]
    return spark.createDataFrame(rows, PAGES)


def brute(rows):
    out = []
    for r in rows:
        payload = (r.html or "").encode()
        same = [x.page_id for x in rows if (x.html or "").encode() == payload and x.page_id is not None]
        again = len(payload) >= 100 and same and r.page_id != min(same)
        out.append((r.page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("archive_bytes", [1, 1 << 28])
def test_round_trip(spark, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    pages = _pages(spark)
    got = warc.read(spark, warc.write(pages)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(pages.collect())
    stored = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert all(stored[r.page_id] == (r.html or "") for r in pages.collect() if r.page_id in (1, 2, 3, 4, 6, 7, 10, 11))


def test_empty(spark):
    assert warc.read(spark, warc.write(spark.createDataFrame([], PAGES))).collect() == []


def _record(payload=b"x" * 200, **other):
    digest = hashlib.sha256(payload).hexdigest()
    return warc.record(1, "http://a", payload, other.get("size", len(payload)), other.get("digest", digest), other.get("refers_to"))


def test_wrong_records():
    assert warc.parse(_record())["payload_bytes"] == 200
    good = _record()
    for bad in (
        _record(size=199), _record(digest="0" * 64), good[:-1], good + b"x", b"WARC/9" + good, good.replace(b"WARC-Date", b"WARC-Type"),
        good.replace(b"WARC-Record-ID", b"X-Record-ID"), good.replace(b"WARC-Type: response", b"WARC-Type: other"), b"",
    ):
        with pytest.raises(ValueError):
            warc.parse(bad)


@pytest.mark.parametrize("packed", [False, True])
def test_frames(packed):
    records = [f"record {k} with words that repeat, {k * 7}".encode() * 9 for k in range(300)]
    learnt = zstandard.train_dictionary(2048, records)
    content = zstandard.ZstdCompressor().compress(learnt.as_bytes()) if packed else learnt.as_bytes()
    squeeze = zstandard.ZstdCompressor(dict_data=learnt)
    archive = struct.pack("<II", 0x184D2A5D, len(content)) + content + b"".join(map(squeeze.compress, records[:5]))
    archive += struct.pack("<II", 0x184D2A50, 3) + b"abc" + b"".join(map(squeeze.compress, records[5:]))
    assert list(warc.frames(io.BytesIO(archive))) == records
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(archive[:-3])))
    plain = zstandard.ZstdCompressor()
    assert list(warc.frames(io.BytesIO(plain.compress(b"one") + plain.compress(b"")))) == [b"one", b""]
    assert list(warc.frames(io.BytesIO(b""))) == []
