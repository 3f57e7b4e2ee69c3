"""WARC archives compressed with Zstandard (operator 9).

An archive may begin with a skippable frame that holds a dictionary; every record is a frame of its
own after it. The writer stores each payload once: of the pages with equal payloads of ``FEWEST``
bytes or more, the smallest page_id has the response record and the others revisit it. Each task
writes archives into the shared folder; which of them count is said by a manifest that Spark commits,
so a task that runs twice does no harm. The reader goes through an archive frame by frame, takes the
dictionary from the leading frame and checks headers, lengths and digests.

Defined cases: a null html is empty; rows that share page_id and payload are each a record, of the
same kind; null page_ids never are what others refer to; an empty table gives an empty manifest;
other columns are ignored. Memory: one record beside the samples of the dictionary.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumencat.sources.storage import fresh_path

FEWEST = 100
DICTIONARY, SAMPLES, SAMPLE_BYTES = 16 << 10, 200, 1 << 20
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
#: The frame numbers of the Zstandard format and of its use for WARC.
_SKIPPABLE, _DICTIONARY_FRAME, _DICTIONARY_MAGIC, _FRAME_MAGIC = 0x184D2A50, 0x184D2A5D, 0xEC30A437, 0xFD2FB528
_END = b"\r\n\r\n"
_CHUNK = 1 << 20


def _uri(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def _page_of(uri: str) -> int | None:
    kind, _, rest = uri.strip("<>").partition("urn:x-page:")
    if kind or not rest:
        raise ValueError(f"not a page: {uri}")
    page = rest.split(":")[0]
    return int(page) if page else None


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record with its headers; a revisit keeps the length and digest of the payload it leaves out."""
    head = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode(), b""]
    block = b"\r\n".join(head) + b"\r\n" + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_uri(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: {_uri(refers_to, digest)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    lines += [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def parse(data: bytes) -> dict:
    """The record in a frame; ValueError where headers, lengths or digests are wrong."""
    head, found, rest = data.partition(_END)
    version, *lines = head.decode("utf-8").split("\r\n")
    if not found or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC record")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in fields:
            raise ValueError(f"a wrong header line: {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    size = int(fields["content-length"])
    if len(rest) != size + len(_END) or rest[size:] != _END:
        raise ValueError(f"a block of {len(rest) - len(_END)} bytes, said to be {size}")
    http, found, payload = rest[:size].partition(_END)
    lengths = [int(line.split(b":", 1)[1]) for line in http.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")]
    if not found or len(lengths) != 1:
        raise ValueError("no HTTP header with a length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    out = {
        "page_id": _page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"], "payload_bytes": lengths[0], "payload_digest": digest,
        "refers_to": None, "payload": None,
    }
    if fields["warc-type"] == "response":
        if len(payload) != lengths[0] or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload that its header does not describe")
        return out | {"payload": payload}
    if fields["warc-type"] != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError(f"a wrong {fields['warc-type']}")
    return out | {"refers_to": _page_of(fields["warc-refers-to"])}


def frames(source) -> Iterator[bytes]:
    """What the frames of an archive hold, one after the other."""
    held, first, dictionary = b"", True, None

    def filled(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            more = source.read(_CHUNK)
            if not more:
                return False
            held += more
        return True

    while filled(4):
        magic = struct.unpack("<I", held[:4])[0]
        if magic & ~0xF == _SKIPPABLE:
            size = struct.unpack("<I", held[4:8])[0] if filled(8) else 0
            if not filled(8 + size):
                raise ValueError("a cut frame")
            content, held = held[8 : 8 + size], held[8 + size :]
            if first and magic == _DICTIONARY_FRAME:
                if struct.unpack("<I", content[:4])[0] == _FRAME_MAGIC:
                    content = zstandard.ZstdDecompressor().decompress(content, max_output_size=1 << 30)
                if struct.unpack("<I", content[:4])[0] != _DICTIONARY_MAGIC:
                    raise ValueError("no dictionary in its frame")
                dictionary = zstandard.ZstdCompressionDict(content)
        else:
            unpack = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            parts = [unpack.decompress(held)]
            while not unpack.eof:
                more = source.read(_CHUNK)
                if not more:
                    raise ValueError("a cut frame")
                parts.append(unpack.decompress(more))
            held = unpack.unused_data
            yield b"".join(parts)
        first = False
    if held:
        raise ValueError("a cut frame")


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples)
    except zstandard.ZstdError:  # too little to learn from
        return None


def with_revisits(pages: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to): the payload only where it is stored."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        html.alias("payload"), F.octet_length(html).cast("long").alias("size"), F.sha2(html, 256).alias("digest"),
    )
    # A row per payload that occurs again; groups are counted before they shuffle.
    shared = rows.where(F.col("size") >= fewest).groupBy(F.col("digest").alias("shared")).agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, F.col("digest") == F.col("shared"), "left").select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "digest",
        F.when(again, F.col("first")).alias("refers_to"),
    )


def write(pages: DataFrame, path: str | None = None) -> str:
    """Write the archives of ``pages`` (page_id, url, html) and their manifest; returns the folder."""
    path = path or fresh_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pyarrow.fs.FileSystem.from_uri(path)
        store.create_dir(f"{root}/archives", recursive=True)
        names, counts, sizes = [], [], []
        sink = None

        def start(samples: list[bytes]):
            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):04d}.warc.zst"
            names.append(name)
            counts.append(0)
            sizes.append(0)
            out = store.open_output_stream(f"{root}/archives/{name}", compression=None)
            learnt = _dictionary(samples)
            if learnt:
                out.write(struct.pack("<II", _DICTIONARY_FRAME, len(learnt.as_bytes())) + learnt.as_bytes())
            return out, zstandard.ZstdCompressor(3, dict_data=learnt, write_checksum=True)

        def put(data: bytes) -> None:
            frame = squeeze.compress(data)
            sink.write(frame)
            counts[-1] += 1
            sizes[-1] += len(frame)

        waiting: list[bytes] = []
        for batch in batches:
            for row in zip(*batch.columns):
                page_id, url, payload, size, digest, refers_to = (v.as_py() for v in row)
                data = record(page_id, url, payload or b"", size, digest, refers_to)
                if sink is None:
                    waiting.append(data)
                    if len(waiting) < SAMPLES and sum(map(len, waiting)) < SAMPLE_BYTES:
                        continue
                    sink, squeeze = start(waiting)
                    for data in waiting:
                        put(data)
                    waiting = []
                else:
                    put(data)
                if sizes[-1] >= ARCHIVE_BYTES:
                    sink.close()
                    sink = None
        if waiting:
            sink, squeeze = start(waiting)
            for data in waiting:
                put(data)
        if sink is not None:
            sink.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    with_revisits(pages).mapInArrow(run, "archive string, records long, bytes long").write.parquet(f"{path}/manifest")
    return path


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of all records."""
    manifest = spark.read.parquet(f"{path}/manifest")
    n = manifest.count()
    kinds = {
        "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(),
        "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(path)

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            columns = [pa.array([None if k == "payload" and not payloads else r[k] for r in rows], kind) for k, kind in kinds.items()]
            return pa.RecordBatch.from_arrays(columns, list(kinds))

        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, seen = [], 0, 0
                with store.open_input_stream(f"{root}/archives/{name}", compression=None) as source:
                    for data in frames(source):
                        try:
                            rows.append(parse(data))
                        except ValueError as wrong:
                            raise ValueError(f"{name}, record {seen}: {wrong}") from wrong
                        seen += 1
                        held += len(data) if payloads else 100
                        if held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{name} has {seen} records and not {records}")
                yield batch_of(rows)

    return manifest.select("archive", "records").repartition(max(1, n)).mapInArrow(
        run,
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary",
    )
