"""WARC archives in Zstandard, a frame for each record.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary
- itself in a Zstandard frame -, then one frame for each record, compressed with it.
The reader takes the dictionary from that frame, decodes frame by frame (memory: one
record), and checks of every record the version, the required headers, Content-Length,
the closing line breaks and the digests of block and payload.

Of rows with equal payloads of at least `least` bytes, the smallest page id is a
response and the others are revisits of it: only HTTP headers, whose Content-Length
and payload digest are still those of the full payload.

Defined cases: null html is an empty payload; a null url is empty, control characters
in it are percent-encoded; rows that repeat with the smallest id are all responses; a
null id is written empty, never chosen for reference, and read as null; an empty table
gives no archives; very long pages are one record each, and one of them is held at a time;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.cluster import MAP_BITS, bitmap, column, fresh_dir, in_map, tasks, written

MAGIC = 0x184D2A5D
LEAST = 100
#: The dictionary is fitted on the rows with the smallest id hashes: so many, so many characters of each.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 8192, 32768
#: A new archive is begun beyond so many bytes.
ARCHIVE_BYTES = 32 << 20
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
DATE = "2000-01-01T00:00:00Z"
OUT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def dictionary(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> bytes:
    """A dictionary fitted on a bounded sample; empty where the sample is too small for one."""
    # A hash bound leaves about twice as many rows as are wanted, so that tasks send only those.
    most = 1 << 30
    bound = min(most, 1024 + 2 * SAMPLE_ROWS * most // max(1, pages.count()))
    h = F.shiftrightunsigned(F.xxhash64(id_col, F.lit(9)), 34)
    rows = pages.where((h < bound) & (F.length(html_col) > 0)).select(h.alias("h"), F.substring(html_col, 1, SAMPLE_CHARS).alias("s"))
    samples = [r["s"].encode() for r in rows.orderBy("h", "s").limit(SAMPLE_ROWS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def leading_frame(trained: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=9).compress(trained) if trained else b""
    return struct.pack("<II", MAGIC, len(body)) + body


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """The record of a page: a response, or a revisit of another page."""
    return framed(page_id, url, payload if refers_to is None else b"", len(payload), hashlib.sha256(payload).hexdigest(), refers_to, date)


def framed(page_id: int | None, url: str, kept: bytes, size: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A record of a payload of `size` bytes and this digest, of which `kept` (all, or of a revisit nothing) follows."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + kept
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    safe = "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", safe),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields, all checked; ValueError tells what is wrong."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"bad WARC record: {what}")

    end = raw.find(b"\r\n\r\n")
    need(raw.startswith((b"WARC/1.1\r\n", b"WARC/1.0\r\n")) and end > 0, "no version line or header end")
    head: dict[str, str] = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        key, colon, value = line.decode().partition(":")
        need(bool(colon) and key.lower() not in head, f"header line {line[:40]!r}")
        head[key.lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        need(key in head, f"no {key}")
    need(head["content-length"].isdigit(), "Content-Length")
    size, body = int(head["content-length"]), raw[end + 4 :]
    need(len(body) == size + 4 and body.endswith(b"\r\n\r\n"), "length")
    block = body[:size]
    if "warc-block-digest" in head:
        need(head["warc-block-digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}", "block digest")
    http, blank, payload = block.partition(b"\r\n\r\n")
    need(bool(blank), "no HTTP header end")
    lengths = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    need(len(lengths) == 1 and lengths[0].isdigit(), "HTTP Content-Length")
    kind, digest = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        need(len(payload) == int(lengths[0]), "payload length")
        need(digest == hashlib.sha256(payload).hexdigest(), "payload digest")
    else:
        need(kind == "revisit" and not payload and "warc-refers-to" in head, "type")
    number = lambda x: int(y) if (y := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": number(head["warc-record-id"]), "url": head.get("warc-target-uri", ""), "payload_bytes": int(lengths[0]), "payload_digest": digest, "record_type": kind, "refers_to": number(head["warc-refers-to"]) if kind == "revisit" else None}


def records(source) -> Iterator[bytes]:
    """The raw records of an archive, read from a binary stream frame by frame."""
    head = source.read(8)
    if len(head) < 8:
        raise ValueError("bad archive: shorter than its leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != MAGIC:
        raise ValueError("bad archive: it doesn't start with a dictionary frame")
    body = source.read(size)
    if len(body) != size:
        raise ValueError("bad archive: its dictionary frame is cut off")
    if body.startswith(b"\x28\xb5\x2f\xfd"):
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) if body else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        frame, parts = decoder.decompressobj(), []
        chunk = rest or source.read(1 << 16)
        if not chunk:
            return
        while True:
            parts.append(frame.decompress(chunk))
            if frame.eof:
                rest = frame.unused_data
                break
            chunk = source.read(1 << 16)
            if not chunk:
                raise ValueError("bad archive: its last frame is cut off")
        yield b"".join(parts)


def marked(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html (null for revisits), payload_bytes, payload_digest, refers_to (null for responses).

    What is shuffled is ids, addresses and digests: they make the revisits, whose records
    need no payload. Pages stay where they are. A bitmap of the revisits' ids and digests
    says which pages may be revisits, a second one which of those may be none; pages that
    are in both are told by a join, all others need none.
    """
    html = F.coalesce(column(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        column(id_col).cast("long").alias("page_id"), F.coalesce(column(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"),
    )
    slim = written(rows.where(F.col("payload_bytes") >= least).drop("html"), "warc-digests")
    # Only digests that occur twice are joined; a hot one is split by adaptive skew joins.
    first = slim.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    again = F.col("refers_to").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("refers_to")))
    revisits = written(slim.join(first, "payload_digest").where(again).select("page_id", "url", "payload_bytes", "payload_digest", "refers_to"), "warc-revisits")
    null = F.col("page_id").isNull()
    known = {"_id": F.coalesce("page_id", F.lit(0).cast("long")), "_null": null}
    key = ["payload_digest", "_id", "_null"]
    marks = revisits.withColumns(known).select(*key).distinct()
    bits = {f"_{k}": F.pmod(F.xxhash64(F.col("page_id"), F.col("payload_digest"), F.lit(k)), F.lit(MAP_BITS)) for k in (1, 2)}
    maps = [bitmap(F.col("_1"), revisits.withColumns(bits))]
    shared = pages.sparkSession.sparkContext.broadcast(maps[0])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_map(shared.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))))

    doubtful = slim.withColumns(bits).select("page_id", "payload_digest", "_2", "_1").mapInArrow(hits, "page_id long, payload_digest string, _2 long, _1 long")
    maps.append(bitmap(F.col("_2"), doubtful.withColumns(known).join(marks, key, "left_anti")))
    both = pages.sparkSession.sparkContext.broadcast(maps)

    def part(certain: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size, one, two = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5, 6))
                may = (size >= least) & in_map(both.value[0], one)
                rows = np.flatnonzero(~may if certain else may & in_map(both.value[1], two))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([c if len(rows) == batch.num_rows else c.take(pa.array(rows)) for c in batch.columns[:5]], batch.schema.names[:5])

        return rows.withColumns(bits).mapInArrow(run, "page_id long, url string, html string, payload_bytes long, payload_digest string")

    told = part(False).withColumns(known).join(marks, key, "left_anti")
    names = ["page_id", "url", "html", "payload_bytes", "payload_digest"]
    responses = part(True).union(told.select(*names)).withColumn("refers_to", F.lit(None).cast("long"))
    return responses.union(revisits.select("page_id", "url", F.lit(None).cast("string").alias("html"), "payload_bytes", "payload_digest", "refers_to"))


def write(rows: DataFrame, folder: str, trained: bytes = b"", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of `marked` as archives under folder; path and records of each.

    Names are new in each attempt of a task, and the result is a written table, so an
    archive of a lost or repeated task is never listed.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdCompressor(level=3)
        out, path, n, done = None, "", 0, []
        for batch in batches:
            for page_id, url, html, size, digest, refers_to in zip(*(batch.column(i) for i in range(6))):
                if out is None:
                    path, n = f"{base}/{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(path)
                    out.write(leading_frame(trained))
                out.write(packer.compress(framed(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), size.as_py(), digest.as_py(), refers_to.as_py())))
                n += 1
                if out.tell() >= archive_bytes:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], ["path", "records"])

    # A batch holds BATCH_BYTES, or one page that is longer.
    conf, limits = rows.sparkSession.conf, {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: conf.get(k) for k in limits}
    for k, v in limits.items():
        conf.set(k, str(v))
    try:
        listed = rows.mapInArrow(put, "path string, records long")
        return written(listed.repartition(1 + tasks(rows.sparkSession) // 64), "warc-list")  # a row for each archive: a few files
    finally:
        for k, v in before.items():
            conf.set(k, v)


def read(archives: DataFrame, folder: str) -> DataFrame:
    """The checked records of archives (column path), one task for a few archives."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in OUT.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in OUT.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[dict] = []
                with store.open_input_stream(path) as source:
                    for raw in records(source):
                        rows.append(parse(raw))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    return archives.select("path").repartition(tasks(archives.sparkSession), "path").mapInArrow(get, OUT)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    folder = fresh_dir(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    elif folder.startswith("file:/") and not folder.startswith("file://"):
        folder = f"file://{folder.removeprefix('file:')}"
    return read(write(marked(pages), folder, dictionary(pages)), folder)
