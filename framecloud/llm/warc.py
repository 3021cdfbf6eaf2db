"""WARC archives: writing by tasks, and a reader that splits files by bytes.

Each record is a gzip member of its own. A reading task takes a byte range, scans
it for the gzip magic, accepts a candidate only if it decodes to a WARC header,
and owns the records that start inside its range, following the last one beyond
the end. The writer makes sure that no member holds a second candidate.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framecloud.llm.storage import attempt_name, open_input, open_output, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
#: Bytes of a range that one task scans.
SPLIT_BYTES = 32 << 20
#: A file is closed once it has this size.
FILE_BYTES = 1 << 30
READ_BYTES = 1 << 20
FEED_BYTES = 1 << 14
#: Payloads below this size are never deduplicated.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, bytes bigint, records bigint"
RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def member(data: bytes) -> bytes:
    """One gzip member without an inner member that a scan could take for a record.

    Stored blocks keep bytes as they are, so an archive inside a page could show
    up; Huffman coding alone, then other levels, breaks it up.
    """
    for level, strategy in ((6, zlib.Z_DEFAULT_STRATEGY), (6, zlib.Z_HUFFMAN_ONLY), (1, zlib.Z_DEFAULT_STRATEGY), (9, zlib.Z_FIXED)):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31, 9, strategy)
        packed = packer.compress(data) + packer.flush()
        at = packed.find(MAGIC, 1)
        while at > 0 and not is_record(packed[at : at + 512]):
            at = packed.find(MAGIC, at + 1)
        if at < 0:
            return packed
    raise ValueError("a record could not be packed without an inner record")


def is_record(head: bytes) -> bool:
    """Whether bytes at a magic decode to the start of a WARC header."""
    try:
        return zlib.decompressobj(31).decompress(head, len(VERSION)) == VERSION
    except zlib.error:
        return False


def one_line(text: str) -> str:
    return "".join(c for c in text if c not in "\r\n")


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, when: str) -> bytes:
    """The bytes of one record; a revisit carries the HTTP head alone."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        body += payload
    sha = base64.b32encode(hashlib.sha256(body).digest()).decode()
    name = lambda i: f"<urn:page:{i}>"
    head = [
        VERSION.decode(),
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name('null' if page_id is None else page_id)}",
        f"WARC-Date: {when}",
        *([f"WARC-Target-URI: {one_line(url)}"] if url else []),
        f"WARC-Block-Digest: sha256:{sha}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (html in UTF-8), digest, record_type and refers_to.

    Of rows with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the
    smallest page_id is the response and the others revisit it; rows that repeat
    that id, and groups without any id, are all responses. A null html is an empty
    payload. Only digests that occur twice reach the join, which splits hot ones.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    narrow = rows.where(F.length("payload") >= REVISIT_BYTES).groupBy("digest")
    first = narrow.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Dealt anew, the small side leaves the join an exchange of its own, so a hot digest can be split.
    joined = rows.join(first.select("digest", "first").hint("rebalance"), "digest", "left")
    revisit = (F.length("payload") >= REVISIT_BYTES) & (
        F.col("first") < F.coalesce(F.col("page_id"), F.lit(2**63 - 1))
    )
    revisit = F.coalesce(revisit, F.lit(False))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, when: datetime | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per page and return the manifest: path, bytes, records.

    Takes the rows of ``with_record_types``. Each task appends to files of its own
    and starts a new one beyond ``file_bytes``. An empty table gives no file.
    """
    stamp = (when or datetime(2000, 1, 1, tzinfo=UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        part = TaskContext.get().partitionId()
        sink, path, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for at in range(batch.num_rows):
                r = {n: batch.column(k)[at].as_py() for k, n in enumerate(batch.schema.names)}
                if sink is None:
                    path, size, count = attempt_name(folder, part, ".warc.gz"), 0, 0
                    sink = open_output(path)
                packed = member(record(r["page_id"], r["url"], r["payload"], r["digest"], r["record_type"], r["refers_to"], stamp))
                sink.write(packed)
                size, count = size + len(packed), count + 1
                if size >= file_bytes:
                    sink.close()
                    done.append((path, size, count))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((path, size, count))
        if done:
            columns = zip(*done, strict=True)
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)],
                names=["path", "bytes", "records"],
            )

    return written(pages.mapInArrow(run, MANIFEST), f"{folder}/manifest")


class Window:
    """Bytes of a file from an offset on, read in pieces and dropped once passed."""

    def __init__(self, file, start: int) -> None:
        self.file, self.start = file, start
        self._held, self._at = b"", 0
        file.seek(start)

    def need(self, size: int) -> bool:
        """Whether ``size`` more bytes are there; reads on as needed."""
        while len(self._held) - self._at < size:
            piece = self.file.read(READ_BYTES)
            if not piece:
                return False
            self._held, self._at = self._held[self._at :] + piece, 0
        return True

    def peek(self, size: int) -> bytes:
        return self._held[self._at : self._at + size]

    def skip(self, size: int) -> None:
        self._at += size
        self.start += size

    def to_magic(self) -> bool:
        """Go to the next magic; False at the end of the file."""
        while self.need(len(MAGIC)):
            found = self._held.find(MAGIC, self._at)
            if found >= 0:
                self.skip(found - self._at)
                return True
            self.skip(len(self._held) - self._at - len(MAGIC) + 1)
        return False


def inflate(window: Window) -> Iterator[bytes]:
    """Decoded pieces of the member at the window's start; leaves the window behind it."""
    unpacker = zlib.decompressobj(31)
    while not unpacker.eof:
        if not window.need(1):
            raise ValueError("an archive ends inside a record")
        fed = window.peek(FEED_BYTES)
        data = unpacker.decompress(fed, READ_BYTES)
        window.skip(len(fed) - len(unpacker.unconsumed_tail) - len(unpacker.unused_data))
        if data:
            yield data


def parse(pieces: Iterator[bytes], payload: bool) -> dict:
    """Header fields of a record with the size and digest of its payload.

    The payload streams through the digest; it is kept only if asked for.
    """
    head = b""
    for piece in pieces:
        head += piece
        if b"\r\n\r\n" in head:
            break
    lines, _, rest = head.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in lines.decode().split("\r\n")[1:])
    left = int(fields["Content-Length"])
    kept, size, digest, http = [], 0, hashlib.sha256(), b""
    opened = False
    while True:
        rest, left = rest[:left], left - len(rest[:left])
        if not opened:
            http += rest
            start = http.find(b"\r\n\r\n")
            opened = start >= 0
            rest = http[start + 4 :] if opened else b""
        digest.update(rest)
        size += len(rest)
        if payload:
            kept.append(rest)
        rest = next(pieces, None)
        if rest is None:
            break
    if left:
        raise ValueError(f"record {fields['WARC-Record-ID']} is cut short")
    return fields | {"size": size, "sha": digest.hexdigest(), "payload": b"".join(kept)}


def records(file, start: int, end: int, payload: bool = False) -> Iterator[dict]:
    """Records whose first byte lies in [start, end)."""
    window = Window(file, start)
    while window.start < end and window.to_magic() and window.start < end:
        window.need(512)
        if is_record(window.peek(512)):
            pieces = inflate(window)
            yield parse(pieces, payload)
            for _ in pieces:  # what follows the block belongs to the member
                pass
        else:
            window.skip(1)


def page_number(urn: str | None) -> int | None:
    text = (urn or "").removesuffix(">").rpartition(":")[2]
    return int(text) if text.lstrip("-").isdigit() else None


def splits(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, start and end of every byte range, spread over tasks."""
    starts = F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint")))
    ranges = manifest.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    end = F.least(F.col("start") + split_bytes, F.col("bytes"))
    return ranges.select("path", "start", end.alias("end")).repartition("path", "start")


def read_archives(ranges: DataFrame, payload: bool = False) -> DataFrame:
    """One row per record that starts in a range, optionally with its payload.

    A response's digest is computed from its bytes and must equal its header; a
    revisit has both figures from its header. A damaged record raises.
    """
    schema = RECORD + (", payload binary" if payload else "")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with open_input(r["path"]) as file:
                    rows = []
                    held = 0
                    for f in records(file, r["start"], r["end"], payload):
                        kind = f["WARC-Type"]
                        said = f["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and said != f["sha"]:
                            raise ValueError(f"{r['path']}: record {f['WARC-Record-ID']} has another digest")
                        size = f["size"] if kind == "response" else int(f["WARC-Payload-Length"])
                        row = (page_number(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), kind, size, said, page_number(f.get("WARC-Refers-To")))
                        rows.append((*row, f["payload"]) if payload else row)
                        held += len(f["payload"])
                        if len(rows) >= 5000 or held > 8 * READ_BYTES:
                            yield batch_of(rows, payload)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows, payload)

    return ranges.mapInArrow(run, schema)


def batch_of(rows: list[tuple], payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payload
    names = [f.split()[0] for f in RECORD.split(", ")] + ["payload"] * payload
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
