"""WARC archives: writing with revisits and segments, reading with reassembly.

A page becomes a `response` record whose block is an HTTP response in chunked
transfer framing, or a `revisit` record if an equal payload is held by a record
with a smaller id. A block over segment_bytes goes on in `continuation` records,
which name the first record in WARC-Segment-Origin-ID; the last one states
WARC-Segment-Total-Length. Records are gzip members, archives are files in the
folder that driver and executors share, and a manifest table lists the files of
the task attempts that succeeded, so files of lost attempts are never read.

Reading parses each archive as a stream. Segments are dealt out by their origin,
sorted by number and joined; then the total length is verified, the framing is
decoded and the digest is compared.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import join_hot, materialise, new_path, texts

DATE = "2024-01-01T00:00:00Z"
SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 32_768, 8_192, 64_000_000


class BadArchive(ValueError):
    """An archive that breaks the format, or whose lengths or digests don't agree."""


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[a : a + size]), p) for a in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def decode_chunked(data: bytes) -> bytes:
    """Undoes chunked transfer framing; extensions and trailers are allowed."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        m = re.fullmatch(rb"\s*([0-9A-Fa-f]+)\s*(?:;.*)?", data[at:end], re.S) if end >= 0 else None
        if not m:
            raise BadArchive("no chunk size where one is due")
        n = int(m[1], 16)
        if not n:
            break
        a, at = end + 2, end + 2 + n
        if data[at : at + 2] != b"\r\n":
            raise BadArchive("a chunk doesn't end where its size says")
        out.append(data[a:at])
        at += 2
    if data[end + 2 : end + 4] != b"\r\n" and not data[end + 2 :].endswith(b"\r\n\r\n"):
        raise BadArchive("the framing isn't closed")
    return b"".join(out)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def clean_header(value) -> str:
    """A header value is one line."""
    return re.sub(r"[\r\n]+", " ", str(value))


def page_records(page_id, url, payload: bytes, digest: str, refers_to, name: str, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """All records of a page; name makes the record ids."""
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    common = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", clean_header(url or "about:blank"))]
    if page_id is not None:
        common.append(("Page-ID", str(page_id)))
    common.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    kind = ("Content-Type", "application/http;msgtype=response")
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield record([("WARC-Type", "revisit"), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-ID", str(refers_to)), kind], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + encode_chunked(payload)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *common, kind], block)
        return
    yield record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1"), kind], block[:segment])
    for k, a in enumerate(range(segment, len(block), segment), 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if a + segment >= len(block) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{k}')}>"), ("WARC-Date", DATE), ("WARC-Target-URI", clean_header(url or "about:blank")), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k)), *last], block[a : a + segment])


def members(stream, read: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time."""
    unpacker, out = zlib.decompressobj(31), []
    while data := stream.read(read):
        while data:
            out.append(unpacker.decompress(data))
            data = b""
            if unpacker.eof:
                data = unpacker.unused_data
                yield b"".join(out)
                unpacker, out = zlib.decompressobj(31), []
    if any(out):
        raise BadArchive("the archive ends within a record")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block."""
    end = data.find(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise BadArchive("no WARC record where one is due")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    block = data[end + 4 : end + 4 + n]
    if len(block) != n or data[end + 4 + n :] != b"\r\n\r\n":
        raise BadArchive("a record's length isn't what it says")
    return headers, block


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise BadArchive("no HTTP header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[:end].decode("latin-1").split("\r\n")[1:])}
    body = block[end + 4 :]
    return headers, decode_chunked(body) if "chunked" in headers.get("transfer-encoding", "").lower() else body


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _writer(folder: str, segment: int, most: int):
    def write(batches):
        from pyspark import TaskContext

        at = TaskContext.get()
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out, name, size, files, row = None, "", 0, [], 0
        for batch in batches:
            ids, urls, shas, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for page, url, payload, sha, to in zip(ids, urls, texts(batch.column(2)), shas, refers, strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                if out is None:
                    name = f"part-{at.partitionId()}-{at.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
                    out, size = store.open_output_stream(f"{base}/{name}", compression=None), 0
                for data in page_records(page, url, payload, digest, to, f"{folder}/{at.partitionId()}/{row}", segment):
                    out.write(data)
                    size += len(data)
                row += 1
                if size >= most:
                    out.close()
                    out = files.append((name, size))
        if out is not None:
            out.close()
            files.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in files], pa.string()), pa.array([s for _, s in files], pa.int64())], names=["path", "bytes"])

    return write


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all pages and returns the manifest: path, bytes.

    Of equal payloads of at least least_bytes bytes the smallest id is a
    response; rows with a larger or no id revisit it. Rows that repeat that id
    are responses too. A null payload is empty, a null url about:blank.
    """

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    held = materialise(rows.groupBy("sha").agg(F.min(F.when(F.octet_length("payload") >= least_bytes, F.col("page_id"))).alias("first"), F.count("*").alias("k")), "first")
    # Only digests whose first record others may revisit take part in the join.
    several = held.where("k > 1 and first is not null")
    roles = join_hot(rows, several, ["sha"], "k", held.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0], "left")
    roles = roles.select("page_id", "url", "payload", "sha", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))
    return materialise(roles.mapInArrow(_writer(folder, segment_bytes, archive_bytes), "path string, bytes long"), "manifest")


_READ = "origin string, number long, total long, page_id long, url string, digest string, record_type string, refers_to long, n long, block binary"


def _reader(batches):
    fields = [f.split() for f in _READ.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    number = lambda h, k: int(h[k]) if k in h else None

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])

    for files in batches:
        for path in files.column(0).to_pylist():
            store, at = _open(path)
            rows, held = [], 0
            with store.open_input_stream(at, compression=None) as stream:
                for data in members(stream):
                    h, block = parse_record(data)
                    kind, digest = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    head = (number(h, "page-id"), h.get("warc-target-uri"), digest)
                    if kind == "continuation":
                        row = (h["warc-segment-origin-id"], int(h["warc-segment-number"]), number(h, "warc-segment-total-length"), None, None, None, None, None, None, block)
                    elif "warc-segment-number" in h:
                        row = (h["warc-record-id"], 1, None, *head, kind, None, None, block)
                    elif kind == "revisit":
                        row = (h["warc-record-id"], 0, None, *head, kind, number(h, "refers-to-page-id"), int(http_payload(block)[0]["content-length"]), None)
                    else:
                        row = (h["warc-record-id"], 0, None, *head, kind, None, _checked(block, digest), None)
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= 2000 or held > 8_000_000:
                        yield batch(rows)
                        rows, held = [], 0
            yield batch(rows)


def _checked(block: bytes, digest: str | None) -> int:
    payload = http_payload(block)[1]
    if digest is not None and payload_digest(payload) != digest:
        raise BadArchive("a payload isn't what its digest says")
    return len(payload)


def join_segments(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """(number, total length if last, block) in order of number; all must be there."""
    if [n for n, _, _ in parts] != list(range(1, len(parts) + 1)):
        raise BadArchive(f"segments {[n for n, _, _ in parts]} don't follow from 1")
    block = b"".join(b for _, _, b in parts)
    if parts[-1][1] != len(block):
        raise BadArchive(f"segments have {len(block)} bytes, {parts[-1][1]} are due")
    return block


def _assemble(batches):
    """Rows come sorted by origin and number; an origin may span batches."""
    names = ["page_id", "url", "digest", "record_type", "refers_to", "n"]
    parts, head, origin = [], None, None

    def done():
        if head is None:
            raise BadArchive(f"continuations of {origin} without a first segment")
        return (*head[:4], None, _checked(join_segments(parts), head[2]))

    def batch(rows, schema):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(n).type) for i, n in enumerate(names)], names=names)

    schema = None
    for b in batches:
        schema, rows = b.schema, []
        for r in b.to_pylist():
            if r["origin"] != origin:
                if origin is not None:
                    rows.append(done())
                parts, head, origin = [], None, r["origin"]
            if r["number"] == 1:
                head = tuple(r[n] for n in names)
            parts.append((r["number"], r["total"], r["block"]))
        yield batch(rows, schema)
    if origin is not None:
        yield batch([done()], schema)


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, digest, record_type, refers_to, n (payload bytes) of each archived page.

    Raises if a segment is missing or doubled, or a length or digest is wrong.
    """
    tasks = max(1, 4 * manifest.sparkSession.sparkContext.defaultParallelism)
    files = manifest.select("path").repartition(tasks, "path")
    read = materialise(files.mapInArrow(_reader, _READ), "records")
    names = ["page_id", "url", "digest", "record_type", "refers_to", "n"]
    whole = read.where("number = 0").select(*names)
    parts = read.where("number > 0")
    joined = materialise(parts.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(_assemble, "page_id long, url string, digest string, record_type string, refers_to long, n long"), "joined")
    return whole.unionByName(joined)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archives all pages in the shared folder and reports what the archives hold."""
    manifest = write_archives(pages, new_path(pages.sparkSession, "warc"), **options)
    return read_archives(manifest).select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
