"""WARC archives: writing, normalising monolithic gzip files, and reading back by index.

A writer may compress a whole archive as one gzip stream; a record in it can't be reached without inflating all before
it. The normaliser inflates such a file once, piece by piece, cuts it into records by their Content-Length, writes
every record as a gzip member of its own to a new file, and each member's record id, offset and length to a sidecar. It
reads and writes streams and holds one record, whatever the archive's size.

Archives are files <name>.warc.gz and <name>.idx in the shared folder, which workers reach through pyarrow's file systems. A file
appears under its name only when it is whole, and only names that a finished task reports are read, so a task that runs again or
twice does no harm. The sidecars are read as text by Spark, which deals their lines over tasks; each line leads to its record by
offset. In a store that pyarrow doesn't know, archives are rows of a table instead (name, content, index), a few megabytes each.

Of records with equal payloads of at least `least` bytes, the one with the largest id is a response and the others are
revisits that refer to it.

Edge cases. A null page is the empty payload. Rows that share the largest id of a payload are responses all. A row with a
null id is a record without a number, a revisit if its payload has a response elsewhere. Null URLs leave their header
out; control characters in URLs are percent-encoded. Pages of any length are records like others. An empty table gives no
archives and no rows. Extra columns are ignored, whatever their names. A file that ends inside a record or isn't gzip raises
ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, scratch, stored

#: Payload bytes of an archive, and of a piece that the inflater takes at a time.
ARCHIVE_BYTES, PIECE = 8 << 20, 1 << 16
#: Payload bytes of an archive file, and plain bytes that the inflater gives at a time.
FILE_BYTES, MOST = 256 << 20, 1 << 20
LEAST = 1000
ARCHIVE = "name string, content binary, index array<struct<record:string,offset:bigint,length:bigint>>"
RECORD = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_URN = "urn:quernel:page:"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"" if kind == "revisit" else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if kind == "revisit" else payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_URN}{'none' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head += [f"Content-Type: application/http; msgtype={kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(data: bytes | Iterable[bytes]) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or more members, piece by piece; the file may come in pieces."""
    z = None
    for chunk in (data[at : at + PIECE] for at in range(0, len(data), PIECE)) if isinstance(data, bytes) else data:
        while chunk:
            z = z or zlib.decompressobj(31)
            try:
                piece = z.decompress(chunk, MOST)
                yield piece
                while len(piece) == MOST and not z.eof:  # more than a piece may lie in what was taken already
                    piece = z.decompress(z.unconsumed_tail, MOST)
                    yield piece
            except zlib.error as e:
                raise ValueError(f"not a gzip stream: {e}") from e
            chunk, z = (z.unused_data, None) if z.eof else (z.unconsumed_tail, z)
    if z is not None:
        raise ValueError("the gzip stream ends early")


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("a record must begin with WARC/")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record of a plain stream; holds one record at a time."""
    held = bytearray()
    need, head = 0, None
    for piece in pieces:
        held += piece
        while True:
            if head is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = headers(bytes(held[:end]))
                need = end + 4 + int(head["content-length"]) + 4
            if len(held) < need:
                break
            yield head, bytes(held[:need])
            del held[:need]
            head = None
    if held:
        raise ValueError("the archive ends inside a record")


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes | Iterable[bytes]) -> Iterator[tuple[str, bytes]]:
    """(record id, gzip member) of each record of a gzip file."""
    for head, whole in records(inflated(data)):
        yield head["warc-record-id"], member(whole)


def normalised(data: bytes) -> tuple[bytes, list[dict]]:
    """One gzip member for each record, and the index of the members."""
    out, index, at = [], [], 0
    for name, packed in members(data):
        out.append(packed)
        index.append({"record": name, "offset": at, "length": len(packed)})
        at += len(packed)
    return b"".join(out), index


def classified(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to). Only digests that repeat are joined back to the pages."""
    pages = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload")})
    lead = pages.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("lead"), F.count("*").alias("n")).where("n > 1").select("digest", "lead")
    revisit = F.col("lead").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("lead")))
    joined = pages.join(lead, "digest", "left")
    return joined.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("lead")).alias("refers_to"))


def _columns(batch: pa.RecordBatch) -> Iterator[bytes]:
    columns = [batch.column(c) for c in ("page_id", "url", "payload", "record_type", "refers_to")]
    for i in range(batch.num_rows):
        yield record(*(c[i].as_py() for c in columns))


def monolithic(classed: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of whole-file gzip, (name, content). The name is a digest of the content, so a task that runs again
    gives the same name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, out, size = None, [], 0

        def closed() -> pa.RecordBatch:
            data = b"".join([*out, z.flush()])
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(data).hexdigest()]), pa.array([data], pa.binary())], names=["name", "content"])

        for batch in batches:
            for raw in _columns(batch):
                if z is None:
                    z, out, size = zlib.compressobj(6, zlib.DEFLATED, 31), [], 0
                out.append(z.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield closed()
                    z = None
        if z is not None:
            yield closed()

    return in_small_batches(classed).mapInArrow(run, "name string, content binary")


def store_of(folder: str):
    """pyarrow's file system for a folder, and the path in it; ArrowInvalid or OSError if it can't reach one."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]://", "s3://", folder)
    return (fs.LocalFileSystem(), uri) if "://" not in uri and not uri.startswith("file:") else fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


@contextmanager
def _whole(store, path: str):
    """A stream to a file that takes the name `path()` once it is whole; what a failed task leaves has no such name."""
    part = f"{path}.part-{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as f:
        yield f
    store.move(part, path)


FILES = "name string, bytes long, records long"


def _listed(name: str, size: int, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["name", "bytes", "records"])


def write_files(classed: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes records to monolithic archives <name>.warc.gz, each one gzip stream; gives (name, bytes, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        raws = (raw for batch in batches for raw in _columns(batch))
        for first in raws:
            name, z, plain, size, n = uuid.uuid4().hex, zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0, 0
            with _whole(store, f"{root}/{name}.warc.gz") as f:
                raw = first
                while raw is not None:
                    size += f.write(z.compress(raw))
                    plain, n = plain + len(raw), n + 1
                    raw = next(raws, None) if plain < file_bytes else None
                size += f.write(z.flush())
            yield _listed(name, size, n)

    return in_small_batches(classed).mapInArrow(run, FILES)


def normalise_files(files: DataFrame, source: str, target: str) -> DataFrame:
    """Reads each <name>.warc.gz of `source` as a stream, and writes one with a member for each record, and its <name>.idx, below
    `target`; gives (name, bytes, records) of the new ones, whose names are their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (there, come), (store, root) = store_of(source), store_of(target)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for old in batch.column("name").to_pylist():
                name, at, n = uuid.uuid4().hex, 0, 0
                with there.open_input_stream(f"{come}/{old}.warc.gz", compression=None) as f, _whole(store, f"{root}/{name}.warc.gz") as out, _whole(store, f"{root}/{name}.idx") as index:
                    for record_id, packed in members(iter(lambda f=f: f.read(PIECE), b"")):
                        out.write(packed)
                        index.write(f"{record_id} {at} {len(packed)}\n".encode())
                        at, n = at + len(packed), n + 1
                yield _listed(name, at, n)

    return files.select("name").mapInArrow(run, FILES)


def read_files(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the files named, reached by its line in the sidecar alone."""
    spark = files.sparkSession
    if files.isEmpty():
        return spark.createDataFrame([], RECORD)
    line = F.split("value", " ")
    lines = spark.read.text(folder, pathGlobFilter="*.idx").select(F.regexp_extract(F.input_file_name(), r"([0-9a-f]+)\.idx$", 1).alias("name"), line[1].cast("long").alias("offset"), line[2].cast("long").alias("length"))
    lines = lines.join(files.select("name"), "name", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        opened, f = None, None
        for batch in batches:
            out, held = [], 0
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("name", "offset", "length")), strict=True):
                if name != opened:
                    if f is not None:
                        f.close()
                    opened, f = name, store.open_input_file(f"{root}/{name}.warc.gz")
                f.seek(offset)
                out.append(_row(zlib.decompress(f.read(length), 31), payloads))
                held += len(out[-1]["payload"] or b"")
                if held > ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
        if f is not None:
            f.close()

    return lines.select("name", "offset", "length").mapInArrow(run, RECORD)


def normalise(archives: DataFrame) -> DataFrame:
    """Archives (name, content) with a member for each record, and their index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("record", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for i in range(batch.num_rows):
                content, index = normalised(batch.column("content")[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column("name").slice(i, 1), pa.array([content], pa.binary()), pa.array([index], kind)], names=["name", "content", "index"])

    return archives.mapInArrow(run, ARCHIVE)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _number(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix(_URN)
    return int(name) if name not in ("", "none") else None


def _row(whole: bytes, payloads: bool) -> dict:
    """What a record says. A response's payload is checked against its digest."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    at = headers(head)
    block = rest[: int(at["content-length"])]
    digest = base64.b32decode(at["warc-payload-digest"].removeprefix("sha1:")).hex()
    payload, size = None, int(at["x-payload-length"])
    if at["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{at['warc-record-id']}: the payload doesn't match its digest")
    return {"page_id": _number(at["warc-record-id"]), "record_type": at["warc-type"], "payload_bytes": size, "payload_digest": digest, "refers_to": _number(at.get("warc-refers-to")), "payload": payload if payloads else None}


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record, reached by its index entry alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = memoryview(batch.column("content")[i].as_buffer())
                out = [_row(zlib.decompress(content[e["offset"] : e["offset"] + e["length"]], 31), payloads) for e in batch.column("index")[i].as_py()]
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return archives.mapInArrow(run, RECORD)


def export_files(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive of a table as <name>.warc.gz and its index as <name>.idx below a folder; gives (name, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                lines = "".join(f"{e['record']} {e['offset']} {e['length']}\n" for e in row["index"])
                for end, data in ((".warc.gz", row["content"]), (".idx", lines.encode())):
                    with _whole(store, f"{root}/{row['name']}{end}") as f:
                        f.write(data)
                yield pa.RecordBatch.from_arrays([pa.array([row["name"]]), pa.array([len(row["content"])], pa.int64())], names=["name", "bytes"])

    return archives.mapInArrow(run, "name string, bytes long")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes all pages to monolithic archives, normalises them, and reads every record back by the sidecars. The files stay in the
    shared folder as long as the application."""
    classed, folder = classified(pages, least=least), scratch(pages.sparkSession, "warc-files")
    try:
        store_of(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        found = read(stored(normalise(stored(monolithic(classed), "warc-monolithic")), "warc"), payloads=False)
    else:
        first, second = f"{folder}/monolithic", f"{folder}/members"
        files = stored(write_files(classed, first), "warc-monolithic")
        found = read_files(stored(normalise_files(files, first, second), "warc-members"), second, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
