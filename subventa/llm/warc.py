"""WARC archives as a Spark data source, and the plan of which records store a payload.

`spark.read.format("warc")` and `df.write.format("warc")` after `register(spark)`.

Files hold one gzip member per record. A member's header names its own length
(extra field `sl`), so a reader can step over a record it has not inflated. Each
task writes files of its own; a commit lists them, with places where a split may
begin, in `manifest.json`. Only listed files are read, so the files of lost or
repeated tasks do no harm.

Reading plans one partition per file and split, takes predicates on record_type,
page_id, target_uri and payload_digest (=, IN, null tests, and <, > on page_id),
inflates a member as far as its headers, and goes on to the payload only for a
record that passes and if option `payload` is not "false".

Paths may be local or any URI that pyarrow's file systems know.

Defined cases: a null html is an empty payload, a null url has no target header,
a null page_id has no page header and its record is a response. Payloads under
`MIN_REVISIT` bytes are all stored. Of rows that repeat a page_id with the same
payload each is written, as a response if the id is the smallest.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

MIN_REVISIT = 100
SPLIT_BYTES = 64 * 1024 * 1024
FILE_BYTES = 256 * 1024 * 1024
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_type string, page_id long, target_uri string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_ARROW = pa.schema(
    [
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("target_uri", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)
_PUSHED = ("record_type", "page_id", "target_uri", "payload_digest")
# Rows and payload bytes of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 4096, 8 * 1024 * 1024
_EXTRA = b"sl"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def member(record: bytes, level: int = LEVEL) -> bytes:
    """A gzip member that tells its own length and that of the record."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0\0\0\0" + b"\0\xff" + struct.pack("<H", 12) + _EXTRA + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(record_type: str, page_id: int | None, url: str | None, refers_to: int | None, digest: str, size: int, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http + (payload if record_type == "response" else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{url}\n{digest}")
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        plain = url.isprintable() and url == url.strip() and url.isascii()
        lines.append(f"WARC-Target-URI: {url if plain else quote(url, safe='')}")
        if not plain:
            lines.append("X-Target-Quoted: yes")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Bytes: {size}"]
    if record_type == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon:
            out[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


@dataclass
class _Commit(WriterCommitMessage):
    files: list = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, level: int):
        self.path, self.overwrite, self.level = path, overwrite, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Commit:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        done: list[dict] = []
        out, name, at, splits = None, "", 0, []

        def close():
            if out is not None:
                out.close()
                done.append({"name": name, "bytes": at, "splits": splits})

        for batch in iterator:
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in _ARROW]
            for values in zip(*cols):
                if out is None or at >= FILE_BYTES:
                    close()
                    name, at, splits = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                kind, page, url, refers, digest, size, payload = (v.as_py() for v in values)
                packed = member(record(kind, page, url, refers, digest, size, payload or b""), self.level)
                if at - splits[-1] >= SPLIT_BYTES:
                    splits.append(at)
                out.write(packed)
                at += len(packed)
        close()
        return _Commit(files=done)

    def commit(self, messages: list) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        if not self.overwrite:
            files = _manifest(store, root) + files
        name = f"{root}/manifest-{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(name) as out:
            out.write(json.dumps({"files": files}).encode())
        store.move(name, f"{root}/manifest.json")

    def abort(self, messages: list) -> None:
        """Files of an aborted write are in no manifest."""


def _manifest(store: pafs.FileSystem, root: str) -> list[dict]:
    if store.get_file_info(f"{root}/manifest.json").type == pafs.FileType.NotFound:
        return []
    with store.open_input_stream(f"{root}/manifest.json") as src:
        return json.loads(src.read())["files"]


@dataclass
class _Split(InputPartition):
    file: str
    start: int
    end: int

    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        kinds = {EqualTo: "eq", In: "in", IsNull: "null", IsNotNull: "set", LessThan: "lt", LessThanOrEqual: "le", GreaterThan: "gt", GreaterThanOrEqual: "ge"}
        for f in filters:
            kind, column = kinds.get(type(f)), getattr(f, "attribute", ())
            if kind is None or len(column) != 1 or column[0] not in _PUSHED or (kind in ("lt", "le", "gt", "ge") and column[0] != "page_id"):
                yield f
            else:
                self.tests.append((kind, column[0], getattr(f, "value", None)))

    def partitions(self) -> list[InputPartition]:
        store, root = _open(self.path)
        if store.get_file_info(root).type == pafs.FileType.File:
            return [_Split(root, 0, store.get_file_info(root).size)]
        listed = _manifest(store, root)
        if listed:
            return [_Split(f"{root}/{f['name']}", a, b) for f in listed for a, b in zip(f["splits"], [*f["splits"][1:], f["bytes"]])]
        if store.get_file_info(f"{root}/manifest.json").type != pafs.FileType.NotFound:
            return [_Split("", 0, 0)]
        found = store.get_file_info(pafs.FileSelector(root, recursive=True))
        return [_Split(f.path, 0, f.size) for f in found if f.is_file and f.path.endswith((".warc.gz", ".warc"))]

    def _passes(self, values: dict) -> bool:
        for kind, column, value in self.tests:
            v = values[column]
            if kind == "null":
                ok = v is None
            elif kind == "set":
                ok = v is not None
            elif v is None or value is None:
                ok = False
            else:
                ok = {"eq": lambda: v == value, "in": lambda: v in value, "lt": lambda: v < value, "le": lambda: v <= value, "gt": lambda: v > value, "ge": lambda: v >= value}[kind]()
            if not ok:
                return False
        return True

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        store, _ = _open(self.path)
        rows: dict[str, list] = {f.name: [] for f in _ARROW}
        held = 0
        with store.open_input_file(partition.file) as src:
            for head, body in records(src, partition.start, partition.end):
                page = head.get("x-page-id")
                url = head.get("warc-target-uri")
                refers = head.get("x-refers-to-page")
                values = {
                    "record_type": head.get("warc-type"),
                    "page_id": int(page) if page is not None else None,
                    "target_uri": unquote(url) if url is not None and "x-target-quoted" in head else url,
                    "refers_to": int(refers) if refers is not None else None,
                    "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                    "payload_bytes": int(head["x-payload-bytes"]) if "x-payload-bytes" in head else None,
                    "payload": None,
                }
                if not self._passes(values):
                    continue
                if self.payload and values["record_type"] == "response":
                    values["payload"] = body().partition(b"\r\n\r\n")[2]
                    held += len(values["payload"])
                for k, v in values.items():
                    rows[k].append(v)
                if len(rows["page_id"]) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict(rows, schema=_ARROW)
                    rows, held = {k: [] for k in rows}, 0
        if rows["page_id"]:
            yield pa.RecordBatch.from_pydict(rows, schema=_ARROW)


class _Unzipped:
    """The plain bytes of a range, whether its file is zipped (in any number of members) or not."""

    def __init__(self, src, at: int, end: int, zipped: bool):
        self.src, self.at, self.end = src, at, end
        self.inflate = zlib.decompressobj(31) if zipped else None
        self.pending = b""

    def more(self, n: int) -> bytes:
        """Up to about n bytes more; nothing at the end of the range."""
        while True:
            if not self.pending and self.at < self.end:
                self.src.seek(self.at)
                self.pending = self.src.read(min(max(65536, n if self.inflate is None else 0), self.end - self.at))
                self.at += len(self.pending)
            if not self.pending:
                if self.inflate is not None and not self.inflate.eof and self.at > 0 and self.started:
                    raise ValueError("archive ends inside a record")
                return b""
            if self.inflate is None:
                out, self.pending = self.pending, b""
                return out
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            self.started = True
            out = self.inflate.decompress(self.pending, n)
            self.pending = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.started = False
            if out:
                return out

    started = False


def _streamed(src, start: int, end: int, zipped: bool):
    """Records one after the other, wherever the members of the file begin."""
    plain, held = _Unzipped(src, start, end, zipped), bytearray()

    def fill(n: int) -> bool:
        data = plain.more(n)
        held.extend(data)
        return bool(data)

    while True:
        while not held.strip(b"\r\n"):
            held.clear()
            if not fill(4096):
                return
        del held[: len(held) - len(held.lstrip(b"\r\n"))]
        searched = 0
        while (cut := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not fill(4096):
                raise ValueError("record without an end of its headers")
        head = headers(bytes(held[:cut]))
        begin, length = cut + 4, int(head.get("content-length", 0))

        def block(begin=begin, length=length) -> bytes:
            while len(held) < begin + length:
                if not fill(max(65536, begin + length - len(held))):
                    raise ValueError("record shorter than its content length")
            return bytes(held[begin : begin + length])

        yield head, block
        left = begin + length
        while left > len(held):
            left -= len(held)
            held.clear()
            if not fill(1 << 20):
                raise ValueError("record shorter than its content length")
        del held[:left]


def records(src, start: int, end: int):
    """(headers, function that reads the rest and returns the block) of each record in the byte range.

    Members that name their size, as those written here, hold one record and are stepped over unread. From the first
    other member on, and in a file that is not zipped, all bytes are read, as a member may hold any number of records.
    """
    at = start
    while at < end:
        src.seek(at)
        first = src.read(min(16384, end - at))
        if first[:4] != b"\x1f\x8b\x08\x04" or first[12:14] != _EXTRA:
            yield from _streamed(src, at, end, zipped=first[:2] == b"\x1f\x8b")
            return
        size = struct.unpack("<I", first[16:20])[0]
        inflate = zlib.decompressobj(31)
        plain = inflate.decompress(first, 4096)
        state = {"plain": plain, "taken": len(first)}

        def more(n: int, state=state, inflate=inflate, at=at) -> bool:
            """Inflate up to n more bytes; False at the member's end."""
            if inflate.eof:
                return False
            data = inflate.unconsumed_tail
            if not data:
                src.seek(at + state["taken"])
                data = src.read(65536)
                state["taken"] += len(data)
                if not data:
                    raise ValueError("archive ends inside a record")
            state["plain"] += inflate.decompress(data, n)
            return True

        while b"\r\n\r\n" not in state["plain"]:
            if not more(4096):
                raise ValueError("record without an end of its headers")
        cut = state["plain"].index(b"\r\n\r\n")
        head = headers(state["plain"][:cut])

        def block(cut=cut, head=head, state=state, more=more) -> bytes:
            length = int(head.get("content-length", 0))
            while len(state["plain"]) < cut + 4 + length:
                if not more(max(65536, cut + 4 + length - len(state["plain"]))):
                    raise ValueError("record shorter than its content length")
            return state["plain"][cut + 4 : cut + 4 + length]

        yield head, block
        at += size


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("level", LEVEL)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def planned(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Records of `pages` (page_id, url, html): equal payloads are stored once, by the smallest page_id."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").alias("target_uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = (
        rows.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    revisits = (F.col("page_id") != F.col("first")) & F.col("first").isNotNull() & F.col("page_id").isNotNull()
    out = rows.join(first, "payload_digest", "left").withColumn("again", F.coalesce(revisits, F.lit(False)))
    return out.select(
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
        "page_id",
        "target_uri",
        F.when(F.col("again"), F.col("first")).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )


def write_archive(records_df: DataFrame, path: str, mode: str = "overwrite") -> None:
    register(records_df.sparkSession)
    records_df.write.format("warc").mode(mode).save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
