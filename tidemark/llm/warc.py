"""WARC archives as a Spark data source, in Python, for reading and writing.

    spark.read.format("warc").load(path)        a file or a folder of .warc or .warc.gz
    df.write.format("warc").mode("append").save(path)

Rows: record_id, record_type, uri, date, refers_to, payload_digest, payload_length,
headers (map) and payload. A partition is a file. Equality, IN and not-null
predicates on the header columns are pushed down: headers are parsed first, and
the payload of a record that they rule out isn't decoded. A record is a gzip
member of its own, which carries its lengths (the `sl` field), so that a reader
steps over it; members without that field are inflated and thrown away. With
option payload=false no payload is decoded at all.

The writer's tasks write files of their own under names that no other attempt has,
and the driver moves those of the successful attempts into place, so that a lost
executor leaves nothing behind that is read.

Nulls: a null payload is an empty one, null header values are left out and read
as null. Empty tables give empty archives; a payload of any length is one row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.llm.common import new_path, sliced

SCHEMA = "record_id string, record_type string, uri string, date string, refers_to string, payload_digest string, payload_length long, headers map<string,string>, payload binary"
#: Header columns and the headers that they come from.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of records that are given none.
DATE = "1970-01-01T00:00:00Z"
ROWS = 256
#: Bytes that are read at once.
CHUNK = 1 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose `sl` field has its whole length and that of the data."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: dict[str, str | None], payload: bytes, length: int | None = None) -> bytes:
    """A record with an HTTP response as its block. length: the full payload's, where it isn't that of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    lines = [f"{k}: {one_line(v)}" for k, v in headers.items() if v is not None]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "WARC/1.1\r\n".encode() + "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def page_head(kind: str, record_id: str, date: str, uri: str | None, digest: str) -> dict[str, str | None]:
    """The headers that every record of the writer has."""
    return {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": digest}


def one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def parsed_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """A record's headers and the length of their text, if all of it is there."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


class Source:
    """A file that is read forward in chunks and can be stepped over."""

    def __init__(self, file):
        self.file, self.held, self.at = file, b"", 0

    def need(self, n: int) -> bytes:
        while (missing := n - len(self.held) + self.at) > 0 and (new := self.file.read(max(missing, CHUNK))):
            self.held, self.at = self.held[self.at :] + new, 0
        return self.held[self.at : self.at + n]

    def step(self, n: int) -> None:
        self.at += n
        if self.at > len(self.held):
            self.file.seek(self.at - len(self.held), 1)
            self.held, self.at = b"", 0


@dataclass
class Wanted:
    """What pushed predicates ask of the headers: allowed values by column, and columns that mustn't be null."""

    values: dict[str, set]
    present: set[str]

    def __call__(self, headers: dict[str, str]) -> bool:
        return all(headers.get(HEADERS[c]) in v for c, v in self.values.items()) and all(HEADERS[c] in headers for c in self.present)


def records(file, wanted: Wanted, payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes | None, int]]:
    """Headers, HTTP body (None: not decoded) and the full payload's length of the wanted records."""
    src = Source(file)
    while head := src.need(4):
        if head[:2] == b"\x1f\x8b":
            got = _zipped(src, wanted, payloads)
        elif head[:2] == b"\r\n":
            src.step(2)
            continue
        else:
            got = _plain(src, wanted, payloads)
        if got:
            yield got


def _plain(src: Source, wanted: Wanted, payloads: bool) -> tuple | None:
    n = 4096
    while (head := parsed_head(start := src.need(n))) is None:
        if len(start) < n or not start.startswith(b"WARC/"):
            raise ValueError("a record's headers don't end")
        n *= 2
    headers, size = head
    length = int(headers.get("Content-Length", 0))
    src.step(size)
    if not wanted(headers):
        src.step(length)
        return None
    block = src.need(length if payloads else min(length, 4096))[: length if payloads else 4096]
    src.step(length)
    return _row(headers, block, length, payloads)


def _zipped(src: Source, wanted: Wanted, payloads: bool) -> tuple | None:
    extra = src.need(24)
    whole = struct.unpack("<I", extra[16:20])[0] if len(extra) == 24 and extra[3] & 4 and extra[12:14] == b"sl" else 0
    inflate = zlib.decompressobj(31)
    # what the decompressor was given and the file hasn't been stepped over yet
    given = src.need(whole or CHUNK)
    tail = given

    def inflated(n: int) -> bytes:
        """Up to n more bytes of the member; none at its end."""
        nonlocal given, tail
        while not inflate.eof:
            part = inflate.decompress(tail, n)
            tail = inflate.unconsumed_tail
            if part or inflate.eof:
                return part
            if not tail:
                if whole:
                    raise ValueError("a member is cut short")
                src.step(len(given))
                given = tail = src.need(CHUNK)[:CHUNK]
                if not given:
                    raise ValueError("the file ends inside a member")
        return b""

    out = inflated(2048)
    while (head := parsed_head(out)) is None:
        if not (part := inflated(max(2048, len(out)))):
            raise ValueError("a record's headers don't end")
        out += part
    headers, size = head
    length = int(headers.get("Content-Length", 0))
    keep = wanted(headers)
    if whole and not (keep and payloads):
        src.step(whole)
    else:
        parts = [out]
        while part := inflated(CHUNK):
            if keep:
                parts.append(part)
        out = b"".join(parts)
        src.step(len(given) - len(inflate.unused_data))
    return _row(headers, out[size : size + length], length, payloads) if keep else None


def _row(headers: dict[str, str], block: bytes, length: int, payloads: bool) -> tuple[dict[str, str], bytes | None, int]:
    """Splits an HTTP block. The full payload's length is the block's own for what isn't a revisit, else HTTP's."""
    end = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[:end].decode("latin-1").split("\r\n")[1:])}
    full = int(http.get("content-length", length - end)) if headers.get("WARC-Type") == "revisit" else length - end
    return headers, block[end:] if payloads else None, full


@dataclass
class FilePartition(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads = options["path"], options.get("payload", "true").lower() != "false"
        self.wanted = Wanted({}, set())

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name in HEADERS and isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.wanted.values[name] = self.wanted.values.get(name, {f.value}) & {f.value}
            elif name in HEADERS and isinstance(f, In):
                self.wanted.values[name] = self.wanted.values.get(name, set(f.value)) & set(f.value)
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.wanted.present.add(name)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, path = opened(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(path, recursive=True))
            paths = sorted(x.path for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz")) and "/_temporary/" not in x.path)
        else:
            paths = [path]
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        return [FilePartition(scheme + p) for p in paths] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, path = opened(partition.path)
        rows: list[tuple] = []
        held = 0
        with store.open_input_file(path) as file:
            for row in records(file, self.wanted, self.payloads):
                rows.append(row)
                held += len(row[1] or b"")
                if len(rows) == ROWS or held > 16 * CHUNK:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = {c: pa.array([h.get(name) for h, _, _ in rows], pa.string()) for c, name in HEADERS.items()}
    return pa.record_batch(
        cols | {
            "payload_length": pa.array([n for _, _, n in rows], pa.int64()),
            "headers": pa.array([list(h.items()) for h, _, _ in rows], pa.map_(pa.string(), pa.string())),
            "payload": pa.array([b for _, b, _ in rows], pa.binary()),
        }
    )


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.level, self.date = options["path"], int(options.get("level", "6")), options.get("date", DATE)
        self.names = schema.names
        if "record_id" not in self.names or not {"payload", "member"} & set(self.names):
            raise ValueError("the columns record_id and payload (or member) are needed")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = opened(self.path)
        file = f"{path}/_temporary/{uuid.uuid4().hex}.warc.gz"
        store.create_dir(f"{path}/_temporary", recursive=True)
        any_row = False
        with store.open_output_stream(file, compression=None) as out:
            for batch in iterator:
                cols = {n: batch.column(k) for k, n in enumerate(self.names)}
                get = lambda name, k: cols[name][k].as_py() if name in cols else None
                for k in range(batch.num_rows):
                    any_row = True
                    if made := get("member", k):
                        out.write(made)
                        continue
                    payload, kind = get("payload", k) or b"", get("record_type", k) or "response"
                    digest = get("payload_digest", k) or "sha1:" + sha1_base32(payload)
                    head = page_head(kind, get("record_id", k), get("date", k) or self.date, get("uri", k), digest)
                    if kind == "revisit":
                        head |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": get("refers_to", k)}
                    out.write(member(record(head, payload, get("payload_length", k)), self.level))
        return Written(file if any_row else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = opened(self.path)
        store.create_dir(path, recursive=True)
        job = uuid.uuid4().hex[:8]
        for k, m in enumerate(messages):
            if m is not None and m.file:
                store.move(m.file, f"{path}/part-{k:05d}-{job}.warc.gz")
        self._clean(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*opened(self.path))

    def _clean(self, store: fs.FileSystem, path: str) -> None:
        if store.get_file_info(f"{path}/_temporary").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/_temporary")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def _id(column: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), column.cast("string"), F.lit(">"))


def _of_id(column: Column) -> Column:
    return F.regexp_extract(column, r"^<urn:page:(-?\d*)>$", 1)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads' digests and lengths, and each page's record as a response: compressed once, as it goes into the archive."""
    for batch in sliced(batches, ROWS, (3,)):
        digests, lengths, members = [], [], []
        for record_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
            payload = (html or "").encode()
            digest = hashlib.sha1(payload).digest()
            digests.append(digest.hex()), lengths.append(len(payload))
            members.append(member(record(page_head("response", record_id, DATE, url, "sha1:" + base64.b32encode(digest).decode()), payload)))
        yield pa.record_batch(
            {
                "page_id": batch.column(0), "record_id": batch.column(1), "url": batch.column(2), "digest": pa.array(digests, pa.string()),
                "payload_length": pa.array(lengths, pa.int64()), "member": pa.array(members, pa.binary()),
            }
        )


def archive_pages(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes a record for each page (page_id, url, html); repeated payloads become revisits.

    Of pages whose payloads of at least `least` bytes are equal, the one with the
    largest page_id is the response; rows that repeat that page_id are responses
    too. A null page_id counts as smaller than any; pages of equal payload without
    any page_id are all responses.
    """
    register(pages.sparkSession)
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    sizes = pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("n"))
    # maxima are combined before the shuffle; the join is a plain one, which is split where a digest is hot
    last = sizes.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"))
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    record_id = F.coalesce(_id(F.col("page_id")), F.lit("<urn:page:>"))
    rows = pages.select("page_id", record_id.alias("record_id"), "url", "html")
    rows = rows.mapInArrow(_members, f"page_id {kind['page_id']}, record_id string, url {kind['url']}, digest string, payload_length long, member binary")
    rows = rows.join(last, "digest", "left")
    again = F.coalesce((F.col("payload_length") >= least) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(False))
    out = rows.select(
        "record_id",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("uri"),
        F.when(again, _id(F.col("keeper"))).alias("refers_to"),
        F.when(~again, F.col("member")).alias("member"),
        F.concat(F.lit("sha1:"), base32(F.col("digest"))).alias("payload_digest"),
        "payload_length",
    )
    out.write.format("warc").mode("append").save(path)


def base32(hexed: Column) -> Column:
    """RFC 4648 base32 of 40 hex digits, by number conversion of 15, 15 and 10 of them. hexed is evaluated three times."""
    part = lambda at, n: F.lpad(F.conv(F.substring(hexed, at, n), 16, 32), n * 4 // 5, "0")
    return F.translate(F.concat(part(1, 15), part(16, 15), part(31, 10)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archived(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Writes pages' archives (to a new shared folder, if no path is given) and reads them back.

    page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    archive_pages(pages, path, least)
    kind = pages.schema["page_id"].dataType.simpleString()
    hexed = F.when(F.col("record_type") == "response", F.sha1("payload"))
    digest = F.when(F.col("hexed").isNotNull(), base32(F.col("hexed"))).otherwise(F.substring_index("payload_digest", ":", -1))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_length"))
    number = lambda c: F.expr(f"try_cast(`{c}` as {kind})")
    # a projection of its own for the hash: inside of base32 each payload would be hashed as often as that refers to it
    got = read(spark, path).select(_of_id(F.col("record_id")).alias("page"), _of_id(F.col("refers_to")).alias("other"), size.alias("payload_bytes"), hexed.alias("hexed"), "payload_digest", "record_type")
    return got.select(number("page").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", number("other").alias("refers_to"))
