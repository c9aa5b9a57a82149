"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Every record is a gzip member of its own. Its header carries the member's packed size (extra field ``SL``), so that a reader can
step over a record after parsing its headers; without the field the member is inflated and thrown away piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage,
)

from tideline.llm.common import scratch, stage

READ_SCHEMA = ("record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, "
               "content_type string, payload_bytes bigint, payload binary")
#: Columns that come from a record's headers, with their header names; filters on them are applied before a payload is inflated.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
           "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
_PIECE = 1 << 16


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(path: str):
    """(pyarrow file system, path in it) for a URI or a local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


# --- one record ---------------------------------------------------------------------------------------------------------

def pack(block: bytes, level: int) -> bytes:
    """A gzip member with its packed size in the header."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(block) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    size, plain = (size, len(block)) if size < 1 << 32 else (0, 0)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<HII", 8, size, plain & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str, date: str, content_type: str, block: bytes, more: tuple[tuple[str, str], ...] = ()) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {uri}"] * bool(uri) + [f"{k}: {v}" for k, v in more]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def one_line(value: str | None) -> str:
    return " ".join((value or "").split())


class Plain:
    """An uncompressed archive as a stream: ``out`` holds what has been read and not dropped yet."""

    def __init__(self, file, size: int):
        self.file, self.size, self.out = file, size, b""

    def more(self) -> bool:
        """Read one more piece into ``out``; False at the end."""
        data = self.file.read(_PIECE)
        self.out += data
        return bool(data)

    def drop(self, n: int) -> None:
        """Step over the next n bytes."""
        if n > len(self.out):
            at = self.file.tell() + n - len(self.out)
            if at > self.size:
                raise ValueError("the archive ends inside a record")
            self.file.seek(at)
        self.out = self.out[n:]


class Packed:
    """The same for gzip members one after another, with any number of records in each."""

    def __init__(self, file, size: int):
        self.file, self.size, self.out, self.at, self.inflate = file, size, b"", 0, None

    def _start(self) -> bool:
        if self.at >= self.size:
            return False
        self.file.seek(self.at)
        head = self.file.read(24)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {self.at}")
        known = len(head) == 24 and head[3] & 4 and head[12:14] == b"SL"
        packed, self.plain = struct.unpack("<II", head[16:24]) if known else (0, 0)
        self.next = self.at + packed if packed > 24 else None  # sizes beyond 4 GB don't fit; such a member is read through
        self.file.seek(self.at)
        self.inflate, self.taken, self.made = zlib.decompressobj(31), 0, 0
        return True

    def more(self) -> bool:
        if self.inflate is not None and self.inflate.eof:
            self.at += self.taken - len(self.inflate.unused_data)
            self.inflate = None
        if self.inflate is None and not self._start():
            return False
        data = self.inflate.unconsumed_tail or self.file.read(_PIECE)
        if not data:
            raise ValueError("the archive ends inside a record")
        before = len(self.inflate.unconsumed_tail)
        piece = self.inflate.decompress(data, _PIECE)
        self.taken, self.made = self.taken + len(data) - before, self.made + len(piece)
        self.out += piece
        return True

    def drop(self, n: int) -> None:
        """Step over n bytes; where nothing but line ends follows them in a member of known size, by its packed size."""
        while n > len(self.out):
            n, self.out = n - len(self.out), b""
            if self.inflate is not None and self.next is not None and not self.inflate.eof and 0 <= self.plain - self.made - n <= 4:
                if self.next > self.size:
                    raise ValueError("the archive ends inside a record")
                self.at, self.inflate = self.next, None
                return
            if not self.more():
                raise ValueError("the archive ends inside a record")
        self.out = self.out[n:]


def unchunked(body: bytes) -> bytes:
    """The content of a chunked HTTP body; what isn't chunked as announced is returned as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return body
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        if at + n > len(body):
            return body
        out.append(body[at:at + n])
        at += n + 2


def headers_of(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def read_records(file, size: int, wanted, payloads: bool, verify: bool, packed: bool = True) -> Iterator[tuple]:
    """Tuples as READ_SCHEMA; ``wanted`` judges the header columns. Only wanted records are inflated beyond their headers.

    A payload is the block without HTTP headers, its chunks joined. The digest of a record may be of the payload with or without
    its chunk framing; the body counts as sent where it isn't asked for, so ``payload_bytes`` of a chunked one is read for.
    """
    stream = (Packed if packed else Plain)(file, size)

    def upto(mark: bytes, at: int) -> int:
        """Place of the mark from ``at`` on, or -1."""
        seen = at
        while (found := stream.out.find(mark, seen)) < 0:
            seen = max(at, len(stream.out) - len(mark) + 1)
            if not stream.more():
                return -1
        return found

    while True:
        stream.out = stream.out.lstrip(b"\r\n")
        if not stream.out:
            if not stream.more():
                return
            continue
        end = upto(b"\r\n\r\n", 0)
        if end < 0 or not stream.out.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = headers_of(stream.out[:end])
        stream.drop(end + 4)
        columns = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
        if columns["payload_digest"]:
            columns["payload_digest"] = columns["payload_digest"].rpartition(":")[2]
        length = int(fields["content-length"])
        if not wanted(columns):
            stream.drop(length)
            continue
        skip, payload, count, chunked = 0, None, length, False
        if (columns["content_type"] or "").startswith("application/http"):
            while (inner := stream.out.find(b"\r\n\r\n", 0, length)) < 0 and len(stream.out) < length and stream.more():
                pass
            skip = inner + 4 if inner >= 0 else length
            http = headers_of(stream.out[:skip])
            chunked = "chunked" in http.get("transfer-encoding", "").lower()
            announced = http.get("content-length", "")
            count = int(announced) if announced.isdigit() and not chunked else length - skip
        full = columns["record_type"] != "revisit"
        if full and (payloads or verify or chunked):
            parts, held = [], 0
            while held < length:
                if not stream.out and not stream.more():
                    raise ValueError("the archive ends inside a record")
                parts.append(stream.out[:length - held])
                held += len(parts[-1])
                stream.out = stream.out[len(parts[-1]):]
            body = b"".join(parts)[skip:]
            payload = unchunked(body) if chunked else body
            if verify and (not chunked and len(body) != count or columns["payload_digest"] not in (None, digest(payload), digest(body))):
                raise ValueError(f"the payload of {columns['record_id']} doesn't match its digest")
            count = len(payload)
        else:
            stream.drop(length)
        yield (*columns.values(), count, payload if payloads else None)


# --- the data source ----------------------------------------------------------------------------------------------------

class WarcFiles(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    """Options: ``payload`` (false: null payloads, nothing is inflated for them), ``verify`` (true: check digests of full records),
    ``split_mb`` (files a task). Reads ``.warc.gz`` and ``.warc`` files; another file in the folder is an error, hidden ones are not read."""

    def __init__(self, options):
        self.options, self.tests = dict(options), []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                name = f.attribute[0]
                if isinstance(f, EqualTo):
                    self.tests.append((name, "in", (f.value,)))
                elif isinstance(f, In):
                    self.tests.append((name, "in", tuple(f.value)))
                elif isinstance(f, StringStartsWith):
                    self.tests.append((name, "starts", f.value))
                else:
                    self.tests.append((name, "some", None))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = filesystem(self.options["path"])
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            files = [info]
        else:
            files = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=False))
        base = info.path.rstrip("/")
        hidden = lambda path: any(part.startswith(("_", ".")) for part in path[len(base):].split("/") if part)
        files = sorted(((f.path, f.size) for f in files if f.type == fs.FileType.File and not hidden(f.path)), key=lambda f: -f[1])
        for path, _ in files:
            if not path.endswith((".warc.gz", ".warc")):
                raise ValueError(f"not an archive: {path}")
        most, groups = float(self.options.get("split_mb", 64)) * 1e6, []
        for path, size in files:  # small files share a task
            if groups and groups[-1][1] + size <= most:
                groups[-1][0].append((path, size))
                groups[-1][1] += size
            else:
                groups.append([[(path, size)], size])
        return [WarcFiles(g[0]) for g in groups] or [WarcFiles([])]

    def _wanted(self, columns) -> bool:
        for name, how, value in self.tests:
            x = columns[name]
            if x is None or how == "in" and x not in value or how == "starts" and not x.startswith(value):
                return False
        return True

    def read(self, partition):
        system, _ = filesystem(self.options["path"])
        truth = lambda name, default: self.options.get(name, default).lower() == "true"
        for path, size in partition.paths:
            with system.open_input_file(path) as file:
                yield from read_records(file, size, self._wanted, truth("payload", "true"), truth("verify", "false"), path.endswith(".gz"))


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (record_type, record_id, target_uri, warc_date, refers_to, payload) as response and revisit records.

    Tasks write into a hidden folder of the job and the commit gives the files of the tasks that count their names, so that a task
    that is run again, or twice, leaves no record behind twice, and jobs that write to one path at once don't meet. Overwriting
    removes the old archives after the new ones are in place. Options: ``file_mb`` (a file's size before the next is begun), ``level`` (of compression).
    """

    def __init__(self, options, overwrite: bool):
        self.options, self.overwrite, self.job = dict(options), overwrite, f"_{uuid.uuid4().hex}"

    def write(self, iterator):
        system, root = filesystem(self.options["path"])
        system.create_dir(f"{root}/{self.job}", recursive=True)
        most, level = float(self.options.get("file_mb", 256)) * 1e6, int(self.options.get("level", 3))
        files, out = [], None
        for batch in iterator:
            names = batch.schema.names
            columns = [batch.column(names.index(c)) for c in ("record_type", "record_id", "target_uri", "warc_date", "refers_to", "payload")]
            for i in range(batch.num_rows):
                kind, rid, uri, date, refers, payload = (c[i].as_py() for c in columns)
                payload = payload or b""
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                more = (("WARC-Payload-Digest", f"sha1:{digest(payload)}"),)
                if kind == "revisit":
                    more += (("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers))
                block = record(kind, one_line(rid), one_line(uri), date, "application/http; msgtype=response", head if kind == "revisit" else head + payload, more)
                if out is None or out.tell() > most:
                    if out is not None:
                        out.close()
                    files.append(f"{root}/{self.job}/{uuid.uuid4().hex}.warc.gz")
                    out = system.open_output_stream(files[-1], compression=None)
                    info = b"software: tideline\r\nformat: WARC File Format 1.1\r\n"
                    out.write(pack(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", "", date, "application/warc-fields", info), level))
                out.write(pack(block, level))
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        from pyarrow import fs

        system, root = filesystem(self.options["path"])
        system.create_dir(root, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and self.overwrite
               and f.path.endswith((".warc.gz", ".warc")) and not f.path.rpartition("/")[2].startswith(("_", "."))]
        for file in (f for m in messages if m is not None for f in m.files):
            system.move(file, f"{root}/records-{file.rpartition('/')[2]}")
        for file in old:
            system.delete_file(file)
        self._clear(system, root)

    def abort(self, messages):
        self._clear(*filesystem(self.options["path"]))

    def _clear(self, system, root) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class Warc(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


# --- pages --------------------------------------------------------------------------------------------------------------

def page_records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Rows for the writer: of equal payloads of ``least_bytes`` or more the page with the least id responds, others revisit it.

    Copies are found on (id, digest) rows alone; payloads are not grouped. What goes back to the pages are the ids of revisits,
    one row each, so that a payload with a third of all pages is no hot key. Null payloads are empty ones. Pages that tie for
    the least id, and pages without id whose payload no page with an id has, all respond.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8")
    digests = pages.select(F.col(id_col).alias("_pid"), F.sha1(payload).alias("_sha"), F.octet_length(payload).alias("_n"))
    digests = stage(digests.where(F.col("_n") >= least_bytes), "payload_digests")
    first = digests.groupBy("_sha").agg(F.min("_pid").alias("_first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1 and _first is not null")
    first = stage(first.select(F.col("_sha").alias("_s"), "_first"), "first_pages")
    revisits = digests.join(first, F.col("_sha") == F.col("_s")).where("_pid is null or _pid > _first")
    revisits = stage(revisits.select("_pid", "_sha", "_first").distinct(), "revisits")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    # always by shuffle: revisits grow with the crawl
    joined = rows.join(revisits.hint("merge"), F.col("page").eqNullSafe(F.col("_pid")) & (F.sha1("payload") == F.col("_sha")), "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return joined.select(
        F.when(F.col("_first").isNull(), "response").otherwise("revisit").alias("record_type"), urn(F.col("page")).alias("record_id"),
        "target_uri", F.lit(date).alias("warc_date"), F.when(F.col("_first").isNotNull(), urn(F.col("_first"))).alias("refers_to"), "payload")


def archive_and_read(pages: DataFrame, path: str | None = None, least_bytes: int = 0, **names) -> DataFrame:
    """Write a record for every page to ``path`` (a new shared folder by default) and read the archives back.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to, all from the archives; the payloads of responses are
    inflated and checked against their digests. Every row gives one record, repeated rows too; an empty table gives none. A null or
    empty html is an empty payload, a very long one is written and read whole, by one task; columns beside the three named ones
    are ignored, whatever their names.
    """
    spark = pages.sparkSession
    register(spark)
    path = path or scratch(spark, "warc")
    page_records(pages, least_bytes, **names).write.format("warc").option("path", path).mode("append").save()
    back = spark.read.format("warc").option("path", path).option("payload", "false").option("verify", "true").option("split_mb", "16").load()
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    kind = dict(pages.dtypes)[names.get("id_col", "page_id")]
    return back.where(F.col("record_type").isin("response", "revisit")).select(
        number("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").cast(kind).alias("refers_to"), "target_uri")
