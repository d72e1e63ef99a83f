"""WARC archives as a PySpark Python data source, with identical payloads stored once and revisited."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from sensorframe.llm._common import fresh_path, join_counted, table, written

#: Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
ID_PREFIX = "urn:page:"
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, "
    "payload_bytes bigint, refers_to string, payload binary"
)
#: Columns that a header alone decides, by the header that holds them.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
HEAD_BYTES = 4096  # read first from a record; more only where a header is longer
ROLL_BYTES = 256 << 20  # a task starts another file beyond this
BATCH_BYTES = 8 << 20


def _storage(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


_SIZED = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8)  # how a member with its size begins


def _member(record: bytes) -> bytes:
    """One gzip member with its compressed size in an extra field, by which readers skip records they do not want."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    return _SIZED + struct.pack("<Q", len(body)) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _one_line(value: str) -> str:
    return " ".join(str(value).split())


def _record(row: dict) -> bytes:
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    block = HTTP_HEAD % (row["payload_bytes"] or 0) + (b"" if revisit else payload)
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["date"]), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    if row["target_uri"] is not None:
        fields.append(("WARC-Target-URI", row["target_uri"]))
    fields.append(("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"))
    if revisit:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{row['refers_to']}>")]
    head = VERSION + "\r\n" + "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files under hidden names of this job; a committed job gives those of its tasks their names and deletes the
    others, so a lost or repeated task leaves nothing."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = _storage(self.path)
        store.create_dir(base, recursive=True)
        paths: list[str] = []
        out = None
        for batch in iterator:
            for i in range(batch.num_rows):
                if out is None or out.tell() > ROLL_BYTES:
                    if out is not None:
                        out.close()
                    paths.append(f"{base}/.{self.job}-{uuid.uuid4().hex}.warc.gz")
                    out = store.open_output_stream(paths[-1], compression=None)
                out.write(_member(_record({n: batch.column(n)[i].as_py() for n in batch.schema.names})))
        if out is not None:
            out.close()
        return _Written(paths)

    def _clear(self) -> None:
        store, base = _storage(self.path)
        for x in store.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if x.is_file and x.base_name.startswith(f".{self.job}-"):
                store.delete_file(x.path)

    def commit(self, messages: list) -> None:
        store, _ = _storage(self.path)
        for m in messages:
            for p in m.paths if m else ():
                folder, _, name = p.rpartition("/")
                store.move(p, f"{folder}/{name[1:]}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload, self.wanted = path, with_payload, []

    def pushFilters(self, filters: list) -> Iterator:
        """Takes equality, membership and prefix tests on header columns; hands back the rest."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith)):
                values = (f.value,) if isinstance(f, (EqualTo, StringStartsWith)) else tuple(f.value)
                self.wanted.append((name, isinstance(f, StringStartsWith), values))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, base = _storage(self.path)
        found = store.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        files = [x for x in found if x.is_file and x.base_name.endswith((".warc.gz", ".warc")) and x.base_name[0] not in "._"]
        return [_File(x.path) for x in sorted(files, key=lambda x: (-x.size, x.path))]

    def _passes(self, row: dict) -> bool:
        return all(row[n] is not None and (row[n].startswith(v[0]) if prefix else row[n] in v) for n, prefix, v in self.wanted)

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        schema = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in SCHEMA.split(", "))])
        rows, held = [], 0
        store, _ = _storage(self.path)
        with store.open_input_file(partition.path) as f:
            for row in self._records(f):
                rows.append(row)
                held += 500 + len(row["payload"] or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, f) -> Iterator[dict]:
        """Members that tell their size are passed over when their header is not wanted. Other gzip members and bare records are
        read on as one stream."""
        at, size, get = 0, f.size(), _Blocks(f).get
        while at < size:
            if get(at, len(_SIZED)) == _SIZED:
                body = at + len(_SIZED) + 8
                at = body + struct.unpack("<Q", get(body - 8, 8))[0]
                stream = _Stream(get, body, at, zlib.decompressobj(-15))
                at += 8
                if row := self._record(stream, False):
                    yield row
                continue
            stream = _Stream(get, at, size, zlib.decompressobj(31) if get(at, 2) == b"\x1f\x8b" else None)
            while stream.more():
                if row := self._record(stream, True):
                    yield row
            return

    def _record(self, stream: _Stream, to_end: bool) -> dict | None:
        """The next record, or nothing where it is not wanted; ``to_end`` leaves the stream behind it."""
        head = stream.until(b"\r\n\r\n").lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no archive record where one should begin: {head[0][:40]!r}")
        fields = _fields(head[1:])
        left = int(fields.get("content-length", 0))
        row = {n: fields.get(h.lower()) for n, h in HEADERS.items()}
        row["payload_digest"] = _hex_digest(row["payload_digest"])
        for n in ("record_id", "refers_to"):
            row[n] = row[n] and row[n].strip("<>")
        wanted = self._passes(row)
        if wanted:
            row |= {"payload": None, "payload_bytes": left}
            if left and fields.get("content-type", "").lower().startswith("application/http"):
                http = stream.until(b"\r\n\r\n", left)
                left -= len(http)
                told = _fields(http.decode("latin-1").split("\r\n")[1:]).get("content-length", "")
                # a revisit holds no payload; its length is the one that the kept head tells
                row["payload_bytes"] = left if row["record_type"] != "revisit" else int(told) if told.isdigit() else None
            if self.with_payload and row["record_type"] != "revisit":
                row["payload"] = stream.take(left)
                left = 0
        if to_end:
            stream.skip(left)
            stream.blank()
        return row if wanted else None


def _fields(lines: list[str]) -> dict[str, str]:
    """Header values by lower-case name; a repeated name keeps its first value."""
    out: dict[str, str] = {}
    for name, colon, value in (line.partition(":") for line in lines):
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _hex_digest(value: str | None) -> str | None:
    """Bare lower-case hex of a digest that is told in hex or, as most archives do, in base 32."""
    value = (value or "").partition(":")[2] or value or None
    return base64.b32decode(value).hex() if value and len(value) == 32 and value.isalnum() and value.isupper() else value


class _Stream:
    """What stands between two places of a file, inflated piece by piece; gzip members that follow one another are one stream."""

    def __init__(self, get, at: int, end: int, opened):
        self.get, self.at, self.end, self.opened, self.held = get, at, end, opened, b""

    def _next(self) -> bytes:
        while True:
            tail = self.opened.unconsumed_tail if self.opened else b""
            raw = tail or self.get(self.at, min(HEAD_BYTES, self.end - self.at))
            self.at += 0 if tail else len(raw)
            if not raw or not self.opened:
                return raw
            out = self.opened.decompress(raw, 16 * HEAD_BYTES)
            if self.opened.eof:
                self.at -= len(self.opened.unused_data)
                another = self.at < self.end and self.get(self.at, 2) == b"\x1f\x8b"
                self.at = self.at if another else self.end
                self.opened = zlib.decompressobj(31)
            if out:
                return out

    def more(self) -> bool:
        self.held = self.held or self._next()
        return bool(self.held)

    def until(self, mark: bytes, most: int | None = None) -> bytes:
        """Up to and with ``mark``, past line ends that stand before it; all, or ``most`` bytes, where it does not come."""
        parts = bytearray()
        while most is None or len(parts) < most:
            if not self.more():
                break
            parts += self.held
            self.held = b""
            skip = 0 if most is not None else len(parts) - len(parts.lstrip(b"\r\n"))
            if (found := parts.find(mark, skip)) >= 0:
                most = min(found + len(mark), len(parts) if most is None else most)
                break
        most = len(parts) if most is None else min(most, len(parts))
        self.held = bytes(parts[most:])
        return bytes(parts[:most])

    def take(self, n: int) -> bytes:
        parts = []
        while n > 0 and self.more():
            parts.append(self.held[:n])
            self.held = self.held[n:]
            n -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n > 0 and self.more():
            past = min(n, len(self.held))
            self.held = self.held[past:]
            n -= past

    def blank(self) -> None:
        """Passes the line ends behind a record."""
        while self.more():
            self.held = self.held.lstrip(b"\r\n")
            if self.held:
                return


class _Blocks:
    """Random reads through one block, so that neighbouring small reads cost one request."""

    def __init__(self, f, block: int = 1 << 20):
        self.f, self.block, self.base, self.held = f, block, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.base <= at <= at + n <= self.base + len(self.held):
            self.base, self.held = at, self.f.read_at(max(n, self.block), at)
        return self.held[at - self.base : at - self.base + n]


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``: the records of all ``.warc.gz`` and ``.warc`` files below. Option ``payload`` =
    false leaves payloads undecoded. The payload of an HTTP record is what follows its HTTP head, of another record its block."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark push filters into Python sources, which it does not do by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records_of(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One archive record per page. Of equal payloads of at least ``least`` bytes the one with the largest page id is a
    response and the others revisit it; all smaller ones are responses.

    A null html is an empty payload, a null url leaves its header out, other columns are not read. Rows with a null page id
    are responses and are not shuffled. Repeated rows with one page id give one record each, all of one kind. Payloads never move by their digest:
    only (page id, digest) rows do, with hot digests salted, and payloads of revisits are not carried on.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    each = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), payload.alias("_payload"))
    each = each.withColumns({"_digest": F.sha1("_payload"), "_bytes": F.octet_length("_payload").cast("long")})
    large = each.where((F.col("_bytes") >= least) & F.col("_id").isNotNull()).select("_id", "_digest", "_bytes")
    groups = large.groupBy("_digest", "_bytes").agg(F.max("_id").alias("_keeper"), F.count("*").alias("_n")).where("_n > 1")
    copies = join_counted(large, written(groups, "equal-payloads"), ["_digest", "_bytes"], "_n", F.xxhash64("_id"))
    copies = copies.where("_id <> _keeper").select("_id", "_keeper").distinct()
    nameless = each.where(F.col("_id").isNull()).withColumn("_keeper", F.col("_id"))
    each = each.where(F.col("_id").isNotNull()).join(copies, "_id", "left").unionByName(nameless)
    again = F.col("_keeper").isNotNull()
    return each.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit(ID_PREFIX), F.coalesce(F.col("_id").cast("string"), F.lit(""))).alias("record_id"),
        F.col("_url").alias("target_uri"), F.lit(date).alias("date"), F.col("_digest").alias("payload_digest"), F.col("_bytes").alias("payload_bytes"),
        F.when(again, F.concat(F.lit(ID_PREFIX), F.col("_keeper").cast("string"))).alias("refers_to"),
        F.when(~again, F.col("_payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def sha1_hex(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(records_of(table(spark, sf_dir, "pages")), path)
    full = read_warc(spark, path).where(F.col("record_type") == "response")
    again = read_warc(spark, path, payload=False).where(F.col("record_type") == "revisit")

    def number(c):
        return F.expr(f"try_cast(substring({c}, {len(ID_PREFIX) + 1}) AS bigint)")

    # what a response holds is measured on the payload that was read back, what a revisit tells comes from its header
    full = full.select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return full.unionByName(again.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")))


QUERIES = {"op5_warc": op5_warc}
ORACLES = {
    "op5_warc": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)"""
}
