"""WARC archives as a PySpark Python data source.

    spark.dataSource.register(WarcDataSource)
    df.write.format("warc").mode("append").save(folder)        # payloads and headers to record-compressed archives
    spark.read.format("warc").option("payload", "false").load(folder).where("record_type = 'revisit'")

Reading plans one partition per group of files, keeps the comparisons on record type and other header fields for
itself, parses each record's headers first, and neither inflates nor decodes a payload that is filtered out or not
asked for: the writer states each gzip member's length in its extra field ("sl", compressed and full length), so the
reader seeks to the next record."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual,
                                    In, InputPartition, IsNotNull, LessThanOrEqual, WriterCommitMessage)

from blockyard.llm.common import materialize, new_folder

COLUMNS = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
           "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # a fixed capture date, so that reruns write equal bytes
#: Bytes of one archive before the next begins, of one partition of small archives, and of one read.
ROLL, TOGETHER, READ = 256 << 20, 64 << 20, 64 << 10


def _member(data: bytes) -> bytes:
    """A gzip member whose extra field holds its own length and the length of its contents."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def record(kind: str, record_id: str, uri: str, digest: str, length: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """A response record with its payload, or a revisit record with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    clean = lambda s: s.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{clean(record_id)}>", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {clean(uri)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{clean(refers_to)}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Done(WriterCommitMessage):
    def __init__(self, paths):
        self.paths = paths


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of COLUMNS. Each task writes files of its own under hidden names and gives them their final names
    at its end, so a task that is lost or run twice leaves no half archive; files of tasks that do not count are
    deleted."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Done:
        fs, folder = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(folder, recursive=True)
        out, size, made = None, 0, []
        for batch in batches:
            for row in range(batch.num_rows):
                r = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                if out is None or size > ROLL:
                    if out is not None:
                        out.close()
                    made.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{folder}/_{made[-1]}", compression=None), 0
                size += out.write(_member(record(r["record_type"], r["record_id"], r["target_uri"] or "", r["payload_digest"],
                                                 r["payload_bytes"], r["payload"] or b"", r["refers_to"])))
        if out is not None:
            out.close()
        for name in made:
            fs.move(f"{folder}/_{name}", f"{folder}/{name}")
        return _Done(made)

    def commit(self, messages) -> None:
        fs, folder = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(folder, recursive=True)
        counted = "\n".join(sorted(n for m in messages if m is not None for n in m.paths))
        with fs.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}") as f:
            f.write(counted.encode())

    def abort(self, messages) -> None:
        fs, folder = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for name in m.paths if m is not None else ():
                fs.delete_file(f"{folder}/{name}")


class _Files(InputPartition):
    def __init__(self, files):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list[Filter]):
        """Keeps tests of header fields; gives back the rest."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in (*HEADERS, "payload_bytes") and isinstance(f, (EqualTo, In, IsNotNull, GreaterThanOrEqual, LessThanOrEqual)):
                self.tests.append(f)
            else:
                yield f

    def partitions(self):
        """Archives in groups of up to TOGETHER bytes; those that a committed write names, or all if none says."""
        fs, folder = pafs.FileSystem.from_uri(self.path)
        infos = [i for i in fs.get_file_info(pafs.FileSelector(folder)) if i.is_file]
        manifests = [i.path for i in infos if i.base_name.startswith("_manifest-")]
        counted = set()
        for m in manifests:
            with fs.open_input_stream(m) as f:
                counted.update(f.read().decode().split())
        files = sorted((i for i in infos if not i.base_name.startswith("_") and i.base_name.endswith((".warc", ".warc.gz"))
                        and (not manifests or i.base_name in counted)), key=lambda i: i.path)
        groups, held = [[]], 0
        for i in files:
            if groups[-1] and held + i.size > TOGETHER:
                groups.append([])
                held = 0
            groups[-1].append(i.path)
            held += i.size
        return [_Files(g) for g in groups]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
                            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for path in partition.files:
            with fs.open_input_file(path) as f:
                for row in records(f, path.endswith(".gz"), self._wanted, self.payload):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _wanted(self, row: dict) -> bool:
        for f in self.tests:
            v = row[f.attribute[0]]
            if v is None or isinstance(f, EqualTo) and v != f.value or isinstance(f, In) and v not in f.value \
                    or isinstance(f, GreaterThanOrEqual) and v < f.value or isinstance(f, LessThanOrEqual) and v > f.value:
                return False
        return True


class WarcDataSource(DataSource):
    """Options: path; payload (default true): false leaves the column null and skips every payload."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


class _Inflater:
    """Reads a gzip member (or the rest of a plain file) a little at a time."""

    def __init__(self, f, packed: bool):
        self.f, self.unzip, self.buffer, self.over = f, zlib.decompressobj(31) if packed else None, b"", False

    def more(self) -> bool:
        if self.over:
            return False
        if self.unzip is None:
            got = self.f.read(READ)
            self.over = not got
        else:
            fed = self.unzip.unconsumed_tail or self.f.read(READ)
            got = self.unzip.decompress(fed, READ) if fed else b""
            self.over = self.unzip.eof or not fed
        self.buffer += got
        return bool(got) or not self.over

    def head(self, end: bytes = b"\r\n\r\n") -> bytes:
        while end not in self.buffer and self.more():
            pass
        head, _, self.buffer = self.buffer.partition(end)
        return head

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self.more():
                break
            parts.append(self.buffer)
            have += len(self.buffer)
        data = b"".join(parts)
        self.buffer = data[n:]
        return data[:n]


def records(f, packed: bool, wanted=lambda row: True, payload: bool = True) -> Iterator[dict]:
    """The records of an open archive that `wanted` lets through by their headers. A payload that is read is checked
    against its digest; ValueError if it differs or the archive is cut off."""
    size, at = f.size(), 0
    while at < size:
        f.seek(at)
        length = None
        if packed:
            start = f.read(24)
            if start[:2] != b"\x1f\x8b":
                raise ValueError(f"no gzip member at {at}")
            if start[3:4] == b"\x04" and start[12:14] == b"sl":
                length = struct.unpack("<I", start[16:20])[0]
            f.seek(at)
        data = _Inflater(f, packed)
        top = data.head()
        lines = top.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = int(fields["content-length"])
        row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
        row = {c: v[1:-1] if v and c in ("record_id", "refers_to") and v[:1] == "<" else v for c, v in row.items()}
        if (row["payload_digest"] or "").startswith("sha1:"):
            row["payload_digest"] = row["payload_digest"][5:]
        http = fields.get("content-type", "").startswith("application/http")
        head = data.head() if http else b""
        told = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:]))
        body = block - (len(head) + 4 if http else 0)
        row["payload_bytes"], row["payload"] = int(told.get("content-length", body)), None
        if wanted(row):
            if payload and row["record_type"] != "revisit":
                row["payload"] = data.take(body)
                if len(row["payload"]) != body:
                    raise ValueError(f"record at {at} is cut off")
                if row["payload_digest"] and base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode() != row["payload_digest"]:
                    raise ValueError(f"the payload of the record at {at} does not have its digest")
            yield row
        if not packed:
            at += len(top) + 4 + block + 4
        elif length:
            at += length
        else:  # a member without its length: inflate to its end
            while not data.over:
                data.buffer = b""
                data.more()
            at = f.tell() - len(data.unzip.unused_data)


def base32_of_hex(digest: Column) -> Column:
    """Bare upper-case base32 of 20 bytes given as hex digits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    # five hex digits are 20 bits, four letters
    number = lambda i: F.conv(F.substring(digest, i // 4 * 5 + 1, 5), 16, 10).cast("int")
    letter = lambda i: F.substr(F.lit(alphabet), F.shiftright(number(i), 5 * (3 - i % 4)).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*[letter(i) for i in range(32)])


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Rows of COLUMNS, one per page: of pages with equal payloads of at least `least` bytes, the one with the largest
    key is a response and the others revisit it. Rows that repeat the largest key are responses too. A null key is
    smaller than any other, and rows are responses if no row of the payload has a key. Payloads: UTF-8 html, null: empty.

    Which page is the response is a partial aggregation by digest; payloads do not take part in it."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    base = pages.select(F.col(key).alias("k"), F.col(url).alias("target_uri"), payload.alias("payload")) \
        .withColumn("_sha", F.sha1("payload")).withColumn("d", base32_of_hex(F.col("_sha"))) \
        .withColumn("n", F.octet_length("payload").cast("long"))
    slim = materialize(base.select("k", "d", "n"), "warc-digests")
    firsts = materialize(slim.where(F.col("n") >= least).groupBy("d").agg(F.max("k").alias("first"), F.count("*").alias("c"))
                         .where("c > 1 and first is not null").select("d", "first"), "warc-firsts")
    revisits = slim.join(firsts, "d").where(~F.col("k").eqNullSafe(F.col("first"))).select("k", F.col("d").alias("rd"), "first").distinct()
    revisits = materialize(revisits, "warc-revisits").withColumnRenamed("k", "rk")
    out = base.join(revisits, base.k.eqNullSafe(revisits.rk) & (base.d == revisits.rd), "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    again = F.col("first").isNotNull()
    return out.select(F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), urn(F.col("k")).alias("record_id"),
                      "target_uri", F.when(again, urn(F.col("first"))).alias("refers_to"), F.col("d").alias("payload_digest"),
                      F.col("n").alias("payload_bytes"), F.when(~again, F.col("payload")).alias("payload"))


def use_warc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_pages(pages: DataFrame, folder: str | None = None, **options) -> str:
    """Writes the archives; returns their folder (a new one in the shared checkpoint location by default)."""
    use_warc(pages.sparkSession)
    folder = folder or new_folder(pages.sparkSession, "warc")
    page_records(pages, **options).write.format("warc").mode("append").save(folder)
    return folder


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    use_warc(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)
