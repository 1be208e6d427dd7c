"""Token id files: independent zstandard frames with a trailing seek table and a checksum per frame.

A file holds, one after another:
* frames: each a zstandard frame of the little-endian uint32 ids of consecutive whole documents;
* the document table: a skippable frame (magic 0x184D2A50) with, per document, its key (int64), whether the key is null
  (1 byte), and its number of ids (int64), and its frame (uint32); itself packed as one zstandard frame;
* the seek table, in the public seekable zstandard format: a skippable frame (magic 0x184D2A5E) with, per frame, its
  packed size, its full size and the low 32 bits of the XXH64 of its contents, then the number of frames, a descriptor
  byte (0x80: with checksums) and the magic 0x8F92EAB1.
Any zstandard decoder reads the ids of a whole file; this reader fetches the tables at its end, and then the frames of
the documents asked for."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockyard.llm.bpe import encoder
from blockyard.llm.common import materialize, new_folder

# fixed values of the seekable zstandard format
SEEK_TABLE, DOCUMENT_TABLE, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: Ids of a frame before the next begins (a document is never split, so a frame holds one document at least).
FRAME = 1 << 18
END = 2
_TABLE = np.dtype([("key", "<i8"), ("null", "u1"), ("n", "<i8"), ("frame", "<u4")])


def _xxh32(data: bytes) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FileWriter:
    def __init__(self, out):
        import zstandard
        self.out, self.pack = out, zstandard.ZstdCompressor(level=3)
        self.frames, self.table, self.held, self.size = [], [], [], 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.table.append((key or 0, key is None, len(ids), len(self.frames)))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= FRAME:
            self._flush()

    def _flush(self) -> None:
        data = np.concatenate(self.held).astype("<u4").tobytes()
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), _xxh32(data)))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        table = self.pack.compress(np.array(self.table, _TABLE).tobytes())
        self.out.write(struct.pack("<II", DOCUMENT_TABLE, len(table) + 8) + table + struct.pack("<Q", len(table)))
        seek = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(seek)) + seek)


class FileReader:
    """Random access to one file: `documents` is the document table, `frames` the seek table."""

    def __init__(self, f):
        self.f, size = f, f.size()
        f.seek(size - 9)
        n, kind, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE or kind != 0x80:
            raise ValueError("not a seekable zstandard file with checksums")
        seek_at = size - 9 - 12 * n - 8
        f.seek(seek_at)
        if struct.unpack("<II", f.read(8)) != (SEEK_TABLE, 12 * n + 9):
            raise ValueError("broken seek table")
        self.frames = [struct.unpack("<III", f.read(12)) for _ in range(n)]
        self.at = np.concatenate([[0], np.cumsum([x[0] for x in self.frames])]).astype(np.int64) if n else np.zeros(1, np.int64)
        f.seek(seek_at - 8)
        length = struct.unpack("<Q", f.read(8))[0]
        f.seek(seek_at - 8 - length)
        import zstandard
        self.unpack = zstandard.ZstdDecompressor()
        self.documents = np.frombuffer(self.unpack.decompress(f.read(length)) if length else b"", _TABLE)

    def frame(self, i: int) -> np.ndarray:
        packed, full, check = self.frames[i]
        self.f.seek(int(self.at[i]))
        data = self.unpack.decompress(self.f.read(packed), max_output_size=full)
        if len(data) != full or _xxh32(data) != check:
            raise ValueError(f"frame {i} does not have its checksum")
        return np.frombuffer(data, "<u4")

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file; inflates its frame only."""
        of = self.documents["frame"][i]
        first = int(np.searchsorted(self.documents["frame"], of))
        start = int(self.documents["n"][first:i].sum())
        return self.frame(int(of))[start:start + int(self.documents["n"][i])]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text",
                      rows_per_file: int = 20_000, end: int = END) -> DataFrame:
    """Writes the ids of every whole text (null: empty), each followed by `end`, in ascending order of the key (nulls
    first, repeated keys next to each other), and returns the manifest: (file, part, documents, frames, ids), parts in that
    order. The folder is a new one in the shared checkpoint location by default; an empty table writes no file.

    The texts are range-partitioned by key and a hash of the text, so a file holds a run of keys and the rows of a key that
    very many rows share spread over files; rows of one key are in the order of hash and text. A task writes under a hidden name and
    renames at its end, so a lost or repeated task leaves whole files or none."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-ids")
    order = ["key", "_hash", "text"]
    slim = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    files = max(1, -(-slim.select("key").count() // rows_per_file), int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = slim.withColumn("_hash", F.xxhash64("text"))
    parts = slim.repartitionByRange(files, F.col("key").asc_nulls_first(), "_hash") \
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order]).drop("_hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        out, coder = None, None
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(base, recursive=True)
                hidden = f"{base}/_{part}-{TaskContext.get().taskAttemptId()}"
                stream = fs.open_output_stream(hidden, compression=None)
                out, coder = FileWriter(stream), encoder(tokenizer)
            if batch.num_rows:
                texts = (text.as_py() for text in batch.column(1))
                for k, ids in zip(batch.column(0).to_pylist(), coder.encode_all(texts)):
                    out.add(k, np.append(ids, np.uint32(end)))
        if out is not None:
            out.close()
            stream.close()
            final = f"{base}/ids-{part:06d}.zst"
            fs.move(hidden, final)
            n = sum(t[2] for t in out.table)
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/ids-{part:06d}.zst", "part": part, "documents": len(out.table),
                                               "frames": len(out.frames), "ids": n}])

    return materialize(parts.mapInArrow(write, "file string, part bigint, documents bigint, frames bigint, ids bigint"), "token-manifest")


def read_documents(manifest: DataFrame, digest=None, kind: str = "ids array<bigint>") -> DataFrame:
    """(doc_id, start, n_tokens, and `kind`, what `digest` makes of each document's ids): all documents of the files,
    frame by frame. start counts the ids of all documents before. One row of work per file and run of frames."""
    digest = digest or (lambda ids: ids.astype(np.int64).tolist())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    work = files.select("file", "before", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        schema = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    name = row["file"]
                    fs, path = pafs.FileSystem.from_uri(name)
                    reader = FileReader(fs.open_input_file(path))
                t = reader.documents
                ids = reader.frame(row["frame"])
                first, last = np.searchsorted(t["frame"], [row["frame"], row["frame"] + 1])
                start = row["before"] + int(t["n"][:first].sum())
                ends = np.cumsum(t["n"][first:last])
                keys = [None if n else int(k) for k, n in zip(t["key"][first:last], t["null"][first:last])]
                values = [digest(ids[e - n:e]) for e, n in zip(ends, t["n"][first:last])]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + ends - t["n"][first:last], pa.int64()),
                                                  pa.array(t["n"][first:last], pa.int64()), pa.array(values)],
                                                 ["doc_id", "start", "n_tokens", kind.split()[0]])

    spread = work.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", F.floor(F.col("frame") / 8)) \
        .sortWithinPartitions("file", "frame")
    return spread.mapInArrow(read, f"doc_id bigint, start bigint, n_tokens bigint, {kind}")


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
