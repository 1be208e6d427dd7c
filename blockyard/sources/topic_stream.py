"""Topic logs as a stream whose offsets are per topic and partition.

A log is a parquet folder partitioned by ``topic`` and ``partition``, its files
sorted by ``offset`` (:func:`write_topic_log`). The source plans each
micro-batch from the footers' offset ranges: at most ``maxRecords`` records a
poll, dealt out evenly over the partitions. A micro-batch is one poll, read by
one task per file that overlaps, or ``pollsPerBatch`` of them at most, read by
tasks that each take a run of whole polls. A column ``poll`` of the schema holds
the number of the record's poll, from 0 at the stream's start.
Its offsets are the next record of every partition and the next poll, kept in
the stream's checkpoint, so a restart goes on where the last planned micro-batch
ended and one that was not committed is read again, record by record the same.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Key of the polls in the stream's offsets; no topic is named like it.
POLLS = "#polls"
#: Records of a row group of a log file: what a task reads to get one of them.
GROUP_RECORDS = 8192
LOG_SCHEMA = "topic string, partition int, offset bigint, key string, value string, ts timestamp"


@dataclass
class Slice:
    """Records [lo, hi) of one file."""
    path: str
    topic: str
    partition: int
    lo: int
    hi: int


@dataclass
class Task(InputPartition):
    """Slices that one task reads. Poll number ``poll`` begins at the offsets ``begin`` and takes ``quota`` (none: all
    there are) of every partition, the next ones go on from there."""
    slices: list[Slice]
    begin: dict[tuple[str, int], int]
    poll: int
    quota: int | None


def _file_system(path: str):
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        scheme, rest = path.split(":", 1)
        return fs.FileSystem.from_uri(f"{scheme}://{rest.lstrip('/')}" if scheme != "file" else "file:///" + rest.lstrip("/"))
    return fs.LocalFileSystem(), path


class Log:
    """What the footers of a log folder say. Files do not change once written, so each footer is read once."""

    def __init__(self, path: str, topics: Sequence[str]):
        self.fs, self.root = _file_system(path)
        self.topics = set(topics)
        self.files: dict[str, tuple[str, int, int, int] | None] = {}

    def refresh(self) -> None:
        import pyarrow.parquet as pq
        from pyarrow import fs
        for info in self.fs.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            name = info.path
            if name in self.files or not name.endswith(".parquet") or info.base_name.startswith(("_", ".")):
                continue
            keys = dict(p.split("=", 1) for p in name.split("/")[-3:-1] if "=" in p)
            topic = unquote(keys.get("topic", ""))
            found = None
            if topic in self.topics:
                with self.fs.open_input_file(name) as f:
                    meta = pq.ParquetFile(f).metadata
                column = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == "offset") if meta.num_rows else 0
                stats = [meta.row_group(g).column(column).statistics for g in range(meta.num_row_groups)]
                if stats:
                    found = (topic, int(keys["partition"]), min(s.min for s in stats), max(s.max for s in stats))
            self.files[name] = found

    def bounds(self) -> dict[tuple[str, int], tuple[int, int]]:
        """(first offset, end) per topic partition."""
        out: dict = {}
        for found in self.files.values():
            if found:
                lo, hi = out.get(found[:2], (found[2], found[3] + 1))
                out[found[:2]] = (min(lo, found[2]), max(hi, found[3] + 1))
        return out

    def slices(self, start: dict, end: dict) -> list[Slice]:
        out = []
        for name, found in sorted(self.files.items()):
            if found and found[:2] in end:
                lo, hi = max(start.get(found[:2], found[2]), found[2]), min(end[found[:2]], found[3] + 1)
                if lo < hi:
                    out.append(Slice(name, found[0], found[1], lo, hi))
        return out


def _packed(at: dict, poll: int, quota: int | None) -> dict:
    """``poll``: the next poll; ``quota``: of the last planned ones, which a replay has to cut alike."""
    out: dict = {}
    for (topic, p), n in sorted(at.items()):
        out.setdefault(topic, {})[str(p)] = n
    return out | {POLLS: {"next": poll, "quota": quota}}


def _unpacked(offset: dict) -> tuple[dict, int, int | None]:
    polls = offset.get(POLLS, {"next": 0, "quota": None})
    return {(t, int(p)): int(n) for t, parts in offset.items() if t != POLLS for p, n in parts.items()}, polls["next"], polls["quota"]


class TopicLogReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.log = Log(options["path"], json.loads(options["topics"]))
        self.starting = options.get("startingoffsets", "latest")
        self.most = int(options.get("maxrecords", "0"))
        self.polls = int(options.get("pollsperbatch", "1"))
        self.tasks = int(options.get("tasks", "1"))
        self.at: dict | None = None
        self.poll, self.quota = 0, None

    def initialOffset(self) -> dict:
        """``earliest``, ``latest``, or the given offsets; partitions without one begin at ``earliest``."""
        self.log.refresh()
        bounds = self.log.bounds()
        if self.starting == "latest":
            self.at = {k: hi for k, (_, hi) in bounds.items()}
        else:
            given = {} if self.starting == "earliest" else _unpacked(json.loads(self.starting))[0]
            self.at = {k: max(given.get(k, lo), lo) for k, (lo, _) in bounds.items()}
        return _packed(self.at, 0, None)  # also asked for when a restart replays the first micro-batch

    def latestOffset(self) -> dict:
        """The end of the next polls: each ``maxRecords`` after the last planned one, in equal parts per partition. A
        partition that is new, or whose records before its first file are gone, goes on at its first offset."""
        self.log.refresh()
        bounds = self.log.bounds()
        quota = max(1, self.most // max(1, len(bounds))) if self.most else None
        end, polls = dict(self.at or {}), 0
        for k, (lo, hi) in bounds.items():
            begin = max(end.get(k, lo), lo)
            end[k] = max(begin, hi if quota is None else min(hi, begin + quota * self.polls))
            polls = max(polls, min(1, end[k] - begin) if quota is None else -(-(end[k] - begin) // quota))
        return _packed(end, self.poll + polls, quota if polls else self.quota)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # on a restart this is called with the last planned offset before the next one is asked for
        self.log.refresh()
        at, first, _ = _unpacked(start)
        self.at, self.poll, self.quota = _unpacked(end)
        begin = {k: max(at.get(k, lo), lo) for k, (lo, _) in self.log.bounds().items()}
        if self.polls == 1 or self.quota is None:
            tasks = [[s] for s in self.log.slices(at, self.at)]
        else:
            polls = self.poll - first
            cuts = [polls * i // min(self.tasks, polls) * self.quota for i in range(min(self.tasks, polls) + 1)] if polls else []
            ends = [{k: min(n, begin.get(k, n) + cut) for k, n in self.at.items()} for cut in cuts]
            tasks = [self.log.slices(lo, hi) for lo, hi in zip(ends, ends[1:])]
        return [Task(t, {(s.topic, s.partition): begin[s.topic, s.partition] for s in t}, first, self.quota) for t in tasks if t] \
            or [Task([], {}, first, self.quota)]

    def read(self, partition: Task) -> Iterator:
        for s in partition.slices:
            yield from self._records(s, partition.begin[s.topic, s.partition], partition.poll, partition.quota)

    def _records(self, part: Slice, begin: int, poll: int, quota: int | None) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema
        schema = to_arrow_schema(self.schema)
        made = ("topic", "partition", "poll")
        with self.log.fs.open_input_file(part.path) as f:
            file = pq.ParquetFile(f)
            offset = next(i for i in range(file.metadata.num_columns) if file.metadata.schema.column(i).path == "offset")
            groups = []
            for g in range(file.num_row_groups):
                s = file.metadata.row_group(g).column(offset).statistics
                if s.max >= part.lo and s.min < part.hi:
                    groups.append(g)
            columns = [n for n in schema.names if n not in made]
            for batch in file.iter_batches(row_groups=groups, columns=list({*columns, "offset"})):
                at = batch.column("offset")
                batch = batch.filter(pc.and_(pc.greater_equal(at, part.lo), pc.less(at, part.hi)))
                of = pa.array([0] * batch.num_rows, pa.int64()) if quota is None else pc.divide(pc.subtract(batch.column("offset"), begin), quota)
                fixed = {"topic": pa.array([part.topic] * batch.num_rows, pa.string()),
                         "partition": pa.array([part.partition] * batch.num_rows, pa.int32()), "poll": pc.add(of, poll)}
                yield pa.RecordBatch.from_arrays([(fixed[n] if n in made else batch.column(n)).cast(schema.field(n).type) for n in schema.names], schema=schema)

    def commit(self, end: dict) -> None:
        pass


class TopicLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return LOG_SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TopicLogReader(schema, {k.lower(): v for k, v in self.options.items()})


def write_topic_log(df: DataFrame, path: str, files: int | None = None) -> None:
    """Append records (``topic, partition, offset`` and others) in offset order, in parallel."""
    files = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(files, "topic", "partition", "offset").sortWithinPartitions("topic", "partition", "offset")
     .write.mode("append").option("parquet.block.row.count.limit", GROUP_RECORDS).partitionBy("topic", "partition").parquet(path))


def read_topic_stream(spark: SparkSession, path: str, topics: Sequence[str], schema: StructType | str = LOG_SCHEMA,
                      starting: str | dict = "latest", max_records: int = 0, polls: int = 1) -> DataFrame:
    """A stream of the log's records from ``starting`` (``earliest``, ``latest`` or ``{topic: {partition: offset}}``),
    at most ``max_records`` a poll (0: all there are; one record per partition at least) and ``polls`` polls a
    micro-batch."""
    spark.dataSource.register(TopicLogSource)
    starting = starting if isinstance(starting, str) else json.dumps({t: {str(p): n for p, n in v.items()} for t, v in starting.items()})
    return (spark.readStream.format("topic_log").schema(schema).option("path", path).option("topics", json.dumps(list(topics)))
            .option("startingOffsets", starting).option("maxRecords", str(max_records)).option("pollsPerBatch", str(polls))
            .option("tasks", spark.conf.get("spark.sql.shuffle.partitions")).load())
