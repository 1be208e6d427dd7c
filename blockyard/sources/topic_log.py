"""Topic log sources: a Kafka-shaped table (topic, partition, offset, key,
value, ts) read as a batch or a stream, start policies and seeks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = ("topic STRING, partition INT, offset BIGINT, key STRING, value STRING, "
              "ts TIMESTAMP")


def topic_log_source(log: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Subscribe to a list of topics of a topic-log DataFrame (batch or
    streaming). The filter is pushed to the parquet scan."""
    return log.filter(F.col("topic").isin(list(topics)))


def read_topic_log(spark: SparkSession, path: str, topics: Sequence[str],
                   stream: bool = False, glob: str | None = None,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Read a topic log stored as parquet files (one folder). A stream
    reads the same folder (a single-file path is not a streaming source)."""
    if stream:
        r = spark.readStream.schema(LOG_SCHEMA)
        if glob:
            r = r.option("pathGlobFilter", glob)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        df = r.parquet(path)
    else:
        df = spark.read.parquet(path)
    return topic_log_source(df, topics)


def read_kafka(spark: SparkSession, bootstrap: str, topics: Sequence[str],
               starting: str = "latest", stream: bool = True,
               max_offsets_per_trigger: int | None = None) -> DataFrame:
    """The same schema straight from Kafka where the connector is installed
    (``startingOffsets`` = the start policy, ``maxOffsetsPerTrigger`` = the
    poll size limit)."""
    reader = spark.readStream if stream else spark.read
    r = (reader.format("kafka").option("kafka.bootstrap.servers", bootstrap)
         .option("subscribe", ",".join(topics)).option("startingOffsets", starting))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return r.load().select(
        "topic", "partition", "offset", F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ts"))


def log_start_policy(log: DataFrame, committed: DataFrame, policy: str = "latest",
                     by: tuple[str, ...] = ("topic", "partition")) -> DataFrame:
    """Rows a consumer group reads: from its committed offset, or — with no
    committed offset — from the ``earliest`` retained offset or from the
    ``latest`` end (nothing old is read).

    ``committed``: (topic, partition, committed). The per-partition ends are a
    partial aggregation (one row per partition); joined back on partition."""
    by = list(by)
    ends = log.groupBy(*by).agg(
        F.min("offset").alias("_earliest"), (F.max("offset") + 1).alias("_latest"))
    default = F.col("_earliest") if policy == "earliest" else F.col("_latest")
    # one row per topic-partition on the small side
    starts = (ends.join(committed.select(*by, "committed"), by, "left")
              .select(*by, F.coalesce("committed", default).alias("start_offset")))
    return (log.join(starts, by, "inner")
            .filter(F.col("offset") >= F.col("start_offset")))


def seek_from_offset(log: DataFrame, topic: str, partition: int, offset: int) -> DataFrame:
    """One topic-partition from a given offset on (pushed to the scan)."""
    return log.filter((F.col("topic") == topic) & (F.col("partition") == partition)
                      & (F.col("offset") >= offset))
