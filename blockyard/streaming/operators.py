"""Streaming forms of the operators (Structured Streaming).

Built-in aggregations, joins and deduplication, whose state Spark keeps in the
checkpointed state store (per key, so it spreads over executors and survives
restarts). Stock requests are in :mod:`stock`, races with a timer in
:mod:`race`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockyard import constants as K
from blockyard.functions import rgb_classify
from blockyard.operators.broker import PARTITION, every_tick
from blockyard.operators.tracker import dashboard_events, order_tracker

# --- tracker_stream ----------------------------------------------------------

def tracker_stream(log: DataFrame) -> DataFrame:
    """Live order tracker: one updated row per order and micro-batch (update
    mode). The batch tracker is one aggregation of order-free facts, so it
    runs unchanged as a streaming aggregation with fixed-width state."""
    return order_tracker(dashboard_events(log))


def tracker_rows(updates: DataFrame) -> DataFrame:
    """Latest update per order (``n_events`` only grows)."""
    cols = [c for c in updates.columns if c not in ("order_id", "batch_id")]
    last = F.max_by(F.struct(*cols), F.col("n_events"))
    return updates.groupBy("order_id").agg(last.alias("s")).select("order_id", "s.*")


# --- dedup / commit / poll / lag ---------------------------------------------

def with_event_time(df: DataFrame, ts: str = "ts", out: str = "event_time") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ); the session clock is
    UTC, so the instant is unchanged."""
    return df.withColumn(out, F.col(ts).cast("timestamp"))


def dedup_stream(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop redelivered records: same (topic, partition, offset) within the
    watermark delay."""
    return (with_event_time(log).withWatermark("event_time", delay)
            .dropDuplicatesWithinWatermark(["topic", "partition", "offset"]))


def lag_ticks_stream(log: DataFrame, tick_s: int, delay: str = "1 day", by: Sequence[str] = PARTITION) -> DataFrame:
    """Log end per topic partition and tick (tumbling window of max offset);
    update mode re-emits a tick while it changes."""
    return (with_event_time(log).withWatermark("event_time", delay)
            .groupBy(*by, F.window("event_time", f"{tick_s} seconds").alias("w"))
            .agg((F.max("offset") + 1).alias("end_in_tick")))


def lag_at_ticks(ends: DataFrame, commits: DataFrame, log_start: DataFrame, tick_s: int, by: Sequence[str] = PARTITION) -> DataFrame:
    """The report of a drained lag stream: every partition at every tick, with
    the offsets ``lost`` to retention before the consumer committed them.
    ``ends``: the stream's updates, ``w``, ``end_in_tick`` and ``batch_id``."""
    by, c = list(by), F.col("committed")
    last = ends.groupBy(*by, F.col("w.start").cast("timestamp_ntz").alias("tick_start")).agg(F.max("end_in_tick").alias("end_in_tick"))
    d = every_tick(last, commits, tick_s, by).drop("tick_no").join(log_start.select(*by, "log_start"), by, "left")
    return d.withColumn("lost", F.when((F.col("log_start") > c) & (c >= 0), F.col("log_start") - c).otherwise(F.lit(0)).cast("long")) \
        .drop("log_start")


def colour_gate_stream(readings: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Colour check on live readings: classify each reading (stateless) and
    join to the static expected-colour table; keep mismatches."""
    m = readings.withColumn("measured", rgb_classify("r8", "g8", "b8"))
    return m.join(expected, keys, "inner").filter(F.col("measured") != F.col("expected"))


def sensor_gate_stream(probes: DataFrame, readings: DataFrame, tolerance_s: int = K.SENSOR_WAIT_SECONDS,
                       limit: float = K.PICKUP_DISTANCE_LIMIT, delay: str = "1 hour") -> DataFrame:
    """What the gate decides for each probe ``(id, sensor, t, r8, g8, b8,
    expected)`` on live distance messages ``(id, sensor, ts, payload)``, once
    per probe: ``timeout`` if its sensor sends nothing within ``tolerance_s``
    after it, else from the next message ``no_block`` (farther than ``limit``,
    or no number) or, by the colour channels, ``wrong_colour`` or ``ok``.

    Probes and messages meet per sensor in sliding windows of twice the
    tolerance: in the window in whose first half a probe lies are all messages
    that can answer it. A streaming aggregation gathers a window's rows, for
    the tolerance and the delay, and emits them when the watermark passes its
    end, so messages may come in any order within the delay; each probe then
    takes the next message by search in the sorted times. A message is in two
    windows, so the work grows with the rows, not with the probes times the
    messages within the tolerance. Of messages of one time the smallest id
    counts; rows without a time have no answer."""
    channels = ["r8", "g8", "b8", "expected"]
    p = with_event_time(probes, "t", "event_time").withWatermark("event_time", delay)
    r = with_event_time(readings, "ts", "event_time").withWatermark("event_time", delay)
    us, made = F.unix_micros("event_time").alias("us"), F.get_json_object("payload", "$.distance").try_cast("double")
    probe = p.select("event_time", "sensor", F.struct(us, "id", *channels).alias("probe"))
    read = r.select("event_time", "sensor", F.struct(us, F.col("id").alias("reading_id"), made.alias("distance")).alias("reading"))
    rows = probe.unionByName(read, allowMissingColumns=True).filter(F.col("event_time").isNotNull())
    w = F.window("event_time", f"{2 * tolerance_s} seconds", f"{tolerance_s} seconds")
    first_half = F.col("event_time") < F.col("w.start") + F.expr(f"INTERVAL {tolerance_s} SECONDS")
    g = rows.withColumn("w", w).filter(F.col("reading").isNotNull() | first_half).groupBy("w", "sensor").agg(
        F.collect_set("probe").alias("probes"), F.collect_set("reading").alias("readings")) \
        .filter(F.size("probes") > 0).select("sensor", "probes", F.when(F.col("sensor").isNotNull(), F.array_sort("readings")).alias("readings"))
    kinds = g.schema["probes"].dataType.elementType.simpleString()[len("struct<"):-1]
    reading_id = g.schema["readings"].dataType.elementType["reading_id"].dataType.simpleString()
    d = g.mapInArrow(_next_readings(tolerance_s * 1_000_000),
                     f"sensor {g.schema['sensor'].dataType.simpleString()}, probe struct<{kinds}>, reading_id {reading_id}, distance double")
    d = d.select("sensor", "probe.*", "reading_id", "distance", F.timestamp_micros("probe.us").cast("timestamp_ntz").alias("t"))
    measured = rgb_classify("r8", "g8", "b8")
    gate = (F.when(F.col("reading_id").isNull(), "timeout")
            .when(F.coalesce(F.col("distance") > limit, F.lit(True)), "no_block")
            .when(measured != F.col("expected"), "wrong_colour").otherwise("ok"))
    return d.select("id", "sensor", "t", "reading_id", "distance", gate.alias("gate"))


def _next_readings(tolerance_us: int):
    """Arrow batches of windows (``sensor``, ``probes``, ``readings`` by time) -> one row per probe."""
    def next_readings(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for i in range(batch.num_rows):
                sensor, probes, readings = (batch.column(c)[i] for c in range(3))
                asked, read = probes.values, readings.values
                t = np.asarray(asked.field("us"))
                times = np.asarray(read.field("us")) if read is not None else np.zeros(0, np.int64)
                at = np.searchsorted(times, t, side="right")
                found = np.append(times, 0)[at] <= t + tolerance_us
                at = pa.array(at, mask=(at == len(times)) | ~found)
                answer = [read.field(c).take(at) if read is not None else pa.nulls(len(t), batch.schema.field("readings").type.value_type.field(c).type)
                          for c in ("reading_id", "distance")]
                yield pa.RecordBatch.from_arrays([pa.array([sensor.as_py()] * len(t), sensor.type), asked, *answer],
                                                 ["sensor", "probe", "reading_id", "distance"])
    return next_readings
