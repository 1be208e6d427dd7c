"""Sensor checks: distance threshold, colour mismatch, next reading after a
point in time (forward as-of join with tolerance)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockyard import constants as K
from blockyard.functions import epoch_ms, rgb_classify


def with_distance(readings: DataFrame, payload: str = "payload") -> DataFrame:
    """Take ``distance`` from the JSON payload as a double (non-numeric ->
    null)."""
    return readings.withColumn(
        "distance", F.get_json_object(F.col(payload), "$.distance").try_cast("double"))


def pickup_failed(readings: DataFrame, limit: float = K.PICKUP_DISTANCE_LIMIT) -> DataFrame:
    """Distance above the limit: no block held (equal is fine)."""
    return readings.filter(F.col("distance") > limit)


def colour_mismatch(readings: DataFrame) -> DataFrame:
    """Measured colour (from the byte channels) differs from the expected
    stock colour; UNKNOWN always counts as a mismatch."""
    m = readings.withColumn("measured", rgb_classify("r8", "g8", "b8"))
    return m.filter(F.col("measured") != F.col("expected"))


def next_reading(probes: DataFrame, readings: DataFrame, tolerance_s: int = K.SENSOR_WAIT_SECONDS) -> DataFrame:
    """For each probe ``(id, sensor, t)`` the first reading of the same
    sensor strictly after ``t`` and at most ``tolerance_s`` later; none ->
    ``timed_out``.

    Plan (no pair explosion, no per-sensor task): time is cut into chunks
    of the tolerance width. Within ``(sensor, chunk)`` a reverse-ordered
    running ``last(ignorenulls)`` carries the next reading back to each
    probe (O(n) frame). A probe with no later reading in its chunk takes the
    first reading of the next chunk (a per-chunk ``min_by`` - partial
    aggregation - equi-joined on ``chunk + 1``); anything further is beyond
    the tolerance anyway."""
    width = max(1, tolerance_s) * 1000
    rd = readings.select("sensor", "ts", F.struct(F.col("id").alias("reading_id"), F.col("ts").alias("reading_ts"),
                                                  F.col("distance")).alias("rd"))
    p = probes.select("sensor", F.col("t").alias("ts"), F.col("id").alias("probe_id"),
                      F.lit(None).cast(rd.schema["rd"].dataType).alias("rd"), F.lit(0).alias("kind"))
    u = p.unionByName(rd.withColumn("probe_id", F.lit(None).cast("long")).withColumn("kind", F.lit(1)))
    u = u.withColumn("chunk", F.floor(epoch_ms("ts") / width).cast("long"))
    w = (Window.partitionBy("sensor", "chunk").orderBy(F.col("ts").desc(), F.col("kind").asc())
         .rowsBetween(Window.unboundedPreceding, -1))
    u = u.withColumn("nxt", F.last("rd", ignorenulls=True).over(w))
    probed = u.filter(F.col("kind") == 0)
    # first reading per (sensor, chunk): one min_by per column (fixed-width
    # buffers -> hash aggregation), re-packed afterwards
    firsts = (readings.withColumn("chunk", F.floor(epoch_ms("ts") / width).cast("long"))
              .groupBy("sensor", "chunk")
              .agg(F.min_by("id", F.col("ts")).alias("_id"), F.min("ts").alias("_ts"),
                   F.min_by("distance", F.col("ts")).alias("_d"))
              .select("sensor", (F.col("chunk") - 1).alias("chunk"),
                      F.struct(F.col("_id").alias("reading_id"), F.col("_ts").alias("reading_ts"),
                               F.col("_d").alias("distance")).alias("first_next")))
    j = probed.join(firsts, ["sensor", "chunk"], "left")
    cand = F.coalesce(F.col("nxt"), F.col("first_next"))
    ok = cand.isNotNull() & (cand["reading_ts"] <= F.timestamp_add("SECOND", F.lit(tolerance_s), F.col("ts")))
    return j.select(
        F.col("probe_id").alias("id"), "sensor", F.col("ts").alias("t"),
        F.when(ok, cand["reading_id"]).alias("reading_id"),
        F.when(ok, cand["reading_ts"]).alias("reading_ts"),
        F.when(ok, cand["distance"]).alias("distance"),
        (~ok).alias("timed_out"))
