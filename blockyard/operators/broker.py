"""Broker measurements over a topic log: latency, throughput, progress,
targets, partition lag and loss, lag growth, redelivery, skipped offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockyard.functions import epoch_ms, safe_epoch
from blockyard.operators.sequencing import chunk_of, running_many
from blockyard.session import materialize

SEQ_CHUNK = 1 << 20
#: What identifies a partition of a log; a log of one topic may go by "partition" alone.
PARTITION = ("topic", "partition")


def latency_series(log: DataFrame, arrival_ms: F.Column, skip: bool = True) -> DataFrame:
    """Per message: latency = arrival - produced time (payload
    ``timestamp``); messages without a numeric timestamp are skipped.

    ``skip=False`` keeps them with null ``produced_ms`` / ``latency``: the
    aggregations below ignore nulls, so they need no filter before the
    aggregation (a filter there would be pushed, with the payload decoding,
    into the scan)."""
    d = log.withColumn("produced_ms", safe_epoch("value"))
    if skip:
        d = d.filter(F.col("produced_ms").isNotNull())
    return d.withColumn("latency", arrival_ms - F.col("produced_ms"))


VALUE_CHUNK = 1 << 12
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_summary(series: DataFrame, by: Sequence[str] = ("topic",), approx: bool = False) -> DataFrame:
    """count, min, p50, p95, p99 (nearest rank), max, avg per group; messages
    without a latency do not count.

    Exact by counting: messages per (group, latency) are a partial
    aggregation, whose counts run on over chunks of VALUE_CHUNK latencies; a
    percentile is the least latency whose running count reaches its rank. No
    buffer or task holds the values of a group. ``approx=True`` builds one
    mergeable KLL sketch per group instead, of fixed size."""
    by, n, v = list(by), F.col("n"), F.col("latency")
    known = series.filter(v.isNotNull()) if approx else series.groupBy(*by, "latency").agg(F.count("latency").alias("n"))
    if approx:
        g = known.groupBy(*by).agg(F.count("latency").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
                                   F.avg(v).alias("avg"), F.kll_sketch_agg_bigint(v.cast("long")).alias("_kll"))
        quantiles = [F.kll_sketch_get_quantile_bigint("_kll", F.lit(p)).alias(name) for name, p in PERCENTILES.items()]
        return g.select(*by, "n", "min", *quantiles, "max", "avg")
    counts = materialize(known.filter(n > 0).withColumn("latency", v.cast("long")), "latency-counts")
    totals = counts.groupBy(*by).agg(F.sum(n).alias("_all"))
    upto = running_many(counts, by, ["latency"], [(n, "_upto", "sum")], chunk_of("latency", VALUE_CHUNK))
    ranked = upto.join(totals, by)
    at = [F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_all"))), v)).alias(name)
          for name, p in PERCENTILES.items()]
    return ranked.groupBy(*by).agg(F.sum(n).alias("n"), F.min(v).alias("min"), *at, F.max(v).alias("max"),
                                   (F.sum(v * n) / F.sum(n)).alias("avg"))


def throughput(series: DataFrame, by: Sequence[str] = ("topic",), time_ms: str = "produced_ms") -> DataFrame:
    """Messages per second per scenario: ``count * 1000 / max(1, elapsed)``."""
    t = F.col(time_ms)
    g = series.groupBy(*by).agg(F.count(t).alias("n"), (F.max(t) - F.min(t)).alias("elapsed_ms")) \
        .filter(F.col("n") > 0)
    return g.withColumn("per_second", F.col("n") * 1000.0 / F.greatest(F.lit(1), F.col("elapsed_ms")))


def progress_ticks(series: DataFrame, every: int, by: str = "topic", order: str = "seq") -> DataFrame:
    """A row each ``every`` collected messages per topic (running count of
    messages with a latency, chunked so a topic is not one task)."""
    ok = F.col("latency").isNotNull()
    d = running_many(series, [by], [order], [(F.when(ok, F.lit(1)).otherwise(F.lit(0)).cast("long"),
                                              "collected", "sum")], chunk_of(order, SEQ_CHUNK))
    return d.filter(ok & (F.col("collected") % every == 0))


def target_reached(series: DataFrame, topics: Sequence[str], target: int, by: str = "topic") -> DataFrame:
    """Per topic of the list: count and whether it reached ``target``;
    ``all_reached`` = every topic did (topics without rows count as 0)."""
    counts = series.groupBy(by).agg(F.count("latency").alias("n"))
    spark = series.sparkSession
    # the topic list is the caller's literal list: bounded by construction
    wanted = spark.createDataFrame([(t,) for t in topics], f"{by} string")
    d = (wanted.join(counts, by, "left")
         .withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
         .withColumn("reached", F.col("n") >= target))
    # one window over the rows of the literal list, so the log is aggregated once
    return d.withColumn("all_reached", F.bool_and("reached").over(Window.partitionBy(F.lit(1))))


def partition_lag(log: DataFrame, commits: DataFrame, log_start: DataFrame | None = None,
                  by: Sequence[str] = PARTITION) -> DataFrame:
    """Per partition: log start, committed (-1 unknown), log end, lag =
    end - committed (null when unknown), lost = start - committed when
    retention passed the consumer. Retention drops offsets below
    ``log_start``; a partition that it emptied starts and ends there, and
    stays in the result. One partial aggregation; the joined tables have one
    row per partition."""
    by = list(by)
    start = F.min("offset")
    if log_start is not None:
        known = log_start.select(*by, F.col("log_start").alias("_from"))
        ends = log.groupBy(*by).agg((F.max("offset") + 1).alias("_end"), start.alias("_least")).join(known, by, "full")
        first = F.greatest(F.coalesce("_least", F.lit(0)), F.coalesce("_from", F.lit(0)))
        ends = ends.select(*by, F.when(F.col("_end") > first, first).otherwise(F.coalesce("_from", first)).cast("long").alias("log_start"),
                           F.greatest(F.col("_end"), F.col("_from")).cast("long").alias("log_end"))
    else:
        ends = log.groupBy(*by).agg(start.alias("log_start"), (F.max("offset") + 1).alias("log_end"))
    d = ends.join(commits.select(*by, "committed"), by, "left")
    c = F.coalesce(F.col("committed"), F.lit(-1)).cast("long")
    return d.select(
        *by, "log_start", c.alias("committed"), "log_end",
        F.when((c >= 0) & (F.col("log_end") >= 0), F.col("log_end") - c).alias("lag"),
        F.when((F.col("log_start") > c) & (c >= 0), F.col("log_start") - c).otherwise(F.lit(0)).cast("long").alias("lost"))


def tick_ends(log: DataFrame, tick_s: int, by: Sequence[str] = PARTITION) -> DataFrame:
    """Log end per partition and tick with messages: ``tick_start, end_in_tick``."""
    ticks = (log.groupBy(*by, F.window(F.col("ts").cast("timestamp"), f"{tick_s} seconds").alias("w"))
             .agg((F.max("offset") + 1).alias("end_in_tick")))
    return ticks.select(*by, F.col("w.start").cast("timestamp_ntz").alias("tick_start"), "end_in_tick")


def every_tick(ends: DataFrame, commits: DataFrame, tick_s: int, by: Sequence[str] = PARTITION) -> DataFrame:
    """``by, tick_start, tick_no, log_end, committed, lag`` for every partition
    (of the log or committed) at every tick between the first and the last of
    all: a monitor that polls reports idle partitions too. ``ends``: one row
    per partition and tick with messages; the end runs on where there are none,
    from 0. The spine has one row per partition and tick; the running maximum
    is chunked, so a long history is not one task."""
    by, width = list(by), F.lit(tick_s * 1000)
    number = F.floor(epoch_ms("tick_start") / width).cast("long")
    # one row per partition and tick: staging it is cheap and keeps the passes below from re-expanding the log plan
    ends = materialize(ends.withColumn("tick_no", number), "tick-ends")
    span = ends.agg(F.min("tick_no").alias("lo"), F.max("tick_no").alias("hi"))
    parts = ends.select(*by).unionByName(commits.select(*by)).distinct()
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    spine = parts.withColumn("tick_no", F.explode(F.when(lo.isNotNull(), F.sequence(lo, hi))))
    d = spine.join(ends.select(*by, "tick_no", "end_in_tick"), [*by, "tick_no"], "left").join(commits.select(*by, "committed"), by, "left")
    d = running_many(d, by, ["tick_no"], [(F.col("end_in_tick"), "_end", "max")], chunk_of("tick_no", 1 << 16), stage=True)
    c = F.coalesce(F.col("committed"), F.lit(-1)).cast("long")
    d = d.withColumn("log_end", F.coalesce("_end", F.lit(0)).cast("long"))
    return d.select(*by, F.timestamp_millis(F.col("tick_no") * width).cast("timestamp_ntz").alias("tick_start"), "tick_no", "log_end",
                    c.alias("committed"), F.when(c >= 0, F.col("log_end") - c).alias("lag"))


def lag_growth(log: DataFrame, commits: DataFrame, tick_s: int, by: Sequence[str] = PARTITION) -> DataFrame:
    """Lag of every partition at each poll tick and its growth since the
    previous tick (a running "previous", chunked)."""
    by = list(by)
    d = every_tick(tick_ends(log, tick_s, by), commits, tick_s, by)
    d = running_many(d, by, ["tick_no"], [(F.col("lag"), "_prev_lag", "prev")], chunk_of("tick_no", 1 << 16), stage=True)
    return d.select(*by, "tick_start", "log_end", "committed", "lag",
                    (F.col("lag") - F.col("_prev_lag")).alias("growth"))


def redeliveries(deliveries: DataFrame, by: Sequence[str] = PARTITION) -> DataFrame:
    """Same partition and offset delivered more than once."""
    return (deliveries.groupBy(*by, "offset").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def skipped_offsets(log: DataFrame, commits: DataFrame, by: Sequence[str] = PARTITION) -> DataFrame:
    """Rows a restarted consumer never processes because it committed ahead
    of what it processed: ``processed < offset < committed``. One row per
    partition on the small side, then a range filter."""
    by = list(by)
    d = log.join(commits.select(*by, "processed", "committed"), by, "inner")
    return d.filter((F.col("offset") > F.col("processed")) & (F.col("offset") < F.col("committed")))
