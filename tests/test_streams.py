"""Streams resume from their checkpoint: run part of the input, stop, add
the rest, restart with the same checkpoint, and compare with the batch
twin."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from blockyard.operators import stock_log as L
from blockyard.operators import tracker as T
from blockyard.plans import views as V
from blockyard.sources.topic_stream import read_topic_stream, write_topic_log
from blockyard.streaming import operators as SO
from blockyard.streaming.race import late_rows, order_races, race_rows, rocks_state
from blockyard.streaming.stock import StockTable, reserve_stream
from blockyard.streaming.runtime import drain_polls, fresh_path, per_batch_sink, read_log_stream, write_ordered_log
from paths import SF_SMALL

EPOCH = datetime(1970, 1, 2)


def _run(stream, out, ckpt):
    q = (stream.writeStream.outputMode("update").option("checkpointLocation", ckpt)
         .foreachBatch(per_batch_sink(out)).trigger(availableNow=True).start())
    q.awaitTermination()


def test_tracker_stream_resumes_from_checkpoint(spark):
    v1 = V.event_log(spark, SF_SMALL)
    path, out, ckpt = (fresh_path(spark, n) for n in ("log", "out", "ckpt"))
    half = v1.agg(F.max("seq")).first()[0] // 2
    write_ordered_log(v1.filter(F.col("seq") <= half), path, "seq", 2)
    _run(SO.tracker_stream(read_log_stream(spark, path, v1.schema, 1)), out, ckpt)
    first_batches = spark.read.parquet(out).select("batch_id").distinct().count()
    # the rest arrives later; the restarted query continues from its offsets and state
    write_ordered_log(v1.filter(F.col("seq") > half), path, "seq", 2)
    _run(SO.tracker_stream(read_log_stream(spark, path, v1.schema, 1)), out, ckpt)
    got = SO.tracker_rows(spark.read.parquet(out))
    want = T.order_tracker(T.dashboard_events(v1))
    cols = ["order_id", "step", "failed", "item_type", "t0", "t1", "t2", "t3", "last_ts", "n_events"]
    assert first_batches >= 2
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(got.select(*cols)).count() == 0


def test_dedup_stream_drops_cross_batch_redeliveries(spark):
    v1 = V.event_log(spark, SF_SMALL).select("seq", "ts", F.lit("a").alias("topic"), "partition", "offset")
    # another topic has the same partitions and offsets
    v1 = v1.union(v1.select((F.col("seq") + 10**6).alias("seq"), "ts", F.lit("b"), "partition", "offset"))
    path = fresh_path(spark, "dups")
    write_ordered_log(v1, path, "seq", 2)
    # redeliver the first file's rows again, in a later file
    write_ordered_log(v1.filter(F.col("seq") % 3 == 0), path, "seq", 1)
    s = read_log_stream(spark, path, v1.schema, 1)
    out, ckpt = fresh_path(spark, "out"), fresh_path(spark, "ckpt")
    q = (SO.dedup_stream(s, "30 days").drop("event_time").writeStream.option("checkpointLocation", ckpt)
         .foreachBatch(per_batch_sink(out)).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == v1.count()
    assert got.select("topic", "partition", "offset").distinct().count() == v1.count()


def test_reserve_stream_fetch_and_restore(spark):
    """Reserve, fetch and restore mixed in one stream: restored cells are
    free again and the order may reserve again."""
    stock = spark.createDataFrame([(x, 0, "RED", True, None, None) for x in range(3)], L.STOCK)
    rows = [(1, "reserve", "a", 2, "Red"), (2, "reserve", "b", 2, "red"), (3, "fetch", "a", None, None), (4, "reserve", "b", 2, "RED"),
            (5, "restore", "a", None, None), (6, "reserve", "b", 2, "RED"), (7, "reserve", "a", 1, "RED")]
    df = spark.createDataFrame(rows, "seq long, kind string, order_id string, count int, color_raw string")
    path, replies, ckpt = (fresh_path(spark, n) for n in ("stock", "replies", "ckpt"))
    write_ordered_log(df, path, "seq", 1)
    table = StockTable(spark, fresh_path(spark, "table")).load(stock)
    reserve_stream(read_log_stream(spark, path, df.schema, 1), table, replies, ckpt).awaitTermination()
    got = {r.seq: (r.status, r["count"]) for r in spark.read.parquet(replies).collect()}
    assert got[1] == (200, 2)            # a takes (0,0), (1,0)
    assert got[2][0] == 409              # only one left
    assert got[3] == (200, 2)            # a fetches its two cells
    assert got[4][0] == 409              # still one free
    assert got[5] == (200, 2)            # a restores: cells come back
    assert got[6] == (200, 2)            # now b fits
    assert got[7] == (200, 1)            # a holds nothing now; one cell left fits


def test_ordered_log_files_follow_their_ranges(spark):
    """One parallel job per append; modification times rise with the order,
    over appends too, and no file has more records than asked for."""
    import os
    path = fresh_path(spark, "ranges")
    for lo in (0, 1000):
        write_ordered_log(spark.range(lo, lo + 1000).withColumnRenamed("id", "seq"), path, n_files=4, max_records=100)
    folder = path.removeprefix("file:")
    files = sorted((os.path.getmtime(f"{folder}/{f}"), f) for f in os.listdir(folder) if f.startswith("part-"))
    ends = [spark.read.parquet(f"{path}/{f}").agg(F.min("seq"), F.max("seq"), F.count("seq")).first() for _, f in files]
    assert len({t for t, _ in files}) == len(files) >= 20
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert max(e[2] for e in ends) <= 100 and sum(e[2] for e in ends) == 2000


def _race(spark, batches, timeout_s=3600, delay="10 minutes"):
    """Decided and late rows of races whose rows (what, event, order, second) come batch by batch."""
    path, out, ckpt = (fresh_path(spark, n) for n in ("race", "out", "ckpt"))
    schema = "what string, event_id long, order_id string, t long"
    for i, rows in enumerate(batches):
        write_ordered_log(spark.createDataFrame([(*r, i) for r in rows], schema + ", seq long"), path, n_files=1)
    s = read_log_stream(spark, path, schema, 1).select(
        "what", "event_id", "order_id", F.lit("k").alias("correlation_id"), F.timestamp_seconds(F.col("t") + 86400).cast("timestamp_ntz").alias("ts"))
    starts = s.filter("what = 's'").select("order_id", "correlation_id", F.col("ts").alias("start_ts"))
    outs = s.filter("what <> 's'").select("event_id", "order_id", "correlation_id", F.col("what").alias("kind"), "ts")
    with rocks_state(spark):
        q = (order_races(starts, outs, timeout_s, delay).writeStream.option("checkpointLocation", ckpt)
             .foreachBatch(per_batch_sink(out)).trigger(availableNow=True).start())
    q.awaitTermination()
    found = spark.read.parquet(out)
    decided = {r.order_id: (r.winner, r.event_id, int((r.decided_ts - EPOCH).total_seconds())) for r in race_rows(found).collect()}
    return decided, {(r.order_id, r.event_id) for r in late_rows(found).collect()}


def test_races_are_decided_by_timers(spark):
    """Second outcomes, outcomes past the deadline and outcomes of an order that starts in a later batch; a start that
    comes after a later one; an order without an outcome; orders whose deadline the watermark has not passed."""
    decided, late = _race(spark, [
        [("s", -1, "a", 0), ("complete", 1, "a", 60), ("error", 2, "a", 120), ("error", 3, "b", 130), ("s", -1, "d", 300)],
        [("s", -1, "b", 200), ("complete", 5, "b", 200 + 3600), ("s", -1, "d", 100), ("complete", 9, "d", 150), ("complete", 10, "d", 350)],
        [("s", -1, "c", 4000), ("error", 7, "c", 4001), ("complete", 8, "c", 4001), ("s", -1, "e", 4100)],
        [("complete", 11, "a", 9000), ("s", -1, "f", 9000)]])
    assert decided == {"a": ("complete", 1, 60), "b": ("timeout", None, 3800), "c": ("error", 7, 4001), "d": ("complete", 9, 150),
                       "e": ("timeout", None, 7700)}
    assert late == {("a", 2), ("a", 11), ("b", 5), ("c", 8), ("d", 10)}


def test_gate_in_a_stream(spark):
    """Timeout, no block, wrong colour and ok; messages out of order; a message at the probe's time does not count."""
    probes = [(1, 0, 100, 9, 0, 1, "RED"), (2, 0, 200, 9, 0, 1, "BLUE"), (3, 1, 100, 9, 0, 1, "RED"), (4, 1, 300, 9, 0, 1, "RED"), (5, 0, 9000, 9, 0, 1, "RED")]
    reads = [(11, 0, 100, '{"distance": 1}'), (13, 0, 120, '{"distance": 99}'), (12, 0, 110, '{"distance": 25.0}'), (14, 0, 230, '{"distance": 3}'),
             (15, 1, 131, '{"distance": 3}'), (16, 1, 301, '{"distance": 25.5}'), (17, 1, 9000, "x")]
    p = spark.createDataFrame(probes, "id long, sensor int, s long, r8 long, g8 long, b8 long, expected string").withColumn("t", F.timestamp_seconds("s"))
    r = spark.createDataFrame(reads, "id long, sensor int, s long, payload string").withColumn("ts", F.timestamp_seconds("s"))
    pp, rp, out, ckpt = (fresh_path(spark, n) for n in ("probes", "reads", "out", "ckpt"))
    write_ordered_log(p, pp, "s", 2)
    write_ordered_log(r, rp, "id", 2)
    g = SO.sensor_gate_stream(read_log_stream(spark, pp, p.schema, 1), read_log_stream(spark, rp, r.schema, 1), 30, delay="10 minutes")
    g.writeStream.option("checkpointLocation", ckpt).foreachBatch(per_batch_sink(out)).trigger(availableNow=True).start().awaitTermination()
    got = {x.id: (x.reading_id, x.gate) for x in spark.read.parquet(out).collect()}
    assert got == {1: (12, "ok"), 2: (14, "wrong_colour"), 3: (None, "timeout"), 4: (16, "no_block")}


def test_lag_at_ticks_counts_lost_offsets(spark):
    ends = spark.sql("""SELECT 't' AS topic, p AS partition, named_struct('start', timestamp'2024-01-01', 'end', timestamp'2024-01-02') AS w,
                        e AS end_in_tick, 0 AS batch_id FROM VALUES (0, 90L), (0, 100L), (1, 100L), (2, 100L) v(p, e)""")
    commits = spark.sql("SELECT 't' AS topic, p AS partition, c AS committed FROM VALUES (0, 40L), (1, 90L) v(p, c)")
    start = spark.sql("SELECT 't' AS topic, p AS partition, 50L AS log_start FROM VALUES (0), (1), (2) v(p)")
    got = {r.partition: (r.committed, r.lag, r.lost) for r in SO.lag_at_ticks(ends, commits, start, 86400).collect()}
    assert got == {0: (40, 60, 10), 1: (90, 10, 0), 2: (-1, None, 0)}


def test_topic_stream_polls_and_restarts(spark):
    """Polls are bounded, starts follow the policy, a restart goes on at the last planned poll, and new files and
    partitions are found."""
    schema = "topic string, partition int, offset long, value string"
    path = fresh_path(spark, "topic-log")

    def records(topic, p, lo, hi):
        return [(topic, p, o, f"{topic}{p}-{o}") for o in range(lo, hi)]
    first = records("a", 0, 0, 25) + records("a", 1, 10, 14) + records("b.x", 0, 0, 7) + records("other", 0, 0, 9)
    write_topic_log(spark.createDataFrame(first, schema), path, 3)
    out, ckpt = fresh_path(spark, "out"), fresh_path(spark, "ckpt")

    def run(out, ckpt, crash=None, **start):
        def body(df, i):
            per_batch_sink(out)(df, i)
            if i == crash:
                raise RuntimeError("gone")
        q = read_topic_stream(spark, path, ["a", "b.x"], schema, **start).writeStream.option("checkpointLocation", ckpt).foreachBatch(body).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    def got(out):
        return sorted((r.topic, r.partition, r.offset, r.value) for r in spark.read.parquet(out).collect())
    with pytest.raises(Exception):
        run(out, ckpt, crash=1, starting="earliest", max_records=12)  # four of each partition a poll
    run(out, ckpt, starting="earliest", max_records=12)
    assert got(out) == sorted(r for r in first if r[0] != "other")
    sizes = {r.batch_id: r["count"] for r in spark.read.parquet(out).groupBy("batch_id").count().collect()}
    assert sizes == {0: 12, 1: 7, 2: 4, 3: 4, 4: 4, 5: 4, 6: 1}
    more = records("a", 0, 25, 30) + records("a", 7, 3, 5)
    write_topic_log(spark.createDataFrame(more, schema), path, 1)
    run(out, ckpt, starting="earliest", max_records=12)
    assert got(out) == sorted([r for r in first if r[0] != "other"] + more)
    late, given = fresh_path(spark, "late"), fresh_path(spark, "given")
    run(given, fresh_path(spark, "ckpt"), starting={"a": {0: 28, 1: 12}, "b.x": {0: 99}})
    assert got(given) == sorted(records("a", 0, 28, 30) + records("a", 1, 12, 14) + records("a", 7, 3, 5))
    keep = fresh_path(spark, "ckpt")
    run(late, keep, starting="latest")
    write_topic_log(spark.createDataFrame(records("a", 1, 14, 16), schema), path, 1)
    run(late, keep, starting="latest")
    assert got(late) == records("a", 1, 14, 16)


def test_many_polls_in_a_micro_batch(spark):
    """A micro-batch carries many polls, each still bounded, delivered and committed by itself: after a failure in poll 7
    that poll comes again, and no other."""
    schema = "topic string, partition int, offset long, value string"
    rows = [("a", p, o, f"{p}-{o}") for p, n in enumerate((230, 50, 0, 101)) for o in range(3, 3 + n)]
    path = fresh_path(spark, "topic-log")
    write_topic_log(spark.createDataFrame(rows, schema), path, 5)
    stream = read_topic_stream(spark, path, ["a"], schema + ", poll long", "earliest", 30, 9)
    batches = []
    got, tries = drain_polls(stream, spark, "many", transform=lambda b: batches.append(1) or b, crash_in=7)
    assert sorted((r.partition, r.offset, r.value, r.batch_id) for r in got.collect()) \
        == sorted((p, o, v, (o - 3) // 10) for _, p, o, v in rows)
    assert {r.batch_id: r["count"] for r in tries.groupBy("batch_id").count().collect()} == {i: 2 if i == 7 else 1 for i in range(23)}
    assert len(batches) == 4  # polls 0 to 7, 7 to 8, 9 to 17, 18 to 22


def test_gate_meets_probes_and_messages_in_windows(spark):
    """A dense sensor: no join by sensor alone, whose pairs grow with the square of the rows. Probes of a null sensor time
    out, repeated probes come once, messages across a window's edge count, up to the tolerance."""
    probes = [(i, i % 2, 100 + i, 9, 0, 1, "RED") for i in range(400)] + [(7, 1, 107, 9, 0, 1, "RED"), (900, None, 150, 9, 0, 1, "RED"), (999, 0, 5000, 9, 0, 1, "RED")]
    reads = [(10000 + i, i % 2, 100 + 7 * i, '{"distance": 3}') for i in range(60)] + [(20000, None, 151, '{"distance": 3}'), (20001, 0, 5000, "x")]
    p = spark.createDataFrame(probes, "id long, sensor int, s long, r8 long, g8 long, b8 long, expected string").withColumn("t", F.timestamp_seconds("s"))
    r = spark.createDataFrame(reads, "id long, sensor int, s long, payload string").withColumn("ts", F.timestamp_seconds("s"))
    pp, rp, out = (fresh_path(spark, n) for n in ("probes", "reads", "out"))
    write_ordered_log(p, pp, "s", 1)
    write_ordered_log(r, rp, "id", 1)
    g = SO.sensor_gate_stream(read_log_stream(spark, pp, p.schema, 1), read_log_stream(spark, rp, r.schema, 1), 9, delay="10 minutes")
    assert "Join" not in g._jdf.queryExecution().analyzed().toString()
    g.writeStream.option("checkpointLocation", fresh_path(spark, "ckpt")).foreachBatch(per_batch_sink(out)).trigger(availableNow=True).start().awaitTermination()
    want = []
    for i, sensor, s, *_ in set(probes[:-1]):
        later = sorted((t, e) for e, x, t, _ in reads if x == sensor and x is not None and s < t <= s + 9)
        want.append((i, later[0][1] if later else None))
    assert sorted(((x.id, x.reading_id) for x in spark.read.parquet(out).collect()), key=str) == sorted(want, key=str)


def test_a_bucket_of_races_is_one_call(spark):
    """Orders share a bucket's state and timer: 5,000 orders in one step, against a plain reading of each."""
    import pandas as pd
    from blockyard.streaming.race import BUCKETS, OPEN, OrderRace
    rows = [(f"o{i}", "k", *r) for i in range(5000) for r in (
        ("start", i * 1_000_000, -1, 0), ("error", i * 1_000_000 + i % 9 * 1_000_000, 10 * i, 2), ("complete", i * 1_000_000 + 3_000_000, 10 * i + 1, 2))]
    found, left, wake = OrderRace(6, 60)._decide(pd.DataFrame(rows, columns=OPEN), 4_000_000)
    want = {(f"o{i}", "decided", "error" if i % 9 <= 3 else "complete") for i in range(3995)}
    want |= {(f"o{i}", "late", None) for i in range(3995)}
    assert {(r.order_id, r.result, r.winner) for r in found.itertuples()} == want and len(found) == len(want)
    assert len(left) == 3995 + 3 * 1005 and wake == 66_000
    s = spark.readStream.format("rate").load().select(F.lit("o").alias("order_id"), F.lit("k").alias("correlation_id"), F.col("timestamp").alias("ts"),
                                                       F.lit("error").alias("kind"), F.col("value").alias("event_id"))
    plan = order_races(s.withColumnRenamed("ts", "start_ts"), s, 6)._jdf.queryExecution().analyzed().toString()
    assert BUCKETS > 1 and "bucket" in plan
