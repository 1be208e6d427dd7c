"""Queries: broker measurements (§2.6), log checks (§2.7), log sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockyard import constants as K
from blockyard.functions import epoch_ms
from blockyard.operators import broker as B
from blockyard.plans import views as V
from blockyard.plans.registry import query
from blockyard.session import materialize
from blockyard.sources.topic_log import log_start_policy, seek_from_offset

TARGET_TOPICS = [K.INFO_TOPIC, K.ERROR_TOPIC, K.COMPLETE_TOPIC, K.MANUFACTURE_TOPIC]
TARGET = 2000
TICK_S = 86400

SERIES_SQL = """
, ser AS (
  SELECT topic, seq, "offset", partition, ts, produced_ms, (epoch_us(ts) // 1000 + latency_ms) - produced_ms AS latency
  FROM (SELECT *, TRY_CAST(CASE WHEN json_valid(value) THEN json_extract_string(value, '$.timestamp') END AS BIGINT)
                  AS produced_ms FROM event_log)
  WHERE produced_ms IS NOT NULL)"""


def _series(spark, sf, skip: bool = True):
    v = V.event_log(spark, sf, offsets=False)
    return B.latency_series(v, epoch_ms("ts") + F.col("latency_ms"), skip)


@query("latency_series", SERIES_SQL + "\nSELECT topic, seq, latency FROM ser", ("event_log",))
def q_latency_series(spark, sf):
    return _series(spark, sf).select("topic", "seq", "latency")


def _rank_sql(p: float) -> str:
    return f"max(CASE WHEN rn = greatest(1, CAST(ceil({p} * cnt) AS BIGINT)) THEN latency END) AS p{int(p * 100)}"


@query("latency_summary", SERIES_SQL + f"""
, rk AS (SELECT topic, latency, row_number() OVER (PARTITION BY topic ORDER BY latency) AS rn,
                count(*) OVER (PARTITION BY topic) AS cnt FROM ser)
SELECT topic, count(*) AS n, min(latency) AS min, {_rank_sql(0.5)}, {_rank_sql(0.95)}, {_rank_sql(0.99)},
       max(latency) AS max, avg(latency) AS avg
FROM rk GROUP BY topic""", ("event_log",))
def q_latency_summary(spark, sf):
    return B.latency_summary(_series(spark, sf, skip=False))


@query("throughput", SERIES_SQL + """
SELECT topic, count(*) AS n, max(produced_ms) - min(produced_ms) AS elapsed_ms,
       CAST(count(*) AS DOUBLE) * CAST(1000.0 AS DOUBLE)
         / CAST(greatest(1, max(produced_ms) - min(produced_ms)) AS DOUBLE) AS per_second
FROM ser GROUP BY topic""", ("event_log",))
def q_throughput(spark, sf):
    return B.throughput(_series(spark, sf, skip=False))


@query("progress_ticks", SERIES_SQL + f"""
SELECT topic, seq, collected FROM (
  SELECT topic, seq, row_number() OVER (PARTITION BY topic ORDER BY seq) AS collected FROM ser)
WHERE collected % {K.LATENCY_PROGRESS_EVERY} = 0""", ("event_log",))
def q_progress_ticks(spark, sf):
    return B.progress_ticks(_series(spark, sf, skip=False), K.LATENCY_PROGRESS_EVERY).select("topic", "seq", "collected")


@query("target_reached", SERIES_SQL + f"""
, wanted AS (SELECT * FROM (VALUES {", ".join(f"('{t}')" for t in TARGET_TOPICS)}) t(topic)),
cnt AS (SELECT w.topic, CAST(coalesce(c.n, 0) AS BIGINT) AS n
        FROM wanted w LEFT JOIN (SELECT topic, count(*) AS n FROM ser GROUP BY topic) c ON w.topic = c.topic)
SELECT topic, n, n >= {TARGET} AS reached, (SELECT bool_and(n >= {TARGET}) FROM cnt) AS all_reached FROM cnt""",
       ("event_log",))
def q_target_reached(spark, sf):
    return B.target_reached(_series(spark, sf, skip=False), TARGET_TOPICS, TARGET)


@query("partition_lag", """
, kept AS (SELECT l.* FROM event_log l LEFT JOIN log_start s ON l.partition = s.partition
           WHERE l."offset" >= coalesce(s.log_start, 0)),
ends AS (SELECT partition, min("offset") AS log_start, max("offset") + 1 AS log_end FROM kept GROUP BY partition)
SELECT e.partition, e.log_start, CAST(coalesce(c.committed, -1) AS BIGINT) AS committed, e.log_end,
       CASE WHEN coalesce(c.committed, -1) >= 0 AND e.log_end >= 0 THEN e.log_end - coalesce(c.committed, -1) END AS lag,
       CAST(CASE WHEN e.log_start > coalesce(c.committed, -1) AND coalesce(c.committed, -1) >= 0
                 THEN e.log_start - coalesce(c.committed, -1) ELSE 0 END AS BIGINT) AS lost
FROM ends e LEFT JOIN commits c ON e.partition = c.partition""", ("event_log", "commits", "log_start"))
def q_partition_lag(spark, sf):
    return B.partition_lag(V.event_log(spark, sf), V.commits(spark, sf), V.log_start(spark, sf), by=["partition"])


# every partition at every tick: `ends` carried forward over a generated spine
TICKS_SQL = f"""
, t AS (SELECT partition, epoch_us(ts) // 1000 // {TICK_S * 1000} AS tick, max("offset") + 1 AS end_in_tick
        FROM event_log GROUP BY ALL),
spine AS (SELECT partition, unnest(generate_series(lo, hi)) AS tick
          FROM (SELECT partition FROM t UNION SELECT partition FROM commits), (SELECT min(tick) AS lo, max(tick) AS hi FROM t)),
t2 AS (SELECT s.partition, epoch_ms(s.tick * {TICK_S * 1000}) AS tick_start, s.tick,
              CAST(coalesce(max(end_in_tick) OVER (PARTITION BY s.partition ORDER BY s.tick
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS log_end,
              CAST(coalesce(c.committed, -1) AS BIGINT) AS committed
       FROM spine s LEFT JOIN t ON s.partition = t.partition AND s.tick = t.tick LEFT JOIN commits c ON s.partition = c.partition),
t3 AS (SELECT *, CASE WHEN committed >= 0 THEN log_end - committed END AS lag FROM t2)
"""


@query("lag_growth", TICKS_SQL + """
SELECT partition, tick_start, log_end, committed, lag, lag - lag(lag) OVER (PARTITION BY partition ORDER BY tick) AS growth
FROM t3""", ("event_log", "commits"))
def q_lag_growth(spark, sf):
    return B.lag_growth(V.event_log(spark, sf), V.commits(spark, sf), TICK_S, by=["partition"])


@query("redeliveries", """
SELECT partition, "offset", count(*) AS n FROM deliveries GROUP BY partition, "offset" HAVING count(*) > 1""",
       ("deliveries",))
def q_redeliveries(spark, sf):
    return B.redeliveries(V.deliveries(spark, sf), by=["partition"])


@query("skipped_offsets", """
SELECT l.partition, l."offset", l.seq FROM event_log l JOIN commits c ON l.partition = c.partition
WHERE l."offset" > c.processed AND l."offset" < c.committed""", ("event_log", "commits"))
def q_skipped(spark, sf):
    return B.skipped_offsets(V.event_log(spark, sf), V.commits(spark, sf), by=["partition"]).select("partition", "offset", "seq")


@query("log_start_policy", """
, ends AS (SELECT partition, min("offset") AS e, max("offset") + 1 AS l FROM event_log GROUP BY partition),
st AS (SELECT ends.partition, coalesce(c.committed, ends.e) AS start_offset
       FROM ends LEFT JOIN commits c ON ends.partition = c.partition)
SELECT l.seq, l.partition, l."offset" FROM event_log l JOIN st ON l.partition = st.partition
WHERE l."offset" >= st.start_offset""", ("event_log", "commits"))
def q_log_start_policy(spark, sf):
    log = materialize(V.event_log(spark, sf), "log")  # numbered once
    d = log_start_policy(log, V.commits(spark, sf), "earliest", by=("partition",))
    return d.select("seq", "partition", "offset")


@query("log_start_policy_latest", """
, ends AS (SELECT partition, min("offset") AS e, max("offset") + 1 AS l FROM event_log GROUP BY partition),
st AS (SELECT ends.partition, coalesce(c.committed, ends.l) AS start_offset
       FROM ends LEFT JOIN commits c ON ends.partition = c.partition)
SELECT l.seq, l.partition, l."offset" FROM event_log l JOIN st ON l.partition = st.partition
WHERE l."offset" >= st.start_offset""", ("event_log", "commits"))
def q_log_start_policy_latest(spark, sf):
    log = materialize(V.event_log(spark, sf), "log")
    d = log_start_policy(log, V.commits(spark, sf), "latest", by=("partition",))
    return d.select("seq", "partition", "offset")


@query("seek_from_offset", """
SELECT seq, partition, "offset" FROM event_log WHERE topic = 'info.v1' AND partition = 1 AND "offset" >= 500""",
       ("event_log",))
def q_seek(spark, sf):
    return seek_from_offset(V.event_log(spark, sf), K.INFO_TOPIC, 1, 500).select("seq", "partition", "offset")
