"""Queries: joins and races (§2.5), sensor checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockyard.operators import correlate as C
from blockyard.operators import motion as M
from blockyard.operators import sensors as SN
from blockyard.operators import stock as S
from blockyard.plans import views as V
from blockyard.plans.registry import query

RACE_S = 6 * 3600
ASSEMBLY_S = 3 * 3600
TOLERANCE_S = 2 * 3600

MATCH_SQL = """
, win AS (
  SELECT w.order_id, w.correlation_id, w.start_ts, o.event_id, o.kind, o.ts
  FROM waiting w JOIN outcomes o ON w.order_id = o.order_id AND w.correlation_id = o.correlation_id
   AND o.ts >= w.start_ts AND o.ts < w.start_ts + INTERVAL {h} HOUR),
matched AS (
  SELECT order_id, correlation_id, start_ts, arg_min(event_id, ts) AS event_id, arg_min(kind, ts) AS kind,
         min(ts) AS ts
  FROM win GROUP BY order_id, correlation_id, start_ts)"""


@query("correlate_outcomes", MATCH_SQL.format(h=6) + "\nSELECT * FROM matched", ("waiting", "outcomes"))
def q_correlate(spark, sf):
    return C.correlate_outcomes(V.waiting(spark, sf), V.outcomes(spark, sf), RACE_S)


@query("uncorrelated_events", MATCH_SQL.format(h=6) + """
SELECT o.* FROM outcomes o WHERE o.event_id NOT IN (SELECT event_id FROM matched)""", ("waiting", "outcomes"))
def q_uncorrelated(spark, sf):
    o = V.outcomes(spark, sf)
    m = C.correlate_outcomes(V.waiting(spark, sf), o, RACE_S)
    return C.uncorrelated_events(o, m)


RACE_SQL = MATCH_SQL + """
SELECT w.order_id, w.correlation_id, w.start_ts, coalesce(m.kind, 'timeout') AS winner, m.event_id,
       coalesce(m.ts, w.start_ts + INTERVAL {h} HOUR) AS decided_ts
FROM waiting w LEFT JOIN matched m ON w.order_id = m.order_id AND w.correlation_id = m.correlation_id"""


@query("order_race", RACE_SQL.format(h=6), ("waiting", "outcomes"))
def q_order_race(spark, sf):
    return C.order_race(V.waiting(spark, sf), V.outcomes(spark, sf), RACE_S)


@query("assembly_timeout", RACE_SQL.format(h=3), ("waiting", "outcomes"))
def q_assembly_timeout(spark, sf):
    return C.assembly_timeout(V.waiting(spark, sf), V.outcomes(spark, sf), ASSEMBLY_S)


@query("duplicate_waiting", """
SELECT order_id, correlation_id, count(*) AS n FROM event_log WHERE event_type = 'signup'
GROUP BY order_id, correlation_id HAVING count(*) > 1""", ("event_log",))
def q_duplicate_waiting(spark, sf):
    """Keys under which more than one order waits (every start of an order, not only its first): correlating to them is
    ambiguous."""
    log = V.event_log(spark, sf, offsets=False)
    return C.duplicate_waiting(log.filter(F.col("event_type") == "signup").select("order_id", "correlation_id"))


@query("duplicate_reservations", """
SELECT seq, order_id FROM requests
WHERE item IS NOT NULL AND order_id IN (SELECT order_id FROM cells WHERE order_id IS NOT NULL
                                        UNION SELECT order_id FROM fetch_log)""",
       ("requests", "cells", "fetch_log"))
def q_dup_reservations(spark, sf):
    r = V.requests(spark, sf).filter(F.col("item").isNotNull())
    return S.duplicate_reservations(r, V.cells(spark, sf), V.fetch_log(spark, sf)).select("seq", "order_id")


POS_SQL = """
, pos AS (SELECT order_id, CAST(row_number() OVER (PARTITION BY order_id ORDER BY x, y) AS BIGINT) AS pos, x, y, color
          FROM cells WHERE filled AND order_id IS NOT NULL)"""


@query("assembly_zip", POS_SQL + """
, plan AS (SELECT * FROM (VALUES ('CHAIR', 1, 0, 0, 0), ('TABLE', 1, 0, 0, 0), ('TABLE', 2, 1, 0, 0),
                                 ('SHELF', 1, 0, 0, 0), ('SHELF', 2, 0, 0, 1), ('CLOSET', 1, 0, 0, 0),
                                 ('CLOSET', 2, 0, 0, 1), ('CLOSET', 3, 0, 0, 2)) t(item, pos, ax, ay, az)),
ords AS (SELECT order_id, item FROM requests WHERE NOT is_repeat AND item IS NOT NULL)
SELECT p.order_id, p.pos, p.x, p.y, p.color, o.item, CAST(pl.ax AS INTEGER) AS ax, CAST(pl.ay AS INTEGER) AS ay,
       CAST(pl.az AS INTEGER) AS az, CAST(pl.ax * 26 AS INTEGER) AS move_dx, CAST(-85 + pl.az * 26 AS INTEGER) AS move_dz
FROM pos p JOIN ords o ON p.order_id = o.order_id JOIN plan pl ON pl.item = o.item AND pl.pos = p.pos""",
       ("cells", "requests"))
def q_assembly_zip(spark, sf):
    pos = S.reserved_positions(V.cells(spark, sf))
    ords = V.requests(spark, sf).filter(~F.col("is_repeat") & F.col("item").isNotNull()).select("order_id", "item")
    from blockyard.functions import assembly_offset
    z = M.assembly_zip(pos, ords)
    move = assembly_offset("ax", "az")
    return z.select("order_id", "pos", "x", "y", "color", "item", "ax", "ay", "az",
                    move["dx"].alias("move_dx"), move["dz"].alias("move_dz"))


@query("order_positions", POS_SQL + """
SELECT r.seq, r.order_id, p.pos, p.x, p.y, p.color
FROM (SELECT seq, order_id FROM requests WHERE item IS NOT NULL) r LEFT JOIN pos p ON r.order_id = p.order_id""",
       ("cells", "requests"))
def q_order_positions(spark, sf):
    r = V.requests(spark, sf).filter(F.col("item").isNotNull()).select("seq", "order_id")
    return S.order_positions(r, V.cells(spark, sf)).select("seq", "order_id", "pos", "x", "y", "color")


@query("colour_mismatch", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, expected, measured FROM (
  SELECT *, CASE WHEN r8 > g8 AND g8 > b8 THEN 'YELLOW' WHEN r8 > g8 AND r8 > b8 THEN 'RED'
                 WHEN g8 > r8 AND g8 > b8 THEN 'GREEN' WHEN b8 > r8 AND b8 > g8 THEN 'BLUE'
                 ELSE 'UNKNOWN' END AS measured FROM colour_readings)
WHERE measured <> expected""", ("colour_readings",))
def q_colour_mismatch(spark, sf):
    c = SN.colour_mismatch(V.colour_readings(spark, sf))
    return c.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "expected", "measured")


@query("next_reading", f"""
, rd AS (SELECT id AS reading_id, sensor, ts AS reading_ts,
                TRY_CAST(json_extract_string(payload, '$.distance') AS DOUBLE) AS distance FROM readings),
j AS (SELECT p.id, p.sensor, p.t, r.reading_id, r.reading_ts, r.distance
      FROM probes p ASOF LEFT JOIN rd r ON p.sensor = r.sensor AND r.reading_ts > p.t)
SELECT id, sensor, t,
       CASE WHEN ok THEN reading_id END AS reading_id, CASE WHEN ok THEN reading_ts END AS reading_ts,
       CASE WHEN ok THEN distance END AS distance, NOT ok AS timed_out
FROM (SELECT *, coalesce(reading_ts <= t + INTERVAL {TOLERANCE_S} SECOND, false) AS ok FROM j)""",
       ("probes", "readings"))
def q_next_reading(spark, sf):
    rd = SN.with_distance(V.readings(spark, sf))
    return SN.next_reading(V.probes(spark, sf), rd, TOLERANCE_S)
