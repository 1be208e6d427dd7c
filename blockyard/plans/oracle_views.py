"""The derived views V1-V11 as DuckDB SQL (the independent oracle side).

``with_views(sql, *names)`` prefixes a query with the CTEs it needs, in
dependency order. The driver pre-registers the parquet tables as views.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {
    "ev0": ([], """
SELECT event_id AS seq, ts, user_id, event_type,
       CAST(user_id % 4 AS INTEGER) AS partition,
       CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS order_id,
       CAST(round(value * 100) AS BIGINT) AS latency_ms,
       value,
       md5(CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d')) AS correlation_id,
       CASE WHEN event_id % 5 = 0 THEN CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d')
            ELSE concat_ws('-', substr(md5(CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d')), 1, 8),
                                substr(md5(CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d')), 9, 4),
                                substr(md5(CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d')), 13, 4),
                                substr(md5(CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d')), 17, 4),
                                substr(md5(CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d')), 21, 12)) END AS uuid_text,
       CASE event_type WHEN 'signup' THEN 'info.v1' WHEN 'view' THEN 'info.v1' WHEN 'click' THEN 'info.v1'
                       WHEN 'purchase' THEN 'order.complete.v1' WHEN 'error' THEN 'error.v1' END AS topic,
       CASE event_type
         WHEN 'signup' THEN 'Order received: ' || CASE user_id % 4 WHEN 0 THEN 'CHAIR' WHEN 1 THEN 'TABLE'
                                                                   WHEN 2 THEN 'Shelf' ELSE 'closet' END
         WHEN 'view' THEN 'Inventory reserved'
         WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'Manufacturing succeeded via feedback'
                                ELSE 'Manufacturing started' END
         WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'Order complete' END
         WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'Inventory service unavailable'
                                             WHEN 1 THEN 'Manufacturing failed'
                                             ELSE 'Factory reported an error' END
       END AS message,
       CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS "offset",
       CAST(CAST(user_id % 4 AS INTEGER) AS VARCHAR) AS key
FROM events"""),
    "event_log": (["ev0"], """
SELECT * REPLACE (
  CASE WHEN seq % 50 = 0 THEN 'oops ' || CAST(seq AS VARCHAR)
       WHEN seq % 50 = 1 THEN '[1]'
       ELSE '{"message":' || CASE WHEN message IS NULL THEN 'null' ELSE '"' || message || '"' END
            || ',"orderId":"' || CASE WHEN seq % 50 = 2 THEN '' ELSE order_id END
            || '","correlationId":"' || correlation_id || '","timestamp":'
            || CAST(epoch_us(ts) // 1000 AS VARCHAR) || '}' END AS value)
FROM ev0"""),
    "waiting": (["event_log"], """
SELECT order_id, correlation_id, min(ts) AS start_ts
FROM event_log WHERE event_type = 'signup' GROUP BY order_id, correlation_id"""),
    "outcomes": (["event_log"], """
SELECT seq AS event_id, order_id,
       CASE WHEN seq % 7 = 0 THEN md5(order_id || '#') ELSE correlation_id END AS correlation_id,
       ts, CASE WHEN event_type = 'purchase' THEN 'complete' ELSE 'error' END AS kind
FROM event_log WHERE event_type IN ('purchase', 'error')"""),
    "cells": ([], """
SELECT p_partkey // 4 AS x, p_partkey % 4 AS y,
       CASE p_partkey % 4 WHEN 0 THEN 'RED' WHEN 1 THEN 'GREEN' WHEN 2 THEN 'BLUE' ELSE 'YELLOW' END AS color,
       p_partkey % 11 <> 0 AS filled,
       (p_partkey % 11 <> 0 AND p_partkey % 5 = 0) AS reserved,
       CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 5 = 0 THEN CAST(p_partkey % 300 AS VARCHAR) END AS order_id
FROM part"""),
    "fetch_log": ([], """
SELECT CAST(p_partkey % 300 AS VARCHAR) AS order_id, p_partkey // 4 AS x, p_partkey % 4 AS y,
       CASE p_partkey % 4 WHEN 0 THEN 'RED' WHEN 1 THEN 'GREEN' WHEN 2 THEN 'BLUE' ELSE 'YELLOW' END AS color
FROM part WHERE p_partkey % 11 = 0"""),
    "requests": ([], """
WITH base AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS order_id,
         CASE WHEN o_orderkey % 97 = 0 THEN 'sofa'
              ELSE CASE o_orderkey % 4 WHEN 0 THEN 'Chair' WHEN 1 THEN ' table ' WHEN 2 THEN 'SHELF' ELSE 'closet' END
         END AS item_raw,
         CASE WHEN o_orderkey % 89 = 0 THEN 'purple'
              ELSE ['Red', 'green', 'BLUE', 'Yellow'][(o_orderkey // 4) % 4 + 1] END AS color_raw,
         CASE WHEN o_orderkey % 89 = 0 THEN 'purple'
              ELSE ['Red', 'green', 'BLUE', 'Yellow'][(o_orderkey // 4 + (o_orderkey % 25 = 3)::INT) % 4 + 1] END AS second_raw,
         CASE o_orderkey % 7 WHEN 5 THEN 409 WHEN 6 THEN 503 ELSE 200 END AS status
  FROM orders),
r AS (SELECT 2 * k AS seq, false AS is_repeat, order_id, item_raw, color_raw, status FROM base UNION ALL
      SELECT 2 * k + 1, true, order_id, item_raw, second_raw, status FROM base WHERE k % 10 = 0 OR k % 25 = 3),
n AS (SELECT *, CASE WHEN item_raw IN ('CHAIR','TABLE','SHELF','CLOSET') THEN item_raw
                     WHEN upper(trim(item_raw)) IN ('CHAIR','TABLE','SHELF','CLOSET') THEN upper(trim(item_raw))
                END AS item FROM r)
SELECT *, CASE item WHEN 'CHAIR' THEN 1 WHEN 'TABLE' THEN 2 WHEN 'SHELF' THEN 2 WHEN 'CLOSET' THEN 3 END AS count
FROM n"""),
    "stock_log": (["requests"], """
SELECT seq * 1000 AS seq, 'reserve' AS kind, order_id, count, color_raw FROM requests
UNION ALL SELECT o_orderkey * 2000 + 50500, 'fetch', CAST(o_orderkey AS VARCHAR), NULL, NULL FROM orders WHERE o_orderkey % 6 = 1
UNION ALL SELECT (o_orderkey % 3 + 1) * 2000000 + 1 + o_orderkey, 'restore', CAST(o_orderkey AS VARCHAR), NULL, NULL
FROM orders WHERE o_orderkey < 300 AND o_orderkey % 10 IN (5, 7)"""),
    "probes": ([], """
SELECT event_id AS id, CAST(user_id % 10 AS INTEGER) AS sensor, ts AS t
FROM events WHERE event_type = 'click'"""),
    "readings": ([], """
SELECT event_id AS id, CAST(user_id % 10 AS INTEGER) AS sensor, ts,
       '{"distance":' || CAST(value % 60 AS VARCHAR) || '}' AS payload
FROM events WHERE event_type = 'view'"""),
    "deliveries": (["event_log"], """
SELECT *, 1 AS delivery FROM event_log
UNION ALL SELECT *, 2 AS delivery FROM event_log WHERE "offset" % 10 = 0"""),
    "pends": (["event_log"], """
SELECT partition, max("offset") AS m FROM event_log GROUP BY partition"""),
    "commits": (["pends"], """
SELECT partition, committed,
       CAST(CASE partition WHEN 0 THEN committed - 5 WHEN 1 THEN committed - 10 ELSE committed END AS BIGINT) AS processed
FROM (SELECT partition,
             CAST(CASE partition WHEN 0 THEN floor(m * 0.6) WHEN 1 THEN floor(m * 0.9)
                                 WHEN 2 THEN floor(m * 0.2) END AS BIGINT) AS committed
      FROM pends WHERE partition <> 3)"""),
    "log_start": (["pends"], """
SELECT partition, CAST(CASE WHEN partition = 2 THEN floor(m * 0.5) ELSE 0 END AS BIGINT) AS log_start
FROM pends"""),
    "commands": ([], """
SELECT l_suppkey AS robot,
       CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS seq,
       CASE WHEN l_linenumber % 4 = 0 THEN 'MovementCommand'
            WHEN l_linenumber % 4 IN (1, 2) THEN 'RelativeMovementCommand'
            ELSE 'SuctionCupCommand' END AS kind,
       CAST(CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_quantity AS INTEGER)
                 WHEN l_linenumber % 4 IN (1, 2) THEN CAST(l_quantity AS INTEGER) - 25 END AS DOUBLE) AS x,
       CAST(CASE WHEN l_linenumber % 4 IN (0, 1) THEN round(l_discount * 100) END AS DOUBLE) AS y,
       CAST(CASE WHEN l_linenumber % 4 <> 3 THEN round(l_tax * 100) END AS DOUBLE) AS z,
       CASE WHEN l_linenumber % 4 <> 3 THEN CAST(0.0 AS DOUBLE) END AS r,
       CASE WHEN l_linenumber % 4 = 3 THEN l_returnflag = 'R' END AS suck
FROM lineitem"""),
    "robot_commands": (["commands"], """
SELECT robot, seq,
       CASE k WHEN 1 THEN 'MovementSpeedCommand' WHEN 2 THEN 'MoveConveyorCommand' WHEN 3 THEN 'RunConveyorCommand' ELSE kind END AS kind,
       CASE WHEN o THEN NULL ELSE x END AS x, CASE WHEN o THEN NULL ELSE y END AS y, CASE WHEN o THEN NULL ELSE z END AS z,
       CASE WHEN o THEN NULL ELSE r END AS r, suck, CASE WHEN o THEN x + 30 END AS speed,
       CASE WHEN k = 1 AND z > 3 THEN z * 10 END AS acceleration, CASE WHEN k = 2 THEN z * 2 END AS distance,
       CASE WHEN k IN (2, 3) THEN CASE WHEN x > 0 THEN 'FORWARD' ELSE 'BACKWARD' END END AS direction
FROM (SELECT *, coalesce(k IN (1, 2, 3), false) AS o
      FROM (SELECT *, CASE WHEN kind = 'RelativeMovementCommand' THEN CAST(x + z AS INTEGER) % 7 END AS k FROM commands))"""),
    "colour_readings": ([], """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_partkey * 31 % 1000 AS r, l_suppkey * 97 % 1000 AS g, l_orderkey * 13 % 1000 AS b,
       CAST(CASE WHEN l_orderkey % 101 = 0 THEN 0
                 ELSE (l_partkey * 31 % 1000 + l_suppkey * 97 % 1000 + l_orderkey * 13 % 1000) % 1500 END AS BIGINT) AS clear,
       l_partkey % 256 AS r8, l_suppkey * 7 % 256 AS g8, l_orderkey * 13 % 256 AS b8,
       CASE l_linenumber % 4 WHEN 0 THEN 'RED' WHEN 1 THEN 'GREEN' WHEN 2 THEN 'BLUE' ELSE 'YELLOW' END AS expected,
       192 AS integration_code, 4 AS gain, CAST(1.0 AS DOUBLE) AS glass
FROM lineitem"""),
    "attempts": ([], """
SELECT l_orderkey AS order_key,
       CASE l_linenumber % 3 WHEN 0 THEN 'reserve' WHEN 1 THEN 'reset after timeout' ELSE 'reset after error' END AS activity,
       CASE l_linenumber % 3 WHEN 0 THEN 'Activity_reserveInventory' WHEN 1 THEN 'Activity_0uhz0y6'
                             ELSE 'Activity_0ezfqp2' END AS activity_id,
       l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'R' AS success, l_partkey % 3 <> 0 AS technical
FROM lineitem"""),
    "ledger0": ([], """
SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS seq,
       l_partkey AS cell, l_partkey // 4 AS x, l_partkey % 4 AS y,
       CASE l_partkey % 4 WHEN 0 THEN 'RED' WHEN 1 THEN 'GREEN' WHEN 2 THEN 'BLUE' ELSE 'YELLOW' END AS color,
       CASE l_linenumber % 3 WHEN 0 THEN 'reserve' WHEN 1 THEN 'fetch' ELSE 'restore' END AS action,
       CAST(l_suppkey % 3 AS VARCHAR) AS order_id
FROM lineitem"""),
    "ledger": (["ledger0"], """
SELECT * FROM ledger0
UNION ALL SELECT max(seq) // 2, NULL, NULL, NULL, NULL, 'restore_all', NULL FROM ledger0"""),
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """``WITH <views...> <sql>``; a query may add its own CTEs after a
    comma by starting ``sql`` with ``, name AS (...)``."""
    parts = [f"{n} AS ({VIEWS[n][1].strip()})" for n in _closure(names)]
    sql = sql.strip()
    if not parts:
        return sql
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)
    if sql.startswith(","):
        return head + sql
    return head + "\n" + sql
