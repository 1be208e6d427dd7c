"""Queries: stock allocation and ledger (§2.8), stock aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockyard import constants as K
from blockyard.operators import stock as S
from blockyard.operators.ledger import ledger_replay
from blockyard.plans import views as V
from blockyard.plans.registry import query


COLOUR_CODE = "CASE upper(color_raw) WHEN 'RED' THEN 1 WHEN 'GREEN' THEN 2 WHEN 'BLUE' THEN 3 WHEN 'YELLOW' THEN 4 ELSE 0 END"
FREE_SQL = "[" + ", ".join(
    f"(SELECT count(*) FROM cells WHERE filled AND NOT reserved AND color = '{c}')" for c in K.ORDER_COLOURS) + "]"

# one request at a time: `free` blocks per colour, `got` the orders that were granted
ALLOC_SQL = f"""
, rq AS (SELECT seq, order_id, count, color_raw, upper(color_raw) AS color, {COLOUR_CODE} AS c FROM requests),
holders AS (SELECT order_id FROM cells WHERE order_id IS NOT NULL UNION SELECT order_id FROM fetch_log),
ok AS (SELECT rq.*, h.order_id IS NOT NULL AS held FROM rq LEFT JOIN holders h ON rq.order_id = h.order_id
       WHERE c > 0 AND count IS NOT NULL),
elig AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) AS k, seq, CAST(order_id AS BIGINT) AS o, count, c FROM ok WHERE NOT held),
sim(k, seq, granted, free, got) AS (
  SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), false, {FREE_SQL}, CAST([] AS BIGINT[])
  UNION ALL
  SELECT k, seq, fits, CASE WHEN fits THEN list_transform(free, lambda x, i: CASE WHEN i = c THEN x - count ELSE x END) ELSE free END,
         CASE WHEN fits THEN list_append(got, o) ELSE got END
  FROM (SELECT e.*, s.free, s.got, e.count <= s.free[e.c] AND NOT list_contains(s.got, e.o) AS fits
        FROM sim s JOIN elig e ON e.k = s.k + 1)),
free AS (SELECT color, count(*) AS f FROM cells WHERE filled AND NOT reserved GROUP BY color),
dec AS (SELECT ok.*, coalesce(a.granted, false) AS granted, coalesce(f.f, 0) AS free
        FROM ok LEFT JOIN sim a ON ok.seq = a.seq LEFT JOIN free f ON ok.color = f.color),
d2 AS (SELECT *, free - coalesce(sum(CASE WHEN granted THEN count ELSE 0 END) OVER (PARTITION BY color ORDER BY seq
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS avail,
              min(CASE WHEN granted THEN seq END) OVER (PARTITION BY order_id) AS gseq
       FROM dec),
kinds AS (SELECT *, CASE WHEN held THEN 'duplicate' WHEN granted THEN 'granted'
                         WHEN gseq < seq THEN 'duplicate' ELSE 'insufficient' END AS kind FROM d2)"""


@query("reserve_results", ALLOC_SQL + """
SELECT seq, order_id, color, count,
       CASE kind WHEN 'granted' THEN 200 ELSE 409 END AS status,
       CASE kind WHEN 'granted' THEN NULL
                 WHEN 'duplicate' THEN 'Order ''' || order_id || ''' already has reserved blocks'
                 ELSE 'Not enough ' || color || ' blocks. Requested: ' || CAST(count AS VARCHAR) || ', available: '
                      || CAST(avail AS VARCHAR) END AS message
FROM kinds
UNION ALL
SELECT seq, order_id, color, count, 400,
       'Unknown color: ' || color_raw || '. Valid colors: [''RED'', ''GREEN'', ''BLUE'', ''YELLOW'']'
FROM rq WHERE c = 0 AND count IS NOT NULL
UNION ALL
SELECT seq, order_id, color, count, 422, 'Input should be a valid integer' FROM rq WHERE count IS NULL""",
       ("requests", "cells", "fetch_log"), recursive=True)
def q_reserve_results(spark, sf):
    return S.reserve_results(V.requests(spark, sf), V.cells(spark, sf), V.fetch_log(spark, sf))


@query("reserve", ALLOC_SQL + """
, g AS (SELECT *, coalesce(sum(count) OVER (PARTITION BY color ORDER BY seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ub FROM kinds WHERE kind = 'granted'),
fr AS (SELECT color, x, y, row_number() OVER (PARTITION BY color ORDER BY x, y) AS rank
       FROM cells WHERE filled AND NOT reserved)
SELECT g.seq, g.order_id, fr.x, fr.y, fr.color
FROM g JOIN fr ON g.color = fr.color AND fr.rank > g.ub AND fr.rank <= g.ub + g.count""",
       ("requests", "cells", "fetch_log"), recursive=True)
def q_reserve(spark, sf):
    return S.reserve(V.requests(spark, sf), V.cells(spark, sf), V.fetch_log(spark, sf))


@query("stock_by_colour", """
SELECT color, count(*) FILTER (WHERE filled AND NOT reserved) AS available,
       count(*) FILTER (WHERE filled AND reserved) AS reserved, count(*) FILTER (WHERE NOT filled) AS empty
FROM cells GROUP BY color""", ("cells",))
def q_stock_by_colour(spark, sf):
    return S.stock_by_colour(V.cells(spark, sf))


@query("reserved_positions", """
SELECT order_id, x, y, color, CAST(row_number() OVER (PARTITION BY order_id ORDER BY x, y) AS BIGINT) AS pos
FROM cells WHERE filled AND order_id IS NOT NULL""", ("cells",))
def q_reserved_positions(spark, sf):
    return S.reserved_positions(V.cells(spark, sf))


@query("row_major_cells", """SELECT x, y, color, filled, reserved, order_id FROM cells ORDER BY x, y""", ("cells",))
def q_row_major(spark, sf):
    return S.row_major_cells(V.cells(spark, sf))


@query("fetch", """
, rq AS (SELECT seq, order_id, seq = min(seq) OVER (PARTITION BY order_id) AS first FROM requests),
held AS (SELECT order_id, x, y, color FROM cells WHERE filled AND order_id IS NOT NULL),
hit AS (SELECT rq.seq, rq.order_id, 200 AS status, h.x, h.y, h.color, CAST(NULL AS VARCHAR) AS message
        FROM rq JOIN held h ON rq.order_id = h.order_id WHERE rq.first)
SELECT * FROM hit
UNION ALL
SELECT seq, order_id, 404, NULL, NULL, NULL, 'No reserved blocks found for order ''' || order_id || ''''
FROM rq WHERE seq NOT IN (SELECT seq FROM hit)""", ("requests", "cells"))
def q_fetch(spark, sf):
    return S.fetch(V.requests(spark, sf), V.cells(spark, sf))


@query("restore_order", """
, rq AS (SELECT seq, order_id, seq = min(seq) OVER (PARTITION BY order_id) AS first FROM requests),
back AS (SELECT order_id, count(*) AS n FROM (SELECT order_id FROM cells WHERE filled AND order_id IS NOT NULL
                                             UNION ALL SELECT order_id FROM fetch_log) GROUP BY order_id)
SELECT rq.seq, rq.order_id,
       CASE WHEN rq.first AND b.n IS NOT NULL THEN 200 ELSE 404 END AS status,
       CAST(CASE WHEN rq.first AND b.n IS NOT NULL THEN b.n ELSE 0 END AS BIGINT) AS restored,
       CASE WHEN rq.first AND b.n IS NOT NULL
            THEN 'Restored ' || CAST(b.n AS VARCHAR) || ' block(s) for order ''' || rq.order_id || ''''
            ELSE 'No blocks found for order ''' || rq.order_id || '''' END AS message
FROM rq LEFT JOIN back b ON rq.order_id = b.order_id""", ("requests", "cells", "fetch_log"))
def q_restore_order(spark, sf):
    return S.restore_order(V.requests(spark, sf), V.cells(spark, sf), V.fetch_log(spark, sf))


@query("restore_all", """
SELECT x, y, CASE y % 4 WHEN 0 THEN 'RED' WHEN 1 THEN 'GREEN' WHEN 2 THEN 'BLUE' ELSE 'YELLOW' END AS color,
       true AS filled, false AS reserved, CAST(NULL AS VARCHAR) AS order_id FROM cells""", ("cells",))
def q_restore_all(spark, sf):
    return S.restore_all(V.cells(spark, sf))


@query("ledger_replay", """
, acts AS (SELECT * FROM ledger WHERE action <> 'restore_all'
             AND seq > (SELECT coalesce(max(seq), -1) FROM ledger WHERE action = 'restore_all')),
o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY seq) AS k FROM acts),
st(cell, k, filled, holder, logged) AS (
  SELECT DISTINCT cell, CAST(0 AS BIGINT), true, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM o
  UNION ALL
  SELECT st.cell, st.k + 1,
    CASE WHEN o.action = 'fetch' AND st.filled AND st.holder = o.order_id THEN false
         WHEN o.action = 'restore' AND coalesce((st.filled AND st.holder = o.order_id) OR st.logged = o.order_id, false)
           THEN true
         ELSE st.filled END,
    CASE WHEN o.action = 'reserve' AND st.filled AND st.holder IS NULL THEN o.order_id
         WHEN o.action = 'fetch' AND st.filled AND st.holder = o.order_id THEN NULL
         WHEN o.action = 'restore' AND coalesce((st.filled AND st.holder = o.order_id) OR st.logged = o.order_id, false)
           THEN NULL
         ELSE st.holder END,
    CASE WHEN o.action = 'fetch' AND st.filled AND st.holder = o.order_id THEN o.order_id
         WHEN o.action = 'restore' AND coalesce((st.filled AND st.holder = o.order_id) OR st.logged = o.order_id, false)
           THEN NULL
         ELSE st.logged END
  FROM st JOIN o ON o.cell = st.cell AND o.k = st.k + 1),
fin AS (SELECT cell, arg_max(filled, k) AS filled, arg_max(holder, k) AS holder, arg_max(logged, k) AS logged,
               max(k) AS k FROM st GROUP BY cell),
fin2 AS (SELECT st.cell, st.filled, st.holder, st.logged FROM st JOIN fin ON st.cell = fin.cell AND st.k = fin.k),
allc AS (SELECT DISTINCT cell, x, y, color FROM ledger WHERE action <> 'restore_all')
SELECT a.cell, a.x, a.y, a.color, coalesce(f.filled, true) AS filled, f.holder IS NOT NULL AS reserved,
       f.holder AS order_id, f.logged AS logged_by
FROM allc a LEFT JOIN fin2 f ON a.cell = f.cell""", ("ledger",), recursive=True)
def q_ledger_replay(spark, sf):
    return ledger_replay(V.ledger(spark, sf))


@query("stock_grid_source", """
SELECT x, y, filled, CASE WHEN filled THEN color END AS color, CASE WHEN filled THEN reserved END AS reserved,
       CASE WHEN filled THEN order_id END AS order_id FROM cells""", ("cells",))
def q_stock_grid_source(spark, sf):
    from blockyard.sources.stock_grid import stock_grid_source
    return stock_grid_source(V.stock_grid(spark, sf))
