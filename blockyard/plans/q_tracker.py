"""Queries: topic log, dashboard decoding, tracker."""

from __future__ import annotations


from blockyard import constants as K
from blockyard.operators import tracker as T
from blockyard.plans import views as V
from blockyard.plans.registry import query
from blockyard.sources.topic_log import topic_log_source

# Shared DuckDB fragments: dashboard events and detected steps.
EV_SQL = """
, obj AS (
  SELECT *, coalesce(CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' END, false) AS is_obj
  FROM event_log),
ev AS (
  SELECT seq, ts, topic,
         CASE WHEN is_obj THEN json_extract_string(value, '$.orderId') END AS order_id,
         CASE WHEN is_obj THEN json_extract_string(value, '$.message') ELSE value END AS message,
         coalesce(starts_with(topic, 'error'), false) AS is_error,
         CASE WHEN is_obj THEN TRY_CAST(json_extract_string(value, '$.timestamp') AS BIGINT) END AS timestamp_ms
  FROM obj),
det AS (
  SELECT *, CASE
      WHEN is_error AND (contains(txt, 'manufactur') OR contains(txt, 'restock') OR contains(txt, 'restore')) THEN 3
      WHEN is_error AND contains(txt, 'inventor') THEN 1
      WHEN is_error THEN 3
      WHEN contains(txt, 'complete') OR contains(txt, 'finish') OR contains(txt, 'deliver') THEN 3
      WHEN contains(txt, 'manufactur') OR contains(txt, 'production') OR contains(txt, 'robot') THEN 2
      WHEN contains(txt, 'reserv') OR contains(txt, 'inventor') THEN 1
      WHEN contains(txt, 'order') AND contains(txt, 'receiv') THEN 0 END AS step_d,
    nullif(upper(regexp_extract(coalesce(message, '') || ' ', '(?i)\\b(CHAIR|TABLE|SHELF|CLOSET)\\b', 1)), '') AS item
  FROM (SELECT *, ' ' || lower(coalesce(message, '')) AS txt FROM ev)),
det2 AS (SELECT * EXCLUDE (txt), CASE WHEN step_d IS NOT NULL THEN is_error END AS failed_d FROM det)"""

TRACKER_SQL = EV_SQL + """,
w AS (
  SELECT *, greatest(0, coalesce(max(step_d) OVER (PARTITION BY order_id ORDER BY seq
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS cur
  FROM det2 WHERE order_id IS NOT NULL AND order_id <> ''),
w2 AS (SELECT *, CASE WHEN timestamp_ms IS NOT NULL AND timestamp_ms <> 0 THEN epoch_ms(timestamp_ms) ELSE ts END AS st
       FROM w),
tracker AS (
  SELECT order_id,
         CAST(greatest(0, coalesce(max(step_d), 0)) AS INTEGER) AS step,
         coalesce(arg_max(failed_d, seq) FILTER (WHERE step_d >= cur), false) AS failed,
         arg_max(item, seq) FILTER (WHERE item IS NOT NULL) AS item_type,
         min(ts) AS t0,
         min(st) FILTER (WHERE step_d = 1 AND step_d > cur) AS t1,
         min(st) FILTER (WHERE step_d = 2 AND step_d > cur) AS t2,
         min(st) FILTER (WHERE step_d = 3 AND step_d > cur) AS t3,
         max(ts) AS last_ts, count(*) AS n_events
  FROM w2 GROUP BY order_id)"""


def _events(spark, sf):
    return T.dashboard_events(V.event_log(spark, sf, offsets=False))


def _tracker(spark, sf):
    return T.order_tracker(_events(spark, sf))


@query("topic_log_source", """
SELECT topic, partition, "offset", key, value, ts FROM event_log
WHERE topic IN ('info.v1', 'error.v1', 'order.complete.v1')""", ("event_log",))
def q_topic_log_source(spark, sf):
    log = V.event_log(spark, sf)
    return topic_log_source(log, K.DASHBOARD_TOPICS).select(
        "topic", "partition", "offset", "key", "value", "ts")


@query("topic_union", """
SELECT topic, seq, "offset" FROM event_log WHERE topic = 'info.v1'
UNION ALL SELECT topic, seq, "offset" FROM event_log WHERE topic = 'error.v1'
UNION ALL SELECT topic, seq, "offset" FROM event_log WHERE topic = 'order.complete.v1'""", ("event_log",))
def q_topic_union(spark, sf):
    # a union of subscriptions is one subscription: the log is read and numbered once
    return topic_log_source(V.event_log(spark, sf), K.DASHBOARD_TOPICS).select("topic", "seq", "offset")


@query("event_step", EV_SQL + """
SELECT seq, step_d AS step, failed_d AS failed FROM det2""", ("event_log",))
def q_event_step(spark, sf):
    from blockyard.functions import event_step
    e = _events(spark, sf)
    d = event_step("message", "is_error", "info_title")
    return e.select("seq", d["step"].alias("step"), d["failed"].alias("failed"))


@query("item_type_from_text", EV_SQL + """
SELECT seq, item AS item_type FROM det2""", ("event_log",))
def q_item_type(spark, sf):
    from blockyard.functions import item_type_from_text
    e = _events(spark, sf)
    return e.select("seq", item_type_from_text("message", "info_text").alias("item_type"))


@query("order_tracker", TRACKER_SQL + """
SELECT * FROM tracker""", ("event_log",))
def q_order_tracker(spark, sf):
    return _tracker(spark, sf)


@query("tracker_steps", TRACKER_SQL + """
, labels AS (SELECT * FROM (VALUES (0, 'Order Received'), (1, 'Inventory Reserved'),
                                   (2, 'Manufacturing'), (3, 'Completed')) t(idx, label))
SELECT order_id, CAST(idx AS INTEGER) AS idx, label,
       CASE WHEN idx < step THEN 'done'
            WHEN idx = step THEN CASE WHEN failed THEN 'failed' WHEN step = 3 THEN 'done' ELSE 'active' END
            ELSE '' END AS state,
       CASE idx WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END AS time
FROM tracker, labels""", ("event_log",))
def q_tracker_steps(spark, sf):
    return T.tracker_steps(_tracker(spark, sf))


@query("recent_orders", TRACKER_SQL + """
SELECT * FROM tracker ORDER BY last_ts DESC, order_id LIMIT 20""", ("event_log",))
def q_recent_orders(spark, sf):
    return T.recent_orders(_tracker(spark, sf))
