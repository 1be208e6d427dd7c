"""Queries: file sources (§2.1) and sinks (§2.2).

File-source queries first write data Spark derives from the driver tables
in the reference's file layouts into a fresh folder under the shared
checkpoint location, then read it back with the source under test.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockyard.functions import epoch_ms, nonblank_text_field
from blockyard.operators.sequencing import chunk_of, last_spec, running_many
from blockyard.plans import views as V
from blockyard.plans.registry import query
from blockyard.session import scratch_path
from blockyard.sinks.publish import (FanOut, publish_complete, publish_manufacture,
                                     publish_notifications)
from blockyard.sources.robot import robot_command_source, robot_flow_source, write_robot_flows
from blockyard.sources.sensor import sensor_csv_source, sensor_topic_source, write_sensor_csv
from blockyard.streaming.runtime import read_log_stream, write_ordered_log


def _fresh(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("sensor_csv_source", """
SELECT id, sensor, epoch_ms(epoch_us(ts) // 1000) AS ts,
       TRY_CAST(json_extract_string(payload, '$.distance') AS DOUBLE) AS distance
FROM readings""", ("readings",))
def q_sensor_csv(spark, sf):
    r = sensor_topic_source(V.readings(spark, sf))
    value = F.to_json(F.struct(F.lit("distance_IR_short").alias("type"),
                               F.concat(F.lit("S"), F.col("sensor").cast("string")).alias("UID"),
                               F.lit("Conveyor").alias("location"), F.col("id").alias("messageID"),
                               F.col("distance")))
    rows = r.select(epoch_ms("ts").alias("Timestamp"),
                    F.date_format(F.timestamp_add("HOUR", F.lit(1), F.col("ts")), "yyyy-MM-dd HH:mm:ss.SSS")
                    .alias("Date"), value.alias("Value"), F.lit(None).cast("string").alias("Properties"))
    path = _fresh(spark, "sensor-csv")
    write_sensor_csv(rows, path)
    back = sensor_csv_source(spark, path)
    return back.select(F.col("message_id").alias("id"),
                       F.substring("uid", 2, 10).cast("int").alias("sensor"), "ts",
                       F.get_json_object("value", "$.distance").cast("double").alias("distance"))


@query("sensor_topic_source", """
SELECT id, sensor, ts, TRY_CAST(json_extract_string(payload, '$.distance') AS DOUBLE) AS distance
FROM readings""", ("readings",))
def q_sensor_topic(spark, sf):
    return sensor_topic_source(V.readings(spark, sf)).select("id", "sensor", "ts", "distance")


FLOW_SQL = """
, fl AS (SELECT robot, seq, kind, x, y, z, r,
                last_value(suck IGNORE NULLS) OVER (PARTITION BY robot ORDER BY seq
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st
         FROM commands),
mv AS (SELECT robot, CAST(row_number() OVER (PARTITION BY robot ORDER BY seq) - 1 AS BIGINT) AS row, x, y, z, r, st
       FROM fl WHERE kind = 'MovementCommand'),
sc AS (SELECT robot, row, st, lag(st) OVER (PARTITION BY robot ORDER BY row) AS prev FROM mv WHERE st IS NOT NULL)
SELECT robot, row, 0 AS sub, 'MovementCommand' AS kind, x, y, z, r, CAST(NULL AS BOOLEAN) AS suck FROM mv
UNION ALL
SELECT robot, row, 1, 'SuctionCupCommand', NULL, NULL, NULL, NULL, st FROM sc WHERE prev IS NULL OR prev <> st"""


@query("robot_flow_source", FLOW_SQL, ("commands",))
def q_robot_flow(spark, sf):
    c = V.commands(spark, sf)
    absolute = F.col("kind") == "MovementCommand"
    d = running_many(c, ["robot"], ["seq"],
                     [(F.when(absolute, F.lit(1)).otherwise(F.lit(0)).cast("long"), "n_abs", "sum"),
                      last_spec(F.col("seq"), F.col("suck"), "state")], chunk_of("seq", 1 << 20))
    rows = d.filter(absolute).select("robot", (F.col("n_abs") - 1).alias("row"), "x", "y", "z", "r",
                                     F.col("state").alias("suck"))
    path = _fresh(spark, "robot-flows")
    write_robot_flows(rows, path)
    back = robot_flow_source(spark, path)
    return back.withColumn("robot", F.col("robot").cast("long")).withColumn("sub", F.col("sub").cast("int"))


@query("robot_command_source", """
SELECT robot, seq, kind,
       CASE WHEN kind = 'MovementCommand' THEN coalesce(x, 0.0) ELSE x END AS x,
       CASE WHEN kind = 'MovementCommand' THEN coalesce(y, 0.0) ELSE y END AS y,
       CASE WHEN kind = 'MovementCommand' THEN coalesce(z, 0.0) ELSE z END AS z,
       CASE WHEN kind = 'MovementCommand' THEN coalesce(r, 0.0) ELSE r END AS r,
       CASE WHEN kind = 'MovementCommand' THEN 'MOVE_JOINT' END AS mode,
       CASE WHEN kind = 'SuctionCupCommand' THEN coalesce(suck, false) END AS suck
FROM commands""", ("commands",))
def q_robot_commands(spark, sf):
    c = V.commands(spark, sf)
    text = F.to_json(F.create_map(F.col("kind"), F.struct("x", "y", "z", "r", "suck")))
    parsed = robot_command_source(c.select("robot", "seq", text.alias("command")))
    return parsed.select("robot", "seq", "kind", "x", "y", "z", "r", "mode", "suck")


NB = "CASE WHEN json_valid(value) AND trim(json_extract_string(value, '$.{f}')) <> '' THEN json_extract_string(value, '$.{f}') END"
HASH_ID = """concat_ws('-', substr(md5(CAST(seq AS VARCHAR)), 1, 8), substr(md5(CAST(seq AS VARCHAR)), 9, 4),
                          substr(md5(CAST(seq AS VARCHAR)), 13, 4), substr(md5(CAST(seq AS VARCHAR)), 17, 4),
                          substr(md5(CAST(seq AS VARCHAR)), 21, 12))"""


@query("publish_notifications", f"""
SELECT seq, topic, '0' AS key,
       json_object('message', message, 'orderId', coalesce({NB.format(f='orderId')}, 'unknown-order'),
                   'correlationId', coalesce({NB.format(f='correlationId')}, {HASH_ID}))::VARCHAR AS value,
       CAST(NULL AS VARCHAR) AS error
FROM event_log WHERE topic IN ('info.v1', 'error.v1')""", ("event_log",))
def q_publish_notifications(spark, sf):
    v = V.event_log(spark, sf, offsets=False).filter(F.col("topic").isin("info.v1", "error.v1"))
    out = publish_notifications(v, F.col("topic"), F.col("message"), nonblank_text_field("value", "orderId"),
                                nonblank_text_field("value", "correlationId"), F.col("seq"))
    return out.select("seq", "topic", "key", "value", "error")


@query("publish_manufacture", f"""
SELECT seq, 'order.manufacture.v1' AS topic, '0' AS key,
       CASE WHEN it IN ('CHAIR', 'TABLE', 'SHELF', 'CLOSET')
            THEN json_object('order', json_object('orderId', order_id, 'itemType', it), 'correlationId', {HASH_ID})::VARCHAR
       END AS value,
       CASE WHEN it NOT IN ('CHAIR', 'TABLE', 'SHELF', 'CLOSET') THEN 'Invalid item type: ' || it END AS error
FROM (SELECT seq, order_id, coalesce(item, item_raw) AS it FROM requests WHERE NOT is_repeat)""", ("requests",))
def q_publish_manufacture(spark, sf):
    r = V.requests(spark, sf).filter(~F.col("is_repeat"))
    out = publish_manufacture(r, F.col("order_id"), F.coalesce("item", "item_raw"), F.lit(None).cast("string"),
                              F.col("seq"))
    return out.select("seq", "topic", "key", "value", "error")


@query("publish_complete", """
SELECT event_id, 'order.complete.v1' AS topic, '0' AS key,
       json_object('orderId', order_id, 'correlationId', correlation_id)::VARCHAR AS value
FROM outcomes WHERE kind = 'complete'""", ("outcomes",))
def q_publish_complete(spark, sf):
    o = V.outcomes(spark, sf).filter(F.col("kind") == "complete")
    return publish_complete(o, F.col("order_id"), F.col("correlation_id")).select("event_id", "topic", "key", "value")


@query("fan_out_sink", """
SELECT 'audit' AS sink, seq, topic FROM event_log UNION ALL SELECT 'dashboard', seq, topic FROM event_log""",
       ("event_log",))
def q_fan_out(spark, sf):
    """The log streams to three sinks, one of which is closed and is dropped at its first batch."""
    log, path = V.event_log(spark, sf, offsets=False).select("seq", "topic"), _fresh(spark, "fan-out-log")
    write_ordered_log(log, path)
    base = _fresh(spark, "fan-out")

    def to(name):
        return lambda df, i: df.write.mode("overwrite").parquet(f"{base}/{name}/batch_id={i}")

    def broken(df, i):
        raise RuntimeError("subscriber closed")

    body = FanOut(spark, {"audit": to("audit"), "closed": broken, "dashboard": to("dashboard")}, f"{base}/state")
    read_log_stream(spark, path, log.schema, 2).writeStream.option("checkpointLocation", f"{base}/ckpt") \
        .foreachBatch(body).trigger(availableNow=True).start().awaitTermination()
    kept = [n for n in body.sinks if n not in body.dropped()]
    out = [spark.read.parquet(f"{base}/{n}").select(F.lit(n).alias("sink"), "seq", "topic") for n in kept]
    return functools.reduce(DataFrame.unionByName, out)


@query("publish_notifications_factory", f"""
SELECT seq, topic, '0' AS key,
       CASE WHEN {NB.format(f='orderId')} IS NOT NULL AND {NB.format(f='correlationId')} IS NOT NULL
            THEN json_object('message', message, 'orderId', json_extract_string(value, '$.orderId'),
                             'correlationId', json_extract_string(value, '$.correlationId'))::VARCHAR END AS value,
       CASE WHEN {NB.format(f='orderId')} IS NULL OR {NB.format(f='correlationId')} IS NULL
            THEN 'orderId and correlationId are required' END AS error
FROM event_log WHERE topic IN ('info.v1', 'error.v1')""", ("event_log",))
def q_publish_notifications_factory(spark, sf):
    """Factory-side notifications: both ids are required, otherwise the row
    carries an error instead of a message."""
    v = V.event_log(spark, sf, offsets=False).filter(F.col("topic").isin("info.v1", "error.v1"))
    out = publish_notifications(v, F.col("topic"), F.col("message"), nonblank_text_field("value", "orderId"),
                                nonblank_text_field("value", "correlationId"), F.col("seq"), side="factory")
    return out.select("seq", "topic", "key", "value", "error")
