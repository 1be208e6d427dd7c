"""Queries: scalar projections and filters (§2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockyard import constants as K
from blockyard import functions as P
from blockyard.operators import stock as S
from blockyard.plans import views as V
from blockyard.plans.registry import query

L4 = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
L4_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
OBJ_SQL = "(json_valid(value) AND coalesce(CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' END, false))"


def _jfield(field: str) -> str:
    return f"CASE WHEN json_valid(value) THEN json_extract_string(value, '$.{field}') END"


# --- JSON ------------------------------------------------------------------

@query("json_decode", f"""
SELECT seq, json_valid(value) AS decoded,
       CASE WHEN {OBJ_SQL} THEN json_extract_string(value, '$.orderId') END AS order_id
FROM event_log""", ("event_log",))
def q_json_decode(spark, sf):
    v = V.event_log(spark, sf, offsets=False)
    j = P.json_decode("value")
    return v.select("seq", j.isNotNull().alias("decoded"),
                    F.try_variant_get(j, "$.orderId", "string").alias("order_id"))


@query("json_encode", """
SELECT seq, json_object('message', message, 'orderId', order_id, 'correlationId', correlation_id)::VARCHAR AS json
FROM event_log""", ("event_log",))
def q_json_encode(spark, sf):
    v = V.event_log(spark, sf, offsets=False)
    s = F.struct(F.col("message").alias("message"), F.col("order_id").alias("orderId"),
                 F.col("correlation_id").alias("correlationId"))
    return v.select("seq", F.to_json(s, {"ignoreNullFields": "false"}).alias("json"))


@query("topic_tag_with_fallback", f"""
SELECT seq,
       CASE WHEN {OBJ_SQL} THEN json_merge_patch(value, json_object('_topic', topic))::VARCHAR
            ELSE json_object('message', value, '_topic', topic)::VARCHAR END AS tagged
FROM event_log""", ("event_log",))
def q_topic_tag(spark, sf):
    v = V.event_log(spark, sf, offsets=False)
    return v.select("seq", P.topic_tag_with_fallback("value", "topic").alias("tagged"))


@query("nonblank_text_field", f"""
SELECT seq, CASE WHEN trim({_jfield('orderId')}) <> '' THEN {_jfield('orderId')} END AS order_id,
       CASE WHEN trim({_jfield('message')}) <> '' THEN {_jfield('message')} END AS message
FROM event_log""", ("event_log",))
def q_nonblank(spark, sf):
    v = V.event_log(spark, sf, offsets=False)
    return v.select("seq", P.nonblank_text_field("value", "orderId").alias("order_id"),
                    P.nonblank_text_field("value", "message").alias("message"))


@query("safe_epoch", f"""
SELECT seq, TRY_CAST({_jfield('timestamp')} AS BIGINT) AS produced_ms FROM event_log""", ("event_log",))
def q_safe_epoch(spark, sf):
    v = V.event_log(spark, sf, offsets=False)
    return v.select("seq", P.safe_epoch("value").alias("produced_ms"))


# --- order-side texts ------------------------------------------------------

COLOUR_NORM_SQL = """CASE WHEN color_raw IN ('RED','GREEN','BLUE','YELLOW') THEN color_raw
            WHEN upper(trim(color_raw)) IN ('RED','GREEN','BLUE','YELLOW') THEN upper(trim(color_raw)) END"""


@query("enum_normalise", f"""
SELECT seq, item, {COLOUR_NORM_SQL} AS color FROM requests""", ("requests",))
def q_enum(spark, sf):
    r = V.requests(spark, sf)
    return r.select("seq", "item", P.enum_normalise("color_raw", K.ORDER_COLOURS).alias("color"))


@query("block_count", """SELECT seq, item, count FROM requests""", ("requests",))
def q_block_count(spark, sf):
    r = V.requests(spark, sf)
    return r.select("seq", "item", P.block_count("item").alias("count"))


@query("assembly_plan", """
, plan AS (SELECT * FROM (VALUES ('CHAIR', 0, 0, 0, 0), ('TABLE', 0, 0, 0, 0), ('TABLE', 1, 1, 0, 0),
                                 ('SHELF', 0, 0, 0, 0), ('SHELF', 1, 0, 0, 1), ('CLOSET', 0, 0, 0, 0),
                                 ('CLOSET', 1, 0, 0, 1), ('CLOSET', 2, 0, 0, 2)) t(item, pos, x, y, z))
SELECT r.seq, r.item, CAST(p.pos AS INTEGER) AS pos, CAST(p.x AS INTEGER) AS x, CAST(p.y AS INTEGER) AS y,
       CAST(p.z AS INTEGER) AS z
FROM requests r JOIN plan p ON r.item = p.item""", ("requests",))
def q_assembly_plan(spark, sf):
    r = V.requests(spark, sf).filter(F.col("item").isNotNull())
    e = r.select("seq", "item", F.posexplode(P.assembly_plan("item")).alias("pos", "p"))
    return e.select("seq", "item", F.col("pos").cast("int").alias("pos"), "p.x", "p.y", "p.z")


ID_SQL = """
SELECT seq,
       coalesce(CASE WHEN trim(existing) <> '' THEN existing END,
                CASE WHEN trim(business_key) <> '' THEN business_key END,
                concat_ws('-', substr(md5(CAST(seq AS VARCHAR)), 1, 8), substr(md5(CAST(seq AS VARCHAR)), 9, 4),
                          substr(md5(CAST(seq AS VARCHAR)), 13, 4), substr(md5(CAST(seq AS VARCHAR)), 17, 4),
                          substr(md5(CAST(seq AS VARCHAR)), 21, 12))) AS order_id
FROM (SELECT seq, CASE seq % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE order_id END AS existing,
             CASE WHEN seq % 2 = 0 THEN 'bk-' || CAST(seq AS VARCHAR) END AS business_key FROM requests)"""


@query("id_defaults", ID_SQL, ("requests",))
def q_id_defaults(spark, sf):
    r = V.requests(spark, sf)
    s = F.col("seq")
    existing = F.when(s % 3 == 0, F.lit(None).cast("string")).when(s % 3 == 1, F.lit("  ")).otherwise(F.col("order_id"))
    bk = F.when(s % 2 == 0, F.concat(F.lit("bk-"), s.cast("string")))
    return r.select("seq", P.id_defaults(existing, bk, s).alias("order_id"))


STATUS_SQL = f"CASE WHEN item IS NOT NULL AND ({COLOUR_NORM_SQL}) IS NOT NULL THEN status END"


@query("reservation_outcome", f"""
SELECT seq, coalesce(st >= 200 AND st < 300, false) AS success,
       CASE WHEN st >= 200 AND st < 300 THEN NULL WHEN st = 409 THEN 'INSUFFICIENT_BLOCKS'
            ELSE 'TECHNICAL_OR_INVALID_REQUEST' END AS failure_type,
       CASE WHEN st >= 200 AND st < 300 THEN false WHEN st = 409 THEN false ELSE true END AS technical
FROM (SELECT seq, {STATUS_SQL} AS st FROM requests)""", ("requests",))
def q_reservation_outcome(spark, sf):
    r = _sent_status(V.requests(spark, sf))
    o = P.reservation_outcome("st")
    return r.select("seq", o["success"].alias("success"), o["failure_type"].alias("failure_type"),
                    o["technical"].alias("technical"))


def _sent_status(r):
    """HTTP status only for requests the order side actually sends (valid
    item and colour); others fail before the call."""
    colour = P.enum_normalise("color_raw", K.ORDER_COLOURS)
    return r.withColumn("st", F.when(F.col("item").isNotNull() & colour.isNotNull(), F.col("status")))


@query("outcome_message", f"""
SELECT seq, CASE
  WHEN st >= 200 AND st < 300 THEN NULL
  WHEN st = 409 THEN 'Reservation not possible due to insufficient inventory.'
  WHEN st IS NULL THEN 'Inventory service unavailable: Invalid request'
  ELSE 'Inventory service unavailable: Inventory service returned status ' || CAST(st AS VARCHAR) END AS message
FROM (SELECT seq, {STATUS_SQL} AS st FROM requests)""", ("requests",))
def q_outcome_message(spark, sf):
    r = _sent_status(V.requests(spark, sf))
    st = F.col("st")
    kind = (F.when((st >= 200) & (st < 300), F.lit(None).cast("string"))
            .when(st == 409, F.lit("reservation_info")).otherwise(F.lit("reservation_error")))
    detail = (F.when(st == 409, F.lit(""))
              .when(st.isNull(), F.lit("Invalid request"))
              .otherwise(F.concat(F.lit("Inventory service returned status "), st.cast("string"))))
    return r.select("seq", P.outcome_message(kind, detail).alias("message"))


@query("failure_stage", f"""
SELECT {L4_SQL}, activity_id,
       CASE activity_id WHEN 'Activity_0uhz0y6' THEN 'AFTER_TIMEOUT' WHEN 'Activity_0ezfqp2' THEN 'AFTER_FACTORY_ERROR'
                        ELSE 'UNKNOWN' END AS stage,
       CASE activity_id WHEN 'Activity_0ezfqp2' THEN 'INVENTORY_RESTORE_FACTORY_FAILED'
                        ELSE 'INVENTORY_RESTORE_TIMEOUT_FAILED' END AS error_code,
       CASE activity_id WHEN 'Activity_0uhz0y6' THEN 'Inventory restore failed after manufacturing timeout.'
                        WHEN 'Activity_0ezfqp2' THEN 'Inventory restore failed after factory error: status 500'
                        ELSE 'Inventory restore failed.' END AS message
FROM attempts WHERE NOT success""", ("attempts",))
def q_failure_stage(spark, sf):
    a = V.attempts(spark, sf).filter(~F.col("success"))
    fs = P.failure_stage("activity_id")
    detail = F.when(fs["stage"] == "AFTER_FACTORY_ERROR", F.lit("status 500"))
    return a.select(*L4, "activity_id", fs["stage"].alias("stage"), fs["error_code"].alias("error_code"),
                    P.outcome_message(F.lit("restore_error"), detail, fs["stage"]).alias("message"))


# --- dashboard helpers -----------------------------------------------------

@query("uuid_valid", """
SELECT seq, uuid_text, coalesce(regexp_matches(uuid_text,
  '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$'), false) AS valid
FROM event_log""", ("event_log",))
def q_uuid_valid(spark, sf):
    v = V.event_log(spark, sf, offsets=False)
    return v.select("seq", "uuid_text", P.uuid_valid("uuid_text").alias("valid"))


@query("time_label", """
SELECT seq, coalesce(strftime(ts, '%H:%M:%S.%g'), '') AS label FROM event_log""", ("event_log",))
def q_time_label(spark, sf):
    v = V.event_log(spark, sf, offsets=False)
    return v.select("seq", P.time_label("ts").alias("label"))


KEY_RAW_SQL = "CASE WHEN seq % 13 = 0 THEN NULL WHEN seq % 13 = 1 THEN 'p' || key ELSE key END"


@query("key_partition", f"""
SELECT seq, key_raw, TRY_CAST(key_raw AS INTEGER) AS target_partition,
       TRY_CAST(key_raw AS INTEGER) IS NOT NULL AS valid
FROM (SELECT seq, {KEY_RAW_SQL} AS key_raw FROM event_log)""", ("event_log",))
def q_key_partition(spark, sf):
    v = V.event_log(spark, sf, offsets=False)
    s = F.col("seq")
    raw = (F.when(s % 13 == 0, F.lit(None).cast("string"))
           .when(s % 13 == 1, F.concat(F.lit("p"), F.col("key"))).otherwise(F.col("key")))
    p = P.key_partition(raw)
    return v.select("seq", raw.alias("key_raw"), p.alias("target_partition"), p.isNotNull().alias("valid"))


# --- colour ----------------------------------------------------------------

@query("rgb_classify", f"""
SELECT {L4_SQL}, CASE WHEN r8 > g8 AND g8 > b8 THEN 'YELLOW' WHEN r8 > g8 AND r8 > b8 THEN 'RED'
                      WHEN g8 > r8 AND g8 > b8 THEN 'GREEN' WHEN b8 > r8 AND b8 > g8 THEN 'BLUE'
                      ELSE 'UNKNOWN' END AS measured
FROM colour_readings""", ("colour_readings",))
def q_rgb_classify(spark, sf):
    c = V.colour_readings(spark, sf)
    return c.select(*L4, P.rgb_classify("r8", "g8", "b8").alias("measured"))


def _gamma_sql(c: str) -> str:
    return (f"CASE WHEN clear = 0 THEN 0 ELSE CAST(least(255, floor(pow(floor(({c} / clear) * 256) / 255, 2.5) * 255)) "
            f"AS INTEGER) END")


@query("rgb_normalise", f"""
SELECT {L4_SQL}, {_gamma_sql('r')} AS nr, {_gamma_sql('g')} AS ng, {_gamma_sql('b')} AS nb
FROM colour_readings""", ("colour_readings",))
def q_rgb_normalise(spark, sf):
    c = V.colour_readings(spark, sf)
    n = P.rgb_normalise("r", "g", "b", "clear")
    return c.select(*L4, n["r"].alias("nr"), n["g"].alias("ng"), n["b"].alias("nb"))


@query("rgb_pack", f"""
SELECT {L4_SQL}, CAST((r8 << 16) | (g8 << 8) | b8 AS INTEGER) AS packed FROM colour_readings""",
       ("colour_readings",))
def q_rgb_pack(spark, sf):
    c = V.colour_readings(spark, sf)
    return c.select(*L4, P.rgb_pack("r8", "g8", "b8").alias("packed"))


LUX_SQL = """
, lc AS (
  SELECT *, (256 - integration_code) AS cyc, (256 - integration_code) * 2.4 AS t_ms FROM colour_readings),
lc2 AS (
  SELECT *, CASE WHEN t_ms < 150 THEN sat0 - sat0 / 4 ELSE sat0 END AS sat,
         CASE WHEN r + g + b > clear THEN (r + g + b - clear) / 2.0 ELSE 0.0 END AS ir
  FROM (SELECT *, CASE WHEN cyc > 63 THEN 65535.0 ELSE cyc * 1024.0 END AS sat0 FROM lc)),
lc3 AS (
  SELECT *, r - ir AS r2, g - ir AS g2, b - ir AS b2,
         CASE WHEN (t_ms * gain) / (glass * 310.0) = 0 THEN 0.001 ELSE (t_ms * gain) / (glass * 310.0) END AS cpl
  FROM lc2)"""


@query("lux_cct", LUX_SQL + f"""
SELECT {L4_SQL},
       CASE WHEN clear < sat THEN (0.136 * r2 + 1.0 * g2 + -0.444 * b2) / cpl END AS lux,
       CASE WHEN clear < sat THEN 3810 * b2 / (CASE WHEN r2 = 0 THEN 0.001 ELSE r2 END) + 1391 END AS cct
FROM lc3""", ("colour_readings",))
def q_lux_cct(spark, sf):
    c = V.colour_readings(spark, sf)
    x = P.lux_cct("r", "g", "b", "clear", "integration_code", "gain", "glass")
    return c.select(*L4, x["lux"].alias("lux"), x["cct"].alias("cct"))


@query("flag_colour", f"""
SELECT {L4_SQL}, CASE WHEN r8 >= 128 THEN 'RED' WHEN g8 >= 128 THEN 'GREEN' WHEN b8 >= 128 THEN 'BLUE'
                      ELSE 'YELLOW' END AS colour
FROM colour_readings""", ("colour_readings",))
def q_flag_colour(spark, sf):
    c = V.colour_readings(spark, sf)
    flag = [F.when(F.col(x) >= 128, 1).otherwise(0) for x in ("r8", "g8", "b8")]
    return c.select(*L4, P.flag_colour(*flag).alias("colour"))


@query("stock_to_robot_offset", """
SELECT x, y, x * 27 AS dx, y * 27 AS dy, -12 AS z FROM cells""", ("cells",))
def q_stock_offset(spark, sf):
    c = V.cells(spark, sf)
    o = P.stock_to_robot_offset("x", "y")
    return c.select("x", "y", o["dx"].alias("dx"), o["dy"].alias("dy"), o["z"].alias("z"))


# --- filters (§2.4) --------------------------------------------------------

@query("keys_present", f"""
SELECT seq FROM event_log
WHERE trim({_jfield('orderId')}) <> '' AND trim({_jfield('correlationId')}) <> ''""", ("event_log",))
def q_keys_present(spark, sf):
    from blockyard.operators.correlate import keys_present
    v = V.event_log(spark, sf, offsets=False)
    e = v.select("seq", P.nonblank_text_field("value", "orderId").alias("order_id"),
                 P.nonblank_text_field("value", "correlationId").alias("correlation_id"))
    return keys_present(e).select("seq")


@query("pickup_failed", """
SELECT id, sensor, CAST(json_extract_string(payload, '$.distance') AS DOUBLE) AS distance
FROM readings WHERE CAST(json_extract_string(payload, '$.distance') AS DOUBLE) > 25.0""", ("readings",))
def q_pickup_failed(spark, sf):
    from blockyard.operators.sensors import pickup_failed, with_distance
    return pickup_failed(with_distance(V.readings(spark, sf))).select("id", "sensor", "distance")


@query("available_cells", """
SELECT x, y, color FROM cells WHERE filled AND NOT reserved""", ("cells",))
def q_available_cells(spark, sf):
    return S.available_cells(V.cells(spark, sf)).select("x", "y", "color")


@query("unknown_colour_requests", """
SELECT seq, order_id, 400 AS status,
       'Unknown color: ' || color_raw || '. Valid colors: [''RED'', ''GREEN'', ''BLUE'', ''YELLOW'']' AS message
FROM requests WHERE item IS NOT NULL AND upper(color_raw) NOT IN ('RED', 'GREEN', 'BLUE', 'YELLOW')""",
       ("requests",))
def q_unknown_colour(spark, sf):
    r = V.requests(spark, sf).filter(F.col("item").isNotNull())
    return S.unknown_colour_requests(r).select("seq", "order_id", "status", "message")
