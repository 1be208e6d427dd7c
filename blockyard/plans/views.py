"""Derived test views V1-V11 over the driver tables (FIXTURES.md §3).

Each view is a lazy DataFrame over the parquet scans, so Catalyst prunes the
columns and pushes filters of the query that uses it down to the scan.
The DuckDB oracle derives the same views in ``oracle_views.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockyard import constants as K
from blockyard.functions import block_count, enum_normalise, epoch_ms
from blockyard.operators.sequencing import chunk_of, row_number
from blockyard.session import table

# Chunk widths for the skew-safe row numbers (units of the ordering key).
SEQ_CHUNK = 1 << 20
# The global numbering (no key) uses narrower chunks so it spreads over
# tasks; its prefix table stays small (rows / width).
GLOBAL_CHUNK = 1 << 16


def _case(col: F.Column, mapping: list, default=None) -> F.Column:
    """``CASE col WHEN k THEN v ...`` from (k, v) pairs in order."""
    expr = None
    for k, v in mapping:
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


# --- fixed values: V1 message texts ----------------------------------------
SIGNUP_ITEMS = ["CHAIR", "TABLE", "Shelf", "closet"]
ERROR_TEXTS = ["Inventory service unavailable", "Manufacturing failed", "Factory reported an error"]


def event_log(spark: SparkSession, sf_dir: str, offsets: bool = True) -> DataFrame:
    """V1: the events table as a topic log (seq, ts, partition, offset, key,
    topic, value JSON, ...). ``offsets=False`` leaves out the per-partition
    offset (a running count) for queries that do not read it."""
    e = table(spark, sf_dir, "events")
    uid, seq, et, ts = F.col("user_id"), F.col("event_id"), F.col("event_type"), F.col("ts")
    order_id = F.concat(uid.cast("string"), F.lit("-"), F.date_format(ts, "yyyyMMdd"))
    h = F.md5(order_id)
    signup_item = _case(uid % 4, list(enumerate(SIGNUP_ITEMS)))
    message = (F.when(et == "signup", F.concat(F.lit("Order received: "), signup_item))
               .when(et == "view", F.lit("Inventory reserved"))
               .when(et == "click", F.when(seq % 4 == 0, F.lit("Manufacturing succeeded via feedback"))
                     .otherwise(F.lit("Manufacturing started")))
               .when(et == "purchase", F.when(seq % 2 == 0, F.lit(None).cast("string"))
                     .otherwise(F.lit("Order complete")))
               .when(et == "error", _case(seq % 3, list(enumerate(ERROR_TEXTS)))))
    topic = _case(et, [("signup", K.INFO_TOPIC), ("view", K.INFO_TOPIC), ("click", K.INFO_TOPIC),
                       ("purchase", K.COMPLETE_TOPIC), ("error", K.ERROR_TOPIC)])
    d = e.select(
        seq.alias("seq"), ts, uid, et, (uid % 4).cast("int").alias("partition"),
        order_id.alias("order_id"), F.round(F.col("value") * 100).cast("long").alias("latency_ms"),
        h.alias("correlation_id"),
        F.when(seq % 5 == 0, order_id).otherwise(
            F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                        F.substring(h, 17, 4), F.substring(h, 21, 12))).alias("uuid_text"),
        topic.alias("topic"), message.alias("message"))
    m, s = F.col("message"), F.col("seq")
    msg_json = F.when(m.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), m, F.lit('"')))
    oid = F.when(s % 50 == 2, F.lit("")).otherwise(F.col("order_id"))
    value = (F.when(s % 50 == 0, F.concat(F.lit("oops "), s.cast("string")))
             .when(s % 50 == 1, F.lit("[1]"))
             .otherwise(F.concat(F.lit('{"message":'), msg_json, F.lit(',"orderId":"'), oid,
                                 F.lit('","correlationId":"'), F.col("correlation_id"),
                                 F.lit('","timestamp":'), epoch_ms("ts").cast("string"), F.lit("}"))))
    d = d.select("*", value.alias("value"), F.col("partition").cast("string").alias("key"))
    if offsets:
        d = row_number(d, ["partition"], ["seq"], "offset1", chunk_of("seq", SEQ_CHUNK))
        d = d.select(*[c for c in d.columns if c != "offset1"], (F.col("offset1") - 1).alias("offset"))
    return d


def waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 waiting: first signup per order (partial aggregation)."""
    v1 = event_log(spark, sf_dir, offsets=False)
    return (v1.filter(F.col("event_type") == "signup")
            .groupBy("order_id", "correlation_id").agg(F.min("ts").alias("start_ts")))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 outcomes: purchase -> complete, error -> error; every 7th carries a
    wrong correlation id."""
    v1 = event_log(spark, sf_dir, offsets=False)
    o = v1.filter(F.col("event_type").isin("purchase", "error"))
    return o.select(
        F.col("seq").alias("event_id"), "order_id",
        F.when(F.col("seq") % 7 == 0, F.md5(F.concat("order_id", F.lit("#"))))
         .otherwise(F.col("correlation_id")).alias("correlation_id"),
        "ts",
        F.when(F.col("event_type") == "purchase", F.lit("complete")).otherwise(F.lit("error")).alias("kind"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 cells: one row per stock cell (x, y, color, filled, reserved,
    order_id)."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    filled = k % 11 != 0
    held = filled & (k % 5 == 0)
    return p.select(
        F.expr("p_partkey div 4").alias("x"), (k % 4).alias("y"),
        _case(k % 4, list(enumerate(K.ORDER_COLOURS))).alias("color"),
        filled.alias("filled"), held.alias("reserved"),
        F.when(held, (k % 300).cast("string")).alias("order_id"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 fetch log: emptied cells and the order that fetched them."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    return p.filter(k % 11 == 0).select(
        (k % 300).cast("string").alias("order_id"), F.expr("p_partkey div 4").alias("x"),
        (k % 4).alias("y"), _case(k % 4, list(enumerate(K.ORDER_COLOURS))).alias("color"))


def stock_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 nested form: one row per x holding the array of cells by y (null
    cell = empty). The nested source shape of ``stock_grid_source``."""
    c = cells(spark, sf_dir)
    cell = F.when(F.col("filled"), F.struct("color", "reserved", "order_id"))
    return (c.groupBy("x")
            .agg(F.sort_array(F.collect_list(F.struct("y", cell.alias("cell")))).alias("ys"))
            .select("x", F.transform("ys", lambda s: s["cell"]).alias("row")))


# --- fixed values: V4 raw texts --------------------------------------------
RAW_ITEMS = ["Chair", " table ", "SHELF", "closet"]
RAW_COLOURS = ["Red", "green", "BLUE", "Yellow"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 reservation requests from orders, with repeats and HTTP status."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    # one scan: every 10th order arrives again, and one in 25 asks for another colour;
    # seq = 2 * key + repeat, so no two requests share a seq
    other = k % 25 == 3
    again = F.explode(F.when((k % 10 == 0) | other, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    o = o.select("o_orderkey", again.alias("_again"))
    r = o.select(
        (k * 2 + F.col("_again")).alias("seq"), (F.col("_again") == 1).alias("is_repeat"), k.cast("string").alias("order_id"),
        F.when(k % 97 == 0, F.lit("sofa")).otherwise(_case(k % 4, list(enumerate(RAW_ITEMS)))).alias("item_raw"),
        F.when(k % 89 == 0, F.lit("purple"))
         .otherwise(_case((F.expr("o_orderkey div 4") + F.when(other, F.col("_again")).otherwise(0)) % 4,
                          list(enumerate(RAW_COLOURS)))).alias("color_raw"),
        _case(k % 7, [(5, 409), (6, 503)], 200).alias("status"))
    item = enum_normalise("item_raw", K.ITEM_TYPES)
    return r.withColumn("item", item).withColumn("count", block_count("item"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 probes: click rows ask for the next reading of a sensor."""
    e = table(spark, sf_dir, "events")
    return (e.filter(F.col("event_type") == "click")
            .select(F.col("event_id").alias("id"), (F.col("user_id") % 10).cast("int").alias("sensor"),
                    F.col("ts").alias("t")))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 readings: view rows as distance messages (JSON text)."""
    e = table(spark, sf_dir, "events")
    return (e.filter(F.col("event_type") == "view")
            .select(F.col("event_id").alias("id"), (F.col("user_id") % 10).cast("int").alias("sensor"),
                    "ts", F.concat(F.lit('{"distance":'), (F.col("value") % 60).cast("string"),
                                   F.lit("}")).alias("payload")))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 deliveries: the log plus a redelivered copy of every 10th offset."""
    v1 = event_log(spark, sf_dir)
    # one pass over the log: every 10th offset is delivered twice
    copies = F.when(F.col("offset") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return v1.select("*", F.explode(copies).alias("delivery"))


def partition_ends(v1: DataFrame) -> DataFrame:
    """Highest offset per partition. Offsets are dense from 0, so it is the
    partition's row count - 1: a partial count, no offset numbering."""
    return v1.groupBy("partition").agg((F.count(F.lit(1)) - 1).alias("m"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 committed and processed offsets per partition (p3 has none)."""
    m = partition_ends(event_log(spark, sf_dir, offsets=False))
    p, mm = F.col("partition"), F.col("m")
    committed = (F.when(p == 0, F.floor(mm * 0.6)).when(p == 1, F.floor(mm * 0.9))
                 .when(p == 2, F.floor(mm * 0.2))).cast("long")
    processed = (F.when(p == 0, committed - 5).when(p == 1, committed - 10)
                 .otherwise(committed)).cast("long")
    return (m.filter(p != 3)
            .select("partition", committed.alias("committed"), processed.alias("processed")))


def log_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 log start per partition (retention moved p2 to half way)."""
    m = partition_ends(event_log(spark, sf_dir, offsets=False))
    return m.select("partition", F.when(F.col("partition") == 2, F.floor(F.col("m") * 0.5))
                    .otherwise(F.lit(0)).cast("long").alias("log_start"))


def _l4(li: DataFrame) -> list[str]:
    return ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7 robot commands: robot = supplier, one command per line item in L4
    order."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
        "l_tax", "l_returnflag")
    li = row_number(li, ["l_suppkey"], _l4(li), "seq", chunk_of("l_orderkey", SEQ_CHUNK))
    n = F.col("l_linenumber") % 4
    kind = (F.when(n == 0, F.lit("MovementCommand"))
            .when(n.isin(1, 2), F.lit("RelativeMovementCommand"))
            .otherwise(F.lit("SuctionCupCommand")))
    is_move = n != 3
    qty = F.col("l_quantity").cast("int")
    return li.select(
        F.col("l_suppkey").alias("robot"), "seq", kind.alias("kind"),
        F.when(n == 0, qty).when(n.isin(1, 2), qty - 25).cast("double").alias("x"),
        F.when(n.isin(0, 1), F.round(F.col("l_discount") * 100)).cast("double").alias("y"),
        F.when(is_move, F.round(F.col("l_tax") * 100)).cast("double").alias("z"),
        F.when(is_move, F.lit(0.0)).alias("r"),
        F.when(n == 3, F.col("l_returnflag") == "R").alias("suck"))


def robot_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V13: V7, in which some moves are speed and conveyor commands instead
    (by the whole part of x and z); ``speed, acceleration, distance,
    direction`` as these need them."""
    c = commands(spark, sf_dir)
    k = F.when(F.col("kind") == "RelativeMovementCommand", (F.col("x") + F.col("z")).cast("int") % 7)
    kind = (F.when(k == 1, "MovementSpeedCommand").when(k == 2, "MoveConveyorCommand").when(k == 3, "RunConveyorCommand")
            .otherwise(F.col("kind")))
    other = F.coalesce(k.isin(1, 2, 3), F.lit(False))
    return c.select(
        "robot", "seq", kind.alias("kind"), *[F.when(~other, F.col(a)).alias(a) for a in "xyzr"], "suck",
        F.when(other, F.col("x") + 30).alias("speed"), F.when((k == 1) & (F.col("z") > 3), F.col("z") * 10).alias("acceleration"),
        F.when(k == 2, F.col("z") * 2).alias("distance"),
        F.when(k.isin(2, 3), F.when(F.col("x") > 0, "FORWARD").otherwise("BACKWARD")).alias("direction"))


def colour_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8 colour readings: raw and byte channels plus the expected colour."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    pk, sk, ok = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    r, g, b = pk * 31 % 1000, sk * 97 % 1000, ok * 13 % 1000
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        r.alias("r"), g.alias("g"), b.alias("b"),
        F.when(ok % 101 == 0, F.lit(0)).otherwise((r + g + b) % 1500).cast("long").alias("clear"),
        (pk % 256).alias("r8"), (sk * 7 % 256).alias("g8"), (ok * 13 % 256).alias("b8"),
        _case(F.col("l_linenumber") % 4, list(enumerate(K.ORDER_COLOURS))).alias("expected"),
        F.lit(192).alias("integration_code"), F.lit(4).alias("gain"), F.lit(1.0).alias("glass"))


# --- fixed values: V10 activities ------------------------------------------
ACTIVITIES = [("reserve", "Activity_reserveInventory"),
              ("reset after timeout", "Activity_0uhz0y6"),
              ("reset after error", "Activity_0ezfqp2")]


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V10 attempt log: one try per line item."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")
    n = F.col("l_linenumber") % 3
    return li.select(
        F.col("l_orderkey").alias("order_key"),
        _case(n, [(i, a) for i, (a, _) in enumerate(ACTIVITIES)]).alias("activity"),
        _case(n, [(i, a) for i, (_, a) in enumerate(ACTIVITIES)]).alias("activity_id"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_returnflag") != "R").alias("success"), (F.col("l_partkey") % 3 != 0).alias("technical"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V11 cell action log: global seq in L4 order, one restore_all at half
    of the highest seq (marked by ``restore_all_after``)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    li = row_number(li, [], _l4(li), "seq", chunk_of("l_orderkey", GLOBAL_CHUNK))
    n = F.col("l_linenumber") % 3
    pk = F.col("l_partkey")
    acts = li.select(
        "seq", pk.alias("cell"), F.expr("l_partkey div 4").alias("x"), (pk % 4).alias("y"),
        _case(pk % 4, list(enumerate(K.ORDER_COLOURS))).alias("color"),
        _case(n, [(0, "reserve"), (1, "fetch"), (2, "restore")]).alias("action"),
        (F.col("l_suppkey") % 3).cast("string").alias("order_id"))
    # seq is a dense row number 1..n, so max(seq) = count(*) (no second pass)
    n_rows = table(spark, sf_dir, "lineitem").select("l_orderkey")
    reset = n_rows.agg(F.floor(F.count(F.lit(1)) / 2).cast("long").alias("seq")).select(
        "seq", F.lit(None).cast("long").alias("cell"), F.lit(None).cast("long").alias("x"),
        F.lit(None).cast("long").alias("y"), F.lit(None).cast("string").alias("color"),
        F.lit("restore_all").alias("action"), F.lit(None).cast("string").alias("order_id"))
    return acts.unionByName(reset)


#: Requests between whose places the restores of V12 come, in groups.
RESTORE_AFTER = 2000


def stock_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12 mixed stock requests: V4 with wider seq, a fetch some requests
    after one order in six, and restores of low orders (which hold cells from
    the start, or get some early) in three groups."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    r = requests(spark, sf_dir).select((F.col("seq") * 1000).alias("seq"), F.lit("reserve").alias("kind"), "order_id", "count", "color_raw")
    f = o.filter(k % 6 == 1).select((k * 2000 + 50_500).alias("seq"), F.lit("fetch").alias("kind"), k.cast("string").alias("order_id"))
    b = o.filter((k < 300) & (k % 10).isin(5, 7)).select(
        ((k % 3 + 1) * (RESTORE_AFTER * 1000) + 1 + k).alias("seq"), F.lit("restore").alias("kind"), k.cast("string").alias("order_id"))
    return r.unionByName(f.unionByName(b), allowMissingColumns=True)
