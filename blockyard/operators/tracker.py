"""Dashboard order tracker: decode events, fold them per order, expand
to display steps, pick the most recent orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockyard import constants as K
from blockyard.functions import event_step, item_type_from_text

def ms_to_ts(ms) -> F.Column:
    """Epoch ms -> TIMESTAMP_NTZ (UTC wall clock), no session zone."""
    return F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


DASHBOARD_FIELDS = "orderId STRING, message STRING, infoTitle STRING, infoText STRING, timestamp STRING"


def dashboard_events(log: DataFrame) -> DataFrame:
    """Topic log -> decoded dashboard events (seq, ts, topic, order_id,
    message, is_error, info_title, info_text, timestamp_ms). Payloads that
    are not JSON objects become ``{message: raw}`` (no order id).

    The payload is parsed once per row (``from_json`` into the fields the
    dashboard reads; a malformed text parses to null)."""
    v = F.col("value")
    p = F.from_json(v, DASHBOARD_FIELDS)
    d = log.select("seq", "ts", "topic", "value", p.alias("_p"))
    obj = F.coalesce(F.col("_p").isNotNull() & v.rlike(r"^\s*\{"), F.lit(False))

    def field(name):
        return F.when(obj, F.col(f"_p.{name}"))

    return d.select(
        "seq", "ts", "topic",
        field("orderId").alias("order_id"),
        F.when(obj, F.col("_p.message")).otherwise(v).alias("message"),
        F.coalesce(F.col("topic").startswith("error"), F.lit(False)).alias("is_error"),
        field("infoTitle").alias("info_title"),
        field("infoText").alias("info_text"),
        field("timestamp").try_cast("bigint").alias("timestamp_ms"))


def order_tracker(events: DataFrame) -> DataFrame:
    """Fold events (arrival order = ``seq``) into one status row per order.

    Start at step 0 on the first event; a detected step is accepted when it
    is >= the current step (= max of earlier detected steps), sets the step
    and overwrites ``failed``; a step time is recorded on a rise only; item
    type = last non-null; ``last_ts`` = last event.

    The fold reduces to order-free facts, so the whole tracker is ONE
    partial (map-side) aggregation per order - no window, no per-order sort,
    so a hot order is pre-aggregated on every task:
      * step = max detected step (floored at 0);
      * the last accepted event is the last event carrying that max step, so
        ``failed`` = max_by over the packed key (step, seq);
      * step s rises (and records its time) iff the first event with step s
        comes before the first event with any higher step."""
    e = events.filter(F.col("order_id").isNotNull() & (F.col("order_id") != ""))
    det = event_step("message", "is_error", "info_title")
    # item type as a small int code: fixed-width aggregation buffers keep the
    # aggregation a hash aggregation (a string buffer forces a sort)
    item = item_type_from_text("message", "info_text")
    code = F.array_position(F.array(*[F.lit(t) for t in K.ITEM_TYPES]), item)
    e = e.select("order_id", "seq", "ts", "timestamp_ms", det["step"].alias("step_d"),
                 det["failed"].alias("failed_d"), F.when(code > 0, code).cast("int").alias("item"))
    ts_ms, seq, step_d = F.col("timestamp_ms"), F.col("seq"), F.col("step_d")
    step_time = F.when(ts_ms.isNotNull() & (ts_ms != 0), ms_to_ts(ts_ms)).otherwise(F.col("ts"))
    aggs = [
        F.max(step_d).alias("_max_step"),
        F.max_by("item", F.when(F.col("item").isNotNull(), seq)).alias("item_code"),
        F.min("ts").alias("t0"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events"),
    ]
    # the last event of each step; the highest step's says whether the order failed
    aggs += [F.max_by("failed_d", F.when(step_d == s_, seq)).alias(f"_failed{s_}") for s_ in range(4)]
    for s_ in (1, 2, 3):
        aggs += [F.min(F.when(step_d == s_, seq)).alias(f"_first{s_}"),
                 F.min_by(step_time, F.when(step_d == s_, seq)).alias(f"_time{s_}"),
                 F.min(F.when(step_d > s_, seq)).alias(f"_above{s_}")]
    g = e.groupBy("order_id").agg(*aggs)

    def rise(s_):
        above = F.col(f"_above{s_}")
        return F.when(F.col(f"_first{s_}").isNotNull() & (above.isNull() | (F.col(f"_first{s_}") < above)),
                      F.col(f"_time{s_}")).alias(f"t{s_}")

    names = F.array(*[F.lit(t) for t in K.ITEM_TYPES])
    # guard the lookup: element_at with a NULL index does not reliably give NULL
    item_type = F.when(F.col("item_code").isNotNull(), F.element_at(names, F.col("item_code")))
    return g.select(
        "order_id", F.greatest(F.lit(0), F.coalesce("_max_step", F.lit(0))).cast("int").alias("step"),
        F.coalesce(F.coalesce(*[F.when(F.col("_max_step") == s_, F.col(f"_failed{s_}")) for s_ in range(4)]),
                   F.lit(False)).alias("failed"), item_type.alias("item_type"),
        "t0", rise(1), rise(2), rise(3), "last_ts", "n_events")


def tracker_steps(tracker: DataFrame) -> DataFrame:
    """Tracker row -> four display rows (idx, label, state, time)."""
    labels = F.array(*[F.lit(x) for x in K.STEP_LABELS])
    times = F.array("t0", "t1", "t2", "t3")
    t = tracker.select("order_id", "step", "failed", times.alias("times"),
                       F.posexplode(labels).alias("idx", "label"))
    i, s = F.col("idx"), F.col("step")
    state = (F.when(i < s, "done")
             .when(i == s, F.when(F.col("failed"), "failed")
                   .when(s == len(K.STEP_LABELS) - 1, "done").otherwise("active"))
             .otherwise(""))
    return t.select("order_id", i.cast("int").alias("idx"), "label", state.alias("state"),
                    F.element_at("times", i + 1).alias("time"))


def recent_orders(tracker: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` trackers updated last, newest first (a top-k: each task
    keeps n rows, one merge of n x tasks rows)."""
    return tracker.orderBy(F.col("last_ts").desc(), F.col("order_id")).limit(n)
