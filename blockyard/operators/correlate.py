"""Correlation of outcomes to waiting orders, and races with timeouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["order_id", "correlation_id"]
# outcome kinds as codes: fixed-width aggregation buffers (hash aggregation)
KINDS = ["complete", "error"]


def _first_outcome(j: DataFrame) -> DataFrame:
    """Earliest outcome per waiting order: min_by per column (ts unique).
    Orders without an in-window outcome (left join) keep null columns."""
    code = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    g = j.withColumn("_kind", code).groupBy(*KEYS, "start_ts").agg(
        F.min_by("event_id", F.col("ts")).alias("event_id"),
        F.min_by("_kind", F.col("ts")).alias("_kind"),
        F.min("ts").alias("ts"))
    names = F.array(*[F.lit(k) for k in KINDS])
    return g.withColumn("kind", F.when(F.col("_kind") > 0, F.element_at(names, F.col("_kind")))).drop("_kind")


def keys_present(events: DataFrame) -> DataFrame:
    """Events with a non-blank order id and correlation id."""
    def ok(c):
        return F.coalesce(F.regexp_replace(F.col(c), r"\s", "") != "", F.lit(False))
    return events.filter(ok("order_id") & ok("correlation_id"))


def _deadline(start: str, seconds: int) -> F.Column:
    return F.timestamp_add("SECOND", F.lit(seconds), F.col(start))


def _in_window(waiting: DataFrame, outcomes: DataFrame, timeout_s: int, how: str) -> DataFrame:
    """Equi-join on the two keys with ``start <= ts < start + timeout``. The
    waiting side has one row per key, so a hot order on the outcome side is
    split by AQE's skew-join handling instead of landing in one task."""
    o = outcomes.select(*KEYS, "event_id", "kind", "ts")
    cond = [waiting[k] == o[k] for k in KEYS] + [
        o["ts"] >= waiting["start_ts"], o["ts"] < _deadline("start_ts", timeout_s)]
    j = waiting.join(o, cond, how)
    return j.select(*[waiting[k] for k in KEYS], "start_ts", "event_id", "kind", o["ts"].alias("ts"))


def correlate_outcomes(waiting: DataFrame, outcomes: DataFrame, timeout_s: int) -> DataFrame:
    """Each waiting order with the outcome that reached it: the earliest
    outcome in its window (an order stops waiting at the first one).
    ``min_by`` is a partial aggregation - no per-order sort."""
    j = _in_window(waiting, outcomes, timeout_s, "inner")
    return _first_outcome(j).select(*KEYS, "start_ts", "event_id", "kind", "ts")


def duplicate_waiting(waiting: DataFrame) -> DataFrame:
    """Waiting keys present more than once (correlation must be unique)."""
    return waiting.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def uncorrelated_events(outcomes: DataFrame, matched: DataFrame) -> DataFrame:
    """Outcomes no order consumed: unknown keys, too early, too late, or
    after the first outcome (left anti join on the event id)."""
    return outcomes.join(matched.select("event_id"), "event_id", "left_anti")


def order_race(waiting: DataFrame, outcomes: DataFrame, timeout_s: int) -> DataFrame:
    """Per waiting order the earliest of complete / error / timeout wins.
    ``winner`` in (complete, error, timeout); ``decided_ts`` its time.

    Outcomes are first reduced to one row per order (an inner join, which AQE
    can split at a hot order, then a partial aggregation); the outer join has
    one row on either side."""
    first = correlate_outcomes(waiting, outcomes, timeout_s)
    w = waiting.select(*KEYS, "start_ts").distinct()
    g = w.join(first, [*KEYS, "start_ts"], "left")
    return g.select(
        *KEYS, "start_ts",
        F.coalesce(F.col("kind"), F.lit("timeout")).alias("winner"),
        "event_id",
        F.coalesce(F.col("ts"), _deadline("start_ts", timeout_s)).alias("decided_ts"))


def assembly_timeout(waiting: DataFrame, outcomes: DataFrame, timeout_s: int) -> DataFrame:
    """The factory's assembly timer: the same race with its own timeout."""
    return order_race(waiting, outcomes, timeout_s)
