"""Races of orders with a timer, as a stateful stream with event-time timers.

Orders are dealt to buckets by hash; a bucket's state is one small table: per
order its first start and, until it is decided, the outcomes that came. When the
watermark has passed ``start + timeout``, no earlier record can come any more
and the order is decided; so records may come in any order within the
watermark's delay. A decided order is remembered for ``keep`` longer, to
tell which of its later outcomes are late, and then forgotten, as is an order
that never starts: state is bounded by the orders of the last timeout, delay
and ``keep``, not by all orders. A bucket has one timer, for the first of its
orders, and works on all its orders at once, so calls to the state are by bucket
and micro-batch, not by order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RACE = ("order_id string, correlation_id string, result string, winner string, event_id long, "
        "start_us long, at_us long")
COLUMNS = ["order_id", "correlation_id", "result", "winner", "event_id", "start_us", "at_us"]
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets of orders; a checkpoint holds on to their number.
BUCKETS = 256
OPEN = ["order_id", "correlation_id", "kind", "us", "event_id", "what"]
START, DECIDED, OUTCOME = 0, 1, 2
NEVER = np.iinfo(np.int64).max


class OrderRace(StatefulProcessor):
    """Emits one ``decided`` row per order, and a ``late`` row per outcome that did not decide it."""

    def __init__(self, timeout_s: int, keep_s: int):
        self.timeout_us, self.keep_us = timeout_s * 1_000_000, keep_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "rows binary, timer long")  # an Arrow table of OPEN

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new["what"] = np.where(new["kind"] == "start", START, OUTCOME)
        yield from self._step(new[OPEN], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(None, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _step(self, new: pd.DataFrame | None, now: int, fired: int | None = None) -> Iterator[pd.DataFrame]:
        packed, timer = self.open.get() if self.open.exists() else (None, None)
        parts = [pa.ipc.open_stream(packed).read_pandas()] if packed else []
        parts += [] if new is None else [new]
        if not parts:
            return
        found, left, wake = self._decide(pd.concat(parts, ignore_index=True), now)
        if timer is not None and timer != fired and timer != wake:
            self.handle.deleteTimer(timer)
        if wake is None:
            self.open.clear()
        else:
            table, out = pa.Table.from_pandas(left, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema) as writer:
                writer.write_table(table)
            self.open.update((out.getvalue().to_pybytes(), wake))
            if timer != wake or timer == fired:
                self.handle.registerTimer(wake)
        if len(found):
            yield found

    def _decide(self, d: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
        """(rows to emit, rows to keep, when to look again) of a bucket's rows at the watermark ``now``."""
        of = d.groupby(["order_id", "correlation_id"], sort=False, dropna=False).ngroup().to_numpy()
        us, event, what = (d[c].to_numpy(np.int64) for c in ("us", "event_id", "what"))
        kind = pd.factorize(d["kind"], sort=True)[0]
        n = int(of.max()) + 1
        _, row = np.unique(of, return_index=True)  # a row of each order

        def least(mask):
            out = np.full(n, NEVER)
            np.minimum.at(out, of[mask], us[mask])
            return out
        start = least(what == DECIDED)
        known = start < NEVER
        start = np.where(known, start, least(what == START))
        begun, outcome = start < NEVER, what == OUTCOME
        end = np.where(begun, start, 0) + self.timeout_us
        due = begun & ~known & (end // 1000 <= now)
        after = outcome & (us >= start[of])

        # the first outcome in time wins; of equal times the smallest event
        came = np.flatnonzero(after & due[of])
        came = came[np.lexsort((kind[came], event[came], us[came], of[came]))]
        first = came[np.r_[True, of[came][1:] != of[came][:-1]]] if len(came) else came
        first = first[us[first] < end[of[first]]]
        won = np.full(n, -1)
        won[of[first]] = first
        w = won[of]
        same = (w >= 0) & (us == us[w]) & (event == event[w]) & (kind == kind[w])
        late = after & (known[of] | (due[of] & ~same))
        decided = np.flatnonzero(due)
        by = won[decided]
        found = pd.concat([
            pd.DataFrame({"order_id": d["order_id"].to_numpy()[row[decided]], "correlation_id": d["correlation_id"].to_numpy()[row[decided]],
                          "result": "decided", "winner": np.where(by >= 0, d["kind"].to_numpy()[by], "timeout"),
                          "event_id": pd.array(event[by], "Int64"), "start_us": start[decided], "at_us": np.where(by >= 0, us[by], end[decided])}),
            pd.DataFrame({"order_id": d["order_id"].to_numpy()[late], "correlation_id": d["correlation_id"].to_numpy()[late], "result": "late",
                          "winner": None, "event_id": pd.array(event[late], "Int64"), "start_us": start[of[late]], "at_us": us[late]})],
            ignore_index=True)[COLUMNS]
        found.loc[np.flatnonzero(by < 0), "event_id"] = pd.NA

        # forgotten: orders decided earlier, and orders without a start, `keep` after their last time
        last = np.full(n, -NEVER)
        np.maximum.at(last, of[outcome], us[outcome])
        until = np.where(begun, end, last) + np.where(begun & ~known & ~due, 0, self.keep_us)
        gone = (known | ~begun) & (until // 1000 <= now)
        heads = np.flatnonzero(begun & ~gone)
        head = d.iloc[row[heads]][OPEN].assign(kind="start", us=start[heads], event_id=-1, what=np.where((known | due)[heads], DECIDED, START))
        left = pd.concat([head, d[outcome & ~(known | due | gone)[of]]], ignore_index=True)
        return found, left, int((until[~gone] // 1000).min()) if len(left) else None


def order_races(starts: DataFrame, outcomes: DataFrame, timeout_s: int, delay: str = "1 hour", keep_s: int = 86400) -> DataFrame:
    """Decided orders and late outcomes (``result``) of a stream of starts (``order_id, correlation_id, start_ts``) and
    outcomes (``event_id, order_id, correlation_id, kind, ts``). Both times of a row are microseconds since the epoch.
    Start the query under :func:`rocks_state`, which the state variables need."""
    def side(df, ts, kind, event):
        t = F.col(ts).cast("timestamp")
        return df.select("order_id", "correlation_id", kind.alias("kind"), F.unix_micros(t).alias("us"), event.alias("event_id"), t.alias("event_time"))
    both = side(starts, "start_ts", F.lit("start"), F.lit(-1).cast("long")).unionByName(side(outcomes, "ts", F.col("kind"), F.col("event_id")))
    bucket = F.pmod(F.xxhash64("order_id", "correlation_id"), F.lit(BUCKETS)).cast("int")
    return both.withColumn("bucket", bucket).withWatermark("event_time", delay).groupBy("bucket").transformWithStateInPandas(
        OrderRace(timeout_s, keep_s), RACE, "append", "eventTime")


class rocks_state:
    """State stores of the streams that start inside the block are RocksDB's."""

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self):
        self.old = self.conf.get(STORE, None)
        self.conf.set(STORE, ROCKS)

    def __exit__(self, *_):
        if self.old is None:
            self.conf.unset(STORE)
        else:
            self.conf.set(STORE, self.old)


def race_rows(found: DataFrame) -> DataFrame:
    """Decided orders: ``order_id, correlation_id, start_ts, winner, event_id, decided_ts``."""
    return found.filter("result = 'decided'").select(
        "order_id", "correlation_id", F.timestamp_micros("start_us").cast("timestamp_ntz").alias("start_ts"), "winner", "event_id",
        F.timestamp_micros("at_us").cast("timestamp_ntz").alias("decided_ts"))


def late_rows(found: DataFrame) -> DataFrame:
    """Late outcomes: ``event_id, order_id, correlation_id``."""
    return found.filter("result = 'late'").select("event_id", "order_id", "correlation_id")
