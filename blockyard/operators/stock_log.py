"""A log of mixed stock requests, answered as if they came one by one.

Stock: one row per cell, ``x, y, color, filled, order_id, logged_by``: the
order that holds the cell, or the one whose fetch emptied it (the fetch log).
Requests: ``seq, kind, order_id, count, color_raw``, kind one of ``reserve``,
``fetch``, ``restore`` (without an order: everything) and ``restore_all``.

The log is cut into epochs, in none of which a reserve follows a restore.
Within an epoch free cells only become fewer while requests are reserved, so
the rounds of :mod:`stock` decide all reserves at once; what a fetch or restore
finds then depends on four facts per order. An epoch is a bounded number of
joins and aggregations over its requests and the stock, whatever their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockyard.operators.sequencing import chunk_of, running_many
from blockyard.operators.stock import SEQ_CHUNK, _allocation, _placed, _reserve_replies, restore_all
from blockyard.session import materialize

STOCK = "x long, y long, color string, filled boolean, order_id string, logged_by string"
REPLY = "seq long, kind string, order_id string, color string, count long, status int, message string"
RESET_TEXT = "Inventory restored to default state"
MISSING_TEXT = "Field required"


def stock_of(cells: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Stock from a cell table (``x, y, color, filled, reserved, order_id``)
    and a fetch log (``order_id, x, y, color``)."""
    logged = fetch_log.select("x", "y", F.col("order_id").alias("logged_by"))
    return cells.join(logged, ["x", "y"], "left").select(
        "x", "y", "color", "filled", F.when(F.col("filled"), F.col("order_id")).alias("order_id"),
        F.when(~F.col("filled"), F.col("logged_by")).alias("logged_by"))


def with_epochs(requests: DataFrame, chunk_width: int = SEQ_CHUNK) -> DataFrame:
    """``requests`` with ``epoch``: how many reserves before it, itself
    included, have a restore as their predecessor among reserves and restores."""
    mark = F.when(F.col("kind") == "reserve", 1).when(F.col("kind").startswith("restore"), 2)
    chunk = chunk_of("seq", chunk_width)
    d = running_many(requests, [], ["seq"], [(mark, "_last", "last", False)], chunk)
    turn = ((F.col("kind") == "reserve") & (F.coalesce("_last", F.lit(0)) == 2)).cast("long")
    return running_many(d, [], ["seq"], [(turn, "epoch", "sum")], chunk, stage=True).drop("_last")


def _answer(kind: str, rows: DataFrame, done: Column, count: Column, good: Column, bad: Column) -> DataFrame:
    missing = F.col("order_id").isNull()
    return rows.select("seq", F.lit(kind).alias("kind"), "order_id", F.lit(None).cast("string").alias("color"),
                       F.when(done, count).otherwise(0).cast("long").alias("count"),
                       F.when(done, 200).when(missing, 422).otherwise(404).alias("status"),
                       F.when(done, good).when(missing, F.lit(MISSING_TEXT)).otherwise(bad).alias("message"))


def _epoch(stock: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(replies, stock after) for requests in which no reserve follows a restore."""
    kind = F.col("kind")
    whole = (kind == "restore_all") | ((kind == "restore") & F.col("order_id").isNull())
    cells = stock.withColumn("reserved", F.col("order_id").isNotNull())
    log = stock.filter(F.col("logged_by").isNotNull()).select(F.col("logged_by").alias("order_id"))
    a = materialize(_allocation(requests.filter(kind == "reserve"), cells, log), "stock-decisions")
    placed = materialize(_placed(a, cells).select("x", "y", F.col("order_id").alias("_won")), "stock-placed")

    # per order: cells held and since when, cells logged, first restore and the fetch that empties the cells
    named = F.col("order_id").isNotNull()
    reset, restoring, fetching = requests.agg(
        F.min(F.when(whole, F.col("seq"))), F.max((kind == "restore") & named), F.max((kind == "fetch") & named)).first()
    end = F.lit(reset).cast("long") if reset is not None else F.lit((1 << 63) - 1)
    before = requests.filter(F.col("seq") < end)
    held = cells.filter("reserved").select("order_id", F.lit(-(1 << 63)).alias("since"), F.lit(1).alias("held"), F.lit(0).alias("logged"))
    won = a.filter((kind == "granted") & (F.col("count") > 0)).select("order_id", F.col("seq").alias("since"), F.col("count").alias("held"), F.lit(0).alias("logged"))
    logged = log.select("order_id", F.lit(None).cast("long").alias("since"), F.lit(0).alias("held"), F.lit(1).alias("logged"))
    facts = held.unionByName(won).unionByName(logged).groupBy("order_id").agg(
        F.min("since").alias("since"), F.sum("held").alias("held"), F.sum("logged").alias("logged"))
    never = F.lit(None).cast("long")
    if restoring:
        restores = before.filter((kind == "restore") & named).groupBy("order_id").agg(F.min("seq").alias("restored"))
        facts = facts.join(restores, "order_id", "left")
    else:
        facts = facts.withColumn("restored", never)
    facts = materialize(facts, "stock-facts")
    if fetching:
        empties = before.filter(kind == "fetch").join(facts, "order_id") \
            .filter((F.col("held") > 0) & (F.col("seq") > F.col("since")) & (F.col("seq") < F.coalesce("restored", end))) \
            .groupBy("order_id").agg(F.min("seq").alias("fetched"))
        facts = materialize(facts.join(empties, "order_id", "left"), "stock-facts")
    else:
        facts = facts.withColumn("fetched", never)

    asked = requests.filter(kind != "reserve").filter(~whole).join(facts, "order_id", "left")
    quoted = F.concat(F.lit("'"), F.col("order_id"), F.lit("'"))
    amount = F.col("held") + F.col("logged")
    none, text = F.lit(None).cast("string"), F.lit
    replies = _reserve_replies(a).select("seq", F.lit("reserve").alias("kind"), "order_id", "color",
                                         F.col("count").cast("long").alias("count"), "status", "message")
    replies = replies.unionByName(_answer(
        "fetch", asked.filter(kind == "fetch"), F.coalesce(F.col("seq") == F.col("fetched"), F.lit(False)), F.col("held"), none,
        F.concat(text("No reserved blocks found for order "), quoted)))
    replies = replies.unionByName(_answer(
        "restore", asked.filter(kind == "restore"), F.coalesce(F.col("seq") == F.col("restored"), F.lit(False)), amount,
        F.concat(text("Restored "), amount.cast("string"), text(" block(s) for order "), quoted),
        F.concat(text("No blocks found for order "), quoted)))
    replies = replies.unionByName(requests.filter(whole).select(
        "seq", "kind", "order_id", none.alias("color"), F.lit(0).cast("long").alias("count"),
        F.lit(200).alias("status"), F.lit(RESET_TEXT).alias("message")))
    if reset is not None:
        after = restore_all(cells).select("x", "y", "color", "filled", "order_id", none.alias("logged_by"))
    else:
        now = stock.join(placed, ["x", "y"], "left").withColumn("order_id", F.coalesce("_won", "order_id")) \
            .withColumn("_of", F.coalesce("order_id", "logged_by"))
        now = now.join(facts.select(F.col("order_id").alias("_of"), F.col("restored").isNotNull().alias("_back"),
                                    F.col("fetched").isNotNull().alias("_gone")), "_of", "left")
        back, gone = (F.coalesce(c, F.lit(False)) for c in ("_back", "_gone"))
        holds = F.col("order_id").isNotNull()
        after = now.select(
            "x", "y", "color", (F.col("filled") & ~(holds & gone) | (F.col("_of").isNotNull() & back)).alias("filled"),
            F.when(~back & ~gone, F.col("order_id")).alias("order_id"),
            F.when(~back, F.when(holds & gone, F.col("order_id")).otherwise(F.col("logged_by"))).alias("logged_by"))
    return replies, after


def apply_stock_log(stock: DataFrame, requests: DataFrame, chunk_width: int = SEQ_CHUNK) -> tuple[DataFrame, DataFrame]:
    """(replies, stock after all requests). Replies: ``seq, kind, order_id,
    color, count, status, message``; count is what a reserve asked for, or the
    cells that a fetch or restore moved.

    Requests without an order or, to reserve, without a count are answered 422;
    an unknown colour 400; what does not fit, or an order that already holds or
    has fetched cells, 409; nothing to fetch or restore 404. An order that was
    refused may ask again, for any colour. ``seq`` must be unique. Without
    requests there are no replies and the stock stays. ``requests`` is read
    once; the last epoch's replies and stock are left to the caller to write."""
    cols = ["seq", "kind", "order_id", "count", "color_raw"]
    # dealt by seq, since a few log files would be read by as few tasks again and again
    dealt = materialize(requests.select(*cols).repartition("seq"), "stock-requests")
    rows, restoring = dealt.agg(F.count(F.lit(1)), F.max(F.col("kind").startswith("restore"))).first()
    epochs = min(rows, 1)
    if restoring:
        dealt = materialize(with_epochs(dealt, chunk_width), "stock-requests")
        epochs = int(dealt.agg(F.max("epoch")).first()[0]) + 1
    replies = dealt.sparkSession.createDataFrame([], REPLY)
    for epoch in range(epochs):
        part, stock = _epoch(stock, (dealt.filter(F.col("epoch") == epoch) if restoring else dealt).select(*cols))
        if epoch + 1 < epochs:
            part, stock = materialize(part, "stock-replies"), materialize(stock, "stock")
        replies = replies.unionByName(part)
    return replies, stock
