"""Stock grid: availability, all-or-nothing reservation, fetch and restore.
(Mixed logs: :mod:`stock_log`; replay of cell ledgers: :mod:`ledger`.)

Cell table: ``x, y, color, filled, reserved, order_id`` (one row per cell).
Requests: ``seq, order_id, count, color_raw`` in arrival order ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockyard import constants as K
from blockyard.operators.sequencing import chunk_of, row_number, running
from blockyard.session import materialize

SEQ_CHUNK = 1 << 20
CELL_CHUNK = 1 << 16

# --- fixed values: inventory response texts --------------------------------
VALID_COLOURS_TEXT = "['RED', 'GREEN', 'BLUE', 'YELLOW']"
# answer to a request without a count or an order (the body fails validation)
INVALID_TEXT = "Input should be a valid integer"


def _first_of_key(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """Mark the earliest row per key (partial aggregation + join; no
    per-key window, so a hot key does not sit in one task)."""
    firsts = df.groupBy(key).agg(F.min(order).alias("_key_min"))
    return (df.join(firsts, key, "left")
            .withColumn(out, F.col(order) == F.col("_key_min")).drop("_key_min"))


def available_cells(cells: DataFrame, colour: str | None = None) -> DataFrame:
    """Non-empty, not reserved (and of the given colour)."""
    c = cells.filter(F.col("filled") & ~F.col("reserved"))
    return c.filter(F.col("color") == colour) if colour else c


def row_major_cells(cells: DataFrame) -> DataFrame:
    """Cells by x then y."""
    return cells.orderBy("x", "y")


def unknown_colour_requests(requests: DataFrame) -> DataFrame:
    """Requests whose upper-cased colour is not a stock colour -> 400 rows."""
    colour = F.upper(F.col("color_raw"))
    bad = requests.filter(~F.coalesce(colour.isin(*K.ORDER_COLOURS), F.lit(False)))
    return bad.withColumn("status", F.lit(400)).withColumn(
        "message", F.concat(F.lit("Unknown color: "), F.col("color_raw"),
                            F.lit(". Valid colors: " + VALID_COLOURS_TEXT)))


def stock_by_colour(cells: DataFrame) -> DataFrame:
    """Available, reserved and empty counts per colour (partial agg)."""
    f, r = F.col("filled"), F.col("reserved")
    return cells.groupBy("color").agg(
        F.count_if(f & ~r).alias("available"), F.count_if(f & r).alias("reserved"),
        F.count_if(~f).alias("empty"))


def reserved_positions(cells: DataFrame) -> DataFrame:
    """Positions held per order, in row-major order, as long-form rows
    ``(order_id, pos, x, y, color)`` (the list of the reference, one element
    per row; no per-order collect). Orders holding nothing have no row."""
    held = cells.filter(F.col("filled") & F.col("order_id").isNotNull()).select("order_id", "x", "y", "color")
    # chunks by x are in row-major order whatever the grid's width
    return row_number(held, ["order_id"], ["x", "y"], "pos", chunk_of("x", CELL_CHUNK))


def order_positions(orders: DataFrame, cells: DataFrame) -> DataFrame:
    """Each order with the colour and positions it holds (left join; no
    holding -> one row with nulls)."""
    pos = reserved_positions(cells)
    return orders.join(pos, "order_id", "left")


def duplicate_reservations(requests: DataFrame, cells: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Requests whose order already holds cells or is in the fetch log
    (left semi join against the union of both key sets)."""
    holders = (cells.filter(F.col("order_id").isNotNull()).select("order_id")
               .unionByName(fetch_log.select("order_id")))
    return requests.join(holders, "order_id", "left_semi")


def _free_ranked(cells: DataFrame) -> DataFrame:
    """Free cells numbered 1.. per colour in row-major order."""
    free = available_cells(cells).select("color", "x", "y")
    return row_number(free, ["color"], ["x", "y"], "rank", chunk_of("x", CELL_CHUNK))


def _by_colour(values: dict) -> Column:
    """The value of the row's colour; null for a colour without one."""
    out = F.lit(None).cast("long")
    for colour, v in values.items():
        if v is not None:
            out = F.when(F.col("color") == colour, F.lit(int(v)).cast("long")).otherwise(out)
    return out


def _allocation(requests: DataFrame, cells: DataFrame, fetch_log: DataFrame,
                chunk_width: int = SEQ_CHUNK) -> DataFrame:
    """Decide every request as if they came one by one in ``seq`` order:
    ``seq, order_id, color, color_raw, count, kind, avail, _used_before``,
    kind one of invalid (no count or order), bad_colour, duplicate, granted,
    insufficient."""
    r = requests.select("seq", "order_id", "count", "color_raw",
                        F.upper(F.col("color_raw")).alias("color"))
    invalid = F.col("count").isNull() | F.col("order_id").isNull()
    known = F.coalesce(F.col("color").isin(*K.ORDER_COLOURS), F.lit(False))
    holders = (cells.filter(F.col("order_id").isNotNull()).select("order_id")
               .unionByName(fetch_log.select("order_id")).distinct()
               .withColumn("_held", F.lit(True)))
    ok = (r.filter(~invalid & known).join(holders, "order_id", "left")
          .withColumn("_held", F.coalesce("_held", F.lit(False))))
    chunk = chunk_of("seq", chunk_width)
    # one row per colour (bounded by the colour enum)
    free = dict.fromkeys(K.ORDER_COLOURS, 0) | {
        x["color"]: x["n"] for x in available_cells(cells).filter(F.col("color").isin(*K.ORDER_COLOURS))
        .groupBy("color").agg(F.count(F.lit(1)).alias("n")).collect()}
    cols = ["seq", "order_id", "color", "color_raw", "count"]
    none = [F.lit(None).cast("long").alias(c) for c in ("avail", "_used_before")]
    bad = r.filter(invalid | ~known).select(
        *cols, F.when(invalid, F.lit("invalid")).otherwise(F.lit("bad_colour")).alias("kind"), *none)
    # What asks for more than is free at the start never fits, so it does not
    # compete; it is refused, or a duplicate, at the end.
    competes = ~F.col("_held") & (F.col("count") > 0) & (F.col("count") <= _by_colour(free))
    if any(free.values()):
        # Iterative plan: cut the lineage of each round (a table written to the
        # shared checkpoint folder) so plans stay small and a lost executor only
        # recomputes one round.
        ok = materialize(ok, "reserve-requests")
    if not any(free.values()) or ok.filter(competes).isEmpty():  # nothing is granted: no rounds, no running counts
        kind = (F.when(F.col("_held"), F.lit("duplicate")).when(F.col("count") <= 0, F.lit("granted"))
                .otherwise(F.lit("insufficient")))
        d = ok.select(*cols, kind.alias("kind"), _by_colour(free).alias("avail"), F.lit(0).cast("long").alias("_used_before"))
        return d.unionByName(bad)

    # Rounds of "grant the prefix that fits". An order competes until it is
    # granted; within a round its earliest remaining request is taken to be
    # granted and its later ones to be duplicates. Per colour this holds up to
    # the first request that does not fit, and there for sure up to V, the
    # first misfit of all colours. Beyond V, a later request of an order whose
    # earliest one is for another colour and not before V is undecided, so its
    # colour stops there for this round. What stays behind a stop competes
    # again if its count still fits. Each round refuses a request at V, so the
    # largest competing count of a colour drops: rounds <= colours x largest
    # count (the largest count alone where no order changes its colour).
    rem, granted = dict(free), []
    code = F.array_position(F.array(*[F.lit(c) for c in K.ORDER_COLOURS]), F.col("color"))
    cur = ok.filter(competes).select("seq", "order_id", "color", "count")
    while True:
        firsts = cur.groupBy("order_id").agg(F.min("seq").alias("_f"), F.min_by(code, F.col("seq")).alias("_fc"))
        c = cur.join(firsts, "order_id", "inner")
        first = F.col("seq") == F.col("_f")
        eff = F.when(first, F.col("count")).otherwise(F.lit(0)).cast("long")
        cs = running(c, ["color"], ["seq"], eff, "_cs", "sum", chunk)
        cs = materialize(cs.select("seq", "order_id", "color", "count", "_f", "_cs", first.alias("_first"),
                                   (F.col("_cs") > _by_colour(rem)).alias("_over"),
                                   (~first & (code != F.col("_fc"))).alias("_cross")), "reserve-round")
        stats = {x["color"]: x for x in cs.groupBy("color").agg(
            F.min(F.when(F.col("_over"), F.col("seq"))).alias("misfit"), F.max("_cross").alias("cross"),
            F.max(F.when(~F.col("_over"), F.col("_cs"))).alias("used")).collect()}
        misfit = {k: x["misfit"] for k, x in stats.items()}
        stop, used = dict(misfit), {k: x["used"] for k, x in stats.items()}
        upto = min((m for m in misfit.values() if m is not None), default=None)
        if upto is not None and any(x["cross"] for x in stats.values()):
            open_ = cs.filter(F.col("_cross") & (F.col("_f") >= upto)).groupBy("color").agg(F.min("seq").alias("seq")).collect()
            for x in open_:
                stop[x["color"]] = x["seq"] if stop[x["color"]] is None else min(stop[x["color"]], x["seq"])
            used = {x["color"]: x["used"] for x in cs.filter(F.col("seq") < _by_colour(stop) if any(stop.values()) else F.lit(True))
                    .groupBy("color").agg(F.max("_cs").alias("used")).collect()} | {
                        k: u for k, u in used.items() if stop[k] is None}
        behind = F.coalesce(F.col("seq") >= _by_colour(stop), F.lit(False))
        won = cs.filter(F.col("_first") & ~behind).select("seq", "order_id")
        granted.append(won.select("seq"))
        rem = {k: v - (used.get(k) or 0) for k, v in rem.items()}
        if upto is None:
            break
        cur = materialize(cs.filter(behind & ~F.coalesce(F.col("seq") == _by_colour(misfit), F.lit(False))
                                    & (F.col("count") <= _by_colour(rem)))
                          .join(won.select("order_id"), "order_id", "left_anti")
                          .select("seq", "order_id", "color", "count"), "reserve-left")
        if cur.isEmpty():
            break
    won = granted[0]
    for g in granted[1:]:
        won = won.unionByName(g)
    d = ok.join(won.withColumn("_granted", F.lit(True)), "seq", "left").withColumn(
        "_granted", F.coalesce("_granted", F.lit(False)))
    gcount = F.when(F.col("_granted"), F.col("count")).otherwise(F.lit(0)).cast("long")
    # inputs here are the written request table and the small round tables,
    # so this last pass needs no lineage cut of its own
    d = running(d, ["color"], ["seq"], gcount, "_used_before", "sum", chunk, inclusive=False)
    d = d.withColumn("avail", _by_colour(free) - F.coalesce("_used_before", F.lit(0)))
    # A request is a duplicate once an earlier request of its order was
    # granted (the order then holds cells).
    order_granted = d.filter("_granted").groupBy("order_id").agg(F.min("seq").alias("_gseq"))
    d = d.join(order_granted, "order_id", "left")
    kind = (F.when(F.col("_held"), F.lit("duplicate"))
            .when(F.col("_granted"), F.lit("granted"))
            .when(F.col("_gseq").isNotNull() & (F.col("_gseq") < F.col("seq")), F.lit("duplicate"))
            .when(F.col("count") <= 0, F.lit("granted"))  # nothing asked for, nothing held
            .otherwise(F.lit("insufficient")))
    return d.select(*cols, kind.alias("kind"), "avail", "_used_before").unionByName(bad)


def _reserve_replies(a: DataFrame) -> DataFrame:
    k = F.col("kind")
    status = F.when(k == "granted", 200).when(k == "bad_colour", 400).when(k == "invalid", 422).otherwise(409)
    msg = (F.when(k == "granted", F.lit(None).cast("string"))
           .when(k == "invalid", F.lit(INVALID_TEXT))
           .when(k == "bad_colour", F.concat(F.lit("Unknown color: "), F.coalesce("color_raw", F.lit("")),
                                             F.lit(". Valid colors: " + VALID_COLOURS_TEXT)))
           .when(k == "duplicate", F.concat(F.lit("Order '"), F.col("order_id"),
                                            F.lit("' already has reserved blocks")))
           .otherwise(F.concat(F.lit("Not enough "), F.col("color"), F.lit(" blocks. Requested: "),
                               F.col("count").cast("string"), F.lit(", available: "),
                               F.col("avail").cast("string"))))
    return a.select("seq", "order_id", "color", "count", status.alias("status"), msg.alias("message"))


def _placed(a: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of the granted requests of an allocation. Each expands to its
    ``count`` (<= 3) rank rows, joined to the ranked free cells on
    (color, rank) - an equi-join."""
    lo = F.coalesce(F.col("_used_before"), F.lit(0)) + 1
    want = a.filter((F.col("kind") == "granted") & (F.col("count") > 0)).select(
        "seq", "order_id", "color", F.explode(F.sequence(lo, lo + F.col("count") - 1)).alias("rank"))
    return want.join(_free_ranked(cells), ["color", "rank"], "inner").select(
        "seq", "order_id", "x", "y", "color")


def reserve_results(requests: DataFrame, cells: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """One result per request: 200, 400, 409 or 422 with the service's text."""
    return _reserve_replies(_allocation(requests, cells, fetch_log))


def reserve(requests: DataFrame, cells: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Cells granted to each request: the first free cells of its colour
    in row-major order, ``[used_before + 1, used_before + count]``."""
    return _placed(_allocation(requests, cells, fetch_log), cells)


def fetch(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """Fetch requests per order: the first request of an order empties the
    cells it holds (they enter the fetch log, status 200, one row per
    cell); a request finding nothing gets one 404 row."""
    r = _first_of_key(requests.select("seq", "order_id"), "order_id", "seq", "_first")
    held = cells.filter(F.col("filled") & F.col("order_id").isNotNull()).select(
        F.col("order_id").alias("_holder"), "x", "y", "color")
    # one join answers both: later requests of an order match nothing
    d = r.join(held, F.col("_first") & (F.col("order_id") == F.col("_holder")), "left")
    miss = F.col("_holder").isNull()
    return d.select(
        "seq", "order_id", F.when(miss, 404).otherwise(200).alias("status"), "x", "y", "color",
        F.when(miss, F.concat(F.lit("No reserved blocks found for order '"), F.col("order_id"), F.lit("'"))).alias("message"))


def restore_order(requests: DataFrame, cells: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Restore per order: held cells are freed and fetched cells come back
    unreserved; the message counts them. Only the first request of an order
    finds anything; the rest (and orders with nothing) get 404."""
    r = _first_of_key(requests.select("seq", "order_id"), "order_id", "seq", "_first")
    held = cells.filter(F.col("filled") & F.col("order_id").isNotNull()).select("order_id")
    back = held.unionByName(fetch_log.select("order_id"))
    n = back.groupBy("order_id").agg(F.count(F.lit(1)).alias("restored"))
    d = r.join(n, "order_id", "left")
    found = F.col("_first") & F.col("restored").isNotNull()
    return d.select(
        "seq", "order_id",
        F.when(found, 200).otherwise(404).alias("status"),
        F.when(found, F.col("restored")).otherwise(F.lit(0)).cast("long").alias("restored"),
        F.when(found, F.concat(F.lit("Restored "), F.col("restored").cast("string"),
                               F.lit(" block(s) for order '"), F.col("order_id"), F.lit("'")))
         .otherwise(F.concat(F.lit("No blocks found for order '"), F.col("order_id"), F.lit("'")))
         .alias("message"))


def restore_all(cells: DataFrame) -> DataFrame:
    """Default grid over the same cells: every cell filled with its column's
    colour, unreserved; the fetch log is cleared."""
    colour = F.element_at(F.array(*[F.lit(c) for c in K.ORDER_COLOURS]), (F.col("y") % 4 + 1).cast("int"))
    return cells.select("x", "y", colour.alias("color"), F.lit(True).alias("filled"),
                        F.lit(False).alias("reserved"), F.lit(None).cast("string").alias("order_id"))
