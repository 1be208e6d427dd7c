"""Replay of cell ledgers by pointer doubling.

A cell is free, held by an order, or emptied and logged by one. An action that
takes effect decides which action of the cell can take effect next:

* a reserve of an order: the next fetch or restore of that order,
* a fetch: the next restore of that order,
* a restore: the next reserve, of whichever order.

So every action has one successor, known without replaying anything, and a
cell's final state is that of the last action on the path from its first
reserve. The paths are followed by doubling: each action points to its
successor, then to the successor's successor, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockyard.operators.sequencing import running_many
from blockyard.session import discard, materialize

LEDGER_CHUNK = 1 << 20


def ledger_replay(ledger: DataFrame, chunk_width: int = LEDGER_CHUNK) -> DataFrame:
    """Cell state from an action log ``(seq, cell, x, y, color, action,
    order_id)``; ``action = 'restore_all'`` rows (cell null) reset the grid.

    Only actions after the last ``restore_all`` matter (a global max as a
    scalar subquery). Successors come from running minima over the reversed
    order, in chunks of ``seq``, so neither a hot cell nor a hot order of a
    cell sits in one task. The doubling takes about log2(longest path) rounds
    of one equi-join of narrow rows, each written to the checkpoint folder;
    paths that have ended leave the joined side. Cells without live actions
    keep the default state. Actions without an order, and unknown actions,
    change nothing."""
    # the cut is a scalar subquery: computed once, inlined as a value (no join)
    cut = (ledger.filter(F.col("action") == "restore_all")
           .agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_cut")).scalar())
    acts = ledger.filter(F.col("action") != "restore_all")
    cells = acts.select("cell", "x", "y", "color").distinct()
    live = acts.filter((F.col("seq") > cut) & F.col("order_id").isNotNull()
                       & F.col("action").isin("reserve", "fetch", "restore"))
    live = materialize(live.select("seq", "cell", "order_id", "action"), "ledger-live")

    # the next action of a kind is the least seq among the later ones
    back, a, seq = -F.col("seq"), F.col("action"), F.col("seq")
    chunk = F.floor(back / F.lit(chunk_width)).cast("long")
    own = running_many(live, ["cell", "order_id"], [back],
                       [(F.when(a != "reserve", seq), "_end", "min", False),
                        (F.when(a == "restore", seq), "_back", "min", False)], chunk)
    both = running_many(own, ["cell"], [back], [(F.when(a == "reserve", seq), "_taken", "min", False)], chunk, stage=True)
    succ = F.when(a == "reserve", F.col("_end")).when(a == "fetch", F.col("_back")).otherwise(F.col("_taken"))
    jumps = [materialize(both.select("seq", succ.alias("to")).filter(F.col("to").isNotNull()), "ledger-jump")]
    while True:  # jumps[k]: actions with 2^k steps ahead of them at least, and where these lead
        far = jumps[-1].select(F.col("seq").alias("to"), F.col("to").alias("_far"))
        longer = materialize(jumps[-1].join(far, "to").select("seq", F.col("_far").alias("to")), "ledger-jump")
        if longer.isEmpty():
            break
        jumps.append(longer)
    # one start per cell takes each jump that is left, the longest first
    at = live.filter(a == "reserve").groupBy("cell").agg(F.min("seq").alias("at"))
    for jump in reversed(jumps):
        at = materialize(at.join(jump.withColumnRenamed("seq", "at"), "at", "left")
                         .select("cell", F.coalesce("to", "at").alias("at")), "ledger-at")
    for done in [*jumps, longer]:
        discard(done)
    final = live.join(at.select(F.col("at").alias("seq")), "seq").select("cell", "action", F.col("order_id").alias("_order"))
    k, o = F.col("action"), F.col("_order")
    return cells.join(final, "cell", "left").select(
        "cell", "x", "y", "color",
        F.coalesce(k != "fetch", F.lit(True)).alias("filled"),
        F.coalesce(k == "reserve", F.lit(False)).alias("reserved"),
        F.when(k == "reserve", o).alias("order_id"),
        F.when(k == "fetch", o).alias("logged_by"))
