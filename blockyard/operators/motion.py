"""Robot command lists: state-change filtering, position accumulation,
final positions, assembly pairing, and retries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockyard.functions import assembly_plan
from blockyard.operators.sequencing import chunk_of, running_many

SEQ_CHUNK = 1 << 20


def state_change_only(df: DataFrame, by: Sequence[str], order: str, state: Sequence[str],
                      chunk: F.Column | None = None, stage: bool = False) -> DataFrame:
    """Keep the first row of each key and then only rows whose state
    differs (null-safe) from the previous row's state. ``stage`` writes the
    input once first (use it when the input is itself a running pass)."""
    ch = chunk if chunk is not None else chunk_of(order, SEQ_CHUNK)
    specs = [(F.col(order), "_prev_rank", "prev")] + [(F.col(s), f"_prev_{s}", "prev") for s in state]
    d = running_many(df, list(by), [order], specs, ch, stage=stage)
    same = F.lit(True)
    for s in state:
        same = same & F.col(f"_prev_{s}").eqNullSafe(F.col(s))
    return d.filter(F.col("_prev_rank").isNull() | ~same).drop("_prev_rank", *[f"_prev_{s}" for s in state])


AXES = ("x", "y", "z", "r")


def _absolute() -> F.Column:
    return F.col("kind").isin("MovementCommand", "HomeCommand")


def _target(axis: str) -> F.Column:
    """Where an absolute command puts the axis (null = 0, home = 0)."""
    return F.when(F.col("kind") == "MovementCommand", F.coalesce(F.col(axis), F.lit(0.0))).otherwise(F.lit(0.0))


def _delta(axis: str) -> F.Column:
    return F.when(F.col("kind") == "RelativeMovementCommand", F.coalesce(F.col(axis), F.lit(0.0))).otherwise(F.lit(0.0))


# --- fixed values: a robot's state before any command ----------------------
SPEED_AT_FIRST = 50.0
ACCELERATION_AT_FIRST = 100.0
#: State columns: the kinds of command that set them, the command's field, the value before any.
STATES = {
    "speed": (["MovementSpeedCommand"], "speed", SPEED_AT_FIRST),
    "acceleration": (["MovementSpeedCommand"], "acceleration", ACCELERATION_AT_FIRST),
    "conveyor_speed": (["MoveConveyorCommand", "RunConveyorCommand"], "speed", 0.0),
    "conveyor_distance": (["MoveConveyorCommand"], "distance", 0.0),
    "conveyor_direction": (["MoveConveyorCommand", "RunConveyorCommand"], "direction", None),
}
FIELDS = {"suck": "boolean", "speed": "double", "acceleration": "double", "distance": "double", "direction": "string"}


def trajectory(commands: DataFrame, chunk_width: int = SEQ_CHUNK) -> DataFrame:
    """Position and state after each command: an absolute move sets x, y, z,
    r; a relative move adds (null = 0); ``HomeCommand`` resets to 0; suction,
    speed, acceleration and the conveyor's speed, distance and direction are
    the last set values (an acceleration that is not given stays). Commands
    may lack the columns of FIELDS.

    Absolute commands cut a robot's log into segments. A position is the
    running sum, within its segment only, of the target that began it and the
    deltas since, so rounding errors do not grow with the log. Segment numbers,
    last states and sums are chunked running aggregates: one pass for the
    former, one for the sums."""
    ch = chunk_of("seq", chunk_width)
    given = commands.select("robot", "seq", "kind", *AXES, *[
        (F.col(f) if f in commands.columns else F.lit(None)).cast(t).alias(f) for f, t in FIELDS.items()])
    begins = F.when(_absolute(), F.lit(1)).otherwise(F.lit(0)).cast("long")
    last = [(F.when(F.col("kind").isin(*kinds), F.col(f)), f"_{s}", "last") for s, (kinds, f, _) in STATES.items()]
    d = running_many(given, ["robot"], ["seq"], [(begins, "_segment", "sum"), (F.col("suck"), "_suction", "last"), *last],
                     ch, stage=True)
    steps = [(F.when(_absolute(), _target(a)).otherwise(_delta(a)), f"p{a}", "sum") for a in AXES]
    d = running_many(d.drop(*FIELDS), ["robot", "_segment"], ["seq"], steps, ch, stage=True)
    return d.select("robot", "seq", "kind", *[f"p{a}" for a in AXES], F.coalesce("_suction", F.lit(False)).alias("suction"),
                    *[(F.col(f"_{s}") if first is None else F.coalesce(f"_{s}", F.lit(first))).alias(s)
                      for s, (_, _, first) in STATES.items()])


def final_position(commands: DataFrame) -> DataFrame:
    """Last position per robot, as ``trajectory`` gives it: the last absolute
    command and the sum of the deltas after it. Two partial aggregations."""
    at = F.when(_absolute(), F.col("seq"))
    # one max_by per column: fixed-width buffers keep it a hash aggregation
    last = commands.groupBy("robot").agg(
        F.max("seq").alias("n_commands"), F.max(at).alias("_at"),
        *[F.max_by(_target(a), at).alias(f"_{a}") for a in AXES],
        F.max_by("suck", F.when(F.col("suck").isNotNull(), F.col("seq"))).alias("suction"))
    moves = commands.filter(F.col("kind") == "RelativeMovementCommand").select("robot", "seq", "kind", *AXES)
    since = (moves.join(last.select("robot", "_at"), "robot").filter(F.col("_at").isNull() | (F.col("seq") > F.col("_at")))
             .groupBy("robot").agg(*[F.sum(_delta(a)).alias(f"_d{a}") for a in AXES]))
    zero = F.lit(0.0)
    return last.join(since, "robot", "left").select(
        "robot", "n_commands", *[(F.coalesce(f"_{a}", zero) + F.coalesce(f"_d{a}", zero)).alias(f"p{a}") for a in AXES],
        F.coalesce("suction", F.lit(False)).alias("suction"))


def assembly_zip(positions: DataFrame, orders: DataFrame) -> DataFrame:
    """Pair the i-th fetched block of an order (row-major ``pos``) with the
    i-th assembly position of its item: an equi-join on (order, pos)."""
    plan = orders.select("order_id", "item", F.posexplode(assembly_plan("item")).alias("i", "a"))
    plan = plan.select("order_id", "item", (F.col("i") + 1).alias("pos"),
                       F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("a.z").alias("az"))
    return positions.join(plan, ["order_id", "pos"], "inner")


def retry_attempts(attempts: DataFrame, by: Sequence[str], order: Sequence[str], max_tries: int = 3,
                   technical: str | None = None) -> DataFrame:
    """Number the tries of each (order, activity); keep tries up to the first
    success, the first business refusal or the last allowed try.
    ``retries_left``, ``final`` and ``outcome`` (success / refused / retry /
    error) per kept try. ``technical``: boolean column; a failure that is not
    technical is a refusal, which ends at once (without the column, or where
    it is null, all failures are technical).

    Only the first ``max_tries`` rows of a key matter, and Spark keeps no more
    per task before it shuffles (a window group limit), so a hot key stays small."""
    key = Window.partitionBy(*by)
    refused = ~F.col("success") & ~F.coalesce(F.col(technical), F.lit(True)) if technical else F.lit(False)
    d = attempts.withColumn("_refused", refused)
    d = d.withColumn("attempt", F.row_number().over(key.orderBy(*order))).filter(F.col("attempt") <= max_tries)
    ends = F.col("success") | F.col("_refused")
    d = d.withColumn("_end", F.min(F.when(ends, F.col("attempt"))).over(key))
    d = d.filter(F.col("_end").isNull() | (F.col("attempt") <= F.col("_end")))
    final = ends | (F.col("attempt") == max_tries)
    outcome = (F.when(F.col("success"), "success").when(F.col("_refused"), "refused")
               .when(F.col("attempt") == max_tries, "error").otherwise("retry"))
    return d.select(*by, *[c for c in order if c not in by], F.col("attempt").cast("long").alias("attempt"),
                    (F.lit(max_tries) - F.col("attempt")).cast("long").alias("retries_left"),
                    final.alias("final"), outcome.alias("outcome"), "success")
