"""Mixing sources to target weights by a time-varying curriculum, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockyard.llm.common import null_safe, running_totals, words
from blockyard.session import materialize

#: Weight schedules over training time 0 to 1 as (time, weight) knots, linear in between. Their integrals are the
#: overall weights 3, 1 and 2; sources take them in turn, in code point order, null last.
SCHEDULES = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)))
#: Rows of a source that are switched at most, one after another, each to come nearer to its target.
SWITCHES = 16


def integral(knots: Sequence[tuple[float, float]]) -> list[float]:
    """Integral of the schedule up to each knot."""
    areas = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        areas.append(areas[-1] + (t1 - t0) * (w0 + w1) / 2)
    return areas


def time_of(share: Column, turn: Column, schedules: Sequence) -> Column:
    """Training time at which a source has been asked for `share` (0 to 1) of its target: the inverse of the
    normalised integral of its schedule, a root of a quadratic in each segment."""
    out = F.lit(1.0)
    for i, knots in reversed(list(enumerate(schedules))):
        areas = integral(knots)
        inner = F.lit(float(knots[-1][0]))
        for k in reversed(range(len(knots) - 1)):
            (t0, w0), (t1, w1) = knots[k], knots[k + 1]
            if areas[k + 1] <= areas[k]:
                continue
            y = F.greatest(share * F.lit(areas[-1]) - F.lit(areas[k]), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / (t1 - t0)) * y, F.lit(0.0)))
            x = F.when(y <= 0, F.lit(0.0)).otherwise(2 * y / (F.lit(w0) + root))
            inner = F.when(share * F.lit(areas[-1]) <= F.lit(areas[k + 1]), F.lit(t0) + x).otherwise(inner)
        out = F.when(turn == i, inner).otherwise(out)
    return out


def source_targets(sizes: DataFrame, schedules: Sequence, budget: float, most: float) -> DataFrame:
    """One row per source: `_g`, source, source_size, turn, weight, target.

    Targets share `budget` times all sizes by weight; a source stops at `most` times its size and the excess goes
    to the others by weight, until none is above. That level is closed-form: with the sources ordered by cap over
    weight, it is the largest level that capping any prefix of them would give. The windows below hold one row per
    source (a bounded dimension), not rows of documents."""
    weights = F.array(*[F.lit(float(integral(s)[-1])) for s in schedules])
    by_source = sizes.groupBy("_g", "source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(schedules)
    t = by_source.withColumn("turn", turn.cast("int")).withColumn("weight", F.element_at(weights, F.col("turn") + 1))
    everything = Window.partitionBy()
    t = t.withColumn("_cap", F.col("source_size") * F.lit(float(most))) \
        .withColumn("_ask", F.sum("source_size").over(everything) * F.lit(float(budget)))
    upto = Window.orderBy(F.when(F.col("weight") > 0, F.col("_cap") / F.col("weight")).otherwise(F.lit(float("inf"))), "_g") \
        .rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    level = F.when(left > 1e-9, (F.col("_ask") - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / left)
    t = t.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
    return t.withColumn("target", F.least("_cap", F.greatest(F.col("_level") * F.col("weight"), F.lit(0.0)))) \
        .drop("_cap", "_ask", "_level")


MADE = ["size", "source_size", "target", "taken", "positions"]


def mixing_plan(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
                schedules: Sequence = SCHEDULES, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Decides how often and when each row is read in training; returns df's columns plus `size` (words), source_size,
    target (both of the row's source), taken (words) and positions (array of training times, one per reading).

    Each source is read in passes over a fixed pseudo-random order of its rows: the whole passes that fit its target,
    then a last partial pass that tries every row in that order and takes it if it fits what is left of the target.
    While switching one row, of all the source's rows, brings the words taken nearer to the target, the best such row
    is switched (SWITCHES times at most), which matters where a source is small or a row is large. A reading that starts after a share u of its
    source's target is placed where the integrated weight schedule reaches u; the words before it are counted exactly,
    in the partial pass over the rows that this pass takes.

    Null or empty texts have size 0 and are read without effect; null is a source of its own, last; of rows that are equal
    in key, text and source the last pass takes as many as fit, and each pass reads them at the place of the first; a source or table without words gets target 0;
    columns of df named like a result are replaced. A source may hold any share of the rows: sums are partial
    aggregations, and running totals go by chunks of the order. All is decided on a narrow table without texts, which
    is joined to the rows (mixed_rows sorts them without that join)."""
    keep = [c for c in df.columns if c not in MADE]
    base, units, state = _planned(df, keep, text, source, key, schedules, budget, most)
    whole, some = _copies_apart(base, units, state)
    names = ["_g", "_id"]
    out = whole.select("_row", *names).join(units.select(*names, *MADE), names)
    if some is not None:
        out = whole.select("_row", *names).join(units.where("not _partial").select(*names, *MADE), names) \
            .unionByName(some.select("_row", *names, "_more").join(units.where("_partial").select(*names, "_more", *MADE), [*names, "_more"]).drop("_more"))
    return out.select(*[F.col("_row")[c].alias(c) for c in keep], *MADE)


def mixed_rows(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
               schedules: Sequence = SCHEDULES, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """The readings of mixing_plan in training order: df's columns and `position`, range-sorted by position and key. Nulls,
    empty texts, repeated rows and clashing names are as there; rows that are not read are left out; an empty table gives
    no rows.

    Texts are shuffled once. The places of a source's readings rise along the order of each of its passes, so where the
    ranges of the sort begin in that order is a small table, by which a row finds its range; there it meets the
    exact place of its reading, which comes from the narrow table."""
    keep = [c for c in df.columns if c != "position"]
    base, units, state = _planned(df, keep, text, source, key, schedules, budget, most)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = units.where("_more or not _partial").select("_g", "_id", F.posexplode("positions").alias("_pass", "position"))
    steps = F.array(*[F.lit(k / ranges) for k in range(1, ranges)] or [F.lit(0.5)])
    bounds = places.agg(F.percentile_approx("position", steps)).scalar()  # one row, a value in the plan
    places = materialize(places.withColumn("_bounds", bounds).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("position"))))
                         .drop("_bounds"), "mix-places")
    begins = places.groupBy("_g", "_pass", "_range").agg(F.min("_id").alias("first")) \
        .groupBy("_g", "_pass").agg(F.collect_list(F.struct("_range", "first")).alias("begins")) \
        .groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_pass", "begins"))).alias("begins"))
    state = materialize(state.join(begins, "_g"), "mix-ranges")  # sources without a reading are left out
    apart, some = _copies_apart(base, units, state)
    rows = apart.join(state, "_g").withColumn("_copies", F.col("whole") + _chosen().cast("int"))
    if some is not None:
        rows = rows.unionByName(some.join(state, "_g").withColumn("_copies", F.col("whole") + F.col("_more").cast("int")), allowMissingColumns=True)
    rows = rows.where("_copies > 0") \
        .select("_g", "_id", "_row", "begins", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_pass"))
    begun = F.filter(F.element_at("begins", F.col("_pass")), lambda x: x["first"] <= F.col("_id"))
    rows = rows.withColumn("_range", F.array_max(F.transform(begun, lambda x: x["_range"])))
    names = ["_range", "_g", "_id", "_pass"]
    both = rows.select(*names, F.lit(None).cast("double").alias("position"), "_row") \
        .unionByName(places.select(*names, "position"), allowMissingColumns=True)
    met = both.repartitionById(ranges, F.col("_range").cast("int")).withColumn("position", F.max("position").over(Window.partitionBy(*names)))
    return met.where("_row is not null").sortWithinPartitions("position", F.col("_row")[key]) \
        .select(*[F.col("_row")[c].alias(c) for c in keep], "position")


def _planned(df: DataFrame, keep: Sequence[str], text: str, source: str, key: str, schedules, budget, most):
    """(rows of df with `size` and their names, the distinct rows with the results, per-source state)."""
    # the order of a pass: by hash, then by key and content, so reruns agree
    base = df.select(F.struct(*[df[c] for c in keep]).alias("_row")) \
        .withColumn("size", F.size(words(F.col("_row")[text])).cast("long")) \
        .withColumn("_t", F.xxhash64(F.col("_row")[text])).withColumn("_g", null_safe(F.col("_row")[source])) \
        .withColumn("_h", F.xxhash64(F.col("_row")[key], F.col("_t"))) \
        .withColumn("_id", F.struct(F.col("_h").bitwiseXOR(F.lit(-(1 << 63))).alias("u"), F.col("_row")[key].alias("k"), F.col("_t").alias("t")))
    slim = base.select("_g", F.col("_row")[source].alias("source"), "_id", "_h", "size")
    units = materialize(slim.groupBy(*slim.columns).agg(F.count("*").alias("_n")).withColumn("_w", F.col("_n") * F.col("size")), "mix")
    rows = units.count()
    state = _decide(units, rows, schedules, budget, most)

    # words before a row: in a whole pass, and in the partial pass (of the rows that it takes)
    at = units.drop("source").join(state, "_g").withColumn("_m", _taken_copies()).drop("stretches", "part")
    at = running_totals(at, ["_g"], "_h", ["_id"], "_w", rows).drop("_rank").withColumnRenamed("_before", "_all")
    at = at.withColumn("_taken", F.col("_m") * F.col("size"))
    at = running_totals(at, ["_g"], "_h", ["_id"], "_taken", rows)
    # copies of which the partial pass takes some are of two kinds; all others of one
    at = at.withColumn("_partial", (F.col("_m") > 0) & (F.col("_m") < F.col("_n"))) \
        .withColumn("_more", F.explode(F.when(F.col("_partial"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.col("_m") > 0))))
    copies = F.col("whole") + F.col("_more").cast("int")

    def place(j):
        begun = j * F.col("source_size") + F.when(j < F.col("whole"), F.col("_all")).otherwise(F.col("_before"))
        share = F.when(F.col("target") > 0, F.least(begun / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
        return time_of(share, F.col("turn"), schedules)

    readings = F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    at = at.withColumn("taken", (copies * F.col("size")).cast("long")).withColumn("positions", F.transform(readings, place))
    return base, materialize(at.select("_g", "_id", "_more", "_partial", "_m", "_n", *MADE), "mix-plan"), state


def _copies_apart(base: DataFrame, units: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose copies are all read alike, rows of the units of which the partial pass takes some copies, or None if
    there is no such unit). The latter have `_more`: whether the pass takes them.

    Which of equal rows are taken makes no difference, so they are numbered by the partition in which they are found:
    each partition's rows get their share of the number, by the running count over partitions. The rows are written
    first, so that partitions stay the same."""
    names = ["_g", "_id"]
    partial = units.where("_partial and _more").select(*names, "_m", "_n")
    if partial.isEmpty():
        return base, None
    few = materialize(base.join(partial, names).withColumn("_c", F.spark_partition_id()), "mix-copies")
    counts = few.groupBy(*names, "_c", "_m", "_n").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*names).orderBy("_c"))
    share = lambda k: F.floor(F.col("_m") * k / F.col("_n"))
    counts = counts.withColumn("_share", share(upto) - share(upto - F.col("_k"))).select(*names, "_c", "_share")
    number = F.row_number().over(Window.partitionBy(*names, "_c").orderBy(F.lit(0)))
    some = few.join(counts, [*names, "_c"]).withColumn("_more", number <= F.col("_share"))
    return base.join(partial.select(*names), names, "left_anti"), some.select(*base.columns, "_more")


def _chosen() -> Column:
    """Whether a row is in the last, partial pass of its source; of a unit with copies, whether all are."""
    taken = F.exists("stretches", lambda s: (F.col("size") <= s["room"]) & (F.col("_id") <= s["upto"])
                     & F.coalesce(F.col("_id") > s["after"], F.lit(True)))
    listed = F.filter("part", lambda p: p["i"] == F.col("_id"))
    return F.coalesce(F.get(listed, F.lit(0))["m"] > 0, taken)


def _taken_copies() -> Column:
    """How many copies of a unit the partial pass takes."""
    listed = F.filter("part", lambda p: p["i"] == F.col("_id"))
    return F.coalesce(F.get(listed, F.lit(0))["m"], F.when(_chosen(), F.col("_n")).otherwise(F.lit(0))).cast("long")


def _decide(units: DataFrame, rows: int, schedules, budget: float, most: float) -> DataFrame:
    """Per source: `whole` passes, `rest` (words asked of the partial pass), and what the partial pass takes: `stretches`
    of the order (its rows of at most `room` words) and, for the units in `part`, `m` of their copies. `units`: the
    distinct rows, `_n` their copies, `_w` the words of all copies."""
    targets = source_targets(units.select("_g", "source", F.col("_w").alias("size")), schedules, budget, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    kind = units.schema["_id"].dataType.simpleString()
    state = materialize(targets.withColumn("whole", whole.cast("int"))
                        .withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size"), 6))
                        .withColumn("gap", F.col("rest")).withColumn("after", F.expr(f"cast(null as {kind})"))
                        .withColumn("stretches", F.expr(f"cast(array() as array<struct<room:double,after:{kind},upto:{kind}>>)"))
                        .withColumn("part", F.expr(f"cast(array() as array<struct<i:{kind},m:bigint>>)")).drop("source", "weight"), "mix-state")
    # what is left shrinks, so a row that did not fit never will: each stretch starts after the unit that ended the last,
    # of which it takes the copies that fit; then less than one of its size is left
    while True:
        fits = units.join(state.select("_g", "gap", "after"), "_g") \
            .where((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & F.coalesce(F.col("_id") > F.col("after"), F.lit(True)))
        over = F.col("_before") + F.col("_w") > F.col("gap")
        copies = F.floor((F.col("gap") - F.col("_before")) / F.col("size")).cast("long")
        step = running_totals(fits.drop("after", "source"), ["_g"], "_h", ["_id"], "_w", rows).groupBy("_g").agg(
            F.max(F.when(~over, F.col("_id"))).alias("upto"), F.sum(F.when(~over, F.col("_w")).otherwise(0)).alias("got"),
            F.min(F.when(over, F.struct(F.col("_id").alias("i"), copies.alias("m"), "size"))).alias("stop"))
        more = F.array(F.struct(F.col("gap").alias("room"), F.col("after"), F.col("upto")))
        some = F.coalesce(F.col("stop")["m"], F.lit(0))
        state = materialize(state.join(step, "_g", "left").withColumn(
            "stretches", F.when(F.col("upto").isNull(), F.col("stretches")).otherwise(F.concat("stretches", more)))
            .withColumn("part", F.when(some > 0, F.concat("part", F.array(F.struct(F.col("stop")["i"].alias("i"), some.alias("m"))))).otherwise(F.col("part")))
            .withColumn("gap", F.round(F.col("gap") - F.coalesce("got", F.lit(0)) - some * F.coalesce(F.col("stop")["size"], F.lit(0)), 6))
            .withColumn("after", F.coalesce(F.col("stop")["i"], "upto", "after")).withColumn("stop", F.col("stop")["i"]).drop("upto", "got"), "mix-state")
        done = state.where("stop is not null").isEmpty()
        state = state.drop("stop")
        if done:
            break
    for _ in range(SWITCHES):
        def switched(m, left):
            return F.struct(F.abs(left).alias("d"), F.col("_id").alias("i"), m.alias("m"), left.alias("left"))
        near = F.array(F.when(F.col("_m") < F.col("_n"), switched(F.col("_m") + 1, F.round(F.col("gap") - F.col("size"), 6))),
                       F.when(F.col("_m") > 0, switched(F.col("_m") - 1, F.round(F.col("gap") + F.col("size"), 6))))
        best = units.join(state.select("_g", "gap", "rest", "stretches", "part"), "_g").withColumn("_m", _taken_copies()) \
            .where((F.col("rest") > 0) & (F.col("size") > 0)).withColumn("near", F.array_min(F.array_compact(near))) \
            .where(F.col("near")["d"] < F.abs("gap")).groupBy("_g").agg(F.min("near").alias("_pick"))
        best = materialize(best, "mix-switch")
        if best.isEmpty():
            break
        others = F.filter("part", lambda p: p["i"] != F.col("_pick")["i"])
        part = F.concat(others, F.array(F.struct(F.col("_pick")["i"].alias("i"), F.col("_pick")["m"].alias("m"))))
        state = materialize(state.join(best, "_g", "left").withColumn("part", F.when(F.col("_pick").isNull(), F.col("part")).otherwise(part))
                            .withColumn("gap", F.coalesce(F.col("_pick")["left"], F.col("gap"))).drop("_pick"), "mix-state")
    return state.drop("gap", "after")


def in_training_order(plan: DataFrame, tie: str = "doc_id") -> DataFrame:
    """One row per reading: plan's columns but positions, and its `position`; range-sorted by it."""
    keep = [c for c in plan.columns if c not in ("position", "positions")]
    readings = plan.select(F.struct(*[plan[c] for c in keep]).alias("_row"), F.explode("positions").alias("position"))
    return readings.orderBy("position", F.col("_row")[tie]).select(*[F.col("_row")[c].alias(c) for c in keep], "position")
