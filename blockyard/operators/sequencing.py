"""Skew-safe running aggregates and row numbers.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to
one task. With few keys (four topic partitions, four colours) or one hot key
holding a third of the data, that task is the whole job. The helpers here
cut each key into ordered *chunks* (a monotone bucket of the ordering, e.g.
``event_id div 2^20``):

1. per ``(key, chunk)`` totals — a partial (map-side) aggregation whose
   output is tiny (keys x chunks),
2. an exclusive prefix over the chunk totals of each key (window on the
   small table),
3. the within-chunk running value — a window partitioned by
   ``(key, chunk)``, so one hot key is spread over many tasks,
4. combine: ``prefix (+ or max) within``.

Steps 1 and 3 each read the input (1 only its key, chunk and value
columns, pre-aggregated map-side); for an expensive input, pass
``stage=True`` to write it once to the checkpoint folder. The join in 4 is
an equi-join on ``(key, chunk)`` against the small table;
AQE turns it into a broadcast at run time when the measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and keeps the shuffle join beyond.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1 << 20
_CHUNK = "_by_chunk"
_BASE = "_by_base"
_TOT = "_by_tot"


def _as_cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def chunk_of(col: str | Column, width: int = DEFAULT_WIDTH) -> Column:
    """Monotone chunk id of a numeric ordering column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(width)).cast("long")


def running_many(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
                 specs: Sequence[tuple], chunk: Column | None = None, stage: bool = False) -> DataFrame:
    """Several running aggregates over the same key and order in one pass.

    ``specs``: ``(value, out, how)`` or ``(value, out, how, inclusive)``;
    ``how`` is ``sum`` / ``max`` / ``min``, ``last`` (latest non-null value)
    or ``prev`` (the previous row's value, nulls included; ``inclusive`` is
    ignored). ``last`` and ``prev`` rank rows by the first ``order`` column,
    which must be numeric and unique within the key.

    Plan: chunk totals by a partial (map-side) hash aggregation of the
    input (fixed-width buffers only: ``max_by`` for last/prev); an
    exclusive prefix over the small totals table; the within-chunk running
    values by a window partitioned by ``(key, chunk)``; an equi-join on
    ``(key, chunk)`` adds the prefix. When none of the outputs is used,
    Catalyst prunes the window and eliminates the join.

    ``stage=True`` first writes the input to the shared checkpoint folder
    (a lineage cut): use it when the input is itself the output of earlier
    passes, so the two branches scan a file instead of recomputing (and
    compounding) the upstream plan."""
    aggs = {"sum": F.sum, "max": F.max, "min": F.min}
    if stage:
        from blockyard.session import materialize
        df = materialize(df, "running-input")
    by = list(by)
    order_cols = _as_cols(order)
    rank = order_cols[0]
    if chunk is None:
        chunk = F.lit(0).cast("long")
    keys = by + [_CHUNK]
    d = df.withColumn(_CHUNK, chunk)
    norm = [(v, o, h, (rest[0] if rest else True)) for v, o, h, *rest in specs]

    def total(v, how):
        if how == "last":
            return F.max_by(v, F.when(v.isNotNull(), rank))
        if how == "prev":
            return F.max_by(v, rank)
        return aggs[how](v)

    totals = d.groupBy(*keys).agg(*[total(v, h).alias(f"{_TOT}{i}") for i, (v, _, h, _) in enumerate(norm)])
    wb = Window.partitionBy(*by).orderBy(_CHUNK)
    wb_ex = wb.rowsBetween(Window.unboundedPreceding, -1)

    def base(i, how):
        t = F.col(f"{_TOT}{i}")
        if how == "last":
            return F.last(t, ignorenulls=True).over(wb_ex)
        if how == "prev":
            return F.lag(t, 1).over(wb)
        return aggs[how](t).over(wb_ex)

    bases = totals.select(*keys, *[base(i, h).alias(f"{_BASE}{i}") for i, (_, _, h, _) in enumerate(norm)])

    wo = Window.partitionBy(*keys).orderBy(*order_cols)
    wi_in = wo.rowsBetween(Window.unboundedPreceding, 0)
    wi_ex = wo.rowsBetween(Window.unboundedPreceding, -1)
    wcols = []
    need_first = any(h == "prev" for _, _, h, _ in norm)
    for i, (v, _, how, inclusive) in enumerate(norm):
        frame = wi_in if inclusive else wi_ex
        if how == "last":
            wcols.append(F.last(v, ignorenulls=True).over(frame).alias(f"_wi{i}"))
        elif how == "prev":
            wcols.append(F.lag(v, 1).over(wo).alias(f"_wi{i}"))
        else:
            wcols.append(aggs[how](v).over(frame).alias(f"_wi{i}"))
    if need_first:
        wcols.append(F.lag(rank, 1).over(wo).isNull().alias("_chunk_first"))
    w = d.select("*", *wcols)
    j = w.join(bases, keys, "left")
    outs = []
    for i, (v, out, how, inclusive) in enumerate(norm):
        within = F.col(f"_wi{i}")
        b = F.col(f"{_BASE}{i}")
        if how == "sum":
            # SQL semantics: a sum over no non-null value is null
            combined = F.when(b.isNull() & within.isNull(), F.lit(None)).otherwise(
                F.coalesce(b, F.lit(0)) + F.coalesce(within, F.lit(0)))
        elif how == "max":
            combined = F.greatest(b, within)
        elif how == "min":
            combined = F.least(b, within)
        elif how == "last":
            combined = F.coalesce(within, b)
        else:
            combined = F.when(F.col("_chunk_first"), b).otherwise(within)
        outs.append(combined.alias(out))
    drop = [f"{_BASE}{i}" for i in range(len(norm))] + [f"_wi{i}" for i in range(len(norm))] + [_CHUNK]
    if need_first:
        drop.append("_chunk_first")
    return j.select("*", *outs).drop(*drop)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
            value: Column, out: str, how: str = "sum",
            chunk: Column | None = None, inclusive: bool = True) -> DataFrame:
    """Add ``out`` = running ``how`` of ``value`` over rows of the same ``by``
    key ordered by ``order`` (must be unique within the key).

    ``how``: ``sum``, ``max``, ``min``. ``inclusive=False`` excludes the
    current row. ``chunk`` must be non-decreasing in ``order`` (defaults to
    one chunk per key, i.e. a plain window)."""
    return running_many(df, by, order, [(value, out, how, inclusive)], chunk)


def row_number(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
               out: str, chunk: Column | None = None) -> DataFrame:
    """1-based row number within ``by`` ordered by ``order`` (unique)."""
    return running(df, by, order, F.lit(1).cast("long"), out, "sum", chunk)


def last_spec(rank: Column, value: Column, out: str, inclusive: bool = True) -> tuple:
    """Spec for :func:`running_many`: running "last non-null" of ``value``
    (rows ranked by the first order column; ``rank`` is kept for callers
    and must be that column)."""
    return (value, out, "last", inclusive)
