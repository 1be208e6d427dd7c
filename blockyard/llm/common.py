"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockyard.session import materialize, prepare, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one window task numbers on average (see running_totals).
ROWS_PER_CHUNK = 1 << 13


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared checkpoint location."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only (a text without other than ASCII characters may take the faster lower())."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column, pattern: str = WORD) -> Column:
    """Array of a text's words; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def null_safe(col: Column) -> Column:
    """A never-null string key that keeps null apart from every value."""
    return F.when(col.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), col.cast("string")))


def chunk_bits(rows: int) -> int:
    return max(1, math.ceil(math.log2(max(2, rows / ROWS_PER_CHUNK))))


def chunk_starts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, _chunk, _n0, _s0, _s): rows and sum of `value` in the group's earlier chunks, and the chunk's own sum."""
    totals = df.groupBy(*group, "_chunk").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
                         F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"), "_s")


def running_totals(df: DataFrame, group: Sequence[str], hash_col: str, order: Sequence[str], value: str,
                   rows: int) -> DataFrame:
    """Adds `_rank` (0, 1, ... within the group) and `_before` (sum of `value` over the group's earlier rows), in
    the order of (hash_col unsigned, order).

    A group may hold any share of the rows: the top bits of the 64-bit hash cut it into chunks of about
    ROWS_PER_CHUNK rows. Chunk totals are a partial aggregation, their running sums a window over the small chunk
    table, and rows are numbered inside their chunk only."""
    chunk = F.shiftrightunsigned(F.col(hash_col), 64 - chunk_bits(rows))
    # the sign bit is flipped, so that the signed order of `_u` is the unsigned order of the hash
    df = df.withColumn("_chunk", chunk).withColumn("_u", F.col(hash_col).bitwiseXOR(F.lit(-(1 << 63))))
    starts = chunk_starts(df, group, value)
    inside = Window.partitionBy(*group, "_chunk").orderBy("_u", *order)
    numbered = df.withColumn("_i", F.row_number().over(inside) - 1) \
        .withColumn("_p", F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.join(starts, [*group, "_chunk"]) \
        .withColumn("_rank", (F.col("_n0") + F.col("_i")).cast("long")) \
        .withColumn("_before", F.col("_s0") + F.col("_p")) \
        .drop("_chunk", "_u", "_i", "_p", "_n0", "_s0", "_s")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node of the component; only
    nodes with an edge to another node are returned.

    Labels start as the smallest neighbour. Each round takes the smallest label among the neighbours, hooks the old
    label to the new one, and jumps to the label's label, so paths halve and the rounds grow with the logarithm of
    the longest path. Each round is written to the shared checkpoint folder; nothing is collected. Hot nodes: both
    inputs of each join are plain scans, which adaptive execution can split, and the minima are partial
    aggregations."""
    both = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialize(both.union(both.select("v", "u")).distinct(), "cc-edges")
    label = materialize(both.groupBy("u").agg(F.min("v").alias("m"))
                        .select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "cc-labels")
    while True:
        seen = both.join(label, both.v == label.node).groupBy("u").agg(F.min("root").alias("m"))
        step = label.join(seen, label.node == seen.u).select("node", "root", F.least("root", "m").alias("new"))
        hooked = materialize(step.select("node", "new").union(step.select(F.col("root").alias("node"), "new"))
                             .groupBy("node").agg(F.min("new").alias("new")), "cc-hooked")
        up = hooked.select(F.col("node").alias("p"), F.col("new").alias("up"))
        jumped = hooked.join(up, F.col("new") == F.col("p")).select("node", F.col("up").alias("root"))
        old = label.withColumnRenamed("root", "old")
        label = materialize(jumped.join(old, "node").select("node", "root", F.col("root") != F.col("old")), "cc-labels")
        moved = label.columns[-1]
        done = label.where(F.col(f"`{moved}`")).isEmpty()
        label = label.select("node", "root")
        if done:
            return label
