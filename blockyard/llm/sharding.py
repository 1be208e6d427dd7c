"""Sharding by jump consistent hashing (Lamping and Veach, 2014), with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockyard.llm.common import running_totals

# fixed values: the multiplier of the published 64-bit generator (its increment is 1), as 32-bit halves; the low
# half again as 16-bit halves, so that no product leaves the signed 64-bit range
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_LOW1, _LOW0 = _LOW >> 16, _LOW & 0xFFFF
_M32 = 0xFFFFFFFF


def _times(x: Column, high16: int, low16: int) -> Column:
    """x (32 bits) times a 32-bit constant, modulo a multiple of 2**32, without overflow."""
    return x * F.lit(low16) + F.shiftleft((x * F.lit(high16)).bitwiseAND(F.lit(0xFFFF)), 16)


def _jump(state: Column, shards: int) -> Column:
    """One jump: the generator's next state, then the next shard count at which the key moves."""
    hi, lo = state["hi"], state["lo"]
    top = lo * F.lit(_LOW1)
    low = lo * F.lit(_LOW0) + F.shiftleft(top.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    high = (F.shiftright(top, 16) + F.shiftright(low, 32) + (lo * F.lit(_HIGH)).bitwiseAND(F.lit(_M32))
            + _times(hi, _LOW1, _LOW0)).bitwiseAND(F.lit(_M32))
    ahead = F.floor((state["next"] + 1) * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1)))
    moved = F.struct(high.alias("hi"), low.bitwiseAND(F.lit(_M32)).alias("lo"), state["next"].alias("at"),
                     ahead.cast("long").alias("next"))
    return F.when(state["next"] >= shards, state).otherwise(moved)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard (int, 0 to shards - 1) of a 64-bit key; a null key counts as key 0.

    Going from n to n + 1 shards moves a key only into the new shard. The walk ends after about ln(shards) jumps
    and after `shards` jumps at most: all keys walk the usual length, and only keys still under way go on."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(_M32)).alias("hi"),
                     key.bitwiseAND(F.lit(_M32)).alias("lo"), F.lit(-1).cast("long").alias("at"),
                     F.lit(0).cast("long").alias("next"))
    usual = min(shards, 32 + 4 * math.ceil(math.log2(shards + 1)))
    walk = lambda begin, steps: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, lambda s, _: _jump(s, shards))
    end = walk(start, usual)
    if usual < shards:
        end = F.when(end["next"] >= shards, end).otherwise(walk(end, shards - usual))
    return end["at"].cast("int")


def assign_shards(df: DataFrame, key: str, shards: int, column: str = "shard") -> DataFrame:
    """Adds the shard of each row's integer key. A projection: no shuffle, all rows and columns kept. Null keys form
    one key (0); equal keys share a shard; an empty table stays empty. An existing column of that name is replaced."""
    return df.withColumn(column, jump_hash(F.col(key), shards))


def number_slots(df: DataFrame, key: str, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Adds the row's place in its shard: 0, 1, ... without gaps, in a fixed pseudo-random order of the keys (repeated
    keys next to each other). Shards are numbered in chunks, so a shard needs no task of its own.

    Rows with a null key or shard are numbered like others (null is a shard of its own); rows of one key are ordered by
    their other columns, which must be of types that Spark can order (no maps), and equal rows in any way, which gives
    the same result; an existing column named `slot` is replaced; an empty table stays empty."""
    keep = [c for c in df.columns if c != slot]
    rest = [c for c in keep if c not in (key, shard)]
    packed = df.select(F.col(shard).alias("_shard"), F.col(key).alias("_key"), F.struct(*[df[c] for c in rest]).alias("_row"),
                       F.xxhash64(key).alias("_h"), F.lit(1).cast("long").alias("_one"))
    out = running_totals(packed, ["_shard"], "_h", ["_key", "_row"], "_one", df.count())
    return out.select(F.col("_key").alias(key), *[F.col("_row")[c].alias(c) for c in rest], F.col("_shard").alias(shard),
                      F.col("_rank").alias(slot))
