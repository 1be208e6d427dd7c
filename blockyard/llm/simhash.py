"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh, 2016)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockyard.llm.common import ascii_lower, components, words
from blockyard.session import materialize

BITS = 64
#: Distinct fingerprints of one bucket that are compared in one piece; larger buckets are dealt out as pairs of pieces.
PIECE = 4096


def shingle_hashes(text: Column, width: int) -> DataFrame:
    """XXH64 (seed 42) of each run of `width` words, repeats included; of the whole sequence if it is shorter; none
    if the text has no word. Words are lower-cased (A-Z) and joined by single spaces."""
    w = words(ascii_lower(text))
    join = lambda a, i: F.concat_ws(" ", *[F.get(a, i + k) for k in range(width)])
    one = F.transform(F.array(w), lambda a: F.when(F.size(a) == 0, F.expr("cast(array() as array<bigint>)"))
                      .when(F.size(a) < width, F.array(F.xxhash64(F.concat_ws(" ", a))))
                      .otherwise(F.transform(F.sequence(F.lit(0), F.size(a) - width), lambda i: F.xxhash64(join(a, i)))))
    return one[0]


def _majority(hashes: pa.Array) -> pa.Array:
    """Per list of hashes, the 64-bit number of the bits set in over half of them; 0 for an empty list."""
    hashes = hashes.combine_chunks() if isinstance(hashes, pa.ChunkedArray) else hashes
    ends = hashes.offsets.to_numpy()
    flat = hashes.values.to_numpy(zero_copy_only=False)
    out = np.zeros(len(hashes), np.uint64)
    powers = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    for i in range(len(hashes)):
        a, b = int(ends[i]), int(ends[i + 1])
        counts = np.zeros(BITS, np.int64)
        for at in range(a, b, 1 << 16):  # long texts in pieces
            part = np.ascontiguousarray(flat[at:min(b, at + (1 << 16))]).view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = powers[2 * counts > b - a].sum(dtype=np.uint64)
    return pa.array(out.view(np.int64))


def fingerprints(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, fingerprint): the SimHash of each text as a signed 64-bit number; 0 for a null, empty or wordless text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _majority(batch.column(1))], ["key", "fingerprint"])
    hashed = df.select(F.col(key).alias("key"), shingle_hashes(F.col(text), width).alias("h"))
    return hashed.mapInArrow(run, f"key {hashed.schema['key'].dataType.simpleString()}, fingerprint bigint")


def covering_masks(radius: int, bits: int = BITS, seed: int = 1) -> list[int]:
    """2**(radius + 1) - 1 bit masks such that any `radius` bit positions lie outside one of them at least.

    Each position gets a vector over GF(2) of radius + 1 bits; mask v holds the positions whose vector has an odd
    product with v. The vectors of `radius` positions span less than the whole space, so some nonzero v is orthogonal
    to all of them and mask v avoids them. This holds for any choice of vectors; nonzero ones dealt evenly balance the
    masks."""
    span = 1 << (radius + 1)
    vectors = np.resize(np.arange(1, span), bits)
    np.random.default_rng(seed).shuffle(vectors)
    return [sum(1 << i for i in range(bits) if bin(int(vectors[i]) & v).count("1") % 2) for v in range(1, span)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _stars(keys: np.ndarray, part: np.ndarray, value: np.ndarray, radius: int) -> tuple[list, list]:
    """Links among rows sorted by (key): two lists of values, a spanning forest's worth for large buckets.

    Small buckets are compared row against the s-th next row, for all buckets at once; larger ones by _forest."""
    a, b = [], []
    n = len(keys)
    if n < 2:
        return a, b
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, n])
    size_of = np.repeat(sizes, sizes)
    small = size_of <= 32
    for s in range(1, 32):
        at = np.flatnonzero(small[:-s] & (keys[:-s] == keys[s:])) if n > s else np.array([], int)
        if not len(at):
            break
        hit = at[(np.bitwise_count(value[at] ^ value[at + s]) <= radius)]
        a.append(value[hit]), b.append(value[hit + s])
    for g in np.flatnonzero(sizes > 32):
        rows = slice(starts[g], starts[g] + sizes[g])
        own, which = value[rows], part[rows]
        linked = _forest(own, which, radius)
        a.append(own[linked[0]]), b.append(own[linked[1]])
    return a, b


def _forest(x: np.ndarray, which: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect all rows within `radius` of each other (of two pieces, only across them): a search
    from row to row, in which each row is compared once with all rows not reached yet."""
    across = which.min() != which.max()
    waiting, left, right = np.arange(len(x)), [], []
    while len(waiting):
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            i = queue.pop()
            near = np.bitwise_count(x[i] ^ x[waiting]) <= radius
            if across:
                near &= which[waiting] != which[i]
            hit = waiting[near]
            if len(hit):
                left.append(np.full(len(hit), i)), right.append(hit)
                waiting = waiting[~near]
                queue.extend(hit)
    none = [np.array([], int)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last bucket may go on in the next batch
        def out(t):
            key = np.stack([t["mask"].to_numpy(), t["bucket"].to_numpy(), t["lo"].to_numpy(), t["hi"].to_numpy()])
            new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]
            a, b = _stars(np.cumsum(new), t["part"].to_numpy(), t["fp"].to_numpy().view(np.uint64), radius)
            if a and sum(map(len, a)):
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (a, b)], ["a", "b"])
            return None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
            if not t.num_rows:
                continue
            key = [t[c].to_numpy() for c in ("mask", "bucket", "lo", "hi")]
            last = np.logical_and.reduce([k == k[-1] for k in key])
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            held = t.slice(cut)
            if cut and (r := out(t.slice(0, cut))) is not None:
                yield r
        if held is not None and (r := out(held)) is not None:
            yield r
    return run


def near_links(fps: DataFrame, radius: int, piece: int = PIECE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column `fp`) that differ in at most `radius` bits: enough of them to
    connect all that are within the radius.

    Every such pair shares a bucket of some mask, so nothing is missed. Buckets above `piece` fingerprints are dealt
    out as pairs of pieces to several tasks; rows of a pair of pieces meet in one task, which holds two pieces."""
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bucket"))
                                 for i, m in enumerate(covering_masks(radius))]))
    rows = materialize(fps.select("fp", tables.alias("t")).select("fp", "t.mask", "t.bucket"), "simhash-tables")
    full = materialize(rows.groupBy("mask", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    pieces = F.ceil(F.col("n") / piece).cast("int")
    rows = rows.join(full, ["mask", "bucket"]).withColumn("s", pieces) \
        .withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("s")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1))) \
        .select("mask", "bucket", F.least("part", "o").alias("lo"), F.greatest("part", "o").alias("hi"), "part", "fp")
    met = rows.repartition("mask", "bucket", "lo", "hi").sortWithinPartitions("mask", "bucket", "lo", "hi", "fp")
    return met.mapInArrow(_link(radius), "a bigint, b bigint")


def simhash_components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(key, fingerprint (signed), component_id): documents whose fingerprints differ in at most `radius` bits are
    linked; component_id is the smallest key reachable over links.

    Null, empty and wordless texts share fingerprint 0, which links like any other. Repeated rows each give a row. Rows
    with a null key join a component but do not name it unless all its keys are null. An empty table gives no rows.
    Equal fingerprints are one node, so a large group of copies costs one row in the search."""
    prints = materialize(fingerprints(df, key, text, width), "simhash")
    nodes = materialize(prints.groupBy("fingerprint").agg(F.min("key").alias("least")).withColumnRenamed("fingerprint", "fp"), "simhash-fps")
    graph = components(near_links(nodes.select("fp"), radius))
    named = nodes.join(graph, nodes.fp == graph.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "simhash-roots")
    smallest = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    label = materialize(named.join(smallest, "root").select(F.col("fp").alias("fingerprint"), "component_id"), "simhash-labels")
    return prints.join(label, "fingerprint").select("key", "fingerprint", "component_id")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """df's rows of which one per component stays: the one with the smallest key (all rows of that key, if repeated).

    Null, empty and wordless texts form one component. A row with a null key stays only if its component has no other
    key. Rows whose key is repeated with texts of several components stay together, if one of them is the first of its
    component. Other columns, whatever their names, are passed through; an empty table gives no rows. The keys that go
    are few against those that stay, so these are what the rows are joined with."""
    found = simhash_components(df, key, text, width, radius)
    gone = found.groupBy("key").agg(F.max(F.col("key").eqNullSafe(F.col("component_id"))).alias("_first")).where("not _first")
    gone = materialize(gone.select(F.col("key").alias("_key")), "simhash-gone")
    return df.join(gone, df[key].eqNullSafe(gone["_key"]), "left_anti")
