"""Embedding near-duplicates: codes by iterative quantisation, multi-index Hamming tables, reranking by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockyard.llm.common import components, materialize

#: Vectors that the rotation is learned from at most, rows of a bucket that are compared in one piece, and rows per bucket
#: aimed at.
FIT_ROWS, PIECE, PER_BUCKET = 10_000, 1024, 128
#: Modelled share of pairs at the threshold that meet in some table (more similar pairs meet more often).
RECALL = 0.95
#: Work of one meeting row in comparisons, for the choice of keys; (key bits, tables, radius) of a length with one vector.
ROW_WORK, ONE_BUCKET = 200, (0, 1, 0)


def usable(v: Column) -> Column:
    """Neither null, nor zero, nor with a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotation(x: np.ndarray, rounds: int = 50, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) for up to 64 bits: the principal directions of unit vectors x, rotated so that the projected
    vectors lie as near as possible to the corners of a cube (Gong and Lazebnik, 2011). Directions without variance,
    as in a sample with few vectors, are kept as they are."""
    mean = x.mean(axis=0)
    bits = min(64, x.shape[1])
    _, vectors = np.linalg.eigh(np.cov((x - mean).T) + 1e-12 * np.eye(x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
    top = vectors[:, ::-1][:, :bits]
    low = (x - mean) @ top
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(low @ r).T @ low)
        r = (u @ vt).T
    return mean, top @ r


def sample_pairs(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray, cosine: float, pairs: int = 4000, seed: int = 4) -> list[np.ndarray]:
    """Which bits differ (pair x bit) in pairs at the threshold: pairs made from sampled unit vectors x by a step of that
    angle, along the difference of two others and in any direction, and those that x has between the threshold and
    half-way to equal, if there are 100. Centring widens angles where the vectors share a large mean, so they
    are measured on the codes."""
    r = np.random.default_rng(seed)
    code = lambda v: (v - mean) @ rotation > 0
    a, c, d = (x[r.integers(0, len(x), pairs)] for _ in range(3))
    out = []
    for step in (c - d, r.normal(size=a.shape)):
        step = step - (step * a).sum(axis=1, keepdims=True) * a
        size = np.linalg.norm(step, axis=1, keepdims=True)
        ok = size[:, 0] > 1e-9
        y = cosine * a[ok] + math.sqrt(max(0.0, 1 - cosine * cosine)) * step[ok] / size[ok]
        out.append(code(a[ok]) != code(y))
    found = []
    for s in range(0, len(x), 512):
        near = x[s:s + 512] @ x.T
        i, j = np.nonzero((near >= cosine) & (near < (1 + cosine) / 2))
        keep = r.permutation(np.flatnonzero(i + s < j))[:pairs // 8]
        found.append(np.stack([i[keep] + s, j[keep]], axis=1))
    i, j = np.concatenate(found).T
    bits = code(x)
    return [g for g in [*out, bits[i] != bits[j]] if len(g) >= 100]


def plan_tables(rows: int, bits: int, cosine: float, sampled: list[np.ndarray] = ()) -> tuple[int, int, int]:
    """(bits of a table's key, tables, radius within a key). Keys grow with the logarithm of the rows at most, so that
    buckets need not grow; the radius is the smallest with which pairs at the threshold meet with probability RECALL, if
    their bits differ independently by their angle and in each of the `sampled` groups of pairs. Of the lengths of a key,
    the one with the least work."""
    longest = max(2, min(bits, math.ceil(math.log2(max(2, rows / PER_BUCKET)))))
    same = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    plans = []
    for b in range(min(longest, bits), 0, -1):
        m = bits // b
        least = [g[:, :b * m].reshape(-1, m, b).sum(axis=2).min(axis=1) for g in sampled]
        for radius in range(b + 1):
            p = sum(math.comb(b, k) * same ** (b - k) * (1 - same) ** k for k in range(radius + 1))
            if 1 - (1 - p) ** m >= RECALL and all((x <= radius).mean() >= RECALL for x in least):
                break
        work = m * sum(math.comb(b, k) for k in range(radius + 1)) * (ROW_WORK + rows / 2 ** b)
        plans.append((work, b, m, radius))
    return min(plans)[1:]


def _near(keys: np.ndarray, b: int, radius: int) -> np.ndarray:
    """The other keys of b bits within the radius of each key."""
    from itertools import combinations
    flips = [sum(1 << i for i in c) for r in range(1, radius + 1) for c in combinations(range(b), r)]
    return keys[:, None] ^ np.array(flips, np.int64)[None, :] if flips else np.zeros((len(keys), 0), np.int64)


def _compare(plans: dict[int, tuple[int, int, int]], cosine: float):
    """Kernel of one bucket (or pair of pieces of it): links that no earlier table has, weighted by copies, and a forest
    of links, as rows (node, links, other)."""
    def met_before(x: np.ndarray, y: np.ndarray, table: int, dim: int) -> np.ndarray:
        b, _, radius = plans.get(dim, ONE_BUCKET)
        out = np.zeros((len(x), len(y)), bool)
        for t in range(table):
            part = np.uint64((1 << b) - 1)
            kx, ky = (x >> np.uint64(b * t)) & part, (y >> np.uint64(b * t)) & part
            out |= np.bitwise_count(kx[:, None] ^ ky[None, :]) <= radius
        return out

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("node")
        node, code = t["node"].to_numpy(), t["code"].to_numpy().view(np.uint64)
        copies, own, part = t["n"].to_numpy(), t["own"].to_numpy(zero_copy_only=False), t["part"].to_numpy()
        dim = t["dim"][0].as_py()
        x = _unit(t["embedding"].combine_chunks().values.to_numpy(zero_copy_only=False), dim)
        table, across = t["table"][0].as_py(), t["lo"][0].as_py() != t["hi"][0].as_py()
        n = len(x)
        linked = np.zeros((n, n), bool)
        links = np.zeros(n, np.int64)
        for s in range(0, n, 256):
            e = min(n, s + 256)
            hit = x[s:e] @ x.T >= cosine
            hit &= np.arange(s, e)[:, None] != np.arange(n)[None, :]
            # members of the bucket with each other; visitors from near buckets with members that have a larger name
            hit &= (own[s:e, None] & own[None, :]) | (own[s:e, None] & (node[None, :] < node[s:e, None])) \
                | (own[None, :] & (node[s:e, None] < node[None, :]) & ~own[s:e, None])
            hit &= own[s:e, None] | own[None, :]
            if across:
                hit &= part[s:e, None] != part[None, :]
            linked[s:e] = hit
            rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
            if len(rows):
                fresh = hit[np.ix_(rows, cols)] & ~met_before(code[s:e][rows], code[cols], table, dim)
                links[s + rows] += fresh @ copies[cols]
        other = np.arange(n)
        waiting = linked.any(axis=1)
        while waiting.any():
            seed = int(np.argmax(waiting))
            reached = np.zeros(n, bool)
            edge = np.array([seed])
            reached[seed] = True
            while len(edge):
                new = linked[edge].any(axis=0) & ~reached
                reached |= new
                edge = np.flatnonzero(new)
            other[reached] = seed
            waiting &= ~reached
        keep = np.flatnonzero((links > 0) | (other != np.arange(n)))
        return pa.table({"node": node[keep], "links": links[keep], "other": node[other[keep]]})
    return run


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95,
                 fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of df: its key (as `vec_id`), n_links (other rows with a cosine of at least `cosine`, copies
    counted), component_id (the smallest key reachable over links), kept (key = component_id).

    Vectors are compared with those of their own length, each length by itself and in one way at every size. Codes: the signs of the vectors under a rotation learned from the first `fit_rows`
    distinct vectors in a pseudo-random order. Tables: the code is cut into keys; vectors meet where a key is equal or
    within a small radius, and a pair is counted in the first table in which it meets. Every meeting is compared by the
    cosine of the original vectors in double precision, so no link is wrong; a link is missed if the pair meets nowhere
    (see RECALL; keys and radius are planned by how such pairs meet in the sample). Equal vectors are one node, with its
    number of copies. Buckets above PIECE vectors are dealt out as pairs of pieces, and each piece gives at most one row
    per vector, never its pairs.

    A vector that is null, empty, zero, or has null or non-finite components has no links and is its own component.
    Repeated rows link like other copies. A null key names a component only if it has no other key. An empty table gives
    no rows."""
    base = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding"))
    # a vector's name: two independent hashes could only agree for different vectors by a chance of 2**-64
    named = base.withColumn("node", F.when(usable(F.col("embedding")), F.xxhash64("embedding")))
    nodes = materialize(named.where("node is not null").groupBy("node", "embedding").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("dim", F.size("embedding")), "itq-nodes")
    fits, plans = {}, {}
    for dim, rows in nodes.groupBy("dim").count().where("count > 1").orderBy("dim").collect():
        sample = nodes.where(F.col("dim") == dim).orderBy(F.xxhash64("node", F.lit(5)), "node").limit(fit_rows).select("embedding").toArrow()
        x = _unit(sample["embedding"].combine_chunks().values.to_numpy(zero_copy_only=False), dim)
        fits[dim] = learn_rotation(x)
        plans[dim] = plan_tables(rows, fits[dim][1].shape[1], cosine, sample_pairs(x, *fits[dim], cosine))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                dims = batch.column(2).to_numpy()
                for dim in np.unique(dims).tolist():
                    part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                    b, m, radius = plans.get(dim, ONE_BUCKET)
                    code = np.zeros(part.num_rows, np.uint64)
                    if dim in fits:
                        mean, rotation = fits[dim]
                        x = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False), dim)
                        code = ((x - mean) @ rotation > 0).astype(np.uint64) @ (np.uint64(1) << np.arange(rotation.shape[1], dtype=np.uint64))
                    for t in range(m):
                        own = ((code >> np.uint64(b * t)) & np.uint64((1 << b) - 1)).astype(np.int64)
                        near = _near(own, b, radius)
                        which = np.concatenate([np.arange(len(own)), np.repeat(np.arange(len(own)), near.shape[1])])
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(which)), pa.array(code.view(np.int64)[which]), pa.array(np.full(len(which), dim, np.int32)),
                             pa.array(np.full(len(which), t, np.int32)), pa.array(np.concatenate([own, near.ravel()])),
                             pa.array(np.arange(len(which)) < len(own))],
                            ["node", "code", "dim", "table", "bucket", "own"])

    met = materialize(nodes.select("node", "embedding", "dim").mapInArrow(
        tables, "node bigint, code bigint, dim int, table int, bucket bigint, own boolean"), "itq-tables")
    full = materialize(met.groupBy("dim", "table", "bucket").agg(F.count("*").alias("c")).where("c > 1"), "itq-buckets")
    pieces = F.ceil(F.col("c") / PIECE).cast("int")
    dealt = met.join(full, ["dim", "table", "bucket"]).withColumn("s", pieces) \
        .withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("s")).cast("int")) \
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1))) \
        .select("node", "code", "dim", "table", "bucket", "own", "part", F.least("part", "o").alias("lo"), F.greatest("part", "o").alias("hi"))
    dealt = dealt.join(nodes.select("node", "embedding", "n"), "node")
    found = materialize(dealt.groupBy("dim", "table", "bucket", "lo", "hi").applyInArrow(
        _compare(plans, cosine), "node bigint, links bigint, other bigint"), "itq-links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    graph = components(found.where("node <> other"), "node", "other").withColumnRenamed("node", "gnode")
    rooted = nodes.select("node", "least", "n").join(graph, F.col("node") == F.col("gnode"), "left") \
        .select("node", "least", "n", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted.join(links, "node", "left").na.fill(0, ["links"]), "itq-roots")
    smallest = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "itq-least")
    label = materialize(rooted.join(smallest, "root").select("node", "component_id", (F.col("links") + F.col("n") - 1).alias("n_links")),
                        "itq-labels").withColumnRenamed("node", "lnode")
    return named.select("vec_id", "node").join(label, F.col("node") == F.col("lnode"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))
