"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockyard.llm.common import null_safe
from blockyard.session import discard, materialize

#: Words of the classifier: runs of letters and digits of the lower-cased text. Each is hashed twice, whole and by its
#: first letters, and the two embeddings are added, so that unseen endings of a known stem share its embedding.
TOKEN = r"[\p{L}\p{N}]+"
STEM = 5
BUCKETS = 1 << 15


@dataclass(frozen=True)
class Options:
    """What is learned from at most: rows per label, and words of a row that is learned from (longer labelled rows are
    passed over in learning only; scoring reads whole texts)."""
    rows_per_label: int = 3000
    words_per_row: int = 4096
    dim: int = 16
    filters: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    batch: int = 32
    steps: int = 900
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 7


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the key as text, modulo 4, is 2."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def calibration(key: Column) -> Column:
    """One learning row in eight sets the thresholds and is not fitted."""
    return F.floor(F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) / 4) % 8 == 0


def word_ids(text: Column) -> Column:
    """Array of hashed ids, two per word in a row: word, stem."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    both = F.transform(found, lambda w: F.array(
        F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"),
        (F.pmod(F.xxhash64(F.substring(w, 1, STEM), F.lit(1)), F.lit(BUCKETS)) + BUCKETS).cast("int")))
    return F.flatten(both)


class Network:
    """score = sigmoid(v . relu(max over positions of the filters) + c). A text shorter than a filter is padded with
    zero embeddings; an empty text is all padding."""

    def __init__(self, o: Options):
        r = np.random.default_rng(o.seed)
        self.o = o
        self.emb = r.normal(0, 0.1, (2 * BUCKETS, o.dim)).astype(np.float32)
        self.w = {k: r.normal(0, 1 / np.sqrt(k * o.dim), (k, o.dim, o.filters)).astype(np.float32) for k in o.widths}
        self.b = {k: np.zeros(o.filters, np.float32) for k in o.widths}
        self.v = r.normal(0, 0.3, o.filters * len(o.widths)).astype(np.float32)
        self.c, self.shift = 0.0, 0.0

    def _pooled(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int):
        """Per text and filter of width k: the largest activation and its position. x: embeddings, where each text is
        followed by enough zero rows for the widest filter; `sizes` counts positions (1 at least)."""
        z = sum(x[j:len(x) - k + 1 + j] @ self.w[k][j] for j in range(k))
        best, at = np.empty((len(starts), self.o.filters), np.float32), np.empty((len(starts), self.o.filters), np.int64)
        for i, (s, n) in enumerate(zip(starts, sizes)):
            part = z[s:s + max(1, n - k + 1)]
            at[i] = part.argmax(axis=0)
            best[i] = part[at[i], np.arange(self.o.filters)]
            at[i] += s
        return best + self.b[k], at

    def train(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        o, r = self.o, np.random.default_rng(self.o.seed + 1)
        pad, order = max(o.widths), np.array([], int)
        seen = {n: np.zeros_like(a) for n, a in self._dense().items()}
        seen_emb = np.zeros(len(self.emb), np.float32)
        for step in range(o.steps):
            if len(order) < o.batch:
                order = np.concatenate([order, r.permutation(len(texts))])
            pick, order = order[:o.batch], order[o.batch:]
            ids, starts, sizes, total = [], [], [], 0
            for t in pick:
                pairs = texts[t].reshape(-1, 2)
                ids.append(pairs), ids.append(np.full((pad, 2), -1))
                starts.append(total), sizes.append(len(pairs))
                total += len(pairs) + pad
            ids, starts, sizes = np.concatenate(ids), np.array(starts), np.array(sizes)
            real = ids[:, 0] >= 0
            x = (self.emb[ids[:, 0]] + self.emb[ids[:, 1]]) * real[:, None]
            pooled = {k: self._pooled(x, starts, sizes, k) for k in o.widths}
            h = np.concatenate([np.maximum(pooled[k][0], 0) for k in o.widths], axis=1)
            p = 1 / (1 + np.exp(-(h @ self.v + self.c)))
            g = ((p - labels[pick]) / len(pick)).astype(np.float32)
            grads = {"v": h.T @ g, "c": np.array([g.sum()], np.float32)}
            dx = np.zeros_like(x)
            for n, k in enumerate(o.widths):
                mine = slice(n * o.filters, (n + 1) * o.filters)
                back = g[:, None] * self.v[mine] * (h[:, mine] > 0)
                at = pooled[k][1]
                dw = np.zeros_like(self.w[k])
                for j in range(k):
                    rows = x[at + j]
                    dw[j] = np.einsum("bfd,bf->df", rows, back)
                    np.add.at(dx, (at + j).ravel(), (back[:, :, None] * self.w[k][j].T[None]).reshape(-1, o.dim))
                grads[f"w{k}"], grads[f"b{k}"] = dw, back.sum(axis=0)
            rate = o.rate * (1 - step / o.steps)
            dense = self._dense()
            for name, grad in grads.items():  # Adagrad
                grad = grad + o.decay * dense[name]
                seen[name] += grad * grad
                dense[name] -= rate * 3 * grad / (np.sqrt(seen[name]) + 1e-6)
            self.c = float(dense["c"][0])
            touched = np.flatnonzero(np.any(dx != 0, axis=1) & real)
            for side in (0, 1):
                where, inverse = np.unique(ids[touched, side], return_inverse=True)
                grad = np.zeros((len(where), o.dim), np.float32)
                np.add.at(grad, inverse, dx[touched])
                seen_emb[where] += (grad * grad).mean(axis=1)
                self.emb[where] -= rate * 3 * grad / (np.sqrt(seen_emb[where]) + 1e-6)[:, None]

    def _dense(self) -> dict[str, np.ndarray]:
        return {"v": self.v, "c": np.array([self.c], np.float32)} | {f"w{k}": w for k, w in self.w.items()} | {f"b{k}": b for k, b in self.b.items()}

    def weights(self) -> dict:
        """What a score depends on, and what is sent to the tasks."""
        return {"emb": self.emb, "w": self.w, "b": self.b, "v": self.v, "c": self.c + self.shift}

    def compiled(self) -> dict:
        return compiled(self.weights())


def compiled(weights: dict) -> dict:
    """For scoring: each embedding times each filter row, so that a filter is a sum of table rows. The tables are several
    times as large as the weights, so each task makes its own."""
    return {"tables": {k: [(weights["emb"] @ w[j]).astype(np.float32) for j in range(k)] for k, w in weights["w"].items()},
            "b": weights["b"], "v": weights["v"], "c": weights["c"]}


def _score(model: dict, flat: np.ndarray, ends: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
    """Scores of texts given as flat id pairs and list offsets; long texts go in overlapping pieces of their words."""
    out = np.empty(len(ends) - 1)
    widths = sorted(model["tables"])
    ends = ends // 2
    pairs = flat.reshape(-1, 2)
    group, held = [], 0
    def flush():
        # texts of this group laid out one after another, each followed by padding
        pad, where, starts, total = max(widths), [], [], 0
        for i in group:
            starts.append(total)
            where.append(np.arange(ends[i], ends[i + 1])), where.append(np.full(pad, -1))
            total += ends[i + 1] - ends[i] + pad
        where, starts = np.concatenate(where), np.array(starts)
        real = where >= 0
        a, b = pairs[where, 0] if len(pairs) else np.zeros(total, int), pairs[where, 1] if len(pairs) else np.zeros(total, int)
        sizes = ends[np.array(group) + 1] - ends[group]
        h = [_pool(model, a, b, real, starts, sizes, k) for k in widths]
        out[group] = 1 / (1 + np.exp(-(np.maximum(np.concatenate(h, axis=1), 0) @ model["v"] + model["c"])))
    for i in range(len(out)):
        n = ends[i + 1] - ends[i]
        if group and held + n > piece:
            flush()
            group, held = [], 0
        if n > piece:
            best = None
            for s in range(ends[i], ends[i + 1], piece):
                e = min(ends[i + 1], s + piece + max(widths) - 1)
                a, b = pairs[s:e, 0], pairs[s:e, 1]
                at = [_pool(model, a, b, np.ones(e - s, bool), np.array([0]), np.array([e - s]), k) if e - s >= k else None for k in widths]
                best = at if best is None else [x if y is None else np.maximum(x, y) for x, y in zip(best, at)]
            out[i] = 1 / (1 + np.exp(-(np.maximum(np.concatenate(best, axis=1), 0) @ model["v"] + model["c"])))[0]
        else:
            group.append(i)
            held += n
    if group:
        flush()
    return out


def _pool(model: dict, a, b, real, starts, sizes, k) -> np.ndarray:
    tables = model["tables"][k]
    n = len(a) - k + 1
    z = np.zeros((n, len(model["b"][k])), np.float32)
    for j, t in enumerate(tables):
        z += (t[a[j:n + j]] + t[b[j:n + j]]) * real[j:n + j, None]
    # positions past a text's last full window (or its only, padded one) do not count
    stop = starts + np.maximum(1, sizes - k + 1)
    bounds = np.minimum(np.stack([starts, stop], axis=1).ravel(), n)
    bounds = bounds[:-1] if bounds[-1] >= n else bounds
    return np.maximum.reduceat(z, bounds, axis=0)[::2] + model["b"][k]


def _trained(got: pa.Table, share: float, options: Options) -> dict | None:
    """Weights learned from (_key, toxic, ids); None if the rows do not have both labels. share: of label 1 among all
    learning rows."""
    got = got.sort_by([("_key", "ascending"), ("toxic", "ascending")])
    y = got["toxic"].to_numpy().astype(np.float32)
    if len(set(y)) < 2:
        return None
    ids = got["ids"].combine_chunks()
    ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    del got
    net = Network(options)
    net.train([flat[a:b] for a, b in zip(ends, ends[1:])], y)
    # the sample is denser in one label than all learning rows are: scores are set back to these rows' share
    sampled = float(y.mean())
    net.shift = float(np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)))
    return net.weights()


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, options: Options) -> dict | None:
    """The weights of a model from at most rows_per_label learning rows of each label, the first in a pseudo-random order
    of the keys; None if the rows do not have both labels. The rows that are learned from are bounded by the options, so
    one task trains on them whatever the tables' size; the driver gets the weights alone, which are of fixed size."""
    o = options
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)) & ~calibration(F.col(key))) \
        .groupBy(key).agg(F.max("toxic").alias("toxic")).withColumn("_h", F.xxhash64(key))
    usable = materialize(usable, "toxicity-labels")
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    some = [usable.where(F.col("toxic") == y).orderBy("_h", key).limit(o.rows_per_label) for y in (0, 1)]
    some = materialize(some[0].unionByName(some[1]).select(F.col(key).alias("_key"), "toxic"), "toxicity-sample")
    given = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text"))
    rows = given.join(some, F.col("_k") == F.col("_key")).select("_key", "toxic", word_ids(F.col("_text")).alias("ids")) \
        .where(F.size("ids") <= 2 * o.words_per_row)
    rows = materialize(rows, "toxicity-learn")
    share = counts[1] / (counts[0] + counts[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        found = _trained(pa.Table.from_batches(held), share, o) if held else None
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found, 5)], pa.binary())], ["weights"])

    got = rows.coalesce(1).mapInArrow(run, "weights binary").collect()
    discard(rows)
    return pickle.loads(got[0]["weights"]) if got else None


def scores(docs: DataFrame, model: dict | Broadcast | None, key: str, text: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, *also, score): each whole text's score, 0 to 1, by the weights that fit() returns. Without a model every score
    is 0. A model that is broadcast already is left to the caller to destroy."""
    keep = [F.col(key).alias("key"), *[F.col(c) for c in also]]
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    # of fixed size: buckets x dimensions
    sent = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*keep, word_ids(F.col(text)).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = None
        for b in batches:
            ids = b.column(b.num_columns - 1)
            flat = ids.values.to_numpy(zero_copy_only=False)
            ready = ready or compiled(sent.value)
            got = _score(ready, flat, ids.offsets.to_numpy()) if len(ids) else np.array([])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.float64())], [*b.schema.names[:-1], "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{kinds}, score double")


def language_thresholds(scored: DataFrame, labels: DataFrame, key: str, default: float, bins: int = 200) -> DataFrame:
    """(lang key `_l`, threshold): per language the score from which on most calibration rows are decided rightly;
    of equally good scores the middle of their longest stretch, and `default` for a language without both labels. All calibration
    rows count, as a histogram of `bins` scores per language."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col(key)) & calibration(F.col(key))).groupBy(key).agg(F.max("toxic").alias("toxic"))
    rows = scored.join(known, scored["key"] == known[key]).select(
        null_safe(F.col("lang")).alias("_l"), F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin"), "toxic")
    per_bin = rows.groupBy("_l", "bin").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    grid = per_bin.select("_l").distinct().select("_l", F.explode(F.sequence(F.lit(1), F.lit(bins - 1))).alias("bin"))
    full = grid.join(per_bin, ["_l", "bin"], "full").na.fill(0, ["bad", "n"])
    below = Window.partitionBy("_l").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("_l")
    wrong = F.coalesce(F.sum("bad").over(below), F.lit(0)) + F.sum(F.col("n") - F.col("bad")).over(everything) \
        - F.coalesce(F.sum(F.col("n") - F.col("bad")).over(below), F.lit(0))
    cost = full.withColumn("wrong", wrong).withColumn("_bad", F.sum("bad").over(everything)) \
        .withColumn("_n", F.sum("n").over(everything)).withColumn("_least", F.min("wrong").over(everything))
    # neighbouring best bins form a run; the longest run counts, of equal ones the first
    best = cost.where(F.col("wrong") == F.col("_least")).withColumn("_run", F.col("bin") - F.row_number().over(Window.partitionBy("_l").orderBy("bin")))
    runs = best.groupBy("_l", "_run").agg(F.count("*").alias("n"), F.min("bin").alias("bin"), F.avg("bin").alias("middle"),
                                          F.max((F.col("_bad") > 0) & (F.col("_bad") < F.col("_n"))).alias("known"))
    first = runs.groupBy("_l").agg(F.max(F.struct("n", (-F.col("bin")).alias("b"), "middle", "known")).alias("r"))
    return first.select("_l", F.when(F.col("r")["known"], F.col("r")["middle"] / bins).otherwise(F.lit(default)).alias("threshold"))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             at: float = 0.3, options: Options = Options()) -> DataFrame:
    """One row per row of docs: its key (as `doc_id`), held_out, score, predicted (score >= at), the language's
    threshold and rejected (score >= threshold).

    Null, empty and wordless texts are scored as pure padding. Rows with a null key are scored and are not held out
    (crc32 of the empty text). Repeated keys in labels count as toxic if any row says so. Without learning rows of both
    labels all scores are 0. Null languages are one language. An empty table gives no rows. Labels, language, source and
    key never enter a score; the language only chooses a threshold."""
    model = fit(docs, labels, key, text, options)
    model = docs.sparkSession.sparkContext.broadcast(model) if model else None
    scored = materialize(scores(docs.select(F.col(key).alias("_k"), F.col(text).alias("_text"), F.col(lang).alias("lang")),
                                model, "_k", "_text", ("lang",)), "toxicity-scores")
    if model:
        model.destroy()
    limits = materialize(language_thresholds(scored, labels, key, at), "toxicity-thresholds")
    return scored.withColumn("_lang", null_safe(F.col("lang"))).join(limits, F.col("_lang") == F.col("_l"), "left").select(
        F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score",
        (F.col("score") >= at).cast("int").alias("predicted"), F.coalesce("threshold", F.lit(float(at))).alias("threshold"),
        (F.col("score") >= F.coalesce("threshold", F.lit(float(at)))).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose score stays below their language's threshold. All rows of a key go if one of them does; rows
    with a null key are one key; null and empty texts are scored as padding and may stay. Columns are passed through,
    whatever their names; an empty table gives no rows."""
    bad = toxicity(docs, labels, key, **options).where("rejected").select(F.col("doc_id").alias("_bad")).distinct()
    bad = materialize(bad, "toxicity-bad")
    return docs.join(bad, docs[key].eqNullSafe(bad["_bad"]), "left_anti")
