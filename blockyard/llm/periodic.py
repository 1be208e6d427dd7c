"""Periodic runs of words, found by string synchronising sets (Kempa and Kociumaka, 2019)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least this many words, and at least this many periods. The choice of scales below relies on the latter.
LEAST, POWER = 6, 4
#: The smallest scale of the synchronising sets; smaller periods are found by comparing words a period apart.
FIRST_SCALE = 8
#: Bytes of texts that are searched together. A longer text is searched by itself.
BLOCK = 1 << 22

FOUND = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _mix(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    """64-bit hash of pairs."""
    with np.errstate(over="ignore"):
        z = x * np.uint64(0x9E3779B97F4A7C15) + y
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Words:
    """The words of a block of texts: `ids` (equal words, equal numbers), `first` (word at which each text begins, and
    the end), `data` and `sizes` (bytes of all words without what lies between them, and their lengths). Words are
    maximal runs of bytes other than 0x20 and 0x09-0x0D, which never are a part of another UTF-8 character."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
        begins[edge] |= solid[edge]
        stops[edge - 1] |= solid[edge - 1]
        begins, stops = np.flatnonzero(begins), np.flatnonzero(stops)
        self.first = np.searchsorted(begins, offsets)
        self.sizes = stops - begins + 1
        self.data = raw[solid]
        ends = np.r_[np.int64(0), np.cumsum(self.sizes)]
        words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(self.data)])
        self.ids = pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False) if len(begins) else np.zeros(0, np.int32)

    def joined(self, kept: np.ndarray) -> pa.Array:
        """Per text, its kept words joined by single spaces."""
        sizes = self.sizes[kept]
        text_of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[kept]
        space = np.r_[text_of[1:] == text_of[:-1], np.zeros(min(1, len(text_of)), bool)]
        after = np.cumsum(sizes + space)
        out = np.full(int(after[-1]) if len(after) else 0, 32, np.uint8)
        solid = np.ones(len(out), bool)
        solid[after[space] - 1] = False
        out[solid] = self.data[np.repeat(kept, self.sizes)]
        ends = np.r_[np.int64(0), np.cumsum(np.bincount(text_of, sizes + space, len(self.first) - 1).astype(np.int64))]
        return pa.Array.from_buffers(pa.large_string(), len(self.first) - 1, [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.string())


def _grown(ids: np.ndarray, begin: int, stop: int, lo: int, hi: int, p: int) -> tuple[int, int]:
    """The longest stretch around [begin, stop), itself of period p, that keeps it within the text [lo, hi)."""
    while begin > lo:
        at = max(lo, begin - 4 * p)
        off = np.flatnonzero(ids[at:begin] != ids[at + p:begin + p])
        begin = at + int(off[-1]) + 1 if len(off) else at
        if len(off):
            break
    while stop < hi:
        to = min(hi, stop + 4 * p)
        off = np.flatnonzero(ids[stop:to] != ids[stop - p:to - p])
        stop = stop + int(off[0]) if len(off) else to
        if len(off):
            break
    return begin, stop


def _small_periods(ids: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Highly periodic regions: runs (start, stop, period) of periods below FIRST_SCALE."""
    found = []
    for q in range(1, min(FIRST_SCALE, len(ids))):
        same = (ids[:-q] == ids[q:]) & (np.arange(q, len(ids)) < end[:-q])
        edge = np.flatnonzero(np.diff(np.r_[0, same.view(np.int8), 0]))
        begin, stop = edge[::2], edge[1::2] + q
        long = stop - begin >= max(LEAST, POWER * q)
        found.append(np.stack([begin[long], stop[long], np.full(long.sum(), q)], axis=1))
    return found


def _synchronising(h: np.ndarray, room: np.ndarray, periodic: np.ndarray, scale: int) -> np.ndarray:
    """Positions i, chosen by nothing but the 2 * scale words from i on: among the positions i to i + scale whose next
    `scale` words are not highly periodic, the least hash is at i or at i + scale. room: words left in the text."""
    key = np.where(periodic, np.uint64(2**64 - 1), h)
    least, width = key, 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(key) - scale
    least = np.minimum(least[:n], key[scale:])
    chosen = (room[:n] >= 2 * scale) & (least < np.uint64(2**64 - 1)) & ((key[:n] == least) | (key[scale:] == least))
    return np.flatnonzero(chosen)


def find_runs(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (start, stop, period), by start and period: the maximal stretches of LEAST words and POWER periods at least
    in the texts that begin at `first` (its last entry is the end of all).

    Scale t = 8, 16, ... finds the periods t to 2t - 1. In a run of such a period p, some position i among the first t
    is synchronising: else t + t windows of t words in a row would be highly periodic (period t / 4 at most), and so
    would be the run. The 2t words from i on and from i + p on are equal and inside the run, since it has 4p words, so
    i + p is synchronising too; and no position between has an equal context, for p would not be the smallest period.
    Thus neighbours among the positions of one context propose the period, and what they span is grown to the run.
    Highly periodic positions are those inside the runs of period t / 4 at most, which smaller scales have found; they
    are left out of the choice, so that about 2 / t of all positions are chosen even in such regions."""
    n = len(ids)
    end = np.repeat(first[1:], np.diff(first))
    found = _small_periods(ids, end)
    pos, scale = np.arange(n), 1
    h = _mix(ids.astype(np.uint64), np.uint64(1))
    while True:
        # texts that are too short for a run of this period are left out from here on
        size = np.repeat(np.diff(first), np.diff(first))[pos]
        stays = size >= POWER * max(scale, FIRST_SCALE)
        if not stays.any():
            break
        pos, h = pos[stays], h[stays]
        if scale >= FIRST_SCALE:
            found.append(_of_scale(ids, first, end, pos, h, scale, np.concatenate(found)))
        h = _mix(h, np.r_[h[scale:], np.zeros(min(scale, len(h)), np.uint64)])
        scale *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), int)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # of equal stretches the smallest period stays: the others are its multiples
    fresh = np.r_[np.ones(min(1, len(runs)), bool), (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _of_scale(ids, first, end, pos, h, scale, known) -> np.ndarray:
    small = known[(known[:, 2] * 4 <= scale) & (known[:, 1] - known[:, 0] >= scale)]
    cover = np.zeros(len(ids) + 1, np.int32)
    np.add.at(cover, small[:, 0], 1)
    np.add.at(cover, small[:, 1] - scale + 1, -1)
    periodic = np.cumsum(cover)[pos] > 0
    if len(pos) <= 2 * scale:
        return np.zeros((0, 3), int)
    at = _synchronising(h, end[pos] - pos, periodic, scale)
    context = _mix(_mix(h[at], h[at + scale]), end[pos[at]].astype(np.uint64))
    order = np.argsort(context, kind="stable")
    i, j, same = pos[at[order[:-1]]], pos[at[order[1:]]], context[order[:-1]] == context[order[1:]]
    pairs = same & (j - i >= scale) & (j - i < 2 * scale)
    i, p = i[pairs], (j - i)[pairs]
    by = np.lexsort((i, p))
    i, p = i[by], p[by]
    # pairs of one period that share a period of words belong to one run
    start = np.flatnonzero(np.r_[np.ones(min(1, len(i)), bool), (p[1:] != p[:-1]) | (i[1:] > i[:-1] + 2 * scale)])
    last = np.r_[start[1:], len(i)] - 1 if len(start) else start
    out = []
    for a, b, q in zip(i[start].tolist(), (i[last] + p[last] + 2 * scale).tolist(), p[start].tolist()):
        text = np.searchsorted(first, a, side="right") - 1
        if b <= first[text + 1] and np.array_equal(ids[a:b - q], ids[a + q:b]):  # contexts are compared by hash so far
            a, b = _grown(ids, a, b, int(first[text]), int(first[text + 1]), q)
            if b - a >= POWER * q:
                out.append((a, b, q))
    return np.unique(np.array(out), axis=0) if out else np.zeros((0, 3), int)


def _search(texts: pa.Array) -> list[pa.Array]:
    words = Words(texts)
    runs = find_runs(words.ids, words.first)
    drop = np.zeros(len(words.ids) + 1, np.int32)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 1], -1)
    kept = np.cumsum(drop[:-1]) == 0
    text = np.searchsorted(words.first, runs[:, 0], side="right") - 1
    fields = [pa.array(c.astype(np.int64)) for c in (runs[:, 0] - words.first[text], runs[:, 1] - runs[:, 0], runs[:, 2])]
    inner = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
    offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
    return [pa.array(np.diff(words.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), inner), words.joined(kept)]


def _blocks(texts: pa.Array) -> Iterator[slice]:
    """Slices of about BLOCK bytes, one text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK, side="right")))
        yield slice(at, to)
        at = to


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, n_words, runs (by start, then period; start is a word number from 0) and collapsed
    (the words that no run contains after its first period, joined by single spaces).

    A run is a stretch of words with smallest period q, of at least 6 words and 4 periods, that no neighbouring word
    extends. Null, empty and wordless texts have no words, no runs and an empty collapsed text. Whole texts are
    searched; a block of texts is searched at a time, and memory is bounded by a block or the longest text. Repeated
    rows each give a row, null keys too; an empty table gives no rows; other columns are not read. Overlapping runs
    each count, and a word is dropped if any of them drops it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch.column(1)):
                n = part.stop - part.start
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, n), *_search(batch.column(1).slice(part.start, n))],
                                                 ["key", "n_words", "runs", "collapsed"])
    given = df.select(df[key].alias("key"), df[text].alias("_text"))
    return given.mapInArrow(run, f"key {given.schema['key'].dataType.simpleString()}, {FOUND}")


def longest(runs):
    """Of an array of runs, the longest as a struct; of equal ones the first, then the one of smallest period; null if
    there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))
