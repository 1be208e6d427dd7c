"""Exact substring dedup with truncated longest-previous-factor arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in an earlier document. The suffixes that matter are
dealt out by content: of each window of LENGTH bytes, the smallest hash of its GRAM-byte grams (the leftmost of equals)
is the window's anchor, so equal windows have equal anchors wherever they occur, and neighbouring windows share one. A
`site` is an anchor with the bytes of all its windows. Jobs, each over blocks of documents in the shared folder:

1. texts are laid down in blocks; equal whole texts are found by two hashes, and only the first of them goes on;
2. each block sends the hashes of its anchors; those that occur in more than one document come back;
3. each block sends its distinct sites at these anchors, with their earliest document;
4. the windows of all sites at an anchor are put in suffix order; from the common prefixes of neighbours and the previous
   and next smaller positions comes the longest previous factor of each window, cut at LENGTH, and its source, which is
   followed to the earliest document that has the window;
5. each block removes the windows that a document before their own has.

Traffic is by block and distinct site, not by occurrence, so a passage in a third of all documents costs each block one
row. Nothing but these rows moves: texts are written once and read block by block."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockyard.llm.common import materialize, new_folder

LENGTH, GRAM = 50, 24
#: Bytes of a block, of a piece of it that is hashed at a time, and of text per bucket of anchors and of sites.
BLOCK, PIECE, PER_ANCHORS, PER_SITES = 16 << 20, 1 << 20, 16 << 20, 4 << 20
LAST = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_CACHE: dict[int, tuple] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(data: np.ndarray) -> np.ndarray:
    n = len(data) + 1
    if n not in _CACHE or len(_CACHE[n][0]) < n:
        size = 1 << (n - 1).bit_length()
        up, down = _CACHE.get(size) or _CACHE.setdefault(size, _powers(size))
    else:
        up, down = _CACHE[n]
    return np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])]), down


def _span_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the bytes start to stop, whatever their place."""
    return _mix((sums[stop] - sums[start]) * down[start])


def sites(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Of the windows that lie inside one of the texts laid end to end in `data` (they end at `ends`): runs of
    neighbouring windows with the same anchor. Returns (first window, last window, anchor, hash of the anchor's gram)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    sums, down = _sums(data)
    n = len(data) - gram + 1
    h = _mix((sums[gram:] - sums[:-gram]) * down[:n])
    # one number holds the order of the hash and, for the leftmost of equals, the place
    best = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:  # minima over twice as many grams each time
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows from p on lie inside a text if it does not end before p + length
    starts = np.concatenate([[0], ends[:-1]])
    count = np.maximum(ends - starts - length + 1, 0)
    inside = np.zeros(len(anchor) + 1, np.int32)
    np.add.at(inside, starts[count > 0], 1)
    np.add.at(inside, (starts + count)[count > 0], -1)
    p = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(p):
        return none, none, none, np.zeros(0, np.uint64)
    new = np.r_[True, (np.diff(p) > 1) | (anchor[p][1:] != anchor[p][:-1])]
    # two texts next to each other may share neither windows nor a run
    new |= np.isin(p, starts)
    first = p[new]
    last = np.r_[p[np.flatnonzero(new)[1:] - 1], p[-1]]
    return first, last, anchor[first], h[anchor[first]]


def _pieces(block: pa.Table, skip: set) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, row, place in the row's text) of a block's texts, some at a time; long texts in overlapping parts."""
    held, rows, places, size = [], [], [], 0
    for i, text in enumerate(block["text"].combine_chunks() if block.num_rows else []):
        if i in skip:
            continue
        raw = np.frombuffer(text.as_buffer(), np.uint8) if text.as_buffer() is not None else np.zeros(0, np.uint8)
        for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
            part = raw[at:at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            held.append(part), rows.append(i), places.append(at)
            size += len(part)
            if size >= PIECE:
                yield np.concatenate(held), np.cumsum([len(x) for x in held]), np.array(rows), np.array(places)
                held, rows, places, size = [], [], [], 0
    if held:
        yield np.concatenate(held), np.cumsum([len(x) for x in held]), np.array(rows), np.array(places)


def _read(folder: str, block: int, columns: list[str] | None = None) -> pa.Table:
    fs, base = pafs.FileSystem.from_uri(folder)
    return pq.read_table(f"{base}/block-{block}.parquet", filesystem=fs, columns=columns)


def _low(h: np.ndarray) -> np.ndarray:
    """The 40 bits of a hash that are sent where a false match only costs time."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :5])


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _lay_down(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        number, held, size = TaskContext.get().partitionId() << 20, [], 0

        def flush():
            table = pa.Table.from_batches(held)
            hidden = f"{base}/_{number}-{uuid.uuid4().hex}"
            pq.write_table(table.select(["doc", "text"]), hidden, filesystem=fs, compression="zstd", use_dictionary=False)
            fs.move(hidden, f"{base}/block-{number}.parquet")  # whole or not at all; a task that runs again writes the same
            n = table.num_rows
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int64)), pa.array(np.arange(n, dtype=np.int64)),
                                               *[table[c].combine_chunks() for c in ("doc", "h1", "h2", "n")]],
                                              ["block", "row", "doc", "h1", "h2", "n"])
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                held.append(batch)
                size += int(np.sum(batch["n"].to_numpy()))
                if size >= BLOCK:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()
    return run


def _send_anchors(folder: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                text = _read(folder, r["block"])
                for data, ends, rows, _ in _pieces(text, set(r["copies"])):
                    first, _, _, h = sites(data, ends)
                    doc = rows[np.searchsorted(ends, first, side="right")]
                    order = np.lexsort((doc, h))
                    h, doc = h[order], doc[order]
                    new = np.r_[True, h[1:] != h[:-1]]
                    at = np.flatnonzero(new)
                    several = np.maximum.reduceat(doc, at) != np.minimum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
                    h = h[at]
                    to = _bucket(h, buckets)
                    order = np.argsort(to, kind="stable")
                    h, to, several = h[order], to[order], several[order]
                    cut = np.r_[0, np.flatnonzero(np.diff(to)) + 1, len(to)] if len(to) else np.zeros(1, int)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to[cut[:-1]], pa.int64()), pa.array(np.full(len(cut) - 1, r["block"], np.int64)),
                         pa.array([_low(h[a:b]).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                         pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                        ["bucket", "block", "low", "several"])
    return run


def _wide(low: bytes) -> np.ndarray:
    raw = np.frombuffer(low, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view(np.uint64).ravel()


def _repeated(t: pa.Table) -> pa.Table:
    """Of one bucket's anchors: per block, those that another piece has too, or several documents of one piece."""
    lows = [_wide(x.as_py()) for x in t["low"]]
    several = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(l)).astype(bool) for x, l in zip(t["several"], lows)]
    value, of = np.concatenate(lows), np.repeat(np.arange(len(lows)), [len(x) for x in lows])
    order = np.argsort(value, kind="stable")
    v = value[order]
    same = v[1:] == v[:-1]
    again = np.r_[False, same] | np.r_[same, False] | np.concatenate(several)[order]
    value, of = v[again], of[order][again]
    order = np.argsort(of, kind="stable")
    value, of = value[order], of[order]
    cut = np.searchsorted(of, np.arange(len(lows) + 1))
    keep = np.flatnonzero(np.diff(cut))
    return pa.table({"block": t["block"].combine_chunks().take(pa.array(keep)),
                     "bucket": t["bucket"].combine_chunks().take(pa.array(keep)),
                     "low": pa.array([_low(value[cut[i]:cut[i + 1]]).tobytes() for i in keep], pa.binary())})


def _candidates(folder: str, block: int, copies: list, wanted: list, buckets: int):
    """A block's sites at repeated anchors: yields per piece (bytes, first, last, anchor, hash, row, offset to the text)."""
    key = lambda low, to: low ^ (_mix(to.astype(np.uint64)) & np.uint64(0xFFFFFF0000000000))
    known = np.unique(np.concatenate([key(_wide(w["low"]), np.full(len(w["low"]) // 5, w["bucket"])) for w in wanted])) if wanted else np.zeros(0, np.uint64)
    if not len(known):
        return
    for data, ends, rows, places in _pieces(_read(folder, block), set(copies)):
        first, last, anchor, h = sites(data, ends)
        mine = key(h & np.uint64(0xFFFFFFFFFF), _bucket(h, buckets))
        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        hit = known[at] == mine
        first, last, anchor, h = first[hit], last[hit], anchor[hit], h[hit]
        if not len(first):
            continue
        part = np.searchsorted(ends, first, side="right")
        sums, down = _sums(data)
        shape = ((anchor - first).astype(np.uint64) << np.uint64(8)) | (last - first).astype(np.uint64)
        name = _mix(_span_hash(sums, down, first, last + LENGTH) ^ _mix(shape))
        yield data, first, last, anchor, h, name, rows[part], places[part] - np.concatenate([[0], ends[:-1]])[part]


def _send_sites(folder: str, anchor_buckets: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                doc_of = None
                for data, first, last, anchor, h, name, row, _ in _candidates(folder, r["block"], r["copies"], r["wanted"], anchor_buckets):
                    doc_of = _read(folder, r["block"], ["doc"])["doc"].to_numpy() if doc_of is None else doc_of
                    doc = doc_of[row]
                    order = np.lexsort((doc, name, h))  # distinct sites of the piece, each with its earliest document
                    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (name[order][1:] != name[order][:-1])]
                    one = order[new]
                    to = _bucket(h[one], buckets)
                    one = one[np.argsort(to, kind="stable")]
                    to = np.sort(to, kind="stable")
                    cut = np.r_[0, np.flatnonzero(np.diff(to)) + 1, len(to)]
                    sizes = last[one] - first[one] + LENGTH
                    text = data[np.repeat(first[one] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
                    edge = np.concatenate([[0], np.cumsum(sizes)])
                    blobs = {"h": h[one], "name": name[one], "doc": doc[one], "lead": (anchor - first)[one].astype(np.uint8),
                             "more": (last - first)[one].astype(np.uint8)}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to[cut[:-1]], pa.int64()), pa.array(np.full(len(cut) - 1, r["block"], np.int64)),
                         *[pa.array([v[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for v in blobs.values()],
                         pa.array([text[edge[a]:edge[b]].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                        ["bucket", "block", *blobs, "text"])
    return run


def suffix_order(text: np.ndarray, starts: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts` in order of their first `length` bytes, then of document, and the common prefix of each
    with the one before it (0 for the first), both up to `length`."""
    words = -(-length // 8)
    rows = np.zeros((len(starts), words * 8), np.uint8)
    rows[:, :length] = text[starts[:, None] + np.arange(length)]
    keys = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((doc, *keys.T[::-1]))
    rows = rows[order, :length]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return order, np.r_[0, common].astype(np.int64)


def _smaller(doc: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """For each place of the suffix order the nearest place before it with a smaller document, as long as all common
    prefixes on the way reach `length`; -1 where there is none. Found by pointer jumping: a place whose candidate is not
    smaller takes over the candidate's own answer so far, so steps grow from round to round."""
    at = np.arange(len(doc)) - 1
    at[common < length] = -1
    left = np.flatnonzero(at >= 0)
    while len(left):
        left = left[doc[at[left]] >= doc[left]]
        at[left] = at[at[left]]
        left = left[at[left] >= 0]
    return at


def longest_previous_factors(text: np.ndarray, starts: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(lpf, source) of each suffix: its longest common prefix with a suffix of a smaller document, cut at `length`, if it
    reaches `length`, else 0; and the place of such a suffix, or -1. The previous and the next smaller place in suffix
    order have the longest common prefixes with it."""
    order, common = suffix_order(text, starts, doc, length)
    back = _smaller(doc[order], common, length)
    n = len(order)
    ahead = _smaller(doc[order][::-1], np.r_[0, common[1:][::-1]], length)[::-1]
    ahead = np.where(ahead >= 0, n - 1 - ahead, -1)
    near = np.where(back >= 0, back, ahead)
    source = np.empty(n, np.int64)
    source[order] = np.where(near >= 0, order[near], -1)
    return np.where(source >= 0, length, 0), source


def first_documents(text: np.ndarray, starts: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The earliest document with each suffix's first `length` bytes: its own if it has no previous factor of that length,
    else that of its source, whose source is followed in turn (by doubling)."""
    _, source = longest_previous_factors(text, starts, doc, length)
    at = np.where(source >= 0, source, np.arange(len(source)))
    while True:
        far = at[at]
        if np.array_equal(far, at):
            return doc[at]
        at = far


def _earliest(most: int = 200_000):
    def run(t: pa.Table) -> pa.Table:
        """Per block and site: stretches of windows that occur in a document before the last that the bucket knows."""
        get = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in t[c]])
        h, name, doc = get("h", np.uint64), get("name", np.uint64), get("doc", np.int64)
        lead, more, text = get("lead", np.uint8).astype(np.int64), get("more", np.uint8).astype(np.int64), get("text", np.uint8)
        block = np.repeat(t["block"].to_numpy(), [len(x.as_py()) // 8 for x in t["h"]])
        sizes = more + LENGTH
        begin = np.cumsum(sizes) - sizes
        # sites that several blocks or pieces have: one of each goes on, with its earliest document
        order = np.lexsort((doc, name, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (name[order][1:] != name[order][:-1])]
        one, which = order[new], np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        groups = np.flatnonzero(np.r_[True, h[one][1:] != h[one][:-1]])
        parts, at = [], 0
        windows = np.concatenate([[0], np.cumsum(more[one] + 1)])
        while at < len(groups):  # some anchors at a time
            end = max(at + 1, int(np.searchsorted(windows[np.r_[groups[1:], len(one)]], windows[groups[at]] + most, side="right")))
            a, b = groups[at], groups[end] if end < len(groups) else len(one)
            s = one[a:b]
            counts = more[s] + 1
            shift = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            parts.append(first_documents(text, np.repeat(begin[s], counts) + shift, np.repeat(doc[s], counts)))
            at = end
        least = np.concatenate(parts)
        # stretches of equal documents within a site
        site = np.repeat(np.arange(len(one)), more[one] + 1)
        place = np.arange(len(site)) - windows[site]
        new = np.r_[True, (site[1:] != site[:-1]) | (least[1:] != least[:-1])]
        run_at = np.flatnonzero(new)
        stop = np.r_[run_at[1:], len(site)] - 1
        r_site, r_from, r_to, r_doc = site[run_at], place[run_at], place[stop], least[run_at]
        # a block needs the stretches of its sites where an earlier document than the site's last may have them
        low = np.searchsorted(r_site, which, side="left")
        n = np.searchsorted(r_site, which, side="right") - low
        pick = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        occ = np.repeat(np.arange(len(which)), n)
        order = np.argsort(block[occ], kind="stable")
        occ, pick = occ[order], pick[order]
        cut = np.r_[0, np.flatnonzero(np.diff(block[occ])) + 1, len(occ)] if len(occ) else np.zeros(1, int)
        cols = {"h": h[occ], "name": name[occ], "from": r_from[pick].astype(np.uint8), "to": r_to[pick].astype(np.uint8), "doc": r_doc[pick]}
        return pa.table({"block": pa.array(block[occ][cut[:-1]], pa.int64())} | {
            c: pa.array([v[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for c, v in cols.items()})
    return run


def _remove(folder: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                text = _read(folder, r["block"])
                docs = text["doc"].to_numpy(zero_copy_only=False) if text.num_rows else np.zeros(0, np.int64)
                got = r["stretches"] or []
                cat = lambda c, kind: np.concatenate([np.frombuffer(x[c], kind) for x in got]) if got else np.zeros(0, kind)
                name = _mix(cat("name", np.uint64) ^ _mix(cat("h", np.uint64)))
                a, b, doc = cat("from", np.uint8).astype(np.int64), cat("to", np.uint8).astype(np.int64), cat("doc", np.int64)
                order = np.argsort(name, kind="stable")
                name, a, b, doc = name[order], a[order], b[order], doc[order]
                cover = {}
                for _, first, _, _, h, site, row, offset in _candidates(folder, r["block"], r["copies"], r["wanted"] or [], buckets):
                    mine = _mix(site ^ _mix(h))
                    low = np.searchsorted(name, mine, side="left")
                    n = np.searchsorted(name, mine, side="right") - low
                    pick = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    occ = np.repeat(np.arange(len(mine)), n)
                    hit = doc[pick] < docs[row[occ]]
                    occ, pick = occ[hit], pick[hit]
                    begin = first[occ] + offset[occ]
                    for i, s, e in zip(row[occ].tolist(), (begin + a[pick]).tolist(), (begin + b[pick] + LENGTH).tolist()):
                        cover.setdefault(i, []).append((s, e))
                copies = set(r["copies"])
                out = []
                for i, value in enumerate(text["text"]):
                    raw = value.as_py()
                    spans = [(0, len(raw))] if i in copies and len(raw) >= LENGTH else _union(cover.get(i, []))
                    kept, at = [], 0
                    for s, e in spans:
                        kept.append(raw[at:s])
                        at = e
                    kept = b"".join([*kept, raw[at:]])
                    out.append((int(docs[i]), len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), r["block"], i,
                                [x for span in spans for x in span]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) if k < 7 else pa.array(list(c), pa.list_(pa.int64())) for k, c in enumerate(zip(*out))],
                                                     ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "block", "row", "spans"])
    return run


def _union(spans: list) -> list:
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: its key (as `doc_id`), n_bytes, n_removed, n_spans, kept_sha256 (of what is left) and spans
    (start and end of each removed run, one after another, in bytes).

    Texts are UTF-8 bytes, null ones are empty; texts under LENGTH bytes are never touched. A null key comes after all
    others. Rows with the same key do not remove each other's bytes; of rows with equal key and text each gives the same
    result. Matches never cross documents and are judged on the input. An empty table gives no rows."""
    spark = df.sparkSession
    folder = new_folder(spark, "substrings")
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    base = df.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), raw.alias("text"), F.xxhash64(raw).alias("h1"),
                     F.xxhash64(raw, F.lit(1)).alias("h2"), F.octet_length(raw).cast("long").alias("n"))
    table = materialize(base.mapInArrow(_lay_down(folder), "block bigint, row bigint, doc bigint, h1 bigint, h2 bigint, n bigint"), "lpf-rows")
    firsts = table.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    firsts = materialize(firsts, "lpf-firsts")
    copies = table.join(firsts, ["h1", "h2"]).where("doc > first").groupBy("block").agg(F.collect_list("row").alias("copies"))
    copies = materialize(copies, "lpf-copies")
    total = table.agg(F.sum("n")).collect()[0][0] or 0
    none = F.expr("cast(array() as array<bigint>)")
    blocks = materialize(table.select("block").distinct().join(copies, "block", "left")
                         .select("block", F.coalesce("copies", none).alias("copies")), "lpf-blocks")
    n_anchor, n_site = max(1, total // PER_ANCHORS), max(1, total // PER_SITES)
    spread = lambda d: d.repartition(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) * 8, total // BLOCK + 1)), "block")

    sent = spread(blocks).mapInArrow(_send_anchors(folder, n_anchor), "bucket bigint, block bigint, low binary, several binary")
    again = materialize(sent.groupBy("bucket").applyInArrow(_repeated, "block bigint, bucket bigint, low binary")
                        .groupBy("block").agg(F.collect_list(F.struct("bucket", "low")).alias("wanted")), "lpf-anchors")
    asked = materialize(blocks.join(again, "block", "left"), "lpf-asked")
    wanted = asked.where("wanted is not null")
    found = spread(wanted).mapInArrow(_send_sites(folder, n_anchor, n_site),
                                      "bucket bigint, block bigint, h binary, name binary, doc binary, lead binary, more binary, text binary")
    told = found.groupBy("bucket").applyInArrow(_earliest(), "block bigint, h binary, name binary, `from` binary, `to` binary, doc binary") \
        .groupBy("block").agg(F.collect_list(F.struct("h", "name", "from", "to", "doc")).alias("stretches"))
    told = materialize(told, "lpf-told")
    done = spread(asked.join(told, "block", "left")).mapInArrow(
        _remove(folder, n_anchor), "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, block bigint, row bigint, spans array<bigint>")
    return done.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
