"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeated rows, an empty
table, and columns whose names clash with results."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from samples import LONG, MESSY, PASSAGE, documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts(spark, messy, nothing):
    from blockyard.llm.token_counts import attribute, section_tokens
    t = Tokenizer.from_file(BPE)
    got = section_tokens(messy, BPE).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect()
    got = {r["doc_id"]: r["n"] for r in got}
    for i, text, *_ in MESSY:
        copies = sum(x[0] == i for x in MESSY)
        assert got[i] == copies * len(t.encode(text or "", add_special_tokens=False).ids)
    assert section_tokens(nothing, BPE).count() == 0
    begin, stop = np.array([0, 2, 5, 9]), np.array([2, 5, 9, 9])
    starts, ends = np.array([0, 3]), np.array([3, 8])
    assert attribute(begin, stop, starts, ends, "first").tolist() == [2, 1]
    assert attribute(begin, stop, starts, ends, "last").tolist() == [1, 2]
    assert attribute(begin, stop, starts, ends, "largest").tolist() == [1, 2]
    assert np.allclose(attribute(begin, stop, starts, ends, "share"), [1 + 1 / 3, 2 / 3 + 3 / 4])


@pytest.mark.parametrize("text", ["", " ", "a  b\n\n c", "foo<|endoftext|> bar <|endoftext|>b", "a\t b", "a  b", "日本 語 テ\n ü😀 'll don't", LONG[:5000]])
def test_encoder_equals_library(text):
    from blockyard.llm.bpe import Encoder
    want = Tokenizer.from_file(BPE).encode(text, add_special_tokens=False)
    ids, begin, stop = Encoder(BPE, spans=True).encode(text)
    assert ids.tolist() == want.ids and list(zip(begin.tolist(), stop.tolist())) == want.offsets
    assert Encoder(BPE).encode(text).tolist() == want.ids


def test_encoder_learns_for_many_texts_at_once():
    from blockyard.llm.bpe import Encoder
    library, encoder, calls = Tokenizer.from_file(BPE), Encoder(BPE), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    texts = [f"Wort{i} neu{i}é.\nund{i}\n\nmehr  {i} \n\n{i % 7}" for i in range(500)] + ["", " ", "\n", "\n\n", " \n\nx", "a\n\n<|endoftext|>b", "a\n\n\nb "]
    got = list(encoder.encode_all(texts))
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == 1
    assert [g.tolist() for g in encoder.encode_all(texts)] == [g.tolist() for g in got] and len(calls) == 1


def _fingerprint(text):
    w = WORDS.findall((text or "").translate(LOWER))
    s = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, messy, nothing):
    from blockyard.llm.simhash import keep_first, simhash_components
    rows = simhash_components(messy).collect()
    assert len(rows) == len(MESSY)
    want = {i: _fingerprint(t) for i, t, *_ in MESSY}
    assert all(r["fingerprint"] % (1 << 64) == want[r["key"]] for r in rows)
    label = {r["key"]: r["component_id"] for r in rows}
    assert label[8] == label[7] == label[9] == 7 and label[10] == label[3] == label[5] == 3 and label[14] == 2
    kept = sorted(r["doc_id"] for r in keep_first(messy).collect() if r["doc_id"] is not None)
    assert kept == sorted(set(kept)) and {7, 3, 2} <= set(kept) and not {8, 9, 10, 5, 14} & set(kept)
    assert simhash_components(nothing).count() == 0 and keep_first(nothing).columns == nothing.columns


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
def test_masks_cover(radius):
    from blockyard.llm.simhash import covering_masks
    masks, r = covering_masks(radius), np.random.default_rng(0)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        bits = sum(1 << int(b) for b in r.choice(64, radius, replace=False))
        assert any(not m & bits for m in masks)


def test_simhash_large_bucket(spark):
    """Links in buckets that are dealt out as pairs of pieces, against all pairs."""
    from blockyard.llm.common import components
    from blockyard.llm.simhash import near_links
    r = np.random.default_rng(1)
    base = int(r.integers(1 << 62))
    values = sorted({base ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 6)), replace=False)) for _ in range(300)})
    values = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    got = {x["node"]: x["root"] for x in components(near_links(df, 3, piece=40)).collect()}
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if bin((a ^ b) % (1 << 64)).count("1") <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    assert all(got.get(v, v) == root[v] for v in values)


def test_mixing(spark, messy, nothing):
    from blockyard.llm.mixing import in_training_order, mixing_plan
    r = np.random.default_rng(2)
    rows = [(i, " ".join("w" * int(r.integers(1, 200)) for _ in range(int(r.integers(0, 300)))) if i % 50 else None, "en", f"s{int(r.integers(0, 5)) * (i % 3 > 0)}" if i % 7 else None)
            for i in range(1500)]
    plan = mixing_plan(documents(spark, rows)).collect()
    assert len(plan) == 1500
    by = {}
    for p in plan:
        s = by.setdefault(p["source"], [p["source_size"], p["target"], 0, 0])
        s[2] += p["taken"]
        s[3] += p["size"]
        assert p["taken"] in (0, p["size"], 2 * p["size"]) and len(p["positions"]) <= 2 and all(0 <= x <= 1 for x in p["positions"])
    assert all(s[0] == s[3] and abs(s[2] - s[1]) <= 2 + 0.001 * s[1] for s in by.values())
    # the targets: level by level
    order = sorted(by, key=lambda s: (s is None, s))
    weight = dict(zip(order, [3, 1, 2] * 9))
    left, open_, want = 1.5 * sum(s[0] for s in by.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * by[s][0]}
        for s in over or open_:
            want[s] = 2 * by[s][0] if over else share[s]
        if not over:
            break
        left -= sum(want[s] for s in over)
        open_ -= over
    assert all(abs(want[s] - by[s][1]) < 1e-6 * (1 + want[s]) for s in order)
    out = in_training_order(mixing_plan(documents(spark, rows))).collect()
    assert [x["position"] for x in out] == sorted(x["position"] for x in out)
    assert sum(x["size"] for x in out) == sum(p["taken"] for p in plan)
    # early readings come more often from sources whose weight falls, late ones where it rises
    falls, rises = ([x["position"] for x in out if order.index(x["source"]) % 3 == k] for k in (0, 2))
    assert np.mean(falls) < np.mean(rises)
    assert mixing_plan(messy).count() == len(MESSY) and mixing_plan(nothing).count() == 0


def test_mixing_fills_beside_a_long_document(spark):
    from blockyard.llm.mixing import mixing_plan
    rows = [(i, " ".join([f"w{i}"] * 10), "en", "s") for i in range(1000)] + [(10_001, "x " * 20_000, "en", "s")]  # 35th in the order
    plan = mixing_plan(documents(spark, rows), budget=1 / 6).collect()
    assert plan[0]["target"] == pytest.approx(5000) and sum(p["taken"] for p in plan) == 5000


def test_mixing_places_readings_exactly(spark, nothing):
    from blockyard.llm.mixing import mixed_rows, mixing_plan
    r = np.random.default_rng(8)
    sizes = [int(x) for x in r.integers(0, 30, 400)]
    sizes[50] = 3000
    rows = [(i, f"w{i} " * n, "en", "ab"[i % 3 > 0]) for i, n in enumerate(sizes)] + [(None, "y", None, None)]
    docs = documents(spark, rows)
    names = docs.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text")).bitwiseXOR(F.lit(-(1 << 63))).alias("u")).collect()
    order = {n["doc_id"]: k for k, n in enumerate(sorted(names, key=lambda n: n["u"]))}
    plan = {p["doc_id"]: p for p in mixing_plan(docs).collect()}
    for source, ends in (("a", (4.0, 2.0)), ("b", (1.0, 1.0))):
        mine = sorted((p for p in plan.values() if p["source"] == source), key=lambda p: order[p["doc_id"]])
        area, read = lambda t: ends[0] * t + (ends[1] - ends[0]) * t * t / 2, 0
        for j in range(max(len(p["positions"]) for p in mine)):
            for p in mine:
                if len(p["positions"]) > j:
                    assert area(p["positions"][j]) / area(1) == pytest.approx(min(1, read / p["target"]), abs=1e-9)
                    read += p["size"]
    want = sorted((t, -1 if i is None else i) for i, p in plan.items() for t in p["positions"])
    got = mixed_rows(docs).collect()
    assert [(x["position"], -1 if x["doc_id"] is None else x["doc_id"]) for x in got] == want
    assert all(x["text"] == plan[x["doc_id"]]["text"] for x in got) and got[0].asDict().keys() == {*docs.columns}
    assert mixed_rows(nothing).count() == 0


def test_toxicity(spark, messy, nothing):
    from blockyard.llm.toxicity import Options, drop_toxic, held_out, toxicity
    r = np.random.default_rng(3)
    text = lambda bad: " ".join([f"w{int(x)}" for x in r.integers(0, 300, 40)] + ["vile" if int(r.integers(2)) else "nastyish"] * bad)
    rows = [(i, text(i % 4 == 0), ("en", "de")[i % 2], "s") for i in range(800)]
    docs = documents(spark, rows + MESSY_KEYS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(800)] + [(3, 0, None), (None, 1, 1)], "doc_id bigint, toxic int, lang int")
    got = toxicity(docs, labels, options=Options(steps=200)).collect()
    assert len(got) == len(rows) + len(MESSY_KEYS)
    for g in got:
        if g["doc_id"] is not None and g["doc_id"] < 800:
            assert g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2)
    unseen = [g for g in got if g["held_out"] and g["doc_id"] < 800]
    assert np.mean([(g["score"] >= 0.3) == (g["doc_id"] % 4 == 0) for g in unseen]) > 0.95
    assert all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.3) for g in got)
    clean = drop_toxic(docs, labels, options=Options(steps=200))
    assert clean.columns == docs.columns and clean.count() < docs.count()
    none = labels.where("false")
    assert {g["score"] for g in toxicity(messy, none).collect()} == {0.0} and toxicity(nothing, none).count() == 0
    assert drop_toxic(messy, none).count() == len(MESSY)
    assert spark.range(1).select(held_out(F.lit(None).cast("long")).alias("h")).first()["h"] is False


MESSY_KEYS = [(i if i is None else i + 1000, t, lang, s) for i, t, lang, s in MESSY]


def test_network_long_texts():
    """Scoring in pieces equals scoring at once."""
    from blockyard.llm.toxicity import BUCKETS, Network, Options, _score
    model = Network(Options()).compiled()
    r = np.random.default_rng(4)
    sizes = [0, 1, 2, 500, 3, 0, 90]
    flat = np.concatenate([np.stack([r.integers(0, BUCKETS, n), r.integers(BUCKETS, 2 * BUCKETS, n)], 1).ravel() for n in sizes])
    ends = 2 * np.r_[0, np.cumsum(sizes)]
    assert np.allclose(_score(model, flat, ends), _score(model, flat, ends, piece=64))


def test_warc(spark, tmp_path):
    from blockyard.llm.warc import _member, read_archives, record, records, write_pages
    pages = [(1, "http://a", "<p>x</p>"), (9, "http://b", "<p>x</p>"), (4, None, "<p>x</p>"), (5, "http://c", None), (6, "http://d", ""), (None, "u", "<p>x</p>"),
             (7, "http://e\r\nWARC-Type: fake", "é" * 300_000), (9, "http://b", "<p>x</p>")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id bigint, url string, html string, payload string")
    folder = write_pages(df, f"file://{tmp_path}/w")
    got = read_archives(spark, folder).collect()
    assert len(got) == len(pages)
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    by = {}
    for g in got:
        by.setdefault(g["record_id"].split(":")[-1], []).append(g)
    for i, _, html in pages:
        raw = (html or "").encode()
        for g in by["none" if i is None else str(i)]:
            assert g["payload_digest"] == sha(raw) and g["payload_bytes"] == len(raw)
            last = max((p[0] for p in pages if (p[2] or "") == (html or "") and p[0] is not None), default=None)
            assert g["record_type"] == ("response" if i == last else "revisit")
            assert bytes(g["payload"]) == raw if i == last else g["payload"] is None and g["refers_to"] == f"urn:page:{last}"
    some = read_archives(spark, folder, payload=False).where("record_type = 'revisit' and payload_bytes >= 1").select("record_id", "payload")
    assert some.count() == 3 and {r["payload"] for r in some.collect()} == {None}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0] or "record_type" not in plan.split("BatchScan")[0]
    assert read_archives(spark, write_pages(df.where("false"), f"file://{tmp_path}/none")).count() == 0
    # archives of others: plain, and gzip without lengths
    import gzip
    import io

    class Archive(io.BytesIO):
        def size(self):
            return len(self.getvalue())
    one = record("response", "urn:page:1", "u", sha(b"abc"), 3, b"abc", None)
    for data, packed in ((one * 3, False), (gzip.compress(one) * 3, True), (_member(one) * 3, True)):
        assert [r["payload"] for r in records(Archive(data), packed)] == [b"abc"] * 3
        assert [r["payload"] for r in records(Archive(data), packed, payload=False)] == [None] * 3
    odd = one.replace(b"urn:page:1", b"urn:page:\xff\xfe", 1)  # bytes that are no UTF-8
    assert [r["payload"] for r in records(Archive(odd * 3), False)] == [b"abc"] * 3
    with pytest.raises(ValueError, match="digest"):
        list(records(Archive(one.replace(b"abc\r\n", b"abd\r\n")), False))


def test_embeddings(spark):
    from blockyard.llm.embeddings import near_vectors, plan_tables
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 16)).astype(np.float32)
    x[100:220] = x[100] + 0.08 * r.normal(size=(120, 16))
    x[300:330] = x[5]
    vectors = [v.tolist() for v in x] + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3, [1e30] * 16, [2e30] * 16]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(5, vectors[5], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, node int")
    got = near_vectors(df).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(v, float)) for i, v, _ in rows if v and None not in v and len(v) == 16 and np.isfinite(v).all() and np.any(v)]
    u = np.stack([v / np.linalg.norm(v) for _, v in good])
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    want = {}
    root = np.array([i for i, _ in good])
    for _ in range(len(good)):
        root = np.minimum(root, np.where(link, root[None, :], 10**9).min(axis=1))
    for (i, _), n, c in zip(good, link.sum(axis=1), root):
        want[i] = (n, c)
    found = sum(g["n_links"] for g in got)
    assert link.sum() * 0.95 <= found <= link.sum()
    for g in got:
        n, c = want.get(g["vec_id"], (0, g["vec_id"]))
        assert g["n_links"] <= n and g["kept"] == (g["vec_id"] == g["component_id"])
    assert near_vectors(df.where("false")).count() == 0
    assert plan_tables(51_282, 64, 0.95)[2] == 0 and plan_tables(10**9, 64, 0.95)[2] > 0


def test_embeddings_of_two_lengths(spark):
    from blockyard.llm.embeddings import near_vectors
    r = np.random.default_rng(6)
    vectors = [v.tolist() for v in np.concatenate([r.normal(size=(1100, 8))])] + [v.tolist() for v in r.normal(size=(20, 12))]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(2000 + i, vectors[1100 + i]) for i in range(20)]
    got = {g["vec_id"]: g for g in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), cosine=0.99).collect()}
    for i in range(20):
        assert got[1100 + i]["n_links"] == got[2000 + i]["n_links"] == 1 and got[2000 + i]["component_id"] == 1100 + i


@pytest.mark.parametrize("common", [0.0, 0.8, 0.9])
def test_recall_with_a_common_mean(common):
    from blockyard.llm.embeddings import _unit, learn_rotation, plan_tables, sample_pairs
    r = np.random.default_rng(7)
    dim, n = 64, 4000
    axis = np.eye(dim)[0]
    draw = lambda k: _unit((np.sqrt(common) * axis + np.sqrt((1 - common) / dim) * r.normal(size=(k, dim))).ravel(), dim)
    x = draw(n)
    mean, rotation = learn_rotation(x)
    b, m, radius = plan_tables(51_282, rotation.shape[1], 0.95, sample_pairs(x, mean, rotation, 0.95))
    a, step = draw(n), r.normal(size=(n, dim))
    step -= (step * a).sum(axis=1, keepdims=True) * a
    y = 0.95 * a + np.sqrt(1 - 0.95 ** 2) * step / np.linalg.norm(step, axis=1, keepdims=True)
    differ = ((a - mean) @ rotation > 0) != ((y - mean) @ rotation > 0)
    assert (differ[:, :b * m].reshape(n, m, b).sum(axis=2).min(axis=1) <= radius).mean() >= 0.93


def test_decontamination(spark, messy, nothing):
    from blockyard.llm.decontaminate import contamination, drop_contaminated
    items = [("i1", PASSAGE), ("i2", "Äpfel été X"), ("i3", None), ("i4", "..."), ("i10", "x"), (None, PASSAGE + " zz"), ("i1", PASSAGE)]
    bench = spark.createDataFrame([(*i, "y") for i in items], "item_id string, text string, doc_id string")
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: token.findall((t or "").translate(LOWER))
    wins = {}
    for i, t in items:
        w = cut(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[s:s + 13]), set()).add(i)
    rows = contamination(messy, bench).collect()
    assert len(rows) == len(MESSY)
    text = {i: t for i, t, *_ in MESSY}
    for g in rows:
        w, hit, ids = cut(text[g["doc_id"]]), set(), set()
        for win, owners in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    ids |= owners - {None}
        assert (g["n_words"], g["n_hit"], g["n_items"]) == (len(w), len(hit), len(ids))
        assert g["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert g["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert drop_contaminated(messy, bench).columns == messy.columns
    assert contamination(nothing, bench).count() == 0
    assert not any(g["contaminated"] for g in contamination(messy, bench.where("false")).collect())


def _substrings(rows):
    data = [((2**63 - 1) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for p in range(len(b) - 49):
            k = b[p:p + 50]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        out.append((None if i == 2**63 - 1 else i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substrings(spark, messy, nothing, monkeypatch):
    from blockyard.llm import substrings
    r = np.random.default_rng(6)
    rows = [(i, t) for i, t, *_ in MESSY]
    for i in range(60):
        parts = [PASSAGE[int(r.integers(0, 30)):int(r.integers(50, 92))], "ab" * int(r.integers(0, 60)), "é" * int(r.integers(0, 40)),
                 "".join(r.choice(list("abc "), int(r.integers(0, 80)))), "z" * int(r.integers(0, 120))]
        r.shuffle(parts)
        rows.append((100 + int(r.integers(0, 50)), "".join(parts)))
    got = [tuple(x) for x in substrings.repeated_spans(documents(spark, [(i, t, "", "") for i, t in rows])).drop("spans").collect()]
    assert sorted(got, key=str) == _substrings(rows)
    assert substrings.repeated_spans(nothing).count() == 0


def test_token_files(spark, messy, nothing, tmp_path):
    import pyarrow.fs as pafs
    import zstandard
    from blockyard.llm.token_files import FileReader, ids_crc32, read_documents, write_token_files
    manifest = write_token_files(messy, BPE, f"file://{tmp_path}/t", rows_per_file=3)
    got = [tuple(r) for r in read_documents(manifest, ids_crc32, "c bigint").orderBy("start").collect()]
    t = Tokenizer.from_file(BPE)
    rows = sorted(((i is not None, i, x or "") for i, x, *_ in MESSY), key=lambda r: (r[0], r[1] or 0, r[2]))
    start, want = 0, []
    for _, i, x in rows:
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [2], np.uint32)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    path = manifest.orderBy("part").first()["file"].removeprefix("file://")
    reader = FileReader(pafs.LocalFileSystem().open_input_file(path))
    assert ids_crc32(reader.document(1)) == want[1][3]
    with open(path, "rb") as f:  # any decoder reads the ids
        data = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert len(data) >= 4 * want[0][2]
    broken = bytearray(open(path, "rb").read())
    reader.frames[0] = (*reader.frames[0][:2], reader.frames[0][2] ^ 1)
    with pytest.raises(ValueError, match="checksum"):
        reader.frame(0)
    assert broken and read_documents(write_token_files(nothing, BPE, f"file://{tmp_path}/n")).count() == 0


def _jump(k, n):
    k, b, j = k % (1 << 64), -1, 0
    while j < n:
        b, k = j, (k * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 8, 9, 100, 5000])
def test_jump_hash(spark, shards):
    from blockyard.llm.sharding import jump_hash
    keys = [*range(40), -1, -(1 << 63), (1 << 63) - 1, 123456789012345678, None]
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", jump_hash(F.col("k"), shards).alias("s")).collect()
    assert all(r["s"] == _jump(r["k"] or 0, shards) for r in got)


def test_slots(spark, messy, nothing):
    from blockyard.llm.sharding import assign_shards, number_slots
    out = number_slots(assign_shards(messy, "doc_id", 4), "doc_id").collect()
    assert len(out) == len(MESSY)
    for s in range(4):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert number_slots(assign_shards(nothing, "doc_id", 4), "doc_id").count() == 0


def test_encoder_cuts_long_texts(monkeypatch):
    """Texts with any white space, in blocks of a few characters, equal one call of the library."""
    from blockyard.llm import bpe
    monkeypatch.setattr(bpe, "BLOCK", 7)
    r = np.random.default_rng(4)
    library, encoder = Tokenizer.from_file(BPE), bpe.Encoder(BPE, spans=True)
    for _ in range(300):
        text = "".join(r.choice(list("ab '.1é日") + [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\xa0", "\u2003", " \t", "\u3000 "], 40))
        want = library.encode(text, add_special_tokens=False)
        ids, begin, stop = encoder.encode(text)
        assert ids.tolist() == want.ids and list(zip(begin.tolist(), stop.tolist())) == want.offsets, repr(text)


def test_sections_against_all_tokens(spark, messy):
    """Tokens per line of every text, each token given to the line that holds most of it (the first of equal ones)."""
    from blockyard.llm.token_counts import section_tokens
    library = Tokenizer.from_file(BPE)
    rows = messy.union(documents(spark, [(60, "one\ntwo  \n\n three\n", "en", "a"), (61, "é\n日本\n😀 x\n\n\n\ny", "en", "a")]))
    got = {}
    for x in section_tokens(rows, BPE).collect():
        got.setdefault((x["doc_id"], x["section"]), []).append((x["start"], x["end"], x["n_tokens"]))
    want = {}
    for r in rows.select("doc_id", "text").collect():
        text = r["text"] or ""
        lines = text.splitlines(keepends=True) if not set(text) & set("\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029") else text.split("\n")
        ends = np.cumsum([len(x) for x in lines]).tolist() or [0]
        counts = [0] * len(ends)
        for a, b in library.encode(text, add_special_tokens=False).offsets:
            share = [min(b, e) - max(a, s) for s, e in zip([0, *ends], ends)]
            counts[int(np.argmax(share))] += 1
        for i, (s, e) in enumerate(zip([0, *ends], ends)):
            want.setdefault((r["doc_id"], i), []).append((s, e, float(counts[i])))
    assert got == want


def test_vectors_against_brute_force_through_the_tables(spark):
    """3,000 vectors with a hot cluster and pairs planted around the threshold: no link is wrong, and nine in ten of all
    links, and of those just above the threshold, are found."""
    from blockyard.llm.embeddings import near_vectors
    r = np.random.default_rng(11)
    dim = 48

    def beside(a, cosine):
        step = r.normal(size=a.shape)
        step -= (step * a).sum(axis=1, keepdims=True) * a / (a * a).sum(axis=1, keepdims=True)
        step /= np.linalg.norm(step, axis=1, keepdims=True)
        a = a / np.linalg.norm(a, axis=1, keepdims=True)
        return cosine[:, None] * a + np.sqrt(1 - cosine[:, None] ** 2) * step
    for mean in (0.0, 3.0):  # with a large common mean, too
        x = r.normal(size=(1800, dim)) + mean * np.eye(dim)[0] * 3
        pairs = beside(x[:600], r.uniform(0.94, 0.97, 600))
        hot = beside(np.repeat(x[700:701], 600, axis=0), r.uniform(0.96, 0.999, 600))
        v = np.concatenate([x, pairs, hot])
        rows = [(i, w.tolist()) for i, w in enumerate(v)]
        got = {g["vec_id"]: g["n_links"] for g in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        near = u @ u.T >= 0.95
        np.fill_diagonal(near, False)
        want = near.sum(axis=1)
        found = np.array([got[i] for i in range(len(v))])
        assert (found <= want).all()
        assert found.sum() >= 0.9 * want.sum() and found[1800:2400].sum() >= 0.9 * want[1800:2400].sum()


@pytest.mark.parametrize("length", [1, 3, 8, 9, 16, 50])
def test_longest_previous_factors(length):
    """Suffix order, common prefixes, sources and earliest documents against all pairs."""
    from blockyard.llm.substrings import first_documents, longest_previous_factors, suffix_order
    r = np.random.default_rng(length)
    for letters in (1, 2, 3):
        text = r.integers(97, 97 + letters, 600).astype(np.uint8)
        text[300:400] = text[100:200]
        starts, doc = r.integers(0, 600 - length, 200), r.integers(0, 30, 200)
        w = [bytes(text[s:s + length]) for s in starts]
        order, common = suffix_order(text, starts, doc, length)
        assert [(w[i], doc[i]) for i in order] == sorted(zip(w, doc))
        for a, b, k in zip(order, order[1:], common[1:]):
            assert w[a][:k] == w[b][:k] and (k == length or w[a][k] != w[b][k])
        earliest = [min(d for d, x in zip(doc, w) if x == y) for y in w]
        lpf, source = longest_previous_factors(text, starts, doc, length)
        for i in range(200):
            assert (lpf[i] == length) == (earliest[i] < doc[i]) == (source[i] >= 0)
            assert source[i] < 0 or (w[source[i]] == w[i] and doc[source[i]] < doc[i])
        assert first_documents(text, starts, doc, length).tolist() == earliest


def test_mixing_takes_some_of_equal_rows(spark):
    """1,000 copies of a row of 10 words beside 50 others: as many as fit are taken, in the plan and in the order."""
    from blockyard.llm.mixing import mixed_rows, mixing_plan
    rows = [(1, "w " * 10, "en", "s")] * 1000 + [(100 + i, f"x{i} " * 11, "en", "s") for i in range(50)]
    docs = documents(spark, rows).repartition(7)
    plan = mixing_plan(docs).collect()
    assert len(plan) == len(rows)
    target, size = plan[0]["target"], plan[0]["source_size"]
    assert size == 10_550 and target == 1.5 * size
    taken = sum(p["taken"] for p in plan)
    assert abs(taken - target) <= 10 and all(p["taken"] in (p["size"], 2 * p["size"]) and len(p["positions"]) == p["taken"] // p["size"] for p in plan)
    again = mixing_plan(documents(spark, rows).repartition(3)).collect()
    assert sorted((p["doc_id"], p["taken"], p["positions"]) for p in again) == sorted((p["doc_id"], p["taken"], p["positions"]) for p in plan)
    out = mixed_rows(docs).collect()
    assert len(out) == sum(len(p["positions"]) for p in plan)
    assert sorted((r["doc_id"], r["position"]) for r in out if r["doc_id"] > 1) == sorted((p["doc_id"], x) for p in plan if p["doc_id"] > 1 for x in p["positions"])
    assert sum(r["doc_id"] == 1 for r in out) == sum(len(p["positions"]) for p in plan if p["doc_id"] == 1)
