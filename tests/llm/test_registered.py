"""The registered queries that have no SQL, on a whole small table, against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from blockyard.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1(spark, docs):
    library, got = Tokenizer.from_file(BPE), {}
    for r in QUERIES["op1_token_counts"](spark, SF).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["n_tokens"]))
    for i, d in docs.items():
        spans = sorted(got[i])
        assert sum(n for *_, n in spans) == len(library.encode(d["text"] or "", add_special_tokens=False).ids)
        assert [s for s, *_ in spans][1:] == [e for _, e, _ in spans][:-1] and spans[-1][1] == len(d["text"] or "")


def test_op2(spark, docs):
    def fingerprint(text):
        w = WORD.findall((text or "").translate(LOWER))
        s = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in s], np.uint64)
        return sum(1 << b for b in range(64) if len(h) and 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    prints = {i: fingerprint(d["text"]) for i, d in docs.items()}
    keys = sorted(prints)
    x = np.array([prints[i] for i in keys], np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    root = np.array(keys)
    for _ in keys:
        new = np.where(near, root[None, :], 1 << 60).min(axis=1)
        if (new == root).all():
            break
        root = new
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op2_simhash"](spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", int(c)) for i, c in zip(keys, root)}


def test_op3(spark, docs):
    by = {}
    rows = QUERIES["op3_mixing"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(WORD.findall(d["text"] or "")) and r["taken"] in (0, r["size"], 2 * r["size"])
        by.setdefault(d["source"], []).append(r)
    for rs in by.values():
        assert {r["source_size"] for r in rs} == {sum(r["size"] for r in rs)} and len({r["target"] for r in rs}) == 1
        # no single row could be switched to come nearer, so the gap is at most half the largest row
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 1 + max(r["size"] for r in rs) / 2
    assert abs(sum(rs[0]["target"] for rs in by.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-3


def test_op8(spark, docs):
    first = {}
    raw = {i: (d["text"] or "").encode() for i, d in docs.items()}
    for i in sorted(raw):
        for k in range(len(raw[i]) - 49):
            first.setdefault(raw[i][k:k + 50], i)
    got = {r["doc_id"]: r for r in QUERIES["op8_substring_dedup"](spark, SF).collect()}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())


def test_op9(spark, docs):
    library, start = Tokenizer.from_file(BPE), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op9_token_files"](spark, SF).collect()}
    for i in sorted(docs):
        ids = np.array([*library.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_op10(spark, docs):
    def jump(key, n):
        at, to = -1, 0
        while to < n:
            at, key = to, (key * 2862933555777941757 + 1) % 2**64
            to = int((at + 1) * (2**31 / ((key >> 33) + 1)))
        return at
    rows = QUERIES["op10_sharding"](spark, SF).collect()
    slots = {}
    for r in rows:
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 8), jump(r["doc_id"], 9)) and r["grown_shard"] in (r["shard"], 8)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())
