"""Periodic runs against a search of all periods, and the query against its contract."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from blockyard.llm import periodic as P
from samples import MESSY, documents

SF = "/root/testdata/sf0.001"


def _brute(w):
    """All runs (start, length, period) of one sequence: stretches of each period, without those of a smaller one."""
    found = {}
    for q in range(1, len(w) // P.POWER + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(P.LEAST, P.POWER * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def _collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def _sequences(seed):
    r = np.random.default_rng(seed)
    for _ in range(60):
        parts = []
        for _ in range(int(r.integers(0, 6))):
            kind, k = int(r.integers(4)), int(r.integers(1, 60))
            unit = r.integers(0, int(r.integers(1, 5)), k).tolist()
            if kind == 0:
                parts += unit
            elif kind == 1:
                parts += (unit * 12)[:int(r.integers(1, 10 * k + 1))]
            elif kind == 2:  # runs of runs
                parts += (([0] * k + [1] * int(r.integers(1, 9))) * 6)[:int(r.integers(1, 6 * k + 20))]
            else:
                a, b = [0], [0, 1]  # Fibonacci words are full of squares and cubes
                while len(b) < k * 4:
                    a, b = b, b + a
                parts += (b * 5)[:int(r.integers(1, 600))]
        yield parts


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    texts = list(_sequences(seed))
    ids = np.array([x for t in texts for x in t], np.int32)
    first = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = P.find_runs(ids, first)
    want = [(first[k] + s, first[k] + s + n, q) for k, t in enumerate(texts) for s, n, q in _brute(t)]
    assert sorted(map(tuple, got.tolist())) == sorted(map(tuple, np.array(want).reshape(-1, 3).tolist()))


def test_every_period_is_found():
    r = np.random.default_rng(9)
    texts = []
    for p in range(1, 300):
        unit = np.r_[r.integers(5, 10**6, p)]
        texts.append(np.r_[[1, 2], np.tile(unit, 6)[:max(P.LEAST, 4 * p)], [3]].tolist())
    first = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = P.find_runs(np.concatenate(texts).astype(np.int32), first)
    assert got[:, 2].tolist() == list(range(1, 300)) and (got[:, 0] == first[:-1] + 2).all()


def test_chosen_positions_are_consistent_and_sparse():
    r = np.random.default_rng(3)
    ids = r.integers(0, 3, 4000)
    for scale in (8, 16, 32):
        def chosen(x):
            h = np.array([zlib.crc32(bytes(x[i:i + scale].astype(np.uint8))) for i in range(len(x))], np.uint64)
            return set(P._synchronising(h, len(x) - np.arange(len(x)), np.zeros(len(x), bool), scale).tolist())
        whole, part = chosen(ids), chosen(ids[1000:2000])
        assert {i - 1000 for i in whole if 1000 <= i <= 2000 - 2 * scale} == part
        assert len(whole) < 4 * len(ids) / scale and max(np.diff(sorted(whole))) <= scale


def test_words_and_joined():
    texts = ["", None, " a  b\tc\n", "\x0b", "é ü\u00a0x\u2003y z", "a", "b "]
    w = P.Words(pa.array(texts))
    plain = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert np.diff(w.first).tolist() == [len(x) for x in plain]
    assert w.joined(np.ones(len(w.ids), bool)).to_pylist() == [" ".join(x) for x in plain]
    assert w.joined(np.zeros(len(w.ids), bool)).to_pylist() == [""] * len(texts)
    flat = [x for p in plain for x in p]
    assert all((flat[i] == flat[j]) == (w.ids[i] == w.ids[j]) for i in range(len(flat)) for j in range(len(flat)))
    part = P.Words(pa.array(texts).slice(2, 3))
    assert part.joined(np.ones(len(part.ids), bool)).to_pylist() == [" ".join(x) for x in plain[2:5]]


def test_messy(spark, messy, nothing, monkeypatch):
    rows = messy.union(documents(spark, [(50, "a b " * 40 + "tail", "en", "a"), (None, "x x x x x x", "en", "b")]))
    got = P.periodic_runs(rows).collect()
    assert len(got) == len(MESSY) + 2 and P.periodic_runs(nothing).count() == 0
    for r in got:
        if r["key"] == 50:
            assert [tuple(x) for x in r["runs"]] == [(0, 80, 2)] and r["collapsed"] == "a b tail" and r["n_words"] == 81
        if r["key"] in (3, 5, 10):
            assert r["n_words"] == 0 and r["runs"] == [] and r["collapsed"] == ""
    assert sorted(r["collapsed"] for r in got if r["key"] is None) == ["no key at all here", "x"]
    long = next(r for r in got if r["key"] == 12)
    w = next(t for i, t, *_ in MESSY if i == 12).split()
    assert [tuple(x) for x in long["runs"]] == [x for x in [(0, len(w), 2 * 977 * 13)] if x[1] >= 4 * x[2]]


def test_query(spark):
    from blockyard.llm.queries import QUERIES
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    found = 0
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n, h = len(w), zlib.crc32(str(d["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = _brute(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_runs"], r["start"], r["length"], r["period"]) == (n, len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(_collapse(w, runs).encode()).hexdigest()
        found += len(runs)
    assert found > 20
