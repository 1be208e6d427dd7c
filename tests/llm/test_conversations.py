"""The prefix trie against a trie of tuples, the double array by itself, and the query against its SQL and contract."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from blockyard.llm import conversations as C

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth bigint, n string, node string, least bigint"


def _table(spark, rows):
    """A conversations table with extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA)


def _sequences(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in by.items()}


def _rebuilt(seqs):
    out = {}
    for c, s in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = seqs.get(c - int(np.fmod(c, 100)), [])[:h] + s[h:]
    return out


def _brute(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    rows = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(seqs[c]) == len(p)))
        rows.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids.get(p, 0), leaves[p], saved[p],
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, rows))


def _trie(df):
    turns = C.numbered_turns(df)
    return C.prefix_trie(turns.select("conv_id").distinct(), turns.withColumn("depth", F.col("i") + 1).drop("i"))


def _rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def _some(seed, n=150, longest=9):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for k in range(int(r.integers(0, longest))):
            rows.append((c * 37 % 1000 - 200, k if r.random() < 0.9 else None, ["user", "assistant", None][int(r.integers(3))] if k else "system",
                         ["", "hi", None, "é" * 3, f"own {c}"][min(4, int(r.integers(3 + k)))]))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_trie_equals_brute_force(spark, monkeypatch, seed):
    if seed:  # small pieces and parts: prefixes over several storeys, nodes of several shards, ids over several chunks
        monkeypatch.setattr(C, "STOREY", 2), monkeypatch.setattr(C, "PIECES", 7), monkeypatch.setattr(C, "IDS", 50)
    rows = _some(seed)
    assert _rows(_trie(_table(spark, rows))) == _brute(_sequences(rows))


def test_long_and_repeated_conversations(spark):
    rows = [(c, k, "user", f"turn {k % 50}") for c in range(3) for k in range(700)]        # three copies over eleven storeys
    rows += [(10 + c, k, "user", f"turn {k % 50}") for c in range(40) for k in range(3 + c % 2)]
    rows += [(99, 0, "user", "turn 0"), (99, 0, "user", "turn 0"), (99, 0, "assistant", "x"), (None, 0, "user", "lost")]
    assert _rows(_trie(_table(spark, rows))) == _brute(_sequences(rows))


def test_empty_table(spark):
    assert _trie(_table(spark, [])).count() == 0
    assert C.prefix_trie(*C.rebuilt_turns(C.numbered_turns(_table(spark, [])), F.col("conv_id"), F.lit(1), 1)).count() == 0


def test_turns_are_numbered_over_ranges(spark):
    r = np.random.default_rng(5)
    rows = [(1, int(x), "user", f"t{i}") for i, x in enumerate(r.integers(0, 400, 3000))] + [(2, None, None, None)] * 5
    got = C.numbered_turns(_table(spark, rows).repartition(7)).collect()
    assert sorted(x["i"] for x in got if x["conv_id"] == 1) == list(range(3000))
    assert sorted(x["i"] for x in got if x["conv_id"] == 2) == list(range(5))


@pytest.mark.parametrize("seed", range(5))
def test_double_array(seed):
    r = np.random.default_rng(seed)
    paths = sorted({tuple(r.integers(0, [3, 40, 2000][int(r.integers(3))], int(r.integers(1, 6))).tolist()) for _ in range(800)} | {(s,) for s in range(700)})
    sizes = np.array([len(p) for p in paths])
    columns = [np.array([p[k] if len(p) > k else -1 for p in paths]) for k in range(sizes.max())]
    trie = C.DoubleArray(columns, sizes, 2000)
    known = {(): 0}
    for p in paths:
        at = 0
        for d, s in enumerate(p, 1):
            to = int(trie.step(np.array([at]), np.array([s]))[0])
            assert to > 0 and trie.check[to] == at and known.setdefault(p[:d], to) == to
            at = to
    assert len(set(known.values())) == len(known) == (trie.check != -1).sum()
    for p, at in list(known.items())[:300]:  # no child that is not there
        wrong = [s for s in range(0, 2000, 7) if (*p, s) not in known]
        assert (trie.step(np.full(len(wrong), at), np.array(wrong)) == -1).all()
    assert len(trie.check) < 40 * len(known) + 4000


def test_query_equals_contract(spark, tmp_path):
    from blockyard.llm.queries import ORACLES, QUERIES
    rows = _some(3, 300, 12)
    _table(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op11_prefix_trie"](spark, str(tmp_path))
    assert _rows(got) == _brute(_rebuilt(_sequences(rows)))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(str, con.sql(ORACLES["op11_prefix_trie"]).fetchall())) == _rows(got)


def test_query_equals_sql(spark):
    from blockyard.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    rel = con.sql(ORACLES["op11_prefix_trie"])
    got = QUERIES["op11_prefix_trie"](spark, SF)
    assert rel.columns == got.columns and sorted(map(str, rel.fetchall())) == _rows(got)
