"""The convolutional classifier: scores against a plain convolution, thresholds against all cuts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockyard.llm import toxicity as T


def test_scores_equal_a_plain_convolution():
    o = T.Options(dim=4, filters=3)
    net, r = T.Network(o), np.random.default_rng(1)
    net.c, net.shift = 0.3, -0.2
    for k in o.widths:
        net.b[k] += r.normal(size=o.filters).astype(np.float32)
    texts = [r.integers(0, T.BUCKETS, 2 * n) + np.tile([0, T.BUCKETS], n) for n in (0, 1, 2, 3, 7, 60, 500)]
    ends = np.r_[0, np.cumsum([len(t) for t in texts])]
    for piece in (1 << 16, 64):  # whole, and long texts in pieces
        got = T._score(net.compiled(), np.concatenate(texts).astype(int), ends, piece)
        for t, g in zip(texts, got):
            x = (net.emb[t[::2]] + net.emb[t[1::2]]) if len(t) else np.zeros((0, o.dim))
            h = []
            for k in o.widths:
                y = np.vstack([x, np.zeros((max(0, k - len(x)), o.dim))])
                h += (np.max([sum(y[s + j] @ net.w[k][j] for j in range(k)) for s in range(len(y) - k + 1)], axis=0) + net.b[k]).tolist()
            want = 1 / (1 + np.exp(-(np.maximum(h, 0) @ net.v + net.c + net.shift)))
            assert abs(g - want) < 1e-4


@pytest.mark.parametrize("seed", range(3))
def test_thresholds_make_the_fewest_errors(spark, seed):
    keys = [r[0] for r in spark.range(4000).where(T.calibration(F.col("id")) & ~T.held_out(F.col("id"))).collect()]
    r = np.random.default_rng(seed)
    rows = [(keys[0], "x", .1, 0), (keys[1], "x", .2, 1), (keys[2], "x", .8, 0), (keys[3], "x", .9, 1), (keys[4], "one", .5, 1)]
    for k in keys[5:200]:
        y = int(r.random() < 0.4)
        rows.append((k, f"l{int(r.integers(3))}", float(np.clip(r.normal(0.35 + 0.3 * y, 0.15), 0, 1)), y))
    scored = spark.createDataFrame([(k, lang, s) for k, lang, s, _ in rows], "key bigint, lang string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, _, y in rows], "doc_id bigint, toxic int")
    got = {x["_l"][1:]: x["threshold"] for x in T.language_thresholds(scored, labels, "doc_id", 0.3, 200).collect()}
    assert got.pop("one") == 0.3
    for lang, at in got.items():
        mine = [(min(int(s * 200), 199), y) for _, la, s, y in rows if la == lang]
        wrong = [sum((b >= cut) != bool(y) for b, y in mine) for cut in range(201)]
        cut = int(np.ceil(at * 200 - 1e-9))
        assert wrong[cut] == min(wrong), (lang, at)


def test_a_task_trains_and_the_driver_gets_the_weights_alone(spark, monkeypatch):
    o = T.Options(steps=30)
    r = np.random.default_rng(5)
    rows = [(i, " ".join([f"w{int(x)}" for x in r.integers(0, 50, 12)] + ["vile"] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string").repartition(7)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    learned = docs.where(~T.held_out(F.col("doc_id")) & ~T.calibration(F.col("doc_id"))).orderBy("doc_id").select("doc_id", T.word_ids(F.col("text")).alias("ids")).collect()
    y = np.array([x["doc_id"] % 3 == 0 for x in learned], np.float32)
    want = T.Network(o)
    want.train([np.array(x["ids"], np.int32) for x in learned], y)  # the sample is all learning rows, so no shift

    def refuse(*_):
        raise AssertionError("trained in the driver")
    monkeypatch.setattr(T.Network, "train", refuse)
    got = T.fit(docs, labels, "doc_id", "text", o)
    assert {k for k in got} == {"emb", "w", "b", "v", "c"}
    assert np.allclose(got["emb"], want.emb, atol=1e-5) and np.allclose(got["v"], want.v, atol=1e-5) and abs(got["c"] - want.c) < 1e-5
    assert all(np.allclose(got["w"][k], want.w[k], atol=1e-5) and np.allclose(got["b"][k], want.b[k], atol=1e-5) for k in o.widths)
    assert T.fit(docs, labels.where("toxic = 1"), "doc_id", "text", o) is None and T.fit(docs.where("false"), labels, "doc_id", "text", o) is None
