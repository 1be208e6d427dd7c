"""The rule ensemble: statistics against plain Python, the lasso against its optimality conditions, compiled rules against
numpy, held-out accuracy, and messy input."""

import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockyard.llm import quality as Q
from samples import MESSY, documents

SF = "/root/testdata/sf0.01"


def _plain(text):
    t = text or ""
    w, n = re.findall(r"[^\x20\x09-\x0D]+", t), len(t)
    lines = [x for x in t.split("\n") if x.strip(" ")]
    part = lambda k, of: k / of if of else 0.0
    kind = lambda f: part(sum(map(f, t)), n)
    cat = unicodedata.category
    return {"chars": n, "words": len(w), "word_length": part(sum(map(len, w)), len(w)), "longest_word": max(map(len, w), default=0),
            "distinct_words": part(len(set(w)), len(w)), "repeated_words": part(sum(a == b for a, b in zip(w, w[1:])), len(w)),
            "wordless": part(sum(not any(cat(c)[0] == "L" for c in x) for x in w), len(w)), "lines": len(lines),
            "distinct_lines": part(len(set(lines)), len(lines)),
            "closed_lines": part(sum(bool(re.search(r"[.!?:;\"'…。]\s*$", x)) for x in lines), len(lines)),
            "letters": kind(lambda c: cat(c)[0] == "L"), "capitals": kind(lambda c: cat(c) == "Lu"), "digits": kind(lambda c: cat(c) == "Nd"),
            "stops": kind(lambda c: c in ".,;:!?"), "symbols": kind(lambda c: cat(c)[0] == "S" or c in "#%&*@/\\_{}[]")}


def test_statistics(spark):
    texts = [t for _, t, *_ in MESSY] + ["A a a.\nA a a.\n\n  \nB # $$ 12 | no\n", "x {y} [z] _ \\ / @ é É 日本。", "!!!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", Q.statistics(F.col("t")).alias("s")).collect():
        want = _plain(texts[r["i"]])
        assert r["s"].asDict().keys() == want.keys()
        assert all(abs(r["s"][k] - want[k]) < 1e-12 for k in want), (texts[r["i"]], r["s"], want)


def test_lasso_is_optimal():
    r = np.random.default_rng(0)
    a = (r.random((400, 12)) < 0.4).astype(float)
    y = (r.random(400) < 1 / (1 + np.exp(-(2 * a[:, 0] - 3 * a[:, 1])))).astype(float)
    for strength in (0.001, 0.02, 0.08):
        w = Q.lasso_logistic(a, y, strength, 4000)
        grad = a.T @ (1 / (1 + np.exp(-(w[0] + a @ w[1:]))) - y) / len(y)
        assert abs((1 / (1 + np.exp(-(w[0] + a @ w[1:]))) - y).mean()) < 1e-6
        on = w[1:] != 0
        assert np.allclose(grad[on], -strength * np.sign(w[1:][on]), atol=1e-6) and (abs(grad[~on]) <= strength + 1e-6).all()


def test_rules_are_tree_paths_and_compile(spark):
    r = np.random.default_rng(1)
    x = r.random((600, len(Q.STATISTICS)))
    y = ((x[:, 3] > 0.4) & (x[:, 5] <= 0.8)).astype(float)
    o = Q.Options(trees=8, steps=150)
    rules = Q.tree_rules(x, y, o)
    assert rules and all(1 <= len(rule) <= o.depth and all(lo < hi for _, lo, hi in rule) for rule in rules)
    assert rules == Q.tree_rules(x, y, o)
    model = Q.fit_rules(x, y, x[:100], y[:100], o)
    assert 0 < len(model.rules) < len(rules) and ((model.score(x) > 0.5) == y).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"{s} double" for s in Q.STATISTICS))
    assert np.allclose([z[0] for z in df.select(model.column()).collect()], model.score(x))
    assert len(model.describe()) == len(model.rules)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_messy(spark, messy, nothing):
    labels = _labels(spark, [(7, 1, 0), (7, 1, 1), (8, 0, 0), (11, 1, None), (12, 1, 0), (None, 0, 0), (14, None, 0), (2, 9, 0), (99, 1, 0)])
    rows = Q.quality(messy, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, *_ in MESSY)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 5 == 0)
    assert Q.quality(nothing, labels).count() == 0
    assert {r["score"] for r in Q.quality(messy, _labels(spark, [])).collect()} == {0.5}


def test_rows_of_one_key_are_learned_from_once(spark):
    docs = documents(spark, [(1, f"text {i}.", "en", "a") for i in range(300)] + [(2, "bad | bad | #### bad", "en", "a")])
    rows = Q.quality(docs, _labels(spark, [(1, 1, 0), (2, 0, 0)])).collect()
    assert len(rows) == 301


def test_query(spark):
    from blockyard.llm.queries import QUERIES
    got = {r["doc_id"]: r for r in QUERIES["op13_quality"](spark, SF).collect()}
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [k for k, r in got.items() if r["held_out"] and k in label]
    assert len(held) > 30 and np.mean([got[k]["predicted"] == label[k] for k in held]) > 0.95
    good, bad = ([got[k]["score"] for k in held if label[k] == y] for y in (1, 0))
    assert np.mean([[g > b for g in good] for b in bad]) > 0.97


@pytest.mark.parametrize("name", ["score"])
def test_score_needs_no_label_of_its_own(spark, name):
    """The scores of rows do not change with labels of held-out rows, language or source."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = Q.quality(docs, labels)
    b = Q.quality(docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x")),
                  labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert a.select("doc_id", name).exceptAll(b.select("doc_id", name)).isEmpty()
