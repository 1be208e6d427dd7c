"""Chunked running aggregates equal plain windows, also when a key spans
many chunks (tiny widths) and one key holds most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockyard.operators.sequencing import chunk_of, row_number, running, running_many


def _data(spark):
    rows = []
    for i in range(2000):
        k = 0 if i % 3 else (i % 7)          # key 0 holds two thirds of the rows
        v = None if i % 11 == 0 else float((i * 37) % 101)
        rows.append((k, i, v))
    return spark.createDataFrame(rows, "k int, o long, v double")


def test_running_matches_window(spark):
    df = _data(spark)
    ch = chunk_of("o", 13)
    a = row_number(df, ["k"], ["o"], "rn", ch)
    a = running(a, ["k"], ["o"], F.col("v"), "cs", "sum", ch)
    a = running(a, ["k"], ["o"], F.col("v"), "ex", "sum", ch, inclusive=False)
    a = running_many(a, ["k"], ["o"], [(F.col("v"), "mx", "max"), (F.col("v"), "mn", "min", False)], ch)
    a = running_many(a, ["k"], ["o"], [(F.col("v"), "lv", "last")], ch)
    w = Window.partitionBy("k").orderBy("o")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    b = (a.withColumn("rn2", F.row_number().over(w))
         .withColumn("cs2", F.sum("v").over(upto)).withColumn("ex2", F.sum("v").over(before))
         .withColumn("mx2", F.max("v").over(upto)).withColumn("mn2", F.min("v").over(before))
         .withColumn("lv2", F.last("v", True).over(upto)))
    bad = b.filter("rn <> rn2 OR NOT (cs <=> cs2) OR NOT (ex <=> ex2) OR NOT (mx <=> mx2) "
                   "OR NOT (mn <=> mn2) OR NOT (lv <=> lv2)")
    assert bad.count() == 0
    assert b.count() == 2000


def test_global_row_number_without_key(spark):
    df = _data(spark)
    a = row_number(df, [], ["o"], "rn", chunk_of("o", 64)).filter("rn <> o + 1")
    assert a.count() == 0


def test_prev_matches_lag(spark):
    df = _data(spark)
    ch = chunk_of("o", 7)
    a = running_many(df, ["k"], ["o"], [(F.col("v"), "pv", "prev"), (F.col("o"), "po", "prev")], ch)
    w = Window.partitionBy("k").orderBy("o")
    b = a.withColumn("pv2", F.lag("v").over(w)).withColumn("po2", F.lag("o").over(w))
    assert b.filter("NOT (pv <=> pv2) OR NOT (po <=> po2)").count() == 0
