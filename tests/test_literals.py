"""Worked examples stated in the reference's report (lag and loss)."""

from blockyard.operators.broker import partition_lag


def _log(spark, parts):
    rows = []
    for p, start, end in parts:
        rows += [(p, start), (p, end - 1)]
    return spark.createDataFrame(rows, "partition int, offset long")


def test_lag_example(spark):
    log = _log(spark, [(0, 0, 82892), (1, 0, 82994)])
    commits = spark.createDataFrame([(0, 3987), (1, 3641)], "partition int, committed long")
    got = {r.partition: (r.lag, r.lost) for r in partition_lag(log, commits, by=["partition"]).collect()}
    assert got == {0: (78905, 0), 1: (79353, 0)}


def test_loss_example(spark):
    log = _log(spark, [(0, 37399, 38684), (1, 37279, 38500)])
    commits = spark.createDataFrame([(0, 7645), (1, 5103)], "partition int, committed long")
    got = {r.partition: r.lost for r in partition_lag(log, commits, by=["partition"]).collect()}
    assert got == {0: 29754, 1: 32176}


def test_unknown_committed_is_minus_one(spark):
    log = _log(spark, [(0, 0, 10)])
    commits = spark.createDataFrame([], "partition int, committed long")
    r = partition_lag(log, commits, by=["partition"]).collect()[0]
    assert (r.committed, r.lag, r.lost) == (-1, None, 0)
