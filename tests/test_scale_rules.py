"""Inputs beyond the fixtures: large keys, wide grids, second colours, real
flow files, logs with several topics."""

import pytest
from pyspark.sql import functions as F

from blockyard import session
from blockyard.operators import broker as B
from blockyard.operators import motion
from blockyard.operators import stock as S
from blockyard.operators import tracker as T
from blockyard.plans import views as V
from blockyard.sources.robot import robot_flow_source


def test_requests_with_large_keys(spark, tmp_path):
    keys = [5, 10, 9_999_990, 10_000_000, 10_000_005, 20_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    r = V.requests(spark, str(tmp_path)).collect()
    assert len({x["seq"] for x in r}) == len(r)
    assert sorted(int(x["order_id"]) for x in r if not x["is_repeat"]) == keys


def test_tracker_with_large_seq(spark):
    ev = "seq long, ts timestamp, topic string, order_id string, message string, is_error boolean, info_title string, info_text string, timestamp_ms long"
    rows = [(1, None, "error.v1", "o", "Manufacturing failed", True, None, None, None),
            (3 * 2**44 + 7, None, "info.v1", "o", "Inventory reserved", False, None, None, None)]
    got = T.order_tracker(spark.createDataFrame(rows, ev)).first()
    assert got["step"] == 3 and got["failed"] is True


def test_ten_column_grid(spark):
    rows = [(x, y, "RED", True, True, "o") for x in range(30) for y in range(10)]
    cells = spark.createDataFrame(rows, "x long, y long, color string, filled boolean, reserved boolean, order_id string")
    got = S.reserved_positions(cells).orderBy("pos").collect()
    assert [(r["x"], r["y"]) for r in got] == [(x, y) for x in range(30) for y in range(10)]
    assert [r["pos"] for r in got] == list(range(1, 301))


def test_second_colour_after_a_refusal(spark):
    cells = spark.createDataFrame([(0, 0, "BLUE", True, False, None), (0, 1, "RED", True, False, None)],
                                  "x long, y long, color string, filled boolean, reserved boolean, order_id string")
    log = spark.createDataFrame([], "order_id string, x long, y long, color string")
    reqs = spark.createDataFrame([(1, "o", 2, "red"), (2, "o", 1, "blue"), (3, "p", 1, "blue"), (4, "p", 1, "red")],
                                 "seq long, order_id string, count int, color_raw string")
    got = {r["seq"]: (r["status"], r["message"]) for r in S.reserve_results(reqs, cells, log).collect()}
    assert got[1][0] == 409 and "Not enough" in got[1][1]
    assert got[2] == (200, None)  # the service has no rule on colours
    assert got[3] == (409, "Not enough BLUE blocks. Requested: 1, available: 0") and got[4][0] == 200


def test_flow_file_with_line_breaks(spark, tmp_path):
    rows = "".join(f"""
  <row{i}>
    <item_0>MOVJ</item_0>
    <item_2>{i}.5</item_2>
    <item_3>{-i}.0</item_3>
    <item_4>1.0</item_4>
    <item_5>0.0</item_5>
    <item_12>{float(i > 5)}</item_12>
  </row{i}>""" for i in range(12))
    (tmp_path / "arm7.playback").write_text(f"<root>\n  <row_StudioVersion>1</row_StudioVersion>{rows}\n</root>\n")
    got = robot_flow_source(spark, f"{tmp_path}/arm7.playback").collect()
    moves = sorted((r for r in got if r["kind"] == "MovementCommand"), key=lambda r: r["row"])
    assert len(moves) == 12 and {r["robot"] for r in got} == {"arm7"} and moves[3]["x"] == 3.5
    assert sorted((r["row"], r["suck"]) for r in got if r["kind"] == "SuctionCupCommand") == [(0, False), (6, True)]


def test_flow_file_with_all_of_xml(spark, tmp_path):
    """Attributes, comments (one hides a row), character references, CDATA, white space in tags, empty and missing items."""
    (tmp_path / "arm.xml").write_text("""<?xml version="1.0"?>
<root author="x &gt; y"><!-- <row9> is no row -->
  <row_StudioVersion>2</row_StudioVersion>
  <row0 id="1"><item_2 unit="mm">1.5</item_2><item_3><![CDATA[2.5]]></item_3><!-- z --><item_4>&#51;.5</item_4><item_5/><item_12>1.0</item_12></row0 >
  <!-- <row1><item_2>99</item_2></row1> -->
  <row2
     a='b'>
    <item_1>a &lt;row7&gt; &amp; <![CDATA[b]]></item_1><item_2> -4 </item_2><item_12>0</item_12></row2>
  <row3><item_2>7<!-- 8 --></item_2></row3><row4></row4>
</root>
""")
    got = robot_flow_source(spark, f"{tmp_path}/arm.xml").collect()
    moves = sorted((r.row, r.x, r.y, r.z, r.r) for r in got if r.sub == 0)
    assert moves == [(0, 1.5, 2.5, 3.5, None), (1, -4.0, None, None, None), (2, 7.0, None, None, None), (3, None, None, None, None)]
    assert sorted((r.row, r.suck) for r in got if r.sub == 1) == [(0, True), (1, False)] and {r.robot for r in got} == {"arm"}


def test_flow_file_in_splits(spark, tmp_path):
    rows = "".join(f"<row{i}><item_2>{i}</item_2><item_12>{i // 50 % 2}</item_12></row{i}>\n" for i in range(500))
    (tmp_path / "arm.xml").write_text(f"<root>\n{rows}</root>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = robot_flow_source(spark, f"{tmp_path}/arm.xml").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.row, r.x) for r in got if r.sub == 0) == [(i, float(i)) for i in range(500)]
    assert sorted((r.row, r.suck) for r in got if r.sub == 1) == [(50 * k, k % 2 == 1) for k in range(10)]


def test_logs_of_several_topics(spark):
    log = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("b", 0, 0), ("b", 0, 1), ("b", 0, 1)], "topic string, partition int, offset long")
    assert [(r["topic"], r["n"]) for r in B.redeliveries(log).collect()] == [("b", 2)]
    commits = spark.createDataFrame([("a", 0, 1), ("b", 0, 0), ("c", 0, 3)], "topic string, partition int, committed long")
    start = spark.createDataFrame([("b", 0, 2), ("c", 0, 9)], "topic string, partition int, log_start long")
    got = {r["topic"]: (r["log_start"], r["log_end"], r["lag"], r["lost"]) for r in B.partition_lag(log, commits, start).collect()}
    # b and c are emptied by retention and stay in the result
    assert got == {"a": (0, 2, 1, 0), "b": (2, 2, 2, 2), "c": (9, 9, 6, 6)}


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_discard_deletes_what_was_staged(spark):
    staged = session.materialize(spark.range(3), "gone")
    files = staged.inputFiles()
    session.discard(staged)
    with pytest.raises(Exception):
        spark.read.parquet(*files).count()
    assert F is not None


def test_trajectory_rounds_within_a_segment(spark):
    """An absolute move after 20,000 deltas ends exactly where it says; suction starts false."""
    n = 20_000
    log = spark.range(1, n + 1).select(F.lit(1).alias("robot"), F.col("id").alias("seq"), F.lit("RelativeMovementCommand").alias("kind"),
                                       *[F.lit(0.1).alias(a) for a in "xyzr"], F.lit(None).cast("boolean").alias("suck"))
    move = spark.sql(f"SELECT 1 AS robot, {n + 1}L AS seq, 'MovementCommand' AS kind, 12.3D AS x, 0D AS y, 0D AS z, 0D AS r, "
                     f"CAST(NULL AS BOOLEAN) AS suck")
    commands = log.union(move)
    end = motion.trajectory(commands, chunk_width=1000).orderBy(F.desc("seq")).first()
    assert (end.px, end.suction) == (12.3, False)
    last = motion.final_position(commands).first()
    assert (last.n_commands, last.px, last.suction) == (n + 1, 12.3, False)
    assert motion.final_position(log).first().px == pytest.approx(2000.0)


def test_trajectory_states(spark):
    rows = [(1, "MovementSpeedCommand", None, 20.0, 5.0, None, None), (2, "RunConveyorCommand", None, 3.0, None, None, "FORWARD"),
            (3, "MoveConveyorCommand", None, 4.0, None, 7.0, "BACKWARD"), (4, "MovementSpeedCommand", None, 30.0, None, None, None),
            (5, "MovementCommand", 1.0, None, None, None, None), (6, "RunConveyorCommand", None, 0.0, None, None, "STOP")]
    df = spark.createDataFrame(rows, "seq long, kind string, x double, speed double, acceleration double, distance double, direction string") \
        .select(F.lit(1).alias("robot"), "*", *[F.lit(None).cast("double").alias(a) for a in "yzr"])
    got = motion.trajectory(df, chunk_width=2).orderBy("seq").collect()
    assert [(r.speed, r.acceleration, r.conveyor_speed, r.conveyor_distance, r.conveyor_direction, r.px, r.suction) for r in got] == [
        (20.0, 5.0, 0.0, 0.0, None, 0.0, False), (20.0, 5.0, 3.0, 0.0, "FORWARD", 0.0, False), (20.0, 5.0, 4.0, 7.0, "BACKWARD", 0.0, False),
        (30.0, 5.0, 4.0, 7.0, "BACKWARD", 0.0, False), (30.0, 5.0, 4.0, 7.0, "BACKWARD", 1.0, False), (30.0, 5.0, 0.0, 7.0, "STOP", 1.0, False)]
    first = motion.trajectory(df.select("robot", "seq", "kind", *"xyzr").filter("seq = 5"), chunk_width=2).first()
    assert (first.speed, first.acceleration, first.conveyor_speed) == (50.0, 100.0, 0.0)


def test_latency_summary_counts(spark):
    import math
    import random
    rng = random.Random(2)
    rows = [(t, rng.choice([-5, 0, 3, 10**7, int(rng.lognormvariate(8, 3))])) for t in "aab" for _ in range(700)] + [("c", None), ("d", 9)]
    df = spark.createDataFrame(rows, "topic string, latency long")
    exact = {r["topic"]: r for r in B.latency_summary(df).collect()}
    near = {r["topic"]: r for r in B.latency_summary(df, approx=True).collect()}
    assert set(exact) == set(near) == {"a", "b", "d"}
    for t, r in exact.items():
        v = sorted(x for s, x in rows if s == t)
        want = [v[max(1, math.ceil(p * len(v))) - 1] for p in (0.5, 0.95, 0.99)]
        assert [r["n"], r["min"], r["p50"], r["p95"], r["p99"], r["max"]] == [len(v), v[0], *want, v[-1]]
        assert r["avg"] == pytest.approx(sum(v) / len(v)) and near[t]["n"] == len(v)
        assert abs(v.index(near[t]["p50"]) - len(v) / 2) < 0.35 * len(v) + 1
    plan = B.latency_summary(df)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_idle_partitions_have_a_lag_at_every_tick(spark):
    log = spark.sql("SELECT p AS partition, o AS offset, timestamp_seconds(t * 10) AS ts FROM VALUES (0, 0L, 1), (0, 1L, 1), (0, 2L, 4), (1, 0L, 2) v(p, o, t)")
    commits = spark.sql("SELECT p AS partition, c AS committed FROM VALUES (0, 1L), (2, 0L) v(p, c)")
    got = {(r.partition, r.tick_start.second): (r.log_end, r.lag, r.growth) for r in B.lag_growth(log, commits, 10, ["partition"]).collect()}
    assert got == {(0, 10): (2, 1, None), (0, 20): (2, 1, 0), (0, 30): (2, 1, 0), (0, 40): (3, 2, 1),
                   (1, 10): (0, None, None), (1, 20): (1, None, None), (1, 30): (1, None, None), (1, 40): (1, None, None),
                   (2, 10): (0, 0, None), (2, 20): (0, 0, 0), (2, 30): (0, 0, 0), (2, 40): (0, 0, 0)}
    assert B.lag_growth(log.filter("false"), commits, 10, ["partition"]).count() == 0


def test_retry_attempts_shuffles_once(spark):
    rows = [(1, i, i == 1) for i in range(5)] + [(2, i, False) for i in range(5)]
    d = motion.retry_attempts(spark.createDataFrame(rows, "k int, t int, success boolean"), ["k"], ["t"])
    assert sorted((r.k, r.attempt, r.outcome) for r in d.collect()) == [
        (1, 1, "retry"), (1, 2, "success"), (2, 1, "retry"), (2, 2, "retry"), (2, 3, "error")]
    kinds = spark.createDataFrame([(1, 1, False, True), (1, 2, False, False), (1, 3, True, None), (2, 1, False, None), (2, 2, True, None)],
                                  "k int, t int, success boolean, technical boolean")
    got = motion.retry_attempts(kinds, ["k"], ["t"], technical="technical").collect()
    assert sorted((r.k, r.attempt, r.final, r.outcome) for r in got) == [
        (1, 1, False, "retry"), (1, 2, True, "refused"), (2, 1, False, "retry"), (2, 2, True, "success")]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
