"""Source shapes: command lists, nested grids, sensor CSV."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from blockyard.sources.robot import robot_command_source
from blockyard.sources.sensor import sensor_csv_source
from blockyard.sources.stock_grid import stock_grid_source


def test_command_list_array_with_defaults(spark):
    text = ('[{"MovementCommand": {"x": 1.5}}, {"RelativeMovementCommand": {"z": -3}}, '
            '{"SuctionCupCommand": {}}, {"GripperCommand": {"state": "OPEN"}}, {"MovementSpeedCommand": {}}]')
    df = spark.createDataFrame([(7, text)], "robot int, command string")
    rows = robot_command_source(df).orderBy("item_pos").collect()
    assert [r.kind for r in rows] == ["MovementCommand", "RelativeMovementCommand", "SuctionCupCommand",
                                      "GripperCommand", "MovementSpeedCommand"]
    assert (rows[0].x, rows[0].y, rows[0].mode) == (1.5, 0.0, "MOVE_JOINT")
    assert (rows[1].x, rows[1].z) == (None, -3.0)
    assert rows[2].suck is False and rows[3].state == "OPEN" and rows[4].speed == 0.0


def test_nested_grid_posexplode_twice(spark):
    grid = [[{"color": "RED", "reserved": False, "order_id": None}, None],
            [None, {"color": "GREEN", "reserved": True, "order_id": "a"}]]
    df = spark.createDataFrame([(grid,)], "grid array<array<struct<color string, reserved boolean, order_id string>>>")
    cells = stock_grid_source(df.select(F.col("grid").alias("row")), "row", None)
    got = sorted((r.x, r.y, r.filled, r.color, r.order_id) for r in cells.collect())
    assert got == [(0, 0, True, "RED", None), (0, 1, False, None, None), (1, 0, False, None, None),
                   (1, 1, True, "GREEN", "a")]


def test_sensor_csv_layout(spark):
    d = tempfile.mkdtemp(prefix="blockyard-csv-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("Timestamp;Date;Value;Properties\n")
        f.write('1700000000123;2023-11-14 23:13:20;{"type":"distance_IR_short","UID":"TG2",'
                '"location":"HumanWS","messageID":4,"distance":30.0};\n')
    r = sensor_csv_source(spark, d).collect()[0]
    assert (r.ts_ms, r.type, r.uid, r.location, r.message_id, r.properties) == (
        1700000000123, "distance_IR_short", "TG2", "HumanWS", 4, None)


def test_partition_by_key_places_rows(spark):
    from blockyard.sinks.publish import partition_by_key
    df = spark.createDataFrame([(str(i % 3), i) for i in range(30)] + [("x", 99), (None, 98), ("7", 97)],
                               "key string, v int")
    valid, rejected = partition_by_key(df, 3)
    placed = valid.select("key", F.spark_partition_id().alias("p")).distinct().collect()
    assert all(int(r.key) == r.p for r in placed) and valid.count() == 30
    assert sorted(r.v for r in rejected.collect()) == [97, 98, 99]


def test_fan_out_remembers(spark):
    """A failed sink is dropped, also after a restart; a replayed batch goes only to sinks that do not have it."""
    from blockyard.sinks.publish import FanOut
    from blockyard.streaming.runtime import fresh_path
    seen, state = {}, fresh_path(spark, "fan-out-state")

    def ok(name):
        return lambda df, i: seen.setdefault(name, []).append((i, df.count()))

    def broken(df, i):
        raise RuntimeError("closed")

    def interrupted(df, i):
        raise KeyboardInterrupt

    body = FanOut(spark, {"a": ok("a"), "bad": broken, "b": ok("b")}, state)
    body(spark.range(5), 0)
    assert body.dropped() == ["bad"]
    with pytest.raises(KeyboardInterrupt):  # the driver goes while batch 1 is written
        FanOut(spark, {"a": ok("a"), "b": interrupted}, state)(spark.range(3), 1)
    body = FanOut(spark, {"a": ok("a"), "bad": ok("bad"), "b": ok("b")}, state)
    body(spark.range(3), 1)
    body(spark.range(2), 2)
    assert seen == {"a": [(0, 5), (1, 3), (2, 2)], "b": [(0, 5), (1, 3), (2, 2)]} and body.dropped() == ["bad"]
