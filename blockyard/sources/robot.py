"""Robot command lists: XML flow files and JSON command lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockyard.operators.motion import state_change_only
from blockyard.operators.sequencing import row_number
from blockyard.session import materialize

# --- fixed values: command kinds and their defaults ------------------------
COMMAND_KINDS = ["MovementCommand", "RelativeMovementCommand", "RunConveyorCommand", "MoveConveyorCommand",
                 "SuctionCupCommand", "GripperCommand", "MovementSpeedCommand"]
MOVE_MODE_DEFAULT = "MOVE_JOINT"
DIRECTION_DEFAULT = "STOP"
GRIPPER_DEFAULT = "DISABLE"

COMMAND_FIELDS = ("x DOUBLE, y DOUBLE, z DOUBLE, r DOUBLE, mode STRING, direction STRING, speed DOUBLE, "
                  "distance DOUBLE, suck BOOLEAN, state STRING, acceleration DOUBLE")


# --- fixed values: items of a flow row that are read -------------------------
ROW_ITEMS = {"x": "item_2", "y": "item_3", "z": "item_4", "r": "item_5", "suck_state": "item_12"}


def robot_flow_source(spark: SparkSession, path: str) -> DataFrame:
    """Load XML flow files (one per robot folder ``robot=<id>``, or plain
    files named after the robot; line breaks are allowed anywhere): keep the
    elements named ``row<digits>`` in document order, a move per row, and a
    suction command when ``item_12`` is first given or changes. Elements may
    have attributes, comments, character references and CDATA sections; rows
    do not nest, and a comment hides at most one of them.

    Files are read in records that end at a row's end tag, so a file of any
    length is many records and may be split over tasks; the row of a record is
    parsed by ``from_xml``, and rows are numbered by chunks of the file.

    Output ``robot, row, sub, kind, x, y, z, r, suck`` with ``(row, sub)``
    the command order (sub 0 = move, 1 = suction)."""
    files = spark.read.option("lineSep", "</row").text(path)
    if "robot" not in files.columns:  # a plain file or folder: the robot is the file's name
        files = files.withColumn("robot", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1))
    # a comment goes, also if it ends in the next record or has begun in the last one
    text = F.regexp_replace("value", r"(?s)\A((?!<!--).)*?-->|<!--.*?(-->|\z)", "")
    body = F.regexp_extract(text, r"(?s)<row\d+(\s[^>]*)?>((?!.*<row\d+[\s>]).*)\z", 2)
    has = text.rlike(r"<row\d+(\s[^>]*[^/>])?>")
    found = files.select("robot", F.input_file_name().alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                         F.monotonically_increasing_id().alias("_at"), has.alias("_has"),
                         F.concat(F.lit("<row>"), body, F.lit("</row>")).alias("xml")).filter("_has")
    schema = ", ".join(f"{i} STRING" for i in ROW_ITEMS.values())
    found = found.select("robot", "_file", "_block", "_at", F.from_xml("xml", schema).alias("v"))
    # a file's blocks are in order, and so are the records of a block
    found = row_number(materialize(found, "flow-rows"), ["robot", "_file"], ["_block", "_at"], "_n", F.col("_block"))

    def item(name):
        v = F.trim(F.col("v")[ROW_ITEMS[name]])
        return F.when(v != "", v).cast("double")

    rows = found.select("robot", (F.col("_n") - 1).cast("long").alias("row"), *[item(a).alias(a) for a in "xyzr"],
                        (item("suck_state").cast("int") != 0).alias("suck_state"))
    moves = rows.select("robot", "row", F.lit(0).alias("sub"), F.lit("MovementCommand").alias("kind"),
                        "x", "y", "z", "r", F.lit(None).cast("boolean").alias("suck"))
    states = rows.filter(F.col("suck_state").isNotNull()).select("robot", "row", "suck_state")
    changes = state_change_only(states, ["robot"], "row", ["suck_state"])
    sucks = changes.select("robot", "row", F.lit(1).alias("sub"), F.lit("SuctionCupCommand").alias("kind"),
                           *[F.lit(None).cast("double").alias(a) for a in "xyzr"],
                           F.col("suck_state").alias("suck"))
    return moves.unionByName(sucks)


def write_robot_flows(rows: DataFrame, path: str) -> None:
    """Write flow XML, one file per robot: ``robot, row, x, y, z, r,
    suck (nullable)`` -> ``<root><row<n>><item_2>x</item_2>...</row<n>></root>``.
    Rows are hash-partitioned by robot and sorted within the task."""
    def num(c):
        return F.format_string("%.1f", F.col(c))
    line = F.concat(
        F.lit("<row"), F.col("row").cast("string"), F.lit("><item_0>MOVJ</item_0><item_1>p"),
        F.col("row").cast("string"), F.lit("</item_1><item_2>"), num("x"), F.lit("</item_2><item_3>"), num("y"),
        F.lit("</item_3><item_4>"), num("z"), F.lit("</item_4><item_5>"), num("r"),
        F.lit("</item_5><item_10>0</item_10><item_11>0</item_11>"),
        F.when(F.col("suck").isNotNull(), F.concat(F.lit("<item_12>"), F.col("suck").cast("int").cast("string"),
                                                   F.lit(".0</item_12>"))).otherwise(F.lit("")),
        F.lit("</row"), F.col("row").cast("string"), F.lit(">"))
    line = F.regexp_replace(line, "><(/row|item_)", ">\n  <$1")
    body = rows.select("robot", F.col("row").cast("long").alias("k"), line.alias("value"))
    robots = rows.select("robot").distinct()
    head = robots.select("robot", F.lit(-1).cast("long").alias("k"), F.lit("<root>").alias("value"))
    tail = robots.select("robot", F.lit(2**62).cast("long").alias("k"), F.lit("</root>").alias("value"))
    (head.unionByName(body).unionByName(tail).repartition("robot").sortWithinPartitions("robot", "k")
     .select("robot", "value").write.mode("overwrite").partitionBy("robot").text(path))


def robot_command_source(commands: DataFrame, col: str = "command") -> DataFrame:
    """Single-key command objects ``{"Kind": {...}}`` (one per row, or a JSON
    array per row) -> typed commands with the defaults of each kind:
    ``seq, kind, x, y, z, r, mode, direction, speed, distance, suck, state,
    acceleration``."""
    c = F.col(col)
    is_array = F.ltrim(c).startswith("[")
    one = F.from_json(c, f"map<string, struct<{COMMAND_FIELDS}>>")
    many = F.from_json(c, f"array<map<string, struct<{COMMAND_FIELDS}>>>")
    items = F.when(is_array, many).otherwise(F.array(one))
    d = commands.select("*", F.posexplode(items).alias("item_pos", "m"))
    d = d.select("*", F.explode(F.map_entries("m")).alias("e")).drop("m")
    k, v = F.col("e.key"), F.col("e.value")

    def field(name):
        return v[name]

    absolute = k == "MovementCommand"
    conveyor = k.isin("RunConveyorCommand", "MoveConveyorCommand")
    out = d.select(
        *[x for x in commands.columns if x != col], "item_pos", k.alias("kind"),
        *[F.when(absolute, F.coalesce(field(a), F.lit(0.0))).otherwise(field(a)).alias(a) for a in "xyzr"],
        F.when(absolute, F.coalesce(field("mode"), F.lit(MOVE_MODE_DEFAULT))).alias("mode"),
        F.when(conveyor, F.coalesce(field("direction"), F.lit(DIRECTION_DEFAULT))).alias("direction"),
        F.when(conveyor | (k == "MovementSpeedCommand"), F.coalesce(field("speed"), F.lit(0.0))).alias("speed"),
        F.when(k == "MoveConveyorCommand", F.coalesce(field("distance"), F.lit(0.0))).alias("distance"),
        F.when(k == "SuctionCupCommand", F.coalesce(field("suck"), F.lit(False))).alias("suck"),
        F.when(k == "GripperCommand", F.coalesce(field("state"), F.lit(GRIPPER_DEFAULT))).alias("state"),
        F.when(k == "MovementSpeedCommand", field("acceleration")).alias("acceleration"),
        k.isin(*COMMAND_KINDS).alias("known"))
    return out
