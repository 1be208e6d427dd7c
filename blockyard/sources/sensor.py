"""Recorded sensor series (``Timestamp;Date;Value;Properties`` CSV with a
JSON value) and sensor topics (JSON messages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_SCHEMA = "Timestamp LONG, Date STRING, Value STRING, Properties STRING"


def sensor_csv_source(spark: SparkSession, path: str) -> DataFrame:
    """Read recorded series: ``;``-separated, header line, no quoting (the
    JSON value holds quotes and commas), the trailing ``;`` gives a null
    fourth column. Adds the common JSON fields and the event time."""
    raw = (spark.read.option("sep", ";").option("header", True).option("quote", "")
           .option("mode", "PERMISSIVE").schema(CSV_SCHEMA).csv(path))
    v = F.col("Value")
    return raw.select(
        F.col("Timestamp").alias("ts_ms"),
        F.timestamp_add("MILLISECOND", F.col("Timestamp"),
                        F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"),
        F.col("Date").alias("local_time"), v.alias("value"), F.col("Properties").alias("properties"),
        F.get_json_object(v, "$.type").alias("type"), F.get_json_object(v, "$.UID").alias("uid"),
        F.get_json_object(v, "$.location").alias("location"),
        F.get_json_object(v, "$.messageID").try_cast("long").alias("message_id"))


def write_sensor_csv(df: DataFrame, path: str) -> None:
    """Write ``Timestamp, Date, Value, Properties`` rows in the recorded
    layout (header, ``;``, unquoted)."""
    (df.select("Timestamp", "Date", "Value", "Properties").write.mode("overwrite")
     .option("sep", ";").option("header", True).option("quote", "").option("escapeQuotes", False)
     .csv(path))


def sensor_topic_source(messages: DataFrame, field: str = "distance", payload: str = "payload") -> DataFrame:
    """One sensor topic as JSON messages (batch or stream); the measured
    field as a double (non-numeric -> null)."""
    return messages.withColumn(field, F.get_json_object(F.col(payload), f"$.{field}").try_cast("double"))


def read_sensor_topic(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON-lines sensor messages from a folder (no MQTT source in Spark);
    ``payload`` is the raw line."""
    r = spark.readStream if stream else spark.read
    return sensor_topic_source(r.text(path).withColumnRenamed("value", "payload"))
