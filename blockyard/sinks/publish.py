"""Message sinks: notification, manufacture and completion messages, and
fan-out of one batch to several sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockyard.session import discard, materialize
from blockyard import constants as K
from blockyard.functions import nonblank, uuid_from_hash


_OUT = ("topic", "key", "value", "error")


def _keep(df: DataFrame) -> list[str]:
    """Input columns carried along (the message columns are replaced)."""
    return [c for c in df.columns if c not in _OUT]


def _json(*pairs) -> F.Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in pairs]), {"ignoreNullFields": "false"})


def publish_notifications(df: DataFrame, topic: F.Column, message: F.Column, order_id: F.Column,
                          correlation_id: F.Column, seed: F.Column, side: str = "order") -> DataFrame:
    """``{message, orderId, correlationId}`` with key ``"0"`` for the info or
    error topic. Order side: blank order id -> ``unknown-order``, blank
    correlation id -> generated (hash of ``seed``, reruns agree). Factory
    side requires both ids: rows lacking one get ``error`` set instead of a
    value."""
    cid = F.coalesce(nonblank(correlation_id), uuid_from_hash(seed))
    if side == "order":
        oid = F.coalesce(nonblank(order_id), F.lit(K.UNKNOWN_ORDER))
        value, err = _json(("message", message), ("orderId", oid), ("correlationId", cid)), F.lit(None).cast("string")
    else:
        ok = nonblank(order_id).isNotNull() & nonblank(correlation_id).isNotNull()
        value = F.when(ok, _json(("message", message), ("orderId", order_id), ("correlationId", correlation_id)))
        err = F.when(~ok, F.lit("orderId and correlationId are required"))
    return df.select(*_keep(df), topic.alias("topic"), F.lit(K.NOTIFICATION_KEY).alias("key"), value.alias("value"),
                     err.alias("error"))


def publish_manufacture(df: DataFrame, order_id: F.Column, item_type: F.Column, correlation_id: F.Column,
                        seed: F.Column) -> DataFrame:
    """``{order: {orderId, itemType}, correlationId}``; an item type outside
    the enum becomes an error row (no value)."""
    cid = F.coalesce(nonblank(correlation_id), uuid_from_hash(seed))
    ok = F.coalesce(item_type.isin(*K.ITEM_TYPES), F.lit(False))
    value = F.to_json(F.struct(F.struct(order_id.alias("orderId"), item_type.alias("itemType")).alias("order"),
                               cid.alias("correlationId")))
    return df.select(*_keep(df), F.lit(K.MANUFACTURE_TOPIC).alias("topic"), F.lit(K.NOTIFICATION_KEY).alias("key"),
                     F.when(ok, value).alias("value"),
                     F.when(~ok, F.concat(F.lit("Invalid item type: "), F.coalesce(item_type, F.lit("null"))))
                     .alias("error"))


def publish_complete(df: DataFrame, order_id: F.Column, correlation_id: F.Column) -> DataFrame:
    """``{orderId, correlationId}`` for the completion topic."""
    return df.select(*_keep(df), F.lit(K.COMPLETE_TOPIC).alias("topic"), F.lit(K.NOTIFICATION_KEY).alias("key"),
                     _json(("orderId", order_id), ("correlationId", correlation_id)).alias("value"))


def partition_by_key(df: DataFrame, num_partitions: int, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """The producer's key partitioner: the partition number is the integer
    value of the text key. Valid rows are placed in exactly that output
    partition (``repartitionById``); rows with a null, non-numeric or
    out-of-range key are returned separately as rejected."""
    from blockyard.functions import key_partition
    d = df.withColumn("_partition", key_partition(key, num_partitions))
    valid = d.filter(F.col("_partition").isNotNull()).repartitionById(num_partitions, "_partition")
    rejected = d.filter(F.col("_partition").isNull()).drop("_partition")
    return valid.drop("_partition"), rejected


def write_messages(df: DataFrame, path: str | None = None, kafka_bootstrap: str | None = None) -> None:
    """Write ``topic, key, value`` rows to Kafka (connector installed) or
    append them to a parquet topic log."""
    out = df.filter(F.col("value").isNotNull()).select("topic", "key", "value")
    if kafka_bootstrap:
        out.write.format("kafka").option("kafka.bootstrap.servers", kafka_bootstrap).save()
    else:
        out.write.mode("append").partitionBy("topic").parquet(path)


class FanOut:
    """``foreachBatch`` body: every micro-batch goes to all sinks (called with
    the batch and its number); a sink that fails is dropped for good.

    What was done is recorded under ``state``, in the shared folder: a file per
    sink and batch that was written, and one per dropped sink. A restarted
    stream reads them, so a replayed batch goes only to the sinks that do not
    have it, and a dropped sink stays dropped. A sink that is interrupted
    between its write and the record gets the batch again, under the same
    number."""

    def __init__(self, spark: SparkSession, sinks: dict[str, Callable[[DataFrame, int], None]], state: str):
        self.spark, self.sinks, self.state = spark, dict(sinks), state.rstrip("/")

    def _file(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.state}/{path}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _known(self, path: str) -> bool:
        fs, p = self._file(path)
        return fs.exists(p)

    def _record(self, path: str, text: str = "") -> None:
        fs, p = self._file(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def dropped(self) -> list[str]:
        return [n for n in self.sinks if self._known(f"dropped/{n}")]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        gone = set(self.dropped())
        open_ = {n: w for n, w in self.sinks.items() if n not in gone and not self._known(f"done/{n}/{batch_id}")}
        numbered = {n: (lambda df, w=w: w(df, batch_id)) for n, w in open_.items()}
        fan_out(batch, numbered, lambda name, good, error: self._record(
            f"done/{name}/{batch_id}" if good else f"dropped/{name}", error or ""))


def fan_out(df: DataFrame, sinks: dict[str, Callable[[DataFrame], None]],
            report: Callable[[str, bool, str | None], None] = lambda *_: None) -> list[tuple[str, bool, str | None]]:
    """Send one (micro-)batch to every sink; a failing sink is reported and
    dropped, the rest still receive the batch; ``report`` hears of each as
    soon as it is done. The batch is written once to the shared checkpoint
    folder for the several writes, and deleted after them."""
    status = []
    df = materialize(df, "fan-out")
    try:
        for name, write in list(sinks.items()):
            try:
                write(df)
                status.append((name, True, None))
            except Exception as e:  # noqa: BLE001 - a subscriber failure must not stop the others
                status.append((name, False, str(e)))
                sinks.pop(name, None)
            report(*status[-1])
    finally:
        discard(df)
    return status
