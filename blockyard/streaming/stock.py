"""Stock requests as a stream: a versioned stock table, changed per micro-batch.

``version=n`` of the table is the stock before micro-batch n. A micro-batch
reads its version, answers its requests by :func:`apply_stock_log` and writes
its replies and the next version, both in overwrite mode under its own number:
a batch that is replayed after a failure reads the same version again and
replaces what it wrote. Versions that no replay can ask for are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockyard.operators.sequencing import DEFAULT_WIDTH
from blockyard.operators.stock_log import apply_stock_log


class StockTable:
    """Stock (columns of ``stock_log.STOCK``) under ``path``, one folder per
    version, written by as many tasks as its rows need."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def _fs(self, folder: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def load(self, stock: DataFrame) -> StockTable:
        """Write the stock that the stream starts from. Does nothing if there is one, so a restart may call it again."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            stock.write.mode("overwrite").parquet(self._folder(0))
        return self

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._folder(version))

    def write(self, version: int, stock: DataFrame) -> None:
        stock.write.mode("overwrite").parquet(self._folder(version))

    def forget(self, version: int) -> None:
        fs, p = self._fs(self._folder(version))
        fs.delete(p, True)


def reserve_stream(requests: DataFrame, table: StockTable, replies: str, checkpoint: str, chunk_width: int = DEFAULT_WIDTH,
                   **trigger):
    """Start a stream of stock requests (``seq, kind, order_id, count,
    color_raw``; ``seq`` rises from one micro-batch to the next) against
    ``table``; replies go to ``replies``/batch_id=<n>. Returns the query."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        answers, after = apply_stock_log(table.read(batch_id), batch, chunk_width)
        answers.write.mode("overwrite").parquet(f"{replies}/batch_id={batch_id}")
        table.write(batch_id + 1, after)
        if batch_id:
            table.forget(batch_id - 1)  # this batch has begun, so the one before is committed

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply) \
        .trigger(**(trigger or {"availableNow": True})).start()


def stock_requests(reserves: DataFrame, others: DataFrame) -> DataFrame:
    """One request log from reserve requests (``seq, order_id, count,
    color_raw``) and others (``seq, kind, order_id``)."""
    cols = ["seq", "kind", "order_id", "count", "color_raw"]
    return reserves.withColumn("kind", F.lit("reserve")).select(*cols).unionByName(
        others.select("seq", "kind", "order_id", F.lit(None).cast("int").alias("count"), F.lit(None).cast("string").alias("color_raw")))
