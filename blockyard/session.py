"""Session helpers: build a session for tests / bench, table loading,
and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "blockyard") -> SparkSession:
    """Local session used by tests and bench. On a cluster, the session comes
    from the launcher and only :func:`prepare` is applied."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BLOCKYARD_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every query relies on: UTC session clock (stream watermarks
    and epoch conversions), Arrow batches of fewer rows than by default (rows
    hold whole texts, and a task holds a batch several times) and a checkpoint
    folder. The checkpoint folder set
    by the cluster (``spark.checkpoint.dir``) is always kept; a local temp
    folder is only chosen by a local master that has none (tests)."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(ARROW_ROWS, "10000") == "10000":
        spark.conf.set(ARROW_ROWS, "2000")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``blockyard`` importable in the Python workers (the state
    machines run there): zip the package into the shared checkpoint folder
    and ``addPyFile`` it, once per SparkContext."""
    import io
    import uuid
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_blockyard_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.join("blockyard", os.path.relpath(full, pkg_dir)))
    target = f"{checkpoint_dir(spark).rstrip('/')}/pyfiles-{uuid.uuid4().hex}/blockyard.zip"
    jvm = sc._jvm
    p = jvm.org.apache.hadoop.fs.Path(target)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(p, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(str(fs.makeQualified(p).toString()))
    sc._blockyard_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster
    (``spark.checkpoint.dir``). Only when none is configured (local runs,
    tests) a local folder is chosen, via ``setCheckpointDir`` -
    ``spark.checkpoint.dir`` itself is a core setting that cannot be changed
    at run time."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
        return d
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="blockyard-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint location (never machine-local on
    a cluster) for tables a job writes and reads back."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table: a parquet scan with pushdown and pruning. It has the
    splits of its files; a plan is the same at every size."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def discard(df: DataFrame) -> None:
    """Delete the folder that :func:`materialize` wrote for ``df``, once all
    that reads it is done."""
    spark = df.sparkSession
    jvm, base = spark.sparkContext._jvm, checkpoint_dir(spark).split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(base):
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as parquet under the shared checkpoint
    folder and read it back (one computation; the read-back has file
    statistics for AQE and column pruning). Survives executor loss, unlike
    cached or locally checkpointed data."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
