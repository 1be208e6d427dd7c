"""Session contract: the checkpoint folder named by the cluster is used
for lineage cuts; a local one is chosen only when none is set."""

from pyspark.sql import functions as F

from blockyard import session as S


def test_checkpoint_dir_contract(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    base = S.checkpoint_dir(spark)
    if configured:                      # the cluster's folder is used as is
        assert base == configured
    assert spark.sparkContext.getCheckpointDir() is not None
    staged = S.materialize(spark.range(10).withColumn("x", F.col("id") * 2), "contract")
    assert staged.count() == 10
    def plain(path):
        return path.split("file:")[-1].lstrip("/")
    assert all(plain(f).startswith(plain(base)) for f in staged.inputFiles())


def test_table_reads_whole_table(spark):
    from paths import SF_SMALL
    import duckdb
    n = duckdb.sql(f"SELECT count(*) FROM '{SF_SMALL}/lineitem.parquet'").fetchall()[0][0]
    assert S.table(spark, SF_SMALL, "lineitem").count() == n
