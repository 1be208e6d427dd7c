"""The corpus pipeline: columns, decisions and messy input; SQL for the queries that have it."""

import duckdb
import pytest

from samples import MESSY

SF = "/root/testdata/sf0.001"


def test_stages(spark, messy, nothing, tmp_path):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "decontamination", "mixing", "sharding"]
    for docs, rows in ((messy, len(MESSY)), (nothing, 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name}-{rows}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{rows}")
        kept = {r["doc_id"] for r in docs.collect()}
        assert not kept & {8, 9, 10, 14}


def test_run_keeps_clean_documents(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, SF)
    assert "shard" in out.columns and 100 < out.count() < 400


@pytest.mark.parametrize("name", ["op5_warc", "op6_embedding_near_dedup", "op7_decontamination"])
def test_sql(spark, name):
    from blockyard.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(rel.columns) == sorted(got.columns)
    order = sorted(rel.columns)
    assert sorted(map(str, rel.select(", ".join(order)).fetchall())) == sorted(str(tuple(r)) for r in got.select(*order).collect())
