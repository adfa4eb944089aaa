import pytest

import corpus_pipeline
from gridcover.llm.common import materialize
from gridcover.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        if name != "mixing":
            assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    assert docs.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]


def test_odd_documents_pass_every_stage(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        for d in (odd_docs, no_docs):
            out = stage(spark, d, SF)
            out.write.format("noop").mode("overwrite").save()
            if name != "mixing":
                assert out.columns == d.columns


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_run(spark, name):
    df = queries()[name](spark, SF)
    n = {"op1": None, "op10": 50}.get(name.split("_")[0], 200)
    assert n is None or df.count() == n


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = c.execute(oracle_sql()[name])
    names = sorted(d[0] for d in cur.description)
    order = [[d[0] for d in cur.description].index(k) for k in names]
    want = sorted((tuple(r[k] for k in order) for r in cur.fetchall()), key=str)
    assert sorted(map(tuple, queries()[name](spark, SF).select(*names).collect()), key=str) == want
