"""The pipeline's stages, each on its own input, and what the driver relies on."""

import corpus_pipeline
from siltgate.llm import queries
from siltgate.llm.common import table


def test_stages_filter_and_pass_columns_on(spark, small):
    docs = table(spark, small, "documents")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == columns, name
        now = {r.doc_id for r in out.collect()}
        assert now <= seen and len(now) > 0.7 * len(seen), name
        docs, seen = spark.createDataFrame(out.toPandas(), out.schema), now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert last.count() == docs.count()


def test_run_returns_token_rows(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 11)} == {q[: q.index("_") + 1] for q in queries.QUERIES if q.startswith("op")}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


def test_ablations_equal_their_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = queries.quality_ablations(spark, small).select("version", "rule", "n_fail", "n_only", "n_kept", "n_kept_without").collect()
    assert {tuple(r) for r in got} == set(con.execute(queries.ABLATIONS_SQL).fetchall()) and len(got) == 14
