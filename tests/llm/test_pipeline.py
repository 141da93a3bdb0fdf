"""Every stage against brute force, and the queries against their SQL twins."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline
from linefold.llm import queries
from linefold.llm.oracles import ORACLES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    got = queries.QUERIES[name](spark, DATA)
    assert set(got.columns) == set(want.columns)
    rows = sorted(map(tuple, got.select(*want.columns).collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    table = lambda df: {r.doc_id: r for r in df.collect()}

    given = table(docs)
    clean = stages["toxicity"](spark, docs, DATA)
    score = {r.doc_id: r.score for r in queries.op8_toxicity(spark, DATA).collect()}
    assert set(table(clean)) == {i for i in given if score[i] < 0.3}

    from test_near_duplicates import expected

    single = stages["near_duplicates"](spark, docs, DATA)
    component, _ = expected([(i, r.text) for i, r in given.items()], 5)
    assert set(table(single)) == set(component.values())

    left = stages["decontamination"](spark, docs, DATA)
    hit = {r.doc_id for r in queries.op9_decontamination(spark, DATA).collect() if r.contaminated}
    assert set(table(left)) == set(given) - hit and hit

    private = table(stages["private_data"](spark, docs, DATA))
    replaced = {r.doc_id: r.text for r in queries.op6_surrogates(spark, DATA).collect()}
    assert {i: r.text for i, r in private.items()} == replaced
    assert all(r.n_chars == len(r.text) for r in private.values())

    packed = table(stages["packing"](spark, docs, DATA))
    assert {i: r.text for i, r in packed.items()} == {i: r.text for i, r in given.items()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name


def test_odd_rows_through_all_stages(spark, docs_of, odd_rows, tmp_path):
    names = corpus_pipeline.COLUMNS
    rows = [*odd_rows, (11, "b c d e f g"), (12, "words of a passage that is in a benchmark, and of nothing else at all, indeed")]
    docs_of(rows).select(names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tests = [(1, "Words of a passage that is in a benchmark and of nothing else at all"), (2, None)]
    spark.createDataFrame(tests, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted([1, 2, 3, 4, None, 5, 6, 7, 11], key=repr)
    docs_of([]).select(names).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
