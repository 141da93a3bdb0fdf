"""Stores of batch jobs: repeated and failed jobs, versions, pruned lookups."""

import pytest
from pyspark.sql import functions as F

from linefold.sources import history, registry, stores

ENTRY = ["command", "strategy", "calls", "confidence", "hot"]


def results(spark, first, last):
    return spark.range(first, last).selectExpr(
        "id as doc_id", "concat('cmd ', id % 3) as command", "'list' as strategy", "'seed' as source", "cast(id as string) as raw_output",
        "'x' as compressed_output", "id as raw_tokens", "1L as compressed_tokens", "timestamp_seconds(id div 4) as created_at"
    )


def calls(spark, first, last):
    return spark.range(first, last).selectExpr(
        "concat('cmd ', id % 3) as command", "id as seq", "if(id % 7 = 0, 'table', 'list') as shape", "id as raw", "1L as comp", "timestamp_seconds(id) as ts"
    )


def rows(df):
    return sorted(map(tuple, df.select(*history.HISTORY_COLUMNS).collect()))


def test_append_fail_append(spark, tmp_path):
    path = str(tmp_path / "history")
    stores.append_to_store(results(spark, 0, 100), path, 1, 32)
    before = rows(stores.stored_history(spark, path))
    broken = results(spark, 100, 150).withColumn("raw_tokens", F.when(F.col("doc_id") == 149, F.raise_error("lost")).otherwise(F.col("raw_tokens")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        stores.append_to_store(broken, path, 2, 32)
    assert rows(stores.stored_history(spark, path)) == before
    for _ in range(2):
        stores.append_to_store(results(spark, 100, 150), path, 2, 32)
        stored = rows(stores.stored_history(spark, path))
    both = history.history_append(history.history_append(None, results(spark, 0, 100), 0), results(spark, 100, 150), 0)
    assert stored == rows(both) and [r[0] for r in stored] == list(range(1, 151))


def test_lookup_reads_one_range(spark, tmp_path):
    path = str(tmp_path / "history")
    stores.append_to_store(results(spark, 0, 1000), path, 1, 100)
    found = stores.stored_by_id(spark, path, [437], 100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [ids" in plan and "In(id, [437])" in plan or "EqualTo(id,437)" in plan
    assert [r.id for r in found.collect()] == [437]
    everything = len(spark.read.parquet(path).inputFiles())
    read = found.select(F.input_file_name().alias("file")).distinct().collect()
    assert len(read) == 1 < everything and "/ids=4/" in read[0].file
    assert stores.stored_by_id(spark, path, [4000], 100).collect() == []


def test_newest_and_expired(spark, tmp_path):
    path = str(tmp_path / "history")
    stores.append_to_store(results(spark, 0, 1000), path, 1, 100)
    newest = rows(stores.stored_history(spark, path, 150, 100))
    assert [r[0] for r in newest] == list(range(851, 1001))
    assert stores.expire(spark, path, 150, 100) == 8
    assert rows(stores.stored_history(spark, path, 150, 100)) == newest
    assert stores.expire(spark, str(tmp_path / "none"), 5) == 0


def test_registry_versions(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert stores.registry_version(spark, path) is None
    stores.merge_into_store(calls(spark, 0, 60), path, 1)
    stores.merge_into_store(calls(spark, 60, 90), path, 2)
    again = stores.merge_into_store(calls(spark, 60, 90), path, 2)
    want = registry.merge_registry(calls(spark, 60, 90), registry.merge_registry(calls(spark, 0, 60)))
    assert sorted(again.select(ENTRY).collect()) == sorted(want.select(ENTRY).collect())
    stores.merge_into_store(calls(spark, 90, 91), path, 3)
    assert stores.drop_versions(spark, path, 2) == [1]
    assert stores.registry_version(spark, path, 1) is None
    assert stores.registry_version(spark, path).agg(F.sum("calls")).first()[0] == 91
    assert stores.drop_versions(spark, path, 0) == [2, 3]


def test_reads_list_only_the_ranges_they_need(spark, tmp_path):
    """More ranges than Spark lists on the driver: a lookup lists and opens its own."""
    path, n = str(tmp_path / "many"), 60
    rows = spark.range(n).selectExpr(
        "id as doc_id", "'c' as command", "'list' as strategy", "'seed' as source", "'r' as raw_output", "'c' as compressed_output",
        "2L as raw_tokens", "1L as compressed_tokens", "timestamp_seconds(id) as created_at",
    )
    stores.append_to_store(rows, path, 1, 1)
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    for group, read in [
        ("lookup", lambda: stores.stored_by_id(spark, path, [7], 1)),
        ("newest", lambda: stores.stored_history(spark, path, 2, 1)),
        ("next", lambda: stores.append_to_store(rows.limit(1), path, 2, 1)),
    ]:
        context.setJobGroup(group, group)
        found = read()
        stages = [s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds]
        context.setLocalProperty("spark.jobGroup.id", None)
        assert max((tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)), default=0) < n // 2
        if group != "next":
            assert sorted(r.id for r in found.collect()) == ([7] if group == "lookup" else [n - 1, n])
    assert stores.stored_by_id(spark, path, [n + 1], 1).count() == 1 and stores.stored_by_id(spark, path, [999], 1).count() == 0
