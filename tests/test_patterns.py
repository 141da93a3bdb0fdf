"""User patterns: Python forms, groups, broken ones."""

import pytest
from pyspark.sql import functions as F

from linefold.functions import safety
from linefold.functions.patterns import bad_patterns, to_java
from linefold.operators import contract
from linefold.plans.condense import BAD_PATTERN, Settings, condense_outputs
from linefold.plans.catalog import OVERRIDE_FIELDS
from linefold.sources import rules


def test_python_forms(spark):
    assert to_java(r"(?P<a_b>x)(?P=a_b)\Z") == r"(?<ab>x)\k<ab>\z"
    assert to_java(r"\\Z") == r"\\Z"
    assert bad_patterns(["(bad", "ok", "(?P<x>z)"]) == ["(bad"]


def test_sensitive_patterns(spark):
    texts = spark.createDataFrame([("xx",), ("zzz",), ("nothing",), ("bad",)], "t string")
    hit = safety.sensitive_text(F.col("t"), ["(?P<x>zzz)", "(bad", "(a)b", r"(x)\1"])
    assert [r.hit for r in texts.select(hit.alias("hit")).collect()] == [True, True, False, False]


def test_contract_patterns(spark, lines_of):
    lines = lines_of({1: ["ab", "xx", "zq"]})
    left = contract.always_strip(lines, ["(a)b", r"(x)\1"])
    assert [r.line for r in left.collect()] == ["zq"]
    with pytest.raises(ValueError):
        contract.always_strip(lines, ["(bad"])


def _outputs(spark):
    text = "\n".join(f"word{i} and some other words here" for i in range(60))
    return spark.createDataFrame([(1, "git log", text), (2, "docker ps", text)], "doc_id long, command string, output string")


def _override(spark, prefix, keep, strip):
    return (prefix, tuple(None for _ in rules.PARAMS.names), keep, strip)


def test_a_bad_override_affects_its_own_outputs_only(spark):
    overrides = [_override(spark, "git log", ["(bad"], []), _override(spark, "docker", ["(?P<n>word59)"], [])]
    got = condense_outputs(_outputs(spark), overrides=spark.createDataFrame(overrides, OVERRIDE_FIELDS))
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].reason == BAD_PATTERN and rows[1].result == rows[1].output
    assert rows[2].reason is None and "word59" in rows[2].result


def test_bad_settings_pass_all_through(spark):
    got = condense_outputs(_outputs(spark), settings=Settings(always_strip=["(bad"])).collect()
    assert all(r.reason == BAD_PATTERN and r.result == r.output for r in got)


def test_nothing_left_still_meets_the_target(spark):
    got = condense_outputs(_outputs(spark), settings=Settings(always_strip=["."], target_max_tokens=50)).collect()
    assert all(r.compressed_tokens <= 50 for r in got)


def test_repeated_prefixes_match_once(spark):
    twice = spark.createDataFrame([_override(spark, "git log", ["a"], []), _override(spark, "git log", ["b"], [])], OVERRIDE_FIELDS)
    found = rules.match_prefix(_outputs(spark), twice, into="user").select("doc_id", "user.always_keep").collect()
    assert sorted((r.doc_id, r.always_keep) for r in found) == [(1, ["b"]), (2, None)]
