from pyspark.sql import functions as F

from linefold.functions.text import count_tokens
from linefold.plans.catalog import OVERRIDE_FIELDS
from linefold.plans.condense import BYPASS, OVERSIZE, Settings, call_log, condense_outputs, history_rows
from linefold.sources import registry, rules

LOG = "\n".join(f"abc{i:04d} feat: commit number {i}" for i in range(100))
PYTEST = "\n".join(
    [f"tests/test_a.py::test_{i} PASSED" for i in range(30)]
    + ["tests/test_a.py::test_x FAILED", "    assert 1 == 2", "=" * 10 + " 1 failed, 30 passed " + "=" * 10]
)
TABLE = "\n".join(["NAME      ID", "----      --"] + [f"row{i}      {i}" for i in range(30)])


def run(spark, cases, **options):
    df = spark.createDataFrame([(i, c, o) for i, (c, o) in enumerate(cases)], "doc_id long, command string, output string")
    return {r.doc_id: r for r in condense_outputs(df, **options).collect()}


def test_seeds_decide(spark):
    cases = [
        ("git  log --oneline", LOG),
        ("pytest -q", PYTEST),
        ("docker ps", TABLE),
        ("cargo build", "\n".join([f"Compiling {i}%" for i in range(40)] + ["error: broken", "Finished"])),
        ("mystery", LOG),
        ("git log", "short"),
        ("git log", "\x1b[31m" + LOG + "\x1b[0m"),
        ("git log", LOG + "\npassword"),
    ]
    out = run(spark, cases)
    log = LOG.split("\n")
    assert out[0].result.split("\n") == [*log[:16], "... [80 more items]", *log[-4:]]
    assert out[0].command == "git log --oneline" and out[0].source == "seed"
    assert out[1].result.split("\n") == PYTEST.split("\n")[-3:]
    assert out[2].result.split("\n")[-1] == "... [additional rows omitted]" and len(out[2].result.split("\n")) == 18
    assert out[3].result == "error: broken\nFinished"
    assert (out[4].strategy, out[4].source) == ("list", "classifier")
    assert out[5].result == "short" and out[5].reason == "minimal output" and out[5].strategy is None
    assert out[6].result == out[0].result
    assert out[7].result == cases[7][1]


def test_guards(spark):
    words = "\n".join(" ".join(f"word{i}x{j}" for j in range(6)) for i in range(60))
    target = run(spark, [("git log", words), ("cat x", words)], settings=Settings(target_max_tokens=50))
    assert all(r.compressed_tokens <= 50 for r in target.values())
    flat = "\n".join(f"Key {i}: v {i} w {i} x" for i in range(40))
    near = run(spark, [("git log", flat)], settings=Settings(min_savings_ratio=0.9))
    assert len(near[0].result.split("\n")) == 19
    dense = run(spark, [("cat x", " ".join(f"w{i}" for i in range(400)) + "\n" * 20)], settings=Settings(target_max_tokens=9))
    assert dense[0].result == " ".join(f"w{i}" for i in range(9))
    tiny = run(spark, [("cat x", "\n".join(["a"] * 15))])
    assert tiny[0].result == "\n".join(["a"] * 15)


def test_overrides_and_registry(spark):
    params = tuple(4 if f == "max_lines" else None for f in rules.PARAMS.names)
    overrides = spark.createDataFrame([("git log", params, ["number 5$"], ["number 1$"])], OVERRIDE_FIELDS)
    out = run(spark, [("git log -3", LOG)], overrides=overrides)
    log = LOG.split("\n")
    assert out[0].result.split("\n") == [log[0], log[2], "... [96 more items]", log[99], log[5]]
    calls = spark.createDataFrame([("mystery", i, "table", 9, 3) for i in range(9)], "command string, seq long, shape string, raw long, comp long")
    learned = registry.merge_registry(calls.withColumn("ts", F.timestamp_seconds("seq")))
    again = run(spark, [("mystery", LOG), ("mystery -v", LOG)], registry=learned)
    assert (again[0].strategy, again[0].source, again[1].source) == ("table", "learned", "classifier")


def test_bypass_size_and_logs(spark):
    df = spark.createDataFrame(
        [(1, "git log", LOG, True), (2, "git log", LOG, False), (3, "mystery", LOG, False)],
        "doc_id long, command string, output string, bypass boolean",
    )
    out = condense_outputs(df, settings=Settings(max_output_bytes=len(LOG)))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].reason == BYPASS and rows[1].result == LOG and rows[2].reason is None
    assert [r.command for r in call_log(out).collect()] == ["mystery"]
    assert sorted(r.doc_id for r in history_rows(out).collect()) == [2, 3]
    small = condense_outputs(df, settings=Settings(max_output_bytes=len(LOG) - 1))
    assert {r.reason for r in small.collect()} == {BYPASS, OVERSIZE}


def test_results_never_grow(spark):
    cases = [("find .", "\n".join(f"a/{i % 4}/{i}" for i in range(n))) for n in range(15, 40, 6)]
    df = spark.createDataFrame([(i, c, o) for i, (c, o) in enumerate(cases)], "doc_id long, command string, output string")
    out = condense_outputs(df)
    grew = (F.length("result") > F.length("output")) | (count_tokens(F.col("result")) > count_tokens(F.col("output")))
    assert out.filter(grew).count() == 0 and out.count() == len(cases)
