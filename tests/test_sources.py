import json
import random

import pytest
from pyspark.sql import functions as F

from linefold.sources import events, history, registry, rules
from linefold.sources.outputs import read_outputs


def fold(shapes, shape=None, confidence=None):
    """The learning rule, call by call, in doubles."""
    for call in shapes:
        if shape is None:
            shape, confidence = call, 0.50
        elif confidence < 0.95:
            if call == shape:
                confidence = min(1.0, confidence + 0.08)
            elif confidence - 0.20 < 0.50:
                shape, confidence = call, 0.50
            else:
                confidence -= 0.20
    return shape, confidence


def random_calls(rng, n):
    pool = rng.sample(["list", "error", "table", "diff"], rng.randint(1, 4))
    weights = [rng.choice([1, 3, 20]) for _ in pool]
    return rng.choices(pool, weights, k=n)


def test_fold_equals_the_sequential_rule(spark):
    rng = random.Random(5)
    log = {f"cmd {i}": random_calls(rng, rng.choice([1, 2, 7, 30, 200])) for i in range(150)}
    # five gains and two losses bring the confidence back to where it was, but for rounding
    log["drift"] = ["a"] * 5 + ["b"] + (["a"] * 5 + ["b", "b"]) * 60
    rows = [(c, i * 3, s) for c, shapes in log.items() for i, s in enumerate(shapes)]
    calls = spark.createDataFrame(rows, "command string, seq long, shape string")
    for size, joined in ((4, 3), (16, 1024), (1 << 16, 1024)):
        learned = registry.learn_fold(calls, None, size, joined)
        found = {r.command: (r.strategy, r.confidence) for r in learned.collect()}
        assert found == {c: fold(shapes) for c, shapes in log.items()}


def as_calls(spark, rows):
    return spark.createDataFrame(rows, "command string, seq long, shape string, raw long, comp long").withColumn(
        "ts", F.timestamp_seconds("seq")
    )


def test_merge_continues_and_respects_the_user(spark):
    rng = random.Random(9)
    log = {f"cmd {i}": random_calls(rng, 40) for i in range(30)}
    rows = [(c, i, s, 100, 50) for c, shapes in log.items() for i, s in enumerate(shapes)]
    calls = as_calls(spark, rows)
    merged = registry.merge_registry(calls.filter("seq >= 13"), registry.merge_registry(calls.filter("seq < 13")), 8)
    found = {r.command: (r.strategy, r.confidence, r.calls, r.hot) for r in merged.collect()}
    for command, shapes in log.items():
        shape, confidence = fold(shapes)
        assert found[command] == (shape, confidence, 40, confidence >= 0.85)
    fixed = registry.registry_entries(registry.merge_registry(calls.filter("command = 'cmd 1'"))).withColumns(
        {"source": F.lit("user"), "strategy": F.lit("table"), "confidence": F.lit(0.5)}
    )
    row = registry.merge_registry(calls.filter("command = 'cmd 1'"), fixed).first()
    assert (row.strategy, row.confidence, row.calls) == ("table", 0.5, 80)


@pytest.fixture(params=[0, 64 << 20], ids=["salted", "broadcast"])
def bound(request, monkeypatch):
    monkeypatch.setattr(rules, "BROADCAST_BYTES", request.param)


def test_reset_summary_and_lookup(spark, bound):
    rows = [("a b -x", i, "list", 100, 40) for i in range(12)] + [("c", i, "diff", 10, 20) for i in range(2)]
    calls = as_calls(spark, rows)
    reg = registry.merge_registry(calls)
    assert registry.registry_summary(reg, calls).first()[:] == (2, 12 * 60, 1)
    assert [r.command for r in registry.hot_commands(reg).collect()] == ["a b -x"]
    reset = registry.reset_commands(reg, spark.createDataFrame([("a b -x",)], "command string"))
    row = reset.filter("command = 'a b -x'").first()
    assert (row.confidence, row.calls, row.hot, row.avg_raw_tokens) == (0.5, 0, False, 100.0)
    assert registry.reset_all(reg).count() == 0
    asked = spark.createDataFrame([(1, "a b -x"), (2, "a b -y"), (3, "c")], "doc_id long, command string")
    exact = {r.doc_id: r.entry and r.entry.strategy for r in rules.lookup_registry(asked, reg).collect()}
    assert exact == {1: "list", 2: None, 3: None}
    base = {r.doc_id: r.base_entry and r.base_entry.strategy for r in rules.lookup_base_key(asked, reg).collect()}
    assert base == {1: "list", 2: "list", 3: None}


def test_longest_prefix_and_extensions(spark, bound):
    asked = ["git log -5", "git logs", "npm run build", "npm run", "ls", "lsof", "my tool x"]
    outputs = spark.createDataFrame([(i, c) for i, c in enumerate(asked)], "doc_id long, command string")
    entries = [
        ("a.yaml", "my tool", '{"strategy": "table", "params": {"max_rows": 3}}'),
        ("b.yaml", "my tool", '{"strategy": "list", "streamable": null}'),
        ("a.yaml", "ls", '{"strategy": "nope"}'),
        ("a.yaml", "cat", '{"strategy": "list", "color": 1}'),
        ("a.yaml", "find", '{"params": [1]}'),
        ("a.yaml", "find", '{"streamable": 1}'),
        ("a.yaml", "find", "3"),
    ]
    raw = spark.createDataFrame(entries, "file string, prefix string, body string")
    reasons = [r.reason for r in rules.checked_extensions(raw).collect()]
    assert reasons == [
        None, None, "unknown strategy", "unknown keys", "params must be a mapping", "streamable must be a bool", "not a mapping"
    ]
    table = rules.seed_table(rules.seeds(spark), rules.valid_extensions(raw))
    found = {r.doc_id: r.rule and (r.rule.prefix, r.rule.strategy, r.rule.user_override) for r in rules.match_prefix(outputs, table).collect()}
    assert found == {
        0: ("git log", "list", False),
        1: None,
        2: ("npm run build", "progress", False),
        3: None,
        4: ("ls", "list", False),
        5: None,
        6: ("my tool", "list", True),
    }


def test_history(spark):
    rows = [(i, f"c{i % 2}", f"raw {i}", f"short {i}") for i in range(10)]
    results = spark.createDataFrame(rows, "doc_id long, command string, raw_output string, compressed_output string").selectExpr(
        "*", "'list' as strategy", "'seed' as source", "10L as raw_tokens", "2L as compressed_tokens", "timestamp_seconds(doc_id) as created_at"
    )
    first = history.history_append(None, results.filter("doc_id < 6"), 4)
    assert sorted(r.id for r in first.collect()) == [3, 4, 5, 6]
    both = history.history_append(first, results.filter("doc_id >= 6"), 5)
    assert sorted((r.id, r.raw_output) for r in both.collect()) == [(i, f"raw {i - 1}") for i in range(6, 11)]
    assert history.history_latest(both, "c0").first().id == 9
    assert [r.id for r in history.history_recent(both, 0).collect()] == [10]
    assert history.restore(both).first().text == "raw 9"
    assert history.restore(both, ids=[7], compressed=True).first().text == "short 6"
    assert history.history_by_id(both, 1).count() == 0


def test_tool_events(spark):
    call = {"tool_input": {"command": "ls"}}
    cases = [
        ({"tool_name": "Bash", **call, "tool_response": {"output": "out"}}, ("tool_result", "out")),
        ({"tool_name": "Bash", **call, "tool_response": {"output": "", "stdout": "so", "stderr": "se"}}, ("tool_result", "so\nse")),
        ({"tool_name": "Bash", **call, "tool_response": {"stdout": "a se b", "stderr": "se"}}, ("tool_result", "a se b")),
        ({"tool_name": "Bash", **call, "tool_response": {"stderr": "se"}}, ("tool_result", "se")),
        ({"tool_name": "Bash", **call, "tool_response": "plain"}, ("tool_result", "plain")),
        ({"tool_name": "Bash", "turn_id": None, "tool_use_id": 1, **call, "tool_response": {"output": "x"}}, ("block", "x")),
        ({"tool_name": "run_shell_command", **call, "tool_response": {"llmContent": [{"text": "a"}, "b", {}]}}, ("deny", "a\nb\n")),
        ({"tool_name": "run_shell_command", **call, "tool_response": {"llmContent": "", "returnDisplay": "r"}}, ("deny", "r")),
        ({"tool_name": "Read", **call, "tool_response": {"output": "out"}}, None),
        ({"tool_name": "Bash", "tool_input": {"command": ""}, "tool_response": {"output": "out"}}, None),
        ({"tool_name": "Bash", **call, "tool_response": {}}, None),
        ({"type": "tool_result", "content": "done"}, None),
        ([1], None),
    ]
    data = [(i, json.dumps(event)) for i, (event, _) in enumerate(cases)] + [(99, "{broken")]
    df = spark.createDataFrame(data, "doc_id long, value string")
    found = {r.doc_id: (r.dialect, r.output) for r in events.normalize_tool_events(df).collect()}
    assert found == {i: want for i, (_, want) in enumerate(cases) if want}
    assert [r.doc_id for r in events.already_transformed(df).collect()] == [11]
    replies = events.tool_envelopes(events.normalize_tool_events(df).withColumn("result", F.lit("r"))).collect()
    by_id = {r.doc_id: json.loads(r.value) for r in replies}
    assert by_id[0] == {"type": "tool_result", "content": "r"}
    assert by_id[5] == {"decision": "block", "reason": "r"} and by_id[6] == {"decision": "deny", "reason": "r"}


def test_outputs_from_files(spark, tmp_path):
    for name, text in (("a.log", "one\r\ntwo\n"), ("b.log", "three")):
        (tmp_path / name).write_bytes(text.encode())
    found = read_outputs(spark, str(tmp_path), "text", "make").collect()
    assert sorted((r.command, r.output) for r in found) == [("make", "one\r\ntwo\n"), ("make", "three")]
    rows = tmp_path / "rows"
    spark.createDataFrame([(1, "ls", "x")], "id long, command string, output string").write.json(str(rows))
    assert read_outputs(spark, str(rows), "json", doc_id="id").collect() == [(1, "ls", "x")]


def test_short_segments_reach_python_as_rows(spark):
    rows = [(f"c{i % 3}", i, ["list", "table", None, "error"][i * i % 7 % 4]) for i in range(900)]
    calls = spark.createDataFrame(rows, "command string, seq long, shape string").filter("shape is not null")
    short, long = registry.learn_fold(calls, segment_calls=16), registry.learn_fold(calls, segment_calls=registry.SHORT_SEGMENT + 1)
    assert sorted(short.collect()) == sorted(long.collect())
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("MapInPandas") == 1
