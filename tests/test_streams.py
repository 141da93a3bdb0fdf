"""Streams over several micro-batches give the rows of one batch."""

import random

import pytest
from pyspark.sql import functions as F

from linefold.operators import chunks
from linefold.plans import catalog
from linefold.plans import condense as plan
from linefold.plans import fixtures as fx
from linefold.session import folders_in, shared_dir
from linefold.sources import registry
from linefold.streaming import lines as stream_lines
from linefold.streaming import late, learning, runs, sinks

SF = "/root/testdata/sf0.001"
ENTRY = ["command", "strategy", "calls", "confidence", "hot"]


def events_in_files(spark, folder, n=4):
    """The events cut into files in time order, one micro-batch each."""
    events = fx.read(spark, SF, "events")
    for i in range(n):
        events.filter(F.floor(F.col("event_id") * n / events.count()) == i).coalesce(1).write.parquet(f"{folder}/part{i}")
    reader = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return events, reader.parquet(folder)


def progress_lines(df):
    return df.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts", F.expr(fx.PROGRESS_LINE).alias("line"))


def test_line_rules(spark, tmp_path):
    batch, stream = events_in_files(spark, str(tmp_path / "in"))
    out = str(tmp_path / "errors")
    sinks.write_stream(stream_lines.progress_errors(progress_lines(stream)), out, out + "-c").awaitTermination()
    want = stream_lines.progress_errors(progress_lines(batch))
    assert sorted(spark.read.parquet(out).collect()) == sorted(want.collect())


CHUNK_ROWS = "run_id int, seq long, t double, chunk string, eof boolean"


def timed(spark, rows):
    df = spark.createDataFrame(rows, CHUNK_ROWS)
    return df.selectExpr("run_id", "seq", "timestamp_micros(cast(t * 1000000 as long)) as ts", "chunk", "eof")


def chunk_batches(spark, folder, rows, n=5):
    """Rows as a stream of ``n`` micro-batches, and a last one far in the future."""
    step = -(-len(rows) // n)
    for i in range(n):
        timed(spark, rows[i * step : (i + 1) * step]).coalesce(1).write.parquet(f"{folder}/p{i}")
    timed(spark, [(-1, 0, 9999.0, "", False)]).coalesce(1).write.parquet(f"{folder}/p{n}")
    return spark.readStream.schema(timed(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def random_chunks(seed, shuffled=0.9):
    """Chunks of five runs, in an order up to ``shuffled`` seconds off."""
    rng, rows = random.Random(seed), []
    for run in range(5):
        t = 0.0
        for seq in range(40):
            t += rng.choice([0.1, 0.2, 0.5, 2.5])
            text = "".join(rng.choice(["ab", "\n", "error: c", " ", "10%"]) for _ in range(rng.randint(0, 4)))
            rows.append((run, seq, t, None if rng.random() < 0.05 else text, seq == 39))
    return sorted(rows, key=lambda r: r[2] + rng.random() * shuffled)


def streamed(df, out):
    job = sinks.write_stream(df, out, out + "-c")
    job.awaitTermination()
    assert job.lastProgress["batchId"] >= 5
    return df.sparkSession.read.parquet(out).filter("run_id >= 0")


def test_lines_of_chunks_out_of_order(spark, tmp_path):
    rows = random_chunks(1)
    stream = chunk_batches(spark, str(tmp_path / "in"), rows)
    got = streamed(runs.lines_of_chunks(stream, 1.0), str(tmp_path / "out"))
    texts = timed(spark, rows).withColumn("chunk", F.coalesce("chunk", F.lit("")))
    want = chunks.assemble_chunks(texts).drop("part")
    assert sorted(tuple(r) for r in got.filter("not eof").select("run_id", "pos", "line").collect()) == sorted(tuple(r) for r in want.collect())
    assert got.filter("eof").count() == 5


def test_endless_line_goes_out_in_parts(spark, tmp_path):
    rows = [(1, i, 1 + i * 0.1, "abcdefg", False) for i in range(40)] + [(1, 40, 5.0, "hi\nlast", False), (1, 41, 5.1, "", True)]
    stream = chunk_batches(spark, str(tmp_path / "in"), rows)
    got = streamed(runs.lines_of_chunks(stream, 1.0, max_line=50), str(tmp_path / "out")).filter("not eof").orderBy("pos", "part").collect()
    assert "".join(r.line for r in got if r.pos == 0) == "abcdefg" * 40 + "hi"
    assert [r.part for r in got if r.pos == 0] == list(range(6)) and {len(r.line) for r in got[:5]} == {50}
    assert [(r.pos, r.part, r.line) for r in got[6:]] == [(1, 0, "last")]


def test_errors_and_final_lines(spark, tmp_path):
    rows = [(r, s, t, (c or "").strip("\n") or None, False) for r, s, t, c, _ in random_chunks(2)]
    stream = chunk_batches(spark, str(tmp_path / "in"), rows).withColumnRenamed("chunk", "line").drop("eof")
    got = streamed(runs.errors_and_final_lines(stream, 1.0, 2.0), str(tmp_path / "out"))
    lines = timed(spark, rows).withColumnRenamed("chunk", "line")
    errors = stream_lines.progress_errors(lines).select("run_id", "seq", "line")
    assert sorted(got.filter("kind = 'error'").select("run_id", "seq", "line").collect()) == sorted(errors.collect())
    finals = got.filter("kind = 'final'").select("run_id", "started", F.col("ts").alias("ended"), "line")
    assert sorted(finals.collect()) == sorted(stream_lines.final_lines(lines, 2.0).collect())


def sessions_of(df):
    return sorted(tuple(r) for r in df.filter("run_id >= 0").collect())


def test_rows_behind_the_watermark_are_kept_aside(spark, tmp_path):
    """Finals of the rows on time, and the late rows, are all rows; nothing is dropped in between."""
    rows = random_chunks(3, shuffled=6.0)
    stream = chunk_batches(spark, str(tmp_path / "in"), rows, 8)
    base = str(tmp_path / "split")
    late.split_late(stream, base, base + "/c", 0.5).awaitTermination()
    kept_aside = late.late_rows(spark, base)
    n_late = kept_aside.count()
    assert 0 < n_late < len(rows)
    reader = spark.readStream.schema(timed(spark, []).schema).option("maxFilesPerTrigger", 1)
    got = streamed(late.stall_sessions(late.on_time(reader, base), 2.0, 0.5), str(tmp_path / "out"))
    punctual = timed(spark, rows).join(kept_aside.select("run_id", "seq"), ["run_id", "seq"], "left_anti")
    assert got.agg(F.sum("n_chunks")).first()[0] == len(rows) - n_late
    assert sessions_of(got) == sessions_of(late.stall_sessions(punctual, 2.0))


@pytest.mark.parametrize("limit", [10_000, 12])
def test_silent_segments(spark, tmp_path, limit):
    rows = [(r, s, t, c or "", False) for r, s, t, c, _ in random_chunks(4)]
    stream = chunk_batches(spark, str(tmp_path / "in"), rows)
    got = streamed(runs.segments_of_chunks(stream, 1.0, 2.0, limit), str(tmp_path / "out"))
    want = chunks.segment_outputs(chunks.stall_segments(timed(spark, rows), 2.0), limit)
    columns = ["run_id", "segment", "part", "output", "reason"]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(map(tuple, want.select(columns).collect()), key=repr)


def test_shown_lines_and_restart(spark, tmp_path):
    """A whole run; the stream stops after every file and goes on from its checkpoint."""
    texts = ["Step a\n10", "%\n", "error: b\npass", "word: hunter2 token\nSte", "p c\n", "rest"]
    rows = [(1, i, 1 + i * 0.2, t, False) for i, t in enumerate(texts)] + [(1, 6, 6.0, "Step d\n", True)]
    out, folder = str(tmp_path / "out"), str(tmp_path / "in")
    stream = None
    for i, row in enumerate([*rows, (-1, 0, 9999.0, "", False)]):
        timed(spark, [row]).coalesce(1).write.parquet(f"{folder}/p{i}")
        stream = stream or spark.readStream.schema(timed(spark, []).schema).parquet(f"{folder}/*")
        sinks.write_stream(runs.shown_lines(stream, 1.0, 2.0), out, out + "-c").awaitTermination()
    got = spark.read.parquet(out).orderBy("ts").collect()
    assert [(r.kind, r.line) for r in got] == [("error", "error: b"), ("final", "rest"), ("final", "Step d")]
    assert got[1].ts.timestamp() % 60 == 4.0


def test_condensed_segments_in_run_order(spark):
    """Small segments are condensed, chunks of large ones pass through; together they are the run."""
    many = "same line\n" * 40
    rows = [(1, 0, 0.0, many, False), (1, 1, 9.0, many * 3, False), (1, 2, 9.5, many, False), (1, 3, 20.0, "a\nb", False), (2, 0, 0.0, None, False)]
    cut = chunks.segment_outputs(chunks.stall_segments(timed(spark, rows), 2.0), 1000)
    got = plan.condense_segments(cut.withColumn("command", F.lit("unknown tool"))).orderBy("run_id", "segment", "part").collect()
    assert [(r.run_id, r.segment, r.part) for r in got] == [(1, 0, 0), (1, 1, 1), (1, 1, 2), (1, 2, 0), (2, 0, 0)]
    assert "".join(r.result for r in got[1:3]) == many * 4 and got[1].reason == "output exceeds the size limit"
    assert got[0].result.count("\n") == 25 and got[3].result == "a\nb"


def test_swallowed_lines_are_no_silence(spark):
    texts = ["Step a", "10%", "20%", "30%", "40%", "Step b", "50%", "60%", "70%", "done"]
    rows = [(1, i, f"2026-01-01 00:00:{i:02d}", t) for i, t in enumerate(texts)] + [(2, 0, "2026-01-01 00:00:00", "x y"), (2, 1, "2026-01-01 00:00:02", "z")]
    lines = spark.createDataFrame(rows, "run_id int, seq int, ts string, line string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.run_id, r.line) for r in stream_lines.final_lines(lines, 2.0).collect()) == [(1, "done"), (2, "x y"), (2, "z")]


def test_learning(spark, tmp_path):
    _, stream = events_in_files(spark, str(tmp_path / "in"))
    calls = stream.selectExpr(
        "concat('cmd ', cast(user_id as string)) as command", "event_id as seq", "event_type as shape", "100L as raw", "50L as comp", "ts"
    )
    checkpoint = str(tmp_path / "registry")
    job = learning.stream_learn(calls, checkpoint)
    job.awaitTermination()
    assert job.lastProgress["batchId"] >= 3
    batch = fx.read(spark, SF, "events").selectExpr(
        "concat('cmd ', cast(user_id as string)) as command", "event_id as seq", "event_type as shape", "100L as raw", "50L as comp", "ts"
    )
    final, want = learning.registry_of_state(spark, checkpoint), registry.merge_registry(batch)
    assert sorted(final.select(*ENTRY).collect()) == sorted(want.select(*ENTRY).collect())


def test_learning_goes_on_from_a_registry(spark, tmp_path):
    def calls_of(first, last):
        rows = [(f"c{i % 3}", i, "list" if i % 5 else "table", i, i // 2) for i in range(first, last)]
        df = spark.createDataFrame(rows, "command string, seq long, shape string, raw long, comp long")
        return df.withColumn("ts", F.timestamp_seconds(F.col("seq")))

    user = registry.merge_registry(calls_of(0, 30)).withColumn("user_override", F.col("command") == "c1")
    calls_of(30, 90).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    stream = spark.readStream.schema(calls_of(0, 1).schema).parquet(str(tmp_path / "in/*"))
    checkpoint = str(tmp_path / "state")
    learning.stream_learn(stream, checkpoint, user).awaitTermination()
    # a later run takes the state, not the table it once began with
    calls_of(90, 100).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    learning.stream_learn(stream, checkpoint, user).awaitTermination()
    want = registry.merge_registry(calls_of(90, 100), registry.merge_registry(calls_of(30, 90), user))
    got = learning.registry_of_state(spark, checkpoint)
    assert got.columns == want.columns
    assert sorted(got.select(*ENTRY, "user_override", "last_seen").collect()) == sorted(want.select(*ENTRY, "user_override", "last_seen").collect())
    averages = [{r.command: round(r.avg_raw_tokens, 6) for r in df.collect()} for df in (got, want)]
    assert averages[0] == averages[1]


def test_tool_events(spark, tmp_path):
    """Files of JSON lines: events are answered, broken lines set aside, and a repeated batch replaces its files."""
    output = "\\n".join(["building the same target"] * 40)
    event = '{"tool_name": "Bash", "tool_input": {"command": "make"}, "tool_response": {"output": "%s"}}' % output
    answer = '{"type":"tool_result","content":"done"}'
    for i, lines in enumerate([[event, "{broken", ""], [answer, event, event, "[1, 2]", "null"]]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{i}.jsonl").write_text("\n".join(lines) + "\n")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    before = set(folders_in(spark, shared_dir(spark)))
    job = sinks.stream_tool_events(stream, out, out + "-c")
    job.awaitTermination()
    assert job.lastProgress["batchId"] == 1
    assert set(folders_in(spark, shared_dir(spark))) == before
    values = [r.value for r in spark.read.text(out + "/answers").collect()]
    assert len(values) == 4 and answer in values and sum("building" in v and "tool_result" in v for v in values) == 3
    assert sorted(r.value for r in spark.read.text(out + "/corrupt").collect()) == ["[1, 2]", "null", "{broken"]


def test_condensing(spark, tmp_path):
    docs = fx.outputs(spark, SF).limit(40)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    sinks.stream_condense(stream, out, out + "-c").awaitTermination()
    assert spark.read.parquet(out).count() == 40


@pytest.mark.parametrize("as_folder", [True, False])
def test_a_table_of_many_files_is_streamed_whole(spark, tmp_path, as_folder):
    docs = fx.read(spark, SF, "documents").limit(12)
    if as_folder:
        docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    else:
        docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    (tmp_path / "documents.parquet.old").mkdir()
    assert catalog.QUERIES["stream_condense"](spark, str(tmp_path)).count() == 12


class CountedState:
    """State of one run in memory, and how often it is accessed."""

    def __init__(self):
        self.values, self.timers, self.accesses = {}, set(), 0

    def variable(self, name, *_):
        return CountedVariable(self, name)

    getValueState = getListState = getMapState = variable

    def registerTimer(self, millis):
        self.accesses += 1
        self.timers.add(millis)


class CountedVariable:
    def __init__(self, state, name):
        self.state, self.name = state, name

    def __getattr__(self, call):
        def access(*args):
            values = self.state.values
            self.state.accesses += 1
            if call in ("update", "put"):
                values[self.name] = args[0]
            elif call == "updateValue":
                values.setdefault(self.name, {})[args[0]] = args[1]
            elif call == "removeKey":
                del values[self.name][args[0]]
            elif call == "iterator":
                return iter(list(values.get(self.name, {}).items()))
            elif call in ("appendList", "appendValue"):
                values.setdefault(self.name, []).extend(args[0] if call == "appendList" else args)
            elif call == "clear":
                values.pop(self.name, None)
            elif call == "exists":
                return self.name in values
            elif call == "get":
                found = values.get(self.name)
                return iter(found or []) if self.name in ("held", "rest", "pieces") else found

        return access


class Clock:
    def __init__(self, millis):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: millis


@pytest.mark.parametrize("make", [lambda: runs.Lines(2.0, 50), lambda: runs.Segments(2.0, 90_000), lambda: runs.ErrorsAndFinal(2.0)])
def test_accesses_to_state_do_not_grow_with_the_rows(make):
    def accesses(n):
        processor, state = make(), CountedState()
        processor.init(state)
        rows = [{"seq": i, "at": 1_000_000 + i * 1000, "eof": False, "chunk": "ab\n", "line": "sab"} for i in range(n)]
        found = list(processor.handleInputRows((1,), iter(rows), Clock(0)))
        assert not found
        while state.timers:
            state.timers.remove(at := min(state.timers))
            found += processor.handleExpiredTimer((1,), Clock(9_000_000), Clock(at))
        assert found
        return state.accesses

    assert accesses(800) == accesses(10) < 20
