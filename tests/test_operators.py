"""Worked examples of every condensing rule, and whole = segmented on random documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from linefold.operators import budget, chunks, contract, rows, shapes
from linefold.operators.ordered import number_lines, segment


def test_runs_and_ends(lines_of, texts):
    lines = lines_of({1: ["a"] * 4 + [" a", "", "b", "b"], 2: [f"l{i}" for i in range(40)]})
    collapsed = rows.collapse_runs(lines, 3).withColumn("ord", F.col("pos"))
    assert texts(collapsed)[1] == ["a [repeated 5x]", "b", "b"]
    assert texts(rows.generic(lines))[2] == [f"l{i}" for i in [*range(20), *range(30, 40)]]
    marked = rows.head_tail(lines, mark_all=True)
    assert texts(marked)[2][20] == "... [10 more lines]"
    assert texts(rows.generic(lines, max_lines=10))[2] == [
        *[f"l{i}" for i in range(6)], "... [30 more lines]", *[f"l{i}" for i in range(36, 40)]
    ]
    listed = texts(rows.list_lines(lines, max_lines=20))[2]
    assert listed == [*[f"l{i}" for i in range(16)], "... [20 more items]", *[f"l{i}" for i in range(36, 40)]]
    assert texts(rows.list_lines(lines, max_lines=40))[2] == [f"l{i}" for i in range(40)]


def test_contract_order(lines_of, texts):
    lines = lines_of({1: [f"l{i}" for i in range(40)]})
    shown = texts(rows.list_lines(lines, max_lines=4, keep=["l2[0-2]"], strip=["l21", "more"]))[1]
    assert shown == ["l0", "l1", "l2", "l39", "l20", "l22"]
    assert texts(rows.generic(lines, max_lines=4, keep=["l20"], strip=["l2"]))[1] == [
        "l0", "l1", "... [25 more lines]", "l38", "l39", "l20"
    ]


def test_directories(lines_of, texts):
    lines = lines_of({1: ["a/x", "top", "a/y", "b/z", "a/w", "a/v", "//r", "b\\c"]})
    assert texts(rows.list_lines(lines, group_dirs=True))[1] == ["top", "a/... [4 files]", "b/z", "//r", "b\\c"]


def test_progress(lines_of, texts):
    lines = lines_of({1: ["10%", "ERROR one", "step", "ERROR one", "50 MB/s", "done", " "], 2: ["a fail", "b"]})
    assert texts(shapes.progress(lines)) == {1: ["ERROR one", "done"], 2: ["a fail", "b"]}
    assert texts(shapes.progress(lines, keep_mode="all"))[1] == ["step", "done", "ERROR one"]


def test_test_run(lines_of, texts):
    lines = lines_of(
        {1: ["start", "t1 PASSED", "t2 FAILED", "x", "AssertionError: a", "y", "t3 FAILED", "AssertionError: a", "ok", "z",
             "==== 2 failed ===="]}
    )
    assert texts(shapes.test_run(lines, max_traceback_lines=2))[1] == [
        "t2 FAILED", "x", "AssertionError: a", "... [traceback truncated]", "t3 FAILED", "==== 2 failed ===="
    ]


def test_diff(lines_of, texts):
    diff = ["index 1..2", "--- a/f", "+++ b/f", "@@ -1 @@", " c1", " c2", " c3", "-old", "+new", " d1", " d2", " d3"]
    lines = lines_of({1: diff})
    assert texts(shapes.diff(lines, context_lines=1))[1] == [*diff[1:4], " c3", "-old", "+new", " d1"]
    two = lines_of({1: [*diff, "+++ b/g", "+1", "+2", "+++ b/f", "+3", "+++ /dev/null", "-4"]})
    assert texts(shapes.diff(two, max_lines=3))[1] == [shapes.DIFF_SUMMARY, "f: +1 -1", "g: +2 -0"]


def test_table(lines_of, texts):
    lines = lines_of({1: ["intro", "NAME  ID", "----  --", "a  1  2  3  4  5  6", "", "b" * 45 + "  9", "c  3", "d"]})
    assert texts(shapes.table(lines, max_rows=2))[1] == [
        "intro", "NAME  ID", "----  --", "a  1  2  3  4  ", "b" * 37 + "...  9", shapes.ROWS_CUT
    ]


def test_keyvalue(lines_of, texts):
    pairs = ["Name: a", "Status: b", "Size = 3", "plain", "Start time: x", "drop me: 1"]
    lines = lines_of({1: pairs})
    assert texts(shapes.keyvalue(lines, always_strip_keys=["^drop"]))[1] == pairs[:-1]
    assert texts(shapes.keyvalue(lines, max_lines=4))[1] == ["Name: a", "Size = 3", "plain", "drop me: 1", shapes.TIMES_CUT]
    assert texts(shapes.keyvalue(lines, max_lines=2))[1] == ["Name: a", "Size = 3", shapes.PAIRS_CUT]


def test_error(lines_of, texts):
    frames = [f'  File "a.py", line {i}' for i in range(4)]
    lines = lines_of(
        {1: ["before", "Traceback", frames[0], "    code0", frames[0], '  File "/venv/x.py"', "    lib", frames[1], frames[2],
             "    code2", frames[3], "ValueError: x", "Caused by y", "Caused by y"]}
    )
    assert texts(shapes.error_trace(lines, max_traceback_lines=2))[1] == [
        "before", "Traceback", frames[0], "    code0", "    lib", frames[1], shapes.FRAMES_CUT, "ValueError: x", "Caused by y"
    ]


def test_budgets(spark):
    texts = spark.createDataFrame([(1, "a b\nc d\n--\ne f"), (2, "one two three four"), (3, "tiny")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in budget.fit_to_budget(texts, 3).collect()} == {1: "a b c", 2: "one two three"}
    assert {r.doc_id: r.text for r in budget.fit_lines(texts, 7).collect()}[1] == f"a b\nc d\n--\n{budget.BUDGET_CUT}"


def test_chunks(spark):
    data = [(1, 0, "ab"), (1, 1, "c\nd"), (1, 2, "\n\ne"), (1, 3, " "), (2, 0, "x\n"), (2, 1, " ")]
    df = spark.createDataFrame(data, "run_id long, seq long, chunk string")
    lines = {(r.run_id, r.pos): r.line for r in chunks.assemble_chunks(df).collect()}
    assert lines == {(1, 0): "abc", (1, 1): "d", (1, 2): "", (1, 3): "e ", (2, 0): "x"}


VOCABULARY = {
    "rows": ["a", "a", "b", "c", "", " a ", "d/x", "d/y", "e/f/z", "keep"],
    "progress": ["10%", "step 1", "error x", "fail y", "eta 3", "done", ""],
    "tests": ["t FAILED", "t PASSED", "x", "AssertionError: 1", "AssertionError: 2", "expect(1)", "==== 1 failed", ""],
    "diff": ["+++ b/f", "+++ b/g", "--- a/f", "@@ 1", "+a", "-b", " c", " d", " e", "index 1", "+++ /dev/null"],
    "table": ["HEAD  X", "---  --", "a  b  c  d  e  f  g", "cell  2", "", "  ", "x\ty"],
    "pairs": ["Name: a", "At: b", "date = 3", "plain", "size=4", "other key: 5"],
    "trace": ["Traceback", "  File \"a\"", "  File \"b\"", "  File \"/venv/c\"", "    code", "    omitted", "Err: x",
              "Caused by z", "Exception Caused by z", "at line 3", ""],
}
OPERATORS = {
    "collapse": ("rows", lambda d: rows.collapse_runs(d, 2)),
    "generic": ("rows", lambda d: rows.generic(d, 9, 4, 3, keep=["^c", "keep"], strip=["2x"])),
    "list": ("rows", lambda d: rows.list_lines(d, 8, 5, 3, dedup=True, keep=["b"])),
    "directories": ("rows", lambda d: rows.list_lines(d, 8, 5, 3, group_dirs=True)),
    "progress": ("progress", lambda d: shapes.progress(d, "all")),
    "tests": ("tests", lambda d: shapes.test_run(d, 2)),
    "diff": ("diff", lambda d: shapes.diff(d, 25, 1)),
    "stat": ("diff", lambda d: shapes.diff_stat(d)),
    "table": ("table", lambda d: shapes.table(d, 4)),
    "pairs": ("pairs", lambda d: shapes.keyvalue(d, 9)),
    "trace": ("trace", lambda d: shapes.error_trace(d, 3)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_segments_do_not_change_results(spark, name):
    """Cutting documents into pieces of five positions gives the rows of whole documents."""
    words, apply = OPERATORS[name]
    rng = random.Random(name)
    data = []
    for doc in range(60):
        size = rng.choice([1, 3, 6, 17, 40])
        pool = rng.sample(VOCABULARY[words], rng.randint(2, len(VOCABULARY[words])))
        data += [(doc, pos, rng.choice(pool)) for pos in range(size)]
    lines = spark.createDataFrame(data, "doc_id long, pos long, line string").cache()
    whole = apply(lines)
    columns = [c for c in sorted(whole.columns) if c != "seg"]
    assert sorted(whole.select(*columns).collect()) == sorted(apply(segment(lines, 5)).select(*columns).collect())


def test_numbering_in_buckets(spark):
    df = spark.range(1000).selectExpr("id % 3 as doc_id", "id * 7 % 1000 as at")
    out = number_lines(df, "doc_id", ["at"], F.floor(F.col("at") / 10)).collect()
    for doc in range(3):
        ordered = sorted((r["at"], r["pos"]) for r in out if r["doc_id"] == doc)
        assert [pos for _, pos in ordered] == list(range(len(ordered)))


def test_strip_alone(lines_of):
    lines = lines_of({1: ["a", "b1", "c"]})
    assert contract.always_strip(lines, ["b\\d"]).count() == 2


def test_a_run_without_line_ends(spark):
    """A hundred thousand chunks of one line, and lines and rests around the limit, in parts."""
    endless = spark.range(100_000).selectExpr("1 as run_id", "id as seq", "cast(id % 10 as string) as chunk")
    texts = ["abcde\n", "abcdef", "ghij\nklmno", "", "pq", "\n", "     ", " "]
    short = spark.createDataFrame([(2, i, t) for i, t in enumerate(texts)] + [(3, 0, "  "), (3, 1, "   ")], "run_id int, seq long, chunk string")
    got = chunks.assemble_chunks(endless.unionByName(short), bucket=4096, max_line=5).groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "part", "line"))).alias("lines")
    )
    lines = {r.run_id: [tuple(x) for x in r.lines] for r in got.collect()}
    assert lines[1] == [(0, i, "01234" if i % 2 == 0 else "56789") for i in range(20_000)]
    assert lines[2] == [(0, 0, "abcde"), (1, 0, "abcde"), (1, 1, "fghij"), (2, 0, "klmno"), (2, 1, "pq"), (3, 0, "     "), (3, 1, " ")]
    assert 3 not in lines


def ladder_by_hand(lines, now, target, keep, strip):
    """The ladder as its rule says it: one text per rung, on the way down the smallest."""
    collapsed, i = [], 0
    rows = [line.strip() for line in lines if line.strip()]
    while i < len(rows):
        n = next((k for k in range(i, len(rows)) if rows[k] != rows[i]), len(rows)) - i
        collapsed += [f"{rows[i]} [repeated {n}x]"] if n >= 3 else rows[i : i + n]
        i += n
    collapsed = [line for line in collapsed if not re.search(strip, line)]
    best = None
    for most in (60, 40, 30, 20, 15, 10):
        head, tail = max(3, int(most * 0.6)), max(2, int(most * 0.3))
        shown = list(collapsed)
        if len(shown) > head + tail:
            more = [f"... [{len(shown) - head - tail} more lines]"] if len(shown) > most else []
            shown = [*shown[:head], *more, *shown[-tail:]]
        shown += list(dict.fromkeys(line for line in lines if re.search(keep, line) and line not in shown))
        text = "\n".join(shown)
        tokens = max(1, len(re.findall(r"[a-z0-9]+", text)))
        if text and tokens < (best[1] if best else now):
            best = (text, tokens)
        if text and tokens <= target:
            break
    return best


@pytest.mark.parametrize("seed, target", [(0, 12), (2, 60)])
def test_ladder_against_every_rung(spark, lines_of, seed, target):
    """Documents of no, few and many lines, repeats, blanks, kept lines at the ends, lost ones, and one that reads like a marker."""
    rng = random.Random(seed)
    pool = ["a b c", "k one", " k one", "x", "drop me", "", "  ", "k two three four", "... [7 more lines]", "b b", "d e f g h"]
    docs = {i: [rng.choice(pool) if rng.random() < 0.5 else f"l{j} w" for j in range(rng.choice([0, 1, 5, 12, 25, 64, 150]))] for i in range(40)}
    docs |= {100: ["drop me"] * 30, 101: ["", "k one"] + ["drop me"] * 30, 102: ["x", "y"] * 60, 103: [f"... [{n} more lines]" for n in range(90)]}
    now = {i: 40 for i in docs}
    keep, strip = r"^ ?k|^$|^\.\.\. \[7 ", "drop"
    sizes = spark.createDataFrame(list(now.items()), "doc_id long, tokens long")
    for form in (lines_of(docs), segment(lines_of(docs), 7)):
        for kept, stripped in (([keep], [strip]), (None, None)):
            found = budget.budget_ladder(form, sizes, target, kept, stripped).collect()
            want = {i: ladder_by_hand(v, now[i], target, keep if kept else r"(?!)", strip if kept else r"(?!)") for i, v in docs.items()}
            got = {r.doc_id: [r.text, r.tokens] for r in found}
            assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items() if v}
            assert {i: v[1] for i, v in got.items()} == {i: v[1] for i, v in want.items() if v}
