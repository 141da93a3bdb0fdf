"""The given tables seen as outputs, line tables, call logs, chunks and tool events.

Documents made from events, line items, parts, orders or customers can hold any share of
their table, so their lines are numbered in buckets of the order key and marked as segmented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import explode_lines
from ..operators.ordered import number_lines, segment
from ..session import spread, staged

BUCKET = 1 << 16


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The command each document source stands for.
SOURCE_COMMANDS = {
    "src0": "git status",
    "src1": "git diff HEAD",
    "src2": "git log --oneline",
    "src3": "git push",
    "src4": "git pull",
    "src5": "git stash list",
    "src6": "docker ps -a",
    "src7": "docker build .",
    "src8": "docker logs web",
    "src9": "docker images",
    "src10": "pytest tests",
    "src11": "jest",
    "src12": "cargo test",
    "src13": "npm install",
    "src14": "pip install x",
    "src15": "cargo build",
    "src16": "npm run build",
    "src17": "ls -R",
    "src18": "find src",
}


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One command output per document."""
    command = F.create_map(*[F.lit(v) for kv in SOURCE_COMMANDS.items() for v in kv])[F.col("source")]
    return spread(read(spark, sf_dir, "documents")).select(
        "doc_id", F.coalesce(command, F.lit("unknown tool")).alias("command"), F.col("text").alias("output")
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, of any size."""
    return explode_lines(outputs(spark, sf_dir))


def _numbered(rows: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Numbered once and stored: the operators read their lines more than once."""
    return segment(staged(number_lines(rows, "doc_id", order, bucket).select("doc_id", "pos", "line"), "lines"))


def event_lines(spark: SparkSession, sf_dir: str, line: str = "event_type") -> DataFrame:
    """Events of a user, in id order, as the lines of one log."""
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), "event_id", F.expr(line).alias("line")
    )
    return _numbered(rows, ["event_id"], F.floor(F.col("event_id") / BUCKET))


PROGRESS_LINE = """case event_type
  when 'error' then concat('error: step ', cast(event_id % 7 as varchar(9)))
  when 'view' then concat(cast(event_id % 100 as varchar(9)), '%')
  when 'click' then '10 MB/s ETA 1m'
  else concat('Step ', cast(event_id % 20 as varchar(9)), '/20') end"""
TEST_LINE = """case event_type
  when 'error' then concat('t.py::test_', cast(event_id % 50 as varchar(9)), ' FAILED')
  when 'view' then concat('t.py::test_', cast(event_id % 50 as varchar(9)), ' PASSED')
  when 'click' then concat('AssertionError: ', cast(event_id % 5 as varchar(9)))
  else '    trace line' end"""
TRACE_LINE = """case event_type
  when 'signup' then 'Traceback (most recent call last):'
  when 'view' then concat('  File "app.py", line ', cast(event_id % 3 as varchar(9)))
  when 'click' then '    call()'
  when 'purchase' then '  File "/usr/lib/python3/x.py", line 1'
  else 'ValueError: bad' end"""
DIFF_LINE = """case when l_linenumber = 1 then concat('+++ b/f', cast(l_orderkey % 40 as varchar(9)))
  when l_returnflag = 'A' then concat('+p', cast(l_partkey as varchar(12)))
  when l_returnflag = 'R' then concat('-p', cast(l_partkey as varchar(12)))
  else concat(' p', cast(l_partkey as varchar(12))) end"""
PATH_LINE = "concat(p_brand, '/', p_type, '/', cast(p_partkey as varchar(12)))"
TABLE_LINE = (
    "concat(cast(o_orderkey as varchar(12)), '   ', o_orderstatus, '   ', o_orderpriority, '   a   b   c')"
)
PAIR_LINE = """concat(case c_custkey % 3 when 0 then 'Name' when 1 then 'Start time' else 'Market segment' end,
  ': ', c_mktsegment)"""


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), "l_orderkey", "l_linenumber", "l_partkey", F.expr(DIFF_LINE).alias("line")
    )
    return _numbered(
        rows, ["l_orderkey", "l_linenumber", "l_partkey"], F.floor(F.col("l_orderkey") / BUCKET)
    )


def path_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(
        (F.col("p_size") % 5).cast("bigint").alias("doc_id"), "p_partkey", F.expr(PATH_LINE).alias("line")
    )
    return _numbered(rows, ["p_partkey"], F.floor(F.col("p_partkey") / BUCKET))


def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as table rows below a header and a separator."""
    rows = read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 100).alias("doc_id"), "o_orderkey", F.expr(TABLE_LINE).alias("line")
    )
    body = number_lines(rows, "doc_id", ["o_orderkey"], F.floor(F.col("o_orderkey") / BUCKET))
    body = body.select("doc_id", (F.col("pos") + 2).alias("pos"), "line")
    top = rows.select("doc_id").distinct().select(
        "doc_id",
        F.inline(
            F.expr(
                "array(named_struct('pos', 0L, 'line', 'ORDER   STATUS   PRIORITY   A   B   C'),"
                " named_struct('pos', 1L, 'line', '-----   ------   --------   -   -   -'))"
            )
        ),
    )
    return segment(staged(top.unionByName(body), "lines"))


def pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("doc_id"), "c_custkey", F.expr(PAIR_LINE).alias("line")
    )
    return _numbered(rows, ["c_custkey"], F.floor(F.col("c_custkey") / BUCKET))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call log: (command, seq, shape, raw, comp, session_id, ts)."""
    return read(spark, sf_dir, "events").selectExpr(
        "concat('cmd ', cast(user_id as string)) as command",
        "event_id as seq",
        """case when user_id % 3 = 0 then 'list'
           when event_type = 'error' then 'error'
           when event_type = 'view' and user_id % 3 = 1 then 'table'
           else 'list' end as shape""",
        "100 + event_id % 900 as raw",
        "50 + event_id % 400 as comp",
        "event_id div 16 as session_id",
        "ts",
    )


def as_chunks(events: DataFrame, *more: str) -> DataFrame:
    """Terminal chunks: a third of them end a line."""
    return events.selectExpr(
        "user_id as run_id",
        "event_id as seq",
        "ts",
        "concat('chunk ', event_type, case when event_id % 3 = 0 then '\\n' else '' end) as chunk",
        *more,
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_chunks(read(spark, sf_dir, "events"))


SEGMENT_LINES = "array_join(transform(sequence(0, event_id % 30), i -> concat('line ', i % 4, ' ', event_type, '\\n')), '')"


def run_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of many lines, whose silent segments are worth condensing."""
    return read(spark, sf_dir, "events").selectExpr("user_id as run_id", "event_id as seq", "ts", f"{SEGMENT_LINES} as chunk")
