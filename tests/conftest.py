import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("linefold-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines_of(spark):
    """A line table from {doc_id: text or list of lines}."""

    def make(docs):
        rows = []
        for doc, lines in docs.items():
            lines = lines.split("\n") if isinstance(lines, str) else lines
            rows += [(doc, pos, line) for pos, line in enumerate(lines)]
        return spark.createDataFrame(rows, "doc_id long, pos long, line string")

    return make


@pytest.fixture
def texts():
    """{doc_id: [lines in order]} of a result."""

    def collect(result):
        out = {}
        for row in sorted(result.select("doc_id", "ord", "line").collect(), key=lambda r: (r.doc_id, r.ord)):
            out.setdefault(row.doc_id, []).append(row.line)
        return out

    return collect
