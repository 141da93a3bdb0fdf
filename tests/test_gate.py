from pyspark.sql import functions as F

from linefold.functions import safety, shape
from linefold.functions.safety import BINARY, BLOCKED, ERROR_SHAPE, MINIMAL, SENSITIVE

LONG = "\n".join(f"row {i}" for i in range(20))


def reasons(spark, cases, **options):
    df = spark.createDataFrame([(i, c, o) for i, (c, o) in enumerate(cases)], "i int, command string, output string")
    return [r.reason for r in safety.gate(df, **options).orderBy("i").collect()]


def test_reasons_in_order(spark):
    cases = [
        ("terraform plan", "password\n" + LONG),
        ("printenv", LONG),
        ("envelope", LONG),
        ("cat a", LONG + "\nmy PASSWORD here"),
        ("cat a", LONG + "\nsecretary password_strength"),
        ("cat .env", LONG),
        ("cat a", LONG + "\npa\u017f\u017fword"),
        ("cat a", LONG + "\nAuthorization: Bearer abc"),
        ("cat a", "\x00" + LONG),
        ("cat a", "\x01" * 2000 + LONG),
        ("cat a", "\n".join(["x"] * 14)),
        ("cat a", "\n".join(["x"] * 15)),
        ("cat a", LONG + "\nforbidden7"),
    ]
    assert reasons(spark, cases, blocklist=["terra", "# cat"], extra_patterns=[r"forbidden\d", "(broken"]) == [
        BLOCKED,
        SENSITIVE,
        None,
        SENSITIVE,
        None,
        SENSITIVE,
        SENSITIVE,
        SENSITIVE,
        BINARY,
        BINARY,
        MINIMAL,
        None,
        SENSITIVE,
    ]


def test_every_pattern_holds_a_word_of_the_prefilter(spark):
    hits = [
        "x.env", ".env.local", "id_rsa", "id_ed25519", "a.pem", "a.key", "a.p12", "a.pfx", "credentials", "secret",
        "password", "api_key", "apikey", "AWS_SECRET", "GITHUB_TOKEN", "bearer x", "-----BEGIN", "-----END", ".ssh/",
        "$HOME", "echo $x", "private-key", ".netrc", "vault read", "git credential", "ssh-keygen",
        "openssl req -new -key", "openssl genrsa", "/etc/shadow",
    ]
    df = spark.createDataFrame([(h,) for h in hits + [h.upper() for h in hits]], "s string")
    assert df.filter(~safety.sensitive_text(F.col("s"))).collect() == []


def test_error_passthrough(spark):
    trace = 'Traceback (most recent call last):\n  File "a.py", line 1\n    go()\n' * 6
    assert reasons(spark, [("python a", trace)], pass_errors=True) == [ERROR_SHAPE]
    assert reasons(spark, [("python a", trace)]) == [None]


def test_shapes(spark):
    cases = {
        "": ("generic", 0.0),
        "hello": ("generic", 0.0),
        "\n".join(f"file{i}.txt" for i in range(25)): ("list", 1.0),
        "Downloading 10%\nDownloading 50%\nDownloading 100%": ("progress", 0.8),
        "test_a PASSED\ntest_b FAILED\n==== 1 failed ====": ("test", 1.0),
        "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-old\n+new": ("diff", 1.0),
        "NAME  ID\n----  --\na  1\nb  2\nc  3": ("table", 1.0),
        "first key: a\nother key: b\nthird key: c": ("keyvalue", 0.7),
        'Traceback\n  File "a.py", line 1\n    go()\nValueError': ("error", 1.0),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, output string")
    found = [(r.shape, r.confidence) for r in shape.detect(df).orderBy("i").collect()]
    assert found == list(cases.values())


def test_mean_length_is_computed_once_an_output(spark):
    """Inside the lambda over lines it would be summed over all lines for every line."""
    docs = spark.range(2).selectExpr("id as doc_id", "repeat('a line\\n', 30) as output")
    plan = shape.detect(docs)._jdf.queryExecution().optimizedPlan().toString()
    within = plan.split("abs((cast(length(")[1].split("<= 20.0")[0]
    assert "aggregate(" not in within


def test_keys_go_over_lines(spark):
    """The counts of keys are those of the plain patterns, which give characters back."""
    texts = ["a b: c\nd=e", "a\nb\nc: d\ne f = g", ":x\na:\n b", "a a\na\n", "", "a == b\nc: : d\ne:  \n", "a=\n\nb", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, output string")
    colon, equals = (p.replace("++", "+").replace("*+", "*") for p in (shape.KEY_COLON, shape.KEY_EQUALS))
    want = df.select(F.regexp_count("output", F.lit(colon)), F.regexp_count("output", F.lit(equals)))
    got = df.select(shape._keys(F.col("output"), shape.KEY_COLON, ":"), shape._keys(F.col("output"), shape.KEY_EQUALS, "="))
    assert list(map(tuple, got.collect())) == list(map(tuple, want.collect()))


def test_one_pass_finds_every_sensitive_word_and_nothing_else(spark):
    words = [p + w + q for w in safety.SENSITIVE_WORDS for p, q in (("", ""), ("xx ", " yy"), ("a", "b\n"))]
    parts = [w[1:] for w in safety.SENSITIVE_WORDS if len(w) > 3] + [w[:-1] for w in safety.SENSITIVE_WORDS if len(w) > 3]
    df = spark.createDataFrame([(t,) for t in [*words, *parts, "", "plain text"]], "t string")
    found = df.select("t", F.col("t").rlike(safety.any_word(safety.SENSITIVE_WORDS)).alias("hit")).collect()
    assert {r.t: r.hit for r in found} == {r.t: any(w in r.t for w in safety.SENSITIVE_WORDS) for r in found}
