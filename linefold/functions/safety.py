"""Safety gate: why an output is passed through unchanged."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import java_patterns
from .shape import detect
from .text import line_array, strip

# Sensitive patterns, commands that print the environment, limits, reasons.
SENSITIVE_PATTERNS = [
    r"\.env$",
    r"\.env\.",
    r"\bid_rsa\b",
    r"\bid_ed25519\b",
    r"\.pem\b",
    r"\.key\b",
    r"\.p12\b",
    r"\.pfx\b",
    r"\bcredentials\b",
    r"\bsecret\b",
    r"\bpassword\b",
    r"\bapi[_-]?key\b",
    r"\bAWS_SECRET\b",
    r"\bGITHUB_TOKEN\b",
    r"\bbearer\s+[a-zA-Z0-9]",
    r"-----BEGIN",
    r"-----END",
    r"\.ssh/",
    r"\$[A-Z_]{4,}",
    r"echo\s+\$",
    r"\bprivate[_-]?key\b",
    r"\.netrc\b",
    r"\bvault\s+read\b",
    r"\bgit\s+credential\b",
    r"\bssh-keygen\b",
    r"openssl\s+(?:genrsa|ecparam|genpkey|pkcs12|req\s.*-key)",
    r"/etc/(?:passwd|shadow|sudoers)",
]
# Lower-case text that every match of the patterns above holds.
SENSITIVE_WORDS = [
    ".env",
    "id_rsa",
    "id_ed25519",
    ".pem",
    ".key",
    ".p12",
    ".pfx",
    "credential",
    "secret",
    "password",
    "api",
    "github_token",
    "bearer",
    "-----begin",
    "-----end",
    ".ssh/",
    "$",
    "private",
    ".netrc",
    "vault",
    "ssh-keygen",
    "openssl",
    "/etc/",
]
# Characters that are rare in texts, rarest first.
RARE = "_$-./2vkbpcgywmf"
# Characters that match a plain letter when case is ignored.
FOLDED, PLAIN = "\u017f\u0131\u0130\u212a", "siik"
SENSITIVE_COMMANDS = ["printenv", "declare", "env", "set", "history", "fc"]
BINARY_SAMPLE_CHARS = 4096
UNPRINTABLE = r"[\p{C}\p{Z}&&[^ \n\r\t]]"
MIN_LINES = 15
ERROR_CONFIDENCE = 0.7
BLOCKED, SENSITIVE, BINARY, MINIMAL, ERROR_SHAPE = (
    "command in user blocklist",
    "security sensitive content detected",
    "binary output detected",
    "minimal output",
    "error output pass-through",
)


def _any_pattern(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?iuUd)" + "|".join(f"(?:{p})" for p in patterns))


def any_word(words: list[str]) -> str:
    """A pattern that finds any of the words in one pass: a rare character of each word first, then what is around it."""

    def quoted(part: str) -> str:
        return "".join(c if c.isalnum() else "\\" + c for c in part)

    around: dict[str, list[str]] = {}
    for word in words:
        rare = min(word, key=lambda c: RARE.find(c) if c in RARE else len(RARE))
        at = word.index(rare)
        before = f"(?<={quoted(word[: at + 1])})" if at else ""
        around.setdefault(rare, []).append(before + quoted(word[at + 1 :]))
    each = [f"(?<={quoted(c)})(?:{'|'.join(rest)})" for c, rest in around.items()]
    return f"[{''.join(map(quoted, around))}](?:{'|'.join(each)})"


def sensitive_text(text: Column, extra_patterns: list[str] | None = None) -> Column:
    """A pattern matches, whatever the case. The regex runs only on texts with one of its words."""
    holds_folded = reduce(or_, [F.contains(text, F.lit(c)) for c in FOLDED])
    odd = (F.octet_length(text) > F.length(text)) & holds_folded
    folded = F.lower(F.when(odd, F.translate(text, FOLDED, PLAIN)).otherwise(text))
    suspect = folded.rlike(any_word(SENSITIVE_WORDS))
    hit = suspect & _any_pattern(text, SENSITIVE_PATTERNS)
    for pattern in java_patterns(extra_patterns or []).values():  # a bad one is skipped, as a rule of the gate
        hit = hit | text.rlike("(?iuUd)" + pattern)
    return hit


def sensitive_command(command: Column) -> Column:
    first_word = F.regexp_extract(strip(command), r"(?U)^[^\s\x1c-\x1f]+", 0)
    return first_word.isin(SENSITIVE_COMMANDS)


def is_binary(text: Column, ratio: float = 0.3) -> Column:
    sample = F.substring(text, 1, BINARY_SAMPLE_CHARS)
    share = F.regexp_count(sample, F.lit(UNPRINTABLE)) / F.nullif(F.length(sample), F.lit(0))
    return F.contains(sample, F.lit("\x00")) | F.coalesce(share > F.lit(ratio), F.lit(False))


def is_minimal(text: Column, min_lines: int = MIN_LINES) -> Column:
    return F.size(line_array(text)) < min_lines


def blocklisted(command: Column, prefixes: list[str]) -> Column:
    """Raw prefix test, without a word boundary; the list is a job parameter."""
    wanted = [p.strip() for p in prefixes]
    wanted = [p for p in wanted if p and not p.startswith("#")]
    hit = F.lit(False)
    for prefix in wanted:
        hit = hit | F.startswith(strip(command), F.lit(prefix))
    return hit


def skip_reason(
    command: Column,
    output: Column,
    *,
    blocklist: list[str] | None = None,
    extra_patterns: list[str] | None = None,
    binary_ratio: float = 0.3,
    min_lines: int = MIN_LINES,
) -> Column:
    """First reason that holds, in order; null for an output to condense."""
    return (
        F.when(blocklisted(command, blocklist or []), F.lit(BLOCKED))
        .when(
            sensitive_command(command)
            | sensitive_text(command, extra_patterns)
            | sensitive_text(output, extra_patterns),
            F.lit(SENSITIVE),
        )
        .when(is_binary(output, binary_ratio), F.lit(BINARY))
        .when(is_minimal(output, min_lines), F.lit(MINIMAL))
    )


def gate(outputs: DataFrame, *, pass_errors: bool = False, **options) -> DataFrame:
    """Add ``reason``; with ``pass_errors`` confident error traces are passed through too."""
    df = outputs.withColumn("reason", skip_reason(F.col("command"), F.col("output"), **options))
    if not pass_errors:
        return df
    is_error = (F.col("shape") == "error") & (F.col("confidence") >= F.lit(ERROR_CONFIDENCE))
    return (
        detect(df)
        .withColumn("reason", F.coalesce("reason", F.when(is_error, F.lit(ERROR_SHAPE))))
        .drop("shape", "confidence")
    )


def safety_report(outputs: DataFrame, **options) -> DataFrame:
    """Outputs per reason ('' counts the ones to condense)."""
    return (
        gate(outputs, **options)
        .groupBy(F.coalesce("reason", F.lit("")).alias("reason"))
        .agg(F.count("*").alias("n_outputs"))
    )
