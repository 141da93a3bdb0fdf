"""User patterns: written for Python, run by Java."""

from __future__ import annotations

import re
import warnings

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext

NAME = r"(?P<name>\w+)"


def to_java(pattern: str) -> str:
    """The pattern with the forms that only Python has written as Java has them."""

    def plain(m: re.Match) -> str:
        return "".join(c for c in m["name"] if c.isalnum() and c.isascii())

    pattern = re.sub(r"\(\?P<" + NAME + ">", lambda m: f"(?<{plain(m)}>", pattern)
    pattern = re.sub(r"\(\?P=" + NAME + r"\)", lambda m: f"\\k<{plain(m)}>", pattern)
    return re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", pattern)


def compiles(pattern: str) -> bool:
    """In Python as given and in Java as translated."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(to_java(pattern))
    except Py4JJavaError:
        warnings.warn(f"pattern {pattern!r} has no Java form and is not used", stacklevel=2)
        return False
    return True


def bad_patterns(patterns: list[str]) -> list[str]:
    return [p for p in patterns if not compiles(p)]


def java_patterns(patterns: list[str]) -> dict[str, str]:
    """Java form of each pattern that compiles."""
    return {p: to_java(p) for p in patterns if compiles(p)}
