"""Patterns that mean the same to Python's re and to Java's."""

from __future__ import annotations

import re

#: Constructs whose meaning differs, or that one of the two engines lacks.
REJECTED = {
    r"\(\?P=": "named back-reference",
    r"\(\?\(": "conditional group",
    r"\\[pP]\{": "Unicode property",
    r"\\Z": "end of text",
    r"\\[GQEXRhHvV]": "Java escape",
    r"\(\?[<]?#": "comment group",
    r"\[[^\]]*&&": "class intersection",
}


class PatternError(ValueError):
    """The pattern cannot be used in both engines alike."""


def java_pattern(pattern: str, *, ignore_case: bool = True) -> str:
    """The Java form of a Python pattern, or PatternError.

    Named groups are respelled. Without case, matching is Unicode-aware, as
    Python's is.
    """
    try:
        re.compile(pattern)
    except re.error as e:
        raise PatternError(f"{pattern!r}: {e}") from e
    for construct, name in REJECTED.items():
        if re.search(construct, pattern):
            raise PatternError(f"{pattern!r}: {name}")
    java = re.sub(r"\(\?P<", "(?<", pattern)
    return f"(?iU){java}" if ignore_case else f"(?U){java}"


def safe_pattern(pattern: object, spark=None) -> str | None:
    """The pattern if it compiles in Python, and in Java where a session is given; else None."""
    if not isinstance(pattern, str) or not pattern.strip():
        return None
    try:
        java = java_pattern(pattern)
        if spark is not None:
            spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception:  # Java's PatternSyntaxException comes as a Py4J error
        return None
    return pattern


def alternation(terms: list[str]) -> str:
    """A pattern that matches any of the terms literally."""
    return "|".join(re.escape(t) for t in terms if t)
