"""The two wildcard languages: query globs, which never cross dots, and export wildcards, which do."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_MAGIC = re.compile(r"[*{}\[\],]")


def is_pattern(segment: str) -> bool:
    return bool(_MAGIC.search(segment))


def segment_regex(segment: str) -> str:
    """Anchored regex of one segment: ``*`` any text, ``{a,b}`` alternatives, ``[...]`` as it is, ``?`` itself."""
    table = {"*": ".*", "{": "(", "}": ")", ",": "|", "?": r"\?"}
    return "^" + "".join(table.get(c, c) for c in segment) + "$"


def split_pattern(pattern: str) -> list[str]:
    return pattern.split(".")


def segment_matches(value: Column, segment: str) -> Column:
    if segment == "*":
        return value.isNotNull()
    return value.rlike(segment_regex(segment)) if is_pattern(segment) else value == segment


def glob_matches(name: Column, pattern: str) -> Column:
    """True where ``name`` has as many segments as ``pattern`` and each matches its own.

    The literal text before the first wildcard is also given as a range condition, so that a Parquet scan can skip row groups.
    """
    segments = split_pattern(pattern)
    if not any(map(is_pattern, segments)):
        return name == pattern
    own = F.split(name, r"\.")
    matches = F.size(own) == len(segments)
    for i, segment in enumerate(segments):
        if segment != "*":
            matches = matches & segment_matches(own[i], segment)
    start = literal(pattern)
    return (name.startswith(start) & matches) if start else matches


def literal(pattern: str) -> str:
    """The text before the first wildcard."""
    m = _MAGIC.search(pattern)
    return pattern[: m.start()] if m else pattern


def wildcard_matches(name: Column, wildcard: str) -> Column:
    """``*`` is any text, dots too; ``?`` is one character."""
    if wildcard == "*":
        return name.isNotNull()
    return name.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([\\.^$|()\[\]{}+*?])", r"\\\1", c) for c in wildcard) + "$")
