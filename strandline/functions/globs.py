"""Shell-style globs as Java regular expressions, and overlapping substring search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set("\\.^$|?*+()[]{}-&~#")


def glob_to_regex(pattern: str) -> str:
    """An anchored regex for a whole-string, case-sensitive glob: `*` crosses '/', `?` is any one
    character, `[...]` and `[!...]` are sets (a first ']' is literal), an unclosed '[' is literal."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            start = i + 1 + (pattern[i + 1 : i + 2] == "!")
            end = pattern.find("]", start + 1)
            if end < 0:
                out.append(r"\[")
            else:
                body = pattern[start:end]
                safe = "".join("\\" + x if x in _SPECIAL - {"-"} else x for x in body)
                out.append("[" + ("^" if start == i + 2 else "") + safe + "]")
                i = end
        else:
            out.append("\\" + c if c in _SPECIAL else c)
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def as_list(patterns: str | list[str]) -> list[str]:
    return [patterns] if isinstance(patterns, str) else list(patterns)


def matches(col: Column, patterns: str | list[str]) -> Column:
    """True where any pattern matches; false for an empty list."""
    hit = F.lit(False)
    for p in as_list(patterns):
        hit = hit | col.rlike(glob_to_regex(p))
    return hit


def any_matches(paths: Column, patterns: str | list[str]) -> Column:
    """True where any path of an array matches any pattern."""
    return F.exists(paths, lambda p: matches(p, patterns))


def find_all_indices(col: Column, sub: str) -> Column:
    """0-based starts of all occurrences, overlapping ones too; empty for an empty `sub`."""
    if not sub:
        return F.array().cast("array<int>")
    last = F.length(col) - len(sub) + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(starts, lambda i: F.substring(col, i, F.lit(len(sub))) == sub), lambda i: i - 1)
