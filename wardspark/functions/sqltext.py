"""Column expressions written as SQL text.

Wide tables of rules are turned into one parsed expression instead of thousands of column
objects: the plan is the same, and building it costs the driver one call.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardspark.functions.regex import glob_regex, is_glob, java


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, (list, tuple)):
        return array(value)
    return text(str(value))


def array(values: Iterable[object]) -> str:
    items = [literal(v) for v in values]
    return f"array({', '.join(items)})" if items else "cast(array() as array<string>)"


def mapping(table: Mapping[object, object]) -> str:
    return "map(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in table.items()) + ")"


def strings(values: Iterable[str]) -> Column:
    """A literal string array column."""
    return F.expr(array(list(values)))


def rlike(column: str, pattern: str, ignore_case: bool = False) -> str:
    return f"({column} RLIKE {text(java(pattern, ignore_case))})"


def any_word(column: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def any_head(found: str, lowered: str, words: Sequence[str], heads: Mapping[str, str]) -> str:
    """One of ``words`` may occur: by its head among those found (see ``regex.word_heads``), or by a byte search."""
    known = {heads[w] for w in words if w in heads}
    longer = sorted({h for h in heads.values() if h.startswith(tuple(known))}) if known else []
    tests = [f"arrays_overlap({found}, {array(longer)})"] if known else []
    rest = [w for w in words if w not in heads]
    return "(" + " OR ".join(tests + ([any_word(lowered, rest)] if rest else [])) + ")"


def guarded(column: str, lowered: str, pattern: str, words: Sequence[str], ignore_case: bool = True) -> str:
    """A regex test tried only where one of ``words`` occurs."""
    hit = rlike(column, pattern, ignore_case)
    return f"({any_word(lowered, words)} AND {hit})" if words else hit


def glob(column: str, patterns: Iterable[object]) -> str:
    """Equal to, or matching as a glob, any of ``patterns``; null never does."""
    wanted = [str(p) for p in patterns]
    if not wanted:
        return "false"
    tests = [f"{column} IN ({', '.join(text(p) for p in wanted)})"]
    tests += [f"{column} RLIKE {text(glob_regex(p))}" for p in wanted if is_glob(p)]
    return f"coalesce({' OR '.join(tests)}, false)"


def glob_any(column: str, patterns: Iterable[object]) -> str:
    return f"coalesce(exists({column}, v -> {glob('v', list(patterns))}), false)"


def chosen(tests: Sequence[tuple[str, str]], element: str = "string") -> Column:
    """The values whose condition holds, in order; ``tests`` are (condition, value) in SQL."""
    if not tests:
        return F.expr(f"cast(array() as array<{element}>)")
    cases = ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in tests)
    return F.expr(f"filter(array({cases}), x -> x IS NOT NULL)")
