"""Pattern dialect: patterns are written in Python's dialect and run by the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode classes, and ``\n`` as the only line end, as Python has it.
_FLAGS, _FLAGS_I = "(?Ud)", "(?Uid)"


def java(pattern: str, ignore_case: bool = False) -> str:
    if pattern.startswith("(?i)"):
        pattern, ignore_case = pattern[4:], True
    return (_FLAGS_I if ignore_case else _FLAGS) + pattern


def search(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(java(pattern, ignore_case))


#: Letters that fold to s, i or k when case is ignored, though ``lower`` keeps some of them.
_ODD_CASE, _ODD_FOLD = "\u017f\u0131\u0130\u212a", "siik"


def is_ascii(text: Column) -> Column:
    """One byte per character; a length comparison, far cheaper than a regex."""
    return F.octet_length(text) == F.length(text)


def folded(text: Column) -> Column:
    """Lower case, such that every case-insensitive match of a word contains the word."""
    odd = ~is_ascii(text) & text.rlike(f"[{_ODD_CASE}]")
    return F.when(odd, F.lower(F.translate(text, _ODD_CASE, _ODD_FOLD))).otherwise(F.lower(text))


def contains_any(lowered: Column, words: Iterable[str]) -> Column:
    """Cheap byte search used ahead of a regex that needs one of ``words``."""
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in words])


def tree(words: Iterable[str]) -> str:
    """An alternation of words as a tree of letters, the longest word first: one step a letter, however many the words."""
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def escaped(letter: str) -> str:
        return letter if letter.isalnum() or letter == "_" else "\\" + letter

    def below(node: dict) -> str:
        letters = sorted(c for c in node if c)
        if not letters:
            return ""
        ways = [escaped(c) + below(node[c]) for c in letters]
        if len(ways) > 8:  # a branch is found by ranges of its first letter
            parts = [range(i, min(i + 5, len(ways))) for i in range(0, len(ways), 5)]
            ways = [f"(?=[{''.join(escaped(letters[i]) for i in part)}])(?:{'|'.join(ways[i] for i in part)})" for part in parts]
        if len(ways) == 1 and "" not in node:
            return ways[0]
        return f"(?:{'|'.join(ways)})" + ("?" if "" in node else "")

    return below(root)


def marked(text: Column, pattern: str, group: int) -> Column:
    """The distinct non-empty values of a group over all matches of a pattern that reads each character once."""
    return F.array_distinct(F.array_remove(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), ""))


def word_heads(lowered: Column, heads: Iterable[str]) -> Column:
    """Which of ``heads`` (letters a to z) begin a word: of those that begin one word, the longest. One pass over the text.

    A word is a run of the letters a to z here, so it may also begin behind an accented letter.
    """
    return marked(lowered, f"({tree(heads)}|)[a-z]*+[^a-z]*+", 1)


def guarded(text: Column, lowered: Column, pattern: str, words: Sequence[str], ignore_case: bool = True) -> Column:
    """``search`` that is only tried where one of ``words`` occurs."""
    hit = search(text, pattern, ignore_case)
    return F.coalesce(contains_any(lowered, words) & hit if words else hit, F.lit(False))


def glob_regex(glob: str) -> str:
    """A whole-value regex for a shell glob (``*``, ``?``, ``[seq]``, ``[!seq]``)."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        else:
            out.append("\\" + ch if ch in ".^$+{}()|\\[]/-&~#" else ch)
        i += 1
    return "(?s)^(?:" + "".join(out) + ")\\z"


def is_glob(value: str) -> bool:
    return any(c in value for c in "*?[")


def glob_match(value: Column, patterns: Sequence[object]) -> Column:
    """A string column equals, or matches as a glob, any of ``patterns``; null never does."""
    wanted = [str(p) for p in patterns]
    tests = [value.isin(*wanted)] if wanted else []
    tests += [value.rlike(glob_regex(p)) for p in wanted if is_glob(p)]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(False)


def glob_match_any(values: Column, patterns: Sequence[object]) -> Column:
    """An array column has an element matching any of ``patterns``."""
    return F.coalesce(F.exists(values, lambda v: glob_match(v, patterns)), F.lit(False))
