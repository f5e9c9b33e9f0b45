"""Text functions: normalisation, hidden segments, word sets, digests."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wardspark.functions.regex import is_ascii, java
from wardspark.functions.sqltext import strings

# Word lists.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "of", "to", "in", "on", "at", "by", "for", "with", "from",
    "as", "is", "are", "was", "were", "be", "been", "being", "this", "that", "these", "those", "it", "its", "it's",
    "you", "your", "we", "our", "they", "their", "he", "she", "his", "her", "i", "me", "my", "do", "does", "did",
    "not", "no", "can", "could", "would", "should", "will", "shall", "may", "might", "must", "have", "has", "had",
    "there", "here", "what", "which", "who", "when", "where", "why", "how", "all", "any", "some", "each", "other",
    "more", "most", "than", "so", "such", "only", "own", "same", "too", "very",
)
MEMORY_STOPWORDS = (
    "the", "and", "for", "with", "from", "that", "this", "when", "where", "what", "have", "has", "was", "were", "are",
    "you", "your", "our", "their",
)

# Character sets and candidates.
INVISIBLE = r"[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\x{E0000}-\x{E007F}]"
BASE64_RUN = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{16,}={0,2}(?![A-Za-z0-9+/=])"
HEX_RUN = r"(?<![0-9a-fA-F])(?:[0-9a-fA-F]{2}){12,}(?![0-9a-fA-F])"
SPACED_LETTERS = r"(?<=\b\w)[\s.\-_*]{1,2}(?=\w\b)"
#: What is no base64 character; written out, as a negated class costs several times as much.
_OTHER = r"[\x00-*,-.:-@\[-`{-\x{10FFFF}]"
#: What SPACED_LETTERS finds, tested from the separator, which is rarer than a letter.
_SPACED = r"[\s.\-_*](?<=\b\w[\s.\-_*])[\s.\-_*]?(?=\w\b)"

#: Latin text whose compatibility normal form is itself; anything else goes to the normaliser.
_NFKC_STABLE = (
    r"^[\x00-\x7f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131"
    r"\u0134-\u013e\u0141-\u0148\u014a-\u017e\u2010\u2012-\u2016\u2018-\u2023\u20ac]*+$"
)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def is_plain(text: Column) -> Column:
    """The text is its own compatibility form and holds no invisible character."""
    return is_ascii(text) | text.rlike(_NFKC_STABLE)


def nfkc(text: Column, plain: Column | None = None) -> Column:
    """Unicode compatibility form; only rows that may change are sent to Python."""
    unstable = ~(is_plain(text) if plain is None else plain)
    return F.coalesce(_nfkc(F.when(unstable, text)), text)


def count_invisible(text: Column, plain: Column | None = None) -> Column:
    return F.when(is_ascii(text) if plain is None else plain, F.lit(0)).otherwise(F.regexp_count(text, F.lit(INVISIBLE)))


def undo_spacing(text: Column, plain: Column | None = None) -> Column:
    """Drop invisible characters, then close up ``i g n o r e`` and ``i-g-n-o-r-e``."""
    shown = F.when(is_ascii(text) if plain is None else plain, text).otherwise(F.regexp_replace(text, INVISIBLE, ""))
    return F.transform(
        F.array(shown), lambda s: F.when(s.rlike(java(_SPACED)), F.regexp_replace(s, java(SPACED_LETTERS), "")).otherwise(s)
    )[0]


def normalise_text(text: Column, plain: Column | None = None) -> Column:
    return undo_spacing(nfkc(text, plain), plain)


def has_long_run(text: Column) -> Column:
    """Sixteen base64 characters in a row: what any encoded segment contains. Each character is read once."""
    return text.rlike(rf"\A{_OTHER}*+(?:[A-Za-z0-9+/]{{1,15}}+{_OTHER}++)*+[A-Za-z0-9+/]{{16}}")


def decoded_segments(text: Column, long_run: Column | None = None) -> Column:
    """Readable plaintexts hidden as base64 or hex, base64 first."""

    def candidates(pattern: str) -> Column:
        runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.when(has_long_run(text) if long_run is None else long_run, runs).otherwise(F.array().cast("array<string>"))

    def from_base64(run: Column) -> Column:
        core = F.rtrim(run, F.lit("="))
        fill = (4 - F.length(core) % 4) % 4
        valid = (F.length(core) % 4 != 1) & (F.length(run) - F.length(core) <= fill)
        return F.when(valid, F.try_to_binary(F.concat(core, F.repeat(F.lit("="), fill)), F.lit("base64")))

    def readable(raw: Column) -> Column:
        plain = F.try_validate_utf8(raw.cast("string"))
        unprintable = F.regexp_count(
            plain, F.lit(r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}&&[^\t-\r\x1c-\x1f\x{85}]]")
        )
        ok = (
            (F.length(plain) >= 8)
            & ((F.length(plain) - unprintable) / F.length(plain) > 0.95)
            & plain.rlike(r"[A-Za-z]{3}(?U:\s)[A-Za-z]{2}")
        )
        return F.when(ok, plain)

    plains = F.concat(
        F.transform(candidates(BASE64_RUN), lambda s: readable(from_base64(s))),
        F.transform(candidates(HEX_RUN), lambda s: readable(F.try_to_binary(s, F.lit("hex")))),
    )
    return F.filter(plains, lambda p: p.isNotNull())


def words(text: Column) -> Column:
    """Lower-case ASCII alphanumeric words, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingles_of_words(ws: Column, n: int) -> Column:
    """Distinct word n-grams; a short text that still has enough words is one shingle."""
    size = F.size(ws)
    grams = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))
    return (
        F.when(size >= n, F.array_distinct(grams))
        .when(size >= max(3, n // 2), F.array(F.array_join(ws, " ")))
        .otherwise(F.array().cast("array<string>"))
    )


def shingles(text: Column, n: int = 6) -> Column:
    """Word n-grams of a text. The words are bound by a lambda, so they are split once, not per gram."""
    return F.transform(F.array(words(text)), lambda ws: shingles_of_words(ws, n))[0]


def content_words(text: Column) -> Column:
    """Distinct words longer than two characters that are not stop words."""
    kept = F.array_except(words(text), strings(STOPWORDS))
    return F.filter(kept, lambda w: F.length(w) > 2)


def memory_terms(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_.\-]{3,}"), F.lit(0))
    return F.array_except(found, strings(MEMORY_STOPWORDS))


def split_sentences(text: Column) -> Column:
    """Pieces ending in ``.``, ``!`` or ``?`` followed by white space; blank ones dropped."""
    return F.filter(F.split(text, java(r"(?<=[.!?])\s+")), lambda s: F.length(F.trim(s)) > 0)


def digest(text: Column, salt: str) -> Column:
    return F.left(F.sha2(F.concat(F.lit(salt), text), 256), F.lit(32))


def argument_text(name: Column, arguments: Column) -> Column:
    """``name(key='value', …)`` with keys in order, for a string map."""

    def quoted(v: Column) -> Column:
        body = F.replace(v, F.lit("\\"), F.lit("\\\\"))
        for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            body = F.replace(body, F.lit(raw), F.lit(shown))
        double = F.contains(v, F.lit("'")) & ~F.contains(v, F.lit('"'))
        single = F.replace(body, F.lit("'"), F.lit("\\'"))
        return F.when(v.isNull(), "None").when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), single, F.lit("'"))
        )

    pairs = F.transform(
        F.array_sort(F.map_entries(arguments)), lambda e: F.concat(e["key"], F.lit("="), quoted(e["value"]))
    )
    return F.concat(name, F.lit("("), F.coalesce(F.array_join(pairs, ", "), F.lit("")), F.lit(")"))


_PART = "struct<type:string,text:string,content:string>"


def flatten_content(content: Column) -> Column:
    """Message content (a plain string, or a JSON list of parts) as text.

    Parts nest one level: a tool result holds a string or a list of text parts.
    """

    def part_text(p: Column, inner: bool) -> Column:
        out = F.when(p["type"].isin("text", "input_text", "output_text"), p["text"])
        if inner:
            nested = F.array_join(
                F.filter(
                    F.transform(F.from_json(p["content"], f"array<{_PART}>"), lambda q: part_text(q, False)),
                    lambda s: s.isNotNull() & (s != ""),
                ),
                "\n",
            )
            out = out.when(
                p["type"] == "tool_result", F.when(p["content"].startswith("["), nested).otherwise(p["content"])
            )
        return out

    parts = F.transform(F.from_json(content, f"array<{_PART}>"), lambda p: part_text(p, True))
    joined = F.array_join(F.filter(parts, lambda s: s.isNotNull() & (s != "")), "\n")
    return F.when(content.isNull(), "").when(content.rlike(r"^\s*\["), joined).otherwise(content)


def _model_facing_parts(definition: dict) -> list[str]:
    """Name, description and every descriptive string in the parameter schema, depth first."""
    schema = definition.get("inputSchema") or definition.get("parameters") or definition.get("input_schema") or {}
    parts = [str(definition.get("name") or ""), str(definition.get("description") or "")]
    todo: list[tuple[bool, object]] = [(False, schema)]
    while todo:
        is_text, node = todo.pop()
        if is_text:
            parts.append(node if isinstance(node, str) else json.dumps(node, default=str))
        elif isinstance(node, list):
            todo.extend((False, v) for v in reversed(node))
        elif isinstance(node, dict):
            for key, value in reversed(list(node.items())):
                todo.append((False, value))
                if key in ("description", "title", "default", "examples", "enum"):
                    todo.append((True, value))
    return [p for p in parts if p]


def _each(definitions: pd.Series, fn) -> pd.Series:
    def one(raw):
        try:
            parsed = json.loads(raw) if raw is not None else None
        except ValueError:
            return None
        return fn(parsed) if isinstance(parsed, dict) else None

    return definitions.map(one).astype("object")


@F.pandas_udf(StringType())
def tool_text(definition: pd.Series) -> pd.Series:
    """Everything a model reads of a JSON tool definition, one string per row."""
    return _each(definition, lambda d: "\n".join(_model_facing_parts(d)))


@F.pandas_udf(StringType())
def canonical_tool(definition: pd.Series) -> pd.Series:
    """Name, description and schema as sorted, compact JSON."""

    def one(d: dict) -> str:
        schema = d.get("inputSchema") or d.get("parameters") or d.get("input_schema") or {}
        body = {"name": d.get("name"), "description": d.get("description") or "", "schema": schema}
        return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)

    return _each(definition, one)


def tool_fingerprint(definition: Column) -> Column:
    return F.sha2(canonical_tool(definition), 256)


def join_nonblank(sep: str, cols: Sequence[Column]) -> Column:
    """Non-null, non-empty columns joined by ``sep``."""
    return F.array_join(F.filter(F.array(*cols), lambda c: c.isNotNull() & (c != "")), sep)
