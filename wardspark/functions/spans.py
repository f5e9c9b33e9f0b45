"""Exact match spans, merging and replacement, in code points, without Python workers.

A regex cannot report offsets from SQL, so matches are fenced with one private-use
character, the text is split on it, and offsets are the running lengths of the parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardspark.functions.regex import java

FENCE = "\ue000"
FLAGS = r"^\(\?[A-Za-z]+\)"
_SPAN_TEXT = "array<struct<start:int,end:int,label:string,text:string>>"
_SPAN = "array<struct<start:int,end:int,label:string>>"


def empty_spans(with_text: bool = False) -> Column:
    return F.array().cast(_SPAN_TEXT if with_text else _SPAN)


def find_spans_by(text: Column, pattern: Column, lead: Column, label: Column) -> Column:
    """All matches of ``lead`` + ``pattern``, the span covering ``pattern`` only.

    The pattern columns may differ per element; leading flags belong to ``lead``.
    """
    fenced = F.regexp_replace(
        F.translate(text, FENCE, "\ufffd"),
        F.concat(F.regexp_extract(lead, FLAGS, 0), F.lit("("), F.regexp_replace(lead, FLAGS, ""), F.lit(")("), pattern, F.lit(")")),
        F.lit(f"$1{FENCE}$2{FENCE}"),
    )
    start = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("hit"), empty_spans(True).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["pos"] + F.length(part)
        found = F.struct(acc["pos"].alias("start"), end.alias("end"), label.alias("label"), part.alias("text"))
        return F.struct(
            end.alias("pos"),
            (~acc["hit"]).alias("hit"),
            F.when(acc["hit"], F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(F.split(fenced, FENCE), start, step, lambda a: a["out"])


def find_spans(text: Column, pattern: str, label: str, ignore_case: bool = False, lead: str = "") -> Column:
    """Spans of one pattern; rows without a match do no offset work."""
    found = find_spans_by(text, F.lit(pattern), F.lit(java(lead, ignore_case)), F.lit(label))
    return F.when(text.rlike(java(lead + pattern, ignore_case)), found).otherwise(empty_spans(True))


def keep_first_claims(spans: Column) -> Column:
    """Drop every span overlapping an earlier one in the array (precedence order)."""
    return F.aggregate(
        spans,
        empty_spans(True),
        lambda taken, s: F.when(
            F.exists(taken, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"])), taken
        ).otherwise(F.concat(taken, F.array(s))),
    )


def strip_text(spans: Column) -> Column:
    """Spans without the matched text, as findings store them."""
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))
    )


def _ordered(spans: Column) -> Column:
    keyed = F.transform(
        spans,
        lambda s, i: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), i.alias("i"), s["label"].alias("label")),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda k: F.struct(k["a"].alias("start"), (-k["b"]).alias("end"), k["label"].alias("label")),
    )


def merge_spans(spans: Column) -> Column:
    """Disjoint spans: overlapping ones are joined and their labels joined with ``+``."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(
            last["start"].alias("start"), s["end"].alias("end"), F.concat_ws("+", last["label"], s["label"]).alias("label")
        )
        return (
            F.when(F.size(acc) == 0, F.array(s))
            .when(s["start"] >= last["end"], F.concat(acc, F.array(s)))
            .when(s["end"] > last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))
            .otherwise(acc)
        )

    return F.aggregate(_ordered(spans), empty_spans(), step)


def outermost_spans(spans: Column) -> Column:
    """Spans not contained in another one."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        inside = (F.size(acc) > 0) & (s["start"] >= last["start"]) & (s["end"] <= last["end"])
        return F.when(inside, acc).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(_ordered(spans), empty_spans(), step)


def redact_spans(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by ``[REDACTED:label]``; spans may overlap."""
    merged = F.filter(
        merge_spans(spans), lambda s: (s["start"] >= 0) & (s["start"] <= s["end"]) & (s["end"] <= F.length(text))
    )
    replaced = F.aggregate(
        F.reverse(merged),
        text,
        lambda t, s: F.concat(
            F.substring(t, F.lit(1), s["start"]),
            F.lit("[REDACTED:"), s["label"], F.lit("]"),
            F.substring(t, s["end"] + 1, F.length(t)),
        ),
    )
    return F.when(F.size(spans) > 0, replaced).otherwise(text)
