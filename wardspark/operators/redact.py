"""Redaction of payloads and of audit text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardspark.functions import regex, spans
from wardspark.functions.text import digest
from wardspark.operators.scan import REGISTRY
from wardspark.operators.signals import SAFETY_NET


def finding_spans(findings: Column, detectors: Sequence[str] | None = None) -> Column:
    """Spans of fired findings, optionally of the named detectors only."""
    kept = F.filter(findings, lambda f: f["detected"] if detectors is None else f["detected"] & f["detector"].isin(*detectors))
    return F.flatten(F.transform(kept, lambda f: f["spans"]))


def redacted_payload(text: Column, findings: Column) -> Column:
    """``text`` with the spans of every rewriting detector replaced in one pass."""
    mutating = [name for name, d in REGISTRY.items() if d.mutates]
    return spans.redact_spans(text, finding_spans(findings, mutating))


def safety_net(text: Column, extra: Sequence[str] = ()) -> tuple[Column, Column]:
    """Last-line redaction: (redacted text, labels hit in order)."""
    out, labels = text, []
    for e in SAFETY_NET:
        pattern = regex.java(e.pattern, e.ignore_case)
        labels.append(F.when(out.rlike(pattern), F.lit(e.label)))
        out = F.regexp_replace(out, pattern, f"[REDACTED:{e.label}]")
    for p in extra:
        labels.append(F.when(out.rlike(regex.java(p)), F.lit("custom")))
        out = F.regexp_replace(out, regex.java(p), "[REDACTED:custom]")
    return out, F.array_distinct(F.filter(F.array(*labels), lambda x: x.isNotNull()))


def truncated(text: Column, limit: int) -> Column:
    over = F.length(text) - limit
    cut = F.concat(F.left(text, F.lit(limit)), F.lit("…[truncated "), over.cast("string"), F.lit(" chars]"))
    return F.when((F.lit(limit) > 0) & (over > 0), cut).otherwise(text)


def audit_payload(
    text: Column, findings: Column | None = None, *, mode: str = "redacted", salt: str = "", include: bool = True,
    max_chars: int = 0, extra: Sequence[str] = (),
) -> tuple[Column, Column]:
    """What of a payload may be stored: (text, redacted labels); ``max_chars`` 0 keeps all of it."""
    nothing = F.lit(None).cast("string")
    no_labels = F.array().cast("array<string>")
    if mode == "none" or not include:
        return nothing, no_labels
    present = text.isNotNull()
    if mode == "hash_only":
        return F.when(present, F.concat(F.lit("sha256:"), digest(text, salt))), F.when(present, F.lit(["*"])).otherwise(no_labels)
    if mode == "full":
        return truncated(text, max_chars), no_labels
    if mode != "redacted":
        raise ValueError(f"unknown redaction mode {mode!r}")
    if findings is None:
        shown, names = text, no_labels
    else:
        found = finding_spans(findings)
        shown = spans.redact_spans(text, found)
        names = F.transform(spans.merge_spans(found), lambda s: s["label"])
    out, extra_names = safety_net(shown, extra)
    labels = F.array_distinct(F.concat(names, extra_names))
    return truncated(out, max_chars), F.when(present, labels).otherwise(no_labels)
