"""How a scan is declared and run.

A scan is a narrow projection: levels of helper columns followed by one finding struct.
``run_scans`` merges the levels of many scans, so ten scans cost a handful of projections
and no shuffle. Scans are plain functions of a :class:`ScanInput`; registering one under
an existing name replaces it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions import regex, spans, sqltext
from wardspark.operators.signals import HEADS, Entity, Signal
from wardspark.schema import FINDING_DDL

_HITS = "array<struct<id:string,weight:double,family:string>>"


@dataclass(frozen=True)
class ScanInput:
    """The columns a scan may read. Only ``text`` is required."""

    text: Column
    stage: str = "input"
    trust: Column | None = None
    roles: Column | None = None
    authenticated: Column | None = None
    tool: Column | None = None
    tool_risk: Column | None = None
    history_chars: Column | None = None
    history_messages: Column | None = None
    max_tokens: Column | None = None
    grounding: Column | None = None
    system_text: Column | None = None
    conversation_finding: Column | None = None

    def or_default(self, name: str, default: Any) -> Column:
        value = getattr(self, name)
        return F.lit(default) if value is None else F.coalesce(value, F.lit(default))

    @property
    def trust_col(self) -> Column:
        return self.or_default("trust", "user")

    @property
    def roles_col(self) -> Column:
        empty = F.array().cast("array<string>")
        return empty if self.roles is None else F.coalesce(self.roles, empty)


@dataclass(frozen=True)
class Scan:
    name: str
    finding: Column
    levels: Sequence[Mapping[str, Column]] = ()


@dataclass(frozen=True)
class Detector:
    """A registered scan: where it may run, what it reports, how it fails."""

    build: Callable[[ScanInput, Mapping[str, Any]], Scan]
    stages: tuple[str, ...]
    category: str
    mutates: bool = False
    fail_mode: str = "open"
    enabled: bool = True
    options: Mapping[str, Any] = field(default_factory=dict)

    def with_options(self, **options: Any) -> Detector:
        return replace(self, options={**self.options, **options})


REGISTRY: dict[str, Detector] = {}


def register(name: str, detector: Detector) -> None:
    """Add a scan, or replace the one of that name."""
    REGISTRY[name] = detector


def detector(name: str, **kw: Any) -> Callable:
    def wrap(build: Callable) -> Callable:
        register(name, Detector(build=build, **kw))
        return build

    return wrap


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Put computed columns behind a one-row generator.

    A filter on a computed column is otherwise inlined through every projection that led to
    it, which multiplies the expressions. It stays above this node instead, while filters on
    other columns still pass through. No shuffle, one output row per input row.
    """
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, F.inline(F.array(F.struct(*names))))


def with_scalars(df: DataFrame, one_row: DataFrame, *names: str) -> DataFrame:
    """Add the columns of a one-row aggregate as a scalar subquery: no join, null where there is no row."""
    row = one_row.select(F.struct(*names).alias("_row")).scalar()
    return df.withColumn("_row", row).select("*", *[F.col("_row")[n].alias(n) for n in names]).drop("_row")


def run_scans(df: DataFrame, scans: Sequence[Scan], out: str = "findings") -> DataFrame:
    """Add ``out``, the array of findings in the order of ``scans``."""
    temps: dict[str, None] = {}
    for depth in range(max((len(s.levels) for s in scans), default=0)):
        cols: dict[str, Column] = {}
        for scan in scans:
            if depth < len(scan.levels):
                cols.update({k: v for k, v in scan.levels[depth].items() if k not in temps})
        temps.update(dict.fromkeys(cols))
        df = df.withColumns(cols)
    found = F.array(*[s.finding.cast(FINDING_DDL) for s in scans]) if scans else F.array().cast(f"array<{FINDING_DDL}>")
    return settle(df.withColumn(out, found).drop(*temps), out)


def run_scan(df: DataFrame, scan: Scan, out: str | None = None) -> DataFrame:
    """Add one finding struct named ``out`` (the scan's name by default)."""
    name = out or scan.name
    return run_scans(df, [scan], "_found").withColumn(name, F.col("_found")[0]).drop("_found")


def finding(
    name: str,
    category: str,
    hit: Column,
    *,
    score: Column,
    severity: Column,
    action: Column,
    summary: Column | None = None,
    span_list: Column | None = None,
    evidence: Column | None = None,
    threats: Column | None = None,
    options: Mapping[str, Any] | None = None,
) -> Column:
    """A finding struct; a miss is the clean finding (score 0, info, allow)."""
    override = (options or {}).get("override_action")
    no_spans = spans.empty_spans()
    no_names = F.array().cast("array<string>")

    found = F.struct(
        F.lit(name), F.lit(True), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), severity,
        F.lit(override) if override else action, summary if summary is not None else F.lit(name), F.lit(category),
        span_list if span_list is not None else no_spans, evidence if evidence is not None else F.lit(None),
        F.lit(None), F.lit(None), threats if threats is not None else no_names,
    ).cast(FINDING_DDL)
    clean = F.expr(
        f"cast(struct({sqltext.text(name)}, false, 0.0D, 'info', 'allow', '', {sqltext.text(category)}, array(), NULL, NULL, NULL, "
        f"array()) as {FINDING_DDL})"
    )
    return F.when(F.coalesce(hit, F.lit(False)), found).otherwise(clean)


def no_hits() -> Column:
    return F.array().cast(_HITS)


def hit_struct(id_: str, weight: float | Column, family: str = "") -> Column:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.struct(F.lit(id_).alias("id"), w.alias("weight"), F.lit(family).alias("family"))


def hit_sql(id_: str, weight: float, family: str = "") -> str:
    return f"named_struct('id', {sqltext.text(id_)}, 'weight', {float(weight)!r}D, 'family', {sqltext.text(family)})"


def signal_hits(
    text: str, lowered: str, signals: Sequence[Signal], also: str | None = None, long_run: str | None = None,
    found: str | None = None,
) -> Column:
    """The matched signals of a table, in table order; arguments are column names or SQL conditions.

    ``found`` holds the word heads of the text, for tables of ``HEADS``.
    """
    tests = []
    for s in signals:
        if found is None:
            test = sqltext.guarded(text, lowered, s.pattern, s.words, s.ignore_case)
        else:
            test = gated(text, lowered, found, s.pattern, (s.words, *s.also), s.ignore_case)
        if s.id == "base64_blob" and long_run is not None:
            test = f"{long_run} AND {test}"
        tests.append((test if also is None else f"{also} AND {test}", hit_sql(s.id, s.weight, s.family)))
    return sqltext.chosen(tests, _HITS[6:-1]).cast(_HITS)


def gated(text: str, lowered: str, found: str, pattern: str, groups: Sequence[Sequence[str]], ignore_case: bool = True) -> str:
    """A regex test tried only where a word of each group may occur."""
    tests = [sqltext.any_head(found, lowered, words, HEADS) for words in groups if words]
    return "(" + " AND ".join([*tests, sqltext.rlike(text, pattern, ignore_case)]) + ")"


def present(structs: Sequence[Column]) -> Column:
    """The non-null elements, as a hit array."""
    if not structs:
        return no_hits()
    return F.filter(F.array(*structs), lambda h: h.isNotNull()).cast(_HITS)


def ids(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["id"])


def max_weight(hits: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(hits, lambda h: h["weight"])), F.lit(0.0))


def saturate(weights: Sequence[Column]) -> Column:
    """``1 - prod(1 - w)``: evidence adds up with diminishing returns."""
    product = reduce(lambda a, w: a * (F.lit(1.0) - w), weights, F.lit(1.0))
    return F.lit(1.0) - product


def saturate_hits(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(1.0), lambda a, h: a * (F.lit(1.0) - h["weight"]), lambda a: F.lit(1.0) - a)


def table_spans(text: Column, hit_ids: Column, rows: Sequence[tuple[str, str, str, str]], first_only: bool = False) -> Column:
    """Spans of the rules named in ``hit_ids``; rows are (id, label, lead with flags, pattern).

    The rules are one literal array walked by a lambda, so the plan stays small however
    long the table is, and only rows that hit pay for offsets.
    """
    t = sqltext.text
    rules = F.expr("array(" + ", ".join(
        f"named_struct('id', {t(i)}, 'label', {t(label)}, 'lead', {t(lead)}, 'pattern', {t(p)})" for i, label, lead, p in rows
    ) + ")")
    wanted = F.filter(rules, lambda r: F.array_contains(hit_ids, r["id"]))

    def of(rule: Column) -> Column:
        found = spans.find_spans_by(text, rule["pattern"], rule["lead"], rule["label"])
        return F.slice(found, 1, 1) if first_only else found

    return F.when(F.size(hit_ids) > 0, F.flatten(F.transform(wanted, of))).otherwise(spans.empty_spans(True))


def signal_rows(signals: Sequence[Signal], prefix: str = "") -> list[tuple[str, str, str, str]]:
    return [(s.id, prefix + s.id, regex.java("", s.ignore_case), s.pattern) for s in signals]


def entity_rows(entities: Sequence[Entity], prefix: str = "") -> list[tuple[str, str, str, str]]:
    out = []
    for e in entities:
        flags = regex.java("", e.ignore_case)
        out.append((e.label, prefix + e.label, flags + e.lead, e.pattern))
    return out


def json_evidence(**cols: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()]))
