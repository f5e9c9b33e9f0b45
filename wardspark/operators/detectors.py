"""The per-text scans. Every one is a narrow projection built from the pattern tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardspark.functions import checks, regex, spans, sqltext
from wardspark.functions import text as X
from wardspark.functions.ranks import AUTHORITY, REQUIRED_AUTHORITY, SEVERITIES, TIERS, authority, lookup, worst
from wardspark.operators import signals as S
from wardspark.operators.scan import (
    Scan,
    ScanInput,
    detector,
    entity_rows,
    finding,
    gated,
    hit_sql,
    hit_struct,
    ids,
    json_evidence,
    max_weight,
    no_hits,
    present,
    saturate,
    saturate_hits,
    signal_hits,
    signal_rows,
    table_spans,
)

Options = Mapping[str, Any]


TEXT, LOWER, WORDS = "_text", "_lc", "_heads"


def _text(data: ScanInput) -> list[dict[str, Column]]:
    """Levels every scan starts with: the text under a fixed name, then its folded form."""
    return [{TEXT: data.text}, {LOWER: regex.folded(F.col(TEXT))}]


def _heads(data: ScanInput) -> list[dict[str, Column]]:
    """The same, then the heads of its words: scans that run together share one pass over the text."""
    return [*_text(data), {WORDS: regex.word_heads(F.col(LOWER), S.HEADS.values())}]


def _summary(prefix: str, names: Column) -> Column:
    return F.concat(F.lit(prefix + " ("), F.array_join(F.array_sort(F.array_distinct(names)), ", "), F.lit(")"))


def _labels(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(found, lambda s: s["label"])))


# --- personal data -----------------------------------------------------------------


def _pii_valid(s: Column) -> Column:
    label, value = s["label"], s["text"]
    return (
        F.when(label == "credit_card", checks.luhn_valid(value))
        .when(label == "us_ssn", checks.ssn_valid(value))
        .when(label == "iban", checks.iban_valid(value))
        .when(label == "phone", checks.phone_valid(value))
        .otherwise(F.lit(True))
    )


def pii_table(opts: Options) -> list[S.Entity]:
    """The entities in force: built-in ones, cards and account numbers first, then custom ones."""
    custom = [S.Entity(k, v["pattern"], v.get("severity", "medium")) for k, v in (opts.get("custom") or {}).items()]
    table = [*S.PII, *custom]
    chosen = opts.get("entities")
    unknown = set(chosen or ()) - {e.label for e in table}
    if unknown:
        raise ValueError(f"unknown PII entities: {', '.join(sorted(unknown))}")
    return [_first_tested(e) for e in table if not chosen or e.label in chosen]


def _first_tested(e: S.Entity) -> S.Entity:
    """A built-in entity whose lead looks ahead to what the pattern begins with; the matches are the same."""
    first = S.PII_FIRST.get(e.label) if e in S.PII else None
    return e._replace(lead=f"(?={first})" + e.lead) if first else e


def pii_candidates(text: str, lowered: str, table: list[S.Entity], found: str, digit: str) -> Column:
    """Labels whose pattern matches at all, before checksums; arguments are column names."""
    built_in = {e.label for e in S.PII}
    tests = []
    for e in table:
        hit = sqltext.rlike(text, e.lead + e.pattern, e.ignore_case)
        if e.label in S.PII_NEEDS:
            hit = f"{sqltext.any_head(found, lowered, S.PII_NEEDS[e.label], S.HEADS)} AND {hit}"
        elif e.label in built_in:
            hit = f"{digit} AND {hit}"
        tests.append((hit, sqltext.text(e.label)))
    return sqltext.chosen(tests)


def pii_spans(text: Column, candidates: Column, table: list[S.Entity]) -> Column:
    """Valid spans, earlier entities claiming text before later ones."""
    found = table_spans(text, candidates, entity_rows(table))
    return spans.keep_first_claims(F.filter(found, _pii_valid))


@detector("pii", stages=("input", "output", "tool_call", "tool_result", "memory_write"), category="sensitive_data",
          mutates=True, fail_mode="closed")
def scan_pii(data: ScanInput, opts: Options) -> Scan:
    table = pii_table(opts)
    found = F.col("_pii_spans")
    blocked = [b for b in opts.get("block_entities", ())]
    action = F.lit(opts.get("action", "redact"))
    if blocked:
        action = F.when(F.arrays_overlap(_labels(found), sqltext.strings(blocked)), "block").otherwise(action)
    sev = {e.label: e.severity for e in table}
    severity = worst(F.transform(found, lambda s: lookup(s["label"], sev)), SEVERITIES, "info")
    counts = F.map_from_entries(
        F.transform(_labels(found), lambda lb: F.struct(lb, F.size(F.filter(found, lambda s: s["label"] == lb))))
    )
    return Scan(
        "pii",
        finding(
            "pii", "sensitive_data", F.size(found) > 0, score=F.lit(1.0), severity=severity, action=action,
            summary=_summary("personal data", F.transform(found, lambda s: s["label"])),
            span_list=spans.strip_text(found),
            evidence=json_evidence(labels=_labels(found), counts=counts), options=opts,
        ),
        [
            *_heads(data)[:2],
            {**_heads(data)[2], "_pii_digit": F.col(TEXT).rlike("[0-9]")},
            {"_pii_cand": pii_candidates(TEXT, LOWER, table, WORDS, "_pii_digit")},
            {"_pii_spans": pii_spans(F.col(TEXT), F.col("_pii_cand"), table)},
        ],
    )


# --- credentials -------------------------------------------------------------------


def vendor_hits(text: str, lowered: str, found: str) -> Column:
    def hit(e: S.Entity) -> str:
        test = sqltext.guarded(text, text, e.pattern, (S.VENDOR_NEEDS[e.label],), False)
        words = S.VENDOR_WORDS.get(e.label)
        return f"{sqltext.any_head(found, lowered, words, S.HEADS)} AND {test}" if words else test

    return sqltext.chosen([(hit(e), sqltext.text(e.label)) for e in S.VENDOR_TOKENS])


def assigned_secrets(text: Column, lowered: Column) -> Column:
    """Random-looking values assigned to secret-like names, placeholders left out."""
    found = spans.find_spans(text, S.ASSIGNMENT_VALUE, "high_entropy", ignore_case=True, lead=S.ASSIGNMENT_LEAD)
    kept = F.filter(
        found,
        lambda s: ~s["text"].rlike("(?i)" + S.PLACEHOLDER) & (checks.shannon_entropy(s["text"]) >= S.MIN_ENTROPY),
    )
    near = regex.search(text, S.ASSIGNMENT_VALUE_NEAR, True) & regex.contains_any(lowered, S.ASSIGNMENT_WORDS)
    return F.when(near, kept).otherwise(spans.empty_spans(True))


@detector("secrets", stages=("input", "output", "stream", "tool_call", "tool_result", "memory_write"),
          category="credential_exposure", mutates=True, fail_mode="closed")
def scan_secrets(data: ScanInput, opts: Options) -> Scan:
    found = F.col("_sec_spans")
    return Scan(
        "secrets",
        finding(
            "secrets", "credential_exposure", F.size(found) > 0, score=F.lit(1.0), severity=F.lit("critical"),
            action=F.lit(opts.get("action", "block")),
            summary=_summary("credential material", F.transform(found, lambda s: s["label"])),
            span_list=spans.outermost_spans(spans.strip_text(found)),
            evidence=json_evidence(
                labels=_labels(found), entropy_matches=F.size(F.filter(found, lambda s: s["label"] == "high_entropy"))
            ),
            options=opts,
        ),
        [
            *_heads(data),
            {"_sec_vendor": vendor_hits(TEXT, LOWER, WORDS), "_sec_assigned": assigned_secrets(F.col(TEXT), F.col(LOWER))},
            {"_sec_spans": F.concat(
                table_spans(F.col(TEXT), F.col("_sec_vendor"), entity_rows(S.VENDOR_TOKENS)), F.col("_sec_assigned")
            )},
        ],
    )


# --- prompt injection --------------------------------------------------------------


def injection_signals(opts: Options) -> list[S.Signal]:
    off = set(opts.get("disabled_signals", ()))
    extra = [
        S.Signal(x["id"], x["pattern"], float(x.get("weight", 0.5)), x.get("family", "custom"))
        for x in opts.get("extra_signals", ())
    ]
    return [s for s in (*S.INJECTION, *extra) if s.id not in off]


def family_weights(hits: Column, families: list[str]) -> dict[str, Column]:
    """Within a family only the strongest signal counts."""
    return {
        fam: F.coalesce(
            F.array_max(F.transform(F.filter(hits, lambda h: h["family"] == fam), lambda h: h["weight"])), F.lit(0.0)
        )
        for fam in families
    }


def _families(table: list[S.Signal]) -> list[str]:
    return list(dict.fromkeys(s.family for s in table))


@detector("prompt_injection", stages=("input", "retrieval", "tool_result", "memory_write", "stream"),
          category="prompt_injection")
def scan_prompt_injection(data: ScanInput, opts: Options) -> Scan:
    table = injection_signals(opts)
    families = _families(table)
    if "obfuscation" not in families:
        families.append("obfuscation")
    threshold = float(opts.get("threshold", S.INJECTION_THRESHOLD))
    flag_at = float(opts.get("flag_threshold", S.INJECTION_FLAG))
    escalate_at = float(opts.get("escalate_threshold", S.INJECTION_ESCALATE))
    invisible_weight = float(opts.get("invisible_weight", S.INVISIBLE_WEIGHT))

    norm, dec = F.col("_inj_norm"), F.col("_inj_dec")
    dec_hits = sqltext.chosen([
        (f"exists(_inj_dec, p -> {sqltext.rlike('p', s.pattern, True)})", hit_sql("encoded:" + s.id, s.weight, s.family)) for s in table
    ])
    side = present([
        F.when(F.size(F.col("_inj_dhits")) > 0, hit_struct("encoded", S.ENCODED_WEIGHT, "obfuscation")),
        F.when(F.col("_inj_inv") > 0, hit_struct("invisible_characters", invisible_weight, "obfuscation")),
    ])
    multiplier = lookup(data.trust_col, S.TRUST_MULTIPLIER, 1.0)
    score, hits = F.col("_inj_score"), F.col("_inj_hits")
    strong = score >= threshold
    untrusted = authority(data.trust_col) <= AUTHORITY["retrieved"]
    return Scan(
        "prompt_injection",
        finding(
            "prompt_injection", "prompt_injection", score >= min(threshold, flag_at), score=score,
            severity=F.when(strong & untrusted, "critical").when(strong, "high").otherwise("low"),
            action=F.when(strong, F.lit(opts.get("action", "block"))).otherwise("flag"),
            summary=_summary("prompt injection signals", F.transform(hits, lambda h: h["family"])),
            span_list=spans.strip_text(table_spans(norm, ids(hits), signal_rows(table), first_only=True)),
            evidence=json_evidence(
                signals=ids(hits), base_score=F.round(F.col("_inj_base"), 4), trust_multiplier=multiplier,
                invisible_characters=F.col("_inj_inv"), encoded_segments=F.size(dec),
                escalate=(F.size(hits) > 0) & (score >= escalate_at) & (score < threshold),
            ),
            options=opts,
        ),
        [
            {TEXT: data.text, "_inj_pure": X.is_plain(data.text), "_inj_run": X.has_long_run(data.text)},
            {
                LOWER: regex.folded(F.col(TEXT)), "_inj_norm": X.normalise_text(F.col(TEXT), F.col("_inj_pure")),
                "_inj_inv": X.count_invisible(F.col(TEXT), F.col("_inj_pure")),
            },
            {
                **_heads(data)[2], "_inj_same": norm == F.col(TEXT),
                "_inj_nlc": F.when(norm == F.col(TEXT), F.col(LOWER)).otherwise(regex.folded(norm)),
                "_inj_nrun": F.when(norm == F.col(TEXT), F.col("_inj_run")).otherwise(X.has_long_run(norm)),
                "_inj_dec": F.transform(X.decoded_segments(F.col(TEXT), F.col("_inj_run")), lambda s: X.undo_spacing(s)),
            },
            {"_inj_words": F.when(F.col("_inj_same"), F.col(WORDS)).otherwise(
                regex.word_heads(F.col("_inj_nlc"), S.HEADS.values()))},
            {
                "_inj_plain": signal_hits("_inj_norm", "_inj_nlc", table, long_run="_inj_nrun", found="_inj_words"),
                "_inj_dhits": F.when(F.size(dec) > 0, dec_hits).otherwise(no_hits()),
            },
            {"_inj_hits": F.concat(F.col("_inj_plain"), F.col("_inj_dhits"), side)},
            {"_inj_base": F.when(
                F.size(hits) > 0, saturate(list(family_weights(hits, families).values()))
            ).otherwise(F.lit(0.0))},
            {"_inj_score": F.least(F.lit(1.0), F.col("_inj_base") * multiplier)},
        ],
    )


# --- authority claims --------------------------------------------------------------


@detector("authority_claim", stages=("input", "retrieval", "tool_result", "memory_write"),
          category="authority_manipulation")
def scan_authority_claims(data: ScanInput, opts: Options) -> Scan:
    threshold = float(opts.get("threshold", 0.5))
    mapping = {**S.CLAIM_ROLES, **{k: tuple(v) for k, v in (opts.get("role_mapping") or {}).items()}}
    held = F.transform(data.roles_col, F.lower)
    claims = F.col("_auth_claims")
    backed = F.transform(F.array(held), lambda mine: present([
        F.when(F.arrays_overlap(mine, sqltext.strings([r.lower() for r in roles])), F.expr(hit_sql(claim, 0.0)))
        for claim, roles in mapping.items() if roles
    ]))[0] if data.roles is not None else no_hits()
    unverified = F.array_except(ids(claims), ids(F.col("_auth_backed")))
    ask = F.expr(gated(TEXT, LOWER, WORDS, S.SENSITIVE_ASK, (S.SENSITIVE_WORDS,)))
    weak_source = authority(data.trust_col) <= AUTHORITY["tool"]
    anonymous = ~data.or_default("authenticated", False)
    all_verified = F.size(F.col("_auth_unverified")) == 0
    raw = (
        F.lit(0.5) + F.when(F.col("_auth_ask"), 0.3).otherwise(0.0)
        + F.when(anonymous, 0.1).otherwise(0.0) + F.when(weak_source, 0.3).otherwise(0.0)
    )
    score = F.col("_auth_score")
    low = score < threshold
    return Scan(
        "authority_claim",
        finding(
            "authority_claim", "authority_manipulation", F.size(claims) > 0, score=score,
            severity=F.when(all_verified, "info").when(low, "low").when(weak_source, "critical").otherwise("high"),
            action=F.when(all_verified | low, "flag").when(weak_source, "block").otherwise(
                F.lit(opts.get("action", "challenge"))),
            summary=_summary("authority claims", ids(claims)),
            span_list=spans.strip_text(table_spans(
                data.text, ids(claims), signal_rows(S.AUTHORITY_CLAIMS, "authority:"), first_only=True)),
            evidence=json_evidence(
                claims=ids(claims), unverified=F.col("_auth_unverified"), sensitive_request=F.col("_auth_ask")),
            options=opts,
        ),
        [
            *_heads(data),
            {"_auth_claims": signal_hits(TEXT, LOWER, S.AUTHORITY_CLAIMS, found=WORDS), "_auth_backed": backed},
            {"_auth_unverified": unverified, "_auth_ask": F.when(F.size(claims) > 0, ask).otherwise(F.lit(False))},
            {"_auth_score": F.when(F.size(claims) == 0, 0.0).when(all_verified, 0.1).otherwise(
                F.least(F.lit(1.0), raw))},
        ],
    )


# --- resource abuse ----------------------------------------------------------------


def top_token_share(text: Column, min_tokens: int, least: float = 0.5) -> Column:
    """Share of the commonest token where there are ``min_tokens`` or more, exact from ``least`` up.

    A token filling half of a sorted list sits at one of the two middle places; smaller shares
    take the longest run of the list.
    """
    ordered = F.sort_array(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\S+"), F.lit(0)))

    def middle_share(tokens: Column) -> Column:
        n = F.size(tokens)
        middle = F.array_distinct(F.array(
            F.element_at(tokens, F.floor((n - 1) / 2).cast("int") + 1), F.element_at(tokens, F.floor(n / 2).cast("int") + 1)
        ))
        times = F.transform(middle, lambda w: n - F.size(F.array_remove(tokens, w)))
        return F.when(n >= min_tokens, F.array_max(times) / n)

    def longest_run(tokens: Column) -> Column:
        def step(acc: Column, token: Column) -> Column:
            run = F.when(acc["token"] == token, acc["run"] + 1).otherwise(F.lit(1))
            return F.struct(token.alias("token"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

        start = F.struct(F.lit(None).cast("string").alias("token"), F.lit(0).alias("run"), F.lit(0).alias("best"))
        n = F.size(tokens)
        return F.when(n >= min_tokens, F.aggregate(tokens, start, step, lambda acc: acc["best"]) / n)

    long_enough = F.length(text) >= 2 * min_tokens - 1
    return F.when(long_enough, F.transform(F.array(ordered), middle_share if least >= 0.5 else longest_run)[0])


def long_repeat(text: Column, length: int) -> Column:
    """A character repeated ``length`` times: any such run covers half its length from one of the places looked at."""
    half = length // 2
    candidate = regex.marked(text, r"(?s)(.)(?:(\1{%d})|.{0,%d})" % (half - 1, half - 1), 2)
    return (F.size(candidate) > 0) & text.rlike(r"(?s)(.)\1{%d,}" % (length - 1))


@detector("resource_abuse", stages=("input",), category="unbounded_consumption")
def scan_resource_abuse(data: ScanInput, opts: Options) -> Scan:
    threshold = float(opts.get("threshold", 0.6))
    cap = int(opts.get("max_output_tokens", 0))
    chars = F.length(data.text) + data.or_default("history_chars", 0)
    share = float(opts.get("flood_share", S.FLOOD_SHARE))
    run = long_repeat(F.col(TEXT), S.RUN_LENGTH)
    endless = F.expr(gated(TEXT, LOWER, WORDS, S.ENDLESS, (S.ENDLESS_WORDS, S.ENDLESS_ALSO)))
    tests = [
        F.when(chars > int(opts.get("max_chars", S.MAX_CHARS)), hit_struct("oversized_prompt", 0.9)),
        F.when(data.or_default("history_messages", 0) > int(opts.get("max_messages", S.MAX_MESSAGES)),
               hit_struct("oversized_history", 0.8)),
        F.when(F.col("_ra_share") >= share, hit_struct("token_flood", 0.7)),
        F.when((F.length(data.text) >= S.RUN_LENGTH) & run, hit_struct("character_flood", 0.7)),
        F.when(endless, hit_struct("endless_generation", 0.55)),
    ]
    if cap:
        tests.append(F.when(data.or_default("max_tokens", 0) > cap, hit_struct("output_budget_exceeded", 0.8)))
    hits = F.col("_ra_hits")
    score = max_weight(hits)
    return Scan(
        "resource_abuse",
        finding(
            "resource_abuse", "unbounded_consumption", F.size(hits) > 0, score=score,
            severity=F.when(score >= threshold, "medium").otherwise("low"),
            action=F.when(score >= threshold, "block").otherwise("flag"),
            summary=_summary("resource abuse", ids(hits)), evidence=json_evidence(signals=ids(hits)), options=opts,
        ),
        [
            *_heads(data),
            {"_ra_share": top_token_share(data.text, int(opts.get("flood_min_tokens", S.FLOOD_MIN_TOKENS)), share)},
            {"_ra_hits": present(tests)},
        ],
    )


# --- content policy ----------------------------------------------------------------


def _escaped(term: str) -> str:
    return "".join("\\" + c if c in r".^$*+?{}[]\|()-&~#" else c for c in term)


def topic_table(opts: Options) -> list[tuple[str, str, str, tuple[str, ...]]]:
    """(name, severity, pattern, words) of each category and each regex rule."""
    cats = opts.get("categories")
    terms = {k: (v.get("severity", "medium"), tuple(v["terms"])) for k, v in cats.items()} if cats else S.BANNED_TOPICS
    out = [
        (name, sev, "|".join(rf"\b{_escaped(t)}\b" for t in ts), tuple(t.lower() for t in ts))
        for name, (sev, ts) in terms.items() if ts
    ]
    rules = opts.get("rules") or {}
    return out + [(name, r.get("severity", "medium"), r["pattern"], ()) for name, r in rules.items()]


@detector("banned_topics", stages=("input", "output", "stream"), category="content_policy")
def scan_banned_topics(data: ScanInput, opts: Options) -> Scan:
    table = topic_table(opts)
    found = sqltext.chosen([(gated(TEXT, LOWER, WORDS, p, (w,)), sqltext.text(n)) for n, _, p, w in table])
    names, hits = F.col("_ban_names"), F.col("_ban_spans")
    severity = worst(F.transform(names, lambda n: lookup(n, {t[0]: t[1] for t in table})), SEVERITIES, "info")
    rows = [(n, "banned:" + n, regex.java("", True), p) for n, _, p, _ in table]
    return Scan(
        "banned_topics",
        finding(
            "banned_topics", "content_policy", F.size(names) > 0, score=F.lit(1.0), severity=severity,
            action=F.lit(opts.get("action", "block")), summary=_summary("banned content", names),
            span_list=spans.outermost_spans(spans.strip_text(hits)),
            evidence=json_evidence(categories=F.array_sort(names), matches=F.size(hits)), options=opts,
        ),
        [*_heads(data), {"_ban_names": found}, {"_ban_spans": table_spans(data.text, names, rows)}],
    )


# --- leakage -----------------------------------------------------------------------


def _salted(value: str, salt: str) -> str:
    import hashlib

    return hashlib.sha256((salt + value).encode("utf-8", "replace")).hexdigest()


def registered_spans(text: Column, registered: Mapping[str, str], salt: str, min_length: int = 8) -> Column:
    """Windows of ``text`` whose salted hash is a registered one. Plaintexts stay on the driver."""
    kept = {k: v.strip() for k, v in registered.items() if len(v.strip()) >= min_length}
    by_length: dict[int, dict[str, str]] = {}
    for label, value in kept.items():
        by_length.setdefault(len(value), {})[_salted(value, salt)] = f"leaked:{label}"

    def windows(n: int, table: Mapping[str, str]) -> Column:
        every = F.transform(
            F.sequence(F.lit(1), F.length(text) - n + 1),
            lambda i: F.struct(
                (i - 1).alias("start"), (i - 1 + n).alias("end"),
                lookup(F.sha2(F.concat(F.lit(salt), F.substring(text, i, F.lit(n))), 256), table).alias("label"),
                F.lit("").alias("text"),
            ),
        )
        return F.when(F.length(text) >= n, F.filter(every, lambda w: w["label"].isNotNull())).otherwise(
            spans.empty_spans(True)
        )

    parts = [windows(n, table) for n, table in sorted(by_length.items())]
    return F.concat(*parts) if parts else spans.empty_spans(True)


@detector("secret_leakage", stages=("output", "stream", "tool_call"), category="data_leakage", mutates=True,
          fail_mode="closed")
def scan_secret_leakage(data: ScanInput, opts: Options) -> Scan:
    found = F.col("_leak_spans")
    registered = registered_spans(data.text, opts.get("secrets") or {}, opts.get("salt", ""), opts.get("min_length", 8))
    return Scan(
        "secret_leakage",
        finding(
            "secret_leakage", "data_leakage", F.size(found) > 0, score=F.lit(1.0), severity=F.lit("critical"),
            action=F.lit(opts.get("action", "block")),
            summary=_summary("confidential material", F.transform(found, lambda s: s["label"])),
            span_list=spans.outermost_spans(spans.strip_text(found)),
            evidence=json_evidence(labels=_labels(found)), options=opts,
        ),
        [
            *_heads(data),
            {"_leak_vendor": vendor_hits(TEXT, LOWER, WORDS)},
            {"_leak_spans": F.concat(
                registered, table_spans(data.text, F.col("_leak_vendor"), entity_rows(S.VENDOR_TOKENS, "credential:"))
            )},
        ],
    )


@detector("system_prompt_leakage", stages=("output", "stream"), category="system_prompt_leakage", mutates=True)
def scan_system_prompt_leakage(data: ScanInput, opts: Options) -> Scan:
    """Canary tokens and n-gram overlap with the row's system prompt and any fixed prompts."""
    n, min_matches = int(opts.get("ngram", 6)), int(opts.get("min_matches", 3))
    threshold = float(opts.get("threshold", 0.6))
    canaries = list(opts.get("canaries", ()))
    fixed = list(opts.get("system_prompts", ()))
    no_grams = F.array().cast("array<string>")
    grams = [X.shingles(F.lit(p), n) for p in fixed]
    if data.system_text is not None:
        grams.append(F.when(data.system_text.isNotNull(), X.shingles(data.system_text, n)).otherwise(no_grams))
    system = F.array_distinct(F.concat(*grams)) if grams else no_grams
    planted = F.filter(
        F.array(*[F.when(F.contains(data.text, F.lit(c)), F.lit(c)) for c in canaries]) if canaries else no_grams,
        lambda c: c.isNotNull(),
    )
    matched, total = F.col("_spl_matched"), F.size(F.col("_spl_system"))
    coverage = F.when(total > 0, matched / total).otherwise(F.lit(0.0))
    overlap_score = F.least(F.lit(1.0), F.lit(0.4) + coverage * 1.5)
    canary = F.size(F.col("_spl_canary")) > 0
    overlap = (total > 0) & ((matched >= min_matches) | (coverage >= 0.5))
    strong = overlap_score >= threshold
    where = F.transform(
        F.col("_spl_canary"),
        lambda c: F.struct((F.instr(data.text, c) - 1).alias("start"), (F.instr(data.text, c) - 1 + F.length(c)).alias("end"),
                           F.lit("canary_token").alias("label")),
    )
    return Scan(
        "system_prompt_leakage",
        finding(
            "system_prompt_leakage", "system_prompt_leakage", canary | overlap,
            score=F.when(canary, F.lit(1.0)).otherwise(overlap_score),
            severity=F.when(canary, "critical").when(strong, "high").otherwise("low"),
            action=F.when(canary | strong, "block").otherwise("flag"),
            summary=F.when(canary, "canary token in output").otherwise("output repeats the system prompt"),
            span_list=where.cast("array<struct<start:int,end:int,label:string>>"),
            evidence=json_evidence(matched_ngrams=matched, system_ngrams=total, coverage=F.round(coverage, 4)),
            options=opts,
        ),
        [
            {"_spl_system": system, "_spl_canary": planted},
            {"_spl_matched": F.when(
                total > 0, F.size(F.array_intersect(F.col("_spl_system"), X.shingles(data.text, n)))
            ).otherwise(F.lit(0))},
        ],
    )


# --- output handling ---------------------------------------------------------------


def url_parts(url: Column) -> dict[str, Column]:
    """Host (lower case, no user or port), path and query of an http URL."""
    netloc = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":[^\]]*$", ""))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), r";[^/]*$", "")
    return {"host": host, "path": path, "query": F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)}


def exfil_links(text: Column, allowed: list[str] | tuple[str, ...] = ()) -> Column:
    """(host, weight) of links that would carry data out when rendered, images weighing more."""
    domains = [d.lower().lstrip(".") for d in allowed]

    def one(match: Column, pattern: str) -> Column:
        parts = url_parts(F.regexp_extract(match, pattern, 1))
        long_segment = F.exists(F.split(parts["path"], "/"), lambda seg: F.length(seg) > 64)
        permitted = F.lit(False)
        for d in domains:
            permitted = permitted | (parts["host"] == d) | parts["host"].endswith("." + d)
        image = match.startswith("!") | F.lower(match).startswith("<img")
        risky = (parts["host"] != "") & ~permitted & ((parts["query"] != "") | long_segment)
        return F.when(risky, F.struct(parts["host"].alias("host"), F.when(image, 0.9).otherwise(0.55).alias("weight"),
                                      match.alias("text")))

    def all_of(pattern: str, need: str) -> Column:
        java = regex.java(pattern, True)
        matches = F.when(
            F.contains(F.lower(text), F.lit(need)) & text.rlike(java), F.regexp_extract_all(text, F.lit(java), F.lit(0))
        ).otherwise(F.array().cast("array<string>"))
        return F.transform(matches, lambda m: one(m, java))

    both = F.concat(all_of(S.MARKDOWN_URL, "]("), all_of(S.HTML_IMAGE, "<img"))
    return F.filter(both, lambda x: x.isNotNull())


def exfil_hosts(text: Column, allowed: list[str] | tuple[str, ...] = ()) -> Column:
    return F.transform(exfil_links(text, allowed), lambda x: x["host"])


@detector("unsafe_output", stages=("output", "stream"), category="improper_output", mutates=True)
def scan_unsafe_output(data: ScanInput, opts: Options) -> Scan:
    threshold = float(opts.get("threshold", 0.6))
    runs = bool(opts.get("executes_output", False))
    inert = [s for s in S.INERT_PAYLOADS if opts.get(s.family, True)]
    inert = [
        s._replace(weight=min(1.0, s.weight + S.EXECUTES_BOOST) if runs else min(s.weight, S.INERT_CAP)) for s in inert
    ]
    table = [*S.ACTIVE_HTML, *inert]
    links, hits = F.col("_uo_links"), F.col("_uo_hits")
    link_hits = F.transform(
        links, lambda x: F.struct(F.lit("markdown_exfil").alias("id"), x["weight"].alias("weight"), F.lit("link").alias("family"))
    )
    rce = F.exists(hits, lambda h: h["id"].isin("reverse_shell", "pipe_to_shell")) | F.lit(runs)
    score = max_weight(hits)
    strong = score >= threshold
    link_spans = F.filter(
        spans.find_spans(data.text, f"{S.MARKDOWN_URL}|{S.HTML_IMAGE}", "markdown_exfil", ignore_case=True),
        lambda s: F.exists(links, lambda x: x["text"] == s["text"]),
    )
    return Scan(
        "unsafe_output",
        finding(
            "unsafe_output", "improper_output", F.size(hits) > 0, score=score,
            severity=F.when(strong & (score >= 0.8), "high").when(strong, "medium").otherwise("low"),
            action=F.when(strong, "block").otherwise("flag"), summary=_summary("unsafe output", ids(hits)),
            span_list=spans.strip_text(F.concat(
                F.when(F.size(links) > 0, link_spans).otherwise(spans.empty_spans(True)),
                table_spans(data.text, ids(hits), signal_rows(table), first_only=True))),
            evidence=json_evidence(signals=ids(hits), hosts=F.transform(links, lambda x: x["host"])),
            threats=F.when(rce, sqltext.strings(["ASI05"])).otherwise(F.array().cast("array<string>")), options=opts,
        ),
        [
            *_text(data),
            {"_uo_links": exfil_links(data.text, opts.get("allowed_domains", ()))},
            {"_uo_hits": F.concat(link_hits, signal_hits(TEXT, LOWER, table))},
        ],
    )


# --- tools -------------------------------------------------------------------------


@detector("code_execution", stages=("tool_call",), category="code_execution", fail_mode="closed")
def scan_code_execution(data: ScanInput, opts: Options) -> Scan:
    threshold = float(opts.get("threshold", 0.6))
    tool = data.or_default("tool", "")
    exec_sink = (tool != "") & regex.search(tool, opts.get("exec_tools", S.EXEC_TOOL), True)
    hits, score = F.col("_ce_hits"), F.col("_ce_score")
    strong = score >= threshold
    both = [*S.EXEC_ALWAYS, *S.EXEC_INJECTED]
    return Scan(
        "code_execution",
        finding(
            "code_execution", "code_execution", F.size(hits) > 0, score=score,
            severity=F.when(strong & (score >= 0.85), "critical").when(strong, "high").otherwise("low"),
            action=F.when(strong, "block").otherwise("flag"), summary=_summary("execution payload", ids(hits)),
            span_list=spans.strip_text(table_spans(data.text, ids(hits), signal_rows(both), first_only=True)),
            evidence=json_evidence(signals=ids(hits), execution_sink=F.col("_ce_sink")), options=opts,
        ),
        [
            *_text(data),
            {"_ce_sink": exec_sink},
            {"_ce_hits": F.concat(
                signal_hits(TEXT, LOWER, S.EXEC_ALWAYS), signal_hits(TEXT, LOWER, S.EXEC_INJECTED, also="NOT _ce_sink"),
            )},
            {"_ce_score": saturate_hits(hits)},
        ],
    )


def sink_tier(tool: Column, table: Mapping[str, str] | None = None, default: str = "medium") -> Column:
    """The highest tier among the table's keys found in the tool name."""
    merged = {**S.SINK_TIERS, **(table or {})}
    table_sql = ", ".join(f"named_struct('k', {sqltext.text(k)}, 't', {TIERS.index(t)})" for k, t in merged.items())
    name = F.lower(tool)
    top = F.aggregate(
        F.expr(f"array({table_sql})"), F.lit(-1), lambda best, e: F.when(F.contains(name, e["k"]), F.greatest(best, e["t"])).otherwise(best)
    )
    return F.when(top >= 0, F.element_at(sqltext.strings(TIERS), F.greatest(top, F.lit(0)) + 1)).otherwise(F.lit(default))


def flow_record(data: ScanInput, opts: Options | None = None) -> dict[str, Column]:
    """Source, sink, tier, persistence and outside effect of one transfer."""
    opts = opts or {}
    tool = data.tool if data.tool is not None else F.lit(None).cast("string")
    if data.stage in ("retrieval", "tool_result"):
        sink = F.concat(F.lit("model_context"), F.coalesce(F.concat(F.lit("<-"), tool), F.lit("")))
        tier = F.lit("low")
    else:
        sink = F.coalesce(tool, F.lit(data.stage))
        resolved = sink_tier(sink, opts.get("sink_risk"), opts.get("default_risk", "medium"))
        tier = resolved if data.tool_risk is None else F.coalesce(data.tool_risk, resolved)
    persistent = F.lit(data.stage == "memory_write") | F.contains(F.lower(sink), F.lit("write"))
    outside = F.lit(data.stage == "tool_call") & tier.isin("high", "critical")
    return {
        "source_trust": data.trust_col, "sink": sink, "sink_risk": tier, "boundary": F.lit(data.stage),
        "persistent": persistent, "external_effect": outside,
    }


@detector("token_flow", stages=("tool_call", "tool_result", "memory_write", "retrieval"), category="unsafe_flow",
          fail_mode="closed")
def scan_token_flow(data: ScanInput, opts: Options) -> Scan:
    rec = flow_record(data, opts)
    hits, tier = F.col("_tf_hits"), F.col("_tf_tier")
    auth = authority(data.trust_col)
    gap = lookup(tier, REQUIRED_AUTHORITY) - auth
    dangerous = F.size(hits) > 0
    structural = dangerous & tier.isin("high", "critical")
    underpowered = (gap > 0) & F.lit(data.stage == "tool_call")
    kept = rec["persistent"] & (auth <= AUTHORITY["retrieved"])
    gap_action = "challenge" if opts.get("challenge_instead_of_block") else "block"
    return Scan(
        "token_flow",
        finding(
            "token_flow", "unsafe_flow", structural | underpowered | dangerous | kept,
            score=F.when(structural, 1.0).when(underpowered, F.least(F.lit(1.0), F.lit(0.6) + gap * 0.15))
            .when(dangerous, 0.4).otherwise(0.35),
            severity=F.when(structural, "critical").when(underpowered & (tier == "critical"), "critical")
            .when(underpowered, "high").otherwise("low"),
            action=F.when(structural, "block").when(underpowered, gap_action).otherwise("flag"),
            summary=F.concat(F.lit("flow into "), rec["sink"], F.lit(" ("), tier, F.lit(" risk)")),
            evidence=json_evidence(dangerous_patterns=ids(hits), sink=rec["sink"], sink_risk=tier, authority_gap=gap),
            options=opts,
        ),
        [*_text(data), {
            "_tf_hits": signal_hits(TEXT, LOWER, S.DANGEROUS_ARGUMENTS), "_tf_tier": rec["sink_risk"],
        }],
    )


@detector("tool_poisoning", stages=("tool_definition",), category="tool_poisoning", fail_mode="closed")
def scan_tool_definitions(data: ScanInput, opts: Options) -> Scan:
    """Directives hidden in a tool definition; ``rug_pull`` (a boolean column) adds a redefinition."""
    threshold = float(opts.get("threshold", 0.6))
    norm = F.col("_tp_norm")
    families = _families(list(S.INJECTION))
    rug = opts.get("rug_pull")
    rug = F.lit(False) if rug is None else F.coalesce(rug, F.lit(False))
    fams = family_weights(F.col("_tp_inj"), families)
    extra = present([
        *[F.when(w > 0, hit_struct("injection:" + f, w, f)) for f, w in fams.items()],
        F.when(X.count_invisible(data.text) > 0, hit_struct("invisible_characters", S.POISON_INVISIBLE_WEIGHT)),
        F.when(rug, hit_struct("definition_changed", S.RUG_PULL_WEIGHT)),
    ])
    hits, score = F.col("_tp_hits"), F.col("_tp_score")
    strong = score >= threshold
    return Scan(
        "tool_poisoning",
        finding(
            "tool_poisoning", "tool_poisoning", F.size(hits) > 0, score=score,
            severity=F.when(strong & (rug | (score >= 0.85)), "critical").when(strong, "high").otherwise("low"),
            action=F.when(strong, "block").otherwise("flag"), summary=_summary("tool definition", ids(hits)),
            span_list=spans.strip_text(table_spans(norm, ids(hits), signal_rows(S.POISON), first_only=True)),
            evidence=json_evidence(signals=ids(hits), rug_pull=rug), options=opts,
        ),
        [
            {"_tp_norm": X.normalise_text(data.text)},
            {"_tp_lc": regex.folded(norm)},
            {"_tp_words": regex.word_heads(F.col("_tp_lc"), S.HEADS.values())},
            {
                "_tp_poison": signal_hits("_tp_norm", "_tp_lc", S.POISON),
                "_tp_inj": signal_hits("_tp_norm", "_tp_lc", S.INJECTION, found="_tp_words"),
            },
            {"_tp_hits": F.concat(F.col("_tp_poison"), extra)},
            {"_tp_score": saturate_hits(hits)},
        ],
    )


# --- groundedness ------------------------------------------------------------------


@detector("groundedness", stages=("output",), category="hallucination", enabled=False)
def scan_groundedness(data: ScanInput, opts: Options) -> Scan:
    """Share of substantive sentences whose words the row's grounding text does not hold."""
    min_overlap = float(opts.get("min_overlap", 0.3))
    min_words = int(opts.get("min_sentence_words", 6))
    max_ratio = float(opts.get("max_unsupported_ratio", 0.5))
    source = data.or_default("grounding", "")
    vocab, overlaps = F.col("_gr_vocab"), F.col("_gr_overlaps")
    scored = F.transform(
        X.split_sentences(data.text),
        lambda s: F.transform(
            F.array(X.content_words(s)),
            lambda w: F.when(F.size(w) >= min_words, F.size(F.array_intersect(w, vocab)) / F.size(w)),
        )[0],
    )
    ratio = F.size(F.filter(overlaps, lambda o: o < min_overlap)) / F.size(overlaps)
    checked = (F.size(vocab) > 0) & (F.size(overlaps) > 0)
    return Scan(
        "groundedness",
        finding(
            "groundedness", "hallucination", checked & (ratio > max_ratio), score=ratio, severity=F.lit("medium"),
            action=F.lit(opts.get("action", "flag")), summary=F.lit("sentences not supported by the passages"),
            evidence=json_evidence(sentences_checked=F.size(overlaps), unsupported_ratio=F.round(ratio, 3)),
            options=opts,
        ),
        [{"_gr_vocab": X.content_words(source)},
         {"_gr_overlaps": F.filter(scored, lambda o: o.isNotNull())}],
    )


@detector("trajectory", stages=("input",), category="multi_turn_attack")
def scan_trajectory_row(data: ScanInput, opts: Options) -> Scan:
    """The conversation-level finding joined onto the row (see ``operators.conversation``)."""
    clean = finding("trajectory", "multi_turn_attack", F.lit(False), score=F.lit(0.0), severity=F.lit("info"),
                    action=F.lit("allow"))
    found = clean if data.conversation_finding is None else F.coalesce(data.conversation_finding, clean)
    return Scan("trajectory", found)


