"""Scans over planted documents, tool calls and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.operators import conversation as C
from wardspark.operators import signals as S
from wardspark.operators import tools as TL
from wardspark.operators.detectors import TEXT  # noqa: F401 - loads the scans
from wardspark.operators.scan import REGISTRY, ScanInput, run_scan
from wardspark.plans.firewall import screen, screen_documents
from wardspark.plans.stages import scan_all
from wardspark.queries.base import (
    CALLS_SQL, CHATS_SQL, PLANTED_SQL, chats, planted, query, quoted, re2, spread, table, tool_calls,
)
from wardspark.functions.text import STOPWORDS, tool_fingerprint


def _scan(df, name, stage, text="text", **kw):
    options = kw.pop("options", {})
    return run_scan(df, REGISTRY[name].build(ScanInput(F.col(text), stage=stage, **kw), options), "f")




def _pattern(label: str) -> str:
    return {e.label: e.pattern for e in S.PII}[label]


# Words around a match may be accented, where the engines' word boundaries differ: entities
# are checked by the letters and digits themselves.
@query("scan_pii", f"""
WITH {PLANTED_SQL}, m AS (SELECT doc_id,
 len(regexp_extract_all(text, {re2(_pattern('email'))})) AS emails,
 len(regexp_extract_all(text, {re2(_pattern('ip_address'))})) AS ips,
 len(list_filter(regexp_extract_all(text, {re2(_pattern('credit_card'))}), lambda raw: length(regexp_replace(raw, '[^0-9]', '', 'g')) >= 13 AND
   list_sum(list_transform(range(1, length(regexp_replace(raw, '[^0-9]', '', 'g')) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(regexp_replace(raw, '[^0-9]', '', 'g')), i, 1) AS INT)
    ELSE (CAST(substr(reverse(regexp_replace(raw, '[^0-9]', '', 'g')), i, 1) AS INT) * 2) // 10 + (CAST(substr(reverse(regexp_replace(raw, '[^0-9]', '', 'g')), i, 1) AS INT) * 2) % 10 END)) % 10 = 0)) AS cards
 FROM planted)
SELECT doc_id, CAST(emails AS BIGINT) AS emails, CAST(ips AS BIGINT) AS ips, CAST(cards AS BIGINT) AS cards,
 CASE WHEN cards > 0 THEN 'high' WHEN emails > 0 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN cards > 0 THEN 'block' ELSE 'redact' END AS action
FROM m WHERE emails + ips + cards > 0""")
def _pii(spark, sf):
    opts = {"entities": ["email", "ip_address", "credit_card"], "block_entities": ["credit_card"]}
    out = _scan(planted(spark, sf), "pii", "input", options=opts).filter("f.detected")
    n = lambda label: F.size(F.filter("f.spans", lambda s: s["label"] == label)).cast("bigint")
    return out.select("doc_id", n("email").alias("emails"), n("ip_address").alias("ips"), n("credit_card").alias("cards"),
                      "f.severity", "f.action")


@query("scan_secrets", f"""
WITH {PLANTED_SQL}, m AS (SELECT doc_id, text, regexp_matches(text, {re2(S.VENDOR_TOKENS[0].pattern)}) AS gh, regexp_matches(text, {re2(S.VENDOR_TOKENS[3].pattern)}) AS aws,
 regexp_extract(text, 'api_secret = .([0-9A-Za-z]{{32}})', 1) <> '' AS planted_secret, regexp_extract_all(text, 'token = "([0-9a-f]{{40}})"', 1) AS hexes FROM planted),
h AS (SELECT doc_id, pos, list_extract(hexes, pos) AS v FROM (SELECT doc_id, hexes, unnest(range(1, len(hexes) + 1)) AS pos FROM m)),
e AS (SELECT doc_id, pos, -sum((k / 40) * log2(k / 40)) AS bits FROM (SELECT doc_id, pos, c, count(*) AS k FROM (SELECT doc_id, pos, unnest(string_split(v, '')) AS c FROM h) WHERE c <> '' GROUP BY ALL) GROUP BY ALL),
n AS (SELECT doc_id, count(*) FILTER (WHERE bits >= 3.5) AS hits FROM e GROUP BY 1)
SELECT doc_id, gh AS github, aws, planted_secret OR coalesce(hits, 0) > 0 OR gh AS assigned FROM m LEFT JOIN n USING (doc_id)
WHERE gh OR aws OR planted_secret OR coalesce(hits, 0) > 0""")
def _secrets(spark, sf):
    out = _scan(planted(spark, sf), "secrets", "input").filter("f.detected")
    ev = F.from_json("f.evidence", "labels array<string>, entropy_matches int")
    has = lambda label: F.array_contains(ev["labels"], label)
    # The planted code-host token is not an assignment; one that is counts in both columns.
    return out.select("doc_id", has("github_token").alias("github"), has("aws_access_key_id").alias("aws"),
                      (has("high_entropy") | has("github_token")).alias("assigned"))


def _fam_sql(text: str) -> str:
    fams: dict[str, list[str]] = {}
    for s in S.INJECTION:
        fams.setdefault(s.family, []).append(f"CASE WHEN regexp_matches({text}, {re2(s.pattern, True)}) THEN {s.weight}::DOUBLE ELSE 0 END")
    return " * ".join("(1 - greatest(" + ", ".join(v) + ", 0))" for v in fams.values())


_INJ = f"""
WITH {PLANTED_SQL}, b AS (SELECT doc_id, 1 - {_fam_sql('text')} AS base, doc_id % 3 AS t FROM planted),
s AS (SELECT doc_id, CASE t WHEN 0 THEN 'user' WHEN 1 THEN 'tool' ELSE 'external' END AS trust,
  least(1.0, base * CASE t WHEN 0 THEN 1.0 WHEN 1 THEN 1.6 ELSE 2.0 END) AS score FROM b)"""


def _injected(spark, sf):
    trust = F.element_at(F.lit(["user", "tool", "external"]), (F.col("doc_id") % 3 + 1).cast("int"))
    return _scan(planted(spark, sf).withColumn("trust", trust), "prompt_injection", "input", trust=F.col("trust"))


@query("scan_prompt_injection", _INJ + """
SELECT doc_id, trust, round(score, 4) AS score, CASE WHEN score >= 0.6 AND trust = 'external' THEN 'critical' WHEN score >= 0.6 THEN 'high' ELSE 'low' END AS severity,
 CASE WHEN score >= 0.6 THEN 'block' ELSE 'flag' END AS action FROM s WHERE score >= 0.35""")
def _injection(spark, sf):
    return _injected(spark, sf).filter("f.detected").select("doc_id", "trust", F.round("f.score", 4).alias("score"), "f.severity", "f.action")


@query("select_escalations", _INJ + " SELECT doc_id, trust, round(score, 4) AS score FROM s WHERE score >= 0.45 AND score < 0.6")
def _escalations(spark, sf):
    out = _injected(spark, sf).select("doc_id", "trust", F.col("f.score").alias("score"))
    return C.select_escalations(out).withColumn("score", F.round("score", 4))


def _claims_sql() -> str:
    return " || ".join(f"CASE WHEN regexp_matches(text, {re2(s.pattern, True)}) THEN '{s.id},' ELSE '' END" for s in S.AUTHORITY_CLAIMS)


@query("scan_authority_claims", f"""
WITH {PLANTED_SQL}, c AS (SELECT doc_id, {_claims_sql()} AS claims, regexp_matches(text, {re2(S.SENSITIVE_ASK, True)}) AS ask, doc_id % 2 = 0 AS known FROM planted),
s AS (SELECT *, claims = 'owner,' AS backed, 0.5 + CASE WHEN ask THEN 0.3 ELSE 0 END + CASE WHEN known THEN 0 ELSE 0.1 END AS raw FROM c WHERE claims <> '')
SELECT doc_id, claims, round(CAST(CASE WHEN backed THEN 0.1 ELSE least(1.0, raw) END AS DOUBLE), 4) AS score, CASE WHEN backed THEN 'info' ELSE 'high' END AS severity,
 CASE WHEN backed THEN 'flag' ELSE 'challenge' END AS action FROM s""")
def _authority(spark, sf):
    out = _scan(planted(spark, sf), "authority_claim", "input", roles=F.array(F.lit("Owner")), authenticated=F.col("doc_id") % 2 == 0)
    claims = F.from_json("f.evidence", "claims array<string>")["claims"]
    return out.filter("f.detected").select("doc_id", F.concat(F.array_join(claims, ","), F.lit(",")).alias("claims"),
                                           F.round("f.score", 4).alias("score"), "f.severity", "f.action")


@query("scan_resource_abuse", f"""
WITH {PLANTED_SQL}, t AS (SELECT doc_id, text, unnest(regexp_extract_all(lower(text), '[^\\s\\x{{00A0}}\\x{{0085}}\\x{{000B}}]+')) AS w FROM planted WHERE length(text) >= 399),
g AS (SELECT doc_id, max(n) AS top, sum(n) AS total FROM (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL) GROUP BY 1),
s AS (SELECT p.doc_id, CASE WHEN length(text) > 20000 THEN 0.9 ELSE 0 END AS big, CASE WHEN g.total >= 200 AND g.top >= 0.1 * g.total THEN 0.7 ELSE 0 END AS flood,
 CASE WHEN regexp_matches(text, {re2(S.ENDLESS, True)}) THEN 0.55 ELSE 0 END AS endless FROM planted p LEFT JOIN g USING (doc_id))
SELECT doc_id, flood > 0 AS flooded, CAST(greatest(big, flood, endless) AS DOUBLE) AS score, CASE WHEN greatest(big, flood, endless) >= 0.6 THEN 'block' ELSE 'flag' END AS action FROM s WHERE greatest(big, flood, endless) > 0""")
def _abuse(spark, sf):
    out = _scan(planted(spark, sf), "resource_abuse", "input", options={"max_chars": 20_000, "flood_share": 0.1}).filter("f.detected")
    return out.select("doc_id", F.contains("f.evidence", F.lit("token_flood")).alias("flooded"), "f.score", "f.action")


def _topic_sql(name: str) -> str:
    return "|".join(rf"\b{t}\b" for t in S.BANNED_TOPICS[name][1])


@query("scan_banned_topics", f"""
WITH {PLANTED_SQL}, m AS (SELECT doc_id, {', '.join(f"regexp_matches(text, {re2(_topic_sql(n), True)}) AS {n}" for n in S.BANNED_TOPICS)} FROM planted)
SELECT doc_id, concat_ws(',', CASE WHEN fraud THEN 'fraud' END, CASE WHEN malware THEN 'malware' END, CASE WHEN self_harm THEN 'self_harm' END, CASE WHEN weapons THEN 'weapons' END) AS categories,
 CASE WHEN self_harm THEN 'critical' WHEN weapons OR malware THEN 'high' ELSE 'medium' END AS severity FROM m WHERE fraud OR malware OR self_harm OR weapons""")
def _banned(spark, sf):
    out = _scan(planted(spark, sf), "banned_topics", "input").filter("f.detected")
    cats = F.from_json("f.evidence", "categories array<string>")["categories"]
    return out.select("doc_id", F.array_join(cats, ",").alias("categories"), "f.severity")


def _out_sql(signals) -> str:
    return ", ".join(f"CASE WHEN regexp_matches(text, {re2(s.pattern, s.ignore_case)}) THEN {min(s.weight, S.INERT_CAP) if s.family != 'html' else s.weight} ELSE 0 END" for s in signals)


@query("scan_unsafe_output", f"""
WITH {PLANTED_SQL}, m AS (SELECT doc_id, greatest({_out_sql(S.ACTIVE_HTML)}, {_out_sql(S.INERT_PAYLOADS)},
 CASE WHEN contains(text, '![x](https://evil.example/c?d=') THEN 0.9 WHEN contains(text, '[docs](https://docs.example/path?q=1)') THEN 0.55 ELSE 0 END) AS score,
 regexp_matches(text, {re2(S.INERT_PAYLOADS[1].pattern, True)}) AS rce FROM planted)
SELECT doc_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS severity,
 CASE WHEN score >= 0.6 THEN 'block' ELSE 'flag' END AS action, CASE WHEN rce THEN 'ASI05' ELSE '' END AS extra FROM m WHERE score > 0""")
def _unsafe(spark, sf):
    out = _scan(planted(spark, sf), "unsafe_output", "output").filter("f.detected")
    return out.select("doc_id", "f.score", "f.severity", "f.action", F.array_join("f.threats", ",").alias("extra"))


@query("scan_unsafe_pages", f"""
WITH m AS (SELECT page_id, greatest({_out_sql(S.ACTIVE_HTML).replace('(text', '(html')}, 0) AS score FROM pages)
SELECT page_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS severity FROM m WHERE score > 0""")
def _pages(spark, sf):
    """Active content in crawled pages, treated as model output."""
    pages = spread(table(spark, sf, "pages"), "page_id")
    out = _scan(pages, "unsafe_output", "output", text="html").filter("f.detected")
    return out.select("page_id", "f.score", "f.severity")


def _sat(signals, extra: str = "") -> str:
    return " * ".join(f"(1 - CASE WHEN {extra}regexp_matches(text, {re2(s.pattern, True)}) THEN {s.weight}::DOUBLE ELSE 0 END)" for s in signals)


@query("scan_code_execution", f"""
WITH {CALLS_SQL}, s AS (SELECT doc_id, tool, regexp_matches(tool, {re2(S.EXEC_TOOL, True)}) AS sink,
 1 - ({_sat(S.EXEC_ALWAYS)}) * ({_sat(S.EXEC_INJECTED, f"NOT regexp_matches(tool, {re2(S.EXEC_TOOL, True)}) AND ")}) AS score FROM calls)
SELECT doc_id, tool, sink, round(score, 4) AS score, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.6 THEN 'high' ELSE 'low' END AS severity FROM s WHERE score > 0""")
def _exec(spark, sf):
    out = _scan(tool_calls(spark, sf), "code_execution", "tool_call", tool=F.col("tool")).filter("f.detected")
    sink = F.from_json("f.evidence", "execution_sink boolean")["execution_sink"]
    return out.select("doc_id", "tool", sink.alias("sink"), F.round("f.score", 4).alias("score"), "f.severity")


_TIER = ("CASE WHEN contains(tool, 'shell') OR contains(tool, 'db.delete') OR contains(tool, 'payment') THEN 'critical' WHEN contains(tool, 'email') OR contains(tool, 'send') THEN 'high' "
         "WHEN contains(tool, 'memory.write') THEN 'medium' WHEN contains(tool, 'get') OR contains(tool, 'search') OR contains(tool, 'read') OR contains(tool, 'lookup') THEN 'low' ELSE 'medium' END")
_DANGER = [s for s in S.DANGEROUS_ARGUMENTS if s.id != "outbound_exfil"]
_DANGER_SQL = " OR ".join(f"regexp_matches(text, {re2(s.pattern, True)})" for s in _DANGER)


@query("scan_token_flow", f"""
WITH {CALLS_SQL}, r AS (SELECT *, {_TIER} AS tier, {_DANGER_SQL} OR regexp_matches(text, {re2(r"https?://[^\s'\"]{4,}", True)}) AS danger,
 CASE trust WHEN 'user' THEN 3 WHEN 'tool' THEN 2 WHEN 'retrieved' THEN 1 ELSE 0 END AS au FROM calls),
g AS (SELECT *, CASE tier WHEN 'low' THEN 1 WHEN 'medium' THEN 3 ELSE 4 END - au AS gap FROM r)
SELECT doc_id, tool, tier, round(CAST(CASE WHEN danger AND tier IN ('high', 'critical') THEN 1.0 WHEN gap > 0 THEN least(1.0, 0.6 + 0.15 * gap) WHEN danger THEN 0.4 ELSE 0.35 END AS DOUBLE), 4) AS score,
 CASE WHEN danger AND tier IN ('high', 'critical') THEN 'block' WHEN gap > 0 THEN 'block' ELSE 'flag' END AS action
FROM g WHERE danger OR gap > 0 OR (contains(tool, 'write') AND au <= 1)""")
def _flow(spark, sf):
    out = _scan(tool_calls(spark, sf), "token_flow", "tool_call", tool=F.col("tool"), trust=F.col("trust")).filter("f.detected")
    tier = F.from_json("f.evidence", "sink_risk string")["sink_risk"]
    return out.select("doc_id", "tool", tier.alias("tier"), F.round("f.score", 4).alias("score"), "f.action")


@query("flow_records", f"""
WITH {CALLS_SQL} SELECT tool AS sink, trust AS source_trust, {_TIER} AS sink_risk, contains(tool, 'write') AS persistent,
 {_TIER} IN ('high', 'critical') AS external_effect, count(*) AS n FROM calls GROUP BY ALL""")
def _records(spark, sf):
    calls = tool_calls(spark, sf)
    out = TL.flow_records(calls, ScanInput(F.col("text"), stage="tool_call", tool=F.col("tool"), trust=F.col("trust")))
    return out.groupBy("sink", "source_trust", "sink_risk", "persistent", "external_effect").agg(F.count("*").alias("n"))


# Markers of one family, which all begin alike: a document quotes those of its id and of twice its id.
_MARKED = ("tok AS (SELECT 'CANARY-' || s_name AS token FROM supplier UNION ALL SELECT 'CANARY-7f3a9c'), "
           "marked AS (SELECT doc_id, text || ' CANARY-Supplier#' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || ', CANARY-Supplier#' || lpad(CAST(2 * doc_id AS VARCHAR), 9, '0') || '.' AS text FROM planted)")


@query("scan_canary", f"WITH {PLANTED_SQL}, {_MARKED} SELECT doc_id, token FROM marked JOIN tok ON contains(text, token) GROUP BY ALL")
def _canary(spark, sf):
    """Markers are the suppliers' names with one prefix, and one planted token."""
    named = table(spark, sf, "supplier").select(F.concat(F.lit("CANARY-"), "s_name").alias("token"))
    tokens = named.union(spark.createDataFrame([("CANARY-7f3a9c",)], "token string"))
    quote = lambda n: F.concat(F.lit(" CANARY-Supplier#"), F.lpad(n.cast("string"), 9, "0"))
    marked = planted(spark, sf).select("doc_id", F.concat("text", quote(F.col("doc_id")), F.lit(","), quote(2 * F.col("doc_id")), F.lit(".")).alias("text"))
    return C.scan_canary(marked, tokens).select("doc_id", "token")


@query("scan_registered_secrets", f"""
WITH {PLANTED_SQL}, reg AS (SELECT 's' || s_suppkey AS label, s_name AS value FROM supplier UNION ALL SELECT 'admin', 'hunter2x' UNION ALL SELECT 'short', 'card'),
said AS (SELECT doc_id, right(text, 60) || ' Supplier#' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS text FROM planted),
hits AS (SELECT doc_id, 'leaked:' || label AS label, unnest(list_filter(range(1, length(text) - length(value) + 2), lambda i: substr(text, i, length(value)) = value)) AS pos, length(value) AS n
         FROM said JOIN reg ON length(value) >= 8 AND contains(text, value))
SELECT doc_id, label, CAST(pos - 1 AS INTEGER) AS start, CAST(pos - 1 + n AS INTEGER) AS "end" FROM hits""")
def _registered(spark, sf):
    """Ends of documents that quote a supplier's name; values are known by salted digests only."""
    values = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("label"), F.col("s_name").alias("v"))
    values = values.union(spark.createDataFrame([("admin", "hunter2x"), ("short", "card")], "label string, v string"))
    known = values.select("label", F.sha2(F.concat(F.lit("pepper"), "v"), 256).alias("digest"), F.length("v").alias("length"))
    said = planted(spark, sf).select("doc_id", F.concat(F.expr("right(text, 60)"), F.lit(" Supplier#"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("text"))
    return C.scan_registered_secrets(said, known, "pepper", id_col="doc_id")


_GRAMS = ("SELECT {k}, unnest(list_distinct(CASE WHEN len(ws) >= 6 THEN list_transform(range(1, len(ws) - 4), lambda i: array_to_string(ws[i:i+5], ' ')) "
          "WHEN len(ws) >= 3 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM (SELECT {k}, regexp_extract_all(lower({t}), '[a-z0-9]+') AS ws FROM {f})")
_LEAK_OUT = ("outp AS (SELECT c.conv_id, c.turn, CASE WHEN c.turn % 3 = 0 AND s.stext IS NOT NULL THEN c.text || ' ' || substr(s.stext, 1, CAST(60 + c.turn * 40 AS INT)) ELSE c.text END AS text "
             "FROM conversations c LEFT JOIN (SELECT conv_id, min(text) AS stext FROM conversations WHERE role = 'system' GROUP BY 1) s USING (conv_id) WHERE c.role = 'assistant')")


@query("scan_prompt_overlap", f"""
WITH {_LEAK_OUT}, sg AS (SELECT DISTINCT conv_id, g FROM ({_GRAMS.format(k='conv_id', t='text', f="(SELECT * FROM conversations WHERE role = 'system')")})),
og AS ({_GRAMS.format(k='conv_id, turn', t='text', f='outp')}),
t AS (SELECT conv_id, count(*) AS total FROM sg GROUP BY 1), m AS (SELECT conv_id, turn, count(*) AS m FROM og JOIN sg USING (conv_id, g) GROUP BY ALL),
r AS (SELECT o.conv_id, o.turn, coalesce(m.m, 0) AS matched_ngrams, coalesce(t.total, 0) AS system_ngrams FROM outp o LEFT JOIN t USING (conv_id) LEFT JOIN m USING (conv_id, turn)),
s AS (SELECT *, CASE WHEN system_ngrams > 0 THEN matched_ngrams / system_ngrams ELSE 0.0 END AS cov FROM r),
h AS (SELECT *, system_ngrams > 0 AND (matched_ngrams >= 3 OR cov >= 0.5) AS hit, least(1.0, 0.4 + 1.5 * cov) AS sc FROM s)
SELECT conv_id, turn, matched_ngrams, system_ngrams, round(CASE WHEN hit THEN sc ELSE 0 END, 4) AS score,
 CASE WHEN NOT hit THEN 'allow' WHEN sc >= 0.6 THEN 'block' ELSE 'flag' END AS action FROM h""")
def _overlap(spark, sf):
    c = table(spark, sf, "conversations")
    system = c.filter("role = 'system'")
    first = system.groupBy("conv_id").agg(F.min("text").alias("stext"))
    out = c.filter("role = 'assistant'").join(first, "conv_id", "left")
    quoted_part = F.substring(F.col("stext"), F.lit(1), (F.col("turn") * 40 + 60).cast("int"))
    leaked = F.when((F.col("turn") % 3 == 0) & F.col("stext").isNotNull(), F.concat("text", F.lit(" "), quoted_part)).otherwise(F.col("text"))
    r = C.scan_prompt_overlap(out.select("conv_id", "turn", leaked.alias("text")), system.select("conv_id", "text"))
    return r.select("conv_id", "turn", "matched_ngrams", "system_ngrams", F.round("score", 4).alias("score"), "action")


_STOP = "[" + ", ".join(quoted(w) for w in STOPWORDS) + "]"


@query("scan_groundedness", f"""
WITH v AS (SELECT DISTINCT conv_id, w FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations WHERE role = 'user') WHERE length(w) > 2 AND NOT list_contains({_STOP}, w)),
p AS (SELECT conv_id, turn, string_split(regexp_replace(text, '([.!?])[\\s\\x{{00A0}}\\x{{0085}}\\x{{000B}}]+', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, turn, i, list_distinct(list_filter(regexp_extract_all(lower(list_extract(ps, i)), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))) AS ws
  FROM (SELECT conv_id, turn, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)),
b AS (SELECT conv_id, turn, i, len(ws) AS n, unnest(ws) AS w FROM s WHERE len(ws) >= 6),
o AS (SELECT b.conv_id, turn, i, count(v.w) / any_value(n) AS ov FROM b LEFT JOIN v ON v.conv_id = b.conv_id AND v.w = b.w GROUP BY ALL),
g AS (SELECT conv_id, turn, count(*) AS sentences_checked, count(*) FILTER (WHERE ov < 0.3) AS unsupported_sentences FROM o GROUP BY ALL)
SELECT conv_id, turn, sentences_checked, unsupported_sentences, CASE WHEN unsupported_sentences / sentences_checked > 0.5 THEN 'flag' ELSE 'allow' END AS action
FROM g WHERE conv_id IN (SELECT conv_id FROM v)""")
def _grounded(spark, sf):
    c = table(spark, sf, "conversations")
    r = C.scan_groundedness(c.filter("role = 'assistant'").select("conv_id", "turn", "text"), c.filter("role = 'user'").select("conv_id", "text"))
    return r.select("conv_id", "turn", "sentences_checked", "unsupported_sentences", "action")


def _rank_window() -> str:
    dens = ", ".join(
        "len(list_filter(ws, lambda w: w IN (" + ", ".join(quoted(t) for t in terms) + f"))) / greatest(1, len(ws)) AS d_{n}"
        for n, terms in S.TOPIC_TERMS.items()
    )
    return f"""
{CHATS_SQL}, ft AS (SELECT conv_id, turn, role, regexp_matches(text, {re2(S.REFUSAL, True)}) AS refusal, regexp_matches(text, {re2(S.PERSISTENCE, True)}) AS persist,
  rtrim(text) LIKE '%?' AS question, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_words, {dens}
  FROM (SELECT *, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM chats)),
lu AS (SELECT conv_id, max(turn) AS last FROM ft WHERE role = 'user' GROUP BY 1),
win AS (SELECT ft.*, ft.turn = lu.last AS tested FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM (SELECT ft.* FROM ft JOIN lu USING (conv_id) WHERE turn <= last)) ft JOIN lu USING (conv_id) WHERE rn <= 13),
hist AS (SELECT * FROM win WHERE NOT tested),
c1 AS (SELECT lu.conv_id, count(*) FILTER (WHERE role = 'user') AS user_turns, count(*) FILTER (WHERE role = 'assistant' AND refusal) AS refusals,
  count(*) FILTER (WHERE role = 'user' AND persist) AS persistence_markers, count(*) FILTER (WHERE role = 'user' AND question) AS questions,
  avg(n_words) FILTER (WHERE role = 'user' AND question) AS q_mean, var_pop(n_words) FILTER (WHERE role = 'user' AND question) AS q_var FROM lu LEFT JOIN hist USING (conv_id) GROUP BY 1),
rp AS (SELECT *, CASE WHEN refusals = 0 THEN 0.0 ELSE least(1.0, least(1.0, 1.5 * refusals / greatest(1, user_turns)) * 0.6 + CASE WHEN persistence_markers > 0 THEN least(0.4, 0.15 * persistence_markers) ELSE 0 END) END AS refusal_pressure FROM c1),
ser AS (SELECT conv_id, topic, pos, row_number() OVER (PARTITION BY conv_id, topic ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id, topic) AS n, d FROM (
  {' UNION ALL '.join(f"SELECT conv_id, turn, '{n}' AS topic, {i} AS pos, d_{n} AS d FROM win WHERE role = 'user'" for i, n in enumerate(S.TOPIC_TERMS))})),
hv AS (SELECT conv_id, topic, pos, avg(d) FILTER (WHERE i <= greatest(1, n // 2)) AS st, coalesce(avg(d) FILTER (WHERE i > greatest(1, n // 2)), max(d)) AS en FROM ser GROUP BY ALL),
sc AS (SELECT *, least(1.0, least(1.0, 0.5 * least(1.0, (en - st) * 40) + 0.5 * least(1.0, en * 30)) + CASE WHEN st < 0.005 THEN 0.15 ELSE 0 END) AS s FROM hv WHERE en > st),
bt AS (SELECT conv_id, arg_max(topic, round(s, 9) * 1000 - pos * 0.000001) AS drift_topic, max(s) AS topic_drift FROM sc GROUP BY 1),
sig AS (SELECT rp.*, bt.drift_topic, coalesce(bt.topic_drift, 0.0) AS topic_drift,
  CASE WHEN bt.drift_topic IS NULL OR questions < 3 OR q_mean > 25 THEN 0.0 ELSE least(1.0, 0.4 + 0.5 * (1.0 / (1.0 + q_var / greatest(1.0, q_mean))) * least(1.0, questions / 5)) END AS decomposition
  FROM rp LEFT JOIN bt USING (conv_id))"""


@query("trajectory_signals", f"""WITH {_rank_window()}
SELECT conv_id, user_turns, refusals, persistence_markers, questions, drift_topic, round(refusal_pressure, 4) AS refusal_pressure,
 round(topic_drift, 4) AS topic_drift, round(decomposition, 4) AS decomposition FROM sig""")
def _signals(spark, sf):
    """Refusal pressure, topic drift and decomposition of every conversation."""
    s = C.trajectory_signals(chats(spark, sf))
    big = {n: F.col(n).cast("bigint") for n in ("user_turns", "refusals", "persistence_markers", "questions")}
    return s.withColumns({**big, **{n: F.round(n, 4) for n in ("refusal_pressure", "topic_drift", "decomposition")}})


_TRAJ = f"""WITH {_rank_window()}, f AS (SELECT *, (refusal_pressure >= 0.4)::INT + (topic_drift >= 0.4)::INT + (decomposition >= 0.4)::INT AS strong,
 greatest(refusal_pressure, topic_drift, decomposition) AS top FROM sig),
r AS (SELECT *, CASE WHEN user_turns < 3 THEN 0.0 WHEN strong >= 2 THEN least(1.0, top + 0.2) ELSE top END AS score FROM f)"""


@query("scan_trajectory", _TRAJ + """
SELECT conv_id, round(score, 4) AS score, CASE WHEN score >= 0.65 THEN 'block' WHEN score >= 0.39 THEN 'flag' ELSE 'allow' END AS action FROM r""")
def _trajectory(spark, sf):
    return C.scan_trajectory(chats(spark, sf)).select("conv_id", F.round("score", 4).alias("score"), "trajectory.action")


@query("detect_rug_pulls", """
WITH d AS (SELECT o_orderkey, 's' || (o_custkey % 7) AS server, 'tool' || (o_custkey % 50) AS name, epoch_us(o_orderdate) // 1000 AS ts_ms, o_orderstatus AS fp FROM orders),
p AS (SELECT server, name, arg_min(fp, CAST(ts_ms AS HUGEINT) * 1000000000 + o_orderkey) AS pinned FROM d GROUP BY ALL)
SELECT server, name, count(*) AS definitions, count(*) FILTER (WHERE fp <> pinned) AS changed FROM d JOIN p USING (server, name) GROUP BY ALL""")
def _rug(spark, sf):
    """Orders as published tool definitions whose description follows the status."""
    o = table(spark, sf, "orders")
    ts = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))")
    d = o.select(F.concat(F.lit("s"), F.col("o_custkey") % 7).alias("server"), F.concat(F.lit("tool"), F.col("o_custkey") % 50).alias("name"),
                 ts.alias("ts_ms"), F.col("o_orderkey").alias("seq"), F.sha2(F.col("o_orderstatus"), 256).alias("fingerprint"))
    out = TL.detect_rug_pulls(d)
    return out.groupBy("server", "name").agg(F.count("*").alias("definitions"), F.count_if("rug_pull").alias("changed"))


@query("scan_tool_definitions", f"""
WITH {PLANTED_SQL}, b AS (SELECT doc_id, 1 - ({_sat([s for s in S.POISON])}) * {_fam_sql('text')} AS score FROM planted)
SELECT doc_id, round(score, 4) AS score, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.6 THEN 'high' ELSE 'low' END AS severity FROM b WHERE score > 0""")
def _tooldefs(spark, sf):
    """Documents as tool descriptions."""
    out = _scan(planted(spark, sf), "tool_poisoning", "tool_definition").filter("f.detected")
    return out.select("doc_id", F.round("f.score", 4).alias("score"), "f.severity")


@query("tool_fingerprint", """
SELECT p_type, count(DISTINCT sha256('{"description":"' || p_name || '","name":"' || p_brand || '","schema":{"size":' || p_size || '}}')) AS fingerprints, count(*) AS tools FROM part GROUP BY 1""")
def _fingerprint(spark, sf):
    body = F.format_string('{"parameters": {"size": %d}, "name": "%s", "description": "%s"}', "p_size", "p_brand", "p_name")
    p = table(spark, sf, "part").select("p_type", tool_fingerprint(body).alias("fp"))
    return p.groupBy("p_type").agg(F.count_distinct("fp").alias("fingerprints"), F.count("*").alias("tools"))


_RETR = _fam_sql("text")


@query("screen_documents", f"""
WITH {PLANTED_SQL}, s AS (SELECT doc_id, source, least(1.0, (1 - {_RETR}) * 1.8) AS inj,
 {_claims_sql()} <> '' AS claim, {_DANGER_SQL} OR regexp_matches(text, {re2(r"https?://[^\s'\"]{4,}", True)}) AS danger FROM planted),
k AS (SELECT source, inj >= 0.35 OR claim AS rejected FROM s)
SELECT source, count(*) AS documents, count(*) FILTER (WHERE NOT rejected) AS kept FROM k GROUP BY 1""")
def _screened(spark, sf):
    """Retrieval screening: how many documents of each source may enter context."""
    out = screen_documents(planted(spark, sf)).select("source", "kept")
    return out.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("kept").alias("kept"))


@query("scan_all")
def _scan_all(spark, sf):
    """All input scans in one projection: hits by detector, severity and action."""
    out = scan_all(planted(spark, sf), ScanInput(F.col("text"), stage="input"))
    f = out.select(F.explode("findings").alias("f")).filter("f.detected").select("f.*")
    return f.groupBy("detector", "severity", "action").agg(F.count("*").alias("hits"))


@query("screen_corpus", f"""
WITH {PLANTED_SQL}, p AS (SELECT source, lang, doc_id, text,
 regexp_matches(text, {re2(_pattern('email'))}) OR regexp_matches(text, {re2(_pattern('ip_address'))}) OR
 len(list_filter(regexp_extract_all(text, {re2(_pattern('credit_card'))}), lambda raw: length(regexp_replace(raw, '[^0-9]', '', 'g')) >= 13 AND
   list_sum(list_transform(range(1, length(regexp_replace(raw, '[^0-9]', '', 'g')) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(regexp_replace(raw, '[^0-9]', '', 'g')), i, 1) AS INT)
    ELSE (CAST(substr(reverse(regexp_replace(raw, '[^0-9]', '', 'g')), i, 1) AS INT) * 2) // 10 + (CAST(substr(reverse(regexp_replace(raw, '[^0-9]', '', 'g')), i, 1) AS INT) * 2) % 10 END)) % 10 = 0)) > 0 AS hit FROM planted)
SELECT source, lang, count(*) AS docs, count(*) FILTER (WHERE hit) AS redacted, count(*) FILTER (WHERE hit) AS low_risk, count(*) FILTER (WHERE NOT hit) AS no_risk FROM p GROUP BY ALL""")
def _corpus(spark, sf):
    """Personal data of three kinds, then threats, risk, policy and decision, by source and language."""
    opts = {"entities": ["email", "ip_address", "credit_card"]}
    docs = planted(spark, sf)
    found = scan_all(docs, ScanInput(F.col("text"), stage="input"), names=["pii"], options={"pii": opts})
    from wardspark.plans.firewall import decide

    out = decide(found, stage="input").select("source", "lang", "action", "risk.band")
    return out.groupBy("source", "lang").agg(
        F.count("*").alias("docs"), F.count_if(F.col("action") == "redact").alias("redacted"),
        F.count_if(F.col("band") == "low").alias("low_risk"), F.count_if(F.col("band") == "none").alias("no_risk"))


@query("screen_requests")
def _requests(spark, sf):
    """The whole request path at the input boundary: decisions by source and action."""
    out = screen(planted(spark, sf), stage="input").select("source", "action", "risk.band")
    return out.groupBy("source", "action", "band").agg(F.count("*").alias("n"))


