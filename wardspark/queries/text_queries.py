"""Text functions, redaction and line scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.functions import checks, ranks, regex
from wardspark.functions import text as X
from wardspark.functions.tables import register
from wardspark.operators import conversation as C
from wardspark.operators.detectors import exfil_hosts
from wardspark.operators.redact import audit_payload, safety_net
from wardspark.operators.signals import PII, SAFETY_NET
from wardspark.queries.base import (
    AUDIT_SQL, PLANTED_SQL, audit, planted, quoted, query, re2, spread, table,
)
from wardspark.sources.text import scan_totals, screened_lines

_STOP = "[" + ", ".join(quoted(w) for w in X.STOPWORDS) + "]"
_MSTOP = "[" + ", ".join(quoted(w) for w in X.MEMORY_STOPWORDS) + "]"
_BY_LABEL = {e.label: e.pattern for e in PII}


@query("luhn_valid", f"""
WITH {PLANTED_SQL}, m AS (
  SELECT doc_id, unnest(regexp_extract_all(text, {re2(_BY_LABEL['credit_card'])})) AS raw FROM planted),
d AS (SELECT doc_id, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM m),
s AS (SELECT doc_id, digits, list_sum(list_transform(range(1, length(digits) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(digits), i, 1) AS INT)
         ELSE (CAST(substr(reverse(digits), i, 1) AS INT) * 2) // 10 + (CAST(substr(reverse(digits), i, 1) AS INT) * 2) % 10 END)) AS total FROM d)
SELECT doc_id, digits, length(digits) >= 13 AND total % 10 = 0 AS valid FROM s""")
def _luhn(spark, sf):
    m = planted(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(regex.java(_BY_LABEL["credit_card"])), F.lit(0))).alias("raw"))
    return m.select("doc_id", F.regexp_replace("raw", "[^0-9]", "").alias("digits"), checks.luhn_valid(F.col("raw")).alias("valid"))


@query("ssn_valid", """
WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' ||
  lpad(CAST(c_custkey * 7 % 10000 AS VARCHAR), 4, '0') AS ssn FROM customer)
SELECT c_custkey, ssn, substr(ssn, 1, 3) NOT IN ('000', '666') AND substr(ssn, 1, 1) <> '9' AND substr(ssn, 5, 2) <> '00'
  AND substr(ssn, 8, 4) <> '0000' AS valid FROM c""")
def _ssn(spark, sf):
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    c = table(spark, sf, "customer").select("c_custkey", F.concat_ws(
        "-", pad(F.col("c_custkey") % 1000, 3), pad(F.col("c_nationkey"), 2), pad(F.col("c_custkey") * 7 % 10000, 4)).alias("ssn"))
    return c.withColumn("valid", checks.ssn_valid(F.col("ssn")))


@query("iban_valid", """
WITH c AS (SELECT o_orderkey, 'GB' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || 'WEST' || lpad(CAST(o_custkey AS VARCHAR), 12, '1') AS iban FROM orders),
d AS (SELECT o_orderkey, iban, CAST('32142829' || substr(iban, 9) || '1611' || substr(iban, 3, 2) AS HUGEINT) % 97 = 1 AS valid FROM c)
SELECT valid, count(*) AS n, min(iban) AS first_iban FROM d GROUP BY 1""")
def _iban(spark, sf):
    iban = F.concat(F.lit("GB"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("WEST"),
                    F.lpad(F.col("o_custkey").cast("string"), 12, "1"))
    d = table(spark, sf, "orders").select(iban.alias("iban")).withColumn("valid", checks.iban_valid(F.col("iban")))
    return d.groupBy("valid").agg(F.count("*").alias("n"), F.min("iban").alias("first_iban"))


@query("shannon_entropy", """
WITH b AS (SELECT p_partkey, p_name FROM part), c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch, length(p_name) AS n FROM b),
g AS (SELECT p_partkey, ch, n, count(*) AS k FROM c WHERE ch <> '' GROUP BY ALL)
SELECT p_partkey, round(-sum((k / n) * log2(k / n)), 6) AS entropy FROM g GROUP BY 1""")
def _entropy(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(checks.shannon_entropy(F.col("p_name")), 6).alias("entropy"))


@query("shingles", """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 6 THEN list_transform(range(1, len(ws) - 4), lambda i: array_to_string(ws[i:i+5], ' '))
  WHEN len(ws) >= 3 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gs FROM w)
SELECT doc_id, CAST(len(gs) AS BIGINT) AS n, list_min(gs) AS first_gram, list_max(gs) AS last_gram FROM g""")
def _shingles(spark, sf):
    d = spread(table(spark, sf, "documents"), "doc_id").select("doc_id", X.shingles(F.col("text"), 6).alias("g"))
    return d.select("doc_id", F.size("g").cast("bigint").alias("n"), F.array_min("g").alias("first_gram"), F.array_max("g").alias("last_gram"))


@query("content_words", f"""
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS word FROM documents)
SELECT doc_id, count(*) AS n, min(word) AS first_word, max(word) AS last_word FROM w
WHERE length(word) > 2 AND NOT list_contains({_STOP}, word) GROUP BY 1""")
def _content(spark, sf):
    w = spread(table(spark, sf, "documents"), "doc_id").select("doc_id", X.content_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return w.select("doc_id", F.size("w").cast("bigint").alias("n"), F.array_min("w").alias("first_word"), F.array_max("w").alias("last_word"))


@query("memory_terms", f"""
WITH w AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_.\\-]{{3,}}'))) AS term FROM conversations)
SELECT conv_id, turn, count(*) AS n, min(term) AS first_term FROM w WHERE NOT list_contains({_MSTOP}, term) GROUP BY ALL""")
def _mterms(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", X.memory_terms(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return t.select("conv_id", "turn", F.size("t").cast("bigint").alias("n"), F.array_min("t").alias("first_term"))


@query("split_sentences", """
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[\\s\\x{00A0}\\x{0085}\\x{000B}]+', '\\1' || chr(1), 'g'), chr(1))) AS part FROM documents)
SELECT doc_id, count(*) AS n, max(length(part)) AS longest FROM s WHERE trim(part) <> '' GROUP BY 1""")
def _sentences(spark, sf):
    s = spread(table(spark, sf, "documents"), "doc_id").select("doc_id", X.split_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n"),
                    F.array_max(F.transform("s", F.length)).cast("bigint").alias("longest")).filter("n > 0")


@query("digest", "SELECT doc_id, substr(sha256('pepper' || text), 1, 32) AS digest FROM documents")
def _digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.digest(F.col("text"), "pepper").alias("digest"))


@query("security_relevant", f"""
WITH {AUDIT_SQL} SELECT action, severity, error IS NOT NULL AS has_error,
  action IN ('block', 'challenge') OR severity IN ('high', 'critical') OR error IS NOT NULL AS relevant, count(*) AS n FROM a GROUP BY ALL""")
def _relevant(spark, sf):
    e = audit(spark, sf)
    rel = ranks.security_relevant(F.col("action"), F.col("severity"), F.col("error")).alias("relevant")
    return e.groupBy("action", "severity", F.col("error").isNotNull().alias("has_error"), rel).agg(F.count("*").alias("n"))


@query("sample_traffic", f"""
WITH {AUDIT_SQL} SELECT action, severity, count(*) AS n FROM a WHERE action IN ('block', 'challenge') OR severity IN ('high', 'critical') OR error IS NOT NULL
 OR CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 1000 GROUP BY ALL""")
def _sample(spark, sf):
    """A tenth of ordinary traffic, and every security-relevant event."""
    e = audit(spark, sf)
    rel = ranks.security_relevant(F.col("action"), F.col("severity"), F.col("error"))
    kept = e.filter(rel | ranks.sampled(F.col("event_id"), 0.1))
    return kept.groupBy("action", "severity").agg(F.count("*").alias("n"))


@query("rank_helpers", f"""
WITH {AUDIT_SQL} SELECT action, severity, risk_band, trust,
 CAST(list_position(['allow','flag','redact','challenge','block'], action) - 1 AS INT) AS action_rank,
 CAST(list_position(['info','low','medium','high','critical'], severity) - 1 AS INT) AS severity_rank,
 CAST(list_position(['none','low','medium','high','critical'], risk_band) - 1 AS INT) AS band_rank,
 CASE trust WHEN 'user' THEN 3 WHEN 'tool' THEN 2 WHEN 'retrieved' THEN 1 ELSE 0 END AS authority, count(*) AS n FROM a GROUP BY ALL""")
def _ranks(spark, sf):
    e = audit(spark, sf).withColumn("trust", F.col("tags")["trust"])
    return e.groupBy(
        "action", "severity", "risk_band", "trust", ranks.action_rank(F.col("action")).alias("action_rank"),
        ranks.severity_rank(F.col("severity")).alias("severity_rank"), ranks.band_rank(F.col("risk_band")).alias("band_rank"),
        ranks.authority(F.col("trust")).alias("authority"),
    ).agg(F.count("*").alias("n"))


@query("exfil_hosts", f"""
WITH {PLANTED_SQL}, m AS (SELECT doc_id, text, unnest(regexp_extract_all(text,
  '(?i)!?\\[[^\\]\\n]{{0,200}}\\]\\(\\s*<?https?://[^\\s)>]+>?\\s*\\)')) AS link FROM planted),
u AS (SELECT doc_id, link, regexp_extract(link, '(https?://[^\\s)>]+)', 1) AS url FROM m)
SELECT doc_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM u WHERE contains(url, '?')""")
def _hosts(spark, sf):
    return planted(spark, sf).select("doc_id", F.explode(exfil_hosts(F.col("text"))).alias("host"))


@query("glob_match", f"""
WITH {AUDIT_SQL} SELECT tool, regexp_full_match(tool, 'payment\\..*') OR regexp_full_match(tool, '.*\\.e?ec') OR tool = 'email.send'
  OR regexp_full_match(tool, '[a-d]rm\\.look.p') AS hit, count(*) AS n FROM a WHERE tool IS NOT NULL GROUP BY ALL""")
def _glob(spark, sf):
    e = audit(spark, sf).select(F.col("tags")["tool"].alias("tool")).filter("tool is not null")
    hit = regex.glob_match(F.col("tool"), ["payment.*", "*.?ec", "email.send", "[a-d]rm.look?p"])
    return e.groupBy("tool", hit.alias("hit")).agg(F.count("*").alias("n"))


@query("current_turn", """
WITH l AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN turn END) AS last FROM conversations GROUP BY 1)
SELECT c.conv_id, c.turn, c.role, 'user' AS trust, 'input' AS stage FROM conversations c JOIN l USING (conv_id)
WHERE (l.last IS NULL OR c.turn > l.last) AND c.role NOT IN ('system', 'developer')""")
def _current(spark, sf):
    return C.current_turn(table(spark, sf, "conversations")).select("conv_id", "turn", "role", "trust", "stage")


@query("cause_trust", """
WITH c AS (SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE (CASE WHEN turn > 4 THEN 0 ELSE 3 END) END AS au FROM conversations),
r AS (SELECT conv_id, turn, min(au) OVER (PARTITION BY conv_id ORDER BY turn) AS low FROM c)
SELECT conv_id, turn, CASE low WHEN 0 THEN 'external' WHEN 2 THEN 'tool' ELSE 'user' END AS cause_trust FROM r""")
def _cause(spark, sf):
    m = (F.col("conv_id") + F.col("turn")) % 4
    trust = F.when(m == 0, "user").when(m == 1, "tool").when(m == 2, "user_confirmed").otherwise(
        F.when(F.col("turn") > 4, "external").otherwise("user"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", trust.alias("trust"))
    return C.cause_trust(c).select("conv_id", "turn", "cause_trust")


@query("conversation_text", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS conversation FROM r WHERE rn <= 4 GROUP BY 1""")
def _ctext(spark, sf):
    return C.conversation_text(table(spark, sf, "conversations"), 4)


def _net_sql() -> str:
    expr = "text"
    tests = []
    for e in SAFETY_NET:
        if e.label == "private_key":
            continue
        tests.append(f"CASE WHEN regexp_matches({expr}, {re2(e.pattern, e.ignore_case)}) THEN '{e.label}' END")
        expr = f"regexp_replace({expr}, {re2(e.pattern, e.ignore_case)}, '[REDACTED:{e.label}]', 'g')"
    return f"WITH {PLANTED_SQL} SELECT doc_id, sha256(replace({expr}, ' ', '')) AS digest, concat_ws(',', {', '.join(tests)}) AS labels FROM planted"


@query("redact_safety_net", _net_sql())
def _net(spark, sf):
    out, labels = safety_net(F.col("text"))
    return planted(spark, sf).select("doc_id", F.sha2(F.replace(out, F.lit(" ")), 256).alias("digest"), F.array_join(labels, ",").alias("labels"))


@query("audit_payload", """
SELECT doc_id, 'sha256:' || substr(sha256('pepper' || text), 1, 32) AS hashed,
 text AS shown,
 CAST(NULL AS VARCHAR) AS hidden FROM documents""")
def _payload(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", audit_payload(t, mode="hash_only", salt="pepper")[0].alias("hashed"),
        audit_payload(t, mode="full")[0].alias("shown"), audit_payload(t, mode="none")[0].alias("hidden"))


_LINE_BLOCKS = " OR ".join(
    f"regexp_matches(line, {p})" for p in (
        quoted("\\bgh[pousr]_[A-Za-z0-9]{30,255}\\b"), quoted("\\b(?:AKIA|ASIA)[A-Z0-9]{16}\\b"), quoted("api_secret = .k7Jx2"),
        quoted("(?i)ignore all previous instructions|Reveal your system prompt|no longer bound|collector\\.example\\.net/in|Do not tell the user|decode the text and then run"
               "|full authorization for this|just a test environment|As the owner I say so|pipe bomb|stolen credit card|admin password:|New instructions:|I am the administrator, disable"),
    ))


@query("scan_lines", f"""
WITH {PLANTED_SQL}, lines AS (SELECT unnest(string_split(replace(text, chr(13), chr(10)), chr(10))) AS line FROM planted),
kept AS (SELECT row_number() OVER () AS i, line, regexp_extract(line, 'token = "([0-9a-f]{{40}})"', 1) AS assigned FROM lines WHERE trim(line, ' ') <> ''),
ch AS (SELECT i, unnest(string_split(assigned, '')) AS c FROM kept WHERE assigned <> ''),
ent AS (SELECT i, -sum((k / 40) * log2(k / 40)) AS bits FROM (SELECT i, c, count(*) AS k FROM ch WHERE c <> '' GROUP BY ALL) GROUP BY 1)
SELECT count(*) AS scanned, count(*) FILTER (WHERE {_LINE_BLOCKS} OR coalesce(bits >= 3.5, false)) AS blocked FROM kept LEFT JOIN ent USING (i)""")
def _lines(spark, sf):
    lines = planted(spark, sf).select(F.explode(F.split("text", r"[\r\n]")).alias("value"))
    return scan_totals(screened_lines(lines))


# Rules that read the same in both engines.
_SPAN_RULES = {"address": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "number": "[0-9]{3,}", "link": "https?://[a-z0-9./-]+"}


@query("find_spans", "SELECT doc_id, label, value, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS label, unnest(regexp_extract_all(text, '{v}')) AS value FROM documents" for k, v in _SPAN_RULES.items()) + ") GROUP BY ALL")
def _find_spans(spark, sf):
    """Spans of three rules as rows, by a lateral join with the table function."""
    register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("_span_documents")
    rules = ", ".join(f"'{k}', '{v}'" for k, v in _SPAN_RULES.items())
    found = spark.sql(f"SELECT d.doc_id, s.label, s.value FROM _span_documents d, LATERAL find_spans(d.text, map({rules})) s")
    return found.groupBy("doc_id", "label", "value").agg(F.count("*").alias("n"))
