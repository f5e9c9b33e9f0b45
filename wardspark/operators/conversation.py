"""Operators over conversations: (conv_id, turn, role, text).

A conversation may hold a third of all rows, so nothing collects one. Texts are reduced to
small per-turn features before any shuffle, per-conversation extremes use map-side
combining, and the twelve-turn window is a ranked filter Spark also applies before the
shuffle, so a hot conversation sends at most a window of rows per input task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspark.functions import regex
from wardspark.functions import text as X
from wardspark.functions.ranks import AUTHORITY, lookup
from wardspark.operators import signals as S
from wardspark.operators.scan import finding, json_evidence, settle

# How a message's role maps to trust and boundary.
ROLE_TRUST = {"system": "system", "developer": "system", "user": "user", "assistant": "user", "tool": "tool", "function": "tool"}


def role_trust(role: Column) -> Column:
    return lookup(role, ROLE_TRUST, "external")


def role_stage(role: Column) -> Column:
    return F.when(role_trust(role) == "tool", "tool_result").otherwise("input")


def current_turn(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Messages after the last assistant message, with trust and stage; instructions are left out."""
    last = messages.filter(F.col("role") == "assistant").groupBy(key).agg(F.max("turn").alias("_last"))
    rest = messages.filter(~F.col("role").isin("system", "developer"))
    return (
        rest.join(last, key, "left")
        .filter(F.col("_last").isNull() | (F.col("turn") > F.col("_last")))
        .drop("_last")
        .withColumns({"trust": role_trust(F.col("role")), "stage": role_stage(F.col("role"))})
    )


def cause_trust(messages: DataFrame, key: str = "conv_id", trust: str = "trust", start: str = "user_confirmed") -> DataFrame:
    """The least trusted source among the conversation's messages so far.

    A running minimum over six levels needs only the first turn of each level, which is a
    map-side combined aggregate instead of an ordered pass over the conversation.
    """
    levels = sorted(AUTHORITY, key=AUTHORITY.get)
    firsts = messages.groupBy(key).agg(*[F.min(F.when(F.col(trust) == t, F.col("turn"))).alias(f"_first_{t}") for t in levels])
    below = [t for t in levels if AUTHORITY[t] < AUTHORITY[start]]
    seen: Column | None = None
    for t in below:
        test = F.col(f"_first_{t}") <= F.col("turn")
        seen = F.when(test, t) if seen is None else seen.when(test, t)
    lowest = seen.otherwise(F.lit(start))
    reported = F.when(lowest == start, "user").otherwise(lowest)
    return messages.join(firsts, key).withColumn("cause_trust", reported).drop(*[f"_first_{t}" for t in levels])


def last_turns(messages: DataFrame, n: int, key: str = "conv_id") -> DataFrame:
    """The newest ``n`` messages of each conversation, ``_rn`` counting back from 1."""
    newest_first = Window.partitionBy(key).orderBy(F.col("turn").desc())
    return messages.withColumn("_rn", F.row_number().over(newest_first)).filter(F.col("_rn") <= n)


def conversation_text(messages: DataFrame, limit: int = 10, key: str = "conv_id") -> DataFrame:
    """``role: content`` lines of the last ``limit`` turns, oldest first."""
    lines = last_turns(messages, limit, key).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))).alias("_l")
    )
    return lines.select(key, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("conversation"))


def turn_features(messages: DataFrame, topics: Mapping[str, Sequence[str]] | None = None, key: str = "conv_id") -> DataFrame:
    """What the multi-turn signals need of each message; the text itself goes no further."""
    text, lc = F.col("text"), F.col("_lc")
    table = {**S.TOPIC_TERMS, **(topics or {})}
    refusal = regex.guarded(text, lc, S.REFUSAL, ("sorry", "afraid", "unable", "can", "won't", "will", "against", "decline"))
    insist = regex.guarded(text, lc, S.PERSISTENCE, (
        "but", "come", "please", "try", "what", "let", "rephrase", "you", "continue"))

    def density(terms: Sequence[str]) -> Column:
        hits = F.size(F.filter(F.col("_words"), lambda w: w.isin(*terms)))
        return F.when(regex.contains_any(lc, terms), hits / F.greatest(F.lit(1), F.size("_words"))).otherwise(F.lit(0.0))

    trimmed = F.regexp_replace(text, regex.java(r"\s+$"), "")
    return (
        messages.withColumn("_lc", regex.folded(text))
        .withColumn("_words", F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))
        .select(
            key, "turn", "role",
            refusal.alias("refusal"), insist.alias("persistence"),
            trimmed.endswith("?").alias("question"),
            F.size(F.filter(F.split(text, regex.java(r"\s+")), lambda w: w != "")).alias("n_words"),
            F.struct(*[density(terms).alias(t) for t, terms in table.items()]).alias("density"),
        )
    )


def trajectory_window(messages: DataFrame, window: int = S.TRAJECTORY_WINDOW, key: str = "conv_id",
                      topics: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Per conversation: the last user turn (``tested``) and up to ``window`` turns before it, oldest first."""
    feats = turn_features(messages, topics, key)
    last_user = feats.filter(F.col("role") == "user").groupBy(key).agg(F.max("turn").alias("_last_user"))
    upto = feats.join(last_user, key).filter(F.col("turn") <= F.col("_last_user"))
    newest_first = Window.partitionBy(key).orderBy(F.col("turn").desc())
    kept = upto.withColumn("_rn", F.row_number().over(newest_first)).filter(F.col("_rn") <= window + 1)
    names = ["turn", "role", "refusal", "persistence", "question", "n_words", "density"]
    return kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("turns"))


def refusal_pressure(refusals: Column, persistence: Column, turns: Column) -> Column:
    """Repeated refusals the user keeps pushing against."""
    base = F.least(F.lit(1.0), refusals / F.greatest(F.lit(1), turns) * 1.5) * 0.6
    push = F.when(persistence > 0, F.least(F.lit(0.4), persistence * 0.15)).otherwise(F.lit(0.0))
    return F.when(refusals == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), base + push))


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def topic_drift(series: Mapping[str, Column]) -> Column:
    """(score, topic) of the topic whose density rises most from the first to the second half."""
    scored = []
    for pos, (topic, xs) in enumerate(series.items()):
        half = F.greatest(F.lit(1), F.floor(F.size(xs) / 2).cast("int"))
        start = _mean(F.slice(xs, F.lit(1), half))
        end = F.when(F.size(xs) > half, _mean(F.slice(xs, half + 1, F.size(xs)))).otherwise(F.element_at(xs, -1))
        rise = F.least(F.lit(1.0), (end - start) * 40)
        magnitude = F.least(F.lit(1.0), end * 30)
        score = F.least(F.lit(1.0), rise * 0.5 + magnitude * 0.5)
        score = F.when(start < 0.005, F.least(F.lit(1.0), score + 0.15)).otherwise(score)
        scored.append(F.when(end > start, F.struct(score.alias("score"), F.lit(-pos).alias("pos"), F.lit(topic).alias("topic"))))
    best = F.array_max(F.filter(F.array(*scored), lambda s: s.isNotNull()))
    return F.struct(F.coalesce(best["score"], F.lit(0.0)).alias("score"), best["topic"].alias("topic"))


def decomposition(questions: Column, lengths: Column, topic: Column) -> Column:
    """Many short, evenly sized questions on one topic; ``lengths`` are the questions' word counts."""
    mean = _mean(lengths)
    variance = F.aggregate(lengths, F.lit(0.0), lambda a, n: a + (n - mean) * (n - mean)) / F.size(lengths)
    uniformity = F.lit(1.0) / (F.lit(1.0) + variance / F.greatest(F.lit(1.0), mean))
    score = F.least(F.lit(1.0), F.lit(0.4) + uniformity * 0.5 * F.least(F.lit(1.0), questions / 5))
    return F.when(topic.isNull() | (questions < 3) | (mean > 25), F.lit(0.0)).otherwise(score)


def trajectory_signals(messages: DataFrame, key: str = "conv_id", window: int = S.TRAJECTORY_WINDOW,
                       topics: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The three multi-turn signals and what they were computed from, one row per conversation."""
    names = list({**S.TOPIC_TERMS, **(topics or {})})
    base = trajectory_window(messages, window, key, topics)
    history = F.slice("turns", F.lit(1), F.size("turns") - 1)
    by_role = lambda role: F.filter(F.col("_history"), lambda t: t["role"] == role)
    users = F.col("_users")
    df = base.withColumn("_history", history).withColumns({"_users": by_role("user"), "_assistants": by_role("assistant")})
    asked = F.filter(users, lambda t: t["question"])
    drift_turns = F.concat(users, F.slice("turns", -1, 1))
    df = df.withColumns({
        "user_turns": F.size(users),
        "refusals": F.size(F.filter("_assistants", lambda t: t["refusal"])),
        "persistence_markers": F.size(F.filter(users, lambda t: t["persistence"])),
        "_drift": topic_drift({n: F.transform(drift_turns, lambda t: t["density"][n]) for n in names}),
        "questions": F.size(asked),
        "_lengths": F.transform(asked, lambda t: t["n_words"]),
    })
    df = df.withColumns({
        "refusal_pressure": refusal_pressure(F.col("refusals"), F.col("persistence_markers"), F.col("user_turns")),
        "drift_topic": F.col("_drift.topic"),
        "topic_drift": F.col("_drift.score"),
        "decomposition": decomposition(F.col("questions"), F.col("_lengths"), F.col("_drift.topic")),
    })
    names = ("user_turns", "refusals", "persistence_markers", "questions", "drift_topic", "refusal_pressure", "topic_drift",
             "decomposition")
    return settle(df.select(key, *names), *names)


def scan_trajectory(messages: DataFrame, key: str = "conv_id", threshold: float = S.TRAJECTORY_THRESHOLD,
                    min_turns: int = S.TRAJECTORY_MIN_TURNS, window: int = S.TRAJECTORY_WINDOW,
                    topics: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One ``trajectory`` finding per conversation, tested at its last user turn."""
    sig = trajectory_signals(messages, key, window, topics)
    parts = [F.col("refusal_pressure"), F.col("topic_drift"), F.col("decomposition")]
    strong = reduce(lambda a, b: a + b, [(p >= 0.4).cast("int") for p in parts])
    top = F.greatest(*parts)
    enough = F.col("user_turns") >= min_turns
    score = F.when(strong >= 2, F.least(F.lit(1.0), top + 0.2)).otherwise(top)
    sig = sig.withColumn("score", F.when(enough, score).otherwise(F.lit(0.0)))
    hard = F.col("score") >= threshold
    found = finding(
        "trajectory", "multi_turn_attack", F.col("score") >= threshold * 0.6, score=F.col("score"),
        severity=F.when(hard, "high").otherwise("low"), action=F.when(hard, "block").otherwise("flag"),
        summary=F.lit("multi-turn escalation"),
        evidence=json_evidence(refusals=F.col("refusals"), persistence_markers=F.col("persistence_markers"),
                               turns_analysed=F.col("user_turns"), drift_topic=F.col("drift_topic")),
    )
    return settle(sig.withColumn("trajectory", found), "score", "trajectory")


def scan_prompt_overlap(outputs: DataFrame, prompts: DataFrame, key: str = "conv_id", output_id: str = "turn",
                        ngram: int = 6, min_matches: int = 3, threshold: float = 0.6) -> DataFrame:
    """How much of its conversation's system prompt each output repeats, by n-gram equi-join.

    ``outputs`` is (key, output_id, text), ``prompts`` is (key, text). Grams are hashed before
    the shuffle and joined on (key, gram), so one hot conversation spreads over its grams.
    """
    def hashed(df: DataFrame) -> Column:
        return F.explode(F.transform(X.shingles(F.col("text"), ngram), lambda g: F.xxhash64(g))).alias("_g")

    system = prompts.select(key, hashed(prompts)).distinct()
    totals = system.groupBy(key).agg(F.count("*").alias("system_ngrams"))
    out = outputs.select(key, output_id, hashed(outputs))
    matched = out.join(system, [key, "_g"]).groupBy(key, output_id).agg(F.count("*").alias("matched_ngrams"))
    base = outputs.select(key, output_id).join(totals, key, "left").join(matched, [key, output_id], "left")
    m = F.coalesce("matched_ngrams", F.lit(0).cast("bigint"))
    total = F.coalesce("system_ngrams", F.lit(0).cast("bigint"))
    cov = F.when(total > 0, m / total).otherwise(F.lit(0.0))
    hit = (total > 0) & ((m >= min_matches) | (cov >= 0.5))
    score = F.when(hit, F.least(F.lit(1.0), F.lit(0.4) + cov * 1.5)).otherwise(F.lit(0.0))
    return base.select(
        key, output_id, m.alias("matched_ngrams"), total.alias("system_ngrams"), cov.alias("coverage"), score.alias("score"),
        F.when(~hit, "allow").when(score >= threshold, "block").otherwise("flag").alias("action"),
    )


def scan_groundedness(answers: DataFrame, passages: DataFrame, key: str = "conv_id", answer_id: str = "turn",
                      min_overlap: float = 0.3, min_words: int = 6, max_ratio: float = 0.5) -> DataFrame:
    """Share of each answer's substantive sentences that its key's passages do not support.

    Sentence words are matched to passage words by equi-join on (key, word), so neither a
    vocabulary nor a conversation is ever gathered in one place.
    """
    vocab = passages.select(key, F.explode(X.content_words(F.col("text"))).alias("_w")).distinct()
    has_vocab = vocab.groupBy(key).agg(F.lit(True).alias("_has"))
    sentences = answers.select(key, answer_id, F.posexplode(X.split_sentences(F.col("text"))).alias("_s", "_text"))
    bags = sentences.select(key, answer_id, "_s", X.content_words(F.col("_text")).alias("_words")).filter(
        F.size("_words") >= min_words
    )
    exploded = bags.select(key, answer_id, "_s", F.size("_words").alias("_n"), F.explode("_words").alias("_w"))
    known = vocab.withColumn("_known", F.lit(1))
    scored = (
        exploded.join(known, [key, "_w"], "left")
        .groupBy(key, answer_id, "_s").agg((F.count("_known") / F.first("_n")).alias("overlap"))
    )
    per = scored.groupBy(key, answer_id).agg(
        F.count("*").alias("sentences_checked"), F.count_if(F.col("overlap") < min_overlap).alias("unsupported_sentences"),
        F.avg("overlap").alias("mean_overlap"),
    )
    ratio = F.col("unsupported_sentences") / F.col("sentences_checked")
    return per.join(has_vocab, key).select(
        key, answer_id, "sentences_checked", "unsupported_sentences", ratio.alias("unsupported_ratio"), "mean_overlap",
        F.when(ratio > max_ratio, "flag").otherwise("allow").alias("action"),
    )


#: Bytes of markers, and digests of registered values, that one pass over the texts takes along.
MARKER_BYTES = 16 << 20
DIGESTS = 200_000


def _passes(df: DataFrame, cost: Column, most: int, key: str) -> Iterator[list[tuple]]:
    """The rows of ``df`` in parts that cost about ``most`` each; a part is small enough to go to every task."""
    total = df.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-int(total) // most))
    for i in range(count):
        part = df.where(F.pmod(F.xxhash64(key), F.lit(count)) == i).collect()
        if part:
            yield [tuple(r) for r in part]


def scan_canary(outputs: DataFrame, canaries: DataFrame, text_col: str = "text") -> DataFrame:
    """Outputs holding a planted marker, one row per marker; ``canaries`` is (token).

    All markers are looked for at once by an automaton, in time linear in the text and in its hits, however
    alike the markers are. Markers of more than ``MARKER_BYTES`` take several passes over the texts. No shuffle of texts.
    Null texts and null or empty markers match nothing; a marker counts once for each row.
    """
    tokens = canaries.select("token").filter(F.length("token") > 0).distinct()
    schema = T.StructType([*outputs.schema.fields, T.StructField("token", T.StringType())])
    found = None
    for part in _passes(tokens, F.octet_length("token") + 64, MARKER_BYTES, "token"):
        sent = outputs.sparkSession.sparkContext.broadcast([t for (t,) in part])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for token in sent.value:
                automaton.add_word(token, token)
            automaton.make_automaton()
            for batch in batches:
                at, hits = [], []
                for i, text in enumerate(batch.column(text_col).to_pylist()):
                    if text:
                        names = {token for _, token in automaton.iter(text)}
                        at += [i] * len(names)
                        hits += names
                if at:
                    rows = batch.take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(hits, pa.string())], names=[*batch.schema.names, "token"])

        rows = outputs.mapInArrow(search, schema)
        found = rows if found is None else found.union(rows)
    return outputs.sparkSession.createDataFrame([], schema) if found is None else found


def scan_registered_secrets(outputs: DataFrame, registered: DataFrame, salt: str, id_col: str = "id",
                            text_col: str = "text", min_length: int = 8) -> DataFrame:
    """Outputs that quote a registered value; ``registered`` is (label, digest, length), plaintexts unknown.

    Every place of a text is hashed once for each registered length, in place, and looked up among the digests; these go
    to the tasks in parts of ``DIGESTS``. Only what was found leaves a task. Null texts quote nothing.
    """
    known = registered.filter((F.col("length") >= min_length) & F.col("digest").isNotNull()).select("digest", "label", "length").distinct()
    id_type = dict(outputs.dtypes)[id_col]
    schema = f"{id_col} {id_type}, label string, start int, end int"
    found = None
    for part in _passes(known, F.lit(1), DIGESTS, "digest"):
        sent = outputs.sparkSession.sparkContext.broadcast(part)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import hashlib

            salted = hashlib.sha256(salt.encode("utf-8"))
            table: dict[int, dict[str, list[str]]] = {}
            for digest, label, n in sent.value:
                table.setdefault(int(n), {}).setdefault(digest, []).append(label)
            for batch in batches:
                rows: list[tuple] = []
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    text = text or ""
                    raw = text.encode("utf-8", "surrogatepass")
                    ends = None if len(raw) == len(text) else np.concatenate([np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), [len(raw)]])
                    for n, digests in table.items():
                        for i in range(len(text) - n + 1):
                            a, z = (i, i + n) if ends is None else (int(ends[i]), int(ends[i + n]))
                            window = salted.copy()
                            window.update(raw[a:z])
                            for label in digests.get(window.hexdigest(), ()):
                                rows.append((name, f"leaked:{label}", i, i + n))
                if rows:
                    kinds = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[id_col, "label", "start", "end"])

        rows = outputs.select(id_col, text_col).mapInArrow(search, schema)
        found = rows if found is None else found.union(rows)
    return outputs.sparkSession.createDataFrame([], schema) if found is None else found


def select_escalations(df: DataFrame, score: str = "score", low: float = S.INJECTION_ESCALATE,
                       high: float = S.INJECTION_THRESHOLD) -> DataFrame:
    """Rows in the ambiguous band that deserve a second opinion."""
    return df.filter((F.col(score) >= low) & (F.col(score) < high))


def parse_verdict(raw: Column) -> Column:
    """A classifier's reply as {unsafe, score, category, reason}; null where it cannot be read."""
    body = F.trim(raw)
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    source = F.when(fenced != "", fenced).when(body.startswith("{"), body).otherwise(braced)
    parsed = F.from_json(source, "unsafe boolean, score double, category string, reason string")
    word = F.lower(F.trim(F.regexp_extract(body, r"^[^\n]*", 0)))
    bare = word.isin("safe", "unsafe")
    valid = F.try_parse_json(source).isNotNull() & (source != "")
    nothing = F.lit(None).cast("string")
    unsafe = F.when(source != "", F.coalesce(parsed["unsafe"], F.lit(False))).otherwise(word == "unsafe")
    score = F.when((source != "") & parsed["score"].isNotNull(), parsed["score"]).otherwise(unsafe.cast("double"))
    return F.when(valid | ((source == "") & bare), F.struct(
        unsafe.alias("unsafe"), score.alias("score"),
        F.when(source != "", parsed["category"]).otherwise(nothing).alias("category"),
        F.when(source != "", parsed["reason"]).otherwise(nothing).alias("reason"),
    ))


def apply_verdicts(df: DataFrame, verdicts: DataFrame, key: str, threshold: float = 0.5, fail_mode: str = "open") -> DataFrame:
    """Join classifier replies (key, raw) and add an ``llm_classifier`` finding.

    A missing reply is a clean row; one that cannot be read is a scan failure.
    """
    from wardspark.operators.decision import with_error_policy

    v = F.col("_verdict")
    joined = df.join(verdicts.select(key, F.col("raw").alias("_raw")), key, "left").withColumn("_verdict", parse_verdict(F.col("_raw")))
    found = finding(
        "llm_classifier", "prompt_injection", v["unsafe"] & (v["score"] >= threshold), score=v["score"],
        severity=F.lit("high"), action=F.lit("block"), summary=F.coalesce(v["reason"], F.lit("classifier verdict")),
        evidence=json_evidence(category=v["category"], reason=v["reason"]),
    )
    error = F.when(F.col("_raw").isNotNull() & v.isNull(), "unparseable classifier output")
    return joined.withColumn("llm_classifier", with_error_policy(found, error, "llm_classifier", fail_mode)).drop("_raw", "_verdict")
