"""Output that arrives in chunks: what a checkpointing guard lets through, in batch or as a stream.

A response is checked whenever enough characters have come since the last check, and at its end. A check
reads the new text behind a carry of what precedes it, as long as the longest pattern of the scans, so
a response costs time in proportion to its length. Windows are cut by one walk that both forms
share; the ordinary scans then run on the windows as columns, and what passed is released, but for text held back.

State for each response: the carry, the text since the last check, and a few numbers. Repeated
chunks count as often as they come; null chunks are empty; a null id is one response.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardspark.functions.ranks import action_rank
from wardspark.operators.scan import ScanInput, settle
from wardspark.plans.firewall import decide
from wardspark.plans.stages import scan_all

# Checking distance, scan sets and score marks.
CHECK_EVERY, ESCALATE_AT, BREAK_AT = 120, 0.45, 0.75
FAST_SCANS = ("secret_leakage", "banned_topics")
FULL_SCANS = ("secret_leakage", "banned_topics", "pii", "prompt_injection")
#: Characters before the new text that a check reads again: the longest token the scans know has 4,105.
CARRY = 4_224


def open_construct(text: Column) -> Column:
    """Where an unterminated link, image or tag begins (0-based), else the text's length."""
    n = F.length(text)
    # Position of the last bracket, from the length of what follows it.
    after = F.length(F.regexp_extract(text, r"(?s)\[([^\[]*)$", 1))
    bracket = F.when(F.contains(text, F.lit("[")), n - after - 1)
    rest = F.substring(text, bracket + 1, n)
    unterminated = rest.rlike(r"(?s)^\[[^\]]*$") | rest.rlike(r"(?s)^\[[^\]]*\]$") | rest.rlike(r"(?s)^\[[^\]]*\]\([^)]*$")
    image = F.substring(text, bracket, F.lit(1)) == "!"
    cut = F.when(unterminated, F.when((bracket > 0) & image, bracket - 1).otherwise(bracket)).otherwise(n)
    tail = F.length(F.regexp_extract(text, r"(?s)<([^<>]*)$", 1))
    angle = F.when(text.rlike(r"(?s)<[^<>]*$"), n - tail - 1)
    return F.least(F.coalesce(cut, n), F.coalesce(angle, n))


@dataclass
class Walk:
    """One response on its way: ``feed`` takes a chunk and gives the window of a check that is due."""

    every: int
    carry: int
    before: str = ""  # the carry
    pending: str = ""  # since the last check
    since: int = 0
    checkpoint: int = 0
    total: int = 0
    chunks: int = 0

    def feed(self, chunk: str | None, final: bool, check_rest: bool) -> tuple[int, bool, int, int, int, str] | None:
        """(checkpoint, final, where its window starts, characters so far, chunks so far, window) if a check is due."""
        chunk = chunk or ""
        self.pending += chunk
        self.since += len(chunk)
        self.total += len(chunk)
        self.chunks += 1
        due = self.since >= self.every
        if not due and not (final and check_rest and self.pending):
            return None
        self.checkpoint += 1
        window = self.before + self.pending
        row = (self.checkpoint, final, self.total - len(window), self.total, self.chunks, window)
        self.before, self.pending, self.since = self.tail(window), "", 0
        return row

    def tail(self, window: str) -> str:
        """The end of a window, from white space on: a cut within a word would make a word of its rest."""
        if len(window) <= self.carry:
            return window
        cut = len(window) - self.carry
        for i in range(cut, len(window)):
            if window[i].isspace():
                return window[i:]
        return window[cut:]

    def state(self) -> tuple:
        return self.before, self.pending, self.since, self.checkpoint, self.total, self.chunks


_STATE = T.StructType([T.StructField(n, T.StringType()) for n in ("before", "pending")] + [T.StructField(n, T.LongType()) for n in ("since", "checkpoint", "total", "chunks")])
_WINDOW = "checkpoint long, final boolean, start long, total long, chunks long, window string"
_NAMES = [c.split()[0] for c in _WINDOW.split(", ")]


def checkpoint_windows(chunks: DataFrame, every: int = CHECK_EVERY, key: str = "stream_id", carry: int = CARRY, check_rest: bool = True) -> DataFrame:
    """The windows that checks read, of whole responses (key, seq, chunk).

    Responses are dealt out by key and walked in order; a task holds one response's state.
    """
    types = dict(chunks.dtypes)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, held = object(), None, None  # the last row waits: only the next one tells whether its response ends
        for pdf in batches:
            out: list[tuple] = []

            def take(row: tuple, final: bool) -> None:
                made = state.feed(row[2], final, check_rest)
                if made:
                    out.append((row[0], row[1], *made))

            for row in pdf.itertuples(index=False, name=None):
                if held is not None:
                    take(held, row[0] != held[0])
                if state is None or row[0] != current:
                    current, state = row[0], Walk(every, carry)
                held = row
            yield pd.DataFrame(out, columns=[key, "seq", *_NAMES])
        if held is not None:
            made = state.feed(held[2], True, check_rest)
            yield pd.DataFrame([(held[0], held[1], *made)] if made else [], columns=[key, "seq", *_NAMES])

    ordered = chunks.select(F.coalesce(key, F.lit("").cast(types[key])).alias(key), "seq", F.coalesce("chunk", F.lit("")).alias("chunk")).repartition(key).sortWithinPartitions(key, "seq", "chunk")
    return ordered.mapInPandas(walk, f"{key} {types[key]}, seq {types['seq']}, {_WINDOW}")


def verdicts(windows: DataFrame, *, trust: str = "system", scans: Sequence[str] = FAST_SCANS, full_scans: Sequence[str] = FULL_SCANS,
             key: str = "stream_id", hold_back: int = 0, hold_constructs: bool = False, options: dict[str, dict] | None = None) -> DataFrame:
    """Each window's ``score``, whether it must ``stop`` the response, and up to where the response may be released (``upto``).

    Doubtful windows are scanned again, by ``full_scans``; the others are empty texts to these. No join and no shuffle.
    """
    kept = [key, "seq", *_NAMES]
    fast = decide(scan_all(windows, ScanInput(F.col("window"), stage="stream", trust=F.lit(trust)), names=scans, options=options), stage="stream")
    top = F.coalesce(F.array_max(F.transform(F.filter("findings", lambda f: f["detected"]), lambda f: f["score"])), F.lit(0.0))
    fast = fast.select(*kept, F.col("blocked").alias("_blocked"), top.alias("score"))
    doubtful = ~F.col("_blocked") & (F.col("score") >= ESCALATE_AT) & (F.col("score") < BREAK_AT)
    fast = settle(fast.withColumn("_again", F.when(doubtful, F.col("window")).otherwise("")), "_again")
    full = decide(scan_all(fast, ScanInput(F.col("_again"), stage="stream", trust=F.lit(trust)), names=full_scans, options=options), stage="stream")
    stop = F.col("_blocked") | ((F.col("_again") != "") & (action_rank(F.col("action")) >= 3))
    upto = F.col("total") - hold_back if hold_back else F.col("total")
    if hold_constructs:
        upto = F.least(upto, F.col("start") + open_construct(F.col("window")))
    upto = F.when(F.col("final"), F.col("total")).otherwise(F.greatest(F.lit(0), upto))
    return full.select(key, "seq", "checkpoint", "final", "total", "chunks", "score", stop.alias("stop"), upto.cast("long").alias("upto"))


def checkpoint_scan(chunks: DataFrame, *, every: int = CHECK_EVERY, trust: str = "system", scans: Sequence[str] = FAST_SCANS,
                    full_scans: Sequence[str] = FULL_SCANS, key: str = "stream_id", hold_window: bool = True, carry: int = CARRY,
                    hold_back: int = 0, hold_constructs: bool = False, options: dict[str, dict] | None = None) -> DataFrame:
    """Per response (key, seq, chunk): checks made, where it broke, and how much was delivered.

    Nothing after the first stopping check counts. ``hold_window``: text is released by checks only, so
    the rest at the end is checked too. ``hold_back`` characters, and with ``hold_constructs`` an unterminated
    link, image or tag, wait for the next check.
    """
    windows = checkpoint_windows(chunks, every, key, carry, hold_window)
    found = verdicts(windows, trust=trust, scans=scans, full_scans=full_scans, key=key, hold_back=hold_back, hold_constructs=hold_constructs, options=options)
    # What precedes the first stop, from combined extremes: a check passed iff it comes before that.
    at = found.groupBy(key).agg(F.min(F.when(F.col("stop"), F.col("checkpoint"))).alias("_k"), F.max("checkpoint").alias("_all"))
    seen = found.join(at, key).filter(F.col("_k").isNull() | (F.col("checkpoint") <= F.col("_k")))
    summary = seen.groupBy(key).agg(
        F.max("checkpoint").alias("checkpoints"), F.bool_or("stop").alias("broken"),
        F.count_if(~F.col("stop") & (F.col("score") >= BREAK_AT)).alias("break_signals"),
        F.coalesce(F.max(F.when(~F.col("stop"), F.col("upto"))), F.lit(0)).alias("delivered_chars"),
    )
    id_type = dict(chunks.dtypes)[key]
    sizes = chunks.groupBy(F.coalesce(key, F.lit("").cast(id_type)).alias(key)).agg(F.sum(F.coalesce(F.length("chunk"), F.lit(0))).alias("total_chars"), F.count("*").alias("chunks"))
    broken = F.coalesce("broken", F.lit(False))
    return sizes.join(summary, key, "left").select(
        key, "chunks", F.coalesce("checkpoints", F.lit(0)).alias("checkpoints"), broken.alias("broken"),
        F.coalesce("break_signals", F.lit(0).cast("bigint")).alias("break_signals"),
        F.when(broken, F.col("delivered_chars")).otherwise(F.col("total_chars")).alias("delivered_chars"), "total_chars",
    )


class _Windows(StatefulProcessor):
    """Walks a response across micro-batches; its state goes with its last chunk, or after ``ttl_ms``."""

    def __init__(self, every: int, carry: int, check_rest: bool, ttl_ms: int | None) -> None:
        self.every, self.carry, self.check_rest, self.ttl_ms = every, carry, check_rest, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("walk", _STATE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        walk = Walk(self.every, self.carry, *self.held.get()) if self.held.exists() else Walk(self.every, self.carry)
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out, ended = [], False
        for seq, chunk, final in zip(pdf["seq"], pdf["chunk"], pdf["final"], strict=True):
            made = walk.feed(chunk, bool(final), self.check_rest)
            ended = ended or bool(final)
            if made:
                out.append((key[0], seq, *made))
        self.held.clear() if ended else self.held.update(walk.state())
        yield pd.DataFrame(out, columns=["stream_id", "seq", *_NAMES])

    def close(self) -> None:
        pass


class _Release(StatefulProcessor):
    """What each check lets through; after the first stop nothing more."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getValueState("sent", T.StructType([T.StructField("upto", T.LongType()), T.StructField("broken", T.BooleanType())]), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        upto, broken = self.sent.get() if self.sent.exists() else (0, False)
        pdf = pd.concat(list(rows)).sort_values("checkpoint", kind="stable")
        out, ended = [], False
        for checkpoint, final, to, stop in zip(pdf["checkpoint"], pdf["final"], pdf["upto"], pdf["stop"], strict=True):
            ended = ended or bool(final)
            if broken:
                continue
            broken = bool(stop)
            begin, upto = upto, upto if broken else max(upto, int(to))
            out.append((key[0], checkpoint, begin, upto, broken, bool(final) or broken))
        self.sent.clear() if ended else self.sent.update((upto, broken))
        yield pd.DataFrame(out, columns=["stream_id", "checkpoint", "released_from", "released_to", "broken", "ended"])

    def close(self) -> None:
        pass


def stream_checkpoint_scan(chunks: DataFrame, *, every: int = CHECK_EVERY, carry: int = CARRY, hold_window: bool = True, ttl_ms: int | None = None, **scan: Any) -> DataFrame:
    """The live form over chunks (stream_id, seq, chunk, final): a row for each check, with the characters it releases.

    Chunks of a response must come in order of ``seq`` across micro-batches, the last one with ``final``. The first
    stop gives a row with ``broken`` and releases nothing; later chunks of that response give none. State goes with
    the last chunk; ``ttl_ms`` also drops that of responses which never end, for queries that run on (its
    clock makes a trigger that is to end wait for ever).
    """
    mode = "None" if ttl_ms is None else "ProcessingTime"
    held = chunks.select("stream_id", "seq", "chunk", "final")
    kinds = dict(held.dtypes)
    windows = held.groupBy("stream_id").transformWithStateInPandas(
        _Windows(every, carry, hold_window, ttl_ms), f"stream_id {kinds['stream_id']}, seq {kinds['seq']}, {_WINDOW}", "Append", mode)
    found = verdicts(windows, **scan).select("stream_id", "checkpoint", "final", "upto", "stop")
    return found.groupBy("stream_id").transformWithStateInPandas(
        _Release(ttl_ms), f"stream_id {kinds['stream_id']}, checkpoint long, released_from long, released_to long, broken boolean, ended boolean", "Append", mode)
