"""Collocations: phrases whose words stand together more often than their parts would make them.

Texts are split into pieces and words; everything is counted for each language, which is part of a
word's hash. First words are counted. Then the pointers to all places are sorted by the ``DEPTH``
words from there on by multikey three-way quicksort: an equal partition is a phrase, its size the count. Each task
combines what it has read, and routes it by its leading two words to a bucket (by three where the two
are very frequent, so that no bucket is hot). A bucket sorts what all tasks have sent it, and abandons
partitions that stay below the least count. Only words that may reach that count are routed: a bitmap of fixed size
tells which; one that is full lets all pass and changes no result.

A task sends at most ``FAN`` buckets for each ``CHUNK`` of words; more buckets are reached in several steps, each of
which combines again.

Null texts are empty and null languages are ``und``; repeated rows count as often as they stand; an
empty table gives no phrases; other columns are not read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.llm import shared
from wardspark.llm.tokens import slices
from wardspark.llm.words import hashed, mix, starts_of, text_bytes

DEPTH = 3
LEAST = 10
#: A phrase goes if a longer candidate makes up so many hundredths of its occurrences.
COVER = 50
LIMIT = 2000
SCALE = 1_000_000
#: Words sorted together in a task, words of a bucket, buckets of a step, bytes of text hashed at a time.
CHUNK = 1_000_000
BUCKET = 500_000
FAN = 1024
SLICE = 500_000
#: Words kept as text until they are sent, hashes kept of those sent; beyond that a word is sent again.
NAMES = 100_000
TOLD = 2_000_000
#: Partitions of at most so many pointers are finished by sorting.
SMALL = 16_384
BITMAP = 25
#: Frequent pairs that are routed by three words: every ``STRIDE``-th place is looked at, at most ``HOT`` pairs are sent to tasks.
STRIDE = 4
HOT = 100_000

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9]] = True
_ONE = np.uint64(1)


def lang_key(lang: str) -> int:
    data, offsets = text_bytes(pa.array([lang]))
    begins, at = starts_of(np.ones(len(data), bool), offsets)
    return int(hashed(data, np.ones(len(data), bool), begins, at, False)[0]) if len(at) else 0


class Words:
    """The words of a slice of texts: hashes that hold the language, and whether the next word stands in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        self.data, offsets = text_bytes(batch.column("text"))
        ends = _ENDS[self.data]
        solid = ~(ends | _BLANK[self.data])
        begins, self.at = starts_of(solid, offsets)
        self.solid = solid
        self.langs = batch.column("lang").to_pylist()
        keys = {lang: lang_key(lang) for lang in set(self.langs)}
        self.text = np.searchsorted(offsets, self.at, side="right") - 1
        self.lang = np.array([keys[lang] for lang in self.langs], np.uint64)[self.text]
        self.hash = np.maximum(mix(hashed(self.data, solid, begins, self.at, True) ^ mix(self.lang)), _ONE)
        piece = np.cumsum(ends)[self.at] if len(self.at) else self.at
        self.joined = np.zeros(len(self.at), bool)
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])

    def spelled(self, which: np.ndarray) -> list[bytes]:
        """The words at some places."""
        gaps = np.append(np.flatnonzero(~self.solid), len(self.data))
        start = self.at[which]
        next_text = np.append(self.at, len(self.data))[which + 1]
        stop = np.minimum(gaps[np.searchsorted(gaps, start)], next_text)  # texts may follow each other without a gap
        raw = self.data.tobytes().lower()  # A-Z only, as bytes
        return [raw[a:z] for a, z in zip(start.tolist(), stop.tolist(), strict=True)]


COUNTS = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])
COUNTS_DDL = "kind int, lang string, key long, n long"


def _pair(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mix(h1 * np.uint64(0x9FB21C651E98DF25) + h2)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: (word, count) of each chunk. Kind 1: (pair, count) of frequent ones among the places looked at. Kind 2: words of a language."""

    def rows(kind: int, keys: np.ndarray, n: np.ndarray, langs: list[str] | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(keys), kind, np.int32)), pa.array(langs or [None] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], schema=COUNTS)

    def counted(held: list[np.ndarray], pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield rows(0, *np.unique(np.concatenate(held), return_counts=True))
        values, counts = np.unique(np.concatenate(pairs), return_counts=True)
        often = counts >= 8
        yield rows(1, values[often], counts[often])

    held, pairs, size = [], [], 0
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            w = Words(batch)
            of_text = np.bincount(w.text, minlength=batch.num_rows)
            by_lang: dict[str, int] = {}
            for lang, n in zip(w.langs, of_text.tolist(), strict=True):
                by_lang[lang] = by_lang.get(lang, 0) + n
            yield rows(2, np.array([lang_key(x) for x in by_lang], np.uint64), np.array(list(by_lang.values())), list(by_lang))
            held.append(w.hash)
            places = np.flatnonzero(w.joined)[::STRIDE]
            pairs.append(_pair(w.hash[places], w.hash[places + 1]))
            size += len(w.hash)
            if size >= CHUNK:
                yield from counted(held, pairs)
                held, pairs, size = [], [], 0
    if size:
        yield from counted(held, pairs)


def partitions(keys: list[np.ndarray], weights: np.ndarray | None, least: int, also: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal partitions of pointers by multikey three-way quicksort: of each, a pointer and its weight, in the order of the keys.

    First for the full depth, then, in no order, for the first ``also`` keys. Partitions below ``least`` are abandoned.
    """
    depth_most = len(keys)
    found: dict[int, tuple[list, list]] = {depth_most: ([], [])}
    if also:
        found[also] = ([], [])
    rng = np.random.default_rng(1)
    weigh = (lambda at: len(at)) if weights is None else (lambda at: int(weights[at].sum()))

    def finish(at: np.ndarray, depth: int) -> None:
        order = at[np.lexsort([keys[d][at] for d in reversed(range(depth, depth_most))])]
        new = np.zeros(len(order), bool)
        new[0] = True
        totals = np.ones(len(order), np.int64) if weights is None else weights[order]
        for d in range(depth, depth_most):
            k = keys[d][order]
            new[1:] |= k[1:] != k[:-1]
            if d + 1 in found:
                first = np.flatnonzero(new)
                sums = np.add.reduceat(totals, first)
                kept = sums >= least
                found[d + 1][0].append(order[first[kept]])
                found[d + 1][1].append(sums[kept])

    stack = [(np.arange(len(keys[0])), 0)]
    while stack:
        at, depth = stack.pop()
        if not len(at) or weigh(at) < least:
            continue
        if depth == depth_most:
            found[depth][0].append(at[:1])
            found[depth][1].append(np.array([weigh(at)]))
        elif len(at) <= SMALL:
            finish(at, depth)
        else:
            k = keys[depth][at]
            pivot = np.partition(k[rng.integers(0, len(k), 31)], 15)[15]
            less, equal = k < pivot, k == pivot
            same = at[equal]
            stack += [(at[~(less | equal)], depth), (same, depth + 1), (at[less], depth)]  # the last comes first
            if depth + 1 == also and (total := weigh(same)) >= least:
                found[also][0].append(same[:1])
                found[also][1].append(np.array([total]))
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return (*map(join, found[depth_most]), *(map(join, found[also]) if also else (join([]), join([]))))


def _packed(h: list[np.ndarray], n: np.ndarray) -> bytes:
    """Phrases in order, with counts: each pair of leading words once, with how many phrases follow."""
    new = np.ones(len(n), bool)
    new[1:] = (h[0][1:] != h[0][:-1]) | (h[1][1:] != h[1][:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(n)))
    return struct.pack("<QQ", len(first), len(n)) + b"".join(x.astype("<u8").tobytes() for x in (h[0][first], h[1][first], runs, h[2], n))


def _unpacked(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    pairs, total = struct.unpack_from("<QQ", data)
    a, b, runs, c, n = np.split(np.frombuffer(data, "<u8", offset=16), np.cumsum([pairs, pairs, pairs, total]))
    runs = runs.astype(np.int64)
    return [np.repeat(a, runs), np.repeat(b, runs), c], n.astype(np.int64)


SENT = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
SENT_DDL = "bucket long, kind int, data binary"
_PHRASES, _HOT, _WORDS = 0, 1, 2


def _rows(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    """One row at a time: a whole batch as Python objects would stand in memory twice."""
    return zip(*((x.as_py() for x in batch.column(c)) for c in names), strict=True)


def _route(h: list[np.ndarray], hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each phrase belongs, as a number of 64 bits, and whether it goes by all its words."""
    pair = _pair(h[0], h[1])
    frequent = np.zeros(len(pair), bool)
    if len(hot):
        frequent = hot[np.minimum(np.searchsorted(hot, pair), len(hot) - 1)] == pair
    return np.where(frequent, _pair(pair, h[2]), mix(pair)), frequent


def bucket_of(route: np.ndarray, buckets: int) -> np.ndarray:
    return ((route >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _dealt(h: list[np.ndarray], n: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Phrases in order, packed by bucket."""
    route, frequent = _route(h, hot)
    bucket = bucket_of(route, buckets) * 2 + frequent
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else []
    parts = np.split(order, edges[1:]) if len(order) else []
    rows = [(int(bucket[p[0]]) // 2, int(bucket[p[0]]) % 2, _packed([x[p] for x in h], n[p])) for p in parts]
    for a in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 256], strict=True), SENT, strict=True)], schema=SENT)


def _named(keys: np.ndarray, langs: np.ndarray, spelled: list[bytes], buckets: int) -> Iterator[pa.RecordBatch]:
    """(word's hash, language, word), packed by bucket."""
    bucket = bucket_of(mix(keys), buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else []
    parts = np.split(order, edges[1:]) if len(order) else []
    rows = [(int(bucket[p[0]]), _WORDS, struct.pack("<Q", len(p)) + keys[p].astype("<u8").tobytes() + langs[p].astype("<u8").tobytes() + b"\n".join(spelled[i] for i in p.tolist())) for p in parts]
    for a in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 256], strict=True), SENT, strict=True)], schema=SENT)


def _unnamed(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    (n,) = struct.unpack_from("<Q", data)
    keys, langs = np.frombuffer(data, "<u8", 2 * n, 8).reshape(2, n).tolist()
    return zip(keys, langs, data[8 + 16 * n :].split(b"\n"), strict=True)


def _read(sent, buckets: int):
    """Phrases and words of the texts of a task, by bucket."""

    def chunk(hashes: list[np.ndarray], joined: list[np.ndarray], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, follows = np.concatenate(hashes), np.concatenate(joined)
        keys = [h]
        reach = np.ones(len(h), bool)
        for d in range(1, DEPTH):
            reach = reach & np.append(follows[d - 1 :], np.zeros(d - 1, bool))
            keys.append(np.where(reach, np.append(h[d:], np.zeros(d, np.uint64)), np.uint64(0)))
        places = np.flatnonzero(keys[1])
        keys = [k[places] for k in keys]
        at, n, _, _ = partitions(keys, None, 1)
        yield from _dealt([k[at] for k in keys], n, hot, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = sent.value
        hashes, joined, size = [], [], 0
        # Words are sent once a chunk at the latest; of those sent only the hashes stay, in order.
        told = np.zeros(0, np.uint64)
        names: dict[int, tuple[int, bytes]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal told, hashes, joined, size, names
            if names:
                langs, spelled = zip(*names.values(), strict=True)
                keys = np.array(list(names), np.uint64)
                yield from _named(keys, np.array(langs, np.uint64), list(spelled), buckets)
                told = np.sort(np.concatenate([told if len(told) < TOLD else told[:0], keys]))
                names = {}
            if size:
                held, hashes, joined, size = (hashes, joined), [], [], 0
                yield from chunk(*held, hot)

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                w = Words(batch)
                slot = w.hash >> np.uint64(64 - BITMAP)
                may = (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & _ONE == _ONE
                w.joined[:-1] &= may[1:] & may[:-1]
                hashes.append(w.hash)
                joined.append(w.joined)
                size += len(w.hash)
                known, first = np.unique(w.hash, return_index=True)
                fresh = may[first]
                if len(told):
                    fresh &= told[np.minimum(np.searchsorted(told, known), len(told) - 1)] != known
                new = [i for h, i in zip(known[fresh].tolist(), first[fresh].tolist(), strict=True) if h not in names]
                for i, word in zip(new, w.spelled(np.array(new, np.int64)), strict=True):
                    names[int(w.hash[i])] = int(w.lang[i]), word
                if size >= CHUNK or len(names) >= NAMES:
                    yield from flushed()
        yield from flushed()

    return run


def _combined(held: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    got = [_unpacked(d) for d in held]
    return [np.concatenate([h[d] for h, _ in got]) for d in range(3)], np.concatenate([n for _, n in got])


def _finer(sent, buckets: int):
    """What has met in coarse buckets is combined, and dealt to finer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hot = sent.value
        held, size = [], 0

        def merged() -> Iterator[pa.RecordBatch]:
            h, n = _combined(held)
            at, total, _, _ = partitions(h, n, 1)
            return _dealt([x[at] for x in h], total, hot, buckets)

        for batch in batches:
            for kind, data in _rows(batch, ["kind", "data"]):
                if kind == _WORDS:
                    keys, langs, spelled = zip(*_unnamed(data), strict=True)
                    yield from _named(np.array(keys, np.uint64), np.array(langs, np.uint64), list(spelled), buckets)
                    continue
                held.append(data)
                size += len(data) // 16
                if size >= CHUNK:
                    yield from merged()
                    held, size = [], 0
        if held:
            yield from merged()

    return run


MINED = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("h3", pa.int64()), ("n", pa.int64()), ("lang", pa.int64()), ("word", pa.string())])
MINED_DDL = "h1 long, h2 long, h3 long, n long, lang long, word string"


def _mined(least: int):
    """Buckets one after the other: pairs (h3 null) and triples with their counts, and the words (h2 null)."""

    def rows(h: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(n), pa.int64())
        ids = [pa.array(x.view(np.int64)) for x in h] + [none] * (3 - len(h))
        return pa.RecordBatch.from_arrays([*ids, pa.array(n), none, pa.nulls(len(n), pa.string())], schema=MINED)

    def bucket(held: dict[int, list[bytes]], names: dict[int, tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for kind, data in held.items():
            h, n = _combined(data)
            at, total, at2, total2 = partitions(h, n, least if kind == _PHRASES else 1, 2)
            full = (h[2][at] != 0) & (total >= least)
            yield rows([x[at[full]] for x in h], total[full])
            yield rows([x[at2] for x in h[:2]], total2)
        if names:
            none = pa.nulls(len(names), pa.int64())
            langs, spelled = zip(*names.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(names), np.uint64).view(np.int64)), none, none, none, pa.array(np.array(langs, np.uint64).view(np.int64)), pa.array(spelled, pa.binary()).cast(pa.string())], schema=MINED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        names: dict[int, tuple[int, bytes]] = {}
        last = None
        for batch in batches:
            for number, kind, data in _rows(batch, SENT.names):
                if number != last:
                    yield from bucket(held, names)
                    held, names, last = {}, {}, number
                if kind == _WORDS:
                    names |= {k: (lang, word) for k, lang, word in _unnamed(data)}
                else:
                    held.setdefault(kind, []).append(data)
        yield from bucket(held, names)

    return run


def counted_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words (h, lang, word, n), pairs (h1, h2, n), triples (h1, h2, h3, n) with at least ``least`` occurrences, and words by language (lang, n)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counts = docs.mapInArrow(_counts, COUNTS_DDL).groupBy("kind", "lang", "key").agg(F.sum("n").alias("n"))
    with shared.small_batches(spark):
        counts = shared.saved(counts.where(f"kind != 0 or n >= {least}"), "counts")
    langs = counts.where("kind = 2").select("lang", F.col("key").alias("lang_key"), "n")
    total = langs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.where("kind = 1").orderBy(F.desc("n"), "key").limit(HOT).select("key").toArrow()
    slot = F.expr(f"shiftrightunsigned(key, {64 - BITMAP})")
    bits = counts.where("kind = 0").groupBy(F.shiftright(slot, 6).alias("place")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - BITMAP}) & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP - 6), np.uint64)
    bitmap[bits["place"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast((bitmap, np.sort(often["key"].to_numpy().view(np.uint64))))

    steps = [max(1, -(-total // BUCKET))]
    while steps[0] > FAN:
        steps.insert(0, -(-steps[0] // FAN))
    dealt = docs.mapInArrow(_read(sent, steps[0]), SENT_DDL)
    for buckets in steps[1:]:
        dealt = dealt.repartition("bucket").mapInArrow(_finer(sent, buckets), SENT_DDL)
    with shared.small_batches(spark):
        mined = shared.saved(dealt.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_mined(least), MINED_DDL), "mined")

    names = mined.where("h2 is null").select(F.col("h1").alias("h"), F.col("lang").alias("lang_key"), "word")
    known = names.join(counts.where("kind = 0").select(F.col("key").alias("h"), "n"), "h").join(F.broadcast(langs.select("lang_key", "lang")), "lang_key").select("h", "lang", "word", "n")
    pairs = mined.where("h2 is not null and h3 is null").groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    triples = mined.where("h3 is not null").select("h1", "h2", "h3", "n")
    return known, pairs, triples, langs.select("lang", "n")


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE a a / (left right)), exactly: of counts below 10^15 all products fit 38 digits."""
    whole = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"cast(({whole(a)} * {whole(a)} * {SCALE}BD) div ({whole(left)} * {whole(right)}) as bigint)")


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, limit: int = LIMIT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of two and three words."""
    known, pairs, triples, langs = counted_phrases(docs, least)
    word = lambda i: known.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"), F.col("n").alias(f"f{i}"), *([F.col("lang")] if i == 1 else []))
    covered = triples.select("h1", "h2", "n").union(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "n")).groupBy("h1", "h2").agg(F.max("n").alias("longer"))
    two = pairs.join(covered, ["h1", "h2"], "left").where(f"longer is null or 100 * longer < {cover} * n").join(word(1), "h1").join(word(2), "h2")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), _score("n", "f1", "f2").alias("score"))
    side = lambda a, b, n: pairs.select(F.col("h1").alias(a), F.col("h2").alias(b), F.col("n").alias(n))
    three = triples.join(side("h1", "h2", "n12"), ["h1", "h2"]).join(side("h2", "h3", "n23"), ["h2", "h3"]).join(word(1), "h1").join(word(2), "h2").join(word(3), "h3")
    three = three.withColumn("s1", _score("n", "f1", "n23")).withColumn("s2", _score("n", "n12", "f3"))
    cut = lambda x, y: F.expr(f"if(s2 < s1, {y}, {x})")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), cut("f1", "n12").alias("l"), cut("n23", "f3").alias("r"), cut("s1", "s2").alias("score"))
    # A language may hold nearly all phrases: ranks come from counts by range, not from one task a language.
    order = two.union(three).withColumn("by_score", -F.col("score")).withColumn("by_a", -F.col("a"))
    ranked = shared.running_totals(order, ["lang"], ["by_score", "by_a", "phrase"], {"above": F.lit(1)}).where(F.col("above") < limit)
    return ranked.join(F.broadcast(langs), "lang").select("lang", (F.col("above") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
