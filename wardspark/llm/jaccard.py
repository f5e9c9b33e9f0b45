"""Exact n-gram Jaccard join: subsets of small sets, inverted lists of large ones.

A document's set holds its distinct shingles of ``WIDTH`` words. Two sets of sizes n and m link
when 100 * overlap >= 75 * union, that is when they share need(n, m) = ceil(3 (n + m) / 7).

* Sets of at most ``boundary`` shingles (chosen by cost from the sizes at hand) enumerate their
  subsets of each size that a partner may need. A shared subset of that size is a link.
* Larger sets enter their rarest shingles, as many as any partner must share one of, into
  inverted lists. The order of rarity comes from counts of all documents, made slice by slice;
  it decides only how long the lists get, never which links are found.

Lists are worked in two rounds, so that no group emits all its pairs. First each list ties its
members to one, and links that hold are joined into components. Then only members of different
components are paired, and only those whose lists leave room for a link.
Both rounds read the texts of the candidates and count their overlap exactly; sets that agree
as a whole are one class from the start.

Null and empty texts have no shingles and link with nothing; equal texts are one class; equal
doc_ids keep all their rows; texts without a doc_id link like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm import shared
from wardspark.llm.components import components
from wardspark.llm.tokens import slices
from wardspark.llm.words import mix, shingle_sets

WIDTH = 5
#: Counts of frequent shingles kept as the order of rarity (a bound on what each task is sent).
ORDER_SIZE = 400_000
#: Bytes of text hashed at a time; a task holds several arrays of eight bytes for each of them.
SLICE = 2_000_000
#: Shingles a task counts at a time.
COUNTED = 2_000_000
#: What checking one candidate costs, in listed rows.
CHECK_COST = 40
#: Documents compared with one hub in a task at a time.
CHUNK = 64
_SMALL_MOST = 24


def need(n: int, m: int) -> int:
    """The least overlap of linked sets of these sizes."""
    return -(-3 * (n + m) // 7)


def listed(n):
    """How many of its rarest shingles a set of this size lists: any partner shares one of them."""
    return n - -(-3 * n // 4) + 1


def least_shared(n: str, m: str) -> str:
    """SQL for how many listed shingles linked sets of these sizes share at least.

    What they share beyond their lists is at most what one of them does not list.
    """
    return f"greatest(1, ceil(3 * ({n} + {m}) / 7) - ceil(3 * greatest({n}, {m}) / 4) + 1)"


@lru_cache(maxsize=256)
def subset_sizes(n: int, boundary: int) -> tuple[int, ...]:
    """Sizes of the subsets that a set of n shingles enumerates: what pairs with a small set need."""
    low = -(-3 * n // 4)
    return tuple(sorted({need(n, m) for m in range(low, 4 * n // 3 + 1) if min(n, m) <= boundary and need(n, m) <= min(n, m)}))


def subset_cost(n: int, boundary: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, boundary))


def choose_boundary(sizes: dict[int, int], partners: float = 0.5) -> int:
    """The size up to which enumerating subsets costs less than listing and checking; ``sizes``: sets by their size."""
    def cost(b: int) -> float:
        subsets = sum(count * subset_cost(n, b) for n, count in sizes.items() if n <= 4 * b // 3)
        lists = sum(count * (listed(n) + partners * CHECK_COST) for n, count in sizes.items() if b < n <= _SMALL_MOST)
        return subsets + lists

    return min(range(_SMALL_MOST * 3 // 4), key=cost)


def tag_of(hashes: np.ndarray) -> int:
    """The class of a set, from its shingles in any order."""
    total = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(hashes) else np.uint64(0)
    return int(mix(np.array([total], np.uint64) + np.uint64(len(hashes))).view(np.int64)[0])


SHAPES = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("tag", pa.int64())])


def _rows(kind: int, key: pa.Array, n, tag: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(tag), kind, np.int32)), key, pa.array(n, pa.int64()), pa.array(tag)], schema=SHAPES)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: (doc_id, set size, tag) of each document. Kind 1: (shingle, count) of those that recur among ``COUNTED`` shingles or so."""
    held: dict[int, np.ndarray] = {}  # distinct sets that are not counted yet
    size = 0

    def often() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(list(held.values())), return_counts=True)
        kept = counts >= 3
        return _rows(1, pa.array(values[kept].view(np.int64)), counts[kept], np.zeros(kept.sum(), np.int64))

    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            sets = shingle_sets(batch.column("text"), WIDTH)
            tags = [tag_of(s) for s in sets]
            yield _rows(0, batch.column("doc_id"), [len(s) for s in sets], np.array(tags, np.int64))
            for tag, s in zip(tags, sets, strict=True):
                if len(s) and tag not in held:
                    held[tag] = s
                    size += len(s)
            if size >= COUNTED:
                yield often()
                held, size = {}, 0
    if held:
        yield often()


ENTRIES = pa.schema([("key", pa.int64()), ("tag", pa.int64()), ("n", pa.int32()), ("c", pa.int32()), ("pos", pa.int32()), ("rare", pa.int32())])
ENTRIES_DDL = "key long, tag long, n int, c int, pos int, rare int"


def _entries(order, boundary: int):
    """List entries of each distinct set of a slice; c is the subset's size, 0 for a listed shingle; pos is its place in the list of the set; rare counts the set's shingles that are not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, level = order.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                keys, tags, sizes, cs, places, rares = [], [], [], [], [], []
                sets = {tag_of(s): s for s in shingle_sets(batch.column("text"), WIDTH) if len(s)}
                for tag, s in sets.items():
                    n, got, rare = len(s), [], len(s)
                    for c in subset_sizes(n, boundary) if n <= 4 * boundary // 3 else ():
                        spread = mix(s ^ np.uint64(c))
                        total = spread.sum(dtype=np.uint64)
                        out = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
                        got.append((mix(total - spread[out].sum(axis=1, dtype=np.uint64) + np.uint64(c)), c))
                    if n > boundary:
                        k = listed(n)
                        if len(frequent):
                            at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                            rank = np.where(frequent[at] == s, level[at], 0)
                            rare = n - int(np.count_nonzero(rank))
                            s = s[np.argsort(rank, kind="stable")[:k]] if rank.any() else s[:k]
                        got.append((s[:k], 0))
                    for found, c in got:
                        keys.append(found)
                        tags.append(np.full(len(found), tag, np.int64))
                        sizes.append(np.full(len(found), n, np.int32))
                        cs.append(np.full(len(found), c, np.int32))
                        places.append(np.arange(len(found), dtype=np.int32))
                        rares.append(np.full(len(found), rare, np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (tags, sizes, cs, places, rares))], schema=ENTRIES)

    return run


LISTS = pa.schema([
    ("key", pa.int64()), ("tag", pa.int64()), ("n", pa.int32()), ("c", pa.int32()), ("pos", pa.int32()), ("hub", pa.int64()), ("hub_n", pa.int32()),
])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by (key, c, rare, tag) come in; those of lists with several sets go out, with the list's first set as hub.

    The hub has the fewest rare shingles: of near copies it is the one closest to all others, in
    whichever lists it stands. Only the last entry is held between batches, so a list may be of any length.
    """
    held = None  # the last entry, whether it is in company, and its list's hub
    for batch in batches:
        key, tag, n, c, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if not len(key):
            continue
        if held:
            key, tag, n, c, pos = (np.concatenate([np.array([h], x.dtype), x]) for h, x in zip(held[0], (key, tag, n, c, pos), strict=True))
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (c[1:] == c[:-1]) & (tag[1:] == tag[:-1])])
        if again.any():  # the same set from several slices
            key, tag, n, c, pos = (x[~again] for x in (key, tag, n, c, pos))
        same = (key[1:] == key[:-1]) & (c[1:] == c[:-1])
        company = np.zeros(len(key), bool)
        company[0] = bool(held and held[1])
        company[1:] |= same
        company[:-1] |= same
        start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(key)), 0))
        hub, hub_n = tag[start], n[start]
        if held:
            hub[start == 0], hub_n[start == 0] = held[2]
        out = company[:-1]
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][out]) for x in (key, tag, n, c, pos, hub, hub_n)], schema=LISTS)
        held = ((key[-1], tag[-1], n[-1], c[-1], pos[-1]), bool(company[-1]), (hub[-1], hub_n[-1]))
    if held and held[1]:
        yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*held[0], *held[2]), LISTS, strict=True)], schema=LISTS)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, chunk, hub first) come in: the hub's text, then texts to compare with it. Links go out."""
    at, base, base_n = None, None, 0
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            sets = shingle_sets(batch.column("text"), WIDTH)
            found: list[tuple[int, int]] = []
            for a, chunk, hub, tag, s in zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "hub", "tag")), sets, strict=True):
                if tag_of(s) != tag:  # another text under the same doc_id
                    continue
                if hub:
                    at, base, base_n = (a, chunk), s, len(s)
                elif at == (a, chunk):
                    place = np.minimum(np.searchsorted(base, s), base_n - 1)
                    if int((base[place] == s).sum()) >= need(base_n, len(s)):
                        found.append((a, tag))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=LINKS)


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class of each text, beside the text."""
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            tags = [tag_of(s) for s in shingle_sets(batch.column("text"), WIDTH)]
            yield pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), batch.column("text")], names=["tag", "text"])


def _checked(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link. A hub with many partners is dealt out in chunks."""
    many = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {CHUNK}) as int)").alias("chunks"))
    dealt = shared.saved(pairs.join(many, "a").select("a", "b", F.expr("pmod(xxhash64(b), chunks)").alias("chunk")), "pairs")
    roles = dealt.select(F.col("b").alias("tag"), "a", "chunk", F.lit(False).alias("hub")).union(
        dealt.select(F.col("a").alias("tag"), "a", "chunk", F.lit(True).alias("hub")).distinct())
    placed = roles.join(classes.select("tag", F.col("first").alias("doc_id")), "tag")
    texts = docs.select("doc_id", "text").join(placed, "doc_id").select("a", "chunk", "hub", "tag", "text")
    # Texts whose every row lacks a doc_id are found by their class; the filter reaches the scan, so without such rows nothing is read.
    nameless = docs.where("doc_id is null").select("text").mapInArrow(_tagged, "tag long, text string")
    nameless = nameless.join(placed.where("doc_id is null").select("tag").distinct(), "tag", "left_semi").groupBy("tag").agg(F.min("text").alias("text"))
    texts = texts.union(placed.where("doc_id is null").drop("doc_id").join(nameless, "tag").select("a", "chunk", "hub", "tag", "text"))
    texts = texts.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.desc("hub"))
    links = shared.saved(texts.select("a", "chunk", "hub", "tag", "text").mapInArrow(_check, "a long, b long"), "links")
    shared.discard(dealt)
    return links


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every document.

    Rows without a doc_id link like any other; their component_id is null where no doc_id is reached.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    seen = shared.saved(docs.mapInArrow(_shapes, "kind int, key long, n long, tag long"), "shapes")
    shapes = seen.where("kind = 0").select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), "tag")
    classes = shared.saved(shapes.where("n_shingles > 0").groupBy("tag").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n")), "classes")
    often = seen.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(ORDER_SIZE).toArrow()
    keys = often["key"].to_numpy().view(np.uint64)
    level = np.ceil(np.log2(often["n"].to_numpy() + 1)).astype(np.uint8)
    by_key = np.argsort(keys)
    order = spark.sparkContext.broadcast((keys[by_key], level[by_key]))
    sizes = {r["n"]: r["count"] for r in classes.where(F.col("n") <= _SMALL_MOST).groupBy("n").count().collect()}

    entries = docs.select("text").mapInArrow(_entries(order, choose_boundary(sizes)), ENTRIES_DDL)
    sorted_entries = entries.repartition("key").sortWithinPartitions("key", "c", "rare", "tag")
    lists = shared.saved(sorted_entries.mapInArrow(_lists, "key long, tag long, n int, c int, pos int, hub long, hub_n int"), "lists")

    tied = lists.where("hub != tag").groupBy(F.col("hub").alias("a"), F.col("tag").alias("b"), F.col("hub_n").alias("n"), F.col("n").alias("m")).agg(
        F.max("c").alias("c"), F.expr("count_if(c = 0)").alias("shared"))
    tied = shared.saved(_weighed(tied, least_shared("n", "m")), "tied")
    links = _links(tied, docs, classes)
    label = components(links)

    here = lists.join(label.withColumnRenamed("node", "tag"), "tag", "left").select("key", "c", "tag", "n", "pos", F.coalesce("label", "tag").alias("label"))
    here = shared.saved(here, "labelled")
    split = here.groupBy("key", "c").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "c")
    open_lists = here.join(split, ["key", "c"], "left_semi")
    # A pair shares at least least_shared(n, m) listed shingles, all of them in open lists.
    standing = here.where("c = 0").join(split, ["key", "c"], "left_semi").groupBy("tag").agg(F.count("*").cast("int").alias("open"))
    open_lists = shared.saved(open_lists.join(standing, "tag", "left").select("key", "c", "tag", "n", "pos", "label", F.coalesce("open", F.lit(0)).alias("open")), "open")
    x, y = open_lists.alias("x"), open_lists.alias("y")
    # It also shares one among the first n - need + 1 and m - need + 1 of their lists.
    need_of = "ceil(3 * (x.n + y.n) / 7)"
    can = f"if(x.c = 0, {least_shared('x.n', 'y.n')} <= least(x.open, y.open) and greatest(x.pos - x.n, y.pos - y.n) + {need_of} <= 0, x.c >= {need_of})"
    fits = "x.label != y.label and x.tag < y.tag and 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n)"
    crossed = x.join(y, F.expr(f"x.key = y.key and x.c = y.c and {fits} and {can}")).groupBy(
        F.col("x.tag").alias("a"), F.col("y.tag").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).agg(
        F.max("x.c").alias("c"), F.expr("count_if(x.c = 0)").alias("shared"))
    crossed = shared.saved(_weighed(crossed, "1"), "crossed")
    more = _links(crossed, docs, classes)
    label = components(links.union(more))

    tops = classes.join(label.withColumnRenamed("node", "tag"), "tag", "left").select("tag", "first", F.coalesce("label", "tag").alias("label"))
    least = tops.groupBy("label").agg(F.min("first").alias("component_id"))
    member = tops.join(least, "label").select("tag", "component_id")
    return shapes.join(member, "tag", "left").select("doc_id", F.col("n_shingles"), F.expr("if(n_shingles = 0, doc_id, component_id)").alias("component_id"))


def _weighed(pairs: DataFrame, least: str) -> DataFrame:
    """Pairs that link by a shared subset, or may link as they share at least ``least`` listed shingles."""
    sure = F.expr("c > 0 and c >= ceil(3 * (n + m) / 7)")
    may = F.expr(f"shared >= {least} and 4 * least(n, m) >= 3 * greatest(n, m)")
    return pairs.withColumn("sure", sure).where(F.col("sure") | may).select("a", "b", "sure")


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    return pairs.where("sure").select("a", "b").union(_checked(pairs.where("not sure").select("a", "b"), docs, classes))
