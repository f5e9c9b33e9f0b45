"""The training-data operators against plain versions, round trips and odd inputs."""

from __future__ import annotations

import gzip
import hashlib
import html
import io
import math
import re
import tracemalloc
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from wardspark.llm import attention, chat, components, extract, jaccard, mixing, packing, prefix_hash, queries, rans, shared, tokens, topk, vertical, warc, words

WORD_BPE, BYTE_BPE = (tokens.vocabulary(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    None, "", " ", "one", "two  words", " lead", "trail ", "a\n\nb", "a\n b\tc", "don't I'll x' it's,  y.", "ÀÉ İ ΣΑΣ é ́x", "x<|endoftext|>y", "1234 5.6!!",
    "日本語 テスト🙂👩‍👩‍👧", "\x1cb\x85c d", "\0 \0a", "a,\nb, a,", "the same five words here again", "The SAME five words here again", "word " * 3000,
]
DOCS_DDL = "doc_id long, text string, lang string, source string, n_chars long, ids string, tag string, part string, _row string, row string, key string, n int"


def docs_of(spark, texts, sources=("a", "b", None)):
    rows = [(i, t, None, sources[i % len(sources)], None, *["x"] * 6, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS_DDL).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, and a row without doc_id; columns that clash with inner names."""
    shared.ship(spark)
    d = docs_of(spark, ODD)
    return shared.saved(d.union(d.where("doc_id = 17")).union(d.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long"))), "odd")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


# --- tokens ---------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(st.characters(codec="utf-8") | st.sampled_from(" \n\t'a.,<|"), max_size=40), max_size=5))
def test_words_have_the_ids_of_their_text(path, texts):
    e = tokens.encoder(path)
    assert e([*texts, *ODD]) == e.whole([*texts, *(t or "" for t in ODD)])


def truth(texts, path):
    from tokenizers import Tokenizer

    return [np.array(e.ids + [1], "<u4") for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 3000), st.integers(0, 10**6))
def test_blocks_decode_from_any_place(n, kinds, seed):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.zipf(1.4, n), kinds).astype(np.uint32)
    table = rans.Frequencies.from_bytes(rans.Frequencies.of(*np.unique(ids, return_counts=True)).to_bytes())
    assert table.counts.sum() == 1 << table.bits and (table.counts > 0).all()
    codec = rans.Codec(table)
    block = codec.encode(ids)
    a, b = sorted(rng.integers(0, n + 1, 2))
    assert (codec.decode(block) == ids).all() and (codec.decode(block, a, b) == ids[a:b]).all()
    broken = bytearray(block)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        codec.decode(bytes(broken))


def test_token_files_hold_all_documents(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(rans, "FILE_IDS", 1000)
    folder = shared.shared_path(spark, "t")
    rans.write_tokens(odd, folder, WORD_BPE)
    got = sorted(rans.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == [None, *sorted([*range(len(ODD)), 17])]
    want = truth([ODD[8 if i is None else i] for i in ids], WORD_BPE)
    start = 0
    for r, w in zip(got, want, strict=True):
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(w), w.tobytes())
        start += len(w)
    folder = shared.shared_path(spark, "t")
    rans.write_tokens(empty, folder, WORD_BPE)
    assert rans.read_tokens(spark, folder).count() == 0


def test_token_files_keep_order_when_a_task_reads_many_ranges(spark):
    """One task reads the largest range first; what lies between two of its ranges must not be skipped."""
    conf = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    rng = np.random.default_rng(5)
    noise = lambda n: " ".join(str(v) for v in rng.integers(0, 10**9, n))
    docs = spark.createDataFrame([(i, noise((400, 5, 200, 50)[i // 50])) for i in range(200)], "doc_id long, text string").repartition(3)
    folder = shared.shared_path(spark, "rans")
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rans.write_tokens(docs, folder, WORD_BPE)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = sorted(rans.read_tokens(spark, folder).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == list(range(200))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()


def check_pieces(rows, want, sequence):
    """Every id lies in one piece, and sequences have no gaps."""
    by_doc = defaultdict(list)
    at = 0
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * sequence + r["offset"] == at and r["offset"] + r["length"] <= sequence
        at += r["length"]
        by_doc[r["doc_id"]].append(r)
    assert at == sum(sum(map(len, w)) for w in want.values())
    for doc, pieces in by_doc.items():
        copies = len(want[doc])
        held = sorted((r["start"], bytes(r["ids"])) for r in pieces)
        if copies == 1:
            assert b"".join(x for _, x in held) == want[doc][0].tobytes() and [s for s, _ in held] == list(np.cumsum([0, *(len(x) // 4 for _, x in held)])[:-1])


def test_packing_places_every_id_once(spark, odd, empty):
    want = defaultdict(list)
    for doc, w in zip(range(len(ODD)), truth(ODD, BYTE_BPE), strict=True):
        want[doc].append(w)
    want[17].append(want[17][0])
    want[None].append(want[8][0])
    for targets in (None, {"a": 3, "b": 1}):
        check_pieces(packing.pack(odd, BYTE_BPE, targets, sequence=64, window=256).collect(), want, 64)
    assert packing.pack(empty, BYTE_BPE).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.integers(1, 9)), min_size=1, max_size=5), st.integers(4, 60))
def test_rounds_serve_targets_and_carry_deficits(sources, window):
    totals, parts = zip(*sources, strict=True)
    rounds = packing.Rounds(tuple(map(str, range(len(totals)))), totals, parts, window)
    seen = sorted((place + k, s, at + k) for s, t in enumerate(totals) for _, at, place, size in rounds.pieces(s, 0, t, 16) for k in range(size))
    assert [p for p, _, _ in seen] == list(range(sum(totals)))
    for j in range(4):
        for s, (given_now, share) in enumerate(zip(rounds.given(j), parts, strict=True)):
            assert given_now == min(totals[s], j * window * share // sum(parts))


# --- WARC -----------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    long, other = "x" * 150 + "é", "y" * 99
    rows = [(3, "u3", long, 1), (1, "u\r\n1", long, 1), (2, None, other, 1), (4, "u", other, 1), (5, "u5", None, 1), (6, "u6", "", 1), (1, "u\r\n1", long, 1), (None, "n", long, 1),
            (7, "big", "<p>" * 700_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(3)
    folder = shared.shared_path(spark, "warc")
    warc.write_pages(shared.saved(pages, "pages"), folder)
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.page_records(spark, folder).collect()}
    want = set()
    for page, _, text, _ in rows:
        data = (text or "").encode()
        again = text == long and page != 1
        want.add((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == want
    archives = warc.read_archives(spark, folder)
    assert archives.where("record_type = 'revisit'").count() == 2 and archives.where("record_id in ('<urn:page:2>', '<urn:page:4>') and record_type = 'response'").count() == 2
    plan = archives.where("record_type = 'revisit'").select("record_id")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # the source takes the predicate
    assert warc.read_archives(spark, folder, payload=False).where("payload is not null").count() == 0
    member = next(Path(folder.removeprefix("file://")).glob("*.warc.gz")).read_bytes()
    assert gzip.decompress(member).startswith(b"WARC/1.1\r\n")
    folder = shared.shared_path(spark, "warc")
    warc.write_pages(pages.where("false"), folder)
    assert warc.page_records(spark, folder).count() == 0


def test_rejected_records_are_inflated_no_further_than_their_header(monkeypatch):
    noise = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    kinds = ["response", "revisit"] * 3
    data = b"".join(warc.member(warc.record(k, "u" * 2000 if i == 2 else "u", i, noise if k == "response" else b"", "d", len(noise), None, k == "revisit")) for i, k in enumerate(kinds))
    inflated, real = [], zlib.decompressobj

    class Counted:
        def __init__(self, bits):
            self.inner = real(bits)

        def decompress(self, *args):
            out = self.inner.decompress(*args)
            inflated.append(len(out))
            return out

        def flush(self):
            return self.inner.flush()

        unconsumed_tail = property(lambda self: self.inner.unconsumed_tail)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)
    rows = list(warc.read_records(io.BytesIO(data), 0, len(data), lambda h: h["warc-type"] == "revisit", True))
    assert len(rows) == 3 and sum(inflated) < 6 * 1100 + 2500
    inflated.clear()
    assert len(list(warc.read_records(io.BytesIO(data), 0, len(data), lambda h: True, False))) == 6 and sum(inflated) < 6 * 1100 + 2500
    monkeypatch.undo()
    assert [r[6] for r in warc.read_records(io.BytesIO(data), 0, len(data), lambda h: h["warc-type"] == "response", True)] == [noise] * 3


# --- near copies ----------------------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups_of(texts):
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    name = {i: i for i in sets}

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                name[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def corpus(seed=3):
    """Near copies of short and long texts, with a passage that many share."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 40))
    out = list(ODD)
    for size in (5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 200):
        base = list(rng.choice(vocabulary, size))
        for k in range(8):
            text = base[:]
            for at in rng.integers(0, size, k % 4):
                text[at] = str(rng.choice(vocabulary))
            out.append(" ".join(text[: size - k // 3]))
        out += [" ".join(list(rng.choice(vocabulary, size)) + passage) for _ in range(3)]
    return out


@pytest.mark.parametrize("boundary", [None, 0, 12])
def test_groups_equal_brute_force(spark, monkeypatch, boundary):
    texts = corpus()
    if boundary is not None:
        monkeypatch.setattr(jaccard, "choose_boundary", lambda sizes: boundary)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs_of(spark, texts)).collect()}
    assert got == groups_of(texts)


def test_groups_of_odd_tables(odd, empty):
    got = jaccard.jaccard_groups(odd).collect()
    assert len(got) == len(ODD) + 2 and {r["component_id"] for r in got if r["doc_id"] in (17, 18)} == {17}
    assert jaccard.jaccard_groups(empty).count() == 0


def test_a_text_without_doc_id_still_bridges(spark):
    """b links a with c, which do not link with each other, and all of b's rows lack a doc_id."""
    words = [f"w{i}" for i in range(400)]
    a, b, c = (" ".join(words[i:i + 300]) for i in (0, 40, 80))
    rows = [(7, a), (None, b), (None, b), (5, c), (None, "alone " * 3), (None, None), (9, None)]
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [
        (0, 0, 0), (0, 1, 0), (0, 296, 5), (0, 296, 5), (5, 296, 5), (7, 296, 5), (9, 0, 9)]


def test_need_is_the_least_overlap():
    for n in range(1, 60):
        for m in range(1, 60):
            least = next((c for c in range(1, min(n, m) + 1) if 100 * c >= 75 * (n + m - c)), None)
            assert least is None or least == jaccard.need(n, m)


def test_components_of_a_chain(spark):
    chain = spark.range(40).selectExpr("id as a", "id + 1 as b").union(spark.sql("select 100L, 101L union all select 5L, 5L"))
    got = {r["node"]: r["label"] for r in components.components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(chain.where("false")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é日\t\n\x0b,\x85"), max_size=30), min_size=1, max_size=6))
def test_word_hashes(texts):
    hashes, firsts = words.words(pa.array(texts))
    flat = [w for t in texts for w in _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))]
    assert len(flat) == len(hashes) and len(set(flat)) == len(set(hashes.tolist())) and firsts[-1] == len(flat)


# --- mixing ---------------------------------------------------------------------------------


def test_rates_meet_targets(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    targets = {"good": 0.8, "poor": 0.15, "toxic": 0.05}
    rows = mixing.mix(docs, labels, targets).toPandas()
    p, t, r = rows[["p_good", "p_poor", "p_toxic"]].to_numpy(), rows["n_words"].to_numpy(), rows["rate"].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (r >= 0).all()
    assert (t == [len([w for w in re.split("[ \n\t\r\x0b\x0c]", x) if w]) for x in docs.toPandas().set_index("doc_id")["text"].reindex(rows["doc_id"])]).all()
    assert np.abs((r * t) @ p / t.sum() - np.array(list(targets.values()))).max() < 0.02
    best = np.ones(len(r))  # plain projected gradient, long enough
    for _ in range(4000):
        pull = (best * t) @ p / t.sum() - np.array(list(targets.values()))
        best = np.clip(best - (p @ pull + mixing.RIDGE * (best - 1)) / (1 + mixing.RIDGE), 0, mixing.MOST)
    assert np.abs(best - r).max() < 0.02
    plan = docs._jdf.queryExecution().toString() + mixing.mix(docs, labels, targets)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_of_odd_tables(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(0, 1, None), (5, 0, 0), (5, 1, 1), (None, 1, 0), (9, None, None)], none.schema)
    for labels in (none, some):
        rows = mixing.mix(odd, labels, {"good": 1.0, "poor": 1.0}).collect()
        assert len(rows) == len(ODD) + 2 and all(r["rate"] >= 0 and r["n_words"] >= 0 for r in rows)
        assert mixing.mix(empty, labels, {"good": 1.0}).count() == 0
    rates = odd.select(F.monotonically_increasing_id().alias("_row"), F.lit(2.0).alias("rate"))
    assert mixing.apply_rates(odd, rates).count() == 2 * (len(ODD) + 2)


def test_fractional_rates_keep_their_totals(spark):
    docs = shared.saved(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")), "docs")
    wanted = [0.4, 0.6, 1.0, 2.5]
    rates = docs.select(F.monotonically_increasing_id().alias("_row"), F.element_at(F.lit(wanted), (F.col("doc_id") % 4 + 1).cast("int")).alias("rate"))
    got = {r["k"]: r for r in mixing.apply_rates(docs, rates).groupBy((F.col("doc_id") % 4).alias("k")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).collect()}
    assert all(abs(got[k]["n"] / 5000 - w) < 0.03 for k, w in enumerate(wanted))
    assert got[2]["n"] == got[2]["docs"] == 5000 and got[3]["docs"] == 5000


def test_the_mixing_stage_keeps_clean_documents_once(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rates = shared.saved(mixing.mix(docs, labels, corpus_pipeline.TARGETS, most=1.0), "rates")
    out = shared.saved(corpus_pipeline.mix_sources(spark, docs, big), "mixed")
    expected = rates.agg(F.sum(F.col("rate") * F.col("n_words"))).first()[0]
    words = out.agg(F.sum(F.expr("size(filter(split(text, '[ \n\t\r\x0b\x0c]'), w -> w != ''))"))).first()[0]
    assert out.count() == out.select("doc_id").distinct().count() and abs(words / expected - 1) < 0.05
    clean = rates.where("p_good > 0.95").select("doc_id")
    assert out.join(clean, "doc_id").count() >= 0.98 * clean.count()
    assert mixing.shortfalls(rates, corpus_pipeline.TARGETS)["good"] > 0  # no repeats: what is missing is reported
    assert mixing.shortfalls(mixing.mix(docs, labels, corpus_pipeline.TARGETS, most=None), corpus_pipeline.TARGETS)["good"] < 0.02


# --- pages ----------------------------------------------------------------------------------

PAGE = """<html><head><title>t</title></head><body><header class="site-header"><a href=/>Home</a></header><div id="cookie-notice">We use cookies, ok?</div>
<nav><ul><li><a href=x>one</a></ul></nav><div class="wrap"><div class="sidebar widget"><p>Popular, posts, here and so on, many words to read.</p></div>
<div class="content"><div class="post"><h1>Big title</h1><p>First paragraph, with <b>bold</b>, <a href=q>link</a> and text&nbsp;more &lt;x&gt;.</p>
<ul><li>item one<li>item two</ul><blockquote>quoted, text here.</blockquote>loose text<br>after break<span class="ad">BUY</span> end.<table><tr><td>c1<td>c2</table></div>
<section class="comments"><h2>Comments</h2><p>Nice, post, I liked it very, very much indeed sir.</p></section></div></div><form><p>Subscribe</p><input></form>
<footer>&copy; me</footer><!-- x --><script>a<b</script></body></html>"""


def test_main_text_of_a_page():
    want = "Big title First paragraph, with bold, link and text more <x>. item one item two quoted, text here. loose text after break end. c1 c2"
    assert extract.main_text(PAGE) == want
    for k in range(0, len(PAGE), 7):
        assert isinstance(extract.main_text(PAGE[:k]), str)
    assert extract.main_text("<article><header><h1>T</h1></header><p>x</p><footer>f</footer></article>") == "T x"
    assert [extract.main_text(p) for p in (None, "", "<div", "plain < text", "<p>a<p class='x'")] == ["", "", "", "plain < text", "a"]
    assert extract.main_text("<div>y" * 5000).count("y") == 5000 and extract.main_text('<a "' * 5000) == ""


def test_pages_without_article_keep_what_lies_beside_the_body():
    long = "<p>" + "Some words, and more words, that make a paragraph of text. " * 4 + "</p>"
    said = " ".join(re.sub("<.?p>", " ", long).split())
    assert extract.main_text(f"<div><h1>Title</h1><div class=body>{long * 3}</div><p>Short last line.</p></div>") == f"Title {said} {said} {said} Short last line."
    page = f"<body><nav>Menu</nav><h1>T</h1>before<div class=body>{long * 3}</div>loose, text<ul><li>one<li>two</ul><blockquote>Quote</blockquote><pre>x = 1</pre>"
    page += f"<section>Short part.</section><div>{long}</div><p>End.</p><ul><li><a href=a>link</a><li><a href=b>other</a></ul><footer>F</footer></body>"
    assert extract.main_text(page) == f"T before {said} {said} {said} loose, text one two Quote x = 1 Short part. {said} End."


def test_given_pages_give_their_article(spark, sf):
    def article(page):
        a, b = page.find("<article>"), page.find("</article>")
        inner = re.sub(r"<[^>]*$", "", page[a:]) if b < 0 else page[a:b]
        return " ".join(" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?p>|<br>|</?h1>|</?article>", inner) if x.strip())

    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("_html", F.lit(1))
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract.extract_pages(pages).collect():
        assert r["text"] == " ".join(article(source[r["page_id"]]).split()) and r["n_chars"] == len(r["text"]) and r["_html"] == 1
    assert extract.extract_pages(pages.where("false")).count() == 0


# --- search ---------------------------------------------------------------------------------


def test_top_products_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vertical, "CANDIDATES", 60)
    monkeypatch.setattr(vertical, "QUERIES", 3)
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.normal(0, 1, 20)] for _ in range(200)]
    vectors[3:6] = [vectors[2]] * 3
    rows = list(enumerate(vectors)) + [(100, vectors[7]), (300, None), (301, [None, 1.0]), (400, [float("nan")] * 20), (401, [float("inf")]), (402, [1e30]), (None, vectors[1]), (500, []), (501, [2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, row string, rank int").repartition(4)
    got = defaultdict(list)
    for r in sorted(topk.top_products(df, F.expr("vec_id % 100 = 0"), 10).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["score"], r["vec_id"], r["rank"]))
    fit = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and i not in (300, 301, 400, 401)]
    want = defaultdict(list)
    for a, (q, x) in enumerate(fit):
        if q % 100 == 0:
            scores = sorted(((vertical.as_long(sum(p * s for p, s in zip(x, y, strict=False))), i) for b, (i, y) in enumerate(fit) if b != a), key=lambda s: (-s[0], s[1]))[:10]
            want[q] += [(s, i, k + 1) for k, (s, i) in enumerate(scores)]
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items()}
    assert topk.top_products(df.where("false"), F.expr("vec_id % 100 = 0")).count() == 0


# --- fingerprints ---------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text("ab🙂", max_size=30), st.text("ab🙂", max_size=30), st.data())
def test_spans_and_extensions(a, b, data):
    x, y = (prefix_hash.PrefixHash(prefix_hash.code_points(t)) for t in (a, b))
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    length = next((k for k, (p, q) in enumerate(zip(a[i:], b[j:], strict=False)) if p != q), min(len(a) - i, len(b) - j))
    assert x.extension(i, y, j) == length
    keep = len(a) - len(a) // 3
    new = prefix_hash.edited_text(a, b)
    h = x.edited(prefix_hash.code_points(new), keep)
    assert h.span(0, h.n) == prefix_hash.PrefixHash(prefix_hash.code_points(new)).span(0, len(new))
    assert prefix_hash.likeness(prefix_hash.fingerprint(a), prefix_hash.fingerprint(a)) == 1


def test_fingerprints_of_odd_tables(spark, odd, empty):
    rows = {r["doc_id"]: r for r in prefix_hash.fingerprints(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert len(rows) == len(ODD)
    for i, text in enumerate(ODD):
        new = prefix_hash.edited_text(text or "", ODD[i - 1] or "")
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text or ""), hashlib.sha256(new.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (prefix_hash.fingerprint(text or ""), prefix_hash.fingerprint(new))
        assert r["near_next"] == prefix_hash.likeness(r["fingerprint"], prefix_hash.fingerprint(ODD[i - 1] or ""))
        assert r["same_prefix"] == next((k for k, (p, q) in enumerate(zip(text or "", new, strict=False)) if p != q), len(text or ""))
    assert prefix_hash.fingerprints(odd).count() == len(ODD) + 2
    one = prefix_hash.fingerprints(docs_of(spark, ["abcdef"])).collect()[0]
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert prefix_hash.fingerprints(empty).count() == 0


def test_likeness_estimates_the_share_of_spans():
    rng = np.random.default_rng(8)
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    spans = lambda t: {t[i : i + prefix_hash.SPAN] for i in range(len(t) - prefix_hash.SPAN + 1)}
    errors = []
    for _ in range(60):
        a = letters(2000)
        keep = int(rng.integers(0, 2000))
        b = a[:keep] + letters(2000 - keep)
        x, y = spans(a), spans(b)
        errors.append(prefix_hash.likeness(prefix_hash.fingerprint(a), prefix_hash.fingerprint(b)) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.1
    far = [letters(300_000) for _ in range(2)]
    assert prefix_hash.likeness(*map(prefix_hash.fingerprint, far)) == 0


# --- chats ----------------------------------------------------------------------------------


def test_chats_keep_the_longest(spark):
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("user", None)
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, c], 5: [a, b, c], None: [b], 7: [("use", "rhi")], 8: [(None, "x")] * 70}
    rows = [(i, 10 * t, *turn, "z") for i, turns in logs.items() for t, turn in enumerate(turns)] + [(1, 0, "user", "hi", "z"), (9, None, "user", "q", "z"), (9, 1, "user", "r", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string").repartition(3)
    got = {(r["conv_id"], r["part"]): (r["n_turns"], r["text"]) for r in chat.chat_rows(df).collect()}
    assert set(got) == {(3, 0), (4, 0), (None, 0), (7, 0), (8, 0), (8, 1), (9, 0)}
    assert got[3, 0] == (3, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n<|im_end|>\n") and got[8, 1][0] == 6
    assert got[9, 0][1].index("q<") < got[9, 0][1].index("r<")
    assert chat.chat_rows(df.where("false")).count() == 0
    plan = chat.chat_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- quality --------------------------------------------------------------------------------


def test_held_out_quality(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = queries.QUERIES["op10_attention_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (rows["held_out"] == rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.95


def test_scores_of_odd_tables(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    some = spark.createDataFrame([(i, i % 2) for i in range(18)] + [(3, None), (None, 1), (4, 7)], none.schema)
    for labels in (none, some):
        model = attention.train(odd, labels)
        rows = attention.score_documents(odd.withColumn("score", F.lit("old")), model).collect()
        assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows)
        assert attention.score_documents(empty, model).count() == 0
        assert attention.train(empty, labels).prior == 1.0


def test_attention_gradient():
    rng = np.random.default_rng(1)
    x, begins = rng.random((60, attention.FEATURES)).astype(np.float32), np.arange(0, 61, 3)
    y = (np.maximum.reduceat(x[:, 2], begins[:-1]) < 0.7).astype(float)  # one passage decides
    model = attention.fit(x, begins, y, epochs=400)
    assert ((model.scores(x, begins) > 0.5) == y).mean() > 0.95
    assert np.allclose(np.add.reduceat(model.attention(x, begins), begins[:-1]), 1)


# --- queries and pipeline -------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())


def test_stages_of_the_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").withColumn("_row", F.lit("x"))
    docs = shared.saved(docs.union(docs.where("doc_id < 5")).union(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string"))), "docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = shared.saved(stage(spark, docs, sf.replace("0.001", "0.01")), "stage")
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        assert docs.exceptAll(before).count() == 0
        if name == "near copies":
            texts = [r["text"] for r in before.select("doc_id", "text").collect()]
            sizes = groups_of_sets(texts)
            assert docs.count() == sizes
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0


@pytest.mark.parametrize("stage, module, name", [("drop_near_copies", jaccard, "jaccard_groups"), ("mix_sources", mixing, "mix")])
def test_stages_keep_row_numbers_when_scans_split_anew(spark, sf, monkeypatch, stage, module, name):
    """After the first jobs of a stage the table is scanned in another number of splits."""
    docs = shared.saved(spark.read.parquet(f"{sf}/documents.parquet").repartition(6, "doc_id"), "docs")
    run = lambda: sorted(r["doc_id"] for r in getattr(corpus_pipeline, stage)(spark, docs, sf).collect())
    want = run()
    real = getattr(module, name)

    def then_split_anew(*args, **kw):
        made = shared.saved(real(*args, **kw), "made")
        for k, v in {"openCostInBytes": "0", "minPartitionNum": "1"}.items():
            spark.conf.set(f"spark.sql.files.{k}", v)
        return made

    monkeypatch.setattr(module, name, then_split_anew)
    try:
        got = run()
    finally:
        for k in ("openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{k}")
    # Numbers decide which documents are thinned, so mixing is compared by what is surely kept.
    assert got == want if stage == "drop_near_copies" else len(got) > 0.9 * len(want)


def groups_of_sets(texts):
    """How many groups of near copies there are, by an inverted index."""
    sets = [shingles(t) for t in texts]
    index, shared_by = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for g in s:
            for j in index[g]:
                shared_by[j, i] += 1
            index[g].append(i)
    name = list(range(len(sets)))

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for (i, j), both in shared_by.items():
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            name[top(j)] = top(i)
    return len({top(i) for i in range(len(sets))})


def test_fitting_domains_holds_only_buckets_that_were_met(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    mixing.fit_domains(docs, labels)  # imports and first use are not counted
    tracemalloc.start()
    model = mixing.fit_domains(docs, labels)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 20_000_000  # one array over all buckets and three domains takes 25 MB
    docs_of = {r["domain"]: r["n"] for r in labels.selectExpr("doc_id", f"{mixing.DOMAIN} AS domain").where("domain is not null").groupBy("doc_id").agg(F.max("domain").alias("domain")).join(docs, "doc_id").groupBy("domain").agg(F.count("*").alias("n")).collect()}
    met: dict[int, dict[str, int]] = {}
    rows = docs.join(labels.selectExpr("doc_id", f"{mixing.DOMAIN} AS domain").where("domain is not null").groupBy("doc_id").agg(F.max("domain").alias("domain")), "doc_id")
    for r in rows.select("domain", F.explode(F.array_distinct(mixing._split("text"))).alias("w")).where("w != ''").select("domain", mixing._bucket(F.col("w")).alias("b")).groupBy("b", "domain").count().collect():
        met.setdefault(r["b"], dict.fromkeys(model.names, 0))[r["domain"]] = r["count"]
    want = {}
    total = sum(docs_of.values())
    for b, of in met.items():
        if sum(of.values()) >= mixing.LEAST_DOCS:
            k = sum(of.values())
            weights = [math.log((of[d] + 0.5) / (docs_of[d] + 1)) - math.log((k - of[d] + 0.5) / (total - docs_of[d] + 1)) - 2 * math.sqrt(1 / (of[d] + 0.5) + 1 / (k - of[d] + 0.5)) for d in model.names]
            if max(weights) >= mixing.LEAST_ODDS:
                want[b] = [w if w >= mixing.LEAST_ODDS else 0.0 for w in weights]
    got = {r[0]: list(r[1:]) for r in model.words.collect()}
    assert got.keys() == want.keys()
    assert all(got[b] == pytest.approx(want[b]) for b in want)
