"""One query per operator, over its whole table, and check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import attention, bond, chat, extract, jaccard, mixing, packing, phrases, prefix_hash, rans, shared, substrings, tokens, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shared.ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_warc_archives",
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
    m AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, d.payload_digest,
           CASE WHEN first_id IS NULL OR first_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
    FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND payload_bytes >= 100
    """,
)
def warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.shared_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.page_records(spark, folder)


@query("op2_range_coded_tokens")
def range_coded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.shared_path(spark, "rans")
    rans.write_tokens(table(spark, sf_dir, "documents"), folder, tokens.vocabulary("word_bpe_49k.json"))
    return rans.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


@query("op4_mixture_packing")
def mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"), keep_ids=False))


@query("op6_tree_scored_text")
def tree_scored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query(
    "op7_top_products",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 10
    """,
)
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"))


@query("op8_prefix_fingerprints")
def prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.fingerprints(table(spark, sf_dir, "documents"))


@query("op10_attention_quality")
def attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    model = attention.train(docs, table(spark, sf_dir, "labels"))
    scored = attention.score_documents(docs, model)
    held_out = F.coalesce(attention.fold_of(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= attention.THRESHOLD).cast("int").alias("predicted"))


TARGETS = {"good": 0.85, "poor": 0.1, "toxic": 0.05}


@query("op5_soft_mixing")
def soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, table(spark, sf_dir, "labels"), TARGETS).drop("_row")


@query(
    "op9_collapsed_chats",
    r"""
    WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    d AS (SELECT *, sha256(length(role) || ':' || role || text) AS digest FROM t),
    n AS (SELECT *, row_number() OVER w - 1 AS place, md5(string_agg(digest, ',') OVER w) AS prefix FROM d
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT conv_id, max(place) AS place, arg_max(prefix, place) AS prefix FROM n GROUP BY conv_id),
    k AS (SELECT min(conv_id) AS conv_id FROM e WHERE NOT EXISTS (
              SELECT 1 FROM n JOIN e AS f ON f.conv_id = n.conv_id WHERE n.prefix = e.prefix AND n.place = e.place AND n.place < f.place)
          GROUP BY prefix)
    SELECT conv_id, place // 64 AS part, CAST(count(*) AS INTEGER) AS n_turns,
           string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
    FROM n SEMI JOIN k USING (conv_id) GROUP BY ALL
    """,
)
def collapsed_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_rows(table(spark, sf_dir, "conversations"))


@query(
    "op13_bond_negatives",
    """
    WITH v AS (
        SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
        SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
               CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
    ),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5
    """,
)
def bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return bond.hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")), F.expr("vec_id % 100 = 0"))


@query(
    "op11_suffix_phrases",
    r"""
    WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
    g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
          FROM p, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k),
    f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
    n AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
    cuts AS (SELECT c.lang, c.k, phrase, a, w, j, array_to_string(w[:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM c, (VALUES (1), (2)) AS v(j) WHERE j < c.k),
    s AS (SELECT q.lang, q.k, q.phrase, a, q.w, j, x.n AS l, y.n AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
          FROM cuts q JOIN f x ON x.lang = q.lang AND x.phrase = q.x AND x.k = j JOIN f y ON y.lang = q.lang AND y.phrase = q.y AND y.k = q.k - j),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    longer AS (SELECT lang, phrase, max(a) AS a FROM (
                   SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL)
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, n.n, score
    FROM b JOIN n USING (lang) LEFT JOIN longer ON b.k = 2 AND longer.lang = b.lang AND longer.phrase = b.phrase
    WHERE longer.a IS NULL OR 100 * longer.a < 50 * b.a QUALIFY rank <= 2000
    """,
)
def suffix_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query(
    "op12_fm_substrings",
    r"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT id, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
    m AS (SELECT h, min(doc_id) AS least FROM s GROUP BY h),
    c AS (SELECT id, i FROM s JOIN m USING (h) WHERE least < doc_id),
    r AS (SELECT DISTINCT id, i + k AS p FROM c, LATERAL (SELECT unnest(range(50)) AS k)),
    g AS (SELECT id, list(p) AS ps FROM r GROUP BY id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
           sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]), ' ') END) AS kept_sha256
    FROM d LEFT JOIN g USING (id)
    """,
)
def fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.without_repeats(table(spark, sf_dir, "documents")))
