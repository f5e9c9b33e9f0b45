"""Rates for documents so that domains meet target weights, with soft membership; DataFrame functions only.

A classifier is learned from a labelled table: by log-odds of words (hashed to ``BUCKETS``) and
of words' last signs it gives each document an evidence for each domain, and a linear
discriminant turns evidence into posteriors. Rates then solve, by accelerated projected gradient,

    min  1/2 sum_d ((E_d - T_d) / T)^2 + ridge/2 sum_i t_i / T (r_i - 1)^2,   0 <= r_i <= most,

E_d = sum_i r_i t_i p_id being the expected words of domain d and T_d its target. A step needs
only E, one number for each domain; rates stay in the table.

Null and empty texts have no words: their posteriors are the domains' shares, and they do not
count in totals. Labels that are null are left out; a document labelled twice counts in its
rarest-named domain (the greatest name). Domains without a labelled document get no posterior, and
their target is shared by the others; without labels all rates are 1. Equal doc_ids are rated
one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.llm import shared

BUCKETS = 1 << 20
MAX_LABELLED = 20_000
#: A word in that many labelled documents counts as evidence if, two standard errors below what was counted, its odds are still raised so far (as a logarithm).
LEAST_ODDS, LEAST_DOCS = 1.5, 4
STEPS = 48
RIDGE = 0.01
MOST = 4.0

#: SQL for a labelled row's domain.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' WHEN quality = 1 THEN 'good' END"


@dataclass(frozen=True)
class Domains:
    """A fitted classifier: evidence by bucket and last sign, and a discriminant over evidence."""

    names: list[str]
    words: DataFrame | None
    signs: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    shares: np.ndarray


def _split(text: str) -> Column:
    flat = F.lower(F.coalesce(F.col(text), F.lit("")))
    for sign in ("\n", "\t", "\r", "\x0b", "\x0c"):
        flat = F.replace(flat, F.lit(sign), F.lit(" "))
    return F.split(flat, " ")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _sign(word: Column) -> Column:
    return F.least(F.ascii(F.right(word, F.lit(1))), F.lit(255))


def _evidence(rows: DataFrame, key: list[str], model: Domains) -> DataFrame:
    """key, n_words and the evidence x0.. of each row with words; nothing but counts is shuffled."""
    n = len(model.names)
    word = rows.select(*key, F.explode(_split("text")).alias("w")).where("w != ''").select(*key, _bucket(F.col("w")).alias("bucket"), _sign(F.col("w")).alias("sign"))
    joined = word.join(F.broadcast(model.words), "bucket", "left")  # at most BUCKETS rows
    signs = [F.array(*(F.lit(float(v)) for v in model.signs[:, d])) for d in range(n)]
    sums = joined.groupBy(*key).agg(
        F.count("*").alias("n_words"), *(F.sum(f"w{d}").alias(f"f{d}") for d in range(n)),
        *(F.sum(F.element_at(signs[d], F.col("sign") + 1)).alias(f"g{d}") for d in range(n)))
    hit = lambda d: F.coalesce(F.col(f"f{d}"), F.lit(0.0))
    return sums.select(*key, "n_words", *((hit(d) / (1 + hit(d))).alias(f"x{d}") for d in range(n)), *((F.col(f"g{d}") / F.col("n_words")).alias(f"x{n + d}") for d in range(n)))


def _log_odds(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each row of counts by domain: how much likelier it is in a domain than in the others."""
    rest = counts.sum(axis=1, keepdims=True) - counts
    return np.log((counts + 0.5) / (docs + 1)) - np.log((rest + 0.5) / (docs.sum() - docs + 1))


def _weights(met: pa.Table, docs: np.ndarray) -> pa.Table:
    """The buckets (b) that are evidence for a domain, with their weights w0..; n0.. are their labelled documents by domain, ``docs`` all of them."""
    n = len(docs)
    counts = np.column_stack([met[f"n{i}"].to_numpy() for i in range(n)]).astype(float)
    error = np.sqrt(1 / (counts + 0.5) + 1 / (counts.sum(axis=1, keepdims=True) - counts + 0.5))
    least = _log_odds(counts, docs) - 2 * error
    weight = np.where(least >= LEAST_ODDS, least, 0.0)
    kept = np.flatnonzero(weight.any(axis=1))
    kept = kept[np.argsort(met["b"].to_numpy()[kept])]
    return pa.table({"bucket": pa.array(met["b"].to_numpy()[kept], pa.int32()), **{f"w{d}": weight[kept, d] for d in range(n)}})


def fit_domains(docs: DataFrame, labels: DataFrame, domain: str = DOMAIN, most: int = MAX_LABELLED) -> Domains:
    """Learn from at most ``most`` labelled documents, those of smallest hash; counts by bucket and domain reach the driver."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(domain).alias("domain")).where("domain is not null")
    known = known.groupBy("doc_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = shared.saved(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id").select(F.monotonically_increasing_id().alias("row"), "domain", "text"), "labelled")
    sizes = rows.groupBy("domain").count().orderBy("domain").collect()
    names = [r["domain"] for r in sizes]
    per = np.array([r["count"] for r in sizes], float)
    n = len(names)
    if n < 2:
        return Domains(names, None, np.zeros((256, n)), np.zeros((2 * n, n)), np.zeros(n), per / max(1, per.sum()))
    place = {d: i for i, d in enumerate(names)}
    word = rows.select("domain", F.explode(F.array_distinct(_split("text"))).alias("w")).where("w != ''")
    by_domain = word.groupBy(_bucket(F.col("w")).alias("b")).agg(F.count("*").alias("all"), *(F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(names)))
    # Only buckets that were seen are held: arrays over all BUCKETS take 25 MB each for three domains, several at a time.
    met = by_domain.where(f"all >= {LEAST_DOCS}").select("b", *(f"n{i}" for i in range(n))).toArrow()
    words = spark.createDataFrame(_weights(met, per), ", ".join(["bucket int", *(f"w{d} double" for d in range(n))]))
    seen = np.zeros((256, n))
    all_words = rows.select("domain", F.explode(_split("text")).alias("w")).where("w != ''")
    for r in all_words.groupBy(_sign(F.col("w")).alias("s"), "domain").count().collect():
        seen[r["s"], place[r["domain"]]] = r["count"]
    signs = np.clip(_log_odds(seen, seen.sum(axis=0)), -4, 4)
    first = Domains(names, words, signs, np.zeros((2 * n, n)), np.zeros(n), per / per.sum())

    # Means and products of the evidence by domain are all that the discriminant needs.
    x = [f"x{i}" for i in range(2 * n)]
    moments = _evidence(rows, ["row", "domain"], first).groupBy("domain").agg(
        F.count("*").alias("n"), *(F.avg(a).alias(a) for a in x), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(x) for b in x[i:])).collect()
    mean, within, total = np.zeros((n, 2 * n)), np.zeros((2 * n, 2 * n)), 0
    for r in moments:
        d = place[r["domain"]]
        mean[d] = [r[a] for a in x]
        product = np.array([[r[f"{x[min(i, j)]}_{x[max(i, j)]}"] for j in range(2 * n)] for i in range(2 * n)])
        within += product - r["n"] * np.outer(mean[d], mean[d])
        total += r["n"]
    spread = within / max(1, total) + 1e-4 * np.eye(2 * n)
    slope = np.linalg.solve(spread, mean.T)
    offset = np.log(per / per.sum()) - 0.5 * np.einsum("dk,kd->d", mean, slope)
    return Domains(names, words, signs, slope, offset, per / per.sum())


def posteriors(docs: DataFrame, model: Domains, row: str | None = None) -> DataFrame:
    """``docs`` with ``_row`` (its column ``row``, or a number of each row), n_words and p_<domain>, written once."""
    n = len(model.names)
    numbered = docs.select("doc_id", "text", F.col(row).alias("_row")) if row else shared.numbered(docs.select("doc_id", "text"), "_row")
    if model.words is None:
        words = F.size(F.filter(_split("text"), lambda w: w != "")).cast("long")
        return shared.saved(numbered.select("doc_id", "_row", words.alias("n_words"), *(F.lit(1.0).alias(f"p_{d}") for d in model.names)), "posteriors")
    found = _evidence(numbered.select("_row", "text"), ["_row"], model)
    scores = [sum((F.col(f"x{i}") * float(model.slope[i, d]) for i in range(2 * n)), F.lit(float(model.offset[d]))) for d in range(n)]
    scored = found.select("_row", "n_words", *(s.alias(f"s{d}") for d, s in enumerate(scores)))
    top = F.greatest(*(F.col(f"s{d}") for d in range(n)))
    raised = scored.select("_row", "n_words", *(F.exp(F.col(f"s{d}") - top).alias(f"e{d}") for d in range(n)))
    total = sum((F.col(f"e{d}") for d in range(1, n)), F.col("e0"))
    given = raised.select("_row", "n_words", *((F.col(f"e{d}") / total).alias(f"p_{name}") for d, name in enumerate(model.names)))
    joined = numbered.select("doc_id", "_row").join(given, "_row", "left")
    filled = [F.coalesce(f"p_{name}", F.lit(float(model.shares[d]))).alias(f"p_{name}") for d, name in enumerate(model.names)]
    return shared.saved(joined.select("doc_id", "_row", F.coalesce("n_words", F.lit(0)).alias("n_words"), *filled), "posteriors")


def fit_rates(rows: DataFrame, names: list[str], targets: dict[str, float], steps: int = STEPS, ridge: float = RIDGE, most: float | None = MOST) -> DataFrame:
    """``rows`` with rate, unbounded if ``most`` is None. Every few steps the rates are written, which keeps plans short."""
    wanted = np.array([max(0.0, targets.get(d, 0.0)) for d in names])
    if len(names) < 2 or not wanted.sum():
        return rows.withColumn("rate", F.lit(1.0))
    wanted = wanted / wanted.sum()
    total = float(rows.agg(F.sum("n_words")).first()[0] or 0)
    if not total:
        return rows.withColumn("rate", F.lit(1.0))
    step, root = 1 / (1 + ridge), np.sqrt(ridge / (1 + ridge))
    push = float((1 - root) / (1 + root))
    now = rows.withColumn("_old", F.lit(1.0)).withColumn("rate", F.lit(1.0))
    for k in range(steps):
        ahead = now.withColumn("_ahead", F.col("rate") + push * (F.col("rate") - F.col("_old")))
        sums = ahead.agg(*(F.sum(F.col("_ahead") * F.col("n_words") * F.col(f"p_{d}")).alias(d) for d in names)).first()
        pull = [float(sums[d]) / total - float(w) for d, w in zip(names, wanted, strict=True)]
        slope = sum((F.col(f"p_{d}") * c for d, c in zip(names, pull, strict=True)), F.lit(0.0)) + ridge * (F.col("_ahead") - 1)
        new = F.greatest(F.col("_ahead") - step * slope, F.lit(0.0))
        new = new if most is None else F.least(new, F.lit(most))
        now = ahead.select(*rows.columns, F.col("rate").alias("_old"), new.alias("rate"))
        if k % 6 == 5:
            now = shared.saved(now, "rates")
    return now.drop("_old")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = DOMAIN, most: float | None = MOST, row: str | None = None) -> DataFrame:
    """doc_id, _row, n_words, posteriors p_<domain> and rate of every document; ``row`` names a column that numbers them."""
    model = fit_domains(docs, labels, domain)
    return fit_rates(posteriors(docs, model, row), model.names, targets, most=most)


def shortfalls(rates: DataFrame, targets: dict[str, float]) -> dict[str, float]:
    """By domain: its target less its expected words, as a share of all words; a bound on rates leaves some above 0."""
    names = [c[2:] for c in rates.columns if c.startswith("p_")]
    wanted = {d: max(0.0, targets.get(d, 0.0)) for d in names}
    sums = rates.agg(F.sum("n_words").alias("_all"), *(F.sum(F.col("rate") * F.col("n_words") * F.col(f"p_{d}")).alias(f"p_{d}") for d in names)).first()
    if not sums["_all"] or not sum(wanted.values()):
        return {}
    return {d: w / sum(wanted.values()) - sums[f"p_{d}"] / sums["_all"] for d, w in wanted.items()}


def apply_rates(docs: DataFrame, rates: DataFrame, number: str | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate: the whole part, and once more with the chance of the rest.

    The chance is a hash of the row's number, so expected totals are those of the rates. ``number``
    is the column of ``docs`` that numbered the rows for ``mix`` (see ``shared.numbered``); without
    it rows are numbered anew, which is right only for a scan that cannot be split differently.
    """
    row, copies, copy = (shared.free(docs, n) for n in ("_row", "_copies", "_copy"))
    chance = F.pmod(F.xxhash64(F.lit("copies"), "_row"), F.lit(1 << 32)) / float(1 << 32)
    whole = rates.select(F.col("_row").alias(row), F.floor(F.col("rate") + chance).cast("int").alias(copies))
    kept = docs.withColumn(row, F.col(number) if number else F.monotonically_increasing_id()).join(whole, row).where(F.col(copies) > 0)
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
