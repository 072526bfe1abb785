"""Mixing sources to target weights by Poisson replication.

Each document is repeated a number of times drawn from a Poisson distribution
whose mean is its source's target repetition rate.  The draw inverts the
distribution at a number that a hash of seed and doc_id fixes, so a rerun, or a
rerun of one lost task, draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written

SEED = "mix-1"
#: Default weights: a source of n documents gets n ** TEMPER shares.
TEMPER = 0.5
#: A source with more than this share of all documents, one in HOT, is never shuffled by its name.
HOT = 512


def uniform(*parts: Column) -> Column:
    """In [0, 1), 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def target_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """(m_source, rate, hot): the mean number of copies of a source's documents.

    A source's share of ``total`` (the number of documents, if none is given) is
    its weight's share; sources without a weight get none.  Null is a source of
    its own, named "" in ``weights``.  A hot source has more than one document
    in HOT, so there are fewer than HOT of them.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("m_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = written(sizes.withColumn("weight", F.pow("n", F.lit(TEMPER))), "mix-sizes")
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "m_source string, weight double")
        weighted = written(sizes.join(named, "m_source", "left").fillna(0.0, ["weight"]), "mix-sizes")
    whole = weighted.agg(F.sum("weight").alias("weights"), F.sum("n").alias("all")).first()
    if not whole["all"]:
        return weighted.select("m_source", F.lit(0.0).alias("rate"), F.lit(False).alias("hot"))
    out = whole["all"] if total is None else total
    rate = F.col("weight") / F.lit(whole["weights"]) * F.lit(out) / F.col("n") if whole["weights"] else F.lit(0.0)
    return weighted.select("m_source", rate.alias("rate"), (F.col("n") * HOT > whole["all"]).alias("hot"))


def drawn_copies(rate: Column, u: Column) -> Column:
    """How many of P(X <= j), j = 0, 1, ..., of a Poisson variable do not exceed ``u``: its inverse at u.

    Looked at as far as the values differ from 1; the work for a document is in
    proportion to its rate, as its copies are.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), (F.exp(-rate) <= u).cast("int").alias("n"))

    def step(acc: Column, j: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate / j)
        total = acc["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), (acc["n"] + (total <= u).cast("int")).alias("n"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["n"])).otherwise(0)


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` with its columns, each row as often as drawn, and ``copy`` (from 0) and ``shuffle_key``; in a global random order.

    Null doc_ids are drawn alike, and so are repeated rows; null and empty texts
    are rows like any others; columns named copy or shuffle_key are replaced, all
    others kept whatever their names; no rows give no rows.  Rows are dealt to
    ranges of shuffle_key and sorted in them.
    """
    keep = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    source = F.coalesce("source", F.lit(""))
    rates = target_rates(docs, weights, total)
    hot = [r["m_source"] for r in rates.filter("hot").select("m_source").collect()]  # fewer than HOT
    rows = docs.select(F.struct(*keep).alias("row"), ident.alias("ident"), source.alias("m_source"), uniform(F.lit(seed), ident).alias("m_u"))
    drawn = rows.filter(F.col("m_source").isin(hot)).join(F.broadcast(rates.filter("hot")), "m_source")
    if not rates.filter("not hot").isEmpty():
        drawn = drawn.unionByName(rows.filter(~F.col("m_source").isin(hot)).join(rates.filter("not hot"), "m_source"))
    drawn = drawn.withColumn("m_n", drawn_copies(F.col("rate"), F.col("m_u"))).filter("m_n > 0")
    copies = drawn.select("row", "ident", F.explode(F.sequence(F.lit(0), F.col("m_n") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("ident"), F.col("copy").cast("string"))))
    dealt = keyed.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select(*[F.col("row")[c].alias(c) for c in keep], "copy", "shuffle_key")


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, mixed to weights that flatten the sources' sizes."""
    return replicated(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key")


OP7_SQL = f"""
WITH sizes AS (SELECT source, count(*) AS n, power(count(*), {TEMPER}) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, weight / (SELECT sum(weight) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
terms AS (
  SELECT source, j, sum(exp(-rate + j * ln(rate) - lgamma(j + 1))) OVER (PARTITION BY source ORDER BY j) AS below
  FROM rates, range(0, 400) t(j) WHERE j <= ceil(rate + 12 * sqrt(rate) + 30)
),
below AS (SELECT source, list(below ORDER BY j) AS cdf FROM terms GROUP BY source),
drawn AS (
  SELECT d.*, len(list_filter(b.cdf, lambda c: c <= ('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0)) AS k
  FROM documents d JOIN below b ON d.source = b.source
)
SELECT doc_id, text, lang, source, n_chars, c.copy::INTEGER AS copy, md5('{SEED}:order:' || doc_id || ':' || c.copy) AS shuffle_key
FROM drawn, LATERAL (SELECT unnest(range(0, k)) AS copy) c
"""
