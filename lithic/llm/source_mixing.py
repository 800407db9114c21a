"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the listed sources'
total size, over its own size.  Every document draws its count from a Poisson
distribution with that mean by inverting the distribution function at a uniform
number hashed from seed and id, so a run is repeatable and needs no counter or
state.  Documents are exploded by their counts and dealt out again by a hash of
seed, id and copy: a random partition, and a random order inside it.

Only DataFrame functions.  Sizes are pre-aggregated per source; a source may hold
any share of the rows, as nothing is gathered by source.  The table of rates is
broadcast up to ``MAX_BROADCAST_SOURCES`` sources and joined with salt beyond.

Defined results: null counts as a source of its own; with ``weights`` a source
that isn't listed keeps rate 1; a source of total size 0 has rate 1; null ids
draw like the empty id; repeated rows draw the same count; null and empty texts have
size 0 and are replicated like others; texts of any length are only measured, never
cut; an empty table stays empty.  Added columns come after those of the input; where
the input has a column of that name, in any case, it is kept and the added one gets
underscores in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

MAX_BROADCAST_SOURCES = 50_000
SALTS = 64


def hashed_unit(seed: int, *parts: Column) -> Column:
    """Uniform number in [0, 1) from 52 bits of a seeded hash."""
    text = F.concat_ws(":", F.lit(str(seed)), *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """The distribution function at 0, 1, 2, … until nothing of weight is left."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("lp"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        lp = s["lp"] + F.log(rate) - F.log(k.cast("double"))
        c = s["c"] + F.exp(lp)
        return F.struct(lp.alias("lp"), c.alias("c"), F.concat(s["all"], F.array(c)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), top), start, step, lambda s: s["all"])).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, power: float, source: str, measure: str) -> DataFrame:
    """``src, rate``: one row per source."""
    sizes = docs.groupBy(F.col(source).cast("string").alias("src")).agg(F.sum(F.expr(measure).cast("double")).alias("size"))
    sizes = materialize(sizes.withColumn("size", F.coalesce("size", F.lit(0.0))), "sizes")
    if weights is None:
        share = F.when(F.col("size") > 0, F.pow("size", F.lit(power))).otherwise(0.0)
    else:
        if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
            raise ValueError("weights must be non-negative, and one positive")
        listed = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        share = F.element_at(listed, F.col("src"))
    sizes = sizes.withColumn("share", share)
    total = sizes.where("share is not null").agg(F.sum("size").alias("size"), F.sum("share").alias("share")).first()
    rate = F.lit(float(total["size"] or 0)) * F.col("share") / F.lit(float(total["share"] or 1)) / F.col("size")
    return sizes.select("src", F.when((F.col("size") > 0) & F.col("share").isNotNull(), rate).otherwise(1.0).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = 0.5,
    seed: int = 42,
    source: str = "source",
    key: str = "doc_id",
    measure: str = "length(text)",
) -> DataFrame:
    """``docs`` replicated to the target shares, with ``copy`` (from 0) and ``mix_key``.

    ``weights`` gives shares by source; without it a source's share is its size
    to the power ``power`` (1 keeps proportions, 0 makes sources equal).
    ``measure`` is the SQL expression that sizes a document.
    """
    rates = source_rates(docs, weights, power, source, measure).select("src", poisson_cdf(F.col("rate")).alias("cdf"))
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("copy", "mix_key"):
        while name in taken:
            name = f"_{name}"
        names.append(name)
    # the input's columns travel in one struct, so no name of theirs can meet one used here
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{source}`").cast("string").alias("of"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("ident"))
    if rates.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates), F.col("of").eqNullSafe(F.col("src")))
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(salted, F.col("of").eqNullSafe(F.col("src")) & (F.pmod(F.xxhash64("ident"), F.lit(SALTS)) == F.col("salt")))
    u = hashed_unit(seed, F.lit("n"), F.col("ident"))
    drawn = joined.select("row", "ident", F.size(F.filter("cdf", lambda c: c <= u)).alias("n")).where("n > 0")
    copies = drawn.select("row", "ident", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    mixed = copies.select("row", "k", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("s"), "ident", F.col("k").cast("string"))).alias("at"))
    mixed = mixed.repartition("at").sortWithinPartitions("at")
    return mixed.select("row.*", F.col("k").alias(names[0]), F.col("at").alias(names[1]))


MIX_SQL = """
WITH sizes AS (
  SELECT source AS src, CAST(SUM(length(text)) AS DOUBLE) AS size FROM documents GROUP BY source
), shares AS (
  SELECT src, size, CASE WHEN size > 0 THEN pow(size, 0.5) ELSE 0 END AS share FROM sizes
), rates AS (
  SELECT src, CASE WHEN size > 0 THEN (SELECT SUM(size) FROM shares) * share / (SELECT SUM(share) FROM shares) / size ELSE 1.0 END AS rate FROM shares
), steps AS (
  SELECT src, k, exp(-rate + k * ln(rate) - CASE WHEN k > 1 THEN lgamma(k + 1) ELSE 0 END) AS p
  FROM rates, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INT))) AS k) AS g
), cdf AS (
  SELECT src, k, SUM(p) OVER (PARTITION BY src ORDER BY k) AS c FROM steps
), drawn AS (
  SELECT doc_id, source, CAST(CAST('0x' || substr(md5('42:n:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents
), counts AS (
  SELECT d.doc_id, COUNT(c.k) AS n FROM drawn d JOIN cdf c ON c.src IS NOT DISTINCT FROM d.source AND c.c <= d.u GROUP BY d.doc_id
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy, md5('42:s:' || doc_id || ':' || copy) AS mix_key
FROM (SELECT d.*, unnest(generate_series(0, c.n - 1)) AS copy FROM documents d JOIN counts c USING (doc_id)) AS x
"""
