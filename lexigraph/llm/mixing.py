"""Mixing sources to target weights by Poisson replication.

Each row is repeated as often as a Poisson variable says, whose mean is the target repetition rate
of its source and whose uniform is a hash of seed and id. The copies are then shuffled globally.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS

#: A mean above this is inverted as a sum of equal parts with a uniform each; exp(-part) stays far from underflow.
PART = 16.0


def uniform(seed: int, *parts: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def poisson(u: Column, mean: Column) -> Column:
    """The smallest k with P(X <= k) > u, for means up to PART."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.when(u >= first, 1).otherwise(0).cast("long").alias("n"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        c = s["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), (s["n"] + F.when(u >= c, 1).otherwise(0)).cast("long").alias("n"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["n"])


def rates(df: DataFrame, source_col: str, text_col: str, weights: Mapping[str, float] | None, alpha: float, scale: float) -> DataFrame:
    """(_source, _rate): target share of the characters over the share that the source has.

    A source's weight is taken from `weights`, or else is its number of characters to the power
    `alpha`. A source without a character gets its rate from its weight as if it had one.
    """
    sizes = df.groupBy(F.col(source_col).alias("_source")).agg(F.greatest(F.sum(F.length(F.coalesce(F.col(text_col), F.lit("")))), F.lit(1)).cast("double").alias("_chars"))
    weight = F.pow(F.col("_chars"), F.lit(float(alpha)))
    if weights is not None:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        weight = F.coalesce(F.try_element_at(given, F.coalesce(F.col("_source"), F.lit("null"))), F.lit(0.0))
    sizes = sizes.withColumn("_weight", weight)
    total = sizes.agg(F.sum("_chars").alias("_all_chars"), F.sum("_weight").alias("_all_weight"))
    # `total` is an aggregate without keys: one row, whatever the input.
    return sizes.join(F.broadcast(total), F.lit(True)).select(
        "_source", F.when(F.col("_all_weight") > 0, F.lit(float(scale)) * (F.col("_weight") / F.col("_all_weight")) * (F.col("_all_chars") / F.col("_chars"))).otherwise(0.0).alias("_rate")
    )


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Mapping[str, float] | None = None, alpha: float = 0.7, scale: float = 1.0, seed: int = 11) -> DataFrame:
    """The rows of `df`, each repeated by its Poisson count, with ``copy`` (0, 1, ...), in shuffled order.

    All columns of `df` are kept; one named ``copy`` is replaced. A null source is a source of its
    own (``"null"`` in `weights`); a null or empty text counts no characters; rows that repeat an
    id get the same count. Weights of zero drop a source. An empty table gives an empty result.
    """
    kept = [c for c in df.columns if c != "copy"]
    names = [f"_{i}" for i in range(len(kept))]  # so that no column can clash with those made here
    at = dict(zip(kept, names, strict=True))
    key, source, text = F.col(at[id_col]), at[source_col], at[text_col]
    df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    by_source = rates(df, source, text, weights, alpha, scale)
    if by_source.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        by_source = F.broadcast(by_source)
    rate = F.col("_rate")
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    count = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0).cast("long"), lambda s, j: s + poisson(uniform(seed, key, j), F.col("_mean")))
    out = (
        df.join(by_source, F.col(source).eqNullSafe(F.col("_source")))
        .withColumn("_parts", parts)
        .withColumn("_mean", rate / F.col("_parts"))
        .withColumn("_count", count)
        .where("_count > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_count").cast("int") - 1)))
        .withColumn("_order", F.xxhash64(F.lit(seed), key, F.col("copy")))
    )
    return out.repartition("_order").sortWithinPartitions("_order").select(*[F.col(n).alias(c) for c, n in at.items()], "copy")


def oracle(alpha: float = 0.7, scale: float = 1.0, seed: int = 11) -> str:
    return f"""
WITH sizes AS (SELECT source, CAST(greatest(sum(length(coalesce(text, ''))), 1) AS DOUBLE) AS chars FROM documents GROUP BY source),
weighted AS (SELECT *, pow(chars, {alpha}) AS weight FROM sizes),
rated AS (SELECT source, {scale} * (weight / sum(weight) OVER ()) * (sum(chars) OVER () / chars) AS rate FROM weighted),
parted AS (SELECT d.*, greatest(CAST(ceil(rate / {PART}) AS INT), 1) AS parts, rate / greatest(CAST(ceil(rate / {PART}) AS INT), 1) AS mean
  FROM documents d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source),
drawn AS (SELECT doc_id, mean, CAST(('0x' || substr(md5('{seed}:' || doc_id || ':' || j), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM parted, unnest(range(1, parts + 1)) AS t(j)),
tables AS (SELECT mean, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY mean ORDER BY k) AS cdf
  FROM (SELECT DISTINCT mean FROM drawn), unnest(range(0, 100)) AS t(k)),
counts AS (SELECT doc_id, count(k) AS n FROM drawn LEFT JOIN tables ON drawn.mean = tables.mean AND cdf <= u GROUP BY doc_id)
SELECT d.*, CAST(c.copy AS INT) AS copy FROM documents d JOIN counts USING (doc_id), unnest(range(0, n)) AS c(copy)
"""
