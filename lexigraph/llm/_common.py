"""What the training-data operators share: inputs, checkpoints and size-checked joins."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup of a few fixed-width columns is broadcast (about 25 MB); beyond it, joins shuffle.
BROADCAST_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the folder that all executors share, so that losing an executor loses nothing.

    The cluster names the folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one will
    do on a single machine, as in tests; on a cluster it is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexigraph-"))
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """`df` checkpointed, as a table whose size Spark does not know.

    A checkpoint keeps the size that was estimated for its plan, and a join's estimate is the product of
    its sides: over rounds of joins, the number gets so long that the driver spends its time multiplying. Actual
    sizes are known to AQE all the same.
    """
    df, session = checkpointed(df), df.sparkSession
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(session._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), session)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII text takes the fast path of `lower`."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def lookup(df: DataFrame) -> DataFrame:
    """`df` as a table of its own, broadcast if it has at most BROADCAST_ROWS rows.

    A larger one is joined by a shuffle of its own, whose hot keys AQE can split.
    """
    df = checkpointed(df)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Places of a bitmap, as a power of two; a word of it has 64 places.
PLACES = 26


def place(*key: Column) -> Column:
    return F.xxhash64(*key).bitwiseAND(F.lit((1 << PLACES) - 1))


def bitmap(groups: DataFrame, *key: str) -> DataFrame:
    """(_word, _bits): the places of the keys of `groups`; at most 2**(PLACES - 6) rows, whatever their number."""
    at = groups.select(place(*map(F.col, key)).alias("_at"))
    return at.groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_at & 63 AS INT))")).alias("_bits"))


def marked(rows: DataFrame, bits: DataFrame, *key: str) -> DataFrame:
    """`rows` with ``_alive``: whether the place of a row's key is marked."""
    rows = rows.withColumn("_at", place(*map(F.col, key))).withColumn("_word", F.shiftright("_at", 6))
    alive = F.expr("coalesce(shiftrightunsigned(_bits, CAST(_at & 63 AS INT)) & 1, 0) = 1")
    return rows.join(F.broadcast(bits), "_word", "left").withColumn("_alive", alive).drop("_word", "_bits", "_at")
