"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError


#: Rows of a few narrow columns up to which a table is broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary one will do on a single machine; on a cluster it is an error, as
    executors would not see it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise EngineError(1, "spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexigraph-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written there, which cuts its plan and outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out to all cores if it comes in fewer partitions, as one small file does; a large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
