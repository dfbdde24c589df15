"""Connected components of an edge table: blocks of edges shrink to stars, which large-star and small-star steps join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import settled

#: Edges that a task shrinks at once: 4 MB of ids.
BLOCK_EDGES = 1 << 18


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of these edges, but for the smallest of its component, and that smallest."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    label, a, b = np.arange(len(ids)), at[: len(u)], at[len(u) :]
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
    far = np.flatnonzero(label != np.arange(len(ids)))
    return ids[far], ids[label[far]]


def shrunk(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The stars of each `block` edges of a task."""

    def out():
        columns = stars(*(np.concatenate([x[k] for x in held]) for k in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["u", "v"])

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            part = batch.slice(at, block)
            if held and size + part.num_rows > block:
                yield out()
                held, size = [], 0
            held.append([c.to_numpy() for c in part.columns])
            size += part.num_rows
    if held:
        yield out()


def components(edges: DataFrame, left: str = "a", right: str = "b", block: int = BLOCK_EDGES) -> DataFrame:
    """(id, component): for each end of an edge, the smallest id that it reaches.

    Nulls and self-loops link nothing; repeated edges count once; no edges give no rows. Tasks first
    shrink their edges, `block` at a time, to stars. Stars of one block are the components; those of
    several are joined in rounds, whose steps are keyed aggregates with map-side combine and joins that AQE may
    split where a node is hot. Each round is written to the shared checkpoint folder; nothing but two
    numbers a round reaches the driver.
    """
    pairs = edges.select(F.col(left).cast("long").alias("_a"), F.col(right).cast("long").alias("_b")).where("_a != _b").select(F.greatest("_a", "_b").alias("u"), F.least("_a", "_b").alias("v"))
    pairs = settled(pairs)
    blocks = math.ceil(pairs.count() / block)
    pairs = pairs.coalesce(max(1, blocks)).mapInArrow(lambda batches: shrunk(batches, block), "u long, v long")
    pairs, before = settled(pairs if blocks <= 1 else pairs.distinct()), None
    while blocks > 1:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are tables of their own, so that the joins have shuffles of their own, whose hot keys AQE can split.
        least = settled(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # A node's own minimum replaces its edges; ends of the old edges are linked to that minimum.
        large = settled(large)
        nearest = settled(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(nearest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(nearest).distinct()
        pairs = settled(small)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    found = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
