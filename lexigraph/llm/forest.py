"""Embedding near-dedup with a forest of random projections.

Each tree splits the vectors again and again along random directions, one per tree and level. A split lies
where the projections are sparse, near the middle, and the vectors within the gap go to both sides
(spill). Vectors that share a leaf are compared exactly, in double precision; trees miss different
pairs, so their links are united. A pair is counted in the first leaf that it shares only, so that link
counts need no table of pairs: a task gives link counts and a spanning forest.

Equal vectors form a class, of which one row goes through the trees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpointed, lookup
from .components import components
from .minhash import groups

TREES, LEAF, SPILL = 8, 512, 0.10
#: Most classes, and bytes of them, on which the splits are fitted; every class is indexed.
SAMPLE, SAMPLE_BYTES = 65_536, 64 << 20
#: In the first tree, a node of which this share of sampled pairs is linked is a leaf of any size: a split would
#: part them. The other trees split it like any other, so that only one compares all its pairs.
DENSE = 0.2
#: Rows of a block; a leaf of more rows is compared block by block, each pair of blocks in a task of its own.
BLOCK = 1024
#: Lengths that have no more classes than this get no trees: all their vectors are one leaf.
PLAIN = 4096
MAX_DEPTH = 40


def directions(dim: int, tree: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim, tree])).standard_normal((dim, MAX_DEPTH))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms, in double precision; scaled first, so that squares cannot overflow or vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_tree(sample: np.ndarray, whole: int, tree: int, seed: int, threshold: float) -> dict[int, tuple[float, float]]:
    """Splits of a tree by node number (root 1, children 2n and 2n+1): the gap that goes to both sides."""
    at = sample @ directions(sample.shape[1], tree, seed)
    rng = np.random.Generator(np.random.PCG64([seed, tree, 1]))
    most = max(8, LEAF * len(sample) / max(whole, 1))
    splits: dict[int, tuple[float, float]] = {}
    todo = [(1, 0, np.arange(len(sample)))]
    while todo:
        node, level, rows = todo.pop()
        if len(rows) <= most or level >= MAX_DEPTH:
            continue
        a, b = rng.choice(rows, 400), rng.choice(rows, 400)
        if tree == 0 and (np.einsum("ij,ij->i", sample[a], sample[b])[a != b] >= threshold).mean() > DENSE:
            continue
        order = np.sort(at[rows, level])
        n, w = len(rows), max(1, int(SPILL * len(rows)))
        first = np.arange(int(0.25 * n), max(int(0.25 * n) + 1, int(0.75 * n) - w))
        i = int(first[np.argmax(order[first + w] - order[first])])
        low, high = float(order[i]), float(order[i + w])
        left, right = rows[at[rows, level] <= high], rows[at[rows, level] >= low]
        if len(left) == n or len(right) == n:
            continue
        splits[node] = (low, high)
        todo += [(2 * node, level + 1, left), (2 * node + 1, level + 1, right)]
    return splits


def route(x: np.ndarray, splits: list[dict[int, tuple[float, float]]], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs over all trees; a leaf is tree << 48 | node."""
    rows_out, leaves_out = [], []
    for tree, own in enumerate(splits):
        at = x @ directions(x.shape[1], tree, seed)
        todo = [(1, 0, np.arange(len(x)))]
        while todo:
            node, level, rows = todo.pop()
            if not len(rows):
                continue
            if node not in own:
                rows_out.append(rows)
                leaves_out.append(np.full(len(rows), (tree << 48) | node, np.int64))
                continue
            low, high = own[node]
            p = at[rows, level]
            todo += [(2 * node, level + 1, rows[p <= high]), (2 * node + 1, level + 1, rows[p >= low])]
    return np.concatenate(rows_out), np.concatenate(leaves_out)


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest leaf that stands in both rows; rows are padded with -1 and -2."""
    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return np.where(both, a, np.iinfo(np.int64).max).min(axis=1)


def compare(x, side, ids, copies, leaves, leaf, within, threshold):
    """Link counts and a spanning forest of the pairs at home in this leaf."""
    n = len(x)
    counts, label, edges = np.zeros(n, np.int64), np.arange(n), []
    for start in range(0, n, 512):
        block = x[start : start + 512] @ x.T
        i, j = np.nonzero(block >= threshold)
        i += start
        keep = (j > i) & (within | (side[i] != side[j]))
        i, j = i[keep], j[keep]
        for at in range(0, len(i), 20_000):
            p, q = i[at : at + 20_000], j[at : at + 20_000]
            home = first_shared(leaves[p], np.where(leaves[q] == -1, -2, leaves[q])) == leaf
            p, q = p[home], q[home]
            np.add.at(counts, p, copies[q])
            np.add.at(counts, q, copies[p])
            while len(p):  # unite: the smaller label wins, and an edge is kept for each union
                a, b = label[p], label[q]
                apart = a != b
                p, q, a, b = p[apart], q[apart], a[apart], b[apart]
                if not len(p):
                    break
                high, low = np.maximum(a, b), np.minimum(a, b)
                # Of the edges that would lower a label, one is taken for each label.
                took, first = np.unique(high, return_index=True)
                edges += zip(ids[p[first]].tolist(), ids[q[first]].tolist(), strict=True)
                parent = np.arange(n)
                parent[took] = low[first]
                while (parent[parent] != parent).any():
                    parent = parent[parent]
                label = parent[label]
    return counts, edges


def usable(column) -> object:
    """Whether a vector can be compared: not null or zero, without null or non-finite components."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(column.isNotNull() & F.forall(column, finite) & F.exists(column, lambda v: v != 0), F.lit(False))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, trees: int = TREES, seed: int = 7) -> DataFrame:
    """One row per row of `df`: ``id_col, n_links, component_id, kept``.

    Vectors link if their cosine, in double precision, is at least `threshold`; n_links counts the
    other rows that a row is linked with, copies included, and component_id is the smallest id
    reachable by links, the own one included. Vectors that are null, zero or hold null or non-finite
    components link with nothing, nor do vectors of different lengths. Rows that repeat an id count as
    rows. A row with a null id counts as a link but lends its id to none. Other columns are not
    read. An empty table gives an empty result. Splits are fitted on up to SAMPLE classes, drawn by hash.
    """
    vector = F.col("vector")
    single = isinstance(df.schema[vector_col].dataType, T.ArrayType) and isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(T.ArrayType(T.DoubleType())).alias("vector")).withColumn("vector", F.when(usable(vector), F.transform(vector, lambda v: v + F.lit(0.0))))
    whole = rows.where(vector.isNotNull())
    # Classes are numbered, not hashed, so that no two can be taken for one; the numbers are fixed by the checkpoint.
    classes = whole.groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = checkpointed(classes.withColumn("id", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")))
    many = [r[0] for r in classes.groupBy("dim").count().where(F.col("count") > PLAIN).select("dim").collect()]
    found = linked_pairs(placed_plainly(classes.where(~F.col("dim").isin(many)) if many else classes, single), threshold, single)
    for dim in many:
        found = found.unionByName(linked_pairs(placed_by_trees(classes.where(F.col("dim") == dim), dim, threshold, trees, seed, single), threshold, single))
    found = checkpointed(found)
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("component", "root")
    named = classes.join(counts, "id", "left").join(joined, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = whole.join(named, "vector").select("id", "n_links", "component_id")
    out = linked.union(rows.where(vector.isNull()).select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), "n_links", F.coalesce("component_id", "id").alias("component_id"), F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"))


PLACED = "id long, copies long, vector binary, leaves array<long>"


def packed(vectors: pa.Array, single: bool) -> pa.Array:
    """The bytes of each vector, four a component if they came so, else eight."""
    kind = np.float32 if single else np.float64
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(vectors.value_lengths().to_numpy())
    return pa.array([v.tobytes() for v in np.split(flat, ends[:-1])], pa.binary())


def placed_plainly(classes: DataFrame, single: bool) -> DataFrame:
    """Classes in one leaf for each length of vectors, numbered below zero."""

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1), pa.int32()), pa.array(-1 - batch.column(3).to_numpy().astype(np.int64) - 2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(batch.column(2), single), lists], names=["id", "copies", "vector", "leaves"])

    return classes.select("id", "copies", "vector", "dim").mapInArrow(place, PLACED)


def placed_by_trees(classes: DataFrame, dim: int, threshold: float, trees: int, seed: int, single: bool) -> DataFrame:
    """Classes of one length with their leaves in all trees.

    Vectors travel as they came, in four bytes a component if they were `single`; they are scaled where they are compared.
    """
    whole = classes.count()
    most = max(4096, min(SAMPLE, SAMPLE_BYTES // (8 * max(dim, 1))))
    drawn = classes if whole <= most else classes.where(F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * most / whole))
    sample = drawn.select("vector").limit(most).toArrow().column(0).combine_chunks()
    sample = unit(sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
    splits = [fit_tree(sample, whole, t, seed, threshold) for t in range(trees)]
    del sample
    held = classes.sparkSession.sparkContext.broadcast(splits)  # at most trees * SAMPLE / 4 splits of two numbers

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            row, leaf = route(unit(raw), held.value, seed)
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(batch.column(2), single), lists], names=["id", "copies", "vector", "leaves"])

    return classes.select("id", "copies", "vector").mapInArrow(place, PLACED)


def linked_pairs(placed: DataFrame, threshold: float, single: bool) -> DataFrame:
    """(a, b, n): edges of spanning forests (n null), and link counts of a class in one leaf (b null)."""
    kind = np.float32 if single else np.float64
    entries = placed.withColumn("leaf", F.explode("leaves"))
    sizes = entries.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n")).where("_n > 1")
    entries = entries.join(lookup(sizes), "leaf", "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("side", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    entries = entries.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    entries = entries.select("leaf", F.least("side", "_p").alias("lo"), F.greatest("side", "_p").alias("hi"), "side", "id", "copies", "vector", "leaves")
    entries = entries.repartition("leaf", "lo", "hi").sortWithinPartitions("leaf", "lo", "hi")

    def link(batches):
        for group in groups(batches, ("leaf", "lo", "hi")):
            if group.num_rows < 2:
                continue
            ids, side, copies = (group.column(c).to_numpy() for c in ("id", "side", "copies"))
            x = unit(np.frombuffer(b"".join(group.column("vector").to_pylist()), kind).astype(float).reshape(group.num_rows, -1))  # a leaf has one length
            lists = group.column("leaves").combine_chunks()
            lengths = lists.value_lengths().to_numpy()
            leaves = np.full((group.num_rows, int(lengths.max())), -1, np.int64)
            leaves[np.arange(leaves.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
            within = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
            counts, edges = compare(x, side, ids, copies, leaves, group.column("leaf")[0].as_py(), within, threshold)
            has = np.flatnonzero(counts)
            if len(has):
                a, b = np.array(edges, np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((ids[has], a))), pa.array([None] * len(has) + b.tolist(), pa.int64()), pa.array(counts[has].tolist() + [None] * len(a), pa.int64())],
                    names=["a", "b", "n"],
                )

    return entries.mapInArrow(link, "a long, b long, n long")
