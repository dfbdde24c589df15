"""Near-dedup by BagMinHash over multisets of word shingles.

Signatures: a shingle of multiplicity w lives on the weights (0, w], cut into the dyadic nodes
(0,1], (1,2], (2,4], ... Each node has a Poisson process of rate equal to its width, seeded by shingle
and node alone; each point carries a register and a position within the node, and counts if
its position is at most w. A register keeps the time of its first point, so that two documents agree in
a register with probability equal to their weighted Jaccard similarity. Nodes stop as soon as their
time passes the largest register, which makes a signature cost about n + m log m points.

Links: documents of equal word sequences form a class, and only one of a class goes on. Banding puts
classes into buckets; within buckets, whole signatures are compared, and classes whose estimate comes
near the threshold form families. Within a family, the multisets themselves are compared; linked
classes are united. Families and buckets that are too large for a task are cut into blocks. One block is
compared with all, then only what that left apart. Tasks give spanning forests of the links that they find, not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, lookup
from .components import components
from .words import BASE, buffers, counted, hashed, mix, shingles, slices

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4  # a pair at 0.8 shares no band with probability (1 - 0.8**4)**24 = 3e-6
REGISTERS = BANDS * ROWS
#: Pairs whose signatures agree less than this are not compared; at 0.8, fewer agree with probability below 1e-7.
NEAR = 0.56
#: Most rows and bytes of text of a block.
BLOCK_ROWS, BLOCK_BYTES = 1024, 24 << 20


def signatures(elements: np.ndarray, rows: np.ndarray, weights: np.ndarray, n_rows: int, m: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers (n_rows x m, uint64) of the multisets given as (element, row, weight); no element: all ones."""
    keys, owners, widths, lows, limits = [elements], [rows], [np.ones(len(elements))], [np.zeros(len(elements))], [weights]
    low = 1
    while len(more := np.flatnonzero(weights > low)):
        keys.append(mix(elements[more] + np.uint64(low * int(BASE) % 2**64)))
        owners.append(rows[more])
        widths.append(np.full(len(more), float(low)))
        lows.append(np.full(len(more), float(low)))
        limits.append(weights[more])
        low *= 2
    key, owner, width, lo, limit = (np.concatenate(x) for x in (keys, owners, widths, lows, limits))
    times = np.full(n_rows * m, np.inf)
    now, point = np.zeros(len(key)), 0
    while len(key):
        step = int(max(1, min(64, 60_000 // len(key))))
        draw = mix(key[:, None] + np.arange(point + 1, point + step + 1, dtype=np.uint64) * M_STEP)
        wait = -np.log(((draw >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / width[:, None]
        wait[:, 0] += now
        at = np.cumsum(wait, axis=1)
        other = mix(draw ^ BASE)
        register = ((other & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        fits = np.floor(lo[:, None] + width[:, None] * ((other >> np.uint64(32)) * 2.0**-32)) < limit[:, None]
        target = owner[:, None] * m + register
        np.minimum.at(times, target[fits], at[fits])
        now, point = at[:, -1], point + step
        going = now < times.reshape(n_rows, m).max(axis=1)[owner]
        key, owner, width, lo, limit, now = (x[going] for x in (key, owner, width, lo, limit, now))
    return mix(times.view(np.uint64).reshape(n_rows, m))


M_STEP = np.uint64(0xD1342543DE82EF95)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        out = mix(out * BASE + signature[:, r::rows][:, :bands])
    return mix(out + np.arange(bands, dtype=np.uint64) * BASE)


def sketch(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, words, size, class_a, class_b, signature, bands) of each row.

    class_a and class_b are 128 bits of the word sequence; mark tells the texts of a repeated id apart.
    """
    schema = "id long, mark long, words int, size long, class_a long, class_b long, signature binary, bands array<long>"

    def run(batches):
        for batch in batches:
            ids, marks, (data, offsets) = batch.column(0), batch.column(2), buffers(batch.column(1))
            for start, end in slices(offsets):
                own = offsets[start : end + 1]
                words, firsts = hashed(data, own)
                counts = np.diff(firsts)
                place = np.arange(len(words)) - np.repeat(firsts[:-1], counts)
                full = np.flatnonzero(counts)
                parts = []
                for salt in (np.uint64(0x51ED270B), np.uint64(0x2545F4914F6CDD1D)):
                    total = np.zeros(end - start, np.uint64)
                    if len(words):
                        total[full] = np.add.reduceat(mix(words ^ mix(place.astype(np.uint64) * BASE + salt)), firsts[:-1][full])
                    parts.append(mix(total + counts.astype(np.uint64)).view(np.int64))
                element, row, weight = counted(*shingles(words, firsts, SHINGLE))
                found = signatures(element, row, weight, end - start)
                keys = band_keys(found, BANDS, ROWS).view(np.int64)
                short = (found & np.uint64(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, end - start),
                        marks.slice(start, end - start),
                        pa.array(counts, pa.int32()),
                        pa.array(np.diff(own), pa.int64()),
                        *[pa.array(p) for p in parts],
                        pa.array([x.tobytes() for x in short], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (end - start + 1) * BANDS, BANDS), pa.int32()), pa.array(keys.ravel())),
                    ],
                    names=["id", "mark", "words", "size", "class_a", "class_b", "signature", "bands"],
                )

    return identified(df, id_col, text_col).mapInArrow(run, schema)


def identified(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, mark): a row is known by its id and, if ids repeat, by a hash of its text."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def n_blocks(rows: Column, size: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def dealt(n: Column) -> Column:
    return F.pmod(F.xxhash64("id"), n).cast("int")


def paired(rows: DataFrame, key: str, partners: Column, more: DataFrame) -> DataFrame:
    """A copy of each row of `rows` (key, id, side, ...) for each block of `partners`, next to those of that block; lo and hi name both."""
    rows = rows.join(more, ["id", "mark"])
    if "text" in more.columns:
        rows = rows.dropDuplicates(["id", "mark"])  # equal rows bring equal texts
    rows = rows.withColumn("_p", F.explode(partners)).select("*", F.least("side", "_p").alias("lo"), F.greatest("side", "_p").alias("hi"))
    return rows.drop("_n", "_p", "_top", "_main", "_rest", "size", "mark").repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", "id")


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of the rows of one group, from batches that are ordered by `keys`."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[start] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def forest(signature: np.ndarray, side: np.ndarray, within: bool, near: int, verify: Callable | None, label: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows: pairs that agree in `near` registers or more and pass `verify`; rows of equal labels are linked already."""
    n, out = len(signature), []
    label = np.unique(label, return_inverse=True)[1]
    for i in range(n - 1):
        other = np.flatnonzero((label[i + 1 :] != label[i]) & ((side[i + 1 :] != side[i]) | within)) + i + 1
        if not len(other):
            continue
        other = other[(signature[other] == signature[i]).sum(axis=1) >= near]
        if len(other) and verify:
            other = other[verify(i, other)]
        for j in other.tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def compared(pairs: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b): spanning forests of the links within each pair of blocks."""
    text = "text" in pairs.columns

    def run(batches):
        near = int(np.ceil(NEAR * REGISTERS))
        for group in groups(batches, (key, "lo", "hi")):
            if group.num_rows < 2:
                continue
            ids, side = group.column("id").to_numpy(), group.column("side").to_numpy()
            label = group.column("label").to_numpy() if "label" in group.column_names else ids
            signature = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint16).reshape(group.num_rows, -1)
            verify = overlap(group.column("text").combine_chunks(), threshold) if text else None
            pairs = forest(signature, side, group.column("lo")[0].as_py() == group.column("hi")[0].as_py(), near, verify, label)
            if pairs:
                a, b = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def forests(rows: DataFrame, key: str, more: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges that unite what links unite within the groups of `rows` (key, id, mark, size).

    `more` (id, mark, signature, and text if texts are to be compared) is joined to rows only when they go to their tasks.
    A group of up to BLOCK_ROWS rows and BLOCK_BYTES bytes is one task. A larger one is dealt to blocks by a hash of
    the id and goes in two passes. The first compares one block with all. The second takes up what the first
    left apart: members outside the largest component of their group meet each other and that component, whose
    members do not meet each other again. Every link between components is tried, and a group whose
    members are mostly copies of one text costs in proportion to its rows.
    """
    large = lookup(rows.groupBy(key).agg(n_blocks(F.count("*"), F.sum("size")).alias("_n")).where("_n > 1"))
    cut = rows.join(large, key, "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("side", dealt(F.col("_n")))
    every = F.sequence(F.lit(0), F.col("_n") - 1)
    first = compared(paired(cut, key, F.when(F.col("side") == 0, every).otherwise(F.array(F.lit(0))), more), key, threshold)
    if large.isEmpty():
        return first
    known = checkpointed(components(first).withColumnRenamed("component", "label"))
    united = known.select(F.col("id").alias("a"), F.col("label").alias("b"))
    rest = rows.join(large.drop("_n"), key, "left_semi").join(known, "id", "left").withColumn("label", F.coalesce("label", "id"))
    rest = checkpointed(rest)
    shares = rest.groupBy(key, "label").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    tops = shares.groupBy(key).agg(F.max(F.struct("n", "s", "label")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > top.n")
    tops = tops.select(key, F.col("top.label").alias("_top"), n_blocks(F.col("top.n"), F.col("top.s")).alias("_main"), n_blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("_rest"))
    top, main = F.col("label") == F.col("_top"), F.col("_main")
    tops = lookup(tops)
    if tops.isEmpty():
        return united
    cut = rest.join(tops, key).withColumn("side", F.when(top, dealt(main)).otherwise(main + dealt(F.col("_rest"))))
    partners = F.sequence(F.when(F.col("side") < main, main).otherwise(F.lit(0)), main + F.col("_rest") - 1)
    return united.union(compared(paired(cut, key, partners, more), key, threshold))


def overlap(texts: pa.Array, threshold: float) -> Callable:
    """A test of row i against rows: whether the weighted Jaccard similarity of their shingles is at least `threshold`."""
    data, offsets = buffers(texts)
    bags = []
    for start, end in slices(offsets):
        element, row, weight = counted(*shingles(*hashed(data, offsets[start : end + 1]), SHINGLE))
        cuts = np.searchsorted(row, np.arange(end - start + 1))
        bags += [(element[a:b], weight[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    _, ids = np.unique(np.concatenate([b[0] for b in bags]), return_inverse=True)
    ends = np.cumsum([len(b[0]) for b in bags])
    starts = ends - [len(b[0]) for b in bags]
    weights = np.concatenate([b[1] for b in bags])
    totals = np.array([b[1].sum() for b in bags])
    have = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)

    def verify(i: int, rows: np.ndarray) -> np.ndarray:
        own = slice(starts[i], ends[i])
        have[ids[own]] = weights[own]
        good = np.zeros(len(rows), bool)
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            lengths = ends[part] - starts[part]
            firsts = np.cumsum(lengths) - lengths
            flat = np.arange(lengths.sum()) + np.repeat(starts[part] - firsts, lengths)
            common = np.add.reduceat(np.minimum(have[ids[flat]], weights[flat]), firsts)
            good[at : at + 256] = common >= threshold * (totals[i] + totals[part] - common) - 1e-9
        have[ids[own]] = 0
        return good

    return verify


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `df`: ``id_col, class_id, kept``.

    Documents are linked if the weighted Jaccard similarity of their multisets of five-word
    shingles is at least `threshold`; class_id is the smallest id among those reachable by links,
    and only the row of that id is kept. Words are runs of non-space in lower-cased text. A text of fewer than
    five words has one shingle of all its words. A text without a word (null, empty, blank)
    links with nothing and is kept. Rows that repeat an id are classed each by its own text, and
    marked kept if that class is named by their id; texts whose smallest id is the same are one class. A row with a null
    id takes the class of an equal text with an id, or else a null class. Other columns are not read. An empty table
    gives an empty result.
    """
    sketches = checkpointed(sketch(df, id_col, text_col))
    full = sketches.where("words > 0")
    classes = full.groupBy("class_a", "class_b").agg(F.min("id").alias("id"), F.max("size").alias("size"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "mark")))["mark"].alias("mark"), F.max("signature").alias("signature"), F.max("bands").alias("bands")).where("id IS NOT NULL")
    classes = checkpointed(classes)
    # Buckets of the same members, from different bands, are one.
    entries = classes.select("id", "mark", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "mark").cast("decimal(20,0)")).alias("s"), F.min("id").alias("first")).where("n > 1")
    buckets = buckets.groupBy("n", "s", "first").agg(F.min("key").alias("key")).select("key")
    members = checkpointed(entries.join(buckets, "key").withColumn("size", F.lit(0).cast("long")))
    likely = forests(members, "key", classes.select("id", "mark", "signature"), threshold)
    family = checkpointed(components(likely).withColumnRenamed("component", "key"))
    suspects = checkpointed(family.join(classes.select("id", "mark", "size"), "id"))
    texts = classes.select("id", "mark", "signature").join(identified(df, id_col, text_col), ["id", "mark"])
    linked = components(forests(suspects, "key", texts, threshold))
    named = classes.select("class_a", "class_b", "id").join(linked, "id", "left").select("class_a", "class_b", F.coalesce("component", "id").alias("class_id"))
    out = sketches.where("words > 0").select("id", "class_a", "class_b").join(named, ["class_a", "class_b"], "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    out = out.union(sketches.where("words = 0").select("id", F.col("id").alias("class_id")))
    return out.select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))
