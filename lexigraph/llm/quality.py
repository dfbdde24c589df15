"""Data selection by importance resampling with hashed n-gram models.

Words and word pairs are hashed into buckets. Two generative models, of the target text and of the raw
text, give each document the logarithm of its importance weight; Gumbel noise, seeded by id, is added,
and the largest k stay. That is a draw without replacement in proportion to the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed
from .mixing import uniform
from .words import BASE, buffers, hashed, mix, slices

BUCKETS = 10_000
#: Most labelled documents from which the target model is fitted; more are thinned by a hash of the id.
TARGET_DOCS = 200_000
SMOOTHING = 1.0


def features(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word and each pair of neighbours in a row."""
    counts = np.diff(firsts)
    rows = np.repeat(np.arange(len(counts)), counts)
    single = (words % np.uint64(BUCKETS)).astype(np.int64)
    if len(words) < 2:
        return single, rows
    inner = rows[1:] == rows[:-1]
    pairs = (mix(words[:-1] * BASE + words[1:])[inner] % np.uint64(BUCKETS)).astype(np.int64)
    return np.concatenate((single, pairs)), np.concatenate((rows, rows[1:][inner]))


def bucket_counts(df: DataFrame, text_col: str) -> np.ndarray:
    """Occurrences of each bucket over all rows. Tasks send at most BUCKETS sums; the driver gets BUCKETS numbers."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for start, end in slices(offsets):
                bucket, _ = features(*hashed(data, offsets[start : end + 1]))
                total += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for bucket, n in df.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def log_ratio(target: DataFrame, raw: DataFrame, text_col: str = "text") -> np.ndarray:
    """log p_target - log p_raw of each bucket, with add-one smoothing."""
    p, q = (bucket_counts(x, text_col) + SMOOTHING for x in (target, raw))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def weigh(df: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_features, log_weight): the log importance weight of each whole text; 0 for one without a word."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for start, end in slices(offsets):
                bucket, row = features(*hashed(data, offsets[start : end + 1]))
                weight = np.bincount(row, ratio[bucket], end - start)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(np.bincount(row, minlength=end - start)), pa.array(weight)], names=["id", "n_features", "log_weight"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, n_features long, log_weight double").withColumnRenamed("id", id_col)


def cutoff(keys: DataFrame, k: int) -> tuple[float, int] | None:
    """The k-th largest (key, -id) pair of `keys` (key double, id long), by narrowing histograms of 4096 bins; None if all fit."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if n <= k:
        return None
    above, inside = 0, keys
    for _ in range(12):
        if not low < high:
            break
        width = (high - low) / 4096
        bins = inside.withColumn("bin", F.least(F.floor((F.col("key") - low) / width), F.lit(4095))).groupBy("bin").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("bin")).collect()
        for b in bins:
            if above + b["n"] >= k:
                low, high = b["lo"], b["hi"]
                inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
                left = b["n"]
                break
            above += b["n"]
        if left <= 4096:
            break
    # The rest is one bin of at most 4096 rows, or rows of one key, which go by id.
    if low == high:
        ids = inside.select("id")
        lo, hi, want = *ids.agg(F.min("id"), F.max("id")).first(), k - above
        while lo < hi:
            mid = (lo + hi) // 2
            if ids.where(F.col("id") <= mid).count() >= want:
                hi = mid
            else:
                lo = mid + 1
        return low, lo
    rows = inside.orderBy(F.desc("key"), "id").limit(k - above).collect()
    return rows[-1]["key"], rows[-1]["id"]


def select(weights: DataFrame, share: float, id_col: str = "doc_id", seed: int = 23) -> DataFrame:
    """`weights` with ``gumbel_key, selected``: the `share` of rows with the largest log weight plus Gumbel noise.

    The number of rows is rounded up. Ties go to the smaller id; rows that repeat an id and a
    weight are tied and stay or go together, so that a few more may stay. A null id draws as the text "null".
    """
    u = (uniform(seed, F.col(id_col)) * float(1 << 52) + 0.5) / float(1 << 52)
    keyed = checkpointed(weights.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))))
    keys = keyed.select(F.col("gumbel_key").alias("key"), F.coalesce(F.col(id_col), F.lit(-1)).alias("id"))
    last = cutoff(keys, int(np.ceil(share * keyed.count())))
    chosen = F.lit(True)
    if last is not None:
        chosen = (F.col("gumbel_key") > last[0]) | ((F.col("gumbel_key") == last[0]) & (F.coalesce(F.col(id_col), F.lit(-1)) <= last[1]))
    return keyed.withColumn("selected", chosen)


def target_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of documents labelled good and not toxic, TARGET_DOCS at most, found by a broadcast of their ids."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct()
    n = good.count()
    if n > TARGET_DOCS:
        good = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * TARGET_DOCS / n * 0.99))
    return docs.join(F.broadcast(good.limit(TARGET_DOCS)), "doc_id", "left_semi")


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.8, seed: int = 23) -> DataFrame:
    """One row per document: ``doc_id, n_features, log_weight, gumbel_key, selected``.

    A null or empty text has weight 0 in logarithm. Without a good label the target model is
    uniform. Other columns are not read. An empty table gives an empty result.
    """
    ratio = log_ratio(target_rows(docs, labels), docs)
    return select(weigh(docs, ratio), share, seed=seed)
