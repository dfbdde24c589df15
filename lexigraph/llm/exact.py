"""Exact dedup by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Only DataFrame functions run. Each step looks only at rows whose group held two rows or more in the step
before, and the digest of a whole text is computed only for rows of surviving (length, prefix) groups. Which
groups survive is told by a bitmap of 2**26 places, whatever their number: it is a table of at most 2**20
words, which may always be broadcast, so that no text is ever shuffled. A row that shares a place by chance
is looked at once more and found alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, bitmap, checkpointed, lookup, marked

PREFIX_CHARS = 64


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept`` and the columns named in `carry`.

    Texts are equal if identical after lower-casing A-Z only; null counts as the empty text, so
    null and empty rows form one group. The largest id of a group stays. Rows that repeat an id
    with an equal text count each in group_size and are all marked kept if that id stays (tied
    copies are told apart by nothing). A null id never beats another one. Other columns of `df`
    are not read, so their names cannot clash. An empty table gives an empty result.
    """
    rows = df.select(
        F.col(id_col).alias("_id"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("_len"),
        F.col(text_col).alias("_text"),
    )
    prefix = F.xxhash64(ascii_lower(F.substring("_text", 1, PREFIX_CHARS)))
    # Step 1: lengths that occur twice. Only their rows go on.
    lengths = checkpointed(bitmap(rows.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1"), "_len"))
    rows = marked(rows, lengths, "_len").withColumn("_prefix", F.when(F.col("_alive"), prefix)).drop("_alive")
    # Step 2: among them, (length, prefix) pairs that occur twice.
    pairs = rows.where("_prefix IS NOT NULL").groupBy("_len", "_prefix").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = marked(rows, checkpointed(bitmap(pairs, "_len", "_prefix")), "_len", "_prefix")
    # Step 3: whole texts of what survives, read where they lie. The rows that go on are narrow, and are written once.
    rows = rows.withColumn("_full", F.when(F.col("_prefix").isNotNull() & F.col("_alive"), F.sha2(ascii_lower(F.col("_text")), 256))).drop("_text", "_alive", "_prefix")
    rows = checkpointed(rows)
    groups = rows.where(F.col("_full").isNotNull()).groupBy("_len", "_full").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size")).where("_size > 1")
    # Rows without a digest get a key of their own: a shared null would send them all to one task.
    spread = F.coalesce(F.col("_full"), F.concat(F.lit("-"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    out = rows.withColumn("_full", spread).join(lookup(groups), ["_len", "_full"], "left")
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce(F.col("_size"), F.lit(1)).cast("long").alias("group_size"),
        (F.col("_id").eqNullSafe(keep)).alias("kept"),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
    )
