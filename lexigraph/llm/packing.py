"""Best-fit-decreasing packing of documents into token windows, under conflict constraints.

A bin may hold at most one row of a duplicate cluster and `per_source` rows of a source. Each bin
carries two bitmaps: the sources that are closed to it and the clusters that it has. Bins are kept
by residual; the search for a row's bin starts at the smallest residual that fits and goes on to
the successor until it meets a compatible bin, which is then the tightest one.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces of a shard on average. Shards are packed apart; each leaves at most a few open bins.
SHARD_ROWS = 4000


def pack_rows(sizes, sources, clusters, capacity: int, per_source: int) -> list[list[int]]:
    """Bins as lists of row numbers, for rows in decreasing order of size. Sizes are 1 to capacity.

    Bins of one residual are grouped by both bitmaps, so that a group that conflicts is passed in
    one step, however many bins it has. Clusters of one row need no bit.
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in seen.items() if n > 1)}
    bins: list[list[int]] = []
    counts: list[dict] = []
    residuals: list[int] = []  # sorted, of open bins
    by_residual: dict[int, dict[tuple[int, int], list[int]]] = {}
    for row, (size, source, cluster) in enumerate(zip(sizes, sources, clusters, strict=True)):
        s, c = source_bit[source], cluster_bit.get(cluster, 0)
        found = None
        at = bisect.bisect_left(residuals, size)
        while at < len(residuals) and found is None:
            residual = residuals[at]
            for key, members in by_residual[residual].items():
                if not (key[0] & s or key[1] & c):
                    found = (residual, key, members)
                    break
            at += 1
        if found is None:
            residual, closed, held, b = capacity, 0, 0, len(bins)
            bins.append([])
            counts.append({})
        else:
            residual, key, members = found
            closed, held = key
            b = members.pop()
            if not members:
                del by_residual[residual][key]
                if not by_residual[residual]:
                    del by_residual[residual]
                    residuals.pop(bisect.bisect_left(residuals, residual))
        bins[b].append(row)
        counts[b][s] = counts[b].get(s, 0) + 1
        if counts[b][s] >= per_source:
            closed |= s
        residual -= size
        if residual > 0:
            if residual not in by_residual:
                bisect.insort(residuals, residual)
                by_residual[residual] = {}
            by_residual[residual].setdefault((closed, held | c), []).append(b)
    return bins


def pack(df: DataFrame, capacity: int = 4096, per_source: int = 4, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cluster_col: str | None = None, shard_rows: int = SHARD_ROWS, seed: int = 5) -> DataFrame:
    """One row per bin: ``bin_id, doc_ids, piece_starts, piece_tokens, n_tokens``; the lists run in parallel.

    Tokens are runs of characters other than white space. A text with more tokens than `capacity`
    becomes pieces of `capacity` tokens and a rest; pieces of a text never share a bin. A text
    without a token (null, empty, blank) needs no room and is in no bin. Without `cluster_col`, a
    cluster is a text after lower-casing and collapsing white space, so repeated rows conflict. A
    null source is a source of its own. Rows are spread over shards by a hash of id and piece, so
    no source or cluster can fill a shard, and ties in size go by id, then piece. Other columns are
    not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.md5(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(r"\S+")).alias("n"), F.coalesce(cluster, F.concat(F.lit("null"), F.col(id_col).cast("string"))).alias("cluster")).where("n > 0")
    n_pieces = rows.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    n_shards = max(1, -(-int(n_pieces) // shard_rows))
    pieces = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(capacity)))).select(
        F.pmod(F.xxhash64(F.lit(seed), "id", "start"), F.lit(n_shards)).alias("shard"), "id", "source", "cluster", F.col("start").cast("int"), F.least(F.lit(capacity), F.col("n") - F.col("start")).cast("int").alias("size")
    )

    def pack_shard(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "id", "start", "cluster"], ascending=[False, True, True, True], kind="stable")
        sources = ["\0" if x is None else x for x in group["source"]]
        # Bitmaps of pieces of one text: whole pieces are alike for the cluster, and so never meet.
        bins = pack_rows(group["size"].tolist(), sources, group["cluster"].tolist(), capacity, per_source)
        ids, starts, sizes = (group[c].tolist() for c in ("id", "start", "size"))
        return pd.DataFrame(
            {
                "bin_id": [(int(key[0]) << 32) + i for i in range(len(bins))],
                "doc_ids": [[None if pd.isna(ids[r]) else int(ids[r]) for r in b] for b in bins],
                "piece_starts": [[starts[r] for r in b] for b in bins],
                "piece_tokens": [[sizes[r] for r in b] for b in bins],
                "n_tokens": [sum(sizes[r] for r in b) for b in bins],
            }
        )

    return pieces.groupBy("shard").applyInPandas(pack_shard, "bin_id long, doc_ids array<long>, piece_starts array<int>, piece_tokens array<int>, n_tokens int")
