"""Matching plain phrases with joins: the same result as the kernel where matches cannot nest.

A phrase is found by the key of its first words, and then compared whole, so that a document makes at
most KEY rows per token, however long the phrases are. The vocabulary may be larger than memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import term_phrases, visible

KEY = 3
#: A vocabulary of this many phrases or fewer is broadcast.
BROADCAST_PHRASES = 100_000


def phrase_table(terms: DataFrame, id_col: str = "term", text_col: str = "text") -> DataFrame:
    """(term, words, n, key): the word runs that match terms without plus signs.

    Of terms with an equal run, one that is written so comes before one that only reads so (without its
    accents, say), then the longer, then the smaller id.
    """
    rows = terms.select(F.col(id_col).alias("term"), F.explode(term_phrases(F.col(text_col))).alias("p"))
    rows = rows.groupBy("p.words").agg(F.min_by("term", F.struct("p.alias", -F.col("p.length"), "term")).alias("term"))
    return rows.select("term", "words", F.size("words").alias("n"), F.array_join(F.slice("words", 1, KEY), " ").alias("key"))


def find_phrases(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_breaks: str = "ignore", places: bool = False) -> DataFrame:
    """(id_col, term, x, y) of matches that do not overlap: those of most words first, then the leftmost.

    With `places`, also pos and n: the place of a match's first word among those of its text, and how many it has.
    """
    fields = ["term", "x", "y", *(("pos", "n") if places else ())]
    scanned = lambda rows: rows.select(F.col(id_col), visible(F.col(text_col)).alias("w")).select(id_col, "w.*").where(F.size("words") > 0)
    texts = scanned(docs)
    # Only (id, place, key) goes through the join; documents with a hit are then compared whole.
    # Keys of a size are made only if some phrase has one: at most KEY sizes come to the driver.
    sizes = [r[0] for r in phrases.select(F.least(F.lit(KEY), "n")).distinct().collect()]
    keyed = None
    for k in sorted(sizes):
        runs = texts.where(F.size("words") >= k)
        keys = F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: F.concat_ws(" ", *[F.get("words", i + j) for j in range(k)]))  # noqa: B023  (a slice would copy the whole array each time)
        part = runs.select(id_col, F.posexplode(keys if k > 1 else F.col("words")).alias("pos", "key"))
        keyed = part if keyed is None else keyed.unionByName(part)
    if keyed is None:
        return texts.select(id_col, *[F.lit(0).alias(f) for f in fields]).limit(0)
    if phrases.limit(BROADCAST_PHRASES + 1).count() <= BROADCAST_PHRASES:
        phrases = F.broadcast(phrases)
    hits = keyed.join(phrases.withColumnRenamed("words", "phrase"), "key").select(id_col, "pos", "n", "term", "phrase")
    # Only documents with a hit are scanned again.
    hits = hits.join(scanned(docs.join(hits.select(id_col).distinct(), id_col, "left_semi")), id_col).where(F.slice("words", F.col("pos") + 1, F.col("n")) == F.col("phrase"))
    last = F.col("pos") + F.col("n") - 1
    if line_breaks == "boundary":
        hits = hits.where(F.col("line")[F.col("pos")] == F.col("line")[last])
    hits = hits.select(id_col, F.struct((-F.col("n")).alias("rank"), "pos", "n", "term", F.col("x")[F.col("pos")].alias("x"), F.col("y")[last].alias("y")).alias("h"))
    ranked = hits.groupBy(id_col).agg(F.array_sort(F.collect_list("h")).alias("hits"))
    apart = lambda a, b: (a["pos"] + a["n"] <= b["pos"]) | (b["pos"] + b["n"] <= a["pos"])
    chosen = F.aggregate("hits", F.slice("hits", 1, 0), lambda took, h: F.when(F.forall(took, lambda t: apart(t, h)), F.array_append(took, h)).otherwise(took))
    return ranked.select(id_col, F.explode(chosen).alias("h")).select(id_col, *[f"h.{f}" for f in fields])
