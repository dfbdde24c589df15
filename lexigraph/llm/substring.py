"""Substring dedup by line or paragraph hashing.

A text is cut at line ends, and within lines at sentence ends (or at blank lines, for paragraphs); a piece of
fewer than MIN_UNIT words goes with what follows it. Units are normalised and hashed, digests are grouped
globally, and the occurrence that comes first by (id, place) stays. Where later occurrences stand side by
side and make a passage of MIN_WORDS words or more, the passage is removed; the result tells where it lay in
the original text, in code points. So a passage is found wherever it begins in a line, and a short stock line
that recurs by itself is left alone.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bitmap, checkpointed, lookup, marked

#: A piece with fewer words is no unit of its own: it recurs by chance.
MIN_UNIT = 5
#: Words of the shortest passage that is removed. One of fifty words or more has as many in whole sentences,
#: even if it begins and ends amid sentences of its surroundings.
MIN_WORDS = 25
BREAKS = {"line": re.compile(r"[.!?][ \t]+|[。！？\n]"), "paragraph": re.compile(r"\n[^\S\n]*\n\s*")}
#: Letters of scripts that are written without spaces: two count as a word. Fixed ranges of Unicode blocks.
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]")
EDGES = " \t\n"


def size(text: str, words: int) -> int:
    return words if text.isascii() else words + len(UNSPACED.findall(text)) // 2


def pieces(text: str, unit: str = "line") -> list[tuple[int, int, int, str]]:
    """(start, end, size, normal form) of the units of `text`, which tile it; a unit ends with the break after it."""
    out: list[tuple[int, int, int, str]] = []
    begin = at = held = 0
    words: list[str] = []
    for cut in [*[m.end() for m in BREAKS[unit].finditer(text)], len(text)]:
        piece = text[at:cut].lower()
        own = piece.split()
        words += own
        n = size(piece, len(own))
        held += n
        at = cut
        if n >= MIN_UNIT or (cut == len(text) and begin < cut):
            out.append((begin, cut, held, " ".join(words)))
            begin, held, words = cut, 0, []
    return out


def digest(normal: str) -> tuple[int, int]:
    found = hashlib.blake2b(normal.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(found[:8], "big", signed=True), int.from_bytes(found[8:], "big", signed=True)


def passages(units: list[tuple[int, int, int, str]], later: set[int], min_words: int) -> list[tuple[int, int]]:
    """First and last unit of each run of units in `later` that has `min_words` or more."""
    out, first, held = [], 0, 0
    for k in range(len(units) + 1):
        if k in later:
            first = k if not held else first
            held += units[k][2]
        else:
            if held >= min_words:
                out.append((first, k - 1))
            held = 0
    return out


def without(text: str, units: list[tuple[int, int, int, str]], found: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """`text` without the runs in `found` and the breaks after them, and where they lay, without the white space at their ends."""
    out, spans, at = [], [], 0
    for a, b in found:
        start, end = units[a][0], units[b][1]
        own = text[start:end]
        out.append(text[at:start])
        spans.append((start + len(own) - len(own.lstrip(EDGES)), start + len(own.rstrip(EDGES))))
        at = end
    return "".join([*out, text[at:]]), spans


def units(df: DataFrame, id_col: str, text_col: str, unit: str) -> DataFrame:
    """(id, place, high, low): the units of each text that are not empty, with 128 bits of digest."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key is not None and text:
                    rows += [(key, k, *digest(u[3])) for k, u in enumerate(pieces(text, unit)) if u[2]]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["id", "place", "high", "low"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, place int, high long, low long")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of `df`: ``id_col, text, n_removed, removed``.

    `removed` lists the (start, end) of the passages taken out of the original text, in order, and n_removed
    counts them. A unit is equal to another after lower-casing and collapsing white space. A null text stays
    null, an empty one empty; a row with a null id keeps all its units and is no earlier occurrence for
    others. Rows that repeat an id share one rank, so equal units of theirs in one place are tied and all
    stay, if first. Other columns are not read. An empty table gives an empty result.
    """
    found = units(df, id_col, text_col, unit)
    first = found.groupBy("high", "low").agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Only digests that recur come to the join; they are a table of its own, so that AQE can split a frequent one. A
    # bitmap of theirs keeps most other units from being shuffled.
    first = lookup(first)
    recurring = marked(found, checkpointed(bitmap(first, "high", "low")), "high", "low").where("_alive").drop("_alive")
    later = recurring.join(first, ["high", "low"]).where((F.col("id") != F.col("first.id")) | (F.col("place") != F.col("first.place")))
    by_doc = later.groupBy("id").agg(F.collect_set(F.struct("place", "low")).alias("later"))
    texts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(by_doc, F.col("_id") == F.col("id"), "left").select("_id", "text", "later")

    def cut(batches):
        for batch in batches:
            new, counts, flat, ends = [], [], [], [0]
            for text, later in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans: list[tuple[int, int]] = []
                if later and text:
                    own = pieces(text, unit)
                    # Rows that repeat an id may differ in text: a place counts where the digest is that of this text.
                    gone = {x["place"] for x in later if x["place"] < len(own) and digest(own[x["place"]][3])[1] == x["low"]}
                    text, spans = without(text, own, passages(own, gone, min_words))
                new.append(text)
                counts.append(len(spans))
                flat += [{"start": a, "end": b} for a, b in spans]
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), pa.array(counts, pa.int32()), lists], names=["_id", "text", "n_removed", "removed"])

    out = joined.mapInArrow(cut, "_id long, text string, n_removed int, removed array<struct<start:int,end:int>>")
    return out.withColumnRenamed("_id", id_col) if id_col != "text" else out


_MARK, _WHITE = "chr(1)", "' ' || chr(9) || chr(10)"
ORACLE = rf"""
WITH cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?][ \t]+|[。！？\n])', '\1' || {_MARK}, 'g'), {_MARK}) AS p FROM documents WHERE text <> ''),
piece AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM cut),
sized AS (SELECT *, trim(regexp_replace(lower(piece), '\s+', ' ', 'g')) AS norm, length(regexp_replace(piece, '[^\x{{0e00}}-\x{{0eff}}\x{{1000}}-\x{{109f}}\x{{1780}}-\x{{17ff}}\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}]', '', 'g')) // 2 AS unspaced FROM piece),
counted AS (SELECT *, CASE WHEN norm = '' THEN 0 ELSE length(norm) - length(replace(norm, ' ', '')) + 1 END + unspaced AS n FROM sized),
grouped AS (SELECT *, coalesce(sum(CASE WHEN n >= {MIN_UNIT} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM counted WHERE piece <> ''),
unit AS (SELECT doc_id, place, string_agg(piece, '' ORDER BY k) AS unit, CAST(sum(n) AS BIGINT) AS words, string_agg(norm, ' ' ORDER BY k) FILTER (WHERE norm <> '') AS norm FROM grouped GROUP BY ALL),
placed AS (SELECT *, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY place) - length(unit) AS start,
  coalesce(words > 0 AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, place) > 1, false) AS later FROM unit),
runs AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, later ORDER BY place) AS run FROM placed),
passage AS (SELECT doc_id, run, string_agg(unit, '' ORDER BY place) AS body, min(start) AS start FROM runs WHERE later GROUP BY ALL HAVING sum(words) >= {MIN_WORDS}),
gone AS (SELECT doc_id, count(*) AS n, string_agg(CAST(start + length(body) - length(ltrim(body, {_WHITE})) AS BIGINT) || '-' || CAST(start + length(rtrim(body, {_WHITE})) AS BIGINT), ';' ORDER BY start) AS spans FROM passage GROUP BY doc_id),
kept AS (SELECT r.doc_id, string_agg(unit, '' ORDER BY place) AS text FROM runs r ANTI JOIN (SELECT doc_id, run, true AS later FROM passage) p ON r.doc_id = p.doc_id AND r.run = p.run AND r.later = p.later GROUP BY r.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(g.n, 0) AS INT) AS n_removed, coalesce(g.spans, '') AS removed_spans
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN gone g USING (doc_id)
"""
