"""Language identification by compression.

A text is compressed once per language with zstandard, block by block, each time with a raw-content
dictionary of that language; the language that gives the smallest size wins. Narrow margins are rejected.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Bounds of the sample from which the dictionaries are made: documents and bytes of each language, characters of a document.
SAMPLE_DOCS, DICT_BYTES, SAMPLE_CHARS = 400, 112_000, 20_000
#: Labels beyond which `train` refuses: the column is no column of languages then.
MOST_LANGS = 1024
LEVEL = 9
#: A text is compressed in blocks of this many bytes, each from the dictionaries anew, so that they help its end as much as its beginning.
BLOCK = 32_768
LETTER = re.compile(r"[^\W\d_]")
LEARNED = "doc_id long, lang_pred string, score double, margin double"


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary per language, from a bounded sample of `labelled`.

    Rows with a null language, or a null or blank text, teach nothing. Of each language, about
    SAMPLE_DOCS documents are drawn by a hash of the id, of each at most SAMPLE_CHARS characters, in a
    longer one from a place that the hash names; they are joined up to DICT_BYTES, by a task for each
    language. Every language is learned, the most frequent one first; more than MOST_LANGS are an error.
    Only the dictionaries reach the driver.
    """
    order = F.xxhash64(F.lit("langid"), F.col(id_col))
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(F.trim(F.col(text_col))) > 0))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), order.alias("o"), F.col(text_col).cast("string").alias("text"))
    sizes = dict(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS + 1).collect())
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, SAMPLE_DOCS / n))])
    drawn = rows.where((F.pmod("o", F.lit(1 << 30)) / float(1 << 30)) < F.try_element_at(share, F.col("lang")))
    start = F.pmod(F.shiftrightunsigned("o", 31), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1)
    drawn = drawn.select("lang", "o", F.substring(F.col("text"), (start + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))

    def join(group: pa.Table) -> pa.Table:
        data = b""
        for _, text in sorted(zip(group.column("o").to_pylist(), group.column("text").to_pylist(), strict=True)):
            more = text.lower().encode("utf-8", "surrogatepass")
            if data and len(data) + len(more) > DICT_BYTES:
                continue
            data += more[:DICT_BYTES] + b"\n"
        return pa.table({"lang": pa.array([group.column("lang")[0].as_py()], pa.string()), "data": pa.array([data], pa.binary())})

    made = {r["lang"]: bytes(r["data"]) for r in drawn.groupBy("lang").applyInArrow(join, "lang string, data binary").collect()}
    return {lang: made[lang] for lang in sizes if made.get(lang)}


class Classifier:
    """Compressors for the dictionaries; made once in each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.compressors = []
        for lang in self.langs:
            data = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin: the score is the share of the runner-up's size that the best saves."""
        if not self.langs or text is None or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        data = text.lower().encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        best = sizes.index(min(sizes))
        rest = min((x for i, x in enumerate(sizes) if i != best), default=2 * sizes[best])
        margin = (rest - sizes[best]) / max(rest, 1)
        return self.langs[best], max(0.0, min(1.0, margin)), margin


def identify(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = 0.005) -> DataFrame:
    """All columns of `df` and ``lang_pred, score, rejected``; columns of these names are replaced.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text if no
    language was learned. A text is also rejected if its margin is below `min_margin`. Each text is
    compressed to its end, in blocks, and the margin is that of the summed sizes. Ties, as of a few words, go to the most frequent language and have margin 0. Every row gets its
    own answer, repeated ones the same. An empty table gives an empty result.
    """
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "rejected")]
    names = [f"_{i}" for i in range(len(kept))]
    df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])
    at = kept.index(text_col)
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", lang_pred string, score double, rejected boolean"

    def run(batches):
        model = Classifier(dictionaries)
        for batch in batches:
            answers = [model.predict(x) for x in batch.column(at).to_pylist()]
            columns = [pa.array([a[0] for a in answers], pa.string()), pa.array([a[1] for a in answers], pa.float64()), pa.array([a[0] == UNKNOWN or a[2] < min_margin for a in answers], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, "lang_pred", "score", "rejected"])

    out = df.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept, strict=True)], "lang_pred", "score", "rejected")


def remainder(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % n
