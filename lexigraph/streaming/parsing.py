"""Parsing streams of documents, and ontology updates that arrive as a stream.

Parsing a document depends on nothing but the document, so a stream needs no state and no watermark: the
same column function runs over each micro-batch, and a batch job over the same rows gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import parser
from ..plans.ontology import Ontology


def parse_stream(docs: DataFrame, ontology: Ontology, text_col: str = "text", line_breaks: str = "ignore", entities_only: bool = True, failfast: bool = False) -> DataFrame:
    """`docs`, batch or streaming, with ``parsed``; an error is that row's, or the query's if `failfast`."""
    parse = parser(docs.sparkSession, ontology.index, line_breaks=line_breaks, entities_only=entities_only, failfast=failfast)
    return docs.withColumn("parsed", parse(F.col(text_col)))


class LiveOntology:
    """An ontology that a stream of updates (``subject``, ``turtle``, null to remove) replaces batch by batch.

    Documents are parsed in `foreachBatch`, each batch by the version that holds when it starts; a
    version is never changed, so a batch that runs again after a failure may see a later one, but never half of one.
    """

    def __init__(self, ontology: Ontology):
        self.ontology, self.version = ontology, 0

    def apply(self, batch: DataFrame, _: int) -> None:
        """For `foreachBatch` of the update stream; a batch is applied whole or not at all."""
        rows = batch.select("subject", "turtle").collect()  # a batch of edits by hand, not of data
        last = {r["subject"]: r["turtle"] for r in rows}
        if last:
            replace = {s: t for s, t in last.items() if t is not None}
            updated = self.ontology.update(replace, [s for s, t in last.items() if t is None])
            self.ontology, self.version = updated, self.version + 1

    def parse_with(self, sink: Callable[[DataFrame, int], None], **options) -> Callable[[DataFrame, int], None]:
        """For `foreachBatch` of the document stream: parses by the current version and hands on to `sink`."""
        return lambda batch, n: sink(parse_stream(batch, self.ontology, **options).withColumn("version", F.lit(self.version)), n)
