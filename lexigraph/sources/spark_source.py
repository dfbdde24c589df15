"""Ontology files as triples tables.

`read_triples` gets whole files through Spark's own reader, so any store that Spark opens will do: one
task per file, since the grammars cannot be split. `register` adds the formats ``turtle``,
``ontology-json`` and ``ontology-jsonl`` for paths that executors can open themselves.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import EngineError
from ..plans.graph import SCHEMA
from ..plans.storage import spread
from . import reader
from .rdf import MAX_BYTES, Graph

#: Triples from which a batch is passed on.
BATCH = 10_000

FORMATS = {"turtle": "turtle", "ontology-json": "json", "ontology-jsonl": "jsonl"}


def rows_of(graph: Graph, source_ord: int = 0) -> Iterator[tuple]:
    for i, (s, p, o) in enumerate(graph):
        yield source_ord, i, s.value, s.kind, p.value, o.value, o.kind, o.datatype, o.language


def parse(data: bytes, format: str | None, path: str) -> Graph:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        raise EngineError(2, f"{path} is not valid UTF-8") from None
    found = reader.read_source(text, format, path)
    if not isinstance(found, Graph):
        raise EngineError(2, f"{path} is a snapshot, not a source of triples")
    return found


def read_triples(spark: SparkSession, paths: str | list[str], format: str | None = None) -> DataFrame:
    """(path, and the columns of a triples table) of all files; `ord` counts within a file.

    Blank nodes are told apart by file only by `path`; `plans.graph.merge` names them apart. A file of
    more than MAX_BYTES is an error, raised without reading its content.
    """

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    raise EngineError(2, f"Source exceeds 256 MiB input limit: {path}")
                columns = list(zip(*rows_of(parse(data, format, path)), strict=True)) or [()] * 9
                n = len(columns[0])
                types = [pa.int32(), pa.int64(), *[pa.string()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["path", *[x.split()[0] for x in SCHEMA.split(", ")]])

    files = spark.read.format("binaryFile").load(paths)
    large = files.where(F.col("length") > MAX_BYTES).select("path", F.lit(None).cast("binary").alias("content"))
    return files.where(F.col("length") <= MAX_BYTES).select("path", "content").union(large).mapInArrow(run, f"path string, {SCHEMA}")


def triples_of(df: DataFrame, id_col: str, text_col: str, format: str | None = None, base: str = "") -> DataFrame:
    """(id_col, and the columns of a triples table) of a column of sources; a null source states nothing."""

    types = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 7]
    names = ["_id", *[x.split()[0] for x in SCHEMA.split(", ")]]

    def of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Graph() if text is None else reader.read_source(text, format, base)
                if not isinstance(found, Graph):
                    raise EngineError(2, "A snapshot is not a source of triples")
                rows += ((key, *r) for r in rows_of(found))
                if len(rows) >= BATCH:  # small sources share a batch
                    yield of(rows)
                    rows = []
        if rows:
            yield of(rows)

    rows = spread(df).select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"_id string, {SCHEMA}").withColumn("_id", F.col("_id").cast(df.schema[id_col].dataType)).withColumnRenamed("_id", id_col)


class _File(InputPartition):
    def __init__(self, path: str, ordinal: int):
        self.path, self.ordinal = path, ordinal


class _Reader(DataSourceReader):
    def __init__(self, path: str, format: str):
        self.path, self.format = path, format

    def partitions(self) -> list[_File]:
        names = sorted(glob.glob(os.path.join(self.path, "*")) if os.path.isdir(self.path) else glob.glob(self.path))
        if not names:
            raise EngineError(2, f"Cannot read {self.path}")
        return [_File(n, i) for i, n in enumerate(names)]

    def read(self, partition: _File) -> Iterator[tuple]:
        graph = reader.read_source(reader.read_file(partition.path), self.format, reader.file_base(partition.path))
        yield from rows_of(graph, partition.ordinal)


def _source(name: str, format: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options["path"], format)

    return Source


def register(spark: SparkSession) -> None:
    for name, format in FORMATS.items():
        spark.dataSource.register(_source(name, format))
