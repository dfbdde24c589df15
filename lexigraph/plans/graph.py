"""Plans over triples: construction, dedup, merge, flattening, predicates and closures.

A triples table has ``source_ord, ord, s, s_kind, p, o, o_kind, o_datatype, o_language``; `ord` is the
order of statement, which later plans use wherever a first or last one counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACES
from ..sources.rdf import OWL, RDF, RDFS, SKOS, Triple
from .storage import checkpointed

SCHEMA = "source_ord int, ord long, s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_language string"
TERM_COLUMNS = ["s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_language"]
_SPACE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES) + "]"
MAX_FLATTEN, MAX_DEPTH = 128, 1024


def from_graph(spark: SparkSession, triples: Iterable[Triple], source_ord: int = 0) -> DataFrame:
    rows = [(source_ord, i, s.value, s.kind, p.value, o.value, o.kind, o.datatype, o.language) for i, (s, p, o) in enumerate(triples)]
    return spark.createDataFrame(rows, SCHEMA)


def facts(df: DataFrame, subject: Column, predicate: str, obj: Column, kind: str, order: Column, datatype: str | None = None) -> DataFrame:
    """A triple for each row of a relational table; rows with a null end have none."""
    null = F.lit(None).cast("string")
    out = df.select(
        F.lit(0).alias("source_ord"), order.cast("long").alias("ord"), subject.cast("string").alias("s"), F.lit("iri").alias("s_kind"), F.lit(predicate).alias("p"),
        obj.cast("string").alias("o"), F.lit(kind).alias("o_kind"), (F.lit(datatype) if datatype else null).alias("o_datatype"), null.alias("o_language"),
    )
    return out.where("s IS NOT NULL AND o IS NOT NULL")


def stated(df: DataFrame, subject: Column, order: Column, *said: tuple[str, Column, str]) -> DataFrame:
    """`facts` of (predicate, object, kind) at places from `order` on, for a table that is read once for all of them."""
    null = F.lit(None).cast("string")
    each = [F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("kind")) for i, (p, o, kind) in enumerate(said)]
    out = df.select(order.cast("long").alias("first"), subject.cast("string").alias("s"), F.explode(F.array(*each)).alias("f")).select(
        F.lit(0).alias("source_ord"), (F.col("first") + F.col("f.i")).alias("ord"), "s", F.lit("iri").alias("s_kind"), "f.p",
        "f.o", F.col("f.kind").alias("o_kind"), null.alias("o_datatype"), null.alias("o_language"),
    )
    return out.where("s IS NOT NULL AND o IS NOT NULL")


def distinct_triples(triples: DataFrame) -> DataFrame:
    """Equal triples once, at their first position; with map-side combine, which dropDuplicates by order has not."""
    keyed = triples.groupBy(*TERM_COLUMNS).agg(F.min(F.struct("source_ord", "ord")).alias("first"))
    return keyed.select("first.source_ord", "first.ord", *TERM_COLUMNS)


def merge(sources: list[DataFrame]) -> DataFrame:
    """Triples of several sources in their order; blank nodes of different sources stay apart."""
    out = None
    for i, t in enumerate(sources):
        scoped = lambda c, k: F.when(F.col(k) == "blank", F.concat(F.lit(f"_:s{i}."), F.substring(F.col(c), 3, 1 << 30))).otherwise(F.col(c))  # noqa: B023, E731
        part = t.select(F.lit(i).alias("source_ord"), "ord", scoped("s", "s_kind").alias("s"), "s_kind", "p", scoped("o", "o_kind").alias("o"), "o_kind", "o_datatype", "o_language")
        out = part if out is None else out.unionByName(part)
    return distinct_triples(out)


def local(iri: Column) -> Column:
    return F.substring_index(iri, "#", -1)


def trimmed(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACES))  # a regular expression would look for the end at each character


def normal(s: Column, lower: bool = True, collapse: bool = False) -> Column:
    s = trimmed(F.lower(s) if lower else s)
    return F.regexp_replace(s, f"{_SPACE}+", " ") if collapse else s


def predicate_key(p: Column) -> Column:
    out = F.when(p.startswith(RDFS), F.lit("rdfs")).when(p.startswith(SKOS), F.lit("skos")).when(p.startswith(OWL), F.lit("owl")).when(p.startswith(RDF), F.lit("rdf")).otherwise(F.lit(""))
    return F.concat(out, F.lit(":"), local(p))


def blank_values(triples: DataFrame) -> DataFrame:
    """(node, path, value): what each blank node flattens to, through all its predicates, in order of `path`."""
    spark = triples.sparkSession
    # Walks go on from blank nodes only, so that each round reads these and not the whole table.
    triples = checkpointed(triples.where("s_kind = 'blank' OR startswith(s, '_:')").select("s", "s_kind", "o", "o_kind", "ord"))
    walks = spark.sql(
        f"""
        WITH RECURSIVE walk(root, path, node, kind, depth) AS (
          SELECT s, array(ord), o, o_kind, 1 FROM {{t}} WHERE s_kind = 'blank'
          UNION ALL
          SELECT w.root, concat(w.path, array(t.ord)), t.o, t.o_kind,
            CASE WHEN w.depth >= {MAX_FLATTEN} THEN CAST(raise_error('Blank node cycle or nesting limit') AS INT) ELSE w.depth + 1 END
          FROM walk w JOIN {{t}} t ON t.s = w.node WHERE w.kind = 'blank')
        SELECT root AS node, path, CASE kind WHEN 'iri' THEN substring_index(node, '#', -1) ELSE node END AS value FROM walk WHERE kind <> 'blank'
        """,
        t=triples,
    )
    with recursion(spark, MAX_FLATTEN + 2):
        return checkpointed(walks)


def flattened(triples: DataFrame, end: str, lower: bool = True, blanks: DataFrame | None = None) -> DataFrame:
    """`triples` with ``{end}_value`` and ``{end}_path``: local names, literals, and the values of blank nodes, one row each."""
    col, kind = F.col(end), F.col(f"{end}_kind")
    plain = triples.where(kind != "blank").withColumn(f"{end}_value", F.when(kind == "iri", local(col)).otherwise(col)).withColumn(f"{end}_path", F.array().cast("array<bigint>"))
    if blanks is not None:
        b = blanks.select(F.col("node").alias(end), F.col("value").alias(f"{end}_value"), F.col("path").alias(f"{end}_path"))
        plain = plain.unionByName(triples.where(kind == "blank").join(b, end))
    return plain.withColumn(f"{end}_value", normal(F.col(f"{end}_value"), lower))


def has_blanks(triples: DataFrame) -> bool:
    return not triples.where("s_kind = 'blank' OR o_kind = 'blank'").isEmpty()


def predicate_map(triples: DataFrame, predicate: str, lower: bool = True, reverse: bool = False) -> DataFrame:
    """(key, values, ord): subjects and their sorted distinct objects for one predicate, or the other way round.

    A value equal to its key, `nil` and the empty string are removed; keys `nil`, `class` and the empty string are dropped.
    """
    rows = triples.where(F.col("p") == predicate)
    blanks = blank_values(triples) if has_blanks(rows) else None
    rows = flattened(flattened(rows, "s", lower, blanks), "o", lower, blanks)
    k, v = ("o_value", "s_value") if reverse else ("s_value", "o_value")
    rows = rows.where(~F.col(k).isin("", "nil", "class"))
    value = F.when((F.col(v) != F.col(k)) & ~F.col(v).isin("", "nil"), F.col(v))
    return rows.groupBy(F.col(k).alias("key")).agg(F.array_sort(F.collect_set(value)).alias("values"), F.min("ord").alias("ord"))


def closure(edges: DataFrame, starts: DataFrame | None = None, tolerant: bool = False, limit: int = MAX_DEPTH) -> DataFrame:
    """(root, node, path, depth): all walks along `edges` (a, b, ord) from each root, `starts` (root) or every `a`.

    Walks are kept one by one, so that a node reached twice stands twice; `path` orders them depth first.
    A cycle ends a walk if `tolerant`, and is an error otherwise, as is a walk longer than `limit`. Where
    only the nodes that are reached count, `reached` does not enumerate walks.

    Edges are written once, so that a step reads a table and not the plan that made them.
    """
    spark = edges.sparkSession
    edges = checkpointed(edges.select("a", "b", "ord"))
    again = "NOT array_contains(w.seen, e.b)" if tolerant else "true"
    check = "w.depth + 1" if tolerant else f"CASE WHEN array_contains(w.seen, e.b) OR w.depth >= {limit} THEN CAST(raise_error('Cycle or depth limit in hierarchy') AS INT) ELSE w.depth + 1 END"
    with recursion(spark, limit + 2):
        return checkpointed(
            spark.sql(
                f"""
        WITH RECURSIVE walk(root, node, path, seen, depth) AS (
          SELECT s.root, e.b, array(e.ord), array(e.a, e.b), 1 FROM {{s}} s JOIN {{e}} e ON e.a = s.root WHERE e.a <> e.b OR {"false" if tolerant else "raise_error('Cycle or depth limit in hierarchy') IS NULL"}
          UNION ALL
          SELECT w.root, e.b, concat(w.path, array(e.ord)), concat(w.seen, array(e.b)), {check}
          FROM walk w JOIN {{e}} e ON e.a = w.node WHERE {again})
        SELECT root, node, path, depth FROM walk
        """,
                e=edges,
                s=starts if starts is not None else edges.select(F.col("a").alias("root")).distinct(),
            )
        )


@contextmanager
def recursion(spark: SparkSession, levels: int, rows: int = 1_000_000_000) -> Iterator[None]:
    """Limits of recursive queries that run within, put back afterwards."""
    wanted = {"spark.sql.cteRecursionLevelLimit": levels, "spark.sql.cteRecursionRowLimit": rows}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, most in wanted.items():
            if int(before[k]) < most:
                spark.conf.set(k, most)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def reached(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(root, node): every node that walks along `edges` (a, b) reach from each root, once; the root itself if a cycle leads back.

    Rounds of joins on what the round before found for the first time: as many as the longest of the shortest
    ways, whatever the number of walks. Cycles need no care.
    """
    edges = checkpointed(edges.select("a", "b").distinct())
    new = edges.select(F.col("a").alias("root"), F.col("b").alias("node"))
    if starts is not None:
        new = new.join(starts.select("root").distinct(), "root", "left_semi")
    found = new = checkpointed(new)
    while not new.isEmpty():
        step = new.join(edges, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct()
        new = checkpointed(step.join(found, ["root", "node"], "left_anti"))
        found = checkpointed(found.union(new))
    return found


def schema_of(triples: DataFrame) -> DataFrame:
    """One row: `schema`, one of SKOS, MIXED, INDIVIDUAL or CLASS_BASED, and `blanks`, whether there are blank nodes."""
    typed = lambda o: F.max(F.when((F.col("p") == RDF + "type") & (F.col("o") == o), 1).otherwise(0))
    blank = F.coalesce(F.bool_or((F.col("s_kind") == "blank") | (F.col("o_kind") == "blank")), F.lit(False))
    flags = triples.agg(typed(SKOS + "Concept").alias("skos"), typed(OWL + "NamedIndividual").alias("named"), F.max(F.when(F.col("p") == RDFS + "subClassOf", 1).otherwise(0)).alias("sub"), blank.alias("blanks"))
    return flags.select(F.when(F.col("skos") == 1, "SKOS").when((F.col("named") == 1) & (F.col("sub") == 1), "MIXED").when(F.col("named") == 1, "INDIVIDUAL").otherwise("CLASS_BASED").alias("schema"), "blanks")
