"""Ontologies made of relational tables: geography of region and nation, catalogue of part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rdf import OWL, RDF, RDFS, SKOS
from .graph import facts, stated
from .storage import checkpointed, spread

GEO, CAT, TRADE = "http://example.org/geo#", "http://example.org/cat#", "http://example.org/trade#"


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples: nations below regions below the world, with labels, synonyms and tags."""
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    r = F.concat(F.lit(GEO), F.replace("r_name", F.lit(" "), F.lit("_")))
    n = F.concat(F.lit(GEO), F.col("n_name"))
    label = F.lower(F.replace("n_name", F.lit("_"), F.lit(" ")))
    ro, no = F.col("r_regionkey") * 10, F.col("n_nationkey") * 10 + 1000
    up = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    world = spark.range(1)
    return _all([
        facts(world, F.lit(GEO + "World"), RDF + "type", F.lit(OWL + "Class"), "iri", F.lit(-2)),
        facts(world, F.lit(GEO + "World"), RDFS + "label", F.lit("World"), "literal", F.lit(-1)),
        facts(region, r, RDF + "type", F.lit(OWL + "Class"), "iri", ro),
        facts(region, r, RDFS + "label", F.col("r_name"), "literal", ro + 1),
        facts(region, r, RDFS + "subClassOf", F.lit(GEO + "World"), "iri", ro + 2),
        facts(region, r, OWL + "backwardCompatibleWith", F.lit("region"), "literal", ro + 3),
        facts(nation, n, RDF + "type", F.lit(OWL + "Class"), "iri", no),
        facts(nation, n, RDFS + "label", label, "literal", no + 1),
        facts(nation, n, SKOS + "altLabel", F.concat(F.lit("the territory of "), label), "literal", no + 2),
        facts(nation, n, RDFS + "seeAlso", F.concat(F.lit("land+"), F.col("n_nationkey").cast("string")), "literal", no + 3),
        facts(up, n, RDFS + "subClassOf", r, "iri", no + 4),
        facts(nation, n, OWL + "backwardCompatibleWith", F.lit("nation"), "literal", no + 5),
    ])


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples: products, the distinct part names, below their nouns below goods, with synonyms and custom predicates."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    # Written once: parts are read and grouped by one job, not by each kind of fact.
    product = checkpointed(part.groupBy("p_name").agg(F.min("p_partkey").alias("k"))).withColumn("a", F.split_part("p_name", F.lit(" "), F.lit(1))).withColumn("n", F.split_part("p_name", F.lit(" "), F.lit(2)))
    noun = product.groupBy("n").agg(F.min("k").alias("k"))
    s, below = F.concat(F.lit(CAT), F.replace("p_name", F.lit(" "), F.lit("_"))), F.concat(F.lit(CAT), "n")
    twin = product.where("a = 'new'")
    o, no = F.col("k") * 10, F.col("k") * 10 - 10_000_000_000
    return _all([
        facts(spark.range(1), F.lit(CAT + "goods"), RDFS + "label", F.lit("goods"), "literal", F.lit(-20_000_000_000)),
        facts(noun, below, RDF + "type", F.lit(OWL + "Class"), "iri", no),
        facts(noun, below, RDFS + "label", F.col("n"), "literal", no + 1),
        facts(noun, below, RDFS + "subClassOf", F.lit(CAT + "goods"), "iri", no + 2),
        facts(noun, below, OWL + "backwardCompatibleWith", F.lit("product"), "literal", no + 3),
        facts(product, s, RDF + "type", F.lit(OWL + "Class"), "iri", o),
        facts(product, s, RDFS + "label", F.col("p_name"), "literal", o + 1),
        facts(product, s, SKOS + "altLabel", F.concat("n", F.lit(", "), "a"), "literal", o + 2),
        facts(product, s, RDFS + "subClassOf", below, "iri", o + 3),
        facts(product, s, CAT + "requires", F.concat(F.lit(CAT), "a"), "iri", o + 4),
        facts(product, s, CAT + "similarTo", F.concat(F.lit(CAT + "old_"), "n"), "iri", o + 5),
        facts(twin, s, OWL + "equivalentClass", F.concat(F.lit(CAT + "old_"), "n"), "iri", o + 6),
        facts(product, s, RDFS + "comment", F.concat(F.lit("part "), F.col("k").cast("string")), "literal", o + 7),
    ])


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples that grow with the data: suppliers below nations, customers as individuals of nations, and blank nodes."""
    region, nation, supplier, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "supplier", "customer"))
    # A file of one row group would be one task here, and one in each step that follows.
    supplier, customer = spread(supplier.select("s_suppkey", "s_nationkey")), spread(customer.select("c_custkey", "c_nationkey"))
    iri = lambda kind, key: F.concat(F.lit(f"{TRADE}{kind}_"), F.col(key).cast("string"))
    said = lambda kind, key: F.concat(F.lit(f"{kind} "), F.col(key).cast("string"))
    r, n, s, c = iri("region", "r_regionkey"), iri("nation", "n_nationkey"), iri("supplier", "s_suppkey"), iri("customer", "c_custkey")
    ro, no, so, co = F.col("r_regionkey") * 10, F.col("n_nationkey") * 20 + 1000, F.col("s_suppkey") * 20 + 1_000_000_000, F.col("c_custkey") * 20 + 10**15
    up = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    b, d = iri("b", "n_nationkey"), iri("d", "n_nationkey")
    blank = lambda df, *ends: df.withColumns({k: F.concat(F.lit("_:"), F.substring_index(e, "#", -1)) for e, k in ((x, x) for x in ends)} | {f"{e}_kind": F.lit("blank") for e in ends})
    return _all([
        facts(region, r, RDF + "type", F.lit(OWL + "Class"), "iri", ro),
        facts(region, r, RDFS + "label", said("region", "r_regionkey"), "literal", ro + 1),
        facts(nation, n, RDF + "type", F.lit(OWL + "Class"), "iri", no),
        facts(nation, n, RDFS + "label", said("Nation", "n_nationkey"), "literal", no + 1),
        facts(nation, n, RDFS + "subClassOf", iri("region", "n_regionkey"), "iri", no + 2),
        blank(facts(nation, n, OWL + "disjointWith", b, "iri", no + 3), "o"),
        blank(facts(nation, b, RDF + "first", said("Mark", "n_nationkey"), "literal", no + 4), "s"),
        blank(facts(nation, b, RDF + "rest", d, "iri", no + 5), "s", "o"),
        blank(facts(nation, d, RDF + "first", iri("region", "n_regionkey"), "iri", no + 6), "s"),
        stated(supplier, s, so, (RDF + "type", F.lit(OWL + "Class"), "iri"), (RDFS + "label", said("supplier", "s_suppkey"), "literal"), (RDFS + "subClassOf", iri("nation", "s_nationkey"), "iri")),
        facts(up, s, TRADE + "implies", iri("region", "n_regionkey"), "iri", so + 3),
        stated(supplier, s, so + 4, (TRADE + "uses", iri("nation", "s_nationkey"), "iri"), (TRADE + "effects", said("Effect", "s_suppkey"), "literal")),
        stated(customer, c, co, (RDF + "type", F.lit(OWL + "NamedIndividual"), "iri"), (RDF + "type", iri("nation", "c_nationkey"), "iri"), (RDFS + "label", said("customer", "c_custkey"), "literal")),
    ])


_T = "ord, s, p, o, o_kind"

#: The same triples in SQL, as common table expressions `geo` and `cat` of (ord, s, p, o, o_kind).
GEO_SQL = f"""geo({_T}) AS (
  SELECT CAST(ord AS BIGINT), s, p, o, o_kind FROM (
  SELECT -2 AS ord, '{GEO}World' AS s, '{RDF}type' AS p, '{OWL}Class' AS o, 'iri' AS o_kind UNION ALL SELECT -1, '{GEO}World', '{RDFS}label', 'World', 'literal'
  UNION ALL SELECT r_regionkey * 10, '{GEO}' || replace(r_name, ' ', '_'), '{RDF}type', '{OWL}Class', 'iri' FROM region
  UNION ALL SELECT r_regionkey * 10 + 1, '{GEO}' || replace(r_name, ' ', '_'), '{RDFS}label', r_name, 'literal' FROM region
  UNION ALL SELECT r_regionkey * 10 + 2, '{GEO}' || replace(r_name, ' ', '_'), '{RDFS}subClassOf', '{GEO}World', 'iri' FROM region
  UNION ALL SELECT r_regionkey * 10 + 3, '{GEO}' || replace(r_name, ' ', '_'), '{OWL}backwardCompatibleWith', 'region', 'literal' FROM region
  UNION ALL SELECT n_nationkey * 10 + 1000, '{GEO}' || n_name, '{RDF}type', '{OWL}Class', 'iri' FROM nation
  UNION ALL SELECT n_nationkey * 10 + 1001, '{GEO}' || n_name, '{RDFS}label', lower(replace(n_name, '_', ' ')), 'literal' FROM nation
  UNION ALL SELECT n_nationkey * 10 + 1002, '{GEO}' || n_name, '{SKOS}altLabel', 'the territory of ' || lower(replace(n_name, '_', ' ')), 'literal' FROM nation
  UNION ALL SELECT n_nationkey * 10 + 1003, '{GEO}' || n_name, '{RDFS}seeAlso', 'land+' || n_nationkey, 'literal' FROM nation
  UNION ALL SELECT n_nationkey * 10 + 1004, '{GEO}' || n_name, '{RDFS}subClassOf', '{GEO}' || replace(r_name, ' ', '_'), 'iri' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT n_nationkey * 10 + 1005, '{GEO}' || n_name, '{OWL}backwardCompatibleWith', 'nation', 'literal' FROM nation))"""
CAT_SQL = f"""product AS (SELECT p_name, min(p_partkey) AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS n FROM part GROUP BY p_name),
noun AS (SELECT n, min(k) AS k FROM product GROUP BY n),
cat({_T}) AS (
  SELECT CAST(ord AS BIGINT), s, p, o, o_kind FROM (
  SELECT -20000000000 AS ord, '{CAT}goods' AS s, '{RDFS}label' AS p, 'goods' AS o, 'literal' AS o_kind
  UNION ALL SELECT k * 10 - 10000000000, '{CAT}' || n, '{RDF}type', '{OWL}Class', 'iri' FROM noun
  UNION ALL SELECT k * 10 - 10000000000 + 1, '{CAT}' || n, '{RDFS}label', n, 'literal' FROM noun
  UNION ALL SELECT k * 10 - 10000000000 + 2, '{CAT}' || n, '{RDFS}subClassOf', '{CAT}goods', 'iri' FROM noun
  UNION ALL SELECT k * 10 - 10000000000 + 3, '{CAT}' || n, '{OWL}backwardCompatibleWith', 'product', 'literal' FROM noun
  UNION ALL SELECT k * 10, '{CAT}' || replace(p_name, ' ', '_'), '{RDF}type', '{OWL}Class', 'iri' FROM product
  UNION ALL SELECT k * 10 + 1, '{CAT}' || replace(p_name, ' ', '_'), '{RDFS}label', p_name, 'literal' FROM product
  UNION ALL SELECT k * 10 + 2, '{CAT}' || replace(p_name, ' ', '_'), '{SKOS}altLabel', n || ', ' || a, 'literal' FROM product
  UNION ALL SELECT k * 10 + 3, '{CAT}' || replace(p_name, ' ', '_'), '{RDFS}subClassOf', '{CAT}' || n, 'iri' FROM product
  UNION ALL SELECT k * 10 + 4, '{CAT}' || replace(p_name, ' ', '_'), '{CAT}requires', '{CAT}' || a, 'iri' FROM product
  UNION ALL SELECT k * 10 + 5, '{CAT}' || replace(p_name, ' ', '_'), '{CAT}similarTo', '{CAT}old_' || n, 'iri' FROM product
  UNION ALL SELECT k * 10 + 6, '{CAT}' || replace(p_name, ' ', '_'), '{OWL}equivalentClass', '{CAT}old_' || n, 'iri' FROM product WHERE a = 'new'
  UNION ALL SELECT k * 10 + 7, '{CAT}' || replace(p_name, ' ', '_'), '{RDFS}comment', 'part ' || k, 'literal' FROM product))"""


def _stated(select: str, order: str, s: str, p: str, o: str, kind: str = "iri") -> str:
    return f"SELECT {order} AS ord, {s} AS s, '{p}' AS p, {o} AS o, '{kind}' AS o_kind {select}"


def _trade_sql() -> str:
    iri = lambda kind, key: f"'{TRADE}{kind}_' || {key}"
    ro, no, so, co = "r_regionkey * 10", "n_nationkey * 20 + 1000", "s_suppkey * 20 + 1000000000", "c_custkey * 20 + 1000000000000000"
    r, n, s, c = iri("region", "r_regionkey"), iri("nation", "n_nationkey"), iri("supplier", "s_suppkey"), iri("customer", "c_custkey")
    cls, b, d = f"'{OWL}Class'", "'_:b_' || n_nationkey", "'_:d_' || n_nationkey"
    rows = [
        ("FROM region", ro, r, RDF + "type", cls), ("FROM region", ro + " + 1", r, RDFS + "label", "'region ' || r_regionkey", "literal"),
        ("FROM nation", no, n, RDF + "type", cls), ("FROM nation", no + " + 1", n, RDFS + "label", "'Nation ' || n_nationkey", "literal"),
        ("FROM nation", no + " + 2", n, RDFS + "subClassOf", iri("region", "n_regionkey")), ("FROM nation", no + " + 3", n, OWL + "disjointWith", b, "blank"),
        ("FROM nation", no + " + 4", b, RDF + "first", "'Mark ' || n_nationkey", "literal"), ("FROM nation", no + " + 5", b, RDF + "rest", d, "blank"),
        ("FROM nation", no + " + 6", d, RDF + "first", iri("region", "n_regionkey")),
        ("FROM supplier", so, s, RDF + "type", cls), ("FROM supplier", so + " + 1", s, RDFS + "label", "'supplier ' || s_suppkey", "literal"),
        ("FROM supplier", so + " + 2", s, RDFS + "subClassOf", iri("nation", "s_nationkey")),
        ("FROM supplier JOIN nation ON s_nationkey = n_nationkey", so + " + 3", s, TRADE + "implies", iri("region", "n_regionkey")),
        ("FROM supplier", so + " + 4", s, TRADE + "uses", iri("nation", "s_nationkey")), ("FROM supplier", so + " + 5", s, TRADE + "effects", "'Effect ' || s_suppkey", "literal"),
        ("FROM customer", co, c, RDF + "type", f"'{OWL}NamedIndividual'"), ("FROM customer", co + " + 1", c, RDF + "type", iri("nation", "c_nationkey")),
        ("FROM customer", co + " + 2", c, RDFS + "label", "'customer ' || c_custkey", "literal"),
    ]
    return f"trade({_T}) AS (SELECT CAST(ord AS BIGINT), s, p, o, o_kind FROM (" + " UNION ALL ".join(_stated(*x) for x in rows) + "))"


TRADE_SQL = _trade_sql()
