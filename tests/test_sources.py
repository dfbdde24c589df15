from __future__ import annotations

import pytest

from lexigraph.errors import EngineError
from lexigraph.sources import records, turtle
from lexigraph.sources.rdf import RDF, RDFS, XSD, Term, normalized, resolve
from lexigraph.sources.reader import read_source, sniff

TTL = """
@prefix : <http://e/#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
PREFIX owl: <http://www.w3.org/2002/07/owl#>
# a comment
:Dog a owl:Class ; rdfs:label "dog"@en , 'hound', \"\"\"long "quoted"
line\"\"\" ; rdfs:subClassOf [ owl:someValuesFrom :Tail ; ] ;; :n 1, 1.50, 1e3, true, "a\\u00e9"^^<http://e/t> .
[] :p ( :a "b" ( ) ) .
"""


def test_turtle():
    g = list(turtle.read(TTL))
    assert len(g) == 18
    assert g[0] == (Term("http://e/#Dog", "iri"), Term(RDF + "type", "iri"), Term("http://www.w3.org/2002/07/owl#Class", "iri"))
    objects = [t.object for t in g]
    assert Term("dog", "literal", RDF + "langString", "en") in objects and Term('long "quoted"\nline', "literal") in objects
    assert Term("aé", "literal", "http://e/t") in objects and Term("1000.0", "literal", XSD + "double") in objects
    assert sum(t.predicate.value == RDF + "rest" for t in g) == 3


@pytest.mark.parametrize(
    "text", ["<a> <b>", "@prefix a: <x>", ":a :b :c .", "<a> <b> 'x\ny' .", '<a> "b" <c> .', "<a b> <c> <d> .", "<a> <b> <c> ; .x", "@PREFIX a: <x> .", "<a> <b> '\\q' .", "<a> a ( <b> .", "true <a> <b> .", '<a> <b> "x"@1 .', "<a> <b> <\\u0020> ."]
)
def test_bad_turtle(text):
    with pytest.raises(EngineError) as e:
        turtle.read(text, "http://e/")
    assert e.value.line == text.count("\n", 0, len(text)) + 1 or e.value.line == 1


def test_nesting_is_bounded():
    with pytest.raises(EngineError, match="Nesting"):
        turtle.read("<a> <b> " + "(" * 200 + ")" * 200 + " .", "http://e/")


@pytest.mark.parametrize(
    "reference, resolved",
    [("g", "http://a/b/c/g"), ("./g/.", "http://a/b/c/g/"), ("../g", "http://a/b/g"), ("../../../g", "http://a/g"), ("?y", "http://a/b/c/d;p?y"), ("#", "http://a/b/c/d;p?q#"), ("//g", "http://g"), ("g;x=1/../y", "http://a/b/c/y"), ("", "http://a/b/c/d;p?q"), ("urn:x:y", "urn:x:y"), ("/./g", "http://a/g"), ("..", "http://a/b/")],
)
def test_resolution(reference, resolved):
    assert resolve("http://a/b/c/d;p?q", reference) == resolved


@pytest.mark.parametrize(
    "kind, text, value",
    [("integer", "+007", "7"), ("integer", "-0", "0"), ("integer", "x", "x"), ("decimal", "1.50", "1.50"), ("decimal", "1e2", "100"), ("double", "1E3", "1000.0"), ("double", "1e-7", "1e-07"), ("float", "INF", "inf"), ("boolean", "1", "true"), ("boolean", "no", "false"), ("token", " a\t b ", "a b"), ("hexBinary", "AB", "ab"), ("date", " x ", " x ")],
)
def test_literals(kind, text, value):
    assert normalized(Term(text, "literal", XSD + kind)).value == value


JSON = """[{"namespace":"http://e/#","prefixes":{"x":"http://x/"}},
 {"id":"Dog","type":"owl:Class","label":"dog","synonyms":["canine",{"value":"chien","language":"fr"}],"parents":{"blank":"r"},"requires":"x:Food","properties":{"x:n":{"value":"01","datatype":"xsd:integer"}},"facts":[{"predicate":"rdfs:label","value":"Dog"}]},
 {"subject":{"blank":"r"},"predicate":"rdf:type","object":{"id":"owl:Restriction"}}]"""
LINES = JSON[1:-1].replace("},\n ", "}\n")


def test_records():
    g = list(records.read(JSON))
    assert [t.object.value for t in g][:3] == ["http://www.w3.org/2002/07/owl#Class", "dog", "canine"] and len(g) == 9
    assert list(records.read(LINES, lines=True)) == g
    assert g[6].object == Term("1", "literal", XSD + "integer") and g[5].predicate.value == "http://e/#requires"


@pytest.mark.parametrize(
    "text",
    ['[{"id":"a","id":"b"}]', '[{"id":"a","odd":1}]', '[{"id":"a","label":"x"},]', '[{"id":"a","uses":"b"}]', '[{"id":"a","label":{"id":"x","value":"y"}}]', '[{}]', '[{"id":{"value":"x"},"label":"y"}]', '[{"id":"a","label":1}]', '[{"id":"a b"}]', "[1]", "[] x", '[{"subject":"a","predicate":"b"}]', '[{"id":"a","label":NaN}]'],
)
def test_bad_records(text):
    with pytest.raises(EngineError) as e:
        records.read(text, "http://e/")
    assert e.value.line == 1


def test_blank_lines_are_errors():
    with pytest.raises(EngineError) as e:
        records.read('{"id":"http://e/a"}\n\n{"id":"http://e/b"}', lines=True)
    assert e.value.line == 2


def test_sniffing():
    assert [sniff(x) for x in ("[]", '[ {"id":1}]', "[] a <b> .", '{"id":"a"}\n{"id":"b"}', '{"synonyms":{}}', "@prefix a: <b> .", "﻿[{")] == ["json", "json", "turtle", "jsonl", "snapshot", "turtle", "json"]
    with pytest.raises(EngineError):
        read_source("x", "xml")


def test_prefixes_are_bound_once():
    g = turtle.read("@prefix a: <http://1/> . @prefix a: <http://2/> . @prefix a: <http://1/> . a:x a:y a:z .")
    assert g.prefixes["a"] == "http://1/" and g.prefixes["a1"] == "http://2/" and next(iter(g)).subject.value == "http://1/x"


def test_spark_sources(spark, tmp_path):
    from lexigraph.plans.graph import SCHEMA
    from lexigraph.sources.spark_source import read_triples, register

    (tmp_path / "t").mkdir()
    for i in range(3):
        (tmp_path / "t" / f"{i}.ttl").write_text(f"<http://e/{i}> <{RDFS}label> 'label {i}' .", encoding="utf-8")
    (tmp_path / "r.jsonl").write_text(LINES, encoding="utf-8")
    rows = read_triples(spark, str(tmp_path / "t")).collect()
    assert sorted(r["o"] for r in rows) == ["label 0", "label 1", "label 2"]
    register(spark)
    assert spark.read.format("turtle").option("path", str(tmp_path / "t")).load().count() == 3
    df = spark.read.format("ontology-jsonl").option("path", str(tmp_path / "r.jsonl")).load()
    assert df.count() == 9 and df.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_large_files_are_errors(spark, tmp_path, monkeypatch):
    from lexigraph.sources import spark_source

    (tmp_path / "a.ttl").write_text("<http://e/a> <http://e/p> 'x' .", encoding="utf-8")
    (tmp_path / "b.ttl").write_text("<http://e/b> <http://e/p> 'y' ." + " " * 100, encoding="utf-8")
    assert spark_source.read_triples(spark, str(tmp_path)).count() == 2
    monkeypatch.setattr(spark_source, "MAX_BYTES", 100)
    assert spark_source.read_triples(spark, str(tmp_path / "a.ttl")).count() == 1
    with pytest.raises(Exception, match="Source exceeds 256 MiB input limit"):
        spark_source.read_triples(spark, str(tmp_path)).collect()


def test_small_sources_are_dealt_out(spark):
    """Sources in one partition are read on all cores, null ones state nothing, and those of several batches are all there."""
    from pyspark.sql import functions as F

    from lexigraph.sources.spark_source import triples_of

    df = spark.range(0, 12_000, 1, 1).select("id", F.when(F.col("id") % 100 != 7, F.concat(F.lit("<http://a/"), F.col("id").cast("string"), F.lit("> <http://p> 'x', 'y' ."))).alias("text"))
    t = triples_of(df, "id", "text", "turtle")
    assert t.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    got = t.select("id", "ord", "s", "o").collect()
    assert sorted(map(tuple, got)) == [(i, k, f"http://a/{i}", "xy"[k]) for i in range(12_000) if i % 100 != 7 for k in (0, 1)]
