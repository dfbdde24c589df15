from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexigraph import cli
from lexigraph.engine import Engine
from lexigraph.errors import EngineError
from lexigraph.operators.finder import Finder
from lexigraph.plans import graph
from lexigraph.plans.ontology import Ontology, external_synonyms, trie
from lexigraph.plans.storage import checkpointed
from lexigraph.plans.views import Views, rules_of

PREFIX = "@prefix : <http://e/zoo#> . @prefix zoo: <http://e/zoo#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> ."
ZOO = PREFIX + """
:Animal a owl:Class ; rdfs:label "animal" .
:Dog a owl:Class ; rdfs:label "dog", "Domestic Dog" ; skos:altLabel "canine", "hound" ; rdfs:subClassOf :Animal ; owl:backwardCompatibleWith "animal tag" ; :requires :Bone ; :similarTo :Wolf .
:Wolf a owl:Class ; rdfs:label "wolf" ; skos:altLabel "hound" ; rdfs:subClassOf :Animal ; owl:equivalentClass :Dog .
:Big_Dog a owl:Class ; rdfs:label "big dog" ; rdfs:subClassOf :Dog, [ owl:someValuesFrom :Tail ] ; rdfs:comment "not kept" .
"""


@pytest.fixture(scope="module")
def zoo(spark):
    return Ontology.load(spark, content=ZOO, name="zoo")


@pytest.fixture(scope="module")
def live(spark):
    return Ontology.load(spark, content=ZOO, name="zoo", interface="data")


def answer(o, method, *args, **more):
    return Engine._answer(Finder(o).query(method, *args, **more))


def test_snapshot(zoo):
    s = zoo.snapshot()
    assert s["labels"] == {"Animal": "animal", "Dog": "Domestic Dog", "Wolf": "wolf", "Big_Dog": "big dog"}
    assert s["parents"] == {"Dog": ["Animal"], "Wolf": ["Animal"], "Big_Dog": ["Dog", "Tail"]} and s["children"]["Dog"] == ["Big_Dog"]
    assert s["equivalents"] == {"wolf": ["dog"], "dog": ["wolf"]} and s["predicates"] == [":requires", ":similarTo"]
    assert s["by_predicate"]["rdfs:subClassOf"]["big_dog"] == ["dog", "tail"] and "rdfs:comment" not in s["by_predicate"]
    assert s["synonyms"]["rev"]["hound"] == ["dog", "wolf"] and s["spans"]["big"][0]["content"] == ["dog"]
    assert s["ngrams"]["2"] == ["big_dog"] and s["trie"]["2"] == {"big": ["dog"]}


def test_snapshot_round_trip(spark, zoo, tmp_path):
    zoo.write_snapshot(str(tmp_path / "z.json"))
    again = Ontology.load(spark, path=str(tmp_path / "z.json"))
    assert again.snapshot() == zoo.snapshot() and answer(again, "ancestors", "Big_Dog") == answer(zoo, "ancestors", "Big_Dog")
    with pytest.raises(EngineError):
        again.schema()


def test_stored_finder(zoo):
    assert answer(zoo, "ancestors", "Big_Dog") == ["Dog", "Animal", "Tail"] and answer(zoo, "descendants", "Animal") == ["Dog", "Big_Dog", "Wolf"]
    assert answer(zoo, "parents_and_self", "Dog") == ["Dog", "Animal"] and answer(zoo, "has_ancestor", "Big_Dog", "Animal") and not answer(zoo, "has_parent", "Big_Dog", "Animal")
    assert answer(zoo, "find_canon", "Hound") is None and answer(zoo, "find_canon", "hound") == "dog" and answer(zoo, "find_canon", "Big Dog") == "big_dog"
    assert answer(zoo, "is_variant", "canine") and not answer(zoo, "is_canon", "canine") and answer(zoo, "has_data") == 4
    assert answer(zoo, "requires") == {} and answer(zoo, "requires_by_entity", "dog") == [] and answer(zoo, "ngrams", 2) == [] and not answer(zoo, "entity_exists", "dog")
    assert answer(zoo, "by_predicate", ":requires") == {"dog": ["bone"]} and answer(zoo, "labels_rev")["w"] == ["Wolf"]
    with pytest.raises(EngineError):
        answer(zoo, "equivalents")
    assert answer(zoo, "equivalents", interface="ask_json")["dog"] == ["wolf"]
    with pytest.raises(EngineError):
        answer(zoo, "nonsense")


def test_live_finder(live):
    assert answer(live, "ancestors", "Big Dog") == ["animal", "dog", "tail"] and answer(live, "children_and_self", "dog") == ["big_dog", "dog"]
    assert answer(live, "parents_and_self", "nobody") == [] and answer(live, "types_rev")["animal"] == ["dog", "wolf"]
    assert answer(live, "requires") == {"dog": ["bone"]} and answer(live, "required_by_entity", "Bone") == ["dog"] and answer(live, "similar_by_entity", "wolf") == ["dog"]
    assert answer(live, "find_variants", "hound") == ["dog", "wolf", "hound", "canine", "domestic dog"] and answer(live, "is_canon", "Big Dog")
    assert answer(live, "label_by_entity", "Dog") == "Domestic Dog" and answer(live, "entity_exists", "TAIL") and answer(live, "find_ner") == "NER"
    assert answer(live, "equivalents", ["Dog", "wolf"]) == ["dog", "wolf"] and answer(live, "equivalents", "dog", flat_list=False) == {"dog": ["wolf"]}
    assert answer(live, "ner_taxonomy") == {"ANIMAL TAG": ["ANIMAL TAG"]} and answer(live, "ner_depth")["NER"] == ["0"]
    assert answer(live, "transitive", "big dog", "parents") == ["dog", "tail", "animal"]
    with pytest.raises(EngineError):
        answer(live, "infer_by_requires")


def test_graph_finder(zoo):
    assert answer(zoo, "labels", interface="owl") == ["animal", "dog", "Domestic Dog", "wolf", "big dog"] and answer(zoo, "ancestors", "Big_Dog", interface="owl") == ["Dog", "Animal"]
    assert answer(zoo, "parents", "Big_Dog", interface="owl") == ["Tail", "Dog"] and answer(zoo, "entity_exists", "Wolf", interface="owl")
    assert answer(zoo, "predicates", interface="owl")[""] == ["requires", "similarTo"] and answer(zoo, "by_predicate", "requires", interface="owl") == {"dog": ["bone"]}
    assert answer(zoo, "by_predicate_rev", "rdfs:subClassOf", interface="owl")["animal"] == ["dog", "wolf"]
    with pytest.raises(EngineError):
        answer(zoo, "parents", "a b", interface="owl")


def test_cycles(spark):
    o = Ontology.load(spark, content=PREFIX + ':a rdfs:label "a"; rdfs:subClassOf :b . :b rdfs:label "b"; rdfs:subClassOf :c . :c rdfs:label "c"; rdfs:subClassOf :a .')
    assert answer(o, "ancestors", "a", interface="owl") == ["c", "b", "a"] or answer(o, "ancestors", "a", interface="owl") == ["c", "b"]
    for interface in ("json", "data"):
        with pytest.raises(Exception, match="Cycle"):
            answer(o, "ancestors", "a", interface=interface)


def test_update_equals_fresh_load(spark, zoo):
    dog = "http://e/zoo#Dog"
    new = zoo.update({dog: f'<{dog}> a owl:Class ; rdfs:label "mutt" ; rdfs:subClassOf :Animal .', "http://e/zoo#Cat": '<http://e/zoo#Cat> rdfs:label "cat" .'}, ["http://e/zoo#Wolf"])
    fresh = Ontology.load(
        spark,
        content=PREFIX
        + ':Animal a owl:Class ; rdfs:label "animal" . :Dog a owl:Class ; rdfs:label "mutt" ; rdfs:subClassOf :Animal . :Big_Dog a owl:Class ; rdfs:label "big dog" ; rdfs:subClassOf :Dog, [ owl:someValuesFrom :Tail ] ; rdfs:comment "not kept" . :Cat rdfs:label "cat" .',
        name="zoo",
    )
    assert new.snapshot() == fresh.snapshot() and zoo.snapshot()["labels"]["Dog"] == "Domestic Dog"
    assert zoo.update() is zoo
    for bad in ({dog: "<http://e/zoo#X> a owl:Class ."}, {"Dog": ""}, {dog: f"<{dog}> rdfs:subClassOf [] ."}):
        with pytest.raises(EngineError):
            zoo.update(bad)
    with pytest.raises(EngineError):
        zoo.update({dog: ""}, [dog])


def test_collection(spark, zoo):
    other = Ontology.load(spark, content=PREFIX + ':Canis rdfs:label "canine" . :Dog rdfs:label "pup" ; rdfs:subClassOf [ rdfs:label "x" ] .', name="other")
    both = Ontology.collect([zoo, other])
    assert both.synonyms["rev"]["canine"] == ["dog", "canis"] and both.synonyms["fwd"]["dog"][:2] == ["dog", "hound"]
    assert both.triples.where("s_kind = 'blank'").select("s").distinct().count() == 2
    assert answer(both, "ontologies") == ["zoo", "other"] and [t.canon for t in both.index and __import__("lexigraph.functions.udfs", fromlist=["x"]).parse_text(both.index, "canine") if t.type] == ["dog"]


def test_external_synonyms(spark, tmp_path):
    p = tmp_path / "zoo.ttl"
    p.write_text(ZOO, encoding="utf-8")
    (tmp_path / "zoo.ttl.txt").write_text("# a comment\nDog~pup, good boy\nbroken\n", encoding="utf-8")
    live, stored = (Ontology.load(spark, path=str(p), interface=i) for i in ("data", "json"))
    assert "good boy" in live.synonyms["fwd"]["dog"] and "good boy" not in stored.synonyms["fwd"]["dog"]
    assert external_synonyms("a~b, ccc") == {"a": ["ccc", "b"]} and live.index.live


def test_mixed_and_comma_lists(spark):
    o = Ontology.load(spark, content=PREFIX + ':K rdfs:subClassOf :T ; rdfs:label "k" . :T rdfs:label "t, u" . :x a owl:NamedIndividual, :K ; rdfs:label "x" .', comma_lists=True)
    assert o.schema() == "MIXED" and o.snapshot()["parents"]["x"] == ["K"] and o.snapshot()["children"]["K"] == ["x"]
    assert o.synonyms["fwd"]["t"] == ["t", "u"]
    assert Ontology.load(spark, content=PREFIX + ':T rdfs:label "t, u" .').synonyms["fwd"]["t"] == ["t, u"]


def test_spans_in_frames_match_functions(spark):
    from lexigraph.functions import vocabulary

    raw = {"a_b": ["a b", "x+y z", " pad +q", "a_b c"], "tea": ["c++", "tea a b"], "off_of_x": ["off of x!"]}
    rows = [(c, v, i * 100 + k) for i, (c, vs) in enumerate(raw.items()) for k, v in enumerate(vs)]
    df = rules_of(spark.createDataFrame(rows, "canon string, value string, ord long"))
    got = sorted((r["key"], tuple(r["content"]), r["canon"]) for r in df.collect())
    assert got == sorted((k, tuple(r["content"]), r["canon"]) for k, rs in vocabulary.spans(raw).items() for r in rs)


def test_views_are_made_in_pieces_of_like_size_and_written_once(spark, sf_dir, monkeypatch):
    from lexigraph.functions import vocabulary
    from lexigraph.plans import views
    from lexigraph.plans.vocabularies import trade

    customers = trade(spark, sf_dir).where("s LIKE '%customer_%'").groupBy(F.spark_partition_id()).count()
    assert customers.count() >= spark.sparkContext.defaultParallelism  # was one for each kind of fact, as the file is one row group

    written = []
    monkeypatch.setattr(views, "checkpointed", lambda df: written.append(df.columns) or checkpointed(df))
    table = lambda forward: spark.createDataFrame([(c, vs, i) for i, (c, vs) in enumerate(forward.items())], "canon string, variants array<string>, ord long")
    answer = lambda forward: sorted((r["words"], r["entry"]) for r in views.lookup_of(table(forward)).collect())
    two = {f"n_{i}": [f"n {i}"] for i in range(20)}
    assert answer(two) == sorted((2, f"n {i}") for i in range(20)) and len(written) == 1  # was 4: all entries, once a round

    long = {"x": ["a b c d e f", "a b c d", "a b", "a b c d e"], "y": ["b c d", "za b c q", "of b c d e", "q r s t u v w"], "z_a": ["a b c", "c d e f g", "a b a b", "e", ""]}
    assert answer(long) == sorted((n, e) for n, es in vocabulary.lookup(long).items() for e in es)

    raw = {"a_b": ["a b", "a_b c", "a b +q", "x+y", "x + y"], "c_d": ["a b c d", "c d", " c d"], "e": ["e a b", "e"]}
    rows = [(c, v, i * 100 + k) for i, (c, vs) in enumerate(raw.items()) for k, v in enumerate(vs)]
    written.clear()
    got = views.rules_of(spark.createDataFrame(rows, "canon string, value string, ord long"))
    assert "content" in written[0]  # was in none: rules were made anew to be grouped by their keys
    assert sorted((r["key"], tuple(r["content"]), r["canon"]) for r in got.collect()) == sorted((k, tuple(r["content"]), r["canon"]) for k, rs in vocabulary.spans(raw).items() for r in rs)


def test_white_space_of_columns_is_that_of_functions(spark):
    from lexigraph.functions import text

    odd = ["", " ", "a", "\u2028a b\x85\n", "\u3000\u00e9 \u00a0", "\u200ba\ufeff ", "\ud7ffx\U0001f600\x1c", "a\x00 ", *(f"{c}x{c}y{c}{c}" for c in text.SPACES)]
    df = spark.createDataFrame([(s,) for s in odd], "s string").select("s", graph.trimmed(F.col("s")).alias("t"), graph.normal(F.upper("s"), collapse=True).alias("n"))
    assert all(r["t"] == r["s"].strip(text.SPACES) == text.trim(r["s"]) and r["n"] == text.SPACE_RUN.sub(" ", text.trim(r["s"].upper().lower())) for r in df.collect())
    assert all(text.norm(s, collapse=True) == text.SPACE_RUN.sub(" ", text.trim(s.lower())) for s in odd) and set(text.SPACES) == {c for c in map(chr, range(0x110000)) if c.isspace()}


def test_engine_envelopes(spark, tmp_path):
    e = Engine(spark)
    ask = lambda **q: e.request(json.dumps(q))
    assert ask(op="version")["ok"] and ask(op="parse", text="x")["error"]["code"] == 4 and ask(op="nope")["error"]["code"] == 4 and e.request("{")["error"]["code"] == 2 and e.request("{}")["error"]["code"] == 2
    assert ask(op="tokenize", text="Hi.")["result"][1]["text"] == "." and ask(op="tokenize", text="x", line_breaks="odd")["error"]["code"] == 2
    loaded = ask(op="load", content=ZOO, name="zoo")
    assert loaded["result"]["schema"] == "CLASS_BASED" and loaded["result"]["entities"] == 4
    assert ask(op="load", content="bad")["error"]["line"] == 1 and ask(op="parse", text="a Hound")["result"]["text"] == "a dog"
    assert ask(op="query", method="parents", args=["Dog"])["result"] == ["Animal"]
    tokens = ask(op="tokenize", text="big dog")["result"]
    assert ask(op="parse_tokens", tokens=tokens)["result"]["text"] == "big_dog" and ask(op="transform_tokens", tokens=tokens, stage="exact")["result"][0]["swaps"]["type"] == "exact"
    assert ask(op="transform_tokens", tokens=tokens, stage="augment")["result"][0]["ancestors"] == [] and ask(op="transform_tokens", tokens=tokens, stage="x")["error"]["code"] == 2
    assert len(ask(op="triples")["result"]) == len(ask(op="read_rdf", content=ZOO)["result"]) == loaded["result"]["triples"]
    assert ask(op="update", remove=["http://e/zoo#Wolf"])["ok"] and ask(op="query", method="find_canon", args=["wolf"])["result"] is None
    assert ask(op="match_terms", text="a b", terms=["b"])["result"] == [{"term": 0, "x": 2, "y": 3}]
    assert ask(op="generate_synonyms", raw={"A": ["x!"]})["result"] == {"a": ["x", "x!"]} and ask(op="generate_spans", raw={"a_b": ["a b"]})["result"]["a"]
    assert ask(op="generate_lookup", synonyms={"a": ["b c"]})["result"]["2"] == ["b c"] and ask(op="detect_schema", content=ZOO)["result"] == "CLASS_BASED"


def test_cli(spark, tmp_path, capsys, monkeypatch):
    import io

    (tmp_path / "z.ttl").write_text(ZOO, encoding="utf-8")
    monkeypatch.setattr("sys.stdin", io.StringIO('{"op":"version"}\n'))
    assert cli.main(["--ontology", str(tmp_path / "z.ttl"), "--text", "hound", "--serve", "--snapshot", str(tmp_path / "s.json")], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.strip().split("\n")]
    assert lines[0]["result"]["text"] == "dog" and lines[1]["ok"] and json.loads((tmp_path / "s.json").read_text())["labels"]
    assert cli.main(["--ontology", str(tmp_path / "none")], spark) == 1


def test_views_write(zoo, tmp_path, spark):
    zoo.write_views(str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v" / "labels")).count() == 4
    assert Views(zoo.triples).lookup.count() == sum(len(g) for g in zoo.synonyms["lookup"].values())


def test_trie():
    assert trie([]) is None and trie(["a_b_c", "a_d_e", "x"])["3"] == {"a": {"b": ["c"], "d": ["e"]}}


def test_catalogue_groups_parts_once(spark, sf_dir):
    """The facts of products come from a table that is written once, not from a scan and a grouping of parts for each kind."""
    from lexigraph.plans.vocabularies import catalogue

    plan = catalogue(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" not in plan and "parquet" not in plan
