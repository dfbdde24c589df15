"""Registered queries that go through the finder, readers, prepared tokens and stages, with their SQL.

`trade` is a vocabulary that grows with the tables. Answers of the finder are rows (method, key, value).
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import STOPWORDS
from .functions.udfs import murmur64, parser, span_table, token_matcher, tokenize
from .operators.finder import Finder
from .plans import graph
from .plans.ontology import Ontology, external_synonyms
from .plans.storage import checkpointed, spread
from .plans.views import Views, rules_of
from .plans.vocabularies import CAT, CAT_SQL, GEO, GEO_SQL, TRADE, TRADE_SQL, catalogue, geography, trade
from .queries import ORACLE, QUERIES, _nations, query, rows, table
from .sources.rdf import OWL, RDF, RDFS, SKOS
from .sources.spark_source import triples_of

L = "split_part({0}, '#', -1)"


def trading(spark: SparkSession, sf_dir: str, interface: str = "json") -> Ontology:
    return Ontology.from_triples(checkpointed(trade(spark, sf_dir)), {"trade": TRADE}, name="trade", interface=interface)


def answers(o: Ontology, *calls: tuple, **kwargs) -> DataFrame:
    """(method, key, value) of several finder calls; the result of a test or count is one value."""
    finder, parts = Finder(o), []
    for method, *args in calls:
        found = finder.query(method, *args, **kwargs)
        name = F.lit("|".join([method, *map(str, args)])).alias("method")
        if found.columns == ["result"]:
            parts.append(found.select(name, F.lit("").alias("key"), F.col("result").cast("string").alias("value")))
        elif found.columns[0] == "key":
            parts.append(found.select(name, "key", F.explode("values").alias("value")))
        else:
            parts.append(found.select(name, F.lit("").alias("key"), "value"))
    return reduce(DataFrame.union, parts)


def told(*parts: tuple[str, str]) -> str:
    """SQL of (method, key, value) from selects of (key, value), after the triples of `trade`."""
    names = f"sub AS (SELECT {L.format('s')} AS c, {L.format('o')} AS p FROM trade WHERE p = '{RDFS}subClassOf'), lab AS (SELECT {L.format('s')} AS k, o AS label FROM trade WHERE p = '{RDFS}label'), "
    names += f"typ AS (SELECT {L.format('s')} AS c, {L.format('o')} AS p FROM trade WHERE p = '{RDF}type' AND o LIKE '%nation%')"
    names += ", up AS (SELECT c AS a, p AS b FROM sub UNION ALL SELECT x.c, y.p FROM sub x JOIN sub y ON y.c = x.p)"
    return f"WITH {TRADE_SQL}, {names} " + " UNION ALL ".join(f"SELECT '{name}' AS method, CAST(key AS VARCHAR) AS key, CAST(value AS VARCHAR) AS value FROM ({sql})" for name, sql in parts)


# Triples and views of the growing vocabulary.

QUERIES["triples_trade"] = lambda s, d: trade(s, d).select("ord", "s", "p", "o", "o_kind")
ORACLE["triples_trade"] = f"WITH {TRADE_SQL} SELECT * FROM trade"


@query(f"WITH {TRADE_SQL} SELECT {L.format('s')} AS subject, lower('mark ' || split_part(s, '_', -1)) || '|' || (SELECT {L.format('x.o')} FROM trade x WHERE x.s = t.s AND x.p = '{RDFS}subClassOf') AS values FROM trade t WHERE p = '{OWL}disjointWith'")
def flatten_blank_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(checkpointed(trade(spark, sf_dir)))
    return v.by_predicate.where("pk = 'owl:disjointWith'").select("subject", F.array_join("values", "|").alias("values"))


def of_trade(f) -> object:
    return lambda spark, sf_dir: f(Views(checkpointed(trade(spark, sf_dir)), namespace=TRADE))


QUERIES["mixed_parents"] = of_trade(lambda v: rows(v.parents).select("key", "value"))
ORACLE["mixed_parents"] = f"WITH {TRADE_SQL} SELECT {L.format('s')} AS key, {L.format('o')} AS value FROM trade WHERE p = '{RDFS}subClassOf' OR (p = '{RDF}type' AND o LIKE '{TRADE}%')"
QUERIES["mixed_children"] = of_trade(lambda v: rows(v.children).select("key", "value", "pos"))
ORACLE["mixed_children"] = f"WITH {TRADE_SQL} SELECT {L.format('o')} AS key, {L.format('s')} AS value, CAST(row_number() OVER (PARTITION BY o ORDER BY ord) - 1 AS INT) AS pos FROM trade WHERE p = '{RDFS}subClassOf' OR (p = '{RDF}type' AND o LIKE '{TRADE}%')"
QUERIES["mixed_ngrams"] = of_trade(lambda v: v.ngrams.select("level", "entity"))
ORACLE["mixed_ngrams"] = f"WITH {TRADE_SQL} SELECT DISTINCT 2 AS level, {L.format('s')} AS entity FROM trade WHERE p = '{RDFS}label'"
QUERIES["reached_trade"] = of_trade(lambda v: graph.reached(rows(v.parents).select(F.col("key").alias("a"), F.col("value").alias("b"))))
ORACLE["reached_trade"] = f"""WITH RECURSIVE {TRADE_SQL}, e AS (SELECT {L.format('s')} AS a, {L.format('o')} AS b FROM trade WHERE p = '{RDFS}subClassOf' OR (p = '{RDF}type' AND o LIKE '{TRADE}%')),
w AS (SELECT a AS root, b AS node FROM e UNION SELECT w.root, e.b FROM w JOIN e ON e.a = w.node) SELECT root, node FROM w"""
QUERIES["views_trade"] = of_trade(lambda v: v.forward.select(F.lit("synonym").alias("view"), F.col("canon").alias("key"), F.explode("variants").alias("value")).union(v.spans.select(F.lit("rule"), "key", F.concat_ws("|", F.col("canon"), F.array_join("content", "+")))).union(v.lookup.select(F.lit("lookup"), F.col("words").cast("string"), "entry")))
ORACLE["views_trade"] = f"""WITH {TRADE_SQL}, l AS (SELECT {L.format('s')} AS canon, lower(o) AS label FROM trade WHERE p = '{RDFS}label')
SELECT 'synonym' AS view, canon AS key, label AS value FROM l UNION ALL SELECT 'rule', split_part(canon, '_', 1), canon || '|' || split_part(canon, '_', 2) FROM l UNION ALL SELECT 'lookup', '2', label FROM l"""


# The three finders.


@query(
    told(
        ("labels", "SELECT '' AS key, label AS value FROM lab"), ("entities", "SELECT '' AS key, k AS value FROM lab"), ("types", f"SELECT '' AS key, {L.format('s')} AS value FROM trade WHERE p = '{RDF}type'"), ("ngrams|2", "SELECT '' AS key, c AS value FROM sub"),
        ("keyed_labels", "SELECT k AS key, label AS value FROM lab"), ("entity_exists|nation_3", "SELECT '' AS key, 'true' AS value"), ("entity_exists|nation_x", "SELECT '' AS key, 'false' AS value"),
        ("parents|nation_3", "SELECT '' AS key, p AS value FROM sub WHERE c = 'nation_3'"), ("children|nation_3", "SELECT '' AS key, c AS value FROM sub WHERE p = 'nation_3'"),
        ("ancestors|supplier_1", "SELECT '' AS key, b AS value FROM up WHERE a = 'supplier_1'"), ("descendants|region_1", "SELECT '' AS key, a AS value FROM up WHERE b = 'region_1'"),
        ("by_predicate|trade:implies", f"SELECT {L.format('s')} AS key, {L.format('o')} AS value FROM trade WHERE p = '{TRADE}implies'"), ("by_predicate_rev|uses", f"SELECT {L.format('o')} AS key, {L.format('s')} AS value FROM trade WHERE p = '{TRADE}uses'"),
        ("has_parent|nation_3|region_9", "SELECT '' AS key, 'false' AS value"), ("find_canon|customer 7", "SELECT '' AS key, 'customer_7' AS value"),
    )
)
def owl_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(
        trading(spark, sf_dir, "owl"), ("labels",), ("entities",), ("types",), ("ngrams", 2), ("keyed_labels",), ("entity_exists", "nation_3"), ("entity_exists", "nation_x"), ("parents", "nation_3"), ("children", "nation_3"), ("ancestors", "supplier_1"),
        ("descendants", "region_1"), ("by_predicate", "trade:implies"), ("by_predicate_rev", "uses"), ("has_parent", "nation_3", "region_9"), ("find_canon", "customer 7"),
    )


_SELF = "SELECT '' AS key, {0} AS value"
_USES, _IMPLIES, _EFFECTS = (f"SELECT {L.format('s')} AS a, lower({L.format('o')}) AS b FROM trade WHERE p = '{TRADE}{x}'" for x in ("uses", "implies", "effects"))


@query(
    told(
        ("types", "SELECT c AS key, p AS value FROM sub"), ("types_rev", "SELECT p AS key, c AS value FROM sub"), ("entity_exists|Nation 3", _SELF.format("'true'")), ("entity_exists|customer_1", _SELF.format("'false'")),
        ("parents|Nation 3", "SELECT '' AS key, p AS value FROM sub WHERE c = 'nation_3'"), ("children|nation_3", "SELECT '' AS key, c AS value FROM sub WHERE p = 'nation_3'"), ("ancestors|supplier_1", "SELECT '' AS key, b AS value FROM up WHERE a = 'supplier_1'"),
        ("descendants|region_1", "SELECT '' AS key, a AS value FROM up WHERE b = 'region_1'"), ("parents_and_self|nation_3", "SELECT '' AS key, p AS value FROM sub WHERE c = 'nation_3' UNION ALL SELECT '', 'nation_3'"),
        ("children_and_self|nation_3", "SELECT '' AS key, c AS value FROM sub WHERE p = 'nation_3' UNION ALL SELECT '', 'nation_3'"), ("ancestors_and_self|supplier_1", "SELECT '' AS key, b AS value FROM up WHERE a = 'supplier_1' UNION ALL SELECT '', 'supplier_1'"),
        ("descendants_and_self|region_1", "SELECT '' AS key, a AS value FROM up WHERE b = 'region_1' UNION ALL SELECT '', 'region_1'"), ("has_parent|nation_3|region_9", _SELF.format("'false'")),
        ("has_ancestor|supplier_1|region_1", "SELECT '' AS key, count(*) > 0 AS value FROM up WHERE a = 'supplier_1' AND b = 'region_1'"), ("is_canon|Customer 5", _SELF.format("'true'")), ("is_variant|customer_5", _SELF.format("'true'")), ("is_variant|customer x", _SELF.format("'false'")),
    )
)
def live_hierarchy_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(
        trading(spark, sf_dir, "data"), ("types",), ("types_rev",), ("entity_exists", "Nation 3"), ("entity_exists", "customer_1"), ("parents", "Nation 3"), ("children", "nation_3"), ("ancestors", "supplier_1"), ("descendants", "region_1"), ("parents_and_self", "nation_3"),
        ("children_and_self", "nation_3"), ("ancestors_and_self", "supplier_1"), ("descendants_and_self", "region_1"), ("has_parent", "nation_3", "region_9"), ("has_ancestor", "supplier_1", "region_1"), ("is_canon", "Customer 5"), ("is_variant", "customer_5"), ("is_variant", "customer x"),
    )


@query(
    told(
        ("labels", "SELECT k AS key, label AS value FROM lab"), ("labels_rev", "SELECT label AS key, k AS value FROM lab"), ("label_by_entity|Nation 4", _SELF.format("'Nation 4'")), ("synonyms", "SELECT k AS key, lower(label) AS value FROM lab"),
        ("synonyms_rev", "SELECT lower(label) AS key, k AS value FROM lab"), ("find_variants|nation 4", _SELF.format("'nation 4'")), ("find_ner|x", _SELF.format("'NER'")), ("uses", f"SELECT a AS key, b AS value FROM ({_USES})"),
        ("uses_rev", f"SELECT b AS key, a AS value FROM ({_USES})"), ("implies", f"SELECT a AS key, b AS value FROM ({_IMPLIES})"), ("implied_by", f"SELECT b AS key, a AS value FROM ({_IMPLIES})"), ("implies_by_entity|supplier 2", f"SELECT '' AS key, b AS value FROM ({_IMPLIES}) WHERE a = 'supplier_2'"),
        ("implied_by_entity|region_2", f"SELECT '' AS key, a AS value FROM ({_IMPLIES}) WHERE b = 'region_2'"), ("effects", f"SELECT a AS key, b AS value FROM ({_EFFECTS})"), ("effects_rev", f"SELECT b AS key, a AS value FROM ({_EFFECTS})"),
        ("by_predicate|uses", f"SELECT a AS key, b AS value FROM ({_USES})"), ("by_predicate_rev|trade:uses", f"SELECT b AS key, a AS value FROM ({_USES})"), ("ontologies", _SELF.format("'trade'")), ("absolute_path", _SELF.format("''")),
    )
)
def live_relation_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(
        trading(spark, sf_dir, "data"), ("labels",), ("labels_rev",), ("label_by_entity", "Nation 4"), ("synonyms",), ("synonyms_rev",), ("find_variants", "nation 4"), ("find_ner", "x"), ("uses",), ("uses_rev",), ("implies",), ("implied_by",), ("implies_by_entity", "supplier 2"),
        ("implied_by_entity", "region_2"), ("effects",), ("effects_rev",), ("by_predicate", "uses"), ("by_predicate_rev", "trade:uses"), ("ontologies",), ("absolute_path",),
    )


_JP = "SELECT c, p FROM sub UNION ALL SELECT c, p FROM typ"


@query(
    told(
        ("parents|customer_1", "SELECT '' AS key, p AS value FROM typ WHERE c = 'customer_1'"), ("children|nation_3", f"SELECT '' AS key, c AS value FROM ({_JP}) WHERE p = 'nation_3'"),
        ("ancestors|customer_1", "SELECT '' AS key, p AS value FROM typ WHERE c = 'customer_1' UNION ALL SELECT '', sub.p FROM typ JOIN sub ON sub.c = typ.p WHERE typ.c = 'customer_1'"), ("parents_and_self|nation_3", "SELECT '' AS key, p AS value FROM sub WHERE c = 'nation_3' UNION ALL SELECT '', 'nation_3'"),
        ("children_and_self|region_1", "SELECT '' AS key, c AS value FROM sub WHERE p = 'region_1' UNION ALL SELECT '', 'region_1'"), ("has_parent|nation_3|x", _SELF.format("'false'")), ("has_ancestor|customer_1|x", _SELF.format("'false'")), ("has_spans", _SELF.format("'4'")), ("has_data", "SELECT '' AS key, count(*) AS value FROM lab"),
        ("entity_exists|nation_3", _SELF.format("'false'")), ("span_keys", "SELECT '' AS key, unnest(['region', 'nation', 'supplier', 'customer']) AS value"), ("types", "SELECT c AS key, p AS value FROM sub"), ("labels", "SELECT k AS key, label AS value FROM lab"), ("ner", "SELECT label AS key, 'NER' AS value FROM lab"),
        ("find_ner|Nation 2", _SELF.format("'NER'")), ("label_by_entity|nation 2", _SELF.format("'Nation 2'")), ("is_canon|nation_2", _SELF.format("'true'")), ("is_variant|Nation 2", _SELF.format("'false'")), ("find_variants|nation_2", _SELF.format("'nation 2'")), ("predicates", "SELECT '' AS key, unnest([':implies', ':uses', ':effects']) AS value"),
        ("by_predicate|:uses", f"SELECT a AS key, b AS value FROM ({_USES})"), ("by_predicate_rev|:effects", f"SELECT a AS key, b AS value FROM ({_EFFECTS})"), ("lookup", "SELECT '2' AS key, lower(label) AS value FROM lab"), ("synonyms", "SELECT k AS key, lower(label) AS value FROM lab"), ("synonyms_rev", "SELECT lower(label) AS key, k AS value FROM lab"),
        ("labels_rev", "SELECT ch AS key, max_by(k, (ord, pos)) AS value FROM (SELECT lab.k, t.ord, unnest(string_split(lab.label, '')) AS ch, generate_subscripts(string_split(lab.label, ''), 1) AS pos FROM lab JOIN trade t ON t.p LIKE '%label' AND split_part(t.s, '#', -1) = lab.k) GROUP BY ch"),
    )
)
def stored_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(
        trading(spark, sf_dir), ("parents", "customer_1"), ("children", "nation_3"), ("ancestors", "customer_1"), ("parents_and_self", "nation_3"), ("children_and_self", "region_1"), ("has_parent", "nation_3", "x"), ("has_ancestor", "customer_1", "x"), ("has_spans",), ("has_data",), ("entity_exists", "nation_3"),
        ("span_keys",), ("types",), ("labels",), ("ner",), ("find_ner", "Nation 2"), ("label_by_entity", "nation 2"), ("is_canon", "nation_2"), ("is_variant", "Nation 2"), ("find_variants", "nation_2"), ("predicates",), ("by_predicate", ":uses"), ("by_predicate_rev", ":effects"), ("lookup",), ("synonyms",),
        ("synonyms_rev",), ("labels_rev",), ("ngrams", 2), ("uses",),
    )


@query(f"WITH {GEO_SQL} SELECT 'children|World' AS method, '' AS key, {L.format('s')} AS value FROM geo WHERE p = '{RDFS}subClassOf' AND o LIKE '%World' UNION ALL SELECT 'labels', {L.format('s')}, o FROM geo WHERE p = '{RDFS}label' UNION ALL SELECT 'ner', o, 'NER' FROM geo WHERE p = '{RDFS}label' UNION ALL SELECT 'has_data', '', CAST(count(DISTINCT s) AS VARCHAR) FROM geo WHERE p = '{RDFS}label'")
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary of a fixed size, written as one object and loaded from it, told by its content."""
    view = Ontology.from_triples(checkpointed(geography(spark, sf_dir)), name="geo").snapshot()
    return answers(Ontology.load(spark, content=json.dumps(view)), ("children", "World"), ("labels",), ("ner",), ("has_data",))


@query(f"WITH {GEO_SQL}, n AS (SELECT lower({L.format('s')}) AS canon, lower(o) AS label FROM geo WHERE p = '{RDFS}label' AND s LIKE '%NATION%') SELECT label, canon FROM n UNION ALL SELECT 'home of ' || label, canon FROM n UNION ALL SELECT label || ' proper', canon FROM n")
def external_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants from lines beside a source, for the nations: a table of a fixed size."""
    g = checkpointed(geography(spark, sf_dir).where(f"p = '{RDFS}label' AND s LIKE '%NATION%'"))
    names = [(r["s"].rpartition("#")[2].lower(), r["o"]) for r in g.select("s", "o").collect()]
    lines = "\n".join(["# variants", *(f"{c}~home of {o}, {o} proper" for c, o in names), "no line", ""])
    o = Ontology(spark, g, Ontology.from_triples(g, name="geo", interface="data").options, external=external_synonyms(lines))
    return spark.createDataFrame([(v, c) for v, canons in o.synonyms["rev"].items() for c in canons], "label string, canon string")


@query(f"WITH {GEO_SQL}, {CAT_SQL}, x AS (SELECT lower({L.format('s')}) AS key, lower({L.format('o')}) AS value FROM geo WHERE p = '{RDFS}subClassOf' UNION SELECT lower({L.format('s')}), lower({L.format('o')}) FROM cat WHERE p = '{RDFS}subClassOf') SELECT key, value FROM x")
def collection_by_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [Ontology.from_triples(checkpointed(t(spark, sf_dir)), name=n, interface="owl") for t, n in ((geography, "geo"), (catalogue, "cat"), (geography, "again"))]
    return answers(Ontology.collect(parts), ("by_predicate", "rdfs:subClassOf")).select("key", "value")


# Readers.

_STATED = f"SELECT n_nationkey, p, o, o_kind FROM geo JOIN nation ON s = '{GEO}' || n_name WHERE p NOT LIKE '%seeAlso' AND p NOT LIKE '%backwardCompatibleWith'"


@query(f"WITH {GEO_SQL}, x AS ({_STATED}) SELECT f.format, x.* FROM x, (SELECT unnest(['json', 'told json', 'told jsonl', 'told turtle']) AS format) f")
def read_any_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array as such, and JSON, JSONL and Turtle told by their content."""
    record = F.to_json(F.struct(F.col("n_name").alias("id"), F.lit("owl:Class").alias("type"), "label", F.array(F.concat(F.lit("the territory of "), "label")).alias("synonyms"), F.col("up").alias("parents")))
    space = F.lit('{"namespace":"' + GEO + '"}')
    array = F.concat(F.lit("[ "), space, F.lit(" ,\n "), record, F.lit("\n]"))
    turtle = F.concat(F.lit(f"PREFIX : <{GEO}> PREFIX r: <{RDFS}> PREFIX o: <{OWL}> PREFIX k: <{SKOS}>\n:"), "n_name", F.lit(' a o:Class ; r:label """'), "label", F.lit('""" ; k:altLabel "the territory of '), "label", F.lit('" ; r:subClassOf :'), "up", F.lit(" ."))
    n, out = _nations(spark, sf_dir), []
    for name, text, form in (("json", array, "json"), ("told json", array, None), ("told jsonl", F.concat(space, F.lit("\n"), record), None), ("told turtle", turtle, None)):
        out.append(triples_of(n.withColumn("text", text), "n_nationkey", "text", form).select(F.lit(name).alias("format"), "n_nationkey", "p", "o", "o_kind"))
    return reduce(DataFrame.union, out)


@query("SELECT n_nationkey, 'http://a/' || n_nationkey AS s, unnest(['http://b/x', 'http://c/y']) AS o FROM nation")
def bind_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix that is bound anew means the new address from there on."""
    key = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("@prefix p: <http://b/> . <http://a/"), key, F.lit("> <http://q> p:x . @prefix p: <http://c/> . <http://a/"), key, F.lit("> <http://q> p:y ."))
    return triples_of(table(spark, sf_dir, "nation").withColumn("text", text), "n_nationkey", "text").select("n_nationkey", "s", "o")


# Rules.


def _set_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    product = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    canon = F.replace("p_name", F.lit(" "), F.lit("_")).alias("canon")
    return product.select(canon, F.col("p_name").alias("value"), (F.col("k") * 2).alias("ord")).union(product.select(canon, F.concat("p_name", F.lit(" kit")), F.col("k") * 2 + 1))


_RULES = f"""WITH product AS (SELECT DISTINCT p_name, replace(p_name, ' ', '_') AS canon, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS n FROM part), stops AS (SELECT unnest(string_split('{STOPWORDS}', ' ')) AS w)
SELECT canon AS key, 'kit' AS content, canon FROM product UNION ALL SELECT a, n, canon FROM product WHERE n NOT IN (SELECT w FROM stops) UNION ALL SELECT a, CASE WHEN n < 'kit' THEN n || '|kit' ELSE 'kit|' || n END, canon FROM product"""


@query(_RULES)
def compound_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase that holds a compound canonical form makes a rule of it and the rest."""
    return rules_of(_set_rules(spark, sf_dir)).select("key", F.array_join("content", "|").alias("content"), "canon")


@query(_RULES)
def generated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules by the function over ad hoc maps, for the vocabulary of part names, which is small."""
    raw: dict[str, list[str]] = {}
    for r in _set_rules(spark, sf_dir).orderBy("ord").collect():
        raw.setdefault(r["canon"], []).append(r["value"])
    return spark.createDataFrame([(k, "|".join(x["content"]), x["canon"]) for k, own in span_table(raw).items() for x in own], "key string, content string, canon string")


# Tokens.

_QUOTED = "SELECT p_partkey, split_part(p_name, ' ', 2) AS n FROM part"


@query(
    f"WITH q AS ({_QUOTED}) SELECT p_partkey, 'close' AS kind, unnest([n || '''x ', n, ''' ', n || 's', ''' ', 'end']) AS text FROM q UNION ALL SELECT p_partkey, 'odd', unnest(['''', n || ' ', 'ns', ''' ', 'end']) FROM q "
    "UNION ALL SELECT p_partkey, 'even', unnest(['''', n, ''' ', 'ns'' ', 'end']) FROM q UNION ALL SELECT p_partkey, 'late', unnest(['ns'' ', '''', n || ' ', 'end']) FROM q"
)
def apostrophes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An apostrophe that closes a word stands apart but after s; an odd number of lone ones before the first such word pairs the last with it."""
    n = F.split_part("p_name", F.lit(" "), F.lit(2))
    kinds = {"close": F.concat(n, F.lit("'x "), n, F.lit("' "), n, F.lit("s' end")), "odd": F.concat(F.lit("'"), n, F.lit(" ns' end")), "even": F.concat(F.lit("'"), n, F.lit("' ns' end")), "late": F.concat(F.lit("ns' '"), n, F.lit(" end"))}
    parts = spread(table(spark, sf_dir, "part"))
    return reduce(DataFrame.union, [parts.select("p_partkey", F.lit(k).alias("kind"), F.explode(tokenize(text)["text"]).alias("text")) for k, text in kinds.items()])


# MurmurHash64A with seed 1: whole blocks of eight bytes, then the rest, in 128-bit numbers cut to 64.
_M, _TWO = "14313749767032793493::UHUGEINT", "18446744073709551616::UHUGEINT"
_BYTES = "list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::UHUGEINT)"
_LE = "list_sum(list_transform(range(0, {n}), lambda j: b[{at} + j + 1] * (1::UHUGEINT << (8 * j)::UHUGEINT)))"
HASH = f"""bytes AS (SELECT word, {_BYTES} AS b FROM words),
blocks AS (SELECT word, b, len(b) AS n, list_transform(range(0, len(b) // 8), lambda k: list_reduce(list_transform(range(0, 8), lambda j: b[8 * k + 8 - j]), lambda x, y: x * 256::UHUGEINT + y)) AS w,
  CASE WHEN len(b) % 8 > 0 THEN list_reduce(list_reverse(b[8 * (len(b) // 8) + 1:]), lambda x, y: x * 256::UHUGEINT + y) END AS rest FROM bytes),
mixed AS (SELECT word, rest, list_reduce(list_prepend(xor(1::UHUGEINT, n::UHUGEINT * {_M} % {_TWO}), list_transform(w, lambda k: xor(k * {_M} % {_TWO}, (k * {_M} % {_TWO}) // 140737488355328::UHUGEINT) * {_M} % {_TWO})), lambda h, k: xor(h, k) * {_M} % {_TWO}) AS h FROM blocks),
tailed AS (SELECT word, CASE WHEN rest IS NULL THEN h ELSE xor(h, rest) * {_M} % {_TWO} END AS h FROM mixed),
last AS (SELECT word, xor(h, h // 140737488355328::UHUGEINT) * {_M} % {_TWO} AS h FROM tailed),
hashes AS (SELECT word, CAST(xor(h, h // 140737488355328::UHUGEINT) AS VARCHAR) AS hash FROM last)"""
_WORDS = "words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{L}+', 0)) AS word FROM benchmark)"


@query(f"WITH {_WORDS}, {HASH} SELECT word, hash FROM hashes")
def word_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", murmur64(F.col("word")).alias("hash"))


@query(f"WITH q AS (SELECT DISTINCT p_name FROM part), t AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS k FROM q), words AS (SELECT DISTINCT word FROM t), {HASH} SELECT p_name, hash || '#' || k AS id FROM t JOIN hashes USING (word)")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spread(table(spark, sf_dir, "part").select("p_name").distinct())
    return names.select("p_name", F.explode(tokenize(F.col("p_name"))["id"]).alias("id"))


# Stages.


def products(spark: SparkSession, sf_dir: str, interface: str = "json") -> Ontology:
    return Ontology.from_triples(checkpointed(catalogue(spark, sf_dir)), {"cat": CAT}, name="cat", interface=interface)


def entities(parsed: DataFrame, *columns: str) -> DataFrame:
    n = parsed.select(*columns, F.explode("parsed.nodes").alias("n")).where("n.parent IS NULL AND n.type IS NOT NULL")
    return n.select(*columns, "n.canon", "n.type", "n.x", "n.y", "n.confidence")


_LINES = "WITH q AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS n FROM part), m AS (SELECT unnest(['ignore', 'boundary']) AS mode)"


@query(
    _LINES + " SELECT mode, p_partkey, 'space' AS kind, replace(p_name, ' ', '_') AS canon, 0 AS x, length(p_name) AS y FROM q, m UNION ALL SELECT mode, p_partkey, 'break', replace(p_name, ' ', '_'), 0, length(p_name) FROM q, m WHERE mode = 'ignore' "
    "UNION ALL SELECT mode, p_partkey, 'break', n, length(a) + 1, length(p_name) FROM q, m WHERE mode = 'boundary'"
)
def line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases across a line end are found, or not where line ends are boundaries; then the noun alone is."""
    index, out = products(spark, sf_dir).index, []
    for mode in ("ignore", "boundary"):
        parse = parser(spark, index, line_breaks=mode, entities_only=True, failfast=True, with_text=False)
        for kind, sep in (("space", " "), ("break", "\n")):
            parsed = spread(table(spark, sf_dir, "part")).select(F.lit(mode).alias("mode"), "p_partkey", F.lit(kind).alias("kind"), parse(F.replace("p_name", F.lit(" "), F.lit(sep))).alias("parsed"))
            out.append(entities(parsed, "mode", "p_partkey", "kind").select("mode", "p_partkey", "kind", "canon", "x", "y"))
    return reduce(DataFrame.union, out)


_SPAN = "WITH q AS (SELECT s_suppkey AS k, unnest(range(0, 6)) AS gap FROM supplier), t AS (SELECT *, 'x ' || s || repeat(' w', CAST(gap AS INT)) || ' supplier end' AS text, length(s) AS n FROM (SELECT *, CAST(k AS VARCHAR) AS s FROM q))"


@query(_SPAN + " SELECT k, gap, 'supplier_' || k AS canon, 'spans' AS type, 2 AS x, CAST(2 + n + 2 * gap + 9 AS INT) AS y FROM t WHERE gap <= 3")
def span_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's words in turned order, with none to five words between: the window and its offsets."""
    o = Ontology.from_triples(checkpointed(trade(spark, sf_dir).where("s LIKE '%supplier_%'")), name="trade", class_based=True)
    parse = parser(spark, o.index, entities_only=True, failfast=True, with_text=False)
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")).alias("gap"))
    text = F.concat(F.lit("x "), F.col("k").cast("string"), F.expr("repeat(' w', CAST(gap AS INT))"), F.lit(" supplier end"))
    return entities(spread(t).select("k", "gap", parse(text).alias("parsed")), "k", "gap").select("k", "gap", "canon", "type", "x", "y")


_STAGED = "WITH q AS (SELECT DISTINCT p_name, replace(p_name, ' ', '_') AS canon FROM part)"


@query(_STAGED + " SELECT stage, p_name, canon, type, 0 AS x, length(p_name) AS y, confidence FROM q, (SELECT unnest(['exact', 'spans', 'hierarchy', 'all']) AS stage, unnest(['exact', 'spans', 'hierarchy', 'exact']) AS type, unnest([100.0, 100.0, 75.0, 100.0])::DOUBLE AS confidence)")
def token_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared tokens through each stage alone and through all; for the hierarchy, nouns may stand for what lies below them."""
    index = products(spark, sf_dir, "data").index
    names = spread(table(spark, sf_dir, "part").select("p_name").distinct())
    more = lambda t: F.struct(*[t[c].alias(c) for c in ("id", "text", "x", "y", "normal")], F.array(F.concat(t["normal"], F.lit("s")), F.lit("goods")).alias("descendants"))
    tokens = names.select("p_name", F.transform(tokenize(F.col("p_name")), more).alias("tokens"))
    out = []
    for stage in ("exact", "spans", "hierarchy", None):
        parsed = tokens.select(F.lit(stage or "all").alias("stage"), "p_name", token_matcher(spark, index, stage)(F.col("tokens")).alias("parsed"))
        out.append(entities(parsed, "stage", "p_name").select("stage", "p_name", "canon", "type", "x", "y", "confidence"))
    return reduce(DataFrame.union, out)


@query(_STAGED + ", d AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS n FROM part) SELECT a || ' goods' AS text, a || '_' || min(n) AS canon, 'hierarchy' AS type FROM d GROUP BY a")
def hierarchy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word and `goods`, which may stand for each noun below it: the first combination, in order, that is an entity."""
    o = products(spark, sf_dir, "data")
    below = answers(o, ("descendants", "goods")).agg(F.array_sort(F.collect_set("value")).alias("below"))  # a vocabulary of part names, which is small
    words = table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a")).distinct()
    text = F.concat("a", F.lit(" goods"))
    base = lambda t: [t[c].alias(c) for c in ("id", "text", "x", "y", "normal")]
    tokens = F.transform(tokenize(text), lambda t: F.struct(*base(t), F.when(t["normal"] == "goods", F.col("below")).otherwise(F.array().cast("array<string>")).alias("descendants")))
    parsed = words.join(F.broadcast(below), F.lit(True)).select(text.alias("text"), token_matcher(spark, o.index, "hierarchy")(tokens).alias("parsed"))
    return entities(parsed, "text").select("text", "canon", "type")


@query("WITH q AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS a FROM part) SELECT p_name, CASE WHEN a = 'red' THEN 'scarlet' ELSE replace(p_name, ' ', '_') END AS canon FROM q WHERE a <> 'old'")
def update_then_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of some products are replaced, others removed; the updated handle patches the literals that it holds."""
    t = checkpointed(catalogue(spark, sf_dir).where(f"p = '{RDFS}label' AND s LIKE '%\\\\_%'"))
    o = Ontology.from_triples(t, {"cat": CAT}, name="cat", class_based=True)
    o.index  # noqa: B018  the handle before the update has been used
    names = [r["s"] for r in t.select("s").collect()]  # edits by hand: some dozens
    new = o.update({f"{CAT}scarlet": f"<{CAT}scarlet> <{RDFS}label> " + ", ".join(f'"{s.rpartition("#")[2].replace("_", " ")}"' for s in names if "#red_" in s) + " ."}, [s for s in names if "#red_" in s or "#old_" in s])
    parse = parser(spark, new.index, entities_only=True, failfast=True, with_text=False)
    parts = spread(table(spark, sf_dir, "part").select("p_name").distinct())
    return entities(parts.select("p_name", parse(F.col("p_name")).alias("parsed")), "p_name").select("p_name", "canon")
