"""Finder queries: each method of the three interfaces as a plan over the tables of an ontology.

A method that lists gives rows (value), in the order of ``pos``; one that maps gives (key, values); one
that tests or counts gives one row (result). Nothing is computed on the driver but the choice of plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.text import norm
from ..plans import graph
from ..plans.views import BY_LENGTH, CUSTOM
from ..sources.rdf import OWL, RDF, RDFS, SKOS

if TYPE_CHECKING:
    from ..plans.ontology import Ontology

BUILT_IN = {"rdfs": RDFS, "rdf": RDF, "owl": OWL, "skos": SKOS}
#: Methods over custom predicates, by predicate: plain, reversed, by entity, reversed by entity.
RELATIONS = {
    "effects": ("effects", "effects_rev", None, None), "requires": ("requires", "required_by", "requires_by_entity", "required_by_entity"),
    "similarTo": ("similar", "similar_rev", "similar_by_entity", None), "implies": ("implies", "implied_by", "implies_by_entity", "implied_by_entity"), "uses": ("uses", "uses_rev", None, None),
}


def reverse_map(m: DataFrame) -> DataFrame:
    """(key, values): each value with the keys that have it, in order."""
    rows = m.select("key", "ord", F.posexplode("values").alias("at", "value"))
    return rows.groupBy(F.col("value").alias("key")).agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("ord", "at", F.col("key").alias("k"))))["k"]).alias("values"), F.min(F.struct("ord", "at"))["ord"].alias("ord"))


def listed(m: DataFrame, key: Column | str) -> DataFrame:
    """(value, pos): the values of one key."""
    return m.where(F.col("key") == key).select(F.posexplode("values").alias("pos", "value")).select("value", "pos")


def edges_of(m: DataFrame) -> DataFrame:
    """(a, b, ord) of a map."""
    return m.select(F.col("key").alias("a"), F.posexplode("values").alias("ord", "b")).select("a", "b", F.col("ord").cast("long").alias("ord"))


def by_path(walks: DataFrame) -> DataFrame:
    return walks.select(F.col("node").alias("value"), F.col("path").alias("pos"))


def distinct_sorted(rows: DataFrame) -> DataFrame:
    return rows.select("value").distinct().withColumn("pos", F.col("value"))


def canonical(words: DataFrame, forward: DataFrame, back: DataFrame, column: str = "text") -> DataFrame:
    """`words` with ``canon``: the text itself if canonical, else the first canonical form of it, spelt as it is, with spaces, or cleaned."""
    keys = forward.select(F.col("canon").alias("_f"))
    firsts = back.select(F.col("variant").alias("_v"), F.element_at("canons", 1).alias("_c"))
    text = F.col(column)
    clean = graph.normal(F.replace(F.replace(text, F.lit(" "), F.lit("_")), F.lit("'"), F.lit("")))
    out = words
    for i, t in enumerate((text, clean)):
        spaced = F.replace(t, F.lit("_"), F.lit(" "))
        out = out.join(keys.withColumnRenamed("_f", f"_f{i}"), t == F.col(f"_f{i}"), "left")
        out = out.join(firsts.toDF(f"_v{i}", f"_c{i}"), t == F.col(f"_v{i}"), "left").join(firsts.toDF(f"_w{i}", f"_d{i}"), spaced == F.col(f"_w{i}"), "left")
    return out.select(*words.columns, F.coalesce("_f0", "_c0", "_d0", F.when(F.contains(text, F.lit(" ")) | F.contains(text, F.lit("'")), F.coalesce("_f1", "_c1", "_d1"))).alias("canon"))


class Finder:
    """The finder methods of an ontology: ``json`` and ``ask_json`` over stored views, ``data`` over live ones, ``owl`` over the graph."""

    def __init__(self, ontology: Ontology):
        self.ontology, self.spark = ontology, ontology.spark

    def query(self, method: str, *args, interface: str | None = None, **kwargs) -> DataFrame:
        interface = interface or self.ontology.options.interface
        if method == "transitive":
            return self.transitive(args[0], args[1] if len(args) > 1 else "", interface)
        if method == "ontologies":
            return self._values([p.options.name for p in self.ontology.parts or (self.ontology,)])
        if method == "absolute_path":
            return self.spark.createDataFrame([(self.ontology.options.directory,)], "result string")
        own: Callable | None = None
        if interface in ("owl", "data") and self.ontology.view is None:
            own = getattr(self, f"{interface}_{method}", None)
            if own is None and interface == "data":
                own = self._relation(method)
        if own is None and method == "equivalents" and interface == "json":
            raise EngineError(4, "Unsupported ontology method: equivalents")
        own = own or getattr(self, f"json_{method}", None) or self._stored_relation(method)
        if own is None:
            raise EngineError(4, f"Unsupported ontology method: {method}")
        return own(*args, **kwargs)

    # Small results.

    def _values(self, values: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, pos int")

    @staticmethod
    def _test(rows: DataFrame) -> DataFrame:
        return rows.agg((F.count("*") > 0).alias("result"))

    @staticmethod
    def _count(rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("result"))

    @staticmethod
    def _map(rows: DataFrame) -> DataFrame:
        return rows.select("key", "values", "ord")

    # Tables, from the graph or from a prepared snapshot.

    def table(self, name: str) -> DataFrame:
        """(key, values, ord) of parents, children, forward, back, equivalents, labels, ner or types; (entity, ord) of entities."""
        o = self.ontology
        if o.view is not None:
            source: Mapping = {"forward": o.synonyms["fwd"], "back": o.synonyms["rev"], "types": (o.view.get("by_predicate") or {}).get("rdfs:subClassOf") or {}}.get(name, o.view.get(name) or {})
            if name == "entities":
                return self.spark.createDataFrame([(v, i) for i, v in enumerate(source)], "entity string, ord long")
            return self.spark.createDataFrame([(k, [v] if isinstance(v, str) else v, i) for i, (k, v) in enumerate(source.items())], "key string, values array<string>, ord long")
        v = o.views
        if name == "forward":
            return v.forward.select(F.col("canon").alias("key"), F.col("variants").alias("values"), "ord")
        if name == "back":
            return v.back.select(F.col("variant").alias("key"), F.col("canons").alias("values"), "ord")
        if name in ("labels", "ner"):
            rows = getattr(v, name)
            return rows.select("key", F.array("label").alias("values"), "ord") if name == "labels" else rows.select(F.col("label").alias("key"), F.array("ner").alias("values"), "ord")
        if name == "types":
            return v.by_predicate.where("pk = 'rdfs:subClassOf'").select(F.col("subject").alias("key"), "values", "ord")
        return getattr(v, name)

    # json: stored views.

    def json_synonyms(self) -> DataFrame:
        return self._map(self.table("forward"))

    def json_synonyms_rev(self) -> DataFrame:
        return self._map(self.table("back"))

    def json_lookup(self) -> DataFrame:
        if self.ontology.view is not None:
            rows = [(str(n), g, n) for n, g in self.ontology.synonyms["lookup"].items()]
            return self.spark.createDataFrame(rows, "key string, values array<string>, ord long")
        grouped = self.ontology.views.lookup.groupBy("words").agg(F.reverse(F.array_sort(F.collect_list("entry"), BY_LENGTH)).alias("values"))
        return grouped.select(F.col("words").cast("string").alias("key"), "values", F.col("words").cast("long").alias("ord"))

    json_synonyms_lookup = json_lookup

    def json_find_canon(self, text: str) -> DataFrame:
        words = self.spark.createDataFrame([(text,)], "text string")
        forward, back = self.table("forward").withColumnRenamed("key", "canon"), self.table("back").select(F.col("key").alias("variant"), F.col("values").alias("canons"))
        return canonical(words, forward, back).select(F.col("canon").alias("result"))

    def json_is_canon(self, key: str) -> DataFrame:
        return self._test(self.table("forward").where(F.col("key") == key))

    def json_is_variant(self, key: str) -> DataFrame:
        return self._test(self.table("back").where(F.col("key") == key))

    def json_find_variants(self, key: str) -> DataFrame:
        return listed(self.table("forward"), key)

    def json_find_ner(self, key: str) -> DataFrame:
        return self.table("ner").where(F.col("key") == key).select(F.element_at("values", 1).alias("result"))

    def json_label_by_entity(self, entity: str) -> DataFrame:
        return self.table("labels").where(F.col("key") == norm(entity).replace(" ", "_")).select(F.element_at("values", 1).alias("result"))

    def json_by_predicate(self, key: str) -> DataFrame:
        if self.ontology.view is not None:
            rows = ((self.ontology.view.get("by_predicate") or {}).get(key) or {}).items()
            return self.spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "key string, values array<string>, ord long")
        return self.ontology.views.by_predicate.where(F.col("pk") == key).select(F.col("subject").alias("key"), "values", "ord")

    def json_by_predicate_rev(self, key: str) -> DataFrame:
        """A kept quirk: keys without values are left out, and nothing is reversed."""
        return self.json_by_predicate(key).where(F.size("values") > 0)

    def json_parents(self, entity: str) -> DataFrame:
        return listed(self.table("parents"), entity)

    def json_children(self, entity: str) -> DataFrame:
        return listed(self.table("children"), entity)

    def _walk(self, m: DataFrame, entity: str, tolerant: bool = False) -> DataFrame:
        starts = self.spark.createDataFrame([(entity,)], "root string")
        return by_path(graph.closure(edges_of(m), starts, tolerant))

    def _with_self(self, rows: DataFrame, entity: str) -> DataFrame:
        first = F.array().cast("array<bigint>")
        me = self.spark.createDataFrame([(entity,)], "value string").withColumn("pos", first)
        pos = F.col("pos") if dict(rows.dtypes)["pos"].startswith("array") else F.array(F.col("pos").cast("long"))
        return me.unionByName(rows.select("value", pos.alias("pos")))

    def json_ancestors(self, entity: str) -> DataFrame:
        return self._walk(self.table("parents"), entity)

    def json_descendants(self, entity: str) -> DataFrame:
        return self._walk(self.table("children"), entity)

    def json_parents_and_self(self, entity: str) -> DataFrame:
        return self._with_self(self.json_parents(entity), entity)

    def json_children_and_self(self, entity: str) -> DataFrame:
        return self._with_self(self.json_children(entity), entity)

    def json_ancestors_and_self(self, entity: str) -> DataFrame:
        return self._with_self(self.json_ancestors(entity), entity)

    def json_descendants_and_self(self, entity: str) -> DataFrame:
        return self._with_self(self.json_descendants(entity), entity)

    def json_has_parent(self, entity: str, parent: str) -> DataFrame:
        return self._test(self.json_parents(entity).where(F.col("value") == parent))

    def json_has_ancestor(self, entity: str, ancestor: str) -> DataFrame:
        return self._test(self.json_ancestors(entity).where(F.col("value") == ancestor))

    def json_has_spans(self) -> DataFrame:
        """A count of keys, not a test."""
        if self.ontology.view is not None:
            return self._count(self._values(list(self.ontology.span_rules)))
        return self._count(self.ontology.views.spans.select("key").distinct())

    def json_has_data(self) -> DataFrame:
        return self._count(self.table("forward"))

    def json_entity_exists(self, entity: str) -> DataFrame:
        """Only prepared views of a live ontology list entities; for others nothing exists."""
        rows = self.table("entities") if self.ontology.view is not None else self.spark.createDataFrame([], "entity string")
        return self._test(rows.where(F.col("entity") == entity))

    def json_span_keys(self) -> DataFrame:
        keys = self._values(list(self.ontology.span_rules)).select("value") if self.ontology.view is not None else self.ontology.views.spans.select(F.col("key").alias("value")).distinct()
        return keys.withColumn("pos", F.struct(F.length("value"), "value"))

    def json_ngrams(self, level: str | int = "") -> DataFrame:
        """A kept quirk: levels are looked for among synonyms, where there are none."""
        return self._values([]).where("false")

    def json_types(self) -> DataFrame:
        return self._map(self.table("types"))

    json_types_rev = json_types

    def json_entities(self) -> DataFrame:
        """Stored in prepared views of a live ontology only."""
        if self.ontology.view is None or "entities" not in self.ontology.view:
            raise EngineError(4, "Unsupported ontology method: entities")
        return self._values(list(self.ontology.view["entities"]))

    def json_labels(self) -> DataFrame:
        return self._map(self.table("labels"))

    def json_labels_rev(self) -> DataFrame:
        """A kept quirk: each character of labels, with the last key whose label has it."""
        rows = self.table("labels").select("key", "ord", F.posexplode(F.split(F.element_at("values", 1), "")).alias("at", "c")).where("c <> ''")
        return rows.groupBy(F.col("c").alias("key")).agg(F.array(F.max_by("key", F.struct("ord", "at"))).alias("values"), F.min(F.struct("ord", "at"))["ord"].alias("ord"))

    def json_equivalents(self) -> DataFrame:
        return self._map(self.table("equivalents"))

    def json_ner(self) -> DataFrame:
        return self._map(self.table("ner"))

    def json_predicates(self) -> DataFrame:
        if self.ontology.view is not None:
            return self._values(self.ontology.view.get("predicates") or [])
        return self.ontology.views.predicates.select(F.col("pk").alias("value"), F.col("ord").alias("pos"))

    def _stored_relation(self, method: str) -> Callable | None:
        """Custom predicates are looked up without the colon that stored keys begin with, so built views have none; authored ones may."""
        for predicate, (plain, back, entity, back_entity) in RELATIONS.items():
            if method == plain:
                return lambda: self.json_by_predicate(predicate)  # noqa: B023
            if method == back:
                return lambda: self.json_by_predicate_rev(predicate)  # noqa: B023
            if method in (entity, back_entity):
                m = self.json_by_predicate if method == entity else self.json_by_predicate_rev
                twice = method == "similar_by_entity"
                key = lambda e: norm(e).replace(" ", "_")
                return lambda e: listed(m(predicate), key(e)) if not twice else listed(m(predicate), key(e)).select("value", F.explode(F.array(F.col("pos"), F.col("pos") + (1 << 20))).alias("pos"))  # noqa: B023
        return None

    # data: live views.

    @staticmethod
    def _entity(s: str) -> str:
        if not s:
            raise EngineError(2, "Entity must be non-empty")
        return norm(s).replace(" ", "_")

    def data_types(self) -> DataFrame:
        return self._map(self.table("types"))

    def data_types_rev(self) -> DataFrame:
        return reverse_map(self.table("types"))

    def data_entity_exists(self, entity: str) -> DataFrame:
        rows = self.ontology.views.entities
        return self._test(rows.where(F.col("entity") == norm(entity).replace(" ", "_")))

    def _relatives(self, entity: str, up: bool, far: bool) -> DataFrame:
        m = self.table("types")
        m = m if up else reverse_map(m)
        return self._walk(m, self._entity(entity)) if far else listed(m, self._entity(entity))

    def data_parents(self, entity: str) -> DataFrame:
        return self._relatives(entity, True, False)

    def data_children(self, entity: str) -> DataFrame:
        return distinct_sorted(self._relatives(entity, False, False))

    def data_ancestors(self, entity: str) -> DataFrame:
        return distinct_sorted(self._relatives(entity, True, True))

    def data_descendants(self, entity: str) -> DataFrame:
        return self._relatives(entity, False, True)

    def _and_self(self, entity: str, up: bool, far: bool) -> DataFrame:
        """Nothing for an unknown entity."""
        rows = self._relatives(entity, up, far).select("value")
        me = self.ontology.views.entities.where(F.col("entity") == self._entity(entity)).select(F.col("entity").alias("value"))
        return distinct_sorted(rows.union(me))

    def data_parents_and_self(self, entity: str) -> DataFrame:
        return self._and_self(entity, True, False)

    def data_children_and_self(self, entity: str) -> DataFrame:
        return self._and_self(entity, False, False)

    def data_ancestors_and_self(self, entity: str) -> DataFrame:
        return self._and_self(entity, True, True)

    def data_descendants_and_self(self, entity: str) -> DataFrame:
        return self._and_self(entity, False, True)

    def data_has_parent(self, entity: str, parent: str) -> DataFrame:
        return self._test(self._relatives(entity, True, False).where(F.col("value") == parent))

    def data_has_ancestor(self, entity: str, ancestor: str) -> DataFrame:
        return self._test(self._relatives(entity, True, True).where(F.col("value") == ancestor))

    def data_labels(self, force_lowercase: bool = True) -> DataFrame:
        rows = self.ontology.views.live_labels
        if not force_lowercase:
            return self._map(rows)
        # Keys that fall together in lower case: the last one stands.
        return rows.groupBy(F.lower("key").alias("key")).agg(F.max_by("values", "ord").alias("values"), F.min("ord").alias("ord"))

    def data_labels_rev(self, force_lowercase: bool = True) -> DataFrame:
        rows = self.ontology.views.live_labels
        rows = rows.withColumn("key", F.lower("key")) if force_lowercase else rows
        flat = rows.select("key", "ord", F.posexplode("values").alias("at", "value"))
        return flat.groupBy(F.col("value").alias("key")).agg(F.array_sort(F.collect_list(F.struct("ord", "at", F.col("key").alias("k"))))["k"].alias("values"), F.min("ord").alias("ord"))

    def data_label_by_entity(self, entity: str, force_lowercase: bool = True) -> DataFrame:
        return self.data_labels(force_lowercase).where(F.col("key") == norm(entity).replace(" ", "_")).select(F.element_at("values", 1).alias("result"))

    def data_is_canon(self, text: str) -> DataFrame:
        return self.json_is_canon(norm(text).replace(" ", "_").replace("'", ""))

    def data_is_variant(self, text: str) -> DataFrame:
        return self.json_is_variant(norm(text).replace("_", " "))

    def data_find_variants(self, text: str) -> DataFrame:
        key = norm(text).replace("_", " ")
        forward = self.table("forward")
        own = forward.where(F.col("key") == key).select(F.explode("values").alias("value"))
        canons = self.table("back").where(F.col("key") == key).select(F.explode("values").alias("key")).join(forward, "key").select(F.explode("values").alias("value"))
        known = forward.where(F.col("key") == key).select(F.lit(1).alias("_k")).limit(1)
        rows = own.union(canons.join(F.broadcast(known), F.lit(True), "left_anti")).distinct()
        return rows.withColumn("pos", F.struct(F.length("value"), "value")).where(F.lit(key) != "")

    def data_synonyms(self) -> DataFrame:
        return self.table("forward").select("key", F.array_sort("values").alias("values"), "ord")

    def data_synonyms_rev(self) -> DataFrame:
        return self.table("back").select("key", F.array_sort("values").alias("values"), "ord")

    def data_equivalents(self, entities: str | list[str], flat_list: bool = True, underscore_entities: bool = True) -> DataFrame:
        names = [entities] if isinstance(entities, str) else entities
        if not isinstance(names, list):
            raise EngineError(2, "equivalents requires an entity or array")
        rows = self.table("equivalents").where(F.col("key").isin([norm(n.replace("_", " ")) for n in names]))
        if not flat_list:
            return self._map(rows)
        value = F.explode("values").alias("value")
        rows = rows.select(value)
        return distinct_sorted(rows.withColumn("value", F.replace("value", F.lit(" "), F.lit("_"))) if underscore_entities else rows)

    def data_find_ner(self, *_) -> DataFrame:
        return self.spark.createDataFrame([("NER",)], "result string")

    def data_ner_depth(self) -> DataFrame:
        return self.ontology.views.ner_depth.select(F.col("tag").alias("key"), F.array(F.col("depth").cast("string")).alias("values"), F.lit(0).cast("long").alias("ord"))

    def data_ner_depth_rev(self) -> DataFrame:
        """A kept quirk: depths are reversed by digit."""
        rows = self.ontology.views.ner_depth.select("tag", F.explode(F.split(F.col("depth").cast("string"), "")).alias("key")).where("key <> ''")
        return rows.groupBy("key").agg(F.array_sort(F.collect_list("tag")).alias("values"), F.lit(0).cast("long").alias("ord"))

    def data_ner_taxonomy(self) -> DataFrame:
        return self.ontology.views.ner_taxonomy.select(F.col("tag").alias("key"), F.array("taxonomy").alias("values"), F.lit(0).cast("long").alias("ord"))

    def data_ner_taxonomy_rev(self) -> DataFrame:
        return self.ontology.views.ner_taxonomy.groupBy(F.col("taxonomy").alias("key")).agg(F.array_sort(F.collect_list("tag")).alias("values"), F.lit(0).cast("long").alias("ord"))

    def data_graffl_ner(self) -> DataFrame:
        return self.spark.createDataFrame([], "key string, values array<string>, ord long")

    data_graffl_ner_rev = data_graffl_ner

    def data_infer_by_requires(self, *_) -> DataFrame:
        raise EngineError(4, "infer_by_requires is not implemented")

    def _relation(self, method: str) -> Callable | None:
        for predicate, names in RELATIONS.items():
            if method in names:
                return lambda *entity: self._custom(predicate, names.index(method), *entity)  # noqa: B023
        return None

    def _custom(self, predicate: str, form: int, *entity: str) -> DataFrame:
        if self.ontology.views.namespace is None:
            raise EngineError(4, "Unknown ontology namespace prefix")
        m = self.ontology.views.custom(predicate)
        if form % 2:
            m = reverse_map(m)
        if form < 2:
            return self._map(m)
        key = norm(entity[0]).replace(" ", "_")
        if predicate != "similarTo":
            return listed(m, key)
        return listed(m, key).union(listed(reverse_map(m), key).select("value", F.col("pos") + (1 << 20)))

    def data_by_predicate(self, key: str, to_lowercase: bool = True, reverse: bool = False) -> DataFrame:
        return self.owl_by_predicate(key, to_lowercase, reverse)

    def data_by_predicate_rev(self, key: str, to_lowercase: bool = True) -> DataFrame:
        return self.owl_by_predicate(key, to_lowercase, True)

    # owl: the graph itself.

    def _flat(self, predicate: str, end: str, lower: bool) -> DataFrame:
        rows = self.ontology.views.of(predicate)
        flat = graph.flattened(rows, end, lower, self.ontology.views.blanks)
        return flat.select(F.col(f"{end}_value").alias("value"), F.struct("ord", f"{end}_path").alias("pos"))

    def owl_labels(self) -> DataFrame:
        return self._flat(RDFS + "label", "o", False)

    def owl_entities(self) -> DataFrame:
        return self._flat(RDFS + "label", "s", False)

    def owl_types(self, to_lowercase: bool = True) -> DataFrame:
        return self._flat(RDF + "type", "s", to_lowercase)

    def owl_ngrams(self, level: int = 1) -> DataFrame:
        return self._flat(RDFS + "subClassOf", "s", True).where(F.length("value") - F.length(F.replace("value", F.lit("_"), F.lit(""))) == level - 1)

    def owl_keyed_labels(self) -> DataFrame:
        return self._map(self.table("labels"))

    def owl_entity_exists(self, entity: str) -> DataFrame:
        return self._test(self.ontology.views.of(RDFS + "label").where(graph.local(F.col("s")) == entity))

    def owl_predicates(self) -> DataFrame:
        """Prefixes with local names; the empty prefix is always there."""
        key = graph.predicate_key(F.col("p"))
        rows = self.ontology.triples.groupBy("p").agg(F.min("ord").alias("ord")).select(F.split_part(key, F.lit(":"), F.lit(1)).alias("key"), graph.local(F.col("p")).alias("name"), "ord")
        found = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "name")))["name"].alias("values"), F.min("ord").alias("ord"))
        empty = self.spark.createDataFrame([("",)], "key string").join(rows.select("key").distinct(), "key", "left_anti")
        return found.union(empty.select("key", F.array().cast("array<string>"), F.lit(1 << 60).cast("long")))

    def _plain_edges(self, up: bool) -> DataFrame:
        rows = self.ontology.views.of(RDFS + "subClassOf").where("s_kind = 'iri' AND o_kind = 'iri'")
        a, b = ("s", "o") if up else ("o", "s")
        return rows.groupBy(graph.local(F.col(a)).alias("a"), graph.local(F.col(b)).alias("b")).agg(F.min("ord").alias("ord"))

    def _owl_direct(self, entity: str, up: bool) -> DataFrame:
        if re.search(r"[ \t\n\v\f\r]", entity):
            raise EngineError(4, f"Invalid prefixed entity name: {entity}")
        near = self._plain_edges(up).where(F.col("a") == entity).select(F.col("b").alias("value"), F.struct(F.lit(1).alias("k"), "ord", F.array().cast("array<bigint>").alias("path")).alias("pos"))
        if self.ontology.views.blanks is None:
            return near
        own, other = ("s", "o") if up else ("o", "s")
        odd = self.ontology.views.of(RDFS + "subClassOf").where((F.col(f"{own}_kind") == "iri") & (F.col(f"{other}_kind") == "blank") & (graph.local(F.col(own)) == entity))
        flat = graph.flattened(odd, other, False, self.ontology.views.blanks).where(F.col(f"{other}_value") != "nil")
        return flat.select(F.col(f"{other}_value").alias("value"), F.struct(F.lit(0).alias("k"), "ord", F.col(f"{other}_path").alias("path")).alias("pos")).union(near)

    def owl_parents(self, entity: str) -> DataFrame:
        return self._owl_direct(entity, True)

    def owl_children(self, entity: str) -> DataFrame:
        return self._owl_direct(entity, False)

    def _owl_walk(self, entity: str, up: bool) -> DataFrame:
        if re.search(r"[ \t\n\v\f\r]", entity):
            raise EngineError(4, f"Invalid prefixed entity name: {entity}")
        walks = graph.closure(self._plain_edges(up), self.spark.createDataFrame([(entity,)], "root string"), tolerant=True)
        return walks.groupBy(F.col("node").alias("value")).agg(F.min("path").alias("pos"))

    def owl_ancestors(self, entity: str) -> DataFrame:
        """In reverse order of bytes; cycles are allowed."""
        rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("value")))
        return self._owl_walk(entity, True).select("value", rank.alias("pos"))

    def owl_descendants(self, entity: str) -> DataFrame:
        return self._owl_walk(entity, False)

    def owl_by_predicate(self, key: str, to_lowercase: bool = True, reverse: bool = False) -> DataFrame:
        """(key, values, ord) of a prefixed name; a bare one is in the namespace whose prefix is the ontology's name.

        In a collection each source with that prefix answers, and the answers are merged.
        """
        found = None
        for o in self.ontology.parts or (self.ontology,):
            prefix, colon, name = key.partition(":")
            space = o.prefixes.get(prefix) or BUILT_IN.get(prefix) if colon else o.prefixes.get(o.options.name)
            if space is None or o.triples is None:
                continue
            part = graph.predicate_map(o.triples, space + (name if colon else key), to_lowercase, reverse)
            found = part if found is None else found.union(part)
        if found is None:
            raise EngineError(4, f"Unknown namespace prefix: {key.partition(':')[0] if ':' in key else self.ontology.options.name}")
        if not self.ontology.parts:
            return found
        return found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"), F.min("ord").alias("ord"))

    def owl_by_predicate_rev(self, key: str, to_lowercase: bool = True) -> DataFrame:
        return self.owl_by_predicate(key, to_lowercase, True)

    # Over the parents of an entity.

    def transitive(self, entity: str, method: str, interface: str | None = None) -> DataFrame:
        """What `parents`, `children` or another relation lists for an entity and for all on the way up, depth first."""
        if method in ("", "transitive"):
            raise EngineError(2, "transitive requires a query method name")
        interface = interface or self.ontology.options.interface
        up = self.table("types") if interface == "data" else self.table("parents")
        related = {"parents": up, "children": reverse_map(up) if interface == "data" else self.table("children")}.get(method)
        if related is None:
            related = {"synonyms": self.table("forward"), "find_variants": self.table("forward"), "label_by_entity": self.table("labels"), "equivalents": self.table("equivalents")}.get(method)
        if related is None:
            raise EngineError(4, f"Unsupported method for transitive: {method}")
        start = self._entity(entity) if interface == "data" else entity
        first = F.array().cast("array<bigint>")
        me = self.spark.createDataFrame([(start,)], "node string").withColumn("path", first)
        walks = graph.closure(edges_of(up), self.spark.createDataFrame([(start,)], "root string")).select("node", "path")
        return me.union(walks).join(related, F.col("node") == F.col("key")).select(F.posexplode("values").alias("at", "value"), "path").select("value", F.struct("path", "at").alias("pos"))


__all__ = ["CUSTOM", "Finder", "canonical", "distinct_sorted", "edges_of", "listed", "reverse_map"]
