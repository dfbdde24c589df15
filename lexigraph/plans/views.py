"""The tables that an ontology gives: labels, predicates, vocabulary, lookup, span rules, hierarchy.

Each is a plan over triples. Only what works on one literal at a time (its variants, its span rules)
runs in Python, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary
from ..functions.lazy import column_function
from ..functions.text import split_commas
from ..sources.rdf import OWL, RDF, RDFS, SKOS
from .graph import blank_values, flattened, local, normal, predicate_key, predicate_map, reached, schema_of, trimmed
from .storage import BROADCAST_ROWS, checkpointed

META = ["NamedIndividual", "Thing", "Class", "Ontology", "ObjectProperty", "DatatypeProperty", "AnnotationProperty"]
CUSTOM = ["effects", "requires", "similarTo", "implies", "uses"]
BY_LENGTH = lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0)


#: Rows of a batch that are Python objects at once.
PART_ROWS = 1 << 10
STRINGS = pa.list_(pa.string())


def objects(column: pa.Array) -> list:
    """The values of strings, or of lists of them, in one piece and not one by one, which takes ten times as long."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    flat, end = objects(column.flatten()), 0
    return [None if n is None else flat[end : (end := end + n)] for n in pc.list_value_length(column).to_pylist()]


def row_function(returns: str, made: pa.DataType) -> Callable[[Callable], Callable[..., Column]]:
    """A function of one row's values as a column function, in Arrow batches."""

    def wrap(function: Callable) -> Callable[..., Column]:
        def run(*columns: pa.Array) -> pa.Array:
            parts = ([objects(c.slice(at, PART_ROWS)) for c in columns] for at in range(0, len(columns[0]), PART_ROWS))
            return pa.concat_arrays([pa.array([], made), *(pa.array(list(map(function, *part)), made) for part in parts)])

        return column_function(F.arrow_udf, returns)(run)

    return wrap


@row_function("array<string>", STRINGS)
def _variants(literals: list[str] | None) -> list[str]:
    return vocabulary.variants(literals or ())


@row_function("array<struct<n:int,text:string>>", pa.list_(pa.struct([("n", pa.int32()), ("text", pa.string())])))
def _entries(canon: str, forms: list[str]) -> list[tuple[int, str]]:
    return vocabulary.base_entries(canon, forms)


@row_function("array<string>", STRINGS)
def _split_commas(text: str) -> list[str]:
    return split_commas(text)


@row_function("array<struct<plus:boolean,key:string,content:array<string>>>", pa.list_(pa.struct([("plus", pa.bool_()), ("key", pa.string()), ("content", STRINGS)])))
def _rules(canon: str, literals: list[str], compounds: list[str] | None) -> list[tuple[bool, str, tuple[str, ...]]]:
    """A rule of plus signs is known by its key too; an ordinary one that repeats another's words is left out."""
    plus = dict.fromkeys((True, k, w) for k, w in vocabulary.plus_rules(canon, literals, {canon, *(compounds or ())} if "_" in canon else set(compounds or ())))
    ordinary: dict[tuple[str, ...], str] = {}
    for k, w in vocabulary.phrase_rules(canon, literals):
        ordinary.setdefault(w, k)
    return [*plus, *((False, k, w) for w, k in ordinary.items())]


def grouped(raw: DataFrame) -> DataFrame:
    """(canon, literals, ord) of (canon, value, ord): the literals of each canonical form, in order."""
    own = raw.groupBy("canon").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("v"), F.min("ord").alias("ord"))
    return own.select("canon", F.col("v.value").alias("literals"), "ord")


def variants_of(own: DataFrame) -> DataFrame:
    """(canon, variants, ord) of `grouped` literals: what each canonical form is found as."""
    return own.select("canon", _variants("literals").alias("variants"), "ord")


def reversed_of(forward: DataFrame, live: bool = False) -> DataFrame:
    """(variant, canons, ord): the canonical forms of a variant, in order of declaration, or of bytes for the live view."""
    rows = forward.select("canon", "ord", F.posexplode("variants").alias("pos", "variant"))
    canons = F.array_sort(F.collect_list(F.struct("ord", "canon")))["canon"]
    out = rows.groupBy("variant").agg(canons.alias("canons"), F.min(F.struct("ord", "pos")).alias("ord"))
    return out.withColumn("canons", F.array_sort("canons")) if live else out


def lookup_of(forward: DataFrame) -> DataFrame:
    """(words, entry): entries by number of words, and those in which a leading phrase is already collapsed.

    A phrase of n words lies within an entry of n + 1 words if it is an end of one word, the words between as
    they are, and a beginning of another, one or two places in. All these are spelt out, some hundred for an
    entry, and joined with the phrases as they are. A round reads entries of one length only, and what the rounds
    before it made; lengths that no entry has need no round.
    """
    entries = forward.select(F.explode(_entries("canon", "variants")).alias("e")).select(F.col("e.n").alias("words"), F.col("e.text").alias("entry")).distinct()
    entries, made = checkpointed(entries), None
    lengths = {n for (n,) in entries.where("words BETWEEN 3 AND 6").select("words").distinct().collect()}
    for n in (5, 4, 3, 2):
        if made is None and n + 1 not in lengths:
            continue
        source = entries.where(F.col("words") == n + 1)
        source = (source if made is None else source.union(made.where(F.col("words") == n + 1)).distinct()).withColumn("w", F.split("entry", " "))
        gram = F.slice("w", 1, n)
        grams = source.where(~F.arrays_overlap(gram, F.array(*map(F.lit, sorted(vocabulary.GRAM_STOPS))))).select(F.array_join(gram, " ").alias("gram")).distinct()
        within = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(2)), lambda at: spellings(F.col("w"), at, n))))  # noqa: B023
        hits = source.select("entry", F.explode(within).alias("gram")).join(grams, "gram")
        new = hits.select(F.replace("entry", "gram", F.replace("gram", F.lit(" "), F.lit("_"))).alias("entry"))
        new = new.select(F.size(F.split("entry", " ")).alias("words"), "entry").where("words BETWEEN 2 AND 5")
        # A round reads the ones before it twice, so each is written down.
        made = checkpointed((new if made is None else made.union(new)).distinct()) if n > 2 else new if made is None else made.union(new)
    return entries if made is None else entries.union(made).distinct()


def spellings(words: Column, at: Column, n: int) -> Column:
    """Every end of the word at `at`, the n - 2 words after it, and every beginning of the next: all that a phrase of n words can be there."""
    first, last = F.element_at(words, at), F.element_at(words, at + (n - 1))
    ends = F.transform(F.sequence(F.lit(0), F.length(first)), lambda k: F.right(first, k))
    starts = F.transform(F.sequence(F.lit(0), F.length(last)), lambda k: F.left(last, k))
    inner = F.concat(F.lit(" "), F.array_join(F.slice(words, at + 1, n - 2), " "), F.lit(" ")) if n > 2 else F.lit(" ")
    return F.flatten(F.transform(ends, lambda a: F.transform(starts, lambda b: F.concat(a, inner, b))))


def rules_of(raw: DataFrame, distance: int = 4, plus_only: bool = False, comma_lists: bool = False) -> DataFrame:
    """(key, content, canon, distance, ord): span rules of (canon, value, ord)."""
    if comma_lists:
        raw = raw.withColumn("value", F.explode(_split_commas("value")))
    return spans_of(grouped(raw), distance, plus_only)


def spans_of(own: DataFrame, distance: int = 4, plus_only: bool = False) -> DataFrame:
    """`rules_of` literals that are grouped."""
    own = own.withColumn("literals", F.array_distinct("literals"))
    keys = own.where(F.contains("canon", F.lit("_"))).select(F.col("canon").alias("pair"))
    words = own.select("canon", F.explode("literals").alias("value")).select("canon", F.split("value", " ").alias("w")).where(F.size("w") > 1)
    pairs = words.select("canon", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.element_at("w", i), F.lit("_"), F.element_at("w", i + 1)))).alias("pair"))
    # Most are the canonical form that they belong to, which is known to be one.
    pairs = pairs.where("pair <> canon")
    compounds = pairs.join(keys, "pair", "left_semi").groupBy("canon").agg(F.collect_set("pair").alias("compounds"))
    rows = own.join(compounds, "canon", "left").select("canon", "ord", F.posexplode(_rules("canon", "literals", "compounds")).alias("pos", "r")).select("canon", "ord", "pos", "r.*")
    place = F.struct(F.when(F.col("plus"), 0).otherwise(1).alias("pass"), "ord", "pos")
    rules = rows.select("plus", "canon", "content", "key", place.alias("ord"))
    if plus_only:
        return rules.where("plus").select("key", "content", "canon", F.lit(distance).alias("distance"), "ord")
    rules = checkpointed(rules)
    # Of keys that differ in white space at their ends only, the one that came last replaces the others.
    firsts = rules.groupBy("key").agg(F.min("ord").alias("first"))
    last = checkpointed(firsts.groupBy(trimmed(F.col("key")).alias("trimmed")).agg(F.max_by("key", "first").alias("key")))
    # A few keys may have nearly all rules, which are not sent to one task each.
    last = F.broadcast(last) if last.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else last
    return rules.join(last, "key").select(F.col("trimmed").alias("key"), "content", "canon", F.lit(distance).alias("distance"), "ord")


class Views:
    """The tables of one triples table; each is made when first asked for."""

    def __init__(self, triples: DataFrame, distance: int = 4, class_based: bool = False, comma_lists: bool = False, namespace: str | None = None):
        self.triples, self.distance, self.class_based, self.comma_lists, self.namespace = triples, distance, class_based, comma_lists, namespace

    def of(self, predicate: str) -> DataFrame:
        return self.triples.where(F.col("p") == predicate)

    @cached_property
    def _shape(self) -> tuple[str, bool]:
        """The schema, and whether there are blank nodes, by one job."""
        row = schema_of(self.triples).first()
        return row["schema"], bool(row["blanks"])

    @cached_property
    def blanks(self) -> DataFrame | None:
        return blank_values(self.triples) if self._shape[1] else None

    @cached_property
    def mixed(self) -> bool:
        return not self.class_based and self._shape[0] == "MIXED"

    @cached_property
    def labels(self) -> DataFrame:
        """(key, label, ord): the last label of a local name, at the place of the first."""
        rows = self.of(RDFS + "label").select(trimmed(local(F.col("s"))).alias("key"), trimmed(F.col("o")).alias("label"), "ord")
        return rows.groupBy("key").agg(F.max_by("label", "ord").alias("label"), F.min("ord").alias("ord"))

    @cached_property
    def ner(self) -> DataFrame:
        return self.of(RDFS + "label").groupBy(trimmed(F.col("o")).alias("label")).agg(F.lit("NER").alias("ner"), F.min("ord").alias("ord"))

    @cached_property
    def facts(self) -> DataFrame:
        """(pk, subject, value, ord): all triples but comments, flattened and lower-cased."""
        rows = self.triples.withColumn("pk", predicate_key(F.col("p"))).where("pk <> 'rdfs:comment'")
        rows = flattened(flattened(rows, "s", True, self.blanks), "o", True, self.blanks)
        return rows.select("pk", F.col("s_value").alias("subject"), F.col("o_value").alias("value"), "ord")

    @cached_property
    def by_predicate(self) -> DataFrame:
        """(pk, subject, values, ord); a subject of which every value is removed keeps an empty list."""
        value = F.when((F.col("value") != F.col("subject")) & ~F.col("value").isin("", "nil"), F.col("value"))
        return self.facts.where(~F.col("subject").isin("class", "nil")).groupBy("pk", "subject").agg(F.array_sort(F.collect_set(value)).alias("values"), F.min("ord").alias("ord"))

    @cached_property
    def predicates(self) -> DataFrame:
        return self.facts.where("startswith(pk, ':')").groupBy("pk").agg(F.min("ord").alias("ord"))

    @cached_property
    def raw(self) -> DataFrame:
        """(canon, value, ord): distinct literals of labels, synonyms, see-also and inflections."""
        p = F.col("p")
        rows = self.triples.where(p.isin(RDFS + "label", RDFS + "seeAlso", SKOS + "altLabel") | (local(p) == "inflection"))
        rows = flattened(rows, "o", True, self.blanks).withColumn("canon", normal(local(F.col("s")))).where("o_value NOT IN ('', 'nil')")
        return rows.groupBy("canon", F.col("o_value").alias("value")).agg(F.min("ord").alias("ord"))

    @cached_property
    def _own(self) -> DataFrame:
        """`raw` grouped and written once, for the tables that are made of it."""
        return checkpointed(grouped(self.raw))

    @cached_property
    def forward(self) -> DataFrame:
        """(canon, variants, ord), written once, as the ways back and the lookup are made of it too."""
        if not self.comma_lists:
            return checkpointed(variants_of(self._own))
        split = self.raw.select("canon", F.explode(_split_commas("value")).alias("value"), "ord")
        return checkpointed(variants_of(grouped(split.groupBy("canon", "value").agg(F.min("ord").alias("ord")))))

    @cached_property
    def back(self) -> DataFrame:
        return reversed_of(self.forward)

    @cached_property
    def lookup(self) -> DataFrame:
        return lookup_of(self.forward)

    @cached_property
    def spans(self) -> DataFrame:
        return rules_of(self.raw, self.distance, comma_lists=True) if self.comma_lists else spans_of(self._own, self.distance)

    @cached_property
    def _edges(self) -> DataFrame:
        """(child, parent, ord, link): subclass edges, and types of individuals in a mixed ontology; case kept, `nil` left out."""
        sub = flattened(self.of(RDFS + "subClassOf"), "o", False, self.blanks).where("o_value <> 'nil'")
        sub = sub.select(local(F.col("s")).alias("child"), F.col("o_value").alias("parent"), "ord", F.col("o_path").alias("path"), F.lit("sub").alias("link"), F.col("o_kind") == "iri")
        sub = sub.toDF("child", "parent", "ord", "path", "link", "iri")
        if not self.mixed:
            return sub
        typed = self.of(RDF + "type").where("o_kind = 'iri'").select(local(F.col("s")).alias("child"), local(F.col("o")).alias("parent"), "ord", F.array().cast("array<bigint>").alias("path"), F.lit("type").alias("link"), F.lit(True).alias("iri"))
        return sub.unionByName(typed.where(~F.col("parent").isin(META)))

    def _adjacent(self, key: str, value: str, rows: DataFrame) -> DataFrame:
        first = rows.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.min(F.struct("ord", "path")).alias("at"))
        return first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "value")))["value"].alias("values"), F.min("at.ord").alias("ord"))

    @cached_property
    def parents(self) -> DataFrame:
        """(key, values, ord) of labelled children."""
        rows = self._edges.where("iri") if self.mixed else self._edges
        return self._adjacent("child", "parent", rows.join(self.labels.select(F.col("key").alias("child")), "child", "left_semi"))

    @cached_property
    def children(self) -> DataFrame:
        """(key, values, ord) of labelled parents; types count for named individuals only."""
        rows = self._edges.join(self.labels.select(F.col("key").alias("parent")), "parent", "left_semi")
        if self.mixed:
            named = self.of(RDF + "type").where(F.col("o") == OWL + "NamedIndividual").select(local(F.col("s")).alias("child")).distinct()
            rows = rows.where("link = 'sub'").unionByName(rows.where("link = 'type'").join(named, "child", "left_semi").select(*rows.columns))
        return self._adjacent("parent", "child", rows)

    @cached_property
    def equivalents(self) -> DataFrame:
        """(key, values, ord): equivalent classes with labels, both ways, lower-cased."""
        rows = self.of(OWL + "equivalentClass").where("o_kind = 'iri'").select(local(F.col("s")).alias("a"), local(F.col("o")).alias("b"), "ord")
        names = self.labels.select(F.col("key").alias("k"))
        rows = rows.join(names.withColumnRenamed("k", "a"), "a", "left_semi").join(names.withColumnRenamed("k", "b"), "b", "left_semi").select(F.lower("a").alias("a"), F.lower("b").alias("b"), "ord")
        both = rows.select(F.col("a").alias("key"), F.col("b").alias("value"), (2 * F.col("ord")).alias("ord")).union(rows.select("b", "a", 2 * F.col("ord") + 1))
        first = both.groupBy("key", "value").agg(F.min("ord").alias("ord"))
        return first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "value")))["value"].alias("values"), F.min("ord").alias("ord"))

    @cached_property
    def sub_entities(self) -> DataFrame:
        return self.of(RDFS + "subClassOf").groupBy(normal(local(F.col("s"))).alias("entity")).agg(F.min("ord").alias("ord"))

    @cached_property
    def ngrams(self) -> DataFrame:
        """(level, entity, ord): subclasses (labelled names in a mixed ontology) by number of underscores, 1 to 9."""
        rows = self.labels.groupBy(F.lower("key").alias("entity")).agg(F.min("ord").alias("ord")) if self.mixed else self.sub_entities
        return rows.select((F.length("entity") - F.length(F.replace("entity", F.lit("_"), F.lit(""))) + 1).alias("level"), "entity", "ord").where("level <= 9")

    # The live view.

    @cached_property
    def live_labels(self) -> DataFrame:
        return predicate_map(self.triples, RDFS + "label", lower=False)

    def custom(self, name: str, reverse: bool = False) -> DataFrame:
        """(key, values, ord) of effects, requires, similarTo, implies or uses, in the ontology's own namespace."""
        return predicate_map(self.triples, f"{self.namespace}{name}", True, reverse)

    @cached_property
    def entities(self) -> DataFrame:
        """(entity, ord): all subclasses and superclasses, lower-cased."""
        rows = self.by_predicate.where("pk = 'rdfs:subClassOf'")
        every = rows.select(F.col("subject").alias("entity"), F.struct("ord", F.lit(-1).alias("pos")).alias("at")).union(rows.select(F.posexplode("values").alias("pos", "entity"), "ord").select("entity", F.struct("ord", "pos")))
        return every.groupBy("entity").agg(F.min("at").alias("ord"))

    @cached_property
    def ner_tags(self) -> DataFrame:
        """(tag, node, ord): upper-cased tags of entities."""
        rows = flattened(self.of(OWL + "backwardCompatibleWith"), "o", False, self.blanks)
        return rows.select(F.upper("o_value").alias("tag"), F.col("s").alias("node"), "ord")

    @cached_property
    def _up(self) -> DataFrame:
        """(root, node): each tagged or reachable resource with all that it reaches by subclass edges, itself included."""
        edges = self.of(RDFS + "subClassOf").select(F.col("s").alias("a"), F.col("o").alias("b"), "ord")
        nodes = edges.select("a").union(edges.select("b")).union(self.ner_tags.select("node")).distinct()
        return checkpointed(reached(edges).union(nodes.select("a", "a")).distinct())

    @cached_property
    def ner_depth(self) -> DataFrame:
        """(tag, depth): for a tag, how many (superclass, root) pairs its entities reach; `NER` has 0."""
        edges = self.of(RDFS + "subClassOf").where("s <> o").select(F.col("s").alias("root"))
        roots = self.of(RDF + "type").where(F.col("o") == OWL + "Class").select(F.col("s").alias("node")).distinct().join(edges, F.col("node") == F.col("root"), "left_anti")
        reached = self._up.join(roots, "node").groupBy(F.col("root").alias("node")).agg(F.count("*").alias("n"))
        counts = self.ner_tags.join(self._up.select(F.col("root").alias("start"), F.col("node").alias("mid")), F.col("node") == F.col("start")).join(reached.withColumnRenamed("node", "at"), F.col("mid") == F.col("at"))
        counts = counts.groupBy("tag").agg(F.sum("n").alias("depth"))
        return counts.where("tag <> 'NER'").union(counts.limit(1).select(F.lit("NER"), F.coalesce(F.lit(None).cast("long"), F.lit(0).cast("long"))))

    @cached_property
    def ner_taxonomy(self) -> DataFrame:
        """(tag, taxonomy): a tag found on the way up from a tag's entity, the last one declared."""
        up = self._up.toDF("start", "mid")
        upper = self.ner_tags.toDF("taxonomy", "at", "up_ord")
        rows = self.ner_tags.join(up, F.col("node") == F.col("start")).join(upper, F.col("mid") == F.col("at"))
        return rows.groupBy("tag").agg(F.max_by("taxonomy", F.struct("ord", F.col("mid") != F.col("node"), "up_ord")).alias("taxonomy"))


def by_length(a: Column) -> Column:
    """Strings by code points, then bytes."""
    return F.array_sort(a, BY_LENGTH)
