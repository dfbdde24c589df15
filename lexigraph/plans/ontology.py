"""The ontology handle: loading, collections, updates, snapshots and the index for matching.

A handle never changes; an update gives a new one. Its tables are plans; the driver only holds
what matching needs, the vocabulary, which is then broadcast once for each handle.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import vocabulary
from ..functions.text import by_length, norm, split_commas, trim
from ..operators.matching import MatchIndex
from ..sources import reader, turtle
from ..sources.rdf import DEFAULT_PREFIXES, RDFS, SKOS, Graph
from . import graph
from .storage import BROADCAST_ROWS, checkpointed
from .views import Views, lookup_of, reversed_of

#: Rows, and characters, of a vocabulary table that the driver may hold; a larger vocabulary cannot be an in-memory index.
MAX_VOCABULARY, MAX_CHARACTERS = 20_000_000, 1 << 30
#: Subjects of an update up to which the literals that the driver holds are patched instead of read again.
MAX_PATCH = 10_000


@dataclass(frozen=True)
class Options:
    """distance is part of the handle, so that one load's value never leaks into the next."""

    name: str = "ontology"
    base: str = ""
    class_based: bool = False
    distance: int = 4
    interface: str = "json"
    comma_lists: bool = False
    directory: str = ""


def external_synonyms(text: str) -> dict[str, list[str]]:
    """Variants by canonical form, from lines `canon~variant, variant`; `#` begins a comment; the longest come first."""
    out: dict[str, dict[str, None]] = {}
    for line in text.split("\n"):
        clean = norm(line)
        if not clean or clean.startswith("#") or clean.count("~") != 1:
            continue
        canon, _, values = clean.partition("~")
        for v in sorted((norm(x) for x in values.split(",")), key=lambda v: (-len(v), v)):
            if v:
                out.setdefault(norm(canon), {})[v] = None
    return {k: list(v) for k, v in out.items()}


@dataclass(frozen=True, eq=False)
class Ontology:
    spark: SparkSession
    triples: DataFrame | None
    options: Options = field(default_factory=Options)
    prefixes: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULT_PREFIXES))
    external: Mapping[str, list[str]] = field(default_factory=dict)
    parts: tuple[Ontology, ...] = ()
    view: Mapping | None = None  # of a prepared snapshot, which has no triples

    # Loading.

    @classmethod
    def load(cls, spark: SparkSession, path: str | None = None, content: str | None = None, format: str | None = None, **options) -> Ontology:
        """From a file or from text, in Turtle, JSON, JSONL or as a prepared snapshot."""
        if (path is None) == (content is None):
            raise EngineError(2, "Give either path or content")
        name = options.pop("name", None) or (os.path.splitext(os.path.basename(path))[0] if path else "ontology")
        o = Options(name=name, directory=(os.path.dirname(path) or ".") if path else "", **options)
        found = reader.read_source(reader.read_file(path) if path else content, format, o.base or (reader.file_base(path) if path else ""))
        if not isinstance(found, Graph):
            return cls(spark, None, o, view=found)
        external = {}
        if path and o.interface == "data" and os.path.exists(path + ".txt"):
            external = external_synonyms(reader.read_file(path + ".txt"))
        return cls(spark, graph.from_graph(spark, found).cache(), o, found.prefixes, external)

    @classmethod
    def from_triples(cls, triples: DataFrame, prefixes: Mapping[str, str] | None = None, **options) -> Ontology:
        """From a triples table, for instance one made of relational tables by `graph.facts`."""
        return cls(triples.sparkSession, triples, Options(**options), dict(DEFAULT_PREFIXES) | dict(prefixes or {}))

    @classmethod
    def collect(cls, parts: Sequence[Ontology], name: str = "collection") -> Ontology:
        """Several ontologies in order: views are merged, arrays united, the first source's scalars win; blank nodes stay apart."""
        if not parts:
            raise EngineError(2, "A collection needs a source")
        first = parts[0]
        whole = all(p.triples is not None for p in parts)
        prefixes: dict[str, str] = {}
        for p in parts:
            for k, v in p.prefixes.items():
                prefixes.setdefault(k, v)
        o = Options(name, first.options.base, first.options.class_based, first.options.distance, first.options.interface, first.options.comma_lists, first.options.directory)
        return cls(first.spark, graph.merge([p.triples for p in parts]) if whole else None, o, prefixes, parts=tuple(parts))

    # Tables.

    @cached_property
    def views(self) -> Views:
        if self.triples is None:
            raise EngineError(4, "A snapshot has no graph")
        return Views(self.triples, self.options.distance, self.options.class_based, self.options.comma_lists, self.prefixes.get(self.options.name))

    @property
    def live(self) -> bool:
        return self.options.interface == "data"

    def schema(self) -> str:
        if self.triples is None:
            raise EngineError(4, "A snapshot has no graph")
        return graph.schema_of(self.triples).first()[0]

    def _rows(self, df: DataFrame, *columns: str) -> list:
        return bounded(df.orderBy("ord").select(*columns), df.select(*columns)).collect()

    @cached_property
    def _literals(self) -> list[tuple[int, str, str, str, str | None]]:
        """(ord, value, subject, canon, label) of every label, synonym, see-also and inflection, in order, by one job.

        This is what the match index is made of; label is null where the literal is no label.
        """
        v, p = self.views, F.col("p")
        rows = v.triples.where(p.isin(RDFS + "label", RDFS + "seeAlso", SKOS + "altLabel") | (graph.local(p) == "inflection"))
        rows = graph.flattened(rows, "o", True, v.blanks).select("ord", F.col("o_value").alias("value"), "s", graph.normal(graph.local(F.col("s"))).alias("canon"), F.when(p == RDFS + "label", graph.trimmed(F.col("o"))).alias("label"))
        return sorted(zip(*(c.to_pylist() for c in bounded(rows, rows).toArrow().columns), strict=True), key=lambda r: r[:2])

    @cached_property
    def _raw(self) -> dict[str, list[str]]:
        """Distinct literals by canonical form."""
        out: dict[str, dict[str, None]] = {}
        for _, value, _, canon, _ in self._literals:
            if value not in ("", "nil"):
                out.setdefault(canon, {})[value] = None
        return {k: list(v) for k, v in out.items()}

    @cached_property
    def synonyms(self) -> dict[str, dict]:
        """lookup, fwd and rev, in order; the live view adds external synonyms and sorts by bytes."""
        if self.view is not None:
            y = self.view["synonyms"]
            return {"lookup": {int(k): g for k, g in (y.get("lookup") or {}).items()}, "fwd": y.get("fwd") or {}, "rev": y.get("rev") or {}}
        if self.parts:
            fwd: dict[str, dict] = {}
            rev: dict[str, dict] = {}
            for p in self.parts:
                for into, own in ((fwd, p.synonyms["fwd"]), (rev, p.synonyms["rev"])):
                    for k, values in own.items():
                        into.setdefault(k, {}).update(dict.fromkeys(values))
            fwd, rev = ({k: list(v) for k, v in x.items()} for x in (fwd, rev))
            return {"lookup": vocabulary.lookup(fwd), "fwd": fwd, "rev": rev}
        raw = self._raw
        if self.options.comma_lists:
            raw = {k: own for k, vs in raw.items() if (own := list(dict.fromkeys(x for v in vs for x in split_commas(v))))}
        fwd = vocabulary.synonyms(raw)
        rev = vocabulary.reverse(fwd)
        if self.live:
            for canon, values in self.external.items():
                fwd[canon] = list(dict.fromkeys([*fwd.get(canon, ()), *values]))
                for x in values:
                    rev[x] = list(dict.fromkeys([*rev.get(x, ()), canon]))
            fwd, rev = ({k: sorted(v, key=str.encode) for k, v in x.items()} for x in (fwd, rev))
        return {"lookup": vocabulary.lookup(fwd), "fwd": fwd, "rev": rev}

    @cached_property
    def span_rules(self) -> dict[str, list[dict]]:
        if self.view is not None:
            return self.view.get("spans") or {}
        if self.parts:
            out: dict[str, list[dict]] = {}
            for p in self.parts:
                for k, rules in p.span_rules.items():
                    out.setdefault(k, []).extend(r for r in rules if r not in out.get(k, ()))
            return out
        return vocabulary.spans(self._raw, self.options.distance, comma_lists=self.options.comma_lists)

    @cached_property
    def index(self) -> MatchIndex:
        """What matching reads; pickled, it is one broadcast."""
        entities: Iterable[str] = ()
        if self.view is not None:
            entities, ner = self.view.get("entities") or (), self.view.get("ner") or {}
        else:
            entities = [r[0] for r in self._rows(self.views.entities, "entity")] if self.live else ()
            plain = not self.parts and self.views.blanks is None
            ner = dict.fromkeys((r[4] for r in self._literals if r[4] is not None) if plain else (r[0] for r in self._rows(self.views.ner, "label")), "NER")
        y = self.synonyms
        if not y["lookup"] or not y["fwd"]:
            raise EngineError(4, "Empty ontology")
        live = self.live or (self.view or {}).get("_live") is True
        return MatchIndex(y["lookup"], y["fwd"], y["rev"], self.span_rules, entities, ner, live, self.options.name)

    # Updates.

    def update(self, replace: Mapping[str, str] | None = None, remove: Iterable[str] = ()) -> Ontology:
        """A new handle in which subjects are replaced by Turtle fragments, or removed, all or nothing.

        A replacement keeps its subject's place, new subjects come last, and references to a removed
        subject stay. Each subject is an absolute IRI named once; a fragment has that subject only
        and no blank nodes; it knows the ontology's prefixes.
        """
        if self.parts or self.triples is None:
            raise EngineError(4, "Update needs a single ontology with a graph")
        replace, remove = dict(replace or {}), list(remove)
        if not replace and not remove:
            return self
        subjects = [*replace, *remove]
        if len(set(subjects)) < len(subjects):
            raise EngineError(2, "A subject is named twice")
        if any(":" not in s or any(c in s for c in ' <>"{}|^`\\') for s in subjects):
            raise EngineError(2, "Subjects must be absolute IRIs")
        rows = []
        for subject, fragment in replace.items():
            own = turtle.Reader(fragment, self.options.base)
            own.prefixes = {k: v for k, v in self.prefixes.items()}
            for k, t in enumerate(own.read()):
                if t.subject.value != subject or "blank" in (t.subject.kind, t.object.kind):
                    raise EngineError(2, f"A fragment may state {subject} only, without blank nodes")
                rows.append((k, t.subject.value, t.predicate.value, t.object.value, t.object.kind, t.object.datatype, t.object.language, len(rows)))
        named = self.spark.createDataFrame([(s,) for s in subjects], "s string")
        new = Ontology(self.spark, apply_update(self.triples, self.spark.createDataFrame(rows, "k int, s string, p string, o string, o_kind string, o_datatype string, o_language string, n int"), named), self.options, self.prefixes, self.external)
        if "_literals" in self.__dict__ and len(subjects) <= MAX_PATCH and self.views.blanks is None:
            new.__dict__["_literals"] = self._patched(rows, subjects)
            new.views.__dict__["blanks"] = None  # a fragment has none
        return new

    def _patched(self, rows: list[tuple], subjects: list[str]) -> list[tuple]:
        """The literals after an update, from those at hand: the triples are asked for the places of subjects only."""
        places = self.triples.agg(F.max("ord").alias("end"), *[F.min(F.when(F.col("s") == s, F.col("ord"))) for s in subjects]).first() if len(subjects) <= 50 else None
        if places is not None:
            end, at = places[0], dict(zip(subjects, places[1:], strict=True))
        else:
            found = self.triples.join(F.broadcast(self.spark.createDataFrame([(s,) for s in subjects], "s string")), "s", "left_semi").groupBy("s").agg(F.min("ord")).collect()  # MAX_PATCH rows at most
            end, at = self.triples.agg(F.max("ord")).first()[0], {s: o for s, o in found}
        end = -1 if end is None else end
        gone = set(subjects)
        out = [(o * SPREAD, *rest) for o, *rest in self._literals if rest[1] not in gone]
        for k, s, p, o, kind, _, _, n in rows:
            if p in (RDFS + "label", RDFS + "seeAlso", SKOS + "altLabel") or p.rpartition("#")[2] == "inflection":
                place = (end + 1 + n) * SPREAD if at.get(s) is None else at[s] * SPREAD + k
                value = norm(o.rpartition("#")[2] if kind == "iri" else o)
                out.append((place, value, s, norm(s.rpartition("#")[2]), trim(o) if p == RDFS + "label" else None))
        return sorted(out, key=lambda r: r[:2])

    # Snapshots.

    def snapshot(self) -> dict:
        """The views as one object."""
        if self.view is not None:
            return dict(self.view)
        v, y = self.views, self.synonyms
        multi = lambda df: {r["key"]: list(r["values"]) for r in self._rows(df, "key", "values")}
        by: dict[str, dict] = {}
        for r in self._rows(v.by_predicate, "pk", "subject", "values"):
            by.setdefault(r["pk"], {})[r["subject"]] = list(r["values"])
        grams = self._rows(v.ngrams, "level", "entity")
        none = not v.mixed and not grams
        subs = [r[0] for r in self._rows(v.sub_entities, "entity")]
        return {
            "children": multi(v.children), "parents": multi(v.parents), "trie": trie(subs),
            "ngrams": {str(n): None if none else [r["entity"] for r in grams if r["level"] == n] for n in range(1, 10)},
            "spans": self.span_rules, "labels": {r[0]: r[1] for r in self._rows(v.labels, "key", "label")}, "equivalents": multi(v.equivalents) or None,
            "predicates": [r[0] for r in self._rows(v.predicates, "pk")], "by_predicate": by, "ner": {r[0]: "NER" for r in self._rows(v.ner, "label")},
            "synonyms": {"lookup": {str(n): g for n, g in y["lookup"].items()}, "fwd": y["fwd"], "rev": y["rev"]},
        }

    def write_snapshot(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.snapshot(), f, ensure_ascii=False)

    def write_views(self, path: str) -> None:
        """Each view as a Parquet table under `path`, which may be in any store that Spark writes."""
        v = self.views
        for name in ("labels", "ner", "by_predicate", "predicates", "raw", "forward", "back", "lookup", "spans", "parents", "children", "equivalents", "ngrams"):
            getattr(v, name).write.mode("overwrite").parquet(f"{path}/{name}")


#: Places of statements are spread by this, so that a replacement's triples lie between those around its subject.
SPREAD = 1 << 20


def bounded(df: DataFrame, same: DataFrame) -> DataFrame:
    """`df` to be collected, after its rows and characters (counted on `same`, in any order) were found to be within bounds."""
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in same.columns), F.lit(0).cast("long"))
    n, characters = same.agg(F.count("*"), F.sum(width)).first()
    if n > MAX_VOCABULARY or (characters or 0) > MAX_CHARACTERS:
        raise EngineError(1, "The vocabulary is too large for an index")
    return df


def apply_update(triples: DataFrame, replacements: DataFrame, subjects: DataFrame) -> DataFrame:
    """`triples` without those of `subjects` (s), and with `replacements` at their subjects' first places or at the end."""
    subjects = checkpointed(subjects.select("s").distinct())
    few = F.broadcast(subjects) if subjects.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else subjects
    kept = triples.join(few, "s", "left_anti")
    first = triples.join(few, "s", "left_semi").groupBy("s").agg(F.min("ord").alias("at"))
    end = triples.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("end"))  # one row
    new = replacements.join(first, "s", "left").join(F.broadcast(end), F.lit(True))
    placed = new.select(F.lit(0).alias("source_ord"), F.when(F.col("at").isNotNull(), F.col("at") * SPREAD + F.col("k")).otherwise((F.col("end") + 1 + F.col("n")) * SPREAD).alias("ord"), "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", "o_datatype", "o_language")
    both = kept.withColumn("ord", F.col("ord") * SPREAD).select(*placed.columns).unionByName(placed)
    return graph.distinct_triples(both)


def trie(entities: Iterable[str]) -> dict | None:
    """Phrases by number of words, nested by their leading words; the last words are listed, the longest first."""
    phrases: dict[int, dict[str, None]] = {n: {} for n in range(1, 7)}
    for e in entities:
        text = e.replace("_", " ")
        phrases.setdefault(text.count(" ") + 1, {})[text] = None
    if not any(phrases.values()):
        return None

    def nest(texts: Iterable[str]) -> dict:
        own: dict[str, dict[str, None]] = {}
        for t in texts:
            first, _, rest = t.partition(" ")
            own.setdefault(first, {})[rest] = None
        return {k: nest(v) if " " in next(iter(v)) else by_length(v, reverse=True) for k, v in own.items()}

    return {str(n): by_length(g, reverse=True) if n == 1 or n > 6 else nest(by_length(g, reverse=True)) for n, g in phrases.items()}


__all__ = ["Ontology", "Options", "apply_update", "external_synonyms", "lookup_of", "reversed_of", "trie"]
