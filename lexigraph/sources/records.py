"""Readers of ontology records, as a JSON array or one per line, without Spark."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from ..errors import EngineError
from .rdf import OWL, RDF, RDFS, SKOS, Graph, Term, bad, resolve

# Field, predicate, and what a bare string is. A predicate that begins with a colon takes the default namespace. Fixed values.
FIELDS = {
    "type": (RDF + "type", "iri"), "types": (RDF + "type", "iri"), "label": (RDFS + "label", "literal"), "synonyms": (SKOS + "altLabel", "literal"),
    "see_also": (RDFS + "seeAlso", "literal"), "spans": (RDFS + "seeAlso", "literal"), "parents": (RDFS + "subClassOf", "iri"), "equivalents": (OWL + "equivalentClass", "iri"),
    "ner": (OWL + "backwardCompatibleWith", "literal"), "inflections": (":inflection", "literal"), "requires": (":requires", "iri"), "implies": (":implies", "iri"),
    "similar_to": (":similarTo", "iri"), "uses": (":uses", "iri"), "effects": (":effects", "iri"),
}
FORMAT = re.compile(r"[a-z]+/1\Z")
IRI = re.compile(r'[^\x00-\x20<>"{}|^`\\]*\Z')
LANGUAGE = re.compile(r"[a-zA-Z]+(?:-[a-zA-Z0-9]+)*\Z")


class Fields(dict):
    """An object of a record; a field that occurs twice is an error."""


def _object(pairs: list[tuple[str, object]]) -> Fields:
    out = Fields()
    for k, v in pairs:
        if k in out:
            raise EngineError(2, f"Duplicate field: {k}")
        out[k] = v
    return out


def _constant(name: str):
    raise EngineError(2, f"Invalid number: {name}")


DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_constant=_constant)


class Records:
    """Puts the facts of records into a graph; prefixes and base hold from their record on."""

    def __init__(self, base: str = ""):
        self.graph, self.base = Graph(), base
        self.prefixes = dict(self.graph.prefixes)

    @staticmethod
    def members(value, *allowed: str) -> Fields:
        if not isinstance(value, Fields):
            raise EngineError(2, "Expected a JSON object")
        if allowed and (odd := next((k for k in value if k not in allowed), None)) is not None:
            raise EngineError(2, f"Unknown field: {odd}")
        return value

    @staticmethod
    def string(value, name: str) -> str:
        if not isinstance(value, str):
            raise EngineError(2, f"{name} must be a string")
        return value

    def resource(self, value: str, explicit: bool = False) -> Term:
        if not IRI.match(value):
            raise EngineError(2, "Invalid resource identifier")
        if not explicit and value.startswith("_:"):
            if len(value) == 2:
                raise EngineError(2, "Blank node identifier must not be empty")
            return Term(value, "blank")
        prefix, colon, rest = value.partition(":")
        space = None if explicit else self.prefixes.get(prefix if colon else "")
        return Term(space + (rest if colon else value) if space is not None else resolve(self.base, value), "iri")

    def blank(self, value: str) -> Term:
        return self.resource(value if value.startswith("_:") else f"_:{value}")

    def term(self, value, bare: str) -> Term:
        if isinstance(value, str):
            return self.resource(value) if bare == "iri" else Term(value, "literal")
        f = self.members(value, "id", "iri", "blank", "value", "kind", "datatype", "language")
        named = [k for k in ("id", "iri", "blank", "value") if k in f]
        if len(named) != 1:
            raise EngineError(2, "A term needs exactly one of id, iri, blank, or value")
        text = self.string(f[named[0]], "Term value")
        attributes = [k for k in ("kind", "datatype", "language") if k in f]
        if named[0] != "value":
            if attributes:
                raise EngineError(2, "Resource terms cannot carry literal attributes")
            return self.blank(text) if named[0] == "blank" else self.resource(text, named[0] == "iri")
        kind = f.get("kind", "literal")
        if kind not in ("iri", "blank", "literal"):
            raise EngineError(2, "kind must be iri, blank, or literal")
        if kind != "literal":
            if len(attributes) > 1:
                raise EngineError(2, "Resource terms cannot carry literal attributes")
            return self.resource(text, True) if kind == "iri" else self.blank(text)
        datatype = self.resource(self.string(f["datatype"], "datatype")) if "datatype" in f else None
        if datatype and datatype.kind != "iri":
            raise EngineError(2, "Literal datatype must be an IRI")
        if "language" not in f:
            return Term(text, "literal", datatype and datatype.value)
        lang = self.string(f["language"], "language")
        if not LANGUAGE.match(lang):
            raise EngineError(2, "Invalid language tag")
        if datatype and datatype.value != RDF + "langString":
            raise EngineError(2, "A language-tagged literal requires rdf:langString")
        return Term(text, "literal", RDF + "langString", lang)

    def emit(self, s: Term, p: Term, o: Term) -> None:
        if s.kind == "literal" or p.kind != "iri":
            raise EngineError(2, "A subject must be a resource; a predicate must be an IRI")
        self.graph.add(s, p, o)

    def values(self, s: Term, p: Term, data, bare: str) -> None:
        for value in data if isinstance(data, list) else [data]:
            self.emit(s, p, self.term(value, bare))

    def entity(self, record: Fields) -> None:
        subject = self.term(record["id"], "iri")
        for name, value in record.items():
            if name == "facts":
                if not isinstance(value, list):
                    raise EngineError(2, "facts must be an array")
                for fact in value:
                    f = self.members(fact, "predicate", "value")
                    if "value" not in f or "predicate" not in f:
                        raise EngineError(2, "Missing fact value")
                    self.values(subject, self.term(f["predicate"], "iri"), f["value"], "literal")
            elif name == "properties":
                for predicate, v in self.members(value).items():
                    self.values(subject, self.resource(predicate), v, "literal")
            elif name != "id":
                if name not in FIELDS:
                    raise EngineError(2, f"Unknown entity field: {name}; use properties for RDF predicates")
                predicate, bare = FIELDS[name]
                if predicate.startswith(":") and "" not in self.prefixes:
                    raise EngineError(2, f"{name} requires a default namespace")
                self.values(subject, self.resource(predicate) if predicate.startswith(":") else Term(predicate, "iri"), value, bare)
        if subject.kind == "literal":
            raise EngineError(2, "Entity id must be a resource")

    def prefix(self, name: str, value) -> None:
        value = self.string(value, "Namespace IRI")
        if not IRI.match(value) or not IRI.match(name) or ":" in name:
            raise EngineError(2, f"Invalid namespace declaration: {name}")
        self.prefixes[name] = resolve(self.base, value)
        self.graph.bind(name, self.prefixes[name])

    def record(self, value) -> None:
        r = self.members(value)
        if "id" in r:
            return self.entity(r)
        if "subject" in r:
            self.members(r, "subject", "predicate", "object")
            if len(r) < 3:
                raise EngineError(2, "A triple needs subject, predicate and object")
            return self.emit(self.term(r["subject"], "iri"), self.term(r["predicate"], "iri"), self.term(r["object"], "literal"))
        self.members(r, "format", "base", "namespace", "prefixes")
        if not r:
            raise EngineError(2, "Empty source record")
        if "format" in r and not FORMAT.match(self.string(r["format"], "format")):
            raise EngineError(2, "Unsupported ontology schema")
        if "base" in r:
            base = self.string(r["base"], "base")
            if not IRI.match(base):
                raise EngineError(2, "Invalid base IRI")
            self.base = resolve(self.base, base)
        if "namespace" in r:
            self.prefix("", r["namespace"])
        if "prefixes" in r:
            if "namespace" in r and "" in self.members(r["prefixes"]):
                raise EngineError(2, "Declare the default namespace only once per record")
            for name, iri in self.members(r["prefixes"]).items():
                self.prefix(name, iri)


SPACE = re.compile(r"[ \t\r\n]*")


def _array(text: str) -> Iterator[tuple[int, object]]:
    at = SPACE.match(text).end()
    if not text.startswith("[", at):
        raise bad("Expected a JSON array", text, at, 2)
    at = SPACE.match(text, at + 1).end()
    first = True
    while not (first and text.startswith("]", at)):
        start = at
        value, at = DECODER.raw_decode(text, at)
        yield start, value
        first = False
        at = SPACE.match(text, at).end()
        if text.startswith("]", at):
            break
        if not text.startswith(",", at):
            raise bad("Expected , or ]", text, at, 2)
        at = SPACE.match(text, at + 1).end()
    at = SPACE.match(text, at + 1).end()
    if at < len(text):
        raise bad("Text after the array", text, at, 2)


def _lines(text: str) -> Iterator[tuple[int, object]]:
    at = 0
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    for line in lines:
        start = at + len(line) - len(line.lstrip(" \t"))
        value = line.strip(" \t\r")
        if not value:
            raise bad("Blank line", text, at, 2)
        out, end = DECODER.raw_decode(value)
        if end < len(value):
            raise bad("Text after a record", text, start + end, 2)
        yield start, out
        at += len(line) + 1


def read(text: str, base: str = "", lines: bool = False) -> Graph:
    """The graph of records; an error names the line and column of its record."""
    into, at = Records(base), 0
    text = text.removeprefix("﻿")
    try:
        for at, value in _lines(text) if lines else _array(text):  # noqa: B007
            into.record(value)
    except json.JSONDecodeError as e:
        raise bad(e.msg, text, min(len(text), at + e.pos if lines else e.pos), 2) from None
    except EngineError as e:
        raise e if e.line else bad(e.message, text, at, e.code) from None
    return into.graph
