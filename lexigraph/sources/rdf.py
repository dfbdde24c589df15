"""Terms, triples and the graph that readers fill; IRI resolution and literal normalization. Without Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from typing import NamedTuple

from ..errors import EngineError
from ..functions.text import norm

RDF, RDFS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
OWL, SKOS, XSD = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2004/02/skos/core#", "http://www.w3.org/2001/XMLSchema#"
MAX_BYTES = 256 << 20

# Prefixes that finder arguments may use without a declaration. Fixed values.
DEFAULT_PREFIXES = {
    "brick": "https://brickschema.org/schema/Brick#", "csvw": "http://www.w3.org/ns/csvw#", "dc": "http://purl.org/dc/elements/1.1/", "dcat": "http://www.w3.org/ns/dcat#",
    "dcmitype": "http://purl.org/dc/dcmitype/", "dcterms": "http://purl.org/dc/terms/", "dcam": "http://purl.org/dc/dcam/", "doap": "http://usefulinc.com/ns/doap#",
    "foaf": "http://xmlns.com/foaf/0.1/", "geo": "http://www.opengis.net/ont/geosparql#", "odrl": "http://www.w3.org/ns/odrl/2/", "org": "http://www.w3.org/ns/org#",
    "prof": "http://www.w3.org/ns/dx/prof/", "prov": "http://www.w3.org/ns/prov#", "qb": "http://purl.org/linked-data/cube#", "schema": "https://schema.org/",
    "sh": "http://www.w3.org/ns/shacl#", "skos": SKOS, "sosa": "http://www.w3.org/ns/sosa/", "ssn": "http://www.w3.org/ns/ssn/", "time": "http://www.w3.org/2006/time#",
    "vann": "http://purl.org/vocab/vann/", "void": "http://rdfs.org/ns/void#", "wgs": "https://www.w3.org/2003/01/geo/wgs84_pos#", "owl": OWL, "rdf": RDF, "rdfs": RDFS,
    "xsd": XSD, "xml": "http://www.w3.org/XML/1998/namespace",
}


class Term(NamedTuple):
    value: str
    kind: str  # iri, literal or blank
    datatype: str | None = None
    language: str | None = None


class Triple(NamedTuple):
    subject: Term
    predicate: Term
    object: Term


class Graph:
    """Distinct triples in the order of their first statement, and prefixes."""

    def __init__(self) -> None:
        self.triples: dict[Triple, None] = {}
        self.prefixes = dict(DEFAULT_PREFIXES)

    def add(self, s: Term, p: Term, o: Term) -> None:
        self.triples[Triple(s, p, normalized(o))] = None

    def bind(self, prefix: str, iri: str) -> None:
        """Binds a prefix; one that names another IRI already keeps it, and a numbered one is bound."""
        name, i = prefix, 0
        while self.prefixes.get(name, iri) != iri:
            i += 1
            name = f"{prefix}{i}"
        self.prefixes[name] = iri

    def __iter__(self) -> Iterator[Triple]:
        return iter(self.triples)

    def __len__(self) -> int:
        return len(self.triples)


PARTS = re.compile(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\Z")


def _without_dots(path: str) -> str:
    out: list[str] = []
    segments = path.split("/")
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if s == "..":
            if len(out) > 1 or (out and out[0]):
                out.pop()
            if last:
                out.append("")
        elif s == ".":
            if last:
                out.append("")
        else:
            out.append(s)
    return "/".join(out) if not path.startswith("/") or (out and not out[0]) else "/" + "/".join(out)


def resolve(base: str, reference: str) -> str:
    """RFC 3986 reference resolution; an empty query or fragment stays."""
    scheme, authority, path, query, fragment = PARTS.match(reference).groups()
    b_scheme, b_authority, b_path, b_query, _ = PARTS.match(base).groups()
    if scheme is not None:
        path = _without_dots(path)
    elif not base:
        return reference
    else:
        scheme = b_scheme
        if authority is not None:
            path = _without_dots(path)
        else:
            authority = b_authority
            if not path:
                path, query = b_path, b_query if query is None else query
            else:
                if not path.startswith("/"):
                    path = f"/{path}" if b_authority is not None and not b_path else b_path[: b_path.rfind("/") + 1] + path
                path = _without_dots(path)
    return (f"{scheme}:" if scheme is not None else "") + (f"//{authority}" if authority is not None else "") + path + (f"?{query}" if query is not None else "") + (f"#{fragment}" if fragment is not None else "")


INTEGERS = frozenset(
    "integer nonPositiveInteger negativeInteger long int short byte nonNegativeInteger unsignedLong unsignedInt unsignedShort unsignedByte positiveInteger".split()
)
INTEGER = re.compile(r"([+-]?)([0-9]+)\Z")
DECIMAL = re.compile(r"([+-]?)([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE]([+-]?[0-9]+))?\Z")
FLOAT = re.compile(r"[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|inf(?:inity)?|nan)\Z", re.I)


def _decimal(text: str) -> str | None:
    m = DECIMAL.match(text)
    if not m or abs(int(m[3] or 0)) > 100_000:
        return None
    try:
        value = format(Decimal(m[2]).scaleb(int(m[3] or 0)), "f")
    except InvalidOperation:
        return None
    return ("-" if m[1] == "-" else "") + value


def normalized(t: Term) -> Term:
    """A literal of an XSD type in its canonical spelling; other terms, and lexical forms out of range, as they are."""
    if t.kind != "literal" or not t.datatype or not t.datatype.startswith(XSD):
        return t
    kind, value, text = t.datatype[len(XSD) :], None, norm(t.value, lower=False)
    if kind in INTEGERS:
        if m := INTEGER.match(text):
            digits = m[2].lstrip("0") or "0"
            value = ("-" if m[1] == "-" and digits != "0" else "") + digits
    elif kind == "decimal":
        value = _decimal(text)
    elif kind in ("double", "float"):
        if FLOAT.match(text):
            value = repr(float(text))
    elif kind == "boolean":
        value = "true" if t.value.lower() in ("true", "1") else "false"
    elif kind in ("normalizedString", "token"):
        value = re.sub("[\t\r\n]", " ", t.value)
        value = norm(value, lower=False, collapse=True) if kind == "token" else value
    elif kind == "hexBinary" and len(t.value) % 2 == 0 and re.fullmatch("[0-9a-fA-F]*", t.value):
        value = t.value.lower()
    return t if value is None else t._replace(value=value)


def bad(message: str, text: str, at: int, code: int = 3) -> EngineError:
    """An error of a source, with the line and column of a place in it."""
    line = text.count("\n", 0, at) + 1
    return EngineError(code, message, line, at - (text.rfind("\n", 0, at) + 1) + 1)
