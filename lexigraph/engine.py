"""The request protocol: one JSON object in, one out, over an engine that holds an ontology."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .errors import EngineError
from .functions import vocabulary
from .functions.text import tokenize
from .functions.udfs import _boundary, parse_text
from .operators import matching
from .operators.finder import Finder
from .operators.terms import match_terms
from .plans import graph
from .plans.ontology import Ontology, trie
from .sources import reader
from .sources.rdf import Graph, Term

LOAD = ("name", "base", "class_based", "distance", "interface", "comma_lists")


def _term(t: Term) -> dict:
    return {"value": t.value, "kind": t.kind} | ({"datatype": t.datatype} if t.datatype else {}) | ({"language": t.language} if t.language else {})


class Engine:
    """Loads, queries and matches; a failed load or update leaves what was there."""

    def __init__(self, spark: SparkSession):
        self.spark, self.ontology = spark, None

    def request(self, text: str | Mapping) -> dict:
        """An envelope: ok with a result, or an error with code, message and place."""
        try:
            if isinstance(text, str):
                try:
                    text = json.loads(text)
                except ValueError as e:
                    raise EngineError(2, f"Invalid JSON: {e}") from None
            if not isinstance(text, Mapping) or not isinstance(text.get("op"), str):
                raise EngineError(2, "A request requires op")
            return {"ok": True, "result": self.dispatch(text["op"], text)}
        except EngineError as e:
            return {"ok": False, "error": {"code": e.code, "message": e.message} | ({"line": e.line, "column": e.column} if e.line else {})}

    def dispatch(self, op: str, q: Mapping) -> Any:
        boundary = _boundary(q.get("line_breaks", "ignore"))
        if not isinstance(q.get("comma_lists", False), bool):
            raise EngineError(2, "comma_lists must be a boolean")
        known = getattr(self, f"op_{op}", None)
        if known is None:
            raise EngineError(4, f"Unknown operation: {op}")
        return known(q, boundary)

    def current(self) -> Ontology:
        if self.ontology is None:
            raise EngineError(4, "No ontology is loaded")
        return self.ontology

    # Without an ontology.

    def op_version(self, q, _) -> str:
        return __version__

    def op_tokenize(self, q, _) -> list[dict]:
        return [t._asdict() for t in tokenize(self._text(q))]

    def op_match_terms(self, q, boundary) -> list[dict]:
        terms = q.get("terms")
        if not isinstance(terms, list):
            raise EngineError(2, "match_terms requires an array of terms")
        found = match_terms(self._text(q), terms, "boundary" if boundary else "ignore")
        return [{"term": t, "x": x, "y": y} for t, x, y in found]

    def op_generate_synonyms(self, q, _) -> dict:
        forward = vocabulary.synonyms(q.get("raw") or {})
        return vocabulary.reverse(forward) if q.get("reverse") else forward

    def op_generate_lookup(self, q, _) -> dict:
        return {str(n): g for n, g in vocabulary.lookup(q.get("synonyms") or {}).items()}

    def op_generate_spans(self, q, _) -> dict:
        return vocabulary.spans(q.get("raw") or {}, q.get("distance", 4), bool(q.get("plus_only")), q.get("comma_lists", False))

    def _graph(self, q: Mapping) -> Graph:
        found = reader.read_source(q.get("content", q.get("turtle", "")), q.get("format"), q.get("base", ""))
        if not isinstance(found, Graph):
            raise EngineError(2, "The source has no graph")
        return found

    def op_read_rdf(self, q, _) -> list[dict]:
        return [{"subject": _term(s), "predicate": _term(p), "object": _term(o)} for s, p, o in self._graph(q)]

    def op_detect_schema(self, q, _) -> str:
        return graph.schema_of(graph.from_graph(self.spark, self._graph(q))).first()[0]

    # Loading.

    def _load(self, q: Mapping) -> Ontology:
        options = {k: q[k] for k in LOAD if k in q}
        if "snapshot" in q:
            view = q["snapshot"]
            return Ontology.load(self.spark, content=view if isinstance(view, str) else json.dumps(view), format="snapshot", **options)
        if "turtle" in q:
            return Ontology.load(self.spark, content=q["turtle"], format="turtle", **options)
        return Ontology.load(self.spark, q.get("path"), q.get("content"), q.get("format"), **options)

    def op_load(self, q, _) -> dict:
        sources = q.get("sources") or [{"path": p} for p in q.get("paths") or ()]
        if sources:
            inherited = {k: q[k] for k in LOAD if k in q and k != "name"}
            new = Ontology.collect([self._load(inherited | s) for s in sources], q.get("name", "collection"))
        else:
            new = self._load(q)
        result = {"name": new.options.name, "schema": new.schema() if new.triples is not None else None, "triples": new.triples.count() if new.triples is not None else 0, "entities": len(new.synonyms["fwd"])}
        if not q.get("graph_only") and new.synonyms["fwd"]:
            new.index  # noqa: B018  a vocabulary that cannot be indexed fails the load
        self.ontology = new
        return result

    def op_update(self, q, _) -> dict:
        new = self.current().update(q.get("replace"), q.get("remove") or ())
        n = new.triples.count()
        self.ontology = new
        return {"replaced": len(q.get("replace") or {}), "removed": len(q.get("remove") or ()), "triples": n}

    # With an ontology.

    def op_snapshot(self, q, _) -> dict:
        return self.current().snapshot()

    def op_schema(self, q, _) -> str:
        return self.current().schema()

    def op_triples(self, q, _) -> list[dict]:
        if self.current().triples is None:
            raise EngineError(4, "A snapshot has no graph")
        out = []
        for r in self.ontology.triples.orderBy("source_ord", "ord").collect():
            out.append({"subject": _term(Term(r["s"], r["s_kind"])), "predicate": _term(Term(r["p"], "iri")), "object": _term(Term(r["o"], r["o_kind"], r["o_datatype"], r["o_language"]))})
        return out

    def op_query(self, q, _) -> Any:
        o, method = self.current(), q.get("method", "")
        if method == "spans" and q.get("interface") != "owl":  # views that are no lists or maps of texts
            return o.span_rules
        if method == "trie" and q.get("interface") != "owl":
            return o.view.get("trie") if o.view is not None else trie([r[0] for r in o._rows(o.views.sub_entities, "entity")])
        rows = Finder(self.current()).query(q.get("method", ""), *(q.get("args") or ()), interface=q.get("interface"), **(q.get("kwargs") or {}))
        return self._answer(rows)

    @staticmethod
    def _answer(rows: DataFrame) -> Any:
        if rows.columns == ["result"]:
            first = rows.first()
            return first[0] if first else None
        if rows.columns[0] == "key":
            return {r["key"]: list(r["values"]) for r in rows.orderBy("ord").collect()}
        return [r["value"] for r in rows.orderBy("pos").collect()]

    def _parsed(self, nodes: list[matching.Node]) -> dict:
        return {"text": matching.render(nodes), "tokens": [t.as_json() for t in nodes]}

    def op_parse(self, q, boundary) -> dict:
        if "text" not in q and "tokens" in q:
            return self.op_parse_tokens(q, boundary)
        return self._parsed(parse_text(self.current().index, self._text(q), q.get("ctr", 0), boundary))

    def op_parse_tokens(self, q, boundary) -> dict:
        return self._parsed(matching.match(self.current().index, self._tokens(q), q.get("ctr", 0), boundary))

    def op_transform_tokens(self, q, boundary) -> list[dict]:
        index, nodes, stage = self.current().index, self._tokens(q), q.get("stage", "")
        if stage == "augment":
            return self._augment(nodes)
        if stage not in ("exact", "spans", "hierarchy"):
            raise EngineError(2, f"Unknown token transformation: {stage}")
        return [t.as_json() for t in getattr(matching, stage)(index, nodes, boundary)]

    def _augment(self, nodes: list[matching.Node]) -> list[dict]:
        """Alphabetic tokens get their ancestors and descendants, found for all words at once."""
        from .operators.finder import edges_of

        finder, live = Finder(self.current()), self.current().live
        words = sorted({t.normal for t in nodes if t.normal and t.normal.isalpha()})
        starts = self.spark.createDataFrame([(w,) for w in words], "root string")
        from .operators.finder import reverse_map

        up = finder.table("types") if live else finder.table("parents")
        for name, m in (("ancestors", up), ("descendants", reverse_map(up) if live else finder.table("children"))):
            found: dict[str, list] = {}
            for r in graph.closure(edges_of(m), starts).orderBy("path").collect():
                found.setdefault(r["root"], []).append(r["node"])
            for t in nodes:
                if t.normal in words:
                    values = found.get(t.normal, [])
                    t.extra[name] = sorted(set(values), key=str.encode) if live and name == "ancestors" else values
        return [t.as_json() for t in nodes]

    @staticmethod
    def _text(q: Mapping) -> str:
        if not isinstance(q.get("text"), str):
            raise EngineError(2, f"{q.get('op')} requires string text")
        return q["text"]

    @staticmethod
    def _tokens(q: Mapping) -> list[matching.Node]:
        if not isinstance(q.get("tokens"), list):
            raise EngineError(2, "tokens must be an array")
        return [matching.from_json(t) for t in q["tokens"]]
