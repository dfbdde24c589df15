"""A reader of RDF 1.1 Turtle, without Spark."""

from __future__ import annotations

import re

from .rdf import RDF, XSD, Graph, Term, bad, resolve

DEPTH = 128
_BASE = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-˿Ͱ-ͽͿ-῿‌‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff"
_U = _BASE + "_"
_CHARS = _U + r"\-0-9·̀-ͯ‿⁀"
_PREFIX = f"(?:[{_BASE}](?:[{_CHARS}.]*[{_CHARS}])?)?"
_PLX = r"%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]"
_LOCAL = f"(?:(?:[{_U}:0-9]|{_PLX})(?:(?:[{_CHARS}.:]|{_PLX})*(?:[{_CHARS}:]|{_PLX}))?)?"
SKIP = re.compile(r"(?:[ \t\r\n]+|#[^\r\n]*)*")
IRI = re.compile(r'<((?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*)>')
NAME = re.compile(f"({_PREFIX}):({_LOCAL})")
BLANK = re.compile(f"_:([{_U}0-9](?:[{_CHARS}.]*[{_CHARS}])?)")
STRING = re.compile(r'"""((?:"{0,2}(?:[^"\\]|\\.))*)"""|\'\'\'((?:\'{0,2}(?:[^\'\\]|\\.))*)\'\'\'|"([^"\\\n\r]*(?:\\.[^"\\\n\r]*)*)"|\'([^\'\\\n\r]*(?:\\.[^\'\\\n\r]*)*)\'', re.S)
LANG = re.compile(r"@([a-zA-Z]+(?:-[a-zA-Z0-9]+)*)")
NUMBER = re.compile(r"[+-]?(?:(?P<double>(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)[eE][+-]?[0-9]+)|(?P<decimal>[0-9]*\.[0-9]+)|(?P<integer>[0-9]+))")
BOOLEAN = re.compile(rf"(true|false)(?![{_CHARS}:])")
KEYWORD = re.compile(r"@(prefix|base)\b|(prefix|base)\b(?=[ \t\r\n<#:A-Za-z])", re.I)
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|([tbnrf\"'\\])|(.?))", re.S)
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
PLAIN_IRI = re.compile(r'[^\x00-\x20<>"{}|^`\\]*\Z')
A = re.compile(rf"a(?![{_CHARS}:.])")


class Reader:
    def __init__(self, text: str, base: str = ""):
        self.text, self.base, self.at = text.removeprefix("﻿"), base, 0
        self.graph, self.prefixes, self.fresh = Graph(), {}, 0
        self.names: dict[str, Term] = {}

    def fail(self, message: str):
        raise bad(message, self.text, self.at)

    def skip(self) -> None:
        self.at = SKIP.match(self.text, self.at).end()

    def take(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def token(self, c: str) -> bool:
        self.skip()
        if self.text.startswith(c, self.at):
            self.at += len(c)
            return True
        return False

    def expect(self, c: str) -> None:
        if not self.token(c):
            self.fail(f"Expected {c!r}")

    def blank(self, label: str | None = None) -> Term:
        """A labelled blank node, or a new one; names are given in the order of their use."""
        if label is not None and label in self.names:
            return self.names[label]
        self.fresh += 1
        term = Term(f"_:b{self.fresh}", "blank")
        if label is not None:
            self.names[label] = term
        return term

    def unescape(self, s: str, iri: bool = False) -> str:
        def one(m: re.Match) -> str:
            code = m[1] or m[2]
            if code:
                value = int(code, 16)
                if value > 0x10FFFF or 0xD800 <= value < 0xE000:
                    self.fail("Invalid Unicode escape")
                return chr(value)
            if m[3] and not iri:
                return ESCAPES[m[3]]
            self.fail("Invalid escape")

        s = ESCAPE.sub(one, s) if "\\" in s else s
        if iri and not PLAIN_IRI.match(s):
            self.fail("Invalid IRI")
        return s

    def iri(self) -> str | None:
        """An IRI in brackets, resolved, or a prefixed name."""
        if m := self.take(IRI):
            return resolve(self.base, self.unescape(m[1], iri=True))
        if self.text.startswith("_:", self.at):
            return None
        start = self.at
        if m := self.take(NAME):
            if m[1] not in self.prefixes:
                self.at = start
                self.fail(f"Undefined prefix: {m[1]}")
            return self.prefixes[m[1]] + re.sub(r"\\(.)", r"\1", m[2])
        return None

    def read(self) -> Graph:
        while True:
            self.skip()
            if self.at >= len(self.text):
                return self.graph
            if m := self.take(KEYWORD):
                self.directive((m[1] or m[2]).lower(), m[1])
            else:
                self.statement()

    def directive(self, word: str, at_form: str | None) -> None:
        if at_form and at_form != word:
            self.fail("Directives are lower-case")
        self.skip()
        prefix = None
        if word == "prefix":
            m = self.take(re.compile(f"({_PREFIX}):"))
            if not m:
                self.fail("Expected a prefix")
            prefix = m[1]
            self.skip()
        m = self.take(IRI)
        if not m:
            self.fail("Expected an IRI")
        value = resolve(self.base, self.unescape(m[1], iri=True))
        if prefix is None:
            self.base = value
        else:
            self.prefixes[prefix] = value
            self.graph.bind(prefix, value)
        if at_form:
            self.expect(".")

    def statement(self) -> None:
        if self.token("["):
            subject = self.blank()
            if not self.token("]"):
                self.predicates(subject, 1)
                self.expect("]")
                if self.token("."):
                    return
        elif self.token("("):
            subject = self.collection(1)
        else:
            subject = self.resource()
        self.predicates(subject, 0)
        self.expect(".")

    def resource(self) -> Term:
        self.skip()
        if m := self.take(BLANK):
            return self.blank(m[1])
        iri = self.iri()
        if iri is None:
            self.fail("Expected a resource")
        return Term(iri, "iri")

    def predicates(self, subject: Term, depth: int) -> None:
        while True:
            self.skip()
            if self.take(A):
                predicate = Term(RDF + "type", "iri")
            else:
                iri = self.iri()
                if iri is None:
                    self.fail("Expected a predicate")
                predicate = Term(iri, "iri")
            while True:
                self.object(subject, predicate, depth)
                if not self.token(","):
                    break
            if not self.token(";"):
                return
            while self.token(";"):
                pass
            self.skip()
            if self.at >= len(self.text) or self.text[self.at] in ".]":
                return

    def object(self, subject: Term, predicate: Term, depth: int) -> None:
        if depth > DEPTH:
            self.fail("Nesting limit exceeded")
        if self.token("["):
            value = self.blank()
            self.graph.add(subject, predicate, value)
            if not self.token("]"):
                self.predicates(value, depth + 1)
                self.expect("]")
            return
        value = self.collection(depth + 1) if self.token("(") else self.literal() or self.resource()
        self.graph.add(subject, predicate, value)

    def collection(self, depth: int) -> Term:
        if depth > DEPTH:
            self.fail("Nesting limit exceeded")
        first = last = None
        while not self.token(")"):
            node = self.blank()
            if last is None:
                first = node
            else:
                self.graph.add(last, Term(RDF + "rest", "iri"), node)
            self.object(node, Term(RDF + "first", "iri"), depth)
            last = node
        nil = Term(RDF + "nil", "iri")
        if last is not None:
            self.graph.add(last, Term(RDF + "rest", "iri"), nil)
        return first or nil

    def literal(self) -> Term | None:
        self.skip()
        if m := self.take(STRING):
            value = self.unescape(next(g for g in m.groups() if g is not None))
            if lang := self.take(LANG):
                return Term(value, "literal", RDF + "langString", lang[1])
            if self.text.startswith("^^", self.at):
                self.at += 2
                self.skip()
                kind = self.iri()
                if kind is None:
                    self.fail("Expected a datatype")
                return Term(value, "literal", kind)
            return Term(value, "literal")
        if m := self.take(BOOLEAN):
            return Term(m[1], "literal", XSD + "boolean")
        if m := self.take(NUMBER):
            return Term(m[0], "literal", XSD + m.lastgroup)
        return None


def read(text: str, base: str = "") -> Graph:
    return Reader(text, base).read()
