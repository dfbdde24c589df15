"""Matching an ad hoc list of terms, without an ontology and without Spark."""

from __future__ import annotations

from collections.abc import Sequence

from ..errors import EngineError
from ..functions import vocabulary
from ..functions.text import PLUS, SPACES, fold, norm, plus_parts, plus_text, tokenize
from .matching import MatchIndex, Node, from_text, match


def _words(text: str) -> list[str]:
    return [t.normal for t in tokenize(plus_text(text)) if t.normal]


def _reading(term: str) -> tuple[str, list[str]]:
    """How a term reads as a label, and its words."""
    parts = [norm(p, collapse=True) for p in PLUS.split(term)]
    value = "+".join(p + " " if p.endswith("\\") and i < len(parts) - 1 else p for i, p in enumerate(parts))
    if "+" in term and plus_parts(term) is None:
        return value, _words(value)
    return value, [w for p in parts for w in _words(p)]


def _size(node: Node) -> int:
    """Words of a node: tokens that take a place in phrases."""
    return sum(map(_size, node.tokens)) if node.tokens else int(node.normal != "")


class TermIndex:
    """An index of terms. A canonical form holds a space, which no word of a text does, so that matches never feed each other.

    A form from which two final marks were cut has no canonical form, and a text with it is an error; if not
    `strict`, such forms are left out, so that one text cannot fail a batch.
    """

    def __init__(self, terms: Sequence[str], strict: bool = True):
        raw: dict[str, list[str]] = {}
        self.first: dict[str, int] = {}
        seen: set[str] = set()
        for i, term in enumerate(terms):
            if not isinstance(term, str):
                raise EngineError(2, "match_terms terms must be strings")
            value, words = _reading(term)
            if words and value not in seen:
                seen.add(value)
                name = f"{'_'.join(words)} {i} "
                raw[name] = [value]
                self.first[name] = i
        forward = vocabulary.synonyms(raw)
        placed = {f"P{i}": v for i, v in enumerate(forward.values())}
        lookup = {n: [x for x in g if x not in placed] for n, g in vocabulary.lookup(placed).items()}
        if not strict:
            known = set(vocabulary.reverse(forward))
            lookup = {n: [x for x in g if x in known] for n, g in lookup.items()}
        spaced = lambda s: not set(fold(s)).isdisjoint(SPACES)
        spans = {k: [r for r in rules if not any(map(spaced, r["content"]))] for k, rules in vocabulary.spans(raw, plus_only=True).items() if not spaced(k)}
        self.index = MatchIndex(lookup, forward, vocabulary.reverse(forward), {k: r for k, r in spans.items() if r}) if raw else None

    def find(self, text: str | None, boundary: bool = False) -> list[tuple[int, int, int]]:
        """(term, x, y) of top-level matches, in the order of the text; of equal terms, the first is named."""
        return [m[:3] for m in self.places(text, boundary)]

    def places(self, text: str | None, boundary: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(term, x, y, pos, n) of the same: also the place of its first word among those of the text, and how many it has."""
        if self.index is None or not text:
            return []
        nodes = from_text(text)
        if self.index.heads.isdisjoint(t.normal for t in nodes):
            return []
        out, pos = [], 0
        for t in match(self.index, nodes, 0, boundary):
            n = _size(t)
            if t.type and t.canon in self.first:
                out.append((self.first[t.canon], t.x, t.y, pos, n))
            pos += n
        return out

    def phrases(self) -> list[tuple[list[str], bool, int]]:
        """Word runs that are matches, whether each is the spelling of tokens of another form, and that form's length."""
        if self.index is None:
            return []
        out = []
        for n, own in self.index.words.items():
            for text in own:
                words = text.split(" ")
                if len(words) == n and all(words) and fold(norm(text)) == text:
                    source = self.index.aliases.get(text)
                    out.append((words, source is not None, len(source or text)))
        return out


def match_terms(text: str, terms: Sequence[str], line_breaks: str = "ignore") -> list[tuple[int, int, int]]:
    if not isinstance(text, str):
        raise EngineError(2, "match_terms requires string text")
    return TermIndex(terms).find(text, line_breaks == "boundary")
