"""Finding vocabulary in tokens: exact phrases, proximity spans and hierarchy, without Spark.

A MatchIndex is built once from the tables of a vocabulary and then shared by all documents. A
document is a list of nodes; a match replaces a run of nodes by one that holds them, so that the whole history stays.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from ..errors import EngineError
from ..functions.text import JOINER, LINE_BREAKS, SPACES, Token, alias, by_length, fold, norm, scan, token_id, trim

OPERATIONS, COMBINATIONS, DEPTH = 100_000, 1_000_000, 256
_BREAKS = frozenset(LINE_BREAKS)


@dataclass(eq=False, slots=True)
class Node:
    """A token, or an entity made of nodes."""

    key: str | int  # the id, or the position from which it is made when asked for
    text: str
    x: int
    y: int
    normal: str
    ner: str | None = None
    canon: str | None = None
    type: str | None = None
    confidence: float | None = None
    ontologies: list[str] | None = None
    tokens: list[Node] | tuple = ()
    extra: dict | None = None

    @property
    def id(self) -> str:
        if type(self.key) is not int:
            return self.key
        return self.tokens[0].id if self.tokens else token_id(self.text, self.key)

    @property
    def spacing(self) -> bool:
        """White space and joiners only: takes no place in phrases."""
        if self.type or (self.normal and (self.normal.isascii() or fold(self.normal))):
            return False
        return not trim(JOINER.sub("", self.text))

    @property
    def breaks(self) -> bool:
        return self.spacing and not _BREAKS.isdisjoint(self.text)

    def as_json(self) -> dict:
        out = {"id": self.id, "text": self.text, "x": self.x, "y": self.y, "normal": self.normal} | (self.extra or {})
        if self.type:
            out |= {"ner": self.ner, "swaps": {"tokens": [t.as_json() for t in self.tokens], "canon": self.canon, "type": self.type, "ontologies": self.ontologies, "confidence": self.confidence}}
        return out


def from_token(t: Token) -> Node:
    return Node(t.id, t.text, t.x, t.y, t.normal)


def from_text(text: str) -> list[Node]:
    return [Node(i, *t) for i, t in enumerate(zip(*scan(text), strict=True))]


def from_json(t: Mapping) -> Node:
    """A node from a prepared token; fields that matching does not know are kept."""
    numeric = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if not isinstance(t, Mapping) or "id" not in t or not numeric(t.get("x")) or not numeric(t.get("y")) or not isinstance(t.get("text"), str) or not isinstance(t.get("normal"), str):
        raise EngineError(2, "Each token requires id, numeric x/y, and string text/normal")
    node = Node(t["id"], t["text"], t["x"], t["y"], t["normal"], extra={k: v for k, v in t.items() if k not in ("id", "text", "x", "y", "normal")})
    if swaps := t.get("swaps"):
        node.extra.pop("swaps")
        node.ner = node.extra.pop("ner", None)
        node.canon, node.type, node.confidence, node.ontologies = (swaps.get(k) for k in ("canon", "type", "confidence", "ontologies"))
        node.tokens = [from_json(u) for u in swaps.get("tokens") or ()]
    return node


@dataclass(frozen=True)
class Rule:
    content: tuple[str, ...]  # folded, in the order of the unfolded words by length
    context: tuple[str, ...]
    distance: int
    forward: bool
    reverse: bool
    canon: str
    origin: str

    @property
    def rank(self) -> int:
        return self.canon.count("_")


def _by_anchor(rules: list[Rule]) -> dict[str, list[tuple[int, Rule]]]:
    """(place, rule) by the rarest of the words that each rule needs: where many rules share a key, few of them are looked at for a text."""
    needs = [(*r.content, *r.context) for r in rules]
    often = Counter(w for own in needs for w in set(own))
    out: dict[str, list[tuple[int, Rule]]] = {}
    for i, (r, own) in enumerate(zip(rules, needs, strict=True)):
        out.setdefault(min(own, key=often.__getitem__), []).append((i, r))
    return out


class MatchIndex:
    """What matching looks up: phrases by number of words, their beginnings, canonical forms, span rules, entities."""

    def __init__(self, lookup: Mapping[int, Iterable[str]], forward: Iterable[str], back: Mapping[str, list[str]], spans: Mapping[str, list[Mapping]] | None = None, entities: Iterable[str] = (), ner: Mapping[str, str] | None = None, live: bool = False, name: str | None = None):
        self.words: dict[int, set[str]] = {n: set(g) for n, g in lookup.items() if g}
        self.aliases: dict[str, str] = {}
        self.starts: set[str] = set()
        claimed = [(key, text) for g in lookup.values() for text in g if (key := alias(text))]
        for g in lookup.values():
            for text in g:
                self._starts(text)
        for key, text in claimed:
            own = self.words.setdefault(key.count(" ") + 1, set())
            if key not in own and key not in self.aliases:
                own.add(key)
                self.aliases[key] = text
                self._starts(key)
        self.lengths = sorted(n for n in self.words if n > 0)
        self.forward = frozenset(forward)
        self.back = {k: v if isinstance(v, str) else v[0] for k, v in back.items() if v}
        self.rules: dict[str, list[Rule]] = {}
        for key, rules in (spans or {}).items():
            self._add_rules(key, rules)
        for own in self.rules.values():
            own.sort(key=lambda r: r.origin.encode())  # stable: rules of a key keep their order
        #: Words with which a phrase or the key of a rule begins: a text without one has no match.
        self.heads = frozenset(text.partition(" ")[0] for own in self.words.values() for text in own) | self.rules.keys()
        self.grouped = {key: _by_anchor(own) for key, own in self.rules.items()}
        self.rule_words = {w for key, own in self.rules.items() for r in own for w in (key, *r.content, *r.context)}
        self.entities: dict[str, str] = {}
        for e in entities:
            self.entities.setdefault(fold(e), e)
        self.ner = ner or {}
        self.live = live
        self.names = [name] if name else []

    def rules_in(self, words: Mapping[str, object]) -> Iterable[tuple[Rule, tuple[str, ...]]]:
        """Rules, by key and in the order of a key, whose key and anchor are among `words`, with the words that they need."""
        for key in sorted((w for w in words if w in self.rules), key=str.encode):
            groups = self.grouped[key]
            few, many = (words, groups) if len(words) < len(groups) else (groups, words)
            for _, r in sorted((x for w in few if w in many for x in groups[w]), key=lambda x: x[0]):
                yield r, (key, *r.content, *r.context)

    def _starts(self, text: str) -> None:
        at = text.find(" ")
        while at >= 0:
            self.starts.add(text[:at])
            at = text.find(" ", at + 1)

    def _add_rules(self, key: str, rules: Iterable[Mapping]) -> None:
        for r in rules:
            if not isinstance(r.get("content"), list):
                continue
            words = by_length({*r["content"], key})
            content = tuple(f for w in words if (f := fold(w)) or not w)
            if not content or (len(content) < 2 <= len(words)):
                continue
            context = tuple(f for w in r.get("context") or () if (f := fold(w)) or not w)
            rule = Rule(content, context, int(r.get("distance", 4)), r.get("forward") is True, r.get("reverse") is True, r["canon"], key)
            self.rules.setdefault(fold(key) or content[0], []).append(rule)

    def canonical(self, s: str) -> str | None:
        """The text itself if canonical, else the first canonical form of which it is a variant, as it is or cleaned."""
        while True:
            if s in self.forward:
                return s
            found = self.back.get(s) or self.back.get(s.replace("_", " "))
            if found is not None:
                return found
            clean = norm(s.replace(" ", "_").replace("'", ""))
            if clean == s or (" " not in s and "'" not in s):
                return None
            s = clean

    def resolve(self, s: str) -> str:
        canon = self.canonical(s)
        if canon is None and s in self.aliases:
            canon = self.canonical(self.aliases[s])
        if canon is None:
            raise EngineError(4, f"Canonical form not found for {s}")
        return canon


def collapse(run: list[Node], canon: str, kind: str, ner: str | None, confidence: float, names: list[str]) -> Node:
    text = " ".join(trim(t.text) for t in run)
    return Node(run[0].key, text, run[0].x, run[-1].y, canon, ner.upper() if ner else ner, canon, kind, confidence, list(names), run)


def _window_text(normals: list[str]) -> str:
    s = " ".join(normals)
    return norm(s) if s.isascii() else fold(norm(s))


def exact(index: MatchIndex, nodes: list[Node], boundary: bool = False) -> list[Node]:
    """Collapses phrases, the one of most words first, then the leftmost, until none is left."""
    limit = max((n for n in index.lengths if n <= len(nodes)), default=0)
    if not limit:
        return nodes
    nodes = list(nodes)
    n = len(nodes)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    spacing = [t.spacing for t in nodes]
    stop = [boundary and t.breaks for t in nodes]
    words, starts = index.words, index.starts
    single = words.get(1, ())

    def window(i: int) -> tuple[int, int]:
        """(words, end) of the longest phrase that starts at node i."""
        best, size, end, normals = 0, 0, i, []
        at = i
        while at < n and size < limit and not stop[at]:
            if not spacing[at]:
                normals.append(nodes[at].normal)
                size += 1
                text = _window_text(normals)
                if text in words.get(size, ()) and not (size == 1 and nodes[i].type):
                    best, end = size, after[at]
                if text and text not in starts:
                    break
            at = after[at]
        return best, end

    found: dict[int, tuple[int, int]] = {}
    heap: list[tuple[int, int]] = []

    def look(i: int) -> None:
        if spacing[i]:
            return
        found[i] = window(i)
        if found[i][0]:
            heapq.heappush(heap, (-found[i][0], i))

    for i, t in enumerate(nodes):
        # Most tokens begin no phrase; those in plain ASCII are told by one lookup.
        if t.normal in starts or t.normal in single or not t.normal.isascii() or not t.normal.islower() or " " in t.normal:
            look(i)
    operations = 0
    while heap:
        size, i = heapq.heappop(heap)
        if nodes[i] is None or found.get(i, (0,))[0] != -size:
            continue
        end, run = found[i][1], []
        at = i
        while at != end:
            run.append(at)
            at = after[at]
        members = [nodes[k] for k in run]
        canon = index.resolve(_window_text([t.normal for k, t in zip(run, members, strict=True) if not spacing[k]]))
        nodes[i] = collapse(members, canon, "exact", None, 100.0, index.names)
        for k in run[1:]:
            nodes[k] = None
        after[i] = end
        if end < n:
            before[end] = i
        at, seen = i, 0
        touched = [i]
        while before[at] >= 0 and seen < limit - 1:
            at = before[at]
            if stop[at]:
                break
            seen += not spacing[at]
            touched.append(at)
        for k in touched:
            look(k)
        operations += 1
        if operations > OPERATIONS:
            raise EngineError(4, "Matching operation limit exceeded")
    return [t for t in nodes if t is not None]


def _from(places: list[int], at: int) -> int:
    i = bisect_left(places, at)
    return places[i] if i < len(places) else -1


def span_window(places: list[list[int]], rule: Rule, line: list[int] | None) -> tuple[int, int] | None:
    """The tightest, then leftmost window that holds a place of each content word within the rule's distance."""
    first, last = places[0], places[-1]
    same = first is last
    if not same and not rule.forward and not rule.reverse:
        return None
    least = len({id(p) for p in places}) - 1
    best = None
    for s in sorted({at for p in places for at in p}):
        if same:
            a = b = s
        elif rule.forward and rule.reverse:
            a, b = _from(first, s), _from(last, s)
        elif rule.reverse:
            a = _from(first, s)
            b = _from(last, a + 1) if a >= 0 else -1
        else:
            b = _from(last, s)
            a = _from(first, b + 1) if b >= 0 else -1
        chosen = [a, b, *(_from(p, s) for p in places[1:-1])]
        low, high = min(chosen), max(chosen)
        if low < 0 or high - low > rule.distance or (line and line[low] != line[high]):
            continue
        if best is None or (high - low, low) < (best[1] - best[0], best[0]):
            best = low, high
        if best[1] - best[0] == least and best[0] == s:
            break
    return best


def _history(t: Node) -> int:
    return (t.type == "spans") + max(map(_history, t.tokens), default=0)


def spans(index: MatchIndex, nodes: list[Node], boundary: bool = False, frozen: set | None = None) -> list[Node]:
    """Applies span rules until none fits: the rule of most underscores, then by key, each at its best window."""
    if not index.rules:
        return nodes
    frozen = set() if frozen is None else frozen
    nodes = list(nodes)
    forms = [fold(t.normal) for t in nodes]
    if not any(f in index.rules for f in forms):
        return nodes
    depth = [_history(t) if t.type else 0 for t in nodes]
    candidates: list[tuple[Rule, tuple[str, ...]]] | None = None
    past: set[tuple[str, ...]] = set()
    applied = 0
    while True:
        places: dict[str, list[int]] = {}
        node_at: list[int] = []
        line: list[int] | None = [] if boundary else None
        segment = 0
        for i, t in enumerate(nodes):
            if not t.type and t.spacing:
                segment += boundary and t.breaks
                continue
            places.setdefault(forms[i], []).append(len(node_at))
            node_at.append(i)
            if line is not None:
                line.append(segment)
        if candidates is None:
            candidates = list(index.rules_in(places))
        candidates = [c for c in candidates if all(w in places for w in c[1])]
        best, score = None, -1
        for rule, _ in candidates:
            if rule.rank <= score:
                continue
            found = span_window([places[w] for w in rule.content], rule, line)
            if found and found[0] == found[1]:
                # A window of one place: its first occurrence that may still change.
                free = (p for p in places[rule.content[0]] if (nodes[node_at[p]].x, nodes[node_at[p]].y) not in frozen and depth[node_at[p]] < DEPTH)
                p = next(free, None)
                found = None if p is None else (p, p)
            if found:
                best, score = (rule, node_at[found[0]], node_at[found[1]] + 1), rule.rank
        if best is None:
            return nodes
        rule, start, end = best
        form = fold(rule.canon)
        if end - start == 1:
            past.add(tuple(forms))
            if nodes[start].type == "spans" and (*forms[:start], form, *forms[end:]) in past:
                frozen.add((nodes[start].x, nodes[start].y))
                continue
        else:
            past.clear()
        applied += 1
        if applied > OPERATIONS:
            raise EngineError(4, "Matching operation limit exceeded")
        ner = "NER" if index.live else index.ner.get(rule.canon)
        nodes[start:end] = [collapse(nodes[start:end], rule.canon, "spans", ner, 100.0, index.names)]
        depth[start:end] = [max(depth[start:end]) + 1]
        forms[start:end] = [form]
        if form in index.rule_words:
            candidates = None


def _surface(t: Node) -> list[str]:
    out = {t.normal, *((t.extra or {}).get("ancestors") or ()), *((t.extra or {}).get("descendants") or ())}
    for u in t.tokens:
        out.update((u.extra or {}).get("ancestors") or ())
        out.update((u.extra or {}).get("descendants") or ())
    return sorted(out, key=str.encode)


def _product(choices: list[list[str]], entities: Mapping[str, str]) -> str | None:
    """The first combination, in sorted order, that names an entity."""
    budget = COMBINATIONS
    stack: list[tuple[int, str]] = [(0, "")]
    while stack:
        budget -= 1
        if budget < 0:
            raise EngineError(4, "Hierarchy combination limit exceeded")
        at, text = stack.pop()
        if at == len(choices):
            low = text.lower()
            found = entities.get(low if low.isascii() else fold(low))
            if found is not None:
                return found
            continue
        stack += [(at + 1, f"{text}_{v}" if at else v) for v in reversed(choices[at])]
    return None


def hierarchy(index: MatchIndex, nodes: list[Node], boundary: bool = False) -> list[Node]:
    """Collapses 9 to 2 neighbours of which some choice of forms, or of their ancestors or descendants, names an entity."""
    if not index.entities:
        return nodes
    nodes, changed = list(nodes), True
    while changed:
        changed = False
        forms = [_surface(t) for t in nodes]
        many = [len(f) > 1 for f in forms]
        breaks = [boundary and t.breaks for t in nodes]
        for n in range(9, 1, -1):
            for i in range(len(nodes) - n + 1):
                if not any(many[i : i + n]) or any(breaks[i : i + n]):
                    continue
                canon = _product(forms[i : i + n], index.entities)
                if canon is not None:
                    nodes[i : i + n] = [collapse(nodes[i : i + n], canon, "hierarchy", nodes[i].ner, 75.0, index.names)]
                    changed = True
                    break
            if changed:
                break
    return nodes


def parse(index: MatchIndex, text: str, ctr: int = 0, boundary: bool = False) -> list[Node]:
    """The nodes of a text; entities are spelt as in it."""
    nodes = from_text(text)
    if index.heads.isdisjoint(t.normal for t in nodes):
        return nodes
    return [restore(t, text) for t in match(index, nodes, ctr, boundary)]


def match(index: MatchIndex, nodes: list[Node], ctr: int = 0, boundary: bool = False) -> list[Node]:
    """Sweeps of the three stages: one if ctr is 2 or more, else 3 - ctr."""
    if ctr < -1000:
        raise EngineError(4, "Matching recursion limit exceeded")
    frozen: set = set()
    for _ in range(1 if ctr >= 2 else 3 - ctr):
        before = nodes
        nodes = hierarchy(index, spans(index, exact(index, nodes, boundary), boundary, frozen), boundary)
        if len(nodes) == len(before) and all(a is b for a, b in zip(nodes, before, strict=True)):
            break  # a sweep that changed nothing changes nothing again
    return nodes


def restore(node: Node, text: str) -> Node:
    """Entities get the text that they cover, spelt as in the source."""
    if node.type:
        node.text = text[node.x : node.y]
        for t in node.tokens:
            restore(t, text)
    return node


def render(nodes: Iterable[Node]) -> str:
    return " ".join(s for t in nodes if (s := t.canon if t.type else t.text.strip(SPACES)))
