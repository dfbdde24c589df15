"""From canonical forms and their literals to the tables that matching reads, without Spark."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from .text import by_length, is_stopword, norm, plus_parts, plus_text, split_commas

#: A phrase that begins with one of these is not collapsed inside a longer one. Fixed values.
GRAM_STOPS = frozenset(("of", "to", "and", "for"))


def variants(literals: Iterable[str]) -> list[str]:
    """The forms under which literals are found, sorted by length, then bytes."""
    out: dict[str, None] = {}
    for literal in literals:
        text = plus_text(literal)
        out[norm(text, collapse=True)] = None
        if "_" in text:
            out[norm(text.replace("_", " "), collapse=True)] = None
        if text and text[-1] in "!?.":
            out[text[:-1]] = None
        if "." in text and "..." not in text:
            out[norm(text.replace(".", " . "), lower=False, collapse=True)] = None
    return by_length(out)


def synonyms(raw: Mapping[str, Iterable[str]]) -> dict[str, list[str]]:
    """Canonical form to variants."""
    out: dict[str, list[str]] = {}
    for canon, literals in raw.items():
        key = canon.lower()
        out[key] = by_length({*out[key], *variants(literals)}) if key in out else variants(literals)
    return out


def reverse(forward: Mapping[str, Iterable[str]]) -> dict[str, list[str]]:
    """Variant to canonical forms, in the order of the canonical forms."""
    out: dict[str, dict[str, None]] = {}
    for canon, forms in forward.items():
        for v in forms:
            out.setdefault(v, {})[canon] = None
    return {v: list(canons) for v, canons in out.items()}


def base_entries(canon: str, forms: Iterable[str]) -> list[tuple[int, str]]:
    """(words, text) entries that a canonical form and its variants put into the lookup."""
    out = []
    for s in (canon, *(norm(v, collapse=True) for v in forms)):
        text = s.replace("_", " ")
        out.append((text.count(" ") + 1, text))
        if s is not canon and s and s[-1] in "!?.":
            out.append((s.count(" ") + 1, s[:-1]))
    return out


def rewritten(entries: Iterable[str], n: int) -> Iterable[tuple[int, str]]:
    """Entries of n + 1 words in which the leading n words of one of them are joined by underscores."""
    entries = list(entries)
    grams: dict[str, None] = {}
    for entry in entries:
        words = entry.split(" ")[:n]
        if not GRAM_STOPS.intersection(words):
            grams[" ".join(words)] = None
    if not grams:
        return
    hits = finder(grams)
    for entry in entries:
        for gram in hits(entry):
            text = entry.replace(gram, gram.replace(" ", "_"))
            size = text.count(" ") + 1
            if 2 <= size <= 5:
                yield size, text


def finder(needles: Iterable[str]):
    """A function that gives the needles within a text; one pass over the text where an automaton can be built."""
    needles = [x for x in needles if x]
    if not needles:
        return lambda text: ()
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [x for x in needles if x in text]
    automaton = ahocorasick.Automaton()
    for x in needles:
        automaton.add_word(x, x)
    automaton.make_automaton()
    return lambda text: {x for _, x in automaton.iter(text)}


def lookup(forward: Mapping[str, Iterable[str]]) -> dict[int, list[str]]:
    """Number of words to entries, the longest first; a phrase that can be collapsed first also stands with underscores."""
    groups: dict[int, dict[str, None]] = {}
    for canon, forms in forward.items():
        for n, text in base_entries(canon, forms):
            groups.setdefault(n, {})[text] = None
    for n in range(1, 7):
        groups.setdefault(n, {})
    for n in (5, 4, 3, 2):
        for size, text in list(rewritten(groups[n + 1], n)):
            groups[size][text] = None
    return {n: by_length(g, reverse=True) for n, g in groups.items()}


def _content(words: Iterable[str], keep=lambda w: True) -> tuple[str, ...]:
    clean = dict.fromkeys(norm(w, lower=False, collapse=True) for w in words)
    return tuple(sorted((w for w in clean if keep(w)), key=str.encode))


def plus_rules(canon: str, literals: Iterable[str], compounds: frozenset[str] | set[str]) -> Iterable[tuple[str, tuple[str, ...]]]:
    """(key, content) of the rules that plus signs in literals make, and compounds of two words that are canonical forms."""
    every = dict.fromkeys(literals)
    for literal in list(every) if compounds else ():
        words, text = literal.split(" "), literal
        for pair in map("_".join, zip(words, words[1:], strict=False)):
            if pair in compounds:
                text = text.replace(pair.replace("_", " "), pair + " +")
                if not text.endswith("+"):
                    every[text] = None
    for literal in every:
        parts = plus_parts(literal)
        if parts and (content := _content(parts[1:])):
            yield parts[0], content


def phrase_rules(canon: str, literals: Iterable[str]) -> Iterable[tuple[str, tuple[str, ...]]]:
    """(key, content) of the rules of a compound canonical form and its phrases: the first word, and the others but stop words."""
    if " " not in canon and "_" not in canon:
        return
    terms = [canon]
    for v in sorted({norm(x, lower=False) for x in literals}, key=str.encode):
        if (" " in v or "_" in v) and ("+" not in v or plus_parts(v)):
            term = v.lower().replace(" ", "_")
            if term != canon:
                terms.append(term)
    for term in terms:
        first, *rest = term.split("_")
        if content := _content(rest, lambda w: not is_stopword(w.lower())):
            yield first, content


def spans(raw: Mapping[str, Iterable[str]], distance: int = 4, plus_only: bool = False, comma_lists: bool = False) -> dict[str, list[dict]]:
    """Key word to span rules."""
    if comma_lists:
        raw = {k: list(dict.fromkeys(p for v in vs for p in split_commas(v))) for k, vs in raw.items()}
    compounds = {k for k in raw if "_" in k}
    rules: dict[str, dict[tuple, None]] = {}
    seen: set[tuple] = set()
    for canon, literals in raw.items():
        for key, content in plus_rules(canon, literals, compounds):
            if (key, canon, content) not in seen:
                seen.add((key, canon, content))
                rules.setdefault(key, {})[canon, content] = None
    if not plus_only:
        seen = {(canon, content) for key, canon, content in seen if not key}
        for canon, literals in raw.items():
            for key, content in phrase_rules(canon, literals):
                if (canon, content) not in seen:
                    seen.add((canon, content))
                    rules.setdefault(key, {})[canon, content] = None
        trimmed: dict[str, dict[tuple, None]] = {}
        for key, own in rules.items():
            trimmed[norm(key, lower=False)] = own
        rules = trimmed
    return {key: [{"content": list(content), "distance": distance, "forward": True, "reverse": True, "canon": canon} for canon, content in own] for key, own in rules.items()}
