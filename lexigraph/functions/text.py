"""Scalar text functions and the tokenizer, without Spark.

Words recur, so what depends on a word alone (its pieces, their normal forms and hashes) is worked
out once per distinct word and cached; a document costs one pass of a regular expression over its
runs and a lookup per word. Only the pairing of single quotes looks at the whole document.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# White space, dashes, apostrophes, double quotes, default-ignorable ranges, stop words.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
DASHES = "֊᠆‐‑‒–—―⁓⁻₋−⸺⸻〜〰﹘﹣－"
APOSTROPHES = "'`\xb4ʼ‘’‚‛′‹›＇"
DOUBLE_QUOTES = '"\xab\xbb“”„‟″＂'
IGNORABLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before between both but by can did do does doing don down during each few for "
    "from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off "
    "on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this "
    "those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves"
)
LINE_BREAKS = "\n\x0b\x0c\r\x85  "

SPACE_SET, APOSTROPHE_SET = frozenset(SPACES), frozenset(APOSTROPHES)
_STOPS = frozenset(STOPWORDS.split(" "))


def _class(test) -> str:
    """The body of a character class of the code points that pass `test`."""
    out, start = [], None
    for low, high in ((0, 0x33480), (0xE0000, 0xE1000)):  # no character beyond these passes any test here
        for code in range(low, high):
            good = test(chr(code))
            if good and start is None:
                start = code
            elif start is not None and (not good or code == high - 1):
                out.append(f"\\U{start:08x}-\\U{code - (not good):08x}")
                start = None
    return "".join(out)


def is_joiner(c: str) -> bool:
    """A combining mark or a default-ignorable character."""
    return unicodedata.category(c)[0] == "M" or any(a <= ord(c) <= b for a, b in IGNORABLE)


_JOIN = _class(is_joiner)
_NUMERIC = _class(str.isnumeric)
_NOT_LETTER = _class(lambda c: c.isnumeric() and not c.isalpha())
_LETTER = rf"[^\W{_NOT_LETTER}_ʼ{_JOIN}]"
_SPACE = re.escape(SPACES)
JOINER = re.compile(f"[{_JOIN}]")
RUN = re.compile(f"([{_JOIN}]*[{_SPACE}][{_SPACE}{_JOIN}]*|[{_JOIN}]+\\Z)|[^{_SPACE}]+")
_APOS = re.escape(APOSTROPHES)
PIECE = re.compile(rf"``|´´|(?:(?!ʼ)[\w]|(?<=[{_NUMERIC}])[.,]|(?<={_LETTER})[{_APOS}]|(?<={_LETTER})&(?={_LETTER}))+|.", re.S)
CORE = re.compile(rf"(?!ʼ)\w")
ENDS_QUOTED = re.compile(rf"(?s)(.*{_LETTER})([{_APOS}])\Z")
NUMBER_END = re.compile(rf"(?s)(.*[{_NUMERIC}])([.,])\Z")
FOLDS = str.maketrans({**dict.fromkeys(DASHES, "-"), **dict.fromkeys(APOSTROPHES, "'"), **dict.fromkeys(DOUBLE_QUOTES, '"')})
SPACE_RUN = re.compile(f"[{_SPACE}]+")


def trim(s: str) -> str:
    return s.strip(SPACES)


def norm(s: str, lower: bool = True, collapse: bool = False) -> str:
    """Optionally lower-cased, trimmed, and optionally with runs of white space as single spaces."""
    s = s.lower() if lower else s
    return " ".join(s.split()) if collapse else trim(s)  # SPACES are what Python splits at


@lru_cache(1 << 16)
def _fold_char(c: str) -> str:
    if "가" <= c <= "힣":
        return c
    return "".join(x for x in unicodedata.normalize("NFD", c) if not is_joiner(x))


def fold(s: str) -> str:
    """Canonically decomposed by code point, without marks and default-ignorable characters; Hangul syllables stay."""
    return s if s.isascii() else "".join(map(_fold_char, s))


def normal_form(s: str) -> str:
    s = s.replace("``", '"').replace("´´", '"').translate(FOLDS)
    return trim(fold(trim(s.lower())))


_MASK = (1 << 64) - 1


def murmur64a(data: bytes, seed: int = 1) -> int:
    """MurmurHash64A of `data`."""
    m = 0xC6A4A7935BD1E995
    h = seed ^ (len(data) * m & _MASK)
    whole = len(data) & ~7
    for at in range(0, whole, 8):
        k = int.from_bytes(data[at : at + 8], "little") * m & _MASK
        h = (h ^ ((k ^ (k >> 47)) * m & _MASK)) * m & _MASK
    if whole < len(data):
        h = (h ^ int.from_bytes(data[whole:], "little")) * m & _MASK
    h = (h ^ (h >> 47)) * m & _MASK
    return h ^ (h >> 47)


class Piece(NamedTuple):
    text: str
    normal: str
    mark: int  # 0, or LONE: it is one apostrophe, or QUOTED: it is a word that ends in an apostrophe


LONE, QUOTED = 1, 2


def _piece(text: str) -> Piece:
    if text.isascii() and "'" not in text and "`" not in text:
        return Piece(text, text.lower(), 0)
    base = JOINER.sub("", text)
    return Piece(text, normal_form(text), LONE if len(base) == 1 and base in APOSTROPHE_SET else QUOTED if ENDS_QUOTED.match(base) else 0)


@lru_cache(1 << 17)
def _word_hash(text: str) -> int:
    return murmur64a(text.encode("utf-8", "surrogatepass"))


def token_id(text: str, position: int) -> str:
    """The hash of a token's text without the space that a word keeps, and its position."""
    word = text[:-1] if len(text) > 1 and text[-1] == " " and text[0] not in SPACE_SET and not JOINER.match(text[0]) else text
    return f"{_word_hash(word)}#{position}"


def _edges(piece: str) -> list[str]:
    """A run of word characters without the underscores at its ends and the point or comma after a number."""
    lead = min(len(piece) - len(piece.lstrip("_")), len(piece) - 1)
    core = piece[lead:]
    trail = min(len(core) - len(core.rstrip("_")), len(core) - 1)
    core = core[: len(core) - trail] if trail else core
    number = NUMBER_END.match(core)
    return ["_"] * lead + ([number[1], number[2]] if number else [core]) + ["_"] * trail


def _bare(word: str) -> list[str]:
    """Pieces of a word without joiners."""
    out: list[str] = []
    for m in PIECE.finditer(word):
        out += _edges(m[0]) if len(m[0]) > 1 and m[0] not in ("``", "´´") else [m[0]]
    closing = ENDS_QUOTED.match(out[-1])
    if closing and closing[1][-1] not in "sS":
        out[-1:] = [closing[1], closing[2]]
    return out


@lru_cache(1 << 18)
def word_pieces(word: str) -> tuple[Piece, ...]:
    """Pieces of a run of characters other than white space; joiners stay with what they follow."""
    if word.isalpha() and max(word) < "ʰ":  # Latin letters, none of them an apostrophe or a mark
        return (Piece(word, word.lower() if word.isascii() else fold(word.lower()), 0),)
    stem, end = word[:-1], word[-1]
    if end in ".,;:!?|" and stem.isalpha() and max(stem) < "ʰ":
        return Piece(stem, stem.lower() if stem.isascii() else fold(stem.lower()), 0), Piece(end, end, 0)
    base = JOINER.sub("", word)
    if len(base) == len(word):
        return tuple(map(_piece, _bare(word)))
    # Where each character of `base` begins in `word`; joiners before the first one go with it, or stand apart before punctuation.
    starts = [i for i, c in enumerate(word) if not JOINER.match(c)]
    out: list[str] = []
    if starts and starts[0]:
        if CORE.match(base):
            starts[0] = 0
        else:
            out.append(word[: starts[0]])
    if not starts:
        return (_piece(word),)
    starts.append(len(word))
    at = 0
    for piece in _bare(base):
        out.append(word[starts[at] : starts[at + len(piece)]])
        at += len(piece)
    return tuple(map(_piece, out))


class Token(NamedTuple):
    id: str
    text: str
    x: int
    y: int
    normal: str


def _closed(piece: Piece) -> tuple[Piece, Piece]:
    cut = len(piece.text) - 1
    while JOINER.match(piece.text[cut]):
        cut -= 1
    return _piece(piece.text[:cut]), _piece(piece.text[cut:])


def scan(text: str | None) -> tuple[list[str], list[int], list[int], list[str]]:
    """Texts, starts, ends and normal forms of the tokens of `text`, as `tokenize` gives them."""
    parts: list = []
    marked = False
    for m in RUN.finditer(text or ""):
        if m[1] is not None:
            parts.append(m[1])
        else:
            own = word_pieces(m[0])
            parts += own
            marked = marked or own[0].mark or own[-1].mark or any(p.mark for p in own)
    if marked:
        singles, last, first = 0, -1, -1
        for i, p in enumerate(parts):
            if type(p) is Piece:
                if p.mark == LONE:
                    singles, last = singles + 1, i
                elif p.mark == QUOTED and first < 0:
                    first = i
        if first >= 0 and singles % 2 and last < first:
            parts[first : first + 1] = _closed(parts[first])
    texts, xs, ys, normals = [], [], [], []
    at, word = 0, False
    for p in parts:
        if type(p) is Piece:
            length = len(p[0])
            texts.append(p[0])
            xs.append(at)
            at += length
            ys.append(at)
            normals.append(p[1])
            word = True
            continue
        if word and p[0] == " ":
            texts[-1] += " "
            at += 1
            p = p[1:]
        word = False
        if p:
            texts.append(p)
            xs.append(at)
            ys.append(at + len(p.rstrip(SPACES)))
            normals.append("" if p.isspace() else normal_form(p))
            at += len(p)
    return texts, xs, ys, normals


def tokenize(text: str | None) -> list[Token]:
    """Tokens whose texts concatenate to `text`; x and y are code points, and y leaves out white space at the end."""
    texts, xs, ys, normals = scan(text)
    return [Token(token_id(t, i), t, x, y, n) for i, (t, x, y, n) in enumerate(zip(texts, xs, ys, normals, strict=True))]


PLAIN = re.compile(r"(?!_| )(?:[a-zA-Z0-9]|_(?! |\Z)| (?! |_|\Z))*")


def alias(text: str) -> str | None:
    """The text that the tokens of a synonym spell, if that is another one."""
    if PLAIN.fullmatch(text):
        return None
    key = norm(" ".join(t.normal for t in tokenize(text) if t.normal))
    return key if key and key != text else None


def is_stopword(s: str) -> bool:
    return s in _STOPS if " " not in s else f" {s} " in f" {STOPWORDS} "


def local(iri: str) -> str:
    return iri.rpartition("#")[2]


def by_length(values, reverse: bool = False) -> list[str]:
    """Sorted by code points, then bytes."""
    if len(values) < 2:
        return list(values)
    return sorted(values, key=lambda s: (len(s), s.encode("utf-8", "surrogatepass")), reverse=reverse)


NUMERIC_COMMA = re.compile(rf"(?<![{_NUMERIC}]),|,(?![{_NUMERIC}])")


def split_commas(s: str) -> list[str]:
    """Parts between commas that do not stand between two numeric characters, trimmed, without empty ones."""
    return [x for x in map(trim, NUMERIC_COMMA.split(s)) if x]


PLUS = re.compile(r"(?<!\\)\+")


def plus_parts(s: str) -> list[str] | None:
    """Parts of a span written with plus signs; None if there is no such sign or a part lacks a word. Backslash-plus is text."""
    if "+" not in s:
        return None
    parts = PLUS.split(s)
    return [p.replace("\\+", "+") for p in parts] if len(parts) > 1 and all(map(trim, parts)) else None


def plus_text(s: str) -> str:
    """The text that a literal matches as: signs that part spans are spaces, and others are themselves."""
    return (PLUS.sub(" ", s) if plus_parts(s) else s).replace("\\+", "+") if "+" in s else s
