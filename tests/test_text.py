from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigraph.functions import text as T
from lexigraph.functions import vocabulary as V

CASES = [
    ("Bees dance at noon.", ["Bees ", "dance ", "at ", "noon", "."]),
    ("U.K. Law", ["U", ".", "K", ". ", "Law"]),
    ("By 1999.", ["By ", "1999", "."]),
    ("2,345.6, then 9.81.", ["2,345.6", ", ", "then ", "9.81", "."]),
    ("__init__ or Linen_", ["_", "_", "init", "_", "_ ", "or ", "Linen", "_"]),
    ("snake_case", ["snake_case"]),
    ("say 'yes' twice", ["say ", "'", "yes", "' ", "twice"]),
    ("the dogs' bowls", ["the ", "dogs' ", "bowls"]),
    ("'the dogs' bowls", ["'", "the ", "dogs", "' ", "bowls"]),
    ("y'all O'Neil can't", ["y'all ", "O'Neil ", "can't"]),
    ("R&D & b", ["R&D ", "& ", "b"]),
    ("``so'' x", ["``", "so'", "' ", "x"]),
    ("a\tb\nc  d", ["a", "\t", "b", "\n", "c ", " ", "d"]),
    ("été ok", ["été ", "ok"]),
    ("", []),
]


@pytest.mark.parametrize("text, pieces", CASES)
def test_pieces(text, pieces):
    assert [t.text for t in T.tokenize(text)] == pieces


def test_ids_offsets_and_normal_forms():
    a, b = T.tokenize("Dog walks")
    assert a == ("1390790794094431770#0", "Dog ", 0, 3, "dog") and b.id.endswith("#1") and (b.x, b.y, b.normal) == (4, 9, "walks")
    assert [t.normal for t in T.tokenize("Café—“Crème”")] == ["cafe", "-", '"', "creme", '"']
    assert T.fold("Ångström ​ß 각") == "Angstrom ß 각"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab sS'.,_-&1`´́​ \né+")))
def test_tokens_concatenate(text):
    tokens = T.tokenize(text)
    assert "".join(t.text for t in tokens) == text
    at = 0
    for t in tokens:
        assert t.x == at and t.y == at + len(t.text.rstrip(T.SPACES))
        at += len(t.text)
    assert all(t.normal == T.normal_form(t.text) for t in tokens)


def test_plus_and_commas():
    assert T.plus_parts("a+b c") == ["a", "b c"] and T.plus_parts("C++") is None and T.plus_parts(r"a\+b") is None
    assert T.plus_text("a+b") == "a b" and T.plus_text("C++") == "C++" and T.plus_text(r"a\+b") == "a+b"
    assert T.split_commas("Top 1,000 words, more,, x") == ["Top 1,000 words", "more", "x"]


def test_stopwords_and_alias():
    assert T.is_stopword("the") and T.is_stopword("and any") and not T.is_stopword("dog")
    assert T.alias("plain words") is None and T.alias("well/being") == "well / being" and T.alias("C++") == "c + +"
    assert T.local("http://a#b#c") == "c" and T.local("http://a/b") == "http://a/b"


def test_variants_and_lookup():
    assert V.variants(["Big_Cat!"]) == ["Big_Cat", "big cat!", "big_cat!"]
    assert "u . k . law" in V.variants(["u.k. law"])
    found = V.lookup({"x": ["a b c", "a b"]})
    assert found[2] == ["a_b c", "a b"] and set(found) >= {1, 2, 3, 4, 5, 6}


def test_finder_without_automaton(monkeypatch):
    import sys

    with_it = sorted(V.finder(["ab", "b c", "zz"])("ab cd"))
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    assert sorted(V.finder(["ab", "b c", "zz"])("ab cd")) == with_it == ["ab", "b c"]


def test_span_rules():
    rules = V.spans({"office_of_records": ["Office of Records"], "tea": ["leaf+cup"]})
    assert rules["office"] == [{"content": ["records"], "distance": 4, "forward": True, "reverse": True, "canon": "office_of_records"}]
    assert rules["leaf"][0]["content"] == ["cup"] and V.spans({"a_b": ["a b"]}, plus_only=True) == {}
