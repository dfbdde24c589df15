from __future__ import annotations

import itertools
import random

import pytest

from lexigraph.errors import EngineError
from lexigraph.functions import vocabulary as V
from lexigraph.functions.text import tokenize
from lexigraph.functions.udfs import flat_nodes, parse_text
from lexigraph.operators import matching as M
from lexigraph.operators.terms import match_terms


def index(raw, **more):
    forward = V.synonyms(raw)
    return M.MatchIndex(V.lookup(forward), forward, V.reverse(forward), V.spans(raw), **more)


def found(ix, text, **more):
    return [(t.canon, t.text, t.type) for t in parse_text(ix, text, **more) if t.type]


COURSES = {"mathematics": ["mathematics"], "applied_mathematics": ["applied mathematics"], "advanced_applied_mathematics": ["advanced applied mathematics"], "office_of_tidal_records": ["office of tidal records"]}


def test_stages():
    ix = index(COURSES)
    assert found(ix, "mathematics, applied") == [("applied_mathematics", "mathematics, applied", "spans")]
    assert found(ix, "Advanced  Applied\nMathematics!") == [("advanced_applied_mathematics", "Advanced  Applied\nMathematics", "exact")]
    assert found(ix, "tidal office old records") == [("office_of_tidal_records", "tidal office old records", "spans")]
    assert found(ix, "tidal a b c d office records") == []


def test_line_breaks():
    ix = index({"glacier_survey": ["glacier survey"]})
    assert found(ix, "survey\nglacier") and not found(ix, "survey\nglacier", boundary=True)
    assert not found(ix, "glacier\nsurvey", boundary=True) and found(ix, "glacier survey\n", boundary=True)


def test_nested_history_and_render():
    ix = index({"a_b": ["x y"], "long": ["a_b z"]})
    nodes = parse_text(ix, "so x y z.")
    assert M.render(nodes) == "so long ."
    rows = flat_nodes(nodes)
    top = [r for r in rows if r[1] is None]
    assert len(top) == 3 and [r[9] for r in rows if r[10]] == ["long", "a_b"] and max(r[13] for r in rows) == 2
    assert nodes[1].as_json()["swaps"]["confidence"] == 100.0


def test_longest_then_leftmost_and_ties():
    ix = index({"p": ["a b"], "q": ["b c d"], "r": ["d e"]})
    assert found(ix, "a b c d e") == [("q", "b c d", "exact")]
    ix = index({"one": ["café"], "two": ["cafe"]})
    assert found(ix, "CAFÉ cafe") == [("two", "CAFÉ", "exact"), ("two", "cafe", "exact")]


def test_no_canonical_form_is_an_error():
    ix = M.MatchIndex({1: ["x"]}, {"c": ["y"]}, {"y": ["c"]})
    with pytest.raises(EngineError, match="Canonical form not found"):
        parse_text(ix, "x")


def test_hierarchy():
    ix = index({"c": ["c"]}, entities=["big_cat_house"])
    tokens = [{"id": str(i), "text": w, "x": i, "y": i + 1, "normal": w, "descendants": d} for i, (w, d) in enumerate([("large", ["big"]), ("cat", []), ("house", [])])]
    out = M.hierarchy(ix, [M.from_json(t) for t in tokens])
    assert [(t.canon, t.type, t.confidence) for t in out] == [("big_cat_house", "hierarchy", 75.0)]
    many = [M.from_json({"id": "x", "text": "x", "x": 0, "y": 1, "normal": "x", "ancestors": [f"{k}{i}" for i in range(40)]}) for k in range(9)]
    with pytest.raises(EngineError, match="combination"):
        M.hierarchy(ix, many)


def test_prepared_tokens_are_checked():
    with pytest.raises(EngineError):
        M.from_json({"id": "a", "text": "x", "normal": "x", "x": "0", "y": 1})
    t = M.from_json({"id": "a", "text": "x", "normal": "x", "x": 0, "y": 1, "own": 2**60})
    assert t.as_json()["own"] == 2**60


def test_spans_end():
    ix = index({"cafe": ["tea+tea"], "tea": ["café+café"]})
    assert found(ix, "tea")[-1][0] in ("cafe", "tea")


def brute_span(words, text, distance):
    """Whether each word of a rule has an occurrence so that all lie within `distance`."""
    tokens = [t.normal for t in tokenize(text) if t.normal]
    places = [[i for i, t in enumerate(tokens) if t == w] for w in words]
    return any(max(c) - min(c) <= distance for c in itertools.product(*places)) if all(places) else False


def test_spans_match_all_choices():
    r = random.Random(11)
    for _ in range(400):
        words = r.sample(["red", "blue", "green", "old"], r.randint(2, 3))
        text = " ".join(r.choice(["red", "blue", "green", "old", "x", "y", ","]) for _ in range(r.randint(2, 12)))
        ix = M.MatchIndex({}, {"k_k": ["k"]}, {}, {words[0]: [{"content": words[1:], "distance": 3, "forward": True, "reverse": True, "canon": "k_k"}]})
        got = M.spans(ix, [M.from_token(t) for t in tokenize(text)])
        assert any(t.type for t in got) == brute_span(words, text, 3), (words, text)


def test_larger_distance_loses_nothing():
    r = random.Random(3)
    for _ in range(200):
        text = " ".join(r.choice("abcxyz") for _ in range(14))
        hits = [any(t.type for t in M.spans(M.MatchIndex({}, {}, {}, {"a": [{"content": ["b", "c"], "distance": d, "forward": True, "reverse": True, "canon": "k_k"}]}), [M.from_token(t) for t in tokenize(text)])) for d in range(2, 8)]
        assert hits == sorted(hits)


def test_terms():
    assert match_terms("Intro to Data Science", ["data science", "intro"]) == [(1, 0, 5), (0, 9, 21)]
    assert match_terms("C++ or c + +, applied then math", ["C++", "math+applied", "c++"]) == [(0, 0, 3), (0, 7, 12), (1, 14, 31)]
    assert match_terms("data\nscience", ["data science"]) and not match_terms("data\nscience", ["data science"], "boundary")
    assert match_terms("anything", ["", " "]) == [] and match_terms("x", []) == []


def test_terms_do_not_feed_each_other():
    r = random.Random(9)
    vocabulary = [" ".join(r.choice("abcd") for _ in range(r.randint(1, 3))) for _ in range(12)]
    for _ in range(200):
        words = [r.choice("abcde") for _ in range(r.randint(1, 15))]
        got = match_terms(" ".join(words), vocabulary)
        first = {t: vocabulary.index(t) for t in vocabulary}
        taken, expected = [False] * len(words), []
        for n in (3, 2, 1):
            for i in range(len(words) - n + 1):
                if not any(taken[i : i + n]) and " ".join(words[i : i + n]) in first:
                    taken[i : i + n] = [True] * n
                    expected.append((first[" ".join(words[i : i + n])], 2 * i, 2 * (i + n) - 1))
        assert got == sorted(expected, key=lambda m: m[1])


def test_sweeps():
    with pytest.raises(EngineError):
        M.match(index(COURSES), [], -1001)
    assert M.match(index(COURSES), [], 2) == []


def test_rules_that_share_a_key_are_not_all_looked_at(monkeypatch):
    """With many rules of one key, a text costs those whose rarest word it has; all of them are still found."""
    n, looked, window = 2000, [], M.span_window
    ix = index({f"supplier_{k}": [f"supplier {k}"] for k in range(n)})
    assert all(found(ix, f"{k} w w supplier") == [(f"supplier_{k}", f"{k} w w supplier", "spans")] for k in range(n))
    assert [t[0] for t in found(ix, "7 supplier 12 w supplier w 3")] == ["supplier_12", "supplier_3"]
    monkeypatch.setattr(M, "span_window", lambda *a: looked.append(a) or window(*a))
    own = list(ix.rules_in({"supplier": [1], "5": [0], "w": [2]}))
    assert [r.canon for r, _ in own] == ["supplier_5"]
    assert found(ix, "5 supplier") and len(looked) <= 2
