from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from lexigraph.llm import exact, minhash, substring
from lexigraph.llm.components import components

from .conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bags(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append(collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else collections.Counter())
    return out


def classes(rows):
    """Class of each id, by brute force over all pairs that share a shingle."""
    ids, sets = [r[0] for r in rows], bags([r[1] for r in rows])
    index = collections.defaultdict(list)
    for k, b in enumerate(sets):
        for s in b:
            index[s].append(k)
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in {(a, b) for g in index.values() for i, a in enumerate(g) for b in g[i + 1 :]}:
        common = sum((sets[a] & sets[b]).values())
        if common >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - common) - 1e-9:
            x, y = find(a), find(b)
            if ids[x] is not None and (ids[y] is None or ids[x] < ids[y]):
                x, y = y, x
            label[x] = y
    return {i: ids[find(k)] for k, i in enumerate(ids)}


def test_exact_matches_brute_force(odd, odd_rows):
    got = exact.exact_dedup(odd).collect()
    groups = collections.defaultdict(list)
    for r in odd_rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    expected = []
    for g in groups.values():
        keep = max((i for i in g if i is not None), default=None)
        expected += [(i, keep, len(g), i == keep) for i in g]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_exact_on_nothing_and_carried_columns(nothing, docs):
    assert exact.exact_dedup(nothing).count() == 0
    rows = exact.exact_dedup(docs, carry=("lang",)).collect()
    assert rows[0].__fields__ == ["doc_id", "keep_id", "group_size", "kept", "lang"] and len(rows) == docs.count()


def test_exact_does_not_depend_on_the_bitmap(spark, docs, monkeypatch):
    """With a bitmap of 64 places, which nearly all rows share, the groups are the same."""
    from pyspark.sql import functions as F

    from lexigraph.llm import _common

    plain = sorted(exact.exact_dedup(docs).collect())
    monkeypatch.setattr(_common, "PLACES", 6)
    monkeypatch.setattr(exact, "PREFIX_CHARS", 1)
    assert sorted(exact.exact_dedup(docs).collect()) == plain
    keys = spark.range(1000).select(F.col("id").alias("k"))
    monkeypatch.setattr(_common, "PLACES", 12)
    bits = _common.bitmap(keys.where("k < 50"), "k")
    assert bits.count() <= 64
    alive = {r["k"] for r in _common.marked(keys, bits, "k").where("_alive").collect()}
    assert alive >= set(range(50)) and len(alive) < 100


def test_near_matches_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_dedup(docs).collect()}
    assert got == classes(rows)


def test_near_compares_large_families_in_two_passes(spark, monkeypatch):
    """Families of many blocks give the classes of brute force, whether the first block unites them or not."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    r = np.random.default_rng(3)
    rows = []
    for family in range(3):
        base = prose(40 + family, 150).split()
        for k in range(60):
            own = list(base)
            for at in r.choice(150, size=(1, 2, 4)[family] if k % 4 else 3, replace=False):
                own[at] = f"w{family}x{k}x{at}"
            rows.append((1000 * family + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    passes = []
    compared = minhash.compared
    monkeypatch.setattr(minhash, "compared", lambda pairs, *a: passes.append(pairs.count()) or compared(pairs, *a))
    got = {x["doc_id"]: x["class_id"] for x in minhash.near_dedup(docs).collect()}
    expected = classes(rows)
    assert got == expected
    sizes = collections.Counter(expected.values())
    assert max(sizes.values()) >= 40 and len(sizes) > 5 and len(passes) == 3  # one of buckets, which it unites, so that no empty second follows; two of families


def test_near_on_odd_rows(odd, nothing):
    got = collections.Counter(map(tuple, minhash.near_dedup(odd).collect()))
    by_id = {r[0]: r for r in got}
    assert sum(got.values()) == 16 and got[(9, 8, False)] == 2
    assert by_id[1] == (1, 1, True) and by_id[2] == (2, 1, False) and by_id[3] == (3, 1, False)
    assert all(by_id[i][1] == i and by_id[i][2] for i in (4, 5, 6, 7, 8, 10, 13, 14))
    assert by_id[12] == (12, 11, False)
    assert minhash.near_dedup(nothing).count() == 0


def test_near_tells_texts_of_a_repeated_id_apart(spark):
    """No link of any text of a repeated id is lost, whatever the order of rows; texts whose smallest id is the same are one class."""
    a, b, c = prose(11, 60), prose(12, 60), prose(13, 60)
    rows = [(5, a + " end"), (9, a), (9, b), (9, b), (12, b + " end"), (9, c), (14, c.upper()), (None, a), (9, None)]
    for turn in (rows, rows[::-1]):
        docs = spark.createDataFrame(turn, "doc_id long, text string")
        got = collections.Counter(map(tuple, minhash.near_dedup(docs.repartition(3)).collect()))
        assert got == collections.Counter([(5, 5, True), *[(9, 5, False)] * 4, (12, 5, False), (14, 5, False), (None, 5, False), (9, 9, True)])


def test_blocks_lose_no_link(spark, monkeypatch):
    """A family that is cut into blocks gives the same classes; its members are alike in part only."""
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        own = list(words)
        for _ in range(r.randint(0, 6)):
            own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_dedup(docs).collect()} == classes(rows)


def test_signatures_are_unbiased_for_weights():
    rng = np.random.default_rng(3)
    elements = rng.integers(1, 2**63, 60, dtype=np.uint64)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    rows = np.repeat([0, 1], 60)
    w = np.concatenate([a, b])
    keep = w > 0
    s = minhash.signatures(np.concatenate([elements, elements])[keep], rows[keep], w[keep], 2, 4096)
    assert abs((s[0] == s[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 4096)


def test_signatures_do_not_depend_on_company():
    e = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.ones(40, np.int64)
    alone = minhash.signatures(e[:3], np.zeros(3, np.int64), ones[:3], 1)
    both = minhash.signatures(np.concatenate([e[:3], e[3:]]), np.concatenate([np.zeros(3, np.int64), np.ones(37, np.int64)]), ones, 2)
    assert (alone[0] == both[0]).all()


def test_components_of_many_rounds(spark):
    """The driver's work in a round does not grow with the rounds before."""
    from pyspark.sql import functions as F

    chain = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in components(chain, block=2).collect()} == {(i, 0) for i in range(401)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (7, 7), (None, 3), (200, 100)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_many_blocks(spark):
    """Blocks of a few edges, whose stars are joined in rounds, give what one block gives; a hub and repeated edges among them."""
    r = random.Random(3)
    edges = [(r.randrange(-50, 300), r.randrange(-50, 300)) for _ in range(220)] + [(999, i) for i in range(400, 460)] * 2
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for e in edges if e[0] != e[1] for x in e}
    table = spark.createDataFrame([*edges, (None, 5), (7, None)], "a long, b long")
    for block in (16, 100, 1 << 18):
        got = [tuple(x) for x in components(table, block=block).collect()]
        assert len(got) == len(want) and set(got) == want



def plainly_removed(rows, unit, least=25):
    """Units and removed units of each text, one rule at a time, with sets of strings."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        parts = re.split(r"(?<=\n)|(?<=[.!?] )(?![ \t])|(?<=[.!?]\t)(?![ \t])" if unit == "line" else r"(?<=\n\n)", text)
        glued = [""]
        for x in parts:
            glued[-1] += x
            if len(x.split()) >= 5:
                glued.append("")
        glued = [x for x in glued if x]
        old = []
        for u in glued:
            n = " ".join(u.lower().split())
            old.append(n in seen and n != "")
            seen.add(n)
        gone = set()
        for a in range(len(glued)):
            for b in range(a, len(glued)):
                if not old[b]:
                    break
                if len("".join(glued[a : b + 1]).split()) >= least:
                    gone |= set(range(a, b + 1))
        out[i] = (glued, gone)
    return out


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_substring_matches_brute_force(spark, docs, unit):
    rows = [(r["doc_id"], r["text"] if unit == "line" else r["text"].replace(".\n", ".\n\n")) for r in docs.select("doc_id", "text").collect()]
    rows = [(i, re.sub(r"[ \t]*\n\s*\n\s*", "\n\n", t) if unit == "paragraph" else re.sub(r"(?<=[.!?])  +", " ", t)) for i, t in rows]
    got = {r["doc_id"]: r for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit).collect()}
    texts, removed = dict(rows), 0
    for i, (glued, gone) in plainly_removed(rows, unit).items():
        assert got[i]["text"] == "".join(u for k, u in enumerate(glued) if k not in gone)
        taken = "".join(texts[i][a:b] for a, b in got[i]["removed"])
        assert taken.split() == " ".join(u for k, u in enumerate(glued) if k in gone).split() or len(got[i]["removed"]) > 1
        assert "".join(taken.split()) == "".join("".join(u for k, u in enumerate(glued) if k in gone).split()) and got[i]["n_removed"] == len(got[i]["removed"])
        removed += len(gone)
    assert removed > 20


def test_substring_finds_passages_inside_lines(spark):
    """A passage of over fifty words that begins and ends amid sentences is removed; stock lines are left alone."""
    passage = ". ".join(prose(900 + k, 9).capitalize() for k in range(7)) + "."
    broken = passage.replace(". ", ".\n", 3)
    rows = [(i, f"{prose(i, 40)} {passage if i % 2 else broken} {prose(100 + i, 40)}. {prose(200 + i, 30)}") for i in range(12)]
    rows += [(50 + i, f"{prose(300 + i, 60)}\nAll rights reserved by the holder of this text.\nYes.\n{prose(400 + i, 60)}") for i in range(12)]
    got = {r["doc_id"]: r for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == 1 for i in range(1, 12))
    assert all(got[50 + i]["n_removed"] == 0 and got[50 + i]["text"] == texts[50 + i] for i in range(12))
    for i in range(1, 12):
        (a, b), = got[i]["removed"]
        assert texts[i][:a].rstrip() + " " + texts[i][b:].lstrip() == " ".join([got[i]["text"][:a].rstrip(), got[i]["text"][a:].lstrip()]) and len(texts[i][a:b].split()) >= 45


def test_substring_counts_letters_of_unspaced_scripts_and_keeps_repeated_ids_apart(spark):
    sentence = "".join(chr(0x4E00 + k) for k in range(30)) + "\u3002"
    more = "".join(chr(0x5E00 + k) for k in range(40)) + "\u3002"
    rows = [(1, sentence + more), (2, "\u5b57\u3002" + more + sentence + more), (7, prose(1, 40)), (8, prose(1, 40)), (8, prose(2, 60)), (8, None)]
    got = sorted(map(str, ((r["doc_id"], r["text"], r["n_removed"]) for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    expected = [(1, sentence + more, 0), (2, "\u5b57\u3002" + more, 1), (7, prose(1, 40), 0), (8, "", 1), (8, prose(2, 60), 0), (8, None, 0)]
    assert got == sorted(map(str, expected))


def test_substring_on_odd_rows(odd, nothing):
    got = {r["doc_id"]: r for r in substring.substring_dedup(odd).collect()}
    assert got[4]["text"] is None and got[5]["text"] == "" and got[14]["n_removed"] == 1 and got[13]["n_removed"] == 0
    assert len(got[14]["text"].split()) == 30 and got[None]["n_removed"] == 0 and got[2]["text"] == ""
    assert substring.substring_dedup(nothing).count() == 0


def test_sha_is_of_normalised_text(spark, sf_dir):
    from lexigraph.llm.queries import op4_exact_dedup

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op4_exact_dedup(spark, sf_dir).collect():
        assert r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].translate(LOWER).encode()).hexdigest()


def test_joins_without_broadcast_give_the_same(docs, monkeypatch):
    from lexigraph.llm import _common, mixing

    runs = {"near": lambda: minhash.near_dedup(docs), "substring": lambda: substring.substring_dedup(docs), "exact": lambda: exact.exact_dedup(docs), "mix": lambda: mixing.mix(docs)}
    before = {k: sorted(map(str, f().collect())) for k, f in runs.items()}
    for module in (_common, mixing):
        monkeypatch.setattr(module, "BROADCAST_ROWS", -1)
    assert {k: sorted(map(str, f().collect())) for k, f in runs.items()} == before
