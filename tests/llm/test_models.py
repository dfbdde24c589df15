from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import forest, langid, lbl, quality
from lexigraph.llm.words import buffers, hashed, shingles


def held(i, n):
    return zlib.crc32(str(i).encode()) % n == 2


def test_language_is_told_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(langid.remainder("doc_id", 4) != 2))
    rows = langid.identify(docs, model).select("doc_id", "lang", "lang_pred", "score", "rejected").collect()
    mine = [r for r in rows if held(r["doc_id"], 4)]
    assert np.mean([r["lang"] == r["lang_pred"] for r in mine]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) < 0.03 * len(rows)


def test_language_of_odd_rows(spark, odd, nothing, docs):
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    for i in (4, 5, 6, 10):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"]
    assert got[1]["lang_pred"] in model and got[1]["keep_id"] == "clash"
    assert langid.train(nothing) == {} and langid.identify(nothing, {}).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}


def test_long_texts_keep_their_margin(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en' OR lang = 'de'")
    model = langid.train(docs.where(langid.remainder("doc_id", 4) != 2))
    texts = [r["text"] for r in docs.where((langid.remainder("doc_id", 4) == 2) & (F.col("lang") == "en")).select("text").distinct().collect()]
    long = "\n".join(sorted(x for x in texts if x))[:3_000_000]
    assert len(long) == 3_000_000
    r = langid.identify(spark.createDataFrame([(long,)], "text string"), model).head()
    lang, score, margin = langid.Classifier(model).predict(long[:30_000])
    assert r["lang_pred"] == lang == "en" and not r["rejected"] and r["score"] > 0.03 and score == margin


def test_sample_is_bounded(docs, monkeypatch):
    monkeypatch.setattr(langid, "DICT_BYTES", 5000)
    assert all(len(d) <= 5000 + langid.SAMPLE_CHARS * 4 for d in langid.train(docs).values())


def test_language_matches_plain_compression(spark, docs):
    """Each prediction again: whole text in blocks, once with each dictionary, by a compressor of its own."""
    import zstandard

    model = langid.train(docs.where(langid.remainder("doc_id", 4) != 2))
    assert model == langid.train(docs.repartition(7).where(langid.remainder("doc_id", 4) != 2))
    for r in langid.identify(docs, model).collect():
        data = (r["text"] or "").lower().encode()
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        sizes = {}
        for lang, sample in model.items():
            cctx = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(cctx.compress(data[i : i + langid.BLOCK])) for i in range(0, len(data), langid.BLOCK))
        first, second = sorted(sizes.values())[:2]
        assert sizes[r["lang_pred"]] == first and r["score"] == pytest.approx((second - first) / second) and r["rejected"] == ((second - first) / second < 0.005)


def test_a_language_of_long_texts_only_is_learned(spark):
    from .conftest import prose

    drawn = lambda k, n: " ".join(random.Random(k).choices(prose(5, 300).split(), k=n))
    rows = [(i, drawn(i, 12_000), "xx") for i in range(5)] + [(10 + i, "zu den und der die das " * 30, "de") for i in range(5)] + [(30, None, "fr"), (31, " ", "es"), (32, "text", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model) == {"xx", "de"} and len(model["xx"]) >= langid.SAMPLE_CHARS
    assert langid.identify(spark.createDataFrame([(drawn(77, 500),)], "text string"), model).first()["lang_pred"] == "xx"


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        langid.train(spark.range(9).selectExpr("id AS doc_id", "'text' AS text", "CAST(id % 4 AS STRING) AS lang"))


def brute_links(rows, threshold=0.95):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = collections.defaultdict(set)
    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                links[a].add(b)
    label = {}
    for k in range(len(rows)):
        if k in label:
            continue
        group, todo = {k}, [k]
        while todo:
            for b in links[todo.pop()] - group:
                group.add(b)
                todo.append(b)
        least = min((rows[g][0] for g in group if rows[g][0] is not None), default=None)
        label |= dict.fromkeys(group, least)
    return sorted(((rows[k][0], len(links[k]), label[k], rows[k][0] == label[k]) for k in range(len(rows))), key=str)


@pytest.mark.parametrize("leaf", [512, 16])
def test_vectors_match_brute_force(spark, sf_dir, monkeypatch, leaf):
    monkeypatch.setattr(forest, "LEAF", leaf)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rng = np.random.default_rng(1)
    for k in range(150):  # a dense group, and copies
        v = np.array(rows[3][1]) + 0.015 * rng.standard_normal(64)
        rows.append((10_000 + k, v.tolist()))
    rows += [(20_000 + k, rows[5][1]) for k in range(40)]
    got = forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    expected = brute_links(rows)
    found, true = sum(r["n_links"] for r in got), sum(r[1] for r in expected)
    assert found <= true and found >= 0.97 * true
    if leaf == 512:
        assert sorted(map(tuple, got), key=str) == expected


def test_vectors_of_many_lengths(spark, monkeypatch):
    """1,100 lengths, with and without trees of their own: no vector loses its links."""
    rng = np.random.default_rng(4)
    rows = []
    for dim in range(1, 1101):
        v = rng.standard_normal(dim)
        rows += [(2 * dim, v.tolist()), (2 * dim + 1, (v * 2 + 0.001 * v[::-1]).tolist())]
    rows += [(10_000 + k, rng.standard_normal(5).tolist()) for k in range(40)]
    monkeypatch.setattr(forest, "PLAIN", 30)
    got = forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == brute_links(rows)


def test_recall_of_planted_pairs(spark):
    """Every end of 2,000 pairs with cosines of 0.95 to 0.99 among 12,000 vectors, some of them in dense groups."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((12_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(2000):
        c = rng.uniform(0.9501, 0.99)
        other = rng.standard_normal(32)
        other -= (other @ x[k]) * x[k]
        x[6000 + k] = c * x[k] + math.sqrt(1 - c * c) * other / np.linalg.norm(other)
    x[9000:9600] = x[9000] + 0.02 * rng.standard_normal((600, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in forest.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.97 * near.sum() and found[:2000].sum() >= 0.97 * near[:2000].sum()


def test_odd_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one), (2, [2.0, 4.0, 6.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 3.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, [1.0, 2.0]), (9, one), (9, one), (None, one), (10, [-1.0, -2.0, -3.0]), (11, []), (12, [1e300, 2e300, 3e300]), (13, [0.0, -0.0, 1.0]), (14, [-0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    got = sorted(map(tuple, forest.near_vectors(df).collect()), key=str)
    rows = [(i, None if v == [] else [x / 1e300 if x is not None and abs(x) > 1e100 and math.isfinite(x) else x for x in v] if v else v) for i, v in rows]
    expected = brute_links(rows)
    assert [(a, n, c) for a, n, c, _ in got] == [(a, n, c) for a, n, c, _ in expected]
    assert forest.near_vectors(df.limit(0)).count() == 0


def test_scores(spark, sf_dir):
    from lexigraph.llm.queries import op10_lm_scoring

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts = collections.Counter()
    for i, t in texts.items():
        if not held(i, 7):
            counts.update([*lbl.tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    got = op10_lm_scoring(spark, sf_dir).collect()
    assert len(got) == len(texts)
    base = model = 0.0
    for r in got:
        words = [*lbl.tokens(texts[r["doc_id"]]), None]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(r["doc_id"], 7), len(words), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        if r["held_out"]:
            base, model = base + r["base_score"], model + r["score"]
    assert model > base


def test_model_scores_match_plain_sums(docs, monkeypatch):
    """The score of each text again, token by token: the class by its vectors, the word by its add-one share."""
    docs = docs.coalesce(1)
    kept = {}

    def train(texts, vocabulary, plain=lbl.train):
        kept["vocabulary"], kept["model"] = vocabulary, plain(texts, vocabulary)
        return kept["model"]

    monkeypatch.setattr(lbl, "train", train)
    rows = {r["doc_id"]: r for r in lbl.score(docs, langid.remainder("doc_id", 7) != 2).collect()}
    model, v = kept["model"], kept["vocabulary"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = collections.Counter(w for i, t in texts.items() if not held(i, 7) for w in lbl.tokens(t))
    own = {w for w in counts if v.index.get(w, lbl.SINGLE) < lbl.SINGLE}
    sizes = collections.Counter()
    for w, c in counts.items():
        if w not in own:
            sizes[lbl.ending(w)] += c + 1
    out, context, places, bias = (p.astype(float) for p in model.parts())
    for i in sorted(texts)[:25]:
        total, before, last = 0.0, 0, 0
        for w in [*lbl.tokens(texts[i])[:400], None] if len(lbl.tokens(texts[i])) <= 400 else []:
            k = 0 if w is None else 1 + v.index[w] if w in own else 1 + lbl.SINGLE + lbl.ending(w)
            logits = out @ (context[last] @ places[0] + context[before] @ places[1]) + bias
            total += (logits[k] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()) / math.log(10)
            if k > lbl.SINGLE:
                total += math.log10((counts[w] + 1) / (sizes[lbl.ending(w)] + 1))
            before, last = last, k
        assert not total or rows[i]["score"] == pytest.approx(total, rel=1e-4)


def test_scores_of_odd_rows(odd, nothing):
    rows = lbl.score(odd, langid.remainder("doc_id", 7) != 2).collect()
    assert len(rows) == 16
    got = {r["doc_id"]: r for r in rows}
    assert got[4]["n_tokens"] == got[5]["n_tokens"] == got[6]["n_tokens"] == 1 and got[4]["n_known"] == 1
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows) and got[7]["n_tokens"] == 40_001
    assert lbl.score(nothing, F.lit(True)).count() == 0
    assert len(lbl.score(odd, F.lit(False)).collect()) == 16


def test_model_is_normalised(docs):
    vocabulary = lbl.Vocabulary(lbl.count_words(docs.select("text")))
    a, b, z = lbl.train(docs.select("text"), vocabulary).tables()
    total = (10.0 ** (a[:50, None, :].astype(float) + b[None, :50, :] - z[:50, :50, None])).sum(axis=2)
    assert np.allclose(total, 1, atol=1e-4)
    # Words of a class, and one unseen word, share the class's probability.
    sizes = 10 ** vocabulary.class_size[1 + lbl.SINGLE :]
    counts = collections.Counter(w for r in docs.collect() for w in lbl.tokens(r["text"]))
    sums = np.ones(lbl.ENDINGS)
    for w, c in counts.items():
        if vocabulary.index.get(w, lbl.SINGLE) >= lbl.SINGLE:
            sums[lbl.ending(w)] += c + 1
    assert np.allclose(sizes, sums)


def test_gumbel_selection(spark):
    rows = [(i, 10, float(i % 50)) for i in range(20_000)] + [(None, 1, 3.0)]
    weights = spark.createDataFrame(rows, "doc_id long, n_features long, log_weight double")
    got = quality.select(weights, 0.3).collect()
    k = math.ceil(0.3 * len(rows))
    assert sum(r["selected"] for r in got) == k
    best = sorted(got, key=lambda r: -r["gumbel_key"])[:k]
    assert all(r["selected"] for r in best)


def test_gumbel_ties_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(quality, "uniform", lambda *a: F.lit(0.5))
    weights = spark.createDataFrame([(i, 1, 0.0) for i in range(10_000)], "doc_id long, n_features long, log_weight double")
    chosen = sorted(r["doc_id"] for r in quality.select(weights, 0.25).where("selected").collect())
    assert chosen == list(range(2500))


def test_resampling(spark, sf_dir, docs, nothing):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality.resample(docs, labels).collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good, bad = ([rows[i]["log_weight"] / max(1, rows[i]["n_features"]) for i, q in marks.items() if q == k] for k in (1, 0))
    assert np.median(good) > np.median(bad)
    assert np.mean([rows[i]["selected"] for i, q in marks.items() if q == 1]) > 0.9
    assert quality.resample(nothing, labels).count() == 0


def test_weights_match_plain_counting(spark, sf_dir, docs):
    """Every log weight again, with whole numbers and dictionaries: words and pairs in 10,000 buckets, add-one models."""
    from lexigraph.llm import words

    mask, base, values = (1 << 64) - 1, int(words.BASE), [int(x) for x in words.VALUES]

    def mixed(x):
        x = (x ^ (x >> 30)) * int(words.M1) & mask
        x = (x ^ (x >> 27)) * int(words.M2) & mask
        return x ^ (x >> 31)

    def word(w):
        total, power = 0, base
        for byte in w.encode():
            total, power = (total + values[byte] * power) & mask, power * base & mask
        return mixed(total)

    def buckets(text):
        hashes = [word(w) for w in (text or "").lower().split()]
        return collections.Counter([h % 10_000 for h in hashes] + [mixed((a * base + b) & mask) % 10_000 for a, b in zip(hashes, hashes[1:], strict=False)])

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]}
    own = {r["doc_id"]: buckets(r["text"]) for r in docs.collect()}
    target, raw = collections.Counter(), collections.Counter()
    for i, found in own.items():
        raw.update(found)
        target.update(found if i in good else {})
    p, q = sum(target.values()) + 10_000, sum(raw.values()) + 10_000
    for r in quality.resample(docs, labels).collect():
        want = sum(n * (math.log((target[b] + 1) / p) - math.log((raw[b] + 1) / q)) for b, n in own[r["doc_id"]].items())
        assert r["n_features"] == sum(own[r["doc_id"]].values()) and r["log_weight"] == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_resampling_of_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.resample(odd, labels).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 16 and by_id[4]["log_weight"] == by_id[5]["log_weight"] == 0.0


def test_features_match_plain_counting(docs):
    import pyarrow as pa

    texts = [r["text"] for r in docs.limit(20).collect()] + [None, "", "word"]
    words, firsts = hashed(*buffers(pa.array(texts)))
    counts = [len((t or "").lower().split()) for t in texts]
    assert np.diff(firsts).tolist() == counts
    vocabulary = {}
    for t, a in zip(texts, firsts, strict=False):
        for k, w in enumerate((t or "").lower().split()):
            assert vocabulary.setdefault(w, words[a + k]) == words[a + k]
    assert len(set(vocabulary.values())) == len(vocabulary)
    _, rows = shingles(words, firsts, 5)
    assert np.bincount(rows, minlength=len(texts)).tolist() == [0 if not n else max(1, n - 4) for n in counts]
