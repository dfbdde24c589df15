from __future__ import annotations

import collections

import pytest

import corpus_pipeline
from lexigraph.llm import langid, mixing
from tests.llm.test_dedup import LOWER, classes


def test_stages_on_the_small_table(spark, sf_dir, docs):
    """run() against the stages by brute force; packing is held to whole documents in whole bins."""
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = langid.Classifier(langid.train(docs))
    kept = {i: r["text"] for i, r in rows.items() if (p := model.predict(r["text"]))[0] != "und" and p[2] >= 0.005}
    groups = collections.defaultdict(list)
    for i, t in kept.items():
        groups[t.translate(LOWER)].append(i)
    kept = {i: kept[i] for i in map(max, groups.values())}
    near = classes(sorted(kept.items()))
    kept = {i: t for i, t in kept.items() if near[i] == i}
    frame = docs.where(docs["doc_id"].isin(list(kept)))
    counts = collections.Counter(r["doc_id"] for r in mixing.mix(frame).collect())
    got = collections.Counter()
    for b in corpus_pipeline.run(spark, sf_dir).collect():
        for i, k in zip(b["doc_ids"], b["piece_tokens"], strict=True):
            got[i] += k
    assert got == {i: n * len(kept[i].split()) for i, n in counts.items()}


#: What each stage makes of the odd rows: ids that stay, and how often (mixing draws them, packing has those with a word).
LEFT = {
    "exact_dedup": {2: 1, 3: 1, 6: 1, 7: 1, 9: 2, 10: 1, 11: 1, 12: 1, 13: 1, 14: 1, None: 1, 5: 1},
    "minhash_dedup": {1: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 10: 1, 11: 1, 13: 1, 14: 1, None: 1},
}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_each_stage_takes_odd_rows(spark, sf_dir, odd, nothing, odd_rows, name, stage):
    out = stage(spark, odd.select(*corpus_pipeline.DOCUMENT_COLUMNS), sf_dir)
    assert name == "packing" or tuple(out.columns) == corpus_pipeline.DOCUMENT_COLUMNS
    rows, texts = out.collect(), collections.defaultdict(set)
    for r in odd_rows:
        texts[r[0]].add(r[1])
    if name == "packing":
        got = collections.Counter()
        for b in rows:
            for i, n in zip(b["doc_ids"], b["piece_tokens"], strict=True):
                got[i] += n
        assert got == collections.Counter({i: n for i, n in ((i, sum(len((r[1] or "").split()) for r in odd_rows if r[0] == i)) for i in texts) if n})
    else:
        assert all(r["text"] in texts[r["doc_id"]] for r in rows)
        counts = collections.Counter(r["doc_id"] for r in rows)
        if name == "language_id":
            model = langid.Classifier(langid.train(odd))
            kept = [i for i, t, *_ in odd_rows if (p := model.predict(t))[0] != "und" and p[2] >= 0.005]
            assert counts == collections.Counter(kept) and not {4, 5, 6, 10} & set(kept)
        elif name == "mixing":
            assert counts == collections.Counter(r["doc_id"] for r in mixing.mix(odd).collect())
        else:
            assert counts == LEFT[name]
    assert stage(spark, nothing, sf_dir).count() == 0
