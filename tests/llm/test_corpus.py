from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import math
import time
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import mixing, packing, warc


def test_poisson_inverts_the_distribution(spark):
    us = np.linspace(0, 1, 4001)[:-1]
    for mean in (0.05, 1.0, 7.5, 16.0):
        rows = spark.createDataFrame([(float(u),) for u in us], "u double").select("u", mixing.poisson(F.col("u"), F.lit(mean)).alias("k")).collect()
        p = [math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(100)]
        cdf = np.cumsum(p)
        for u, k in rows:
            assert k == np.searchsorted(cdf, u, "right")


def test_mixing_keeps_columns_of_any_name(odd):
    """Columns named like those made on the way come back as they were."""
    names = ("_rate", "_mean", "_order", "_parts", "_count", "_source", "_0", "_chars")
    wide = odd
    for c in names:
        wide = wide.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    rows = mixing.mix(wide, scale=3.0).collect()
    assert rows and rows[0].__fields__ == [*(c for c in wide.columns if c != "copy"), "copy"]
    assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in rows for c in names)
    plain = collections.Counter((r["doc_id"], r["copy"]) for r in mixing.mix(odd, scale=3.0).collect())
    assert collections.Counter((r["doc_id"], r["copy"]) for r in rows) == plain


def test_mixing_reaches_targets(spark):
    rows = [(i, "x" * 10, "big" if i % 10 else "small") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, weights={"big": 0.4, "small": 0.6}).collect()
    share = collections.Counter(r["source"] for r in out)
    assert abs(share["small"] / len(out) - 0.6) < 0.02 and abs(len(out) - 20_000) < 600
    per = collections.Counter(r["doc_id"] for r in out)
    assert sorted(r["copy"] for r in out if r["doc_id"] == max(per, key=per.get)) == list(range(max(per.values())))
    assert [r["doc_id"] for r in out] != sorted(r["doc_id"] for r in out)


def test_mixing_large_means(spark):
    docs = spark.createDataFrame([(i, "x", "a") for i in range(300)], "doc_id long, text string, source string")
    out = mixing.mix(docs, scale=50.0).groupBy("doc_id").count().collect()
    counts = [r["count"] for r in out]
    assert abs(np.mean(counts) - 50) < 2 and abs(np.var(counts) - 50) < 15


def test_mixing_odd_rows(odd, nothing):
    out = mixing.mix(odd, scale=5.0).collect()
    assert set(out[0].__fields__) == set(odd.columns) and {r["source"] for r in out} >= {"a", None}
    assert mixing.mix(odd, weights={"a": 1.0}).where("source IS NULL OR source <> 'a'").count() == 0
    assert mixing.mix(nothing).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_tightest_fit(seed):
    rng = np.random.default_rng(seed)
    n, capacity, per_source = 300, 100, 2
    items = sorted(((int(s), str(a), int(c)) for s, a, c in zip(rng.integers(1, 101, n), rng.choice(["hot", "b", "c"], n, p=[0.5, 0.3, 0.2]), rng.integers(0, 60, n), strict=True)), key=lambda x: -x[0])
    bins = packing.pack_rows(*zip(*items, strict=True), capacity, per_source)
    for b in bins:
        left = capacity
        seen = [items[r] for r in b]
        assert len({x[2] for x in seen}) == len(b) and max(collections.Counter(x[1] for x in seen).values()) <= per_source
        for r in b:
            left -= items[r][0]
        assert left >= 0
    assert sorted(r for b in bins for r in b) == list(range(n))
    # Replayed against every bin: each item goes to a compatible bin that leaves the least room, and to a new one only if there is none.
    home = {r: k for k, b in enumerate(bins) for r in b}
    state: dict[int, dict] = {}
    for r, (size, source, cluster) in enumerate(items):
        fits = [b["room"] for b in state.values() if b["room"] >= size and b["sources"][source] < per_source and cluster not in b["clusters"]]
        own = state.get(home[r])
        assert (own is None) == (not fits) and (own is None or own["room"] == min(fits))
        own = state.setdefault(home[r], {"room": capacity, "sources": collections.Counter(), "clusters": set()})
        own["room"] -= size
        own["sources"][source] += 1
        own["clusters"].add(cluster)


def test_packing_whole_table(docs):
    rows = packing.pack(docs, capacity=512).collect()
    sizes = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    got = collections.Counter()
    for b in rows:
        assert sum(b["piece_tokens"]) == b["n_tokens"] <= 512 and len(set(b["doc_ids"])) == len(b["doc_ids"])
        for i, s, k in zip(b["doc_ids"], b["piece_starts"], b["piece_tokens"], strict=True):
            got[i] += k
            assert s % 512 == 0 and s + k <= sizes[i]
    assert got == {i: n for i, n in sizes.items() if n}


def test_packing_odd_rows(odd, nothing, odd_rows):
    rows = packing.pack(odd, capacity=100).collect()
    got = collections.Counter()
    for b in rows:
        for i, k in zip(b["doc_ids"], b["piece_tokens"], strict=True):
            got[i] += k
    assert got == collections.Counter({i: n for i, n in ((i, sum(len((r[1] or "").split()) for r in odd_rows if r[0] == i)) for i in {r[0] for r in odd_rows}) if n})
    assert packing.pack(nothing).count() == 0


def test_hot_cluster_and_source_pack_fast():
    n = 6000
    bins = packing.pack_rows([50] * n, ["hot"] * n, [0 if i % 3 == 0 else i for i in range(n)], 400, 4)
    assert sum(map(len, bins)) == n and all(sum(1 for r in b if r % 3 == 0) <= 1 for b in bins)


def test_warc_round_trip(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").union(spark.createDataFrame([(-1, None, None), (None, "http://a/", "<p>x\r\n\r\ny</p>"), (-2, "u", "")], "page_id long, url string, html string"))
    records = warc.derive(warc.responses(pages))
    warc.write(records, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w"))
    key = lambda r: str(tuple(r[c] for c in sorted(r.__fields__)))
    one, two = (sorted(map(key, x.select(*sorted(records.columns)).collect())) for x in (records, back))
    assert one == two and len(one) == 2 * pages.count()


def test_warc_links_and_digests(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sources = {r["record_id"]: r for r in warc.responses(pages).collect()}
    rows = warc.derive(warc.responses(pages)).collect()
    for r in rows:
        s = sources[r["refers_to"]]
        assert r["payload_digest"] == warc.digest(s["payload"].encode()) and r["block_digest"] == warc.digest(r["block"].encode())
        assert r["content_length"] == len(r["block"].encode()) and r["source_headers"] == s["http_headers"] and r["target_uri"] == s["target_uri"]
    assert collections.Counter(r["warc_type"] for r in rows) == {"metadata": len(sources), "conversion": len(sources)}
    assert len({r["record_id"] for r in rows}) == len(rows)
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


class Reader(HTMLParser):
    """Text, links, title and language by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.out, self.links, self.titles, self.lang, self.off = [], [], [], None, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "noscript", "template", "svg"):
            self.off.append(tag)
        if tag == "title":
            self.titles.append("")
        if tag == "html":
            self.lang = dict(attrs).get("lang")
        if not self.off:
            self.out.append("\n" if tag in warc.BLOCKS else "")
            if tag == "a" and "href" in dict(attrs):
                self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        if self.off and self.off[-1] == tag:
            self.off.pop()
        elif not self.off:
            self.out.append("\n" if tag in warc.BLOCKS else "")

    def handle_data(self, data):
        if self.titles and self.lasttag == "title" and "head" in self.off:
            self.titles[-1] += data
        if not self.off:
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def test_derived_records_match_another_parser(spark):
    """Every record of every page, made again with the standard library alone."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want, sha = {}, lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    for r in pages.collect():
        seen = Reader(r["html"])
        text = unescape("".join(seen.out))
        lines = [" ".join(x.split()) for x in text.split("\n")]
        n = len(r["html"].encode())
        meta = ([f"title: {' '.join(unescape(seen.titles[0]).split())}"] if seen.titles else []) + ([f"language: {seen.lang}"] if seen.lang else [])
        meta += ["source-content-type: text/html; charset=utf-8", f"source-content-length: {n}", *(f"outlink: {x} L a/@href" for x in seen.links)]
        want[r["page_id"]] = ("".join(x + "\r\n" for x in meta), "\n".join(x for x in lines if x), sha(r["html"]), r["url"])
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 2 * len(want)
    for r in rows:
        meta, text, payload, url = want[r["page_id"]]
        block = meta if r["warc_type"] == "metadata" else text
        assert " ".join(r["block"].split()) == " ".join(block.split()) and r["block"].count("\n") == block.count("\n")
        assert r["payload_digest"] == payload and r["block_digest"] == sha(r["block"]) and r["target_uri"] == url


def test_broken_markup_costs_no_more_than_its_length():
    for part in ("<a ", "<p", "<script ", "<title>", "<html ", '<a href="x>', "<a b='", "<", "<!--", "<head><meta ", "<svg>", "<a href=", " href", "<a ="):
        page = part * (1_000_000 // len(part))
        start = time.perf_counter()
        warc.plain(page)
        warc.fields(page, {})
        assert time.perf_counter() - start < 8, part


def test_responses_are_records_too(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    made = warc.responses(pages)
    warc.write(warc.response_records(made).union(warc.derive(made)), str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w"))
    ids = {r["record_id"] for r in back.where("warc_type = 'response'").collect()}
    assert ids and ids == {r["refers_to"] for r in back.where("warc_type <> 'response'").collect()}
    key = lambda df: sorted(map(str, df.select("page_id", "record_id", "warc_type", "block", "payload_digest").collect()))
    assert key(warc.derive(warc.responses_of(back))) == key(warc.derive(made))


def test_records_of_others_are_read(spark, tmp_path):
    """Lower-case names, no length, a member for each record, a header that goes on, junk between records, a cut end."""
    def record(head, body):
        return ("WARC/1.1\r\n" + head + "\r\n\r\n").encode() + body + b"\r\n\r\n"

    whole = record("warc-type: response\r\nwarc-record-id: <urn:1>\r\ncontent-length: 30\r\nWARC-Target-URI: http://a/\r\n b", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>x\xff")
    loose = record("WARC-Type: metadata\r\nWARC-Record-ID: <urn:2>", b"two\r\n\r\nparts")
    odd = record("WARC-Type: conversion\r\nContent-Length: none", b"WARC/ is no record")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(b"junk\r\n" + whole + loose + odd + b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 99\r\n\r\nshort")
    (tmp_path / "in" / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (whole, odd)))
    rows = sorted(((r["warc_type"], r["record_id"], r["block"], r["content_length"], r["target_uri"]) for r in warc.read(spark, str(tmp_path / "in")).collect()), key=str)
    one = ("response", "<urn:1>", "HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>x\ufffd", 30, "http://a/ b")
    two, three = ("metadata", "<urn:2>", "two\r\n\r\nparts", 12, None), ("conversion", None, "WARC/ is no record", 18, None)
    assert rows == sorted([one, one, two, three, three], key=str)


def test_plain_text():
    page = "<html><head><title>T &amp; t</title><style>p{}</style></head><body><!-- no --><script>var a='</p>';</script><p>One <b>two</b>&nbsp;three<br>four</p><div>a&lt;b</div>"
    assert warc.plain(page) == "One two three\nfour\na<b"
    assert "title: T & t" in warc.fields(page, {"Content-Type": "text/html"}) and warc.plain("<p") == ""


def test_what_is_not_closed_hides_no_text():
    assert warc.plain("<html><head><title>t</title><body><p>whole body text</p>") == "whole body text"
    assert warc.plain("<p>a</p><svg width=1 /><p>rest of page</p>") == "a\nrest of page"
    assert warc.plain("<head><meta charset=utf-8><script>x='</head>'</script><p>b</p><svg><text>c</text></svg>d<svg><p>e") == "b\nd\ne"
    assert warc.plain("<head>\n<!-- <p> --><link rel=x></title>text<noscript>f") == "text f" and warc.plain("<head></head>g<script>h") == "g"
    assert "outlink: http://x/ L" in warc.fields("<head><title>t</title><a href='http://x/'>y</a>", {})
    assert warc.plain("<svg>" * 100_000 + "z") == "z"
