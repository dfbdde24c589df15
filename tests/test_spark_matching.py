from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexigraph.functions import udfs as U
from lexigraph.functions.text import tokenize
from lexigraph.operators.phrases import find_phrases, phrase_table
from lexigraph.plans.ontology import Ontology
from lexigraph.streaming.parsing import LiveOntology, parse_stream

TTL = "@prefix : <http://e/#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . :tea rdfs:label 'green tea', 'tea' . :Café rdfs:label 'Café Crème' ."


@pytest.fixture(scope="module")
def onto(spark):
    return Ontology.load(spark, content=TTL)


def test_columns(spark):
    df = spark.createDataFrame([(1, "Café ok."), (2, None), (3, "")], "id int, text string")
    rows = df.select("id", U.tokenize(F.col("text")).alias("t"), U.ufold(F.col("text")).alias("f"), U.murmur64(F.lit("Dog")).alias("h"), U.normal_form(F.col("text")).alias("n")).orderBy("id").collect()
    assert [t["text"] for t in rows[0]["t"]] == [t.text for t in tokenize("Café ok.")] and rows[1]["t"] is None and rows[2]["t"] == []
    assert rows[0]["f"] == "Cafe ok." and rows[0]["h"] == "1390790794094431770" and rows[0]["n"] == "cafe ok." and rows[1]["f"] is None


def test_parse_and_entities(spark, onto):
    df = spark.createDataFrame([(1, "Green  tea, CAFÉ CREME"), (2, None), (3, "none")], "id int, text string")
    parsed = df.select("id", U.parser(spark, onto.index)(F.col("text")).alias("parsed"))
    rows = {(r["id"], r["canon"], r["surface"]) for r in U.entities(parsed).collect()}
    assert rows == {(1, "tea", "Green  tea"), (1, "café", "CAFÉ CREME")}
    texts = {r["id"]: (r["a"], r["b"]) for r in parsed.select("id", F.col("parsed.text").alias("a"), U.rendered(F.col("parsed.nodes")).alias("b")).collect()}
    assert texts[1] == ("tea , café", "tea , café") and texts[2][0] is None


def test_error_rows(spark):
    from lexigraph.operators.matching import MatchIndex

    bad = MatchIndex({1: ["x"]}, {"c": ["y"]}, {"y": ["c"]})
    df = spark.createDataFrame([("x",), ("z",)], "text string")
    rows = df.select("text", U.parser(spark, bad)(F.col("text")).alias("p")).collect()
    assert {r["text"]: r["p"]["error"] and r["p"]["error"]["code"] for r in rows} == {"x": 4, "z": None}
    with pytest.raises(Exception, match="Canonical form"):
        df.select(U.parser(spark, bad, failfast=True)(F.col("text"))).collect()


def test_queries_do_not_lose_documents_beyond_the_limit(spark, tmp_path):
    from lexigraph import queries as Q
    from lexigraph.operators.matching import OPERATIONS

    long, pairs = ("abcdefghij " * (OPERATIONS + 1), f"{Q.RULE[0]} {Q.RULE[1]} " * (OPERATIONS + 1))
    spark.createDataFrame([(1, "abcdefghij")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, long), (2, pairs)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, long)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for query in (Q.parse_entities, Q.source_entities, Q.stream_parse, Q.render, Q.span_match, Q.line_break_boundary):
        with pytest.raises(Exception, match="Matching operation limit exceeded"):
            query(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("line_breaks", ["ignore", "boundary"])
def test_joins_find_what_the_kernel_finds(spark, sf_dir, line_breaks, monkeypatch):
    import lexigraph.operators.phrases as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    words = [r["text"].split()[:9] for r in docs.select("text").collect()]
    terms = sorted({" ".join(w[i : i + n]) for w in words for i, n in ((0, 2), (1, 3), (2, 5), (4, 1), (3, 2)) if len(w) >= i + n})
    kernel = docs.select("doc_id", F.explode(U.term_matcher(spark, terms, line_breaks)(F.col("text"))).alias("m")).select("doc_id", "m.*")
    table = phrase_table(spark.createDataFrame(list(enumerate(terms)), "term int, text string"))
    assert sorted(find_phrases(docs, table, line_breaks=line_breaks).collect()) == sorted(kernel.collect())
    monkeypatch.setattr(P, "BROADCAST_PHRASES", -1)
    assert find_phrases(docs, table, line_breaks=line_breaks).count() == kernel.count()


def test_row_terms(spark):
    df = spark.createDataFrame([("a b", ["b"]), ("a b", ["a", "a b"]), (None, ["x"]), ("x", None)], "text string, terms array<string>")
    rows = [r[0] and [tuple(m) for m in r[0]] for r in df.select(U.match_terms(F.col("text"), F.col("terms"))).collect()]
    assert rows == [[(0, 2, 3)], [(1, 0, 3)], None, None]


def test_stream_equals_batch(spark, onto, sf_dir, tmp_path):
    docs = spark.createDataFrame([(i, f"some green tea {i}") for i in range(40)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = parse_stream(stream, onto).select("doc_id", F.explode("parsed.nodes").alias("n")).select("doc_id", "n.canon")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = parse_stream(docs, onto).select("doc_id", F.explode("parsed.nodes").alias("n")).select("doc_id", "n.canon")
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect())


def test_updates_by_stream(spark, onto):
    live = LiveOntology(onto)
    live.apply(spark.createDataFrame([("http://e/#tea", "<http://e/#tea> rdfs:label 'chai' ."), ("http://e/#Café", None)], "subject string, turtle string"), 0)
    seen = []
    live.parse_with(lambda df, n: seen.extend(df.select("parsed.text", "version").collect()))(spark.createDataFrame([("chai tea café crème",)], "text string"), 1)
    assert tuple(seen[0]) == ("tea tea café crème", 1)


def test_every_query_has_its_columns(spark, sf_dir):
    """Each registered query of the engine runs and, where it has SQL, gives the SQL's rows."""
    import duckdb

    from lexigraph import queries as Q

    con = duckdb.connect()
    for t in ("region", "nation", "part", "documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in ("labels", "synonyms_fwd", "parents", "ancestors", "tokenize_conversations", "match_terms_benchmark", "span_match", "update_replace_remove", "stream_parse"):
        got = Q.QUERIES[name](spark, sf_dir)
        c = con.execute(Q.ORACLE[name])
        columns = [x[0] for x in c.description]
        key = lambda r: tuple(map(str, r))
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, c.fetchall())), name


def same_as_sql(spark, folder, *names):
    import duckdb

    from lexigraph import queries as Q

    con = duckdb.connect()
    for t in ("benchmark", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    for name in names:
        got, c = Q.QUERIES[name](spark, str(folder)), con.execute(Q.ORACLE[name])
        columns = [x[0] for x in c.description]
        key = lambda r: tuple(map(str, r))
        assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, c.fetchall())), name


def test_passages_in_a_row_count_as_in_sql(spark, tmp_path):
    """Of passages in a row, which share the space between them, every other one counts; those apart all count."""
    p = "red fox jumps over dogs."
    spark.createDataFrame([(0, p), (1, "blue sky")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, p), (2, f"{p} {p}"), (3, f"x {p}\n{p} {p}  {p}{p} y"), (4, f"{p} and {p}, {p} {p} end"), (5, f"{p} blue sky {p} Blue  Sky"), (6, "nothing")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, "x")], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    same_as_sql(spark, tmp_path, "match_terms_benchmark", "match_phrases_benchmark")


def test_a_letter_before_a_word_is_no_part_of_it(spark, tmp_path):
    """`c` and a word of the vocabulary, side by side or near each other, are not the name of the word's class."""
    text = "c abcdefghij or \u00c7 abcdefghij, abcdefghij x c"
    spark.createDataFrame([(1, "abcdefghij")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, text)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    same_as_sql(spark, tmp_path, "parse_entities", "source_entities", "render", "stream_parse")


def test_batches_are_worked_on_by_parts(monkeypatch):
    """Few texts at a time however large the batch, each distinct one once; nulls, empty and repeated texts keep their places."""
    import pyarrow as pa

    monkeypatch.setattr(U, "PART_SIZE", 20)
    batch = pa.array(["a b c", None, "", "a b c", "x" * 50, "y", None, *["z z"] * 20])
    assert [len(p) for p in U.parts(batch)] == [4, 1, 8, 6, 6, 2] and [x for p in U.parts(batch) for x in p.to_pylist()] == batch.to_pylist()
    assert [x for p in U.parts(pa.array([[1] * 15, None, [1] * 9, []])) for x in p.to_pylist()] == [[1] * 15, None, [1] * 9, []]
    seen = []
    plain = lambda text: pa.array([None if t is None else [t, t] for t in text.to_pylist()], pa.list_(pa.string()))
    run = U.by_parts(U.once_each(lambda text: seen.append(len(text)) or plain(text)))
    assert [x for p in run(iter([batch])) for x in p.to_pylist()] == plain(batch).to_pylist()
    assert max(seen) <= 4 and seen[-1] == 1
