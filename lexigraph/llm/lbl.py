"""A log-bilinear language model, trained in numpy with noise-contrastive estimation.

Tokens fall into classes: the end of a text, each of the most frequent words, and classes of all other
words by ending. Two preceding classes predict the next: its score is the product of its vector with the
sum of the context's vectors, each times a matrix of its position, plus a bias. Training is data-parallel:
each task passes over its own texts from a common start, and the parameters are averaged by tokens. The
scores of all contexts, and their normalisers, are three tables made by matrix products, so that
scoring is a lookup. A word's share of its class comes from add-one counts of the training tokens.

Counts of frequent words are broadcast (a table of bounded size); those of the others, which grow
with the corpus, meet the tokens in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed

#: Words with a class of their own, classes of other words, and words whose counts are broadcast.
SINGLE, ENDINGS, HEAD = 767, 256, 65_536
CLASSES = 1 + SINGLE + ENDINGS
DIM, NOISE, BATCH, RATE = 24, 32, 2048, 0.08
#: A task hands on its word counts when it holds so many distinct words.
HELD_WORDS = 300_000
AVERAGERS = 8


def tokens(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z; the end is not among them."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def count_words(texts: DataFrame) -> DataFrame:
    """(word, ending, c) over all rows of a one-column table; null ending: the end of texts."""

    def run(batches):
        held: Counter = Counter()
        ends = 0

        def out():
            words = list(held)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(ending, words), pa.int32()), pa.array(list(held.values()), pa.int64())], names=["word", "ending", "c"])

        for batch in batches:
            ends += batch.num_rows
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([None], pa.int32()), pa.array([ends], pa.int64())], names=["word", "ending", "c"])

    return texts.mapInArrow(run, "word binary, ending int, c long").groupBy("word", "ending").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The frequent words with their counts, and sums over all words by ending."""

    def __init__(self, counts: DataFrame):
        self.total, self.distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
        words = counts.where("ending IS NOT NULL")
        by_count = words.groupBy("c").count().orderBy(F.desc("c")).limit(HEAD).collect()
        seen, least = 0, None
        for r in by_count:  # all words of a count are frequent, or none
            if seen + r["count"] > HEAD:
                break
            seen, least = seen + r["count"], r["c"]
        head = words.where(F.col("c") >= least).collect() if least is not None else []
        head = sorted(((-r["c"], bytes(r["word"]), r["ending"]) for r in head))
        self.index = {w: i for i, (_, w, _) in enumerate(head)}
        self.counts = np.array([-c for c, _, _ in head], np.int64)
        own = np.arange(len(head)) < SINGLE
        suffix = np.array([e for _, _, e in head], np.int64)
        self.classes = np.where(own, 1 + np.arange(len(head)), 1 + SINGLE + suffix).astype(np.int32)
        ends = counts.where("ending IS NULL").agg(F.sum("c")).first()[0] or 0
        occurrences, sizes = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in words.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
            occurrences[1 + SINGLE + r["ending"]], sizes[1 + SINGLE + r["ending"]] = r["c"], r["n"]
        k = int(own.sum())
        np.subtract.at(occurrences, 1 + SINGLE + suffix[:k], self.counts[:k])
        np.subtract.at(sizes, 1 + SINGLE + suffix[:k], 1)
        occurrences[1 : 1 + k] = self.counts[:k]
        occurrences[0] = ends
        self.ends = int(ends)
        self.occurrences = occurrences
        #: log10 of the sum of add-one counts of a class and of one unseen word; 0 for a class of one token.
        self.class_size = np.where(np.arange(CLASSES) > SINGLE, np.log10(occurrences + sizes + 1), 0.0)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index among the frequent words (-1: none), class, and the places of the other words."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        rare = np.flatnonzero(at < 0)
        out = self.classes[at] if len(self.classes) else np.zeros(len(words), np.int32)
        if len(rare):
            out[rare] = [1 + SINGLE + ending(words[i]) for i in rare.tolist()]
        return at, out, rare


class Model:
    """Vectors of outputs and of contexts, matrices of the two positions, and biases."""

    def __init__(self, occurrences: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(17))
        noise = (occurrences + 1) / (occurrences + 1).sum()
        self.out = rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32)
        self.context = rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32)
        self.places = np.stack([np.eye(DIM), 0.5 * np.eye(DIM)]).astype(np.float32)
        self.bias = np.log(noise).astype(np.float32)
        self.noise = noise

    def parts(self) -> list[np.ndarray]:
        return [self.out, self.context, self.places, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def learn(self, classes: np.ndarray, first: np.ndarray, second: np.ndarray, past: list[np.ndarray], rng: np.random.Generator) -> None:
        """A step of noise-contrastive estimation: the batch shares its noise samples; AdaGrad sets the rates."""
        n = len(classes)
        noise = rng.choice(CLASSES, NOISE, p=self.noise)
        e1, e2 = self.context[first], self.context[second]
        q = e1 @ self.places[0] + e2 @ self.places[1]
        target = self.out[classes]
        logk = np.log(NOISE * self.noise).astype(np.float32)
        good = sigmoid(logk[classes] - self.bias[classes] - np.einsum("ij,ij->i", q, target))
        bad = q @ self.out[noise].T
        bad += self.bias[noise] - logk[noise]
        bad = sigmoid(bad)
        np.negative(bad, out=bad)
        dq = good[:, None] * target + bad @ self.out[noise]
        d_out = scatter(classes, good[:, None] * q)
        np.add.at(d_out, noise, bad.T @ q)
        d_bias = np.bincount(classes, good, CLASSES)
        np.add.at(d_bias, noise, bad.sum(0))
        d_context = scatter(np.concatenate((first, second)), np.concatenate((dq @ self.places[0].T, dq @ self.places[1].T)))
        d_places = np.stack([e1.T @ dq, e2.T @ dq])
        for p, g, s in zip(self.parts(), (d_out, d_context, d_places, d_bias), past, strict=True):
            g = (g / n).astype(np.float32)
            s += g * g
            p += RATE * g / np.sqrt(s + 1e-10)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 scores by (previous class, class) and (class before that, class), and log10 normalisers by both contexts."""
        a = (self.context @ self.places[0] @ self.out.T).astype(np.float64)
        b = (self.context @ self.places[1] @ self.out.T + self.bias).astype(np.float64)
        top_a, top_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
        z = np.log(np.maximum(np.exp(a - top_a) @ np.exp(b - top_b).T, 1e-300)) + top_a + top_b.T
        return tuple((x / np.log(10)).astype(np.float32) for x in (a, b, z))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    np.negative(x, out=x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def scatter(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of `rows` by class: sorted, then added run by run."""
    out = np.zeros((CLASSES, rows.shape[1]), rows.dtype)
    if len(at):
        order = np.argsort(at.astype(np.uint16), kind="stable")
        own = at[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        out[own[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def contexts(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of texts in a row, with the end after each, and the two classes before each; before a text stands the end."""
    n = sum(len(c) + 1 for c in classes)
    out, first, second = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    at = 0
    for c in classes:
        k = len(c)
        out[at : at + k] = c
        first[at + 1 : at + 1 + k] = c
        second[at + 2 : at + 1 + k] = c[: max(0, k - 1)]
        at += k + 1
    return out, first, second


def train(texts: DataFrame, vocabulary: Vocabulary) -> Model:
    """The average, by tokens, of models that each task trained in one pass over its rows."""
    held = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        model = Model(held.value.occurrences)
        past = [np.full(p.shape, 1e-6, np.float32) for p in model.parts()]
        rng, seen = np.random.Generator(np.random.PCG64(TaskContext.get().partitionId())), 0
        waiting, size = [], 0

        def step():
            nonlocal seen
            columns = contexts(waiting)
            order = rng.permutation(len(columns[0]))
            for at in range(0, len(order), BATCH):
                model.learn(*[c[order[at : at + BATCH]] for c in columns], past, rng)
            seen += len(order)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                waiting.append(held.value.encode(tokens(text))[1])
                size += len(waiting[-1]) + 1
                if size >= 32 * BATCH:
                    step()
                    waiting, size = [], 0
        if waiting:
            step()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seen], pa.int64()), pa.array([(model.flat().astype(np.float64) * seen).tobytes()], pa.binary())], names=["part", "n", "sums"])

    def add(batches):
        total, n = None, 0
        for batch in batches:
            for k, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(data)
                total, n = x if total is None else total + x, n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "n", "sums"])

    schema = "part int, n long, sums binary"
    sums = texts.mapInArrow(run, schema).repartition(AVERAGERS, "part").mapInArrow(add, schema).collect()  # AVERAGERS rows at most
    model = Model(vocabulary.occurrences)
    if sums:
        model.load((sum(np.frombuffer(r["sums"]) for r in sums) / sum(r["n"] for r in sums)).astype(np.float32))
    return model


def score(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows for which `learn_from` is false or null teach nothing and are held out if false. A null text counts as
    empty: its only token is the end. Rows that repeat an id are scored one by one. Other columns
    are not read. If nothing teaches, N and V are 0 and the model is uniform over classes. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(learn_from, F.lit(True)).alias("learn"), F.col(text_col).cast("string").alias("text"))
    lessons = docs.where("learn").select("text")
    counts = checkpointed(count_words(lessons))
    vocabulary = Vocabulary(counts)
    tables = train(lessons, vocabulary).tables()
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, tables))
    names = ["row", "word", "tf", "id", "learn", "n", "known", "logs", "model"]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches):
        vocabulary, (a, b, z) = held.value
        log_counts = np.append(np.log10(vocabulary.counts + 1.0), 0.0)  # the last, by index -1, is that of other words
        end_log, row = float(np.log10(vocabulary.ends + 1.0)), TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, learn, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for at in range(0, len(texts), 500):
                coded, rows, tails = [], [], []
                for i in range(at, min(at + 500, len(texts))):
                    words = tokens(texts[i])
                    head, classes, rare = vocabulary.encode(words)
                    coded.append(classes)
                    logs = log_counts[head]
                    single = classes <= SINGLE
                    # Of a word's share of its class, its own count; counts of other words are added after the join.
                    own = float(logs[~single].sum() - vocabulary.class_size[classes].sum())
                    row += 1
                    rows.append([row, b"\xff" + row.to_bytes(8, "big"), 0, ids[i], learn[i], len(words) + 1, len(words) - len(rare) + (vocabulary.ends > 0), float(logs.sum()) + end_log, own])
                    tails += [(row, w, n) for w, n in Counter(words[j] for j in rare.tolist()).items()]
                target, first, second = contexts(coded)
                logs = a[first, target].astype(np.float64) + b[second, target] - z[first, second]
                ends = np.cumsum([len(c) + 1 for c in coded])
                for r, s in zip(rows, np.add.reduceat(logs, ends - [len(c) + 1 for c in coded]), strict=True):
                    r[-1] += float(s)
                cols = [list(c) for c in zip(*rows, strict=True)]
                if tails:
                    more = [list(c) for c in zip(*tails, strict=True)]
                    cols = [c + (more[k] if k < 3 else [None] * len(tails)) for k, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    parts = docs.mapInArrow(run, "row long, word binary, tf int, id long, learn boolean, n long, known long, logs double, model double")
    rare = parts.join(counts.where("ending IS NOT NULL").select("word", "c"), "word", "left")
    log = F.col("tf") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1)
    sums = rare.groupBy("row").agg(
        F.max("id").alias("id"), F.max("learn").alias("learn"), F.max("n").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        F.sum("logs").alias("logs"), F.sum("model").alias("model"), F.sum(log).alias("tail"),
    )
    n, v = vocabulary.total, vocabulary.distinct
    return sums.select(
        F.col("id").alias(id_col), (~F.col("learn")).alias("held_out"), "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("tail") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), (F.col("model") + F.col("tail")).alias("score"),
    )
