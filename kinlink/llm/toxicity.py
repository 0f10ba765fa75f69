"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence with words of the vocabulary has the probability
sigmoid(bias + sum of its distinct words' weights, also of their heads of some letters), any other sentence has none; the document's score is the
noisy-or 1 - (1 - leak) * product of (1 - sentence). Weights and leak are trained from document labels
alone, by gradient steps on the noisy-or's penalised likelihood, and the trained sentence scores locate what offends.

The vocabulary is the words that go with the label, by a test on counts over the training sample; it holds at most
`most_words`, so the model is small and is sent to every task. The fit takes at most `sample` labelled documents,
those with the smallest id hashes, exact copies once, and gathers no text: words are counted and sentences turned
to word numbers on the executors. Scoring covers every sentence of every text in one pass without a shuffle.

Defined results: a null or empty text has no sentence and scores the leak. Null labels are left out, and an id's
largest label counts. With no labels of one kind the score is their share everywhere. A null doc_id is held out.
Repeated rows get equal scores. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import materialise, named, ship, table

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 8)
SCORES = "key long, score double, n_offending int, worst_start int, worst_end int, worst_score double, offending string"


def word_features(word: str) -> list[str]:
    """What a word is known by: itself, and its heads of 3 to 7 letters, which also know a stem in inflected or joined words."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if k < len(word))]


class Known(dict):
    """The vocabulary's features of words, kept for the words met last."""

    def __init__(self, vocabulary: dict):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= 1 << 18:
            self.clear()
        out = self[word] = tuple(f for f in word_features(word) if f in self.vocabulary)
        return out


@dataclass
class Model:
    """weights: of the vocabulary's features."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    leak: float = 0.0

    def sentence(self, features: set[str]) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.bias + math.fsum(self.weights[f] for f in features))))) if features else 0.0

    def score(self, text: str | None, known: Known) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, end, score) in code points of its sentences that have any."""
        low = (text or "").lower()
        if not any(map(known.__getitem__, WORD.findall(low))):
            return self.leak, []
        rest, found = 1 - self.leak, []
        same = len(low) == len(text)
        for m in SENTENCE.finditer(text):
            s = m[0].lower() if not same else low[m.start() : m.end()]
            p = self.sentence({f for w in WORD.findall(s) for f in known[w]})
            if p:
                rest *= 1 - p
                found.append((m.start(), m.end(), p))
        return 1 - rest, found


class Bags:
    """Labelled bags of sentences, (label, sentences as word numbers), laid out for the noisy-or."""

    def __init__(self, bags: list[tuple[bool, list[list[int]]]], n_words: int):
        sentences = [s for b in bags for s in b[1]]
        self.y, self.n_words, self.n_sentences = np.array([b[0] for b in bags], float), n_words, len(sentences)
        self.bag = np.array([i for i, b in enumerate(bags) for _ in b[1]], np.int64)
        self.of = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
        self.words = np.array([w for s in sentences for w in s], np.int64)

    def slopes(self, x: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
        """The log-likelihood of the labels and its gradient, at the weights x[:-1] and the leak sigmoid(x[-1])."""
        z = bias + np.bincount(self.of, x[self.words], self.n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        leak = 1 / (1 + np.exp(-x[-1]))
        rest = np.log1p(-leak) + np.bincount(self.bag, np.log1p(-np.minimum(p, 1 - 1e-12)), len(self.y))
        whole = np.maximum(-np.expm1(rest), 1e-9)
        pull = np.where(self.y > 0, np.exp(rest) / whole, -1.0)  # of the log-likelihood by -rest
        return float(np.where(self.y > 0, np.log(whole), rest).sum()), np.append(np.bincount(self.words, (pull[self.bag] * p)[self.of], self.n_words), (pull * leak).sum())


def train(bags: list[tuple[bool, list[list[int]]]], n_words: int, *, bias: float = -4.0, penalty: float = 0.2, epochs: int = 800, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights, none negative, and leak by Adam on the noisy-or's log-likelihood less penalty times their sum. bags: (label, sentences as word numbers).

    The bias is fixed and low and weights cost, so a word is weighed only for documents that no other word explains:
    one that merely stands beside offending sentences gets nothing."""
    laid, x = Bags(bags, n_words), np.zeros(n_words + 1)
    x[-1] = -3.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, epochs + 1):
        g = laid.slopes(x, bias)[1]
        g[:-1] -= penalty
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        pace = rate * min(1.0, 4 * (1 - step / (epochs + 1)))
        x = x + pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        x[:-1] = np.maximum(x[:-1], 0)
    return x[:-1], float(1 / (1 + np.exp(-x[-1])))


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a document is kept from training: by crc32 of its id as text."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(True))


def _lister(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [sorted({f for w in set(WORD.findall((t.as_py() or "").lower())) for f in word_features(w)}) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], ["y", "words"])


def _bagger(number: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(number)
        for b in batches:
            bags = []
            for t in b.column(2):
                lists = [sorted({number[f] for w in WORD.findall(s.lower()) for f in known[w]}) for s in SENTENCE.findall(t.as_py() or "")]
                bags.append([s for s in lists if s])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bags, pa.list_(pa.list_(pa.int32())))], ["key", "y", "bag"])

    return run


def fit(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 20_000,
    most_words: int = 1000, least_docs: int = 3, least_z: float = 4.0, bias: float = -4.0,
) -> Model:
    """Trains on the labelled documents that are not held out."""
    ship(docs.sparkSession)
    marked = labels.select(F.col(named(key)).cast("long").alias("key"), F.col(named(label)).cast("int").alias("y")).where("key is not null and y is not null")
    chosen = marked.where(~held_out(F.col("key"))).groupBy("key").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("key"), "key").limit(sample)  # the documented bound; so it is small enough to broadcast
    own = docs.select(F.col(named(key)).cast("long").alias("key"), F.col(named(text)).cast("string").alias("text"))
    own = own.join(F.broadcast(chosen), "key").groupBy(F.xxhash64("text").alias("hash")).agg(F.min("key").alias("key"), F.max("y").alias("y"), F.first("text").alias("text"))
    bounded = materialise(own.select("key", "y", "text"), "toxic-sample")
    n, positive = bounded.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = positive / n if n else 0.0
    if not 0 < share < 1:
        return Model(leak=min(max(share, 0.0), 1.0))
    counted = bounded.select("y", "text").mapInArrow(_lister, "y int, words array<string>").select("y", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    z = (F.col("k") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    words = [r.w for r in counted.where(F.col("n") >= least_docs).withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "w").limit(most_words).collect()]
    if not words:
        return Model(leak=share)
    rows = bounded.mapInArrow(_bagger({w: i for i, w in enumerate(words)}), "key long, y int, bag array<array<int>>").orderBy("key").toArrow().to_pylist()
    weights, leak = train([(bool(r["y"]), r["bag"]) for r in rows], len(words), bias=bias)
    return Model({w: float(x) for w, x in zip(words, weights) if x >= 0.05}, bias, leak)


def _scorer(model: Model, offends: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model.weights)
        types = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
        for b in batches:
            rows = []
            for t in b.column(1):
                score, found = model.score(t.as_py(), known)
                worst = max(found, key=lambda s: (s[2], -s[0]), default=(None, None, None))
                bad = [s for s in found if s[2] >= offends]
                rows.append((score, len(bad), *worst, ",".join(f"{s[0]}:{s[1]}" for s in bad)))
            columns = [b.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 6, types[1:]))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])

    return run


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", offends: float = 0.5) -> DataFrame:
    """SCORES of every document: its score, the worst sentence, and the spans of those that offend (start:end in code points)."""
    ship(docs.sparkSession)
    own = docs.select(F.col(named(key)).cast("long").alias("key"), F.col(named(text)).cast("string").alias("text"))
    return own.mapInArrow(_scorer(model, offends), SCORES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by a model of the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_offending", "worst_start", "worst_end", "worst_score", "offending",
    )
