"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only documents are labelled. A sentence's probability is a logistic function of
the words in it and of their heads (first four to seven letters), so that inflected and compound forms share what is learned; a document's
is the noisy-or of its sentences, 1 - prod(1 - p). The weights are fitted to the document labels through that formula, after
which the sentence probabilities locate what offends.

The model is fitted on a bounded sample: of each class the ``SAMPLE`` labelled documents with the smallest
hash of their id, without texts over ``SAMPLE_BYTES``. Features are counted on the cluster, and those that toxic documents have far
more often than clean ones enter the model; function words do not. Penalty and label noise are chosen by an inner split of the sample.
Class weights restore the classes' true shares. Everything else covers all documents and whole texts, row by row without a shuffle.
Labels, language, source and id are no inputs of a score.

Defined cases: a null or empty text has no sentence and scores 0. A document with contradicting labels counts as
toxic; null labels and labels without a document are left out. Without labelled documents of both classes every document scores
the share of toxic ones, if it has a sentence. Rows without an id are never learned from and count as held out.
Repeated rows give a row each. Columns of the input that bear an output's name are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, schema_with, slices, strings, written

#: Documents of a class that the model is fitted on, and the largest text among them.
SAMPLE = 4000
SAMPLE_BYTES = 1 << 18
#: A feature of the model stands in so many toxic documents of the sample, and in so many times the share of clean ones; at most so many enter.
LEAST_DOCUMENTS = 5
LEAST_RATIO = 3.0
FEATURES = 20_000
#: Letters of a word's heads.
HEADS = (4, 5, 6, 7)
STEPS = 300
RATE = 0.1
#: Choices of the inner split: (share of clean documents that are labelled toxic, penalty).
CHOICES = ((0.05, 3e-4), (0.05, 3e-5), (0.005, 3e-4), (0.005, 3e-5))
#: Every so manyth document of the sample judges the choices.
INNER = 4
#: Weights below this are left out of the model.
LEAST_WEIGHT = 0.02
#: Words whose weights a task remembers.
KNOWN_WORDS = 500_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def words_of(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


def features_of(word: str) -> list[str]:
    """The word and its heads, marked by a star."""
    return [word, *[f"{word[:k]}*" for k in HEADS if len(word) > k]]


@dataclass
class Model:
    """Weights of words and heads, and the bias of a sentence."""

    bias: float
    weights: dict[str, float]
    known: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def word(self, word: str) -> float:
        """What a word adds to its sentence, heads included."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            found = self.known[word] = sum(self.weights.get(f, 0.0) for f in features_of(word))
        return found

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, log-odds) of the sentences with a word, in code points."""
        out = []
        for m in _SENTENCE.finditer(text):
            if words := words_of(m[0]):
                out.append((m.start(), m.end(), self.bias + math.fsum(self.word(w) for w in words)))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability and its sentences of probability 1/2 or more."""
        if not any(self.word(w) for w in words_of(text)):
            n = sum(1 for s in _SENTENCE.findall(text) if _WORD.search(s))
            return -math.expm1(-n * softplus(self.bias)), []
        found = self.sentences(text)
        total = sum(softplus(z) for _, _, z in found)
        return -math.expm1(-total), [(a, b, 1 / (1 + math.exp(-z))) for a, b, z in found if z >= 0]


def softplus(z: float) -> float:
    return z if z > 30 else math.log1p(math.exp(z))


def document_features(text: str) -> set[str]:
    return {f for w in words_of(text) for f in features_of(w)}


def telling(n_toxic: int, n_clean: int, sizes: tuple[int, int]) -> bool:
    """Whether a feature in so many toxic and clean documents enters the model."""
    return n_toxic >= LEAST_DOCUMENTS and (n_toxic + 0.5) / (sizes[1] + 1) >= LEAST_RATIO * (n_clean + 0.5) / (sizes[0] + 1)


def bag_of(text: str, places: dict[str, int]) -> tuple[list[int], list[int]]:
    """(known features of each sentence one after the other, their number by sentence)."""
    ids: list[int] = []
    sizes = []
    for sentence in _SENTENCE.findall(text):
        if words := words_of(sentence):
            known = [places[f] for w in sorted(words) for f in features_of(w) if f in places]
            ids += known
            sizes.append(len(known))
    return ids, sizes


def fit(texts: list[str], toxic: list[int], weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """The model of labelled documents at hand; ``weights`` are those of the two classes."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in zip(texts, toxic):
        counts[y].update(document_features(text))
    sizes = (len(toxic) - sum(toxic), sum(toxic))
    names = sorted((f for f, n in counts[1].items() if telling(n, counts[0][f], sizes)), key=lambda f: (-counts[1][f], f))[:FEATURES]
    places = {f: i for i, f in enumerate(names)}
    return fit_bags([(y, *bag_of(text, places)) for text, y in zip(texts, toxic)], names, weights)


def fit_bags(rows: Iterable[tuple[int, list[int], list[int]]], names: list[str], weights: tuple[float, float]) -> Model:
    """The model of bags ``(label, features, features by sentence)``."""
    rows = [(y, np.asarray(ids, np.int32), np.asarray(sizes, np.int64)) for y, ids, sizes in rows]
    share = sum(weights[y] for y, _, _ in rows)
    rate = sum(weights[1] for y, _, _ in rows if y) / share if share else 0.0
    if not 0 < rate < 1:
        return Model(math.inf if rate else -math.inf, {})
    rows = [r for r in rows if len(r[2])]
    inner = [r for i, r in enumerate(rows) if i % INNER], [r for i, r in enumerate(rows) if i % INNER == 0]
    best = CHOICES[0]
    if all({0, 1} <= {y for y, _, _ in part} for part in inner):
        best = min(CHOICES, key=lambda c: _loss(_descend(inner[0], len(names), weights, *c), inner[1], weights))
    w = _descend(rows, len(names), weights, *best)
    return Model(float(w[-1]), {f: float(x) for f, x in zip(names, w) if abs(x) >= LEAST_WEIGHT})


def _flat(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, their sentences, sentences' documents, labels)."""
    ids = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int32)
    sizes = np.concatenate([r[2] for r in rows])
    return ids, np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows]), np.array([r[0] for r in rows])


def _totals(w: np.ndarray, ids, sentence, document, n_documents: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds of the sentences, minus log of each document's chance to be clean)."""
    z = w[-1] + np.bincount(sentence, w[ids], len(document))
    return z, np.bincount(document, np.logaddexp(0, z), n_documents)


def _loss(w: np.ndarray, rows, weights) -> float:
    """Mean squared error of the documents' probabilities, which wrong labels do not dominate."""
    ids, sentence, document, y = _flat(rows)
    _, total = _totals(w, ids, sentence, document, len(y))
    class_weight = np.where(y == 1, weights[1], weights[0])
    return float((class_weight * (y + np.expm1(-total)) ** 2).sum() / class_weight.sum())


def _descend(rows, n_features: int, weights, noise: float, sparsity: float, steps: int = STEPS) -> np.ndarray:
    """Adam on the negative log-likelihood of the noisy-or, from a bias at which most documents are clean; the bias is last."""
    ids, sentence, document, y = _flat(rows)
    class_weight = np.where(y == 1, weights[1], weights[0])
    class_weight = class_weight / class_weight.sum()
    w = np.zeros(n_features + 1)
    w[-1] = math.log(max(1e-6, (class_weight * y).sum() / max(1.0, len(document) / len(y))))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z, total = _totals(w, ids, sentence, document, len(y))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        # d loss / d total: 1 for clean documents; toxic ones are toxic by their sentences or by a wrong label.
        clean = np.exp(-total)
        slope = class_weight * np.where(y == 1, -(1 - noise) * clean / (noise + (1 - noise) * (1 - clean)), 1.0)
        g_sentence = slope[document] * p
        grad = np.append(np.bincount(ids, g_sentence[sentence], n_features), g_sentence.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        rate = RATE / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= rate * (first / (1 - 0.9**step))
        # Weights that the penalty outweighs stay zero: rare words that met a wrong label by chance.
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate[:-1] * sparsity, 0)
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model fitted on the bounded sample; rows that ``held_out`` names are not in it."""
    known = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
        .where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most twice ``sample`` rows of two numbers
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(
        F.octet_length("text") <= SAMPLE_BYTES
    )
    # Repeated ids: one text each, so the sample stays bounded.
    rows = texts.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = written(rows.sort("doc_id"), "toxicity-sample")
    picked = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = tuple(totals.get(k, 0) / max(1, picked.get(k, 0)) for k in (0, 1))
    names = _telling_features(rows, (picked.get(0, 0), picked.get(1, 0)))
    # Numbers of features by sentence: what the driver gets is bounded by the sample.
    bags = _bags(rows, {f: i for i, f in enumerate(names)})
    return fit_bags(((r.y, r.ids, r.sizes) for r in bags.toLocalIterator()), names, weights)


def _telling_features(rows: DataFrame, sizes: tuple[int, int]) -> list[str]:
    def counted(batches):
        for batch in slices(batches, 64):
            counts: Counter = Counter()
            for y, text in zip(batch.column("y").to_pylist(), strings(batch.column("text"))):
                counts.update((f, y) for f in document_features(text))
            if counts:
                keys = list(counts)
                yield pa.RecordBatch.from_pydict({
                    "f": pa.array([f for f, _ in keys], pa.string()), "n0": pa.array([0 if y else counts[f, y] for f, y in keys], pa.int64()),
                    "n1": pa.array([counts[f, y] if y else 0 for f, y in keys], pa.int64())})

    n0, n1 = F.col("n0"), F.col("n1")
    found = rows.mapInArrow(counted, "f string, n0 bigint, n1 bigint").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = found.where((n1 >= LEAST_DOCUMENTS) & ((n1 + 0.5) / (sizes[1] + 1) >= LEAST_RATIO * (n0 + 0.5) / (sizes[0] + 1)))
    return [r.f for r in found.orderBy(F.desc("n1"), "f").limit(FEATURES).collect()]


def _bags(rows: DataFrame, places: dict[str, int]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(places)

    def packed(batches):
        for batch in slices(batches):
            made = [bag_of(t, shared.value) for t in strings(batch.column("text"))]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array([m[0] for m in made], kind), pa.array([m[1] for m in made], kind)], names=["doc_id", "y", "ids", "sizes"])

    kinds = dict(rows.dtypes)
    return written(rows.mapInArrow(packed, f"doc_id {kinds['doc_id']}, y int, ids array<int>, sizes array<int>"), "toxicity-bags").sort("doc_id")


OFFENDING = "array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``offending`` (sentences in code points, with their probability)."""
    types = {"score": "double", "offending": OFFENDING}
    drop = () if keep_text else (text,)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scored(batches):
        for batch in slices(batches):
            made = [shared.value.score(t) for t in strings(batch.column(text))]
            found = [[{"start": a, "end": b, "score": p} for a, b, p in x] for _, x in made]
            yield extended(batch, drop, score=pa.array([s for s, _ in made], pa.float64()), offending=pa.array(found, kinds))

    return docs.mapInArrow(scored, schema_with(docs, drop, **types))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, offending."""
    keyed = docs.select("doc_id", "text")
    out = score(keyed, train(keyed, labels), keep_text=False)
    return out.select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "offending"
    )
