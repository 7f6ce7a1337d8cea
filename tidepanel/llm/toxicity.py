"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a logistic score of its words; a document's probability is the noisy-or of
its sentences, one minus the product of their complements. Only document labels are known; their likelihood trains the word
weights, so that the sentences which explain a label get the blame. The fit uses a bounded sample of labelled documents;
scoring reads every sentence of every text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import plain_documents, slices, staged

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
TOKEN = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class MilOptions:
    """sample_rows and sample_chars bound the labelled documents the model is fitted on (whole documents, in an order drawn by
    hashing their ids; one that doesn't fit any more is passed over). A feature gets a weight if at least min_docs documents of the sample hold it and toxic ones among them
    exceed their share by least_deviation standard deviations; at most most_features do, those with the largest deviation."""

    sample_rows: int = 4000
    sample_chars: int = 12_000_000
    min_docs: int = 3
    least_deviation: float = 3.0
    most_features: int = 4000
    rounds: int = 300
    rate: float = 0.1
    l2: float = 0.05
    bias: float = -7.0
    threshold: float = 0.3
    seed: int = 6


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences: text up to . ! ? or a line break."""
    return [m.span() for m in SENTENCE.finditer(text) if not m.group().isspace()]


def features(word: str) -> list[str]:
    """A word as a whole, its openings of four to six letters and its runs of five."""
    out = ["=" + word]
    out += ["^" + word[:k] for k in (4, 5, 6) if len(word) > k]
    out += [word[i : i + 5] for i in range(len(word) - 4)]
    return out


class Bags:
    """Sentences of the sample as rows of distinct words; words are numbered."""

    def __init__(self, texts: list[str]):
        self.words: dict[str, int] = {}
        sizes, word_of, owner = array("i"), array("i"), array("i")
        for k, text in enumerate(texts):
            for a, b in sentences(text):
                found = {self.words.setdefault(w, len(self.words)) for w in TOKEN.findall(text[a:b].lower())}
                word_of.extend(found)
                sizes.append(len(found))
                owner.append(k)
        self.word_of, self.owner = (np.array(x, np.int32) for x in (word_of, owner))
        self.row_of = np.repeat(np.arange(len(sizes), dtype=np.int32), np.array(sizes, np.int32))
        self.n = len(texts)


def features_of(words: dict[str, int], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features of each word that `index` has, one word after another, and how many each word has."""
    flat, hits = array("i"), array("i")
    for w in words:
        own = [index[f] for f in features(w) if f in index]
        flat.extend(own)
        hits.append(len(own))
    return np.array(flat, np.int32), np.array(hits, np.int32)


def spread(flat: np.ndarray, hits: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of a sequence of words, and how many each of them has."""
    times = hits[words]
    first = np.cumsum(hits, dtype=np.int64) - hits
    done = np.cumsum(times, dtype=np.int64)
    return flat[np.repeat(first[words] - (done - times), times) + np.arange(int(times.sum()))], times


def choose_features(bags: Bags, y: np.ndarray, o: MilOptions, at_once: int = 200) -> list[str]:
    """Features that toxic documents hold more often than chance: by deviation, those with the largest first.

    Only features of toxic documents can be; documents are counted `at_once`, so that memory doesn't grow with their pairs.
    """
    doc_of = bags.owner[bags.row_of]
    held = np.zeros(len(bags.words), bool)
    held[bags.word_of[y[doc_of] > 0]] = True
    index: dict[str, int] = {}
    for w, k in bags.words.items():
        if held[k]:
            for f in features(w):
                index.setdefault(f, len(index))
    flat, hits = features_of(bags.words, index)
    holders, toxic = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
    edges = np.searchsorted(doc_of, np.arange(0, bags.n + at_once, at_once))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        found, times = spread(flat, hits, bags.word_of[a:b])
        pairs = np.unique(np.repeat(doc_of[a:b], times).astype(np.int64) * max(len(index), 1) + found)
        doc, feature = np.divmod(pairs, max(len(index), 1))
        holders += np.bincount(feature, minlength=len(index))
        toxic += np.bincount(feature[y[doc] > 0], minlength=len(index))
    share = y.mean()
    z = (toxic - holders * share) / np.sqrt(np.maximum(holders, 1) * share * (1 - share))
    good = (holders >= o.min_docs) & (z >= o.least_deviation)
    found = [(-x, f) for f, x, g in zip(index, z.tolist(), good.tolist()) if g]
    return [f for _, f in sorted(found)[: o.most_features]]


def train(texts: list[str], toxic: list[int], o: MilOptions) -> tuple[float, dict[str, float]]:
    """(bias, weight of each feature) by gradient ascent (Adam) on the likelihood of the document labels.

    Without labelled documents of both kinds the model has the bias alone.
    """
    n, positive = len(texts), sum(toxic)
    if not n or positive in (0, n):
        return (o.bias if not positive else -o.bias), {}
    bags, y = Bags(texts), np.array(toxic, float)
    names = choose_features(bags, y, o)
    index = {f: i for i, f in enumerate(names)}
    cols, times = spread(*features_of(bags.words, index), bags.word_of)
    rows = np.repeat(bags.row_of, times)
    sentences_n, owner = len(bags.owner), bags.owner
    weight, bias = np.zeros(len(names)), o.bias
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for t in range(1, o.rounds + 1):
        z = bias + np.bincount(rows, weight[cols], minlength=sentences_n)
        hazard = np.logaddexp(0.0, z)  # -log(1 - p) of each sentence
        total = np.maximum(np.bincount(owner, hazard, minlength=n), 1e-9)
        slope = y / np.expm1(np.minimum(total, 50.0)) - (1 - y)  # of the log likelihood, by total
        inner = slope[owner] / (1 + np.exp(-z))
        grad = (np.bincount(cols, inner[rows], minlength=len(names)) - o.l2 * weight) / n
        gb = inner.sum() / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        weight += o.rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias += o.rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return float(bias), {f: round(float(x), 4) for f, x in zip(names, weight) if abs(x) > 0.01}


class Scorer:
    """Sentence scores by a model; the sum of a word's weights is remembered for a bounded number of words."""

    def __init__(self, model: tuple[float, dict[str, float]], most_words: int = 250_000):
        self.bias, self.weights = model
        self.most_words, self.known = most_words, {}

    def sentence(self, text: str) -> float:
        """Logit of one sentence."""
        known, z = self.known, self.bias
        for w in set(TOKEN.findall(text)):
            x = known.get(w)
            if x is None:
                if len(known) > self.most_words:
                    known.clear()
                get = self.weights.get
                x = known[w] = sum([get(f, 0.0) for f in features(w.lower())])
            z += x
        return z

    def document(self, text: str) -> tuple[float, int, int, float]:
        """(noisy-or of the sentences, start and end of the worst one, its score); 0 without sentences."""
        spans = sentences(text)
        if not spans:
            return 0.0, 0, 0, 0.0
        z = np.array([self.sentence(text[a:b]) for a, b in spans])
        k = int(z.argmax())
        return float(-np.expm1(-np.logaddexp(0.0, z).sum())), *spans[k], float(1 / (1 + np.exp(-z[k])))


SCHEMA = "doc_id long, score double, worst_start int, worst_end int, worst_score double"


def _score(model: tuple[float, dict[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, "text"):
            found = [scorer.document(t) for t in batch.column("text").to_pylist()]
            score, start, end, worst = zip(*found)
            rest = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            new = [pa.array(score, pa.float64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(worst, pa.float64())]
            yield pa.RecordBatch.from_arrays([*rest, *new], names=[*names, "score", "worst_start", "worst_end", "worst_score"])

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, o: MilOptions) -> tuple[float, dict[str, float]]:
    """Fit on the labelled rows of docs: those that come first by a hash of doc_id, within the bounds of the options.

    The sample is bounded and so are its words, so the model is small whatever the corpus. Rows without label or doc_id and
    labels that contradict each other are left out.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    known = known.filter("toxic = most").select("doc_id", "toxic", F.xxhash64("doc_id", F.lit(o.seed)).alias("turn"))
    drawn = staged(spark, known.orderBy("turn", "doc_id").limit(o.sample_rows), "drawn")
    rows = plain_documents(docs).join(F.broadcast(drawn), "doc_id")  # at most sample_rows ids
    texts, toxic, used = [], [], 0
    small = staged(spark, rows.select("turn", "doc_id", "text", F.col("toxic").cast("int").alias("toxic"), F.length("text").alias("size")), "sample")
    for row in small.orderBy("turn", "doc_id", "text").toLocalIterator():
        if used + row["size"] > o.sample_chars:
            continue
        used += row["size"]
        texts.append(row["text"])
        toxic.append(row["toxic"])
    return train(texts, toxic, o)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def score_documents(docs: DataFrame, model: tuple[float, dict[str, float]], threshold: float) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and the span and score of the sentence that offends most.

    A missing or empty text scores 0. Repeated rows stay; rows without doc_id are scored as well (held_out false); extra
    columns are ignored. Every sentence counts, however long the text.
    """
    scored = plain_documents(docs).mapInArrow(_score(model), SCHEMA)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score"
    )


def reject_toxic(docs: DataFrame, model: tuple[float, dict[str, float]], threshold: float) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below the threshold. A missing text scores 0 and stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, "text"):
            keep = [scorer.document(t or "")[0] < threshold for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
