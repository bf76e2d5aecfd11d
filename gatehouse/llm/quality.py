"""Quality classifier: supervised subword embeddings.

Features of a text are its words, whether neighbouring words are the same, and its byte n-grams of two to four bytes, hashed
into buckets. A bucket has a learned vector; a document is the mean of its features' vectors, and a softmax
layer over it gives the classes. Both are fitted by plain stochastic gradient descent in numpy on a bounded sample of labelled documents. As mean and layer are linear, scoring needs one number per bucket, its vector times
the difference of the two output rows, so a whole text costs a table lookup per feature.

Defined cases: a null or empty text has no features and is scored by the layer's bias; a null doc_id is not held out and has a score;
repeated rows have equal scores; without labels of both classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import chunks, join_utf8, utf8_column
from .samples import held_out, labelled_rows
from .words import BYTE_VALUES, Words, mix

BUCKETS = 1 << 17
WIDTH = 12
GRAMS = (2, 3, 4)
#: Buckets of the bigrams.
SAME_PAIR, OTHER_PAIR = 0, 1
EPOCHS = 8
RATE = 0.5
#: Features that one step of the fit looks at.
FEWEST, MOST = 20, 500
#: How much faster a feature's vector moves than the mean it is part of.
STRETCH = 40
#: The bias is this share of the sample's log-odds: it decides for texts without features.
PRIOR = 0.5
#: Documents that the classifier is fitted on, at most: so many of label 0, and twice as many of label 1.
SAMPLE = 1000
PARTS, REMAINDER = 3, 1


def features(text: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every feature, in the order of kinds."""
    mask = np.uint64(buckets - 1)
    words = Words(text, offsets, lower=False)
    found, docs = [(words.hashes & mask).astype(np.int32)], [words.doc]
    # bigrams: what counts of two words in a row is whether they are the same
    pair = np.flatnonzero(words.doc[1:] == words.doc[:-1]) + 1
    same = words.hashes[pair] == words.hashes[pair - 1]
    found.append(np.where(same, SAME_PAIR, OTHER_PAIR).astype(np.int32))
    docs.append(words.doc[pair])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    values = BYTE_VALUES[text]
    for n in GRAMS:
        if len(text) < n:
            continue
        total = np.zeros(len(text) - n + 1, np.uint64)
        for i in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + values[i:len(text) - n + 1 + i]
        whole = owner[:len(total)] == owner[n - 1:]
        found.append((mix(total[whole]) & mask).astype(np.int32))
        docs.append(owner[:len(total)][whole])
    return np.concatenate(found), np.concatenate(docs)


@dataclass
class Classifier:
    """One number per bucket and the bias: the log-odds of a document are the mean over its features plus the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        odds = np.full(len(offsets) - 1, self.bias)
        for first, last in chunks(offsets):
            base = offsets[first]
            found, doc = features(text[base:offsets[last]], offsets[first:last + 1] - base, len(self.weights))
            size = last - first
            sums = np.bincount(doc, weights=self.weights[found], minlength=size)
            odds[first:last] += sums / np.maximum(np.bincount(doc, minlength=size), 1)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _feature_lists(texts: list[str]) -> list[np.ndarray]:
    """Features of each text, all in one array."""
    encoded = [text.encode() for text in texts]
    # a text has at most as many words and as many pairs as bytes, and as many n-grams of each size
    held = np.empty(sum((2 + len(GRAMS)) * len(x) for x in encoded), np.int32)
    found, end = [], 0
    for text in encoded:
        own = features(*join_utf8([text]))[0]
        held[end:end + len(own)] = own
        found.append(held[end:end + len(own)])
        end += len(own)
    return found


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> Classifier:
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Classifier(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.uniform(-1, 1, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH
    layer = np.zeros((2, WIDTH), np.float32)
    documents = _feature_lists(texts)
    steps = epochs * len(texts)
    order = np.concatenate([rng.permutation(len(texts)) for _ in range(epochs)])
    sizes = np.exp(rng.uniform(np.log(FEWEST), np.log(MOST), steps)).astype(int)
    for step, i in enumerate(order):
        found = documents[i]
        if not len(found):
            continue
        if len(found) > sizes[step]:  # a part of the text's features: short texts must be judged well, too
            found = found[rng.integers(0, len(found), sizes[step])]
        now = rate * (1 - step / steps)
        mean = vectors[found].mean(axis=0)
        odds = layer @ mean
        likely = np.exp(odds - odds.max())
        likely /= likely.sum()
        likely[labels[i]] -= 1
        back = likely @ layer
        layer -= now * np.outer(likely, mean)
        np.subtract.at(vectors, found, (now * STRETCH / len(found)) * back)
    share = float(labels.mean())
    return Classifier((vectors @ (layer[1] - layer[0])).astype(np.float32), float(np.log(share / (1 - share))) * PRIOR)


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """The sample, bounded whatever the input, is fitted in one task; the driver gets the weights, half a megabyte."""
    rows = labelled_rows(docs, labels, "quality", PARTS, REMAINDER, {0: sample, 1: 2 * sample})

    def fitted(texts: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values("doc_id")
        found = fit(texts["text"].tolist(), texts["label"].to_numpy())
        return pd.DataFrame({"weights": [found.weights.tobytes()], "bias": [found.bias]})

    found = rows.groupBy().applyInPandas(fitted, "weights binary, bias double").first()
    if found is None:
        return fit([], np.zeros(0, int))
    return Classifier(np.frombuffer(found.weights, np.float32), found.bias)


def with_quality(docs: DataFrame, classifier: Classifier, output: str = "score") -> DataFrame:
    """`docs` with the score of each whole text; a column of that name is replaced."""
    names = [f.name for f in docs.schema.fields if f.name != output]
    schema = StructType([docs.schema[n] for n in names] + [StructField(output, DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(classifier)  # half a megabyte, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.scores(*utf8_column(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found)], [*names, output])

    return docs.mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = with_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit_on(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id"), PARTS, REMAINDER).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of at least even odds, with their own columns."""
    columns = docs.columns
    output = "_quality_score"
    return with_quality(docs, fit_on(docs, labels), output).where(F.col(output) >= 0.5).select(*columns)
