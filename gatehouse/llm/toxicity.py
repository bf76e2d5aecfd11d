"""Toxicity: a linear-chain conditional random field over the words of a text.

Documents carry labels, words do not, so labelled tokens are made first: in a bounded sample of labelled documents a word or a
beginning of words is offending if nearly all documents that hold it are toxic and more of its contexts than chance allows
(binomial tail), and its occurrences in toxic documents are tokens of label 1. The field has two states; a token's emission is the sum of
learned weights of its word, its beginnings and its end, hashed; transitions are learned too. Forward-backward gives
marginals: over the labelled tokens for the gradient, and over a text for tagging. A logistic layer over the
largest marginal and the expected number of offending tokens, fitted on the sample's documents, is the score.

All texts of a batch are one chain whose transition into a text's first token forgets what was before, cut into columns that numpy
steps through together; column boundaries are exact, so a very long text is one chain too.

Defined cases: a text without words has no tokens: marginal 0, no spans; null text: empty; a null doc_id is not held out and
has a score; repeated rows have equal scores; without toxic labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import chunks, join_utf8, utf8_column
from .samples import held_out, labelled_sample
from .words import LETTERS, Words, mix

BUCKETS = 1 << 18
STEPS = 256
#: Toxic and other documents that the field is fitted on, at most.
SAMPLE_TOXIC, SAMPLE_OTHER = 800, 1600
#: Bytes of the beginnings of words that are units of their own, and of the ending.
BEGINNINGS = (4, 5, 6, 7)
ENDING = 3
#: A unit counts as offending from so many toxic documents on, if they are this share of all that hold it.
LEAST_DOCS = 4
MOSTLY = 0.8
CHANCE = 1e-5
ROUNDS = 10
#: Tokens that one numpy step of the fit looks at.
TOKENS = 200_000
PARTS, REMAINDER = 5, 0
#: A token of at least this marginal is part of a span.
TAGGED = 0.5


def units(words: Words) -> np.ndarray:
    """Hashes of what a word is made of, a row each: the whole word, its beginnings of several lengths, its end."""
    s, e = words.starts, words.ends
    parts = [words.hashes]
    for kind, size in enumerate(BEGINNINGS, 1):
        # a word that is no longer than that has no such beginning of its own
        long = e - s > size
        parts.append(np.where(long, words.hash_spans(s, np.minimum(s + size, e)) ^ np.uint64(kind << 40), parts[0]))
    parts.append(words.hash_spans(np.maximum(e - ENDING, s), e) ^ np.uint64(99 << 40))
    return np.stack(parts)


def buckets_of(unit: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    return (mix(unit) & np.uint64(buckets - 1)).astype(np.int32)


def contexts(words: Words) -> np.ndarray:
    """A hash of the words beside each word."""
    own, doc, edge = words.hashes, words.doc, np.uint64(1)
    before, after = np.full(len(own), edge), np.full(len(own), edge)
    same = doc[1:] == doc[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return mix(before ^ mix(after))


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of each token, and the expected transitions (2 x 2) over all tokens that are not the first of a text.

    `emission` is the score of state 1 against 0, `first` marks a text's first token, `transition` are scores.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    columns = -(-n // STEPS)
    pad = columns * STEPS - n
    # a padded token begins a text of its own: it changes nothing
    e = np.concatenate([emission, np.zeros(pad)]).clip(-30, 30)
    f = np.concatenate([first, np.ones(pad, bool)])
    psi = np.stack([np.ones_like(e), np.exp(e)], axis=-1).reshape(columns, STEPS, 2)
    start = f.reshape(columns, STEPS)
    move = np.exp(transition)
    forget = np.ones((2, 2))
    steps = np.where(start[..., None, None], forget, move) * psi[:, :, None, :]  # from, to

    def normal(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)

    product = np.broadcast_to(np.eye(2), (columns, 2, 2))
    for t in range(STEPS):
        product = normal(product @ steps[:, t])
    into = np.empty((columns, 2))
    now = np.array([0.5, 0.5])
    for c in range(columns):
        into[c] = now
        now = now @ product[c]
        now = now / now.sum()
    out_of = np.empty((columns, 2))
    now = np.ones(2)
    for c in range(columns - 1, -1, -1):
        out_of[c] = now
        now = product[c] @ now
        now = now / now.sum()
    forward, backward = np.empty((columns, STEPS, 2)), np.empty((columns, STEPS, 2))
    state = into
    for t in range(STEPS):
        state = normal(np.einsum("ci,cij->cj", state, steps[:, t]))
        forward[:, t] = state
    state = out_of
    for t in range(STEPS - 1, -1, -1):
        backward[:, t] = state
        state = normal(np.einsum("cij,cj->ci", steps[:, t], state))
    both = forward * backward
    likely = (both[..., 1] / both.sum(axis=-1)).reshape(-1)[:n]
    previous = np.concatenate([into[:, None], forward[:, :-1]], axis=1)
    pair = previous[..., :, None] * steps * backward[..., None, :]
    pair /= pair.sum(axis=(-2, -1), keepdims=True)
    return likely, pair[~start].sum(axis=0)


@dataclass
class Field:
    """Weights of features, scores of transitions, and the layer over a document's marginals."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    bias: float = -4.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    layer: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0.0, 0.0]))

    def tag(self, words: Words) -> np.ndarray:
        """Marginals of the words of a chunk of texts."""
        if not len(words.starts):
            return np.zeros(0)
        found = buckets_of(units(words), len(self.weights))
        emission = self.weights[found].sum(axis=0) + self.bias
        first = np.concatenate(([True], words.doc[1:] != words.doc[:-1]))
        return marginals(emission, first, self.transition)[0]

    @staticmethod
    def summary(likely: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
        """A constant, the largest marginal and the expected number of offending tokens of each text."""
        most = np.zeros(texts)
        np.maximum.at(most, doc, likely)
        return np.column_stack([np.ones(texts), most, np.log1p(np.bincount(doc, weights=likely, minlength=texts))])

    def scores(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary @ self.layer, -50, 50)))


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for X binomial(n, p)."""
    return sum(np.exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * np.log(p) + (n - x) * np.log1p(-p)) for x in range(k, n + 1))


def _counts(unit: np.ndarray, other: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct unit: it, the number of different `other` it occurs with, and how many of those are toxic."""
    order = np.lexsort((other, unit))
    unit, other, toxic = unit[order], other[order], toxic[order]
    fresh = np.concatenate(([True], (unit[1:] != unit[:-1]) | (other[1:] != other[:-1])))
    unit, toxic = unit[fresh], toxic[fresh]
    starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    return unit[starts], np.diff(np.concatenate((starts, [len(unit)]))), np.add.reduceat(toxic.astype(np.int64), starts)


def offending_tokens(made: np.ndarray, context: np.ndarray, doc: np.ndarray, labels: np.ndarray, chance: float = CHANCE) -> np.ndarray:
    """Which tokens have a unit (the word or a beginning of it) that belongs to toxic texts.

    Nearly all documents that hold the unit are toxic, and so are more of its contexts than chance allows. Copies of a
    document share their contexts, so they do not make their words offending. `made` are the units, a row each, the last being the end.
    """
    toxic = labels[doc] == 1
    hit = np.zeros(len(doc), bool)
    for unit in made[:-1]:
        kinds, docs, bad_docs = _counts(unit, doc.astype(np.uint64), toxic)
        _, places, bad_places = _counts(unit, context, toxic)
        share = max(float(bad_places.sum() / places.sum()), 1e-6)
        maybe = np.flatnonzero((bad_docs >= LEAST_DOCS) & (bad_docs >= MOSTLY * docs) & (bad_places >= LEAST_DOCS) & (bad_places >= MOSTLY * places))
        found = [i for i in maybe.tolist() if _tail(int(bad_places[i]), int(places[i]), share) < chance]
        hit |= np.isin(unit, kinds[found])
    return hit & toxic


def fit(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Maximum likelihood of the labelled tokens by adaptive gradient steps, then the layer over documents."""
    labels, made = np.asarray(labels), Field()
    if not len(labels) or not labels.any():
        return made
    text, offsets = join_utf8([t.encode() for t in texts])
    parts, around, docs = [], [], []
    for begin, end in chunks(offsets):
        words = Words(text[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin], LETTERS)
        parts.append(units(words))
        around.append(contexts(words))
        docs.append(words.doc + begin)
    doc = np.concatenate(docs)
    if not len(doc):
        return made
    hashed = np.concatenate(parts, axis=1)
    truth = offending_tokens(hashed, np.concatenate(around), doc, labels)
    found = np.stack([buckets_of(row) for row in hashed])
    del hashed, parts, around
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    inner = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[inner - 1].astype(int), truth[inner].astype(int)), 1)
    share = max(float(truth.mean()), 1e-6)
    made.bias = float(np.log(share / (1 - share)))
    weights, squares, pull = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), 1e-3
    moved = np.full((2, 2), 1e-8)
    begins = np.append(np.flatnonzero(first), len(doc))
    slices = [(begins[a], begins[b]) for a, b in chunks(begins, TOKENS)]
    for _ in range(rounds):
        slope, expected = -pull * weights, np.zeros((2, 2))
        for a, b in slices:
            likely, pairs = marginals(weights[found[:, a:b]].sum(axis=0) + made.bias, first[a:b], made.transition)
            expected += pairs
            for row in found[:, a:b]:
                slope += np.bincount(row, weights=truth[a:b] - likely, minlength=BUCKETS)
        squares += slope**2
        weights += 1.5 * slope / np.sqrt(squares)
        change = seen - expected - pull * made.transition
        moved += change**2
        made.transition = made.transition + 0.3 * change / np.sqrt(moved)
    made.weights = weights.astype(np.float32)
    likely = np.concatenate([marginals(made.weights[found[:, a:b]].sum(axis=0) + made.bias, first[a:b], made.transition)[0] for a, b in slices])
    made.layer = _logistic(Field.summary(likely, doc, len(texts)), labels)
    return made


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Newton steps with a small ridge; every document weighs the same."""
    weight = np.full(len(y), 1 / len(y))
    theta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-3 * theta
        theta = theta + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(theta)), slope)
    return theta


def fit_on(docs: DataFrame, labels: DataFrame) -> Field:
    rows = labelled_sample(docs, labels, "toxic", PARTS, REMAINDER, {0: SAMPLE_OTHER, 1: SAMPLE_TOXIC})
    return fit(rows["text"].tolist(), rows["label"].to_numpy())


def _spans(words: Words, likely: np.ndarray, offsets: np.ndarray) -> dict[int, list[str]]:
    """start:end of tagged runs, in code points of each text; neighbours in one text make one span."""
    out: dict[int, list[str]] = {}
    hits = np.flatnonzero(likely >= TAGGED)
    if not len(hits):
        return out
    points = np.concatenate(([0], np.cumsum((words.text & 0xC0) != 0x80)))  # code points before each byte
    last = -2
    for i in hits.tolist():
        doc = int(words.doc[i])
        base = points[offsets[doc]]
        start, end = int(points[words.starts[i]] - base), int(points[words.ends[i]] - base)
        spans = out.setdefault(doc, [])
        if i == last + 1 and spans and words.doc[last] == doc:
            spans[-1] = f"{spans[-1].split(':')[0]}:{end}"
        else:
            spans.append(f"{start}:{end}")
        last = i
    return out


def with_toxicity(docs: DataFrame, fitted: Field) -> DataFrame:
    """`docs` with `score` and `spans` (start:end pairs in code points, comma-joined); columns of those names are replaced."""
    names = [f.name for f in docs.schema.fields if f.name not in ("score", "spans")]
    schema = StructType([docs.schema[n] for n in names] + [StructField("score", DoubleType()), StructField("spans", StringType())])
    sent = docs.sparkSession.sparkContext.broadcast(fitted)  # a megabyte, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, offsets = utf8_column(batch.column("text"))
            scores, spans = np.empty(batch.num_rows), [""] * batch.num_rows
            for first, last in chunks(offsets):
                base = offsets[first]
                places = offsets[first:last + 1] - base
                words = Words(text[base:offsets[last]], places, LETTERS)
                likely = sent.value.tag(words)
                scores[first:last] = sent.value.scores(Field.summary(likely, words.doc, last - first))
                for row, found in _spans(words, likely, places).items():
                    spans[first + row] = ",".join(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores), pa.array(spans, pa.string())],
                                             [*names, "score", "spans"])

    return docs.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans of every document."""
    scored = with_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit_on(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), PARTS, REMAINDER).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
