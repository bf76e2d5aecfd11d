"""Classifiers: held-out accuracy, and the field's marginals against enumeration; the pipeline from end to end."""

import itertools
import sys
from pathlib import Path

import numpy as np
import pytest

from gatehouse.llm import quality, toxicity
from gatehouse.llm.common import join_utf8
from gatehouse.llm.words import LETTERS, Words

from .fixtures import DOCS, labelled, odd_docs, with_clashes

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = labelled(600)
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (5_000_000, 0, 0), (3, None, None)], LABELS), {r[0]: r[1:] for r in labels}


@pytest.mark.parametrize(("score", "column"), [(quality.score_quality, 0), (toxicity.score_toxicity, 1)])
def test_held_out_accuracy(tables, score, column):
    docs, labels, truth = tables
    found = [r for r in score(docs, labels).collect() if r.held_out]
    assert len(found) > 80
    assert np.mean([r.predicted == truth[r.doc_id][column] for r in found]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_odd_documents_are_scored(spark, tables, score):
    docs = with_clashes(odd_docs(spark))
    found = score(docs, tables[1]).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    same = [r.score for r in found if r.doc_id in (5, 6)]
    assert same[0] == same[1]
    empty = tables[1].limit(0)
    assert len(score(docs, empty).collect()) == docs.count() and score(docs.limit(0), tables[1]).collect() == []
    assert score(docs.limit(0), empty).collect() == []


def test_spans_are_the_offending_words(tables):
    docs, labels, _ = tables
    texts = {r.doc_id: r.text for r in docs.collect()}
    hits = total = 0
    for r in toxicity.score_toxicity(docs, labels).collect():
        for span in filter(None, r.spans.split(",")):
            a, b = map(int, span.split(":"))
            total += 1
            hits += {w.strip("!").lower() for w in texts[r.doc_id][a:b].split()} <= {"blockhead", "nitwit"}
    assert total > 200 and hits / total > 0.97


def test_marginals_against_enumeration():
    rng = np.random.Generator(np.random.PCG64(2))
    sizes = [1, 4, 7, 3]
    emission, move = rng.normal(size=sum(sizes)), rng.normal(size=(2, 2))
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    likely, pairs = toxicity.marginals(emission, first, move)
    at, expected, total = 0, [], np.zeros((2, 2))
    for n in sizes:
        weight, ones = 0.0, np.zeros(n)
        both = np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(emission[at + i] * s for i, s in enumerate(states)) + sum(move[a, b] for a, b in itertools.pairwise(states)))
            weight += w
            ones += w * np.array(states)
            for a, b in itertools.pairwise(states):
                both[a, b] += w
        expected += (ones / weight).tolist()
        total += both / weight
        at += n
    assert np.allclose(likely, expected) and np.allclose(pairs, total)


def test_a_long_chain_does_not_depend_on_its_columns(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(3))
    emission, first, move = rng.normal(size=3000) * 3, rng.random(3000) < 0.01, rng.normal(size=(2, 2))
    first[0] = True
    usual = toxicity.marginals(emission, first, move)
    monkeypatch.setattr(toxicity, "STEPS", 37)
    other = toxicity.marginals(emission, first, move)
    assert np.allclose(usual[0], other[0]) and np.allclose(usual[1], other[1])


def test_words_keep_to_their_texts():
    words = Words(*join_utf8(["ab cd".encode(), b"", "cd é-x".encode(), b"cd"]), LETTERS)
    assert words.doc.tolist() == [0, 0, 2, 2, 2, 3] and words.count.tolist() == [2, 0, 3, 1]
    hashes = words.hashes.tolist()
    assert hashes[1] == hashes[2] == hashes[5] and len(set(hashes)) == 4


def test_pipeline(spark, tables, tmp_path):
    docs, labels, truth = tables
    odd = odd_docs(spark)
    docs.unionByName(odd.withColumn("doc_id", odd["doc_id"] + 10_000)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, counts = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        counts[name] = now.count()
        if name != "best_fit_packing":
            assert now.columns == columns
        if name == "quality_classifier":
            kept = {r.doc_id for r in now.collect() if r.doc_id is not None and r.doc_id < 600}
            good = {d for d, t in truth.items() if t[0]}
            assert len(kept & good) > 0.98 * len(good) and len(kept - good) < 0.05 * len(truth)
    # mixing takes some documents several times and some not at all
    assert counts["quality_classifier"] == counts["line_dedup"] > counts["simhash_near_dedup"]
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert ran.count() == counts["best_fit_packing"]
    places = sorted((r.sequence_id, r.offset, r.length) for r in ran.collect())
    ends = {}
    for sequence, offset, length in places:
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_odd_and_empty_tables(spark, tables, tmp_path, stage):
    tables[1].where("quality = 1").write.parquet(f"{tmp_path}/labels.parquet")  # nothing to reject
    docs = with_clashes(odd_docs(spark))
    assert stage[1](spark, docs, str(tmp_path)).count() > 0
    assert stage[1](spark, docs.limit(0), str(tmp_path)).count() == 0
