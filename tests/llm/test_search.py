"""Top-k search, hard negatives and tokenizer alignment against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatehouse.llm import alignment, hard_negatives, top_k
from gatehouse.llm.vector_blocks import LARGEST

from .fixtures import DOCS, odd_rows, sentence

VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors(count=700, seed=8, clustered=False):
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = rng.normal(size=(6, 12)) * (3 if clustered else 0)
    rows = [(i, (centres[i % 6] + rng.normal(size=12)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(1, count)]
    common = rows[4][1]
    rows += [(i, common, i % 3) for i in range(count, count + count // 2)]  # a third of all rows
    rows += [(0, [0.0] * 12, 1), (1400, None, 1), (1401, [math.nan] * 12, 1), (1402, [math.inf] + [0.0] * 11, 2), (1500, [], 0), (1501, [0.5], 1),
             (1600, rows[3][1] + [1.0, 2.0], 2), (None, rows[5][1], 1), (None, [-x for x in rows[5][1]], None), (200, rows[9][1], 3),
             (200, rows[9][1], 3), (1700, [1e30] + [0.0] * 11, 0), (1750, [-0.001] * 12, None)]
    return [r if r[1] is None or r[0] != 1401 else (r[0], r[1][:3] + [None], r[2]) for r in rows]


def whole(vector):
    return [max(-LARGEST, min(LARGEST, math.floor(256 * x))) for x in vector]


def scored(rows):
    usable = [(i, whole(v), label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return usable, lambda a, b: sum(x * y for x, y in zip(a[1], b[1], strict=False))


def last(i):
    return (i is None, i or 0)


def top_by_hand(rows, every, k):
    usable, score = scored(rows)
    out = Counter()
    for n, q in enumerate(usable):
        if q[0] is not None and q[0] % every == 0:
            best = sorted((-score(q, c), last(c[0]), c[0]) for m, c in enumerate(usable) if m != n)[:k]
            out.update((q[0], rank, i, -s) for rank, (s, _, i) in enumerate(best, 1))
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 90, "block_rows": 7}, {"shard_rows": 3, "block_rows": 500}])
def test_top_k_equals_brute_force(spark, sizes):
    rows = odd_vectors(60 if sizes.get("shard_rows") == 3 else 700)
    frame = spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit(1) for n in ("row", "id", "v", "shard", "block", "score", "rank")})
    found = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in top_k.top_k_of_every(frame, **sizes).collect())
    assert found == top_by_hand(rows, 50, 5)


def test_top_k_of_small_tables(spark):
    assert top_k.top_k_of_every(spark.createDataFrame([], VECTORS)).collect() == []
    assert top_k.top_k_of_every(spark.createDataFrame([(50, [1.0], 1)], VECTORS)).collect() == []
    found = top_k.top_k_of_every(spark.createDataFrame([(50, [1.0], 1), (3, [-1.0], 1)], VECTORS)).collect()
    assert [tuple(r) for r in found] == [(50, 1, 3, -65536)]


def test_maxscore_leaves_rows_out():
    """With a score to beat, small terms are non-essential, and the result is that of all rows."""
    rng = np.random.Generator(np.random.PCG64(2))
    matrix = rng.integers(-9, 10, (400, 8)) * (rng.random((400, 8)) < 0.3) * np.array([50, 30, 9, 3, 1, 1, 1, 1])
    shard = top_k.Postings(matrix, np.arange(400), np.arange(400))
    for own in range(40):
        scores = matrix @ matrix[own]
        scores[own] = -10**9
        order = np.lexsort((np.arange(400), -scores))[:5]
        for least in (None, int(scores[order[4]]), int(scores[order[2]])):
            wanted = [i for i in order if least is None or scores[i] >= least]
            at, found = shard.top(matrix[own], 5, least, own)
            assert at.tolist() == wanted and found.tolist() == scores[wanted].tolist()


def mined_by_hand(rows):
    usable, score = scored([(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in rows if label is not None])
    out = Counter()
    for n, a in enumerate(usable):
        if a[0] is None or a[0] % 100:
            continue
        others = sorted(((-score(a, c), last(c[0]), c[0], c[2]) for m, c in enumerate(usable) if m != n), key=lambda x: x[:2])
        for ps, _, p, _ in [o for o in others if o[3] == a[2]][:5]:
            kept = [o for o in others if o[3] != a[2] and 30 * -ps <= 100 * -o[0] <= 90 * -ps][:10]
            out.update((a[0], p, rank, o[2], -ps, -o[0]) for rank, o in enumerate(kept, 1))
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 120, "block_rows": 3, "codes": 4, "sample": 50}])
def test_hard_negatives_equal_brute_force(spark, sizes):
    rows = odd_vectors(clustered=True)
    frame = spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit(1) for n in ("row", "id", "v", "shard", "block", "positives", "rank")})
    found = Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score)
                    for r in hard_negatives.negatives_of_every(frame, **sizes).collect())
    wanted = mined_by_hand(rows)
    assert found == wanted and len(wanted) > 50


def test_hard_negatives_of_small_tables(spark):
    for rows in ([], [(100, [1.0], 1)], [(100, [], 1), (3, [], 2), (4, [], 1)], [(100, [1.0], None), (101, [1.0], 1)]):
        found = hard_negatives.negatives_of_every(spark.createDataFrame(rows, VECTORS))
        assert Counter(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == mined_by_hand(rows)


def test_visit_stops_once_windows_are_certified():
    """Cells come in descending order of a bound that holds, and tight cells end the visit before all rows are scored."""
    rng = np.random.Generator(np.random.PCG64(4))
    centres = rng.integers(-300, 300, (40, 8))
    matrix = centres[rng.integers(0, 40, 4000)] + rng.integers(-3, 4, (4000, 8))
    books = hard_negatives.codebook(matrix[:, :4]), hard_negatives.codebook(matrix[:, 4:])
    index = hard_negatives.MultiIndex(matrix, books)
    ids = np.arange(4000)[index.order]
    query = matrix[7]
    bounds = list(index.visit(query))
    assert sorted(np.concatenate([at for _, at in bounds]).tolist()) == list(range(4000))
    assert all(a[0] >= b[0] for a, b in zip(bounds, bounds[1:], strict=False))
    assert all(index.scores(query, at).max(initial=-10**9) <= bound for bound, at in bounds)
    window = hard_negatives.Best(10, None, None)
    done = hard_negatives.search(index, query, np.ones(4000, bool), ids, [window])
    order = np.lexsort((np.arange(4000), -(matrix @ query)))[:10]
    assert window.ids.tolist() == order.tolist() and done < 2500


@pytest.fixture(scope="module")
def words():
    import public_tokenizers

    return alignment.Vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def tokens_by_hand(words, text):
    """(id, start, end) of both tokenizers, or none."""
    if not text:
        return [], []
    a = words.a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = words.b.encode(text)
    sides = []
    for ids, table in ((a, words.a_bytes), (b, words.b_bytes)):
        spans, at = [], 0
        for i in ids:
            spans.append((i, at, at + len(table[i])))
            at += len(table[i])
        sides.append(spans)
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return [], []
    return sides


def aligned_by_hand(words, texts):
    docs, counts = [], Counter()
    for text in texts:
        a, b = tokens_by_hand(words, text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        counts.update(links)
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        start, groups = 0, []
        for end in ends:
            sides = [",".join(str(x[0]) for x in side if start < x[2] <= end) for side in (a, b)]
            groups.append("|".join(sides))
            start = end
        docs.append((len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(a, b, g, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest) for a, b, g, links, digest in docs]


TEXTS = ["the plain words of a sentence", "aaaa aaa aa a aaaaaaaa", "<|endoftext|> and <s> stay text </s>", "▁ is not a space", "Zażółć gęślą jaźń — 漢字 😀\n\n\ttabs",
         " leading and  double  spaces ", "\x00 zero \x01 one", "2023-11-05T10:00:00Z 3.14159", "Ǆungla ﬁne é", "<0x41> A"]


@pytest.mark.parametrize("bounds", [{}, {"hot": 0}, {"hot": 40}])
def test_alignment_equals_brute_force(spark, words, bounds):
    rng = random.Random(3)
    short = [(r[0], r[1][:3000] if r[1] else r[1], None, None, None) for r in odd_rows()]
    rows = short + [(100 + i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(200 + i, sentence(rng, 40), None, None, None) for i in range(30)]
    rows += [(300, TEXTS[0], None, None, None)] * 20
    frame = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(1) for n in ("row", "pairs", "times", "best", "total", "n_a")})
    found = Counter(map(tuple, alignment.align_documents(frame, **bounds).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))
    wanted = Counter((r[0], *values) for r, values in zip(rows, aligned_by_hand(words, [r[1] for r in rows]), strict=True))
    assert found == wanted
    assert next(v for v in wanted if v[0] == 103)[1:] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_flushes_and_empty_table(spark, monkeypatch, words):
    assert alignment.align_documents(spark.createDataFrame([], DOCS)).collect() == []
    assert all(b == -1 or words.a_bytes[a] == words.b_bytes[b] for a, b in enumerate(words.same))
    assert (words.same >= 0).sum() > 10_000
    counts = alignment.Counts(words)
    found = alignment.Aligned(words, *map(list, zip(*[words.encode(t) for t in TEXTS if t != TEXTS[3]], strict=True)))
    counts.add(found)
    counts.add(found)
    exact = dict(zip(*(x.tolist() for x in counts.flush_exact()), strict=True))
    pairs = dict(zip(*(x.tolist() for x in counts.flush()), strict=True))
    assert sum(exact.values()) + sum(pairs.values()) == 2 * found.n_links.sum() and sum(exact.values()) > sum(pairs.values()) / 2
