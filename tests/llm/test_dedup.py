"""Line dedup, SimHash and embedding near-dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gatehouse.llm import embedding_dedup, line_dedup, shingle_sets, simhash
from gatehouse.llm.graph import components
from gatehouse.llm.line_dedup import PerfectHash

from .fixtures import DOCS, odd_docs, odd_rows, sentence, with_clashes

SPACES = " \t\n\x0b\x0c\r"


def lines_by_hand(rows, least_chars, least_docs):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(SPACES).translate(table)
            if len(key) >= least_chars and doc_id is not None:
                holders.setdefault(key, set()).add(doc_id)
    keep = {k: max(v) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keep.get(x.strip(SPACES).translate(table), doc_id) == doc_id]
        out.append((-1 if doc_id is None else doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("most", [line_dedup.MOST_INDEX_BYTES, 0])
def test_lines_probe_and_join_agree_with_brute_force(spark, most):
    docs = with_clashes(odd_docs(spark))
    found = line_dedup.dedup_lines(docs, most_index_bytes=most)
    assert set(found.columns) == {*docs.columns, "n_lines", "n_dropped"}
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect())
    assert rows == lines_by_hand([r[:2] for r in odd_rows()], 40, 5)
    assert sum(r[3] for r in rows) == 7


def test_lines_of_empty_table(spark):
    assert line_dedup.line_digests(spark.createDataFrame([], DOCS)).collect() == []


def test_perfect_hash_is_minimal_and_survives_bytes():
    keys = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    made = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(made(keys).tolist()) == list(range(len(keys)))
    assert len(PerfectHash.build(keys[:0])(keys[:5])) == 5


def simhash_by_hand(text):
    data = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    runs = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, seed=42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reached(values, near):
    """The smallest index each index reaches over pairs that `near` accepts."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("crowded", [simhash.MOST_IN_BUCKET, 1])
def test_simhash_components(spark, crowded):
    rows = odd_rows()
    found = simhash.near_duplicates(with_clashes(odd_docs(spark)), crowded).collect()
    assert len(found) == len(rows)
    prints = {simhash_by_hand(r[1]): None for r in rows}
    order = list(prints)
    roots = least_reached(order, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for doc_id, text, *_ in rows:
        root = roots[order.index(simhash_by_hand(text))]
        if doc_id is not None:
            least[root] = min(least.get(root, doc_id), doc_id)
    expected = sorted((d if d is not None else -1, f"{simhash_by_hand(t):016x}", least.get(roots[order.index(simhash_by_hand(t))])) for d, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in found) == expected


@pytest.mark.parametrize("crowded", [simhash.MOST_IN_BUCKET, 3])
def test_links_are_all_pairs_within_two_bits(spark, crowded):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = set(seeds)
    for seed in seeds:
        for _ in range(12):
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                seed ^= 1 << bit
            prints.add(seed)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "p long")
    found = {(r.a, r.b) for r in simhash.links(frame, crowded).collect()}
    mask = (1 << 64) - 1
    assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2}


def test_one_document_of_each_group_stays(spark):
    docs = with_clashes(odd_docs(spark))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert ids == sorted(set(ids)) and 5 in ids and 6 not in ids and ids.count(8) == 1
    assert kept.where("doc_id is null").count() == 2
    assert simhash.drop_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def near_copies():
    """Texts with copies in which 1 to 12 of 240 words are others, single texts, and short ones."""
    rng = random.Random(8)
    rows = []
    for _ in range(12):
        base = sentence(rng, 240).split()
        rows.append(base)
        for edits in (1, 2, 4, 5, 6, 8, 12):
            copy = list(base)
            for at in rng.sample(range(240), edits):
                copy[at] = f"other{rng.randrange(1 << 30)}"
            rows.append(copy)
        rows += [base[:215], base[:180]]
    rows += [sentence(rng, 240).split() for _ in range(20)]
    rows += [["one", "two"], ["One", "Two"], ["one", "three"], []]
    return [" ".join(x) for x in rows]


def jaccard_by_hand(a, b):
    x, y = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies_of_five_word_shingles_go(spark):
    texts = near_copies()
    roots = least_reached(texts, lambda a, b: jaccard_by_hand(a, b) >= 0.8)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == set(roots)
    far = [(simhash.simhash(a) ^ simhash.simhash(b)).bit_count() for a in texts for b in texts if a and b and 0.8 <= jaccard_by_hand(a, b) < 1]
    assert min(far) > 0 and max(far) > 2


def template_pages():
    """Pages that share most of their words but are near copies of few of the others."""
    rng = random.Random(17)
    common = sentence(rng, 200)
    pages = [f"{common} {sentence(rng, 45)}" for _ in range(40)]
    return pages + [p + " and more" for p in pages[::4]] + pages[:3]


@pytest.mark.parametrize(("small", "block"), [(10_000, 4), (1, 4), (1, 10_000), (6, 2)])
def test_a_bucket_without_a_common_leader_is_compared_whole(spark, small, block):
    """Pairs of different components come from a join or from blocks, and all of them are looked at."""
    texts = near_copies() + template_pages()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    roots = least_reached(texts, lambda a, b: jaccard_by_hand(a, b) >= 0.8)
    assert len(set(roots)) > 60
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(shingle_sets, "SMALL", small)
        patch.setattr(shingle_sets, "BLOCK", block)
        assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == set(roots)


def test_large_buckets_give_a_forest_of_links(spark):
    """Pages that are far from their leader, and near to some others, give no more rows than joins of groups, however many pairs look near."""
    rng = random.Random(23)
    common = sentence(rng, 200)
    pages = [f"{common} {sentence(rng, 45)}" for _ in range(60)]
    texts = pages + [f"{p} and {i} more" for p in pages[:12] for i in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    roots = least_reached(texts, lambda a, b: jaccard_by_hand(a, b) >= 0.8)
    made, cogrouped = [], shingle_sets.cogrouped
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(shingle_sets, "SMALL", 1)
        patch.setattr(shingle_sets, "cogrouped", lambda *args: made.append(cogrouped(*args)) or made[-1])
        assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == set(roots)
    # a link is found in one bucket only, that of the first band both its pages share
    rows = [(r.a, r.b) for r in made[0].collect()]
    assert len(rows) <= 2 * len(texts) and len(rows) == len(set(rows))


def test_rows_without_id_are_in_groups_too(spark):
    base, other = near_copies()[0], near_copies()[-10]
    near = base.replace(base.split()[0], "changed", 1)
    rows = [(None, other), (None, other), (None, other.upper()), (None, base), (None, near), (4, near), (3, base), (None, ""), (9, " "), (None, None)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len([r for r in kept if r.doc_id is None and r.text and r.text.lower() == other]) == 1
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [3, 9] and len(kept) == 4


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, i) for i in range(1001, 1300)]
    odd = [(5000, 5000), (7, 6), (6, 7)]
    edges = spark.createDataFrame(path + star + odd, "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert all(roots[i] == 0 for i in range(61)) and all(roots[i] == 1000 for i in range(1000, 1300)) and 5000 not in roots
    assert components(edges.where("a < 0")).collect() == []


def vectors_with_groups(count, seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    rows = rng.normal(size=(count, 32))
    for i in range(0, count, 10):  # each tenth vector has near ones on both sides of the threshold
        for j in range(1, 4):
            rows[i + j] = rows[i] + rng.normal(size=32) * rng.uniform(0.05, 0.4)
    rows[-1], rows[-2] = rows[0], rows[0] * 3
    return rows.astype(np.float32)


def by_hand(rows):
    x = rows.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    return near


def test_embeddings_against_brute_force(spark):
    rows = vectors_with_groups(1500, 4)
    near = by_hand(rows)
    roots = least_reached(range(len(rows)), lambda i, j: near[i, j])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    links = sum(r.n_links for r in found.values())
    assert all(found[i].n_links <= near[i].sum() for i in found)  # none below the threshold
    assert links >= 0.98 * near.sum()
    assert np.mean([found[i].component_id == roots[i] for i in found]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_embeddings_in_small_blocks(spark, monkeypatch):
    rows = vectors_with_groups(300, 9)
    near = by_hand(rows)
    monkeypatch.setattr(embedding_dedup, "HOME_BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "MEMBER_BLOCK", 32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    # a margin of all cells finds every pair; one cell does so too
    for settings in ({"margin": 2.0, "cells": 7}, {"cells": 1}):
        found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(frame, **settings).collect()}
        assert found == {i: int(near[i].sum()) for i in range(len(rows))}


def test_vectors_of_each_length_have_their_links(spark, monkeypatch):
    """A common length, a rarer one with cells of its own, and one without centroids."""
    wide, narrow = vectors_with_groups(400, 5), vectors_with_groups(150, 6)[:, :9].copy()
    few = np.concatenate([narrow[:20, :5], narrow[:20, :5] * 2]).astype(np.float32)
    tables = [wide, narrow, few]
    rows = [(1000 * t + i, v.tolist()) for t, table in enumerate(tables) for i, v in enumerate(table)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(embedding_dedup, "FITTED_LENGTHS", 2)
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame, margin=2.0).collect()}
    for t, table in enumerate(tables):
        near = by_hand(table)
        roots = least_reached(range(len(table)), lambda i, j: near[i, j])  # noqa: B023
        assert near.sum() > 20
        for i in range(len(table)):
            assert (found[1000 * t + i].n_links, found[1000 * t + i].component_id) == (near[i].sum(), 1000 * t + roots[i])


def test_the_fit_has_a_ceiling(spark, monkeypatch):
    rows = vectors_with_groups(1500, 4)
    near = by_hand(rows)
    seen = []
    fit = embedding_dedup.spherical_kmeans
    monkeypatch.setattr(embedding_dedup, "FIT_BYTES", 200 * 32 * 8)
    monkeypatch.setattr(embedding_dedup, "FIT_STEP", 1000)
    monkeypatch.setattr(embedding_dedup, "spherical_kmeans", lambda sample, *a, **b: seen.append(len(sample)) or fit(sample, *a, **b))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(frame).collect()}
    assert 100 < seen[0] < 300  # 200 wanted, chosen by hash
    assert len(found) == len(rows) and sum(found.values()) >= 0.98 * near.sum() and all(found[i] <= near[i].sum() for i in found)


def test_steps_of_the_fit_change_nothing(monkeypatch):
    rows = vectors_with_groups(600, 2).astype(np.float64)
    whole = embedding_dedup.spherical_kmeans(rows, 20)
    monkeypatch.setattr(embedding_dedup, "FIT_STEP", 700)
    assert np.allclose(embedding_dedup.spherical_kmeans(rows, 20), whole)


def test_odd_vectors(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(1, one, 0), (2, one, 0), (2, one, 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0, 0.0], 0), (6, [float("nan"), 1.0, 0.0], 0),
            (7, [None, 1.0, 0.0], 0), (8, [1.0, 0.0], 0), (9, [float("inf"), 0.0, 0.0], 0), (None, one, 0), (10, [-0.0, 1.0, 0.0], None), (11, [0.0, 1.0, 0.0], None),
            (12, [0.0, 0.0, 5.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({n: F.lit(1) for n in ("node", "v", "cells", "home", "kept", "copies")})
    found = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame).collect())
    assert found == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *((i, 0, i, True) for i in range(3, 10)), (0, 0, None, False),
                            (10, 1, 10, True), (11, 1, 10, False), (12, 0, 12, True)])
    assert embedding_dedup.near_duplicates(frame.limit(0)).collect() == []
    assert len(embedding_dedup.near_duplicates(frame.where("vec_id = 3")).collect()) == 1


def test_a_round_of_stars_makes_its_edges_once(spark):
    from gatehouse.llm import graph

    edges = spark.createDataFrame([(5, 1), (5, 2), (7, 2), (9, 8), (10, 9), (12, 10)], "u long, v long")
    for step in (graph._large_star, graph._small_star):
        assert "Union" not in step(edges)._jdf.queryExecution().optimizedPlan().toString()
    found = graph.components(edges.selectExpr("v AS a", "u AS b").union(edges.selectExpr("u AS a", "u AS b")))
    assert {r.node: r.root for r in found.collect()} == {1: 1, 2: 1, 5: 1, 7: 1, 8: 8, 9: 8, 10: 8, 12: 8}
