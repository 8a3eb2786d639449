"""Near-duplicate joins of texts and of vectors, and connected components."""

import random
from collections import Counter
from itertools import combinations

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecmeadow.llm import components, jaccard_join, pq_dedup, queries, shingles


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 480)] + [(900, i) for i in range(500, 600)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.components({n for e in links for n in e}, links)
    alone = Counter(want.values())
    assert found == {n: c for n, c in want.items() if alone[c] > 1}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited_copies(rng, base, copies, most):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, most)):
            at = rng.randrange(len(words))
            rng.choice([lambda: words.pop(at) if len(words) > 1 else None, lambda: words.insert(at, f"n{rng.random()}"), lambda: words.__setitem__(at, "z")])()
        out.append(" ".join(words))
    return out


def family(seed):
    rng = random.Random(seed)
    texts = ["", "  ", "one", "one", "ONE two", "one two three", "one two three four"]
    for size, copies, most in ((400, 30, 40), (60, 40, 6), (12, 30, 2), (5, 10, 1), (150, 60, 30)):
        texts += edited_copies(rng, [f"v{rng.randrange(4 * size)}" for _ in range(size)], copies, most)
    texts += [texts[-1]] * 20 + [" ".join(f"r{rng.random()}" for _ in range(50)) for _ in range(20)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80), (1, 60), (3, 95), (2, 100)])
def test_no_similar_pair_lacks_a_common_signature(words, percent):
    texts = family(words)
    sets = shingles.shingle_sets(texts, words)
    plain = [brute.shingles(t, words) for t in texts]
    assert sets.sizes.tolist() == [len(s) for s in plain]
    doc, signature = jaccard_join.signatures(sets, percent)
    of = [set() for _ in texts]
    for d, s in zip(doc.tolist(), signature.tolist()):
        of[d].add(s)
    for a, b in combinations(range(len(texts)), 2):
        both = len(plain[a] & plain[b])
        if both and 100 * both >= percent * (len(plain[a]) + len(plain[b]) - both):
            assert of[a] & of[b]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab C\t\n\x0bé😀", max_size=30), min_size=1, max_size=8), st.integers(1, 4))
def test_shingle_sets_of_any_texts(texts, words):
    sets = shingles.shingle_sets(texts, words)
    plain = [brute.shingles(t, words) for t in texts]
    assert sets.sizes.tolist() == [len(s) for s in plain]
    held = [set(sets.hashes[sets.doc == i].tolist()) for i in range(len(texts))]
    for a, b in combinations(range(len(texts)), 2):
        assert len(held[a] & held[b]) == len(plain[a] & plain[b])


@pytest.mark.parametrize("tile", [256, 7])
def test_jaccard_join(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    docs = {3 * i + 1: t for i, t in enumerate(family(9))}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    rows = jaccard_join.near_duplicates(df, 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.jaccard_components(docs, 4, 85)


def test_texts_with_passages_in_common_do_not_travel(spark, monkeypatch):
    """Texts of two of twelve passages and of words of their own are not similar; few are sent to be compared."""
    rng = random.Random(5)
    passages = [" ".join(f"p{i}x{j}" for j in range(40)) for i in range(12)]
    texts = [" ".join(rng.sample(passages, 2) + [f"w{rng.random()}" for _ in range(170)]) for _ in range(300)]
    docs = dict(enumerate(texts + edited_copies(rng, texts[0].split(), 10, 10)))
    sent = []
    packed_texts = jaccard_join.packed_texts
    monkeypatch.setattr(jaccard_join, "packed_texts", lambda rows: sent.append(rows.count()) or packed_texts(rows))
    rows = jaccard_join.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.jaccard_components(docs, 5, 80)
    assert sent[0] <= 100


def test_op6_at_small_scale(spark):
    small = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_jaccard_join"](spark, small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.jaccard_components(docs, 4, 85)


def test_join_of_odd_rows(odd_docs, odd_rows, no_docs):
    rows = jaccard_join.near_duplicates(odd_docs).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in rows) == Counter((i, len(brute.shingles(t, 5))) for i, t, *_ in odd_rows)
    of = {r.doc_id: r.component_id for r in rows}
    assert of[1] == of[2] == of[3] == of[4] == 1 and of[8] == of[9] == 8 and of[12] == 12 and of[None] is None
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def vectors(seed, dim=24):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(400)]
    for center in rows[:6]:
        rows += [center * rng.uniform(0.5, 2) + rng.normal(size=dim) * rng.uniform(0.05, 0.3) for _ in range(40)]
    rows += [rows[0]] * 50
    return [np.float32(r).tolist() for r in rows]


@pytest.mark.parametrize("block", [2048, 30])
def test_linked_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(pq_dedup, "BLOCK", block)
    monkeypatch.setattr(pq_dedup, "LIST_SIZE", 40)
    rows = vectors(4)
    x = np.array(rows, dtype=np.float32).astype(float)
    cosine = x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1))
    linked = cosine >= 0.95
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, r, 1) for i, r in enumerate(rows)], "vec_id long, embedding array<float>, label int").repartition(3)
    found = {r.vec_id: r for r in pq_dedup.linked_vectors(df).collect()}
    assert len(found) == len(rows)
    assert all(found[i].n_links <= linked[i].sum() for i in found)
    assert sum(r.n_links for r in found.values()) >= 0.97 * linked.sum()
    want = brute.components(range(len(rows)), list(zip(*np.nonzero(linked))))
    assert sum(found[i].component_id == want[i] for i in found) >= 0.99 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_recall_on_embeddings(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in table], dtype=np.float32).astype(float)
    cosine = x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1))
    exact = int((cosine >= 0.95).sum() - len(x))
    found = sum(r.n_links for r in queries.QUERIES["op5_pq_dedup"](spark, sf).collect())
    assert 0.9 * exact <= found <= exact


def test_odd_vectors(spark):
    good = [1.0, 2.0, 3.0]
    rows = [
        (1, good), (2, [2.0, 4.0, 6.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 0.0, 0.0]),
        (8, [1.0]), (9, []), (None, good), (1, good), (10, [-1.0, -2.0, -3.0]),
    ]
    schema = "vec_id long, embedding array<float>, node long, n int, v string"
    df = spark.createDataFrame([(i, v, 1, 1, "x") for i, v in rows], schema)
    found = pq_dedup.linked_vectors(df).collect()
    assert len(found) == len(rows)
    of = {r.vec_id: r for r in found}
    assert of[1].component_id == of[2].component_id == 1 and of[2].n_links == 2 and not of[2].kept and of[1].kept
    for i in (3, 4, 5, 6, 7, 8, 9, 10):
        assert (of[i].n_links, of[i].component_id, of[i].kept) == (0, i, True)
    assert (of[None].n_links, of[None].component_id, of[None].kept) == (0, None, False)
    for nothing in (df.where("false"), df.where("vec_id in (3, 4)")):
        assert pq_dedup.linked_vectors(nothing).count() == nothing.count()


def test_each_length_has_an_index(spark):
    rows = [(i, [float(i % 5 + 1), 1.0, 0.5, float(i % 7)]) for i in range(30)] + [(100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 3.1]), (102, [2.0]), (103, [7.0])]
    found = {r.vec_id: r for r in pq_dedup.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(found) == len(rows)
    for low, high in ((100, 101), (102, 103)):
        assert (found[low].n_links, found[low].component_id, found[low].kept) == (1, low, True)
        assert (found[high].n_links, found[high].component_id, found[high].kept) == (1, low, False)
    assert all(found[i].component_id < 30 for i in range(30))
