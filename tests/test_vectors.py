"""Banks, scoring, clustering and sub-prototypes."""

import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmeadow.functions import vectors as V
from vecmeadow.operators import bank as B, evaluate as E, novelty as N, scoring as S, subprototypes as P


def frame(spark, m, labels=None):
    labels = labels if labels is not None else [0] * len(m)
    return spark.createDataFrame([(i, [float(x) for x in v], int(l)) for i, (v, l) in enumerate(zip(m, labels))], "vec_id long, embedding array<double>, label int").checkpoint()


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = unit(rng.standard_normal((6, 16)))
    labels = np.arange(180) % 6
    m = centres[labels] + 0.12 * rng.standard_normal((180, 16))
    return m, labels, frame(spark, m, labels)


def bank_arrays(bank):
    return {r.label: (np.array(r.centroid), r.n_support) for r in bank.collect()}


def test_centroid_and_merge(clustered):
    m, labels, df = clustered
    whole = bank_arrays(B.fit_bank(df))
    for l in range(6):
        s = unit(m[labels == l]).sum(axis=0)
        assert np.allclose(whole[l][0], s / np.linalg.norm(s)) and whole[l][1] == 30
    merged = bank_arrays(B.update_bank(B.fit_bank(df.filter("vec_id < 50")), df.filter("vec_id >= 50")))
    assert all(np.allclose(merged[l][0], whole[l][0]) and merged[l][1] == 30 for l in range(6))


def test_small_partials_change_nothing(clustered, monkeypatch):
    _, _, df = clustered
    want = bank_arrays(B.fit_bank(df))
    monkeypatch.setattr(B, "PARTIAL_BYTES", 1)
    got = bank_arrays(B.fit_bank(df))
    assert all(np.allclose(got[l][0], want[l][0]) for l in want)


def test_zero_vectors(spark):
    df = frame(spark, np.array([[0.0, 0.0, 0.0, 0.0]]))
    assert df.select(V.l2(F.col("embedding"))).first()[0] == [0.5] * 4
    assert df.select(V.l2(F.col("embedding"), zero="keep")).first()[0] == [0.0] * 4


def test_scores_ties_and_bounds(spark):
    bank = B.fit_bank(frame(spark, np.eye(3), [5, 2, 9]))
    q = frame(spark, np.array([[1.0, 1.0, 0.0], [0.0, 0.0, 2.0]]))
    rows = {r.vec_id: r for r in S.classify(q, bank, 0.5, 0.0).collect()}
    assert rows[0].best_label == 2 and abs(rows[0].margin) < 1e-12 and rows[0].is_known
    assert S.classify(q, bank, 1.0).filter("vec_id = 1").first().predicted == "9"  # equality accepts
    assert not S.classify(q, bank, 0.5, 0.01).filter("vec_id = 0").first().is_known
    empty = S.classify(q, B.clear_bank(bank), 0.5).collect()
    assert [(r.predicted, r.score) for r in empty] == [("Unknown", 0.0)] * 2


def test_wrong_dimension_fails(spark, clustered):
    bank = B.fit_bank(clustered[2])
    with pytest.raises(Exception, match="dimensions"):
        S.score(frame(spark, np.ones((2, 5))), bank).collect()


@pytest.mark.parametrize("options", [{"truth": "label"}, {"all_scores": True}, {"centring": True}])
def test_large_bank_paths_agree(clustered, options):
    _, _, df = clustered
    bank = B.fit_bank(df.filter("vec_id < 60"))
    small = S.score(df, bank, k=3, **options).collect()
    large = S.score(df, bank, k=3, max_bytes=300, **options).collect()
    key = lambda r: (r.vec_id, [(c.label, round(c.score, 9)) for c in r.candidates], round(r.true_score, 9) if "truth" in options else 0)
    assert sorted(map(key, small)) == sorted(map(key, large))


def test_grouped_large_bank_agrees(clustered):
    _, _, df = clustered
    df = df.withColumn("g", F.col("label") % 2)
    bank = B.fit_bank(df.filter("vec_id < 60"), ["g", "label"])
    key = lambda r: (r.vec_id, [(c.label, round(c.score, 9)) for c in r.candidates])
    small = S.score(df, bank, k=2, group="g").collect()
    assert sorted(map(key, small)) == sorted(map(key, S.score(df, bank, k=2, group="g", max_bytes=300).collect()))


@pytest.mark.parametrize("options", [{"keep_vector": True, "centring": True}, {"group": "g", "centring": True}, {"group": "g", "truth": "label"}])
def test_slices_agree_in_every_form(clustered, options):
    _, _, df = clustered
    df = df.withColumn("g", F.col("label") % 2)
    bank = B.fit_bank(df.filter("vec_id < 60"), ["g", "label"])
    one, many = (S.score(df, bank, k=2, max_bytes=size, **options).collect() for size in (10**6, 300))
    key = lambda r: (r.vec_id, [(c.label, round(c.score, 9)) for c in r.candidates], *(r[c] for c in ("embedding", "true_score", "rival_score") if c in r))
    rounded = lambda r: tuple([round(x, 9) for x in v] if isinstance(v, list) and v and isinstance(v[0], float) else round(v, 9) if isinstance(v, float) else v for v in key(r))
    assert len(one) == df.count() and sorted(map(str, map(rounded, one))) == sorted(map(str, map(rounded, many)))


def test_driver_holds_one_slice_at_a_time(spark, monkeypatch):
    """Forty slices: the driver never holds more than two packed ones, and the winners are those of one product."""
    live, peak = set(), [0, 0]
    pack = S.pack

    def counted(*args):
        made = pack(*args)
        live.add(id(made[0]))
        weakref.finalize(made[0], live.discard, id(made[0]))
        peak[0], peak[1] = max(peak[0], len(live)), peak[1] + 1
        return made

    monkeypatch.setattr(S, "pack", counted)
    rng = np.random.default_rng(5)
    m, p = unit(rng.standard_normal((60, 8))), unit(rng.standard_normal((400, 8)))
    rows = S.score(frame(spark, m), frame(spark, p).select(F.col("vec_id").alias("label"), F.col("embedding").alias("centroid")), k=3, truth="vec_id", max_bytes=640).collect()
    assert peak[1] > 3 * S.CHAINED and peak[0] <= 2
    c = m @ p.T
    for r in rows:
        own = c[r.vec_id]
        assert [x.label for x in r.candidates] == np.argsort(-own, kind="stable")[:3].tolist()
        assert np.allclose([r.true_score, r.rival_score], [own[r.vec_id], max(0, np.delete(own, r.vec_id).max())])


def test_repeated_ids_keep_their_rows(clustered):
    _, _, df = clustered
    bank = B.fit_bank(df.filter("vec_id < 60"))
    twice = df.unionByName(df)
    assert S.score(twice, bank, max_bytes=300).count() == 2 * df.count()


def test_no_query_is_lost_without_prototypes(clustered):
    _, _, df = clustered
    df = df.withColumn("g", F.col("label") % 3)
    bank = B.fit_bank(df.filter("g = 1"), ["g", "label"])
    rows = S.decide(S.score(df, bank, group="g", truth="label"), 0.5, 0.01).collect()
    assert len(rows) == df.count()
    for r in rows:
        if r.g != 1:
            assert (r.candidates, r.score, r.margin, r.predicted, r.true_score, r.rival_score) == ([], 0.0, 0.0, "Unknown", None, 0.0)
    assert S.decide(S.score(df, B.clear_bank(bank)), 0.0).filter("predicted = 'Unknown' and not is_known").count() == df.count()


def leaders(m, t, least, centring=True):
    v = unit(m)
    if centring:
        v = v - v.mean(axis=0)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(n < 1e-12, 1, n)
    taken = np.full(len(v), -1)
    for i in range(len(v)):
        if taken[i] < 0:
            near = np.flatnonzero((v @ v[i] >= t) & (taken < 0))
            if len(near) >= least:
                taken[near] = i
    return {(i, int(l)) for i, l in enumerate(taken) if l >= 0}


@pytest.mark.parametrize("stored", [10**9, 0])
@pytest.mark.parametrize("t", [0.35, 0.8])
def test_leader_clusters_with_copies(spark, stored, t):
    rng = np.random.default_rng(4)
    m = unit(rng.standard_normal((8, 12)))[np.arange(90) % 8] + 0.25 * rng.standard_normal((90, 12))
    m[30:60] = m[30]  # a third of the rows are copies of one vector
    large = 2**60 + 1  # ids beyond what a double can hold
    df = frame(spark, m).withColumn("vec_id", F.col("vec_id") + F.lit(large))
    got = N.leader_clusters(df, t, 3, rows_per_block=25, stored_pairs=stored)
    assert {(r.vec_id - large, r.leader - large) for r in got.collect()} == leaders(m, t, 3)


@pytest.mark.parametrize("stored", [10**9, 0])
def test_leader_clusters_take_few_rounds(spark, monkeypatch, stored):
    m = np.random.default_rng(7).standard_normal((1500, 8))
    written = []
    monkeypatch.setattr(N, "checkpointed", lambda df, real=N.checkpointed: written.append(1) or real(df))
    got = N.leader_clusters(frame(spark, m), 0.7, 3, rows_per_block=400, stored_pairs=stored)
    assert {(r.vec_id, r.leader) for r in got.collect()} == leaders(m, 0.7, 3)
    assert len(written) <= 30


def test_mean_centring_separates_two_groups(spark):
    m = unit(np.array([[10, 1, 0], [10, 1.1, 0], [10, -1, 0], [10, -1.1, 0]], dtype=float))
    df = frame(spark, m)
    members = N.leader_clusters(df, 0.5, 2)
    found = N.describe_clusters(df, members).orderBy("number").collect()
    assert [(r.cluster_id, r.n_samples) for r in found] == [("Novel_Cluster_01", 2), ("Novel_Cluster_02", 2)]
    raw = m[:2].sum(axis=0)
    assert np.allclose(found[0].centroid, raw / np.linalg.norm(raw))


def test_pairs_count_copies(spark):
    df = frame(spark, np.array([[1.0, 0.0]] * 4 + [[0.9, 0.1]] * 2 + [[0.0, 1.0]]))
    pairs = N.similar_pairs(df, 0.9, rows_per_block=2).collect()
    assert [(r.a, r.b, r.copies_a, r.copies_b) for r in pairs] == [(0, 4, 4, 2)]


def test_promotion_makes_members_known(spark, clustered):
    m, labels, df = clustered
    bank = B.fit_bank(df.filter("label < 5"))
    strange = df.filter("label = 5")
    before = S.classify(strange, bank, 0.8).filter("is_known").count()
    members = N.leader_clusters(strange, 0.5, 3, centring=False)
    names = members.select("leader").distinct().withColumn("label", F.lit(77))
    after = S.classify(strange, N.promote(bank, strange, members, names), 0.8).filter("predicted = '77'").count()
    assert before == 0 and after > 20


def kmeans(v, k, rounds=50, tol=1e-6):
    c = v[:k].copy()
    for _ in range(rounds):
        near = np.argmax(v @ c.T, axis=1)
        new = np.array([unit(v[near == j].sum(axis=0, keepdims=True))[0] if (near == j).any() else c[j] for j in range(k)])
        moved = not np.allclose(new, c, atol=tol)
        c = new
        if not moved:
            break
    return c


def test_sub_prototypes(clustered):
    m, labels, df = clustered
    got = P.sub_prototypes(df, 3).collect()
    for l in range(6):
        want = kmeans(unit(m[labels == l]), 3)
        assert np.allclose([r.centroid for r in sorted((r for r in got if r.label == l), key=lambda r: r["sub"])], want)


def test_variance_decides_about_splitting(spark):
    a, b = np.eye(2, 16)
    rng = np.random.default_rng(2)
    two_kinds = np.vstack([np.tile(a, (15, 1)), np.tile(b, (5, 1))]) + 0.02 * rng.standard_normal((20, 16))
    one_kind = np.tile(a, (20, 1)) + 0.02 * rng.standard_normal((20, 16))
    df = frame(spark, np.vstack([two_kinds, one_kind]), [0] * 20 + [1] * 20)
    sizes = {r.label: r["count"] for r in P.adaptive_sub_prototypes(df).groupBy("label").count().collect()}
    assert sizes == {0: 2, 1: 1}


def test_auroc_with_ties_and_chunks(spark):
    rng = np.random.default_rng(3)
    s, y = np.round(rng.random(300), 2), rng.random(300) < 0.4
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "score double, positive boolean")
    wins = (s[y][:, None] > s[~y][None, :]).sum() + 0.5 * (s[y][:, None] == s[~y][None, :]).sum()
    for limit in (10**6, 10):
        assert abs(E.auroc(df, limit=limit).first().auroc - wins / (y.sum() * (~y).sum())) < 1e-6


def test_pair_statistics_in_tiles(clustered):
    m, _, df = clustered
    c = (unit(m) @ unit(m).T)[np.triu_indices(len(m), 1)]
    r = E.pair_statistics(df, rows_per_block=40).first()
    assert (r.pairs, r.min_cosine, r.max_cosine) == (len(c), round(c.min(), 6), round(c.max(), 6))
    assert abs(r.mean_cosine - c.mean()) < 1e-6 and abs(r.std_cosine - c.std()) < 1e-6


def test_thresholds_are_monotone(clustered):
    _, _, df = clustered
    enrolled, held = B.enrol_split(df, 5)
    rows = E.outcome_tally(S.score(held, B.fit_bank(enrolled)), [i / 20 for i in range(21)]).orderBy("theta").collect()
    assert all(a.unknown <= b.unknown for a, b in zip(rows, rows[1:]))
    assert all(r.correct + r.wrong + r.unknown == held.count() for r in rows)
