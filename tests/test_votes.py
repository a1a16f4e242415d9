import numpy as np
import pytest

from kindred.operators import votes

POINTS = "i long, j long, angle_q float, size_q float, angle_c float, size_c float"


def vote(spark, rows, **options):
    return {(r.i, r.j): r for r in votes.geometric_vote(spark.createDataFrame(rows, POINTS), **options).collect()}


@pytest.mark.parametrize("n,accepted", [(49, False), (50, True)])
def test_fifty_votes_are_needed(spark, n, accepted):
    r = vote(spark, [(1, 2, 40.0, 2.0, 0.0, 1.0)] * n)[1, 2]
    assert r.accepted is accepted and r.good == n
    assert (r.angle, r.angle_votes, r.scale_votes) == ((37.5, n, n) if accepted else (0.0, 0, 0))
    if accepted:  # log2(2) = 1 lies in the bin from 0.9 to 1.2 or the next
        assert r.scale in (pytest.approx(2**1.05), pytest.approx(2**1.35))


@pytest.mark.parametrize("n,accepted", [(9, False), (10, True)])
def test_ten_matches_are_needed(spark, n, accepted):
    assert vote(spark, [(1, 2, 1.0, 1.0, 0.0, 1.0)] * n, min_votes=1)[1, 2].accepted is accepted


def test_bins_clamp_and_ties_take_the_first(spark):
    rows = [(1, 2, 0.0, 1.0, 30.0, 1.0)] * 5 + [(1, 2, 359.9, 1.0, 0.0, 1.0)] * 5
    r = vote(spark, rows, min_votes=1)[1, 2]
    assert (r.angle, r.angle_votes) == (7.5, 5)  # -30 falls into the first bin
    assert vote(spark, rows, min_votes=1, wrap_angles=True)[1, 2].angle == 337.5
    far = vote(spark, [(1, 2, 0.0, 100.0, 0.0, 1.0)] * 6 + [(1, 2, 0.0, 0.0, 0.0, 1.0)] * 4, min_votes=1)[1, 2]
    assert far.scale == pytest.approx(2**2.85) and far.scale_votes == 6


def test_matches_without_a_candidate_size_cast_no_scale_vote(spark):
    assert not vote(spark, [(1, 2, 0.0, 1.0, 0.0, 0.0)] * 60)[1, 2].accepted
    rows = [(1, 2, 0.0, 1.0, 0.0, 0.0)] * 14 + [(1, 2, 0.0, 1.0, 0.0, 1.0)] * 6
    assert not vote(spark, rows, min_votes=1)[1, 2].accepted  # 6 of 20 is not more than 0.3
    assert vote(spark, rows, min_votes=1, threshold=0.29)[1, 2].accepted


def test_ratio_test_matches_brute_force(spark):
    rng = np.random.default_rng(22)
    d = {i: rng.normal(size=(n, 4)) for i, n in ((1, 12), (2, 30), (3, 1))}
    rows = [(i, [(float(k), 1.0) for k in range(len(x))], x.tolist()) for i, x in d.items()] + [(4, None, None)]
    features = spark.createDataFrame(rows, "item_id long, keypoints array<struct<angle:float,size:float>>, descriptors array<array<float>>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (4, 2)], "i long, j long")
    got = {(r.i, r.j, r.query_at, r.candidate_at) for r in votes.ratio_matches(features, pairs).collect()}
    x, y = (d[i].astype(np.float32).astype(np.float64) for i in (1, 2))
    dist = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    two = np.sort(dist, axis=1)
    assert got == {(1, 2, k, int(dist[k].argmin())) for k in range(12) if two[k, 0] < 0.75 * two[k, 1]}
    out = votes.verify_pairs(features, pairs)
    assert out.count() == 4 and not out.where("accepted").count()


def test_an_exact_ratio_is_no_match(spark):
    rows = [(1, [(0.0, 1.0)] * 2, [[0.0], [100.0]]), (2, [(0.0, 1.0)] * 2, [[3.0], [4.0]])]
    features = spark.createDataFrame(rows, "item_id long, keypoints array<struct<angle:float,size:float>>, descriptors array<array<float>>")
    pairs = spark.createDataFrame([(1, 2)], "i long, j long")
    assert votes.ratio_matches(features, pairs).count() == 0
    assert votes.ratio_matches(features, pairs, 0.76).count() == 1


@pytest.mark.parametrize("labelled", [True, False])
@pytest.mark.parametrize("most", [1 << 30, 3000])
def test_blocks_hold_each_item_once_and_match_like_pairs(spark, monkeypatch, labelled, most):
    monkeypatch.setattr(votes, "GROUP_BYTES", most)
    rng = np.random.default_rng(8)
    rows = [(i, [(float(k), 1.0 + k) for k in range(10 if i % 9 else 4)], rng.normal(size=(10, 3)).tolist()) for i in range(60)] + [(60, None, None), (61, [], [[1.0, 2.0, 3.0]])]
    features = spark.createDataFrame(rows, "item_id long, keypoints array<struct<angle:float,size:float>>, descriptors array<array<float>>")
    pairs = [(a, b, a // 20 * 20) for a in range(60) for b in range(a + 1, 60) if a // 20 == b // 20] + [(60, 1, 0), (61, 1, 0), (1, 70, 0)]
    df = spark.createDataFrame(pairs, "i long, j long, label long")
    df = df if labelled else df.drop("label")
    want = set()
    for a, b, _ in pairs[:-3]:
        x, y = (np.array(rows[k][2], np.float32).astype(float) for k in (a, b))
        d = np.sqrt(((x[:, None] - y) ** 2).sum(2))
        two = np.sort(d, axis=1)
        want |= {(a, b, k, int(d[k].argmin())) for k in range(10) if two[k, 0] < 0.75 * two[k, 1]}
    assert {(r.i, r.j, r.query_at, r.candidate_at) for r in votes.ratio_matches(features, df).collect()} == want
    full = votes.matches_with_keypoints(features, df)
    got = {(r.i, r.j, r.query_at, r.candidate_at): r for r in full.collect()}
    assert set(got) == {m for m in want if m[2] < len(rows[m[0]][1]) and m[3] < len(rows[m[1]][1])}
    assert all((r.angle_q, r.size_c) == (k[2], 1.0 + k[3]) for k, r in got.items())
    joined = votes.with_keypoints(votes.ratio_matches(features, df), features)
    assert {(r.i, r.j, r.query_at, r.candidate_at, r.angle_c) for r in joined.collect()} == {(*k, r.angle_c) for k, r in got.items()}
    met, members = votes.blocked(features, df)
    n = members.groupBy("item_id").count().agg({"count": "max"}).first()[0]
    assert n == 1 if most > 3000 else n <= 3  # an item of a parted cluster meets the other parts
    assert met.count() == len(pairs) - (0 if most else 3)


def test_a_cluster_of_many_pairs_is_parted_and_votes_as_its_matches_do(spark, monkeypatch):
    monkeypatch.setattr(votes, "LEAST_ROWS", 256)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 4))
    rows = [(i, [(float(rng.uniform(-400, 400)), float(rng.choice([0.0, 1.0, 1.5, 4.0]))) for _ in range(12 - i % 3)], (base + rng.normal(size=(12, 4)) * 0.2)[: 12 - i % 2 * 5].tolist()) for i in range(40)]
    rows[7] = (7, [(None, 1.0), (3.0, None)] * 5, rows[7][2])
    features = spark.createDataFrame(rows, "item_id long, keypoints array<struct<angle:float,size:float>>, descriptors array<array<float>>")
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(40) if a != b] + [(0, 99), (None, 1)], "i long, j long")
    met, _ = votes.blocked(features, pairs)
    blocks = [r["count"] for r in met.groupBy("label", "x", "y").count().collect()]
    assert len(blocks) > 8 and sum(blocks) == 40 * 39 + 1 and max(blocks) < 400
    limits = {"threshold": 0.15, "min_matches": 2, "min_votes": 1}
    for wrap in (False, True):
        want = votes.geometric_vote(votes.matches_with_keypoints(features, pairs), wrap_angles=wrap, **limits).drop("good").collect()
        got = {(r.i, r.j): r for r in votes.verify_pairs(features, pairs, wrap_angles=wrap, **limits).collect()}
        assert len(got) == pairs.count() and not got[0, 99].accepted and not got[None, 1].accepted
        assert {(r.i, r.j): r for r in want} == {k: got[k] for k in ((r.i, r.j) for r in want)} and 0 < sum(r.accepted for r in want) < len(want)
