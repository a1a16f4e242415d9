import itertools
import random

import numpy as np
import pytest

from kindred.operators.cliques import enumerate_cliques
from kindred.operators.clusters import average_linkage, constrained_clusters, split_oversize
from kindred.operators.components import components
from kindred.operators.pairs import pairs_within, top_k


def graph(seed, n=40, m=90):
    rng = random.Random(seed)
    pairs = rng.sample(list(itertools.combinations(range(n), 2)), m)
    return n, [(i, j, rng.choice([0.1, 0.2, 0.3, 0.4, 0.5])) for i, j in pairs]


def merge(n, edges, threshold, ratio, cap):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j, d in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        a, b = sorted((find(i), find(j)))
        size = [find(x) for x in range(n)]
        if a != b and (d < ratio * threshold or size.count(a) + size.count(b) <= cap):
            root[b] = a
    return {x: find(x) for x in range(n)}


@pytest.mark.parametrize("seed,cap", [(1, 4), (2, 8), (3, 50)])
def test_constrained_clusters_match_sequential_merging(spark, seed, cap):
    n, edges = graph(seed)
    items = spark.createDataFrame([(x,) for x in range(n)], "item_id long")
    e = spark.createDataFrame(edges, "i long, j long, dist double")
    got = constrained_clusters(items, e, 0.5, 0.7, cap)
    assert {r.item_id: r.label for r in got.collect()} == merge(n, edges, 0.5, 0.7, cap)
    got = constrained_clusters(items, e, 0.5, 0.7, cap, most=len(edges) - 1)  # by components
    assert {r.item_id: r.label for r in got.collect()} == merge(n, edges, 0.5, 0.7, cap)


def test_components_of_a_chain_and_of_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "i long, j long")
    assert {r.label for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_pairs_and_top_k_match_brute_force_in_many_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, None), (61, [0.0] * 8)], "item_id long, embedding array<double>")
    d = 1 - x @ x.T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if d[i, j] < 0.5}
    assert {(r.i, r.j) for r in pairs_within(items, 0.5, block=13).collect()} == want
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in top_k(items, items, 3, block=13).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.item_id
    assert all([got[i][k] for k in (1, 2, 3)] == np.argsort(d[i], kind="stable")[:3].tolist() for i in range(60))


def test_average_linkage_merges_close_pairs_only(spark):
    v = [[1.0, 0.0], [0.99, 0.14], [0.0, 1.0]]
    items = spark.createDataFrame(list(enumerate(v)), "item_id long, embedding array<double>")
    got = average_linkage(items, pairs_within(items, 0.1), 0.1)
    assert {r.item_id: r.label for r in got.collect()} == {0: 0, 1: 0, 2: 2}


def test_split_and_cliques(spark):
    labels = spark.createDataFrame([(i, 0) for i in range(3)] + [(5, 5), (6, 5)], "item_id long, label long")
    assert {r.item_id: r.label for r in split_oversize(labels, 2).collect()} == {0: 0, 1: 1, 2: 2, 5: 5, 6: 5}
    assert enumerate_cliques({1: {2, 3}, 2: {1, 3}, 3: {1, 2, 4}, 4: {3}}) == [[1, 2, 3], [3, 4]]


def test_average_linkage_of_components_over_the_limit_equals_one_matrix(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<double>")
    groups = {i: [i] for i in range(40)}
    while True:
        d, a, b = min((1 - np.mean(x[groups[a]] @ x[groups[b]].T), a, b) for a, b in itertools.combinations(sorted(groups), 2))
        if d >= 0.3:
            break
        groups[a] += groups.pop(b)
    got = average_linkage(items, pairs_within(items, 0.3), 0.3, most=12, block=9)
    assert {r.item_id: r.label for r in got.collect()} == {i: a for a, m in groups.items() for i in m}


@pytest.mark.parametrize("cap", [4, 50])
def test_weak_components_over_the_limit_match_sequential_merging(spark, cap):
    n, edges = graph(5)
    items = spark.createDataFrame([(x,) for x in range(n)], "item_id long")
    got = constrained_clusters(items, spark.createDataFrame(edges, "i long, j long, dist double"), 0.5, 0.3, cap, most=6)
    assert {r.item_id: r.label for r in got.collect()} == merge(n, edges, 0.5, 0.3, cap)


@pytest.mark.parametrize("cap", [3, 50])
def test_a_hub_of_weak_edges_is_decided_in_few_rounds(spark, monkeypatch, cap):
    from kindred.operators import clusters

    rng = random.Random(9)
    edges = [(0, i, round(rng.uniform(0.4, 0.5), 3)) for i in range(1, 1500)] + [(2 * i + 1, 2 * i + 2, 0.45) for i in range(300)]
    rounds, real = [], clusters.renamed
    monkeypatch.setattr(clusters, "renamed", lambda *a: rounds.append(1) or real(*a))
    monkeypatch.setattr(clusters, "PLACES", 40)
    items = spark.createDataFrame([(x,) for x in range(1500)], "item_id long")
    got = constrained_clusters(items, spark.createDataFrame(edges, "i long, j long, dist double"), 0.5, 0.3, cap, most=200)
    root, size = list(range(1500)), [1] * 1500
    for i, j, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        while root[i] != i:
            i = root[i]
        while root[j] != j:
            j = root[j]
        i, j = sorted((i, j))
        if i != j and size[i] + size[j] <= cap:
            root[j], size[i] = i, size[i] + size[j]
    for x in range(1500):
        root[x] = root[root[x]]
    assert {r.item_id: root[r.label] for r in got.collect()} == {x: root[root[x]] for x in range(1500)} and len(rounds) < 25


def test_clusters_whose_nearest_stays_are_not_compared_again(spark, monkeypatch):
    from kindred.operators import clusters

    # a line of points with growing gaps: few merge in a round
    turn = np.cumsum(np.concatenate([[0.0], 0.02 + 0.0006 * np.arange(39)]))
    x = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<double>")
    asked, real = [], clusters._nearest_clusters
    monkeypatch.setattr(clusters, "_nearest_clusters", lambda a, *r: asked.append((a.where("again").count(), a.count())) or real(a, *r))
    near = pairs_within(items, 0.01)
    got = {r.item_id: r.label for r in average_linkage(items, near, 0.01, most=35, block=16).collect()}
    assert got == {r.item_id: r.label for r in average_linkage(items, near, 0.01).collect()}
    assert asked[0] == (40, 40) and len(asked) > 2 and all(a < n / 3 for a, n in asked[1:])


def test_average_linkage_of_more_like_items_than_one_matrix_takes(spark):
    rng = np.random.default_rng(6)
    x = np.ones((300, 4)) + rng.normal(size=(300, 4)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<double>")
    got = average_linkage(items, pairs_within(items, 0.1), 0.1, most=100, block=64)
    assert {r.label for r in got.collect()} == {0}


@pytest.mark.parametrize("seed", [11, 12])
def test_components_over_runs_and_partitions_match_brute_force(spark, monkeypatch, seed):
    from kindred.operators import components as graph

    monkeypatch.setattr(graph, "RUN_EDGES", 7)
    monkeypatch.setattr(graph, "PACK", 10)
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(None, 3), (4, None), (5, 5)]
    root = {x: x for e in edges for x in e if x is not None}
    for _ in range(200):
        before = dict(root)
        for a, b in edges:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    on = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "i long, j long").repartition(9))
    assert {r.item_id: r.label for r in got.collect()} == {x: c for x, c in root.items() if x in on}


def test_labels_and_totals(spark):
    from kindred.operators.clusters import cluster_sizes, cluster_totals, dense_labels, largest_clusters

    labels = spark.createDataFrame([(i, i // 3 * 3) for i in range(10)], "item_id long, label long")
    assert {r.item_id: r.label for r in dense_labels(labels).collect()} == {i: i // 3 for i in range(10)}
    assert tuple(cluster_totals(labels).first()) == (4, 3, 9, 10)
    assert tuple(cluster_totals(labels.limit(0)).first()) == (0, 0, 0, 0)
    assert [r.label for r in largest_clusters(labels, over=1, most=2).collect()] == [0, 3]
    assert {r.label: r.pairs for r in cluster_sizes(labels).collect()} == {0: 3, 3: 3, 6: 3, 9: 0}


def test_vector_expressions(spark):
    from pyspark.sql import functions as F

    from kindred.functions import vectors

    t = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    out = t.select(vectors.normalized("a").alias("u"), vectors.cosine_distance(vectors.normalized("a"), vectors.normalized("b")).alias("d"), vectors.squared_distance("a", "b").alias("s"), vectors.part("a", F.lit(1), 1).alias("p")).collect()
    assert [list(r.u) for r in out] == [[0.6, 0.8], [0.0, 0.0]]
    assert [round(r.d, 9) for r in out] == [0.2, 1.0] and [r.s for r in out] == [13.0, 1.0] and list(out[0].p) == [4.0]


def test_the_first_nearest_clusters_are_those_of_the_edges(spark):
    from pyspark.sql import functions as F

    from kindred.operators import clusters

    rng = np.random.default_rng(12)
    x = rng.normal(size=(80, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<double>")
    active = items.select(F.lit(0).alias("g"), F.col("item_id").alias("label"), F.col("embedding").alias("s"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("again"))
    want, got = ({r.label: (r.to, round(r.d, 9)) for r in clusters._nearest_clusters(active, 0.2, 16, e).collect()} for e in (None, pairs_within(items, 0.2)))
    assert got == want and 20 < len(got) < 80


def test_a_round_of_a_large_weak_component_is_bounded_however_large_it_is(spark, monkeypatch, tmp_path):
    from kindred.operators import clusters

    real, told = clusters._merged, str(tmp_path / "merged")

    def spy(edges, *rest):
        with open(told, "a") as f:
            f.write(f"{len(edges)} {len(edges.columns)}\n")
        return real(edges, *rest)

    monkeypatch.setattr(clusters, "_merged", spy)
    monkeypatch.setattr(clusters, "PLACES", 5)
    rng = random.Random(4)
    edges = [(0, i, rng.uniform(0.4, 0.5)) for i in range(1, 600)]
    items = spark.createDataFrame([(x,) for x in range(600)], "item_id long")
    got = constrained_clusters(items, spark.createDataFrame(edges, "i long, j long, dist double"), 0.5, 0.3, 3, most=10)
    assert {r.item_id: r.label for r in got.collect()} == merge(600, edges, 0.5, 0.3, 3)
    # no edge twice, as a struct besides its columns
    assert all(int(n) <= 30 and int(c) <= 8 for n, c in (x.split() for x in open(told)))
