"""Centroid clusters, decontamination and resampling against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from kindred.llm import centroids, decontamination, resampling
from kindred.llm.folded import folded_words

VEC = "vec_id long, embedding array<float>, own string, cluster string, x string"
DOC = "doc_id long, text string, hits string, id string, text2 string"


def plain_clusters(rows, k, rounds, dim, seed=1):
    """(id, cluster, distance) of each row, and the centroids, by all distances in Python's integers."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, y, strict=True)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], c


def check_clusters(spark, rows, k, rounds, dim):
    want, c = plain_clusters(rows, k, rounds, dim)
    df = spark.createDataFrame([(i, [float(x) for x in v], "o", "c", "x") for i, v in rows], VEC.replace("array<float>", "array<double>"))
    got = centroids.cluster(df, k=k, rounds=rounds, dim=dim).collect()
    key = repr
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert list(r.centroid) == c[r.cluster]
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster) and r.inertia == sum(d for *_, d in want)


def test_clusters_equal_all_distances(spark):
    rng = np.random.default_rng(3)
    spread = [(i, (rng.normal(size=8) + 3 * (i % 5)).round(2).tolist()) for i in range(400)]
    check_clusters(spark, spread, 6, 5, 8)
    # a grid of few values: many ties, repeated rows, ids that repeat with other vectors, rows without id
    ties = [(i % 90 if i % 11 else None, (rng.integers(-2, 3, 3) / 64).tolist()) for i in range(300)]
    check_clusters(spark, ties, 7, 4, 3)
    large = [(i, (rng.integers(-1, 2, 4) * 1.9e6 + rng.integers(0, 5, 4)).tolist()) for i in range(60)]
    check_clusters(spark, large, 5, 3, 4)
    check_clusters(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])], 16, 3, 2)


def test_bounds_skip_distances_and_prove_what_they_skip(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) * 0.3 + 2 * np.eye(16)[i % 8]).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    states, c = centroids.rounds_of(df, k=8, rounds=4, dim=16, scale=64.0, id_col="vec_id", vector_col="embedding", seed=1)
    tested = [s.groupBy().sum("tested").first()[0] for s in states]
    assert tested[0] == 16000 and tested[-1] < 4000
    for r in states[-1].collect():
        d2 = ((np.array(r.x) - c) ** 2).sum(1)
        assert r.own == d2.argmin() and r.upper >= math.sqrt(d2[r.own]) and (np.array(r.lower) <= np.sqrt(d2)).all()


def test_vectors_that_are_not_kept(spark):
    good = [0.1] * 64
    rows = [(1, good), (2, None), (3, []), (4, [0.1] * 63), (5, [*good[:63], None]), (6, [*good[:63], float("nan")]), (7, [*good[:63], float("inf")]), (8, [0.0] * 64), (9, [1e30] * 64), (None, good)]
    df = spark.createDataFrame([(*r, "o", "c", "x") for r in rows], VEC)
    assert sorted((r.vec_id or 0) for r in centroids.cluster(df).collect()) == [0, 1, 8]
    assert centroids.cluster(df.limit(0)).count() == 0 and centroids.cluster(df.where("vec_id = 2")).columns[0] == "vec_id"


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def plain_hits(text, items, n):
    w = plain_words(text)
    words, hit, named = [x[0] for x in w], set(), set()
    for item, t in items:
        own = [x[0] for x in plain_words(t)]
        for win in {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else ():
            for p in range(len(words) - len(win) + 1):
                if tuple(words[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    named.add(item)
    return len(w), [(p, w[p][1], w[p][2]) for p in sorted(hit)], sorted(str(i) for i in named if i is not None)


def test_contamination_equals_a_plain_search(spark):
    rng = random.Random(8)
    vocabulary = ["a", "B", "é", "ÀB", "7", "cc", "日本", "d'e", "😀x"]
    sentence = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(n))
    items = [(i % 25, sentence(rng.randint(0, 9))) for i in range(40)] + [(30, None), (31, ""), (32, "?!"), (None, "unnamed window here now"), (33, "7"), (34, "ends with a window of item words")]
    docs = [(i, sentence(rng.randint(0, 60)), "h", "i", "t") for i in range(120)]
    docs += [(200, None, "h", "i", "t"), (201, "", "h", "i", "t"), (201, "", "h", "i", "t"), (None, "THE unnamed; window here\tnow", "h", "i", "t"), (203, "long " * 30000 + "ends with a window of item words", "h", "i", "t")]
    docs += [docs[0]] * 5
    df, bench = spark.createDataFrame(docs, DOC), spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, hits string")
    want = sorted(repr((d[0], *plain_hits(d[1], items, 4))) for d in docs)
    for most in (100_000, 40):  # one automaton, and several
        got = decontamination.find_contamination(df, bench, window=4, most=most).collect()
        assert sorted(repr((r.doc_id, r.n_words, [tuple(h) for h in r.hits], list(r.item_ids))) for r in got) == want
    for empty in (bench.limit(0), bench.where("item_id = 30")):
        got = decontamination.find_contamination(df, empty, window=4).collect()
        assert len(got) == len(docs) and not any(r.hits or r.item_ids for r in got)
    assert decontamination.find_contamination(df.limit(0), bench).count() == 0


def test_suffix_runs_give_every_run_of_words_its_bucket():
    rng = random.Random(9)
    texts = [[rng.choice([b"a", b"b", b"cc"]) for _ in range(rng.randint(0, 12))] for _ in range(60)] + [[]]
    for n in (1, 2, 3, 5):
        got = resampling.bucket_ids(texts, n, 97)
        for words, found in zip(texts, got, strict=True):
            want = [crc32(b" ".join(words[i : i + k])) % 97 for k in range(1, n + 1) for i in range(len(words) - k + 1)]
            assert found.tolist() == want
    assert [len(x) for x in resampling.bucket_ids([[], []], 2, 5)] == [0, 0]


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_equals_a_plain_version(spark, n):
    rng = random.Random(n)
    docs = [(i, " ".join(rng.choice(["alpha", "Beta", "γ", "x1", "w%d" % (i % 7)]) for _ in range(rng.randint(0, 60))), "h", "i", "t") for i in range(150)]
    docs += [(500, None, "h", "i", "t"), (501, "", "h", "i", "t"), (None, "alpha " * 40, "h", "i", "t"), (502, "beta " * 20000, "h", "i", "t")] + [docs[3]] * 30
    target = [(1, "alpha beta x1 beta"), (2, None)]
    features = lambda t: [" ".join(w[i : i + k]) for w in [[x.decode() for x in folded_words((t or "").encode())]] for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: crc32(f.encode()) % 50
    s, t = Counter(bucket(f) for d in docs for f in features(d[1])), Counter(bucket(f) for x in target for f in features(x[1]))
    total_s, total_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + 50.0) / ((s[b] + 1.0) * (total_t + 50.0)))) for b in range(50)}
    rows = []
    for i, text, *_ in docs:
        f = features(text)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(f), weight, score, i is not None and len(folded_words((text or "").encode())) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0]))
    drawn = able[: 10 * len(able) // 100]
    df = spark.createDataFrame(docs, DOC)
    got = resampling.resample(df, spark.createDataFrame(target, "item_id long, text string"), n=n, buckets=50).collect()
    assert sorted(repr(tuple(r)[:4]) for r in got) == sorted(repr(r[:4]) for r in rows)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(r[0], r[3]) for r in drawn]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))
    empty = resampling.resample(df.limit(0), spark.createDataFrame([], "text string"), n=n)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_features", "weight", "score", "rank"]
