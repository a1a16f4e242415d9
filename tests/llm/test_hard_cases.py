"""Dense and low-dimensional vectors, ids with several texts, trimming vocabularies, hot keys."""

import json
import random

import numpy as np
import pytest

from kindred.llm import common, embedding_dedup, language_id, minhash_dedup, token_counts


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def around(rng, n, dim, cosine):
    """Vectors of which two have about `cosine`."""
    c = unit(rng.normal(size=(1, dim)))[0]
    r = rng.normal(size=(n, dim))
    r = unit(r - (r @ c)[:, None] * c)
    return np.sqrt(cosine) * c + np.sqrt(1 - cosine) * r


def table(kind):
    rng = np.random.default_rng(5)
    if kind == "third of all in one cluster":
        return np.concatenate([around(rng, 1800, 64, 0.92), unit(rng.normal(size=(4200, 64)))])
    if kind == "half in a looser cluster, 256 dimensions":
        return np.concatenate([around(rng, 1000, 256, 0.9), unit(rng.normal(size=(1000, 256)))])
    if kind == "many clusters":
        return unit(np.repeat(unit(rng.normal(size=(15, 32))), 100, axis=0) + rng.normal(size=(1500, 32)) * 0.05)
    if kind == "all alike":
        return around(rng, 800, 16, 0.97)
    return unit(rng.normal(size=(1500, {"2": 2, "8": 8, "1": 1}[kind])))


@pytest.mark.parametrize("kind", ["third of all in one cluster", "half in a looser cluster, 256 dimensions", "many clusters", "all alike", "2", "8", "1"])
def test_links_of_vectors_equal_brute_force(spark, kind):
    v = table(kind)
    near = unit(v) @ unit(v).T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(v))
    while True:
        low = np.minimum(label, np.where(near, label, len(v)).min(axis=1))
        if (low == label).all():
            break
        label = low
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted(embedding_dedup.near_duplicates(df).collect())
    assert [r.n_links for r in got] == near.sum(axis=1).tolist()
    assert [r.component_id for r in got] == label.tolist()


def test_long_lists_are_parted_without_loss(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LONG", 200)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    v = np.concatenate([around(np.random.default_rng(6), 500, 32, 0.92), unit(np.random.default_rng(7).normal(size=(500, 32)))])
    near = v @ v.T >= 0.9
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted(embedding_dedup.near_duplicates(df).collect())
    assert [r.n_links for r in got] == (near.sum(axis=1) - 1).tolist()


def words(seed, n=60):
    rng = random.Random(seed)
    return [f"w{rng.randrange(1000)}" for _ in range(n)]


def test_texts_of_one_id_are_compared_each(spark):
    t, z = words(1), words(2)
    near = lambda w: [*w[:-1], "other"]
    rows = [(1, t), (2, near(t)), (2, z), (3, near(z)), (9, words(3)), (9, words(4)), (10, near(words(4))), (11, words(5)), (11, words(5)), (None, near(t))]
    df = spark.createDataFrame([(i, " ".join(w), "x") for i, w in rows], "doc_id long, text string, node string")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (9, 9, True), (10, 9, False), (11, 11, True), (None, None, False)}
    # a third of all rows under one id, and equal texts under several
    many = [(5, " ".join(words(100 + i))) for i in range(40)] + [(6, " ".join(near(words(107)))), (4, " ".join(words(120))), (7, " ".join(words(900)))]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    assert got == {5: 4, 6: 4, 4: 4, 7: 7}


def test_chunks_of_vocabularies_that_trim_offsets(tmp_path):
    parts = json.load(open(token_counts.default_vocabulary(), encoding="utf-8"))
    rng = random.Random(6)
    texts = ["".join(rng.choice([" ", "  ", "ab", "don't", "\n", "é9", "<|endoftext|>", ",.", "x" * 30]) for _ in range(rng.randint(0, 90))) for _ in range(200)]
    trims = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    for post in (trims, {"type": "RobertaProcessing", "sep": ["a", 64], "cls": ["b", 65], "trim_offsets": True, "add_prefix_space": False}):
        path = tmp_path / f"{post['type']}.json"
        path.write_text(json.dumps(parts | {"post_processor": post}), encoding="utf-8")
        from tokenizers import Tokenizer

        want = [len(Tokenizer.from_file(str(path)).encode(t, add_special_tokens=False)) for t in texts]
        c = token_counts.Counting(str(path))
        assert c.chunks and c.many(texts) == want and c.counts(texts) == want
        assert [c.huge(t, 50, 6) for t in texts] == want and [c.huge(t, 16, 4) for t in texts] == want


def test_language_fit_counts_whole_texts(spark):
    tail = "zzqq " * 9000  # all beyond 20,000 characters
    rows = [(1, "ab " * 8000 + tail, "one"), (1, "ab " * 8000 + tail, "one"), (2, "cd " * 20, "two"), (3, "", "two"), (4, None, "two")]
    m = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    gram = language_id.grams(np.frombuffer(b"zzq", np.uint8))[0]
    expected = (9000 + 0.5) / (24000 + 45000 - 2 + language_id.BUCKETS / 2)
    assert m.languages == ("one", "two") and abs(float(m.table[gram, 0]) - np.log(expected)) < 1e-4


def test_hot_joins_keep_all_rows_however_many_keys_are_hot(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)
    for keys in (1, 3, 100):
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        rows = [(i % 7 if i % 3 else 0, i) for i in range(200)] + [(None, -1), (99, -2)]
        left = spark.createDataFrame(rows, "k int, x int")
        right = left.where("k <> 99").groupBy("k").agg({"x": "max"}).toDF("k", "top").join(left.groupBy("k").count().toDF("k", "n"), "k")
        inner = common.join_hot(left, right, ["k"])
        assert sorted(inner.collect()) == sorted(left.join(right.drop("n"), "k").collect())
        outer = common.left_join_hot(left, right.drop("n"), "k").select("k", "x", "top")
        assert sorted(map(str, outer.collect())) == sorted(map(str, left.join(right.drop("n"), "k", "left").select("k", "x", "top").collect()))
        assert left.groupBy("k").count().where(f"count >= {common.hot_bar(202)}").count() <= keys


def test_equal_ids_and_sizes_are_drawn_by_their_texts(spark):
    from kindred.llm import mixing

    rows = [(None, " ".join(words(i, 10)), "big") for i in range(60)] + [(1, "a b", "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted((r.text, r.repetitions) for r in mixing.mix(x, keep=("text",)).collect()) for x in (df, df.orderBy("text", ascending=False).repartition(5)))
    assert a == b and len({n for _, n in a}) > 1


def test_a_hub_joins_few_groups_and_is_found_all_the_same(spark):
    from kindred.llm import ann

    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros((1, 8)) + 0.01, unit(rng.normal(size=(400, 8)))])  # all others lie around the first
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    graph = ann.neighbour_graph(df, ann.packed(df), neighbours=6, settled=0.05, hub=10).collect()
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :6]
    assert len(graph) == 401 and np.mean([len(set(r.near) & set(near[r.id].tolist())) / 6 for r in graph]) > 0.9
