import math
import os

import pytest
from pyspark.sql import functions as F

from kindred.functions.vectors import normalized
from kindred.operators.numbering import numbered
from kindred.plans.duplicates import Settings, cached_verdicts, cluster, documents, find_duplicates, group_pairs
from kindred.sources import cache, files, fitted, results


def test_files_are_listed_by_extension_in_any_case(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.JPG", "b.png", "c.txt", "d", "sub/e.webp", "sub/f.Jpeg"):
        (tmp_path / name).write_bytes(b"x")
    os.utime(tmp_path / "a.JPG", (1000.5, 1000.5))
    flat = {r.name: r for r in files.list_files(spark, str(tmp_path)).collect()}
    assert set(flat) == {"a.JPG", "b.png"} and flat["a.JPG"].extension == ".jpg" and abs(flat["a.JPG"].mtime - 1000.5) < 0.01
    assert {r.name for r in files.list_files(spark, str(tmp_path), recursive=True).collect()} == {"a.JPG", "b.png", "e.webp", "f.Jpeg"}


def test_cached_rows_are_valid_within_the_tolerance(spark, tmp_path):
    store = cache.embeddings(spark, str(tmp_path / "e"))
    assert store.count() == 0 and store.clear() == 0
    store.upsert(spark.createDataFrame([("a", 10.0, [1.0]), ("b", 10.0, [2.0]), (None, 1.0, [3.0])], cache.EMBEDDINGS))
    store.upsert(spark.createDataFrame([("b", 20.0, [4.0]), ("c", 30.0, [5.0]), ("c", 30.0, [5.0])], cache.EMBEDDINGS))
    store.upsert(spark.createDataFrame([("d", 40.0, [6.0])], cache.EMBEDDINGS))
    assert {(r.path, r.mtime) for r in store.read().collect()} == {("a", 10.0), ("b", 20.0), ("c", 30.0), ("d", 40.0)}
    items = spark.createDataFrame([("a", 10.009), ("b", 20.011), ("c", 29.98), ("e", 1.0)], "path string, mtime double")
    assert [(r.path, list(r.embedding)) for r in cache.hits(items, store.read()).collect()] == [("a", [1.0])]
    assert {r.path for r in cache.misses(items, store.read()).collect()} == {"b", "c", "e"}
    assert store.clear() > 0 and store.count() == 0


def test_features_and_verdicts_round_trip(spark, tmp_path):
    store = cache.features(spark, str(tmp_path / "f"))
    store.upsert(spark.createDataFrame([("a", 1.0, [(30.0, 2.0)], [[0.5, 1.0]])], cache.FEATURES))
    r = store.read().first()
    assert (r.keypoints[0].angle, list(r.descriptors[0])) == (30.0, [0.5, 1.0])
    said = cache.verdicts(spark, str(tmp_path / "v"))
    rows = spark.createDataFrame([("b", "a", 2.0, 1.0, True, 15.0, 2.0, 60, 70)], cache.VERDICTS)
    said.upsert(cache.canonical(rows))
    asked = spark.createDataFrame([("b", "a", 2.0, 1.0), ("a", "b", 1.0, 2.5), ("a", "c", 1.0, 1.0)], "path1 string, path2 string, mtime1 double, mtime2 double")
    (hit,) = cache.verdict_hits(asked, said.read()).collect()
    assert (hit.path1, hit.mtime1, hit.angle_votes, hit.accepted) == ("a", 1.0, 60, True)
    assert {(r.path1, r.path2) for r in cache.verdict_misses(asked, said.read()).collect()} == {("a", "b"), ("a", "c")}


def test_fitted_tables_need_the_same_fingerprint(spark, tmp_path):
    items = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "item_id long, embedding array<double>")
    mark = fitted.fingerprint(items, k=5)
    assert mark == fitted.fingerprint(items.orderBy("item_id", ascending=False), k=5) != fitted.fingerprint(items, k=6)
    assert mark != fitted.fingerprint(spark.createDataFrame([(1, [1.0, 2.5]), (2, [3.0, 4.0])], items.schema), k=5)
    path = str(tmp_path / "n")
    assert fitted.load_neighbours(spark, path, mark) is None
    fitted.save_neighbours(spark.createDataFrame([(1, 2)], "i long, j long"), path, mark)
    assert [tuple(r) for r in fitted.load_neighbours(spark, path, mark).collect()] == [(1, 2)]
    assert fitted.load_neighbours(spark, path, "other") is None
    book = spark.createDataFrame([(0, 0, [1.0])], "m int, k int, centroid array<double>")
    fitted.save_codebook(book, path, mark)
    assert fitted.load_codebook(spark, path, mark).collect() == book.collect()


@pytest.fixture(scope="module")
def copies(spark):
    v = [[1.0, 0.0, 0.0], [0.999, 0.04, 0.0], [0.998, 0.0, 0.06], [0.0, 1.0, 0.0], [0.0, 0.999, 0.04], [0.0, 0.0, 0.0]]
    v = [[x / (sum(y * y for y in r) ** 0.5 or 1) for x in r] for r in v]
    return spark.createDataFrame([(i, r, f"p{i}", float(i)) for i, r in enumerate(v)], "item_id long, embedding array<double>, path string, mtime double")


@pytest.mark.parametrize("mode", ["linkage", "constrained", "quantized", None])
def test_every_mode_finds_the_copies(spark, copies, mode):
    s = Settings(distance_threshold=0.05, mode=mode, parts=3, centroids=4)
    assert {r.item_id: r.label for r in cluster(copies, s).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    rows = {r.group_id: r for r in find_duplicates(copies, s).collect()}
    assert {k: list(r.members) for k, r in rows.items()} == {0: [0, 1, 2], 3: [3, 4]} and rows[0].n_pairs == 3
    assert cluster(copies, Settings(distance_threshold=0.05, max_cluster_size=2, mode=mode, parts=3, centroids=4)).where("label = item_id").count() == 4


def test_the_number_of_items_does_not_choose_the_mode(spark):
    # 0 and 1 are near; 2 is near to 1, but too far from both on average; 10,000 others are near to none of them
    chain = [(k, [math.cos(a), math.sin(a)] + [0.0] * 14) for k, a in enumerate((0.0, 0.2457, 0.5297))]
    others = F.concat(F.array(F.lit(0.0), F.lit(0.0)), normalized(F.array(*(F.randn(k) for k in range(14)))))
    items = spark.createDataFrame(chain, "item_id long, embedding array<double>").unionByName(spark.range(3, 10_003).select(F.col("id").alias("item_id"), others.alias("embedding")))
    label = lambda s: {r.item_id: r.label for r in cluster(items, s).where("item_id < 3").collect()}
    assert label(Settings(distance_threshold=0.05)) == {0: 0, 1: 0, 2: 2}
    assert label(Settings(distance_threshold=0.05, mode="constrained")) == {0: 0, 1: 0, 2: 0}


def test_the_quantized_mode_takes_what_it_kept(spark, copies, tmp_path, monkeypatch):
    from kindred.operators import quantizer

    s = Settings(distance_threshold=0.05, mode="quantized", parts=3, centroids=4, fitted_path=str(tmp_path / "fit"))
    first = {r.item_id: r.label for r in cluster(copies, s).collect()}
    monkeypatch.setattr(quantizer, "train", None)
    monkeypatch.setattr(quantizer, "adc_top_k", None)
    assert {r.item_id: r.label for r in cluster(copies, s).collect()} == first == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    with pytest.raises(TypeError):  # other vectors
        cluster(copies.where("item_id < 5 and item_id <> 1"), s).collect()


def test_verdicts_make_cliques_with_running_numbers(spark, copies):
    said = spark.createDataFrame([(0, 1, True), (1, 2, True), (0, 2, False), (3, 4, True)], "i long, j long, accepted boolean")
    rows = find_duplicates(copies, Settings(distance_threshold=0.05), said).orderBy("group_id").collect()
    assert [(r.group_id, list(r.members)) for r in rows] == [(0, [0, 1]), (1, [1, 2]), (2, [3, 4])]
    assert find_duplicates(copies.limit(0), Settings(), said).count() == 0


def test_result_documents_round_trip(spark, copies, tmp_path):
    pairs = group_pairs(copies, Settings(distance_threshold=0.05))
    results.save_result(documents(pairs, copies), str(tmp_path / "r"), "/some/folder", "2024-05-01 10:00:00")
    back = results.load_result(spark, str(tmp_path / "r"))
    assert {r.directory for r in back.collect()} == {"/some/folder"}
    got = {r.group_id: r for r in results.group_summary(back).collect()}
    assert list(got[0].paths) == ["p0", "p1", "p2"] and not got[0].verified and 0.99 < got[0].avg_similarity < 1
    assert results.load_result(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("{broken")
    assert results.load_result(spark, str(tmp_path / "bad")) is None


def test_verdicts_come_from_the_cache_the_second_time(spark, copies, tmp_path):
    rows = [(i, [(0.0, 1.0)] * 3, [[float(k), 10.0 * k] for k in range(3)]) for i in range(5)]
    features = spark.createDataFrame(rows, "item_id long, keypoints array<struct<angle:float,size:float>>, descriptors array<array<float>>")
    pairs = spark.createDataFrame([(0, 1), (3, 4)], "i long, j long")
    store = cache.verdicts(spark, str(tmp_path / "w"))
    first = {tuple(r) for r in cached_verdicts(pairs, copies, features, store, 0.3, min_matches=2, min_votes=2).collect()}
    again = {tuple(r) for r in cached_verdicts(pairs, copies, features.limit(0), store, 0.3, min_matches=2, min_votes=2).collect()}
    assert first == again and all(r[2] for r in first) and len(first) == 2


def test_only_pairs_inside_clusters_are_verified(spark, tmp_path, monkeypatch):
    from kindred import queries

    # 60 items near to each other make a cluster over the largest size, two others one of their own
    u = [math.cos(k) for k in range(64)]
    apart = [math.cos(3 * k + 1) for k in range(64)]
    of = lambda v, at, by: [x + by * (k == at) for k, x in enumerate(v)]
    raw = [(k, of(u, k, 0.1)) for k in range(60)] + [(60 + k, of(apart, k, 0.1)) for k in range(2)]
    rows = [(k, [x / sum(y * y for y in v) ** 0.5 for x in v]) for k, v in raw]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    asked, own = [], queries.cached_verdicts

    def verdicts(pairs, *args, **limits):
        out = own(pairs, *args, **limits)
        asked.append({(r.i, r.j) for r in pairs.collect()})
        return out

    monkeypatch.setattr(queries, "cached_verdicts", verdicts)
    found = queries.QUERIES["verified_groups"](spark, str(tmp_path)).collect()
    assert asked == [{(60, 61)}] * 2
    assert [(r.group_id, r.label, r.members, r.n_pairs) for r in found] == [(0, 60, "60,61", 1)]


def test_numbers_are_consecutive_over_partitions(spark):
    t = spark.range(1000).selectExpr("id * 7 % 1000 as x", "id").repartition(7)
    got = {r.x: r.n for r in numbered(t, ["x"], "n").collect()}
    assert got == {x: x for x in range(1000)}
    assert numbered(t.limit(0), ["x"], "n").count() == 0


def test_tables_can_be_released(spark):
    from kindred.operators import lineage

    kept = lineage.cut(spark.range(5))
    with lineage.releasing(spark):
        t = lineage.cut(spark.range(3))
        dealt = lineage.bucketed(spark.range(4), "id")
        assert t.count() == 3 and dealt.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(t.inputFiles()[0]).count()
    assert kept.count() == 5
    t = lineage.cut(spark.range(3))
    lineage.release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(t.inputFiles()[0]).count()


def test_two_writers_at_once_lose_no_row(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "c")

    def write(k):
        store = cache.embeddings(spark, path, buckets=4)
        for turn in range(3):
            rows = [(f"{k}-{turn}-{i}", float(i), [float(k)]) for i in range(20)] + [("shared", float(10 * k + turn), [float(k)])]
            store.upsert(spark.createDataFrame(rows, cache.EMBEDDINGS))

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    store = cache.embeddings(spark, path)
    assert store.count() == store.read().count() == store.read().select("path").distinct().count() == 181
    assert store.versions.numbers() == list(range(1, 10))


def test_an_upsert_rewrites_touched_buckets_only_and_readers_keep_their_version(spark, tmp_path):
    store = cache.embeddings(spark, str(tmp_path / "c"), buckets=16)
    store.upsert(spark.createDataFrame([(f"p{i}", 1.0, [float(i)] * 50) for i in range(400)], cache.EMBEDDINGS))
    was, before = store.read(), store.versions.size(store.versions.path)
    old = store.versions.latest()[1]["buckets"]
    store.upsert(spark.createDataFrame([("p3", 2.0, [0.0])], cache.EMBEDDINGS))
    new = store.versions.latest()[1]["buckets"]
    assert sum(old[b] != new[b] for b in old) == 1 and store.count() == 400
    assert store.versions.size(store.versions.path) - before < before / 4
    assert was.where("path = 'p3'").first().mtime == 1.0 and was.count() == 400
    assert store.vacuum(age=3600) == 0 and was.count() == 400
    store.upsert(spark.createDataFrame([(f"p{i}", 3.0, [1.0]) for i in range(400)], cache.EMBEDDINGS))
    assert store.vacuum(keep=1, age=-1) > 0 and store.count() == store.read().where("mtime = 3").count() == 400
    assert store.clear() > 0 and store.count() == 0 and store.read().count() == 0


def test_a_version_number_is_taken_once(spark, tmp_path):
    from kindred.sources.commits import Versions

    v = Versions(spark, str(tmp_path / "v"))
    assert v.latest() == (0, None) and v.publish(1, {"a": 1}) and not v.publish(1, {"a": 2})
    assert v.latest() == (1, {"a": 1})
    (tmp_path / "v" / "versions" / "000000000002.json").write_text("{broken")
    assert v.latest() == (2, {"a": 1}) and v.commit(lambda n, base: base | {"b": n}) == (3, {"a": 1, "b": 2})


@pytest.mark.parametrize("harm", ["truncated", "overwritten", "gone", "half written", "manifest", "rows lost"])
def test_damaged_fitted_tables_count_as_absent(spark, tmp_path, harm):
    import glob
    import shutil

    path = str(tmp_path / "b")
    book = spark.createDataFrame([(m, k, [0.5 * m, 1.0 * k]) for m in range(4) for k in range(20)], "m int, k int, centroid array<double>").repartition(3)
    fitted.save_codebook(book, path, "mark")
    assert fitted.load_codebook(spark, path, "mark").count() == 80
    files = sorted(glob.glob(f"{path}/data/*/*.parquet"))
    for crc in glob.glob(f"{path}/**/.*.crc", recursive=True):
        os.remove(crc)
    if harm == "truncated":
        with open(files[0], "r+b") as f:
            f.truncate(os.path.getsize(files[0]) // 2)
    elif harm == "overwritten":
        with open(files[0], "wb") as f:
            f.write(b"no table at all")
    elif harm == "gone":
        shutil.rmtree(f"{path}/data")
    elif harm == "half written":
        os.remove(files[0])
    elif harm == "rows lost":
        book.where("k > 0").write.mode("overwrite").parquet(os.path.dirname(files[0]))
    else:
        (manifest,) = glob.glob(f"{path}/versions/*.json")
        with open(manifest, "w") as f:
            f.write('{"fingerprint": "mark", "fol')
    assert fitted.load_codebook(spark, path, "mark") is None
    fitted.save_codebook(book, path, "mark")
    assert fitted.load_codebook(spark, path, "mark").count() == 80
    assert fitted.vacuum(spark, path, age=-1) >= 0 and fitted.load_codebook(spark, path, "mark").count() == 80
