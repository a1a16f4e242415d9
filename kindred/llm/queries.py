"""The queries of this package: name -> function of (spark, folder of the tables), and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import ann, bpe, centroids, decontamination, embedding_dedup, language_id, line_dedup, minhash_dedup, mixing, resampling, substring_dedup, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.drop_repeats(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id")))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs, language_id.fit(docs), declared=language_id.declared_in(F.col("text")), host=F.col("source"))
    return out.select("doc_id", "language", F.round("confidence", 6).alias("confidence"), "accepted")


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over web pages, which have addresses and markup."""
    html = F.col("html")
    out = language_id.identify(
        table(spark, sf_dir, "pages"), language_id.fit(table(spark, sf_dir, "documents")), id_col="page_id", text=language_id.visible(html), declared=language_id.declared_in(html), host=language_id.host_of(F.col("url"))
    )
    return out.select("page_id", "language", F.round("confidence", 6).alias("confidence"), "accepted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"), min_payload_bytes=0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64.0, seed=1)
    numbers = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.encode(numbers, "UTF-8"), 256).alias("centroid_sha256"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n = F.size("hits").cast("long")
    items = F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256)
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), (n > 0).alias("contaminated"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, percent=10, min_words=20, seed=2024)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_nn_descent": op2_nn_descent,
    "op3_mix_sources": op3_mix_sources,
    "op4_language_id": op4_language_id,
    "pages_language": pages_language,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_token_counts": op7_token_counts,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_decontamination": op12_decontamination,
    "op13_importance_resampling": op13_importance_resampling,
    "pipeline": pipeline,
}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

MIX_SQL = f"""
WITH sized AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size,
    md5('42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || {_WORDS}::VARCHAR) AS draw FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap,
    (sum(source_size) OVER ())::BIGINT AS total FROM per),
run AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spare,
    (sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS heavier FROM weighted),
clamp AS (SELECT *, cap * heavier <= weight * spare AS clamped FROM run),
level AS (SELECT spare AS s, heavier AS h FROM clamp WHERE NOT clamped ORDER BY cap / weight, source ASC NULLS LAST LIMIT 1),
plan AS (SELECT c.*, CASE WHEN clamped THEN cap::DOUBLE ELSE (weight * s)::DOUBLE / h::DOUBLE END AS target FROM clamp c LEFT JOIN level ON TRUE),
parts AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 3) END::BIGINT AS whole FROM plan),
ranked AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, greatest(p.target - p.whole * p.source_size, 0) AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id ASC NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS upto
    FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
    (size * least(whole + CASE WHEN upto + size / 2 < rest THEN 1 ELSE 0 END, 3))::BIGINT AS taken FROM ranked
"""

LINE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
lines AS (SELECT r, doc_id, coalesce('s' || source, 'n') AS site, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
bare AS (SELECT *, trim(regexp_replace(line, '[\\t\\r]', ' ', 'g'), ' ') AS key FROM lines),
common AS (SELECT key FROM bare WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= 10),
marked AS (SELECT b.*, c.key IS NOT NULL AS gone FROM bare b LEFT JOIN common c ON b.key = c.key),
kept AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE gone) AS g,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS t FROM marked GROUP BY r)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(g, 0)::BIGINT AS n_removed, sha256(t) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, ((k // 4) * 5 + 1)::INT, 5))::INTEGER >> (5 * (3 - k % 4))::INTEGER) & 31) + 1, 1)), 'string_agg', '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
"""

# windows by their words; each starts in some documents, of which the smallest counts
REPEATS_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) t(i) WHERE len(w) >= 50),
first AS MATERIALIZED (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (h) WHERE doc_id > f),
lost AS (SELECT doc_id, count(*) AS n, list(p) AS p FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(p, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""

# a vector takes part if it is not null, not zero and has finite components only
_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

NEAREST_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_USABLE}),
d AS (SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d QUALIFY rank <= 10
"""

SHINGLES_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, (len(w) - 2)::BIGINT), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM w),
t AS MATERIALIZED (SELECT doc_id, unnest(s) AS t FROM s), n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT i, j FROM p JOIN n x ON p.i = x.doc_id JOIN n y ON p.j = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, other) AS (SELECT DISTINCT i, i FROM l UNION SELECT r.doc_id, l.j FROM r JOIN l ON r.other = l.i),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(component_id, n.doc_id) AS component_id, coalesce(component_id, n.doc_id) = n.doc_id AS kept FROM n LEFT JOIN c USING (doc_id)
"""

COSINE_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_USABLE}),
u AS MATERIALIZED (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
l AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.vec_id <> b.vec_id
    WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])) / a.n / b.n >= 0.9),
r(vec_id, other) AS (SELECT DISTINCT i, i FROM l UNION SELECT r.vec_id, l.j FROM r JOIN l ON r.other = l.i),
c AS (SELECT vec_id, min(other) AS component FROM r GROUP BY vec_id), k AS (SELECT i AS vec_id, count(DISTINCT j) AS n_links FROM l GROUP BY i)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)
"""

# centroids of round 0, then three rounds of assignment and floored means
_SQUARED = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"


def _assigned(n: int) -> str:
    return f"near{n} AS MATERIALIZED (SELECT r, arg_min(k, struct_pack(d := {_SQUARED}, k := k)) AS k, min({_SQUARED}) AS d, any_value(vec_id) AS vec_id, any_value(x) AS x FROM v, c{n - 1} GROUP BY r)"


def _averaged(n: int) -> str:
    return f"""mean{n} AS (SELECT k, list(m ORDER BY place) AS c FROM (SELECT k, place, floor(sum(x[place]) / count(*))::BIGINT AS m FROM near{n}, range(1, 65) t(place) GROUP BY k, place) GROUP BY k),
c{n} AS MATERIALIZED (SELECT b.k, coalesce(m.c, b.c) AS c FROM c{n - 1} b LEFT JOIN mean{n} m USING (k))"""


CENTROID_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1)::INTEGER AS k, x AS c FROM v QUALIFY k < 16),
{", ".join(f"{_assigned(n)}, {_averaged(n)}" for n in (1, 2, 3))}, {_assigned(4)}
SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near4 JOIN c3 USING (k)
"""

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

WINDOWS_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w FROM documents), i AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
iw AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + 9], ' ') AS t FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) x(p) WHERE len(w) > 0),
dw AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM iw) k, unnest(range(1, len(w) - n + 2)) x(p) WHERE len(w) >= n),
m AS MATERIALIZED (SELECT r, p, n, item_id FROM dw JOIN iw USING (n, t)),
hit AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS l FROM m WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(l), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

# the CRC of a word goes over its bytes by a table of 256 entries, which is made by the rule of its polynomial
RESAMPLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w FROM documents),
o AS MATERIALIZED (SELECT r, unnest(w) AS f FROM d), q AS MATERIALIZED (SELECT unnest({_FOLDED}) AS f FROM benchmark),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, s: xor(c >> 1, (c & 1) * 3988292384))) AS t),
f AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(f), (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM (SELECT f FROM o UNION SELECT f FROM q), crc),
s AS (SELECT b, count(*) AS n FROM o JOIN f USING (f) GROUP BY b), t AS (SELECT b, count(*) AS n FROM q JOIN f USING (f) GROUP BY b),
total AS (SELECT (SELECT count(*) FROM o)::DOUBLE AS s, (SELECT count(*) FROM q)::DOUBLE AS t),
g AS MATERIALIZED (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (total.s + 10000) / ((s.n + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (b), total),
w AS (SELECT r, sum(gain)::BIGINT AS weight FROM o JOIN f USING (f) JOIN g USING (b) GROUP BY r),
e AS MATERIALIZED (SELECT r, doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r)),
scored AS MATERIALIZED (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, n_features >= 20 AND doc_id IS NOT NULL AS able FROM e),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features, weight) AS rank FROM scored WHERE able)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM ranked) * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""

#: The all-pairs searches in SQL are for tables of up to some thousands of rows.
ORACLES = {
    "op1_substring_dedup": REPEATS_SQL,
    "op2_nn_descent": NEAREST_SQL,
    "op3_mix_sources": MIX_SQL,
    "op5_line_dedup": LINE_SQL,
    "op6_warc_revisits": WARC_SQL,
    "op8_minhash_dedup": SHINGLES_SQL,
    "op9_embedding_dedup": COSINE_SQL,
    "op11_centroid_clusters": CENTROID_SQL,
    "op12_decontamination": WINDOWS_SQL,
    "op13_importance_resampling": RESAMPLE_SQL,
}
