"""DuckDB SQL for the rows of the queries of kindred.queries."""

from __future__ import annotations

_DOT = "list_sum(list_transform(list_zip({}, {}), lambda x: x[1] * x[2]))"
_SQUARE = "list_sum(list_transform(list_zip({}, {}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"

_V = "v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)"
_PAIRS = f"""{_V},
p AS MATERIALIZED (SELECT a.id AS i, b.id AS j, 1 - {_DOT.format("a.e", "b.e")} AS dist FROM v a JOIN v b ON a.id < b.id),
near AS MATERIALIZED (SELECT * FROM p WHERE dist < 0.6)"""
_REACH = f"""WITH RECURSIVE {_PAIRS}, both_ways AS MATERIALIZED (SELECT i, j FROM near UNION ALL SELECT j, i FROM near),
reach(item_id, other) AS (SELECT DISTINCT i, i FROM both_ways UNION SELECT r.item_id, b.j FROM reach r JOIN both_ways b ON r.other = b.i),
labels AS MATERIALIZED (SELECT item_id, min(other) AS label FROM reach GROUP BY item_id),
counts AS MATERIALIZED (SELECT label, count(*) AS members, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM labels GROUP BY label)"""

# edges in order merge the labels of a list that has an entry for each item
_AT = "at_ AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS place FROM v)"


def _merging(edges: str) -> str:
    """CTEs that end in labels0 (item_id, label): size-constrained merging over the CTE `edges` (i, j, dist)."""
    return f"""{_AT},
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY dist, i, j) AS k, x.place AS i, y.place AS j, dist FROM {edges} e JOIN at_ x ON e.i = x.id JOIN at_ y ON e.j = y.id),
s(k, lab) AS (SELECT 0::BIGINT, (SELECT list(id ORDER BY id) FROM v)
    UNION ALL
    SELECT s.k + 1, CASE WHEN s.lab[o.i] = s.lab[o.j] THEN s.lab
        WHEN o.dist < 0.6 * 0.7 OR len(list_filter(s.lab, lambda x: x = s.lab[o.i])) + len(list_filter(s.lab, lambda x: x = s.lab[o.j])) <= 50
        THEN list_transform(s.lab, lambda x: CASE WHEN x IN (s.lab[o.i], s.lab[o.j]) THEN least(s.lab[o.i], s.lab[o.j]) ELSE x END)
        ELSE s.lab END
    FROM s JOIN o ON o.k = s.k + 1),
last AS MATERIALIZED (SELECT lab FROM s ORDER BY k DESC LIMIT 1),
labels0 AS MATERIALIZED (SELECT a.id AS item_id, last.lab[a.place] AS label FROM at_ a, last)"""


_SPLIT = """labels AS MATERIALIZED (SELECT item_id, CASE WHEN count(*) OVER (PARTITION BY label) > 50 THEN item_id ELSE label END AS label FROM labels0)"""
_CONSTRAINED = f"WITH RECURSIVE {_PAIRS}, {_merging('near')}, {_SPLIT}"
_GROUPED = f"""{_CONSTRAINED},
scored AS MATERIALIZED (SELECT x.label, p.i, p.j, 1 - p.dist AS similarity FROM p JOIN labels x ON p.i = x.item_id JOIN labels y ON p.j = y.item_id AND x.label = y.label)"""
_WHOLE = f"""{_GROUPED},
m AS (SELECT label, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS members, count(*)::INTEGER AS n_members FROM labels GROUP BY label HAVING count(*) > 1),
g AS (SELECT label, count(*) AS n_pairs, round(avg(similarity), 6) AS avg_similarity FROM scored GROUP BY label)"""


def _clique_groups(pairs: str) -> str:
    """Groups of maximal cliques of the CTE `pairs` (label, i, j, similarity)."""
    return f"""adj AS MATERIALIZED (SELECT label, i AS a, list(j) AS nb FROM (SELECT label, i, j FROM {pairs} UNION ALL SELECT label, j, i FROM {pairs}) GROUP BY label, i),
c(label, m) AS (SELECT label, [i, j] FROM {pairs}
    UNION ALL
    SELECT c.label, list_append(c.m, e.j) FROM c JOIN {pairs} e ON e.label = c.label AND e.i = c.m[len(c.m)] JOIN adj ON adj.label = c.label AND adj.a = e.j WHERE list_has_all(adj.nb, c.m)),
best AS MATERIALIZED (SELECT label, m FROM c WHERE NOT EXISTS (SELECT 1 FROM adj WHERE adj.label = c.label AND list_has_all(adj.nb, c.m))),
numbered AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY label, m) - 1)::BIGINT AS group_id, label, m FROM best)
SELECT n.group_id, n.label, array_to_string(n.m, ',') AS members, len(n.m)::INTEGER AS n_members, count(*) AS n_pairs, round(avg(e.similarity), 6) AS avg_similarity
FROM numbered n JOIN {pairs} e ON e.label = n.label AND list_contains(n.m, e.i) AND list_contains(n.m, e.j) GROUP BY ALL"""


_LINKAGE = f"""WITH RECURSIVE {_PAIRS}, {_AT},
on_edge AS MATERIALIZED (SELECT DISTINCT unnest([i, j]) AS id FROM near),
d AS MATERIALIZED (SELECT x.place AS i, y.place AS j, p.dist AS d FROM p JOIN on_edge a ON p.i = a.id JOIN on_edge b ON p.j = b.id JOIN at_ x ON p.i = x.id JOIN at_ y ON p.j = y.id),
s(k, lab) AS (SELECT 0, (SELECT list(id ORDER BY id) FROM v)
    UNION ALL
    SELECT k + 1, list_transform(lab, lambda x: CASE WHEN x = b THEN a ELSE x END) FROM (
        SELECT s.k, s.lab, least(s.lab[d.i], s.lab[d.j]) AS a, greatest(s.lab[d.i], s.lab[d.j]) AS b, avg(d.d) AS m
        FROM s, d WHERE s.lab[d.i] <> s.lab[d.j] GROUP BY ALL HAVING avg(d.d) < 0.6 ORDER BY m, a, b LIMIT 1)),
last AS MATERIALIZED (SELECT lab FROM s ORDER BY k DESC LIMIT 1),
labels0 AS MATERIALIZED (SELECT a.id AS item_id, last.lab[a.place] AS label FROM at_ a, last), {_SPLIT}
SELECT item_id, label FROM labels"""

# the parts of vectors and of the codebook of first rows
_PARTS = f"""{_V}, sub AS MATERIALIZED (SELECT id, m::INTEGER AS m, e[m * 8 + 1 : m * 8 + 8] AS x FROM v, range(8) t(m)),
book0 AS MATERIALIZED (SELECT m, (row_number() OVER (PARTITION BY m ORDER BY id) - 1)::INTEGER AS k, x AS c FROM sub QUALIFY k < 16)"""


def _round(n: int) -> str:
    """One round of k-means: codes by the codebook of round n - 1, and their means, where there are any."""
    return f"""near{n} AS MATERIALIZED (SELECT id, s.m, arg_min(k, struct_pack(d := {_SQUARE.format("x", "c")}, k := k)) AS k, any_value(x) AS x FROM sub s JOIN book{n - 1} b ON s.m = b.m GROUP BY id, s.m),
mean{n} AS (SELECT m, k, list(a ORDER BY place) AS c FROM (SELECT m, k, place, avg(x[place]) AS a FROM near{n}, range(1, 9) t(place) GROUP BY m, k, place) GROUP BY m, k),
book{n} AS MATERIALIZED (SELECT b.m, b.k, coalesce(mean{n}.c, b.c) AS c FROM book{n - 1} b LEFT JOIN mean{n} USING (m, k))"""


_CODES = f"""{_PARTS},
codes AS MATERIALIZED (SELECT id, s.m, arg_min(k, struct_pack(d := {_SQUARE.format("x", "c")}, k := k)) AS k FROM sub s JOIN book0 b ON s.m = b.m GROUP BY id, s.m),
tables AS MATERIALIZED (SELECT id, s.m, k, {_SQUARE.format("x", "c")} AS d FROM sub s JOIN book0 b ON s.m = b.m)"""
_ADC = f"""{_CODES},
adc AS MATERIALIZED (SELECT t.id AS query_id, c.id AS item_id, sum(d) AS dist FROM tables t JOIN codes c ON t.m = c.m AND t.k = c.k GROUP BY ALL),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, item_id)::INTEGER AS rank FROM adc QUALIFY rank <= 6)"""
_NEIGHBOURS = f"""{_ADC},
pairs AS MATERIALIZED (SELECT DISTINCT least(query_id, item_id) AS i, greatest(query_id, item_id) AS j FROM ranked WHERE dist < 1.2 AND query_id <> item_id)"""

_DESCRIPTORS = "desc_ AS MATERIALIZED (SELECT id, k::INTEGER AS k, e[k * 4 + 1 : k * 4 + 4] AS x, e[k * 4 + 1] * 720 AS angle, e[k * 4 + 2] * 8 AS size FROM v, range(16) t(k))"


def _votes(asked: str, descriptors: str = _DESCRIPTORS, threshold: float = 0.2, matches: int = 2, votes: int = 1) -> str:
    """CTEs that end in votes, over the pairs of the CTE `asked` (i, j) and the CTE desc_ (id, k, x, angle, size)."""
    return f"""{descriptors},
dd AS MATERIALIZED (SELECT q.i, q.j, a.k AS query_at, b.k AS candidate_at, sqrt({_SQUARE.format("a.x", "b.x")}) AS dist FROM {asked} q JOIN desc_ a ON q.i = a.id JOIN desc_ b ON q.j = b.id),
two AS (SELECT *, row_number() OVER w AS n, lead(dist) OVER w AS second FROM dd WINDOW w AS (PARTITION BY i, j, query_at ORDER BY dist, candidate_at)),
matches AS MATERIALIZED (SELECT i, j, query_at, candidate_at, dist FROM two WHERE n = 1 AND dist < 0.75 * second),
bins AS MATERIALIZED (SELECT m.i, m.j, greatest(least(trunc((a.angle - b.angle - 360 * trunc((a.angle - b.angle) / 360)) / 15)::INTEGER, 23), 0) AS a,
    CASE WHEN b.size > 0 THEN CASE WHEN a.size > 0 THEN greatest(least(trunc((log2(a.size / b.size) + 3) / 0.3)::INTEGER, 19), 0) ELSE 0 END END AS s
    FROM matches m JOIN desc_ a ON m.i = a.id AND m.query_at = a.k JOIN desc_ b ON m.j = b.id AND m.candidate_at = b.k),
good_ AS (SELECT i, j, count(*) AS good FROM bins GROUP BY ALL),
av AS (SELECT i, j, arg_max(a, struct_pack(n := n, a := -a)) AS a, max(n) AS n FROM (SELECT i, j, a, count(*) AS n FROM bins GROUP BY ALL) GROUP BY ALL),
sv AS (SELECT i, j, arg_max(s, struct_pack(n := n, s := -s)) AS s, max(n) AS n FROM (SELECT i, j, s, count(*) AS n FROM bins WHERE s IS NOT NULL GROUP BY ALL) GROUP BY ALL),
said AS MATERIALIZED (SELECT q.i, q.j, coalesce(good >= {matches} AND least(av.n, coalesce(sv.n, 0)) > good * {threshold} AND least(av.n, coalesce(sv.n, 0)) >= {votes}, false) AS accepted, av.a, av.n AS an, sv.s, sv.n AS sn
    FROM {asked} q LEFT JOIN good_ USING (i, j) LEFT JOIN av USING (i, j) LEFT JOIN sv USING (i, j)),
votes AS MATERIALIZED (SELECT i, j, accepted, CASE WHEN accepted THEN round((a + 0.5) * 15, 6) ELSE 0 END::DOUBLE AS angle, CASE WHEN accepted THEN round(pow(2, (s + 0.5) * 0.3 - 3), 6) ELSE 0 END::DOUBLE AS scale,
    CASE WHEN accepted THEN an ELSE 0 END::INTEGER AS angle_votes, CASE WHEN accepted THEN sn ELSE 0 END::INTEGER AS scale_votes FROM said)"""


# items and their copies, of which some keep all descriptors, some 50, 49 or 9
_COPIED = """keep AS (SELECT id, e, CASE id % 4 WHEN 0 THEN 64 WHEN 1 THEN 50 WHEN 2 THEN 49 ELSE 9 END AS n FROM v),
own AS (SELECT id, n, k::INTEGER AS k, [e[k + 1], e[(k + 1) % 64 + 1], e[(k + 5) % 64 + 1], e[(k + 17) % 64 + 1]] AS x, k * 5.0 AS angle, 1.0 + k % 4 AS size FROM keep, range(64) t(k)),
asked AS MATERIALIZED (SELECT id AS i, id + 1000000 AS j FROM v),
desc_ AS MATERIALIZED (SELECT id, k, x, angle, size FROM own UNION ALL
    SELECT id + 1000000, k, CASE WHEN k < n THEN x ELSE [100.0 * k, 3.0, 5.0, 7.0] END, angle - 40, size / 2 FROM own)"""

# the vote of the cache goes from the smaller path to the larger one
_BY_PATH = """by_path AS MATERIALIZED (SELECT CASE WHEN 'item-' || i < 'item-' || j THEN i ELSE j END AS i, CASE WHEN 'item-' || i < 'item-' || j THEN j ELSE i END AS j FROM near)"""

ORACLES = {
    "find_duplicates": f"{_WHOLE} SELECT label AS group_id, label, members, n_members, n_pairs, avg_similarity FROM m JOIN g USING (label)",
    "pairs_within": f"WITH {_PAIRS} SELECT i, j, round(dist, 6) AS dist FROM near",
    "top_k": f"""WITH {_PAIRS}, d AS (SELECT i AS query_id, j AS item_id, dist FROM p UNION ALL SELECT j, i, dist FROM p),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, item_id)::INTEGER AS rank FROM d)
        SELECT query_id, item_id, round(dist, 6) AS dist, rank FROM r WHERE rank <= 5""",
    "next_distance": f"WITH {_V}, u AS (SELECT id, e, sqrt({_DOT.format('e', 'e')}) AS n FROM v) SELECT a.id AS item_id, round(1 - {_DOT.format('a.e', 'b.e')} / a.n / b.n, 6) AS dist FROM u a JOIN u b ON a.id + 1 = b.id",
    "components": f"{_REACH} SELECT item_id, label FROM labels",
    "constrained_clusters": f"{_CONSTRAINED} SELECT item_id, label FROM labels",
    "average_linkage": _LINKAGE,
    "cluster_sizes": f"{_REACH} SELECT label, members, pairs FROM counts",
    "split_oversize": f"{_REACH} SELECT item_id, CASE WHEN members > 3 THEN item_id ELSE label END AS label FROM labels JOIN counts USING (label)",
    "cluster_totals": f"{_REACH} SELECT count(*) AS clusters, count(*) FILTER (WHERE members > 1) AS groups, coalesce(sum(pairs), 0)::BIGINT AS pairs, coalesce(max(label) + 1, 0) AS next_label FROM counts",
    "largest_clusters": f"{_REACH} SELECT label, members, pairs FROM counts WHERE members > 2 ORDER BY members DESC, label LIMIT 5",
    "dense_labels": f"{_REACH} SELECT item_id, (dense_rank() OVER (ORDER BY label) - 1)::BIGINT AS label FROM labels",
    "clique_groups": f"{_GROUPED}, good AS MATERIALIZED (SELECT label, i, j, similarity FROM scored JOIN near USING (i, j) WHERE similarity >= 0.35), {_clique_groups('good')}",
    "pq_train": f"WITH {_PARTS}, {_round(1)}, {_round(2)} SELECT m, k, (place - 1)::INTEGER AS pos, round(c[place], 6) AS value FROM book2, range(1, 9) t(place)",
    "pq_encode": f"WITH {_CODES} SELECT id AS item_id, m, k FROM codes",
    "pq_decode": f"WITH {_CODES} SELECT id AS item_id, (8 * c.m + place - 1)::INTEGER AS pos, round(b.c[place], 6) AS value FROM codes c JOIN book0 b USING (m, k), range(1, 9) t(place)",
    "adc_distance": f"WITH {_CODES} SELECT t.id AS item_id, round(sum(d), 6) AS dist FROM tables t JOIN codes c ON t.id + 1 = c.id AND t.m = c.m AND t.k = c.k GROUP BY t.id",
    "adc_top_k": f"WITH {_ADC} SELECT query_id, item_id, round(dist, 6) AS dist, rank FROM ranked",
    "pq_clusters": f"WITH RECURSIVE {_NEIGHBOURS}, edges AS MATERIALIZED (SELECT i, j, 1 - {_DOT.format('a.e', 'b.e')} AS dist FROM pairs JOIN v a ON i = a.id JOIN v b ON j = b.id), {_merging('edges')} SELECT item_id, label FROM labels0",
    "ratio_matches": f"WITH {_PAIRS}, {_votes('near')} SELECT i, j, query_at, candidate_at, round(dist, 6) AS dist FROM matches",
    "geometric_vote": f"WITH {_PAIRS}, {_votes('near')} SELECT * FROM votes",
    "verified_groups": f"{_GROUPED}, {_BY_PATH}, {_votes('by_path')}, good AS MATERIALIZED (SELECT label, x.i, x.j, similarity FROM scored x JOIN votes y ON least(y.i, y.j) = x.i AND greatest(y.i, y.j) = x.j WHERE accepted AND similarity >= 0.35), {_clique_groups('good')}",
    "vote_limits": f"WITH {_V}, {_votes('asked', _COPIED, 0.3, 10, 50)} SELECT * FROM votes",
    "search_modes": f"""{_LINKAGE.rpartition('SELECT item_id')[0]} SELECT 'linkage' AS mode, item_id, label FROM labels
        UNION ALL SELECT 'constrained', * FROM ({_CONSTRAINED} SELECT item_id, label FROM labels)
        UNION ALL SELECT 'quantized', * FROM (WITH RECURSIVE {_V},
            centre AS MATERIALIZED (SELECT list(a ORDER BY k) AS c FROM (SELECT k, avg(e[k]) AS a FROM v, range(1, 65) t(k) GROUP BY k)),
            far AS MATERIALIZED (SELECT id, {_SQUARE.format('e', 'c')} AS d FROM v, centre), six AS (SELECT id FROM v ORDER BY id LIMIT 6),
            pairs AS MATERIALIZED (SELECT DISTINCT least(f.id, s.id) AS i, greatest(f.id, s.id) AS j FROM far f, six s WHERE d < 1.2 AND f.id <> s.id),
            edges AS MATERIALIZED (SELECT i, j, 1 - {_DOT.format('a.e', 'b.e')} AS dist FROM pairs JOIN v a ON i = a.id JOIN v b ON j = b.id), {_merging('edges')}, {_SPLIT} SELECT item_id, label FROM labels)""",
    "random_codebook": f"""WITH {_V}, drawn AS (SELECT *, (row_number() OVER (ORDER BY md5('42:' || id), id) - 1)::INTEGER AS k FROM v QUALIFY k < 16)
        SELECT m::INTEGER AS m, k, (place - 1)::INTEGER AS pos, round(e[m * 8 + place], 6) AS value FROM drawn, range(8) t(m), range(1, 9) u(place)""",
    "verified_document": f"""{_GROUPED}, good AS MATERIALIZED (SELECT label, i, j, similarity FROM scored JOIN near USING (i, j) WHERE similarity >= 0.35),
        {_clique_groups('good').rpartition('SELECT n.group_id')[0]}, whole AS (SELECT n.group_id, n.m, round(avg(e.similarity), 6) AS avg_similarity FROM numbered n JOIN good e ON e.label = n.label AND list_contains(n.m, e.i) AND list_contains(n.m, e.j) GROUP BY ALL)
        SELECT group_id, array_to_string(list_sort(list_transform(m, lambda x: 'item-' || x)), ',') AS paths, len(m)::INTEGER AS members, true AS verified, avg_similarity FROM whole""",
    "feature_cache": """SELECT 'item-' || vec_id AS path, vec_id + CASE WHEN vec_id % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS mtime, CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 16 END::INTEGER AS points, round((embedding[1]::DOUBLE * 720)::FLOAT::DOUBLE, 4) AS angle FROM embeddings""",
    "extract_embeddings": """WITH x AS (SELECT vec_id, vec_id % 3 = 0 AND vec_id % 2 = 0 AS cached, vec_id % 10 = 1 AS none, embedding::DOUBLE[] AS e FROM embeddings),
        y AS (SELECT *, list_transform(range(16), lambda i: e[4 * i + 1] + 2 * e[4 * i + 2] + 3 * e[4 * i + 3] + 4 * e[4 * i + 4]) AS y FROM x),
        u AS (SELECT *, sqrt(list_sum(list_transform(y, lambda a: a * a))) AS n FROM y)
        SELECT 'item-' || vec_id AS path, cached, CASE WHEN none AND NOT cached THEN 'no content' END AS failure,
            round(CASE WHEN cached THEN 0.5 WHEN none THEN NULL ELSE (y[1] / n)::FLOAT END::DOUBLE, 6) AS first, round(CASE WHEN cached THEN 0.5 WHEN none THEN NULL ELSE (y[16] / n)::FLOAT END::DOUBLE, 6) AS last FROM u""",
    "pixel_scaling": """WITH b AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(floor((x::DOUBLE + 1) * 127.5), 0), 255)) AS b FROM embeddings),
        ys AS (SELECT i, least(greatest((i + 0.5) * 0.5 - 0.5, 0), 3)::DOUBLE AS y FROM range(8) t(i)), xs AS (SELECT j, least(greatest((j + 0.5) * 2 - 0.5, 0), 3)::DOUBLE AS x FROM range(2) t(j)),
        g AS (SELECT c, i, j, floor(y)::BIGINT AS y0, least(floor(y)::BIGINT + 1, 3) AS y1, y - floor(y) AS fy, floor(x)::BIGINT AS x0, least(floor(x)::BIGINT + 1, 3) AS x1, x - floor(x) AS fx FROM range(3) t(c), ys, xs),
        p AS (SELECT vec_id, c, i, j, fx, fy, b[(y0 * 4 + x0) * 3 + 3 - c] AS a00, b[(y0 * 4 + x1) * 3 + 3 - c] AS a01, b[(y1 * 4 + x0) * 3 + 3 - c] AS a10, b[(y1 * 4 + x1) * 3 + 3 - c] AS a11 FROM b, g)
        SELECT vec_id AS item_id, ((c * 8 + i) * 2 + j)::INTEGER AS pos, round((floor((a00 * (1 - fy) + a10 * fy) * (1 - fx) + (a01 * (1 - fy) + a11 * fy) * fx + 0.5) / 255)::FLOAT::DOUBLE, 6) AS value FROM p""",
    # names are the same in every folder of tables
    "list_files": r"""SELECT regexp_extract(file, '[^/]*$') AS name, '.parquet' AS extension, true AS dated FROM glob('/root/testdata/sf0.01/*.parquet')""",
    "embedding_cache": """SELECT 'item-' || vec_id AS path, vec_id % 3 = 0 AND vec_id % 2 = 0 AS cached, CASE WHEN vec_id % 3 = 0 AND vec_id % 2 = 0 THEN round(embedding[1]::DOUBLE, 6) END AS first FROM embeddings""",
    "codebook_store": f"WITH {_PARTS} SELECT m, k, (place - 1)::INTEGER AS pos, round(c[place], 6) AS value FROM book0, range(1, 9) t(place)",
    "neighbour_store": f"WITH {_NEIGHBOURS} SELECT i, j FROM pairs",
    "result_document": f"""{_WHOLE}, paths AS (SELECT label, string_agg('item-' || item_id, ',' ORDER BY 'item-' || item_id) AS paths FROM labels GROUP BY label)
        SELECT label AS group_id, paths, n_members AS members, false AS verified, avg_similarity FROM m JOIN g USING (label) JOIN paths USING (label)""",
}
