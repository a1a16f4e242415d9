"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries search it greedily.

The graph starts from groups around reference points. Each round, a join brings every vector's neighbours and some reverse
neighbours together, and those meet each other: a neighbour of a neighbour is likely a neighbour. Rounds end when few list
entries change. A query walks the graph from its own vector: each hop joins the best candidates not yet visited with their
neighbours, all queries at once, until no candidate among the best `beam` is left to visit, however many hops that takes. Graph distances are of the vectors as given, in double precision, so
neither outliers nor near copies drown others; results are ranked by the vectors too. Equal vectors are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from kindred.llm.common import bucketed, cut
from kindred.llm.embedding_dedup import matrix, reference_points, unit, usable

NEIGHBOURS, REVERSE = 24, 24
#: Groups of other nodes that a node joins in a round, of all whose lists it is in; others find it in later rounds.
HUB = 256
#: Rounds of the graph go on while more than this share of all list entries changes in one.
SETTLED = 0.3
#: Of a start group, so many meet; larger groups are split.
GROUP = 512
#: Nodes that a query keeps, and of them those not yet visited that it visits in a hop.
BEAM, EXPAND = 600, 200
LIST = "id long, near array<long>, d array<double>"
#: Squared distances under this share of the squared norms are taken from differences, as the dot product cancels there.
CANCELS = 2.0**-20
#: Relative error, in squared distance, that two orders of summation differ by at most: for each component.
ORDER_ERROR = 2.0**-50


def packed(nodes: DataFrame) -> DataFrame:
    """(id, q): vectors as bytes, of float32 if they are floats (without rounding), else of float64."""
    kind = width(nodes.schema["v"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column("v")).astype(kind)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in m], pa.binary())], names=["id", "q"])

    return nodes.select("id", "v").mapInArrow(run, "id long, q binary")


def width(vector: ArrayType) -> str:
    return "<f4" if isinstance(vector.elementType, FloatType) else "<f8"


def _rows(column: pa.BinaryArray, kind: str) -> np.ndarray:
    """A column of vectors as bytes as a matrix of float64, from its buffer."""
    n = len(column)
    if not n:
        return np.zeros((0, 1))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(n, -1).astype(np.float64)


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, NaN of a row to itself; close pairs by differences."""
    with np.errstate(over="ignore", invalid="ignore"):
        n = (x * x).sum(1)
        both = n[:, None] + n
        d = both - 2 * x @ x.T
        a, b = np.nonzero(~(d > CANCELS * both))
        for k in range(0, len(a), 16384):
            i, j = a[k : k + 16384], b[k : k + 16384]
            d[i, j] = ((x[i] - x[j]) ** 2).sum(1)
    np.fill_diagonal(d, np.nan)
    return d


def meet(groups: DataFrame, most: int, kind: str) -> DataFrame:
    """LIST rows: for each member of a group (members array<struct<id, q>>), its `most` nearest other members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                ids, near, dist = [], [], []
                for members in whole.slice(k, 256).column(0):
                    if len(members) < 2:
                        continue
                    members = members.values
                    i = members.field(0).to_numpy()
                    d = _squares(_rows(members.field(1), kind))
                    n = min(most, len(i) - 1)
                    at = np.argpartition(d, n - 1, axis=1)[:, :n]
                    ids += i.tolist()
                    near += list(i[at])
                    dist += list(np.take_along_axis(d, at, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(dist, pa.list_(pa.float64()))], names=["id", "near", "d"])

    return groups.select("members").mapInArrow(run, LIST)


def best(lists: DataFrame, most: int) -> DataFrame:
    """LIST rows, one an id: the `most` nearest distinct of all its lists."""
    joined = lists.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"), F.flatten(F.collect_list("d")).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, dist = [], []
            for n, d in zip(b.column("near"), b.column("d"), strict=True):
                n, d = n.values.to_numpy(), d.values.to_numpy()
                order = np.lexsort((n, d))
                _, first = np.unique(n[order], return_index=True)
                at = order[np.sort(first)[:most]]
                near.append(n[at])
                dist.append(d[at])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(near, pa.list_(pa.int64())), pa.array(dist, pa.list_(pa.float64()))], names=["id", "near", "d"])

    return joined.mapInArrow(run, LIST)


def neighbour_graph(nodes: DataFrame, q: DataFrame, neighbours: int = NEIGHBOURS, settled: float = SETTLED, hub: int = HUB) -> DataFrame:
    """LIST rows of every node (id, v) that has any neighbour. In a round a node meets others in `hub` groups of those that have it in their lists, at most."""
    kind = width(nodes.schema["v"].dataType)
    points = reference_points(nodes.withColumnRenamed("id", "cls"))
    shared = nodes.sparkSession.sparkContext.broadcast(points)  # bounded by reference_points

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.argsort(-(unit(matrix(b.column("v"))) @ shared.value.T), axis=1)[:, :3].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(at), pa.list_(pa.int32()))], names=["id", "p"])

    near = cut(nodes.select("id", "v").mapInArrow(nearest, "id long, p array<int>").select("id", F.explode("p").alias("p")))
    parts = near.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    start = near.join(F.broadcast(parts), "p").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    groups = start.join(q, "id").groupBy("p", "part").agg(F.collect_list(F.struct("id", "q")).alias("members"))
    graph = cut(best(meet(groups, neighbours, kind), neighbours))
    r, changed = 0, 1.0
    while changed > settled:
        forward = graph.select(F.col("id").alias("g"), F.explode("near").alias("id"))
        # those that point at a node are sampled, as NN-descent has it: a hub would otherwise gather all of them, and meet in all their groups
        drawn = cut(forward.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("g", F.lit(r)), "g"))).where(F.col("n") <= max(hub, neighbours)))
        back = drawn.where(F.col("n") <= neighbours).select(F.col("id").alias("g"), F.col("g").alias("id"))
        pairs = drawn.where(F.col("n") <= hub).select("g", "id").unionByName(back).unionByName(graph.select(F.col("id").alias("g"), "id")).distinct()
        groups = pairs.join(q, "id").groupBy("g").agg(F.collect_list(F.struct("id", "q")).alias("members"))
        old = graph.select("id", F.col("near").alias("old"))
        graph = cut(best(graph.unionByName(meet(groups, 8, kind)), neighbours))
        n = graph.join(old, "id", "left").agg(F.sum(F.size(F.array_except("near", F.coalesce("old", F.array().cast("array<long>"))))).alias("new"), F.sum(F.size("near")).alias("all")).first()
        r, changed = r + 1, (n["new"] or 0) / (n["all"] or 1)
    return graph


def search(graph: DataFrame, q: DataFrame, starts: DataFrame, kind: str, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """(query, found array<long>, ds array<double>): at most `beam` nearest nodes found for each node id in `starts` (query), itself included, and their squared distances.

    Links and vectors are dealt by node once. A hop sends ids to the links, and a query's vector only to nodes it has not tried.
    """
    edges = graph.select("id", F.explode("near").alias("to"))
    ranked = graph.select(F.col("id").alias("to"), F.explode(F.arrays_zip("near", "d")).alias("x")).select(F.col("x.near").alias("id"), "to", F.col("x.d").alias("d"))
    # links are walked both ways; of the links that point at a node, the shortest
    back = ranked.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("d", "to"))).where(F.col("n") <= REVERSE).select("id", "to")
    links = bucketed(edges.unionByName(back).groupBy(F.col("id").alias("node")).agg(F.collect_set("to").alias("to")), "node")
    vectors = bucketed(q.groupBy(F.col("id").alias("to")).agg(F.first("q").alias("tq")), "to")
    tried = F.array("query")
    state = cut(starts.join(q.withColumnRenamed("id", "query"), "query").select("query", "q", tried.alias("ids"), F.array(F.lit(0.0)).alias("ds"), F.array().cast("array<long>").alias("seen"), tried.alias("tried")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                b = whole.slice(k, 4096)
                with np.errstate(over="ignore"):
                    d = ((_rows(b.column("tq"), kind) - _rows(b.column("q"), kind)) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("to"), pa.array(d)], names=["query", "to", "d"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ds, seen, known = [], [], [], []
            for i, d, s, t, n in zip(*(b.column(c) for c in ("ids", "ds", "seen", "tried", "new")), strict=True):
                old, visited = i.values.to_numpy(), s.values.to_numpy()
                fresh = old[~np.isin(old, visited)][:expand]
                near, far = (n.values.field(0).to_numpy(), n.values.field(1).to_numpy()) if n.is_valid else (old[:0], np.zeros(0))
                i, d = np.concatenate([old, near]), np.concatenate([d.values.to_numpy(), far])
                at = np.lexsort((i, d))[:beam]
                ids.append(i[at])
                ds.append(d[at])
                seen.append(np.intersect1d(np.concatenate([visited, fresh]), i[at]))
                known.append(np.concatenate([t.values.to_numpy(), near]))
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("q"), *(pa.array(v, pa.list_(t)) for v, t in ((ids, pa.int64()), (ds, pa.float64()), (seen, pa.int64()), (known, pa.int64())))], names=["query", "q", "ids", "ds", "seen", "tried"])

    while True:
        front = state.select("query", F.explode(F.slice(F.array_except("ids", "seen"), 1, expand)).alias("node"))
        if front.isEmpty():
            break
        reached = front.join(links, "node").groupBy("query").agg(F.flatten(F.collect_list("to")).alias("reached"))
        asked = state.select("query", "q", "tried").join(reached, "query").select("query", "q", F.explode(F.array_except("reached", "tried")).alias("to"))
        met = asked.join(vectors, "to").select("query", "to", "q", "tq").mapInArrow(measure, "query long, to long, d double")
        new = met.groupBy("query").agg(F.collect_list(F.struct("to", "d")).alias("new"))
        state = cut(state.join(new, "query", "left").select("query", "q", "ids", "ds", "seen", "tried", "new").mapInArrow(gather, "query long, q binary, ids array<long>, ds array<double>, seen array<long>, tried array<long>"))
    return state.select("query", F.col("ids").alias("found"), "ds")


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, spare: int = 60, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each id in `queries` (query_id), by Euclidean distance, ties to smaller ids.

    A row is no candidate of its own query. Vectors that are null, empty, zero or hold null or non-finite components take no
    part, as queries or candidates; nor do null ids. All vectors have one length. A repeated id counts once, with the
    vector that sorts first. Fewer candidates than k give fewer rows.
    """
    ok = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector_col).alias("v"))
    ok = cut(ok)
    # equal vectors are one node, which keeps as many of its smallest ids as a query can need
    first = ok.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    nodes = cut(first.groupBy("v").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids")))
    named = queries.select(F.col("query_id").cast("long").alias("query_id")).distinct().join(ok, F.col("query_id") == ok["id"]).select("query_id", "v")
    asked = cut(named.join(nodes.select("v", F.col("id").alias("query")), "v"))
    q = cut(packed(nodes))
    graph = neighbour_graph(nodes, q)
    found = search(graph, q, asked.select("query").distinct(), width(nodes.schema["v"].dataType), beam)
    # all that may be as near as the k-th by the last ranking's rounding go to it, and `spare` more
    edge = F.element_at("ds", F.least(F.size("ds"), F.lit(k + 1))) * (1 + ORDER_ERROR * F.size("v"))
    tied = found.join(nodes.select(F.col("id").alias("query"), "v"), "query").select("query", "found", F.size(F.filter("ds", lambda d: d <= edge)).alias("n"))
    few = tied.select("query", F.explode(F.slice("found", F.lit(1), F.greatest("n", F.lit(k + 1 + spare)))).alias("id"))
    pairs = asked.join(few, "query").join(nodes.withColumnRenamed("v", "w"), "id")
    diff = F.zip_with("v", "w", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    scored = pairs.select("query_id", "ids", F.sqrt(F.aggregate(diff, F.lit(0.0), lambda a, x: a + x)).alias("score"))
    each = scored.select("query_id", "score", F.explode("ids").alias(id_col)).where(F.col(id_col) != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", id_col))
    return each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
