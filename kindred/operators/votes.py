"""Geometric consistency of item pairs: descriptor matches by a ratio test, then votes of their angles and scales in histograms.

Features are a table (item_id, keypoints array<struct<angle, size>>, descriptors array<array<float>>), one row an item.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.components import components
from kindred.operators.lineage import cut

#: Fixed values of the check: ratio of the nearest to the second distance, fewest good matches, fewest votes.
RATIO, MIN_MATCHES, MIN_VOTES = 0.75, 10, 50
#: Histograms: angle differences over [0, 360), log2 of size ratios over [-3, 3).
ANGLE_BINS, SCALE_BINS = 24, 20
ANGLE_WIDTH, SCALE_LOW, SCALE_WIDTH = 360 / ANGLE_BINS, -3.0, 6 / SCALE_BINS
#: Distances that a task holds at once.
TILE = 1 << 20
#: Bytes of features that meet in one group, on average.
GROUP_BYTES = 64 << 20
#: Descriptors of pairs' first items that one block matches, at least (unless there are fewer) and at most, on average.
LEAST_ROWS, GROUP_ROWS = 1 << 15, 1 << 21
MATCHES = "i long, j long, query_at int, candidate_at int, dist double, angle_q double, size_q double, angle_c double, size_c double"


def nearest_matches(a: np.ndarray, b: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of `a`, and of `b` the nearest to each, and their distance, where it is under `ratio` times the second."""
    if a.shape[1] != b.shape[1]:
        raise ValueError("descriptors of two items have different lengths")
    found = []
    step = max(1, TILE // b.size)
    for k in range(0, len(a), step):
        d = np.sqrt(((a[k : k + step, None] - b[None]) ** 2).sum(2))
        at, rows = d.argmin(axis=1), np.arange(len(d))
        near = d[rows, at]
        d[rows, at] = np.inf
        good = np.flatnonzero(near < ratio * d.min(axis=1))
        found.append((good + k, at[good], near[good]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def matched_pairs(items: list[np.ndarray], i: np.ndarray, j: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`nearest_matches` of the pairs of places (i, j) of `items`: place of the pair, row of i, row of j, distance, by pair and row of i.

    Pairs of items of equal shapes are compared together, as many as TILE distances allow.
    """
    shapes, shape = np.unique([x.shape for x in items], axis=0, return_inverse=True)
    place, stacks = np.zeros(len(items), np.int64), []
    for s in range(len(shapes)):
        own = np.flatnonzero(shape == s)
        place[own] = np.arange(len(own))
        stacks.append(np.stack([items[x] for x in own]))
    kind, found = shape[i] * len(shapes) + shape[j], []
    order = np.argsort(kind, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
        if not len(run):
            continue
        x, y = stacks[shape[i[run[0]]]], stacks[shape[j[run[0]]]]
        step = TILE // max(1, x[0].size * len(y[0]))
        if step < 2:
            for k in run:
                a, b, d = nearest_matches(x[place[i[k]]], y[place[j[k]]], ratio)
                found.append((np.full(len(a), k), a, b, d))
            continue
        if x.shape[2] != y.shape[2]:
            raise ValueError("descriptors of two items have different lengths")
        for at in range(0, len(run), step):
            some = run[at : at + step]
            d = np.sqrt(((x[place[i[some]]][:, :, None] - y[place[j[some]]][:, None]) ** 2).sum(3))
            nearest = d.argmin(axis=2)[:, :, None]
            near = np.take_along_axis(d, nearest, 2)[:, :, 0]
            np.put_along_axis(d, nearest, np.inf, 2)
            k, a = np.nonzero(near < ratio * d.min(axis=2))
            found.append((some[k], a, nearest[k, a, 0], near[k, a]))
    k, a, b, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.argsort(k, kind="stable")
    return k[order], a[order], b[order], d[order]


def blocked(features: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`pairs` (i, j) with the block (label, x, y) in which each meets, and the items of each block: (label, x, y, item_id).

    Items of one cluster (of `label`, if pairs have one, else of what the pairs connect) meet in one block, so an item travels
    once and not with every pair; small clusters share a block. A cluster of more than GROUP_BYTES, or of more to match than a
    core's quarter of all, is parted, and its parts meet pairwise where they have pairs.
    """
    p = pairs.select("i", "j", *(["label"] if "label" in pairs.columns else [])).where("i is not null and j is not null").distinct()
    if "label" not in pairs.columns:
        p = cut(p)
        labels = components(p).toDF("i", "label")
        p = p.join(labels, "i", "left").withColumn("label", F.coalesce("label", "i"))
    p = cut(p)
    # of the descriptors only their sizes are shuffled here
    many = F.greatest(F.coalesce(F.size("descriptors"), F.lit(0)), F.lit(0))
    weight = features.select("item_id", many.alias("many"), (many * (F.coalesce(F.size(F.col("descriptors")[0]), F.lit(0)) + 2) * 8).cast("long").alias("bytes")).groupBy("item_id").agg(F.max("many").alias("many"), F.max("bytes").alias("bytes"))
    members = p.select("label", F.explode(F.array("i", "j")).alias("item_id")).distinct()
    sums = members.join(weight, "item_id").groupBy("label").agg(F.sum("bytes").alias("bytes"), F.avg("many").alias("many"))
    sums = cut(p.groupBy("label").agg(F.count(F.lit(1)).alias("pairs")).join(sums, "label", "left").select("label", F.coalesce("bytes", F.lit(0)).alias("bytes"), (F.col("pairs") * F.greatest(F.coalesce("many", F.lit(0.0)), F.lit(1.0))).alias("rows")))
    total = sums.agg(F.sum("rows")).first()[0] or 0
    most = min(GROUP_ROWS, max(LEAST_ROWS, total / (4 * pairs.sparkSession.sparkContext.defaultParallelism)))
    # the blocks of a cluster's parts are about half their number squared
    parts = F.greatest(F.lit(1), F.ceil(F.col("bytes") / GROUP_BYTES), F.ceil(F.sqrt(F.col("rows") * 2 / F.lit(float(most)) + 0.25) - 0.5)).cast("int")
    sums = sums.withColumn("parts", parts)
    small = sums.where("parts = 1").agg(F.sum("bytes"), F.sum("rows")).first()
    shared = max(1, -(-(small[0] or 0) // GROUP_BYTES), math.ceil((small[1] or 0) / most))
    part = {c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int") for c in ("i", "j")}
    # clusters of one part are numbered below 0, several to a block
    block = F.when(F.col("parts") == 1, -1 - F.pmod(F.xxhash64("label"), F.lit(shared))).otherwise(F.col("label"))
    met = p.join(sums.select("label", "parts"), "label").select(block.alias("label"), F.least(part["i"], part["j"]).alias("x"), F.greatest(part["i"], part["j"]).alias("y"), "i", "j")
    met = cut(met)
    return met, met.select("label", "x", "y", F.explode(F.array("i", "j")).alias("item_id")).distinct()


class Block:
    """The matches of the pairs of one block: place of the pair in `i` and `j`, rows, distance, and angles and sizes of the items' keypoints."""

    def __init__(self, p: pd.DataFrame, m: pd.DataFrame, ratio: float, keypoints: bool):
        p = p.drop_duplicates(["i", "j"])
        self.i, self.j, ids = p.i.to_numpy(np.int64), p.j.to_numpy(np.int64), pd.Index(m.item_id)
        self.u, self.w = ids.get_indexer(self.i), ids.get_indexer(self.j)
        both = np.flatnonzero((self.u >= 0) & (self.w >= 0))
        k, self.a, self.b, self.d = matched_pairs([np.stack(list(x)).astype(np.float64) for x in m.descriptors], self.u[both], self.w[both], ratio)
        self.pair, self.flat = both[k], {c: self._flat(m[c]) for c in ("angles", "sizes")}
        if keypoints:
            n = np.array([0 if x is None else len(x) for x in m.angles], np.int64)
            known = (self.a < n[self.u[self.pair]]) & (self.b < n[self.w[self.pair]])
            self.pair, self.a, self.b, self.d = (x[known] for x in (self.pair, self.a, self.b, self.d))

    @staticmethod
    def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = [np.zeros(0) if x is None else np.array([np.nan if y is None else y for y in x], np.float64) for x in lists]
        n = np.array([len(x) for x in rows], np.int64)
        return np.concatenate([*rows, [np.nan]]), np.cumsum(n) - n, n

    def points(self, column: str, query: bool) -> np.ndarray:
        """Angles or sizes of the matches on the side of i, if `query`, or of j; NaN where there are none."""
        flat, start, n = self.flat[column]
        item, row = (self.u[self.pair], self.a) if query else (self.w[self.pair], self.b)
        return flat[np.where(row < n[item], start[item] + row, len(flat) - 1)]


def in_blocks(features: DataFrame, pairs: DataFrame, ratio: float, keypoints: bool, rows: Callable[[Block], dict], schema: str) -> DataFrame:
    """What `rows` makes of the matches of each block of `pairs`."""
    points = F.col("keypoints") if "keypoints" in features.columns else F.lit(None).cast("array<struct<angle:double,size:double>>")
    some = features.where(F.size("descriptors") >= 2).select("item_id", "descriptors", F.transform(points, lambda k: k["angle"].cast("double")).alias("angles"), F.transform(points, lambda k: k["size"].cast("double")).alias("sizes"))
    met, members = blocked(some, pairs)
    held = members.toDF("of", "u", "w", "item_id").join(some.dropDuplicates(["item_id"]), "item_id")
    kinds = {"long": "int64", "int": "int32", "double": "float64"}
    types = {c: kinds[k] for c, k in (x.split() for x in schema.split(", "))}
    run = lambda p, m: pd.DataFrame(rows(Block(p, m, ratio, keypoints))).astype(types)
    return met.groupBy("label", "x", "y").cogroup(held.groupBy("of", "u", "w")).applyInPandas(run, schema)


def matches_with_keypoints(features: DataFrame, pairs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """`ratio_matches` with angle_q, size_q (of i) and angle_c, size_c (of j); matches without a keypoint on both sides are left out."""

    def rows(m: Block) -> dict:
        points = {f"{c[:-1]}_{side}": m.points(c, side == "q") for side in "qc" for c in ("angles", "sizes")}
        return {"i": m.i[m.pair], "j": m.j[m.pair], "query_at": m.a, "candidate_at": m.b, "dist": m.d, **points}

    found = in_blocks(features, pairs, ratio, True, rows, MATCHES)
    # a missing number came as NaN
    return found.select("i", "j", "query_at", "candidate_at", "dist", *(F.nanvl(c, F.lit(None)).alias(c) for c in ("angle_q", "size_q", "angle_c", "size_c")))


def ratio_matches(features: DataFrame, pairs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(i, j, query_at, candidate_at, dist): for each descriptor of i, the nearest of j, if nearer than `ratio` times the second nearest.

    Brute force by Euclidean distance, ties to the first. Items with fewer than two descriptors, or none, match nothing.
    Direction is from i to j. Pairs (i, j), perhaps with the `label` of their cluster, count once. Descriptors travel once for
    each block of a cluster, see `blocked`.
    """
    rows = lambda m: {"i": m.i[m.pair], "j": m.j[m.pair], "query_at": m.a, "candidate_at": m.b, "dist": m.d}
    return in_blocks(features, pairs, ratio, False, rows, "i long, j long, query_at int, candidate_at int, dist double")


def with_keypoints(matches: DataFrame, features: DataFrame) -> DataFrame:
    """`matches` with angle_q, size_q (of i) and angle_c, size_c (of j)."""
    points = features.select("item_id", F.posexplode("keypoints").alias("p", "k")).select("item_id", "p", "k.angle", "k.size")
    return matches.join(points.toDF("i", "query_at", "angle_q", "size_q"), ["i", "query_at"]).join(points.toDF("j", "candidate_at", "angle_c", "size_c"), ["j", "candidate_at"])


def histogram_bin(value: Column, low: float, width: float, bins: int) -> Column:
    """Number of the bin, cut towards zero and clamped into the histogram."""
    return F.least(F.greatest(((value - F.lit(low)) / F.lit(width)).cast("int"), F.lit(0)), F.lit(bins - 1))


def geometric_vote(points: DataFrame, threshold: float = 0.3, *, min_matches: int = MIN_MATCHES, min_votes: int = MIN_VOTES, wrap_angles: bool = False) -> DataFrame:
    """(i, j, good, accepted, angle, scale, angle_votes, scale_votes) of every pair with a match in `points` (of `with_keypoints`).

    Angle differences keep the sign of their remainder, so negative ones clamp to the first bin; `wrap_angles` brings them
    into [0, 360) instead. A match whose candidate has no size casts no scale vote. Accepted: `min_matches` good matches, and in both histograms the fullest bin has
    more than `threshold` of them and `min_votes` at least; angle and scale are its middle, the first bin's if equal. Else zeros.
    """
    turn = (F.col("angle_q").cast("double") - F.col("angle_c").cast("double")) % F.lit(360.0)
    turn = F.pmod(turn, F.lit(360.0)) if wrap_angles else turn
    ratio = F.col("size_q").cast("double") / F.when(F.col("size_c") > 0, F.col("size_c").cast("double"))
    a = histogram_bin(turn, 0.0, ANGLE_WIDTH, ANGLE_BINS)
    s = F.when(F.col("size_c") > 0, F.when(F.col("size_q") > 0, histogram_bin(F.log2(ratio), SCALE_LOW, SCALE_WIDTH, SCALE_BINS)).otherwise(0))
    binned = points.select("i", "j", a.alias("a"), s.alias("s"))
    # a row a pair: both histograms are built by partial aggregation
    hist = binned.groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("good"), F.array(*(F.count_if(F.col("a") == b) for b in range(ANGLE_BINS))).alias("angles"), F.array(*(F.count_if(F.col("s") == b) for b in range(SCALE_BINS))).alias("scales")
    )
    most = hist.withColumns({"av": F.array_max("angles"), "sv": F.array_max("scales")})
    return _said(most.withColumns({"a": F.array_position("angles", F.col("av")) - 1, "s": F.array_position("scales", F.col("sv")) - 1}), threshold, min_matches, min_votes)


def _said(voted: DataFrame, threshold: float, min_matches: int, min_votes: int) -> DataFrame:
    """The vote of pairs (i, j) with `good` matches, from the first fullest bins (a, s) of both histograms and their votes (av, sv)."""
    enough = (F.col("good") >= min_matches) & (F.least("av", "sv") > F.col("good") * threshold) & (F.least("av", "sv") >= min_votes)
    angle = (F.col("a") + 0.5) * ANGLE_WIDTH
    scale = F.pow(F.lit(2.0), (F.col("s") + 0.5) * SCALE_WIDTH + SCALE_LOW)
    return voted.select(
        "i",
        "j",
        "good",
        enough.alias("accepted"),
        F.when(enough, angle).otherwise(0.0).alias("angle"),
        F.when(enough, scale).otherwise(0.0).alias("scale"),
        F.when(enough, F.col("av")).otherwise(0).cast("int").alias("angle_votes"),
        F.when(enough, F.col("sv")).otherwise(0).cast("int").alias("scale_votes"),
    )


def _fullest(pair: np.ndarray, value: np.ndarray, low: float, width: float, bins: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of `pairs`, the first bin that most values of its matches fall into, as `histogram_bin` has it, and their number; NaN falls into none."""
    known = ~np.isnan(value)
    at = np.clip(np.trunc((value[known] - low) / width), 0, bins - 1).astype(np.int64)
    n = np.bincount(pair[known] * bins + at, minlength=pairs * bins).reshape(pairs, bins)
    first = n.argmax(axis=1)
    return first, n[np.arange(pairs), first]


def verify_pairs(features: DataFrame, pairs: DataFrame, threshold: float = 0.3, *, min_matches: int = MIN_MATCHES, min_votes: int = MIN_VOTES, wrap_angles: bool = False) -> DataFrame:
    """(i, j, accepted, angle, scale, angle_votes, scale_votes) of every pair (i, j); without enough matches it is not accepted, with zeros.

    As all matches of a pair are found in one block, they are counted there, as `geometric_vote` does, and one row a pair leaves it.
    """

    def rows(m: Block) -> dict:
        size_q, size_c = m.points("sizes", True), m.points("sizes", False)
        with np.errstate(all="ignore"):
            turn = np.fmod(m.points("angles", True) - m.points("angles", False), 360.0)
            turn = np.where(turn < 0, np.fmod(turn + 360.0, 360.0), turn) if wrap_angles else turn
            turn = np.where(np.isnan(turn), 0.0, turn)  # a missing angle counts for the first bin
            # without a size of the candidate there is no vote, without one of the query it is the first bin's
            scale = np.where(size_c > 0, np.where(size_q > 0, np.log2(size_q / size_c), SCALE_LOW), np.nan)
        a, av = _fullest(m.pair, turn, 0.0, ANGLE_WIDTH, ANGLE_BINS, len(m.i))
        s, sv = _fullest(m.pair, scale, SCALE_LOW, SCALE_WIDTH, SCALE_BINS, len(m.i))
        return {"i": m.i, "j": m.j, "good": np.bincount(m.pair, minlength=len(m.i)), "a": a, "av": av, "s": s, "sv": sv}

    voted = in_blocks(features, pairs, RATIO, True, rows, "i long, j long, good long, a int, av int, s int, sv int")
    vote = _said(voted, threshold, min_matches, min_votes).drop("good")
    none = pairs.select("i", "j").where("i is null or j is null").distinct()
    zero = {"accepted": F.lit(False), "angle": F.lit(0.0), "scale": F.lit(0.0), "angle_votes": F.lit(0), "scale_votes": F.lit(0)}
    return vote.unionByName(none.select("i", "j", *(v.alias(c) for c, v in zero.items())))
