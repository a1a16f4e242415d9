"""Near-duplicate documents by banded MinHash, odd sketches and exact checks on whole shingle sets.

The MinHash samples of a document are folded into a parity bitmap (odd sketch). A sample in which two documents differ flips
two bits at most, so the XOR population count estimates how many samples differ: banded candidates of a count that linked
pairs reach with probability LOSS at most are left out, all others are checked exactly, on the words themselves.
Documents of equal sets are one class. In a bucket every class is first compared with a leader, in a few rounds of other
leaders; what then still lies in different components of one bucket is compared with each other in full.

The nodes of all this are classes, not ids: a class has one sketch and one text, of one of its rows. Where an id has several
texts, edges between their classes tie them together in the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import HOT_KEYS, PACK, bucketed, components, counted, cut, join_hot, sliced, small_side
from kindred.llm.text_hash import mixed, shingles, words

#: At similarity 0.8 a pair shares no band with probability (1 - 0.8^5)^28 = 1.5e-5.
BANDS, ROWS, SKETCH_BITS = 28, 5, 512
#: Probability that the sketches leave out a linked pair, at most.
LOSS = 1e-6
ROUNDS = 2
#: Buckets up to this size are compared by a join, larger ones in blocks by NumPy.
BLOCK = 48
#: Members of a block, and bytes of their sets, at most on average; members of a bucket's largest component are dealt in smaller blocks.
MEET, MEET_BYTES, SIDE = 2048, 16 << 20, 256
#: Pairs of one leader that meet its text in one group.
PAIRS = 2_000


@cache
def most_flips(percent: int) -> int:
    """Bits in which the sketches of a pair at `percent` similarity differ at most, but for a probability of LOSS: two for each differing sample."""
    n, q = BANDS * ROWS, 1 - percent / 100
    beyond, d = 1.0, -1
    while beyond > LOSS:
        d += 1
        beyond -= comb(n, d) * q**d * (1 - q) ** (n - d)
    return 2 * d


def samples(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash samples (sets, n) as uint32; sets must not be empty."""
    rng = np.random.default_rng(20)
    a, b = rng.integers(1, 1 << 31, n, dtype=np.uint64) * 2 + 1, rng.integers(0, 1 << 32, n, dtype=np.uint64)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), n), np.uint32)
    for k in range(n):
        y = x * np.uint32(a[k]) + np.uint32(b[k])
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        out[:, k] = np.minimum.reduceat(y, at)
    return out


def odd_sketches(m: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps (sets, bits / 64) of int64 of MinHash samples `m`: each sample, with its number, flips one bit."""
    at = mixed(m.astype(np.uint64) + (np.arange(m.shape[1], dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    flat = np.arange(len(m))[:, None] * bits + at.astype(np.int64)
    out = (np.bincount(flat.ravel(), minlength=len(m) * bits) & 1).astype(np.uint8).reshape(len(m), bits)
    return np.packbits(out, axis=1, bitorder="little").view(np.int64)


def describe(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, th (hash of the text), n_shingles, key (of the set), bands array<long>, sketch array<long>) of every row; nulls for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            h, bound, _ = words([(t or "").encode().lower() for t in batch.column("text").to_pylist()])
            sets = [shingles(h[bound[i] : bound[i + 1]], k) for i in range(batch.num_rows)]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, bands, sketches = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                m = samples([sets[i] for i in full], BANDS * ROWS)
                b = mixed(m.reshape(len(full), BANDS, ROWS).astype(np.uint64) + np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                b = mixed(b.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
                odd = odd_sketches(m, SKETCH_BITS)
                for j, i in enumerate(full):
                    keys[i] = blake2b(sets[i].tobytes(), digest_size=16).digest()
                    bands[i], sketches[i] = b[j], odd[j]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["id", "th", "n_shingles", "key", "bands", "sketch"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id long, th long, n_shingles long, key binary, bands array<long>, sketch array<long>")


def node_of(id_: Column | str, th: Column | str, salt: int) -> Column:
    """A number for the row that stands for a class, from its id and the hash of its text, so that both its sketch and its text find it."""
    return F.xxhash64(id_, th, F.lit(salt))


def classed(full: DataFrame) -> DataFrame:
    """(key, cls (smallest id), node, bands, sketch) of every distinct set; nodes are salted anew until no two classes share one."""
    first = F.struct("id", "th", "bands", "sketch")
    for salt in range(100):
        classes = full.groupBy("key").agg(F.min_by(first, F.struct("id", "th")).alias("x")).select("key", F.col("x.id").alias("cls"), node_of("x.id", "x.th", salt).alias("node"), F.lit(salt).alias("salt"), "x.bands", "x.sketch")
        classes = cut(classes)
        if classes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return classes
    raise ValueError("too many classes for 64-bit numbers")


def tied(full: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Edges (a, b) between the classes of each id that has several, none in the ordinary case."""
    several, n = counted(full.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("id", "lo", "n"))
    if not n:
        return None
    both = join_hot(full.select("id", "key"), several, ["id"]).select("lo", "key").where("lo < key").distinct()
    of = classes.select("key", "node")
    return both.join(of.toDF("lo", "a"), "lo").join(of.toDF("key", "b"), "key").select("a", "b")


def _close(a: str, b: str, percent: int) -> Column:
    """False for sketches of more differing bits than linked pairs have."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)), F.lit(0)) <= most_flips(percent)


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets have 100 * intersection >= percent * union; shingles are compared word by word.

    `texts` has (id, text), one row an id, bucketed by id, so the texts of `a` stay where they are. The text of `b` is sent
    to groups of PAIRS pairs, so a leader of many pairs is in no single task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, set] = {}
        held = 0

        def of(i: int, t: str) -> set:
            nonlocal held
            if i not in kept:
                if held > 1 << 17:
                    kept.clear()
                    held = 0
                w = t.encode().lower().split()
                kept[i] = set(zip(*(w[x:] for x in range(k)), strict=False)) if len(w) >= k else {tuple(w)}
                held += len(kept[i])
            return kept[i]

        for batch in batches:
            a, b, ta, tb = batch.columns
            good = []
            for i in range(batch.num_rows):
                y = of(b[i].as_py(), tb[i].as_py())
                x = of(a[i].as_py(), ta[i].as_py())
                both = len(x & y) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    count = cut(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("salts")), PACK)
    many = small_side(count.where("salts > 1"), HOT_KEYS)  # one in PAIRS pairs at most
    salted = pairs.join(many, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")), F.lit(0)).cast("int").alias("salt"))
    left = salted.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb")).join(count, "b").select("b", "tb", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.join(right, ["b", "salt"]).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def whole_sets(texts: DataFrame, k: int) -> DataFrame:
    """(id, size, hashes binary) of `texts` (id, text): the hashes of each whole shingle set, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sliced([batch], "text", 2 << 20):
                h, bound, _ = words([t.encode().lower() for t in b.column("text").to_pylist()])
                sets = [shingles(h[bound[i] : bound[i + 1]], k) for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "size", "hashes"])

    return texts.select("id", "text").mapInArrow(run, "id long, size long, hashes binary")


def _blocks(member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside large buckets (key, id, comp, sketch): blocks of members meet pairwise, with their whole sets.

    The members of a bucket's largest component need not meet each other. Its blocks meet those of the rest, which mostly is
    few, so they are hardly copied; the blocks of the rest meet each other. Pairs whose sketches don't rule them out are
    checked on the sets at once. Of the links between two components a task returns one, so rows stay in proportion to
    members; candidates never become rows.
    """
    n = F.count(F.lit(1))
    main = member.groupBy("key", "comp").agg(n.alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    full = member.select("key", "id", "comp", "sketch").join(cut(main, PACK), "key").withColumn("rest", F.col("comp") != F.col("main")).drop("main").join(sets, "id")

    def blocks(of: Column, most: int) -> Column:
        return F.ceil(F.greatest(F.count_if(of) / most, F.sum(F.when(of, F.col("size"))) * 8 / MEET_BYTES)).cast("int")

    parts = full.groupBy("key").agg(blocks(F.col("rest"), MEET).alias("some"), blocks(~F.col("rest"), SIDE).alias("most"))
    own = full.join(cut(parts, PACK), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("some")).otherwise(F.col("most"))).cast("int"))
    others, mains = F.sequence(F.lit(0), F.col("some") - 1), F.sequence(F.lit(0), F.col("most") - 1)

    def meeting(side: bool, i: Column, j: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))

    among = F.transform(others, lambda k: meeting(False, F.least("own", k), F.greatest("own", k)))
    across = F.when(F.col("rest"), F.transform(mains, lambda k: meeting(True, F.col("own"), k))).otherwise(F.transform(others, lambda k: meeting(True, k, F.col("own"))))
    met = own.withColumn("at", F.explode(F.when(F.col("rest"), F.concat(among, across)).otherwise(across)))
    met = met.select("key", "at.*", "rest", "own", "id", "comp", "sketch", "size", "hashes")
    flips = most_flips(percent)

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        left, right = (p[p.rest], p[~p.rest]) if p.side.iloc[0] else (p[p.own == p.i.iloc[0]], p[p.own == p.j.iloc[0]])
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            odd, ids, size = np.stack(right.sketch.to_list()).view(np.uint64), right.id.to_numpy(), right["size"].to_numpy()
            terms, codes = np.unique(np.frombuffer(b"".join(right.hashes), np.uint64), return_inverse=True)
            start, mark = np.cumsum(size) - size, np.zeros(len(terms), np.int64)
            # components are renamed as links are found, on both sides
            lc, rc = left.comp.to_numpy(copy=True), right.comp.to_numpy(copy=True)
            for r, (i, s, h) in enumerate(zip(left.id, left.sketch, left.hashes, strict=True)):
                x = np.frombuffer(h, np.uint64)
                differ = np.bitwise_count(odd ^ np.asarray(s).view(np.uint64)).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero((differ <= flips) & (rc != lc[r]))
                if not len(near):
                    continue
                at = np.minimum(np.searchsorted(terms, x), len(terms) - 1)
                at = at[terms[at] == x]
                mark[at] = 1
                n = size[near]
                first = np.cumsum(n) - n
                both = np.add.reduceat(mark[codes[np.repeat(start[near] - first, n) + np.arange(n.sum())]], first)
                mark[at] = 0
                good = near[100 * both >= percent * (len(x) + n - both)]
                for c, one in zip(*np.unique(rc[good], return_index=True), strict=True):
                    out.append((min(i, ids[good[one]]), max(i, ids[good[one]])))
                    own = lc[r]
                    lc[lc == c], rc[rc == c] = own, own
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return met.groupBy("key", "side", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: the component of documents linked at a Jaccard similarity of percent / 100 or more.

    Null texts and texts without words have 0 shingles and are components of their own. Rows that repeat an id are one
    document if their texts are equal; different texts under one id are compared each, and all that any of them is linked
    with is one component. kept: the row's id is the component's smallest. Null ids stand for themselves (component null,
    kept false).
    """
    base = cut(describe(docs, id_col, text_col, shingle_words))
    full = base.where("key is not null and id is not null")
    classes = classed(full)
    banded = classes.select(F.col("node").alias("id"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = cut(banded.join(cut(shared, PACK), "key").select("key", "id").distinct(), PACK)
    sketch = cut(classes.join(member.select("id").distinct(), classes["node"] == F.col("id")).select("id", "sketch"), PACK)
    # the texts of candidates are dealt by node once
    salt = (classes.select("salt").first() or [0])[0]
    texts = docs.where(F.col(text_col).isNotNull()).select(node_of(F.col(id_col).cast("long"), F.xxhash64(text_col), salt).alias("id"), F.col(text_col).alias("text")).join(sketch.select("id"), "id", "left_semi")
    texts = bucketed(texts.groupBy("id").agg(F.max("text").alias("text")), "id")
    comp, links, tested = None, None, None

    def now() -> DataFrame:
        """Members with their component, of buckets that still hold several."""
        m = member.withColumn("comp", F.col("id")) if comp is None else cut(member.join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp")), PACK)
        several = m.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n")
        return cut(m.join(cut(several, PACK), "key"), PACK)

    def test(pairs: DataFrame, more: DataFrame | None = None) -> bool:
        """Checks new pairs (a, b) and `more`, which the sketches need not judge; the components change if any link was found."""
        nonlocal comp, links, tested
        new = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).dropDuplicates(["lo", "hi"])
        new = cut(new if tested is None else new.join(tested, ["lo", "hi"], "left_anti"), PACK)
        tested = new.select("lo", "hi") if tested is None else tested.unionByName(new.select("lo", "hi"))
        near = new.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b").where(_close("sa", "sb", percent)).select("a", "b")
        near = cut(near if more is None else near.unionByName(more).distinct(), PACK)
        found = cut(confirm(near, texts, shingle_words, percent), PACK)
        if found.isEmpty():
            return False
        links = found if links is None else links.unionByName(found)
        comp = components(links)
        return True

    m = now()
    for r in range(ROUNDS):
        if m.isEmpty():
            break
        lead = cut(m.groupBy("key").agg(F.min_by(F.struct("id", "comp"), F.col("id") if r == 0 else F.xxhash64("id", F.lit(r))).alias("lead")), PACK)
        pairs = m.join(lead, "key").where("comp <> lead.comp").select(F.col("id").alias("a"), F.col("lead.id").alias("b"))
        if test(pairs):
            m = now()
    if not m.isEmpty():
        little = m.where(F.col("n") <= BLOCK)
        x, y = little.select("key", F.col("id").alias("a"), F.col("comp").alias("ca")), little.select("key", F.col("id").alias("b"), F.col("comp").alias("cb"))
        rest = x.join(y, "key").where("a < b and ca <> cb").select("a", "b")
        large = cut(m.where(F.col("n") > BLOCK).join(sketch, "id"))
        sets = cut(whole_sets(texts.join(large.select("id").distinct(), "id", "left_semi"), shingle_words))
        test(rest, _blocks(large, sets, percent))
    ties = tied(full, classes)
    if ties is not None:
        comp = components(ties if links is None else links.unionByName(ties))
    own = classes.select("key", "node", "cls")
    if comp is None:
        by_key = own.select("key", F.col("cls").alias("component_id"))
    else:  # a component is named after the smallest id of its classes
        named = cut(own.join(comp, own["node"] == comp["id"], "left").select("key", "cls", F.coalesce("component", "node").alias("c")))
        least = cut(named.groupBy("c").agg(F.min("cls").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), PACK)
        by_key = named.join(least.drop("n"), "c", "left").select("key", F.coalesce("component_id", "cls").alias("component_id"))
    out = base.select("id", "n_shingles", "key").join(cut(by_key), "key", "left")
    own_id = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own_id.alias("component_id"), F.coalesce(F.col("id") == own_id, F.lit(False)).alias("kept"))
