"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

DataFrame functions only. Sizes are summed per source; the water level comes from running sums over sources in order of
cap per weight, which is the state that repeated clamping and resharing ends in. A source with target t and size s takes
every document floor(t / s) times; documents for the rest of t are drawn in a seeded random order until the rest is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import cut, small_side, word_count
from kindred.operators.numbering import numbered, prefix_sums

#: Leading hexadecimal digits of a document's random key by which draws are first summed.
DIGITS = 3


def cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """`sizes` (source, ...) with `weight`: sources in code-point order, null last, weigh the cycle's numbers in turn."""
    at = numbered(sizes.withColumn("__null", F.col("source").isNull()), ["__null", "source"], "__at")
    turn = (F.col("__at") % len(cycle) + 1).cast("int")
    return at.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), turn).cast("long")).drop("__null", "__at")


def whole(x: Column) -> Column:
    """A whole number as a decimal, so that products of sums do not overflow."""
    return x.cast("decimal(19,0)")


def water_fill(weighted: DataFrame, epochs: int = 3) -> DataFrame:
    """`weighted` (source, source_size, weight) with `target`: shares of all sizes by weight, none above epochs * source_size.

    In order of cap / weight, source k is clamped if its cap is at most weight * (total - caps before) / (weights from k on).
    Sources of size 0 get 0. All running sums are of whole numbers, so targets do not depend on the order of summation.
    """
    sums = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    keyed = weighted.withColumns({"__cap": F.col("source_size") * epochs, "__null": F.col("source").isNull()}).withColumn("__key", F.col("__cap") / F.col("weight"))
    w = prefix_sums(keyed, ["__key", "__null", "source"], {"__caps": F.col("__cap"), "__weights": F.col("weight")})
    w = w.withColumns({"__left": F.lit(sums.size) - F.col("__caps"), "__rest": F.lit(sums.weight) - F.col("__weights")})
    w = cut(w.withColumn("__clamped", whole(F.col("__cap")) * whole(F.col("__rest")) <= whole(F.col("weight")) * whole(F.col("__left"))))
    # clamped sources come first; the level is that of the first source that is not
    level = w.where(~F.col("__clamped")).agg(F.min(F.struct("__key", "__null", F.coalesce("source", F.lit("")).alias("source"), "__left", "__rest")).alias("x")).first().x
    share = (F.col("weight") * F.lit(level["__left"])).cast("double") / F.lit(float(level["__rest"])) if level else F.lit(None).cast("double")
    return w.select(*weighted.columns, F.when(F.col("__clamped"), F.col("__cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = 3, cycle: tuple[int, ...] = (1, 2, 3), seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, source_size, target, taken, repetitions, the columns of `keep`) of every row.

    size: words of the text (null: 0). taken = size * repetitions, repetitions a whole number of 0 .. epochs. A source's
    taken words miss its target by at most half of one document. The order of the draw is md5(seed:id:size), ties by id,
    size and a hash of the text, so reruns agree; rows equal in all of these are interchangeable. A null source is a source of its own; null ids are drawn
    like others. Empty tables give empty results.
    """
    sized = cut(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"), F.struct(F.lit(0).alias("none"), *keep).alias("kept")).withColumn(
            "draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("size").cast("string")))
        )
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = water_fill(cyclic_weights(per_source, cycle), epochs)
    plan = cut(
        plan.withColumn("whole", F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).cast("long"))
        .withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    )
    # draws are summed by leading digits, so that only one digit group of a source needs the order of its documents
    digits = F.substring("draw", 1, DIGITS)
    groups = sized.groupBy("source", digits.alias("digits")).agg(F.sum("size").alias("group_size"))
    before = F.coalesce(F.sum("group_size").over(Window.partitionBy("source").orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = groups.withColumn("before", before).join(small_side(plan.select(F.col("source").alias("__s"), "rest")), F.col("source").eqNullSafe(F.col("__s")))
    edge = cut(near.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("group_size") >= F.col("rest"))).groupBy("source").agg(F.max(F.struct("digits", "before", "group_size")).alias("e")).select("source", F.col("e.digits").alias("edge"), F.col("e.before").alias("before")))
    plan = cut(plan.join(small_side(edge.withColumnRenamed("source", "__s")), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"))
    plan_side = small_side(plan.withColumnRenamed("source", "__s"))
    rows = sized.join(plan_side, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    inner = rows.where(digits == F.col("edge"))
    upto = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("draw", F.col("id").asc_nulls_first(), "size", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a document is drawn if the rest of the target reaches beyond its middle
    inner = inner.withColumn("extra", (F.col("before") + upto + F.col("size") / 2 < F.col("rest")).cast("long"))
    outer = rows.where(F.col("edge").isNull() | (digits != F.col("edge"))).withColumn("extra", F.coalesce(digits < F.col("edge"), F.lit(False)).cast("long"))
    return (
        outer.unionByName(inner)
        .withColumn("repetitions", F.least(F.col("whole") + F.col("extra"), F.lit(epochs)))
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("size") * F.col("repetitions")).alias("taken"), "repetitions", *(F.col(f"kept.{c}").alias(c) for c in keep))
    )
