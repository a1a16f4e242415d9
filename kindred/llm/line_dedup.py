"""Removal of boilerplate lines by the number of distinct sites that have them. DataFrame functions only.

Every line hash gets a HyperLogLog sketch of its sites, built on the map side and merged by aggregation. Lines whose estimate
is near the threshold get exact distinct counts, in a second pass that reads no other lines; the rest are decided by the sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import counted, cut, small_side, unused

#: log2 of the sketch size; the relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 11


def lines_of(text: str | Column) -> Column:
    return F.split(text, "\n", -1)


def two_hashes(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a string, of independent seeds: the hash of a first column seeds that of the next."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def line_key(line: Column) -> Column:
    """The two hashes of a line without blanks at its ends; null for a blank line."""
    bare = F.trim(F.regexp_replace(line, r"[\t\r]", " "))
    h1, h2 = two_hashes(bare)
    return F.when(bare != "", F.struct(h1.alias("h1"), h2.alias("h2")))


def boilerplate(docs: DataFrame, text_col: str, site_col: str, sites: int, margin: float) -> DataFrame:
    """Keys (h1, h2) of the lines on `sites` distinct sites or more. A null site counts as one site.

    `margin` is the share of the threshold within which a sketch does not decide: over ten of its standard errors.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("n"))
    lines = docs.select(site.alias("site"), F.explode(F.array_distinct(F.transform(lines_of(text_col), line_key))).alias("k")).where("k is not null").select("k.*", "site")
    # map sides merge sketches, so a line in a third of all rows sends one sketch a task
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = cut(sketches.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites * (1 - margin)))
    near, n = counted(spread.where(F.col("estimate") <= sites * (1 + margin)).select("h1", "h2"))
    sure = spread.where(F.col("estimate") > sites * (1 + margin)).select("h1", "h2")
    if not n:
        return sure
    exact = lines.join(small_side(near), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= sites)
    return sure.unionByName(exact.select("h1", "h2"))


def drop_common_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = 10, margin: float = 0.25) -> DataFrame:
    """`docs` with `text_col` freed of lines on `sites` distinct sites or more, and `n_lines`, `n_removed`.

    Lines are compared without blanks at their ends; blank lines stay. A null text stays null with 0 lines; an empty text is
    one blank line. Rows may repeat: each is cleaned. All columns are kept; `n_lines` and `n_removed` of the input are replaced.
    """
    common = cut(boilerplate(docs, text_col, site_col, sites, margin))
    plain = docs.drop("n_lines", "n_removed")
    t1, t2 = two_hashes(F.col(text_col))
    keyed = plain.select(t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text")).where("text is not null")
    at = keyed.select("t1", "t2", F.posexplode(F.transform(lines_of("text"), line_key)).alias("pos", "k")).where("k is not null").select("t1", "t2", "pos", "k.*")
    hits = at.join(small_side(common), ["h1", "h2"])
    # equal texts share their positions: decisions hang on the text alone
    flags = cut(hits.groupBy("t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("removed")))
    k1, k2, gone, split = (unused(plain, x) for x in ("__t1", "__t2", "__removed", "__lines"))
    # null texts have no flags; their keys are spread by id
    spread = F.xxhash64(F.lit(2), *([F.col(id_col)] if id_col in plain.columns else []), F.col(site_col))
    rows = plain.withColumns({k1: F.when(F.col(text_col).isNull(), spread).otherwise(t1), k2: F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(t2)})
    joined = rows.join(flags.toDF(k1, k2, gone), [k1, k2], "left")
    # runs of kept lines lie between removed positions, so the text is rebuilt from slices in one pass
    edges = F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(split)))
    runs = F.filter(
        F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges)), lambda a, b: F.struct((a + 1).alias("from"), (b - a - 1).alias("n"))), lambda r: r["n"] > 0
    )
    kept = F.array_join(F.transform(runs, lambda r: F.array_join(F.slice(F.col(split), r["from"] + 1, r["n"]), "\n")), "\n")
    out = joined.withColumn(split, lines_of(text_col)).withColumns(
        {
            "n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
            text_col: F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept),
        }
    )
    return out.select(*plain.columns, "n_lines", "n_removed")
