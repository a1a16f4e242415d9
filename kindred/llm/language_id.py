"""Language identification by Bayesian fusion of text, declared markup language, address suffix and host priors.

Text likelihoods come from byte 3-gram tables of each language, fitted on a bounded sample of labelled rows; a uniform table
stands for text of no known language ("und"). How declared languages, suffixes and hosts go with languages is counted over
the whole corpus by grouped aggregation of the text decisions; host counts are smoothed towards their domain's, those
towards the corpus's. A row's own decision is taken out of the counts it is judged by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import cut, join_hot, sliced

UNKNOWN = "und"
#: Bound of the fit: labelled rows for each language, whose texts count whole; languages at most.
SAMPLE_ROWS, MOST_LANGUAGES = 200, 200
#: Parts of a language that a draw ranks on their own first, as one language may hold most rows.
PARTS = 16
BUCKETS = 1 << 16
#: Grams that a text's evidence weighs like at most; grams repeat what their neighbours say.
EVIDENCE = 60
#: Kinds of evidence but the text, as columns of a row.
LEVELS = ("host", "domain", "declared", "suffix")
#: Values of a level up to which their counts are broadcast.
FEW_VALUES = 20_000


@dataclass(frozen=True)
class Model:
    """Languages in code-point order, and log probabilities (BUCKETS, languages + 1) as float32, the last column that of "und"."""

    languages: tuple[str, ...]
    table: np.ndarray


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte 3-gram."""
    x = data.astype(np.uint32)
    h = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)
    return h >> np.uint32(16)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = SAMPLE_ROWS, seed: int = 42) -> Model:
    """A model of the languages that `label_col` names.

    The sample is bounded: for each language the `rows` labelled rows of smallest seeded hash of id and text, rows equal in both
    once. Their whole texts are counted in tasks; only one row of BUCKETS counts a language reaches the driver. Rows without
    label or text, or labelled "und", are not fitted on. More than MOST_LANGUAGES labels raise.
    """
    labelled = docs.where(F.col(label_col).isNotNull() & (F.col(label_col) != UNKNOWN) & F.col(text_col).isNotNull())
    label, draw = F.col(label_col).cast("string"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    languages = tuple(sorted(r[0] for r in labelled.select(label).distinct().limit(MOST_LANGUAGES + 1).collect()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # the first rows of each part of a language, then those of the language; texts are fetched for the rows drawn alone
    first, n = labelled.select(label.alias("l"), draw.alias("draw")).distinct(), F.row_number()
    for part in ([F.pmod("draw", F.lit(PARTS))], []):
        first = first.withColumn("n", n.over(Window.partitionBy("l", *part).orderBy("draw"))).where(F.col("n") <= rows).select("l", "draw")
    drawn = F.broadcast(cut(first))  # rows x MOST_LANGUAGES at most
    texts = labelled.select(label.alias("l"), draw.alias("draw"), F.col(text_col).alias("t")).join(drawn, ["l", "draw"], "left_semi").dropDuplicates(["l", "draw"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in sliced(batches, "t"):
            for language, text in zip(batch.column("l").to_pylist(), batch.column("t").to_pylist(), strict=True):
                data = text.lower().encode()
                n = found.setdefault(language, np.zeros(BUCKETS, np.int64))
                for k in range(0, len(data) - 2, 1 << 18):
                    n += np.bincount(grams(np.frombuffer(data, np.uint8, min(len(data) - k, (1 << 18) + 2), k)), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([n.tobytes() for n in found.values()], pa.binary())], names=["l", "n"])

    def add(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"l": [p.l.iloc[0]], "n": [sum(np.frombuffer(x, np.int64) for x in p.n).tobytes()]})

    table = np.full((BUCKETS, len(languages)), 0.5)
    # tasks tally whole languages, as texts are dealt by few of them at a time
    for r in texts.repartition("l").mapInArrow(tally, "l string, n binary").groupBy("l").applyInPandas(add, "l string, n binary").collect():
        table[:, languages.index(r.l)] += np.frombuffer(r.n, np.int64)
    logs = np.log(table / table.sum(axis=0))
    return Model(languages, np.concatenate([logs, np.full((BUCKETS, 1), -np.log(BUCKETS))], axis=1).astype(np.float32))


def score(df: DataFrame, table: np.ndarray, text_col: str) -> DataFrame:
    """`df` without `text_col`, with `ll array<double>` (mean log likelihood of a gram for each language), `n_grams` and `vote`.

    The vote is the number of the likeliest language, the first of equals; null for a row without text.
    """
    at = df.columns.index(text_col)
    names = [c for c in df.columns if c != text_col]
    shared = df.sparkSession.sparkContext.broadcast(table)  # bounded: BUCKETS x (MOST_LANGUAGES + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sliced(batches, text_col, 4 << 20):
            texts = [f" {t.lower()} ".encode() if t else b"" for t in batch.column(at).to_pylist()]
            n = np.array([max(0, len(t) - 2) for t in texts])
            sums = np.zeros((len(texts), m.shape[1]))
            for i, t in enumerate(texts):
                for k in range(0, n[i], 1 << 18):
                    sums[i] += m[grams(np.frombuffer(t, np.uint8, min(len(t) - k, (1 << 18) + 2), k))].sum(axis=0, dtype=np.float64)
            mean = sums / np.maximum(n, 1)[:, None]
            ll = pa.ListArray.from_arrays(np.arange(0, mean.size + 1, m.shape[1], dtype=np.int32), pa.array(mean.ravel()))
            vote = pa.array(mean.argmax(axis=1), pa.int32(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), ll, pa.array(n, pa.int64()), vote], names=[*names, "ll", "n_grams", "vote"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text_col)
    return df.mapInArrow(run, f"{schema}, ll array<double>, n_grams long, vote int")


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def declared_in(markup: Column) -> Column:
    """Primary subtag of the lang attribute of <html>, in lower case; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(markup, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1), F.lit("")))


def visible(markup: Column) -> Column:
    return F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def identify(
    df: DataFrame,
    model: Model,
    *,
    id_col: str = "doc_id",
    text: Column | None = None,
    declared: Column | None = None,
    host: Column | None = None,
    keep: tuple[str, ...] = (),
    strength: float = 20.0,
    least: float = 0.3,
) -> DataFrame:
    """(id, the columns of `keep`, language, confidence, accepted, posterior) of every row.

    A row without text (null or empty) is "und" and not accepted. Missing declarations, suffixes or hosts are no
    evidence. Ties go to the language that comes first, "und" last. Repeated rows and null ids are each answered and each
    counted as evidence. Not accepted: "und", or a confidence under `least`. An empty table gives an empty result.

    Counts c of decisions by host, domain, declared language and suffix leave out the row's own. With p the share of each
    language in the corpus (add-one, of all decisions) and s = `strength`: domain = (c + s p) / (n + s), host = (c + s domain)
    / (n + s), and for declared language and suffix the factor (c + s p) / (n + s) / p.
    """
    names = [*model.languages, UNKNOWN]
    none = F.lit(None).cast("string")
    text, declared, host = text if text is not None else F.col("text"), declared if declared is not None else none, host if host is not None else none
    src = df.select(F.struct(F.col(id_col).alias(id_col), *(F.col(c) for c in keep)).alias("row"), text.alias("text"), declared.alias("declared"), host.alias("host"))
    labels = F.split("host", r"\.")
    src = src.withColumns({"suffix": F.when(F.size(labels) > 1, F.element_at(labels, -1)), "domain": F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("host"))})
    voted = cut(score(src, model.table, "text"))

    def counts(level: str) -> DataFrame:
        """Decisions of each value of a level, an array by language, and how many rows have the value."""
        per = voted.where(F.col(level).isNotNull()).groupBy(level)
        return cut(per.agg(F.array(*(F.count_if(F.col("vote") == k) for k in range(len(names)))).alias(f"{level}_c"), F.count(F.lit(1)).alias("n")))

    total = voted.agg(*(F.count_if(F.col("vote") == k) for k in range(len(names)))).collect()[0]
    prior = np.array([(c + 1.0) / (sum(total) + len(names)) for c in total])
    joined = voted
    for level in LEVELS:
        joined = join_values(joined, counts(level), level)
    out = fuse(joined, prior, names, strength).select("row.*", "language", "confidence", "posterior")
    accepted = (F.col("language") != UNKNOWN) & (F.col("confidence") >= least)
    return out.select(id_col, *keep, "language", "confidence", accepted.alias("accepted"), "posterior")


def lists(column: pa.ListArray, width: int) -> np.ndarray:
    """A column of lists of one length as a matrix, with zeros for nulls."""
    out = np.zeros((len(column), width))
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out[there] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def fuse(df: DataFrame, prior: np.ndarray, names: list[str], strength: float) -> DataFrame:
    """(row, language, confidence, posterior) from likelihoods, votes and the counts of each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_grams").to_numpy()
            own = np.zeros((batch.num_rows, len(names)))
            voted = np.flatnonzero(n)
            own[voted, batch.column("vote").drop_null().to_numpy()] = 1

            def smoothed(level: str, towards: np.ndarray, batch: pa.RecordBatch = batch, own: np.ndarray = own) -> np.ndarray:
                column = batch.column(f"{level}_c")
                c = lists(column, len(names))
                c = c - np.where(column.is_valid().to_numpy(zero_copy_only=False)[:, None], own, 0)
                return (c + strength * towards) / (c.sum(axis=1, keepdims=True) + strength)

            f = lists(batch.column("ll"), len(names)) * np.minimum(n, EVIDENCE)[:, None]
            f += np.log(smoothed("host", smoothed("domain", prior))) + np.log(smoothed("declared", prior) / prior) + np.log(smoothed("suffix", prior) / prior)
            e = np.exp(f - f.max(axis=1, keepdims=True))
            e /= e.sum(axis=1, keepdims=True)
            best = np.where(n > 0, e.argmax(axis=1), len(names) - 1)
            confidence = np.where(n > 0, e.max(axis=1), 0.0)
            posterior = pa.ListArray.from_arrays(np.arange(0, e.size + 1, e.shape[1], dtype=np.int32), pa.array(e.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([names[k] for k in best], pa.string()), pa.array(confidence), posterior], names=["row", "language", "confidence", "posterior"])

    src = df.select("row", "ll", "n_grams", "vote", *(f"{x}_c" for x in LEVELS))
    return src.mapInArrow(run, f"row {src.schema['row'].dataType.simpleString()}, language string, confidence double, posterior array<double>")


def join_values(rows: DataFrame, values: DataFrame, level: str) -> DataFrame:
    """`rows` with the columns of `values` (one row a value of `level`), nulls for rows without a value.

    Few values are broadcast after a count. Of many, those on many rows are; rows without a value stay out of the shuffle.
    """
    slim = values.drop("n")
    if slim.count() <= FEW_VALUES:
        return rows.join(F.broadcast(slim), level, "left")
    known = join_hot(rows.where(F.col(level).isNotNull()), values, [level])
    absent = rows.where(F.col(level).isNull()).withColumn(f"{level}_c", F.lit(None).cast(slim.schema[f"{level}_c"].dataType))
    return known.unionByName(absent, allowMissingColumns=False)
