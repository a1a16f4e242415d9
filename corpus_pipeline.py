"""The corpus pipeline: language ID, line dedup, near-dedup, source mixing and byte-level BPE, each over all that the stage before kept.

Rows keep what they carry from stage to stage: texts are not joined back by id, so null and repeated ids are no special case
but in the near-duplicate stage, which says what it does with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import bpe, language_id, line_dedup, minhash_dedup, mixing
from kindred.llm.common import counted, cut, small_side

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids of rejected documents up to which they are broadcast, after a count.
REJECTED = 1_000_000
#: Memo of the encoder's workers, which share an executor with all that the stages before left in its heap.
MEMO_BYTES = 40 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known; `lang` becomes the language found. Rows without text, and of unknown language, go."""
    found = language_id.identify(docs, language_id.fit(docs), declared=language_id.declared_in(F.col("text")), host=F.col("source"), keep=("text", "source", "n_chars"))
    return found.where("accepted").withColumn("lang", F.col("language")).select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that ten sites or more have; `n_chars` is that of the text left."""
    out = line_dedup.drop_common_lines(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of smallest doc_id.

    Of rows that repeat a doc_id one stays, the first in order of their columns. Rows without doc_id are in no group and stay.
    """
    found = minhash_dedup.near_duplicates(docs, shingle_words=5, percent=80).where("doc_id is not null")
    found = cut(found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    rejected = found.where("not kept").select("doc_id")
    repeated, n = counted(found.where("kept and n > 1").select("doc_id"))
    stay = docs.select(*COLUMNS).join(small_side(rejected, REJECTED), "doc_id", "left_anti")
    if not n:
        return stay
    several = small_side(repeated, REJECTED)
    one = stay.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return stay.join(several, "doc_id", "left_anti").unionByName(one)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. Rows without words weigh nothing and stay once."""
    taken = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("repetitions")).cast("int")
    out = taken.withColumn("times", times).where("times > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the ids of every copy that the mix takes, their number, and a digest of the bytes they decode to."""
    out = bpe.encode(docs, id_cols=("doc_id", "source", "lang"), decoded=True, memo_bytes=MEMO_BYTES)
    return out.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]
#: Language models, MinHash and BPE are not SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
