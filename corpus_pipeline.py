"""The training-data pipeline: its stages in order, each written as Parquet and read again as the next one's documents.

Quality filter, near-duplicate removal, repeated-substring removal, source mixing, encoding. Each stage works on all that
its predecessor kept; every stage but the last returns the columns of documents.

Cases: null and empty texts pass the filters that they satisfy: they are scored like any text, are near-duplicates of
nothing, lose no bytes, have no words to mix (the mix takes none of them) and so don't reach the encoder. Repeated rows are
near-duplicates of each other, of which one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loginloom.llm import bpe, mixing, ngram_join, quality, suffix_dedup
from loginloom.llm.common import spool, table

#: A document goes if the chance of label 1 is below this: only clear rejections.
LEAST_QUALITY = 0.5


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter(F.col("quality_score") >= LEAST_QUALITY).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the least doc_id; of rows repeated in full, one."""
    found = ngram_join.classes(docs)
    kept = found.filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return rows.withColumn("_version", F.xxhash64("text")).dropDuplicates(["doc_id", "_version"]).select(*docs.columns)


def remove_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier place holds too; characters cut in their middle go. Emptied documents go."""
    rows = suffix_dedup.remove(docs, as_text=True)
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_bytes"))
    text = F.when(F.col("text").isNotNull(), F.col("dedup_text"))
    return _recounted(rows.filter(~emptied).withColumn("text", text), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, one row for each copy taken, shuffled within output shards."""
    return mixing.draw(mixing.mix(docs), docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text that is left."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("suffix-array dedup", remove_repeated_substrings),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_texts),
]

#: SQL can't express the classifier, the draws of the mix or the merges by rank; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = spool(docs, f"stage{k}")
    return docs
